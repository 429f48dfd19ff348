"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is over characters, of order ORDER, one for each language, trained on
the trusted documents (labelled good and not toxic), all of them.

1. Each task counts the n-grams of its trusted texts and merges the counts
   before they are shuffled, so a frequent n-gram is one row a task.
2. Counts become probabilities by joins that are sharded by context and by
   suffix: counts of counts give each language three discounts per order, context
   totals the interpolation weights, and the next lower order (whose counts are
   the numbers of distinct letters in front) the rest.
3. Documents are scored against the table.  It grows with the n-grams that a
   language has, which level off, and not with the corpus; if it has at most
   TABLE_ROWS rows it goes to every task, and no text is shuffled.  Beyond that
   documents are dealt to blocks: a block's distinct n-grams are joined to the
   table's shards, and the block gets their values back.  Both ways give the same
   numbers; the second moves every text once.
4. A short text's perplexity says little, so it is drawn to the mean of the
   language's trusted text, which counts as PRIOR further characters.  As a mean
   over a long text hides a few bad words, a text's peak is judged too: the
   highest perplexity of any WINDOW characters in a row that are all letters or
   stand between words.  Numbers, addresses and signs surprise in good texts as
   well; with them in, they would set the threshold, and bad words pass below it.
5. The thresholds of a language are the QUANTILE of the adjusted perplexities and
   that of the peaks of its trusted documents.  For the peaks each trusted document
   is scored by a model of the other folds, as any 4-gram that it alone has is no
   surprise to a model of its own; copies of a text share a fold.  Adjusted
   perplexities are those under the whole model, which is the stricter of the two.
   Documents above either threshold are rejected.

Defined results: a null or empty text, or one whose language is null or has no
trusted text, has no perplexity and is kept, as nothing speaks against it.  A text
without WINDOW such characters in a row has no peak.  A language whose trusted text is all
in one fold takes its peaks from the whole model.  Trusted means at least
one label row says so.  Repeated rows give repeated rows, and count as often in
training.  Characters beyond the basic plane count as one.  Extra columns are
ignored by ``judge`` and kept by ``reject``.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store, texthash

ORDER = 4
PRIOR = 64
QUANTILE = 0.995
WINDOW = 6
FOLDS = 2
#: Rows of a model (15 bytes each, 60 MB in all) that go to every task as they are.
TABLE_ROWS = 4_000_000
BLOCK_BYTES = 64 << 20
#: Ids that are sent to every task rather than joined by a shuffle: 8 bytes each.
BROADCAST_IDS = 500_000
HELD = 500_000
SLICE_BYTES = 512 << 10
START, ASTRAL = 2, 0xFFFF
U = np.uint64
BETWEEN = " \n.,;:!?'\u2019-"
#: For each character whether it is a letter, a mark on one, or stands between words.
PLAIN = np.array([unicodedata.category(chr(c))[0] in "LM" or chr(c) in BETWEEN for c in range(1 << 16)])


def grams(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each character of each text, and their offsets."""
    n = len(offsets) - 1
    points = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.zeros(len(body) + 1, np.int64)
    np.cumsum((body & 0xC0) != 0x80, out=at[1:])
    at = at[offsets]
    doc = np.repeat(np.arange(n), np.diff(at))
    lead = ORDER - 1
    c = np.full(len(points) + lead * n, START, np.uint64)
    flat = np.minimum(points, ASTRAL).astype(np.uint64)
    flat[(flat == 9) | (flat == 11) | (flat == 12) | (flat == 13)] = 32
    own = np.arange(len(points)) + lead * (doc + 1)
    c[own] = flat
    k = c.copy()
    for j in range(1, ORDER):
        k[j:] |= c[:-j] << U(16 * j)
    return k[own], at


def plain(k: np.ndarray) -> np.ndarray:
    """Whether the last character of each n-gram may be in a peak."""
    return PLAIN[(k & U(ASTRAL)).astype(np.int64)]


def peaks(cost: np.ndarray, at: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """The highest mean cost of WINDOW characters in a row, all of them ``ok``, of each text; nan for texts without."""
    size, out = np.diff(at), np.full(len(at) - 1, np.nan)
    long = np.flatnonzero(size >= WINDOW)
    if len(long):
        total = np.zeros(len(cost) + 1)
        np.cumsum(cost, out=total[1:])
        mean = np.full(len(cost), -np.inf)
        mean[: len(cost) - WINDOW + 1] = (total[WINDOW:] - total[:-WINDOW]) / WINDOW
        other = np.zeros(len(cost) + 1, np.int64)
        np.cumsum(~ok, out=other[1:])
        mean[: len(cost) - WINDOW + 1][other[WINDOW:] > other[:-WINDOW]] = -np.inf
        for j in range(1, WINDOW):  # windows that reach into the next text
            mean[at[1:][size >= j] - j] = -np.inf
        out[long] = np.maximum.reduceat(mean, at[:-1][size > 0])[size[size > 0] >= WINDOW]
        out[np.isneginf(out)] = np.nan
    return out


def count_grams(trusted: DataFrame) -> DataFrame:
    """(lang, gram, c): the 4-grams of columns ``lang`` and ``text``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)

        def rows(lang: str, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n[i : i + 100_000])], names=["lang", "gram", "c"])

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                body, off = texthash.utf8(batch.column(1).filter(pa.array(langs == lang)))
                for a, b in texthash.slices(off, SLICE_BYTES):
                    keys, _ = grams(body[off[a] : off[b]], off[a : b + 1] - off[a])
                    held.setdefault(lang, []).append(np.unique(keys, return_counts=True))
                if sum(len(k) for k, _ in held[lang]) > HELD:
                    held[lang] = [merged(held[lang])]
                    if len(held[lang][0][0]) > HELD // 2:
                        yield from rows(lang, *held.pop(lang)[0])
        for lang, parts in held.items():
            yield from rows(lang, *merged(parts))
        held.clear()
        texthash.give_back()

    store.small_batches(trusted.sparkSession)
    found = trusted.select("lang", "text").mapInArrow(counted, "lang string, gram bigint, c bigint")
    return found.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _mask(order: int) -> Column:
    return F.lit((1 << 16 * order) - 1)


def _level(counts: DataFrame, lower: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Probabilities (lang, gram, p) and context weights (lang, context, gamma) of one order."""
    n = lambda i: F.count_if(F.col("c") == i).cast("double")
    cc = counts.groupBy("lang").agg(*[n(i).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    discount = lambda i: F.greatest(F.least(i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0)), F.lit(float(i) - 0.05)), F.lit(0.05))
    cc = cc.select("lang", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
    counts = counts.withColumn("context", F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("bigint"))
    contexts = counts.groupBy("lang", "context").agg(F.sum("c").alias("total"), n(1).alias("m1"), n(2).alias("m2"), F.count_if(F.col("c") > 2).cast("double").alias("m3"))
    weight = (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total")
    contexts = contexts.join(cc, "lang").select("lang", "context", "total", "d1", "d2", "d3", weight.alias("gamma"))
    own = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    met = counts.join(contexts, ["lang", "context"]).withColumn("suffix", F.col("gram").bitwiseAND(_mask(order - 1)) if order > 1 else F.lit(0).cast("bigint"))
    met = met.select("lang", "gram", "suffix", ((F.col("c") - own) / F.col("total")).alias("a"), "gamma").join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low")), ["lang", "suffix"])
    return met.select("lang", "gram", (F.col("a") + F.col("gamma") * F.col("low")).alias("p")), contexts.select("lang", "context", "gamma")


def train(trusted: DataFrame, teaches: Column | None = None) -> DataFrame:
    """(kind, lang, gram, value): log p of seen n-grams under kinds 1-4, log weights of
    contexts under kinds 11-13, and the log p of an unseen character under kind 0.

    ``trusted``: lang, text.  ``teaches``: the models that text of a ``lang`` goes
    into, its own by default; texts are counted once, whatever their number.
    """
    found = count_grams(trusted)
    if teaches is not None:
        found = found.select(F.explode(teaches).alias("lang"), "gram", "c").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    counts = {ORDER: store.cut(found, "grams")}
    for order in range(ORDER - 1, 0, -1):
        above = counts[order + 1].select("lang", F.col("gram").bitwiseAND(_mask(order)).alias("gram"))
        counts[order] = store.cut(above.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c")), "grams")
    lower = counts[1].groupBy("lang").agg((1.0 / (F.count(F.lit(1)) + 1)).alias("p")).select("lang", F.lit(0).cast("bigint").alias("gram"), "p")
    rows, uniform = None, lower
    for order in range(1, ORDER + 1):
        lower, weights = _level(counts[order], lower, order)
        lower = store.cut(lower, "probabilities")
        if order == 1:
            zero = weights.join(uniform, "lang").select(F.lit(0).alias("kind"), "lang", F.lit(0).cast("bigint").alias("gram"), F.log(F.col("gamma") * F.col("p")).alias("value"))
            rows = zero
        else:
            rows = rows.unionByName(weights.select(F.lit(9 + order).alias("kind"), "lang", F.col("context").alias("gram"), F.log("gamma").alias("value")))
        rows = rows.unionByName(lower.select(F.lit(order).alias("kind"), "lang", "gram", F.log("p").alias("value")))
    return store.cut(rows, "model")


def _values(wanted: DataFrame, model: DataFrame) -> DataFrame:
    """(label, gram, value): log p of distinct n-grams, by joins with the model's shards.

    From the highest order down: a seen n-gram's probability closes it, an unseen
    one adds the weight of its context, if that was seen, and goes on with its suffix.
    """
    found = wanted.select("label", "gram", F.lit(0.0).alias("value"), F.lit(True).alias("open"))

    def add(found: DataFrame, kind: int, part: Column, closes: bool) -> DataFrame:
        shard = model.where(F.col("kind") == kind).select(F.col("lang").alias("l"), F.col("gram").alias("g"), F.col("value").alias("v"))
        met = found.withColumn("part", part).join(shard, (F.col("label") == F.col("l")) & (F.col("part") == F.col("g")), "left")
        value = F.col("value") + F.when(F.col("open"), F.coalesce("v", F.lit(0.0))).otherwise(0.0)
        return met.select("label", "gram", value.alias("value"), (F.col("open") & F.col("v").isNull() if closes else F.col("open")).alias("open"))

    found = add(found, ORDER, F.col("gram"), True)
    for order in range(ORDER - 1, -1, -1):
        if order:
            whole = F.col("gram") if order == ORDER - 1 else F.col("gram").bitwiseAND(_mask(order + 1))
            found = add(found, 10 + order, F.shiftrightunsigned(whole, 16), False)
        found = add(found, order, F.col("gram").bitwiseAND(_mask(order)), True)
    return found.where(~F.col("open")).select("label", "gram", "value")


class Table:
    """The model as one open-addressing table: 64-bit mixed keys and log values."""

    def __init__(self, langs: list[str], kind: np.ndarray, lang: np.ndarray, gram: np.ndarray, value: np.ndarray):
        self.langs = {x: i for i, x in enumerate(langs)}
        keys = self.key(kind, lang, gram)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.values = (keys, value) if len(keys) else (np.zeros(1, np.uint64), np.zeros(1))
        place, left = (keys >> U(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self.slots[place[left]] < 0
            self.slots[place[left[free]]] = left[free]
            left = left[self.slots[place[left]] != left]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def key(kind, lang, gram: np.ndarray) -> np.ndarray:
        salt = texthash.mix(np.asarray(kind, np.uint64) * U(0x9E3779B97F4A7C15) + np.asarray(lang, np.uint64) * U(0xC2B2AE3D27D4EB4F) + U(1))
        return texthash.mix(gram ^ salt)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys, and whether each is there."""
        value, there = np.zeros(len(keys)), np.zeros(len(keys), bool)
        place, left = (keys >> U(64 - self.bits)).astype(np.int64), None
        while True:
            slot = self.slots[place if left is None else place[left]]
            hit = (slot >= 0) & (self.keys[slot] == (keys if left is None else keys[left]))
            at = np.flatnonzero(hit) if left is None else left[hit]
            value[at], there[at] = self.values[slot[hit]], True
            on = (slot >= 0) & ~hit
            left = np.flatnonzero(on) if left is None else left[on]
            if not len(left):
                return value, there
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)

    def log_p(self, k: np.ndarray, lang: np.ndarray) -> np.ndarray:
        out, there = self.find(self.key(ORDER, lang, k))
        left = np.flatnonzero(~there)
        for order in range(ORDER - 1, -1, -1):
            if not len(left):
                break
            context = k[left] >> U(16) if order == ORDER - 1 else (k[left] & U((1 << 16 * (order + 1)) - 1)) >> U(16)
            if order:
                out[left] += self.find(self.key(10 + order, lang[left], context))[0]
            value, there = self.find(self.key(order, lang[left], k[left] & U((1 << 16 * order) - 1)))
            out[left] += value
            left = left[~there]
        return out


def _sent(model: DataFrame):
    """The model in a broadcast variable, language names as numbers; the caller has checked its size."""
    spark = model.sparkSession
    langs = sorted(r["lang"] for r in model.select("lang").distinct().collect())
    number = spark.createDataFrame(list(enumerate(langs)), "number int, name string")
    t = model.join(F.broadcast(number), F.col("lang") == F.col("name")).select(F.col("kind").cast("tinyint"), F.col("number").cast("smallint"), "gram", F.col("value").cast("float")).toArrow().combine_chunks()
    return spark.sparkContext.broadcast((langs, *[t[c].to_numpy() for c in ("kind", "number", "gram", "value")]))


_tables: dict[str, Table] = {}


def _table(name: str, sent) -> Table:
    if name not in _tables:
        _tables.clear()
        langs, kind, lang, gram, value = sent.value
        _tables[name] = Table(langs, kind, lang, gram.view(np.uint64), value)
    return _tables[name]


def _columns(labels: dict[str, str]) -> list[str]:
    return [f"{c}{end}" for c in labels.values() for end in ("", "_peak")]


def _schema(documents: DataFrame, labels: dict[str, str]) -> T.StructType:
    return T.StructType([*documents.schema.fields, *[T.StructField(c, T.DoubleType()) for c in _columns(labels)]])


def score(documents: DataFrame, model: DataFrame, text: str, labels: dict[str, str], largest: int = TABLE_ROWS) -> DataFrame:
    """``documents`` with the log perplexity of each text and its peak's.

    ``labels``: for each column that names a document's model (null: none) the column
    that gets the log perplexity; the peak's goes to that with ``_peak`` behind it.
    Both are null without a model.
    """
    store.small_batches(documents.sparkSession)
    if model.count() > largest:
        return score_by_blocks(documents, model, text, labels)
    sent, name = _sent(model), uuid.uuid4().hex
    at_text, at_labels = documents.columns.index(text), [documents.columns.index(c) for c in labels]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        table = _table(name, sent)
        for batch in batches:
            codes = [np.array([table.langs.get(x, -1) for x in batch.column(i).to_pylist()], np.int64) for i in at_labels]
            body, off = texthash.utf8(batch.column(at_text))
            found = [np.full(batch.num_rows, np.nan) for _ in _columns(labels)]
            for a, b in texthash.slices(off, SLICE_BYTES):
                k, at = grams(body[off[a] : off[b]], off[a : b + 1] - off[a])
                full = np.flatnonzero(np.diff(at))
                for i, code in enumerate(codes):
                    if len(full) and (code[a:b] >= 0).any():
                        of = np.repeat(code[a:b], np.diff(at))
                        lp = np.zeros(len(k))
                        mine = np.flatnonzero(of >= 0)
                        lp[mine] = table.log_p(k[mine], of[mine].astype(np.uint64))
                        found[2 * i][a:b][full] = -np.add.reduceat(lp, at[:-1][full]) / np.diff(at)[full]
                        found[2 * i + 1][a:b] = peaks(-lp, at, plain(k))
            values = [pa.array(x, pa.float64(), mask=(codes[i // 2] < 0) | np.isnan(x)) for i, x in enumerate(found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *values], names=[*batch.schema.names, *_columns(labels)])
        texthash.give_back()

    return documents.mapInArrow(scored, _schema(documents, labels))


def score_by_blocks(documents: DataFrame, model: DataFrame, text: str, labels: dict[str, str]) -> DataFrame:
    """The same for a table of any size: blocks of about BLOCK_BYTES of text ask the model's shards for their n-grams."""
    spark, p = documents.sparkSession, store.free_prefix(documents)
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES), min(spark.sparkContext.defaultParallelism, size >> 20))
    block = F.pmod(F.xxhash64(*[c for c, t in documents.dtypes if "map" not in t]), F.lit(blocks)).cast("int")
    placed = documents.withColumn(f"{p}block", block).repartition(blocks, f"{p}block")

    names = documents.columns
    at_text, at_labels = names.index(text), [names.index(c) for c in labels]

    def parts(texts: pa.Array, groups: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Slices (first, last) of texts with their n-grams, offsets, and each n-gram's group."""
        body, off = texthash.utf8(texts)
        for a, b in texthash.slices(off, SLICE_BYTES):
            k, at = grams(body[off[a] : off[b]], off[a : b + 1] - off[a])
            yield a, b, k, at, [np.repeat(g[a:b], np.diff(at)) for g in groups]

    def coded(names: list, known: dict) -> np.ndarray:
        """Numbers of names; a null has none."""
        return np.array([-1 if None in (x if isinstance(x, tuple) else (x,)) else known.setdefault(x, len(known)) for x in names], np.int64)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            where = batch.column(len(names)).to_pylist()
            groups = [coded(list(zip(where, batch.column(i).to_pylist(), strict=True)), known) for i in at_labels]
            for _, _, k, _, of in parts(batch.column(at_text), groups):
                for own in of:
                    for g in np.unique(own):
                        if g >= 0:
                            mine = held.setdefault(int(g), [])
                            mine.append(np.unique(k[own == g]))
                            if len(mine) > 16:
                                held[int(g)] = [np.unique(np.concatenate(mine))]
        for (where, label), g in known.items():
            keys = np.unique(np.concatenate(held.pop(g, [np.zeros(0, np.uint64)])))
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), where, np.int32)), pa.array([label] * len(part), pa.string()), pa.array(part)], names=["block", "label", "gram"])
        texthash.give_back()

    # The texts are shuffled once: both uses of ``placed`` take all of its columns.  So are the n-grams.
    wanted = placed.mapInArrow(listed, "block int, label string, gram bigint").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "gram")
    values = _values(wanted.select("label", "gram").distinct(), model)
    back = wanted.join(values, ["label", "gram"]).select("block", "label", "gram", "value")
    added = _columns(labels)

    def scored(docs: pa.Table, values: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        known: dict[str, int] = {}
        of_value = coded(values["label"].to_pylist(), known)
        grams_, logs = values["gram"].to_numpy().view(np.uint64), values["value"].to_numpy()
        tables = {}
        for g in known.values():
            mine = np.flatnonzero(of_value == g)
            mine = mine[np.argsort(grams_[mine], kind="stable")]
            tables[g] = grams_[mine], logs[mine]
        out = []
        for batch in docs.select(names).to_batches():
            groups = [np.array([known.get(x, -1) for x in batch.column(i).to_pylist()], np.int64) for i in at_labels]
            found = [np.full(batch.num_rows, np.nan) for _ in added]
            for a, b, k, at, of in parts(batch.column(at_text), groups):
                full = np.flatnonzero(np.diff(at))
                for i, own in enumerate(of):
                    lp = np.zeros(len(k))
                    for g in np.unique(own):
                        if g >= 0:
                            keys, logged = tables[int(g)]
                            mine = own == g
                            lp[mine] = logged[np.searchsorted(keys, k[mine])]
                    if len(full):
                        found[2 * i][a:b][full] = -np.add.reduceat(lp, at[:-1][full]) / np.diff(at)[full]
                        found[2 * i + 1][a:b] = peaks(-lp, at, plain(k))
            masked = [pa.array(x, pa.float64(), mask=np.isnan(x) | (groups[i // 2] < 0)) for i, x in enumerate(found)]
            out.append(pa.RecordBatch.from_arrays([*batch.columns, *masked], names=[*names, *added]))
        texthash.give_back()
        return pa.Table.from_batches(out) if out else pa.table({n: [] for n in [*names, *added]})

    return placed.groupBy(f"{p}block").cogroup(back.groupBy("block")).applyInArrow(scored, _schema(documents, labels))


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct ids of documents labelled good and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col(key).isNotNull()).select(F.col(key).alias("trusted_id")).distinct()


def adjusted(log_ppl: Column, chars: Column, mean: Column) -> Column:
    """The log perplexity with PRIOR characters of the language's mean added."""
    return (log_ppl * chars + PRIOR * mean) / (chars + PRIOR)


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(of_lang, mean, most, most_peak): a language's mean log perplexity, and the adjusted one and the peak above which documents are rejected.

    ``scored``: lang, chars, own (log perplexity), own_peak, and for trusted documents
    ``held_peak``, by a model of the other folds, if there is one.
    """
    known = scored.where("trusted AND own IS NOT NULL").select(F.col("lang").alias("of_lang"), "chars", F.col("own").alias("x"), F.when(F.col("held").isNull(), F.col("own_peak")).otherwise(F.col("held_peak")).alias("peak"))
    means = known.groupBy("of_lang").agg((F.sum(F.col("x") * F.col("chars")) / F.sum("chars")).alias("mean"))
    met = known.join(F.broadcast(means), "of_lang").withColumn("x", adjusted(F.col("x"), F.col("chars"), F.col("mean")))
    return store.cut(met.groupBy("of_lang", "mean").agg(F.percentile_approx("x", quantile, 10_000).alias("most"), F.percentile_approx("peak", quantile, 10_000).alias("most_peak")), "thresholds")


def within_limits(own: Column, most: Column, peak: Column, most_peak: Column) -> Column:
    """Whether neither is above its threshold; what is missing does not speak against a document."""
    return F.coalesce(own <= most, F.lit(True)) & F.coalesce(peak <= most_peak, F.lit(True))


def measured(documents: DataFrame, labels: DataFrame, key: str, text: str, lang: str, p: str) -> DataFrame:
    """``documents`` with, under ``p``: trusted, chars, own, own_peak, held, held_peak.

    Models are trained together: that of all trusted text of a language is named by
    "=" and the language, that without a fold by the fold and the language.
    """
    ids = store.cut(trusted_ids(labels), "trusted").withColumnRenamed("trusted_id", f"{p}id")
    marked = documents.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col(key) == F.col(f"{p}id"), "left")
    trusted = F.col(f"{p}id").isNotNull()
    fold = F.pmod(F.xxhash64(F.col(text)), F.lit(FOLDS)).cast("string")
    marked = marked.select(*documents.columns, trusted.alias(f"{p}trusted"), F.length(text).alias(f"{p}chars"), F.concat(F.lit("="), F.col(lang)).alias(f"{p}whole"), F.when(trusted, F.concat(fold, F.col(lang))).alias(f"{p}other"))
    taught = marked.where(F.col(f"{p}other").isNotNull()).select(F.col(f"{p}other").alias("lang"), F.col(text).alias("text"))
    own_fold, name = F.expr("left(lang, 1)"), F.expr("substr(lang, 2)")
    teaches = F.array_compact(F.array(F.concat(F.lit("="), name), *[F.when(own_fold != str(f), F.concat(F.lit(str(f)), name)) for f in range(FOLDS)]))
    return score(marked, train(taught, teaches), text, {f"{p}whole": f"{p}own", f"{p}other": f"{p}held"})


MEASURES = ["trusted", "chars", "own", "own_peak", "held", "held_peak"]


def judge(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """A row a document: id, lang, perplexity, adjusted perplexity, peak, their thresholds, kept."""
    slim = documents.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    scored = store.cut(measured(slim, labels, "id", "text", "lang", "__").select("id", "lang", *[F.col(f"__{c}").alias(c) for c in MEASURES]), "scored")
    met = scored.join(F.broadcast(thresholds(scored, quantile)), F.col("lang") == F.col("of_lang"), "left")
    own, peak = adjusted(F.col("own"), F.col("chars"), F.col("mean")), F.col("own_peak")
    kept = within_limits(own, F.col("most"), peak, F.col("most_peak"))
    shown = [F.exp(c).alias(name) for c, name in ((F.col("own"), "perplexity"), (own, "adjusted_perplexity"), (F.col("most"), "threshold"), (peak, "peak"), (F.col("most_peak"), "peak_threshold"))]
    return met.select(F.col("id").alias(key), "lang", *shown, kept.alias("kept"))


def reject(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """The documents that are above neither threshold of their language, with all their columns."""
    p = store.free_prefix(documents)
    scored = store.cut(measured(documents, labels, key, text, lang, p).select(*documents.columns, *[p + c for c in MEASURES]), "scored")
    limits = thresholds(scored.select(F.col(lang).alias("lang"), *[F.col(p + c).alias(c) for c in MEASURES]), quantile)
    limits = limits.select(*[F.col(c).alias(p + c) for c in limits.columns])
    met = scored.join(F.broadcast(limits), F.col(lang) == F.col(f"{p}of_lang"), "left")
    own = adjusted(F.col(f"{p}own"), F.col(f"{p}chars"), F.col(f"{p}mean"))
    return met.where(within_limits(own, F.col(f"{p}most"), F.col(f"{p}own_peak"), F.col(f"{p}most_peak"))).select(*documents.columns)
