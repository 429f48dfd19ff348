"""Near-duplicate documents by an LSH forest, confirmed on full shingle sets.

1. A vectorised pass over the texts gives each document its set of k-word
   shingles (as 64-bit hashes), the set's 128-bit digest and its signature.
   Documents with equal digests have equal sets; one node stands for all of them,
   so groups of copies shrink by partial aggregation before anything else.
2. Every tree of the forest has minhashes of its own, as many as it can be deep,
   so trees fail independently.  A tree is the sorted order of the nodes by them;
   nodes that agree on the first FIRST_DEPTH values lie side by side in it.
3. Neighbours first: the nodes of CHAINS of the orders are sorted with their full
   sets, cut into ranges of equal size.  One pass over a range measures the common
   prefix of each node with those just before it, and links it exactly with the
   ones of longest prefix (up to WINDOW, and the first one of the run) that it is
   not connected with yet.  This takes a linear number of comparisons and connects
   ordinary groups of copies, however large.
4. Then the rest, all of it: a region is a run of a common prefix in any of the
   orders.  Where its nodes are all connected there is nothing left to find.
   Other regions adapt their depth: one of more than REGION nodes is cut by one
   more value, as far as the chance of losing a pair at the threshold in every tree
   stays below MISS; what is still larger is dealt to pairs of blocks of BLOCK
   nodes.  Inside a region every pair of nodes that are not connected is judged:
   by size, by the share of equal minhashes (below ``floor`` no pair at the
   threshold falls but by a chance of one in a million), and then exactly on full
   sets.  A pair that meets in several trees is judged in the first of them.
   Only nodes with such a pair send their sets.
5. The components of all links are the groups.

Candidates are never joined to groups before they are confirmed.  No pair is
dropped, capped or sampled: the only loss is MISS, the chance that a pair at the
very threshold meets in no tree (below 1e-4; measured in the tests).

Defined results: a document without words, or without text, has an empty set
and links with nothing.  Repeated rows are copies of each other; rows of one id
and different texts are one document with the links of all of them (``keep_one``
keeps or drops them together).  A row with a null id takes part and links other
rows, but never stands for a group; a group of such rows alone has a null
component, and ``keep_one`` keeps rows without an id.  Extra columns are ignored
by ``near_duplicates``.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, texthash
from .components import components

TREES = 24
FIRST_DEPTH = 4
MISS = 1e-4
CHAINS = 2
WINDOW = 4
REGION = 1000
BLOCK = 500
SEED = 20240229
BYTES = 2  # of a minhash in a signature
#: Ids that are sent to every task rather than joined by a shuffle: 8 bytes each.
BROADCAST_IDS = 500_000


def depths(percent: int, trees: int = TREES, first: int = FIRST_DEPTH, miss: float = MISS) -> list[int]:
    """Prefix lengths at which a pair at the threshold is lost with a chance of at most ``miss``."""
    found, d = [first], first + 1
    while (1 - (percent / 100) ** d) ** trees <= miss:
        found.append(d)
        d += 1
    return found


def floor(percent: int, hashes: int) -> int:
    """Equal minhashes out of ``hashes`` that a pair at the threshold has but for five standard deviations."""
    p = percent / 100
    return int(hashes * p - 5 * (hashes * p * (1 - p)) ** 0.5)


def _multipliers(n: int) -> np.ndarray:
    return texthash.mix(np.arange(SEED, SEED + n, dtype=np.uint64)) | np.uint64(1)


def signatures(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Minhashes of every set, the lower 16 bits of each; sets must not be empty."""
    out = np.empty((len(at) - 1, n), ">u2")
    for j, m in enumerate(_multipliers(n)):
        h = values * m
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, j] = np.minimum.reduceat((h >> np.uint64(32)).astype(np.uint32), at[:-1]) & np.uint32(0xFFFF)
    return out


def digests(values: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each set's digest; zero for empty sets."""
    s1, s2 = np.zeros(len(to) - 1, np.uint64), np.zeros(len(to) - 1, np.uint64)
    full = np.flatnonzero(np.diff(to))
    if len(full):
        s1[full] = np.add.reduceat(texthash.mix(values + np.uint64(17)), to[:-1][full])
        s2[full] = np.add.reduceat(texthash.mix(values ^ np.uint64(0x5851F42D4C957F2D)), to[:-1][full])
    return s1.view(np.int64), s2.view(np.int64)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first, last) of a batch of (id, text) with the distinct shingles of their texts."""
    body, off = texthash.utf8(batch.column(1))
    for a, b in texthash.slices(off):
        h, at = texthash.words(body[off[a] : off[b]], off[a : b + 1] - off[a])
        yield a, b, *texthash.distinct(*texthash.shingles(h, at, k))


def sketch(documents: DataFrame, k: int, depth: int, key: str, text: str) -> DataFrame:
    """doc, n_shingles, s1, s2 (digest of the set) and sig, the minhashes tree by tree (null for an empty set)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for a, b, values, to in _sets(batch, k):
                n = np.diff(to)
                full = np.flatnonzero(n)
                rows: list[bytes | None] = [None] * (b - a)
                if len(full):
                    for i, sig in zip(full, signatures(values, np.append(to[:-1][full], len(values)), TREES * depth), strict=True):
                        rows[i] = sig.tobytes()
                s1, s2 = digests(values, to)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), pa.array(rows, pa.binary())], names=["doc", "n_shingles", "s1", "s2", "sig"])
        texthash.give_back()

    return documents.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(made, "doc bigint, n_shingles bigint, s1 bigint, s2 bigint, sig binary")


def _few(rows: DataFrame) -> bool:
    """Whether a written table of ids may be sent to every task."""
    return rows.count() <= BROADCAST_IDS


def nodes(slim: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(s1, s2, node, any_id, n_shingles, sig), a row a set; edges (a, b) between the sets of one id; the largest id.

    A set's node is its smallest id.  Where that has other sets too, or no row
    of the set has an id, it is a number above all ids that the digest names.
    """
    high = slim.agg(F.max("doc")).first()[0] or 0
    own = F.struct("s1", "s2")
    several = slim.where("doc IS NOT NULL").groupBy("doc").agg(F.min(own).alias("x"), F.max(own).alias("y")).where("x <> y").select(F.col("doc").alias("shared"))
    several = store.cut(several, "several")
    sets = slim.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc").alias("any_id"), F.min(F.struct("n_shingles", "sig")).alias("x"))
    met = sets.join(F.broadcast(several) if _few(several) else several, F.col("any_id") == F.col("shared"), "left")
    above = F.lit(high + 1) + F.pmod(F.xxhash64("s1", "s2"), F.lit(max(1, (1 << 63) - 2 - high)))
    node = F.when(F.col("any_id").isNull() | F.col("shared").isNotNull(), above).otherwise(F.col("any_id"))
    reps = store.cut(met.select("s1", "s2", node.alias("node"), "any_id", "x.n_shingles", "x.sig"), "nodes")
    theirs = slim.where("n_shingles > 0").join(F.broadcast(several) if _few(several) else several, F.col("doc") == F.col("shared"), "left_semi").select("doc", "s1", "s2").distinct()
    links = theirs.join(reps.select("s1", "s2", "node"), ["s1", "s2"]).select(F.col("doc").alias("a"), F.col("node").alias("b"))
    return reps, links, high


def _region(tree: Column, key: Column, depth: int) -> Column:
    return F.xxhash64(tree, F.substring(key, 1, BYTES * depth))


def forest(reps: DataFrame, depth: int) -> DataFrame:
    """(node, tree, key, region): the nodes with company at FIRST_DEPTH, by tree."""
    width = BYTES * depth
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("sig", t * width + 1, F.lit(width)).alias("key")))
    rows = reps.select("node", F.explode(trees).alias("t")).select("node", "t.tree", "t.key").withColumn("region", _region(F.col("tree"), F.col("key"), FIRST_DEPTH))
    # Written, so that the join reads plain shuffles and a region of many nodes can be split.
    heads = store.cut(rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("region"), "heads")
    return store.cut(rows.join(heads, "region"), "forest")


def full_sets(documents: DataFrame, wanted: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(node, shingles) of the wanted nodes (s1, s2, node, any_id), the sets as sorted 64-bit numbers."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for a, b, values, to in _sets(batch, k):
                packed = [values[to[i] : to[i + 1]].tobytes() for i in range(b - a)]
                s1, s2 = digests(values, to)
                yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), pa.array(packed, pa.binary())], names=["s1", "s2", "shingles"])
        texthash.give_back()

    ids = wanted.select(F.col("any_id").alias("wanted_id"))
    rows = documents.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("body"))
    found = rows.join(F.broadcast(ids) if _few(ids) else ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")
    made = found.mapInArrow(sets, "s1 bigint, s2 bigint, shingles binary").dropDuplicates(["s1", "s2"])
    return store.cut(made.join(wanted.select("s1", "s2", "node"), ["s1", "s2"]).select("node", "shingles"), "shingles")


class Groups:
    """Which items are connected."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while self.up.get(root, root) != root:
            root = self.up[root]
        while self.up.get(x, x) != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough, exactly."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def common_prefix(x: bytes, y: bytes) -> int:
    """How many minhashes two keys have in common at the front."""
    n = next((i for i, (a, b) in enumerate(zip(x, y, strict=True)) if a != b), len(x))
    return n // BYTES


EDGES = "a bigint, b bigint"


def _edges(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])


def neighbour_links(trees: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact links (a, b) of neighbours in the sorted order of the first trees."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: deque[tuple[bytes, int, np.ndarray]] = deque(maxlen=WINDOW)
        head, groups, tree = None, Groups(), None
        for batch in batches:
            found = []  # between the roots so far, which keeps paths short
            for t, key, node, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = np.frombuffer(shingles.as_buffer(), np.uint64)
                if head is None or t != tree or common_prefix(head[0], key) < FIRST_DEPTH:
                    run.clear()
                    head, groups, tree = (key, node, own), Groups(), t
                else:
                    for _, other, theirs in (*reversed(run), head):
                        x, y = groups.find(node), groups.find(other)
                        if x != y and linked(own, theirs, percent):
                            groups.join(x, y)
                            found.append((x, y))
                run.append((key, node, own))
            yield from _edges(found)
        texthash.give_back()

    parts = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = trees.where(F.col("tree") < CHAINS).select("tree", "key", "node")
    rows = first.join(sets, "node").select("tree", "key", "node", "shingles")
    rows = rows.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    return store.cut(rows.mapInArrow(walk, EDGES), "neighbours")


def mixed_regions(trees: DataFrame, groups: DataFrame, levels: list[int]) -> DataFrame:
    """(region, n, node, comp, tree, depth): nodes in regions with unconnected ones, at the region's depth."""
    rows = trees.join(groups.select(F.col("node").alias("at"), "root"), F.col("node") == F.col("at"), "left").select("node", F.coalesce("root", "node").alias("comp"), "tree", "key", "region")
    found = []
    for depth in levels:
        heads = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("region", "n")
        heads = store.cut(heads, "heads")
        met = store.cut(rows.join(heads, "region").withColumn("depth", F.lit(depth)), "regions")
        found.append(met if depth == levels[-1] else met.where(F.col("n") <= REGION))
        rows = met.where(F.col("n") > REGION).select("node", "comp", "tree", "key", _region(F.col("tree"), F.col("key"), depth + 1).alias("region"))
        if depth != levels[-1] and rows.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select("region", "n", "node", "comp", "tree", "depth")


def meetings(regions: DataFrame) -> DataFrame:
    """(meet, side, node, comp, tree): where the nodes of a region meet.

    A region of at most REGION nodes is one meeting; those of a larger one meet in
    pairs of blocks, where only nodes of different sides are compared.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int")
    small = F.array(F.struct(F.xxhash64("region").alias("meet"), F.lit(0).alias("side")))
    pair = lambda j: F.xxhash64("region", F.least(own, j), F.greatest(own, j))
    large = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(pair(j).alias("meet"), F.when(j == own, 0).when(own < j, 1).otherwise(2).alias("side")))
    rows = regions.select("node", "comp", "tree", F.explode(F.when(F.col("n") <= REGION, small).otherwise(large)).alias("m"))
    return rows.select("m.meet", "m.side", "node", "comp", "tree")


def candidates(sig: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, tree: int, deep: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of unconnected nodes of a meeting that may link, and their equal minhashes.

    ``sig``: (nodes, trees, depth); ``deep``: (nodes, trees), the depth of the node's
    region in each tree, 0 where it has none.  A pair belongs to the first tree in
    which it shares a region.
    """
    m, flat = len(sig), sig.reshape(len(sig), -1)
    least, out = floor(percent, flat.shape[1]), []
    for a in range(0, m, 256):
        same = np.zeros((min(256, m - a), m), np.int16)
        for h in range(flat.shape[1]):
            same += flat[a : a + 256, h, None] == flat[None, :, h]
        small, large = np.minimum(n[a : a + 256, None], n[None, :]), np.maximum(n[a : a + 256, None], n[None, :])
        good = (same >= least) & (100 * small >= percent * large) & (comp[a : a + 256, None] != comp[None, :])
        good &= (side[a : a + 256, None] != side[None, :]) | (side[None, :] == 0)
        i, j = np.nonzero(good)
        i, j, s = i[i + a < j] + a, j[i + a < j], same[i, j][i + a < j]
        for p in range(0, len(i), 50_000):
            x, y = i[p : p + 50_000], j[p : p + 50_000]
            shared = np.cumprod(sig[x] == sig[y], axis=2, dtype=np.uint8).sum(axis=2) >= np.maximum(deep[x], 1)
            first = (shared & (deep[x] > 0)).argmax(axis=1) == tree
            out.append((x[first], y[first], s[p : p + 50_000][first]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def region_links(documents: DataFrame, reps: DataFrame, sets: DataFrame, regions: DataFrame, percent: int, depth: int) -> DataFrame:
    """Exact links (a, b), between components, of all pairs that meet in a region and are not connected."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
        meet, rows = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns[:7]], *[list(c) for c in batch.columns[7:]], strict=True):
                if row[0] != meet:
                    if len(rows) > 1:
                        yield meet, rows
                    meet, rows = row[0], []
                rows.append(row)
        if len(rows) > 1:
            yield meet, rows

    def pairs(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, side, _, comp, tree, n, sig, *_ = zip(*rows, strict=True)
        deep = np.array([np.frombuffer(r[7].as_buffer(), np.uint8) for r in rows])
        sigs = np.array([np.frombuffer(s, f"<u{BYTES}") for s in sig]).reshape(len(rows), TREES, depth)
        return candidates(sigs, np.array(n), np.array(comp), np.array(side), tree[0], deep, percent)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for meet, rows in grouped(batches):
            i, j, _ = pairs(rows)
            some = np.unique(np.concatenate([i, j]))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([meet] * len(some), pa.int64()), pa.array([rows[x][2] for x in some], pa.int64())], names=["meet", "node"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            i, j, same = pairs(rows)
            comp, groups, found = [r[3] for r in rows], Groups(), []
            held = [np.frombuffer(r[8].as_buffer(), np.uint64) for r in rows]
            for p in np.argsort(-same, kind="stable"):
                x, y = int(i[p]), int(j[p])
                if groups.find(comp[x]) != groups.find(comp[y]) and linked(held[x], held[y], percent):
                    groups.join(comp[x], comp[y])
                    found.append((comp[x], comp[y]))
            yield from _edges(found)
        texthash.give_back()

    by_tree = F.map_from_entries(F.collect_list(F.struct("tree", "depth")))  # one entry a tree
    deep = regions.groupBy(F.col("node").alias("of")).agg(by_tree.alias("d"))
    deep = deep.select("of", F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.lpad(F.hex(F.coalesce(F.try_element_at("d", t), F.lit(0))), 2, "0")), "")).alias("deep"))
    wide = store.cut(reps.select("node", "n_shingles", "sig").join(deep, F.col("node") == F.col("of")).drop("of"), "mixed")
    met = meetings(regions)
    columns = ["meet", "side", "node", "comp", "tree", "n_shingles", "sig", "deep"]
    rows = met.join(wide, "node").select(*columns).repartition(parts, "meet").sortWithinPartitions("meet", "node")
    asked = store.cut(rows.mapInArrow(ask, "meet bigint, node bigint"), "asked")
    rows = met.join(asked, ["meet", "node"], "left_semi").join(wide, "node").join(sets, "node").select(*columns, "shingles")
    return store.cut(rows.repartition(parts, "meet").sortWithinPartitions("meet", "node").mapInArrow(link, EDGES), "region_links")


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: id, n_shingles, component_id, kept (it is the group's smallest id)."""
    store.small_batches(documents.sparkSession)
    levels = depths(percent)
    slim = store.cut(sketch(documents, k, levels[-1], key, text), "sketch")
    reps, id_links, high = nodes(slim)
    trees = forest(reps, levels[-1])
    company = trees.select(F.col("node").alias("with")).distinct()
    wanted = store.cut(reps.select("s1", "s2", "node", "any_id").join(company, F.col("node") == F.col("with"), "left_semi"), "wanted")
    sets = full_sets(documents, wanted, k, key, text)
    near = neighbour_links(trees, sets, percent)
    id_links = store.cut(id_links, "id_links")
    groups = components(near.unionByName(id_links), "groups")
    rest = components(region_links(documents, reps, sets, mixed_regions(trees, groups, levels), percent, levels[-1]), "rest")
    # Components of components: a node leads to its group's root, and that to its own.
    merged = rest.select(F.col("node").alias("at"), F.col("root").alias("top"))
    roots = groups.join(merged, F.col("root") == F.col("at"), "left").select("node", F.coalesce("top", "root").alias("root"))
    lone = rest.join(groups, "node", "left_anti").select("node", "root")
    roots = store.cut(roots.unionByName(lone), "roots")
    named = lambda c: F.when(c <= high, c)
    of_set = reps.select("s1", "s2", "node").join(roots.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select("s1", "s2", F.coalesce("root", "node").alias("of_set"))
    of_id = store.cut(id_links.select(F.col("a").alias("several")).distinct().join(roots, F.col("several") == F.col("node")).select("several", F.col("root").alias("of_id")), "of_id")
    rows = slim.drop("sig").join(of_set, ["s1", "s2"], "left").join(F.broadcast(of_id) if _few(of_id) else of_id, F.col("doc") == F.col("several"), "left")
    component = F.when(F.coalesce("of_id", "of_set").isNull(), F.col("doc")).otherwise(named(F.coalesce("of_id", "of_set")))
    return rows.select(F.col("doc").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(False)).alias("kept"))


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that another one of their group stands for."""
    name = store.free_prefix(documents) + "gone"
    gone = near_duplicates(documents, k, percent, key, text).where(~F.col("kept") & F.col(key).isNotNull()).select(F.col(key).alias(name)).distinct()
    gone = store.cut(gone, "gone")
    return documents.join(F.broadcast(gone) if _few(gone) else gone, F.col(key) == F.col(name), "left_anti")


def oracle(k: int = 5, percent: int = 80) -> str:
    """All pairs that share a shingle, exactly, and their components by recursion; for small tables."""
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, CASE WHEN len(w) < {k} THEN array_to_string(w, ' ') ELSE {gram} END AS g
    FROM words, LATERAL (SELECT unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS i) WHERE len(w) > 0)),
sizes AS (SELECT w.doc_id, count(g.g) AS n FROM words w LEFT JOIN grams g USING (doc_id) GROUP BY w.doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hit FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * hit >= {percent} * (x.n + y.n - hit)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept FROM sizes JOIN reach ON a = doc_id GROUP BY doc_id, n"""
