"""Finding secrets and personal data in texts, JSON cells, metadata and tool calls.

A finding: file, category, pattern, kind, location, fingerprint, preview, reason,
target, combined_with.  Cells are rows (file, location, value); text files are
rows (file, text).  One scan of the values finds all patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detect
from ..functions.jsontext import cell_texts

FINDING = ["file", "category", "pattern", "kind", "location", "fingerprint", "preview", "reason", "target", "combined_with"]

# Shell verbs that show a file's content.
READ_VERBS = ["cat", "type", "more", "less", "head", "tail", "grep", "rg", "findstr", "get-content", "gc", "sed", "awk", "bat", "xxd", "od", "strings", "cp", "copy"]
# Sensitive base names, suffixes and folders.
SENSITIVE_NAMES = [
    ".env", ".envrc", ".netrc", ".npmrc", ".pypirc", ".htpasswd", ".pgpass", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519",
    "credentials", "credentials.toml", "credentials.json", "mcp_config.json", "auth.json", "token.json",
    "secrets.json", "secrets.yaml", "secrets.yml", "secrets.toml",
]
SENSITIVE_SUFFIXES = [".env", ".pem", ".key", ".keystore", ".jks", ".p12", ".pfx", ".kdbx", ".asc"]
SENSITIVE_FOLDERS = [".ssh", ".aws", ".gnupg", ".docker", ".kube", ".azure"]


def _finding(**given: Column) -> list[Column]:
    return [given.get(c, F.lit(None).cast("string")).alias(c) for c in FINDING]


def text_findings(files: DataFrame) -> DataFrame:
    """Findings in whole texts: every match, with its line."""
    rows = detect.each_hit(files, "file")
    return rows.select(
        *_finding(
            file=F.col("file"), category=F.col("h.category"), pattern=F.col("h.pattern"), kind=F.lit("pattern"),
            location=F.concat(F.lit("text:line "), F.col("h.line").cast("string")), fingerprint=detect.fingerprint(F.col("h.value")), preview=detect.mask(F.col("h.value")),
        )
    )


def cell_findings(cells: DataFrame) -> DataFrame:
    """Findings in cells: JSON is scanned leaf by leaf, and the first of each (category, value) of a cell counts."""
    leaves = cells.where("value IS NOT NULL AND value <> ''").select("file", "location", F.posexplode(cell_texts(F.col("value"))).alias("leaf", "text"))
    found = detect.each_hit(leaves, "file", "location", "leaf").select("file", "location", "leaf", "h.*", detect.fingerprint(F.col("h.value")).alias("fp"))
    first = Window.partitionBy("file", "location", "category", "fp").orderBy("leaf", "idx", "value_start")
    found = found.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return found.select(
        *_finding(
            file=F.col("file"), category=F.col("category"), pattern=F.col("pattern"), kind=F.lit("pattern"),
            location=F.concat("location", F.lit(":line "), F.col("line").cast("string")), fingerprint=F.col("fp"), preview=detect.mask(F.col("value")),
        )
    )


def base_name(path: Column) -> Column:
    """The last segment of a path of either kind."""
    flat = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", "")
    return F.substring_index(flat, "/", -1)


def metadata_findings(sessions: DataFrame) -> DataFrame:
    """Project names out of working directories (file, rowid, working_directory)."""
    named = sessions.where(F.col("working_directory").isNotNull() & ~F.contains("working_directory", F.lit(detect.TAG)))
    named = named.withColumn("value", base_name(F.col("working_directory"))).where("value <> ''")
    return named.select(
        *_finding(
            file=F.col("file"), category=F.lit(detect.PROJECT), pattern=F.lit("working_directory"), kind=F.lit("metadata"),
            location=F.concat(F.lit("sessions.working_directory#rowid="), F.col("rowid").cast("string")), fingerprint=detect.fingerprint(F.col("value")), preview=detect.mask(F.col("value")),
        )
    )


def sensitive_path(token: Column) -> Column:
    """Whether a path-like token names a sensitive file."""
    bare = F.btrim(F.trim(token), F.lit("\"'`"))
    norm = F.replace(bare, F.lit("\\"), F.lit("/"))
    base = F.lower(base_name(norm))
    suffix = F.regexp_extract(base, r"^.*[^.].*(\.[^.]+)$", 1)
    named = base.isin(*SENSITIVE_NAMES) | base.startswith(".env") | suffix.isin(*SENSITIVE_SUFFIXES) | F.contains(base, F.lit("credential")) | F.contains(base, F.lit("secret"))
    return (base != "") & (named | F.arrays_overlap(F.split(F.lower(norm), "/"), F.array(*[F.lit(x) for x in SENSITIVE_FOLDERS])))


def tool_call_flag(tool_call_json: Column) -> Column:
    """struct(reason, target) if a tool call reads a sensitive file, else null.

    A shell command counts if any of its tokens is a read verb and one is a
    sensitive path; other calls by their ``path``, then their ``query``.
    """
    at = lambda p: F.get_json_object(tool_call_json, p)
    raw = at("$.rawInput")
    command = F.coalesce(F.nullif(at("$.rawInput.command"), F.lit("")), at("$.title"), F.lit(""))
    tokens = F.filter(F.split(command, r"[|;&>\s]+"), lambda t: t != "")
    target = F.get(F.filter(tokens, sensitive_path), F.lit(0))
    reads = F.exists(tokens, lambda t: F.lower(t).isin(*READ_VERBS))
    flag = lambda reason, target: F.struct(F.lit(reason).alias("reason"), target.alias("target"))
    shell = F.when(reads & target.isNotNull(), flag("shell command reads a sensitive file", target))
    by_key = [F.when(sensitive_path(at(f"$.rawInput.{k}")), flag(f"tool input '{k}' targets a sensitive file", at(f"$.rawInput.{k}"))) for k in ("path", "query")]
    return F.when(raw.startswith("{"), F.when(at("$.kind") == "execute", shell).otherwise(F.coalesce(*by_key)))


def semantic_findings(tool_calls: DataFrame) -> DataFrame:
    """Outputs of tool calls that read a sensitive file (file, rowid, tool_call_json, tool_call_update_json)."""
    rows = tool_calls.withColumn("flag", tool_call_flag(F.col("tool_call_json")))
    output = F.col("tool_call_update_json")
    rows = rows.where(F.col("flag").isNotNull() & output.isNotNull() & ~F.contains(output, F.lit(detect.TAG)))
    return rows.select(
        *_finding(
            file=F.col("file"), category=F.lit(detect.SEMANTIC), pattern=F.lit("sensitive_read"), kind=F.lit("semantic-context"),
            location=F.concat(F.lit("tool_call_state.tool_call_update_json#rowid="), F.col("rowid").cast("string")),
            fingerprint=detect.fingerprint(output), preview=detect.mask(output), reason=F.col("flag.reason"), target=F.col("flag.target"),
        )
    )


def ordered(findings: DataFrame) -> DataFrame:
    """Findings by file, location, category and fingerprint, all as strings."""
    return findings.orderBy("file", "location", "category", "fingerprint")


def secrets(category: Column) -> Column:
    return category.isin(*detect.BLOCKING)


def status(n_secrets: Column, n_findings: Column) -> Column:
    return F.when(n_secrets > 0, "BLOCKED").when(n_findings > 0, "REVIEW").otherwise("CLEAN")


def by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count(F.lit(1)).alias("findings"))


def file_verdicts(files: DataFrame, findings: DataFrame) -> DataFrame:
    """A row a file: findings, secrets, status, and the exit codes of verify and gate.

    ``files``: file, and optionally error (null if it was read).
    """
    errors = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    counts = findings.groupBy("file").agg(F.count(F.lit(1)).alias("findings"), F.count_if(secrets(F.col("category"))).alias("secrets"))
    met = files.select("file", errors.alias("error")).join(counts, "file", "left").select("file", "error", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("secrets", F.lit(0)).alias("secrets"))
    met = met.withColumn("status", status(F.col("secrets"), F.col("findings")))
    hard = F.coalesce(~F.col("error").startswith("skipped:"), F.lit(False))
    verify = F.when(F.col("status") == "CLEAN", 0).otherwise(1)
    gate = F.when(hard, 2).when(F.col("status") == "BLOCKED", 1).otherwise(0)
    return met.select("file", "findings", "secrets", "status", verify.alias("verify_code"), gate.alias("gate_code"))


def report(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files_scanned (binaries left out), totals, by_category and the publication status.

    ``files``: file, type (text, sqlite or binary).
    """
    counts = by_category(findings)
    totals = counts.agg(
        F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"),
        F.coalesce(F.sum(F.when(secrets(F.col("category")), F.col("findings"))), F.lit(0)).alias("secrets"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "findings")))).alias("by_category"),
    )
    scanned = files.agg(F.count_if(F.col("type") != "binary").alias("files_scanned"), F.count_if(F.col("type") == "binary").alias("binaries"))
    return scanned.join(totals).select("files_scanned", "binaries", "findings", "secrets", "by_category", status(F.col("secrets"), F.col("findings")).alias("publication_status"))


def for_session(rows: DataFrame, session_id: str) -> DataFrame:
    """The rows of one session; tables without a session column give none, and neither does ``sessions`` to the scan."""
    return rows.where(F.col("session_id") == session_id) if "session_id" in rows.columns else rows.limit(0)


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 result a finding, as JSON; no secret and no preview goes in."""
    level = F.when(secrets(F.col("category")), "error").otherwise("warning")
    what = F.when(F.col("kind") == "semantic-context", F.lit("sensitive tool output")).otherwise(F.replace(F.coalesce("pattern", "category"), F.lit("_"), F.lit(" ")))
    line = F.nullif(F.regexp_extract("location", r":line (\d+)$", 1), F.lit("")).cast("int")
    place = F.struct(
        F.struct(
            F.struct(F.replace("file", F.lit("\\"), F.lit("/")).alias("uri")).alias("artifactLocation"),
            F.when(line.isNotNull(), F.struct(line.alias("startLine"))).alias("region"),
        ).alias("physicalLocation")
    )
    result = F.struct(
        F.col("category").alias("ruleId"), level.alias("level"), F.struct(F.concat(F.lit("match: "), what).alias("text")).alias("message"),
        F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("value/v1")).alias("partialFingerprints"),
        F.struct("location", "kind", "reason", "target").alias("properties"),
    )
    return findings.select("file", "location", "category", "fingerprint", level.alias("level"), line.alias("start_line"), F.to_json(result).alias("result"))


def sarif_log(findings: DataFrame, tool: str = "lanternfish") -> DataFrame:
    """One row a file: a whole SARIF log, its rules being the categories that can occur."""
    names = sorted({p.category for p in detect.PATTERNS} | {detect.SEMANTIC, detect.PROJECT})
    rules = ",".join(
        f'{{"id":"{n}","name":"{n}","shortDescription":{{"text":"{n.replace("_", " ")} detection"}},"properties":{{"category":"{"secret" if n in detect.BLOCKING else "pii/hygiene"}"}}}}' for n in names
    )
    head = f'{{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{{"tool":{{"driver":{{"name":"{tool}","rules":[{rules}]}}}},"results":['
    rows = sarif_results(findings).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("location", "category", "fingerprint", "result"))).alias("rs"))
    return rows.select("file", F.concat(F.lit(head), F.array_join(F.transform("rs", lambda r: r["result"]), ","), F.lit("]}]}")).alias("log"))
