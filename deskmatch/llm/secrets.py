"""Incremental secret scan over a ledger of content-addressed blobs.

Each text version is a blob named by its SHA-256. The ledger (a Parquet table below the shared folder,
or where the caller keeps it) has one row for each blob and rule version that was scanned, with or
without findings. A run dedupes its texts by blob, drops the pairs that the ledger has, scans the rest
once each, appends them, and joins the ledger back to every path (document) by blob.

Rows may be versions of paths over time: history() tells in which versions of a path a finding stands.

Copies meet in map-side aggregation before the exchange, so a blob that a third of all paths share is
sent once from each task, and its paths are spread over parts when its findings come back.

Defined cases: null texts are empty blobs without findings; an empty table gives an empty result and
adds nothing; repeated rows each get their row; a null id stays null; other columns are ignored
whatever their names; a long text is scanned whole; spans of equal start are ordered by kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, spread_join, whole_text, work_dir

#: The base rules, in order: kind, pattern, group and least length of what the group holds.
BASE_RULES = [
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # a run of 32 or more is what [0-9a-f]+ gives once short runs are dropped
]
#: Rules of our own, which add spans.
MORE_RULES = [
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
]
#: Words of which each match of "assign" has one, whatever their case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
FINDINGS = "array<struct<kind:string,at:int,until:int>>"


def rule_version(rules: list[tuple]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def scan(text: str, rules: list[tuple[str, re.Pattern, int, int]]) -> list[tuple[int, int, int, str]]:
    """Start, number of the rule, end and kind of each match: leftmost, not overlapping within a kind."""
    found, low = [], None
    for n, (kind, pattern, group, least) in enumerate(rules):
        if kind == "assign":
            low = text.lower() if text.isascii() else text.translate(LOWER)
            if not any(w in low for w in ASSIGN_WORDS):
                continue
        found += [(m.start(), n, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found)


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def scan_secrets(docs: DataFrame, ledger: str | None = None, rules: list[tuple] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document its id, blob and findings (array of kind, at, until in code points), by way of the ledger.

    ledger: the folder of a ledger that earlier runs wrote; default: a new one.
    """
    spark, rules = docs.sparkSession, rules or BASE_RULES + MORE_RULES
    version, ledger = rule_version(rules), ledger or work_dir(spark, "ledger")
    schema = f"blob string, rule_version string, findings {FINDINGS}"
    paths = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text")).withColumn("blob", F.sha2("text", 256))
    blobs = paths.groupBy("blob").agg(F.first("text").alias("text"))
    if exists(spark, ledger):
        seen = spark.read.schema(schema).parquet(ledger).filter(F.col("rule_version") == version)
        blobs = blobs.join(seen.select("blob"), "blob", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(kind, re.compile(pattern), group, least) for kind, pattern, group, least in rules]
        for batch in batches:
            rows = [[{"kind": k, "at": a, "until": b} for a, _, b, k in scan(t, own)] for t in batch.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("at", pa.int32()), ("until", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array([version] * len(rows), pa.string()), pa.array(rows, kind)], names=["blob", "rule_version", "findings"])

    blobs.mapInArrow(run, schema).write.mode("append").option("compression", "zstd").parquet(ledger)
    known = spark.read.schema(schema).parquet(ledger).filter(F.col("rule_version") == version).groupBy("blob").agg(F.first("findings").alias("findings"))
    found = known.filter(F.size("findings") > 0)
    back = spread_join(paths.select("id", "blob"), found, "blob", F.col("id"))
    return back.select(F.col("id").alias(id_column), "blob", F.coalesce("findings", F.from_json(F.lit("[]"), FINDINGS)).alias("findings"))


def history(versions: DataFrame, ledger: str | None = None, path_column: str = "path", version_column: str = "version", text_column: str = "text") -> DataFrame:
    """path, kind and secret (SHA-256 of the found string) with the first and last version (of any ordered type) that hold it, how many do, and whether the path's newest version still does.

    versions: one row for each version of each path; its text is scanned once, whatever number of versions and paths share it.
    """
    name = fresh(versions, "_row")
    rows = versions.select(F.struct(F.col(path_column).alias("path"), F.col(version_column).alias("version")).alias(name), F.col(text_column).alias("text"))
    found = scan_secrets(rows, ledger, id_column=name).filter(F.size("findings") > 0).select(F.col(f"{name}.*"), "blob", F.explode("findings").alias("f"))
    texts = rows.select(F.sha2(whole_text(), 256).alias("blob"), whole_text().alias("text")).dropDuplicates(["blob"])
    each = found.join(texts, "blob").select("path", "version", "f.kind", F.sha2(F.substring(F.col("text"), F.col("f.at") + 1, F.col("f.until") - F.col("f.at")), 256).alias("secret"))
    newest = versions.groupBy(F.col(path_column).alias("path")).agg(F.max(version_column).alias("newest"))
    seen = each.groupBy("path", "kind", "secret").agg(F.min("version").alias("first_version"), F.max("version").alias("last_version"), F.count_distinct("version").alias("n_versions"))
    return seen.join(newest, seen["path"].eqNullSafe(newest["path"])).select(seen["path"], "kind", "secret", "first_version", "last_version", "n_versions", (F.col("last_version") == F.col("newest")).alias("still_there"))


def exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def of_kinds(findings, kinds: list[str], f=lambda kept: kept):
    """f of the findings of some kinds."""
    return f(F.filter(findings, lambda x: x["kind"].isin(kinds)))


def joined_spans(findings, kinds: list[str] | None = None):
    """kind:start:end of the findings, comma-joined."""
    kept = findings if kinds is None else of_kinds(findings, kinds)
    return F.array_join(F.transform(kept, lambda f: F.concat_ws(":", f["kind"], f["at"].cast("string"), f["until"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[secret]", id_column: str = "doc_id", text_column: str = "text", ledger: str | None = None) -> DataFrame:
    """The documents, all columns, with each found span replaced by mask; overlapping spans are one.

    Findings meet the documents by blob, so null and repeated ids are masked as all others.
    """
    key, spans = fresh(docs, "_blob"), fresh(docs, "_findings")
    found = scan_secrets(docs, ledger, id_column=id_column, text_column=text_column).filter(F.size("findings") > 0)
    found = found.groupBy("blob").agg(F.first("findings").alias("findings")).toDF(key, spans)
    joined = spread_join(docs.withColumn(key, F.sha2(whole_text(text_column), 256)), found, key, F.col(id_column)).select(*(f"`{c}`" for c in docs.columns), spans)
    at, names = docs.columns.index(text_column), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists, columns = batch.column(at), batch.column(len(names)), batch.columns[: len(names)]
            if lists.null_count < len(lists):
                own = [masked(t, f, mask) for t, f in zip(texts.filter(lists.is_valid()).to_pylist(), lists.drop_null().to_pylist())]
                columns[at] = pc.replace_with_mask(texts, lists.is_valid(), pa.array(own, texts.type))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)


def masked(text: str, findings: list[dict], mask: str) -> str:
    """The text with a mask for each stretch of findings that overlap or touch none before; the findings come by start."""
    pieces, reach = [], 0
    for f in findings:
        if f["at"] >= reach:
            pieces += [text[reach : f["at"]], mask]
        reach = max(reach, f["until"])
    return "".join([*pieces, text[reach:]])
