"""Reading declared tables and import files, and keyed writes that can be repeated."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import body_text, filled

#: Schemas of nested JSON that jobs store and read.
RESULT_JSON = "struct<name:string,name_confidence:string,role_headline:string,review_reasons:array<string>,needs_review:boolean>"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where it is unset and all is one process (tests), in a new temporary folder."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="deskmatch-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: what is used several times is worked out once, and survives lost executors."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dealt_out(rows: DataFrame, each: int = 20_000, like: DataFrame | None = None) -> DataFrame:
    """Rows in parts of so many, as many parts as the cluster has cores at least: for work on each row that takes far longer than moving it. A file's splits don't tell how many rows each has, so they are counted (like: a table of as many, where that is cheaper)."""
    parts = -(-(rows if like is None else like).count() // each)
    return rows.repartition(max(parts, rows.sparkSession.sparkContext.defaultParallelism))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, columns: list[str] | None = None, where: Column | None = None, newest: int | None = None, by: str = "created_at") -> DataFrame:
    """A Parquet table of a declared schema; columns and filter reach the scan."""
    rows = spark.read.schema(schema).parquet(path)
    if where is not None:
        rows = rows.filter(where)
    rows = rows.select(*columns) if columns else rows
    return rows.orderBy(F.desc(by)).limit(newest) if newest else rows


def read_import_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with quoted commas and line breaks, all as text, blank rows left out; source is the file, row_no counts from 2 as a sheet does."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    names = rows.columns
    numbered = rows.select("*", F.col("_metadata.file_name").alias("source")).withColumn("_order", F.monotonically_increasing_id())
    blank = F.forall(F.array(*(F.coalesce(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names)), lambda x: x == "")
    kept = numbered.filter(~blank)
    return kept.withColumn("row_no", F.row_number().over(Window.partitionBy("source").orderBy("_order")) + 1).drop("_order")


#: What is read of a message's part; its own parts stay JSON texts.
PART = "mimeType string, filename string, body struct<data: string, attachmentId: string>, parts array<string>"


def message_leaves(messages: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, mime and text of all texts in messages (JSON of nested parts, of any depth) that are no attachments, decoded from base64url.

    path: the place of a part among those of each level, so that the order by path is that of a depth-first walk. One pass for each
    level, over the parts of that level alone.
    """
    level, found = messages.select(F.col(key), F.array().cast("array<int>").alias("path"), F.from_json(column, PART).alias("part")), []
    while level is not None:
        level = written(level.filter("part IS NOT NULL"), "parts")
        attached = filled(F.col("part.filename")).isNotNull() | filled(F.col("part.body.attachmentId")).isNotNull()
        data = F.translate(filled(F.col("part.body.data")), "-_", "+/")
        text = F.decode(F.unbase64(data), "UTF-8")
        found.append(level.filter(data.isNotNull() & ~attached).select(key, "path", F.col("part.mimeType").alias("mime"), text.alias("text")))
        below = level.select(key, "path", F.posexplode("part.parts").alias("n", "json"))
        level = None if below.isEmpty() else below.select(key, F.concat("path", F.array("n")).alias("path"), F.from_json("json", PART).alias("part"))
    return reduce(DataFrame.unionByName, found)


def message_bodies(messages: DataFrame, key: str, column: str) -> DataFrame:
    """key, text and html: the texts of either kind in the order of a depth-first walk, with an empty line between, tidied; null if there is none."""
    leaves = message_leaves(messages, key, column).filter("mime IN ('text/plain', 'text/html')")
    joined = lambda kind: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("mime") == kind, F.struct("path", "text")))), lambda x: x["text"]), "\n\n")
    out = leaves.groupBy(key).agg(joined("text/plain").alias("text"), joined("text/html").alias("html"))
    return messages.select(key).join(out, key, "left").select(key, body_text(F.col("text")).alias("text"), filled(F.col("html")).alias("html"))


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def write_buckets(rows: DataFrame, folder: str, key: list[str], buckets: int) -> None:
    """A table in folders by a hash of its key, of which merge_into_buckets rewrites some."""
    rows.withColumn("_bucket", bucket_of(key, buckets)).repartition(buckets, "_bucket").write.partitionBy("_bucket").parquet(folder)


def merge_into_buckets(spark: SparkSession, folder: str, batch: DataFrame, key: list[str], buckets: int, refresh: list[str] | None = None, defaults: dict[str, Column] | None = None) -> list[int]:
    """merge_batch of a table of write_buckets: reads and rewrites only the buckets that the batch's keys fall into, and returns them.

    The merged rows are written to the shared folder first; then they replace the buckets' folders. A batch that is
    merged again changes nothing, as its keys are known and its refreshed values are there.
    """
    batch = written(batch.withColumn("_bucket", bucket_of(key, buckets)), "batch")
    touched = sorted(r[0] for r in batch.select("_bucket").distinct().collect())  # no more than there are buckets
    if not touched:
        return []
    old = spark.read.parquet(folder).filter(F.col("_bucket").isin(touched))
    new = written(merge_batch(old, batch, key, refresh, {**(defaults or {}), "_bucket": bucket_of(key, buckets)}), "merged")
    new.repartition(len(touched), "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(folder)
    return touched


def merge_batch(known: DataFrame, batch: DataFrame, key: list[str], refresh: list[str] | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The table after a batch: new keys are added with defaults; known ones keep all, or take the refresh columns only. Of a key that comes twice the least row counts, whatever the order."""
    columns = [c for c in batch.columns if c not in key]
    once = batch.groupBy(*key).agg(F.min(F.struct(*columns)).alias("_row")).select(*key, "_row.*") if columns else batch.distinct()
    fresh = once.join(known.select(*key), key, "left_anti").withColumns(defaults or {})
    if refresh:
        new = once.select(*key, *(F.col(c).alias(f"_{c}") for c in refresh))
        known = known.join(new, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in refresh}).drop(*(f"_{c}" for c in refresh))
    return known.unionByName(fresh.select(known.columns))


def append_if_absent(known: DataFrame, rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is absent, one for each key, and the counts of created and skipped rows."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*(F.col(c) for c in rows.columns))))
    flagged = ranked.join(known.select(*key).distinct().withColumn("_known", F.lit(True)), key, "left").withColumn("action", F.when(F.col("_known") | (F.col("_n") > 1), "skipped").otherwise("created"))
    return flagged.filter("action = 'created'").select(rows.columns), flagged.groupBy("action").agg(F.count("*").alias("n"))


def read_json_column(rows: DataFrame, column: str, schema: str = RESULT_JSON) -> DataFrame:
    """The fields of a JSON text column as columns; broken JSON gives nulls."""
    return rows.withColumn("_json", F.from_json(column, schema)).select("*", "_json.*").drop("_json")


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table of a report as JSON lines in a folder of its own."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")
