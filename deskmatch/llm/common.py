"""Helpers that the corpus operators share: the shared folder, lineage cuts and Arrow chunks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python task handles at once; a longer text forms a chunk of its own.
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir, or a new one where it is unset and driver and executors are one process (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="deskmatch-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Parts that the rows of one key are dealt to in a spread join.
SPREAD = 16


def spread_join(rows: DataFrame, found: DataFrame, key: str, by: Column) -> DataFrame:
    """rows left join found (one row for each key) on a key that a third of all rows may share: rows are dealt to SPREAD parts by a hash, and found goes to each part."""
    part = fresh(rows, "_part")
    each = found.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn(part, F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")).join(each, [key, part], "left").drop(part)


def whole_text(column: str = "text"):
    """The text, or the empty text for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their texts' UTF-8 bytes and offsets; null texts count as empty."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between each two neighbouring offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
