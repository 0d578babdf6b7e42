"""Shards of nearly equal bytes by histogram sort, in DataFrame operations alone.

Rows are ordered by (hash of the text, id), so equal texts stand together and a long run of them may be
cut between ids. Splitters between shards are found by counting: each round sums, in one pass with
map-side sums, the exact bytes and rows below a few probes for every splitter, and narrows each
splitter's interval of keys, until the bytes below it are within TOLERANCE of the target or no key is
left between its bounds. Then the rows move once, to (shard, piece): shards are cut into pieces by the
hash's first bits, and the ids of a hash that has many rows into ranges; a row's slot is the rows of the
shard's earlier pieces plus its place in its piece, so no task sorts a whole shard or all copies of a text.

The law kept is "bytes": a row weighs its text's UTF-8 bytes plus 1.

Defined cases: null texts weigh 1 and count as empty; null ids sort first among equal texts; rows equal
in text and id share a key, so they are never parted by a splitter; an empty table gives an empty
result; other columns travel along, but for those named size, shard or slot, which the result replaces; a text larger than a shard's share gets the
shard to itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, whole_text

#: Bytes by which a splitter may miss its target, as a share of a shard's bytes; probes of a splitter in a round.
TOLERANCE = 0.0005
PROBES = 15
LOW, HIGH = -(1 << 63), (1 << 63) - 1
BASE = 1 << 64


def joined_key(high: int, low: int) -> int:
    """A pair of signed 64-bit integers as one number of the same order."""
    return (high - LOW) * BASE + (low - LOW)


def parted(key: int) -> tuple[int, int]:
    return key // BASE + LOW, key % BASE + LOW


def ranks(probes: list[int]) -> Column:
    """How many of the sorted probes are at or below a row's key."""
    own = F.struct(F.col("_h").alias("h"), F.col("_k").alias("k"))
    table = F.array(*(F.struct(F.lit(h).alias("h"), F.lit(k).alias("k")) for h, k in map(parted, probes)))
    return F.size(F.filter(table, lambda p: p <= own)) if probes else F.lit(0)


class Histogram:
    """Exact bytes and rows below probes, and the first and last key between neighbouring probes."""

    def __init__(self, keys: DataFrame):
        self.keys, self.probes, self.bins = keys, [], {}
        self.count([])

    def count(self, probes: list[int]) -> None:
        """Counts anew with these probes: one pass, with map-side sums for each bin."""
        self.probes = sorted({*probes})
        key = F.struct("_h", "_k")
        rows = self.keys.groupBy(ranks(self.probes).alias("bin")).agg(F.sum("_bytes"), F.count("*"), F.min(key), F.max(key)).collect()  # a row for each bin, so no more than probes + 1
        self.bins = {r[0]: (r[1], r[2], joined_key(*r[3]), joined_key(*r[4])) for r in rows}
        self.below, size, n = [], 0, 0
        for i in range(len(self.probes) + 1):
            size, n = size + self.bins.get(i, (0, 0))[0], n + self.bins.get(i, (0, 0))[1]
            self.below.append((size, n))
        self.total = size, n

    def bin_of(self, target: int) -> int:
        """The bin in which the bytes so far reach the target."""
        return next((i for i, (size, _) in enumerate(self.below) if size >= target), len(self.below) - 1)


def splitters(keys: DataFrame, shards: int) -> tuple[list[int], int]:
    """The key where each shard but the first begins, and the number of rows."""
    known = Histogram(keys)
    targets = [known.total[0] * i // shards for i in range(1, shards)]
    slack = known.total[0] / shards * TOLERANCE
    if not known.total[1]:
        return [], 0

    def edges(target: int) -> list[tuple[int, int]]:
        """Bytes below and key, at the begin and after the end of the target's bin."""
        i = known.bin_of(target)
        before = known.below[i - 1][0] if i else 0
        _, _, low, high = known.bins[i]
        return [(before, low), (known.below[i][0], high + 1)]

    (_, a), (_, b) = edges(known.total[0])
    known.count(evenly(a, b, PROBES * shards))
    while True:
        wanted, held = set(), set()
        for target in targets:
            (size_a, a), (size_b, b) = edges(target)
            held |= {a, b}
            if b - a > 1 and min(abs(size_a - target), abs(size_b - target)) > slack:
                wanted |= {*evenly(a, b, PROBES), a + 1, b - 1} - {a, b}
        if wanted <= {*known.probes}:
            return [min((abs(size - target), key) for size, key in edges(target))[1] for target in targets], known.total[1]
        known.count([*wanted, *held])


def evenly(a: int, b: int, n: int) -> list[int]:
    return [a + (b - a) * i // (n + 1) for i in range(1, n + 1)]


def shard(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows, all columns, with size, shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(row.alias("_row"), F.xxhash64(whole_text(text_column)).alias("_h"), F.coalesce(F.col(id_column).cast("long"), F.lit(LOW)).alias("_k"), (F.octet_length(whole_text(text_column)) + 1).cast("long").alias("size"))
    keys = cut(rows.select("_h", "_k", F.col("size").alias("_bytes")), "keys")
    cuts, n = splitters(keys, shards)
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # At most parts hashes have more than the parts-th part of all rows.
    hot = keys.groupBy("_h").agg(F.count("*").alias("_n"), F.min("_k").cast("double").alias("_from"), F.max("_k").cast("double").alias("_to")).filter(F.col("_n") > n / parts)

    def placed(df: DataFrame) -> DataFrame:
        """Adds shard and piece; a piece of a hot hash holds a range of its ids."""
        step = F.floor((F.col("_k") - F.col("_from")) / (F.col("_to") - F.col("_from") + 1) * F.ceil(F.col("_n") * (parts / max(1, n))))
        top = F.shiftright("_h", 64 - max(1, parts.bit_length()))
        piece = F.when(F.col("_n").isNull(), F.struct(top.alias("top"), F.lit(0).cast("long").alias("of"), F.lit(-1).cast("long").alias("step"))).otherwise(F.struct(top.alias("top"), F.col("_h").alias("of"), step.alias("step")))
        return df.join(F.broadcast(hot), "_h", "left").withColumns({"shard": ranks(cuts), "_piece": piece}).drop("_n", "_from", "_to")

    order = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed(keys).groupBy("shard", "_piece").agg(F.count("*").alias("_rows")).select("shard", "_piece", F.coalesce(F.sum("_rows").over(order), F.lit(0)).alias("_start"))
    # pieces has at most 4 * parts + shards rows.
    moved = placed(rows).repartition("shard", "_piece")
    place = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy("_h", "_k")) - 1
    return moved.withColumn("_place", place).join(F.broadcast(pieces), ["shard", "_piece"]).withColumn("slot", F.col("_start") + F.col("_place")).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("size", "shard", "slot")), "size", "shard", "slot")


def write_shards(docs: DataFrame, folder: str, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the sharded rows as Parquet, a folder for each shard, and returns them."""
    shard(docs, shards, id_column, text_column).write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.parquet(folder)
