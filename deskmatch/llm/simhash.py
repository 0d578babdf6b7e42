"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits; two documents are linked if their fingerprints differ in at most radius
bits. The tables' masks are structured so that every such pair collides in one of them: each bit
position i has a vector m(i) of radius + 1 bits, and for every nonzero vector v one mask keeps the
positions with odd <m(i), v>. The vectors at the positions where a pair differs span at most radius
dimensions, so some v is orthogonal to them all, and under its mask the pair is equal.

Only distinct fingerprints enter the tables, so copies never meet in a bucket. Within a bucket a search
links each fingerprint to one that reaches it, so that a bucket of n gives less than n links. A bucket
of over BUCKET fingerprints is dealt out as pairs of blocks, each a task of bounded size.

Defined cases: null texts are empty; texts without words have fingerprint 0 and are linked as any other;
repeated rows each get their row; documents with a null id get a fingerprint and a null component and
link nothing; rows of one id with different texts are linked each by its own; an empty table gives an empty result; other columns are ignored whatever their names;
long texts are taken whole. The smallest id names a component, so ties can't arise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut
from .components import components

#: Fingerprints of a bucket that one task compares with one another.
BUCKET = 20_000
#: In buckets of so few, all pairs are looked at, for many buckets at once.
SMALL = 16
SEED = 42


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, list[int]]:
    """XXH64 hashes of the texts' shingles of so many words, and their number in each text."""
    raw, hashes, counts = data.tobytes(), [], []
    digest = xxhash.xxh64_intdigest
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        found = raw[a:b].lower().split()
        n = len(found)
        if n <= words:
            hashes += [digest(b" ".join(found), SEED)] if n else []
            counts.append(min(n, 1))
            continue
        text = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found])
        starts = [0, *ends[: n - words].tolist()]
        hashes += [digest(text[s:e], SEED) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist())]
        counts.append(n - words + 1)
    return np.array(hashes, "<u8"), counts


#: The bits of each byte in eight lanes of eight bits.
LANES = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of 64 bits for each run of hashes between neighbouring bounds, none empty: which bits are set in over half of them."""
    sizes = np.diff(bounds)
    parts = -(-sizes // 255)  # a lane counts to 255
    first = np.cumsum(parts) - parts
    starts = np.repeat(bounds[:-1] - 255 * first, parts) + 255 * np.arange(parts.sum())
    lanes = np.add.reduceat(LANES[hashes.view(np.uint8).reshape(-1, 8)], starts, axis=0)
    ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int64)
    return 2 * ones > sizes[:, None]


def fingerprint_chunk(data: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    hashes, counts = shingle_hashes(data, offsets, words)
    sizes = np.array(counts, np.int64)
    out, full = np.zeros(len(counts), np.uint64), sizes > 0
    if full.any():
        set_ = majority(hashes, np.concatenate([[0], np.cumsum(sizes[full])]))
        out[full] = np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and fp (long): bit j is set if it is set in over half of the XXH64 hashes of the text's shingles of so many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fingerprint_chunk(data, offsets, words).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def masks(radius: int, bits: int = 64) -> list[int]:
    """The masks of the tables; the vectors of the bit positions run through all nonzero ones in turn."""
    all_ = (1 << radius + 1) - 1
    vectors = [1 + i % all_ for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, all_ + 1)]


def linked(fps: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is within the radius: each fingerprint, once reached, is compared with those not reached yet."""
    out, rest = [], np.arange(len(fps))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= radius
            if near.any():
                found = rest[near]
                out += [(int(nodes[at]), int(nodes[x])) for x in found]
                front += found.tolist()
                rest = rest[~near]
    return out


def link_buckets(table: DataFrame, radius: int) -> DataFrame:
    """a, b: links within each bucket (bucket, fp, node; rows sorted by bucket); of buckets too large to take at once, their rows, with a null."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("fp", pa.int64()), ("node", pa.int64())])

    def links(pairs):
        a, b = zip(*pairs)
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none, none], schema=schema)

    def passed(bucket, fp, node):
        none = pa.nulls(len(fp), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(np.full(len(fp), bucket)), pa.array(fp), pa.array(node)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None  # rows of the bucket that may go on; the bucket that is being passed on
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("bucket", "fp", "node")])
            if large is not None:
                go = int(np.searchsorted(rows[0], large, "right"))
                if go:
                    yield passed(large, rows[1, :go], rows[2, :go])
                rows = rows[:, go:]
                if not rows.shape[1]:
                    continue
                large = None
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            edges = np.flatnonzero(np.diff(rows[0])) + 1
            bounds = np.concatenate([[0], edges, [rows.shape[1]]])
            found = within(rows, bounds[:-1], radius)  # all buckets but the last, which may go on
            if found:
                yield links(found)
            held = rows[:, bounds[-2] :]
            if held.shape[1] > BUCKET:
                large = held[0, 0]
                yield passed(large, held[1], held[2])
                held = None
        if held is not None:
            found = within(held, np.array([0, held.shape[1]]), radius)
            if found:
                yield links(found)

    return table.mapInArrow(run, "a long, b long, bucket long, fp long, node long")


def within(rows: np.ndarray, bounds: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of the buckets between neighbouring bounds."""
    fps, nodes, sizes, out = rows[1].view(np.uint64), rows[2], np.diff(bounds), []
    small = sizes <= SMALL
    at = np.repeat(bounds[1:], sizes)  # where the bucket of each row ends
    at[np.repeat(~small, sizes)] = 0
    here = np.arange(bounds[0], bounds[-1])
    for lag in range(1, min(SMALL, int(sizes[small].max(initial=0)))):
        here = here[here + lag < at[here - bounds[0]]]
        near = here[np.bitwise_count(fps[here] ^ fps[here + lag]) <= radius]
        out += zip(nodes[near].tolist(), nodes[near + lag].tolist())
    for k in np.flatnonzero(~small):
        a, b = bounds[k], bounds[k + 1]
        out += linked(fps[a:b], nodes[a:b], radius)
    return out


def block_links(big: DataFrame, radius: int) -> DataFrame:
    """Links within large buckets: fingerprints are dealt to blocks by hash, and each pair of blocks is a bucket of bounded size."""
    sizes = big.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(BUCKET // 4)).cast("int").alias("n"))
    own = big.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("n")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(pair.alias("bucket"), "fp", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("bucket", "fp", "node")])
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1, [rows.shape[1]]])
            found = within(rows, bounds[:-1], radius)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
            held = rows[:, bounds[-2] :]
        found = within(held, np.array([0, held.shape[1]]), radius) if held is not None else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return dealt.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document its id, fp (long) and component_id, the smallest id that links of at most radius bits reach."""
    found = cut(fingerprints(docs, words, id_column, text_column), "fingerprints")
    nodes = cut(found.filter("id is not null").groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    # A bucket's key is a hash of the table's number and the masked fingerprint; where two buckets share a key, more pairs are compared, no fewer.
    keys = F.array(*(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for n, m in enumerate(masks(radius))))
    table = nodes.select(F.explode(keys).alias("bucket"), "fp", F.col("fp").alias("node")).repartition("bucket").sortWithinPartitions("bucket")
    rows = cut(link_buckets(table, radius), "links")
    pairs = rows.filter("a is not null").select("a", "b")
    big = rows.filter("a is null").select("bucket", "fp", "node")
    if not big.isEmpty():
        pairs = pairs.unionByName(block_links(big, radius))
    named = components(pairs)
    of = nodes.join(named, nodes["fp"] == named["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    of = of.join(of.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    joined = found.join(of, "fp", "left")
    return joined.select(F.col("id").alias(id_column), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))

