"""Near copies by SimHash: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from wide SimHash fingerprints (BITS bits of the set, bit j set if it is set in over half
of the shingles' hashes) by covering tables: a fingerprint is cut into PARTS parts of PART bits, in
ARRANGEMENTS orders of its bits, and each part has the masks of simhash.masks for WITHIN differing bits. So
two fingerprints of at most (WITHIN + 1) * PARTS - 1 differing bits meet in some table for sure; a pair at a
similarity of just 0.8 differs in 15 % of the bits and meets with a probability of about 0.99 (measured, see
the tests), one above it with more. Each candidate pair is then held against the whole sets, and only pairs of
0.8 or more become links; groups are the components of the links.

A table's key has 20 bits, so of n distinct sets n / 2**20 meet by chance; they are told apart within the bucket
by NEAR further bits, and by all bits of the fingerprints: a pair of any bucket is a candidate if it passes both. For over a billion distinct sets take wider parts, and more of them.

Documents of one set are one node, so exact copies never meet. The nodes of one in EARLY buckets meet their nearest partners first (a node at most
MEMBERS), which joins large groups. What then lies in different groups of any bucket forms clusters; a cluster's nodes are dealt out once, as pairs of
blocks of CLUSTER_ROWS / 2, not once for each shared bucket: the largest group meets the others alone, and only nodes with a partner by size and fingerprint go on to
the comparison of sets, where only links leave the task. A cluster for which that takes more than DEAR times the rows of its buckets of several groups is compared within
those buckets; there a pair counts only in the first bucket that it shares, and a bucket of more than twice BLOCK_ROWS sets or BLOCK_HASHES hashes is dealt out likewise. So
clusters take at most DEAR times the rows of the buckets, of which a node has one for each table at most. Fingerprints and sets come to a node once, not to each of its buckets.

Defined cases: null texts are empty; texts of fewer words than a shingle are one shingle; texts without
words are copies of each other; documents with a null id stay and link nothing; rows of one id with
different texts are judged by their own text; the smallest id of a group stays, with its repeats; other columns
travel along, whatever their names; an empty table gives an empty result; long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, cut, fresh, whole_text
from .components import components
from .simhash import SEED, SMALL, majority, masks, shingle_hashes

#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
#: Bits of a fingerprint in the tables, bits of a part and orders of the bits, differing bits that a part's masks cover, and bits that tell chance meetings apart.
BITS, PART, ARRANGEMENTS, WITHIN, NEAR = 510, 30, 3, 1, 128
PARTS = BITS // PART
#: Most differing bits of a pair, of NEAR and of all: at a similarity of 0.8 they are 19 and 97 on average, with deviations of 4.1 and 9.1; of strangers 64 and 319, with 5.7 and 12.6.
MOST_NEAR, MOST_DIFFERING = 38, 133
#: Rows of a bucket that a task holds while it looks for partners; sets and hashes of a block.
HELD, BLOCK_ROWS, BLOCK_HASHES = 20_000, 2_000, 4_000_000
#: Rows of a bucket whose nearest partners are found in the first meeting; larger ones meet one of theirs.
ONCE_ROWS = 1_000
#: One in so many buckets is in the first meeting; rows of a part that a cluster's nodes are dealt to; a cluster that takes so many times the rows of its buckets meets in them instead.
EARLY, CLUSTER_ROWS, DEAR = 8, 400, 2
#: Members (of all its buckets) that a node meets in the first meeting, those of the fewest differing bits.
MEMBERS = 4
WORDS = -(-(BITS + NEAR) // 64)
#: Words of a fingerprint before those of NEAR.
TABLE_WORDS = WORDS - NEAR // 64
#: Odd factors, one for each 64 bits of a fingerprint, and the orders of its bits.
FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ORDERS = [np.random.default_rng(SEED + k).permutation(BITS) for k in range(ARRANGEMENTS)]
TABLES = [(k, part, mask) for k in range(ARRANGEMENTS) for part in range(PARTS) for mask in masks(WITHIN, PART)]
GOLD = np.uint64(0x9E3779B97F4A7C15)


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The fingerprint of each set, as a row of WORDS 64-bit integers; no set may be empty."""
    out = np.empty((len(bounds) - 1, WORDS), np.uint64)
    for k, factor in enumerate(FACTORS):
        mixed = (hashes ^ (hashes >> np.uint64(31))) * factor
        mixed = (mixed ^ (mixed >> np.uint64(29))) * GOLD
        mixed ^= mixed >> np.uint64(32)
        out[:, k] = np.packbits(majority(mixed, bounds), axis=1, bitorder="little").view("<u8").ravel()
    return out


def table_keys(prints: np.ndarray) -> np.ndarray:
    """A row of one 64-bit key for each table, of fingerprints given as in fingerprints."""
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little", count=BITS)
    powers = np.uint64(1) << np.arange(PART, dtype=np.uint64)
    parts = [[bits[:, order[p * PART : (p + 1) * PART]].astype(np.uint64) @ powers for p in range(PARTS)] for order in ORDERS]
    out = np.empty((len(prints), len(TABLES)), np.uint64)
    for n, (k, part, mask) in enumerate(TABLES):
        key = (parts[k][part] & np.uint64(mask)) + np.uint64(n << 32)
        key = (key ^ (key >> np.uint64(32))) * GOLD
        out[:, n] = (key ^ (key >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[list[np.ndarray], list[int]]:
    """The texts' sets of hashes, sorted, and their keys."""
    hashes, counts = shingle_hashes(data, offsets, words)
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    own = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return own, [xxhash.xxh3_64_intdigest(s.tobytes()) for s in own]


def texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.sha2(whole_text(text_column), 256).alias("sha"), F.col(text_column).cast("string").alias("text"))


def sketches(docs: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    """Per row its id, sha, key (a hash of its set) and, for the first row of a key in a task that has an id, the set's size n and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part, data, offsets in chunks(batch, "text", 2 << 20):
                own, keys = shingle_sets(data, offsets, words)
                new = np.zeros(len(own), bool)
                for i, (key, known) in enumerate(zip(keys, part.column("id").is_valid().to_pylist())):
                    if known and len(own[i]) and key not in seen:
                        seen.add(key)
                        new[i] = True
                at = np.flatnonzero(new)
                found: list[np.ndarray | None] = [None] * len(own)
                if at.size:
                    bounds = np.cumsum([0, *(len(own[i]) for i in at)])
                    for i, row in zip(at, fingerprints(np.concatenate([own[i] for i in at]), bounds)):
                        found[i] = row.view(np.int64)
                columns = [part.column("id"), part.column("sha"), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array([len(s) if x else None for s, x in zip(own, new)], pa.int32()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "sha", "key", "n", "fp"])

    return texts(docs, id_column, text_column).mapInArrow(run, "id long, sha string, key long, n int, fp array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    """key and hashes, the whole set, of the nodes (row: an id and sha of the key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in chunks(batch, "text", 1 << 20):
                own, keys = shingle_sets(data, offsets, words)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array([s.tobytes() for s in own], pa.binary())], names=["key", "hashes"])

    rows = texts(docs, id_column, text_column).join(nodes.select("row.id", "row.sha"), ["id", "sha"], "left_semi")
    return rows.mapInArrow(run, "key long, hashes binary").dropDuplicates(["key"])


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    over, under = SIMILAR
    both = len(np.intersect1d(x, y, assume_unique=True))
    return under * both >= over * (len(x) + len(y) - both)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(*(np.frombuffer(s.as_buffer(), np.uint64) for s in row)) for row in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("key").alias(k), F.col("hashes").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def partnered(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which rows (bucket, key, n, two of near) of the buckets between neighbouring bounds may have a partner; of larger buckets all, whose pairs get the same test later."""
    sizes = np.diff(bounds)
    small = sizes <= SMALL
    keep = np.repeat(~small, sizes)
    ends = np.repeat(np.where(small, bounds[1:], 0), sizes)
    here, n, near = np.arange(bounds[0], bounds[-1]), rows[2], rows[3:].view(np.uint64)
    over, under = SIMILAR
    for lag in range(1, int(sizes[small].max(initial=0))):
        here = here[here + lag < ends[here - bounds[0]]]
        there = here + lag
        close = np.bitwise_count(near[:, here] ^ near[:, there]).sum(axis=0) <= MOST_NEAR
        close &= under * np.minimum(n[here], n[there]) >= over * np.maximum(n[here], n[there])
        keep[here[close] - bounds[0]] = True
        keep[there[close] - bounds[0]] = True
    return keep


def buckets(nodes: DataFrame) -> DataFrame:
    """bucket, key: what the tables' buckets hold that may have a partner there, of nodes (key, n, fp)."""
    names = ["bucket", "key", "n", "near_a", "near_b"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
            keys = table_keys(prints).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1, dtype=np.int32) * len(TABLES)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([lists, batch.column("key"), batch.column("n").cast(pa.int64()), *(pa.array(prints[:, TABLE_WORDS + k].astype("<u8").view(np.int64)) for k in range(2))], names=["buckets", *names[1:]])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None  # rows of the bucket that may go on; the bucket that is being passed on
        some = lambda rows: pa.RecordBatch.from_arrays([pa.array(r) for r in rows[:2]], names=["bucket", "key"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in names])
            if large is not None:
                go = int(np.searchsorted(rows[0], large, "right"))
                yield some(rows[:, :go])
                rows = rows[:, go:]
                if not rows.shape[1]:
                    continue
                large = None
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1])
            yield some(rows[:, : bounds[-1]][:, partnered(rows, bounds)])  # all buckets but the last, which may go on
            held = rows[:, bounds[-1] :]
            if held.shape[1] > HELD:
                large = held[0, 0]
                yield some(held)
                held = None
        if held is not None:
            yield some(held[:, partnered(held, np.array([0, held.shape[1]]))])

    lists = nodes.select("key", "n", "fp").mapInArrow(keyed, "buckets array<long>, key long, n long, near_a long, near_b long")
    rows = lists.select(F.explode("buckets").alias("bucket"), *names[1:]).repartition("bucket").sortWithinPartitions("bucket", "key")
    return cut(rows.mapInArrow(shared, "bucket long, key long"), "buckets")


def met_early(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """bucket, key, one, bits: of one in EARLY buckets the rows (bucket, key) that have a partner, the nearest one's key and its differing bits; of buckets of over ONCE_ROWS rows all rows, and the key of one of them."""
    early = rows.filter(F.pmod(F.xxhash64("bucket"), F.lit(EARLY)) == 0)
    own = early.groupBy("key").agg(F.collect_list("bucket").alias("buckets"))  # at most one for each table
    live = own.join(nodes.select("key", "n", "fp"), "key").select(F.explode("buckets").alias("part"), "key", F.col("key").alias("group"), "n", "fp")
    return cut(with_partner(live, once=False, most=ONCE_ROWS).select(F.col("part").alias("bucket"), "key", "one", "bits"), "early")


def first_pairs(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: each node with up to MEMBERS of the nearest partners in its buckets, where sizes and fingerprints allow for similar sets."""
    over, under = SIMILAR
    ones = rows.filter(F.col("one") != F.col("key")).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("bits", "one"))).alias("ones"))  # at most one for each table
    met = ones.select(F.explode(F.slice("ones.one", 1, MEMBERS)).alias("a"), F.col("key").alias("b"))
    left, right = (nodes.select(F.col("key").alias(k), F.col("n").alias(n), F.col("fp").alias(fp)) for k, n, fp in (("a", "n", "fp"), ("b", "m", "other_fp")))
    differing = F.zip_with("fp", "other_fp", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    most = lambda counts, n: F.aggregate(counts, F.lit(0), lambda s, x: s + x) <= n
    fits = (F.least("n", "m") * under >= F.greatest("n", "m") * over) & most(differing, MOST_DIFFERING) & most(F.slice(differing, TABLE_WORDS + 1, NEAR // 64), MOST_NEAR)
    return met.join(left, "a").join(right, "b").filter(fits).select("a", "b")


def partners(groups: np.ndarray, sizes: np.ndarray, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each row and those after it that are of another group and by size and fingerprint may be similar."""
    over, under = SIMILAR
    for i in range(len(groups) - 1):
        rest = slice(i + 1, None)
        near = (groups[rest] != groups[i]) & (under * np.minimum(sizes[rest], sizes[i]) >= over * np.maximum(sizes[rest], sizes[i]))
        at = np.flatnonzero(near) + i + 1
        differing = np.bitwise_count(prints[at] ^ prints[i])
        yield i, at[(differing.sum(axis=1) <= MOST_DIFFERING) & (differing[:, TABLE_WORDS:].sum(axis=1) <= MOST_NEAR)]


def linked_sets(keys: np.ndarray, groups: np.ndarray, sizes: np.ndarray, prints: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between different groups, until those that similar sets join are one."""
    head, out = {}, []

    def top(g: int) -> int:
        while head.get(g, g) != g:
            g = head[g]
        return g

    for i, at in partners(groups, sizes, prints):
        for j in at.tolist():
            g, h = top(int(groups[i])), top(int(groups[j]))
            if g != h and alike(sets[i], sets[j]):
                head[max(g, h)] = min(g, h)
                out.append((int(keys[i]), int(keys[j])))
    return out


def whole_parts(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple]:
    """Rows of each part (rows sorted by part), with group, n and fp as arrays; of a part of more rows than most, or twice BLOCK_HASHES hashes, its rows in pieces, after a None."""
    held: list[pa.RecordBatch] = []
    at, size, hashes, large = None, 0, 0, False

    def close():
        rows = pa.Table.from_batches(held).combine_chunks()
        if large:
            return None, rows
        prints = rows.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
        return rows, rows.column("group").to_numpy(), rows.column("n").to_numpy(), prints

    for batch in batches:
        parts = batch.column("part").to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)] if len(parts) else []
        for a, b in zip(bounds, bounds[1:]):
            if parts[a] != at:
                if held:
                    yield close()
                held, at, size, hashes, large = [], parts[a], 0, 0, False
            held.append(batch.slice(a, b - a))
            size += b - a
            hashes += int(held[-1].column("n").to_numpy().sum())
            if most and (size > most or (hashes > 2 * BLOCK_HASHES and size > 2)):
                large = True
                yield close()
                held = []
    if held:
        yield close()


def sorted_parts(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", "key")


def with_partner(live: DataFrame, once: bool = True, most: int | None = None) -> DataFrame:
    """Rows (part, key, group, n, fp) that have a partner of another group in their part, and the nearest partner's key and differing bits (one, bits); of parts of more rows than most (default: twice BLOCK_ROWS) all rows, marked large, and the first one's key. once: parts are buckets, and pairs that share an earlier table don't count."""
    schema = T.StructType([*live.schema.fields, T.StructField("one", T.LongType()), T.StructField("bits", T.LongType()), T.StructField("large", T.BooleanType())])
    most, names = most or 2 * BLOCK_ROWS, live.columns

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = table_keys(batch.column("fp").flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), len(TABLES))], names=[*names, "tables"])

    def marked(rows: pa.Table, one: np.ndarray, bits: np.ndarray, large: bool) -> Iterator[pa.RecordBatch]:
        rows = rows.select(names).append_column("one", pa.array(one)).append_column("bits", pa.array(bits))
        yield from rows.append_column("large", pa.array(np.full(len(rows), large))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, 0
        for rows, *known in whole_parts(keyed(batches) if once else batches, most):
            if rows is None:
                part, key = known[0].column("part")[0].as_py(), known[0].column("key")[0].as_py()
                at, first = part, first if part == at else key
                yield from marked(known[0], *(np.full(len(known[0]), x) for x in (first, MOST_DIFFERING)), True)
            elif (known[0] != known[0][0]).any():
                keys, one, bits, prints = rows.column("key").to_numpy(), np.zeros(len(rows), np.int64), np.full(len(rows), BITS + NEAR), known[2]
                if once:
                    tables = rows.column("tables").combine_chunks().flatten().to_numpy().reshape(-1, len(TABLES))
                    before = tables[:, : int(np.flatnonzero(tables[0] == rows.column("part")[0].as_py())[0])]
                for i, partner in partners(*known):
                    if once and len(partner):
                        partner = partner[~(before[partner] == before[i]).any(axis=1)]
                    if len(partner):
                        differing = np.bitwise_count(prints[partner] ^ prints[i]).sum(axis=1, dtype=np.int64)
                        nearer, best = differing < bits[partner], int(differing.argmin())
                        one[partner[nearer]], bits[partner[nearer]] = i, differing[nearer]
                        if differing[best] < bits[i]:
                            one[i], bits[i] = partner[best], differing[best]
                keep = bits < BITS + NEAR
                yield from marked(rows.filter(pa.array(keep)), keys[one[keep]], bits[keep], False)

    return sorted_parts(live.select(*names)).mapInArrow(run, schema)


def blocks(c: Column, s: Column, most: int) -> Column:
    """Blocks of half of most rows and of half of BLOCK_HASHES hashes that c rows of s hashes make."""
    return F.ceil(F.greatest(c * 2 / most, s * 2 / BLOCK_HASHES, F.lit(1))).cast("int")


def dealt(large: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of large parts in parts of at most so many rows (default: BLOCK_ROWS) made of two blocks each: blocks of a part's largest group with those of the others, and those of the others with each other."""
    each = most or BLOCK_ROWS
    counts = large.groupBy("part", "group").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    most = counts.groupBy("part").agg(F.max(F.struct("c", "group", "s")).alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    sizes = most.select("part", F.col("main.group").alias("main"), blocks(F.col("main.c"), F.col("main.s"), each).alias("of_main"), blocks(F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s"), each).alias("of_rest"))
    is_main = F.col("group") == F.col("main")
    own = large.join(sizes, "part").withColumn("own", F.pmod(F.xxhash64("key"), F.when(is_main, F.col("of_main")).otherwise(F.col("of_rest"))).cast("int"))
    to = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    block = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    rest = F.concat(to(F.col("of_main"), lambda x: block("main", x, F.col("own"))), to(F.col("of_rest"), lambda x: block("rest", F.least("own", x), F.greatest("own", x))))
    to_blocks = F.when(is_main, to(F.col("of_rest"), lambda y: block("main", F.col("own"), y))).otherwise(rest)
    return own.withColumn("block", F.explode(to_blocks)).withColumn("part", F.xxhash64("part", "block")).select(large.columns)


def links_within(met: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links between groups within each part of met (part, key, group, n, fp); sets are fetched once for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, *known in whole_parts(batches):
            found = linked_sets(rows.column("key").to_numpy(), *known, [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("hashes")])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    own = met.groupBy("key").agg(*(F.first(c).alias(c) for c in ("group", "n", "fp")), F.collect_list("part").alias("parts"))
    rows = own.join(sets.select("key", "hashes"), "key").withColumn("part", F.explode("parts"))
    return sorted_parts(rows.select("part", "key", "group", "n", "fp", "hashes")).mapInArrow(run, "a long, b long")


def bucket_links(live: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links between groups within each bucket (part, key, group, n, fp). Only sets that by their fingerprints may have a partner are fetched."""
    found = cut(with_partner(live).drop("one", "bits"), "met")
    met, large = found.filter("NOT large").drop("large"), found.filter("large").drop("large")
    if not large.isEmpty():
        met = met.unionByName(cut(with_partner(dealt(large), once=False).drop("one", "bits"), "met").drop("large"))
    return links_within(met, sets)


def of_several_groups(rows: DataFrame, group: DataFrame, nodes: DataFrame) -> DataFrame:
    """part (the cluster), key, group, n, fp, dear: the nodes of clusters, which are groups (node, component) that buckets (bucket, key) join; dear: dealing the cluster out takes more rows than its buckets have."""
    own = rows.groupBy("key").agg(F.collect_list("bucket").alias("buckets"))  # at most one for each table
    grouped = own.join(group, own["key"] == group["node"], "left").select("key", F.coalesce("component", "key").alias("group"), F.explode("buckets").alias("bucket"))
    grouped = cut(grouped, "grouped")
    held = cut(grouped.groupBy("bucket", "group").agg(F.count("*").alias("c")), "held")
    several = held.groupBy("bucket").agg(F.min("group").alias("least"), F.max("group").alias("most"), F.sum("c").alias("c")).filter("least != most")
    met = held.select("bucket", "group").join(several.select("bucket", "least"), "bucket").filter("group != least")
    edges = cut(met.select(F.col("least").alias("a"), F.col("group").alias("b")).distinct(), "joined")
    top = components(edges)
    of = edges.select(F.explode(F.array("a", "b")).alias("group")).distinct()
    of = cut(of.join(top, of["group"] == top["node"], "left").select("group", F.coalesce("component", "group").alias("part")), "clusters")
    members = cut(grouped.select("key", "group").distinct().join(of, "group").join(nodes.select("key", "n", "fp"), "key").select("part", "key", "group", "n", "fp"), "members")
    sizes = members.groupBy("part", "group").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    sizes = sizes.groupBy("part").agg(F.max(F.struct("c", "s")).alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    rest, rest_s = F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s")
    of_main, of_rest = blocks(F.col("main.c"), F.col("main.s"), CLUSTER_ROWS), blocks(rest, rest_s, CLUSTER_ROWS)
    sizes = sizes.select("part", (F.col("main.c") * of_rest + rest * (of_main + of_rest)).alias("dealt_rows"))
    in_buckets = several.join(of, several["least"] == of["group"]).groupBy("part").agg(F.sum(several["c"]).alias("bucket_rows"))
    dear = sizes.join(in_buckets, "part").filter(F.col("dealt_rows") > DEAR * F.col("bucket_rows")).select("part", F.lit(True).alias("dear"))
    return members.join(dear, "part", "left").withColumn("dear", F.coalesce("dear", F.lit(False)))


def in_buckets(rows: DataFrame, members: DataFrame) -> DataFrame:
    """part (the bucket), key, group, n, fp: the members' rows (bucket, key) in buckets that hold more than one group."""
    own = rows.groupBy("key").agg(F.collect_list("bucket").alias("buckets"))
    grouped = cut(own.join(members.select("key", "group"), "key").select("key", "group", F.explode("buckets").alias("bucket")), "grouped")
    several = grouped.groupBy("bucket").agg(F.min("group").alias("least"), F.max("group").alias("most")).filter("least != most").select("bucket")
    left = grouped.join(several, "bucket", "left_semi").groupBy("key").agg(F.collect_list("bucket").alias("buckets"))
    return left.join(members.select("key", "group", "n", "fp"), "key").select(F.explode("buckets").alias("part"), "key", "group", "n", "fp")


def links(rows: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: pairs of similar keys whose components are those of all similar pairs that share a bucket."""
    found = cut(similar(cut(first_pairs(met_early(rows, nodes), nodes), "pairs"), sets), "links")
    live = cut(of_several_groups(rows, components(found), nodes), "live")
    dear = live.filter("dear").drop("dear")
    met = cut(with_partner(dealt(live.filter("NOT dear").drop("dear"), CLUSTER_ROWS), once=False).drop("one", "bits", "large"), "met")
    found = found.unionByName(cut(links_within(met, sets), "links"))
    return found if dear.isEmpty() else found.unionByName(cut(bucket_links(in_buckets(rows, dear), sets), "links"))


def one_of_each(docs: DataFrame, words: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns, without those that have a smaller id in their group; rows with a null id stay."""
    found = cut(sketches(docs, words, id_column, text_column), "sketches")
    ids = found.filter("id is not null").groupBy("key").agg(F.min("id").alias("least"))
    nodes = cut(found.filter("fp is not null").groupBy("key").agg(F.min_by(F.struct("n", "fp"), F.struct("id", "sha")).alias("sketch"), F.min(F.struct("id", "sha")).alias("row")).select("key", "sketch.*", "row"), "nodes")
    rows = buckets(nodes)
    sets = cut(sets_of(docs, nodes.join(rows.select("key").distinct(), "key", "left_semi"), words, id_column, text_column), "sets")
    group = components(links(rows, nodes, sets))
    of = cut(ids.join(group, ids["key"] == group["node"], "left").select("key", "least", F.coalesce("component", "key").alias("group")), "groups")
    least = of.join(of.groupBy("group").agg(F.min("least").alias("first")), "group").select("key", "first")
    gone = found.filter("id is not null").join(least, "key").filter("id != first").select("id", "sha").distinct()
    own, sha = fresh(docs, "_gone"), fresh(docs, "_sha")
    same = (docs[id_column].cast("long") == F.col(own)) & (F.sha2(F.coalesce(docs[text_column].cast("string"), F.lit("")), 256) == F.col(sha))
    return docs.join(gone.toDF(own, sha), same, "left_anti")
