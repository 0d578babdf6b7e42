"""Exact removal of repeated byte strings by sorting suffixes deep and shallow.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Sorting every suffix
of the corpus would move each byte many times over, so suffixes are sorted in groups that are sure to
hold all partners: in every LENGTH-byte string the places where the hash of the next GRAM bytes is
smallest are its anchors; equal strings have equal anchors, so a suffix needs to be compared only with
those that begin at an anchor of equal hash.

1. Texts are reduced to distinct ones and written, bucketed by a text key; a text with a copy goes
   whole if it has LENGTH bytes, and still counts as a partner once.
2. Each text gives its anchors: hash, hash of the context (REACH bytes to the left, LENGTH to the
   right, as far as the text goes), key and place. Equal ones of a chunk go on as one, and rows meet by hash. Anchors of equal context
   are repeated as far as the context goes; unequal contexts under one hash are partners to compare.
3. Of each such context one place is fetched from the texts. In each group the suffixes at the anchors,
   and the reversed prefixes before them, are sorted: multikey quicksort to a shallow depth, then blind
   tries for those that are equal so far. The common lengths of neighbours give, for each place, how
   far it agrees with partners on both sides; LENGTH in sum is a repeated stretch.
4. The stretches return to the texts by key, and the digests to all documents by content.

A group of over GROUP contexts is not sorted in one task: its windows are counted by 128-bit hashes,
spread over all tasks, which gives the same stretches.

Defined cases: null texts are empty; texts under LENGTH bytes lose nothing; repeated rows are copies of
one another; a null id stays null; an empty table gives an empty result; other columns are ignored
whatever their names; strings are judged on the input; matches never cross texts.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, whole_text, work_dir

#: Bytes of a string that must not repeat, bytes of an anchor, and bytes before an anchor that a string may begin.
LENGTH, GRAM = 200, 64
REACH = LENGTH - GRAM
#: Bytes to which multikey quicksort goes before the tries, beyond what a group has in common.
SHALLOW = 8
#: Contexts of a group that one task sorts; up to SQUARE all pairs' common lengths are laid out in memory.
GROUP, SQUARE = 50_000, 400
#: Anchors of a hash that a task holds at once.
HELD = 200_000
CHUNK = 2 << 20
BASE = 0x9E3779B97F4A7C15
TOP = np.uint64(2**64 - 1)


# ---- sorting -----------------------------------------------------------------


def common_length(a: bytes, b: bytes, start: int) -> int:
    """Length of the common beginning of a and b, which agree up to start."""
    low, high = start, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    """Of a blind trie: the depth at which its strings part and the branches by their byte there (-1: the string ends)."""

    __slots__ = ("branches", "depth")

    def __init__(self, depth: int):
        self.depth, self.branches = depth, {}


def byte_at(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def blind_trie(strings: list[bytes], group: list[int], depth: int) -> tuple[list[int], list[int]]:
    """Order of a group that agrees up to depth, and the common length of each with its predecessor (the first: 0).

    A string goes down the trie by the bytes at which strings part, unseen ones in between; compared with
    the leaf it meets, it tells where the new branch belongs.
    """
    root: Node | list[int] = [group[0]]
    for i in group[1:]:
        s, node = strings[i], root
        while isinstance(node, Node):
            node = node.branches.get(byte_at(s, node.depth)) or next(iter(node.branches.values()))
        shared = common_length(s, strings[node[0]], depth)
        if shared == len(s) == len(strings[node[0]]):
            node.append(i)
            continue
        above, node = None, root
        while isinstance(node, Node) and node.depth < shared:
            above, node = node, node.branches[byte_at(s, node.depth)]
        if isinstance(node, Node) and node.depth == shared:
            node.branches[byte_at(s, shared)] = [i]
            continue
        fork = Node(shared)
        other = node
        while isinstance(other, Node):
            other = next(iter(other.branches.values()))
        fork.branches = {byte_at(strings[other[0]], shared): node, byte_at(s, shared): [i]}
        if above is None:
            root = fork
        else:
            above.branches[byte_at(s, above.depth)] = fork
    order, common, stack = [], [], [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, Node):
            keys = sorted(node.branches, reverse=True)
            stack += [(node.branches[k], shared if k == keys[-1] else node.depth) for k in keys]
        else:
            order += node
            common += [shared] + [len(strings[node[0]])] * (len(node) - 1)
    return order, common


def deep_shallow(strings: list[bytes], start: int = 0) -> tuple[list[int], list[int]]:
    """Sorted order of strings that agree up to start, and the common length of each with its predecessor (the first: 0)."""
    order, common = [], []
    stack = [(list(range(len(strings))), start, 0)]
    while stack:
        group, depth, shared = stack.pop()
        if len(group) == 1:
            order.append(group[0])
            common.append(shared)
        elif depth >= start + SHALLOW:
            found, lengths = blind_trie(strings, group, depth)
            order += found
            common += [shared, *lengths[1:]]
        else:
            heads = [byte_at(strings[i], depth) for i in group]
            pivot = sorted((heads[0], heads[len(heads) // 2], heads[-1]))[1]
            less, same, more = ([i for i, h in zip(group, heads) if h < pivot], [i for i, h in zip(group, heads) if h == pivot], [i for i, h in zip(group, heads) if h > pivot])
            parts = [(less, depth), (same, depth + 1), (more, depth)]
            if pivot == -1:  # these strings end here, and so are equal
                order_same = same
                parts = [(more, depth)]
                order += order_same
                common += [shared] + [depth] * (len(same) - 1)
                shared = depth
            first = True
            put = []
            for part, at in parts:
                if part:
                    put.append((part, at, shared if first else depth))
                    first = False
            stack += reversed(put)
    return order, common


def stretches(lefts: list[bytes], rights: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How far each place is repeated to the left and to the right of its anchor (0, 0: not at all).

    lefts: reversed bytes before the anchors; rights: bytes from the anchors on, equal up to GRAM.
    """
    n = len(lefts)
    (order_l, common_l), (order_r, common_r) = deep_shallow(lefts), deep_shallow(rights, GRAM)
    common_l, common_r = np.array(common_l), np.array(common_r)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n <= SQUARE:
        both = [np.empty((n, n), np.int16) for _ in range(2)]
        for matrix, order, common in zip(both, (order_l, order_r), (common_l, common_r)):
            inner = np.zeros((n, n), np.int16)
            for k in range(n - 1):
                inner[k, k + 1 :] = np.minimum.accumulate(common[k + 1 :])
            inner += inner.T
            matrix[np.ix_(order, order)] = inner
        agree_l, agree_r = both
        good = agree_l + agree_r >= LENGTH
        np.fill_diagonal(good, False)
        return np.where(good, agree_l, 0).max(axis=1).astype(np.int64), np.where(good, agree_r, 0).max(axis=1).astype(np.int64)
    size_l, size_r = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    for l in range(REACH + 1):  # windows that begin l bytes before the anchor: equal if both numbers are
        fits = np.flatnonzero((size_l >= l) & (size_r >= LENGTH - l))
        if len(fits) < 2:
            continue
        number_l, number_r = np.empty(n, np.int64), np.empty(n, np.int64)
        number_l[order_l], number_r[order_r] = np.cumsum(common_l < l), np.cumsum(common_r < LENGTH - l)
        key = number_l[fits] * (n + 1) + number_r[fits]
        _, where, count = np.unique(key, return_inverse=True, return_counts=True)
        again = fits[count[where] > 1]
        left[again] = l
        right[again] = np.maximum(right[again], LENGTH - l)
    return left, right


# ---- anchors -----------------------------------------------------------------


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64; those of a chunk are remembered, those of a longer text are not."""
    return chunk_powers(CHUNK + 1) if n <= CHUNK + 1 else chunk_powers.__wrapped__(n)


@functools.lru_cache(2)
def chunk_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        row, done = np.ones(n, np.uint64), 1
        while done < n:
            more = min(done, n - done)
            row[done : done + more] = row[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        out.append(row)
    return out[0], out[1]


@functools.cache
def byte_values() -> np.ndarray:
    return np.random.default_rng(200).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding(values: np.ndarray, size: int, f, fill) -> np.ndarray:
    """f (minimum or maximum) of each run of size values."""
    n = len(values)
    if n < size:
        return values[:0]
    rows = np.concatenate([values, np.full(-n % size, fill, np.uint64)]).reshape(-1, size)
    before, after = f.accumulate(rows, axis=1).ravel(), f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(after[: n - size + 1], before[size - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in the chunk, hashes and context hashes of all anchors, and the number of the text of each."""
    n = len(data)
    none = np.zeros(0, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    if not long.size:
        return none, none.view(np.uint64), none.view(np.uint64), none
    up, down = powers(n + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(byte_values()[data] * down[:n], dtype=np.uint64)])
    h = mix((total[GRAM:] - total[:-GRAM]) * up[: n - GRAM + 1])
    h[h == 0] = 1
    h[h == TOP] = TOP - np.uint64(1)
    inside = np.zeros(n + 1, np.int64)  # grams that lie in one text
    wide = np.flatnonzero(np.diff(offsets) >= GRAM)
    inside[offsets[wide]] += 1
    np.subtract.at(inside, offsets[wide + 1] - GRAM + 1, 1)
    h[np.cumsum(inside)[: len(h)] == 0] = TOP
    least = sliding(h, REACH + 1, np.minimum, TOP)
    whole = np.zeros(n + 1, np.int64)
    whole[offsets[long]] += 1
    np.subtract.at(whole, offsets[long + 1] - LENGTH + 1, 1)
    least[np.cumsum(whole)[: len(least)] == 0] = 0
    padded = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)])
    at = np.flatnonzero(h == sliding(padded, REACH + 1, np.maximum, 0))
    text = np.searchsorted(offsets, at, "right") - 1
    low, high = np.maximum(at - REACH, offsets[text]), np.minimum(at + LENGTH, offsets[text + 1])
    context = mix((total[high] - total[low]) * up[low] + mix(((high - low) * 1024 + (at - low)).astype(np.uint64)))
    return at, h[at], context, text


# ---- jobs --------------------------------------------------------------------


def distinct_texts(docs: DataFrame, text_column: str) -> tuple[DataFrame, str]:
    """key, text (binary), copies, sha: one row for each distinct text, in a table of the shared folder that is bucketed by key; and the table's name in the catalog."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.sha2(F.col(text_column), 256).alias("sha"), F.col(text_column).cast("binary").alias("text"))
    for seed in range(5):
        name = f"distinct_texts_{uuid.uuid4().hex}"
        found = rows.withColumn("key", F.xxhash64("sha", F.lit(seed))).groupBy("key", "sha").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        found.repartition(parts, "key").write.bucketBy(parts, "key").option("compression", "zstd").option("path", work_dir(spark, "texts")).saveAsTable(name)
        table = spark.table(name)
        if table.groupBy("key").count().filter("count > 1").isEmpty():
            return table, name
        spark.sql(f"DROP TABLE {name}")
    raise RuntimeError("text keys clash")


def anchor_rows(texts: DataFrame) -> DataFrame:
    """Anchors of all texts: h, context, key, at, n and local.

    Anchors of equal hash and context in a chunk meet before the exchange: one of them goes on with their number n, the others
    (local) need no more than to be known as repeated. So a passage that a third of all texts share is sent once a chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text", CHUNK):
                at, h, context, text = anchors(data, offsets)
                order = np.lexsort((context, h))
                at, h, context, text = at[order], h[order], context[order], text[order]
                first = np.ones(len(at), bool)
                first[1:] = (h[1:] != h[:-1]) | (context[1:] != context[:-1])
                group = np.cumsum(first) - 1
                n = np.bincount(group)[group] if len(at) else at
                keys = part.column("key").to_numpy()[text]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), pa.array(keys), pa.array((at - offsets[text]).astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(~first)], names=["h", "context", "key", "at", "n", "local"])

    return texts.select("key", "text").mapInArrow(run, "h long, context long, key long, at long, n long, local boolean")


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """Of anchors sorted by (h, context): whole (its context is repeated), and ask (one place of each context of a hash that has several)."""
    names = ["h", "context", "key", "at", "whole", "ask"]

    def close(rows: np.ndarray, several: int | None) -> pa.RecordBatch:
        """rows: all of some hashes, or all of some contexts of the hash several, which is known to have more than one."""
        h, c = rows[0], rows[1]
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
        group_h, group_c = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
        count = np.bincount(group_c, weights=rows[4])[group_c]
        contexts = np.bincount(group_h[new_c])[group_h]
        whole, ask = count > 1, new_c & ((contexts > 1) | (h == several if several is not None else False))
        keep = whole | ask
        return pa.RecordBatch.from_arrays([*(pa.array(r[keep]) for r in rows[:4]), pa.array(whole[keep]), pa.array(ask[keep])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, several = None, None  # rows of the last hash, which may go on; a hash of which contexts are gone on already
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("h", "context", "key", "at", "n")])
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            edge = int(np.searchsorted(rows[0], rows[0, -1]))
            if edge:
                yield close(rows[:, :edge], several)
            held = rows[:, edge:]
            if held.shape[1] > HELD:
                last = edge_of(held[1])
                if last:
                    several = int(held[0, 0])
                    yield close(held[:, :last], several)
                    held = held[:, last:]
                if held.shape[1] > HELD:  # all of one context, and so repeated: one of them stays for what is to come
                    whole = np.ones(held.shape[1] - 1, bool)
                    yield pa.RecordBatch.from_arrays([*(pa.array(r[1:]) for r in held[:4]), pa.array(whole), pa.array(~whole)], names=names)
                    held = held[:, :1]
                    held[4] = 2
        if held is not None:
            yield close(held, several)

    found = rows.filter("NOT local").drop("local").repartition("h").sortWithinPartitions("h", "context").mapInArrow(run, "h long, context long, key long, at long, whole boolean, ask boolean")
    return found.unionByName(rows.filter("local").select("h", "context", "key", "at", F.lit(True).alias("whole"), F.lit(False).alias("ask")))


def edge_of(contexts: np.ndarray) -> int:
    """Where the last run of equal values begins."""
    other = np.flatnonzero(contexts != contexts[-1])
    return int(other[-1]) + 1 if other.size else 0


def fetched(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The bytes around each asked place: h, key, at, single, left (reversed) and right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text", CHUNK):
                raw, rows = data.tobytes(), []
                for key, places, a, b in zip(part.column("key").to_pylist(), part.column("places").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    for p in places:
                        at = a + p["at"]
                        rows.append((p["h"], key, p["at"], not p["whole"], raw[max(a, at - REACH) : at][::-1], raw[at : min(b, at + LENGTH)]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], names=["h", "key", "at", "single", "left", "right"])

    places = asked.groupBy("key").agg(F.collect_list(F.struct("h", "at", "whole")).alias("places"))  # no more than a text's bytes
    return texts.select("key", "text").join(places, "key").mapInArrow(run, "h long, key long, at long, single boolean, left binary, right binary")


def sorted_groups(contexts: DataFrame) -> DataFrame:
    """key, low, high of the stretches of single contexts; rows of groups too large for a task come back (low null)."""
    schema = pa.schema([("key", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("single", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])

    def passed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([r | {"low": None, "high": None} for r in rows], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = [], None

        def close() -> pa.RecordBatch | None:
            if len(held) < 2 or not any(r["single"] for r in held):
                return None
            left, right = stretches([r["left"] for r in held], [r["right"] for r in held])
            rows = [{"key": r["key"], "low": r["at"] - int(a), "high": r["at"] + int(b)} for r, a, b in zip(held, left, right) if r["single"] and b]
            return pa.RecordBatch.from_pylist(rows, schema=schema) if rows else None

        for batch in batches:
            for row in batch.to_pylist():
                if row["h"] == large:
                    held.append(row)
                    if len(held) >= 10_000:
                        yield passed(held)
                        held = []
                    continue
                if held and (large is not None or held[0]["h"] != row["h"]):
                    done = passed(held) if large is not None else close()
                    held = []
                    if done is not None:
                        yield done
                large = None
                held.append(row)
                if len(held) > GROUP:
                    large = row["h"]
                    yield passed(held)
                    held = []
        done = (passed(held) if large is not None else close()) if held else None
        if done is not None:
            yield done

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(run, "key long, low long, high long, h long, at long, single boolean, left binary, right binary")


def counted_windows(big: DataFrame) -> DataFrame:
    """The stretches of groups that no task sorts: windows that another place has too, told by 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                rows = []
                for r in part.to_pylist():
                    whole, n = r["left"][::-1] + r["right"], len(r["left"])
                    rows += [(hashlib.blake2b(whole[i : i + LENGTH], digest_size=16).digest(), r["key"], r["at"] - n + i, r["single"]) for i in range(len(whole) - LENGTH + 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.bool_()))], names=["window", "key", "low", "single"])

    windows = big.select("key", "at", "single", "left", "right").mapInArrow(run, "window binary, key long, low long, single boolean")
    place = F.struct("key", "low")  # two anchors of a text may give the same window
    counts = windows.groupBy("window").agg((F.min(place) != F.max(place)).alias("again")).filter("again").select("window")
    return windows.filter("single").join(counts, "window").select("key", "low", (F.col("low") + LENGTH).alias("high"))


def stripped(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """sha, n_bytes, n_removed, n_spans and kept (binary) of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text", CHUNK):
                out = []
                lists = part.column("spans").to_pylist()
                for sha, copies, found, a, b in zip(part.column("sha").to_pylist(), part.column("copies").to_pylist(), lists, offsets[:-1].tolist(), offsets[1:].tolist()):
                    gone = np.zeros(b - a + 1, np.int32)
                    if copies > 1 and b - a >= LENGTH:
                        gone[[0, b - a]] = 1, -1
                    elif found:
                        np.add.at(gone, [s["low"] for s in found], 1)
                        np.subtract.at(gone, [s["high"] for s in found], 1)
                    gone = np.cumsum(gone)[:-1] > 0
                    starts = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((sha, b - a, int(gone.sum()), starts, data[a:b][~gone].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["sha", "n_bytes", "n_removed", "n_spans", "kept"])

    lists = spans.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))  # no more than a text's bytes
    return texts.join(lists, "key", "left").select("sha", "copies", "text", "spans").mapInArrow(run, "sha string, n_bytes long, n_removed long, n_spans long, kept binary")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """key, low, high: stretches of bytes in strings that occur again, of all distinct texts of at least LENGTH bytes."""
    marked = cut(repeated_anchors(cut(anchor_rows(texts.filter(F.length("text") >= LENGTH)), "places")), "anchors")
    contexts = fetched(texts, marked.filter("ask").select("h", "key", "at", "whole"))
    groups = cut(sorted_groups(contexts), "stretches")
    whole = marked.filter("whole").select("key", F.greatest(F.col("at") - REACH, F.lit(0)).alias("low"), (F.col("at") + LENGTH).alias("high"))
    whole = whole.join(texts.select("key", F.length("text").alias("n")), "key").select("key", "low", F.least("high", "n").alias("high"))
    spans = whole.unionByName(groups.filter("low is not null").select("key", "low", "high"))
    big = groups.filter("low is null")
    return spans if big.isEmpty() else spans.unionByName(counted_windows(big))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: its id, n_bytes, n_removed, n_spans (removed runs) and kept (binary: the remaining bytes)."""
    rows = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
    texts, name = distinct_texts(rows, "text")
    result = stripped(texts, repeated_spans(texts))
    docs.sparkSession.sql(f"DROP TABLE {name}")  # its files stay where the result reads them
    return rows.select("id", F.sha2("text", 256).alias("sha")).join(result, "sha").drop("sha").withColumnRenamed("id", id_column)
