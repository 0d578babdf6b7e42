"""Periodic runs of words, found by string synchronising sets.

A run is a stretch of words with smallest period q, of FACTOR periods and LEAST words at least, that no
neighbouring word extends. Periods up to SMALL are found by comparing each word with the one q words on.
Longer ones are found at dyadic scales t: a run of a period q in (t, 2t] is looked for by the
synchronising set of scale t. A position belongs to it if, of the hashes of the t words from each of the
positions i to i + t, the least one is that of an end; so membership depends on the 2t words from i
alone, and of any t neighbouring positions one belongs to it. Positions in highly periodic regions (the
runs of a period up to t/4, known from smaller scales) take no part, which keeps the set small; what has
so small a period isn't a run of a longer one.

Two neighbouring positions of the set with equal contexts (2t words) at a distance of d words propose
the period d. In a run of period d all positions of the set have such a partner, so their contexts join
to one chain that reaches within t words of either end of the run: long enough chains are extended by at
most t words a side, compared word by word, and kept unless a run of smaller period holds them. Only
texts of over 4t words take part at scale t. Equal contexts are found by 64-bit hashes; what they propose
is compared word by word, so that nothing false is returned.

Defined cases: null texts have no words; texts without words have no runs and an empty collapsed text;
a null id stays null; repeated rows each get their row; runs may overlap, and each is returned; an empty
table gives an empty result; other columns are ignored whatever their names. A text is taken whole; its
task needs some 200 bytes of memory for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, ragged

#: Periods and words that a run has at least.
FACTOR, LEAST = 4, 6
#: Periods up to this one are found by comparing words directly: the first scale, a power of two.
SMALL = 8
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
NEVER = np.uint64(2**64 - 1)
#: Fixed value: what parts words.
WORD = r"[^\x20\x09-\x0D]+"


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair."""
    z = a * ODD[0] + b * ODD[1]
    z ^= z >> np.uint64(31)
    z *= ODD[2]
    z ^= z >> np.uint64(29)
    return z


def ahead(values: np.ndarray, by: int, fill: np.uint64 | None = None) -> np.ndarray:
    """The values that stand so many places on; beyond the end values of their own, or fill."""
    rest = np.full(min(by, len(values)), fill, np.uint64) if fill is not None else (np.arange(min(by, len(values)), dtype=np.uint64) + np.uint64(by)) * ODD[2]
    return np.concatenate([values[by:], rest])


def stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of so many true values at least."""
    edge = np.flatnonzero(np.diff(equal, prepend=False, append=False))
    a, b = edge[::2], edge[1::2]
    long = b - a >= least
    return a[long], b[long]


class Found:
    """Runs found so far, as start, end and period."""

    def __init__(self):
        self.rows = np.zeros((0, 3), np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """Keeps those that no run added before holds: its period would be smaller."""
        if len(start) and len(self.rows):
            order = np.argsort(self.rows[:, 0], kind="stable")
            starts, reach = self.rows[order, 0], np.maximum.accumulate(self.rows[order, 1])
            before = np.searchsorted(starts, start, "right") - 1
            own = (before < 0) | (reach[np.maximum(before, 0)] < end)
            start, end, period = start[own], end[own], period[own]
        if len(start):
            self.rows = np.concatenate([self.rows, np.column_stack([start, end, period])])


def synchronised(h: np.ndarray, t: int, periodic: np.ndarray) -> np.ndarray:
    """The positions of the synchronising set of scale t. h: hashes of t words from each position; periodic: those that take no part."""
    v = np.where(periodic, NEVER, h)
    least, size = v, 1
    while size < t:
        least = np.minimum(least, ahead(least, size, NEVER))
        size *= 2
    last = ahead(v, t, NEVER)
    least = np.minimum(least, last)
    return np.flatnonzero(((least == v) | (least == last)) & (least != NEVER))


def proposals(h: np.ndarray, t: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position, last position and distance of each chain of equal contexts at distances in (t, 2t]."""
    key = mixed(h[at], ahead(h, t)[at])
    order = np.argsort(key, kind="stable")
    i, j = at[order[:-1]], at[order[1:]]
    d = j - i
    fit = (key[order[:-1]] == key[order[1:]]) & (d > t) & (d <= 2 * t)
    i, d = i[fit], d[fit]
    order = np.lexsort([i, d])
    i, d = i[order], d[order]
    new = np.ones(len(i), bool)
    new[1:] = (d[1:] != d[:-1]) | (i[1:] - i[:-1] > 2 * t)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i))[: len(first)] - 1
    return i[first], i[last], d[first]


def extended(x: np.ndarray, first: np.ndarray, last: np.ndarray, d: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the runs that the chains stand for: at most t - 1 more words on either side."""
    step = np.arange(t)
    n = len(x)

    def more(place: np.ndarray) -> np.ndarray:
        """Equal words from the first column on, in each row; places outside don't count as equal."""
        there = (place >= 0) & (place + d[:, None] < n)
        place = np.clip(place, 0, n - 1)
        return (there & (x[place] == x[np.minimum(place + d[:, None], n - 1)])).cumprod(axis=1).sum(axis=1)

    left, right = more(first[:, None] - 1 - step), more(last[:, None] + 2 * t + step)
    start, end = first - left, last + 2 * t + right + d
    fit = (left < t) & (right < t) & (end - start >= np.maximum(FACTOR * d, LEAST))
    start, end, d = start[fit], end[fit], d[fit]
    if len(start):
        place = ragged(start, end - d - start)
        same = x[place] == x[place + np.repeat(d, end - d - start)]
        whole = np.logical_and.reduceat(same, np.cumsum(end - d - start) - (end - d - start))
        start, end, d = start[whole], end[whole], d[whole]
    return start, end, d


def runs_of(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Start, end and period of all runs. x: word numbers, with a negative number of its own after each text; sizes: words of each text."""
    found = Found()
    for q in range(1, SMALL + 1):
        if len(x) > q:
            start, end = stretches(x[q:] == x[:-q], max(FACTOR * q, LEAST) - q)
            found.add(start, end + q, np.full(len(start), q))
    t, places = SMALL, np.arange(len(x))
    h = None
    while (long := sizes >= FACTOR * (t + 1)).any():
        mask = np.repeat(long, sizes + 1)
        places, sizes = places[mask], sizes[long]
        if h is None:
            h, size = mixed(x[places].astype(np.uint64), np.uint64(1)), 1
            while size < t:
                h, size = mixed(h, ahead(h, size)), 2 * size
        else:
            h = h[mask]
        known = found.rows[(found.rows[:, 2] * 4 <= t) & (found.rows[:, 1] - found.rows[:, 0] >= t)]
        at = np.searchsorted(places, known[:, 0])
        there = (at < len(places)) & (places[np.minimum(at, len(places) - 1)] == known[:, 0])
        at, known = at[there], known[there]
        inside = np.zeros(len(places) + 1, np.int64)
        np.add.at(inside, at, 1)
        np.add.at(inside, at + known[:, 1] - known[:, 0] - t + 1, -1)
        first, last, d = proposals(h, t, synchronised(h, t, np.cumsum(inside[:-1]) > 0))
        enough = last + 2 * t - first >= (FACTOR - 1) * d - 2 * t
        if enough.any():
            start, end, d = extended(x[places], first[enough], last[enough], d[enough], t)
            found.add(places[start], places[start] + end - start, d)
        h = mixed(h, ahead(h, t))
        t *= 2
    return found.rows


def collapsed_chunk(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Runs as (text, start, length, period) in order, the number of runs of each text, and the collapsed texts."""
    raw, table, texts, parts = data.tobytes(), {}, [], []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        words = raw[a:b].split()
        texts.append(words)
        parts += [np.fromiter(map(table.setdefault, words, range(a, b)), np.int64, len(words)), np.array([-1 - k])]
    sizes = np.array([len(w) for w in texts], np.int64)
    x = np.concatenate(parts)
    starts = np.cumsum(sizes + 1) - sizes - 1
    rows = runs_of(x, sizes)
    text = np.searchsorted(starts, rows[:, 0], "right") - 1
    rows = np.column_stack([text, rows[:, 0] - starts[text], rows[:, 1] - rows[:, 0], rows[:, 2]])
    rows = rows[np.lexsort([rows[:, 3], rows[:, 1], rows[:, 0]])]
    gone = np.zeros(len(x) + 1, np.int64)
    np.add.at(gone, starts[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
    np.add.at(gone, starts[rows[:, 0]] + rows[:, 1] + rows[:, 2], -1)
    kept = np.cumsum(gone) == 0
    counts = np.bincount(rows[:, 0], minlength=len(sizes))
    out = [b" ".join(compress(w, kept[a : a + len(w)].tolist()) if n else w) for w, a, n in zip(texts, starts.tolist(), counts.tolist())]
    return rows, counts, out


def collapse_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id, runs (start, length and period in words, by start, then period) and collapsed: the words that no run holds after its first period, joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                rows, counts, texts = collapsed_chunk(data, offsets)
                own = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), own)
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "runs", "collapsed"])

    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id_column)


def with_planted_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows; where the id's crc32 h is divisible by ten, words repeat to the end of the text: word i >= a becomes word a + (i - a) % p. A null id leaves its text as it is."""
    name = fresh(docs, "_words")
    h, w = F.crc32(F.col(id_column).cast("string")), F.col(name)
    g, n = F.floor(h / 10), F.size(w).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    words = F.when((h % 10 == 0) & F.col(text_column).rlike(WORD), F.regexp_extract_all(text_column, F.lit(WORD), F.lit(0)))
    made = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return docs.withColumn(name, words).withColumn(text_column, F.when(w.isNotNull(), F.array_join(made, " ")).otherwise(F.col(text_column))).drop(name)
