"""Exact token counts of texts and of all their prefixes.

Byte-level BPE never merges across the words of its splitting rule, so a prefix of a text holds whole
words and at most one cut word. For each distinct word a dynamic program over its bytes gives the last
token and the token count of every prefix: the encoding of a prefix that ends in token t is the
encoding of what stands before t, then t, and t fits exactly if BPE leaves the pair (last token before
t, t) alone. Counts at word ends are running sums. Where a prefix splits into other words than the
whole text does, its count is that of its own words: at the end of a run of white space, within a
contraction, and within the string of a special token.

The counts of all prefixes are written as a table, which answers truncation and budget questions for
any limit later on: no text is read or encoded again.

Work per text is linear, nothing is shuffled, and a task keeps a bounded number of words.

Defined cases: null and empty texts have 0 tokens and 0 bytes; repeated rows each get their row; a null
id stays null; an empty table gives an empty result; other columns of the input are ignored whatever
their names; only prefixes that end with a whole character count; a special token's string is one token.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, ragged, work_dir
from .words import SPACE, classes, code_points, distinct, specials, split

#: Words that a Python worker remembers; then it forgets all and starts anew.
KNOWN_WORDS = 300_000
NEVER = 1 << 60
#: In place of a step: no character ends at this byte.
INSIDE = -(1 << 15)
#: Words that a prefix of two bytes splits in two.
LONG_CONTRACTIONS = (b"'re", b"'ve", b"'ll")
TABLE = "id long, n_bytes long, n_tokens long, steps binary"


@functools.cache
def byte_letters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteVocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) or spec["normalizer"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        letters = byte_letters()
        raw = {w: bytes(letters[c] for c in w) for w in model["vocab"] if all(c in letters for c in w)}
        self.specials = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.ids = {raw[w]: i for w, i in model["vocab"].items() if w in raw and raw[w] not in self.specials}
        self.longest = max(map(len, self.ids))
        self.size = max([*model["vocab"].values(), *self.specials.values()]) + 1
        self.merges: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: left part, right part, rank
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = (model["vocab"][x] for x in (a, b, a + b))
            self.merges[left, right] = rank
            self.made.setdefault(whole, (left, right, rank))
        self.edge = functools.cache(self._edge)
        self.pairs: dict[tuple[int, int], bool] = {}

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens that stand at an edge of a token while it is put together, each with the rank of the merge that ends it."""
        out, end = [], NEVER
        while True:
            out.append((token, end))
            if token not in self.made:
                return out
            end, token = self.made[token][2], self.made[token][int(right)]

    def apart(self, a: int, b: int) -> bool:
        """Does BPE leave a and b, side by side, as they are? Merges happen in the order of ranks, the leftmost first among equals."""
        known = self.pairs.get((a, b))
        if known is None:
            merges = self.merges
            known = not any((rank := merges.get((x, y))) is not None and rank < until and rank <= till for x, until in self.edge(a, True) for y, till in self.edge(b, False))
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def prefixes(self, word: bytes) -> tuple[list[int], list[int]]:
        """Of each prefix of a word, the empty one first: token count and last token."""
        ids, longest, pairs = self.ids, self.longest, self.pairs
        counts, last = [0], [-1]
        for i in range(1, len(word) + 1):
            for j in range(max(0, i - longest), i):
                token = ids.get(word[j:i])
                if token is None:
                    continue
                if j:
                    fits = pairs.get((last[j], token))
                    if not (self.apart(last[j], token) if fits is None else fits):
                        continue
                counts.append(counts[j] + 1)
                last.append(token)
                break
            else:
                raise ValueError(f"no token ends at byte {i} of {word[:40]!r}")
        return counts, last


@functools.cache
def vocabulary(path: str) -> ByteVocabulary:
    return ByteVocabulary(path)


class PrefixCounts:
    """Prefix counts of distinct words, remembered up to a bound."""

    def __init__(self, path: str):
        self.vocab, self.known = vocabulary(path), {}

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts at all prefixes of all words, one word after the other, and where each word's counts begin."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known, vocab, parts = self.known, self.vocab, []
        for w in words:
            counts = known.get(w)
            if counts is None:
                counts = [0] * len(w) + [1] if w in vocab.specials else vocab.prefixes(w)[0]
                if w in LONG_CONTRACTIONS:
                    counts[2] = 2
                counts = known[w] = np.array(counts, np.uint32).tobytes()
            parts.append(counts)
        return np.frombuffer(b"".join(parts), np.uint32), np.cumsum([0, *(len(p) // 4 for p in parts)])


@functools.cache
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def counts_of_chunk(data: np.ndarray, offsets: np.ndarray, table: PrefixCounts) -> tuple[np.ndarray, np.ndarray]:
    """Token count of each text, and the count of its prefix up to each byte."""
    marks = specials(data, offsets, list(table.vocab.specials))
    begins, ends, of = split(data, offsets, "byte", marks)
    number, words = distinct(data, begins, ends)
    inner, starts = table.of(words)
    full = inner[starts[1:] - 1] if words else np.zeros(0, np.uint32)
    total = np.concatenate([[0], np.cumsum(full[number], dtype=np.int64)])
    before = total[:-1] - np.repeat(total[of[:-1]], np.diff(of))  # tokens of the text's earlier words
    sizes = ends - begins
    every = inner[ragged(starts[number] + 1, sizes)] + np.repeat(before, sizes) if words else np.zeros(0, np.int64)
    at, runs_end = white_runs(data, begins, ends, of)
    if at.size:  # a prefix that ends with a run of white space has the run as one word
        run, found = distinct(data, begins[at], runs_end)
        counts, bounds = table.of(found)
        every[runs_end - 1] = before[at] + counts[bounds[1:] - 1][run]
    for a, b in marks:
        partly_special(data, begins, of, before, every, a, b, table)
    return total[of[1:]] - total[of[:-1]], every


def white_runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of white space whose run goes on with the next word's first character, and where that character ends."""
    if len(begins) < 2:
        return begins[:0], begins[:0]
    cp, places = code_points(data)
    white = classes()[cp] == SPACE
    place = (lambda x: x) if places is None else (lambda x: np.searchsorted(places, x))
    first, last = white[place(begins)], white[place(ends) - 1]
    inner = np.ones(len(begins), bool)
    inner[of[1:-1][of[1:-1] < len(begins)]] = False  # the first word of a text goes on with nothing
    at = np.flatnonzero(last[:-1] & first[1:] & inner[1:])
    after = place(begins[at + 1]) + 1
    return at, after if places is None else np.append(places, len(data))[after]


def partly_special(data: np.ndarray, begins: np.ndarray, of: np.ndarray, before: np.ndarray, every: np.ndarray, a: int, b: int, table: PrefixCounts) -> None:
    """Sets the counts within a special token's string, which is plain text until it is whole: words are split anew from two words before it."""
    w = int(np.searchsorted(begins, a))
    first, low = int(of[np.searchsorted(of, w, "right") - 1]), w
    while low > max(first, w - 2) and data[begins[low - 1] : begins[low]].tobytes() not in table.vocab.specials:
        low -= 1
    for end in range(a + 1, b):
        part = data[begins[low] : end]
        x, y, _ = split(part, np.array([0, len(part)]), "byte")
        number, words = distinct(part, x, y)
        counts, bounds = table.of(words)
        every[end - 1] = before[low] + int(counts[bounds[1:] - 1][number].sum())


def prefix_counts_of(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per text its id, n_bytes, n_tokens and steps: for each byte, as signed 16-bit little-endian integers, how the prefix up to it changes the count of the one before, or INSIDE.

    path: a byte-level BPE file, at the same place on all executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_counts(path)
        for batch in batches:
            for part, data, offsets in chunks(batch, "text", 2 << 20):
                n_tokens, every = counts_of_chunk(data, offsets, table)
                whole = np.ones(len(data), bool)
                whole[:-1] = (data[1:] & 0xC0) != 0x80
                at = np.flatnonzero(whole)
                counts = np.diff(every[at], prepend=0)
                first = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])
                counts[first] = every[at][first]
                if counts.size and np.abs(counts).max() >= -INSIDE:
                    raise ValueError("a prefix changes the count by more than a step holds")
                steps = np.full(len(data), INSIDE, "<i2")
                steps[at] = counts
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(offsets)), pa.array(n_tokens), pa.array([steps[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], names=["id", "n_bytes", "n_tokens", "steps"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, TABLE)


def write_prefix_counts(docs: DataFrame, path: str, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The table of all prefixes, written below folder (default: a new one in the shared folder) and read back."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "prefixes")
    prefix_counts_of(docs, path, id_column, text_column).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(TABLE).parquet(folder)


def counts_from(steps: bytes) -> np.ndarray:
    """The token count of the prefix up to each byte; at bytes that end no character, that of the prefix before."""
    own = np.frombuffer(steps, "<i2").astype(np.int64)
    return np.cumsum(np.where(own == INSIDE, 0, own))


def longest_within(steps: bytes, limit: int) -> int:
    """Bytes of the longest prefix of whole characters with at most limit tokens."""
    fits = np.flatnonzero((counts_from(steps) <= limit) & (np.frombuffer(steps, "<i2") != INSIDE))
    return int(fits[-1]) + 1 if fits.size else 0


def within_limit(table: DataFrame, limit: int) -> DataFrame:
    """Adds bytes_within_limit, the longest prefix in bytes of at most limit tokens, to id, n_bytes and n_tokens of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [n if steps is None else longest_within(steps.as_buffer(), limit) for n, steps in zip(batch.column("n_bytes").to_pylist(), (x if x.is_valid else None for x in batch.column("steps")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_bytes", "n_tokens")), pa.array(found, pa.int64())], names=["id", "n_bytes", "n_tokens", "bytes_within_limit"])

    over = table.select("id", "n_bytes", "n_tokens", F.when(F.col("n_tokens") > limit, F.col("steps")).alias("steps"))
    return over.mapInArrow(run, "id long, n_bytes long, n_tokens long, bytes_within_limit long")


def count_at(steps, n_bytes):
    """Token count of the prefix of n_bytes bytes, from the stored steps (columns or literals), in built-in functions."""
    have = F.least(n_bytes, F.floor(F.length(steps) / 2)).cast("int")
    low = lambda i: F.conv(F.hex(F.reverse(F.substring(steps, 2 * i + 1, F.lit(2)))), 16, 10).cast("int")
    step = lambda x: F.when(x == INSIDE + (1 << 16), 0).when(x >= 1 << 15, x - (1 << 16)).otherwise(x)
    every = F.transform(F.sequence(F.lit(0), F.greatest(have - 1, F.lit(0))), lambda i: step(low(i)))
    return F.when(have <= 0, F.lit(0).cast("long")).otherwise(F.aggregate(every, F.lit(0).cast("long"), lambda s, x: s + x))
