"""Hashed maximum-entropy language model, trained by distributed gradient updates.

Counts. A text's tokens are its words (A-Z in lower case) and one end. Each block of texts (some 16 MB)
gives its distinct words with their training counts to buckets by a hash of the word; a bucket adds the
counts up and gives each block the totals of its words back, so no word travels once for each occurrence
and no table of words is gathered. Words are compared exactly: as their bytes up to 15, longer ones as a
128-bit hash.

Model. The log-probability of a token after its context is that of its class and that of the token
within it, each a softmax over hashed features of the context: the word before, the word before that (a
skip of one) and, for the class, the pair of them, with a bias from counts. The CLASSES - 1 classes of PER_CLASS words
each hold the most frequent words by count, the end among them; the last class holds all other words, and
gives each its share of the class's training count, smoothed as in the base score. The probabilities of
all words, with one for any unseen word, add up to 1.

Training runs over all training texts, dealt to ROUNDS parts by a hash of id and text. In a round tasks start
from the same weights, take stochastic gradient steps (Adagrad) over their texts, and send how far each row
of weights moved and how often it was touched; the moves are added up by shards of rows, weighted by
the touches. Weights are of fixed size and are what passes through the driver.

Defined cases: null texts are empty; an empty text is its end alone; a null id is never held out;
repeated rows each get their row and each count; with no training texts all words are unseen; an empty table
gives an empty result; other columns are ignored whatever their names. The input must read alike when
it is read twice (a table, or a written intermediate).
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, sums
from .words import MASKS

PARTS, HELD_OUT = 5, 1
CLASSES, PER_CLASS = 32, 64
#: Rows of weights for classes and for words within a class, and those that a shard has.
CLASS_ROWS, WORD_ROWS, SHARD_ROWS = 1 << 14, 1 << 14, 1 << 12
ROUNDS, RATE, BATCH = 3, 0.1, 2048
#: Training tokens of a task, so that what tasks send stays a small part of what they read.
TASK_TOKENS = 6_000_000
BLOCK_BYTES = 16 << 20
#: Blanks between words.
BLANKS = np.zeros(256, bool)
BLANKS[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: The end as two integers: no word has 255 in its highest byte and 1 below.
END = (np.uint64(1), np.uint64(0xFF << 56))
LN10 = float(np.log(10))


def mixed(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit hash of each pair."""
    z = a * ODD[0] + b * ODD[1]
    z ^= z >> np.uint64(32)
    z *= ODD[2]
    z ^= z >> np.uint64(29)
    return z


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low and high integer of each token of a chunk, an end after each text, and the number of the first token of each text (one more at the end)."""
    data = LOWER[data]
    blank = BLANKS[data]
    begin, stop = ~blank, ~blank
    inner = ~blank[1:] & ~blank[:-1]
    begin[1:] &= ~inner
    stop[:-1] &= ~inner
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] |= ~blank[edges]
    stop[edges - 1] |= ~blank[edges - 1]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    sizes = ends - begins
    raw = data.tobytes()
    eight = np.ndarray((len(raw) + 8,), "<u8", np.frombuffer(raw + bytes(16), np.uint8), strides=(1,))
    low = eight[begins] & MASKS[np.minimum(sizes, 8)]
    high = (eight[np.minimum(begins + 8, len(raw))] & MASKS[np.clip(sizes - 8, 0, 7)]) | np.minimum(sizes, 15).astype(np.uint64) << np.uint64(56)
    far = np.flatnonzero(sizes > 15)
    if far.size:
        found = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begins[far].tolist(), ends[far].tolist()))
        pair = np.frombuffer(found, "<u8").reshape(-1, 2)
        low[far], high[far] = pair[:, 0], (pair[:, 1] & MASKS[7]) | np.uint64(0xFE << 56)
    of = np.searchsorted(begins, offsets)
    bounds = of + np.arange(len(of))
    out = [np.empty(bounds[-1], np.uint64) for _ in range(2)]
    ends_at = bounds[1:] - 1
    mask = np.ones(bounds[-1], bool)
    mask[ends_at] = False
    for k, values in enumerate((low, high)):
        out[k][mask] = values
        out[k][ends_at] = END[k]
    return out[0], out[1], bounds


def numbered(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each token among the distinct ones, in order of bucket hash, and those as low and high."""
    codes, found = pd.factorize(mixed(low, high))
    one = np.empty(len(found), np.int64)
    one[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    if not (np.array_equal(low, low[one][codes]) and np.array_equal(high, high[one][codes])):  # two words share a hash
        pairs, one, codes = np.unique(np.column_stack([low, high]), axis=0, return_index=True, return_inverse=True)
        codes = codes.ravel()
    order = np.lexsort([high[one], low[one], mixed(low[one], high[one])])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[codes], low[one][order], high[one][order]


def of_bucket(low: np.ndarray, high: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets rise with the order of numbered()."""
    return ((mixed(low, high) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], partition: int) -> Iterator[tuple[bytes, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Key, ids, learned, low, high and bounds of tokens of each block. The key holds the partition, the block's number in it and a hash of its tokens."""
    held, size, n = [], 0, 0

    def close():
        ids, learned, low, high, tokens_of = ([x[k] for x in held] for k in range(5))
        low, high = np.concatenate(low), np.concatenate(high)
        key = hashlib.blake2b(b"%d %d " % (partition, n) + low.tobytes() + high.tobytes(), digest_size=16).digest()
        return key, pa.concat_arrays(ids), np.concatenate(learned), low, high, np.concatenate([[0], np.cumsum(np.concatenate(tokens_of))])

    for batch in batches:
        for part, data, offsets in chunks(batch, "text"):
            if held and size + len(data) > BLOCK_BYTES:
                yield close()
                held, size, n = [], 0, n + 1
            low, high, bounds = tokens(data, offsets)
            held.append((part.column("id"), part.column("learned").to_numpy(zero_copy_only=False), low, high, np.diff(bounds)))
            size += len(data)
    if held:
        yield close()


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 3)


def counted(rows: DataFrame, buckets: int) -> DataFrame:
    """block, bucket and totals (binary: the training count of each of the block's words in the bucket), and a row without a block for each bucket: its tokens, its distinct ones, and its most frequent."""
    most = (CLASSES - 1) * PER_CLASS

    def lists(batches):
        for key, _, learned, low, high, bounds in blocks(batches, TaskContext.get().partitionId()):
            number, low, high = numbered(low, high)
            count = np.bincount(number[np.repeat(learned, np.diff(bounds))], minlength=len(low)).astype("<u4")
            edges = np.searchsorted(of_bucket(low, high, buckets), np.arange(buckets + 1))
            for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                if i < j:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([b], pa.int32()), pa.array([packed(low[i:j], high[i:j], count[i:j])], pa.binary())], names=["block", "bucket", "words"])

    def bucket_rows(bucket: int, held: list[tuple[bytes, bytes]]):
        sizes, low, high, count = [], [], [], []
        for _, words in held:
            raw = zstandard.decompress(words)
            n = len(raw) // 20
            sizes.append(n)
            low.append(np.frombuffer(raw, "<u8", n))
            high.append(np.frombuffer(raw, "<u8", n, 8 * n))
            count.append(np.frombuffer(raw, "<u4", n, 16 * n))
        number, low, high = numbered(np.concatenate(low), np.concatenate(high))
        total = np.bincount(number, weights=np.concatenate(count), minlength=len(low)).astype("<i8")
        at = 0
        for (key, _), n in zip(held, sizes):
            yield key, bucket, packed(total[number[at : at + n]]), None, None, None
            at += n
        top = np.lexsort([high, low, -total])[:most]
        top = top[total[top] > 0]
        yield None, bucket, None, int(total.sum()), int((total > 0).sum()), packed(low[top], high[top], total[top])

    def totals(batches):
        """Rows come bucket by bucket."""
        held, at = [], None
        names = ["block", "bucket", "totals", "tokens", "distinct", "most"]
        kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

        def out(rows):
            for r in rows:
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(r, kinds)], names=names)

        for batch in batches:
            for block, bucket, words in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "words"))):
                if held and bucket != at:
                    yield from out(bucket_rows(at, held))
                    held = []
                at = bucket
                held.append((block, words))
        if held:
            yield from out(bucket_rows(at, held))

    listed = rows.mapInArrow(lists, "block binary, bucket int, words binary")
    found = listed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return found.mapInArrow(totals, "block binary, bucket int, totals binary, tokens long, distinct long, most binary")


@dataclass
class Model:
    """low, high: the frequent words, class by class; class_bias, word_bias: logs of their shares; class_rows, word_rows: hashed weights."""

    low: np.ndarray
    high: np.ndarray
    class_bias: np.ndarray
    word_bias: np.ndarray
    class_rows: np.ndarray
    word_rows: np.ndarray
    n_tokens: int
    n_distinct: int
    rest_tokens: int
    rest_distinct: int

    def ranks(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each token among the frequent ones; the last class's number for all others."""
        bits = np.uint64(64 - 16)
        table = np.full(1 << 16, -1, np.int64)
        own, more = mixed(self.low, self.high) >> bits, {}
        for k, s in enumerate(own.tolist()):
            if table[s] < 0:
                table[s] = k
            else:
                more.setdefault(s, []).append(k)
        slot = (mixed(low, high) >> bits).astype(np.int64)
        out = table[slot]
        known = np.maximum(out, 0)
        hit = (out >= 0) & (self.low[known] == low) & (self.high[known] == high) if len(self.low) else np.zeros(len(low), bool)
        out = np.where(hit, out, (CLASSES - 1) * PER_CLASS)
        if more:
            crowded = np.zeros(1 << 16, bool)
            crowded[list(more)] = True
            for i in np.flatnonzero(crowded[slot] & ~hit):
                for k in more[int(slot[i])]:
                    if self.low[k] == low[i] and self.high[k] == high[i]:
                        out[i] = k
        return out


def contexts(low: np.ndarray, high: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the class weights (a row of the result for each feature) and hashes for the word weights, of each token."""
    h = mixed(low, high)
    place = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))

    def before(k: int) -> np.ndarray:
        out = np.empty_like(h)
        out[:k], out[k:] = ODD[3], h[: len(h) - k]
        out[place < k] = ODD[3]
        return out

    one, two = before(1), before(2)
    seeds = np.arange(1, 4, dtype=np.uint64)[:, None]
    features = np.stack([mixed(one, seeds[0]), mixed(two, seeds[1]), mixed(one + two * ODD[1], seeds[2])])
    return ((features >> np.uint64(40)) % np.uint64(CLASS_ROWS)).astype(np.int64), features[:2]


def word_rows_of(features: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return ((mixed(features, classes.astype(np.uint64) + np.uint64(17)) >> np.uint64(40)) % np.uint64(WORD_ROWS)).astype(np.int64)


def gathered(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Sums of a bias and the weights' rows, within +-60. Sums over columns here and below are products with ones, which numpy does several times as fast."""
    out, more = np.empty((rows.shape[1], weights.shape[1]), np.float32), np.empty((rows.shape[1], weights.shape[1]), np.float32)
    np.take(weights, rows[0], axis=0, out=out, mode="clip")
    for own in rows[1:]:
        np.take(weights, own, axis=0, out=more, mode="clip")
        out += more
    out += bias
    return np.clip(out, -60, 60, out=out)


def softmax(logits: np.ndarray) -> np.ndarray:
    """Probabilities of each row, in place."""
    np.exp(logits, out=logits)
    logits *= (1 / (logits @ np.ones(logits.shape[1], np.float32)))[:, None]
    return logits


def log_softmax(logits: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The log-probability of one column of each row."""
    own = logits[np.arange(len(logits)), column]
    np.exp(logits, out=logits)
    return own - np.log(logits @ np.ones(logits.shape[1], np.float32))


def score_tokens(model: Model, low: np.ndarray, high: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log-probability of each token's class and, but for the last class, of the token within it; and which tokens are of the last class."""
    rank = model.ranks(low, high)
    rows, features = contexts(low, high, bounds)
    out = np.empty(len(low), np.float64)
    for a in range(0, len(low), BATCH):
        own, k = slice(a, a + BATCH), rank[a : a + BATCH] // PER_CLASS
        out[own] = log_softmax(gathered(model.class_rows, rows[:, own], model.class_bias), k)
        near = np.flatnonzero(k < CLASSES - 1)
        if near.size:
            at = word_rows_of(features[:, own][:, near], k[near])
            out[a + near] += log_softmax(gathered(model.word_rows, at, model.word_bias[k[near]]), rank[own][near] % PER_CLASS)
    return out, rank == (CLASSES - 1) * PER_CLASS


def descend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, p: np.ndarray, target: np.ndarray, random: np.random.Generator) -> None:
    """An Adagrad step. The gradient of a token is 1 - p at its target and p at all other columns; of these, one drawn by p stands for all, with their whole weight, so that two columns change in each row and the mean is that of the gradient."""
    n, width = p.shape
    p[np.arange(n), target] = 0
    up_to = p @ np.triu(np.ones((width, width), np.float32))
    grad = np.ascontiguousarray(up_to[:, -1])
    beyond = (up_to < (random.random(n, np.float32) * grad)[:, None]).astype(np.float32) @ np.ones(width, np.float32)
    other = np.minimum(beyond.astype(np.int64), width - 1)
    flat, seen, square = weights.reshape(-1), squares.reshape(-1), grad * grad
    for own in rows:
        for at, sign in ((own * width + target, 1), (own * width + other, -1)):
            np.add.at(seen, at, square)
            np.add.at(flat, at, np.float32(sign * RATE) * grad / np.sqrt(seen[at] + np.float32(1e-6)))


class Learner:
    """A copy of the weights that a task moves."""

    def __init__(self, model: Model, seed: int):
        self.model, self.random = model, np.random.default_rng(seed)
        self.start = model.class_rows, model.word_rows
        # Copies of the type as such: pickled arrays have one of their own, which is equal but makes np.add.at take ten times as long.
        model.class_rows, model.word_rows = (w.astype(np.float32) for w in self.start)
        self.squares = [np.zeros(w.shape, np.float32) for w in self.start]
        self.touches = [np.zeros(len(w), np.float32) for w in self.start]

    def learn(self, low: np.ndarray, high: np.ndarray, bounds: np.ndarray) -> None:
        m = self.model
        rank = m.ranks(low, high)
        rows, features = contexts(low, high, bounds)
        for a in range(0, len(low), BATCH):
            own, k = slice(a, a + BATCH), rank[a : a + BATCH] // PER_CLASS
            descend(m.class_rows, self.squares[0], rows[:, own], softmax(gathered(m.class_rows, rows[:, own], m.class_bias)), k, self.random)
            near = np.flatnonzero(k < CLASSES - 1)
            if near.size:
                at = word_rows_of(features[:, own][:, near], k[near])
                descend(m.word_rows, self.squares[1], at, softmax(gathered(m.word_rows, at, m.word_bias[k[near]])), rank[own][near] % PER_CLASS, self.random)
                np.add.at(self.touches[1], at.ravel(), np.float32(1))
        self.touches[0] += np.bincount(rows.ravel(), minlength=CLASS_ROWS)

    def moves(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Shard, touches of its rows and weighted moves of those touched."""
        shard = 0
        for begun, now, touches in zip(self.start, (self.model.class_rows, self.model.word_rows), self.touches):
            for a in range(0, len(begun), SHARD_ROWS):
                t = touches[a : a + SHARD_ROWS]
                yield shard, t, (now[a : a + SHARD_ROWS] - begun[a : a + SHARD_ROWS])[t > 0]
                shard += 1


def first_model(found: DataFrame) -> Model:
    """The model that knows counts alone, from the buckets' rows."""
    facts = found.filter("block is null")
    n, distinct = facts.agg(F.sum("tokens"), F.sum("distinct")).first()
    most = (CLASSES - 1) * PER_CLASS

    def listed(batches):
        for batch in batches:
            for raw in batch.column("most").to_pylist():
                raw = zstandard.decompress(raw)
                k = len(raw) // 24
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, kind, k, 8 * at * k).astype("<i8")) for at, kind in enumerate(("<i8", "<i8", "<i8"))], names=["low", "high", "n"])

    top = facts.select("most").mapInArrow(listed, "low long, high long, n long").orderBy(F.desc("n"), "low", "high").limit(most).collect()  # the frequent words
    low, high, count = (np.array([r[k] for r in top], np.int64) for k in range(3))
    share = np.zeros(most)
    share[: len(count)] = count
    by_class = share.reshape(CLASSES - 1, PER_CLASS)
    rest, rest_distinct = int(n or 0) - int(count.sum()), int(distinct or 0) - len(count)
    word_bias = np.log((by_class + 0.01) / (by_class + 0.01).sum(axis=1, keepdims=True)).astype(np.float32)
    whole = np.append(by_class.sum(axis=1), rest) + 0.5
    rows = [np.zeros((r, c), np.float32) for r, c in ((CLASS_ROWS, CLASSES), (WORD_ROWS, PER_CLASS))]
    return Model(low.view(np.uint64), high.view(np.uint64), np.log(whole / whole.sum()).astype(np.float32), word_bias, *rows, int(n or 0), int(distinct or 0), rest, rest_distinct)


def trained(rows: DataFrame, model: Model) -> Model:
    """The model after ROUNDS passes, each over its own part of the training texts."""
    spark = rows.sparkSession
    tasks = max(1, -(-model.n_tokens // (ROUNDS * TASK_TOKENS)))
    learned = rows.filter("learned").select("text", F.pmod(F.xxhash64("id", "text"), F.lit(ROUNDS)).alias("round"))
    shards = (CLASS_ROWS + WORD_ROWS) // SHARD_ROWS
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(pickle.dumps(model))

        def learn(batches):
            own = None
            for batch in batches:
                for _, data, offsets in chunks(batch, "text", 1 << 20):
                    own = own or Learner(pickle.loads(shared.value), TaskContext.get().partitionId())
                    own.learn(*tokens(data, offsets))
            for shard, touches, moves in own.moves() if own else ():
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([packed(touches.astype("<f4"), (moves * touches[touches > 0, None]).astype("<f4"))], pa.binary())], names=["shard", "moves"])

        def added(batches):
            total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("moves").to_pylist()):
                    raw = zstandard.decompress(raw)
                    touches = np.frombuffer(raw, "<f4", SHARD_ROWS)
                    moves = np.frombuffer(raw, "<f4", -1, 4 * SHARD_ROWS).reshape(int((touches > 0).sum()), -1)
                    own = total.setdefault(shard, (np.zeros(SHARD_ROWS), np.zeros((SHARD_ROWS, moves.shape[1]))))
                    own[0][:] += touches
                    own[1][touches > 0] += moves
            for shard, (touches, moves) in total.items():
                mean = (moves / np.maximum(touches, 1)[:, None]).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([packed(mean)], pa.binary())], names=["shard", "moves"])

        sent = learned.filter(F.col("round") == k).select("text").coalesce(tasks).mapInArrow(learn, "shard int, moves binary")
        for shard, raw in sent.repartition(shards, "shard").mapInArrow(added, "shard int, moves binary").collect():  # the weights' size, whatever the input's
            at = shard * SHARD_ROWS
            to, at = (model.class_rows, at) if at < CLASS_ROWS else (model.word_rows, at - CLASS_ROWS)
            to[at : at + SHARD_ROWS] += np.frombuffer(zstandard.decompress(raw), "<f4").reshape(SHARD_ROWS, -1)
        shared.unpersist()
    return model


def scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_column]
    held_out = F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(PARTS)) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text"), (~held_out).alias("learned"))
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = cut(counted(rows, buckets), "counts")
    model = trained(rows, first_model(found))
    shared = spark.sparkContext.broadcast(pickle.dumps(model))

    def modelled(batches):
        """Of each block: scores of the model but for the last class's words, and the numbers of all tokens."""
        m = pickle.loads(shared.value)
        for key, ids, learned, low, high, bounds in blocks(batches, TaskContext.get().partitionId()):
            logs, rest = score_tokens(m, low, high, bounds)
            number, _, _ = numbered(low, high)
            payload = packed(np.diff(bounds).astype("<u4"), rest, number.astype("<u4"))
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids.to_pylist()], pa.list_(pa.string())), pa.array([(~learned).tolist()], pa.list_(pa.bool_())), pa.array([np.add.reduceat(logs, bounds[:-1]).tolist()], pa.list_(pa.float64())), pa.array([payload], pa.binary())], names=["block", "ids", "held_out", "logs", "numbers"])

    n, v, rest_n, rest_v = model.n_tokens, model.n_distinct, model.rest_tokens, model.rest_distinct

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(right.column("bucket").to_numpy())
        lists = right.column("totals").to_pylist()
        count = np.concatenate([np.frombuffer(zstandard.decompress(lists[k]), "<i8") for k in order]) if lists else np.zeros(0, np.int64)
        base, in_rest = (np.log((count + 0.5) / (total + 0.5 * (kinds + 1))) for total, kinds in ((n, v), (rest_n, rest_v)))
        for ids, held, logs, packed_numbers in zip(*(left.column(c).to_pylist() for c in ("ids", "held_out", "logs", "numbers"))):
            raw = zstandard.decompress(packed_numbers)
            sizes = np.frombuffer(raw, "<u4", len(ids)).astype(np.int64)
            total = int(sizes.sum())
            rest = np.frombuffer(raw, bool, total, 4 * len(ids))
            number = np.frombuffer(raw, "<u4", total, 4 * len(ids) + total)
            if total and int(number.max()) >= len(count):
                raise ValueError("a block's words have changed between two reads of the input")
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            score = np.array(logs) + np.add.reduceat(np.where(rest, in_rest[number], 0.0), bounds[:-1])
            out.append(pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(held, pa.bool_()), pa.array(sizes), pa.array(sums(count[number] > 0, bounds)), pa.array(np.add.reduceat(base[number], bounds[:-1]) / LN10), pa.array(score / LN10)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.Table.from_batches(out, schema=pa.schema([("id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))

    own = rows.mapInArrow(modelled, "block binary, ids array<string>, held_out array<boolean>, logs array<double>, numbers binary")
    totals = found.filter("block is not null").select("block", "bucket", "totals")
    out = own.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(joined, "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").cast(kind).alias(id_column), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
