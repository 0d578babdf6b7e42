"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the mean of rows of a hashed table: the row of the word and those of its first
three, four and five bytes, so that unseen forms of a stem count. Filters of several widths pass over the
whole text, the largest answer of each filter is kept, and a logistic unit gives the score. Training
takes a bounded sample of labelled rows (MOST_TOXIC and MOST_CLEAN, by a hash of the id), the same rule
at every size; scoring passes over every text in its task with a model of fixed size.

Thresholds: on a part of the sample that training does not see, the overall threshold is moved to
THRESHOLD by a shift of the logit, and each language gets a threshold of its own where it has enough
rows. Language never enters a score.

Defined cases: null texts are empty, and an empty text gets the score of no word at all; a null id is
never held out; rows without a label are scored only; of several labels of an id the toxic one counts, of
several texts of an id the least one is learned from;
with no labels of both kinds all scores are 0; an empty table gives an empty result; other columns are
ignored whatever their names; repeated rows each get their row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fresh, whole_text
from .words import distinct, split

#: Rows of the training sample, at most.
MOST_TOXIC, MOST_CLEAN = 2000, 4000
#: The held-out remainder, and the score from which a text is toxic.
PARTS, HELD_OUT, THRESHOLD = 4, 2, 0.3
ROWS, WIDTH, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 32, 0.02
#: Calibration rows that a language needs for a threshold of its own.
LEAST_ROWS = 100


def features(words: list[bytes]) -> np.ndarray:
    """Rows of the embedding table for each word: of itself and of three beginnings."""
    crc = zlib.crc32
    return np.array([(crc(w), crc(w[:3], 3), crc(w[:4], 4), crc(w[:5], 5)) for w in words], np.int64).reshape(-1, 4) % ROWS


def lowered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lower case."""
    if not data.size or data.max() < 0x80:
        return np.frombuffer(data.tobytes().lower(), np.uint8), offsets
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace").lower().encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def placed(number: np.ndarray, of: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers with as many blanks after each text as the widest filter reaches, and where texts begin."""
    pad = max(WIDTHS) - 1
    bounds = of + pad * np.arange(len(of))
    out = np.full(int(bounds[-1]), none, np.int64)
    if len(number):
        out[np.arange(len(number)) + pad * (np.searchsorted(of, np.arange(len(number)), "right") - 1)] = number
    return out, bounds


@dataclass
class Model:
    table: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: float = 0.0
    by_language: dict[str, float] = field(default_factory=dict)

    def answers(self, words: np.ndarray, number: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled answers of all filters for each text, and the answers at all places. words: embeddings of the distinct words, the blank last."""
        parts = np.concatenate([self.filters[w][k] for w in WIDTHS for k in range(w)], axis=1)
        got = (words @ parts)[number]
        every, at = np.empty((len(number), FILTERS * len(WIDTHS)), np.float32), 0
        for j, w in enumerate(WIDTHS):
            own = every[:, j * FILTERS : (j + 1) * FILTERS]
            own[:] = got[:, at : at + FILTERS]
            for k in range(1, w):
                more = got[k:, at + k * FILTERS : at + (k + 1) * FILTERS].copy()
                beyond = (bounds[1:-1, None] - np.arange(1, k + 1)).ravel()  # places whose k-th next word is another text's
                more[beyond[beyond >= 0]] = 0
                own[: len(own) - k] += more
            at += w * FILTERS
        pooled = np.maximum.reduceat(every, bounds[:-1], axis=0)
        return np.maximum(pooled + self.bias, 0), every

    def embeddings(self, rows: np.ndarray) -> np.ndarray:
        own = self.table[rows].mean(axis=1) if len(rows) else np.zeros((0, WIDTH), np.float32)
        return np.concatenate([own, np.zeros((1, WIDTH), np.float32)])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        data, offsets = lowered(data, offsets)
        begins, ends, of = split(data, offsets, "word")
        number, words = distinct(data, begins, ends)
        number, bounds = placed(number, of, len(words))
        pooled, _ = self.answers(self.embeddings(features(words)), number, bounds)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias + self.shift, -50, 50).astype(np.float64)))


def train(texts: list[str], labels: np.ndarray, languages: list[str | None], seed: int = 7) -> Model | None:
    """A model from labelled texts, one in five of which set the thresholds; None if a class is missing."""
    if not 0 < labels.sum() < len(labels):
        return None
    random = np.random.default_rng(seed)
    words, parts, sizes = {}, [], []
    for data, offsets in slices(texts):
        data, offsets = lowered(data, offsets)
        begins, ends, bounds = split(data, offsets, "word")
        part, found = distinct(data, begins, ends)
        parts.append(np.array([words.setdefault(w, len(words)) for w in found], np.int32)[part] if found else np.zeros(0, np.int32))
        sizes.append(np.diff(bounds))
    number, of = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    rows = features(list(words)).astype(np.int32)
    del words, parts
    f = lambda *shape: random.normal(0, 0.3, shape).astype(np.float32)
    model = Model(f(ROWS, WIDTH) * np.float32(0.3), {w: f(w, WIDTH, FILTERS) for w in WIDTHS}, np.zeros(FILTERS * len(WIDTHS), np.float32), f(FILTERS * len(WIDTHS)), 0.0)
    for_check = np.arange(len(texts)) % 5 == 4
    learn = np.flatnonzero(~for_check)
    params = {"table": model.table, "bias": model.bias, "out": model.out, **{w: model.filters[w] for w in WIDTHS}}
    squares = {k: np.zeros_like(v) for k, v in params.items()}

    def step(key, grad, at=None):
        """Adagrad, on some rows or on all."""
        if at is None:
            squares[key] += grad**2
            params[key] -= RATE * 2 * grad / (np.sqrt(squares[key]) + 1e-6)
        else:
            squares[key][at] += grad**2
            params[key][at] -= RATE * 4 * grad / (np.sqrt(squares[key][at]) + 1e-6)

    for _ in range(EPOCHS):
        random.shuffle(learn)
        for batch in (learn[i : i + BATCH] for i in range(0, len(learn), BATCH)):
            sizes = of[batch + 1] - of[batch]
            own = np.concatenate([number[of[d] : of[d + 1]] for d in batch])
            used, own = np.unique(own, return_inverse=True)
            own, bounds = placed(own, np.concatenate([[0], np.cumsum(sizes)]), len(used))
            words_now = model.embeddings(rows[used])
            pooled, every = model.answers(words_now, own, bounds)
            error = 1 / (1 + np.exp(-(pooled @ model.out + model.out_bias))) - labels[batch]
            back = error[:, None] * model.out * (pooled > 0) / len(batch)
            grad_words = np.zeros_like(words_now)
            grads = {}
            for j, w in enumerate(WIDTHS):
                answers, mine = every[:, j * FILTERS : (j + 1) * FILTERS], back[:, j * FILTERS : (j + 1) * FILTERS]
                best = np.stack([bounds[k] + answers[bounds[k] : bounds[k + 1]].argmax(axis=0) for k in range(len(batch))])
                grads[w] = np.zeros_like(model.filters[w])
                for k in range(w):
                    place = np.where(best + k < bounds[1:, None], own[np.minimum(best + k, len(own) - 1)], len(used))
                    grads[w][k] = np.einsum("bfe,bf->ef", words_now[place], mine)
                    np.add.at(grad_words, place, mine[:, :, None] * model.filters[w][k].T[None])
            touched = np.flatnonzero(np.abs(grad_words[:-1]).sum(axis=1))
            step("out", pooled.T @ error / len(batch))
            step("bias", back.sum(axis=0))
            model.out_bias -= RATE * float(error.mean())
            for w in WIDTHS:
                step(w, grads[w])
            if touched.size:
                flat = rows[used[touched]].ravel()
                at, where = np.unique(flat, return_inverse=True)
                grad = np.zeros((len(at), WIDTH), np.float32)
                np.add.at(grad, where, np.repeat(grad_words[touched] / 4, 4, axis=0))
                step("table", grad, at)
    check = np.flatnonzero(for_check) if for_check.any() and 0 < labels[for_check].sum() < for_check.sum() else np.arange(len(texts))
    scores = np.concatenate([model.scores(data, offsets) for data, offsets in slices([texts[i] for i in check])])
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - logit(best_threshold(scores, labels[check])))
    scores = 1 / (1 + np.exp(-(logit(scores) + model.shift)))
    names = np.array([languages[i] or "" for i in check])
    for name in set(names.tolist()) - {""}:
        own = names == name
        if own.sum() >= LEAST_ROWS and 0 < labels[check][own].sum() < own.sum():
            model.by_language[name] = float(best_threshold(scores[own], labels[check][own]))
    return model


def slices(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """UTF-8 bytes and offsets of the texts, about a megabyte at a time: what is computed for all places takes much memory."""
    held, size = [], 0
    for t in texts:
        held.append(t.encode())
        size += len(held[-1])
        if size >= most:
            yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])
            held, size = [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])


def logit(score):
    score = np.clip(score, 1e-9, 1 - 1e-9)
    return np.log(score / (1 - score))


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Midway between the two neighbouring scores where F1 is best."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + labels.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    below = s[k + 1] if k + 1 < len(s) else 0.0
    return float(1 / (1 + np.exp(-(logit(s[k]) + logit(below)) / 2)))


def held_out(id_column):
    """Is the row in the part whose labels are never learned?"""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(PARTS)) == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, lang_column: str) -> list[tuple[str, int, str]]:
    """Text, label and language of the bounded sample."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column)).groupBy(F.col(id_column).alias("_id")).agg((F.max("toxic") > 0).alias("_toxic"))
    order = F.xxhash64("_id", F.lit(11))
    picked = known.filter("_toxic").orderBy(order, "_id").limit(MOST_TOXIC).unionByName(known.filter("not _toxic").orderBy(order, "_id").limit(MOST_CLEAN))
    lang = F.col(lang_column) if lang_column in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_column).alias("_id"), whole_text(text_column).alias("_text"), lang.cast("string").alias("_lang"))
    rows = texts.join(F.broadcast(picked), "_id").groupBy("_id").agg(F.min(F.struct("_text", F.col("_toxic").cast("int").alias("_toxic"), "_lang")).alias("x")).select("_id", "x.*")  # at most MOST_TOXIC + MOST_CLEAN rows
    found = {r[0]: r[1:] for r in rows.toLocalIterator()}
    return [found[k] for k in sorted(found, key=lambda k: (zlib.crc32(str(k).encode()), k))]


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model | None:
    rows = training_rows(docs, labels, id_column, text_column, lang_column)
    return train([r[0] for r in rows], np.array([r[1] for r in rows], np.float64), [r[2] for r in rows])


def score(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text", 2 << 20):
                got = model.scores(data, offsets) if model else np.zeros(len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(got)], names=["id", "score"])

    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_column)


def threshold(model: Model | None, lang):
    """The threshold of a row's language, or the overall one."""
    out = F.lit(THRESHOLD)
    for name, value in sorted(model.by_language.items() if model else []):
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out


def accepted(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The documents, all columns, whose score is below their language's threshold."""
    model = fit(docs, labels, id_column, text_column, lang_column)
    name = fresh(docs, "_score")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, text_column, 2 << 20):
                got = model.scores(data, offsets) if model else np.zeros(len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got)], names=[*part.schema.names, name])

    lang = F.col(lang_column) if lang_column in docs.columns else F.lit(None)
    return docs.mapInArrow(run, schema).filter(F.col(name) < threshold(model, lang)).drop(name)
