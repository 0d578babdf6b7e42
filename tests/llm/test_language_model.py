"""The language model: counts and base scores against plain loops, the model as a distribution, its gradient, and what it learns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from deskmatch.llm import language_model as lm

LONG = ["averyverylongwordindeed", "averyverylongwordindeex", "exactlyfifteen1", "sixteencharacter"]


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def plain(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens and base_score by the contract."""
    count = collections.Counter(w for d, t in rows if not held(d) for w in [*words_of(t), None])
    n, v, out = sum(count.values()), len(count), []
    for d, t in rows:
        own = [*words_of(t), None]
        out.append((d, held(d), len(own), sum(count[w] > 0 for w in own), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)))
    return out


def arrays(texts):
    data = [t.encode() for t in texts]
    return lm.tokens(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


def same(got, rows):
    got = sorted(([r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score] for r in got), key=lambda r: (repr(r[0]), r[2], r[5]))
    want = sorted((list(r) for r in plain(rows)), key=lambda r: (repr(r[0]), r[2], r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert max((abs(a[5] - b[5]) for a, b in zip(got, want)), default=0) < 1e-6


def test_tokens_of_any_text():
    texts = ["", "one", " Two\twoRds\x0b ", "\n", "É é ÀB", *LONG, " ".join(LONG), "", "a"]
    low, high, bounds = arrays(texts)
    pairs, seen = list(zip(low.tolist(), high.tolist())), {}
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        own = [*words_of(t), None]
        assert len(own) == b - a
        for w, p in zip(own, pairs[a:b]):
            assert seen.setdefault(w, p) == p
    assert len(set(seen.values())) == len(seen)


def test_edge_cases(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("abcdefg") * rnd.randrange(1, 20) for _ in range(rnd.randrange(30)))) for i in range(50)]
    rows += [(None, "Null id HERE"), (7, rows[7][1]), (7, "other"), (60, None), (61, ""), (61, ""), (62, " ".join(LONG) * 50), (63, "x" * 5000)]
    df = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, n_tokens int, learned string")
    got = lm.scores(df)
    assert [t for _, t in got.dtypes] == ["bigint", "boolean", "bigint", "bigint", "bigint", "double", "double"]
    same(got.collect(), rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got.collect())
    assert lm.scores(df.filter("false")).count() == 0
    unseen = [(d, t) for d, t in rows if held(d)]
    assert unseen
    got = lm.scores(df.filter(df.doc_id.isin([d for d, _ in unseen]))).collect()
    same(got, unseen)
    assert all(math.isfinite(r.score) for r in got)


def test_whole_table_and_what_is_learned(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lm.scores(docs).collect()
    same(got, rows)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def trained_model():
    texts = ["the red fox ran to the blue house . " * 20 + "rare1 rare2 rare3", "a cow and a dog and a cat " * 30] * 5
    low, high, bounds = arrays(texts)
    number, l, h = lm.numbered(low, high)
    count = np.bincount(number)
    most = (lm.CLASSES - 1) * lm.PER_CLASS
    top = np.lexsort([h, l, -count])[:12]  # some words stay in the last class
    share = np.zeros(most)
    share[:12] = count[top]
    by_class = share.reshape(lm.CLASSES - 1, lm.PER_CLASS)
    rest = int(count.sum() - share.sum())
    whole = np.append(by_class.sum(axis=1), rest) + 0.5
    zeros = [np.zeros((r, c), np.float32) for r, c in ((lm.CLASS_ROWS, lm.CLASSES), (lm.WORD_ROWS, lm.PER_CLASS))]
    word_bias = np.log((by_class + 0.01) / (by_class + 0.01).sum(axis=1, keepdims=True)).astype(np.float32)
    model = lm.Model(l[top], h[top], np.log(whole / whole.sum()).astype(np.float32), word_bias, *zeros, int(count.sum()), len(count), rest, len(count) - 12)
    return model, (low, high, bounds)


def test_probabilities_after_a_context_add_up_to_one():
    model, tokens = trained_model()
    learner = lm.Learner(model, 1)
    for _ in range(3):
        learner.learn(*tokens)
    names = sorted({w for t in ["the red fox ran to blue house .", "a cow and dog cat"] for w in t.split()} | {"rare1", "rare2", "rare3", "never"})
    low, high, bounds = arrays([f"the red {w}" for w in names])
    logs, rest = lm.score_tokens(model, low, high, bounds)
    at = bounds[:-1] + 2
    last = np.exp(logs[at][rest[at]])
    near = np.exp(logs[at][~rest[at]])
    end = np.exp(lm.score_tokens(model, *arrays(["the red"]))[0][-1])
    assert len(set(np.round(last, 9))) == 1  # the last class, whose words share it by their counts
    assert abs(near.sum() + last[0] + end - 1) < 0.02  # but for empty places of classes
    assert near.max() == near[[w for w, r in zip(names, rest[at]) if not r].index("fox")] > 0.8


def test_step_has_the_mean_of_the_gradient():
    rnd = np.random.default_rng(0)
    logits = rnd.normal(0, 1, (1, 8)).astype(np.float32)
    p, target = lm.softmax(np.repeat(logits, 40000, axis=0)), np.full(40000, 3)
    assert np.allclose(p[0], np.exp(logits) / np.exp(logits).sum()) and np.allclose(lm.log_softmax(logits.copy(), np.array([3])), np.log(p[0, 3]))
    weights, squares = np.zeros((1, 8), np.float32), np.full((1, 8), 1e12, np.float32)  # steps of equal size
    want = -p[0].copy()
    lm.descend(weights, squares, np.zeros((1, 40000), np.int64), p, target, rnd)
    want[3] += 1
    got = weights[0] * 1e6 / lm.RATE / 40000
    assert np.abs(got - want).max() < 0.02


def test_moves_are_weighted_by_touches(spark):
    rows = [(i, "the cat sat on the mat " * 30, True) for i in range(40)]
    df = spark.createDataFrame([(str(d), t, x) for d, t, x in rows], "id string, text string, learned boolean").repartition(3)
    found = lm.counted(df, 8).cache()
    model = lm.trained(df, lm.first_model(found))
    assert model.n_tokens == 40 * 181 and model.n_distinct == 6
    logs, _ = lm.score_tokens(model, *arrays(["the cat sat on the mat the cat sat"]))
    assert np.exp(logs[2:9]).min() > 0.4


def test_changed_input_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    monkeypatch.setattr(lm, "trained", lambda rows, model: model)
    real = lm.cut
    monkeypatch.setattr(lm, "cut", lambda d, name: real(d, name).filter("block is null"))
    with pytest.raises(Exception, match="words have changed"):
        lm.scores(df).collect()
