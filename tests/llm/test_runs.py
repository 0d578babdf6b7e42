"""Periodic runs against a search of all periods at all places."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from deskmatch.llm import runs
from deskmatch.llm.queries import table


def all_runs(words):
    """Every maximal stretch by trying all periods, smallest first."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(s <= i and j + q <= s + m for s, m, _ in found):
                found.append((i, j + q - i, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def of_texts(texts):
    data = [t.encode() for t in texts]
    rows, counts, out = runs.collapsed_chunk(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert counts.tolist() == np.bincount(rows[:, 0], minlength=len(texts)).tolist()
    return [[tuple(r[1:].tolist()) for r in rows if r[0] == k] for k in range(len(texts))], [t.decode() for t in out]


def same_as_brute(texts):
    found, out = of_texts(texts)
    for text, own, kept in zip(texts, found, out):
        words = text.encode().split()
        words = [w.decode() for w in words]
        want = all_runs(words)
        assert own == want, (words, own, want)
        assert kept == collapsed(words, want)


def test_runs_of_many_shapes():
    rnd = random.Random(5)
    texts = ["", "a", "a a a a a", "a a a a a a", "a b " * 3, "a b " * 4]
    for _ in range(400):
        words = []
        for _ in range(rnd.randrange(1, 5)):
            alphabet = [f"w{i}" for i in range(rnd.choice([1, 2, 3, 50]))]
            unit = [rnd.choice(alphabet) for _ in range(rnd.choice([1, 2, 3, 5, 8, 9, 13, 16, 17, 24, 31, 33, 40, 64, 65]))]
            if rnd.random() < 0.3:
                unit = unit * rnd.randrange(2, 6) + [rnd.choice(alphabet) for _ in range(rnd.randrange(4))]
            k = rnd.choice([1, 2, 3, 3.6, 4, 4, 4.1, 5, 7, 12])
            words += (unit * 13)[: int(len(unit) * k)] + [f"x{rnd.random()}" for _ in range(rnd.choice([0, 0, 1, 3]))]
        texts.append(" ".join(words))
    for k in range(0, len(texts), 40):
        same_as_brute(texts[k : k + 40])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=40), st.integers(1, 7)), max_size=4), min_size=1, max_size=4))
def test_runs_of_any_repeated_units(shape):
    same_as_brute([" ".join(c for unit, k in parts for c in unit * k) for parts in shape])


def test_long_periods_and_long_texts():
    rnd = random.Random(1)
    unit = [f"w{rnd.randrange(10**6)}" for _ in range(5000)]
    words = ["start", *unit * 5, "end"]
    found, _ = of_texts([" ".join(words), " ".join(unit), "b " * 20000 + "c"])
    assert found == [[(1, 25000, 5000)], [], [(0, 20000, 1)]]


def test_table_of_edge_cases(spark):
    rows = [(1, None, 1), (None, "a b " * 5, 2), (2, "", 3), (2, " \t\n", 3), (3, "é ü\x0b" * 6 + "漢", 4), (3, "é ü\x0b" * 6 + "漢", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumnRenamed("runs", "collapsed")
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.collapse_runs(docs).collect()), key=repr)
    want = [(1, [], ""), (None, [(0, 10, 2)], "a b"), (2, [], ""), (2, [], ""), (3, [(0, 12, 2)], "é ü 漢"), (3, [(0, 12, 2)], "é ü 漢")]
    assert got == sorted(want, key=repr)
    assert runs.collapse_runs(docs.filter("false")).count() == 0


def test_planted_words(spark, small):
    import zlib

    docs = table(spark, small, "documents")
    before = {r.doc_id: (r.text or "").encode().split() for r in docs.collect()}
    n = 0
    for r in runs.with_planted_runs(docs).collect():
        words, h = before[r.doc_id], zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
            n += 1
        assert (r.text or "").encode().split() == words
    assert n > 5
