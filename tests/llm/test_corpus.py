"""Corpus operators against libraries and brute force, on given tables and on edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deskmatch.llm import bpe, decontaminate, near_copies, quality_rules, records, secrets, sharding, simhash, suffix_dedup, token_counts, toxicity, words
from deskmatch.llm import queries as registered
from deskmatch.llm.components import components
from deskmatch.llm.queries import tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
#: Nulls, empty and long texts, repeated rows, ties, special strings, and columns whose names operators use inside.
EDGE = [
    (1, "It's the\n\n  we'LL x's <|endoftext|> end", "a"),
    (2, None, "a"),
    (3, "", None),
    (3, "", None),
    (4, "İstanbul ΣΑΣ é <|ENDOFTEXT|> a<|startoftext|>b  c　d\x1ce ", "b"),
    (None, "same words here are five six seven", "b"),
    (5, "same words here are five six seven", "b"),
    (6, "x" * 3000 + " " * 50 + "漢字" * 400, "b"),
    (7, "word " * 5000, "c"),
    (8, "password = 'abcdefgh1' token: short AKIA" + "A1" * 8 + " " + "0f" * 20, "c"),
]


@pytest.fixture(scope="session")
def edge(spark):
    rows = spark.createDataFrame(EDGE, "doc_id long, text string, source string")
    return rows.withColumns({c: F.lit(c) for c in ("id", "fp", "size", "shard", "slot", "_score", "_gone", "_id", "findings", "blob", "host", "_h", "key", "Bucket")}).withColumn("lang", F.lit("en"))


@pytest.fixture(scope="session")
def none(edge):
    return edge.filter("false")


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def sorted_rows(rows):
    return sorted(rows, key=repr)


@given(st.lists(st.text(st.sampled_from("' \n\tstmdrevlaé12!漢ß😀,　\x85"), max_size=20), max_size=4))
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_the_patterns(parts):
    import regex

    data = np.frombuffer("".join(parts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(p.encode()) for p in parts)])
    byte = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    for rule, pattern in (("byte", byte), ("word", word)):
        begins, ends, of = words.split(data, offsets, rule)
        for k, p in enumerate(parts):
            assert [data.tobytes()[a:b].decode() for a, b in zip(begins[of[k] : of[k + 1]], ends[of[k] : of[k + 1]])] == pattern.findall(p)


def library_ids(path, pairs):
    t = bpe.tokenizer(path)
    return [(d, e.ids) for (d, _), e in zip(pairs, t.encode_batch([x for _, x in pairs], add_special_tokens=False))]


@pytest.mark.parametrize("which", ["docs", "edge", "none"])
def test_token_counts(which, request):
    df = request.getfixturevalue(which)
    want = [(d, len(x.encode()), len(ids)) for (d, x), (_, ids) in zip(texts(df), library_ids(BYTE, texts(df)))]
    got = token_counts.within_limit(token_counts.write_prefix_counts(df, BYTE), 100).collect()
    assert sorted_rows([(r.id, r.n_bytes, r.n_tokens) for r in got]) == sorted_rows(want)
    t = bpe.tokenizer(BYTE)
    by = {d: x for d, x in texts(df)}
    for r in got:
        if r.n_tokens > 100 and r.id is not None:
            raw = by[r.id].encode()
            assert len(t.encode(raw[: r.bytes_within_limit].decode(), add_special_tokens=False).ids) <= 100
            assert len(t.encode(raw[: r.bytes_within_limit + 4].decode("utf-8", "ignore"), add_special_tokens=False).ids) > 100 or len(raw) <= r.bytes_within_limit + 4
        else:
            assert r.bytes_within_limit == r.n_bytes


@given(st.lists(st.lists(st.sampled_from(["'", "re", "ll", "s", " ", "\n", "\t", "the", "hello", "12", "!", "漢", "é", "\u3000", "\x85", "<|endoftext|>", "<|endo", "x're"]), max_size=12).map("".join), max_size=3))
@settings(max_examples=150, deadline=None)
def test_every_prefix_counts_as_the_library_counts_it(parts):
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(p.encode()) for p in parts)])
    total, every = token_counts.counts_of_chunk(data, offsets, token_counts.prefix_counts(BYTE))
    for k, p in enumerate(parts):
        want = [len(e.ids) for e in bpe.tokenizer(BYTE).encode_batch([p[:i] for i in range(len(p) + 1)], add_special_tokens=False)]
        assert total[k] == want[-1]
        assert [int(every[offsets[k] + len(p[:i].encode()) - 1]) for i in range(1, len(p) + 1)] == want[1:]


def test_words_that_share_a_hash_stay_apart():
    low = int.from_bytes(b"abcdefgh", "little")
    factor, other, whole = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 1 << 64
    mixed = lambda w: (int.from_bytes(w[:8], "little") * factor % whole) ^ ((int.from_bytes(w[8:], "little") | len(w) << 56) * other % whole)
    first = b"abcdefghijkl"
    second = next(w for w in ((((mixed(first) ^ (high | 12 << 56) * other % whole) * pow(factor, -1, whole) % whole).to_bytes(8, "little") + high.to_bytes(4, "little")) for high in range(1, 100)))
    assert mixed(first) == mixed(second) and first != second and low
    data = np.frombuffer(first + second + first, np.uint8)
    number, found = words.distinct(data, np.array([0, 12, 24]), np.array([12, 24, 36]))
    assert [found[n] for n in number] == [first, second, first]


def test_prefix_counts_of_words_are_those_of_the_library():
    v, t, random_ = token_counts.vocabulary(BYTE), bpe.tokenizer(BYTE), random.Random(5)
    for _ in range(300):
        w = "".join(random_.choice("etaoinshrdluéñßZQ") for _ in range(random_.randint(1, 14))).encode()
        counts, _ = v.prefixes(b" " + w)
        for i in range(1, len(w) + 2):
            try:
                cut = (b" " + w)[:i].decode()
            except UnicodeDecodeError:
                continue
            assert counts[i] == len(t.encode(cut, add_special_tokens=False).ids)


def test_stored_prefixes_answer_questions(docs):
    table = token_counts.write_prefix_counts(docs.limit(20), BYTE)
    t, by = bpe.tokenizer(BYTE), dict(texts(docs))
    for r in table.select("id", "steps", token_counts.count_at(F.col("steps"), F.lit(9)).alias("at9"), token_counts.count_at(F.col("steps"), F.lit(0)).alias("at0"), token_counts.count_at(F.col("steps"), F.lit(10**6)).alias("all")).collect():
        text = by[r.id]
        assert r.at9 == len(t.encode(text.encode()[:9].decode("utf-8", "ignore"), add_special_tokens=False).ids) and r.at0 == 0
        assert r["all"] == len(t.encode(text, add_special_tokens=False).ids)
        assert len(t.encode(text.encode()[: token_counts.longest_within(r.steps, 5)].decode(), add_special_tokens=False).ids) <= 5


@pytest.mark.parametrize("which", ["docs", "edge", "none"])
def test_bpe_round_trip(which, request):
    df = request.getfixturevalue(which)
    t = bpe.tokenizer(WORD)
    want = [(d, np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)) for d, ids in library_ids(WORD, texts(df))]
    got = [(r.doc_id, bytes(r.ids), r.decoded) for r in bpe.encode_decode(df, WORD).collect()]
    assert sorted_rows(got) == sorted_rows(want)


def test_blocks_of_equal_words_have_keys_of_their_own(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 10)
    batch = pa.record_batch([pa.array([None, 1, 1], pa.int64()), pa.array(["the same words"] * 3)], names=["id", "text"])
    found = list(bpe.blocks(iter([batch] * 3), WORD))
    assert len(found) > 1 and len({key for key, *_ in found}) == len(found)
    assert {key for key, *_ in found}.isdisjoint(key for key, *_ in bpe.blocks(iter([batch] * 3), WORD, 1))


def base_spans(text):
    found = []
    for n, (kind, pattern, group, least) in enumerate((("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))):
        found += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found)


@pytest.mark.parametrize("which", ["docs", "edge", "none"])
def test_secrets(which, request):
    df = request.getfixturevalue(which)
    want = [(d, [(a, b, k) for a, _, b, k in base_spans(x)]) for d, x in texts(df)]
    got = [(r.doc_id, [(f.at, f.until, f.kind) for f in r.findings if f.kind in ("assign", "access", "hex")]) for r in secrets.scan_secrets(df).collect()]
    assert sorted_rows(got) == sorted_rows(want)


def test_ledger_scans_unseen_blobs_only(spark, docs, tmp_path):
    at = f"file://{tmp_path}/ledger"
    secrets.scan_secrets(docs.filter("doc_id % 2 = 0"), at).count()
    first = spark.read.parquet(at).count()
    secrets.scan_secrets(docs, at).count()
    rows = spark.read.parquet(at)
    assert rows.count() == rows.select("blob").distinct().count() == docs.select("text").distinct().count() > first
    secrets.scan_secrets(docs, at, rules=secrets.BASE_RULES).count()
    assert spark.read.parquet(at).count() == 2 * docs.select("text").distinct().count()


def test_redaction_keeps_rows_and_columns(edge):
    out = secrets.redact(edge.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    assert out.columns == edge.columns
    text = out.filter("doc_id = 8").first().text
    assert "[secret]" in text and "abcdefgh1" not in text and not base_spans(text)


def with_secrets(spark, edge):
    rows = [(None, "token: abcdefgh2 a"), (None, "password = 'abcdefgh1'"), *[(50, "x token: abcdefgh3 y")] * 3, (50, "password = 'abcdefgh4' and other words")]
    return edge.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)


def test_redaction_of_null_and_repeated_ids(spark, edge):
    def masked(text):
        out, reach = "", 0
        for a, _, b, _ in base_spans(text):
            out, reach = (out + text[reach:a] + "[secret]", b) if a >= reach else (out, max(reach, b))
        return out + text[reach:]

    df = with_secrets(spark, edge)
    want = [(r.doc_id, r.text and masked(r.text)) for r in df.collect()]
    assert sorted_rows([(r.doc_id, r.text) for r in secrets.redact(df).collect()]) == sorted_rows(want)


def test_decontamination_of_null_and_repeated_ids(spark, edge):
    item = "the quick brown fox jumps over the lazy dog while seven wizards watch from a hill"
    rows = [(None, f"a {item}"), (None, "kept"), *[(60, f"b {item} c")] * 2, (60, "kept too")]
    df = edge.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    kept = decontaminate.clean(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    want = [(r.doc_id, r.text) for r in df.collect() if item not in (r.text or "")]
    assert sorted_rows([(r.doc_id, r.text) for r in kept.collect()]) == sorted_rows(want) and len(want) == df.count() - 3


@pytest.mark.parametrize("which", ["docs", "edge", "none"])
def test_records_are_read_back_in_order(spark, which, request):
    df = request.getfixturevalue(which)
    got = records.read_records(spark, records.write_records(df, BYTE), texts=True).orderBy("start").collect()
    want = sorted(((d, [*ids, 0]) for d, ids in library_ids(BYTE, texts(df))), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    start = 0
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert r.start == start and r.n_ids == len(ids) and r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
        start += len(ids)
    assert sorted_rows([(r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got]) == sorted_rows(want)


def test_broken_records_are_found():
    good = records.frame(3, np.arange(5), 2)
    assert records.unframe(memoryview(good), 0)[1:2] == (3,)
    for at in (1, 9, 14, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(memoryview(bytes(bad)), 0)


@pytest.mark.parametrize("which", ["docs", "edge", "none"])
def test_shards(which, request):
    df = request.getfixturevalue(which)
    rows = sharding.shard(df, 4).collect()
    assert sorted_rows([(r.doc_id, r.text, r["size"]) for r in rows]) == sorted_rows([(d, t, len((t or "").encode()) + 1) for d, t in ((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())])
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for group in by.values():
        assert sorted(r.slot for r in group) == list(range(len(group)))
    if which == "docs":
        sizes, most = [sum(r["size"] for r in g) for g in by.values()], max(r["size"] for r in rows)
        assert len(by) == 4 and max(sizes) - min(sizes) <= 2 * most


def test_hot_text_is_spread_over_shards(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    counts = {r.shard: r["n"] for r in sharding.shard(df, 8).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert max(counts.values()) - min(counts.values()) <= 30


def brute_repeats(pairs):
    seen = {}
    for _, t in pairs:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    out = []
    for d, t in pairs:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        out.append((d, len(t), int(gone.sum()), int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize(("group", "square", "held"), [(50_000, 400, 200_000), (50_000, 1, 3), (4, 400, 200_000)])
def test_repeated_strings(spark, edge, monkeypatch, group, square, held):
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3000 if held == 3 else 2 << 20)
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "SQUARE", square)
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice("the quick brown fox jumps over a lazy dog and cat".split()) for _ in range(n))
    base = text(300)
    more = [(20, "a" * 500), (21, "ab" * 150), (22, "é" * 150), (23, base), (24, base[:700] + "X" + base[701:]), (25, base[300:499] + "Q"), (26, "Z" + base[300:500] + "Y"), (27, base[100:400] + base[150:450]), *((30 + i, text(10) + base[200:500] + text(30)) for i in range(12))]
    df = edge.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()]
    assert sorted_rows(got) == sorted_rows(brute_repeats([(d, t.encode()) for d, t in texts(df)]))


def test_repeats_of_an_empty_table(none):
    assert suffix_dedup.remove_repeats(none).collect() == []


@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=25))
@settings(max_examples=150, deadline=None)
def test_deep_shallow_sort(strings):
    order, common = suffix_dedup.deep_shallow(strings)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
    for k in range(1, len(order)):
        assert common[k] == suffix_dedup.common_length(strings[order[k - 1]], strings[order[k]], 0)


@given(st.text("abc", min_size=1, max_size=10), st.text("abc", max_size=25))
@settings(max_examples=200, deadline=None)
def test_myers_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    assert decontaminate.best_end(pattern, text) == (min(row), row.index(min(row)))


def test_decontamination(spark, edge, none):
    item = "the quick brown fox jumps over the lazy dog while seven wizards watch from a hill"
    spoiled = item.replace("quick", "quikc").replace("hill", "hall")
    rows = [(100, f"before {item.upper()}!! after"), (101, f"x {spoiled} y"), (102, "the quick brown fox alone"), (103, None), (104, item[:40])]
    df = edge.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    items = spark.createDataFrame([(1, item), (2, None), (3, "!!"), (4, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(df, items).collect()}
    assert got == {(100, 1): 0, (100, 4): 0, (101, 1): 3, (101, 4): 3}
    blocks = decontaminate.contaminated(df, items, block_chars=10)
    assert {(r.doc_id, r.item_id): r.distance for r in blocks.collect()} == got
    kept = decontaminate.clean(df, items)
    assert kept.columns == df.columns and kept.count() == df.count() - 2
    assert decontaminate.contaminated(none, items).count() == 0 == decontaminate.contaminated(df, items.filter("false")).count()


def brute_fingerprint(text, n):
    found = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(found[i : i + n]) for i in range(len(found) - n + 1)] if len(found) >= n else [" ".join(found)] * bool(found)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, radius):
    label = {d: d for d in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for c in nodes:
                if (nodes[a] ^ nodes[c]).bit_count() <= radius and label[c] < label[a]:
                    label[a], changed = label[c], True
    return label


@pytest.mark.parametrize("which", ["docs", "edge", "none"])
def test_simhash_components(which, request):
    df = request.getfixturevalue(which)
    got = simhash.near_duplicates(df, 4, 4).collect()
    want = [(d, brute_fingerprint(t, 4)) for d, t in texts(df)]
    assert sorted_rows([(r.doc_id, r.fp & 2**64 - 1) for r in got]) == sorted_rows(want)
    label = brute_components({d: f for d, f in want if d is not None}, 4)
    for r in got:
        assert r.component_id == label.get(r.doc_id)


def brute_shingles(text, n=5):
    found = (text or "").lower().split()
    return frozenset(" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))) if found else frozenset()


def test_near_copies_are_those_of_the_similarity(spark, edge):
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = [(1000, " ".join(base))]
    for i in range(1, 60):  # from one changed word to ten: similarities of 0.92 down to 0.4
        copy = list(base)
        for at in rnd.sample(range(120), 1 + i % 10):
            copy[at] = f"x{i}"
        rows.append((1000 + i, " ".join(copy)))
    df = edge.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = {(r.doc_id, r.text): brute_shingles(r.text) for r in df.collect() if r.doc_id is not None}
    label = {d: d[0] for d in sets}
    changed = True
    alike = [(a, b) for a in sets for b in sets if a != b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    while changed:
        changed = False
        for a, b in alike:
            if label[b] < label[a]:
                label[a], changed = label[b], True
    got = near_copies.one_of_each(df)
    want = [(r.doc_id, r.text) for r in df.collect() if r.doc_id is None or label[r.doc_id, r.text] == r.doc_id]
    assert got.columns == df.columns and sorted_rows([(r.doc_id, r.text) for r in got.collect()]) == sorted_rows(want)
    assert len(df.collect()) > len(want) + 10 and len(alike) > 20


@pytest.mark.parametrize(("held", "small", "block"), [(3, 2, 2_000), (20_000, 2, 4)])
def test_large_buckets_of_near_copies(spark, edge, monkeypatch, held, small, block):
    monkeypatch.setattr(near_copies, "HELD", held)
    monkeypatch.setattr(near_copies, "SMALL", small)
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", block)
    test_near_copies_are_those_of_the_similarity(spark, edge)


def test_large_buckets_pass_whole_before_the_first_meeting(spark, edge, monkeypatch):
    monkeypatch.setattr(near_copies, "ONCE_ROWS", 3)
    test_near_copies_are_those_of_the_similarity(spark, edge)


def joined_rows(df):
    """Rows that each join of the plan made; df was collected before."""
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if "Join" in name and node.metrics().contains("numOutputRows"):
            out.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return out


def test_joins_of_near_copies_make_few_rows_a_node(spark, monkeypatch):
    rnd = random.Random(5)
    base, rows = [f"w{rnd.randrange(10**6)}" for _ in range(120)], []
    for i in range(200):  # one large group of near copies, which share most of their buckets
        rows.append((i, " ".join([*base, f"x{i}"])))
    made, cut = [], near_copies.cut

    def watched(df, name):
        df.collect()
        made.extend((name, n) for n in joined_rows(df))
        return cut(df, name)

    monkeypatch.setattr(near_copies, "cut", watched)
    assert [r.doc_id for r in near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]
    assert len(made) > 3 and max(n for _, n in made) <= near_copies.MEMBERS * len(rows), made


def test_a_pair_of_near_copies_counts_in_one_bucket_alone(spark, monkeypatch):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join([*base, f"x{i}"]) for i in range(100)]
    for i in range(20):  # close by their fingerprints and below the similarity
        other = list(base)
        for at in (5, 25, 45):
            other[at] = f"y{i}"
        texts.append(" ".join(other))
    grouped, semi = near_copies.of_several_groups, []

    def watched(*given):
        semi.append(grouped(*given).count())
        return grouped(*given)

    monkeypatch.setattr(near_copies, "of_several_groups", watched)
    got = near_copies.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    label = brute_near_copies([brute_shingles(t) for t in texts])
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(label)) and 0 < semi[0] < 30 * len(texts), semi


def close_strangers():
    """A group of near copies, and texts close to it by their fingerprints that are below the similarity."""
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join([*base, f"x{i}"]) for i in range(100)]
    for i in range(20):
        other = list(base)
        for at in (5, 25, 45):
            other[at] = f"y{i}"
        texts.append(" ".join(other))
    return texts


def test_a_cluster_of_near_copies_is_dealt_out_once(spark, monkeypatch):
    texts, made, with_partner = close_strangers(), [], near_copies.with_partner

    def watched(*given, **more):
        made.append(with_partner(*given, **more).count())
        return with_partner(*given, **more)

    monkeypatch.setattr(near_copies, "with_partner", watched)
    got = near_copies.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(brute_near_copies([brute_shingles(t) for t in texts])))
    assert sum(made) < 25 * len(texts), made


@pytest.mark.parametrize(("dear", "rows"), [(0, 400), (2, 4)])
def test_clusters_meet_in_their_buckets_or_in_many_blocks(spark, monkeypatch, dear, rows):
    monkeypatch.setattr(near_copies, "DEAR", dear)
    monkeypatch.setattr(near_copies, "CLUSTER_ROWS", rows)
    texts = close_strangers()
    got = near_copies.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(brute_near_copies([brute_shingles(t) for t in texts])))


def brute_near_copies(sets):
    """The smallest place of each set's group."""
    label = list(range(len(sets)))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if 5 * len(x & y) >= 4 * len(x | y) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if g == old else g for g in label]
    return label


def test_the_largest_group_of_a_bucket_is_dealt_to_the_others_alone(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", 20)
    rows = [(1, k, 0 if k < 400 else k, 5, [0]) for k in range(403)] + [(2, k, k % 7, 5, [0]) for k in range(90)]
    live = spark.createDataFrame(rows, "part long, key long, group long, n int, fp array<long>")
    parts = {}
    for r in near_copies.dealt(live).collect():
        parts.setdefault(r.part, []).append((r.key, r.group))
    first = [p for p in parts.values() if any(k >= 400 for k, _ in p)]
    assert sum(map(len, first)) <= 403 + 3 * 41
    met = {frozenset((a, b)) for p in parts.values() for a, g in p for b, h in p if g != h}
    want = {frozenset((a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2]}
    assert want <= met


def test_near_copies_of_an_empty_table(none):
    assert near_copies.one_of_each(none).collect() == []


def test_masks_cover_the_radius():
    rnd = random.Random(1)
    for radius, bits in ((4, 64), (1, 30)):
        found = simhash.masks(radius, bits)
        for _ in range(500):
            diff = sum(1 << b for b in rnd.sample(range(bits), rnd.randint(1, radius)))
            assert any(diff & m == 0 for m in found)


def test_wide_fingerprints_are_majorities_and_meet_at_the_similarity():
    rnd = np.random.default_rng(3)
    met = {0.8: 0, 0.9: 0}
    for similarity in met:
        for _ in range(150):
            n = int(rnd.integers(30, 600))
            common = round(2 * n * similarity / (1 + similarity))
            own = rnd.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            both = near_copies.fingerprints(np.concatenate([own[:n], own[n - common :]]), np.array([0, n, 2 * n]))
            keys = near_copies.table_keys(both)
            met[similarity] += bool((keys[0] == keys[1]).any())
    assert met[0.8] >= 144 and met[0.9] == 150
    hashes = rnd.integers(0, 1 << 63, 700, dtype=np.uint64)
    for bounds in ([0, 1, 3, 700], [0, 400, 700]):
        for row, a, b in zip(simhash.majority(hashes, np.array(bounds)), bounds, bounds[1:]):
            assert [2 * sum(int(h) >> j & 1 for h in hashes[a:b]) > b - a for j in range(64)] == row.tolist()


def test_large_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rnd = random.Random(2)
    fps = {i: rnd.getrandbits(12) for i in range(60)}
    rows = spark.createDataFrame([(5, fp, i) for i, fp in fps.items()], "bucket long, fp long, node long")
    got = simhash.link_buckets(rows.repartition(1).sortWithinPartitions("bucket"), 1)
    big = got.filter("a is null").select("bucket", "fp", "node")
    assert big.count() == 60
    pairs = got.filter("a is not null").select("a", "b").unionByName(simhash.block_links(big, 1))
    named = {r.node: r.component for r in components(pairs).collect()}
    label = brute_components({**fps}, 1)
    assert all(named.get(i, i) == label[i] for i in fps)


def test_components(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (5, 5), (None, 1), (7, 3), (3, 2)], "a long, b long")
    assert {r.node: r.component for r in components(pairs).collect()} == {2: 1, 3: 1, 7: 1, 9: 8}
    assert components(pairs.filter("false")).count() == 0


def test_toxicity_learns_and_defines_edges(spark, edge, none):
    rnd = random.Random(4)
    plain = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rnd.choice(plain) for _ in range(30)) + (f" nasty{rnd.choice('abcd')}" if i % 4 == 0 else ""), "en", int(i % 4 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    labels = df.select("doc_id", "toxic")
    model = toxicity.fit(df, labels)
    got = toxicity.score(df, model).join(labels, "doc_id").withColumn("held", toxicity.held_out("doc_id")).filter("held").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert sum((r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in got) >= 0.97 * len(got)
    scored = toxicity.score(edge, model).collect()
    assert len(scored) == len(EDGE) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(df, labels.filter("toxic = 0")) is None
    kept = toxicity.accepted(df, labels)
    assert kept.columns == df.columns and abs(kept.count() - 450) < 15
    assert toxicity.accepted(edge, labels.filter("false")).count() == len(EDGE)


@pytest.mark.parametrize("which", ["docs", "edge", "none"])
def test_quality_measures(which, request):
    df = request.getfixturevalue(which)

    def brute(text):
        found = re.findall("[^\x20\x09-\x0d]+", text)
        grams = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
        marked = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)} if len(set(grams)) < len(grams) and len(grams) < 2000 else (set(range(len(found))) if len(set(grams)) < len(grams) else set())
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)

    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.judge(df).collect()]
    assert sorted_rows(got) == sorted_rows([(d, *brute(t)) for d, t in texts(df)])


def test_bad_hosts_are_turned_down(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i % 10 else "short", "fine") for i in range(100)] + [(100 + i, "short" if i % 10 else good, "bad") for i in range(100)] + [(300, good, None)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1] and not got[0] and not got[100] and not got[101] and got[300]


def test_each_operator_is_registered():
    assert [n.split("_")[0] for n in registered.queries()] == [f"op{i}" for i in range(1, 11)]


def test_pipeline_stages_keep_columns_and_take_effect(spark, small, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
    kept = spark.read.parquet(f"{tmp_path}/3")
    assert 0.5 * before < docs.count() == kept.count() < before
    assert kept.select("text").distinct().count() == kept.count()
    assert not any(base_spans(t) for _, t in texts(kept))
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert not any(i in decontaminate.normal(t) for _, t in texts(kept) for i in items)
    want = {d: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() for d, ids in library_ids(WORD, texts(kept))}
    assert {r.doc_id: r.ids_sha256 for r in docs.collect()} == want
