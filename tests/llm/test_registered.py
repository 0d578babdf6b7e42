"""The registered corpus queries and the pipeline over a small table of edge cases, against brute force by their contracts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from deskmatch.llm import bpe, decontaminate, records, secrets, suffix_dedup, toxicity
from deskmatch.llm import queries as registered
from deskmatch.llm.queries import tokenizer_path

RND = random.Random(11)
WORDS = [f"w{RND.randrange(10**5)}" for _ in range(400)]
LONG = " ".join(RND.choice(WORDS) for _ in range(300))
ITEM = "the quick brown fox jumps over the lazy dog while seven wizards watch from a hill"
SECRET = "password = 'abcdefgh1' token: short AKIA" + "A1" * 8 + " " + "0f" * 20
TEXTS = [
    "It's the\n\n  we'LL x's <|endoftext|> end", None, "", "", "İstanbul ΣΑΣ é <|ENDOFTEXT|> a<|startoftext|>b  c　d\x1ce ", LONG, LONG, LONG + " and one more word", "x" * 3000 + " " * 50 + "漢字" * 400, "word " * 3000,
    SECRET, f"before {ITEM} after", " ".join(RND.choice(WORDS) for _ in range(200)) + LONG[:500], "line one is here\nline one is here\n# $ % | < > nothing", *(" ".join(RND.choice(WORDS) for _ in range(40)) for _ in range(40)),
]
IDS = [None, *range(1, len(TEXTS) - 1), 7]


@pytest.fixture(scope="module", params=["edge", "none"])
def folder(spark, request, tmp_path_factory):
    """A folder of tables; an id is null, one comes twice, and columns have names that operators use inside."""
    at = tmp_path_factory.mktemp(request.param)
    rows = [(d, t, "en", f"h{i % 3}" if i % 7 else None) for i, (d, t) in enumerate(zip(IDS, TEXTS))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    docs = docs.withColumns({c: F.lit(c) for c in ("id", "fp", "size", "shard", "slot", "_score", "_gone", "_part", "findings", "blob", "host", "key", "part", "Bucket")})
    empty = request.param == "none"
    docs.filter("false" if empty else "true").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (None, None), (3, "!!")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(d, 1, int(d % 5 == 0)) for d in IDS if d], "doc_id long, quality int, toxic int").filter("false" if empty else "true").write.parquet(f"{at}/labels.parquet")
    return str(at)


def pairs(spark, folder):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def check(df, types, want):
    """The contract's columns have these types and the rows these values."""
    columns = list(types)
    assert {c: t for c, t in df.dtypes if c in types} == types
    assert rows_of(df, *columns) == sorted(want, key=repr)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def query(name, spark, folder):
    return next(f for n, f in registered.queries().items() if n.split("_")[0] == name)(spark, folder)


def ids_of(path, texts):
    return [e.ids for e in bpe.tokenizer(tokenizer_path(path)).encode_batch(texts, add_special_tokens=False)] if texts else []


def test_op1(spark, folder):
    p = pairs(spark, folder)
    n = [len(x) for x in ids_of("byte_bpe_50k.json", [t for _, t in p])]
    check(query("op1", spark, folder), {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}, [(d, len(t.encode()), k, k > 1024) for (d, t), k in zip(p, n)])


def test_op2(spark, folder):
    p, tok = pairs(spark, folder), bpe.tokenizer(tokenizer_path("word_bpe_49k.json"))
    want = [(d, len(i), sha(np.array(i, "<u4").tobytes()), sha(tok.decode(i, skip_special_tokens=False))) for (d, _), i in zip(p, ids_of("word_bpe_49k.json", [t for _, t in p]))]
    check(query("op2", spark, folder), {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, want)


def test_op3(spark, folder):
    def spans(text, rules):
        found = []
        for n, (kind, pattern, group, least) in enumerate(rules):
            found += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
        return [(k, a, b) for a, _, b, k in sorted(found)]

    base = [("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
    join = lambda found: ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    want = []
    for d, t in pairs(spark, folder):
        found = spans(t, base)
        want.append((d, *(sum(k == x for k, _, _ in found) for x in ("assign", "access", "hex")), sha(join(found)), join(spans(t, base + secrets.MORE_RULES))))
    check(query("op3", spark, folder), {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}, want)


def test_op4(spark, folder):
    p = pairs(spark, folder)
    ids = [np.array([*i, 0], "<u4") for i in ids_of("byte_bpe_50k.json", [t for _, t in p])]
    got = query("op4", spark, folder)
    assert dict(got.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    rows = sorted(got.collect(), key=lambda r: r.start)
    assert rows_of(got, "doc_id", "n_tokens", "ids_crc32") == sorted(((d, len(i), zlib.crc32(i.tobytes())) for (d, _), i in zip(p, ids)), key=repr)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows]).tolist()][: len(rows)]
    order = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert order == sorted(order)


def test_op5(spark, folder):
    got = query("op5", spark, folder)
    kinds = {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    assert dict(got.dtypes) == kinds
    check(got.select("doc_id", "size", "text_crc32", "law", "grown_shard"), {c: kinds[c] for c in ("doc_id", "size", "text_crc32", "law", "grown_shard")}, [(d, len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None) for d, t in pairs(spark, folder)])
    by = {}
    for r in got.collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_op6(spark, folder):
    p = [(d, t.encode()) for d, t in pairs(spark, folder)]
    seen = {}
    for _, t in p:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    want = []
    for d, t in p:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        want.append((d, len(t), int(gone.sum()), int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()), sha(np.frombuffer(t, np.uint8)[~gone].tobytes())))
    before = {t.name for t in spark.catalog.listTables()}
    check(query("op6", spark, folder), {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}, want)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_op7(spark, folder):
    item = decontaminate.normal(ITEM)
    want = [(d, 1) for d, t in pairs(spark, folder) if item in decontaminate.normal(t)]
    check(query("op7", spark, folder), {"doc_id": "bigint", "item_id": "bigint"}, want)


def test_op8(spark, folder):
    def fingerprint(text):
        found = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(found[i : i + 4]) for i in range(len(found) - 3)] if len(found) >= 4 else [" ".join(found)] * bool(found)
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    p = [(d, fingerprint(t)) for d, t in pairs(spark, folder)]
    of = {f: min((d for d, g in p if g == f and d is not None), default=None) for _, f in p}
    changed = True
    while changed:
        changed = False
        for f in of:
            for g in of:
                if (f ^ g).bit_count() <= 4 and None not in (of[f], of[g]) and of[g] < of[f]:
                    of[f], changed = of[g], True
    check(query("op8", spark, folder), {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}, [(d, f"{f:016x}", of[f] if d is not None else None) for d, f in p])


def test_op9(spark, folder):
    got = query("op9", spark, folder)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = got.collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((d for d, _ in pairs(spark, folder)), key=repr)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op10(spark, folder):
    def measures(text):
        found = re.findall("[^\x20\x09-\x0d]+", text)
        windows = {}
        for i in range(len(found) - 7):
            windows.setdefault(tuple(found[i : i + 8]), []).append(i)
        marked = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        n = len(found)
        return n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), n < 20 or 100 * len(marked) > 30 * n

    types = {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean"}
    got = query("op10", spark, folder)
    check(got, types, [(d, *measures(t)) for d, t in pairs(spark, folder)])
    assert dict(got.dtypes)["kept"] == "boolean" and not any(r.kept for r in got.collect() if r.base_failed)


def test_pipeline_of_edge_cases(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, at = docs.columns, f"{folder}/stages-{random.random()}"
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{at}/{k}")
        before, docs = docs, spark.read.parquet(f"{at}/{k}")
        assert k == 4 or docs.columns == columns
        if k == 1:
            texts = [r.text or "" for r in before.filter("doc_id is not null").collect()]
            kept = [r.text or "" for r in docs.filter("doc_id is not null").collect()]
            assert kept.count(LONG) == min(1, texts.count(LONG)) and docs.filter("doc_id is null").count() == before.filter("doc_id is null").count()
        if k == 2:
            assert [r.text for r in docs.collect() if r.text and ITEM in r.text] == [] and docs.count() == before.filter(~F.coalesce(F.contains("text", F.lit(ITEM)), F.lit(False))).count()
        if k == 3:
            assert docs.count() == before.count() and not [r for r in docs.collect() if r.text and "abcdefgh1" in r.text]
        if k == 4:
            assert docs.count() == before.count()


def test_records_are_picked_by_the_index_alone(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i} " * (i % 7)) for i in range(200)], "doc_id long, text string").coalesce(1)
    folder = records.write_records(df, tokenizer_path("byte_bpe_50k.json"), f"file://{tmp_path}/r", partitions=2)
    index = spark.read.parquet(f"{folder}/index")
    want = {r.doc_id: bytes(r.ids) for r in records.read_records(spark, folder, texts=True).collect()}
    shuffled = records.shuffled_records(spark, folder, 5).collect()
    assert {r.doc_id: bytes(r.ids) for r in shuffled} == want and [r.place for r in shuffled] == sorted(r.place for r in shuffled)
    assert [r.doc_id for r in shuffled] != [r.doc_id for r in records.shuffled_records(spark, folder, 6).collect()]
    first, other = index.orderBy("file", "offset").limit(2).collect()
    path = tmp_path / "r/data" / first.file
    broken = bytearray(path.read_bytes())
    broken[other.offset + 14] ^= 1  # a record that isn't asked for
    path.write_bytes(broken)
    picked = records.pick_records(index.filter(F.col("doc_id") == first.doc_id), folder).collect()
    assert [bytes(r.ids) for r in picked] == [want[first.doc_id]]
    with pytest.raises(Exception, match="wrong payload check"):
        records.pick_records(index.filter(F.col("doc_id") == other.doc_id), folder).collect()


def test_history_of_versions(spark, tmp_path):
    rows = [("a", 1, SECRET), ("a", 2, "clean"), ("a", 3, SECRET + " more"), ("b", 1, SECRET), ("b", 2, "clean"), (None, 1, SECRET), ("c", 1, None)]
    df, at = spark.createDataFrame(rows, "path string, version int, text string"), f"file://{tmp_path}/ledger"
    got = secrets.history(df, at).filter("kind = 'assign'").collect()
    assert {(r.path, r.first_version, r.last_version, r.n_versions, r.still_there) for r in got} == {("a", 1, 3, 2, True), ("b", 1, 1, 1, False), (None, 1, 1, 1, True)}
    n = spark.read.parquet(at).count()
    assert n == 4  # one row for each text, whatever paths and versions share it
    secrets.history(df.unionByName(spark.createDataFrame([("a", 4, "new text")], df.schema)), at).count()
    assert spark.read.parquet(at).count() == n + 1


def brute_least(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_decontamination_finds_what_all_positions_find(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 14, 20])))) for i in range(12)]

    def spoiled(text, edits):
        for _ in range(edits):
            at = rnd.randrange(len(text))
            text = rnd.choice([text[:at] + text[at + 1 :], text[:at] + rnd.choice("abc") + text[at:], text[:at] + rnd.choice("abc") + text[at + 1 :]])
        return text

    docs = [(i, " ".join(word() for _ in range(12)) + " " + spoiled(items[i % 12][1], i // 12) + " " + " ".join(word() for _ in range(12))) for i in range(60)]
    want = {(d, i): best for d, t in docs for i, item in items if (best := brute_least(decontaminate.edged(decontaminate.normal(item)), decontaminate.edged(decontaminate.normal(t)))) <= decontaminate.budget(decontaminate.normal(item), decontaminate.EDIT_RATE)}
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.BLOCK_CHARS, 100):
        assert {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(docs, items, block_chars=size).collect()} == want
    assert len(want) > 30 and max(want.values()) > 1


def test_scores_are_those_of_a_plain_convolution():
    rnd = np.random.default_rng(2)
    f = lambda *shape: rnd.normal(0, 1, shape).astype(np.float32)
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    model = toxicity.Model(f(toxicity.ROWS, toxicity.WIDTH), {w: f(w, toxicity.WIDTH, toxicity.FILTERS) for w in toxicity.WIDTHS}, f(n), f(n), 0.3, 0.1)
    texts = ["", "one", "Two words", "a few more words than the widest filter has", "same same same"]
    data = [t.encode() for t in texts]
    got = model.scores(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    blank = np.zeros(toxicity.WIDTH)
    for t, score in zip(texts, got):
        words = [model.table[toxicity.features([w.encode()])[0]].mean(axis=0) for w in t.lower().split()]
        pooled = []
        for w in toxicity.WIDTHS:
            row = [*words, *[blank] * (max(toxicity.WIDTHS) - 1)] or [blank]
            starts = range(len(row))
            pooled += list(np.max([sum(row[i + k] @ model.filters[w][k] for k in range(w) if i + k < len(row)) for i in starts], axis=0))
        plain = np.maximum(np.array(pooled) + model.bias, 0) @ model.out + model.out_bias + model.shift
        assert abs(score - 1 / (1 + np.exp(-plain))) < 1e-4


def test_powers_of_long_texts_are_not_kept():
    kept = suffix_dedup.chunk_powers.cache_info().currsize
    up, down = suffix_dedup.powers(suffix_dedup.CHUNK + 1000)
    assert len(up) == suffix_dedup.CHUNK + 1000 and suffix_dedup.chunk_powers.cache_info().currsize == kept
    assert int(up[5]) * int(down[5]) % 2**64 == 1 and int(up[-1]) * int(down[-1]) % 2**64 == 1


def test_op13(spark, folder):
    from test_runs import all_runs, collapsed

    want = []
    for d, t in pairs(spark, folder):
        words = re.findall("[^\x20\x09-\x0d]+", t)
        h, n = zlib.crc32(str(d).encode()) if d is not None else 1, len(words)
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = all_runs(words)
        s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want.append((d, len(found), s, m, q, 1000 * m // q if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(collapsed(words, found))))
    types = {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
    check(query("op13", spark, folder), types, want)


def test_short_items_meet_whole_words_alone(spark):
    docs = [(1, "Yesterday we went home"), (2, "He said: yes!"), (3, "yes"), (4, "a-b yes_no"), (5, None), (6, "Eyes, YES; eyes")]
    items = [(1, "yes"), (2, "a"), (3, "we went"), (4, "e w")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.distance, r.at, r.until) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 3): (0, 10, 17), (2, 1): (0, 8, 11), (3, 1): (0, 0, 3), (4, 2): (0, 0, 1), (6, 1): (0, 5, 8)}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [5]


def test_secret_rules_and_masks_are_linear():
    import time

    rules = [(kind, re.compile(pattern), group, least) for kind, pattern, group, least in secrets.BASE_RULES + secrets.MORE_RULES]
    token = "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10
    start = time.time()
    for text in ("eyJ" * 3_500_000, "eyJaaaaaaaaa." * 800_000, "AKIA" * 2_500_000, "password " * 1_000_000, "-----BEGIN " * 900_000, "ab" * 5_000_000):
        secrets.scan(text, rules)
    assert time.time() - start < 60
    assert [text[3] for text in secrets.scan(f"x {token} y", rules)] == ["jwt"] and [x[:3:2] for x in secrets.scan(f"({token})", rules)] == [(1, 1 + len(token))]
    text = f"{token} some words " * 50_000
    found = [{"at": a, "until": b, "kind": k} for a, _, b, k in secrets.scan(text, rules)]
    start = time.time()
    assert len(found) == 50_000 and secrets.masked(text, found, "[secret]") == "[secret] some words " * 50_000 and time.time() - start < 5


def test_masks_of_overlapping_spans(spark):
    text = "password = 'abcdefgh1' 漢 token: " + "0f" * 20 + " end"
    df = spark.createDataFrame([(1, text, "a"), (None, text, "b"), (2, "clean", None), (3, None, "x")], "doc_id long, text string, findings string")
    got = {(r.doc_id, r.text, r.findings) for r in secrets.redact(df).collect()}
    assert got == {(1, "[secret]' 漢 [secret] end", "a"), (None, "[secret]' 漢 [secret] end", "b"), (2, "clean", None), (3, None, "x")}
