"""Joins by rare runs, classes and ranges give what all pairs and whole orders give."""

import random

import pytest
from pyspark.sql import functions as F

from deskmatch.operators import classify, company, dedupe, imports, market, matching, reports, review
from deskmatch.streaming.streams import next_status


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def names(n, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14))) for _ in range(n // 2)]
    return base + [b[: rnd.randint(1, len(b))] + rnd.choice("abc") + b[rnd.randint(0, len(b)) :] for b in base]


@pytest.mark.parametrize(("least", "shortest"), [(0.82, 6), (0.84, 1)])
def test_close_names_are_those_of_all_pairs(spark, least, shortest):
    left, right = {*names(120, 1)}, {*names(120, 2), *names(60, 1)}
    table = lambda rows: spark.createDataFrame([(x,) for x in sorted(rows)], "name string")
    want = {(a, b) for a in left for b in right if a != b and min(len(a), len(b)) >= shortest and 1 - levenshtein(a, b) / max(len(a), len(b)) >= least}
    assert {tuple(r) for r in company.close_names(table(left), table(right), least, shortest).collect()} == want and len(want) > 10


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnop"])
def test_close_names_of_all_lengths_are_those_of_all_pairs(spark, letters):
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    base = [text(n) for n in range(1, 46, 2) for _ in range(2)]

    def edited(name):
        for _ in range(rnd.randint(1, 7)):
            at = rnd.randint(0, len(name))
            name = name[:at] + text(rnd.randint(0, 1)) + name[at + rnd.randint(0, 1) :]
        return name

    left, right = set(base), {edited(b) for b in base for _ in range(3)} - {""}
    table = lambda rows: spark.createDataFrame([(x,) for x in sorted(rows)], "name string")
    want = {(a, b) for a in left for b in right if a != b and 5 * abs(len(a) - len(b)) <= len(a) and 1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.84}
    assert {tuple(r) for r in company.close_names(table(left), table(right), 0.84).collect()} == want and len(want) > 20


def test_names_do_not_meet_by_short_runs(spark):
    """Names of random letters meet by keys that hardly any two strangers share, so the pairs to be tested grow with the names."""
    rnd = random.Random(8)
    table = lambda n: spark.createDataFrame([("".join(rnd.choice("abcdefghijklmnop") for _ in range(20)),) for _ in range(n)], "name string")
    keys = [company.edit_keys(table(2000), company.CLOSE_CONTACT, splits) for splits in (True, False)]
    assert keys[0].join(keys[1], "k").count() < 2000


def test_contained_names_are_those_of_all_pairs(spark):
    texts, found = {*names(100, 3)}, {*names(60, 4), "a", "ab", "abc", "abca"}
    table = lambda rows: spark.createDataFrame([(x,) for x in sorted(rows)], "name string")
    got = {tuple(r) for r in company.contained(table(texts), table(found)).collect()}
    assert got == {(t, n) for t in texts for n in found if n in t} and len(got) > 100


def test_candidates_by_classes_are_those_of_all_pairs(spark):
    rnd = random.Random(5)
    pick = rnd.choice
    skills = ["Java", "ＪＡＶＡ", "sql", "SQL", "aws", "php", "", "Go"]
    month = lambda: pick([None, "2024-01-01", "2024-05-01", "2025-01-01"])
    projects = [(i, pick(["java backend lead", "php site", "sql data lead"]), pick([None, 0, 40, 60]), pick([None, 50, 80]), month(), pick(["東京都", "大阪", ""]), pick(["FULL_REMOTE", "ONSITE", ""]), pick(["OPEN", "DRAFT", "ARCHIVED"])) for i in range(60)]
    persons = [(i, pick(["java backend", "data sql lead", "other"]), pick([None, 0, 45, 70]), month(), pick(["東京都渋谷", "大阪", ""]), pick(["フルリモート希望", "常駐", ""]), pick(["AVAILABLE", "JOINED", "ARCHIVED"])) for i in range(60)]
    p = spark.createDataFrame(projects, "project_id long, title string, unit_min int, unit_max int, start_month string, place string, remote_type string, status string").withColumn("start_month", F.to_date("start_month"))
    q = spark.createDataFrame(persons, "person_id long, summary string, desired int, available string, place string, remote_wish string, status string").withColumn("available", F.to_date("available"))
    ps = spark.createDataFrame([(i, pick(skills), pick(["REQUIRED", "PREFERRED", None])) for i in range(60) for _ in range(4)], "project_id long, skill_name string, skill_type string")
    qs = spark.createDataFrame([(i, pick(skills)) for i in range(60) for _ in range(3)], "person_id long, skill_name string")
    own = ps.withColumn("k", matching.skill_key(F.col("skill_name"))).filter("k != ''").groupBy("project_id", "k").agg(F.max((F.col("skill_type") == "REQUIRED").cast("int")).alias("a"), F.max((F.col("skill_type") == "PREFERRED").cast("int")).alias("b"), F.max(F.col("skill_type").isNull().cast("int")).alias("c"))
    theirs = qs.withColumn("k", matching.skill_key(F.col("skill_name"))).filter("k != ''").select("person_id", "k").distinct()
    common = own.join(theirs, "k").groupBy("project_id", "person_id").agg(F.sum(F.coalesce("a", F.lit(0))).alias("n_required"), F.sum(F.coalesce("b", F.lit(0))).alias("n_preferred"), F.sum("c").alias("n_technology"), F.count("*").alias("n_skills"))
    pairs = common.join(matching.match_projects(p.filter("status != 'ARCHIVED'")), "project_id").join(matching.match_persons(q.filter("status != 'ARCHIVED'")), "person_id")
    every = matching.scored(pairs.withColumns({"place_state": matching.place_state(), "role_match": matching.role_match()})).select(*matching.RESULT)
    for least in (46, 60):
        got = matching.match_candidates(p, ps, q, qs, least)
        want = every.filter(F.col("score") >= least)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() > 5
    with pytest.raises(ValueError, match="over 45"):
        matching.match_candidates(p, ps, q, qs, 45)


def test_chunks_are_those_of_one_order(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["2024-01-01", "2024-01-02", "2024-01-03"]), rnd.random() < 0.3) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, created_at string, wrong boolean").repartition(7)
    got = {r.id: (r.chunk, r.n_updates) for r in dedupe.keyset_chunks(df, 20, 50, F.col("wrong")).collect()}
    want, n = {}, 0
    for place, (i, _, wrong) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)):
        if n < 50:
            n += wrong
            want[i] = (place // 20, n)
    assert got == want


@pytest.mark.parametrize("chunk", [2, 1000])
def test_events_fold_in_runs_as_one_by_one(spark, monkeypatch, chunk):
    monkeypatch.setattr(review, "CHUNK", chunk)
    rnd = random.Random(7)
    events = [(rnd.randrange(6), f"2024-01-{rnd.randint(1, 28):02d} 00:00:00", i, rnd.choice([*review.ACTIONS, "OTHER"]), rnd.choice([None, None, *review.STATES])) for i in range(200)]
    df = spark.createDataFrame(events, "suggestion_id long, ts string, event_id long, action string, expected_status string").withColumn("ts", F.to_timestamp("ts"))
    want = {}
    for s, _, _, action, expected in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        status, applied = want.get(s, (review.FIRST_STATE, 0))
        to = next_status(status, action) if expected in (None, status) else status
        want[s] = (to, applied + (to != status))
    got = review.fold_review_events(df).collect()
    assert {r.suggestion_id: (r.status, r.n_applied) for r in got} == want and all((r.archived_at is not None) == (r.status == "ARCHIVED" and r.n_applied > 0) for r in got)


def test_rows_without_a_company_are_no_duplicates(spark):
    rows = spark.createDataFrame([(1, "same", "", ["a"], "", None), (2, "same", None, ["b"], "", None), (3, "same", "x", ["c"], "", None), (4, "same", "x", ["d"], "", None)], "id long, title string, company string, skill_list array<string>, place string, price_value double")
    assert [(r.id, r.existing_id, r.strength) for r in imports.db_duplicates(rows, rows, F.col("r_id") < F.col("e_id")).collect()] == [(3, 4, "strong")]


@pytest.mark.parametrize("text", ["a@x.example", "see http://x", "Bearer abc", "postgres://h", "mysql://h", "password = 1", "C:\\Users", "/home/me", "-----BEGIN RSA PRIVATE KEY-----"])
def test_each_sensitive_pattern(spark, text):
    rows = spark.createDataFrame([(1, text), (2, "plain words")], "id long, text string")
    assert [r.id for r in reports.sensitive_rows(rows).collect()] == [1]


def test_json_is_sanitised_to_a_depth():
    deep = {"a": {"b": {"c": {"d": {"e": 1}}}}}
    assert reports.safe_json(deep) == {"a": {"b": {"c": {"d": {"e": "[redacted]"}}}}}
    assert reports.safe_json({"ok": ["CODE", "not safe!", float("nan")] + [1] * 30, "email": "x", "bad key": 1}) == {"ok": ["CODE", "[redacted]", None, *[1] * 17]}


def test_mails_of_days_in_japan(spark):
    rows = spark.createDataFrame([(1, "2023-12-31 14:59:59", None), (2, "2023-12-31 15:00:00", "RULE"), (3, "2024-01-02 14:59:59", None), (4, "2024-01-02 15:00:00", None), (5, "2024-01-01 00:00:00", "MANUAL")], "mail_id long, at string, classified_by string").withColumn("received_at", F.to_timestamp("at"))
    assert {r.mail_id for r in classify.to_classify(rows, "2024-01-01", "2024-01-02").collect()} == {2, 3}
    assert [r.mail_id for r in classify.to_classify(rows, newest=2).collect()] == [4, 3]


def test_table_types_and_months():
    assert imports.detect_table_type(["スキル", "単価"])["detected"] == "review" and imports.detect_table_type([])["detected"] == "review"
    assert imports.detect_table_type(["氏 名", "年齢"])["detected"] == "person"
    assert market.last_months("2024-02-15") == ("2023-12", "2024-02")
