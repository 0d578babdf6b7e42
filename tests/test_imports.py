"""Imports: token forms, keys and duplicates, case by case and against all pairs."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from deskmatch.operators import imports


def form(text):
    return re.sub(r"[\s_\-ー・･/／|:：()（）［］\[\]【】「」『』,，.．]", "", unicodedata.normalize("NFKC", (text or "").strip().lower()))


def test_token_forms(spark):
    texts = ["A-B", " ａ　ｂ ", "Ｎｏｄｅ．ｊｓ", "デ・ータ", "（株）山田", None, "", "C#", "x_y/z|w:v", "㈱ 山田"]
    df = spark.createDataFrame([(i, t, [t or "", "Ａ B"]) for i, t in enumerate(texts)], "i int, t string, l array<string>")
    got = df.select("i", imports.token(F.col("t")).alias("x"), imports.token_list(F.col("l")).alias("l")).collect()
    assert {r.i: r.x for r in got} == {i: form(t) for i, t in enumerate(texts)}
    assert all(list(r.l) == [form(texts[r.i]), "ab"] for r in got)


def test_headers_meet_without_signs_and_the_later_field_wins():
    fields = {"a": ["会社名", "client"], "b": ["client company", "CLIENT"], "c": ["Start-Date"]}
    assert imports.map_headers(["会社・名", "Cli ent", "client_company", "start.date", "other"], fields) == ({"a": ["会社・名"], "b": ["client_company", "Cli ent"], "c": ["start.date"]}, ["other"])


def test_keys(spark):
    rows = [(1, "A-B", "2026-07", "X社", "Java、AWS"), (2, "ab", "2026/07", "x社", "java/aws"), (3, None, "2026-07", "X社", None), (4, None, "2026-07", "X社", None), (5, "AB", "2026-07", "X社", "AWS、Java")]
    df = spark.createDataFrame([("f.csv", n, *r) for n, *r in rows], "source string, row_no int, title string, start string, company string, skills string")
    df = df.withColumns({c: F.lit("text of some length") for c in ("work", "place")} | {"price": F.lit("80万円")})
    got = {r.row_no: r for r in imports.source_duplicates(imports.assess_rows(df, "project")).collect()}
    assert got[1].duplicate_key == got[2].duplicate_key != got[5].duplicate_key and [got[n].same_rows for n in (1, 2, 5)] == [2, 2, 1]
    assert got[3].duplicate_key is None and [got[n].same_rows for n in (3, 4)] == [0, 0]
    people = spark.createDataFrame([("f.csv", n, c) for n, c in ((1, "X"), (2, "Y"))], "source string, row_no int, company string").withColumns({"name": F.lit("山田 太郎"), "start": F.lit("7月"), "skills": F.lit("Java"), **{c: F.lit(None).cast("string") for c in ("initials", "role", "price", "place")}})
    assert [r.same_rows for r in imports.source_duplicates(imports.assess_rows(people, "person")).collect()] == [2, 2]  # a person's owner is no part of the key


def test_duplicates_equal_those_of_all_pairs(spark):
    rnd = random.Random(3)
    skills = ["Java", "JAVA ", "C", "R", "AWS", "aws", "Node.js", "ＮＯＤＥＪＳ", "SQL", "Go"]
    rows = [(i, rnd.choice(["A-B", "ab", "c d", "", None]), rnd.choice(["X", "ｘ", "", None]), [rnd.choice(skills) for _ in range(rnd.randrange(6))], rnd.choice(["東京 都", "東京都", "大阪", "", None]), rnd.choice([None, 0.0, 5.0, 9.9, 10.0, 40.0])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, title string, company string, skill_list array<string>, place string, price_value double")
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                common = len({form(s) for s in a[3] if len(form(s)) >= 2} & {form(s) for s in b[3]}) >= 2
                place = form(a[4]) != "" and form(a[4]) == form(b[4])
                near = a[5] is not None and b[5] is not None and abs(a[5] - b[5]) <= 5
                if (form(a[1]) and form(a[2]) and (form(a[1]), form(a[2])) == (form(b[1]), form(b[2]))) or (common and place and near):
                    want[a[0], b[0]] = "strong"
                elif common and (place or near):
                    want[a[0], b[0]] = "weak"
    got = imports.db_duplicates(df, df, F.col("r_id") < F.col("e_id")).collect()
    assert len(got) == len(want) and {(r.id, r.existing_id): r.strength for r in got} == want
    people = df.withColumnsRenamed({"title": "identity", "company": "owner", "place": "available"})
    assert {(r.id, r.existing_id): r.strength for r in imports.db_person_duplicates(people, people, F.col("r_id") < F.col("e_id")).collect()} == want
    assert imports.db_duplicates(df.filter("false"), df).count() == 0


def test_pairs_of_duplicates_are_not_moved(spark):
    rows = [(i, f"t{i}", "x", ["Java", "AWS", "SQL"], "p", 5.0) for i in range(60)] + [(7, "t7", "x", ["Java", "AWS"], "q", 5.0)]
    df = spark.createDataFrame(rows, "id long, title string, company string, skill_list array<string>, place string, price_value double")
    got = imports.db_duplicates(df, df, F.col("r_id") < F.col("e_id"))
    assert len(got.collect()) == 60 * 59 // 2 + 59 and {r.strength for r in got.collect()} == {"strong", "weak"}
    assert not [line for line in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Aggregate" in line]


def test_sides_of_duplicates_are_dealt_out_and_not_broadcast(spark):
    """A side is small beside the pairs that it makes, so its bytes must not choose how many tasks make them."""
    rows = [(i, f"t{i % 9}", "x", ["Java", "AWS", *["SQL"] * (i % 2)], f"p{i % 3}", float(i % 5)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, title string, company string, skill_list array<string>, place string, price_value double")
    got = imports.db_duplicates(df, df, F.col("r_id") < F.col("e_id"))
    assert len({(r.id, r.existing_id) for r in got.collect()}) == got.count() == 90 * 89 // 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and got.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
