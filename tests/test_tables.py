"""Bucketed merges, nested messages and late mails against plain Python."""

import base64
import datetime
import glob
import json
import os

from pyspark.sql import functions as F

from deskmatch.operators import company
from deskmatch.sources import tables
from deskmatch.streaming import streams


def files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/_bucket=*/*.parquet")}


def test_merge_rewrites_touched_buckets_alone(spark, tmp_path):
    at, key = str(tmp_path / "mails"), ["account", "external"]
    rows = spark.createDataFrame([(1, f"m{i}", f"body {i}", "PROJECT_INTRO") for i in range(200)], "account int, external string, body string, category string")
    tables.write_buckets(rows, at, key, 16)
    before = files(at)
    batch = spark.createDataFrame([(1, "m3", "new", "OTHER"), (1, "m3", "newer", "OTHER"), (1, "x1", "first", "OTHER"), (2, "m3", None, "OTHER")], rows.schema)
    merge = lambda b: tables.merge_into_buckets(spark, at, b, key, 16, ["body"], {"category": F.lit("NEEDS_REVIEW")})
    touched = merge(batch)
    after = files(at)
    part = lambda f: int(f.split("_bucket=")[1].split("/")[0])
    assert 0 < len(touched) <= 3 and {f: t for f, t in before.items() if part(f) not in touched} == {f: t for f, t in after.items() if part(f) not in touched}
    table = lambda: sorted(((r.account, r.external, r.body, r.category) for r in spark.read.parquet(at).collect()), key=repr)
    found = {(a, e): (b, c) for a, e, b, c in table()}
    assert len(found) == 202 and found[1, "m3"] == ("new", "PROJECT_INTRO") and found[1, "x1"] == ("first", "NEEDS_REVIEW") and found[2, "m3"] == (None, "NEEDS_REVIEW") and found[1, "m4"] == ("body 4", "PROJECT_INTRO")
    once = table()
    assert merge(batch) == touched and table() == once
    assert merge(batch.filter("false")) == [] and table() == once


def test_nested_messages(spark):
    data = lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("=")
    leaf = lambda t, mime="text/plain", **more: {"mimeType": mime, "body": {"data": data(t)}, **more}
    box = lambda *parts: {"mimeType": "multipart/mixed", "parts": list(parts)}
    messages = [
        (1, box(leaf("a"), box(leaf("b"), box(leaf("<c>", "text/html"), leaf("d?>~"), leaf("gone", filename="x.txt"))), leaf("é漢"), leaf("pdf", "application/pdf"), {"mimeType": "text/plain", "body": {"attachmentId": "7", "data": data("no")}})),
        (2, leaf("alone")), (3, box()), (4, {"mimeType": "text/plain", "body": {}}),
    ]
    df = spark.createDataFrame([(k, json.dumps(m)) for k, m in messages] + [(5, None), (6, "broken {")], "id long, message string")
    got = {r.id: (r.text, r.html) for r in tables.message_bodies(df, "id", "message").collect()}
    assert got == {1: ("a\n\nb\n\nd?>~\n\né漢", "<c>"), 2: ("alone", None), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}
    deep = leaf("deep")
    for _ in range(9):
        deep = box(leaf("up"), deep)
    rows = tables.message_leaves(spark.createDataFrame([(1, json.dumps(deep))], "id long, message string"), "id", "message").orderBy("path").collect()
    assert [r.text for r in rows] == ["up"] * 9 + ["deep"] and len(rows[-1].path) == 9


def test_late_mails_are_named(spark):
    at = lambda day, hour: datetime.datetime(2024, 5, day, hour)
    landed = [(1, "a", at(1, 9)), (1, "b", at(3, 12)), (2, "late", at(1, 23)), (2, "in time", at(3, 1)), (2, "same day", at(2, 23)), (3, "later", at(3, 5)), (2, "new", at(5, 2))]
    df = spark.createDataFrame(landed, "arrival int, name string, received_at timestamp")
    assert {r.name for r in streams.late_mails(df).collect()} == {"late", "same day", "later"}
    assert streams.late_mails(df.filter("arrival = 1")).count() == 0


def test_rows_of_one_contact_are_one_candidate(spark):
    entities = spark.createDataFrame([(1, "Alpha", "p@alpha.example", "Taro Yamada")], "entity_id long, company string, email string, contact string")
    contacts = [(7, "Alpha", "other.example", "x@other.example", "Taro Yamada"), (7, "Alpha", "other.example", "y@other.example", "Yamada Taro"), (7, "Zeta", "alpha.example", "p@alpha.example", None), (8, "Alpha", None, None, "Taro Yamada")]
    got = company.contact_candidates(entities, spark.createDataFrame(contacts, "contact_id long, company string, domain string, email string, contact string"), 5).collect()
    assert [(r.contact_id, r.score, r.rank) for r in got] == [(7, 96, 1), (8, 86, 2)] and got[0].reasons == "contact_email_match,email_domain_match"
    tie = [(7, "Alpha", None, None, None), (7, "Zeta", None, "p@alpha.example", None)]
    points = {"company_name_exact": 46, "contact_email_match": 62}
    got = company.contact_candidates(entities, spark.createDataFrame(tie, "contact_id long, company string, domain string, email string, contact string"), 5).collect()
    assert [(r.contact_id, r.score) for r in got] == [(7, max(points["company_name_exact"], points["contact_email_match"] + 34))]


def test_rows_are_dealt_out_by_their_number(spark):
    rows = spark.range(1000).coalesce(1)
    assert tables.dealt_out(rows, 50).rdd.getNumPartitions() == 20
    assert tables.dealt_out(rows, like=rows.limit(5)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
