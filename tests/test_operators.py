"""Operators: equal forms, idempotency, streams."""

import tempfile

import pytest
from pyspark.sql import functions as F

from deskmatch.operators import company, dedupe, lists, matching, review
from deskmatch.plans import binding
from deskmatch.sources import tables
from deskmatch.streaming import streams


def test_skill_join_loses_no_pair(spark, small):
    p = binding.projects(spark, small).filter("project_id < 120")
    q = binding.persons(spark, small)
    ps, qs = binding.project_skills(spark, small), binding.person_skills(spark, small)
    fast = {(r.project_id, r.person_id, r.score) for r in matching.match_candidates(p, ps, q, qs, 46).collect()}
    pm, qm = matching.match_projects(p.filter("status != 'ARCHIVED'")), matching.match_persons(q.filter("status != 'ARCHIVED'"))
    own = matching.project_sets(ps).select("project_id", F.explode("p_set").alias("x")).select("project_id", "x.*")
    common = own.join(matching.person_sets(qs).select("person_id", F.explode("q_set").alias("k")), "k").groupBy("project_id", "person_id").agg(F.sum("req").alias("n_required"), F.sum("pre").alias("n_preferred"), F.sum("oth").alias("n_technology"), F.count("*").alias("n_skills"))
    every = pm.crossJoin(qm).join(common, ["project_id", "person_id"], "left").na.fill(0, ["n_required", "n_preferred", "n_technology", "n_skills"])
    every = every.withColumns({"place_state": matching.place_state(), "role_match": matching.role_match()})
    slow = {(r.project_id, r.person_id, r.score) for r in matching.scored(every).filter("score >= 46").collect()}
    assert fast == slow and fast
    with pytest.raises(ValueError):
        matching.match_candidates(p, ps, q, qs, 45)


def test_second_save_adds_nothing(spark, small):
    found = matching.match_candidates(binding.projects(spark, small).filter("project_id < 60"), binding.project_skills(spark, small), binding.persons(spark, small), binding.person_skills(spark, small), 60)
    first, events = review.save_suggestions(found, found.select(F.lit("x").alias("suggestion_key")).filter("false"), "v1")
    assert first.count() == found.count() == events.count() > 0
    assert review.save_suggestions(found, first, "v1")[0].count() == 0
    assert review.save_suggestions(found, first, "v2")[0].count() == found.count()


def test_review_transitions(spark):
    cases = [("SUGGESTED", "APPROVE", "APPROVED"), ("APPROVED", "REJECT", "APPROVED"), ("REJECTED", "REQUEST_REVIEW", "NEEDS_REVIEW"), ("ARCHIVED", "RESTORE", "NEEDS_REVIEW"), ("ARCHIVED", "APPROVE", "ARCHIVED"), ("NEEDS_REVIEW", "KEEP_SUGGESTED", "SUGGESTED")]
    df = spark.createDataFrame(cases, "s string, a string, want string").withColumn("got", review.next_state(F.col("s"), F.col("a")))
    assert df.filter("got != want").count() == 0


def test_merge_and_append_are_idempotent(spark):
    known = spark.createDataFrame([(1, "a", "x")], "k int, body string, category string")
    batch = spark.createDataFrame([(1, "b", "y"), (2, "c", "y"), (2, "c", "y")], known.schema)
    once = tables.merge_batch(known, batch, ["k"], ["body"], {"category": F.lit("NEEDS_REVIEW")})
    twice = tables.merge_batch(once, batch, ["k"], ["body"], {"category": F.lit("NEEDS_REVIEW")})
    want = [(1, "b", "x"), (2, "c", "NEEDS_REVIEW")]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))
    fresh, counts = tables.append_if_absent(known, batch, ["k"])
    assert fresh.count() == 1 and {r.action: r.n for r in counts.collect()} == {"created": 1, "skipped": 2}
    assert tables.append_if_absent(known.unionByName(fresh), batch, ["k"])[0].count() == 0


def test_csv_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('案件名,スキル\n"a, ""b""","x\ny"\n,\nc,z\n', encoding="utf-8")
    rows = tables.read_import_csv(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [(r["案件名"], r["スキル"], r.row_no, r.source) for r in rows] == [('a, "b"', "x\ny", 2, "a.csv"), ("c", "z", 3, "a.csv")]


def test_second_extraction_creates_nothing(spark):
    mails = spark.createDataFrame([(i, "same" if i < 3 else f"s{i}", "a@x.example", i) for i in range(6)], "mail_id long, subject string, from_email string, received_at long")
    none = spark.createDataFrame([], "mail_id long, entity_id long")
    prior = spark.createDataFrame([], "subject string, from_email string, entity_id long, created_at long")
    plan = dedupe.plan_extraction(mails, none, prior)
    assert {r.mail_id for r in plan.filter("action = 'created'").collect()} == {2, 3, 4, 5}
    again = dedupe.plan_extraction(mails, plan.select("mail_id", F.col("mail_id").alias("entity_id")), prior)
    assert {r.action for r in again.collect()} == {"skipped"}


def test_set_back_by_hand(spark):
    mails = spark.createDataFrame([(1, "PROJECT_INTRO", "RULE"), (2, "OTHER", None)], "mail_id long, category string, classified_by string")
    entities = spark.createDataFrame([(7, 1, "OPEN"), (8, 2, "OPEN")], "entity_id long, source_mail_id long, status string")
    m, e = dedupe.move_to_unclassified(mails, entities, spark.createDataFrame([(1,)], "mail_id long"))
    assert sorted(map(tuple, m.select("mail_id", "category", "classified_by").collect()), key=str) == [(1, "NEEDS_REVIEW", "MANUAL"), (2, "OTHER", None)]
    assert sorted(map(tuple, e.select("entity_id", "source_mail_id", "status").collect())) == [(7, None, "ARCHIVED"), (8, 2, "OPEN")]


def test_chunks_stop_at_the_update_limit(spark):
    rows = spark.range(10).select("id", F.col("id").alias("created_at"))
    got = dedupe.keyset_chunks(rows, 3, 2, F.col("id") % 2 == 0).orderBy(F.desc("id")).collect()
    assert [(r.id, r.chunk) for r in got] == [(9, 0), (8, 0), (7, 0), (6, 1)]


def test_companies_by_domain_and_alias(spark):
    known = spark.createDataFrame([(1, "Alpha", "alpha.example"), (2, "株式会社Betaworks", None)], "company_id long, name string, domain string")
    alias = known.select("company_id", F.col("name").alias("alias"))
    mails = spark.createDataFrame([(1, "x@sub.alpha.example", None, None, None), (2, "x@gmail.com", "Betaworks 営業", None, None), (3, "x@gmail.com", None, None, None), (4, "x@new-house.example.co.jp", None, None, None), (5, None, None, None, None)], "mail_id long, from_email string, from_name string, label string, signature string")
    got = {r.mail_id: (r.company_id, r.source) for r in company.infer_company(mails, known, alias).collect()}
    assert got == {1: (1, "known_main_email_domain"), 2: (2, "known_alias"), 3: (None, "generic_domain"), 4: (None, "sender_domain"), 5: (None, "none")}


def test_pages_and_orders(spark):
    rows = spark.createDataFrame([(i, f"n{i % 3}", i % 4, i) for i in range(9)], "id int, name string, price int, created_at int")
    page = lists.paginate(rows, [F.desc("id")], 9, 4).collect()
    assert [(r.id, r.page, r.pages, r.place_no) for r in page] == [(0, 3, 3, 9)]
    assert lists.sorted_rows(rows, "price_asc", "name", "price", "id").first().id == 0


def test_streams_give_the_batch_results(spark, small):
    events = binding.table(spark, small, "events").select(F.col("user_id").alias("suggestion_id"), F.col("ts"), "event_id", F.element_at(F.array(*map(F.lit, review.ACTIONS)), (F.col("event_id") % 6 + 1).cast("int")).alias("action"))
    folder = tempfile.mkdtemp()
    events.coalesce(1).orderBy("ts", "event_id").write.parquet(f"{folder}/in")
    live = streams.review_states(spark.readStream.schema(events.schema).parquet(f"{folder}/in"))
    query = live.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", f"{folder}/check").start()
    query.processAllAvailable()
    query.stop()
    got = {r.suggestion_id: (r.status, r.n_applied) for r in spark.sql("SELECT * FROM states").collect()}
    assert got == {r.suggestion_id: (r.status, r.n_applied) for r in review.fold_review_events(events).collect()}


def test_mail_stream_drops_repeats(spark):
    folder = tempfile.mkdtemp()
    rows = spark.createDataFrame([(1, 1, "案件紹介", "x"), (1, 1, "案件紹介", "x"), (1, 2, "hello", "y")], "account_id int, external_id int, subject string, body string")
    rows = rows.withColumns({"received_at": F.lit("2024-01-01").cast("timestamp"), "in_reply_to": F.lit(None).cast("string"), "references_header": F.lit(None).cast("string")})
    rows.write.parquet(f"{folder}/in")
    from deskmatch.functions.mail_rules import STRONG, WEIGHTED

    seen = []
    live = streams.ingest_mails(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), WEIGHTED, STRONG)
    query = streams.merge_each_batch(live, lambda df, n: seen.extend(df.collect()), f"{folder}/check").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.external_id, r.label) for r in seen) == [(1, "project_intro"), (2, "other")]


def test_no_table_is_sent_to_the_driver_to_infer_companies(spark):
    mails = spark.createDataFrame([(1, "x@a.example", "Acme desk", None, None)], "mail_id long, from_email string, from_name string, label string, signature string")
    companies = spark.createDataFrame([(7, "Acme", "acme.example")], "company_id long, name string, domain string")
    out = company.infer_company(mails, companies, companies.limit(1).select("company_id", F.col("name").alias("alias")))
    assert [(r.company_id, r.source) for r in out.collect()] == [(7, "known_alias")]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def moved_rows(df):
    """Rows that the shuffles of the plan wrote; df was collected before."""
    todo, out = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        else:
            if node.nodeName() == "Exchange":
                out += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return out


def test_only_suggestions_with_saved_codes_are_moved(spark):
    rows = [(i, i % 7, 90 if i < 10 else 60, "HIGH" if i < 10 else "MEDIUM", "x", "") for i in range(1000)] + [(5000, 1, None, None, None, None), (5001, 1, 90, "HIGH", "other", "")]
    found = spark.createDataFrame(rows, "project_id long, person_id long, score int, band string, reasons string, warnings string")
    none = found.select(F.lit("x").alias("suggestion_key")).filter("false")
    saved = review.save_suggestions(found.filter("project_id < 9 OR project_id = 5000"), none, "v1", True)[0].drop("suggestion_key")
    got = review.save_suggestions(found, saved, "v1", True)[0]
    want = review.save_suggestions(found, review.save_suggestions(found.filter("project_id < 9 OR project_id = 5000"), none, "v1")[0], "v1")[0]
    assert sorted(r.suggestion_key for r in got.collect()) == sorted(r.suggestion_key for r in want.collect())
    assert len(got.collect()) == 1002 - 10
    assert moved_rows(got) < 200


def test_saved_suggestions_are_not_broadcast_and_only_their_scores_made_again(spark):
    rows = [(i, i % 7, 60 + i % 20, "MEDIUM", "x", "") for i in range(200)]
    found = spark.createDataFrame(rows, "project_id long, person_id long, score int, band string, reasons string, warnings string")
    none = found.select(F.lit("x").alias("suggestion_key")).filter("false")
    saved = tables.written(review.save_suggestions(found.filter("score >= 77"), none, "v1", True)[0].drop("suggestion_key"), "saved")
    asked = []
    got = review.new_suggestions(found, saved, "v1", True, lambda least: asked.append(least) or found.filter(F.col("score") >= least))
    assert sorted(r.project_id for r in got.collect()) == [i for i in range(200) if i % 20 < 17] and asked == [77]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [project_id" in plan and "BroadcastHashJoin [project_id" not in plan
