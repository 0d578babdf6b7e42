"""Queries on ruled mails, persons, exported tables, import reviews, audits and streams, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mail_rules
from ..functions import text as t
from ..operators import classify, company, dedupe, extract, imports, lists, reports
from ..plans import binding as b
from ..sources import tables
from ..streaming import streams
from . import entities as e
from .mails import EXTRACTED, MAILS, mails, project_mails

#: Subjects of mails by an order's number, and what the fixed rules say of each: label, category, confidence, excluded, rules.
SUBJECTS = ["【案件】Java開発 単価80万円", "要員のご紹介です", "セミナーのご招待", "今週の市場動向レポート", "広告キャンペーン", "Re: 打ち合わせ", "お世話になっております", "リモート 開発 支援 面談1回"]
RULED = [("project_intro", "PROJECT_INTRO", 0.9, False, "strong_project_intro:10"), ("person_intro", "PERSON_INTRO", 0.93, False, "strong_person_intro:10"), ("seminar", "SEMINAR", 0.87, True, "seminar:4"), ("newsletter", "NEWSLETTER", 0.98, True, "newsletter:6"), ("sales_ad", "SALES_AD", 0.87, True, "sales_ad:4"), ("reply", "OTHER", 0.95, True, "reply:10"), ("other", "OTHER", 0.5, False, ""), ("project_intro", "PROJECT_INTRO", 0.8167, False, "project_intro:5")]
REASONS = {2: "セミナー・イベント案内のため通常一覧から除外", 3: "メルマガ・ニュースレターのため通常一覧から除外", 4: "営業広告のため通常一覧から除外", 5: classify.REPLY_REASON}
PERSON_SKILLS = ["Java, AWS", "PHP", "Python、SQL、C#", ""]


def order_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    return b.dealt_out(b.table(spark, sf_dir, "orders")).select(k.alias("mail_id"), b.choice(k % 8, SUBJECTS).alias("subject"), F.lit("").alias("body"), none.alias("in_reply_to"), none.alias("references_header"), F.col("o_orderdate").alias("received_at"), F.concat(F.lit("x@d"), F.floor(k / 100).cast("string"), F.lit(".example.jp")).alias("from_email"), F.when(k % 2 == 0, "PROJECT_INTRO").otherwise("PERSON_INTRO").alias("category"))


def _choice(k: str, values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + f"][({k})::INT + 1]"


ORDER_MAILS = f"om AS (SELECT o_orderkey AS mail_id, {_choice('o_orderkey % 8', SUBJECTS)} AS subject, '' AS body, o_orderdate AS received_at, 'x@d' || (o_orderkey // 100)::VARCHAR || '.example.jp' AS from_email, CASE WHEN o_orderkey % 2 = 0 THEN 'PROJECT_INTRO' ELSE 'PERSON_INTRO' END AS category FROM orders)"


def ruled_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails of orders by the desk's fixed rules."""
    out = classify.classify_mails(order_mails(spark, sf_dir), mail_rules.WEIGHTED, mail_rules.STRONG)
    rules = F.array_join(F.transform("matched_rules", lambda r: F.concat_ws(":", r["rule"], r["score"].cast("string"))), ",")
    return out.select("mail_id", "label", out["category"], F.col("confidence").cast("double").alias("confidence"), "is_excluded", "exclude_reason", rules.alias("rules"))


def classification_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest groups of subjects (a top-k report)."""
    return reports.classification_audit(order_mails(spark, sf_dir))


def classification_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored categories left, and what the fixed rules would make of them (the senders are a top-k report)."""
    k = F.col("mail_id")
    m = order_mails(spark, sf_dir).withColumns({"category": F.when(k % 3 == 0, "OTHER").when(k % 3 == 1, "PROJECT_INTRO").otherwise("NEEDS_REVIEW"), "is_excluded": k % 10 == 0})
    m = tables.written(m, "mails")
    return reports.classification_changes(m, classify.classify_mails(m.drop("category", "is_excluded"), mail_rules.WEIGHTED, mail_rules.STRONG))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = extract.with_quality(extract.mail_texts(project_texts(spark, sf_dir)))
    return m.withColumn("n_skills", F.size(extract.skills_in(F.col("_text"), F.lower("_text")))).withColumn("needs_review", F.col("quality_review"))


def project_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short mails of orders: a subject by number, bodies from none to labelled ones."""
    k = F.col("mail_id")
    body = F.when(k % 3 == 0, "案件名：Java\n必須スキル：Java、SQL\n単価：80万円").when(k % 3 == 1, "氏名：山田\nスキルシート\n最寄：東京").otherwise("")
    return order_mails(spark, sf_dir).withColumn("body", body)


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of mails by signal words and the warning that a stored category gets."""
    m = _scored(spark, sf_dir)
    return m.select("mail_id", *(F.col(c).cast("int").alias(c) for c in ("project_score", "person_score", "excluded_score", "margin")), "subject_only", extract.category_mismatch(F.col("category"), F.col("project_score"), F.col("person_score")).alias("mismatch"))


#: Judged texts up to so many are broadcast, as a text of very many mails would meet them in one task.
FEW_TEXTS = 10_000


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails of orders with scores, the record that their category gets, the company inferred, whether an entity has them, and whether sender and subject come again."""
    k = F.col("mail_id")
    m = project_texts(spark, sf_dir).withColumns({"from_email": F.concat(F.lit("x@d"), F.floor(k / 9).cast("string"), F.lit(".example.jp")), "from_name": F.when(k % 4 == 0, "株式会社デスク")})
    m = tables.written(m.withColumn("text_id", F.sha2(F.to_json(F.struct("category", "subject", "body")), 256)), "mails")
    # Mails of one category, subject and body are judged alike, so each text is judged once.
    texts = tables.written(m.select(F.col("text_id").alias("mail_id"), "category", "subject", "body", F.lit(None).cast("string").alias("from_name"), F.lit(None).cast("string").alias("from_email")).dropDuplicates(["mail_id"]), "texts")
    spread = b.dealt_out(texts)
    quality = extract.with_quality(extract.mail_texts(spread)).select("mail_id", "project_score", "person_score", "excluded_score", "margin", "predicted_type", "subject_only", "body_derived", "quality_review", "warnings")
    projects = extract.extract_projects(spread.filter("category = 'PROJECT_INTRO'"), "1998-06-15").select("mail_id", F.size(F.array_distinct(F.concat("required_skills", "preferred_skills", "used_skills"))).alias("n_skills"), "needs_review", "review_reasons")
    persons = extract.extract_persons(spread.filter("category = 'PERSON_INTRO'")).select("mail_id", F.size("skills").alias("n_skills"), "needs_review", "review_reasons", "name_source", "name_confidence", "name_rejected", "role_source")
    judged = tables.written(quality.join(projects.unionByName(persons, allowMissingColumns=True).hint("merge"), "mail_id").withColumnRenamed("mail_id", "text_id"), "judged")
    judged = F.broadcast(judged) if judged.count() <= FEW_TEXTS else judged.hint("merge")
    none = F.lit(None).cast("string")
    found = company.infer_company(m.select("mail_id", "from_email", "from_name", none.alias("label"), none.alias("signature")), e.companies(spark, sf_dir), e.companies(spark, sf_dir).select("company_id", F.col("name").alias("alias")))
    known = e._entities(spark, sf_dir).select(F.col("source_mail_id").alias("mail_id"), F.lit(True).alias("linked")).filter("mail_id IS NOT NULL").distinct()
    again = m.groupBy("from_email", "subject").agg(F.count("*").alias("n"))
    # But for judged texts each side has about as many rows as there are mails, though few bytes: none is to be broadcast.
    m = m.join(again.hint("merge"), ["from_email", "subject"]).select("mail_id", "text_id", (F.col("n") > 1).alias("same_sender_subject"))
    m = m.join(judged, "text_id").drop("text_id").join(found.select("mail_id", F.col("source").alias("company_source"), F.col("confidence").alias("company_confidence")).hint("merge"), "mail_id")
    return m.join(known.hint("merge"), "mail_id", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def quality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of audited mails: all maps and the summary."""
    return reports.quality_audit(_audited(spark, sf_dir))


def high_risk_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 mails at high risk (a sample is the feature)."""
    scored = _scored(spark, sf_dir).withColumn("review_reasons", F.array().cast("array<string>"))
    return reports.high_risk_sample(scored).select("mail_id")


def person_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails that introduce customers: with a name, initials or neither; skills, price, age, station and nationality."""
    rows = b.dealt_out(b.table(spark, sf_dir, "customer")).join(b.nations(spark, sf_dir), "c_nationkey")
    k = F.col("c_custkey")
    who = F.when(k % 3 == 0, "氏名：山田太郎").when(k % 3 == 1, "イニシャル：T.Y")
    lines = [who, F.concat(F.lit("年齢："), (20 + k % 40).cast("string"), F.lit("歳")), F.when(k % 7 != 0, F.concat(F.lit("希望単価："), (40 + k % 50).cast("string"), F.lit("万円"))), F.concat(F.lit("最寄："), b.choice(F.col("n_regionkey"), b.PLACES)), F.when(k % 4 != 3, F.concat(F.lit("スキル："), b.choice(k % 4, PERSON_SKILLS))), F.when(k % 2 == 0, "国籍：日本")]
    return rows.select(k.alias("mail_id"), F.lit("Skill sheet").alias("subject"), F.concat_ws("\n", *lines).alias("body"), F.lit("desk").alias("from_name"), F.lit("desk@example-corp.com").alias("from_email"))


def extracted_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.extract_persons(person_mails(spark, sf_dir))
    return out.select("mail_id", "name", "name_source", "name_confidence", "display_name", "initials", F.array_join("skills", ",").alias("skills"), "desired", "age", "nationality", "place", F.array_join("missing", ",").alias("missing"))


def reviewed_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person records of mails that no entity knows, put into their category by hand."""
    known = e._entities(spark, sf_dir).filter("source_mail_id IS NOT NULL").select(F.col("source_mail_id").alias("mail_id"))
    mails_left = extract.extraction_preview(person_mails(spark, sf_dir), [known, e._links(spark, sf_dir)])
    out = extract.force_review(extract.extract_persons(mails_left), "PERSON")
    return out.select("mail_id", "target", "needs_review", F.array_join("missing", ",").alias("missing"))


def created_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that a run over the projects' mails adds to the six tables: archived projects are known as entities, subjects of drafts are those of open entities' mails."""
    m = tables.written(project_mails(spark, sf_dir), "mails")
    status = b.projects(spark, sf_dir).select(F.col("project_id").alias("mail_id"), "status")
    states = m.join(status, "mail_id")
    known = states.select("mail_id", F.when(F.col("status") == "ARCHIVED", F.col("mail_id")).alias("entity_id"))
    prior = states.filter("status = 'DRAFT'").select("subject", "from_email", F.col("mail_id").alias("entity_id"), F.lit("2023-01-01").cast("timestamp").alias("created_at"))
    plan = dedupe.plan_extraction(m.withColumn("received_at", F.lit("2024-01-01").cast("timestamp")), known, prior)
    rows = dedupe.created_rows(plan, tables.written(extract.extract_projects(b.dealt_out(m), "1998-06-15"), "records"), "GMAIL-PRJ-", "2024-01-01")
    cells = {
        "entities": ["code", "title", "status", "source_mail_id", "created_at"], "conditions": ["unit_min", "unit_max", "upper_min", "upper_max", "start_month", "work_location", "prefecture", "remote_type", "contract", "hours_min", "hours_max"],
        "skills": ["skill_type", "skill_name"], "roles": ["role", "sort_order", "company_name"], "links": ["mail_id", "link_type"], "results": ["mail_id", "target_type", "result", "confidence"],
    }
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    each = [r.select(F.lit(name).alias("table"), F.col("target_id" if name == "results" else "entity_id").alias("entity_id"), F.concat_ws("|", *map(text, cells[name])).alias("cells")) for name, r in rows.items()]
    return reduce(DataFrame.unionByName, each)


def made_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts that customers add to those of the suppliers."""
    k, j = F.col("s_suppkey"), F.col("c_custkey")
    contacts = b.table(spark, sf_dir, "supplier").select(k.alias("company_id"), e.letters(k).alias("name"), F.concat(F.lit("p"), k.cast("string"), F.lit("@x.example")).alias("email"))
    people = b.table(spark, sf_dir, "customer").select(F.floor(j / 15).alias("company_id"), e.letters(F.floor(j / F.when(j % 2 == 0, 15).otherwise(5))).alias("name"), F.when(j % 3 == 0, F.concat(F.lit("P"), F.floor(j / 5).cast("string"), F.lit("@x.example"))).alias("email"))
    return company.find_or_create_contacts(people, contacts).select("company_id", "name", "email")


def unlinked_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, known, prior = e._planned(spark, sf_dir)
    return dedupe.unlinked_plan(m, e._entities(spark, sf_dir), e._links(spark, sf_dir), e._results(spark, sf_dir), m.select("mail_id", (F.length("body") < 400).alias("needs_review")), known, prior)


def remediated_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons (customers) whose stored names are none, and the results that their remediation adds."""
    k = F.col("c_custkey")
    people = b.table(spark, sf_dir, "customer").select(k.alias("person_id"), F.when(k % 4 == 0, "山田太郎").when(k % 4 == 1, "株式会社山田").when(k % 4 == 2, "T.Y").alias("name"), F.when(k % 10 == 0, "ARCHIVED").otherwise("AVAILABLE").alias("status"), F.when(k % 3 != 0, k).alias("source_mail_id"))
    found = dedupe.person_name_remediation(people, extract.not_a_name(F.col("name")))
    results = dedupe.name_results(found, "2024-01-01")
    return found.join(results, found["person_id"] == results["target_id"]).select("person_id", "old_name", "name", found["name_confidence"], "target_type", F.get_json_object("result", "$.name_confidence").alias("result_confidence"))


def paged_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest-first chunks of orders until so many rows were updated (the stop is the feature)."""
    rows = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "P").alias("wrong"))
    n = rows.count()
    return dedupe.keyset_chunks(rows, 50, max(1, n // 8), F.col("wrong")).select("id", "chunk", "n_updates")


def unclassified_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails and entities after all mails with an error event were set back by hand."""
    m, x = dedupe.move_to_unclassified(e._categorized(spark, sf_dir), e._entities(spark, sf_dir), e._results(spark, sf_dir))
    return m.select(F.lit("mail").alias("side"), F.col("mail_id").alias("id"), F.concat_ws(":", "category", "classified_by").alias("state")).unionByName(x.select(F.lit("entity").alias("side"), F.col("entity_id").alias("id"), F.concat_ws(":", "status", F.col("source_mail_id").cast("string")).alias("state")))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a signature below, cut before it."""
    body = F.concat("text", F.lit("\n-- \nDesk"))
    return b.table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.without_signature(body), 256).alias("body_sha"))


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times from milliseconds, or from a header's date where those can't be read."""
    ms = F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"))
    header = F.when(F.col("event_id") % 10 == 0, F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000 (UTC)")))
    return b.table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", t.epoch_time(ms, header)).cast("timestamp_ntz").alias("at"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' JSON as columns, summed by kind of event."""
    rows = tables.read_json_column(b.table(spark, sf_dir, "events"), "props", "struct<k:int>")
    return rows.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("*").alias("n"))


def declared_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table by its declared columns: open ones, counted by priority."""
    rows = tables.read_table(spark, f"{sf_dir}/orders.parquet", "o_orderkey long, o_orderstatus string, o_orderpriority string", ["o_orderkey", "o_orderpriority"], F.col("o_orderstatus") == "O")
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def written_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's table written as JSON lines and read back."""
    folder = tables.work_folder(spark, "report")
    tables.write_report({"events": b.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))}, folder)
    return spark.read.schema("event_type string, n long").json(f"{folder}/events")


def read_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as a sheet with quotes, commas and line breaks in cells, and read as an import file."""
    folder = tables.work_folder(spark, "sheet")
    k = F.col("p_partkey")
    title = F.concat(F.lit('a "'), F.col("p_name"), F.lit('", or\nb'))
    rows = b.table(spark, sf_dir, "part").select(k.cast("string").alias("id"), title.alias("案件名"), F.when(k % 3 == 0, F.col("p_brand")).alias("会社名"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)
    found = tables.read_import_csv(spark, folder)
    return found.select(F.col("id").cast("long").alias("id"), F.sha2("案件名", 256).alias("title_sha"), "会社名")


def table_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of an exported table: its kind from the headers, each row's signals, reasons and action."""
    k = F.col("p_partkey")
    cells = {"案件名": F.when(k % 11 != 0, F.col("p_name")), "業務内容": F.when(k % 13 != 0, F.concat(F.lit("work "), F.col("p_type"))), "単価": F.when(k % 5 == 0, "abc").when(k % 5 == 1, "応相談").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("万円"))), "必須スキル": F.when(k % 7 != 0, F.concat_ws("、", F.col("p_type"), F.col("p_brand"))), "開始月": F.when(k % 17 == 0, "soon").when(k % 17 == 1, "即日").otherwise("2026-07"), "注力": F.when(k % 2 == 0, "yes"), "メモ": F.when(k % 19 == 0, "a@x.example").when(k % 19 == 1, F.repeat(F.lit("x"), 200))}
    rows = b.dealt_out(b.table(spark, sf_dir, "part")).select(F.lit("table.csv").alias("source"), (k + 2).alias("row_no"), *(c.alias(n) for n, c in cells.items()), F.when(k % 23 == 0, F.array(F.lit("more"))).alias("_more"))
    out = imports.assess_table_rows(rows, "_more")
    return out.select("row_no", "detected", "action", F.array_join("reasons", ",").alias("reasons"), "coverage", "n_skills", "signals")


def person_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each two customers as persons: by name and owner, or two skills with a near price or the same availability."""
    k = F.col("c_custkey")
    n = F.floor(k / 6)
    rows = b.table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 5 != 0, e.letters(F.floor(k / 3))).alias("identity"), F.col("c_mktsegment").alias("owner"), F.array(e.letters(n), e.letters(n + 1), F.lit("Java")).alias("skill_list"), (k % 4).cast("string").alias("available"), (F.col("c_acctbal") / 500).alias("price_value"))
    return imports.db_person_duplicates(rows, rows, F.col("r_id") < F.col("e_id"))


def _import_review(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers stand for import runs, parts for their records, lines for the records' links."""
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    runs = b.table(spark, sf_dir, "supplier").select(s.alias("run_id"), b.choice(s % 3, ["CSV", "GMAIL", "MANUAL"]).alias("source_type"), F.when(s % 2 == 0, "APPLY").otherwise("DRY_RUN").alias("mode"), F.when(F.col("s_acctbal") > 0, "SUCCEEDED").otherwise("PARTIAL").alias("status"), F.date_add(F.lit("2024-01-01").cast("date"), (s % 300).cast("int")).alias("created_at"))
    records = b.table(spark, sf_dir, "part").select(p.alias("record_id"), F.floor(p / 20).alias("run_id"), F.when(F.col("p_size") > 25, "project").otherwise("person").alias("record_type"), F.when(p % 3 == 0, "NEEDS_REVIEW").otherwise("CREATED").alias("status"), F.when(p % 4 == 0, F.array(F.lit("LOW_COVERAGE"))).alias("warnings"))
    links = b.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("record_id"), F.when(F.col("l_returnflag") == "R", "DUPLICATE_OF").otherwise("CREATED_FROM").alias("link_type"))
    return runs, records, links


def import_run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All applied runs with the numbers of their records and links."""
    return imports.import_runs(*_import_review(spark, sf_dir), mode="APPLY")


def source_record_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project records to review, with warnings and a duplicate link."""
    _, records, links = _import_review(spark, sf_dir)
    return imports.source_record_list(records, links, record_type="project", link_type="DUPLICATE_OF", review_needed=True, warnings_present=True).select("record_id", "run_id", "n_links")


def row_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = imports.detect_row_type(e.import_rows(spark, sf_dir))
    return out.select("row_no", *(F.col(c).cast("int").alias(c) for c in ("project_score", "person_score")), "row_type", "type_conflict", "type_confidence")


def import_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the sheet by status and confidence, and how many have hashes of their own."""
    rows = imports.source_records(e._assessed(spark, sf_dir), "project")
    return rows.groupBy("status", F.round("confidence", 4).alias("confidence")).agg(F.count("*").alias("n"), F.count_distinct("record_hash").alias("n_hashes"))


def import_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.coverage_summary(e._assessed(spark, sf_dir))


def safe_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON with keys and texts that may not be shown, sanitised."""
    inner = F.struct(F.col("user_id").alias("user"), F.lit("a@x.example").alias("note"), F.lit("hidden").alias("token"))
    raw = F.to_json(F.struct(F.col("event_type").alias("code"), F.lit("Not safe!").alias("remark"), inner.alias("inner"), F.array(F.lit(1), F.lit(2)).alias("list"), F.lit("x").alias("email")))
    return b.table(spark, sf_dir, "events").select("event_id", reports.sanitized_json(F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(raw)).alias("shown"))


def anonymous_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by shortened ids and hashes."""
    return b.table(spark, sf_dir, "customer").select(reports.short_id(F.col("c_name")).alias("short_id"), reports.short_hash(F.col("c_name")).alias("short_hash"))


def _persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("person_id")
    return b.persons(spark, sf_dir).withColumns({"name": e.letters(k), "company_id": F.floor(k / 15), "contact_id": F.floor(k / 20), "age": (20 + k % 45).cast("int"), "skills": F.lit(""), "nationality": F.when(k % 4 == 0, "韓国").when(k % 4 == 1, "日本").otherwise("")})


def person_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rows of all persons: owners and contacts from suppliers, results from events."""
    k = F.col("s_suppkey")
    contacts = b.table(spark, sf_dir, "supplier").select(k.alias("contact_id"), e.letters(k + 1000000).alias("name"))
    results = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("person_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("result_id"), (F.col("event_type") == "error").alias("needs_review"), F.upper("event_type").alias("name_confidence"))
    return lists.person_list(_persons(spark, sf_dir).drop("skills"), b.person_skills(spark, sf_dir).filter("trim(skill_name) != ''"), e.companies(spark, sf_dir), contacts, results)


def person_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 cheapest foreign persons of an age and wish, by price (a page is the feature)."""
    found = lists.filter_persons(_persons(spark, sf_dir), exclude="building", age_from=25, age_to=60, price_from=10, foreign=True, remote=["リモート", "週2"], statuses=["AVAILABLE", "JOINED"], month_to="2001-06")
    return lists.sorted_rows(found, "price_asc", "name", "desired", "person_id").limit(50).select("person_id", "desired", "age")


def named_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 available persons by name (a page is the feature)."""
    found = lists.filter_persons(_persons(spark, sf_dir), available=True)
    return lists.sorted_rows(found, "name", "name", "desired", "person_id").limit(50).select("person_id", "name")


def searched_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects by nearly all filters of the list."""
    k = F.col("project_id")
    more = {"skills": F.lit("Java"), "price": F.col("unit_max"), "work_days": b.choice(k % 3, ["週5", "週3", "週2"]), "has_result": k % 2 == 0, "has_trade_ng": k % 7 == 0, "foreign_policy": F.when(k % 3 == 0, "NOT_ACCEPTABLE").otherwise("UNKNOWN"), "age_condition": F.when(k % 4 == 0, "50代まで").otherwise("30代"), "prefecture": F.col("place"), "created_by": F.concat(F.lit("u"), (k % 3).cast("string"))}
    found = lists.filter_projects(b.projects(spark, sf_dir).withColumns(more), exclude="2-HIGH", created_from="1996-01-01", created_to="1999-12-31", skill="java", price_from=10, price_to=110, prefecture="東京都", work_days=["週5", "週3"], trade_result=True, no_trade_ng=True, ages=["50", "60"])
    return found.select("project_id", "price")


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as landed mails, counted by day and category in a stream that ends with the table."""
    rows = _stream(spark, sf_dir).select(F.col("ts").alias("received_at"), F.upper("event_type").alias("category"))
    return _finished(spark, streams.mail_counts(rows), "counts", "complete", "day timestamp, category string, n_mails long").withColumn("day", F.col("day").cast("timestamp_ntz"))


def late_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mails that land in three runs of one stream: nine of ten, then the rest, most of it late, then one that closes the last day. By day and category: what the stream counted, what came late, and what a recount finds."""
    k = F.col("event_id")
    mails = tables.written(b.table(spark, sf_dir, "events").select(F.when(k % 10 != 0, 1).otherwise(2).alias("arrival"), F.col("ts").cast("timestamp").alias("received_at"), F.upper("event_type").alias("category")), "events")
    end = mails.agg((F.max("received_at") + F.expr("INTERVAL 30 DAYS")).alias("received_at")).select(F.lit(3).alias("arrival"), "received_at", F.lit("END").alias("category"))
    landing, sink, point = (tables.work_folder(spark, n) for n in ("landing", "counts", "counts-point"))
    for n, rows in ((1, mails), (2, mails), (3, end)):
        rows.filter(F.col("arrival") == n).write.mode("append").parquet(landing)
        stream = streams.mail_counts(spark.readStream.schema(mails.schema).parquet(landing))
        stream.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", point).trigger(availableNow=True).start().awaitTermination()
    counted = spark.read.schema("day timestamp, category string, n_mails long").parquet(sink).filter("category != 'END'").groupBy("day", "category").agg(F.sum("n_mails").alias("n_streamed"))
    of_day = lambda rows, name: rows.groupBy(F.date_trunc("day", "received_at").alias("day"), "category").agg(F.count("*").alias(name))
    late = of_day(streams.late_mails(mails), "n_late")
    out = of_day(mails, "n_recounted").join(counted, ["day", "category"], "left").join(late, ["day", "category"], "left").fillna(0, ["n_streamed", "n_late"])
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


def streamed_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as landed mails, once each, classified in a stream; counted by label afterwards."""
    none = F.lit(None).cast("string")
    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("account_id"), F.col("event_id").alias("external_id"), F.col("ts").alias("received_at"), b.choice(F.col("event_id") % 8, SUBJECTS).alias("subject"), F.lit("").alias("body"), none.alias("in_reply_to"), none.alias("references_header"))
    out = streams.ingest_mails(rows, mail_rules.WEIGHTED, mail_rules.STRONG, "60 days").select("external_id", "label")
    return _finished(spark, out, "mails", "append", "external_id long, label string").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("external_id").alias("n_mails"))


def streamed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review states kept by a stream of events."""
    names = {"view": "KEEP_SUGGESTED", "click": "REQUEST_REVIEW", "purchase": "APPROVE", "error": "REJECT"}
    action = b.lookup(F.col("event_type"), names, F.when(F.col("event_id") % 2 == 0, "ARCHIVE").otherwise("RESTORE"))
    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("suggestion_id"), "ts", "event_id", action.alias("action"))
    return _finished(spark, streams.review_states(rows), "states", "update", "suggestion_id long, status string, n_applied long")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = b.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(spark: SparkSession, rows: DataFrame, name: str, mode: str, schema: str) -> DataFrame:
    """What a stream gives once it has taken all there is; each batch is written to a folder of its own number, so a repeated batch replaces itself."""
    folder, point = tables.work_folder(spark, name), tables.work_folder(spark, f"{name}-point")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", point).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(f"{schema}, batch int").parquet(folder)
    if mode == "append":
        return found.drop("batch")
    keys = found.columns[:1] if mode == "update" else ["batch"]
    last = found.groupBy(*keys).agg(F.max("batch").alias("_last")) if mode == "update" else found.agg(F.max("batch").alias("_last"))
    return (found.join(last, keys).filter("batch = _last") if mode == "update" else found.join(F.broadcast(last), F.col("batch") == F.col("_last"))).drop("batch", "_last")  # last: one row


NAMES = ["ruled_mails", "classification_audit", "classification_changes", "quality_scores", "quality_audit", "high_risk_mails", "extracted_persons", "reviewed_persons", "created_rows", "made_contacts", "unlinked_plan", "remediated_persons", "paged_updates", "unclassified_by_hand", "signatures", "event_times", "event_props", "declared_orders", "written_reports", "read_sheets", "table_assessment", "person_duplicates", "import_run_list", "source_record_list", "row_types", "import_records", "import_coverage", "safe_props", "anonymous_events", "person_list", "person_page", "named_persons", "searched_projects", "streamed_counts", "late_counts", "streamed_mails", "streamed_states"]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


def _hits(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({column}, '{w.lower()}')::INT" for w in words) + ")"


_SIGNALS = {"project": mail_rules.PROJECT_SIGNALS, "person": mail_rules.PERSON_SIGNALS, "excluded": mail_rules.EXCLUDED_SIGNALS}
QUALITY = f"""{ORDER_MAILS}, tx AS (SELECT *, lower(subject) AS s, CASE mail_id % 3 WHEN 0 THEN lower('案件名：Java' || chr(10) || '必須スキル：Java、SQL' || chr(10) || '単価：80万円') WHEN 1 THEN '氏名：山田' || chr(10) || 'スキルシート' || chr(10) || '最寄：東京' ELSE lower(subject) END AS b FROM om),
  hs AS (SELECT *, {", ".join(f"{_hits('s', w)} AS s_{k}, {_hits('b', w)} AS b_{k}" for k, w in _SIGNALS.items())} FROM tx),
  sc AS (SELECT *, s_project + 2 * b_project AS project_score, s_person + 2 * b_person AS person_score, s_excluded + 2 * b_excluded AS excluded_score, b_project = 0 AND b_person = 0 AND (s_project > 0 OR s_person > 0) AS subject_only FROM hs)"""
#: What scores say of a mail.
_JUDGED = f"""r AS (SELECT *, b <> '' AND b <> s AS has_body, abs(project_score - person_score) AS margin, greatest(project_score, person_score) AS most, least(project_score, person_score) AS low, {_hits("b", mail_rules.PROJECT_CORE)} AS core_project, {_hits("b", mail_rules.PERSON_CORE)} AS core_person, excluded_score >= 2 AS excluded, b_project > 0 OR b_person > 0 AS body_derived FROM sc),
  f AS (SELECT *, (low >= 3 AND margin <= 1) OR (s_project > s_person AND b_person > b_project AND b_person >= 2) OR (s_person > s_project AND b_project > b_person AND b_project >= 2) AS conflict, most >= 3 OR (subject_only AND most >= 2) AS enough,
    CASE WHEN project_score > person_score THEN has_body AND (core_project = 0 OR regexp_matches(b, 'ありません|なし|実体がない|別途共有')) ELSE has_body AND core_person = 0 AND person_score < 4 END AS thin, has_body AND b_project = 0 AND b_person = 0 AND (s_project > 0 OR s_person > 0) AS weak FROM r),
  j AS (SELECT *, NOT excluded AND NOT conflict AND enough AND thin AS bare, CASE WHEN excluded THEN 'excluded' WHEN conflict OR NOT enough OR thin THEN 'other' WHEN project_score > person_score THEN 'project' ELSE 'person' END AS predicted_type FROM f)"""
_PEOPLE = f"""people AS (SELECT *, {e._letters("person_id")} AS name, person_id // 15 AS company_id, person_id // 20 AS contact_id, (20 + person_id % 45)::INT AS age, CASE person_id % 4 WHEN 0 THEN '韓国' WHEN 1 THEN '日本' ELSE '' END AS nationality FROM persons)"""


def _bucket(c: str, bounds: list[int]) -> str:
    out, low = "CASE", None
    for high in bounds:
        out += f" WHEN {c} <= {high} THEN '{high if low is None or low + 1 == high else f'{low + 1}-{high}'}'"
        low = high
    return f"{out} ELSE '{bounds[-1] + 1}+' END"


#: Metrics of an audit with one key a mail.
_AUDIT = {
    **{c: c for c in ("predicted_type", "name_source", "name_confidence")}, **{c: f"{c}::VARCHAR" for c in ("subject_only", "body_derived", "quality_review", "linked", "same_sender_subject")}, "needs_review": "'true'", "role_source": "CASE WHEN NOT project THEN 'fallback_unknown' END",
    "company_source": "CASE WHEN mail_id % 4 = 0 THEN 'from_name' ELSE 'sender_domain' END", "company_confidence": "CASE WHEN mail_id % 4 = 0 THEN 'MEDIUM' ELSE 'LOW' END", **{c: _bucket(c, [0, 2, 5, 9]) for c in ("project_score", "person_score", "excluded_score", "margin")},
    "skills": "CASE WHEN n_skills = 0 THEN '0' ELSE '1-3' END", "rejected_name": "CASE WHEN name_confidence = 'LOW' THEN name_source END", "outcome": "CASE WHEN linked OR same_sender_subject OR predicted_type IN ('other', 'excluded') THEN 'would_skip' ELSE 'would_create_for_review' END", "high_risk": "'true'",
}


def oracle_sql() -> dict[str, str]:
    ruled = [[r[i] for r in RULED] for i in range(5)]
    marks = ["-- ", "――", "-----Original Message-----", "差出人:"]
    cut = "CASE " + " ".join(f"WHEN instr(x, '{m}') > 241 THEN trim(substring(x, 1, instr(x, '{m}') - 1), ' ' || chr(10) || chr(9) || chr(13) || chr(11) || chr(12))" for m in marks) + " ELSE x END"
    people = f"""pm AS (SELECT c_custkey AS k, {_choice("n_regionkey", b.PLACES)} AS place FROM customer JOIN nation ON c_nationkey = n_nationkey),
      px AS (SELECT k AS mail_id, CASE WHEN k % 3 = 0 THEN '山田太郎' END AS name, CASE WHEN k % 3 = 1 THEN 'T.Y' END AS initials, {_choice("k % 4", ["Java,AWS", "PHP", "Python,C#,SQL", ""])} AS skills, CASE WHEN k % 7 <> 0 THEN (40 + k % 50)::INT END AS desired, (20 + k % 40)::INT AS age, CASE WHEN k % 2 = 0 THEN '日本' END AS nationality, place FROM pm),
      py AS (SELECT *, concat_ws(',', CASE WHEN name IS NULL AND initials IS NULL THEN '氏名' END, CASE WHEN skills = '' THEN 'スキル' END, CASE WHEN desired IS NULL THEN '希望単価' END) AS missing FROM px)"""
    signals = """concat_ws(',', 'unitPrice:' || CASE p_partkey % 5 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'deferred' ELSE 'parsed' END, 'upperAmount:not_provided', 'skills:' || CASE WHEN p_partkey % 7 = 0 THEN 'not_provided' ELSE 'parsed' END,
      'startMonth:' || CASE p_partkey % 17 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'deferred' ELSE 'parsed' END, 'focus:' || CASE WHEN p_partkey % 2 = 0 THEN 'parsed' ELSE 'not_provided' END)"""
    states = _states()
    return {
        "ruled_mails": f"SELECT o_orderkey AS mail_id, {_choice('o_orderkey % 8', ruled[0])} AS label, {_choice('o_orderkey % 8', ruled[1])} AS category, {_choice('o_orderkey % 8', ruled[2])}::DOUBLE AS confidence, {_choice('o_orderkey % 8', ruled[3])} AS is_excluded, {_choice('o_orderkey % 8', [REASONS.get(i) for i in range(8)])} AS exclude_reason, {_choice('o_orderkey % 8', ruled[4])} AS rules FROM orders",
        "classification_audit": f"WITH {ORDER_MAILS} SELECT lower(CASE WHEN subject = 'Re: 打ち合わせ' THEN '打ち合わせ' ELSE subject END) AS pattern, count(*) AS n_mails, count(DISTINCT from_email) AS n_domains, max(received_at) AS newest FROM om GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
        "classification_changes": f"""WITH m AS (SELECT mail_id, received_at, from_email, CASE mail_id % 3 WHEN 0 THEN 'OTHER' WHEN 1 THEN 'PROJECT_INTRO' ELSE 'NEEDS_REVIEW' END AS category, mail_id % 10 = 0 AS is_excluded, {_choice('mail_id % 8', ruled[1])} AS new FROM (WITH {ORDER_MAILS} SELECT mail_id, received_at, from_email FROM om))
          SELECT 'category' AS metric, category || ':' || CASE WHEN is_excluded THEN 'excluded' ELSE 'open' END AS key, count(*) AS n, max(received_at) AS newest FROM m GROUP BY 2 UNION ALL SELECT 'change', category || '>' || new, count(*), max(received_at) FROM m WHERE NOT is_excluded GROUP BY 2
          UNION ALL (SELECT 'sender', from_email, count(*) AS c, max(received_at) FROM m WHERE NOT is_excluded AND category <> 'PROJECT_INTRO' GROUP BY 2 ORDER BY c DESC, from_email LIMIT 30)""",
        "quality_scores": f"WITH {QUALITY} SELECT mail_id, project_score, person_score, excluded_score, abs(project_score - person_score) AS margin, subject_only, CASE WHEN category = 'PERSON_INTRO' AND project_score > person_score AND project_score >= 3 THEN 'PERSON_SUBJECT_LOOKS_LIKE_PROJECT' WHEN category = 'PROJECT_INTRO' AND person_score > project_score AND person_score >= 3 THEN 'PROJECT_SUBJECT_LOOKS_LIKE_PERSON' END AS mismatch FROM sc",
        "quality_audit": f"""WITH {QUALITY}, {_JUDGED}, {e.ENTITIES},
          g AS (SELECT *, mail_id % 2 = 0 AS project, mail_id % 3 AS t, mail_id % 8 AS u, mail_id IN (SELECT source_mail_id FROM entities WHERE source_mail_id IS NOT NULL) AS linked, count(*) OVER (PARTITION BY mail_id // 9, subject) > 1 AS same_sender_subject FROM j),
          w AS (SELECT *, list_filter([CASE WHEN subject_only THEN 'SUBJECT_ONLY_CLASSIFICATION' END, CASE WHEN weak OR bare THEN 'BODY_SIGNAL_WEAK' END, CASE WHEN s_project > s_person AND b_person > b_project THEN 'PERSON_SUBJECT_LOOKS_LIKE_PROJECT' END, CASE WHEN s_person > s_project AND b_project > b_person THEN 'PROJECT_SUBJECT_LOOKS_LIKE_PERSON' END,
            CASE WHEN conflict THEN 'CLASSIFICATION_SIGNAL_CONFLICT' END, CASE WHEN excluded THEN 'EXCLUDED_PATTERN_MATCHED' END, CASE WHEN excluded AND regexp_matches(s || b, 'メルマガ|ニュースレター') THEN 'NEWSLETTER_LIKELY' END], lambda x: x IS NOT NULL) AS warnings, conflict OR subject_only OR weak OR bare AS quality_review,
            CASE WHEN t = 0 THEN 2 WHEN u = 0 AND project THEN 1 ELSE 0 END AS n_skills, CASE WHEN NOT project THEN CASE WHEN t = 1 THEN 'body_labeled_field' WHEN u = 1 THEN 'signature_candidate' ELSE 'subject_candidate' END END AS name_source,
            CASE WHEN NOT project THEN CASE WHEN t = 1 THEN 'HIGH' WHEN u = 5 THEN 'MEDIUM' ELSE 'LOW' END END AS name_confidence FROM g),
          x AS (SELECT *, list_filter(CASE WHEN project THEN [CASE WHEN t <> 0 AND u <> 0 THEN 'PROJECT_REQUIRED_FIELD_MISSING:単価' END, CASE WHEN t <> 1 THEN 'PROJECT_REQUIRED_FIELD_MISSING:作業場所' END, 'PROJECT_REQUIRED_FIELD_MISSING:開始月', CASE WHEN n_skills = 0 THEN 'PROJECT_REQUIRED_FIELD_MISSING:スキル' END,
              CASE WHEN len(warnings) > 0 THEN 'PROJECT_CLASSIFICATION_NEEDS_REVIEW' END, CASE WHEN subject_only THEN 'PROJECT_SUBJECT_ONLY_EXTRACTION' END, CASE WHEN NOT body_derived THEN 'PROJECT_BODY_WEAK' END]
            ELSE list_concat([CASE WHEN name_confidence = 'LOW' THEN 'PERSON_NAME_LOW_CONFIDENCE' END, CASE WHEN name_confidence = 'LOW' AND u = 1 THEN 'PERSON_NAME_REJECTED_COMPANY_OR_SIGNATURE' END, CASE WHEN name_confidence = 'LOW' AND u <> 1 THEN 'PERSON_NAME_FROM_SUBJECT_REJECTED' END, CASE WHEN name_confidence = 'LOW' AND u <> 1 THEN 'PERSON_NAME_REJECTED_SUBJECT_LIKE' END, 'PERSON_REQUIRED_FIELDS_MISSING'], warnings) END, lambda x: x IS NOT NULL) AS reasons FROM w),
          p AS (SELECT unnest([{", ".join(f"{{'m': '{m}', 'v': {v}}}" for m, v in _AUDIT.items())}]) AS kv FROM x UNION ALL SELECT {{'m': 'warning', 'v': unnest(warnings)}} FROM x UNION ALL SELECT {{'m': 'reason', 'v': unnest(reasons)}} FROM x)
          SELECT kv.m AS metric, kv.v AS key, count(*) AS n FROM p WHERE kv.v IS NOT NULL GROUP BY 1, 2""",
        "high_risk_mails": f"WITH {QUALITY}, {_JUDGED} SELECT mail_id FROM j WHERE excluded OR conflict OR NOT enough OR bare OR subject_only OR weak ORDER BY mail_id LIMIT 20",
        "extracted_persons": f"""WITH {people} SELECT mail_id, name, CASE WHEN name IS NOT NULL THEN 'body_labeled_field' ELSE 'subject_candidate' END AS name_source, CASE WHEN name IS NOT NULL THEN 'HIGH' ELSE 'LOW' END AS name_confidence,
          coalesce(name, initials, '氏名未取得（GMAIL-' || substring(mail_id::VARCHAR, 1, 8) || '）') AS display_name, initials, skills, desired, age, nationality, place, missing FROM py""",
        "reviewed_persons": f"""WITH {people}, {e.ENTITIES}, {e.LINKS} SELECT mail_id, 'PERSON' AS target, true AS needs_review, concat_ws(',', nullif(missing, ''), 'manual_classification', CASE WHEN name IS NULL THEN 'PERSON_EXTRACTION_AMBIGUOUS' END) AS missing FROM py
          WHERE mail_id NOT IN (SELECT source_mail_id FROM entities WHERE source_mail_id IS NOT NULL) AND mail_id NOT IN (SELECT mail_id FROM links)""",
        "created_rows": f"""WITH {b.SQL}, ep AS ({EXTRACTED}), c AS (SELECT ep.*, sha256('GMAIL-PRJ-' || mail_id::VARCHAR) AS entity_id FROM ep JOIN projects p ON mail_id = project_id WHERE p.status = 'OPEN')
          SELECT 'entities' AS table, entity_id, concat_ws('|', 'GMAIL-PRJ-' || substring(mail_id::VARCHAR, 1, 8), title, CASE WHEN missing <> '' THEN 'DRAFT' ELSE 'OPEN' END, mail_id, '2024-01-01 00:00:00') AS cells FROM c
          UNION ALL SELECT 'conditions', entity_id, concat_ws('|', {", ".join(f"coalesce({x}::VARCHAR, '-')" for x in ("unit_min", "unit_max", "upper_min", "upper_max", "start", "place", "prefecture", "remote", "contract", "hours_min", "hours_max"))}) FROM c
          UNION ALL SELECT 'skills', entity_id, kind || '|' || skill FROM (SELECT entity_id, 'REQUIRED' AS kind, unnest(string_split(required_skills, ',')) AS skill FROM c UNION ALL SELECT entity_id, 'PREFERRED', unnest(string_split(preferred_skills, ',')) FROM c UNION ALL SELECT entity_id, 'USED_TECHNOLOGY', unnest(string_split(used_skills, ',')) FROM c) WHERE skill <> ''
          UNION ALL SELECT 'roles', entity_id, 'UPPER|0|' || company FROM c WHERE company IS NOT NULL UNION ALL SELECT 'links', entity_id, mail_id || '|EXTRACTED' FROM c
          UNION ALL SELECT 'results', entity_id, mail_id || '|PROJECT|{{"title":"' || title || '","review_reasons":[' || array_to_string(list_transform(list_filter(string_split(missing, ','), lambda x: x <> ''), lambda x: '"PROJECT_REQUIRED_FIELD_MISSING:' || x || '"'), ',') || '],"needs_review":' || (missing <> '')::VARCHAR || '}}|' || printf('%.4f', confidence) FROM c""",
        "made_contacts": f"""WITH p AS (SELECT c_custkey // 15 AS company_id, CASE WHEN c_custkey % 2 = 0 THEN {e._letters("c_custkey // 15")} ELSE {e._letters("c_custkey // 5")} END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'P' || (c_custkey // 5)::VARCHAR || '@x.example' END AS email FROM customer),
          c AS (SELECT s_suppkey AS company_id, {_letters_of_supplier()} AS name, 'p' || s_suppkey::VARCHAR || '@x.example' AS email FROM supplier),
          n AS (SELECT *, coalesce(lower(email), name) AS k FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.company_id = p.company_id AND (c.name IN (p.name, coalesce(lower(p.email), p.name)) OR c.email = coalesce(lower(p.email), p.name))))
          SELECT company_id, min({{'n': name, 'e': email}}).n AS name, min({{'n': name, 'e': email}}).e AS email FROM n GROUP BY company_id, k""",
        "unlinked_plan": f"""WITH {e.ENTITIES}, {e.LINKS}, {e.CATEGORIZED}, {e.KNOWN},
          k AS (SELECT cm.*, nullif(lower(trim(regexp_replace(regexp_replace(subject, '^\\s*(re|fw|fwd)\\s*:\\s*', '', 'i'), '\\s+', ' ', 'g'))), '') AS sub, lang || '.example.com' AS snd, CASE WHEN category = 'PROJECT_INTRO' THEN 'PROJECT' ELSE 'PERSON' END AS target FROM cm),
          pr AS (SELECT sub, snd, arg_min(e.entity_id, {{'a': e.created_at, 'b': e.entity_id}}) AS same FROM entities e JOIN k ON e.source_mail_id = k.mail_id WHERE e.status <> 'ARCHIVED' AND sub IS NOT NULL GROUP BY 1, 2),
          j AS (SELECT k.*, same, way, EXISTS (SELECT 1 FROM entities x WHERE x.source_mail_id = k.mail_id AND x.entity_type = k.target) AS own, EXISTS (SELECT 1 FROM entities x WHERE x.source_mail_id = k.mail_id AND x.entity_type <> k.target) AS other,
            mail_id IN (SELECT mail_id FROM links WHERE link_type = 'EXTRACTED') AS linked, EXISTS (SELECT 1 FROM results x WHERE x.mail_id = k.mail_id AND x.target = k.target) AS read FROM k JOIN kn USING (mail_id) LEFT JOIN pr ON k.sub = pr.sub AND k.snd = pr.snd WHERE category <> 'OTHER' AND NOT is_excluded),
          r AS (SELECT *, CASE WHEN own THEN 'source_' || lower(target) || '_exists' WHEN other THEN 'cross_entity_' || CASE target WHEN 'PROJECT' THEN 'person' ELSE 'project' END || '_source_exists' WHEN linked THEN 'target_mail_entity_link_exists' WHEN read THEN 'target_extraction_result_exists' ELSE way END AS why FROM j)
          SELECT mail_id, target, CASE WHEN why IS NULL THEN 'would_create' ELSE 'skip' END AS action, coalesce(why, CASE WHEN length(body) < 400 THEN 'needs_review' ELSE 'ok' END) AS reason, same AS duplicate_entity FROM r""",
        "remediated_persons": """SELECT c_custkey AS person_id, CASE c_custkey % 4 WHEN 1 THEN '株式会社山田' WHEN 2 THEN 'T.Y' END AS old_name, NULL::VARCHAR AS name, 'LOW' AS name_confidence, 'PERSON' AS target_type, 'LOW' AS result_confidence
          FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 4 <> 0""",
        "paged_updates": """WITH o AS (SELECT o_orderkey AS id, row_number() OVER w AS n, sum((o_orderstatus = 'P')::INT) OVER w AS u, (o_orderstatus = 'P')::INT AS x FROM orders WINDOW w AS (ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING))
          SELECT id, ((n - 1) // 50)::INT AS chunk, u::BIGINT AS n_updates FROM o WHERE u - x < greatest(1, (SELECT count(*) FROM orders) // 8)""",
        "unclassified_by_hand": f"""WITH {e.ENTITIES}, {e.LINKS}, {e.CATEGORIZED} SELECT 'mail' AS side, mail_id AS id, CASE WHEN mail_id IN (SELECT mail_id FROM results) THEN 'NEEDS_REVIEW:MANUAL' ELSE concat_ws(':', category, classified_by) END AS state FROM cm
          UNION ALL SELECT 'entity', entity_id, CASE WHEN source_mail_id IN (SELECT mail_id FROM results) THEN 'ARCHIVED' ELSE concat_ws(':', status, source_mail_id::VARCHAR) END FROM entities""",
        "signatures": f"SELECT doc_id, sha256({cut}) AS body_sha FROM (SELECT doc_id, text || chr(10) || '-- ' || chr(10) || 'Desk' AS x FROM documents)",
        "event_times": "SELECT event_id, CASE WHEN event_id % 5 <> 0 OR event_id % 10 = 0 THEN date_trunc('second', ts) END AS at FROM events",
        "event_props": "SELECT event_type, sum(json_extract(props, '$.k')::INT)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1",
        "declared_orders": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1",
        "written_reports": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
        "read_sheets": "SELECT p_partkey AS id, sha256('a \"' || p_name || '\", or' || chr(10) || 'b') AS title_sha, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS 会社名 FROM part",
        "table_assessment": f"""WITH r AS (SELECT *, concat_ws(',', CASE WHEN p_partkey % 23 = 0 THEN 'ROW_TOO_WIDE' END, CASE WHEN p_partkey % 19 = 0 THEN 'SENSITIVE_VALUE' END, CASE WHEN p_partkey % 19 = 1 THEN 'LONG_TEXT' END, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_partkey % 7 = 0 THEN 'MISSING_REQUIRED_FIELD' END, CASE WHEN p_partkey % 1001 = 0 AND p_partkey % 2 = 1 THEN 'LOW_COVERAGE' END,
            CASE WHEN p_partkey % 19 < 2 THEN 'UNMAPPED_VALUE' END, CASE WHEN p_partkey % 5 = 0 THEN 'INVALID_AMOUNT' END, CASE WHEN p_partkey % 17 = 0 THEN 'INVALID_DATE' END) AS reasons FROM part)
          SELECT p_partkey + 2 AS row_no, 'project' AS detected, CASE WHEN p_partkey % 23 = 0 THEN 'would_fail' WHEN reasons <> '' THEN 'would_need_review' ELSE 'would_create' END AS action, reasons,
          round((2 + (p_partkey % 11 <> 0)::INT + (p_partkey % 13 <> 0)::INT + (p_partkey % 7 <> 0)::INT + (p_partkey % 2 = 0)::INT) / 6, 4)::DOUBLE AS coverage, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 2 END AS n_skills, {signals} AS signals FROM r""",
        "person_duplicates": f"""WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN {e._letters("c_custkey // 3")} ELSE '' END AS n, c_mktsegment AS o, [{e._letters("c_custkey // 6")}, {e._letters("c_custkey // 6 + 1")}, 'java'] AS k, c_custkey % 4 AS av, c_acctbal / 500 AS pr FROM customer),
          j AS (SELECT a.id, b.id AS existing_id, a.n = b.n AND a.n <> '' AND a.o = b.o AS same, len(list_intersect(a.k, b.k)) >= 2 AS two, a.av = b.av AS av, abs(a.pr - b.pr) <= 5 AS near FROM r a JOIN r b ON a.id < b.id)
          SELECT id, existing_id, CASE WHEN same OR (two AND av AND near) THEN 'strong' ELSE 'weak' END AS strength FROM j WHERE same OR (two AND (av OR near))""",
        "import_run_list": f"""WITH r AS (SELECT s_suppkey AS run_id, {_choice("s_suppkey % 3", ["CSV", "GMAIL", "MANUAL"])} AS source_type, CASE WHEN s_suppkey % 2 = 0 THEN 'APPLY' ELSE 'DRY_RUN' END AS mode, CASE WHEN s_acctbal > 0 THEN 'SUCCEEDED' ELSE 'PARTIAL' END AS status, (DATE '2024-01-01' + (s_suppkey % 300)::INT)::DATE AS created_at FROM supplier),
          l AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT p_partkey // 20 AS run_id, count(*) AS a, sum(coalesce(n, 0)) AS b FROM part LEFT JOIN l ON p_partkey = l_partkey GROUP BY 1)
          SELECT r.*, coalesce(a, 0)::BIGINT AS n_records, coalesce(b, 0)::BIGINT AS n_links FROM r LEFT JOIN c USING (run_id) WHERE mode = 'APPLY'""",
        "source_record_list": """SELECT p_partkey AS record_id, p_partkey // 20 AS run_id, count(*) AS n_links FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size > 25 AND p_partkey % 3 = 0 AND p_partkey % 4 = 0 GROUP BY 1, 2 HAVING count(*) FILTER (l_returnflag = 'R') > 0""",
        "row_types": """WITH s AS (SELECT p_partkey + 2 AS row_no, 7 + (p_partkey % 11 <> 0)::INT + 1 + (p_partkey % 13 <> 0)::INT + (p_partkey % 7 <> 0)::INT + 2 AS project_score, 0 AS person_score FROM part)
          SELECT row_no, project_score, person_score, 'project' AS row_type, false AS type_conflict, 1.0::DOUBLE AS type_confidence FROM s""",
        "import_records": f"WITH {e._SHEET} SELECT CASE WHEN warnings <> '' THEN 'would_need_review' ELSE 'would_create' END AS status, CASE WHEN same_rows > 1 THEN 0.95 ELSE greatest(0.1, coverage) END::DOUBLE AS confidence, count(*) AS n, count(*) AS n_hashes FROM sheeted GROUP BY 1, 2",
        "import_coverage": f"WITH {e._SHEET} SELECT 'sheet.csv' AS source, count(*) AS n_rows, round(avg(coverage), 4)::DOUBLE AS average_coverage, count(*) FILTER (coverage < 0.5) AS n_weak, count(*) FILTER (warnings = '') AS n_clean FROM sheeted",
        "safe_props": """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN '{"code":"' || event_type || '","remark":"[redacted]","inner":{"user":' || user_id::VARCHAR || ',"note":"[redacted]"},"list":[1,2]}' END AS shown FROM events""",
        "anonymous_events": "SELECT substring(c_name, 1, 8) AS short_id, substring(sha256(c_name), 1, 12) AS short_hash FROM customer",
        "person_list": f"""WITH {b.SQL}, {e.COMPANIES}, {_PEOPLE}, k AS (SELECT person_id, string_agg(DISTINCT skill_name, ' / ' ORDER BY skill_name) AS skills FROM person_skills WHERE trim(skill_name) <> '' GROUP BY 1),
          r AS (SELECT user_id AS person_id, arg_max({{'n': event_type = 'error', 'c': upper(event_type)}}, {{'a': ts, 'b': event_id}}) AS r FROM events GROUP BY 1)
          SELECT person_id, p.name, status, coalesce(c.name, '未入力') AS company, CASE WHEN s_suppkey IS NULL THEN '未入力' ELSE {e._letters("s_suppkey + 1000000")} END AS contact, CASE WHEN coalesce(desired, 0) <> 0 THEN desired::VARCHAR || '万円' ELSE '未定' END AS price_text, coalesce(desired, 0) AS price_value,
          coalesce(strftime(available, '%Y-%m-%d'), '未入力') AS available_text, coalesce(skills, '未入力') AS skills, coalesce(trade_status = 'OK', false) AS has_result, coalesce(trade_status IN ('NG', 'SUSPENDED'), false) AS has_trade_ng, coalesce(r.n, false) AS needs_review, coalesce(r.c, '') AS name_confidence
          FROM people p LEFT JOIN k USING (person_id) LEFT JOIN companies c USING (company_id) LEFT JOIN supplier ON contact_id = s_suppkey LEFT JOIN r USING (person_id)""",
        "person_page": f"""WITH {b.SQL}, {_PEOPLE} SELECT person_id, desired, age FROM people WHERE NOT contains(lower(name || ' ' || place || ' ' || summary), 'building') AND age BETWEEN 25 AND 60 AND desired >= 10 AND nationality = '韓国' AND (contains(remote_wish, 'リモート') OR contains(remote_wish, '週2'))
          AND status IN ('AVAILABLE', 'JOINED') AND (available IS NULL OR strftime(available, '%Y-%m') <= '2001-06') ORDER BY desired, person_id LIMIT 50""",
        "named_persons": f"WITH {b.SQL}, {_PEOPLE} SELECT person_id, name FROM people WHERE status = 'AVAILABLE' ORDER BY name, person_id LIMIT 50",
        "searched_projects": f"""WITH {b.SQL} SELECT project_id, unit_max AS price FROM projects WHERE NOT contains(lower(title), '2-high') AND created_at >= '1996-01-01' AND created_at < '2000-01-01' AND unit_max BETWEEN 10 AND 110 AND place = '東京都' AND project_id % 3 < 2 AND project_id % 2 = 0 AND project_id % 7 <> 0 AND project_id % 4 = 0""",
        "streamed_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, upper(event_type) AS category, count(*) AS n_mails FROM events GROUP BY 1, 2",
        "late_counts": """WITH m AS (SELECT event_id % 10 = 0 AS second, ts, date_trunc('day', ts)::TIMESTAMP AS day, upper(event_type) AS category FROM events), w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM m WHERE NOT second),
          l AS (SELECT day, category, second AND day + INTERVAL 1 DAY <= mark AS late FROM m, w) SELECT day, category, count(*) AS n_recounted, count(*) FILTER (NOT late) AS n_streamed, count(*) FILTER (late) AS n_late FROM l GROUP BY 1, 2""",
        "streamed_mails": f"SELECT {_choice('event_id % 8', ruled[0])} AS label, count(*) AS n, count(*) AS n_mails FROM events GROUP BY 1",
        "streamed_states": states,
    }


def _letters_of_supplier() -> str:
    return e._letters("s_suppkey")


def _states() -> str:
    from .matching import oracle_sql as matching

    return f"SELECT suggestion_id, status, n_applied::BIGINT AS n_applied FROM ({matching()['review_state']})"
