"""Queries on companies, duplicates, imports, lists and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import company, dedupe, imports, lists, reports
from ..plans import binding as b
from ..sources import tables
from .mails import MAILS, mails


def letters(k):
    """Ten letters made of a number, as names stand in for those of companies and people."""
    return F.translate(F.substring(F.md5(k.cast("string").cast("binary")), 1, 10), "0123456789", "ghijklmnop")


def _letters(k: str) -> str:
    return f"translate(substring(md5(({k})::VARCHAR), 1, 10), '0123456789', 'ghijklmnop')"


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand for companies; some names have legal words, two companies share a domain."""
    k = F.col("s_suppkey")
    return b.table(spark, sf_dir, "supplier").select(k.alias("company_id"), F.concat(letters(k), F.when(k % 4 == 0, " Co., Ltd.").otherwise("")).alias("name"), F.when(k % 3 != 0, F.concat(F.lit("mail"), F.floor(k / 2).cast("string"), F.lit(".example-corp.com"))).alias("domain"), F.when(k % 5 == 0, "NG").when(k % 5 < 3, "OK").otherwise("UNKNOWN").alias("trade_status"))


COMPANIES = f"""companies AS (SELECT s_suppkey AS company_id, {_letters("s_suppkey")} || CASE WHEN s_suppkey % 4 = 0 THEN ' Co., Ltd.' ELSE '' END AS name,
  CASE WHEN s_suppkey % 3 <> 0 THEN 'mail' || (s_suppkey // 2)::VARCHAR || '.example-corp.com' END AS domain,
  CASE WHEN s_suppkey % 5 = 0 THEN 'NG' WHEN s_suppkey % 5 < 3 THEN 'OK' ELSE 'UNKNOWN' END AS trade_status FROM supplier)"""


def customer_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for senders: with a company's domain, a free-mail domain, another domain, a company's name as label, or a company's name in their own name or signature."""
    k = F.col("c_custkey")
    domain = F.when(k % 5 == 0, F.concat(F.lit("a.mail"), F.floor(k / 25).cast("string"), F.lit(".example-corp.com"))).when(k % 5 == 1, "gmail.com").when(k % 5 == 2, F.concat(F.lit("big-desk"), (k % 10).cast("string"), F.lit(".example.jp")))
    name = F.when(k % 5 == 3, F.concat(letters(F.floor(k / 15)), F.lit(" desk"))).when(k % 10 == 4, F.concat(letters(k + 5000000), F.lit(" Systems | Taro Yamada")))
    signature = F.when(k % 10 == 9, F.concat(F.lit("Taro\n"), letters(k + 6000000), F.lit(" Holdings\ntel 03-1234-5678")))
    return b.dealt_out(b.table(spark, sf_dir, "customer")).select(k.alias("mail_id"), F.concat(F.lit("x@"), domain).alias("from_email"), name.alias("from_name"), F.when(k % 5 == 3, F.concat(letters(F.floor(k / 15)), F.lit(" KK"))).alias("label"), signature.alias("signature"))


CUSTOMER_MAILS = f"""cmail AS (SELECT c_custkey AS mail_id, CASE c_custkey % 5 WHEN 0 THEN 'a.mail' || (c_custkey // 25)::VARCHAR || '.example-corp.com' WHEN 1 THEN 'gmail.com' WHEN 2 THEN 'big-desk' || (c_custkey % 10)::VARCHAR || '.example.jp' END AS domain,
  CASE WHEN c_custkey % 5 = 3 THEN {_letters("c_custkey // 15")} || ' desk' WHEN c_custkey % 10 = 4 THEN {_letters("c_custkey + 5000000")} || ' Systems | Taro Yamada' END AS from_name,
  CASE WHEN c_custkey % 5 = 3 THEN {_letters("c_custkey // 15")} || ' KK' END AS label, CASE WHEN c_custkey % 10 = 9 THEN 'Taro' || chr(10) || {_letters("c_custkey + 6000000")} || ' Holdings' || chr(10) || 'tel 03-1234-5678' END AS signature FROM customer)"""


def inferred_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = companies(spark, sf_dir)
    out = company.auto_apply(company.infer_company(customer_mails(spark, sf_dir), c, c.select("company_id", F.col("name").alias("alias"))))
    return out.select("mail_id", "company_id", "company_name", "source", "confidence", "score", "eligible")


def sender_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.sender_company(customer_mails(spark, sf_dir), companies(spark, sf_dir))


def contact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best contacts (of suppliers) for each of the customers (a top-k report): exact, close and contained names, addresses, domains."""
    k = F.col("s_suppkey")
    domain = F.concat(F.lit("mail"), F.floor(k / 2).cast("string"), F.lit(".example-corp.com"))
    person = F.concat_ws(" ", letters(k + 1000000), letters(k + 2000000))
    contacts = b.table(spark, sf_dir, "supplier").select(k.alias("contact_id"), letters(k).alias("company"), domain.alias("domain"), F.concat(F.lit("p"), k.cast("string"), F.lit("@"), domain).alias("email"), person.alias("contact"))
    more = b.table(spark, sf_dir, "supplier").filter(k % 3 == 0).select(k.alias("contact_id"), letters(k).alias("company"), domain.alias("domain"), F.concat(F.lit("q"), k.cast("string"), F.lit("@"), domain).alias("email"), F.concat_ws(" ", letters(k + 2000000), letters(k + 1000000)).alias("contact"))
    contacts = contacts.unionByName(more)  # every third contact has a second row, of another address and turned name
    j = F.col("c_custkey")
    n = F.floor(j / 15)
    name = F.when(j % 6 == 0, F.concat(F.substring(letters(n), 1, 9), F.lit("z"))).when(j % 8 == 2, F.concat(letters(n), F.lit("japan"))).when(j % 2 == 0, letters(n))
    mail = F.when(j % 3 == 0, F.concat(F.lit("p"), F.floor(j / 12).cast("string"), F.lit("@mail"), F.floor(j / 24).cast("string"), F.lit(".example-corp.com")))
    who = F.when(j % 5 == 0, F.concat_ws(" ", letters(n + 2000000), letters(n + 1000000))).when(j % 5 == 1, F.concat_ws(" ", letters(n + 1000000), letters(n + 2000000))).when(j % 5 == 2, F.concat_ws(" ", letters(n + 1000000), F.concat(F.substring(letters(n + 2000000), 1, 9), F.lit("z"))))
    return company.contact_candidates(b.dealt_out(b.table(spark, sf_dir, "customer")).select(j.alias("entity_id"), name.alias("company"), mail.alias("email"), who.alias("contact")), contacts, 3)


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for entities: every fourth has a source mail (a document of even number, so some mails have several), others a code made from a mail's number."""
    k = F.col("o_orderkey")
    code = F.when(k % 4 == 1, F.floor(k / 45) * 3).otherwise(-k)
    return b.table(spark, sf_dir, "orders").select(k.alias("entity_id"), k.alias("id"), F.when(k % 4 == 0, F.floor(k / 30) * 2).alias("source_mail_id"), F.concat(F.lit("GMAIL-PRJ-"), code.cast("string")).alias("code"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "ARCHIVED").otherwise("OPEN").alias("status"), F.when(k % 2 == 0, "PROJECT").otherwise("PERSON").alias("entity_type"))


ENTITIES = """entities AS (SELECT o_orderkey AS entity_id, o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey // 30 * 2 END AS source_mail_id, 'GMAIL-PRJ-' || (CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey // 45 * 3 ELSE -o_orderkey END)::VARCHAR AS code, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN 'ARCHIVED' ELSE 'OPEN' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'PROJECT' ELSE 'PERSON' END AS entity_type FROM orders)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for links between the order and the mail of three times the part's number."""
    rows = b.table(spark, sf_dir, "lineitem").join(b.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select((F.col("l_partkey") * 3).alias("mail_id"), F.col("l_orderkey").alias("entity_id"), F.when(F.col("l_returnflag") == "R", "REVIEW_CANDIDATE").otherwise("EXTRACTED").alias("link_type"), F.col("o_orderdate").alias("created_at"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for extraction results of the mail of five times their number."""
    rows = b.table(spark, sf_dir, "events")
    return rows.select((F.col("event_id") * 5).alias("mail_id"), F.col("user_id").alias("entity_id"), F.col("ts").alias("created_at"), F.when(F.col("value") > 50, "PROJECT").otherwise("PERSON").alias("target"), F.when(F.col("event_type") == "error", "NEEDS_REVIEW").otherwise("AUTO").alias("review_status"))


LINKS = """links AS (SELECT l_partkey * 3 AS mail_id, l_orderkey AS entity_id, CASE WHEN l_returnflag = 'R' THEN 'REVIEW_CANDIDATE' ELSE 'EXTRACTED' END AS link_type, o_orderdate AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
results AS (SELECT event_id * 5 AS mail_id, user_id AS entity_id, ts AS created_at, CASE WHEN value > 50 THEN 'PROJECT' ELSE 'PERSON' END AS target, CASE WHEN event_type = 'error' THEN 'NEEDS_REVIEW' ELSE 'AUTO' END AS review_status FROM events)"""


def _categorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("mail_id")
    return mails(spark, sf_dir).withColumns({"category": F.when(k % 3 == 0, "PROJECT_INTRO").when(k % 3 == 1, "PERSON_INTRO").otherwise("OTHER"), "is_excluded": k % 10 == 0})


CATEGORIZED = f"{MAILS}, cm AS (SELECT *, CASE mail_id % 3 WHEN 0 THEN 'PROJECT_INTRO' WHEN 1 THEN 'PERSON_INTRO' ELSE 'OTHER' END AS category, mail_id % 10 = 0 AS is_excluded FROM mails)"


def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.duplicate_rows(_entities(spark, sf_dir), "source_mail_id", "entity_type").select("id", "source_mail_id", "entity_type", "n_rows", "row_no", "keep")


def category_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.category_mismatches(_entities(spark, sf_dir), _categorized(spark, sf_dir), "PROJECT_INTRO").select("entity_id", "source_mail_id", "reason")


def unlinked_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _entities(spark, sf_dir).filter("source_mail_id IS NOT NULL").select(F.col("source_mail_id").alias("mail_id"))
    return dedupe.unlinked_mails(_categorized(spark, sf_dir), links).select("mail_id", "category")


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mails with senders by language, what is known of them, and the mails of open entities."""
    m = _categorized(spark, sf_dir).withColumn("from_email", F.concat(F.lit("x@"), F.col("lang"), F.lit(".example.com")))
    e = _entities(spark, sf_dir)
    known = dedupe.resolve_existing(m, e, _links(spark, sf_dir), _results(spark, sf_dir), "GMAIL-PRJ-")
    open_ = e.filter("status != 'ARCHIVED'").select(F.col("source_mail_id").alias("mail_id"), "entity_id", "created_at")
    return m, known, open_.join(m.select("mail_id", "subject", "from_email"), "mail_id").drop("mail_id")


def extraction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan of a run over all mails: known by source mail, link, result or code, or by subject and sender of open entities' mails."""
    return dedupe.plan_extraction(*_planned(spark, sf_dir))


def resolved_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of each mail and how it is known."""
    return _planned(spark, sf_dir)[1]


def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for rows of a project sheet with Japanese headers."""
    k = F.col("p_partkey")
    return b.table(spark, sf_dir, "part").select(F.lit("sheet.csv").alias("source"), (k + 2).alias("row_no"), F.when(k % 11 != 0, F.col("p_name")).alias("案件名"), F.col("p_brand").alias("会社名"), F.when(k % 13 != 0, F.concat(F.lit("work "), F.col("p_type"))).alias("作業内容"), F.when(k % 7 != 0, F.concat_ws("、", F.col("p_type"), F.col("p_brand"))).alias("必須スキル"), F.when(k % 5 == 0, "abc").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("万円"))).alias("単価"), F.when(k % 17 == 0, "soon").otherwise("2026-07").alias("開始月"), F.lit("").alias("勤務地"), F.lit("x").alias("未使用列"))


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.source_duplicates(imports.assess_rows(imports.mapped(import_rows(spark, sf_dir), imports.PROJECT_HEADERS), "project"))


def import_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _assessed(spark, sf_dir)
    return out.select("row_no", "title", F.size("skill_list").alias("n_skills"), "coverage", F.array_join("warnings", ",").alias("warnings"), imports.finalize_action(F.col("action"), F.col("same_rows") > 1).alias("action"), F.col("same_rows").cast("long").alias("same_rows"))


def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.import_summary(_assessed(spark, sf_dir), "project")


def import_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each two parts, the later against the earlier: by title and company, or two skills with a near price or the place."""
    p = b.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = p.select(k.alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.array(F.col("p_type"), F.split("p_name", " ")[0]).alias("skill_list"), F.concat(F.lit("p"), (k % 40).cast("string")).alias("place"), F.col("p_size").cast("double").alias("price_value"))
    return imports.db_duplicates(rows, rows, F.col("r_id") < F.col("e_id"))


def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.field_coverage(imports.mapped(import_rows(spark, sf_dir), imports.PROJECT_HEADERS), list(imports.PROJECT_HEADERS))


def merged_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of all documents (each twice) merged into a table of those with a label, bodies refreshed."""
    m = mails(spark, sf_dir).select(F.lit(1).alias("account_id"), F.col("mail_id").alias("external_id"), F.length("body").alias("n_body"), F.lit("OTHER").alias("category"))
    known = m.join(b.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("external_id")).distinct(), "external_id", "left_semi").withColumns({"n_body": F.lit(0), "category": F.lit("PROJECT_INTRO")})
    return tables.merge_batch(known, m.unionByName(m), ["account_id", "external_id"], ["n_body"], {"category": F.lit("NEEDS_REVIEW")})


def appended_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an append of all entities' links to a table that has those of archived ones."""
    e = _entities(spark, sf_dir).filter("source_mail_id IS NOT NULL")
    links = e.select("source_mail_id", "entity_type")
    _, counts = tables.append_if_absent(e.filter("status = 'ARCHIVED'").select("source_mail_id", "entity_type"), links, ["source_mail_id", "entity_type"])
    return counts


def project_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rows of all projects with roles from suppliers and results from events."""
    p, k = b.projects(spark, sf_dir), F.col("project_id")
    parts = (("END_USER", 3), ("PRIME", 7), ("UPPER", 11))
    each = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(i).alias("sort_order"), ((k * m) % F.col("_n")).alias("company_id")) for i, (r, m) in enumerate(parts)))
    n = b.table(spark, sf_dir, "supplier").agg(F.count("*").alias("_n"))
    roles = p.join(F.broadcast(n)).select("project_id", F.explode(each).alias("x")).select("project_id", "x.role", "x.sort_order", "x.company_id", (F.col("x.company_id") * 3).alias("contact_id")).filter("(project_id + sort_order) % 4 != 0")  # n: one row
    results = b.table(spark, sf_dir, "events").select(F.col("event_id").alias("project_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("result_id"), (F.col("event_type") == "error").alias("needs_review"))
    contacts = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contact_id"), letters(F.col("c_custkey") + 1000000).alias("name"))
    sent = p.filter(k % 3 != 0).select("project_id", F.concat(F.lit("Re: "), F.col("title")).alias("subject"), F.concat(F.lit("p"), (k % 100).cast("string"), F.lit("@x.example")).alias("from_email"))
    return lists.project_list(p, b.project_skills(spark, sf_dir).filter("trim(skill_name) != ''"), roles, companies(spark, sf_dir), results, contacts, sent)


def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page in the middle of all projects by falling price: rows of its range alone are sorted (a page is the feature)."""
    rows = b.projects(spark, sf_dir).select("project_id", F.col("unit_max").alias("price"))
    page = rows.count() // 40
    return lists.deep_page(rows, [("price", True), ("project_id", False)], page, 20, most=2000).select("project_id", "price", "page", "pages", "place_no")


def project_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of open projects that a text finds, by price (a page is the feature)."""
    rows = b.projects(spark, sf_dir).withColumns({"skills": F.lit(""), "price": F.col("unit_max")})
    found = lists.filter_projects(rows, text="urgent", month_from="1997-01", price_from=40, focus=True, recruiting=True)
    return lists.paginate(found, [F.desc("price"), "project_id"], 2, 20).select("project_id", "price", "page", "pages", "place_no")


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.confusion_metrics(b.table(spark, sf_dir, "labels"), "quality", "toxic")


def quality_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.project_skills(spark, sf_dir).filter("trim(skill_name) != ''").groupBy("project_id").agg(F.count("*").alias("n"))
    return reports.counters(rows, skills=reports.skill_bucket(F.col("n")), score=reports.score_bucket(F.col("n")))


def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.source_inventory(_categorized(spark, sf_dir).withColumn("provider", F.when(F.col("mail_id") % 5 == 0, "IMPORT").otherwise("GMAIL")), _links(spark, sf_dir), _results(spark, sf_dir), _entities(spark, sf_dir))


def mail_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 newest mails with their links (a sample of the newest is the feature)."""
    return reports.relationship_sample(mails(spark, sf_dir), _links(spark, sf_dir), 30)


def sensitive_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sensitive_rows(b.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id")


def sync_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for steps of sync runs."""
    kinds = {"fetched": "view", "created": "click", "updated": "purchase", "skipped": "signup", "failed": "error"}
    steps = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), *((F.col("event_type") == t).cast("long").alias(n) for n, t in kinds.items()))
    return reports.sync_run_summary(steps)


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations stand for threads: the newest turn of each, and how many turns are replies."""
    rows = b.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("target_id"), F.lit("THREAD").alias("target_type"), F.col("turn").alias("created_at"), F.col("turn").alias("result_id"), "role", F.length("text").alias("n_chars"))
    newest = company.latest_results(rows).select("target_id", F.col("result_id").alias("turn"), "role", "n_chars")
    replies = rows.groupBy("target_id").agg(F.count_if(F.col("result_id") > 0).alias("n_replies"))
    return newest.join(replies, "target_id")


def validated_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as typed-in prices, months and addresses, some of them wrong."""
    k = F.col("p_partkey")
    text = lambda n, *values: b.choice(k % n, list(values))
    rows = b.table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 6 == 0, "x1").when(k % 6 == 1, "").otherwise(F.format_string("%d,000.9", F.col("p_size"))).alias("price_text"), F.when(k % 7 == 0, "2026-13").when(k % 7 == 1, "2026/07").otherwise(" 2026-07").alias("month_text"), text(5, "2026-02-30", "2026-02-28", "soon", " ", "2024-02-29").alias("date_text"),
        F.when(k % 8 == 0, "no mail").when(k % 8 == 1, None).otherwise("a@x.example").alias("email"), text(4, "03-1234", "a@b", "a@b.example", "").alias("contact_text"), text(3, "Java, AWS、Java", " ／ ", "PHP").alias("list_text"), text(4, "募集中", "open", "", "終了").alias("status_text"),
        text(6, "フルリモート", "どこでも", "", " ", "HYBRID", "").alias("remote_text"), text(5, "週2日は出社", "在宅可", "本社常駐", "", "基本リモート、月1出社").alias("remote_note"),
    )
    out = imports.validate_entity_input(rows, {"募集中": "OPEN", "終了": "CLOSED"})
    return out.select("id", "price_value", "month_value", "date_value", F.array_join("list_value", "|").alias("list_value"), "status_value", "remote_value", F.array_join("errors", ",").alias("errors"))


def import_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the sheet by the link that they give."""
    none, strong = F.lit(None).cast("string"), F.lit("strong")
    kind = imports.link_type(F.col("action"), F.when(F.col("same_rows") > 1, strong).otherwise(none), F.lit(False))
    return _assessed(spark, sf_dir).groupBy(kind.alias("link_type")).agg(F.count("*").alias("n"))


def import_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.run_status(_assessed(spark, sf_dir))


def unclassified_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("mail_id")
    domain = F.when(k % 4 == 0, F.concat(F.lit("mail"), (k % 60).cast("string"), F.lit(".example-corp.com"))).when(k % 4 == 1, F.lit("other.example"))
    m = _categorized(spark, sf_dir).withColumns({"from_name": F.when(k % 4 == 2, "Desk").when(k % 4 == 3, " "), "from_email": F.concat(F.lit("x@"), domain)})
    return lists.filter_unclassified(m, _entities(spark, sf_dir), _links(spark, sf_dir), companies(spark, sf_dir)).select("mail_id", "needs_review", "sender_company", "has_result", "has_trade_ng")


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails by the first reason not to extract them."""
    e = _entities(spark, sf_dir).filter("source_mail_id IS NOT NULL").select(F.col("source_mail_id").alias("mail_id"))
    out = dedupe.skip_reason(_categorized(spark, sf_dir), e, _links(spark, sf_dir), _results(spark, sf_dir))
    return out.select("mail_id", "skip_reason")


def archived_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities after those with generated codes and a mail of another category were archived."""
    e = _entities(spark, sf_dir)
    return dedupe.archive(e, dedupe.category_mismatches(e, _categorized(spark, sf_dir), "PROJECT_INTRO"), "GMAIL-PRJ-").select("entity_id", "status")


def search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for searches: the newest 20 of each user and scope (a top-k report)."""
    rows = b.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("scope"), F.col("ts").alias("created_at"))
    return lists.search_history(rows).select("id", "user_id", "scope", "rank")


def first_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order's lines stand for roles in its trade chain; the first by priority."""
    role = F.when(F.col("l_returnflag") == "A", "PRIME").when(F.col("l_returnflag") == "N", "END_USER").otherwise("OTHER")
    rows = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"), role.alias("role"), F.col("l_linenumber").alias("sort_order"), F.col("l_suppkey").alias("company_id"))
    return company.first_role(rows)


NAMES = ["unclassified_mails", "skip_reasons", "archived_mismatches", "search_history", "first_roles", "validated_inputs", "import_links", "import_runs", "inferred_companies", "sender_companies", "contact_candidates", "resolved_mails", "mail_relations", "duplicate_rows", "category_mismatches", "unlinked_mails", "extraction_plan", "import_assessment", "import_summary", "import_duplicates", "field_coverage", "merged_mails", "appended_links", "project_list", "project_page", "deep_page", "confusion_metrics", "quality_counters", "source_inventory", "sensitive_documents", "sync_runs", "threads"]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


KNOWN = """sm AS (SELECT source_mail_id AS mail_id, arg_min(entity_id, {'a': created_at, 'b': entity_id}) AS x FROM entities WHERE source_mail_id IS NOT NULL GROUP BY 1), li AS (SELECT mail_id, arg_min(entity_id, {'a': created_at, 'b': entity_id}) AS x FROM links WHERE link_type = 'EXTRACTED' GROUP BY 1),
  re AS (SELECT mail_id, arg_min(entity_id, {'a': created_at, 'b': entity_id}) AS x FROM results GROUP BY 1), cd AS (SELECT code, arg_min(entity_id, {'a': created_at, 'b': entity_id}) AS x FROM entities GROUP BY 1),
  kn AS (SELECT mail_id, coalesce(sm.x, li.x, re.x, cd.x) AS entity_id, CASE WHEN sm.x IS NOT NULL THEN 'source_mail' WHEN li.x IS NOT NULL THEN 'link' WHEN re.x IS NOT NULL THEN 'result' WHEN cd.x IS NOT NULL THEN 'generated_code' END AS way
    FROM cm LEFT JOIN sm USING (mail_id) LEFT JOIN li USING (mail_id) LEFT JOIN re USING (mail_id) LEFT JOIN cd ON cd.code = 'GMAIL-PRJ-' || substring(cm.mail_id::VARCHAR, 1, 8))"""
_SHEET = """sheet AS (SELECT p_partkey, p_partkey + 2 AS row_no, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS title, p_brand AS company, CASE WHEN p_partkey % 13 <> 0 THEN 'work ' || p_type END AS work,
  CASE WHEN p_partkey % 7 <> 0 THEN [p_type, p_brand] END AS skills, CASE WHEN p_partkey % 5 = 0 THEN 'abc' ELSE p_size::VARCHAR || '万円' END AS price, CASE WHEN p_partkey % 17 = 0 THEN 'soon' ELSE '2026-07' END AS start FROM part),
rated AS (SELECT *, round((4 + (title IS NOT NULL)::INT + (work IS NOT NULL)::INT + (skills IS NOT NULL)::INT - 1) / 7, 4)::DOUBLE AS coverage FROM sheet),
warned AS (SELECT *, concat_ws(',', CASE WHEN title IS NULL THEN 'MISSING_TITLE' END, CASE WHEN work IS NULL THEN 'MISSING_WORK' END, CASE WHEN skills IS NULL THEN 'MISSING_SKILLS' END, CASE WHEN coverage < 0.5 THEN 'LOW_COVERAGE' END,
  CASE WHEN price = 'abc' THEN 'INVALID_PRICE' END, CASE WHEN start = 'soon' THEN 'INVALID_DATE' END, CASE WHEN length(title) < 4 THEN 'LOW_CONFIDENCE' END) AS warnings FROM rated),
sheeted AS (SELECT *, CASE WHEN title IS NULL AND skills IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY regexp_replace(lower(coalesce(title, '')), '[\\s_\\-/.,]', '', 'g'), start, lower(company), lower(coalesce(array_to_string(skills, '|'), '')), title IS NULL AND skills IS NULL) END AS same_rows FROM warned)"""


def oracle_sql() -> dict[str, str]:
    sign_key = "regexp_replace(lower({}), '[株式会社有限会社合同会社合資会社（）()\\[\\]【】\"''`.,、。・\\s_-]', '', 'g')"
    return {
        "inferred_companies": f"""WITH {COMPANIES}, {CUSTOMER_MAILS}, d AS (SELECT domain, min({{'i': company_id, 'n': name}}) AS x FROM companies WHERE domain IS NOT NULL GROUP BY 1),
          a AS (SELECT mail_id, max({{'l': length(k), 'o': -company_id, 'i': company_id, 'n': name}}) AS x FROM (SELECT *, {sign_key.format('name')} AS k FROM companies) JOIN cmail ON contains({sign_key.format("concat_ws(' ', label, from_name, signature)")}, k) GROUP BY 1),
          j AS (SELECT c.*, d.x AS dx, a.x AS ax FROM cmail c LEFT JOIN d ON c.domain = 'a.' || d.domain LEFT JOIN a USING (mail_id)),
          s AS (SELECT *, CASE WHEN dx IS NOT NULL THEN 'known_main_email_domain' WHEN ax IS NOT NULL THEN 'known_alias' WHEN label IS NOT NULL THEN 'body_label' WHEN from_name IS NOT NULL THEN 'from_name' WHEN signature IS NOT NULL THEN 'signature_company'
            WHEN domain = 'gmail.com' THEN 'generic_domain' WHEN domain IS NOT NULL THEN 'sender_domain' ELSE 'none' END AS source FROM j)
          SELECT mail_id, coalesce(dx.i, ax.i) AS company_id, CASE source WHEN 'known_main_email_domain' THEN dx.n WHEN 'known_alias' THEN ax.n WHEN 'body_label' THEN label WHEN 'from_name' THEN string_split(from_name, ' |')[1] WHEN 'signature_company' THEN string_split(signature, chr(10))[2]
            WHEN 'sender_domain' THEN CASE WHEN domain LIKE 'a.mail%' THEN 'Example Corp' ELSE 'Example' END END AS company_name, source,
          CASE WHEN source IN ('known_main_email_domain', 'known_alias', 'body_label') THEN 'HIGH' WHEN source IN ('from_name', 'signature_company') THEN 'MEDIUM' WHEN source = 'none' THEN 'NONE' ELSE 'LOW' END AS confidence,
          CASE source WHEN 'known_main_email_domain' THEN 0.92 WHEN 'known_alias' THEN 0.88 WHEN 'body_label' THEN 0.86 WHEN 'from_name' THEN 0.72 WHEN 'signature_company' THEN 0.68 WHEN 'generic_domain' THEN 0.2 WHEN 'sender_domain' THEN 0.42 ELSE 0 END::DOUBLE AS score, source LIKE 'known%' AS eligible FROM s""",
        "sender_companies": f"""WITH {COMPANIES}, {CUSTOMER_MAILS}, m AS (SELECT mail_id, domain, lower(replace(coalesce(from_name, '') || coalesce('x@' || domain, ''), ' ', '')) AS t FROM cmail),
          d AS (SELECT mail_id, min({{'i': company_id, 'n': name}}) AS x FROM m JOIN companies c ON m.domain = c.domain OR m.domain = 'a.' || c.domain GROUP BY 1), n AS (SELECT mail_id, min({{'i': company_id, 'n': name}}) AS x FROM m JOIN companies c ON contains(t, lower(replace(name, ' ', ''))) GROUP BY 1)
          SELECT mail_id, coalesce(d.x, n.x).i AS company_id, coalesce(d.x, n.x).n AS company_name FROM m LEFT JOIN d USING (mail_id) LEFT JOIN n USING (mail_id)""",
        "contact_candidates": f"""WITH c0 AS (SELECT s_suppkey AS contact_id, {_letters("s_suppkey")} AS k, 'mail' || (s_suppkey // 2)::VARCHAR || '.example-corp.com' AS domain, 'p' || s_suppkey::VARCHAR || '@mail' || (s_suppkey // 2)::VARCHAR || '.example-corp.com' AS email, {_letters("s_suppkey + 1000000")} AS p, {_letters("s_suppkey + 2000000")} AS q FROM supplier),
          c AS (SELECT * FROM c0 UNION ALL SELECT contact_id, k, domain, 'q' || substring(email, 2), q, p FROM c0 WHERE contact_id % 3 = 0),
          f AS (SELECT *, {_letters("c_custkey // 15")} AS l, {_letters("c_custkey // 15 + 1000000")} AS p0, {_letters("c_custkey // 15 + 2000000")} AS q0 FROM customer),
          e AS (SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 6 = 0 THEN substring(l, 1, 9) || 'z' WHEN c_custkey % 8 = 2 THEN l || 'japan' WHEN c_custkey % 2 = 0 THEN l ELSE '' END AS k, CASE WHEN c_custkey % 3 = 0 THEN 'mail' || (c_custkey // 24)::VARCHAR || '.example-corp.com' END AS domain,
            CASE WHEN c_custkey % 3 = 0 THEN 'p' || (c_custkey // 12)::VARCHAR || '@mail' || (c_custkey // 24)::VARCHAR || '.example-corp.com' END AS email, CASE c_custkey % 5 WHEN 0 THEN q0 WHEN 1 THEN p0 WHEN 2 THEN p0 END AS p, CASE c_custkey % 5 WHEN 0 THEN p0 WHEN 1 THEN q0 WHEN 2 THEN substring(q0, 1, 9) || 'z' END AS q FROM f),
          s AS (SELECT entity_id, contact_id, c.k, e.k = c.k AS x, e.k <> '' AND e.k <> c.k AND (contains(e.k, c.k) OR contains(c.k, e.k) OR 1 - levenshtein(e.k, c.k) / greatest(length(e.k), length(c.k)) >= 0.82) AS v, coalesce(e.email = c.email, false) AS m, coalesce(e.domain = c.domain, false) AS d,
            coalesce(e.p || e.q = c.p || c.q, false) AS y, coalesce(e.p || e.q <> c.p || c.q AND (least(e.p, e.q) || greatest(e.p, e.q) = least(c.p, c.q) || greatest(c.p, c.q) OR 1 - levenshtein(e.p || e.q, c.p || c.q) / 20 >= 0.84), false) AS z FROM e, c),
          t AS (SELECT *, least(100, 46 * x::INT + 28 * v::INT + 62 * m::INT + 34 * d::INT + 40 * y::INT + 22 * z::INT)::INT AS score FROM s),
          u AS (SELECT entity_id, contact_id, k, score, bool_or(x) AS x, bool_or(v) AS v, bool_or(m) AS m, bool_or(d) AS d, bool_or(y) AS y, bool_or(z) AS z FROM t WHERE score > 0 GROUP BY entity_id, contact_id, k, score QUALIFY row_number() OVER (PARTITION BY entity_id, contact_id ORDER BY score DESC) = 1),
          w AS (SELECT *, concat_ws(',', CASE WHEN x THEN 'company_name_exact' END, CASE WHEN v THEN 'company_name_variant' END, CASE WHEN m THEN 'contact_email_match' END, CASE WHEN d THEN 'email_domain_match' END, CASE WHEN y THEN 'contact_name_exact' END, CASE WHEN z THEN 'contact_name_variant' END) AS reasons FROM u)
          SELECT entity_id, contact_id, score, reasons, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, len(string_split(reasons, ',')) DESC, k, contact_id)::INT AS rank FROM w) WHERE rank <= 3""",
        "duplicate_rows": f"WITH {ENTITIES}, w AS (SELECT *, count(*) OVER (PARTITION BY source_mail_id, entity_type) AS n_rows, row_number() OVER (PARTITION BY source_mail_id, entity_type ORDER BY created_at, id)::INT AS row_no FROM entities WHERE source_mail_id IS NOT NULL) SELECT id, source_mail_id, entity_type, n_rows, row_no, row_no = 1 AS keep FROM w WHERE n_rows > 1",
        "category_mismatches": f"WITH {ENTITIES}, {CATEGORIZED} SELECT entity_id, source_mail_id, CASE WHEN is_excluded THEN 'MAIL_EXCLUDED' ELSE 'CATEGORY_DIFFERS' END AS reason FROM entities JOIN cm ON source_mail_id = mail_id WHERE status <> 'ARCHIVED' AND (is_excluded OR category <> 'PROJECT_INTRO')",
        "unlinked_mails": f"WITH {ENTITIES}, {CATEGORIZED} SELECT mail_id, category FROM cm WHERE category <> 'OTHER' AND NOT is_excluded AND mail_id NOT IN (SELECT source_mail_id FROM entities WHERE source_mail_id IS NOT NULL)",
        "resolved_mails": f"WITH {ENTITIES}, {LINKS}, {CATEGORIZED}, {KNOWN} SELECT * FROM kn",
        "extraction_plan": f"""WITH {ENTITIES}, {LINKS}, {CATEGORIZED}, {KNOWN},
          k AS (SELECT cm.*, nullif(lower(trim(regexp_replace(regexp_replace(subject, '^\\s*(re|fw|fwd)\\s*:\\s*', '', 'i'), '\\s+', ' ', 'g'))), '') AS sub, lang || '.example.com' AS snd FROM cm),
          pr AS (SELECT sub, snd, arg_min(e.entity_id, {{'a': e.created_at, 'b': e.entity_id}}) AS same FROM entities e JOIN k ON e.source_mail_id = k.mail_id WHERE e.status <> 'ARCHIVED' AND sub IS NOT NULL GROUP BY 1, 2),
          j AS (SELECT k.*, kn.entity_id AS known, same FROM k JOIN kn USING (mail_id) LEFT JOIN pr ON k.sub = pr.sub AND k.snd = pr.snd),
          r AS (SELECT *, row_number() OVER w AS n, first_value(mail_id) OVER w AS f FROM j WINDOW w AS (PARTITION BY sub, snd, known IS NULL AND same IS NULL ORDER BY received_at DESC, mail_id))
          SELECT mail_id, CASE WHEN known IS NOT NULL THEN 'skipped' WHEN same IS NOT NULL THEN 'linked' WHEN sub IS NOT NULL AND n > 1 THEN 'linked' ELSE 'created' END AS action,
          CASE WHEN known IS NOT NULL THEN 'ALREADY_EXTRACTED' WHEN same IS NOT NULL THEN 'SAME_SUBJECT_AND_SENDER' WHEN sub IS NOT NULL AND n > 1 THEN 'SAME_IN_BATCH' ELSE 'NEW' END AS reason, coalesce(known, same) AS entity_id,
          CASE WHEN known IS NULL AND same IS NULL AND sub IS NOT NULL AND n > 1 THEN f END AS same_as_mail FROM r""",
        "import_assessment": f"WITH {_SHEET} SELECT row_no, title, coalesce(len(skills), 0)::INT AS n_skills, coverage, warnings, CASE WHEN warnings <> '' OR same_rows > 1 THEN 'would_need_review' ELSE 'would_create' END AS action, same_rows FROM sheeted",
        "unclassified_mails": f"""WITH {ENTITIES}, {LINKS}, {COMPANIES}, {CATEGORIZED}, u AS (SELECT mail_id, CASE mail_id % 4 WHEN 0 THEN 'mail' || (mail_id % 60)::VARCHAR || '.example-corp.com' WHEN 1 THEN 'other.example' END AS domain FROM cm WHERE category = 'OTHER' AND NOT is_excluded
            AND mail_id NOT IN (SELECT source_mail_id FROM entities WHERE source_mail_id IS NOT NULL AND status <> 'ARCHIVED') AND mail_id NOT IN (SELECT mail_id FROM links)),
          d AS (SELECT domain, min({{'i': company_id, 'n': name, 's': trade_status}}) AS x FROM companies WHERE domain IS NOT NULL GROUP BY 1)
          SELECT mail_id, false AS needs_review, coalesce(x.n, CASE mail_id % 4 WHEN 2 THEN 'Desk' WHEN 3 THEN ' ' END, u.domain, '未入力') AS sender_company, coalesce(x.s = 'OK', false) AS has_result, coalesce(x.s = 'NG', false) AS has_trade_ng FROM u LEFT JOIN d USING (domain)""",
        "skip_reasons": f"""WITH {ENTITIES}, {LINKS}, {CATEGORIZED} SELECT mail_id, CASE WHEN is_excluded THEN 'MAIL_EXCLUDED' WHEN category = 'OTHER' THEN 'NOT_AN_INTRODUCTION' WHEN mail_id IN (SELECT source_mail_id FROM entities) THEN 'ENTITY_EXISTS'
          WHEN mail_id IN (SELECT mail_id FROM links) THEN 'LINK_EXISTS' WHEN mail_id IN (SELECT mail_id FROM results) THEN 'RESULT_EXISTS' WHEN trim(body) = '' THEN 'BODY_EMPTY' END AS skip_reason FROM cm""",
        "archived_mismatches": f"WITH {ENTITIES}, {CATEGORIZED} SELECT entity_id, CASE WHEN is_excluded OR category <> 'PROJECT_INTRO' THEN 'ARCHIVED' ELSE status END AS status FROM entities LEFT JOIN cm ON source_mail_id = mail_id",
        "search_history": "SELECT * FROM (SELECT event_id AS id, user_id, event_type AS scope, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)::INT AS rank FROM events) WHERE rank <= 20",
        "first_roles": """WITH r AS (SELECT l_orderkey AS project_id, CASE l_returnflag WHEN 'A' THEN 'PRIME' WHEN 'N' THEN 'END_USER' ELSE 'OTHER' END AS role, l_linenumber AS o, l_suppkey AS company_id FROM lineitem),
          p AS (SELECT *, CASE role WHEN 'PRIME' THEN 1 WHEN 'END_USER' THEN 2 ELSE 3 END AS p FROM r) SELECT project_id, role, company_id FROM p QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY p, o, company_id) = 1""",
        "validated_inputs": """SELECT p_partkey AS id, CASE WHEN p_partkey % 6 > 1 THEN p_size * 1000 END::BIGINT AS price_value, CASE WHEN p_partkey % 7 > 1 THEN DATE '2026-07-01' END AS month_value, CASE p_partkey % 5 WHEN 1 THEN DATE '2026-02-28' WHEN 4 THEN DATE '2024-02-29' END AS date_value,
          ['Java|AWS', '', 'PHP'][(p_partkey % 3)::INT + 1] AS list_value, CASE p_partkey % 4 WHEN 0 THEN 'OPEN' WHEN 3 THEN 'CLOSED' END AS status_value,
          CASE p_partkey % 6 WHEN 0 THEN 'FULL_REMOTE' WHEN 1 THEN NULL WHEN 4 THEN 'HYBRID' ELSE ['HYBRID', 'REMOTE', 'ONSITE', 'UNKNOWN', 'HYBRID'][(p_partkey % 5)::INT + 1] END AS remote_value,
          concat_ws(',', CASE WHEN p_partkey % 6 = 0 THEN 'PRICE' END, CASE WHEN p_partkey % 7 < 2 THEN 'MONTH' END, CASE WHEN p_partkey % 5 IN (0, 2) THEN 'DATE' END, CASE WHEN p_partkey % 8 = 0 THEN 'EMAIL' END, CASE WHEN p_partkey % 4 = 1 THEN 'CONTACT' END, CASE WHEN p_partkey % 4 = 1 THEN 'STATUS' END, CASE WHEN p_partkey % 6 = 1 THEN 'REMOTE' END) AS errors FROM part""",
        "import_links": f"WITH {_SHEET} SELECT CASE WHEN same_rows > 1 THEN 'DUPLICATE_OF' WHEN warnings <> '' THEN 'REVIEW_CANDIDATE' ELSE 'CREATED_FROM' END AS link_type, count(*) AS n FROM sheeted GROUP BY 1",
        "import_runs": f"WITH {_SHEET} SELECT 'sheet.csv' AS source, CASE WHEN max((warnings <> '')::INT) = 1 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status, count(*) AS n_rows FROM sheeted",
        "import_summary": f"""WITH {_SHEET} SELECT 'action' AS metric, CASE WHEN warnings <> '' THEN 'would_need_review' ELSE 'would_create' END AS key, count(*) AS n FROM sheeted GROUP BY 2 UNION ALL
          SELECT 'warning', unnest(string_split(warnings, ',')) AS key, count(*) FROM sheeted WHERE warnings <> '' GROUP BY 2 UNION ALL SELECT 'duplicate', 'same_source', count(*) FROM sheeted WHERE same_rows > 1 HAVING count(*) > 0
          UNION ALL SELECT 'type', 'project', count(*) FROM sheeted UNION ALL SELECT 'required:title', CASE WHEN title IS NULL THEN 'missing' ELSE 'present' END, count(*) FROM sheeted GROUP BY 2 UNION ALL SELECT 'required:work', CASE WHEN work IS NULL THEN 'missing' ELSE 'present' END, count(*) FROM sheeted GROUP BY 2
          UNION ALL SELECT 'required:skills', CASE WHEN skills IS NULL THEN 'missing' ELSE 'present' END, count(*) FROM sheeted GROUP BY 2""",
        "import_duplicates": """WITH r AS (SELECT p_partkey AS id, p_name AS t, p_brand AS c, [lower(p_type), string_split(p_name, ' ')[1]] AS k, p_partkey % 40 AS pl, p_size::DOUBLE AS pr FROM part),
          j AS (SELECT a.id, b.id AS existing_id, a.t = b.t AND a.c = b.c AS same, len(list_intersect(a.k, b.k)) >= 2 AS two, a.pl = b.pl AS place, abs(a.pr - b.pr) <= 5 AS near FROM r a JOIN r b ON a.id < b.id)
          SELECT id, existing_id, CASE WHEN same OR (two AND place AND near) THEN 'strong' ELSE 'weak' END AS strength FROM j WHERE same OR (two AND (place OR near))""",
        "field_coverage": f"WITH {_SHEET}, f AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {e} AS has FROM sheet" for f, e in {"title": "title IS NOT NULL", "company": "company IS NOT NULL", "work": "work IS NOT NULL", "skills": "skills IS NOT NULL", "price": "true", "start": "true", "place": "false"}.items()) + ") SELECT field, count(*) FILTER (has) AS present, count(*) FILTER (NOT has) AS missing, round(count(*) FILTER (has) / count(*), 4)::DOUBLE AS ratio FROM f GROUP BY 1",
        "merged_mails": "SELECT 1 AS account_id, doc_id AS external_id, length(text)::INT AS n_body, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'PROJECT_INTRO' ELSE 'NEEDS_REVIEW' END AS category FROM documents",
        "appended_links": f"""WITH {ENTITIES}, l AS (SELECT source_mail_id, entity_type, row_number() OVER w AS n, bool_or(status = 'ARCHIVED') OVER (PARTITION BY source_mail_id, entity_type) AS known FROM entities WHERE source_mail_id IS NOT NULL WINDOW w AS (PARTITION BY source_mail_id, entity_type))
          SELECT CASE WHEN n > 1 OR known THEN 'skipped' ELSE 'created' END AS action, count(*) AS n FROM l GROUP BY 1""",
        "project_list": f"""WITH {b.SQL}, {COMPANIES}, k AS (SELECT project_id, coalesce(string_agg(DISTINCT skill_name, ',' ORDER BY skill_name) FILTER (skill_type = 'REQUIRED'), '') AS required_skills, coalesce(string_agg(DISTINCT skill_name, ',' ORDER BY skill_name) FILTER (skill_type = 'PREFERRED'), '') AS preferred_skills,
            coalesce(string_agg(DISTINCT skill_name, ',' ORDER BY skill_name) FILTER (skill_type = 'USED_TECHNOLOGY'), '') AS used_skills FROM project_skills WHERE trim(skill_name) <> '' GROUP BY 1),
          ro AS (SELECT project_id, o, p, (project_id * m) % (SELECT count(*) FROM supplier) AS company_id FROM projects, (VALUES (0, 3, 2), (1, 7, 1), (2, 11, 0)) v(o, m, p) WHERE (project_id + o) % 4 <> 0),
          rj AS (SELECT ro.*, name, trade_status, CASE WHEN c_custkey IS NOT NULL THEN {_letters("c_custkey + 1000000")} END AS contact FROM ro LEFT JOIN companies USING (company_id) LEFT JOIN customer ON c_custkey = company_id * 3),
          rn AS (SELECT project_id, arg_min({{'n': name, 't': trade_status, 'c': contact}}, p) AS f, coalesce(string_agg(name, '>' ORDER BY o), '') AS chain FROM rj GROUP BY 1),
          re AS (SELECT event_id AS project_id, arg_max(event_type = 'error', {{'a': ts, 'b': event_id}}) AS nr FROM events GROUP BY 1)
          SELECT project_id, title, status, f.n AS company, f.c AS contact, coalesce(f.t = 'OK', false) AS has_trade_result, coalesce(f.t = 'NG', false) AS has_trade_ng, chain, CASE WHEN unit_min IS NULL AND unit_max IS NULL THEN '' WHEN unit_min = unit_max THEN unit_max::VARCHAR || '万円' ELSE coalesce(unit_min::VARCHAR, '') || '〜' || coalesce(unit_max::VARCHAR, '') || '万円' END AS price_text,
          coalesce(unit_max, unit_min, 0) AS price_value, required_skills, preferred_skills, used_skills, CASE WHEN project_id % 3 <> 0 THEN 'Re: ' || title END AS mail_subject, CASE WHEN project_id % 3 <> 0 THEN 'p' || (project_id % 100)::VARCHAR || '@x.example' END AS mail_from, nr IS NOT NULL AS has_result, coalesce(nr, false) AS needs_review
          FROM projects LEFT JOIN k USING (project_id) LEFT JOIN rn USING (project_id) LEFT JOIN re USING (project_id)""",
        "deep_page": f"""WITH {b.SQL}, n AS (SELECT count(*) AS n FROM projects), w AS (SELECT project_id, unit_max AS price, row_number() OVER (ORDER BY unit_max DESC, project_id) AS place_no FROM projects)
          SELECT project_id, price, greatest(1, n // 40)::INT AS page, greatest(1, (n + 19) // 20)::INT AS pages, place_no FROM w, n WHERE place_no > (greatest(1, n // 40) - 1) * 20 AND place_no <= greatest(1, n // 40) * 20""",
        "project_page": f"""WITH {b.SQL}, f AS (SELECT project_id, unit_max AS price FROM projects WHERE contains(lower(title), 'urgent') AND (start_month IS NULL OR strftime(start_month, '%Y-%m') >= '1997-01') AND unit_max >= 40 AND is_focus AND status = 'OPEN')
          SELECT project_id, price, 2 AS page, (SELECT greatest(1, ceil(count(*) / 20))::INT FROM f) AS pages, row_number() OVER (ORDER BY price DESC, project_id)::INT AS place_no FROM f ORDER BY price DESC, project_id LIMIT 20 OFFSET 20""",
        "confusion_metrics": """WITH l AS (SELECT quality::VARCHAR AS t, toxic::VARCHAR AS p FROM labels), n AS (SELECT DISTINCT label FROM (SELECT t AS label FROM l UNION ALL SELECT p FROM l)),
          c AS (SELECT label, count(*) FILTER (t = label AND p = label) AS hits, count(*) FILTER (p = label) AS predicted, count(*) FILTER (t = label) AS actual FROM n, l GROUP BY 1),
          r AS (SELECT *, CASE WHEN predicted = 0 THEN 1.0 ELSE hits / predicted END AS pr, CASE WHEN actual = 0 THEN 1.0 ELSE hits / actual END AS re FROM c)
          SELECT label, hits::BIGINT AS hits, predicted::BIGINT AS predicted, actual::BIGINT AS actual, round(pr, 4)::DOUBLE AS precision, round(re, 4)::DOUBLE AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 4)::DOUBLE AS f1, (SELECT round(count(*) FILTER (t = p) / count(*), 4)::DOUBLE FROM l) AS accuracy FROM r""",
        "quality_counters": f"""WITH {b.SQL}, n AS (SELECT count(*) AS n FROM project_skills WHERE trim(skill_name) <> '' GROUP BY project_id)
          SELECT 'skills' AS metric, CASE WHEN n <= 0 THEN '0' WHEN n <= 3 THEN '1-3' WHEN n <= 6 THEN '4-6' WHEN n <= 10 THEN '7-10' WHEN n <= 15 THEN '11-15' ELSE '16+' END AS key, count(*) AS n FROM n GROUP BY 2 UNION ALL
          SELECT 'score', CASE WHEN n <= 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' WHEN n <= 9 THEN '6-9' ELSE '10+' END, count(*) FROM n GROUP BY 2""",
        "source_inventory": f"""WITH {ENTITIES}, {LINKS}, {CATEGORIZED}
          SELECT 'mail_category' AS metric, category AS key, count(*) AS n FROM cm GROUP BY 2 UNION ALL SELECT 'mail_excluded', is_excluded::VARCHAR, count(*) FROM cm GROUP BY 2 UNION ALL SELECT 'link_type', link_type, count(*) FROM links GROUP BY 2 UNION ALL SELECT 'result_target', target, count(*) FROM results GROUP BY 2 UNION ALL SELECT 'result_review', review_status, count(*) FROM results GROUP BY 2 UNION ALL SELECT 'mail_provider', CASE WHEN mail_id % 5 = 0 THEN 'IMPORT' ELSE 'GMAIL' END, count(*) FROM cm GROUP BY 2
          UNION ALL SELECT 'entity_type', entity_type || ':' || status, count(*) FROM entities GROUP BY 2 UNION ALL SELECT 'entity_source', CASE WHEN source_mail_id IS NULL THEN 'without_mail' ELSE 'with_mail' END, count(*) FROM entities GROUP BY 2 UNION ALL SELECT 'mail_derived', entity_type, count(*) FROM entities WHERE starts_with(code, 'GMAIL-') GROUP BY 2
          UNION ALL SELECT 'mails_with_links', '', count(*) FROM cm WHERE mail_id IN (SELECT mail_id FROM links) UNION ALL SELECT 'mails_with_results', '', count(*) FROM cm WHERE mail_id IN (SELECT mail_id FROM results) UNION ALL SELECT 'mails_with_entities', '', count(*) FROM cm WHERE mail_id IN (SELECT source_mail_id FROM entities)
          UNION ALL SELECT 'orphan_links', '', count(*) FROM links WHERE mail_id NOT IN (SELECT mail_id FROM cm) UNION ALL SELECT 'orphan_results', '', count(*) FROM results WHERE mail_id NOT IN (SELECT mail_id FROM cm)""",
        "mail_relations": f"""WITH {LINKS}, {MAILS} SELECT mail_id, received_at, count(link_type) AS n_links, coalesce(string_agg(DISTINCT link_type, ',' ORDER BY link_type), '') AS link_types FROM (SELECT * FROM mails ORDER BY received_at DESC, mail_id DESC LIMIT 30) LEFT JOIN links USING (mail_id) GROUP BY 1, 2""",
        "sensitive_documents": "SELECT doc_id FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}|https?://|(?i:(bearer\\s+[a-z0-9._-]+|(postgres(ql)?|mysql|sqlserver)://|(secret|password|token|api_?key)\\s*[:=]))|[A-Za-z]:\\\\|/(home|users|var)/|-----BEGIN [A-Z ]*PRIVATE KEY-----')",
        "sync_runs": "SELECT user_id AS run_id, max(ts) AS at, count(*) FILTER (event_type = 'view') AS fetched, count(*) FILTER (event_type = 'click') AS created, count(*) FILTER (event_type = 'purchase') AS updated, count(*) FILTER (event_type = 'signup') AS skipped, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1",
        "threads": "SELECT conv_id AS target_id, max(turn) AS turn, arg_max(role, turn) AS role, length(arg_max(text, turn))::INT AS n_chars, count(*) FILTER (turn > 0) AS n_replies FROM conversations GROUP BY 1",
    }
