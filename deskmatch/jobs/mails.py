"""Mail queries (normal forms, classification, extraction, statistics) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import classify, extract, reports
from ..operators.classify import KeywordRule, StrongRule
from ..plans import binding as b
from ..sources import tables

#: Rules for the given texts: words that occur in them.
STRONG = [StrongRule("project_intro", "PROJECT_INTRO", ("tionble", "erstion"), 0.94), StrongRule("person_intro", "PERSON_INTRO", ("queeaux", "ciónrr"), 0.93)]
RULES = [KeywordRule("seminar", "SEMINAR", ("thever", "ndwhst"), 2, 2, True), KeywordRule("newsletter", "NEWSLETTER", ("reeau", "atly"), 2, 2, True), KeywordRule("person_intro", "PERSON_INTRO", ("leau", "einer", "aux", "leau"), 1, 2), KeywordRule("project_intro", "PROJECT_INTRO", ("tion", "ing", "ent", "ciones", "schung"), 1, 3)]


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for mails: the first line is the subject, the source the sender's domain."""
    k = F.col("doc_id")
    subject = F.substring(F.substring_index("text", "\n", 1), 1, 60)
    sender = F.concat(F.lit("sales"), (k % 7).cast("string"), F.lit("@"), F.col("source"), F.lit(".example-corp.com"))
    return b.table(spark, sf_dir, "documents").select(k.alias("mail_id"), F.when(k % 19 == 0, F.concat(F.lit("Re: "), subject)).otherwise(subject).alias("subject"), F.col("text").alias("body"), sender.alias("from_email"), F.lit(None).cast("string").alias("from_name"), F.when(k % 17 == 0, "<id>").alias("in_reply_to"), F.lit(None).cast("string").alias("references_header"), F.timestamp_seconds(F.lit(1704067200) + k * 60).alias("received_at"), F.when(k % 23 == 0, "MANUAL").when(k % 2 == 0, "RULE").alias("classified_by"), "lang")


MAILS = """mails AS (SELECT doc_id AS mail_id, CASE WHEN doc_id % 19 = 0 THEN 'Re: ' ELSE '' END || substring(string_split(text, chr(10))[1], 1, 60) AS subject, text AS body,
  'sales' || (doc_id % 7)::VARCHAR || '@' || source || '.example-corp.com' AS from_email, CASE WHEN doc_id % 17 = 0 THEN '<id>' END AS in_reply_to,
  (TIMESTAMP '2024-01-01' + to_minutes(doc_id)) AS received_at, CASE WHEN doc_id % 23 = 0 THEN 'MANUAL' WHEN doc_id % 2 = 0 THEN 'RULE' END AS classified_by, lang FROM documents)"""


def mails_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mails(spark, sf_dir)
    return rows.select("mail_id", F.sha2(F.coalesce(t.body_text(F.col("body")), F.lit("")), 256).alias("body_sha"), F.length(t.search_text(F.col("body"))).alias("search_length"), t.clean_subject(F.col("subject")).alias("subject"), t.email_domain(F.col("from_email")).alias("domain"), t.body_hash(F.col("body"), F.lit(None).cast("string")).alias("body_hash"), t.is_reply(F.col("subject"), F.col("in_reply_to"), F.col("references_header")).alias("is_reply"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of HTML pages, and the body of mails that hold a page beside a text, a mere link or nothing."""
    k = F.col("page_id")
    plain = F.when(k % 3 == 0, F.concat(F.lit("こちら https://x.example/"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("See page "), k.cast("string"), F.lit(" of the list.")))
    pages = b.table(spark, sf_dir, "pages").withColumns({"page_text": t.html_text(F.col("html")), "plain": plain})
    body, source = t.best_body(F.col("plain"), F.col("page_text"))
    return pages.select("page_id", F.sha2("page_text", 256).alias("text_sha"), F.length("page_text").alias("n_chars"), F.sha2(body, 256).alias("body_sha"), source.alias("source"), t.site_domain(F.col("url")).alias("domain"))


def redacted_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and length of the whole masked text, and the mark that stands for the subject."""
    shown = mails(spark, sf_dir).select("mail_id", "subject", t.redacted(F.col("body")).alias("shown"))
    return shown.select("mail_id", F.sha2("shown", 256).alias("shown_sha"), F.length("shown").alias("n_chars"), t.subject_mark(F.col("subject")).alias("subject_mark"))


def classified_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify_mails(mails(spark, sf_dir), RULES, STRONG).select("mail_id", "label", "category", F.col("confidence").cast("double").alias("confidence"), "is_excluded", "needs_review")


def classification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of all mails that no person classified."""
    rows = classify.to_classify(mails(spark, sf_dir))
    return classify.classification_summary(classify.classify_mails(rows, RULES, STRONG))


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails that a short term, a long term and sql find."""
    rows = mails(spark, sf_dir)
    text = F.concat_ws(" ", "subject", "body")
    return rows.select("mail_id", *(t.matches_term(text, term).alias(f"has_{name}") for name, term in (("ed", "ed"), ("tion", "tion "), ("sql", "SQL")))).filter("has_ed OR has_tion OR has_sql")


def mail_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of classified mails; lines stand for links of mails to entities."""
    line = b.table(spark, sf_dir, "lineitem")
    links = line.select(F.when(F.col("l_orderkey") % 2 == 0, "PROJECT").otherwise("PERSON").alias("entity_type"), F.when(F.col("l_returnflag") == "R", "REVIEW_CANDIDATE").otherwise("EXTRACTED").alias("link_type"))
    return reports.mail_stats(classify.classify_mails(mails(spark, sf_dir), RULES, STRONG), "2024-01-01 06:00:00", links)


def sender_subject_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest groups (a top-k report)."""
    return reports.sender_subject_groups(mails(spark, sf_dir).withColumn("from_email", F.col("lang")), 20)


#: Lines of projects' mails by a project's number.
REQUIRED = ["Java, AWS", "PHP、Laravel", "C#・SQL", "React/TypeScript", "経験者"]
PREFERRED = ["Terraform", "Docker", "Google Cloud、Linux"]
POLICIES = ["外国籍不可", "外国籍：応相談", "外国籍OK", None]
TIMES = ["1", "２", "三"]


def project_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails that describe the projects of orders; which lines they have, and in which form, depends on the number."""
    p = b.projects(spark, sf_dir, spread=True)
    k = F.col("project_id")
    price = F.when(F.col("unit_min") >= 10, F.concat(F.lit("単価："), F.col("unit_min"), F.lit("〜"), F.col("unit_max"), F.lit("万円")))
    start = F.concat(F.lit("開始："), F.date_format("start_month", "yyyy"), F.lit("年"), F.date_format("start_month", "M"), F.lit("月"))
    numbered = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    lines = [
        F.when(k % 7 != 3, F.concat(F.lit("案件名："), F.col("title"))), F.when(k % 5 != 4, numbered("上位会社： 第", k % 1000, "商事様")), F.when(k % 2 == 0, numbered("商流：エンド→元請", k % 3 + 1, "社→弊社")), price, F.concat(F.lit("勤務地："), F.col("place")),
        F.concat(F.lit("必須スキル："), b.choice(k % 5, REQUIRED)), F.when(k % 4 == 0, F.concat(F.lit("尚可："), b.choice(k % 3, PREFERRED))), numbered("精算：", 120 + k % 3 * 10, "-", 180 + k % 2 * 20, "h"), F.concat(F.lit("面談："), b.choice(k % 3, TIMES), F.lit("回")), F.concat(F.lit("契約："), F.col("contract")),
        b.choice(k % 4, POLICIES), F.when(k % 6 == 0, numbered("年齢：", 30 + k % 3 * 10, "代まで")), F.when(F.col("remote_type") == "FULL_REMOTE", "フルリモート").when(F.col("remote_type") == "ONSITE", "常駐"), start, F.when(k % 8 == 1, numbered("担当：営業", k % 50)), F.when(k % 8 < 3, numbered("メール：  sales", k % 50, "@partner.example まで")),
    ]
    return p.select(k.alias("mail_id"), F.concat(F.lit("Re: "), F.col("title")).alias("subject"), F.concat_ws("\n", *lines).alias("body"), F.lit("desk").alias("from_name"), F.lit("desk@example-corp.com").alias("from_email"))


def extracted_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.extract_projects(project_mails(spark, sf_dir), "1998-06-15")
    plain = ["mail_id", "title", "unit_min", "unit_max", "upper_min", "upper_max", "place", "prefecture", "start", "hours_min", "hours_max", "interviews", "contract", "remote", "chain", "company", "contact", "contact_email", "foreign_policy", "age_condition"]
    return out.select(*plain, *(F.array_join(c, ",").alias(c) for c in ("required_skills", "preferred_skills", "used_skills", "missing")), F.col("confidence").cast("double").alias("confidence"))


def address_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address lists made of customers, with a comma inside a quoted name."""
    k = F.col("c_custkey").cast("string")
    header = F.concat(F.lit('"Desk, '), F.col("c_name"), F.lit('" <A'), k, F.lit("@x.Example>, b"), k, F.lit("@mail.y.example"))
    rows = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mail_id"), header.alias("h"))
    return rows.select("mail_id", F.array_join(t.addresses(F.col("h")), ";").alias("addresses"), t.first_name(F.col("h")).alias("name"), t.email_domain(F.element_at(t.addresses(F.col("h")), 2)).alias("domain"))


def mime_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested messages: turns at three levels in turn, of both types, the second an attachment that is passed over."""
    turn = F.col("turn")
    data = F.regexp_replace(F.translate(F.base64(F.encode("text", "utf-8")), "+/", "-_"), "\\s", "")
    leaf = F.struct(F.when(turn % 4 == 3, "text/html").otherwise("text/plain").alias("mimeType"), F.when(turn == 1, "a.txt").alias("filename"), F.struct(data.alias("data")).alias("body"))
    box = lambda part: F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(part).alias("parts"))
    part = F.when(turn % 3 == 0, F.to_json(leaf)).when(turn % 3 == 1, F.to_json(box(leaf))).otherwise(F.to_json(box(box(leaf))))
    parts = b.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
    message = F.concat(F.lit('{"mimeType":"multipart/mixed","parts":['), F.array_join(F.transform("parts", lambda p: p["part"]), ","), F.lit("]}"))
    out = tables.message_bodies(parts.select("conv_id", message.alias("message")), "conv_id", "message")
    return out.select("conv_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("body_sha"), F.sha2("html", 256).alias("html_sha"))


NAMES = ["address_headers", "mime_bodies", "mails_normalized", "page_text", "redacted_mails", "classified_mails", "classification_summary", "text_search", "mail_stats", "sender_subject_groups", "extracted_projects"]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


def _at(place: str, values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({place})::INT + 1]"


def _hits(column: str, words) -> str:
    return "(" + " + ".join(f"contains({column}, '{w.lower()}')::INT" for w in words) + ")"


def _best(column: str, rules: list[KeywordRule]) -> str:
    each = (f"CASE WHEN {_hits(column, r.keywords)} * {r.points} >= {r.threshold} THEN {{'score': {_hits(column, r.keywords)} * {r.points}, 'threshold': {r.threshold}, 'place': {-i}, 'label': '{r.label}', 'category': '{r.category}', 'excluded': {r.excluded}}} END" for i, r in enumerate(rules))
    return f"list_max(list_filter([{', '.join(each)}], lambda x: x IS NOT NULL))"


def _strong(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {_hits(column, r.keywords)} > 0 THEN {{'label': '{r.label}', 'category': '{r.category}', 'confidence': {r.confidence}::DOUBLE}}" for r in STRONG) + " END"


_CONF = "round(least(greatest(0.55 + {x}.score / {x}.threshold * 0.16, 0.55), 0.98), 4)::DOUBLE"
CLASSIFIED = f"""{MAILS}, l AS (SELECT *, lower(subject) AS s, lower(subject || chr(10) || body) AS w FROM mails),
st AS (SELECT *, in_reply_to IS NOT NULL OR starts_with(s, 're:') OR starts_with(s, 'fwd:') AS reply, {_best("s", [r for r in RULES if r.excluded])} AS o, coalesce({_strong("s")}, {_strong("w")}) AS g, {_best("w", RULES)} AS z FROM l),
c AS (SELECT *, CASE WHEN reply THEN 'reply' WHEN o IS NOT NULL THEN o.label WHEN g IS NOT NULL THEN g.label WHEN z IS NOT NULL THEN z.label WHEN trim(w) <> '' THEN 'other' ELSE 'needs_review' END AS label,
  CASE WHEN reply THEN 'OTHER' WHEN o IS NOT NULL THEN o.category WHEN g IS NOT NULL THEN g.category WHEN z IS NOT NULL THEN z.category WHEN trim(w) <> '' THEN 'OTHER' ELSE 'NEEDS_REVIEW' END AS category,
  CASE WHEN reply THEN 0.95 WHEN o IS NOT NULL THEN {_CONF.format(x="o")} WHEN g IS NOT NULL THEN g.confidence WHEN z IS NOT NULL THEN {_CONF.format(x="z")} WHEN trim(w) <> '' THEN 0.5 ELSE 0.3 END AS confidence,
  CASE WHEN reply THEN true WHEN o IS NOT NULL THEN o.excluded WHEN g IS NOT NULL THEN false WHEN z IS NOT NULL THEN z.excluded ELSE false END AS is_excluded,
  NOT reply AND o IS NULL AND g IS NULL AND z IS NULL AND trim(w) = '' AS needs_review FROM st)"""


#: The records of project_mails.
EXTRACTED = f"""WITH {b.SQL}, m AS (SELECT *, project_id AS k, unit_min >= 10 AS priced, {_at("project_id % 5", ["Java,AWS", "PHP,Laravel", "C#,SQL", "TypeScript,React", ""])} AS req, {_at("project_id % 3", ["Terraform", "", "GCP,Linux"])} AS pre FROM projects),
  x AS (SELECT *, CASE WHEN priced THEN NULL ELSE '単価' END AS no_price, CASE WHEN start_month IS NULL THEN '開始月' END AS no_start, CASE WHEN req = '' THEN 'スキル' END AS no_skill FROM m)
  SELECT k AS mail_id, title, CASE WHEN priced THEN unit_min END AS unit_min, CASE WHEN priced THEN unit_max END AS unit_max, CASE WHEN priced THEN unit_min END AS upper_min, CASE WHEN priced THEN unit_max END AS upper_max, place,
  CASE place WHEN '名古屋市' THEN '愛知県' WHEN '札幌市' THEN NULL ELSE place END AS prefecture, CASE WHEN year(start_month) >= 2000 THEN start_month ELSE make_date(1998, month(start_month), 1) END AS start, (120 + k % 3 * 10)::INT AS hours_min, (180 + k % 2 * 20)::INT AS hours_max, (k % 3 + 1)::INT AS interviews,
  CASE contract WHEN '準委任' THEN 'SEMI_DELEGATION' WHEN '派遣' THEN 'DISPATCH' WHEN '請負' THEN 'CONTRACT' ELSE 'UNKNOWN' END AS contract,
  CASE remote_type WHEN 'FULL_REMOTE' THEN 'FULL_REMOTE' WHEN 'ONSITE' THEN 'ONSITE' ELSE 'UNKNOWN' END AS remote, CASE WHEN k % 2 = 0 THEN 'エンド→元請' || (k % 3 + 1)::VARCHAR || '社→弊社' END AS chain, CASE WHEN k % 5 <> 4 THEN '第' || (k % 1000)::VARCHAR || '商事' END AS company,
  CASE WHEN k % 8 = 1 THEN '営業' || (k % 50)::VARCHAR ELSE 'desk' END AS contact, CASE WHEN k % 8 < 3 THEN 'sales' || (k % 50)::VARCHAR || '@partner.example' ELSE 'desk@example-corp.com' END AS contact_email, {_at("k % 4", ["NOT_ACCEPTABLE", "NEED_CONFIRMATION", "ACCEPTABLE", "UNKNOWN"])} AS foreign_policy,
  CASE WHEN k % 6 = 0 THEN (30 + k % 3 * 10)::VARCHAR || '代まで' END AS age_condition, req AS required_skills, CASE WHEN k % 4 = 0 THEN pre ELSE '' END AS preferred_skills, req AS used_skills,
  concat_ws(',', no_price, no_start, no_skill) AS missing, round(0.9 - ((no_price IS NOT NULL)::INT + (no_start IS NOT NULL)::INT + (no_skill IS NOT NULL)::INT) / 6 * 0.4, 4)::DOUBLE AS confidence FROM x"""


def oracle_sql() -> dict[str, str]:
    tidy = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(body, chr(13), ''), '[ \\t]+\\n', chr(10), 'g'), '\\n[ \\t]+', chr(10), 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"
    return {
        "mails_normalized": f"""WITH {MAILS} SELECT mail_id, sha256({tidy}) AS body_sha, length(trim(regexp_replace(body, '\\s+', ' ', 'g')))::INT AS search_length,
          coalesce(nullif(substring(trim(regexp_replace(regexp_replace(subject, '^\\s*(re|fw|fwd)\\s*:\\s*', '', 'i'), '\\s+', ' ', 'g')), 1, 255), ''), 'Gmail取込案件') AS subject, string_split(from_email, '@')[2] AS domain, sha256(body) AS body_hash,
          in_reply_to IS NOT NULL OR starts_with(lower(subject), 're:') AS is_reply FROM mails""",
        "page_text": f"""WITH s AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--[\\s\\S]*?-->', ' ', 'g'), '<style[\\s\\S]*?</style>', ' ', 'gi'), '<script[\\s\\S]*?</script>', ' ', 'gi'),
            '<br\\s*/?>', chr(10), 'gi'), '</(p|div|li|tr|h[1-6]|section|article|table)>', chr(10), 'gi'), '<li[^>]*>', chr(10) || '- ', 'gi'), '<[^>]+>', ' ', 'g') AS h FROM pages),
          n AS (SELECT *, string_split(h, '&#')[1] || array_to_string(list_transform(string_split(h, '&#')[2:], lambda x: CASE WHEN regexp_matches(x, '^[0-9]{{1,7}};') THEN chr(regexp_extract(x, '^([0-9]+);', 1)::INT) || regexp_replace(x, '^[0-9]+;', '') ELSE '&#' || x END), '') AS d FROM s),
          e AS (SELECT *, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(d, '&apos;', chr(39), 'gi'), '&gt;', '>', 'gi'), '&lt;', '<', 'gi'), '&nbsp;', ' ', 'gi'), '&quot;', '"', 'gi'), '&amp;', '&', 'gi'), chr(160), ' ') AS body FROM n),
          p AS (SELECT *, {tidy} AS t FROM e)
          SELECT page_id, sha256(t) AS text_sha, length(t)::INT AS n_chars, CASE WHEN page_id % 3 = 1 THEN sha256('See page ' || page_id::VARCHAR || ' of the list.') ELSE sha256(t) END AS body_sha, CASE WHEN page_id % 3 = 1 THEN 'text/plain' ELSE 'text/html' END AS source,
            regexp_extract(lower(url), '^(?:https?://)?(?:www\\.)?([^/?#:]*)', 1) AS domain FROM p""",
        "address_headers": "SELECT c_custkey AS mail_id, 'a' || c_custkey::VARCHAR || '@x.example;b' || c_custkey::VARCHAR || '@mail.y.example' AS addresses, 'Desk, ' || c_name AS name, 'mail.y.example' AS domain FROM customer",
        "mime_bodies": f"""WITH c AS (SELECT DISTINCT conv_id FROM conversations), j AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (turn % 4 <> 3 AND turn <> 1) AS body, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (turn % 4 = 3) AS html FROM conversations WHERE text <> '' GROUP BY 1),
          n AS (SELECT conv_id, {tidy} AS body, html FROM c LEFT JOIN j USING (conv_id)) SELECT conv_id, length(body)::INT AS n_chars, sha256(body) AS body_sha, sha256(html) AS html_sha FROM n""",
        "redacted_mails": f"""WITH {MAILS} SELECT mail_id, sha256(shown) AS shown_sha, length(shown)::INT AS n_chars, CASE WHEN subject = '' THEN '(no subject)' ELSE '[redacted-subject len=' || length(subject)::VARCHAR || ' hash=' || substring(sha256(subject), 1, 12) || ']' END AS subject_mark FROM (SELECT mail_id, subject, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, 'postgres(?:ql)?://\\S+', '[redacted-database-url]', 'gi'), 'Bearer\\s+[A-Za-z0-9._~+/=-]+', 'Bearer [redacted]', 'gi'),
          '(client_secret|refresh_token|access_token|reset_token|resetToken|password|token|secret)=([^&\\s]+)', '\\1=[redacted]', 'gi'), '(DATABASE_URL)\\s*[:=]\\s*[^\\s,;]+', '\\1=[redacted]', 'gi'), '\\s+', ' ', 'g')) AS shown FROM mails)""",
        "classified_mails": f"WITH {CLASSIFIED} SELECT mail_id, label, category, confidence::DOUBLE AS confidence, is_excluded, needs_review FROM c",
        "classification_summary": f"""WITH {CLASSIFIED} SELECT label, count(*) AS n_mails, count(*) FILTER (is_excluded) AS n_excluded, count(*) FILTER (needs_review) AS n_review FROM c
          WHERE classified_by IS DISTINCT FROM 'MANUAL' GROUP BY 1""",
        "text_search": f"""WITH {MAILS}, h AS (SELECT mail_id, lower(trim(subject || ' ' || body)) AS h FROM mails), r AS (SELECT mail_id, regexp_matches(h, '(^|[^a-z0-9])ed([^a-z0-9]|$)') AS has_ed, contains(h, 'tion') AS has_tion,
          regexp_matches(h, '(^|[^a-z0-9])sql([^a-z0-9]|$)') OR len(list_filter(regexp_extract_all(h, '[a-z0-9][a-z0-9.+#-]*'), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g') IN ('mysql', 'postgresql', 'mssql', 'plsql', 'tsql', 'sqlserver'))) > 0 AS has_sql FROM h)
          SELECT * FROM r WHERE has_ed OR has_tion OR has_sql""",
        "mail_stats": f"""WITH {CLASSIFIED}, k AS (SELECT 'total' AS metric, '' AS key, count(*) AS n FROM c UNION ALL SELECT 'since', '', count(*) FILTER (received_at >= TIMESTAMP '2024-01-01 06:00:00') FROM c
          UNION ALL SELECT 'category', category || ':' || CASE WHEN is_excluded THEN 'excluded' ELSE 'open' END, count(*) FROM c GROUP BY 2
          UNION ALL SELECT 'link', CASE WHEN l_orderkey % 2 = 0 THEN 'PROJECT' ELSE 'PERSON' END || ':' || CASE WHEN l_returnflag = 'R' THEN 'REVIEW_CANDIDATE' ELSE 'EXTRACTED' END, count(*) FROM lineitem GROUP BY 2) SELECT k.*, a AS first_received, z AS last_received FROM k, (SELECT min(received_at) AS a, max(received_at) AS z FROM c)""",
        "sender_subject_groups": f"WITH {MAILS}, n AS (SELECT lang AS from_email, lower(trim(regexp_replace(regexp_replace(subject, '^\\s*(re|fw|fwd)\\s*:\\s*', '', 'i'), '\\s+', ' ', 'g'))) AS subject_key FROM mails) SELECT from_email, subject_key, count(*) AS n_mails FROM n GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 20",
        "extracted_projects": EXTRACTED,
    }
