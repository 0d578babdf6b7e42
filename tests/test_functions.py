"""Column functions on small, written-out cases."""

import datetime

from pyspark.sql import functions as F

from deskmatch.functions import market, rules
from deskmatch.functions import text as t
from deskmatch.functions.mail_rules import STRONG, WEIGHTED
from deskmatch.operators import company, extract, imports, reports
from deskmatch.operators.classify import classify_mails


def values(spark, f, cases, kind="string"):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, c {kind}")
    return [r.v for r in rows.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_skills_regions_styles_and_months(spark):
    assert values(spark, market.skill_name, [" JAVA ", "react.js", "Amazon Web Services", "Type-Script", "Go", "", None, "　js　"]) == ["Java", "React", "AWS", "TypeScript", "Go", "unknown", "unknown", "JavaScript"]
    assert values(spark, market.region, ["東京都渋谷区", "梅田", "名古屋", "札幌", None]) == ["東京", "大阪", "愛知", "unknown", "unknown"]
    assert values(spark, lambda c: market.work_style(F.lit("unknown"), c), ["フルリモート", "週2出社", "リモート可", "常駐", "", None]) == ["FULL_REMOTE", "HYBRID", "REMOTE", "ONSITE", "UNKNOWN", "UNKNOWN"]
    assert values(spark, market.month_key, ["2026-7", "2026/07", "2026年7月", "202607", "soon", None]) == ["2026-07"] * 4 + ["unknown"] * 2
    assert values(spark, market.contract_type, ["準委任", "dispatch", "請負", "other work", "", "semi_delegation"]) == ["SEMI_DELEGATION", "DISPATCH", "CONTRACT", "OTHER", "UNKNOWN", "SEMI_DELEGATION"]


def test_price_bands(spark):
    assert values(spark, market.price_band, [30.0, 30.5, 35.0, 119.9, 120.0, 0.0, -1.0, None, float("nan")], "double") == ["under_30", "30_35", "35_40", "115_120", "120_over", *["unknown"] * 4]
    assert [k for k, *_ in rules.PRICE_BANDS][:3] == ["under_30", "30_35", "35_40"] and len(rules.PRICE_BANDS) == 21


def test_html_and_body_text(spark):
    page = "<style>x{}</style><!-- no --><p>A &amp; B&nbsp;&#67;&#x1F600;&copy;</p><ul><li>one<li class='x'>two</ul><script>bad()</script>x<br/>y"
    assert values(spark, t.html_text, [page, None]) == ["A & B C😀&copy;\n\n- one\n- two x\ny", None]
    assert values(spark, t.body_text, [" a \r\n\n\n\n b\t\tc  ", "  ", None]) == ["a\n\nb c", None, None]
    assert values(spark, lambda c: t.best_body(t.body_text(c), F.lit("w " * 200))[1], ["see https://x.example こちら", "a real text", "https://x.example", None]) == ["text/html", "text/plain", "text/html", "text/html"]


def test_addresses_subjects_and_marks(spark):
    assert values(spark, t.addresses, ['"Doe, A" <A@x.example>, b@y.example', None]) == [["a@x.example", "b@y.example"], []]
    assert values(spark, t.first_name, ['"Doe, A" <A@x.example>, b@y.example']) == ["Doe, A"]
    assert values(spark, t.clean_subject, ["Re: [SES配信] hello  you", "", None]) == ["hello you", "Gmail取込案件", "Gmail取込案件"]
    assert values(spark, t.site_domain, ["https://www.X.example/a?b", "nodot", "a@m.example"]) == ["x.example", None, "m.example"]
    assert values(spark, t.without_signature, ["x" * 250 + "差出人: y", "short -- y"]) == ["x" * 250, "short -- y"]
    shown = values(spark, lambda c: t.redacted(c, 90), ["a token=abc&x postgres://u:p@h Bearer abc.d"])[0]
    assert shown == "a token=[redacted]&x [redacted-database-url] Bearer [redacted]"
    assert values(spark, lambda c: t.epoch_time(c, F.lit("Mon, 1 Jan 2024 00:00:00 +0000")), ["0", "x"]) == [datetime.datetime(1970, 1, 1), datetime.datetime(2024, 1, 1)]


def test_search_terms(spark):
    cases = [("Go developer", "go", True), ("Django", "go", False), ("MySQL and more", "sql", True), ("nosqlx", "sql", False), ("C# .NET", ".net", True), ("anything", "", True), ("JavaScript", "java", True)]
    for text, term, want in cases:
        assert values(spark, lambda c, term=term: t.matches_term(c, term), [text]) == [want]


def test_default_rules_classify(spark):
    mails = [("【案件】", "Java開発 単価80万円", None), ("要員のご紹介", "経歴書", None), ("セミナーのご案内", "x", None), ("Re: 案件", "x", None), ("hello", "plain words", None), (None, None, None)]
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(mails)], "mail_id int, subject string, body string, in_reply_to string").withColumn("references_header", F.lit(None).cast("string"))
    got = [(r.label, float(r.confidence), r.is_excluded, r.needs_review) for r in classify_mails(df, WEIGHTED, STRONG).orderBy("mail_id").collect()]
    assert got == [("project_intro", 0.9, False, False), ("person_intro", 0.93, False, False), ("seminar", 0.71, True, False), ("reply", 0.95, True, False), ("other", 0.5, False, False), ("needs_review", 0.3, False, True)]


MAIL = "案件名：基幹刷新\n必須スキル：Java、AWS\n尚可スキル：Terraform\n単価：80万円〜90万円\n勤務地：渋谷\n精算：140〜180\n面談：面談２回\n開始：2026年7月\n商流：元請\n準委任 外国籍不可 年齢：50代まで リモート併用"


def test_project_fields(spark):
    df = spark.createDataFrame([(1, "Re: 案件のご紹介", MAIL, "A", "a@x.example")], "mail_id int, subject string, body string, from_name string, from_email string")
    r = extract.extract_projects(df, "2026-06-15").first()
    assert (r.title, r.unit_min, r.unit_max, r.place, r.prefecture, r.start, r.hours_min, r.hours_max, r.interviews, r.chain) == ("基幹刷新", 80, 90, "渋谷", "東京都", datetime.date(2026, 7, 1), 140, 180, 2, "元請")
    assert (r.required_skills, r.preferred_skills, r.contract, r.foreign_policy, r.remote, r.predicted_type, r.missing) == (["Java", "AWS", "Terraform"], ["Terraform"], "SEMI_DELEGATION", "NOT_ACCEPTABLE", "HYBRID", "project", [])


def test_person_fields(spark):
    body = "氏名：山田 太郎\n年齢：35歳\nスキル：PHP, Laravel\n希望単価：70万円\n最寄：横浜\n経歴書あり"
    df = spark.createDataFrame([(12345678901, "要員のご紹介", body), (2, "K.S（35歳）Javaエンジニア", "スキルシート添付")], "mail_id long, subject string, body string")
    a, b = extract.extract_persons(df).orderBy(F.desc("mail_id")).collect()
    assert (a.name, a.name_source, a.name_confidence, a.skills, a.desired, a.age, a.place) == ("山田 太郎", "body_labeled_field", "HIGH", ["PHP", "Laravel"], 70, 35, "横浜")
    assert b.name is None and b.initials == "K.S" and b.display_name == "K.S" and b.needs_review and b.role == "Javaエンジニア"


def test_company_and_contact_keys(spark):
    assert values(spark, company.company_key, ["株式会社ABC", "ＡＢＣ Co., Ltd.", "abc", None]) == ["abc", "abc", "abc", ""]
    assert values(spark, company.contact_keys, ["Mr. John Smith", "山田様", None]) == [["johnsmith"], ["山田"], []]
    assert values(spark, company.parent_domains, ["a.b.example.com"]) == [["a.b.example.com", "b.example.com", "example.com"]]


def test_import_checks(spark):
    assert values(spark, imports.split_skills, ["Java、 AWS/Go,, PHP", None]) == [["Java", "AWS", "Go", "PHP"], []]
    assert values(spark, imports.valid_price, ["80万円", "応相談", "abc", None, "７０〜８０"]) == [True, True, False, True, True]
    assert values(spark, imports.valid_date, ["2026-07", "即日", "soon", None]) == [True, True, False, True]
    assert imports.map_headers(["案件名", "未使用列", "スキル", "必須スキル"], imports.PROJECT_HEADERS)[1] == ["未使用列"]
    kinds = imports.detect_row_type(spark.createDataFrame([("a", "b", "c")], "`案件名` string, `作業内容` string, `氏名` string")).first()
    assert (kinds.row_type, kinds.project_score, kinds.person_score) == ("project", 4, 2)


def test_buckets_and_sensitive_rows(spark):
    assert values(spark, reports.score_bucket, [0, 2, 3, 9, 10], "int") == ["0", "1-2", "3-5", "6-9", "10+"]
    assert values(spark, reports.skill_bucket, [0, 3, 15, 16], "int") == ["0", "1-3", "11-15", "16+"]
    df = spark.createDataFrame([(1, "fine"), (2, "a@x.example"), (3, None)], "id int, note string")
    assert [r.id for r in reports.sensitive_rows(df).collect()] == [2]
