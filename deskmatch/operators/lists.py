"""Search, filters, orders, pages and wide rows of entity lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import email_domain, filled, matches_term
from .company import sender_company


def search_text(*columns: str):
    return F.lower(F.concat_ws(" ", *columns))


def text_filters(rows: DataFrame, hay, text: str, exclude: str, ids: str, created_from: str | None, created_to: str | None, id_column: str) -> DataFrame:
    """What both lists filter by: a text, a text to leave out, a part of the id, a range of days of creation."""
    out = rows.filter(matches_term(hay, text))
    out = out.filter(~matches_term(hay, exclude)) if exclude else out
    out = out.filter(F.contains(F.lower(F.col(id_column).cast("string")), F.lit(ids.lower()))) if ids else out
    out = out.filter(F.col("created_at") >= F.lit(created_from).cast("timestamp")) if created_from else out
    return out.filter(F.col("created_at") < F.date_add(F.lit(created_to).cast("date"), 1).cast("timestamp")) if created_to else out


def filter_projects(rows: DataFrame, text: str = "", exclude: str = "", ids: str = "", created_from: str | None = None, created_to: str | None = None, month_from: str | None = None, month_to: str | None = None, skill: str | None = None, price_from: int | None = None, price_to: int | None = None, price_open: bool = False,
                    prefecture: str | None = None, remote: str | None = None, work_days: list[str] | None = None, trade_result: bool = False, no_trade_ng: bool = False, no_foreign: bool = False, ages: list[str] | None = None, mine: str | None = None, focus: bool = False, recruiting: bool = False) -> DataFrame:
    """Project rows (project_id, title, place, skills, start_month, price, remote_type, status, is_focus, created_at and, where asked for, prefecture, work_days, has_result, has_trade_ng, foreign_policy, age_condition, created_by).

    A missing start month passes a month range; price_open: rows without a price; ages: decades such as 50, of which the age condition has to name one.
    """
    out = text_filters(rows, search_text("title", "place", "skills"), text, exclude, ids, created_from, created_to, "project_id")
    if month_from:
        out = out.filter(F.col("start_month").isNull() | (F.date_format("start_month", "yyyy-MM") >= month_from))
    if month_to:
        out = out.filter(F.col("start_month").isNull() | (F.date_format("start_month", "yyyy-MM") <= month_to))
    if skill:
        out = out.filter(matches_term(F.col("skills"), skill))
    if price_open:
        out = out.filter("price IS NULL OR price = 0")
    if price_from is not None:
        out = out.filter(F.col("price") >= price_from)
    if price_to is not None:
        out = out.filter(F.col("price") <= price_to)
    for column, value in (("prefecture", prefecture), ("remote_type", remote), ("created_by", mine)):
        out = out.filter(F.col(column) == value) if value else out
    if work_days:
        out = out.filter(F.col("work_days").isin(work_days))
    if ages:
        out = out.filter(F.col("age_condition").rlike("|".join(f"{a}(代|歳)" for a in ages)))
    for asked, test in ((trade_result, "has_result"), (no_trade_ng, "NOT has_trade_ng"), (no_foreign, "foreign_policy = 'NOT_ACCEPTABLE'"), (focus, "is_focus")):
        out = out.filter(test) if asked else out
    return out.filter("status = 'OPEN'") if recruiting else out


def filter_persons(rows: DataFrame, text: str = "", exclude: str = "", ids: str = "", created_from: str | None = None, created_to: str | None = None, skill: str | None = None, statuses: list[str] | None = None, age_from: int | None = None, age_to: int | None = None, price_from: int | None = None, price_to: int | None = None, price_open: bool = False,
                   month_to: str | None = None, remote: list[str] | None = None, trade_result: bool = False, no_trade_ng: bool = False, foreign: bool = False, mine: str | None = None, available: bool = False) -> DataFrame:
    """Person rows (person_id, name, place, skills, summary, age, desired, available, status, created_at and, where asked for, remote_wish, nationality, has_result, has_trade_ng, created_by); remote: any of the texts; foreign: not of Japan."""
    out = text_filters(rows, search_text(*(c for c in ("name", "place", "skills", "summary") if c in rows.columns)), text, exclude, ids, created_from, created_to, "person_id")
    if skill:
        out = out.filter(matches_term(F.col("skills"), skill))
    if statuses:
        out = out.filter(F.col("status").isin(statuses))
    if month_to:
        out = out.filter(F.col("available").isNull() | (F.date_format("available", "yyyy-MM") <= month_to))
    if price_open:
        out = out.filter("desired IS NULL OR desired = 0")
    for column, low, high in (("age", age_from, age_to), ("desired", price_from, price_to)):
        out = out.filter(F.col(column) >= low) if low is not None else out
        out = out.filter(F.col(column) <= high) if high is not None else out
    if remote:
        out = out.filter(F.exists(F.array(*map(F.lit, remote)), lambda w: F.contains("remote_wish", w)))
    if mine:
        out = out.filter(F.col("created_by") == mine)
    for asked, test in ((trade_result, "has_result"), (no_trade_ng, "NOT has_trade_ng"), (foreign, "nationality != '' AND NOT nationality RLIKE '日本'"), (available, "status = 'AVAILABLE'")):
        out = out.filter(test) if asked else out
    return out


def filter_unclassified(mails: DataFrame, entities: DataFrame, links: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """Mails left to a person: three categories, not excluded, without an active entity or link.

    companies (company_id, name, domain, trade_status): adds the sender's company (or name, or domain) and its trade flags, for mails with from_name and from_email.
    """
    out = mails.filter("category IN ('OTHER', 'NEEDS_REVIEW', 'NORMAL_CONTACT') AND NOT is_excluded")
    active = entities.filter("status != 'ARCHIVED'").select(F.col("source_mail_id").alias("mail_id")).distinct()
    out = out.join(active, "mail_id", "left_anti").join(links.select("mail_id").distinct(), "mail_id", "left_anti").withColumn("needs_review", F.col("category") == "NEEDS_REVIEW")
    if companies is None:
        return out
    found = sender_company(out, companies).join(companies.select("company_id", "trade_status"), "company_id", "left").select("mail_id", "company_name", F.coalesce("trade_status", F.lit("UNKNOWN")).alias("_status"))
    out = out.join(found, "mail_id", "left")
    sender = F.coalesce("company_name", filled(F.col("from_name")), email_domain(F.col("from_email")), F.lit("未入力"))
    return out.withColumns({"sender_company": sender, "has_result": F.col("_status") == "OK", "has_trade_ng": F.col("_status").isin("NG", "SUSPENDED")}).drop("_status")


def _before(order: list[tuple[str, bool]], values: tuple) -> Column:
    """Does a row stand before the values in an order of (column, descending)? Nulls are first, or last in a descending column."""
    out = F.lit(False)
    for (column, descending), value in reversed(list(zip(order, values))):
        x = F.col(column)
        if value is None:
            less, same = (x.isNotNull() if descending else F.lit(False)), x.isNull()
        else:
            less, same = (F.coalesce(x > value, F.lit(False)) if descending else (x < value) | x.isNull()), F.coalesce(x == value, F.lit(False))
        out = less | (same & out)
    return out


def deep_page(rows: DataFrame, order: list[tuple[str, bool]], page: int, size: int, cuts: int = 64, most: int = 100_000) -> DataFrame:
    """A page of rows in an order of (column, descending) with its number, of how many pages, and each row's place.

    The order has to tell all rows apart. Instead of sorting what comes before the page, rows are counted in ranges between
    cuts drawn from them, and the range that the page begins in is cut again, until it has at most so many rows; only these
    and what fills the page from the next ones are sorted. Each pass over the rows gives a count for each range.
    """
    names = [c for c, _ in order]
    by = [F.desc(c) if d else F.asc(c) for c, d in order]
    total, found, first = rows.count(), rows, 0
    pages = max(1, -(-total // size))
    page = min(max(1, page), pages)
    start, held = (page - 1) * size, total
    while held > most:
        drawn = found.select(*names).orderBy(F.xxhash64(*names)).limit(cuts).collect()  # the cuts
        edges = [tuple(r) for r in found.sparkSession.createDataFrame(drawn, found.select(*names).schema).orderBy(*by).collect()]
        at = sum((F.when(_before(order, e), 0).otherwise(1) for e in edges), F.lit(0))
        counts = dict(found.groupBy(at.alias("at")).agg(F.count("*").alias("n")).collect())
        before = first
        k = 0
        while before + counts.get(k, 0) <= start and k < len(edges):
            before, k = before + counts.get(k, 0), k + 1
        end = k  # the page may go on in the next ranges
        taken = counts.get(k, 0)
        while before + taken < min(start + size, total) and end < len(edges):
            end += 1
            taken += counts.get(end, 0)
        if taken == held:
            break
        lower = ~_before(order, edges[k - 1]) if k else F.lit(True)
        upper = _before(order, edges[end]) if end < len(edges) else F.lit(True)
        found, first, held = found.filter(lower & upper), before, taken
    out = found.orderBy(*by).offset(start - first).limit(size)
    place = F.row_number().over(Window.orderBy(*by)) + start
    return out.withColumns({"page": F.lit(page), "pages": F.lit(pages), "place_no": place.cast("long")})


def sorted_rows(rows: DataFrame, sort: str, name: str, price: str, key: str) -> DataFrame:
    """newest, name (Japanese order), price_desc or price_asc; ties by key."""
    orders = {"newest": [F.desc_nulls_last("created_at")], "name": [F.collate(F.col(name), "ja")], "price_desc": [F.desc_nulls_last(price)], "price_asc": [F.asc_nulls_last(price)]}
    return rows.orderBy(*orders[sort], key)


def paginate(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """A page of rows with its number, of how many pages, and the row's place in all rows."""
    n = rows.count()
    pages = max(1, -(-n // size))
    page = min(max(1, page), pages)
    found = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    place = F.row_number().over(Window.orderBy(*order)) + (page - 1) * size
    return found.withColumns({"page": F.lit(page), "pages": F.lit(pages), "place_no": place})


def project_list(projects: DataFrame, skills: DataFrame, roles: DataFrame, companies: DataFrame, results: DataFrame, contacts: DataFrame, mails: DataFrame) -> DataFrame:
    """One wide row a project: skills by type, first role's company, its trade flags and contact, chain of roles, price as text and value, its mail, whether a result is there. Children are reduced to one row before joins.

    roles: project_id, role, sort_order, company_id, contact_id; companies: company_id, name, trade_status; contacts: contact_id, name; mails: project_id, subject, from_email.
    """
    of = lambda t: F.array_join(F.array_sort(F.collect_set(F.when(F.col("skill_type") == t, F.col("skill_name")))), ",")
    skill_rows = skills.groupBy("project_id").agg(of("REQUIRED").alias("required_skills"), of("PREFERRED").alias("preferred_skills"), of("USED_TECHNOLOGY").alias("used_skills"))
    named = roles.join(companies.select("company_id", "name", "trade_status"), "company_id", "left").join(contacts.select("contact_id", F.col("name").alias("contact")), "contact_id", "left")
    place = F.when(F.col("role") == "UPPER", 0).when(F.col("role") == "PRIME", 1).when(F.col("role") == "END_USER", 2).otherwise(3)
    first = F.min_by(F.struct("name", "trade_status", "contact"), F.struct(place, "sort_order"))
    role_rows = named.groupBy("project_id").agg(first.alias("_first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "name"))), lambda x: x["name"]), ">").alias("chain"))
    newest = results.groupBy("project_id").agg(F.max_by("needs_review", F.struct("created_at", "result_id")).alias("needs_review"))
    price = F.when(F.col("unit_min").isNull() & F.col("unit_max").isNull(), "").when(F.col("unit_min") == F.col("unit_max"), F.concat("unit_max", F.lit("万円"))).otherwise(F.concat(F.coalesce(F.col("unit_min").cast("string"), F.lit("")), F.lit("〜"), F.coalesce(F.col("unit_max").cast("string"), F.lit("")), F.lit("万円")))
    out = projects.drop("needs_review").join(skill_rows, "project_id", "left").join(role_rows, "project_id", "left").join(newest, "project_id", "left").join(mails.select("project_id", "subject", "from_email"), "project_id", "left")
    status = F.coalesce("_first.trade_status", F.lit("UNKNOWN"))
    return out.select(
        "project_id", "title", "status", F.col("_first.name").alias("company"), F.col("_first.contact").alias("contact"), (status == "OK").alias("has_trade_result"), status.isin("NG", "SUSPENDED").alias("has_trade_ng"), "chain", price.alias("price_text"), F.coalesce("unit_max", "unit_min", F.lit(0)).alias("price_value"),
        "required_skills", "preferred_skills", "used_skills", F.col("subject").alias("mail_subject"), F.col("from_email").alias("mail_from"), F.col("needs_review").isNotNull().alias("has_result"), F.coalesce("needs_review", F.lit(False)).alias("needs_review"),
    )


def person_list(persons: DataFrame, skills: DataFrame, companies: DataFrame, contacts: DataFrame, results: DataFrame) -> DataFrame:
    """One wide row a person (person_id, name, initials, company_id, contact_id, ...): skills, owner, contact, price text, trade flags and what the newest result says. Children are reduced to one row before joins."""
    skill_rows = skills.groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_set("skill_name")), " / ").alias("skills"))
    fields = [c for c in ("needs_review", "name_confidence", "role_headline", "review_status") if c in results.columns]
    newest = results.groupBy("person_id").agg(F.max_by(F.struct(*fields), F.struct("created_at", "result_id")).alias("r"))
    owners = companies.select("company_id", F.col("name").alias("company"), "trade_status")
    out = persons.join(skill_rows, "person_id", "left").join(owners, "company_id", "left").join(contacts.select("contact_id", F.col("name").alias("contact")), "contact_id", "left").join(newest, "person_id", "left")
    status = F.coalesce("trade_status", F.lit("UNKNOWN"))
    text = lambda c, other: F.coalesce(F.col(c), F.lit(other))
    return out.select(
        "person_id", "name", "status", text("company", "未入力").alias("company"), text("contact", "未入力").alias("contact"), F.when(F.coalesce("desired", F.lit(0)) != 0, F.concat(F.col("desired").cast("string"), F.lit("万円"))).otherwise("未定").alias("price_text"),
        F.coalesce("desired", F.lit(0)).alias("price_value"), F.coalesce(F.date_format("available", "yyyy-MM-dd"), F.lit("未入力")).alias("available_text"), text("skills", "未入力").alias("skills"), (status == "OK").alias("has_result"), status.isin("NG", "SUSPENDED").alias("has_trade_ng"),
        *(F.coalesce(F.col(f"r.{c}"), F.lit(False) if c == "needs_review" else F.lit("")).alias(c) for c in fields),
    )


def search_history(rows: DataFrame, most: int = 20) -> DataFrame:
    """The newest searches of each user and scope."""
    order = Window.partitionBy("user_id", "scope").orderBy(F.desc("created_at"), F.desc("id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= min(most, 50))
