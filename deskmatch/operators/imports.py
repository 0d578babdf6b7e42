"""Spreadsheet imports: headers, types, checks, duplicates, records, links and summaries."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import filled, trimmed
from ..sources.tables import dealt_out, written
from .matching import plain

#: Headers of each field, in order (a later one wins), and limits.
PROJECT_HEADERS = {"title": ["案件名", "タイトル", "title"], "company": ["会社名", "上位会社", "company"], "work": ["作業内容", "業務内容", "work"], "skills": ["必須スキル", "スキル", "skills"], "price": ["単価", "price"], "start": ["開始月", "稼働開始", "start"], "place": ["勤務地", "作業場所", "place"]}
PERSON_HEADERS = {"name": ["氏名", "名前", "name"], "initials": ["イニシャル", "initials"], "skills": ["スキル", "skills"], "role": ["職種", "role"], "start": ["稼働開始", "稼働可能日", "start"], "price": ["希望単価", "price"], "company": ["所属会社", "所属", "company"], "place": ["最寄駅", "place"]}
#: Fields of exported tables with header weight, kind of value and headers, in order.
PROJECT_TABLE = {
    "title": (3, None, ["案件名", "案件タイトル", "プロジェクト名", "title", "project title", "projectName", "name"]),
    "workDescription": (2, None, ["作業内容", "案件内容", "内容", "workDescription", "workContent", "description", "work"]),
    "businessDescription": (2, None, ["業務内容", "業務概要", "businessDescription", "businessContent", "business"]),
    "unitPrice": (1.5, "amount", ["単価", "金額", "amount", "unitPrice", "price", "rate", "月額", "予算"]),
    "upperAmount": (1, "amount", ["上位金額", "上位単価", "上位額", "upperAmount", "upperPrice"]),
    "workLocation": (1.5, None, ["勤務地", "場所", "location", "workLocation", "site", "最寄", "最寄駅"]),
    "skills": (1, "skills", ["スキル", "必須スキル", "必要スキル", "技術", "skills", "skill", "requiredSkills", "technology", "technologies"]),
    "startMonth": (1, "date", ["開始", "開始月", "稼働開始", "参画時期", "start", "startMonth", "availableFrom"]),
    "commercialFlow": (2, None, ["商流", "商流制限", "flow", "commercialFlow"]),
    "upperCompany": (2, None, ["上位会社", "上位", "会社名", "company", "upperCompany"]),
    "endClient": (2, None, ["エンド", "エンドユーザー", "エンド会社", "end", "endClient", "endUser"]),
    "primeCompany": (2, None, ["元請", "元請会社", "プライム", "prime", "primeCompany", "primeContractor"]),
    "status": (0.5, None, ["ステータス", "状態", "status"]),
    "focus": (0.5, "focus", ["注力", "注力案件", "focus", "isFocus"]),
}
PERSON_TABLE = {
    "name": (3, None, ["氏名", "名前", "要員名", "人材名", "name", "personName"]),
    "initials": (2.5, None, ["イニシャル", "initial", "initials"]),
    "skills": (1, "skills", ["スキル", "保有スキル", "skill", "skills", "technology", "technologies"]),
    "desiredUnitPrice": (2, "amount", ["希望単価", "単価", "金額", "amount", "desiredUnitPrice", "rate", "price"]),
    "ownerCompany": (1.5, None, ["所属", "所属会社", "会社", "会社名", "company", "ownerCompany"]),
    "availableFrom": (1.5, "date", ["稼働開始", "開始", "参画可能", "availableFrom", "availability", "start"]),
    "nationality": (2, None, ["国籍", "nationality"]),
    "age": (2, "age", ["年齢", "age"]),
    "status": (0.5, None, ["ステータス", "状態", "status"]),
    "focusNote": (0.5, "focus", ["注力", "注力要員", "focus"]),
    "roleHeadline": (1, None, ["職種", "役割", "ロール", "role", "roleHeadline", "position"]),
}
#: What a cell may not show, the longest cell, the least coverage, and texts that put a value off.
SENSITIVE_CELL = [r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", r"(?i)\b(?:postgres(?:ql)?|mysql|sqlserver)://", r"(?i)\b(?:DATABASE_URL|DIRECT_URL|SMTP_PASSWORD|GMAIL_REFRESH_TOKEN|API[_-]?KEY|TOKEN|PASSWORD|SECRET)\b", r"(?i)\bBearer\s+[A-Za-z0-9._-]+", "-----BEGIN [A-Z ]+KEY-----", r"(?i)[A-Z]:[\\/]", r"[\\/](?:Users|home)[\\/]"]
LONG_CELL, TABLE_COVERAGE = 180, 0.35
PUT_OFF = {"amount": r"(?i)^(応相談|要相談|未定|調整|ASK|TBD)\z", "date": r"(?i)^(即日|随時|応相談|要相談|未定|調整|ASAP|TBD)\z"}
READ = {"date": r"^\d{4}[-/]\d{1,2}([-/]\d{1,2})?\z|^\d{4}年\d{1,2}月(\d{1,2}日)?\z|^\d{1,2}月(\d{1,2}日)?\z", "focus": r"(?i)^(true|false|yes|no|1|0|該当|非該当|あり|なし|有|無|注力)\z"}
#: Fixed value: what the token form of a cell or header leaves out.
TOKEN_SIGNS = r"[\s\uFEFF_\-ー・･/／|:：()（）［］\[\]【】「」『』,，.．]"
REQUIRED = {"project": ["title", "work", "skills"], "person": ["name", "skills"]}
MOST_SKILLS, LEAST_COVERAGE, PRICE_SLACK = 15, 0.5, 5
#: Rows of the existing side for each part of a join of duplicates.
JOINED_ROWS = 2_000


def token_text(text: str) -> str:
    """The token form of a header: what token() gives of a cell."""
    return re.sub(TOKEN_SIGNS, "", unicodedata.normalize("NFKC", text.strip().lower()))


def token(c: Column) -> Column:
    """The form in which cells are compared: trimmed, lower case, NFKC, without blanks and signs; null and blank are empty."""
    return F.regexp_replace(plain(F.lower(trimmed(F.coalesce(c.cast("string"), F.lit(""))))), TOKEN_SIGNS.replace(r"\s", r"\s\p{Z}"), "")


def map_headers(headers: list[str], fields: dict[str, list[str]]) -> tuple[dict[str, list[str]], list[str]]:
    """Columns of each field, in the order of its synonyms, and the headers that no field takes. Headers and synonyms meet in their token form; of fields that share a synonym the later one takes it."""
    owner = {token_text(s): field for field, synonyms in fields.items() for s in synonyms}
    known = {field: [h for s in dict.fromkeys(map(token_text, synonyms)) if owner[s] == field for h in headers if token_text(h) == s] for field, synonyms in fields.items()}
    used = {h for columns in known.values() for h in columns}
    return known, [h for h in headers if h not in used]


def mapped(rows: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """row_no, source and the fields, each the first that isn't blank among its columns."""
    known, _ = map_headers([c for c in rows.columns if c not in ("row_no", "source")], fields)
    value = lambda columns: F.coalesce(*(filled(trimmed(F.col(f"`{c}`"))) for c in columns)) if columns else F.lit(None).cast("string")
    return rows.select("source", "row_no", *(value(c).alias(f) for f, c in known.items()))


def split_skills(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;、，／/・|\\n]"), trimmed), lambda s: s != "")


def price_number(c: Column) -> Column:
    """The first number of a price, its unit aside."""
    return F.regexp_extract(plain(c), r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def valid_price(c: Column) -> Column:
    text = trimmed(plain(F.coalesce(c, F.lit(""))))
    return (text == "") | text.rlike("応相談|スキル見合い|相談|TBD") | text.rlike(r"^[\d,.〜~\-万円/月以上以下前後 ]*\d[\d,.〜~\-万円/月以上以下前後 ]*\z")


def valid_date(c: Column) -> Column:
    text = trimmed(plain(F.coalesce(c, F.lit(""))))
    return (text == "") | text.rlike("即日|随時|相談") | text.rlike(r"^(\d{4}[-/年.]\d{1,2}([-/月.]\d{1,2}日?|月)?|\d{1,2}月|\d{1,2}/\d{1,2})")


def low_confidence_title(c: Column) -> Column:
    return (F.length(c) < 4) | c.rlike("^(案件|テスト|test|未定|TBD|サンプル)\\z")


def low_confidence_name(name: Column, initials: Column) -> Column:
    return initials.isNull() & (name.isNull() | name.rlike("(?i)未定|不明|サンプル|test|テスト|要員|人材") | (F.length(name) < 2))


def duplicate_key(kind: str, who: Column, skills: Column, *more: Column) -> Column:
    """Twelve digits of the hash of a row's kind, title or identity, further cells and first eight skills (an array), in their token form; null for a row with neither title nor skill."""
    name, listed = token(who), token_list(F.slice(skills, 1, 8))
    key = F.substring(F.sha2(F.concat_ws("\n", F.lit(kind), name, *map(token, more), F.array_join(listed, "|")), 256), 1, 12)
    return F.when((name != "") | (F.array_join(listed, "") != ""), key)


def token_list(skills: Column) -> Column:
    """Token forms of an array of texts. All pass the helper for NFKC as one text, as it takes no arrays; no text may hold a line break."""
    return F.transform(F.split(plain(F.array_join(F.transform(skills, lambda s: F.lower(trimmed(s))), "\n")), "\n"), lambda s: F.regexp_replace(s, TOKEN_SIGNS.replace(r"\s", r"\s\p{Z}"), ""))


def assess_rows(rows: DataFrame, kind: str) -> DataFrame:
    """Adds skill_list, coverage, warnings (array), action and duplicate_key to mapped rows."""
    fields = PROJECT_HEADERS if kind == "project" else PERSON_HEADERS
    present = [F.col(f).isNotNull().cast("int") for f in fields]
    filled_in = sum(present, F.lit(0))
    out = rows.withColumns({"skill_list": split_skills(F.col("skills")), "n_filled": filled_in, "coverage": F.round(filled_in / len(fields), 4)})
    who = F.coalesce("name", "initials") if kind == "person" else F.col("title")
    weak = low_confidence_name(F.col("name"), F.col("initials")) if kind == "person" else F.coalesce(low_confidence_title(F.col("title")), F.lit(False))
    tests = [(F.col("name" if kind == "person" and f == "name" else f).isNull() & (F.col("initials").isNull() if f == "name" else F.lit(True)), f"MISSING_{f.upper()}") for f in REQUIRED[kind]]
    tests += [(F.col("coverage") < LEAST_COVERAGE, "LOW_COVERAGE"), (~valid_price(F.col("price")), "INVALID_PRICE"), (~valid_date(F.col("start")), "INVALID_DATE"), (weak & who.isNotNull(), "LOW_CONFIDENCE"), (F.size("skill_list") > MOST_SKILLS, "TOO_MANY_SKILLS")]
    out = out.withColumn("warnings", F.array_compact(F.array(*(F.when(t, c) for t, c in tests))))
    action = F.when(F.col("n_filled") == 0, "would_skip").when(F.size("warnings") > 0, "would_need_review").otherwise("would_create")
    more = [F.col("start")] if kind == "person" else [F.col("start"), F.col("company")]
    return out.withColumns({"action": action, "duplicate_key": duplicate_key(kind, who, F.col("skill_list"), *more)}).drop("n_filled")


def source_duplicates(assessed: DataFrame) -> DataFrame:
    """Adds same_rows: rows of the same key that are not skipped; none for rows without a key."""
    counted = (F.col("action") != "would_skip") & F.col("duplicate_key").isNotNull()
    key = F.coalesce("duplicate_key", F.concat_ws(":", "source", "row_no"))  # rows without a key don't meet
    return assessed.withColumn("same_rows", F.when(counted, F.sum(counted.cast("int")).over(Window.partitionBy(key))).otherwise(0))


def skill_pairs(skills: Column) -> Column:
    """Each two of a sorted array's tokens, as one text."""
    return F.flatten(F.transform(skills, lambda s, i: F.transform(F.slice(skills, i + 2, F.size(skills)), lambda t: F.concat_ws(" ", s, t))))


def db_duplicates(rows: DataFrame, existing: DataFrame, which: Column | None = None) -> DataFrame:
    """row key (id), existing_id, strength, of the pairs that which holds for (r_id, e_id; default: all): strong for the same title and company; with two common skills, strong for the same place and a near price, weak for one of them.

    Both sides: id, title, company, skill_list, place, price_value; texts and skills meet in their token form, skills of one
    character don't count. Two skills must agree, so rows are joined by (two skills, place) and by (two skills, price range):
    what meets by place is a duplicate, what meets by price is one in about two of three cases. Each pair is found in one of the
    three joins alone, so that pairs are not moved again.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        """Token forms, and of texts their hashes too: two rows are told apart by a number, and texts are compared only where hashes agree."""
        title, company, place = (token(F.col(c)) for c in ("title", "company", "place"))
        out = df.select("id", F.when((title != "") & (company != ""), F.concat_ws("\n", title, company)).alias("named"), place.alias("place"), F.array_sort(F.array_distinct(F.filter(token_list(F.col("skill_list")), lambda s: F.length(s) >= 2))).alias("skills"), F.col("price_value").alias("price"))
        out = out.withColumns({"named_hash": F.xxhash64("named"), "place_hash": F.xxhash64("place"), "n_skills": F.size("skills")})
        return out.select(*(F.col(c).alias(p + c) for c in out.columns))

    r, e = (written(side(dealt_out(df), p), f"{p}side") for df, p in ((rows, "r_"), (existing, "e_")))
    parts = max(-(-e.count() // JOINED_ROWS), e.sparkSession.sparkContext.defaultParallelism)
    test = F.lit(True) if which is None else which
    alike = lambda c: F.coalesce((F.col(f"r_{c}_hash") == F.col(f"e_{c}_hash")) & (F.col(f"r_{c}") == F.col(f"e_{c}")), F.lit(False))
    at, priced = alike("place") & (F.col("r_place") != ""), F.coalesce(F.abs(F.col("r_price") - F.col("e_price")) <= PRICE_SLACK, F.lit(False))
    # A pair of rows counts by its first two common skills alone; rows of two skills have no others.
    first = (F.col("r_n_skills") == 2) | (F.col("e_n_skills") == 2) | (F.col("k") == F.concat_ws(" ", F.slice(F.array_intersect("r_skills", "e_skills"), 1, 2)))
    paired = lambda df, p, b: df.select("*", b.alias("b"), F.explode(skill_pairs(F.col(f"{p}skills"))).alias("k"))
    found = lambda pairs, strength: pairs.filter(test).select(F.col("r_id").alias("id"), F.col("e_id").alias("existing_id"), strength.alias("strength"))

    def met(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        """left and right joined. Far more rows come out than go in, so neither side is broadcast, and parts are many whatever the bytes that go in."""
        left, right = (side.filter(reduce(lambda a, c: a & c, (F.col(k).isNotNull() for k in keys))).repartition(parts, *keys) for side in (left, right))
        return left.join(right.hint("merge"), list(keys))

    same = found(met(r.withColumn("b", F.col("r_named")), e.withColumn("b", F.col("e_named")), "b"), F.lit("strong"))
    other = ~alike("named")
    place = found(met(paired(r.filter("r_place != ''"), "r_", F.col("r_place")), paired(e, "e_", F.col("e_place")), "k", "b").filter(other & first), F.when(priced, "strong").otherwise("weak"))
    cell = F.floor(F.col("r_price") / PRICE_SLACK).cast("long")
    cells = paired(r.filter("r_price IS NOT NULL"), "r_", F.array(cell - 1, cell, cell + 1)).withColumn("b", F.explode("b"))
    near = found(met(cells, paired(e, "e_", F.floor(F.col("e_price") / PRICE_SLACK).cast("long")), "k", "b").filter(priced & ~at & other & first), F.lit("weak"))
    return same.unionByName(place).unionByName(near)


def db_person_duplicates(rows: DataFrame, existing: DataFrame, which: Column | None = None) -> DataFrame:
    """id, existing_id, strength: strong for the same identity and owner; with two common skills, strong for a near price and the same availability, weak for one of them.

    Both sides: id, identity, owner, skill_list, available, price_value; joined as db_duplicates joins projects.
    """
    rename = {"identity": "title", "owner": "company", "available": "place"}
    return db_duplicates(rows.withColumnsRenamed(rename), existing.withColumnsRenamed(rename), which)


def header_form(header: str) -> str:
    return re.sub(r"[\s_\-./\\:|()\[\]{}\"'`、。・･／（）［］【】「」『』:：〜~]+", "", unicodedata.normalize("NFKC", header.strip()).lower())


def table_fields(headers: list[str], fields: dict) -> dict[str, str]:
    """The field of each header that has one."""
    known = {header_form(name): field for field, (_, _, names) in fields.items() for name in (field, *names)}
    return {h: known[header_form(h)] for h in headers if header_form(h) in known}


def detect_table_type(headers: list[str]) -> dict:
    """kind (project or person), detected (or review, if headers leave it open), confidence and both scores of a table with these headers."""
    project, person = (sum(fields[f][0] for f in table_fields(headers, fields).values()) for fields in (PROJECT_TABLE, PERSON_TABLE))
    kind = "project" if project >= person else "person"
    open_ = not project + person or (project > 0 and person > 0 and abs(project - person) < 2)
    return {"kind": kind, "detected": "review" if open_ else kind, "confidence": round(max(project, person) / (project + person), 4) if project + person else 0.0, "project_score": project, "person_score": person}


def signal(kind: str, c: Column) -> Column:
    """not_provided, parsed, deferred or needs_review of a cell."""
    text = trimmed(plain(F.coalesce(c, F.lit(""))))
    if kind == "amount":
        compact = F.regexp_replace(text, "[,\\s]", "")
        out = F.when(text.rlike(PUT_OFF[kind]), "deferred").when(compact.rlike("\\d") & compact.rlike(r"^[0-9.万円kK〜~\-以上以下前後税込税別]+\z"), "parsed").otherwise("needs_review")
    elif kind == "date":
        out = F.when(text.rlike(PUT_OFF[kind]), "deferred").when(text.rlike(READ[kind]), "parsed").otherwise("needs_review")
    elif kind == "age":
        years = F.regexp_extract(F.regexp_replace(text, "[歳才\\s]", ""), r"^(\d{1,3})\z", 1).try_cast("int")
        out = F.when(years.between(16, 85), "parsed").otherwise("needs_review")
    elif kind == "skills":
        out = F.when(F.size(split_skills(text)) > 0, "parsed").otherwise("not_provided")
    else:
        out = F.when(text.rlike(READ["focus"]), "parsed").otherwise("deferred")
    return F.when(text == "", "not_provided").otherwise(out)


def assess_table_rows(rows: DataFrame, extra: str | None = None) -> DataFrame:
    """source, row_no, detected, action, reasons, coverage, n_skills and signals (field:signal) of the rows of an exported table.

    The table's kind comes from its headers. extra: a column of cells beyond the header (array of texts), if the reader keeps them.
    """
    headers = [c for c in rows.columns if c not in ("source", "row_no", extra)]
    found = detect_table_type(headers)
    fields = PROJECT_TABLE if found["kind"] == "project" else PERSON_TABLE
    of = table_fields(headers, fields)
    cell = lambda h: filled(trimmed(F.col(f"`{h}`").cast("string")))
    cells = F.array(*map(cell, headers))
    values = {f: F.coalesce(*(cell(h) for h in headers if of.get(h) == f)) for f in dict.fromkeys(of.values())}
    staged = rows.withColumns({"_cells": cells, **{f"_v_{f}": v for f, v in values.items()}})
    value = lambda f: F.col(f"_v_{f}") if f in values else F.lit(None).cast("string")
    n_skills = F.size(split_skills(value("skills")))
    lacking = ((value("title").isNull() | (value("workDescription").isNull() & value("businessDescription").isNull())) if found["kind"] == "project" else (value("name").isNull() & value("initials").isNull())) | (n_skills == 0)
    given = sum((value(f).isNotNull().cast("int") for f in values), F.lit(0))
    coverage = F.round(given / max(1, len(values)), 4)
    kinds = {f: kind for f, (_, kind, _) in fields.items() if kind}
    signals = {f: signal(kind, value(f)) for f, kind in kinds.items()}
    wrong = lambda kind: sum(((signals[f] == "needs_review").cast("int") for f, k in kinds.items() if k == kind), F.lit(0)) > 0
    unmapped = F.exists(F.array(*(cell(h) for h in headers if h not in of), F.lit(None).cast("string")), lambda x: x.isNotNull())
    wide = F.size(F.filter(F.col(extra), lambda x: F.coalesce(x, F.lit("")) != "")) > 0 if extra else F.lit(False)
    sensitive = "|".join(f"(?:{p})" for p in SENSITIVE_CELL)
    tests = [
        (F.lit(found["detected"] == "review"), "TYPE_AMBIGUOUS"), (wide, "ROW_TOO_WIDE"), (F.lit(not of), "NO_MAPPED_COLUMNS"), (F.exists("_cells", lambda x: F.coalesce(x.rlike(sensitive), F.lit(False))), "SENSITIVE_VALUE"), (F.exists("_cells", lambda x: F.coalesce(F.length(x) > LONG_CELL, F.lit(False))), "LONG_TEXT"),
        (lacking, "MISSING_REQUIRED_FIELD"), ((coverage > 0) & (coverage < TABLE_COVERAGE), "LOW_COVERAGE"), (unmapped, "UNMAPPED_VALUE"), (wrong("amount"), "INVALID_AMOUNT"), (wrong("date"), "INVALID_DATE"), (wrong("age"), "INVALID_AGE"), (value("focusNote").isNotNull(), "PERSON_FOCUS"),
    ]
    empty = ~F.exists("_cells", lambda x: x.isNotNull())
    reasons = F.when(empty, F.array(F.lit("EMPTY_ROW"))).otherwise(F.array_compact(F.array(*(F.when(t, c) for t, c in tests))))
    staged = staged.withColumn("reasons", reasons)
    action = F.when(empty, "would_skip").when(F.array_contains("reasons", "ROW_TOO_WIDE"), "would_fail").when(F.size("reasons") > 0, "would_need_review").otherwise("would_create")
    shown = F.concat_ws(",", *(F.concat(F.lit(f"{f}:"), s) for f, s in signals.items()))
    return staged.select("source", "row_no", F.lit(found["detected"]).alias("detected"), action.alias("action"), "reasons", F.when(empty, 0.0).otherwise(coverage).alias("coverage"), F.when(empty, 0).otherwise(n_skills).alias("n_skills"), F.when(empty, "").otherwise(shown).alias("signals"))


def import_runs(runs: DataFrame, records: DataFrame, links: DataFrame, source_type: str | None = None, mode: str | None = None, status: str | None = None) -> DataFrame:
    """Runs (run_id, source_type, mode, status, created_at), filtered, with the numbers of their records (record_id, run_id) and of the records' links (record_id)."""
    for column, value in (("source_type", source_type), ("mode", mode), ("status", status)):
        runs = runs.filter(F.col(column) == value) if value else runs
    linked = links.groupBy("record_id").agg(F.count("*").alias("n"))
    counts = records.select("record_id", "run_id").join(linked, "record_id", "left").groupBy("run_id").agg(F.count("*").alias("n_records"), F.sum(F.coalesce("n", F.lit(0))).alias("n_links"))
    return runs.join(counts, "run_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_records", "n_links")})


def source_record_list(records: DataFrame, links: DataFrame, record_type: str | None = None, status: str | None = None, run_id: int | None = None, link_type: str | None = None, review_needed: bool | None = None, warnings_present: bool | None = None) -> DataFrame:
    """Records (record_id, run_id, record_type, status, warnings), filtered, with the number of their links (record_id, link_type); link_type: at least one of that type."""
    for column, value in (("record_type", record_type), ("status", status), ("run_id", run_id)):
        records = records.filter(F.col(column) == value) if value is not None else records
    if review_needed is not None:
        records = records.filter((F.col("status") == "NEEDS_REVIEW") == review_needed)
    if warnings_present is not None:
        records = records.filter((F.coalesce(F.size("warnings"), F.lit(0)) > 0) == warnings_present)
    if link_type:
        records = records.join(links.filter(F.col("link_type") == link_type).select("record_id").distinct(), "record_id", "left_semi")
    counts = links.groupBy("record_id").agg(F.count("*").alias("n_links"))
    return records.join(counts, "record_id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def finalize_action(action: Column, duplicated: Column) -> Column:
    return F.when(duplicated & (action == "would_create"), "would_need_review").otherwise(action)


def detect_row_type(rows: DataFrame) -> DataFrame:
    """Adds project_score, person_score, row_type, type_conflict and type_confidence: mapped headers plus filled fields of each kind."""
    columns = [c for c in rows.columns if c not in ("row_no", "source")]
    score = {}
    for kind, fields in (("project", PROJECT_HEADERS), ("person", PERSON_HEADERS)):
        known, _ = map_headers(columns, fields)
        hits = [c for cs in known.values() for c in cs[:1]]
        score[kind] = F.lit(len(hits)) + sum((filled(trimmed(F.col(f"`{c}`"))).isNotNull().cast("int") for c in hits), F.lit(0))
    p, q = F.col("project_score"), F.col("person_score")
    out = rows.withColumns({"project_score": score["project"], "person_score": score["person"]})
    conflict = (p > 0) & (q > 0) & (F.abs(p - q) <= 2)
    return out.withColumns({"row_type": F.when(p + q == 0, "unknown").when(p >= q, "project").otherwise("person"), "type_conflict": conflict, "type_confidence": F.when(p + q == 0, 0.0).otherwise(F.round(F.greatest(p, q) / (p + q), 4))})


def coverage_summary(assessed: DataFrame) -> DataFrame:
    """Rows, average coverage, rows of weak coverage and rows without warnings of each source."""
    weak = F.col("coverage") < LEAST_COVERAGE
    return assessed.groupBy("source").agg(F.count("*").alias("n_rows"), F.round(F.avg("coverage"), 4).alias("average_coverage"), F.count_if(weak).alias("n_weak"), F.count_if(F.size("warnings") == 0).alias("n_clean"))


def import_summary(assessed: DataFrame, kind: str) -> DataFrame:
    """Long table (metric, key, n): types, actions, warnings, duplicates, and for each required field the rows that have it or lack it."""
    pair = lambda metric, key: F.struct(F.lit(metric).alias("metric"), key.alias("key"))
    state = lambda f: F.when(F.col(f).isNotNull(), "present").otherwise("missing")
    single = [pair("type", F.lit(kind)), pair("action", F.col("action")), *(pair(f"required:{f}", state(f)) for f in REQUIRED[kind]), F.when(F.col("same_rows") > 1, pair("duplicate", F.lit("same_source")))]
    found = F.concat(F.array_compact(F.array(*single)), F.transform("warnings", lambda w: pair("warning", w)))
    return assessed.select(F.explode(found).alias("x")).groupBy("x.metric", "x.key").agg(F.count("*").alias("n"))


def field_coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, present, missing and ratio over all rows."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().cast("long").alias("has")) for f in fields)))
    return rows.select(each.alias("x")).groupBy("x.field").agg(F.sum("x.has").alias("present"), (F.count("*") - F.sum("x.has")).alias("missing"), F.round(F.sum("x.has") / F.count("*"), 4).alias("ratio"))


def source_records(assessed: DataFrame, kind: str) -> DataFrame:
    """Records of what was imported: hash of the row, status and confidence."""
    shown = [c for c in (PROJECT_HEADERS if kind == "project" else PERSON_HEADERS)]
    confidence = F.when(F.col("same_rows") > 1, 0.95).otherwise(F.greatest(F.lit(0.1), F.col("coverage")))
    return assessed.select(F.sha2(F.concat_ws("|", "source", F.col("row_no").cast("string"), F.to_json(F.struct(*shown))), 256).alias("record_hash"), F.lit(kind).alias("record_type"), F.col("action").alias("status"), confidence.alias("confidence"), F.to_json(F.struct(*shown)).alias("preview"))


def uuid_of(c: Column) -> Column:
    """A stable UUID from the hash of a text."""
    h = F.sha2(c, 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def link_type(action: Column, strength: Column, conflict: Column) -> Column:
    return F.when((action == "would_skip") | conflict, None).when(strength == "strong", "DUPLICATE_OF").when((strength == "weak") | (action == "would_need_review"), "REVIEW_CANDIDATE").otherwise("CREATED_FROM")


def run_status(assessed: DataFrame) -> DataFrame:
    bad = F.max((F.col("action") != "would_create").cast("int")) == 1
    return assessed.groupBy("source").agg(F.when(bad, "PARTIAL").otherwise("SUCCEEDED").alias("status"), F.count("*").alias("n_rows"))


#: What may be chosen for remote work, and patterns that tell it from a text, in order.
REMOTE_CHOICES = {"未確認": "UNKNOWN", "常駐": "ONSITE", "リモート併用": "HYBRID", "一部リモート": "HYBRID", "リモート": "REMOTE", "フルリモート": "FULL_REMOTE", "UNKNOWN": "UNKNOWN", "ONSITE": "ONSITE", "HYBRID": "HYBRID", "REMOTE": "REMOTE", "FULL_REMOTE": "FULL_REMOTE"}
REMOTE_TEXTS = [("フルリモート|フルリモ|完全リモート", "FULL_REMOTE"), ("リモート併用|一部リモート|ハイブリッド|基本リモート.*出社|出社.*リモート|週[1-5].*出社", "HYBRID"), ("リモート|在宅", "REMOTE"), ("常駐|オンサイト|出社", "ONSITE")]


def chosen(c: Column, options: dict[str, str]) -> Column:
    """The option that a trimmed text names, or null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in options.items() for x in pair)), c)


def validate_entity_input(rows: DataFrame, statuses: dict[str, str]) -> DataFrame:
    """Parsed values of the texts that rows have, with an array of errors (codes in this order).

    price_text: price_value (commas aside, cut to a whole number), PRICE; month_text (YYYY-MM): month_value, MONTH; date_text
    (YYYY-MM-DD): date_value, DATE; email: EMAIL; contact_text, an address if it has an @: CONTACT; list_text: list_value, its
    distinct items; status_text: status_value, one of statuses, STATUS; remote_text: remote_value, a choice, or, if blank,
    what remote_note says, REMOTE. Blank texts are null and no error.
    """
    text = lambda c: filled(trimmed(F.col(c)))
    values, tests = {}, []

    def field(name: str, value: Column | None, code: str, wrong: Column) -> None:
        if value is not None:
            values[name] = value
        tests.append((wrong, code))

    if "price_text" in rows.columns:
        price = F.regexp_replace(text("price_text"), ",", "").try_cast("double")
        field("price_value", price.cast("long"), "PRICE", text("price_text").isNotNull() & (price.isNull() | F.isnan(price) | (F.abs(price) == float("inf"))))
    for name, form, more in (("month", "^\\d{4}-\\d{2}\\z", "-01"), ("date", "^\\d{4}-\\d{2}-\\d{2}\\z", "")):
        if f"{name}_text" in rows.columns:
            day = F.when(text(f"{name}_text").rlike(form), F.concat(text(f"{name}_text"), F.lit(more)).try_cast("date"))
            field(f"{name}_value", day, name.upper(), text(f"{name}_text").isNotNull() & day.isNull())
    address = r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"
    if "email" in rows.columns:
        field("email", None, "EMAIL", text("email").isNotNull() & ~text("email").rlike(address))
    if "contact_text" in rows.columns:
        field("contact_text", None, "CONTACT", F.contains(text("contact_text"), F.lit("@")) & ~text("contact_text").rlike(address))
    if "list_text" in rows.columns:
        items = F.transform(F.split(F.coalesce("list_text", F.lit("")), "[\\n,、/／]+"), trimmed)
        values["list_value"] = F.array_distinct(F.filter(items, lambda x: x != ""))
    if "status_text" in rows.columns:
        field("status_value", chosen(text("status_text"), statuses), "STATUS", text("status_text").isNotNull() & chosen(text("status_text"), statuses).isNull())
    if "remote_text" in rows.columns:
        said = F.coalesce(text("remote_note") if "remote_note" in rows.columns else F.lit(None).cast("string"), F.lit(""))
        inferred = F.coalesce(*(F.when(said.rlike(f"(?i){p}"), v) for p, v in REMOTE_TEXTS), F.lit("UNKNOWN"))
        field("remote_value", F.when(text("remote_text").isNull(), inferred).otherwise(chosen(text("remote_text"), REMOTE_CHOICES)), "REMOTE", text("remote_text").isNotNull() & chosen(text("remote_text"), REMOTE_CHOICES).isNull())
    return rows.withColumns({**values, "errors": F.array_compact(F.array(*(F.when(t, c) for t, c in tests)))})
