"""Market analysis: demand, supply, gap and prices by skill, price band, region and cell.

Projects and persons are normalised once (market_projects, market_persons); skills come as tables of
their own and are reduced to distinct (id, skill, type). Medians are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import market as m
from ..functions import rules

BASE = ["project_count", "recruiting_count", "person_count", "demand_supply_gap", "project_median_price", "person_median_price", "focus_project_count", "quality_issue_count"]


def formed(rows: DataFrame, columns: list[str], forms: dict[str, Column]) -> DataFrame:
    """rows with forms (of these columns alone), which take far longer than a join: worked out once for each distinct value and joined back."""
    known = rows.select(*columns).distinct().select(*(F.col(c).alias(f"_of_{c}") for c in columns), *(f.alias(name) for name, f in forms.items()))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in columns]
    return rows.join(known, same, "left").drop(*(f"_of_{c}" for c in columns))


def market_projects(projects: DataFrame) -> DataFrame:
    """project_id and the normal forms that all aggregates use."""
    price = m.project_price(F.col("upper_max"), F.lit(None).cast("int"), F.col("unit_max"), F.col("unit_min"))
    forms = {
        "_region": m.region(F.col("place")),
        "_style": m.work_style(F.col("remote_type"), F.concat_ws(" ", F.coalesce("style_text", F.lit("")), F.coalesce("place", F.lit("")))),
        "_month": m.month_key(F.col("start_month")),
        "_contract": m.contract_type(F.col("contract")),
    }
    rows = formed(projects.withColumn("price", price), ["place", "remote_type", "style_text", "start_month", "contract"], forms)
    return rows.select(
        "project_id", "price", "is_focus", "created_at", "status",
        m.price_band(F.col("price")).alias("price_band"),
        F.col("_region").alias("region"),
        F.col("_style").alias("work_style"),
        F.col("_month").alias("start_month"),
        F.col("_contract").alias("contract_type"),
        m.head_count(F.col("recruiting")).alias("heads"),
        m.quality_count(F.col("issues"), F.col("needs_review")).alias("quality"),
    )


def market_persons(persons: DataFrame) -> DataFrame:
    return persons.select(
        "person_id", m.positive(F.col("desired")).alias("price"), "created_at", "status",
        m.price_band(F.col("desired")).alias("price_band"),
        m.region(F.col("place")).alias("region"),
        m.work_style(None, F.col("remote_wish")).alias("work_style"),
        m.month_key(F.col("available")).alias("start_month"),
        m.quality_count(F.lit(0), F.col("needs_review")).alias("quality"),
    )


def unique_skills(skills: DataFrame, id_column: str) -> DataFrame:
    """Distinct id, skill and type; unknown skills are left out."""
    typed = "skill_type" in skills.columns
    kind = m.skill_type(F.col("skill_type")) if typed else F.lit("OTHER")
    named = formed(skills, ["skill_name", "skill_type"] if typed else ["skill_name"], {"skill": m.skill_name(F.col("skill_name")), "_kind": kind})
    named = named.select(id_column, "skill", F.col("_kind").alias("skill_type"))
    return named.filter(F.col("skill") != rules.UNKNOWN).distinct()


def demand(rows: DataFrame, *keys: str, more: dict[str, str] | None = None) -> DataFrame:
    """Rows are added up by (keys, price) first, so that the exact median takes counts of prices; more: names of further sums, and their columns."""
    sums = {"recruiting_count": F.col("heads"), "focus_project_count": F.col("is_focus").cast("long"), "project_quality": F.col("quality"), **{name: F.col(c) for name, c in (more or {}).items()}}
    priced = rows.groupBy(*keys, "price").agg(F.count("*").alias("project_count"), *(F.sum(c).alias(name) for name, c in sums.items()))
    return priced.groupBy(*keys).agg(F.expr("percentile(price, 0.5, project_count)").alias("project_median_price"), *(F.sum(name).alias(name) for name in ("project_count", *sums)))


def supply(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("person_count"), F.median("price").alias("person_median_price"), F.sum("quality").alias("person_quality"))


def base_metrics(joined: DataFrame) -> DataFrame:
    """Counts of a side without rows are 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = joined.withColumns({c: zero(c).cast("long") for c in ("project_count", "recruiting_count", "person_count", "focus_project_count")})
    return out.withColumns({"demand_supply_gap": F.col("recruiting_count") - F.col("person_count"), "quality_issue_count": (zero("project_quality") + zero("person_quality")).cast("long")}).drop("project_quality", "person_quality")


def ranked(metrics: DataFrame, *keys: str, limit: int | None = None) -> DataFrame:
    """In ranking order: heads, gap, median price, all falling, then keys."""
    out = metrics.orderBy(F.desc("recruiting_count"), F.desc("demand_supply_gap"), F.desc(F.coalesce("project_median_price", F.lit(0.0))), *keys)
    return out if limit is None else out.limit(max(1, min(limit, rules.RANKING_LIMIT)))


def skill_market(projects: DataFrame, project_skills: DataFrame, persons: DataFrame, person_skills: DataFrame) -> DataFrame:
    """One row a skill; a project counts once for a skill, whatever number of types it has there."""
    typed = unique_skills(project_skills, "project_id")
    kinds = [F.max((F.col("skill_type") == t).cast("int")).alias(t) for t in rules.SKILL_TYPES]
    used = typed.groupBy("project_id", "skill").agg(*kinds)
    counts = dict(zip(("required_project_count", "preferred_project_count", "used_project_count"), rules.SKILL_TYPES))
    wanted = demand(used.join(market_projects(projects), "project_id"), "skill", more=counts)
    offered = supply(unique_skills(person_skills, "person_id").select("person_id", "skill").distinct().join(market_persons(persons), "person_id"), "skill")
    out = base_metrics(wanted.join(offered, "skill", "full"))
    return out.select("skill", *BASE, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("required_project_count", "preferred_project_count", "used_project_count")))


def keyed_market(projects: DataFrame, persons: DataFrame, *keys: str) -> DataFrame:
    """Base metrics by normalised columns that both sides have, e.g. price_band or region and work_style."""
    wanted, offered = demand(market_projects(projects), *keys), supply(market_persons(persons), *keys)
    return base_metrics(wanted.join(offered, list(keys), "full")).select(*keys, *BASE)


def price_band_market(projects: DataFrame, persons: DataFrame) -> DataFrame:
    return keyed_market(projects, persons, "price_band").orderBy(m.band_order(F.col("price_band")))


def region_market(projects: DataFrame, persons: DataFrame) -> DataFrame:
    return keyed_market(projects, persons, "region", "work_style")


CELL = ["skill", "price_band", "region", "work_style"]


def market_cells(projects: DataFrame, project_skills: DataFrame, persons: DataFrame, person_skills: DataFrame, as_of: str) -> DataFrame:
    """One row a (skill, band, region, style, start month, contract): demand, the supply that is free by then, and the sales priority.

    Supply is added up by (four keys, month, price) first; each wanted month of a cell then takes the running sum up to
    it: a popular cell costs a row for each month and price, not for each pair of rows or months.
    """
    named = lambda skills, key: unique_skills(skills.select(key, "skill_name"), key).select(key, "skill")  # noqa: E731  of one type, so that one distinct is enough
    wanted = demand(named(project_skills, "project_id").join(market_projects(projects), "project_id"), *CELL, "start_month", "contract_type")
    offered = named(person_skills, "person_id").join(market_persons(persons), "person_id")
    out = wanted.join(cell_supply(offered, wanted), [*CELL, "start_month"], "left")
    return priority(base_metrics(out), as_of).select(*CELL, "start_month", "contract_type", *BASE, "score", "reasons")


def cell_supply(offered: DataFrame, wanted: DataFrame) -> DataFrame:
    """Supply of each (four keys, start month) of wanted: persons free by then, or with an unknown month, or all if the month is unknown.

    Persons are counted by (four keys, month, price); prices within one band are few. Each wanted month takes the running
    sum of a price's counts up to it (unknown months of persons come before all months, those of cells after all), and the
    median is that of the prices weighted by counts.
    """
    order = lambda unknown: F.when(F.col("start_month") == rules.UNKNOWN, unknown).otherwise(F.concat(F.lit("m"), "start_month"))
    months = offered.groupBy(*CELL, "start_month", "price").agg(F.count("*").alias("n"), F.sum("quality").alias("q")).withColumns({"at": order("a"), "is_cell": F.lit(0)})
    cells = wanted.select(*CELL, "start_month").distinct().withColumns({"at": order("z"), "is_cell": F.lit(1)})
    prices = months.select(*CELL, "price").distinct()
    rows = months.unionByName(cells.join(prices, CELL).withColumns({"n": F.lit(0).cast("long"), "q": F.lit(0).cast("long")}))
    until = Window.partitionBy(*CELL, "price").orderBy("at", "is_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    free = rows.select(*CELL, "start_month", "price", "is_cell", F.sum("n").over(until).alias("n"), F.sum("q").over(until).alias("q")).filter("is_cell = 1 AND n > 0")
    return free.groupBy(*CELL, "start_month").agg(F.sum("n").alias("person_count"), F.sum("q").alias("person_quality"), F.expr("percentile(price, 0.5, n)").alias("person_median_price"))


def priority(metrics: DataFrame, as_of: str) -> DataFrame:
    """Adds score and reasons (joined by ';') of the sales priority as of a day (yyyy-MM-dd)."""
    year, month = int(as_of[:4]), int(as_of[5:7])
    price = F.col("project_median_price")
    parted = F.regexp_extract("start_month", r"^(\d{4})-(\d{2})$", 1), F.regexp_extract("start_month", r"^(\d{4})-(\d{2})$", 2)
    away = F.when(parted[0] != "", (parted[0].cast("int") - year) * 12 + parted[1].cast("int") - month)
    parts = {
        "demand": F.least("recruiting_count", F.lit(10)) * 2,
        "gap": F.greatest("demand_supply_gap", F.lit(0)) * 3,
        "price": F.when(price >= 80, 10).when(price >= 70, 6).otherwise(0),
        "focus": F.col("focus_project_count") * 2,
        "timing": F.when(away == 0, 6).when(away == 1, 4).otherwise(0),
    }
    no_price, no_region, no_style = price.isNull() | (F.col("price_band") == rules.UNKNOWN), F.col("region") == rules.UNKNOWN, F.col("work_style") == "UNKNOWN"
    penalty = F.least(F.col("quality_issue_count") * 2, F.lit(10)) + 2 * no_price.cast("int") + 2 * no_region.cast("int") + no_style.cast("int")
    total = sum(parts.values(), F.lit(0)) - penalty
    reasons = [(parts["demand"] >= 10, "案件需要が多い"), (parts["gap"] > 0, "要員供給が不足"), (parts["price"] >= 10, "高単価帯"), (parts["focus"] > 0, "注力案件を含む"), (parts["timing"] > 0, "開始月が近い"), (no_price, "単価未設定が多い"), (no_region, "地域未設定が多い"), (no_style, "勤務形態未設定が多い")]
    return metrics.withColumns({"score": F.greatest(total, F.lit(0)).cast("long"), "reasons": F.concat_ws(";", *(F.when(c, text) for c, text in reasons))})


def quality_alerts(projects: DataFrame, project_skills: DataFrame, persons: DataFrame, person_skills: DataFrame, samples: int = 5) -> DataFrame:
    """code, severity, target, count and the first ids (by id), most frequent code first."""
    ps = market_projects(projects).join(unique_skills(project_skills, "project_id").select("project_id").distinct().withColumn("has_skill", F.lit(True)), "project_id", "left")
    qs = market_persons(persons).join(unique_skills(person_skills, "person_id").select("person_id").distinct().withColumn("has_skill", F.lit(True)), "person_id", "left")
    of = lambda rows, key, tests: rows.select(F.col(key).alias("id"), F.explode(F.array_compact(F.array(*(F.when(c, code) for c, code in tests)))).alias("code"))
    found = of(ps, "project_id", [(F.col("has_skill").isNull(), "PROJECT_SKILL_MISSING"), (F.col("price").isNull(), "PROJECT_PRICE_MISSING"), (F.col("region") == rules.UNKNOWN, "PROJECT_REGION_MISSING"), (F.col("work_style") == "UNKNOWN", "PROJECT_WORK_STYLE_UNKNOWN"), (F.col("start_month") == rules.UNKNOWN, "PROJECT_START_MONTH_MISSING"), (F.col("quality") > 0, "NEEDS_REVIEW")]).withColumn("side", F.lit(0))
    found = found.unionByName(of(qs, "person_id", [(F.col("has_skill").isNull(), "PERSON_SKILL_MISSING"), (F.col("price_band") == rules.UNKNOWN, "PERSON_PRICE_MISSING"), (F.col("region") == rules.UNKNOWN, "PERSON_REGION_MISSING"), (F.col("work_style") == "UNKNOWN", "PERSON_WORK_STYLE_UNKNOWN"), (F.col("quality") > 0, "NEEDS_REVIEW")]).withColumn("side", F.lit(1)))
    counts = found.groupBy("code").agg(F.count("*").alias("count"))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("side", "id"))).filter(F.col("n") <= samples).groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"].cast("string")), ",").alias("sample_ids"))
    kinds = F.create_map(*(x for code, (s, t) in rules.ALERTS.items() for x in (F.lit(code), F.struct(F.lit(s).alias("severity"), F.lit(t).alias("target")))))
    out = counts.join(first, "code").withColumn("k", F.element_at(kinds, F.col("code")))
    return out.select("code", "k.severity", "k.target", "count", "sample_ids").orderBy(F.desc("count"), "code")


def filtered(rows: DataFrame, first_month: str | None = None, last_month: str | None = None, focus: bool = False, band: str | None = None, region: str | None = None, style: str | None = None, contract: str | None = None) -> DataFrame:
    """Normalised rows (market_projects or market_persons) that are not archived, were made in a span of months (swapped if reversed) and have the given values; focus and contract hold for projects only, legacy band keys stand for several bands."""
    out = rows.filter(F.col("status") != "ARCHIVED")
    if first_month and last_month and first_month > last_month:
        first_month, last_month = last_month, first_month
    if first_month:
        out = out.filter(F.col("created_at") >= F.to_timestamp(F.lit(f"{first_month}-01")))
    if last_month:
        out = out.filter(F.col("created_at") < F.add_months(F.lit(f"{last_month}-01").cast("date"), 1).cast("timestamp"))
    if focus and "is_focus" in rows.columns:
        out = out.filter("is_focus")
    if band:
        out = out.filter(F.col("price_band").isin(rules.LEGACY_BANDS.get(band, [band])))
    if region:
        out = out.filter(F.col("region") == region)
    if style:
        out = out.filter(F.col("work_style") == style)
    if contract and "contract_type" in rows.columns:
        out = out.filter(F.col("contract_type") == contract)
    return out


def last_months(as_of: str, n: int = 3) -> tuple[str, str]:
    """First and last of the n months up to that of a day (yyyy-MM-dd): the span that filters take by default."""
    last = int(as_of[:4]) * 12 + int(as_of[5:7]) - 1
    return tuple(f"{m // 12:04d}-{m % 12 + 1:02d}" for m in (last - n + 1, last))


def with_skill(rows: DataFrame, skills: DataFrame, key: str, skill: str) -> DataFrame:
    """The rows of which a skill, whatever its spelling, is the given one."""
    return rows.join(unique_skills(skills, key).filter(F.lower("skill") == skill.lower()).select(key).distinct(), key, "left_semi")


def period_summary(projects: DataFrame, persons: DataFrame) -> DataFrame:
    """First and last created month of all, projects and persons."""
    rows = projects.select(F.lit("projects").alias("side"), "created_at").unionByName(persons.select(F.lit("persons").alias("side"), "created_at"))
    month = F.date_format("created_at", "yyyy-MM")
    sides = F.explode(F.array(F.lit("all"), F.col("side")))
    return rows.select(sides.alias("side"), month.alias("month")).groupBy("side").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))


def alert_total(alerts: DataFrame) -> DataFrame:
    """Alerts over all codes, and how many of them are of each severity."""
    return alerts.groupBy("severity").agg(F.sum("count").alias("n_alerts"))


def market_summary(projects: DataFrame, persons: DataFrame, since: str) -> DataFrame:
    """Counts of both sides: rows, focus, made since a day."""
    one = lambda rows, side, focus: rows.agg(F.lit(side).alias("side"), F.count("*").alias("n_rows"), F.count_if(focus).alias("n_focus"), F.count_if(F.col("created_at") >= F.to_timestamp(F.lit(since))).alias("n_since"))
    return one(projects, "projects", F.col("is_focus")).unionByName(one(persons, "persons", F.lit(False)))


def skill_examples(top: DataFrame, projects: DataFrame, project_skills: DataFrame, persons: DataFrame, person_skills: DataFrame, most: int = 5) -> DataFrame:
    """For each ranked skill (top: at most RANKING_LIMIT rows) the newest projects and persons, without identity."""
    keys = F.broadcast(top.select("skill").limit(rules.RANKING_LIMIT))

    def side(rows: DataFrame, skills: DataFrame, key: str, mark: str, focus: Column) -> DataFrame:
        own = unique_skills(skills, key).select(key, "skill").distinct()
        sized = own.join(own.groupBy(key).agg(F.count("*").alias("n_skills")), key).join(keys, "skill").join(rows, key)
        order = Window.partitionBy("skill").orderBy(F.desc_nulls_last("created_at"), F.desc(focus), F.desc("n_skills"), key)
        picked = sized.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
        return picked.select("skill", F.format_string(f"{mark}-%03d", F.col("n")).alias("example_id"), F.date_format("created_at", "yyyy-MM").alias("month"), "price_band", "region", "work_style", F.col("n_skills").cast("long").alias("n_skills"))

    return side(market_projects(projects), project_skills, "project_id", "PJ", F.col("is_focus").cast("int")).unionByName(side(market_persons(persons), person_skills, "person_id", "PE", F.lit(0)))
