"""Market analysis queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import market
from ..plans import binding as b

AS_OF = "1998-06-15"


def _active(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return b.projects(spark, sf_dir).filter("status != 'ARCHIVED'"), b.persons(spark, sf_dir).filter("status != 'ARCHIVED'")


def _skills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return b.project_skills(spark, sf_dir), b.person_skills(spark, sf_dir)


def skill_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p, q), (ps, qs) = _active(spark, sf_dir), _skills(spark, sf_dir)
    return market.skill_market(p, ps, q, qs)


def skill_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows in ranking order (a top-k report)."""
    return market.ranked(skill_market(spark, sf_dir), "skill", limit=10)


def price_band_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.price_band_market(*_active(spark, sf_dir))


def region_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.region_market(*_active(spark, sf_dir))


def market_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p, q), (ps, qs) = _active(spark, sf_dir), _skills(spark, sf_dir)
    return market.market_cells(p, ps, q, qs, AS_OF)


def focus_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top skill, top known band, top region."""
    one = lambda kind, key, rows: market.ranked(rows, key, limit=1).select(F.lit(kind).alias("kind"), F.col(key).alias("key"))
    band = market.keyed_market(*_active(spark, sf_dir), "price_band").filter(F.col("price_band") != rules.UNKNOWN)
    return one("skill", "skill", skill_market(spark, sf_dir)).unionByName(one("price_band", "price_band", band)).unionByName(one("region", "region", market.keyed_market(*_active(spark, sf_dir), "region")))


def quality_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p, q), (ps, qs) = _active(spark, sf_dir), _skills(spark, sf_dir)
    return market.quality_alerts(p, ps, q, qs)


def market_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill market of open focus projects with old band key 80_over, made in two years (given in reverse)."""
    pick = dict(first_month="1999-12", last_month="1998-01", focus=True, band="80_over")
    p = market.filtered(market.market_projects(b.projects(spark, sf_dir)), **pick)
    q = market.filtered(market.market_persons(b.persons(spark, sf_dir)), **pick)
    return p.select(F.lit("project").alias("side"), F.col("project_id").alias("id"), "price_band", "region", "work_style").unionByName(q.select(F.lit("person").alias("side"), F.col("person_id").alias("id"), "price_band", "region", "work_style"))


def period_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.period_summary(*_active(spark, sf_dir))


def market_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.market_summary(*_active(spark, sf_dir), "1998-01-01")


def alert_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.alert_total(quality_alerts(spark, sf_dir))


def skilled_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of the three months up to a day that ask for a skill."""
    first, last = market.last_months(AS_OF)
    rows = market.filtered(market.market_projects(b.projects(spark, sf_dir)), first, last)
    return market.with_skill(rows, b.project_skills(spark, sf_dir), "project_id", "java").select("project_id", "price_band")


def skill_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p, q), (ps, qs) = _active(spark, sf_dir), _skills(spark, sf_dir)
    return market.skill_examples(skill_ranking(spark, sf_dir), p, ps, q, qs)


def market_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every normal form of every project."""
    return market.market_projects(b.projects(spark, sf_dir)).select("project_id", "price", "price_band", "region", "work_style", "start_month", "contract_type", "heads", "quality")


NAMES = ["skill_market", "skill_ranking", "price_band_market", "region_market", "market_cells", "focus_insights", "quality_alerts", "market_filtered", "period_summary", "market_summary", "skill_examples", "market_normal_forms", "alert_totals", "skilled_projects"]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


def _has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _first(column: str, table: dict[str, list[str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {_has(column, words)} THEN '{key}'" for key, words in table.items()) + f" ELSE '{otherwise}' END"


def _band(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} <= 0 THEN 'unknown' WHEN {c} <= 30 THEN 'under_30' WHEN {c} >= 120 THEN '120_over' ELSE (floor({c} / 5) * 5)::INT::VARCHAR || '_' || (floor({c} / 5) * 5 + 5)::INT::VARCHAR END"


_STYLE = f"CASE WHEN remote_type <> 'UNKNOWN' THEN remote_type ELSE {_first('''(coalesce(style_text, '') || ' ' || place)''', rules.WORK_STYLE_WORDS, 'UNKNOWN')} END"
_ALIAS = "CASE lower(trim(skill_name)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.SKILL_ALIASES.items()) + " ELSE trim(skill_name) END"
MARKET = f"""
np AS (SELECT *, coalesce(CASE WHEN upper_max > 0 THEN upper_max END, CASE WHEN unit_max > 0 THEN unit_max END, CASE WHEN unit_min > 0 THEN unit_min END) AS price,
  {_first("place", rules.REGIONS, "unknown")} AS region, {_STYLE} AS work_style, coalesce(strftime(start_month, '%Y-%m'), 'unknown') AS month,
  CASE WHEN contract = '' THEN 'UNKNOWN' ELSE {_first("contract", rules.CONTRACT_WORDS, "OTHER")} END AS contract_type,
  CASE WHEN recruiting > 0 THEN recruiting ELSE 1 END AS heads, greatest(issues, 0) + needs_review::INT AS quality FROM projects),
p AS (SELECT *, {_band("price")} AS price_band FROM np WHERE status <> 'ARCHIVED'),
q AS (SELECT *, CASE WHEN desired > 0 THEN desired END AS price, {_band("desired")} AS price_band, {_first("place", rules.REGIONS, "unknown")} AS region,
  {_first("coalesce(remote_wish, '')", rules.WORK_STYLE_WORDS, "UNKNOWN")} AS work_style, coalesce(strftime(available, '%Y-%m'), 'unknown') AS month, needs_review::INT AS quality
  FROM persons WHERE status <> 'ARCHIVED'),
pk AS (SELECT DISTINCT project_id, skill_type, {_ALIAS} AS skill FROM project_skills WHERE trim(skill_name) <> ''),
qk AS (SELECT DISTINCT person_id, {_ALIAS} AS skill FROM person_skills WHERE trim(skill_name) <> '')
"""
_BASE = """coalesce(pc, 0)::BIGINT AS project_count, coalesce(rc, 0)::BIGINT AS recruiting_count, coalesce(qc, 0)::BIGINT AS person_count,
  (coalesce(rc, 0) - coalesce(qc, 0))::BIGINT AS demand_supply_gap, pm AS project_median_price, qm AS person_median_price, coalesce(fc, 0)::BIGINT AS focus_project_count,
  (coalesce(pq, 0) + coalesce(qq, 0))::BIGINT AS quality_issue_count"""
_P = "count(*) AS pc, sum(heads) AS rc, median(price) AS pm, sum(is_focus::INT) AS fc, sum(quality) AS pq"
_Q = "count(*) AS qc, median(price) AS qm, sum(quality) AS qq"
SKILLS = f"""
sk AS (SELECT coalesce(d.skill, s.skill) AS skill, {_BASE}, coalesce(r1, 0)::BIGINT AS required_project_count, coalesce(r2, 0)::BIGINT AS preferred_project_count, coalesce(r3, 0)::BIGINT AS used_project_count
  FROM (SELECT skill, {_P}, sum(a) AS r1, sum(b) AS r2, sum(c) AS r3 FROM (SELECT project_id, skill, max((skill_type = 'REQUIRED')::INT) AS a, max((skill_type = 'PREFERRED')::INT) AS b, max((skill_type = 'USED_TECHNOLOGY')::INT) AS c FROM pk GROUP BY 1, 2) JOIN p USING (project_id) GROUP BY skill) d
  FULL JOIN (SELECT skill, {_Q} FROM qk JOIN q USING (person_id) GROUP BY skill) s ON d.skill = s.skill)
"""
_ORDER = "recruiting_count DESC, demand_supply_gap DESC, coalesce(project_median_price, 0) DESC"


def _with(*ctes: str) -> str:
    return "WITH " + ",".join((b.SQL, *ctes))


def _keyed(*keys: str) -> str:
    both = ", ".join(f"coalesce(d.{k}, s.{k}) AS {k}" for k in keys)
    on = " AND ".join(f"d.{k} = s.{k}" for k in keys)
    cols = ", ".join(keys)
    return f"SELECT {both}, {_BASE} FROM (SELECT {cols}, {_P} FROM p GROUP BY {cols}) d FULL JOIN (SELECT {cols}, {_Q} FROM q GROUP BY {cols}) s ON {on}"


_CELL = "skill, price_band, region, work_style"
_SCORE = """least(recruiting_count, 10) * 2 + greatest(demand_supply_gap, 0) * 3 + CASE WHEN project_median_price >= 80 THEN 10 WHEN project_median_price >= 70 THEN 6 ELSE 0 END
  + focus_project_count * 2 + CASE WHEN start_month = '1998-06' THEN 6 WHEN start_month = '1998-07' THEN 4 ELSE 0 END
  - least(quality_issue_count * 2, 10) - CASE WHEN project_median_price IS NULL OR price_band = 'unknown' THEN 2 ELSE 0 END - CASE WHEN region = 'unknown' THEN 2 ELSE 0 END - CASE WHEN work_style = 'UNKNOWN' THEN 1 ELSE 0 END"""
_REASONS = """concat_ws(';', CASE WHEN recruiting_count >= 5 THEN '案件需要が多い' END, CASE WHEN demand_supply_gap > 0 THEN '要員供給が不足' END, CASE WHEN project_median_price >= 80 THEN '高単価帯' END,
  CASE WHEN focus_project_count > 0 THEN '注力案件を含む' END, CASE WHEN start_month IN ('1998-06', '1998-07') THEN '開始月が近い' END, CASE WHEN project_median_price IS NULL OR price_band = 'unknown' THEN '単価未設定が多い' END,
  CASE WHEN region = 'unknown' THEN '地域未設定が多い' END, CASE WHEN work_style = 'UNKNOWN' THEN '勤務形態未設定が多い' END)"""
_ALERT = [("p", "project_id", [("NOT EXISTS (SELECT 1 FROM pk WHERE pk.project_id = t.project_id)", "PROJECT_SKILL_MISSING"), ("price IS NULL", "PROJECT_PRICE_MISSING"), ("region = 'unknown'", "PROJECT_REGION_MISSING"), ("work_style = 'UNKNOWN'", "PROJECT_WORK_STYLE_UNKNOWN"), ("month = 'unknown'", "PROJECT_START_MONTH_MISSING"), ("quality > 0", "NEEDS_REVIEW")]), ("q", "person_id", [("NOT EXISTS (SELECT 1 FROM qk WHERE qk.person_id = t.person_id)", "PERSON_SKILL_MISSING"), ("price_band = 'unknown'", "PERSON_PRICE_MISSING"), ("region = 'unknown'", "PERSON_REGION_MISSING"), ("work_style = 'UNKNOWN'", "PERSON_WORK_STYLE_UNKNOWN"), ("quality > 0", "NEEDS_REVIEW")])]
_ALERT_ROWS = " UNION ALL ".join(f"SELECT {i} AS side, {key} AS id, '{code}' AS code FROM {t} t WHERE {test}" for i, (t, key, tests) in enumerate(_ALERT) for test, code in tests)
_KINDS = " UNION ALL ".join(f"SELECT '{c}' AS code, '{s}' AS severity, '{t}' AS target" for c, (s, t) in rules.ALERTS.items())


def _examples(side: str, rows: str, key: str, skills: str, focus: str) -> str:
    return f"""SELECT skill, '{side}-' || lpad(n::VARCHAR, 3, '0') AS example_id, strftime(created_at, '%Y-%m') AS month, price_band, region, work_style, n_skills FROM (
      SELECT *, row_number() OVER (PARTITION BY skill ORDER BY created_at DESC NULLS LAST, {focus} DESC, n_skills DESC, {key}) AS n
      FROM (SELECT DISTINCT {key}, skill FROM {skills}) JOIN (SELECT {key}, count(DISTINCT skill) AS n_skills FROM {skills} GROUP BY 1) USING ({key}) JOIN top USING (skill) JOIN {rows} USING ({key})) WHERE n <= 5"""


def oracle_sql() -> dict[str, str]:
    top = f"top AS (SELECT skill FROM sk ORDER BY {_ORDER}, skill LIMIT 10)"
    picked = f"{{}} IN ({', '.join(repr(x) for x in rules.LEGACY_BANDS['80_over'])}) AND created_at >= '1998-01-01' AND created_at < '2000-01-01'"
    return {
        "skill_market": f"{_with(MARKET, SKILLS)} SELECT * FROM sk",
        "skill_ranking": f"{_with(MARKET, SKILLS)} SELECT * FROM sk ORDER BY {_ORDER}, skill LIMIT 10",
        "price_band_market": f"{_with(MARKET)} {_keyed('price_band')}",
        "region_market": f"{_with(MARKET)} {_keyed('region', 'work_style')}",
        "market_cells": f"""{_with(MARKET)}, d AS (SELECT {_CELL}, month, contract_type, {_P} FROM (SELECT DISTINCT project_id, skill FROM pk) JOIN p USING (project_id) GROUP BY ALL),
          s AS (SELECT {", ".join(f"c.{k}" for k in _CELL.split(", "))}, c.month, count(*) AS qc, median(price) AS qm, sum(quality) AS qq FROM (SELECT DISTINCT {_CELL}, month FROM d) c JOIN (SELECT * FROM qk JOIN q USING (person_id)) o
            ON {" AND ".join(f"c.{k} = o.{k}" for k in _CELL.split(", "))} AND (o.month = 'unknown' OR c.month = 'unknown' OR o.month <= c.month) GROUP BY ALL),
          m AS (SELECT {_CELL}, month AS start_month, contract_type, {_BASE} FROM d LEFT JOIN s USING ({_CELL}, month))
          SELECT *, greatest({_SCORE}, 0)::BIGINT AS score, {_REASONS} AS reasons FROM m""",
        "focus_insights": f"""{_with(MARKET, SKILLS)}, bands AS ({_keyed('price_band')}), regions AS ({_keyed('region')})
          SELECT * FROM (SELECT 'skill' AS kind, skill AS key FROM sk ORDER BY {_ORDER}, skill LIMIT 1) UNION ALL SELECT * FROM (SELECT 'price_band', price_band FROM bands WHERE price_band <> 'unknown' ORDER BY {_ORDER}, price_band LIMIT 1) UNION ALL SELECT * FROM (SELECT 'region', region FROM regions ORDER BY {_ORDER}, region LIMIT 1)""",
        "quality_alerts": f"""{_with(MARKET)}, a AS ({_ALERT_ROWS}), k AS ({_KINDS})
          SELECT code, severity, target, n AS count, ids AS sample_ids FROM (SELECT code, count(*) AS n FROM a GROUP BY 1) JOIN k USING (code)
          JOIN (SELECT code, string_agg(id::VARCHAR, ',' ORDER BY r) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY side, id) AS r FROM a) WHERE r <= 5 GROUP BY 1) USING (code)""",
        "alert_totals": f"""{_with(MARKET)}, a AS ({_ALERT_ROWS}), k AS ({_KINDS}) SELECT severity, count(*) AS n_alerts FROM a JOIN k USING (code) GROUP BY 1""",
        "skilled_projects": f"""{_with(MARKET)} SELECT project_id, price_band FROM p WHERE created_at >= '1998-04-01' AND created_at < '1998-07-01' AND project_id IN (SELECT project_id FROM pk WHERE lower(skill) = 'java')""",
        "market_filtered": f"""{_with(MARKET)} SELECT 'project' AS side, project_id AS id, price_band, region, work_style FROM p WHERE is_focus AND {picked.format('price_band')}
          UNION ALL SELECT 'person', person_id, price_band, region, work_style FROM q WHERE {picked.format('price_band')}""",
        "period_summary": f"""{_with(MARKET)}, a AS (SELECT 'projects' AS side, strftime(created_at, '%Y-%m') AS month FROM p UNION ALL SELECT 'persons', strftime(created_at, '%Y-%m') FROM q)
          SELECT side, min(month) AS first_month, max(month) AS last_month FROM (SELECT * FROM a UNION ALL SELECT 'all', month FROM a) GROUP BY 1""",
        "market_summary": f"""{_with(MARKET)} SELECT 'projects' AS side, count(*) AS n_rows, count(*) FILTER (is_focus) AS n_focus, count(*) FILTER (created_at >= '1998-01-01') AS n_since FROM p
          UNION ALL SELECT 'persons', count(*), 0, count(*) FILTER (created_at >= '1998-01-01') FROM q""",
        "skill_examples": f"{_with(MARKET, SKILLS, top)} {_examples('PJ', 'p', 'project_id', 'pk', 'is_focus::INT')} UNION ALL {_examples('PE', 'q', 'person_id', 'qk', '0')}",
        "market_normal_forms": f"WITH {b.SQL}, {MARKET.replace(chr(39) + 'ARCHIVED' + chr(39), chr(39) + 'none' + chr(39))} SELECT project_id, price, price_band, region, work_style, month AS start_month, contract_type, heads::BIGINT AS heads, quality::BIGINT AS quality FROM p",
    }
