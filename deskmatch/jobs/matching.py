"""Matching, suggestion and review queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching, pair_counts, review
from ..plans import binding as b
from ..sources import tables

MIN_SCORE = 60
#: A least score that pairs without a common skill may have.
LOW_SCORE = 30
VERSION = "v1"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    return b.projects(spark, sf_dir), b.project_skills(spark, sf_dir), b.persons(spark, sf_dir), b.person_skills(spark, sf_dir)


def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates between all projects and all persons that are not archived."""
    return matching.match_candidates(*_sides(spark, sf_dir), MIN_SCORE)


def match_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three persons of each project (a top-k report)."""
    return matching.best_matches(*_sides(spark, sf_dir), MIN_SCORE, 3).select("project_id", "person_id", "score", "band", "rank")


def match_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands, reasons and warnings of all candidates, which are counted by classes and not listed."""
    pairs = pair_counts.pair_histogram(*_sides(spark, sf_dir)).filter(F.col("score") >= MIN_SCORE)
    return pair_counts.all_pairs_distribution(pairs).filter("kind != 'candidates'")


def match_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands, reasons and warnings of all pairs, whatever their scores, and the pairs of at least LOW_SCORE."""
    pairs = pair_counts.pair_histogram(*_sides(spark, sf_dir))
    return pair_counts.all_pairs_distribution(pairs, LOW_SCORE)


def match_review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of candidates with a matching rate, attention first (a page is the feature)."""
    return matching.review_first_page(*_sides(spark, sf_dir), MIN_SCORE, 2, 20, "match").select("project_id", "person_id", "score", "band", "attention")


def suggestions_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions that a run adds to those of an earlier one that saved only the best band."""
    sides = _sides(spark, sf_dir)
    once = all(rows.groupBy(key).count().filter("count > 1").isEmpty() for rows, key in ((sides[0], "project_id"), (sides[2], "person_id")))
    classes = matching.candidate_classes(*sides, MIN_SCORE)
    of_score = lambda least: matching.class_pairs(*classes, least)
    best = of_score(matching.HIGH_SCORE).filter("band = 'HIGH'")
    first, _ = review.save_suggestions(best, best.select(F.lit(None).cast("string").alias("suggestion_key")).filter("false"), VERSION, once)
    first = tables.written(first.select(*review.PAIR, *review.CODES), "suggestions")
    second = review.new_suggestions(of_score(MIN_SCORE), first, VERSION, once, of_score)
    return second.select("project_id", "person_id", "score", "status", "action", "to_status")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for review actions on suggestion user_id."""
    names = {"view": "KEEP_SUGGESTED", "click": "REQUEST_REVIEW", "purchase": "APPROVE", "error": "REJECT"}
    action = b.lookup(F.col("event_type"), names, F.when(F.col("event_id") % 2 == 0, "ARCHIVE").otherwise("RESTORE"))
    return b.table(spark, sf_dir, "events").select(F.col("user_id").alias("suggestion_id"), "ts", "event_id", action.alias("action"))


def review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.fold_review_events(_events(spark, sf_dir))


def _suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions stand for customers: a score, a state and a time from the key."""
    k = F.col("c_custkey")
    status = F.when(k % 5 == 0, "NEEDS_REVIEW").when(k % 5 < 3, "SUGGESTED").when(k % 5 == 3, "APPROVED").otherwise("REJECTED")
    return b.table(spark, sf_dir, "customer").select(k.alias("suggestion_id"), (k * 37 % 101).cast("int").alias("score"), status.alias("status"), (k % 3).cast("int").alias("n_warnings"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")).alias("created_at"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_queue(_suggestions(spark, sf_dir)).select("suggestion_id", "segment", "score", "created_at")


def suggestion_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of suggested rows with scores from 20 to 90 (a page is the feature)."""
    return review.list_suggestions(_suggestions(spark, sf_dir), "score_desc", 3, 20, 20, 90, status="SUGGESTED")


def suggestion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = b.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("suggestion_id"))
    return review.suggestion_counts(_suggestions(spark, sf_dir), _events(spark, sf_dir), evidence)


def newest_review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 events of each suggestion (a top-k report)."""
    return review.newest_events(_events(spark, sf_dir)).select("suggestion_id", "event_id", "action", "rank")


NAMES = ["match_candidates", "match_top", "match_distribution", "match_all_pairs", "match_review_page", "suggestions_saved", "review_state", "review_queue", "suggestion_page", "suggestion_counts", "newest_review_events"]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


CANDIDATES = f"""WITH {b.SQL},
pr AS (SELECT *, nullif(unit_min, 0) AS pmin, nullif(unit_max, 0) AS pmax, year(start_month) * 12 + month(start_month) AS pmonth, lower(remote_type) AS premote,
  list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^a-z0-9+#.]+', ' ', 'g'), ' +'), lambda t: length(t) >= 3)) AS prole
  FROM projects WHERE status <> 'ARCHIVED'),
pe AS (SELECT *, status AS qstatus, place AS qplace, nullif(desired, 0) AS rate, year(available) * 12 + month(available) AS qmonth, lower(coalesce(remote_wish, '')) AS qremote,
  list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(summary), '[^a-z0-9+#.]+', ' ', 'g'), ' +'), lambda t: length(t) >= 3)) AS qrole FROM persons WHERE status <> 'ARCHIVED'),
ps AS (SELECT project_id, k, max((skill_type = 'REQUIRED')::INT) AS a, max((skill_type = 'PREFERRED')::INT) AS b, max((skill_type = 'USED_TECHNOLOGY')::INT) AS c
  FROM (SELECT *, regexp_replace(lower(skill_name), '[^a-z0-9+#.]+', '', 'g') AS k FROM project_skills) WHERE k <> '' GROUP BY 1, 2),
qs AS (SELECT DISTINCT person_id, regexp_replace(lower(skill_name), '[^a-z0-9+#.]+', '', 'g') AS k FROM person_skills WHERE trim(skill_name) <> ''),
o AS (SELECT project_id, person_id, sum(a)::BIGINT AS n_required, sum(b)::BIGINT AS n_preferred, sum(c)::BIGINT AS n_technology, count(*) AS n_skills FROM ps JOIN qs USING (k) GROUP BY 1, 2),
s AS (SELECT o.*, pr.status AS pstatus, qstatus, pmin, pmax, rate, pmonth, qmonth,
  CASE WHEN rate IS NULL OR (pmin IS NULL AND pmax IS NULL) THEN 'unknown' WHEN rate > pmax THEN 'mismatch' WHEN rate < floor(pmin * 0.75) THEN 'mismatch' ELSE 'match' END AS rate_state,
  CASE WHEN pmonth IS NULL OR qmonth IS NULL THEN 'unknown' WHEN qmonth <= pmonth + 1 THEN 'match' ELSE 'mismatch' END AS date_state,
  CASE WHEN (contains(premote, 'remote') OR contains(premote, 'hybrid')) AND (contains(qremote, 'リモート') OR contains(qremote, '可')) THEN 'match' WHEN contains(qplace, pr.place) THEN 'match' ELSE 'mismatch' END AS place_state,
  len(list_intersect(prole, qrole)) >= 2 AS role_match, (pmin IS NULL AND pmax IS NULL)::INT + (pmonth IS NULL)::INT + (rate IS NULL)::INT + (qmonth IS NULL)::INT >= 3 AS low
  FROM o JOIN pr USING (project_id) JOIN pe USING (person_id)),
t AS (SELECT *, greatest(least(CASE WHEN n_required > 0 THEN least(35, 18 + 7 * n_required) ELSE 0 END + CASE WHEN n_preferred > 0 THEN least(15, 8 + 3 * n_preferred) ELSE 0 END + least(10, 3 * n_technology)
  + CASE rate_state WHEN 'match' THEN 15 WHEN 'unknown' THEN 4 ELSE 0 END + CASE date_state WHEN 'match' THEN 10 WHEN 'unknown' THEN 3 ELSE 0 END + CASE place_state WHEN 'match' THEN 10 WHEN 'unknown' THEN 3 ELSE 0 END
  + 10 * role_match::INT - 8 * low::INT - CASE WHEN pstatus = 'DRAFT' THEN 4 ELSE 0 END - CASE WHEN qstatus <> 'AVAILABLE' THEN 8 ELSE 0 END, 100), 0)::INT AS score FROM s),
c AS (SELECT project_id, person_id, score, CASE WHEN low OR score < 35 THEN 'REVIEW' WHEN score >= 75 THEN 'HIGH' WHEN score >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS band, n_required, n_preferred, n_technology, n_skills,
  rate_state, date_state, place_state, role_match,
  concat_ws(',', CASE WHEN n_required > 0 THEN 'MATCH_SKILL_REQUIRED_OVERLAP' END, CASE WHEN n_preferred > 0 THEN 'MATCH_SKILL_NICE_TO_HAVE_OVERLAP' END,
    'MATCH_RATE_' || CASE rate_state WHEN 'match' THEN 'COMPATIBLE' ELSE upper(rate_state) END, CASE date_state WHEN 'match' THEN 'MATCH_START_COMPATIBLE' WHEN 'unknown' THEN 'MATCH_START_UNKNOWN' END,
    CASE place_state WHEN 'match' THEN 'MATCH_LOCATION_COMPATIBLE' END, CASE WHEN role_match THEN 'MATCH_ROLE_COMPATIBLE' END) AS reasons,
  CASE WHEN low THEN 'MATCH_LOW_FIELD_COVERAGE,MATCH_REVIEW_REQUIRED' ELSE '' END AS warnings FROM t WHERE score >= {MIN_SCORE}),
r AS (SELECT *, CASE WHEN warnings <> '' OR band = 'REVIEW' THEN 'NEEDS_REVIEW' WHEN band = 'HIGH' THEN 'HIGH_SCORE' ELSE 'STANDARD' END AS attention FROM c)
"""
#: All pairs of rows that are not archived with their codes.
ALL_PAIRS = CANDIDATES[: CANDIDATES.index("s AS (SELECT o.*")] + """
s AS (SELECT coalesce(n_required, 0) AS n_required, coalesce(n_preferred, 0) AS n_preferred, coalesce(n_technology, 0) AS n_technology, pr.status AS pstatus, qstatus, x.project_id IS NULL AS pbare, y.person_id IS NULL AS qbare,
  CASE WHEN rate IS NULL OR (pmin IS NULL AND pmax IS NULL) THEN 'unknown' WHEN rate > pmax THEN 'mismatch' WHEN rate < floor(pmin * 0.75) THEN 'mismatch' ELSE 'match' END AS rate_state,
  CASE WHEN pmonth IS NULL OR qmonth IS NULL THEN 'unknown' WHEN qmonth <= pmonth + 1 THEN 'match' ELSE 'mismatch' END AS date_state,
  CASE WHEN (contains(premote, 'remote') OR contains(premote, 'hybrid')) AND (contains(qremote, 'リモート') OR contains(qremote, '可')) THEN 'match' WHEN contains(qplace, pr.place) THEN 'match' ELSE 'mismatch' END AS place_state,
  len(list_intersect(prole, qrole)) >= 2 AS role_match, (pmin IS NULL AND pmax IS NULL)::INT + (pmonth IS NULL)::INT + (rate IS NULL)::INT + (qmonth IS NULL)::INT >= 3 AS low
  FROM pr CROSS JOIN pe LEFT JOIN o USING (project_id, person_id) LEFT JOIN (SELECT DISTINCT project_id FROM project_skills) x USING (project_id) LEFT JOIN (SELECT DISTINCT person_id FROM person_skills) y USING (person_id)),
t AS (SELECT *, greatest(least(CASE WHEN n_required > 0 THEN least(35, 18 + 7 * n_required) ELSE 0 END + CASE WHEN n_preferred > 0 THEN least(15, 8 + 3 * n_preferred) ELSE 0 END + least(10, 3 * n_technology)
  + CASE rate_state WHEN 'match' THEN 15 WHEN 'unknown' THEN 4 ELSE 0 END + CASE date_state WHEN 'match' THEN 10 WHEN 'unknown' THEN 3 ELSE 0 END + CASE place_state WHEN 'match' THEN 10 ELSE 0 END
  + 10 * role_match::INT - 8 * low::INT - CASE WHEN pstatus = 'DRAFT' THEN 4 ELSE 0 END - CASE WHEN qstatus <> 'AVAILABLE' THEN 8 ELSE 0 END - 18 * pbare::INT - 18 * qbare::INT, 100), 0)::INT AS score FROM s),
h AS (SELECT score, low, n_required > 0 AS a, n_preferred > 0 AS b, rate_state, date_state, place_state, role_match, pbare, qbare, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT n, unnest(['band:' || CASE WHEN low OR score < 35 THEN 'REVIEW' WHEN score >= 75 THEN 'HIGH' WHEN score >= 55 THEN 'MEDIUM' ELSE 'LOW' END, CASE WHEN a THEN 'reason:MATCH_SKILL_REQUIRED_OVERLAP' END, CASE WHEN b THEN 'reason:MATCH_SKILL_NICE_TO_HAVE_OVERLAP' END,
  'reason:MATCH_RATE_' || CASE rate_state WHEN 'match' THEN 'COMPATIBLE' ELSE upper(rate_state) END, CASE date_state WHEN 'match' THEN 'reason:MATCH_START_COMPATIBLE' WHEN 'unknown' THEN 'reason:MATCH_START_UNKNOWN' END, CASE place_state WHEN 'match' THEN 'reason:MATCH_LOCATION_COMPATIBLE' END,
  CASE WHEN role_match THEN 'reason:MATCH_ROLE_COMPATIBLE' END, CASE WHEN pbare THEN 'warning:MATCH_MISSING_PROJECT_SKILLS' END, CASE WHEN qbare THEN 'warning:MATCH_MISSING_PERSON_SKILLS' END, CASE WHEN low THEN 'warning:MATCH_LOW_FIELD_COVERAGE' END, CASE WHEN low THEN 'warning:MATCH_REVIEW_REQUIRED' END,
  CASE WHEN score >= LEAST THEN 'candidates:LEAST+' END]) AS c FROM h)
SELECT split_part(c, ':', 1) AS kind, split_part(c, ':', 2) AS code, sum(n)::BIGINT AS n FROM k WHERE c IS NOT NULL GROUP BY 1, 2
""".replace("LEAST", str(LOW_SCORE))
_EVENTS = """e AS (SELECT user_id AS suggestion_id, ts, event_id, CASE event_type WHEN 'view' THEN 'KEEP_SUGGESTED' WHEN 'click' THEN 'REQUEST_REVIEW' WHEN 'purchase' THEN 'APPROVE' WHEN 'error' THEN 'REJECT'
  ELSE CASE WHEN event_id % 2 = 0 THEN 'ARCHIVE' ELSE 'RESTORE' END END AS action FROM events)"""
_SUGGESTIONS = """g AS (SELECT c_custkey AS suggestion_id, (c_custkey * 37 % 101)::INT AS score, CASE WHEN c_custkey % 5 = 0 THEN 'NEEDS_REVIEW' WHEN c_custkey % 5 < 3 THEN 'SUGGESTED' WHEN c_custkey % 5 = 3 THEN 'APPROVED' ELSE 'REJECTED' END AS status,
  (c_custkey % 3)::INT AS n_warnings, (DATE '2024-01-01' + (c_custkey % 300)::INT)::DATE AS created_at FROM customer)"""
_NEXT = "CASE " + " ".join(f"WHEN n.action = '{a}' AND s.status IN ({', '.join(repr(x) for x in froms)}) THEN '{to}'" for a, (froms, to) in review.ACTIONS.items()) + " ELSE s.status END"


def oracle_sql() -> dict[str, str]:
    return {
        "match_candidates": f"{CANDIDATES} SELECT * FROM c",
        "match_top": f"{CANDIDATES} SELECT * FROM (SELECT project_id, person_id, score, band, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, person_id)::INT AS rank FROM c) WHERE rank <= 3",
        "match_distribution": f"""{CANDIDATES} SELECT kind, code, count(*) AS n FROM (SELECT 'band' AS kind, band AS code FROM c UNION ALL SELECT 'reason', unnest(string_split(reasons, ',')) FROM c UNION ALL
          SELECT 'warning', unnest(string_split(warnings, ',')) FROM c WHERE warnings <> '') GROUP BY 1, 2""",
        "match_all_pairs": ALL_PAIRS,
        "match_review_page": f"{CANDIDATES} SELECT project_id, person_id, score, band, attention FROM r WHERE rate_state = 'match' ORDER BY attention = 'NEEDS_REVIEW' DESC, score DESC, project_id, person_id LIMIT 20 OFFSET 20",
        "suggestions_saved": f"{CANDIDATES} SELECT project_id, person_id, score, status, 'CREATED' AS action, status AS to_status FROM (SELECT *, CASE WHEN warnings <> '' OR band = 'REVIEW' THEN 'NEEDS_REVIEW' ELSE 'SUGGESTED' END AS status FROM c WHERE band <> 'HIGH')",
        "review_state": f"""WITH RECURSIVE {_EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY suggestion_id ORDER BY ts, event_id) AS i FROM e),
          s AS (SELECT DISTINCT suggestion_id, 0::BIGINT AS i, 'SUGGESTED' AS status, 0 AS applied, NULL::TIMESTAMP AS seen FROM n
            UNION ALL SELECT s.suggestion_id, s.i + 1, {_NEXT}, s.applied + ({_NEXT} <> s.status)::INT, CASE WHEN {_NEXT} <> s.status THEN n.ts ELSE s.seen END FROM s JOIN n ON n.suggestion_id = s.suggestion_id AND n.i = s.i + 1)
          SELECT suggestion_id, status, applied::INT AS n_applied, i::INT AS n_events, seen AS reviewed_at, CASE WHEN status = 'ARCHIVED' THEN seen END AS archived_at FROM s QUALIFY row_number() OVER (PARTITION BY suggestion_id ORDER BY i DESC) = 1""",
        "review_queue": f"WITH {_SUGGESTIONS} SELECT suggestion_id, segment, score, created_at FROM (SELECT *, CASE WHEN status = 'NEEDS_REVIEW' THEN 1 WHEN status = 'SUGGESTED' THEN 2 WHEN n_warnings > 0 THEN 3 END::INT AS segment FROM g) WHERE segment IS NOT NULL",
        "suggestion_page": f"WITH {_SUGGESTIONS} SELECT * FROM g WHERE score BETWEEN 20 AND 90 AND status = 'SUGGESTED' ORDER BY score DESC, created_at DESC, suggestion_id LIMIT 20 OFFSET 40",
        "suggestion_counts": f"WITH {_EVENTS}, {_SUGGESTIONS} SELECT suggestion_id, coalesce(a, 0) AS n_events, coalesce(b, 0) AS n_evidence FROM g LEFT JOIN (SELECT suggestion_id, count(*) AS a FROM e GROUP BY 1) USING (suggestion_id) LEFT JOIN (SELECT o_custkey AS suggestion_id, count(*) AS b FROM orders GROUP BY 1) USING (suggestion_id)",
        "newest_review_events": f"WITH {_EVENTS} SELECT suggestion_id, event_id, action, rank FROM (SELECT *, row_number() OVER (PARTITION BY suggestion_id ORDER BY ts DESC, event_id DESC)::INT AS rank FROM e) WHERE rank <= 50",
    }
