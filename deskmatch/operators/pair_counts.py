"""Counts over all pairs of projects and persons, none of which is listed.

A pair's score is a sum of points for its skills, its rate, its month, its place, its role words and the two
rows' own states, so pairs are counted by classes:

1. Skills. Only sets that share a skill have skill points. All pairs are counted as if none shared any; for the
   sets that do, the same pairs are taken off and added again with their points (rows with a sign).
2. Place and role. What a pair gives follows from a few flags of either side, but for exceptions: places of
   which one names the other, and role texts with two common words. These are found by joins on runs of two
   characters and on words, and their pairs are again taken off and added with what they give.
3. Rate and month. A rate matches within the project's bounds and a month up to the project's, so each
   project's bounds are looked up in sums over the persons' rates and months (two-way dominance), for all projects
   of a class at once.

Rows are added up by class before each of these steps; classes are as many as there are different values, whatever
the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from . import matching as m

STATES = ["match", "unknown", "mismatch"]
RATE_POINTS, DATE_POINTS, PLACE_POINTS = (15, 4, 0), (10, 3, 0), (10, 3, 0)
ROLE_POINTS, NO_SKILLS, LOW_COVERAGE = 10, 18, 8
P_CLASS = ["required", "preferred", "p_bare", "p_points", "p_missing", "low", "high", "month"]
Q_CLASS = ["place", "role", "q_bare", "q_points", "q_missing", "rate", "free"]
HISTOGRAM = ["required", "preferred", "p_bare", "q_bare", "rate", "date", "place", "role", "low_coverage", "score"]


def _flags(friendly: Column, place: Column, remote: Column) -> Column:
    return friendly.cast("int") * 4 + (place == "").cast("int") * 2 + (remote == "").cast("int")


def _has(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def _default_place(p: Column, q: Column) -> Column:
    """The place state (a number of STATES) of flags, if no place names the other."""
    friendly = lambda c: c.bitwiseAND(4) > 0
    no_place, no_remote = lambda c: c.bitwiseAND(2) > 0, lambda c: c.bitwiseAND(1) > 0
    return F.when(friendly(p) & friendly(q), 0).when(no_place(p) & no_place(q) & no_remote(p) & no_remote(q), 1).when(no_place(p) | no_place(q), F.when(no_remote(p) & no_remote(q), 2).otherwise(1)).otherwise(2)


def _projects(projects: DataFrame, skills: DataFrame) -> DataFrame:
    """Projects by class: set (key and skills), cat and flags of place and role, points of their own, missing fields, bounds and month, n."""
    rows = m.match_projects(projects.filter("status != 'ARCHIVED'")).join(m.project_sets(skills), "project_id", "left").join(skills.select("project_id").distinct().withColumn("_some", F.lit(True)), "project_id", "left")
    bare = F.col("_some").isNull()
    missing = (F.col("p_min").isNull() & F.col("p_max").isNull()).cast("int") + F.col("p_month").isNull().cast("int") + ((F.col("p_place") == "") & (F.col("p_remote") == "")).cast("int")
    points = -F.when(F.col("p_status") == "DRAFT", 4).otherwise(0) - F.when(bare, NO_SKILLS).otherwise(0)
    low = F.floor(F.col("p_min") * 0.75).cast("double")
    return rows.select("project_id", "p_set", "p_place", "p_remote", "p_role", bare.alias("p_bare"), points.alias("p_points"), missing.alias("p_missing"), low.alias("low"), F.col("p_max").cast("double").alias("high"), (F.col("p_month") + 1).alias("month"))


def _persons(persons: DataFrame, skills: DataFrame) -> DataFrame:
    rows = m.match_persons(persons.filter("status != 'ARCHIVED'")).join(m.person_sets(skills), "person_id", "left").join(skills.select("person_id").distinct().withColumn("_some", F.lit(True)), "person_id", "left")
    bare = F.col("_some").isNull()
    missing = F.col("q_rate").isNull().cast("int") + F.col("q_month").isNull().cast("int") + ((F.col("q_place") == "") & (F.col("q_remote") == "")).cast("int")
    points = -F.when(F.col("q_status") != "AVAILABLE", 8).otherwise(0) - F.when(bare, NO_SKILLS).otherwise(0)
    return rows.select("person_id", "q_set", "q_place", "q_remote", "q_role", bare.alias("q_bare"), F.coalesce(points, F.lit(0)).alias("q_points"), missing.alias("q_missing"), F.col("q_rate").cast("double").alias("rate"), F.col("q_month").alias("free"))


def _exceptions(p: DataFrame, q: DataFrame) -> DataFrame:
    """p_cat, q_cat, place_named and role of the kinds of rows for which a place names the other or two role words are common."""
    tokens = p.select("p_place").distinct().select("p_place", F.explode(F.array_distinct(F.filter(F.split("p_place", r"[,\s　、/／・]+"), lambda t: F.length(t) >= 2))).alias("t"))
    runs = q.select("q_place").distinct().filter("length(q_place) >= 2").select("q_place", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("q_place") - 1), lambda i: F.substring(F.col("q_place"), i, 2)))).alias("run"))
    places = tokens.join(runs, F.substring("t", 1, 2) == F.col("run")).filter(F.contains(F.col("q_place"), F.col("t"))).select("p_place", "q_place").distinct()
    words = lambda rows, side: rows.select(f"{side}_role").distinct().filter(F.size(f"{side}_role") >= 2).select(f"{side}_role", F.explode(f"{side}_role").alias("w"))
    roles = words(p, "p").join(words(q, "q"), "w").groupBy("p_role", "q_role").agg(F.count("*").alias("n")).filter("n >= 2").select("p_role", "q_role")
    p_cats, q_cats = (rows.select(f"{s}_cat", f"{s}_flags", f"{s}_place", f"{s}_role").distinct() for rows, s in ((p, "p"), (q, "q")))
    named = p_cats.join(places, "p_place").join(q_cats, "q_place").filter("(p_flags & 4) = 0 OR (q_flags & 4) = 0").select("p_cat", "q_cat", F.lit(True).alias("place_named"), F.lit(False).alias("role"))
    common = p_cats.join(roles, "p_role").join(q_cats, "q_role").select("p_cat", "q_cat", F.lit(False).alias("place_named"), F.lit(True).alias("role"))
    return named.unionByName(common).groupBy("p_cat", "q_cat").agg(F.max("place_named").alias("place_named"), F.max("role").alias("role"))


def _counted(left: pa.Table, right: pa.Table) -> pa.Table:
    """Histogram rows of one class of projects (left) and the persons that it meets (right), both by class with a signed n."""
    kinds = [("required", pa.int32()), ("preferred", pa.int32()), ("p_bare", pa.int32()), ("q_bare", pa.int32()), ("rate", pa.int32()), ("date", pa.int32()), ("place", pa.int32()), ("role", pa.int32()), ("low_coverage", pa.int32()), ("score", pa.int32()), ("n", pa.int64())]
    if not left.num_rows or not right.num_rows:
        return pa.table({k: pa.array([], t) for k, t in kinds})
    number = lambda t, c: t.column(c).to_numpy(zero_copy_only=False).astype(np.float64)  # noqa: E731  null: nan
    whole = lambda t, c: t.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
    low, high, until, rate, free = number(left, "low"), number(left, "high"), number(left, "month"), number(right, "rate"), number(right, "free")
    rates, months = np.unique(rate[~np.isnan(rate)]), np.unique(free[~np.isnan(free)])
    # Places in the sums: before all, known values in order, and unknown ones at the end.
    to_rate = np.where(np.isnan(high), len(rates), np.searchsorted(rates, high, "right"))
    from_rate = np.minimum(np.where(np.isnan(low), 0, np.searchsorted(rates, low, "left")), to_rate)
    to_month = np.searchsorted(months, until, "right")
    bound, dated = ~(np.isnan(low) & np.isnan(high)), ~np.isnan(until)
    q_class, of = np.unique(np.column_stack([whole(right, c) for c in ("place", "role", "q_bare", "q_points", "q_missing")]), axis=0, return_inverse=True)
    at_rate = np.where(np.isnan(rate), len(rates), np.searchsorted(rates, rate))
    at_month = np.where(np.isnan(free), len(months), np.searchsorted(months, free))
    own = np.column_stack([whole(left, c) for c in ("required", "preferred", "p_bare", "p_points", "p_missing")])
    found: dict[tuple, int] = {}
    for k, (place, role, q_bare, q_points, q_missing) in enumerate(q_class.tolist()):
        mine = of.ravel() == k
        grid = np.zeros((len(rates) + 2, len(months) + 2), np.int64)
        np.add.at(grid, (at_rate[mine] + 1, at_month[mine] + 1), whole(right, "n")[mine])
        sums = grid.cumsum(axis=0).cumsum(axis=1)
        last_rate, last_month = len(rates), len(months)
        everything = sums[-1, -1]

        def up_to(r, c):  # noqa: B023  persons of a known rate up to r and a known month up to c; one place further: unknown ones too
            return sums[r, c]  # noqa: B023

        zero = np.zeros(len(low), np.int64)
        by_state = {}
        for d, (c_to, c_from) in {0: (to_month, 0), 1: (last_month + 1, last_month), 2: (last_month, to_month)}.items():
            column = lambda r, c_to=c_to, c_from=c_from: up_to(r, c_to) - up_to(r, c_from)
            undated = lambda r, d=d: up_to(r, last_month + 1) + zero if d == 1 else zero
            pick = lambda r: np.where(dated, column(r), undated(r))  # noqa: B023, E731
            match, known, every = pick(to_rate) - pick(from_rate), pick(np.full(len(low), last_rate)), pick(np.full(len(low), last_rate + 1))
            by_state[0, d] = np.where(bound, match, 0)
            by_state[1, d] = np.where(bound, every - known, every)
            by_state[2, d] = np.where(bound, known - match, 0)
        assert sum(v[0] for v in by_state.values()) == everything
        for (r, d), n in by_state.items():
            n = n * whole(left, "n")
            lacking = own[:, 4] + q_missing >= 3
            score = np.clip(own[:, 3] + q_points + RATE_POINTS[r] + DATE_POINTS[d] + PLACE_POINTS[place] + ROLE_POINTS * role - LOW_COVERAGE * lacking, 0, 100)
            code = (((own[:, 0] * 2 + own[:, 1]) * 2 + own[:, 2]) * 2 + lacking) * 101 + score
            codes, at = np.unique(code[n != 0], return_inverse=True)
            total = np.zeros(len(codes), np.int64)
            np.add.at(total, at, n[n != 0])
            for c, t in zip(codes.tolist(), total.tolist()):
                key = (c // 808, c // 404 % 2, c // 202 % 2, q_bare, r, d, place, role, c // 101 % 2, c % 101)
                found[key] = found.get(key, 0) + t
    columns = list(zip(*((*key, n) for key, n in found.items()))) or [[] for _ in kinds]
    return pa.table({name: pa.array(list(values), t) for (name, t), values in zip(kinds, columns)})


def pair_histogram(projects: DataFrame, project_skills: DataFrame, persons: DataFrame, person_skills: DataFrame) -> DataFrame:
    """n, the number of all pairs of rows that are not archived, by what their scores are made of: common required and preferred skills, sides without any skill, states of rate, date and place (numbers of STATES), role, low coverage, score."""
    key = lambda rows, name, *columns: rows.withColumn(name, F.sha2(F.to_json(F.struct(*columns)), 256))
    p, q = _projects(projects, project_skills), _persons(persons, person_skills)
    p, q = m.shared_words(p, "project_id", "p_role", q, "q_role"), m.shared_words(q, "person_id", "q_role", p, "p_role")
    p = p.withColumn("p_flags", _flags(_has(F.col("p_remote"), m.FRIENDLY_PROJECT), F.col("p_place"), F.col("p_remote")))
    q = q.withColumn("q_flags", _flags(_has(F.col("q_remote"), m.FRIENDLY_PERSON), F.col("q_place"), F.col("q_remote")))
    p = key(key(p, "p_key", "p_set"), "p_cat", "p_place", "p_flags", "p_role")
    q = key(key(q, "q_key", "q_set"), "q_cat", "q_place", "q_flags", "q_role")
    sides = ["p_key", "p_cat", "p_flags", "p_bare", "p_points", "p_missing", "low", "high", "month"]
    p = written(p.groupBy(*sides).agg(F.count("*").alias("n"), F.first("p_set").alias("p_set"), F.first("p_place").alias("p_place"), F.first("p_role").alias("p_role")), "projects")
    sides = ["q_key", "q_cat", "q_flags", "q_bare", "q_points", "q_missing", "rate", "free"]
    q = written(q.groupBy(*sides).agg(F.count("*").alias("n"), F.first("q_set").alias("q_set"), F.first("q_place").alias("q_place"), F.first("q_role").alias("q_role")), "persons")

    # Left: all projects as if no skill were common (key ''), and for each set of persons those with common skills: with their points, less the same without.
    sets = m.set_overlaps(p.filter("p_set IS NOT NULL").select("p_key", "p_set"), q.filter("q_set IS NOT NULL").select("q_key", "q_set"))
    sets = sets.select("p_key", F.col("q_key").alias("key"), (F.col("n_required") > 0).cast("int").alias("required"), (F.col("n_preferred") > 0).cast("int").alias("preferred"), m.skill_points().alias("points"))
    bare = p.select("p_cat", "p_flags", F.lit("").alias("key"), F.lit(0).alias("required"), F.lit(0).alias("preferred"), "p_bare", "p_points", "p_missing", "low", "high", "month", "n")
    met = p.join(sets, "p_key")
    signs = F.explode(F.array(F.struct("required", "preferred", F.col("points").alias("points"), F.lit(1).alias("sign")), F.struct(F.lit(0).alias("required"), F.lit(0).alias("preferred"), F.lit(0).alias("points"), F.lit(-1).alias("sign"))))
    met = met.withColumn("x", signs).select("p_cat", "p_flags", "key", "x.required", "x.preferred", "p_bare", (F.col("p_points") + F.col("x.points")).alias("p_points"), "p_missing", "low", "high", "month", (F.col("n") * F.col("x.sign")).alias("n"))
    left = bare.unionByName(met).withColumn("p_bare", F.col("p_bare").cast("int"))
    left = written(left.groupBy("p_cat", "p_flags", "key", *P_CLASS).agg(F.sum("n").alias("n")).filter("n != 0"), "left")

    # Right: all persons with what flags alone give, for each flag of a project; for each kind of project the exceptions, less what flags gave them.
    each = q.withColumn("key", F.explode(F.array(F.lit(""), "q_key")))
    by_flags = each.withColumn("p_flags", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(F.concat(F.lit("flags "), "p_flags").alias("group"), "key", _default_place(F.col("p_flags"), F.col("q_flags")).alias("place"), F.lit(0).alias("role"), "q_bare", "q_points", "q_missing", "rate", "free", "n")
    found = written(_exceptions(p, q), "exceptions")
    kinds = p.select("p_cat", "p_flags").distinct()
    default = _default_place(F.col("p_flags"), F.col("q_flags"))
    both = F.explode(F.array(F.struct(F.when(F.col("place_named"), 0).otherwise(default).alias("place"), F.col("exception_role").cast("int").alias("role"), F.lit(1).alias("sign")), F.struct(default.alias("place"), F.lit(0).alias("role"), F.lit(-1).alias("sign"))))
    by_kind = each.join(found.withColumnRenamed("role", "exception_role").join(kinds, "p_cat"), "q_cat").withColumn("x", both).select(F.col("p_cat").alias("group"), "key", "x.place", "x.role", "q_bare", "q_points", "q_missing", "rate", "free", (F.col("n") * F.col("x.sign")).alias("n"))
    right = by_flags.unionByName(by_kind).withColumn("q_bare", F.col("q_bare").cast("int")).groupBy("group", "key", *Q_CLASS).agg(F.sum("n").alias("n")).filter("n != 0")

    flagged = left.withColumn("group", F.concat(F.lit("flags "), "p_flags"))
    kind = left.join(found.select("p_cat").distinct(), "p_cat", "left_semi").withColumn("group", F.col("p_cat"))
    sides = flagged.unionByName(kind).groupBy("group", "key", *P_CLASS).agg(F.sum("n").alias("n")).filter("n != 0")
    schema = ", ".join(f"{c} int" for c in HISTOGRAM) + ", n long"
    counts = sides.groupBy("group", "key").cogroup(right.groupBy("group", "key")).applyInArrow(_counted, schema)
    return counts.groupBy(*HISTOGRAM).agg(F.sum("n").alias("n")).filter("n != 0")


def histogram_bands(histogram: DataFrame) -> Column:
    return m.score_band(F.col("score"), F.col("low_coverage") == 1)


def all_pairs_distribution(histogram: DataFrame, min_score: int = 0) -> DataFrame:
    """Counts by kind (band, reason, warning; over all pairs) and code, and the number of pairs of at least min_score (kind candidates)."""
    state = lambda c: F.element_at(F.array(*map(F.lit, STATES)), F.col(c) + 1)
    code = lambda test, kind, name: F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("code")))
    tests = [(F.col("required") == 1, "MATCH_SKILL_REQUIRED_OVERLAP"), (F.col("preferred") == 1, "MATCH_SKILL_NICE_TO_HAVE_OVERLAP"), *((state("rate") == s, f"MATCH_RATE_{c}") for s, c in (("match", "COMPATIBLE"), ("unknown", "UNKNOWN"), ("mismatch", "MISMATCH"))), *((state(x) == s, f"MATCH_{n}_{c}") for x, n in (("date", "START"), ("place", "LOCATION")) for s, c in (("match", "COMPATIBLE"), ("unknown", "UNKNOWN"))), (F.col("role") == 1, "MATCH_ROLE_COMPATIBLE")]
    warned = [(F.col("p_bare") == 1, "MATCH_MISSING_PROJECT_SKILLS"), (F.col("q_bare") == 1, "MATCH_MISSING_PERSON_SKILLS"), (F.col("low_coverage") == 1, "MATCH_LOW_FIELD_COVERAGE"), (F.col("low_coverage") == 1, "MATCH_REVIEW_REQUIRED")]
    band = F.struct(F.lit("band").alias("kind"), histogram_bands(histogram).alias("code"))
    codes = F.array_compact(F.array(band, *(code(t, "reason", n) for t, n in tests), *(code(t, "warning", n) for t, n in warned), code(F.col("score") >= min_score, "candidates", f"{min_score}+")))
    return histogram.select("n", F.explode(codes).alias("x")).groupBy("x.kind", "x.code").agg(F.sum("n").alias("n"))
