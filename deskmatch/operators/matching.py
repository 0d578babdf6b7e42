"""Project and person matching: compatibilities, scores, candidates, distributions and review pages.

A pair without a common skill scores 45 at most (rate 15, date 10, place 10, role 10), so for a least score
over 45 only pairs with a common skill count; lower ones need every pair and are not offered here as a join
of all with all. Pairs are found by classes:

1. Projects and persons are reduced to the distinct sets of their skills. The points of a common set are
   worked out once for each two sets that share a skill, and sets with too few points for the least score go.
2. Persons of one set, place, remote wish, status and role words form a cell. Place, role and status points of a
   project and a cell are worked out once, and cells go that rate and date can't lift to the least score.
3. Only then do the projects meet the persons of the cells that are left, with rate and date in the join.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written

#: The best score of a pair without a common skill, the best of rate and date, and words of remote work.
NO_SKILL_BEST, RATE_AND_DATE_BEST = 45, 25
#: Fixed value: the least score of the best band.
HIGH_SCORE = 75
FRIENDLY_PROJECT = ["remote", "full_remote", "hybrid", "リモート"]
FRIENDLY_PERSON = ["remote", "full_remote", "hybrid", "リモート", "可"]


@functools.cache
def _nfkc():
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return nfkc


def nfkc(c: Column) -> Column:
    """Unicode NFKC, for which there is no built-in function; the helper is made when first used, as it needs a session."""
    return _nfkc()(c)


def plain(c: Column) -> Column:
    """NFKC. All rows pass by the helper, but ASCII texts, which it would leave as they are, go there as nulls."""
    return F.coalesce(nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def skill_key(c: Column) -> Column:
    """Lower-case letters, digits and + # . alone."""
    return F.regexp_replace(F.lower(plain(c)), r"[^\p{L}\p{N}+#.]+", "")


def role_tokens(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(plain(c)), r"[^\p{L}\p{N}+#.]+", " "), " +")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3)))


def month_number(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def match_projects(projects: DataFrame) -> DataFrame:
    """What scoring needs of a project (project_id, title, unit_min, unit_max, start_month, place, remote_type, status)."""
    place = F.lower(F.trim(plain(F.coalesce("place", F.lit("")))))
    return projects.select("project_id", F.when(F.col("unit_min") != 0, F.col("unit_min")).alias("p_min"), F.when(F.col("unit_max") != 0, F.col("unit_max")).alias("p_max"), month_number(F.col("start_month")).alias("p_month"), place.alias("p_place"), F.lower(F.trim(plain(F.coalesce("remote_type", F.lit(""))))).alias("p_remote"), F.col("status").alias("p_status"), role_tokens(F.col("title")).alias("p_role"))


def match_persons(persons: DataFrame) -> DataFrame:
    return persons.select("person_id", F.when(F.col("desired") != 0, F.col("desired")).alias("q_rate"), month_number(F.col("available")).alias("q_month"), F.lower(F.trim(plain(F.coalesce("place", F.lit(""))))).alias("q_place"), F.lower(F.trim(plain(F.coalesce("remote_wish", F.lit(""))))).alias("q_remote"), F.col("status").alias("q_status"), role_tokens(F.col("summary")).alias("q_role"))


def rate_state(match="match", unknown="unknown", mismatch="mismatch") -> Column:
    """The state, or what is given for each."""
    desired, low, high = F.col("q_rate"), F.col("p_min"), F.col("p_max")
    return F.when(desired.isNull() | (low.isNull() & high.isNull()), unknown).when(desired > high, mismatch).when(desired < F.floor(low * 0.75), mismatch).otherwise(match)


def date_state(match="match", unknown="unknown", mismatch="mismatch") -> Column:
    start, free = F.col("p_month"), F.col("q_month")
    return F.when(start.isNull() | free.isNull(), unknown).when(free <= start + 1, match).otherwise(mismatch)


def place_state() -> Column:
    friendly = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    pp, pr, qp, qr = (F.col(c) for c in ("p_place", "p_remote", "q_place", "q_remote"))
    tokens = F.filter(F.split(pp, r"[,\s　、/／・]+"), lambda t: F.length(t) >= 2)
    return (
        F.when(friendly(pr, FRIENDLY_PROJECT) & friendly(qr, FRIENDLY_PERSON), "match")
        .when(F.concat(pp, pr, qp, qr) == "", "unknown")
        .when((pp == "") | (qp == ""), F.when(F.concat(pr, qr) != "", "unknown").otherwise("mismatch"))
        .when(F.exists(tokens, lambda t: F.contains(qp, t)), "match")
        .otherwise("mismatch")
    )


def points(state: Column, match: int, unknown: int) -> Column:
    return F.when(state == "match", match).when(state == "unknown", unknown).otherwise(0)


def score_band(score: Column, review: Column) -> Column:
    return F.when(review | (score < 35), "REVIEW").when(score >= HIGH_SCORE, "HIGH").when(score >= 55, "MEDIUM").otherwise("LOW")


def keyed_skills(skills: DataFrame) -> DataFrame:
    """The rows with k, the key of skill_name: each spelling is normalised once and joined back; rows without a key go."""
    names = skills.select("skill_name").distinct().withColumn("k", skill_key(F.col("skill_name"))).filter("k != ''")
    return skills.join(names, "skill_name")


def project_sets(skills: DataFrame) -> DataFrame:
    """project_id and set: the sorted skills (k, and whether required, preferred or of another type)."""
    kind = F.upper(F.coalesce("skill_type", F.lit("OTHER")))
    typed = keyed_skills(skills).select("project_id", "k", kind.alias("t"))
    flag = lambda test: F.max(test.cast("int"))
    own = typed.groupBy("project_id", "k").agg(flag(F.col("t") == "REQUIRED").alias("req"), flag(F.col("t") == "PREFERRED").alias("pre"), flag(~F.col("t").isin("REQUIRED", "PREFERRED")).alias("oth"))
    return own.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("k", "req", "pre", "oth"))).alias("p_set"))  # no more than there are keys


def person_sets(skills: DataFrame) -> DataFrame:
    return keyed_skills(skills).groupBy("person_id").agg(F.sort_array(F.collect_set("k")).alias("q_set"))


def skill_points() -> Column:
    some = lambda n, most, base, each: F.when(F.col(n) > 0, F.least(F.lit(most), base + each * F.col(n))).otherwise(0)
    return some("n_required", 35, 18, 7) + some("n_preferred", 15, 8, 3) + some("n_technology", 10, 0, 3)


def set_overlaps(p_sets: DataFrame, q_sets: DataFrame) -> DataFrame:
    """p_key, q_key and the common skills of distinct sets: required, preferred, other (types) and distinct over all."""
    left = p_sets.dropDuplicates(["p_key"]).select("p_key", F.explode("p_set").alias("x")).select("p_key", "x.*")
    right = q_sets.dropDuplicates(["q_key"]).select("q_key", F.explode("q_set").alias("k"))
    return left.join(right, "k").groupBy("p_key", "q_key").agg(F.sum("req").alias("n_required"), F.sum("pre").alias("n_preferred"), F.sum("oth").alias("n_technology"), F.count("*").alias("n_skills"))


#: A word that more rows have is looked up by a broadcast; there are at most as many of them as words of all rows divided by this.
FREQUENT = 1_000_000


def shared_words(rows: DataFrame, key: str, words: str, others: DataFrame, other_words: str, frequent: int = FREQUENT) -> DataFrame:
    """The rows with only those of their words that any of the others has; fewer than two can't make a match and become none. Rows of a frequent word don't meet in one task."""
    known = others.select(F.explode(other_words).alias("w")).distinct()
    each = rows.select(key, F.explode(words).alias("w"))
    common = written(each.groupBy("w").agg(F.count("*").alias("n")).join(known, "w"), "words")
    often, rest = common.filter(F.col("n") > frequent).select("w"), common.filter(F.col("n") <= frequent).select("w")
    met = each.join(F.broadcast(often), "w").unionByName(each.join(F.broadcast(often), "w", "left_anti").join(rest.hint("merge"), "w"))
    kept = met.groupBy(key).agg(F.sort_array(F.collect_set("w")).alias("_kept"))
    none = F.array().cast("array<string>")
    return rows.join(kept.hint("merge"), key, "left").withColumn(words, F.when(F.size("_kept") >= 2, F.col("_kept")).otherwise(none)).drop("_kept")


def low_coverage() -> Column:
    tests = (F.col("p_min").isNull() & F.col("p_max").isNull(), F.col("p_month").isNull(), (F.col("p_place") == "") & (F.col("p_remote") == ""), F.col("q_rate").isNull(), F.col("q_month").isNull(), (F.col("q_place") == "") & (F.col("q_remote") == ""))
    return sum((t.cast("int") for t in tests), F.lit(0)) >= 3


def role_match() -> Column:
    return F.size(F.array_intersect("p_role", "q_role")) >= 2


def class_points() -> Column:
    """Points that a project and a cell of persons fix: place, role and both states."""
    return points(F.col("place_state"), 10, 3) + 10 * F.col("role_match").cast("int") - F.when(F.col("p_status") == "DRAFT", 4).otherwise(0) - F.when(F.col("q_status") != "AVAILABLE", 8).otherwise(0)


def pair_points() -> Column:
    """Points that rate and date add, less those for missing fields."""
    return points(rate_state(), 15, 4) + points(date_state(), 10, 3) - 8 * low_coverage().cast("int")


RATE_STATES = DATE_STATES = PLACE_STATES = ("match", "unknown", "mismatch")


@functools.cache
def _reasons() -> tuple[str, ...]:
    """The reasons (codes joined by ',') of each combination of required, preferred, rate, date, place and role, the last one fastest."""
    out = []
    for required, preferred, rate, date, place, role in itertools.product((0, 1), (0, 1), RATE_STATES, DATE_STATES, PLACE_STATES, (0, 1)):
        tests = [(required, "MATCH_SKILL_REQUIRED_OVERLAP"), (preferred, "MATCH_SKILL_NICE_TO_HAVE_OVERLAP"), *((rate == s, f"MATCH_RATE_{c}") for s, c in (("match", "COMPATIBLE"), ("unknown", "UNKNOWN"), ("mismatch", "MISMATCH"))), *((x == s, f"MATCH_{n}_{c}") for x, n in ((date, "START"), (place, "LOCATION")) for s, c in (("match", "COMPATIBLE"), ("unknown", "UNKNOWN"))), (role, "MATCH_ROLE_COMPATIBLE")]
        out.append(",".join(code for test, code in tests if test))
    return tuple(out)


def scored(pairs: DataFrame) -> DataFrame:
    """Adds score, band, warnings and reasons (codes joined by ',') to pairs that have their states and skill counts."""
    total = skill_points() + class_points() + pair_points()
    staged = pairs.withColumns({"rate_state": rate_state(), "date_state": date_state(), "low_coverage": low_coverage(), "score": F.least(F.greatest(total, F.lit(0)), F.lit(100)).cast("int")})
    return with_codes(staged)


def with_codes(staged: DataFrame) -> DataFrame:
    """Adds band, reasons and warnings to pairs that have a score, low_coverage, states and skill counts."""
    at = lambda c: F.when(F.col(c) == "match", 0).when(F.col(c) == "unknown", 1).otherwise(2)
    some = lambda c: F.when(F.col(c), 1).otherwise(0)
    place = F.lit(0)
    for n, c in ((2, some_of("n_required")), (2, some_of("n_preferred")), (3, at("rate_state")), (3, at("date_state")), (3, at("place_state")), (2, some("role_match"))):
        place = place * n + c
    reasons = F.element_at(F.array(*map(F.lit, _reasons())), place + 1)
    return staged.withColumns({"band": score_band(F.col("score"), F.col("low_coverage")), "reasons": reasons, "warnings": F.when(F.col("low_coverage"), "MATCH_LOW_FIELD_COVERAGE,MATCH_REVIEW_REQUIRED").otherwise("")})


def some_of(c: str) -> Column:
    return F.when(F.col(c) > 0, 1).otherwise(0)


RESULT = ["project_id", "person_id", "score", "band", "n_required", "n_preferred", "n_technology", "n_skills", "rate_state", "date_state", "place_state", "role_match", "reasons", "warnings"]
#: Projects' rows of candidate_classes for each block of a join with persons, which stand once for each block.
BLOCK_ROWS = 4_000_000
#: What place, role and a person's status can add up to.
CLASS_POINTS = sorted({place + role - away for place in (0, 3, 10) for role in (0, 10) for away in (0, 8)})


def candidate_classes(projects: DataFrame, project_skills: DataFrame, persons: DataFrame, person_skills: DataFrame, min_score: int) -> tuple[DataFrame, DataFrame]:
    """Projects with each set of skills (q_key) that may lead to min_score, with their kind (pk) and own points (skills, less those of a draft), and persons with their q_key for each pk, with the points that place, role and status give. Both are written."""
    if min_score <= NO_SKILL_BEST:
        raise ValueError(f"min_score has to be over {NO_SKILL_BEST}: pairs without a common skill may have less")
    p = match_projects(projects.filter("status != 'ARCHIVED'"))
    q = match_persons(persons.filter("status != 'ARCHIVED'")).join(person_sets(person_skills).hint("merge"), "person_id")
    p, q = shared_words(p, "project_id", "p_role", q, "q_role"), shared_words(q, "person_id", "q_role", p, "p_role")
    # Of remote work only counts whether it is friendly and whether it is given.
    remote = lambda c, words: F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col(c), w)), words[0]).when(F.col(c) == "", "").otherwise("-")
    p, q = p.withColumn("p_remote", remote("p_remote", FRIENDLY_PROJECT)), q.withColumn("q_remote", remote("q_remote", FRIENDLY_PERSON))
    p_kind, q_kind = ["p_place", "p_remote", "p_role"], ["q_place", "q_remote", "q_role"]
    p, q = written(p, "projects"), written(q, "persons")
    numbered = lambda rows, columns, name: written(rows.select(*columns).distinct().withColumn(name, F.monotonically_increasing_id()), name)
    p_kinds, q_kinds, sets = numbered(p, p_kind, "pk"), numbered(q, q_kind, "qk"), numbered(q, ["q_set"], "q_key")
    blank = lambda s: ((F.col(f"{s}_place") == "") & (F.col(f"{s}_remote") == "")).cast("int")
    kinds = p_kinds.crossJoin(q_kinds).withColumns({"place_state": place_state(), "role_match": role_match(), "q_blank": blank("q")})
    given = points(F.col("place_state"), 10, 3) + 10 * F.col("role_match").cast("int")
    kinds = kinds.select("pk", *q_kind, "place_state", "role_match", "q_blank", given.alias("given"))
    people = q.join(kinds, q_kind).join(sets, "q_set")
    people = people.select("pk", "q_key", "person_id", "q_rate", "q_month", "q_blank", "place_state", "role_match", (F.col("given") - F.when(F.col("q_status") != "AVAILABLE", 8).otherwise(0)).alias("class_points"))
    own = project_sets(project_skills).select("project_id", F.explode("p_set").alias("x")).select("project_id", "x.*")
    common = own.join(sets.select("q_key", F.explode("q_set").alias("k")), "k").groupBy("project_id", "q_key").agg(F.sum("req").alias("n_required"), F.sum("pre").alias("n_preferred"), F.sum("oth").alias("n_technology"), F.count("*").alias("n_skills"))
    enough = common.filter(skill_points() >= min_score - NO_SKILL_BEST)
    missing = (F.col("p_min").isNull() & F.col("p_max").isNull()).cast("int") + F.col("p_month").isNull().cast("int") + blank("p")
    met = p.join(p_kinds, p_kind).select("project_id", "pk", "p_min", "p_max", "p_month", "p_status", missing.alias("p_missing")).join(enough.hint("merge"), "project_id")
    met = met.withColumn("own_points", (skill_points() - F.when(F.col("p_status") == "DRAFT", 4).otherwise(0)).cast("int")).drop("p_status")
    return written(met, "classes"), written(people, "people")


def class_pairs(met: DataFrame, people: DataFrame, min_score: int) -> DataFrame:
    """RESULT of all pairs of at least min_score of the rows of candidate_classes (of that score or a lower one)."""
    session = met.sparkSession
    blocks = -(-met.count() // BLOCK_ROWS) or 1
    parts = max(blocks * 256, session.sparkContext.defaultParallelism)
    keys = ["pk", "q_key", "class_points", "block"]
    # A part's bytes don't tell how many pairs it makes, so its number of parts is given. Persons stand once for each block of projects.
    worth = F.filter(F.array(*map(F.lit, CLASS_POINTS)), lambda c: F.col("own_points") + c >= min_score - RATE_AND_DATE_BEST)
    left = met.select("*", F.explode(worth).alias("class_points"), F.pmod(F.xxhash64("project_id"), F.lit(blocks)).cast("int").alias("block")).repartition(parts, *keys)
    right = people.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(parts, *keys)
    low = F.col("p_missing") + F.col("q_blank") + F.col("q_rate").isNull().cast("int") + F.col("q_month").isNull().cast("int") >= 3
    total = F.col("own_points") + F.col("class_points") + rate_state(15, 4, 0) + date_state(10, 3, 0) - F.when(low, 8).otherwise(0)
    pairs = left.join(right.hint("merge"), keys).filter(total >= min_score)
    return with_codes(pairs.withColumns({"rate_state": rate_state(), "date_state": date_state(), "low_coverage": low, "score": F.least(F.greatest(total, F.lit(0)), F.lit(100)).cast("int")})).select(*RESULT)


def match_candidates(projects: DataFrame, project_skills: DataFrame, persons: DataFrame, person_skills: DataFrame, min_score: int) -> DataFrame:
    """All pairs of at least min_score, which is over NO_SKILL_BEST, among rows that are not archived."""
    return class_pairs(*candidate_classes(projects, project_skills, persons, person_skills, min_score), min_score)


NONE = np.iinfo(np.int64).max


def first_of_each(numbers: np.ndarray, ids: np.ndarray, size: int, most: int) -> np.ndarray:
    """Of each number below size the first so many ids, a row each; NONE where there are fewer. Rows are in order of number and id."""
    rank = np.arange(len(numbers)) - np.searchsorted(numbers, numbers)
    out = np.full((size, most), NONE)
    out[numbers[rank < most], rank[rank < most]] = ids[rank < most]
    return out


def _merged(*parts: np.ndarray) -> np.ndarray:
    """Of arrays of first ids (in the last axis) the first ids of all, each once."""
    out = np.sort(np.concatenate(parts, axis=-1), axis=-1)
    again = np.zeros(out.shape, bool)
    again[..., 1:] = out[..., 1:] == out[..., :-1]
    out[again] = NONE
    return np.sort(out, axis=-1)[..., : parts[0].shape[-1]]


class _Ranges:
    """First ids of each class within ranges of places, from first ids (class, place, most): those of runs of 1, 2, 4, ... places are worked out once."""

    def __init__(self, first: np.ndarray):
        self.runs, n = [first], first.shape[1]
        while 2 ** len(self.runs) <= n:
            last, step = self.runs[-1], 2 ** (len(self.runs) - 1)
            self.runs.append(_merged(last[:, :-step], last[:, step:]))
        self.none = np.full((first.shape[0], first.shape[2]), NONE)

    def within(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each range (from start to before end) the first ids by class."""
        out = np.broadcast_to(self.none, (len(start), *self.none.shape)).copy()
        length = np.maximum(end - start, 0)
        level = np.frexp(length)[1] - 1  # -1 for none
        for k in np.unique(level[level >= 0]):
            at = np.flatnonzero(level == k)
            run = self.runs[k].swapaxes(0, 1)
            out[at] = _merged(run[start[at]], run[end[at] - 2**k])
        return out


#: Wants that are looked up at once.
WANTS = 2048


def _best_of_group(wants: pa.Table, people: pa.Table, most: int, rate_only: str | None, review_first: bool) -> pa.Table:
    """For each of the wants of one kind and set the best persons: by low coverage (if review_first), points up to the want's cap, and id; only those of a rate state, if it is given."""
    number = lambda t, c: t.column(c).to_numpy(zero_copy_only=False).astype(np.float64)  # noqa: E731  null: nan
    whole = lambda t, c: t.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
    ids, rate, month = whole(people, "person_id"), number(people, "q_rate"), number(people, "q_month")
    classes, of = np.unique(np.column_stack([whole(people, "class_points"), whole(people, "q_blank")]), axis=0, return_inverse=True)
    rates = np.unique(rate[~np.isnan(rate)])
    known = len(rates)
    cell = of.ravel() * (known + 1) + np.where(np.isnan(rate), known, np.searchsorted(rates, rate))
    order = np.lexsort((ids, cell))
    ids, month, cell = ids[order], month[order], cell[order]
    low, high, until = number(wants, "p_min"), number(wants, "p_max"), number(wants, "p_month") + 1
    missing, cap, least = whole(wants, "p_missing"), whole(wants, "cap"), whole(wants, "least")
    names = wants.column("want").to_numpy(zero_copy_only=False)
    bound = ~(np.isnan(low) & np.isnan(high))
    to_rate = np.where(np.isnan(high), known, np.searchsorted(rates, high, "right"))
    from_rate = np.minimum(np.where(np.isnan(low), 0, np.searchsorted(rates, np.floor(low * 0.75), "left")), to_rate)

    def firsts(mask: np.ndarray) -> tuple[_Ranges, np.ndarray]:
        """First ids of persons of a mask by ranges of known rates, and of those without a rate."""
        first = first_of_each(cell[mask], ids[mask], len(classes) * (known + 1), most).reshape(len(classes), known + 1, most)
        return _Ranges(first[:, :known]), first[:, known]

    found: list[tuple] = []
    undated = firsts(np.isnan(month))

    def look_up(at: np.ndarray, dates: list) -> None:
        """The best persons of wants of one month. dates: points, whether the month is unknown, and first ids, for each state of date."""
        n, zero, a, b = len(at), np.zeros(len(at), np.int64), from_rate[at], to_rate[at]
        columns: list[tuple] = []
        for date_points, no_date, (ranges, unrated) in dates:
            inside, whole_range = ranges.within(a, b), ranges.within(zero, zero + known)
            outside = _merged(ranges.within(zero, a), ranges.within(b, zero + known))
            nothing = np.full_like(inside, NONE)
            is_bound = bound[at][:, None, None]
            for state, rate_points, no_rate, first in (("match", 15, 0, np.where(is_bound, inside, nothing)), ("mismatch", 0, 0, np.where(is_bound, outside, nothing)), ("unknown", 4, 0, np.where(is_bound, nothing, whole_range)), ("unknown", 4, 1, np.broadcast_to(unrated, inside.shape))):
                if rate_only in (None, state):
                    lacking = missing[at][:, None] + classes[:, 1] + no_rate + no_date >= 3
                    points = np.minimum(classes[:, 0] + rate_points + date_points - 8 * lacking, cap[at][:, None])
                    columns.append(tuple(np.broadcast_to(x, first.shape).reshape(n, -1) for x in (first, points[:, :, None], lacking[:, :, None])))
        first, points, lacking = (np.concatenate(c, axis=1) for c in zip(*columns))
        level = np.where((first == NONE) | (points < least[at][:, None]), NONE, -(points + 1000 * (lacking & review_first)))
        best = np.lexsort((first, level), axis=1)[:, :most]
        pick = lambda x: np.take_along_axis(x, best, axis=1)
        kept = pick(level) != NONE
        found.append((np.broadcast_to(names[at][:, None], best.shape)[kept], pick(first)[kept], pick(points)[kept], pick(lacking)[kept]))

    for want_month in np.unique(until):  # nan: one value, for wants without a month
        dated = not np.isnan(want_month)
        dates = [(10, 0, firsts(month <= want_month)), (0, 0, firsts(month > want_month))] if dated else [(3, 0, firsts(~np.isnan(month)))]
        own = np.flatnonzero(until == want_month if dated else np.isnan(until))
        for i in range(0, len(own), WANTS):
            look_up(own[i : i + WANTS], [*dates, (3, 1, undated)])
    want, person, points, lacking = (np.concatenate(c) if found else [] for c in (list(zip(*found)) or [[]] * 4))
    return pa.table({"want": pa.array(want, pa.string()), "person_id": pa.array(person, pa.int64()), "points": pa.array(points, pa.int32()), "low": pa.array(lacking, pa.bool_())})


def best_matches(projects: DataFrame, project_skills: DataFrame, persons: DataFrame, person_skills: DataFrame, min_score: int, most: int, rate_only: str | None = None, review_first: bool = False) -> DataFrame:
    """Of each project the best candidates (project_id, person_id, score, band, low, rank), by score and person; review_first: those to be reviewed before others; rate_only: those of a rate state.

    No pairs are listed for that. Persons of one set, kind, points, rate and month score alike, so only the first ones of each count. Projects
    want of a set what their kind, bounds, month and missing fields say; the best persons are found once for each different want.
    """
    return best_of_classes(*candidate_classes(projects, project_skills, persons, person_skills, min_score), min_score, most, rate_only, review_first)


def best_of_classes(met: DataFrame, people: DataFrame, min_score: int, most: int, rate_only: str | None = None, review_first: bool = False) -> DataFrame:
    """best_matches of the rows of candidate_classes."""
    most_points = CLASS_POINTS[-1] + RATE_AND_DATE_BEST
    said = ["p_min", "p_max", "p_month", "p_missing", "cap"]
    wants = met.withColumn("cap", F.least(F.lit(most_points), 100 - F.col("own_points")).cast("int")).filter(F.col("own_points") + most_points >= min_score)
    wants = wants.withColumn("want", F.concat_ws("|", "pk", "q_key", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in said))).select("project_id", "pk", "q_key", "own_points", *said, "want")
    each = wants.groupBy("pk", "q_key", "want", *said).agg((min_score - F.max("own_points")).alias("least"))
    own = Window.partitionBy("pk", "q_key", "class_points", "q_blank", "q_rate", "q_month").orderBy("person_id")
    first = people.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= most).select("pk", "q_key", "class_points", "q_blank", "q_rate", "q_month", "person_id")
    parts = max(256, met.sparkSession.sparkContext.defaultParallelism)  # a group's bytes don't tell its work
    best = each.repartition(parts, "pk", "q_key").groupBy("pk", "q_key").cogroup(first.repartition(parts, "pk", "q_key").groupBy("pk", "q_key")).applyInArrow(lambda a, b: _best_of_group(a, b, most, rate_only, review_first), "want string, person_id long, points int, low boolean")
    score = F.least(F.greatest(F.col("own_points") + F.col("points"), F.lit(0)), F.lit(100)).cast("int")
    found = wants.select("project_id", "want", "own_points").join(best.hint("merge"), "want").withColumn("score", score).filter(F.col("score") >= min_score)
    order = Window.partitionBy("project_id").orderBy(*([F.desc("low")] if review_first else []), F.desc("score"), "person_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select("project_id", "person_id", "score", score_band(F.col("score"), F.col("low")).alias("band"), "low", "rank")


def review_first_page(projects: DataFrame, project_skills: DataFrame, persons: DataFrame, person_skills: DataFrame, min_score: int, page: int, size: int, rate_state: str) -> DataFrame:
    """match_review of all candidates of a rate state in the order review_first. Up to a page's end there are rows of at most as many projects, which are the first by their own best row."""
    met, people = candidate_classes(projects, project_skills, persons, person_skills, min_score)
    best = best_of_classes(met, people, min_score, 1, rate_state, True)
    first = best.orderBy(F.desc("low"), F.desc("score"), "project_id").limit(page * size).select("project_id")
    first = written(first, "page")
    picked = met.join(F.broadcast(first), "project_id", "left_semi")  # a page's rows at most
    return match_review(class_pairs(picked, people, min_score), "review_first", page, size, rate_state=rate_state)


def top_matches(candidates: DataFrame, most: int, key: str | None = None) -> DataFrame:
    """The best candidates over all, or for each project or person (key)."""
    order = [F.desc("score"), "project_id", "person_id"]
    if key is None:
        return candidates.orderBy(*order).limit(most)
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= most)


def match_distribution(candidates: DataFrame) -> DataFrame:
    """Counts by kind (band, reason, warning) and code."""
    found = F.array(F.struct(F.lit("band").alias("kind"), F.col("band").alias("code")))
    of = lambda kind, c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("code")))
    return candidates.select(F.explode(F.concat(found, of("reason", F.col("reasons")), of("warning", F.col("warnings")))).alias("x")).groupBy("x.kind", "x.code").agg(F.count("*").alias("n"))


def attention(candidates: DataFrame) -> DataFrame:
    state = F.when(F.col("warnings").contains("MATCH_REVIEW_REQUIRED") | (F.col("band") == "REVIEW"), "NEEDS_REVIEW").when(F.col("band") == "HIGH", "HIGH_SCORE").when(F.col("warnings") != "", "WARNING").otherwise("STANDARD")
    return candidates.withColumn("attention", state)


def review_rows(candidates: DataFrame, overlap: bool | None = None, **states: str) -> DataFrame:
    """Candidates with their attention, filtered by column values and by whether a required or preferred skill is common; match_distribution of them is that of a filtered page."""
    out = attention(candidates)
    for column, value in states.items():
        out = out.filter(F.col(column) == value)
    return out if overlap is None else out.filter((F.col("n_required") + F.col("n_preferred") > 0) == overlap)


def match_review(candidates: DataFrame, sort: str = "score_desc", page: int = 1, size: int = 20, overlap: bool | None = None, **states: str) -> DataFrame:
    """A page of review_rows in one of four orders: score_desc, score_asc, review_first, newest."""
    out = review_rows(candidates, overlap, **states)
    ids = ["project_id", "person_id"]
    orders = {"score_desc": [F.desc("score"), *ids], "score_asc": ["score", *ids], "review_first": [F.desc(F.col("attention") == "NEEDS_REVIEW"), F.desc("score"), *ids], "newest": [F.desc("project_id"), F.desc("person_id")]}
    return out.orderBy(*orders[sort]).offset((page - 1) * size).limit(size)
