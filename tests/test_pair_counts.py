"""Counts over all pairs against a plain loop over them."""

import collections
import datetime
import math
import random
import re

import pyarrow as pa
import pytest

from deskmatch.operators import matching, pair_counts


def words(text):
    return {w for w in re.sub(r"[^\w+#.]|_", " ", text.lower()).split() if len(w) >= 3}


def plain_score(p, p_skills, q, q_skills):
    """Codes and score of a pair, by the rules of the desk."""
    own = {s.lower().strip() for s in q_skills if s.strip()}
    common = lambda kind: len({s.lower().strip() for s, t in p_skills if t == kind and s.strip()} & own)
    req, pre, tech = common("REQUIRED"), common("PREFERRED"), common("USED_TECHNOLOGY")
    low, high, want = p["unit_min"] or None, p["unit_max"] or None, q["desired"] or None
    rate = "UNKNOWN" if want is None or (low is None and high is None) else "MISMATCH" if (high is not None and want > high) or (low is not None and want < math.floor(low * 0.75)) else "COMPATIBLE"
    month = lambda d: d.year * 12 + d.month if d else None
    start, free = month(p["start_month"]), month(q["available"])
    date = "UNKNOWN" if start is None or free is None else "COMPATIBLE" if free <= start + 1 else None
    pr, qr, pp, qp = (str(x or "").lower().strip() for x in (p["remote_type"], q["remote_wish"], p["place"], q["place"]))
    if any(t in pr for t in ("remote", "hybrid", "リモート")) and any(t in qr for t in ("remote", "hybrid", "リモート", "可")):
        place = "COMPATIBLE"
    elif not (pp or pr or qp or qr):
        place = "UNKNOWN"
    elif not pp or not qp:
        place = "UNKNOWN" if pr or qr else None
    else:
        place = "COMPATIBLE" if any(len(t) >= 2 and t in qp for t in re.split(r"[,\s、/／・]+", pp)) else None
    role = len(words(p["title"] or "") & words(q["summary"] or "")) >= 2
    lacking = (low is None and high is None) + (start is None) + (not pp and not pr) + (want is None) + (free is None) + (not qp and not qr) >= 3
    score = (min(35, 18 + 7 * req) if req else 0) + (min(15, 8 + 3 * pre) if pre else 0) + min(10, 3 * tech)
    score += {"COMPATIBLE": 15, "UNKNOWN": 4}.get(rate, 0) + sum({"COMPATIBLE": 10, "UNKNOWN": 3}.get(x, 0) for x in (date, place)) + 10 * role
    score -= 18 * (not p_skills) + 18 * (not q_skills) + 8 * lacking + 4 * (p["status"] == "DRAFT") + 8 * (q["status"] != "AVAILABLE")
    score = max(0, min(100, score))
    band = "REVIEW" if lacking or score < 35 else "HIGH" if score >= 75 else "MEDIUM" if score >= 55 else "LOW"
    codes = [("band", band), ("reason", f"MATCH_RATE_{rate}")]
    codes += [("reason", c) for test, c in ((req, "MATCH_SKILL_REQUIRED_OVERLAP"), (pre, "MATCH_SKILL_NICE_TO_HAVE_OVERLAP"), (date, f"MATCH_START_{date}"), (place, f"MATCH_LOCATION_{place}"), (role, "MATCH_ROLE_COMPATIBLE")) if test]
    codes += [("warning", c) for test, c in ((not p_skills, "MATCH_MISSING_PROJECT_SKILLS"), (not q_skills, "MATCH_MISSING_PERSON_SKILLS"), (lacking, "MATCH_LOW_FIELD_COVERAGE"), (lacking, "MATCH_REVIEW_REQUIRED")) if test]
    return codes, score


def tables(spark, seed, n_projects, n_persons):
    rnd = random.Random(seed)
    any_of = rnd.choice
    day = lambda: any_of([None, *(datetime.date(2024, m, 1) for m in range(1, 9))])
    price = lambda: any_of([None, 0, *range(40, 90, 5)])
    place = lambda: any_of([None, "", "東京都", "東京都 港区", "大阪府・京都府", "港区", "名古屋", "都"])
    text = lambda: " ".join(any_of(["java", "backend", "Server", "api", "web", "ab"]) for _ in range(rnd.randrange(4))) or None
    projects = [{"project_id": i, "title": text(), "unit_min": price(), "unit_max": price(), "start_month": day(), "place": place(), "remote_type": any_of([None, "FULL_REMOTE", "ONSITE", "リモート可"]), "status": any_of(["OPEN", "DRAFT", "ARCHIVED"])} for i in range(n_projects)]
    persons = [{"person_id": i, "summary": text(), "desired": price(), "available": day(), "place": place(), "remote_wish": any_of([None, "", "フルリモート", "週2可", "常駐"]), "status": any_of(["AVAILABLE", "JOINED", "ARCHIVED"])} for i in range(n_persons)]
    skill = lambda: any_of(["Java", "java ", "AWS", "SQL", "C#", " ", "PHP"])
    p_skills = [(i, skill(), any_of(["REQUIRED", "PREFERRED", "USED_TECHNOLOGY"])) for i in range(n_projects) for _ in range(rnd.randrange(5))]
    q_skills = [(i, skill()) for i in range(n_persons) for _ in range(rnd.randrange(4))]
    frames = [
        spark.createDataFrame(projects, "project_id long, title string, unit_min int, unit_max int, start_month date, place string, remote_type string, status string"), spark.createDataFrame(p_skills, "project_id long, skill_name string, skill_type string"),
        spark.createDataFrame(persons, "person_id long, summary string, desired int, available date, place string, remote_wish string, status string"), spark.createDataFrame(q_skills, "person_id long, skill_name string"),
    ]
    want, scores = collections.Counter(), []
    for p in projects:
        for q in persons:
            if "ARCHIVED" not in (p["status"], q["status"]):
                codes, score = plain_score(p, [s[1:] for s in p_skills if s[0] == p["project_id"]], q, [s[1] for s in q_skills if s[0] == q["person_id"]])
                want.update(codes)
                scores.append(score)
    return frames, want, scores


def test_counts_equal_those_of_all_pairs(spark):
    frames, want, scores = tables(spark, 1, 90, 80)
    histogram = pair_counts.pair_histogram(*frames).cache()
    assert sum(r.n for r in histogram.collect()) == len(scores) and min(r.n for r in histogram.collect()) > 0
    for least in (0, 20, 46, 70):
        got = {(r.kind, r.code): r.n for r in pair_counts.all_pairs_distribution(histogram, least).collect()}
        assert got.pop(("candidates", f"{least}+"), 0) == sum(s >= least for s in scores)
        assert got == want


def test_sides_without_rows_or_skills(spark):
    frames, want, _ = tables(spark, 2, 6, 5)
    none = [f.filter("false") for f in frames]
    assert pair_counts.pair_histogram(frames[0], frames[1], none[2], none[3]).count() == 0
    assert pair_counts.pair_histogram(*none).count() == 0
    bare = pair_counts.pair_histogram(frames[0], none[1], frames[2], none[3])
    assert {(r.p_bare, r.q_bare, r.required) for r in bare.collect()} == {(1, 1, 0)}


def test_best_matches_and_first_page_are_those_of_all_candidates(spark):
    frames, _, _ = tables(spark, 3, 120, 110)
    every = matching.match_candidates(*frames, 46).cache()
    for most in (3,):
        want = matching.top_matches(every, most, "project_id").select("project_id", "person_id", "score", "band", "rank")
        got = matching.best_matches(*frames, 46, most).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20
    for state in ("match",):
        pages = [matching.match_review(every, "review_first", 2, 5, rate_state=state), matching.review_first_page(*frames, 46, 2, 5, state)]
        got, want = ([tuple(r) for r in page.select("project_id", "person_id", "score", "attention").collect()] for page in pages)
        assert got == want and len(want) > 0


def test_rows_of_a_frequent_word_keep_it(spark):
    rows = spark.createDataFrame([(i, ["common", f"own{i}", "other"]) for i in range(20)], "id long, words array<string>")
    others = spark.createDataFrame([(["common", "other", "own3"],)], "theirs array<string>")
    for frequent in (5, 100):
        got = {r.id: r.words for r in matching.shared_words(rows, "id", "words", others, "theirs", frequent).collect()}
        assert got == {i: ["common", "other", *["own3"][: i == 3]] for i in range(20)}


def test_supply_of_a_popular_cell_joins_no_two_months(spark):
    from deskmatch.operators import market

    months = [f"{y}-{n:02d}" for y in range(2020, 2024) for n in range(1, 11)] + ["unknown"]
    at = ("java", "b", "r", "s")
    people = [(*at, month, 50 + i % 3 if i % 7 else None, 1) for i, month in enumerate(months * 2)]
    offered = spark.createDataFrame(people, "skill string, price_band string, region string, work_style string, start_month string, price int, quality long")
    wanted = spark.createDataFrame([(*at, month) for month in [*months, "2019-01"]], "skill string, price_band string, region string, work_style string, start_month string")
    out = market.cell_supply(offered, wanted)
    got = {r.start_month: (r.person_count, r.person_quality, r.person_median_price) for r in out.collect()}
    for cell in [*months, "2019-01"]:
        free = [p for p in people if "unknown" in (p[4], cell) or p[4] <= cell]
        prices = sorted(p[5] for p in free if p[5] is not None)
        median = (prices[(len(prices) - 1) // 2] + prices[len(prices) // 2]) / 2 if prices else None
        assert got[cell] == (len(free), len(free), median)
    todo, made = [out._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
        todo += [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else [node.children().apply(k) for k in range(node.children().size())]
    assert made and max(made) <= 4 * (len(months) + 1), made  # months and prices


@pytest.mark.parametrize("review_first", [False, True])
@pytest.mark.parametrize("rate_only", [None, "match"])
def test_best_of_a_group_are_those_of_all(review_first, rate_only):
    rnd = random.Random(11)
    people = [{"person_id": i, "class_points": rnd.choice([-8, 0, 10, 20]), "q_blank": rnd.randrange(2), "q_rate": rnd.choice([None, *range(30, 60)]), "q_month": rnd.choice([None, *range(100, 106)])} for i in rnd.sample(range(1000), 400)]
    wants = [{"want": f"w{i}", "p_min": rnd.choice([None, 40, 50]), "p_max": rnd.choice([None, 35, 45, 60]), "p_month": rnd.choice([None, *range(98, 106)]), "p_missing": 0, "cap": rnd.choice([45, 41]), "least": rnd.choice([0, 30, 44])} for i in range(150)]
    for w in wants:
        w["p_missing"] = (w["p_min"] is None and w["p_max"] is None) + (w["p_month"] is None)
    expected = set()
    for w in wants:
        rows = []
        for q in people:
            low, high, rate = w["p_min"], w["p_max"], q["q_rate"]
            state = "unknown" if rate is None or (low is None and high is None) else "mismatch" if (high is not None and rate > high) or (low is not None and rate < math.floor(low * 0.75)) else "match"
            date = 3 if None in (w["p_month"], q["q_month"]) else 10 if q["q_month"] <= w["p_month"] + 1 else 0
            lacking = w["p_missing"] + q["q_blank"] + (rate is None) + (q["q_month"] is None) >= 3
            points = min(q["class_points"] + {"match": 15, "unknown": 4, "mismatch": 0}[state] + date - 8 * lacking, w["cap"])
            if points >= w["least"] and rate_only in (None, state):
                rows.append((-(lacking and review_first), -points, q["person_id"], lacking))
        expected |= {(w["want"], i, -points, bool(lacking)) for _, points, i, lacking in sorted(rows)[:3]}
    ints = lambda rows, *names: pa.table({n: pa.array([r[n] for r in rows], pa.int64()) for n in names})
    left = ints(wants, "p_min", "p_max", "p_month", "p_missing", "cap", "least").append_column("want", pa.array([w["want"] for w in wants]))
    got = matching._best_of_group(left, ints(people, "person_id", "class_points", "q_blank", "q_rate", "q_month"), 3, rate_only, review_first)
    assert {tuple(r.values()) for r in got.to_pylist()} == expected and len(expected) == got.num_rows > 100


def test_projects_stand_once_for_each_set_and_not_for_each_cell_of_persons(spark):
    frames, _, _ = tables(spark, 4, 60, 90)
    met, people = matching.candidate_classes(*frames, 46)
    assert met.count() == met.select("project_id", "q_key").distinct().count() > 20
    assert people.count() == people.select("pk", "person_id").distinct().count()
    got = matching.class_pairs(met, people, 60)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, matching.match_candidates(*frames, 60).collect()))


def test_a_page_makes_its_classes_once(spark, monkeypatch):
    frames, _, _ = tables(spark, 5, 60, 60)
    made = []
    monkeypatch.setattr(matching, "candidate_classes", lambda *a, f=matching.candidate_classes: made.append(1) or f(*a))
    want = matching.match_review(matching.match_candidates(*frames, 46), "review_first", 1, 7, rate_state="match").collect()
    del made[:]
    assert matching.review_first_page(*frames, 46, 1, 7, "match").collect() == want and made == [1]
