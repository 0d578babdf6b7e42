"""Saved suggestions, their audit events and review queues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Which states an action may start from, and the state it leads to (null: as before).
ACTIONS = {
    "APPROVE": (["SUGGESTED", "NEEDS_REVIEW"], "APPROVED"),
    "REJECT": (["SUGGESTED", "NEEDS_REVIEW"], "REJECTED"),
    "REQUEST_REVIEW": (["SUGGESTED", "APPROVED", "REJECTED"], "NEEDS_REVIEW"),
    "KEEP_SUGGESTED": (["NEEDS_REVIEW"], "SUGGESTED"),
    "ARCHIVE": (["SUGGESTED", "NEEDS_REVIEW", "APPROVED", "REJECTED"], "ARCHIVED"),
    "RESTORE": (["ARCHIVED"], "NEEDS_REVIEW"),
}
FIRST_STATE = "SUGGESTED"
STATES = ["SUGGESTED", "NEEDS_REVIEW", "APPROVED", "REJECTED", "ARCHIVED"]
#: Events of a suggestion that are folded at once.
CHUNK = 1000


def suggestion_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def snapshot_hash(*columns: str) -> Column:
    """Hash of what a score rests on, as JSON with null fields left out."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def initial_status(given: Column, warnings: Column, band: Column, attention: Column) -> Column:
    return F.when(given.isin("SUGGESTED", "NEEDS_REVIEW"), given).when((warnings > 0) | (band == "REVIEW") | (attention == "NEEDS_REVIEW"), "NEEDS_REVIEW").otherwise("SUGGESTED")


#: What identifies a suggestion, and what a snapshot fixes of it.
PAIR, CODES = ["project_id", "person_id", "version", "snapshot"], ["score", "band", "warnings"]


def new_suggestions(candidates: DataFrame, saved: DataFrame, version: str, once: bool = False, of_score: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """Candidates that are not among the saved ones, with suggestion_key, version, snapshot, status and the fields of their CREATED event.

    saved has suggestion_key, or PAIR, or both. once: each pair comes once among the candidates, so none is dropped as a repeat. If saved also has CODES,
    pairs are moved and compared only where a saved suggestion has the same codes, as others have another snapshot; there are at most as many codes as scores, bands and warnings.
    of_score: makes the candidates of at least a score (not null), where that costs less than to make all of them once more. Saved suggestions have few bytes on disk for each row, so they are never broadcast.
    """
    snapshot = snapshot_hash("score", "band", "reasons", "warnings")
    n_warnings = F.size(F.filter(F.split("warnings", ","), lambda w: w != ""))
    with_keys = lambda rows: rows.withColumns({"version": F.lit(version), "snapshot": snapshot, "status": initial_status(F.lit(None).cast("string"), n_warnings, F.col("band"), F.lit(""))}).withColumn("suggestion_key", suggestion_key(*map(F.col, PAIR)))
    keyed = with_keys(candidates)
    by_key, by_pair = "suggestion_key" in saved.columns, {*PAIR} <= {*saved.columns}
    apart = None
    if once and by_pair and {*CODES} <= {*saved.columns}:
        codes = saved.select(*(F.col(c).alias(f"saved_{c}") for c in CODES)).distinct()
        least, most = saved.agg(F.min("score"), F.max("score")).first()
        same = [F.col(c).eqNullSafe(F.col(f"saved_{c}")) for c in CODES]
        apart = keyed.join(F.broadcast(codes), same, "left_anti")
        if of_score is not None and least is not None:
            keyed = with_keys(of_score(least)).select(*keyed.columns)
        keyed = keyed.filter(F.col("score").isNull() | F.col("score").between(least, most)).join(F.broadcast(codes), same, "left_semi")
    fresh = keyed if once else keyed.dropDuplicates(["suggestion_key"])
    if by_key:
        fresh = fresh.join(saved.select("suggestion_key").hint("merge"), "suggestion_key", "left_anti")
    if by_pair:
        fresh = fresh.join(saved.select(*PAIR).hint("merge"), PAIR, "left_anti").select(*keyed.columns)
    fresh = fresh.select(*keyed.columns) if apart is None else apart.unionByName(fresh.select(*keyed.columns))
    return fresh.withColumns({"action": F.lit("CREATED"), "from_status": F.lit(None).cast("string"), "to_status": F.col("status")})


def save_suggestions(candidates: DataFrame, saved: DataFrame, version: str, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """New suggestions, and their CREATED events; a key, or a pair of the same version and snapshot, that is saved already or comes twice is passed over, so that a second run adds nothing. once: as in new_suggestions."""
    fresh = new_suggestions(candidates, saved, version, once)
    return fresh.select("suggestion_key", *PAIR, *CODES, "status"), fresh.select("suggestion_key", "action", "from_status", "to_status")


def next_state(state: Column, action: Column) -> Column:
    """The state after an action; an action that may not start from the state, or leads nowhere new, leaves it."""
    out = state
    for name, (sources, to) in ACTIONS.items():
        out = F.when((action == name) & state.isin(sources), F.lit(to)).otherwise(out)
    return out


def fold_review_events(events: DataFrame) -> DataFrame:
    """suggestion_id, status, n_applied (events that changed the state), n_events, reviewed_at (last change), archived_at (of archived ones), in order of ts and event_id.

    An event with an expected_status, if there is such a column, counts only in that state. Runs of CHUNK events are folded once for
    each state that they may start from, then the runs one after the other, so that no array holds all events of a suggestion.
    """
    expected = F.col("expected_status") if "expected_status" in events.columns else F.lit(None).cast("string")
    number = F.row_number().over(Window.partitionBy("suggestion_id").orderBy("ts", "event_id")) - 1
    rows = events.select("suggestion_id", "ts", "event_id", "action", expected.alias("expected")).withColumn("chunk", F.floor(number / CHUNK))
    chunks = rows.groupBy("suggestion_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "action", "expected"))).alias("events"))
    at_type = dict(events.dtypes)["ts"]

    def step(s: Column, e: Column) -> Column:
        to = F.when(F.coalesce(e["expected"] != s["status"], F.lit(False)), s["status"]).otherwise(next_state(s["status"], e["action"]))
        moved = to != s["status"]
        return F.struct(to.alias("status"), (s["n"] + moved.cast("int")).alias("n"), F.when(moved, e["ts"]).otherwise(s["at"]).alias("at"))

    start = lambda state: F.struct(F.lit(state).alias("status"), F.lit(0).alias("n"), F.lit(None).cast(at_type).alias("at"))
    ends = F.create_map(*(x for state in STATES for x in (F.lit(state), F.aggregate("events", start(state), step))))
    folded = chunks.select("suggestion_id", "chunk", F.size("events").alias("m"), ends.alias("ends")).groupBy("suggestion_id").agg(F.sum("m").cast("int").alias("n_events"), F.array_sort(F.collect_list(F.struct("chunk", F.map_entries("ends").alias("ends")))).alias("chunks"))

    def over(s: Column, c: Column) -> Column:
        end = F.element_at(F.map_from_entries(c["ends"]), s["status"])
        return F.struct(end["status"].alias("status"), (s["n"] + end["n"]).alias("n"), F.coalesce(end["at"], s["at"]).alias("at"))

    out = folded.withColumn("s", F.aggregate("chunks", start(FIRST_STATE), over))
    return out.select("suggestion_id", F.col("s.status").alias("status"), F.col("s.n").alias("n_applied"), "n_events", F.col("s.at").alias("reviewed_at"), F.when(F.col("s.status") == "ARCHIVED", F.col("s.at")).alias("archived_at"))


def list_suggestions(rows: DataFrame, sort: str = "newest", page: int = 1, size: int = 20, low: int = 0, high: int = 100, **equal: str) -> DataFrame:
    out = rows.filter(F.col("score").between(low, high))
    for column, value in equal.items():
        out = out.filter(F.col(column) == value)
    orders = {"newest": [F.desc("created_at"), "suggestion_id"], "score_asc": ["score", F.desc("created_at"), "suggestion_id"], "score_desc": [F.desc("score"), F.desc("created_at"), "suggestion_id"]}
    return out.orderBy(*orders[sort]).offset((page - 1) * size).limit(size)


def review_queue(rows: DataFrame) -> DataFrame:
    """NEEDS_REVIEW first, then SUGGESTED, then others with warnings; adds segment and position."""
    segment = F.when(F.col("status") == "NEEDS_REVIEW", 1).when(F.col("status") == "SUGGESTED", 2).when(F.col("n_warnings") > 0, 3)
    return rows.withColumn("segment", segment).filter("segment IS NOT NULL").orderBy("segment", F.desc("score"), F.desc("created_at"), "suggestion_id")


def suggestion_counts(suggestions: DataFrame, events: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """The numbers of each suggestion's events and, if given, of its pieces of evidence."""
    out = suggestions.select("suggestion_id")
    for name, rows in (("n_events", events), ("n_evidence", evidence)):
        if rows is not None:
            out = out.join(rows.groupBy("suggestion_id").agg(F.count("*").alias(name)), "suggestion_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def newest_events(events: DataFrame, most: int = 50) -> DataFrame:
    order = Window.partitionBy("suggestion_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
