"""Structured Streaming jobs: mail ingest, daily counts, review states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators.classify import KeywordRule, StrongRule, classify_mails
from ..operators.review import ACTIONS, FIRST_STATE


def ingest_mails(stream: DataFrame, rules: list[KeywordRule], strong: list[StrongRule], delay: str = "1 day") -> DataFrame:
    """Landed mails once each (account_id, external_id) within the watermark, classified."""
    once = stream.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["account_id", "external_id"])
    return classify_mails(once, rules, strong)


def merge_each_batch(rows: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each batch to merge(batch, number); a batch may come again with the same number after a failure."""
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def mail_counts(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Mails by day and category. In append mode a day is given once the watermark is past it, and mails that come later are dropped: late_mails names them."""
    days = stream.withWatermark("received_at", delay).groupBy(F.window("received_at", "1 day"), "category")
    return days.agg(F.count("*").alias("n_mails")).select(F.col("window.start").alias("day"), "category", "n_mails")


def late_mails(landed: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The batch job's part of the counts: the landed mails (received_at, arrival: the number of the run that took them in) that mail_counts has dropped, as their day lay behind the watermark of the runs before."""
    newest = landed.groupBy("arrival").agg(F.max("received_at").alias("newest"))
    before = newest.withColumn("mark", F.max("newest").over(Window.orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)) - F.expr(f"INTERVAL {delay}")).select("arrival", "mark")  # a row for each run
    ends = F.date_trunc("day", "received_at") + F.expr("INTERVAL 1 DAY")
    return landed.join(F.broadcast(before), "arrival").filter(ends <= F.col("mark")).drop("mark")


def next_status(status: str, action: str) -> str:
    sources, to = ACTIONS.get(action, ([], status))
    return to if status in sources else status


def review_states(events: DataFrame) -> DataFrame:
    """The state of each suggestion after every batch of its events, in order of time within a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, applied = state.get if state.exists else (FIRST_STATE, 0)
        for action in pd.concat(batches).sort_values(["ts", "event_id"])["action"]:
            to = next_status(status, action)
            applied += to != status
            status = to
        state.update((status, applied))
        yield pd.DataFrame({"suggestion_id": [key[0]], "status": [status], "n_applied": [applied]})

    return events.groupBy("suggestion_id").applyInPandasWithState(step, "suggestion_id long, status string, n_applied long", "status string, n_applied long", "update", GroupStateTimeout.NoTimeout)
