"""Inventories, quality reports and checks on what leaves the library."""

from __future__ import annotations

import json
import math
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_subject
from ..sources.tables import written

#: Patterns that no report may show.
SENSITIVE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"https?://", r"(?i)(bearer\s+[a-z0-9._-]+|(postgres(ql)?|mysql|sqlserver)://|(secret|password|token|api_?key)\s*[:=])", r"[A-Za-z]:\\|/(home|users|var)/", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"]


#: Fixed value: codes that put a mail at high risk.
RISKY_CODES = "LOW_CONFIDENCE|SUBJECT_ONLY|CONFLICT|OVER_EXTRACTION|MISSING|DUPLICATE|EXISTING_ENTITY|REJECTED"


def mail_stats(mails: DataFrame, since: str, links: DataFrame | None = None) -> DataFrame:
    """Long table (metric, key, n) of totals, (category, state) counts and, if given, links of mails to entities by type (entity_type, link_type), with the first and last time received."""
    state = F.concat_ws(":", "category", F.when(F.col("is_excluded"), "excluded").otherwise("open"))
    kind = lambda metric, key, one: F.struct(F.lit(metric).alias("metric"), key.alias("key"), F.coalesce(one, F.lit(0)).cast("long").alias("one"))
    kinds = F.array(kind("total", F.lit(""), F.lit(1)), kind("since", F.lit(""), (F.col("received_at") >= F.to_timestamp(F.lit(since))).cast("int")), kind("category", state, F.lit(1)))
    counts = mails.select(F.explode(kinds).alias("k")).groupBy("k.metric", "k.key").agg(F.sum("k.one").alias("n"))
    if links is not None:
        linked = links.groupBy(F.concat_ws(":", "entity_type", "link_type").alias("key")).agg(F.count("*").alias("n"))
        counts = counts.unionByName(linked.select(F.lit("link").alias("metric"), "key", "n"))
    span = mails.agg(F.min("received_at").alias("first_received"), F.max("received_at").alias("last_received"))
    return counts.join(F.broadcast(span))  # span: one row


def subject_key(c: Column) -> Column:
    return F.lower(clean_subject(c, ""))


def sender_subject_groups(mails: DataFrame, most: int) -> DataFrame:
    groups = mails.groupBy("from_email", subject_key(F.col("subject")).alias("subject_key")).agg(F.count("*").alias("n_mails"))
    return groups.filter("n_mails > 1").orderBy(F.desc("n_mails"), "from_email", "subject_key").limit(most)


def classification_audit(mails: DataFrame, most: int = 50) -> DataFrame:
    """The largest groups of subjects (cut to 120 characters): count, distinct sender domains, newest."""
    pattern = F.substring(subject_key(F.col("subject")), 1, 120)
    domain = F.lower(F.substring_index("from_email", "@", -1))
    return mails.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n_mails"), F.count_distinct(domain).alias("n_domains"), F.max("received_at").alias("newest")).orderBy(F.desc("n_mails"), "pattern").limit(most)


#: Categories of mails that are left to a person.
LEFT_OVER = ["OTHER", "NEEDS_REVIEW", "NORMAL_CONTACT"]


def classification_changes(mails: DataFrame, again: DataFrame, senders: int = 30) -> DataFrame:
    """Long table (metric, key, n, newest) of what a classification left and what another run would do.

    mails: mail_id, category, is_excluded, from_email, received_at; again: mail_id, category of a new run. Metrics: category (with
    its state), change (old>new, of mails not excluded), and sender (the senders with most mails left to a person).
    """
    both = mails.join(again.select("mail_id", F.col("category").alias("_new")), "mail_id", "left")
    row = lambda metric, key: F.struct(F.lit(metric).alias("metric"), key.alias("key"))
    kinds = [row("category", F.concat_ws(":", "category", F.when(F.col("is_excluded"), "excluded").otherwise("open"))), F.when(~F.col("is_excluded"), row("change", F.concat_ws(">", "category", F.coalesce("_new", F.lit("none")))))]
    counts = both.select("received_at", F.explode(F.array_compact(F.array(*kinds))).alias("x")).groupBy("x.metric", "x.key").agg(F.count("*").alias("n"), F.max("received_at").alias("newest"))
    left = mails.filter(F.col("category").isin(LEFT_OVER) & ~F.col("is_excluded")).groupBy(F.lit("sender").alias("metric"), F.lower("from_email").alias("key")).agg(F.count("*").alias("n"), F.max("received_at").alias("newest"))
    return counts.unionByName(left.orderBy(F.desc("n"), "key").limit(senders))


def bucket(score: Column, bounds: list[int]) -> Column:
    """Label of the range a count falls in, e.g. bounds 0, 2, 5, 9: 0, 1-2, 3-5, 6-9, 10+."""
    out, low = F.lit(f"{bounds[-1] + 1}+"), None
    for low, high in reversed(list(zip([None, *bounds], bounds))):
        label = str(high) if low is None or low + 1 == high else f"{low + 1}-{high}"
        out = F.when(score <= high, label).otherwise(out)
    return out


def score_bucket(score: Column) -> Column:
    return bucket(score, [0, 2, 5, 9])


def skill_bucket(count: Column) -> Column:
    return bucket(count, [0, 3, 6, 10, 15])


def counters(rows: DataFrame, **values: Column) -> DataFrame:
    """Counts of the values of several columns, as one long table (metric, key, n)."""
    each = F.array(*(F.struct(F.lit(name).alias("metric"), value.cast("string").alias("key")) for name, value in values.items()))
    return rows.select(F.explode(each).alias("x")).groupBy("x.metric", "x.key").agg(F.count("*").alias("n"))


def is_high_risk(predicted: Column, needs_review: Column, subject_only: Column, codes: Column) -> Column:
    return needs_review | predicted.isin("other", "excluded") | subject_only | F.exists(codes, lambda c: c.rlike(RISKY_CODES))


def confusion_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per label of both sides: counts and precision, recall and F1 (1 where nothing is to divide by), and the overall accuracy; four decimals."""
    pairs = rows.groupBy(F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")).agg(F.count("*").alias("n"))
    side = lambda label, hit, said, real: F.struct(label.alias("label"), hit.alias("hit"), said.alias("said"), real.alias("real"))
    none, n = F.lit(0).cast("long"), F.col("n")
    both = F.array(side(F.col("t"), F.when(F.col("t") == F.col("p"), n).otherwise(none), none, n), side(F.col("p"), none, n, none))
    long = pairs.select(F.explode(both).alias("x")).select("x.*")
    by = long.groupBy("label").agg(F.sum("hit").alias("hits"), F.sum("said").alias("predicted"), F.sum("real").alias("actual"))
    total = pairs.agg(F.round(F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("accuracy"))
    share = lambda a, c: F.when(c == 0, F.lit(1.0)).otherwise(a / c)
    p, r = share(F.col("hits"), F.col("predicted")), share(F.col("hits"), F.col("actual"))
    return by.join(F.broadcast(total)).select("label", "hits", "predicted", "actual", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 4).alias("f1"), "accuracy")


def source_inventory(mails: DataFrame, links: DataFrame, results: DataFrame, entities: DataFrame) -> DataFrame:
    """Counts by kind: mails by category, provider and exclusion, links by type, results by target and review status, entities by type and state, with and without a mail and made from mails; mails with links, results, entities; links and results without a mail."""
    of = lambda rows, metric, key: rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), "key", "n")
    one = lambda rows, metric: rows.agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "n")
    ids = mails.select("mail_id")
    sources = entities.select(F.col("source_mail_id").alias("mail_id")).filter("mail_id IS NOT NULL")
    with_ = lambda rows: ids.join(rows.select("mail_id").distinct(), "mail_id", "left_semi")
    orphans = lambda rows: rows.join(ids, "mail_id", "left_anti")
    counts = [
        of(mails, "mail_category", F.col("category")), of(mails, "mail_provider", F.col("provider")), of(results, "result_review", F.col("review_status")), of(mails, "mail_excluded", F.col("is_excluded").cast("string")), of(links, "link_type", F.col("link_type")), of(results, "result_target", F.col("target")),
        of(entities, "entity_type", F.concat_ws(":", "entity_type", "status")), of(entities, "entity_source", F.when(F.col("source_mail_id").isNull(), "without_mail").otherwise("with_mail")), of(entities.filter(F.col("code").startswith("GMAIL-")), "mail_derived", F.col("entity_type")),
        one(with_(links), "mails_with_links"), one(with_(results), "mails_with_results"), one(with_(sources), "mails_with_entities"), one(orphans(links), "orphan_links"), one(orphans(results), "orphan_results"),
    ]
    return reduce(DataFrame.unionByName, counts)


def relationship_sample(mails: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """The newest mails with the number and the types of their links."""
    newest = mails.select("mail_id", "received_at").orderBy(F.desc("received_at"), F.desc("mail_id")).limit(most)
    own = links.join(F.broadcast(newest.select("mail_id")), "mail_id").groupBy("mail_id").agg(F.count("*").alias("n_links"), F.array_join(F.array_sort(F.collect_set("link_type")), ",").alias("link_types"))  # most rows
    return newest.join(own, "mail_id", "left").select("mail_id", "received_at", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("link_types", F.lit("")).alias("link_types"))


def sync_run_summary(steps: DataFrame) -> DataFrame:
    """Counters of a run summed over its steps, newest run first."""
    names = ["fetched", "created", "updated", "skipped", "failed"]
    return steps.groupBy("run_id").agg(F.max("at").alias("at"), *(F.sum(n).alias(n) for n in names)).orderBy(F.desc("at"), "run_id")


def sensitive_rows(rows: DataFrame) -> DataFrame:
    """Rows of which a text matches a pattern that no report may show."""
    texts = [F.col(c) for c, kind in rows.dtypes if kind == "string"]
    if not texts:
        return rows.filter("false")
    return rows.filter(F.exists(F.array(*texts), lambda x: F.coalesce(x.rlike("|".join(f"(?:{p})" for p in SENSITIVE)), F.lit(False))))


#: Keys and texts that a report's JSON may show, keys that it may not, and its limits.
SAFE_KEY = r"^[A-Za-z][A-Za-z0-9_:-]{0,63}$"
HIDDEN_KEY = r"(?i)(body|company|customer|email|file|mail|name|normalized|path|payload|person|raw|secret|subject|text|token|url|value)"
SAFE_TEXT = r"^(?:[A-Z0-9_:-]{2,96}|[a-z][a-z0-9_:-]{1,96})$"
DEEPEST, MOST_ITEMS = 4, 20


def safe_json(value, depth: int = 0):
    """A JSON value without keys that may not be shown, unsafe texts masked, deep parts masked, lists cut."""
    if depth > DEEPEST:
        return "[redacted]"
    if isinstance(value, dict):
        return {k: safe_json(v, depth + 1) for k, v in value.items() if re.search(SAFE_KEY, k) and not re.search(HIDDEN_KEY, k)}
    if isinstance(value, list):
        return [safe_json(v, depth + 1) for v in value[:MOST_ITEMS]]
    if isinstance(value, str):
        return value if re.search(SAFE_TEXT, value) and not any(re.search(p, value) for p in SENSITIVE) else "[redacted]"
    return None if isinstance(value, float) and not math.isfinite(value) else value


def sanitized_json(c: Column) -> Column:
    """safe_json of JSON texts of any shape, for which built-in functions have no form; broken JSON gives null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(safe_json(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return texts.map(one)

    return clean(c)


def scored_risk() -> Column:
    return is_high_risk(F.col("predicted_type"), F.col("needs_review"), F.col("subject_only"), F.array_union("warnings", F.coalesce("review_reasons", F.array().cast("array<string>"))))


def quality_audit(scored: DataFrame) -> DataFrame:
    """Counter maps and the summary of scored mails as one long table (metric, key, n), from one pass over the rows.

    Columns: predicted_type, project_score, person_score, excluded_score, margin, n_skills, subject_only, body_derived,
    quality_review, needs_review, warnings (array), review_reasons (array); for persons' mails name_source, name_confidence,
    name_rejected, role_source (else null); company_source, company_confidence; linked and same_sender_subject (booleans).
    """
    rows = written(scored.select(*AUDIT_COLUMNS), "audit")
    score = lambda c: score_bucket(F.col(c))
    skip = F.col("linked") | F.col("same_sender_subject") | F.col("predicted_type").isin("other", "excluded")
    single = {c: F.col(c) for c in ("predicted_type", "subject_only", "body_derived", "quality_review", "needs_review", "name_source", "name_confidence", "role_source", "company_source", "company_confidence", "linked", "same_sender_subject")}
    single |= {c: score(c) for c in ("project_score", "person_score", "excluded_score", "margin")} | {"skills": skill_bucket(F.col("n_skills")), "rejected_name": F.when(F.col("name_rejected"), F.col("name_source"))}
    single |= {"outcome": F.when(skip, "would_skip").when(F.col("needs_review") | F.col("quality_review"), "would_create_for_review").otherwise("would_create"), "high_risk": scored_risk() | F.col("linked") | F.col("same_sender_subject")}
    pair = lambda metric, key: F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"))
    many = [F.transform("warnings", lambda x: pair("warning", x)), F.transform("review_reasons", lambda x: pair("reason", x))]
    found = F.filter(F.concat(F.array(*(pair(m, c) for m, c in single.items())), *many), lambda x: x["key"].isNotNull())
    return rows.select(F.explode(found).alias("x")).groupBy("x.metric", "x.key").agg(F.count("*").alias("n"))


AUDIT_COLUMNS = ["predicted_type", "project_score", "person_score", "excluded_score", "margin", "n_skills", "subject_only", "body_derived", "quality_review", "needs_review", "warnings", "review_reasons", "name_source", "name_confidence", "name_rejected", "role_source", "company_source", "company_confidence", "linked", "same_sender_subject"]


def high_risk_sample(scored: DataFrame, most: int = 20) -> DataFrame:
    """The first mails at high risk. What the test reads is written first: it would be worked out again in each of the filter's terms."""
    rows = written(scored.select("mail_id", "predicted_type", "needs_review", "subject_only", "warnings", "review_reasons"), "scored")
    return rows.filter(scored_risk()).select("mail_id", "predicted_type", F.array_join("warnings", ",").alias("warnings")).orderBy("mail_id").limit(most)


def short_id(c: Column, length: int = 8) -> Column:
    return F.substring(c.cast("string"), 1, length)


def short_hash(c: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)
