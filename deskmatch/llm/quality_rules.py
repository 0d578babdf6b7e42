"""Quality rules of documents and of their hosts.

Each text is measured: words, characters, symbols, repeated lines, words in repeated windows. A
document fails a rule by these measures alone; the failures are added up by host, each host's rate is
shrunk towards the rate of all hosts by a beta prior whose two parameters come from the hosts' own
rates (moments), and a host whose shrunk rate is over HOST_LIMIT is turned down with all its documents.
Verdicts come back by a join on the host; a host with a third of all rows meets in map-side sums, and its
rows are spread over parts in the join.

Defined cases: null texts have no words; an empty text fails; documents with a null host are judged by
their own rules alone; repeated rows each get their row and each count for the host; a null id stays
null; an empty table gives an empty result; other columns are ignored whatever their names; long texts
are measured whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, spread_join, sums
from .words import distinct

#: Blanks between words, and symbols.
BLANKS = [32, *range(9, 14)]
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 0.30
#: A document also fails if it has so many symbols a word, or repeated lines among its lines.
MOST_SYMBOLS, MOST_DUP_LINES = 0.10, 0.30
#: Shrunk failure rate from which a host is turned down; bounds of the prior's weight in documents.
HOST_LIMIT, WEIGHTS = 0.5, (2.0, 1000.0)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def is_in(values: list[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[values] = True
    return table


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of all texts of a chunk."""
    blank = is_in(BLANKS)[data]
    edge = np.ones(len(data) + 1, bool)
    edge[:-1] = blank
    before = np.concatenate([[True], blank])[: len(data)]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = np.flatnonzero(~blank & before)
    stops = np.zeros(len(data) + 1, bool)
    stops[1:] = ~blank  # position after a word's byte
    last = np.concatenate([blank, [True]])
    last[offsets] = True
    ends = np.flatnonzero(stops & last)
    of = np.searchsorted(begins, offsets)
    letters = (data & 0xC0) != 0x80
    out = {"n_words": np.diff(of), "word_chars": sums(letters & ~blank, offsets), "n_symbols": sums(is_in([ord(c) for c in SYMBOLS])[data], offsets)}
    raw, dup, lines = data.tobytes(), [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        found = [x for x in raw[a:b].split(b"\n") if x.strip()]
        lines.append(len(found))
        dup.append(len(found) - len(set(found)))
    out["n_dup_lines"], out["n_lines"] = np.array(dup, np.int64), np.array(lines, np.int64)
    number, words = distinct(data, begins, ends)
    out["n_repeat_words"] = sums(repeated(number, of), of)
    return out


def repeated(number: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which words stand in a window of WINDOW words that occurs again in their text. Windows are numbered exactly, by pairing numbers of half windows."""
    marked = np.zeros(len(number), bool)
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    grams, size = number, 1
    while size < WINDOW:
        if len(grams) <= size:
            return marked
        grams = pd.factorize(grams[:-size] * (grams.max() + 1) + grams[size:])[0].astype(np.int64)
        size *= 2
    starts = np.flatnonzero(text[: len(grams)] == text[WINDOW - 1 :])
    codes = pd.factorize(grams[starts] * len(of) + text[starts])[0]
    again = starts[np.bincount(codes)[codes] > 1] if len(codes) else starts
    count = np.zeros(len(number) + 1, np.int64)
    np.add.at(count, again, 1)
    np.add.at(count, again + WINDOW, -1)
    return np.cumsum(count[:-1]) > 0


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """id, host and the measures of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                found = measure(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("host"), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], names=["id", "host", *MEASURES])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(host_column).cast("string").alias("host"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, host string" + "".join(f", {m} long" for m in MEASURES))


def host_verdicts(judged: DataFrame) -> DataFrame:
    """host, host_rate (shrunk failure rate) of rows with host and failed."""
    hosts = judged.filter("host is not null").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("failed").cast("double")).alias("f"))
    mean = F.sum("f") / F.sum("n")
    prior = hosts.agg(mean.alias("m"), F.sum("n").alias("all_n"), F.count("*").alias("hosts"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("squares"))
    # Between-host variance: what the rates spread beyond what chance gives them.
    spread = F.greatest((F.col("squares") - F.col("all_n") * F.col("m") * F.col("m") - F.col("hosts") * F.col("m") * (1 - F.col("m"))) / F.col("all_n"), F.lit(0.0))
    weight = F.when(spread * WEIGHTS[1] > F.col("m") * (1 - F.col("m")), F.greatest(F.col("m") * (1 - F.col("m")) / spread - 1, F.lit(WEIGHTS[0]))).otherwise(F.lit(WEIGHTS[1]))
    prior = prior.select("m", weight.alias("weight"))
    return hosts.join(F.broadcast(prior)).select("host", ((F.col("f") + F.col("m") * F.col("weight")) / (F.col("n") + F.col("weight"))).alias("host_rate"))  # prior: one row


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """Per row: id, host, measures, base_failed, failed, host_rate and kept."""
    n = F.col("n_words")
    base = (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * n)
    more = (100 * F.col("n_symbols") > int(100 * MOST_SYMBOLS) * n) | (100 * F.col("n_dup_lines") > int(100 * MOST_DUP_LINES) * F.col("n_lines"))
    judged = cut(measures(docs, id_column, text_column, host_column).withColumn("base_failed", base).withColumn("failed", base | more), "measures")
    verdicts = host_verdicts(judged)
    out = spread_join(judged, verdicts, "host", F.col("id")).withColumn("kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= HOST_LIMIT))
    return out.withColumnRenamed("id", id_column)


#: The same verdicts in SQL, for tables small enough to take texts apart there.
SQL = f"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS p, words FROM w WHERE len(words) >= {WINDOW}),
k AS (SELECT doc_id, p, list_slice(words, p, p + {WINDOW} - 1) AS gram FROM g),
r AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM k),
x AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + {WINDOW})) AS q FROM r WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, host, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda v: length(v))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(x.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN x USING (doc_id)),
j AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines AS more FROM m),
h AS (SELECT host, count(*)::DOUBLE AS n, sum((base_failed OR more)::INT)::DOUBLE AS f FROM j WHERE host IS NOT NULL GROUP BY host),
a AS (SELECT sum(f) / sum(n) AS m, sum(n) AS all_n, count(*) AS hosts, sum(f * f / n) AS squares FROM h),
s AS (SELECT m, greatest((squares - all_n * m * m - hosts * m * (1 - m)) / all_n, 0) AS spread FROM a),
p AS (SELECT m, CASE WHEN spread * {WEIGHTS[1]} > m * (1 - m) THEN greatest(m * (1 - m) / spread - 1, {WEIGHTS[0]}) ELSE {WEIGHTS[1]} END AS weight FROM s),
v AS (SELECT host, (f + m * weight) / (n + weight) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(rate, 0) <= {HOST_LIMIT} AS kept
FROM j LEFT JOIN v USING (host)
"""
