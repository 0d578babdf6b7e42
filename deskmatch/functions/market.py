"""Normal forms of skills, places, work styles, prices, contracts and months."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

#: White space as texts of the desk have it: ASCII, no-break and ideographic.
BLANKS = "[\\s 　﻿]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"^{BLANKS}+|{BLANKS}+$", "")


def has_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def first_of(text: Column, table: dict[str, list[str]], otherwise: Column) -> Column:
    """The first key of which a word occurs in text."""
    out = otherwise
    for key, words in reversed(table.items()):
        out = F.when(has_any(text, words), F.lit(key)).otherwise(out)
    return out


def skill_name(c: Column) -> Column:
    raw = trimmed(c)
    key = F.regexp_replace(F.regexp_replace(F.lower(raw), "[＿_－—–-]", ""), f"{BLANKS}+", " ")
    alias = F.create_map(*(F.lit(x) for pair in rules.SKILL_ALIASES.items() for x in pair))
    return F.when(raw == "", rules.UNKNOWN).otherwise(F.coalesce(F.element_at(alias, key), raw))


def skill_type(c: Column) -> Column:
    t = F.upper(trimmed(c))
    return F.when(t.isin(rules.SKILL_TYPES), t).otherwise("OTHER")


def region(*places: Column) -> Column:
    """Of the first place that has a known one."""
    found = [first_of(F.coalesce(p, F.lit("")), rules.REGIONS, F.lit(None)) for p in places]
    return F.coalesce(*found, F.lit(rules.UNKNOWN))


def work_style(remote_type: Column | None, text: Column) -> Column:
    named = first_of(F.lower(F.coalesce(text, F.lit(""))), rules.WORK_STYLE_WORDS, F.lit("UNKNOWN"))
    if remote_type is None:
        return named
    direct = F.upper(trimmed(remote_type))
    return F.when(direct.isin([s for s in rules.WORK_STYLES if s != "UNKNOWN"]), direct).otherwise(named)


def positive(c: Column) -> Column:
    return F.when((c > 0) & ~F.isnan(c.cast("double")), c)


def price_band(price: Column) -> Column:
    """The first band that holds the price: the lowest one takes its upper bound too."""
    low = F.floor(price / 5) * 5
    between = F.concat_ws("_", low.cast("string"), (low + 5).cast("string"))
    return F.when(price.isNull() | ~(price > 0) | F.isnan(price.cast("double")), rules.UNKNOWN).when(price <= 30, "under_30").when(price >= 120, "120_over").otherwise(between)


def band_order(band: Column) -> Column:
    return F.array_position(F.array(*(F.lit(k) for k, *_ in rules.PRICE_BANDS)), band)


def project_price(upper_max: Column, upper_min: Column, unit_max: Column, unit_min: Column) -> Column:
    return F.coalesce(*map(positive, (upper_max, upper_min, unit_max, unit_min)))


def contract_type(c: Column) -> Column:
    text = trimmed(c)
    named = first_of(F.lower(text), rules.CONTRACT_WORDS, F.lit("OTHER"))
    return F.when(F.upper(text).isin(rules.CONTRACT_TYPES), F.upper(text)).when(text == "", "UNKNOWN").otherwise(named)


def month_key(c: Column) -> Column:
    """yyyy-MM of a date, or of texts such as 2026-7, 2026/07, 2026年7月 and 202607."""
    text = trimmed(c.cast("string"))
    parted = r"^(\d{4})[-/年](\d{1,2})"
    return F.when(text.rlike(parted), F.concat_ws("-", F.regexp_extract(text, parted, 1), F.lpad(F.regexp_extract(text, parted, 2), 2, "0"))).when(text.rlike(r"^\d{6}\z"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2))).otherwise(rules.UNKNOWN)


def head_count(c: Column) -> Column:
    return F.when(c > 0, F.floor(c)).otherwise(1).cast("long")


def quality_count(issues: Column, needs_review: Column) -> Column:
    return (F.greatest(F.coalesce(issues, F.lit(0)), F.lit(0)) + F.coalesce(needs_review, F.lit(False)).cast("int")).cast("long")
