"""Job tables derived from the given tables, in DataFrames and in the SQL that oracles build on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import dealt_out  # noqa: F401

#: Spellings of skills by brand number, 1 to 25.
SPELLINGS = ["JAVA", "Java", "java", "js", "JS", "JavaScript", "ts", "TypeScript", "aws", "AWS", "Amazon Web Services", "React.js", "reactjs", "React", "python", "PYTHON", "php", "PHP", "Go", "SQL", "Linux", "C#", "Terraform", "", " Kotlin "]
CONTRACTS = {"AUTOMOBILE": "準委任", "BUILDING": "派遣", "FURNITURE": "請負", "HOUSEHOLD": "業務委託"}
PLACES = ["東京都", "大阪府", "名古屋市", "福岡県", "札幌市"]
REMOTE_TYPES = {"1-URGENT": "FULL_REMOTE", "2-HIGH": "HYBRID", "5-LOW": "ONSITE"}
REMOTE_WISHES = ["フルリモート希望", "リモート可", "週2出社", "常駐可"]
PERSON_OFFSETS = (1, 3, 7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choice(index, values: list[str]):
    """The value at a place counted from 0, or null."""
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def lookup(c, values: dict[str, str], otherwise):
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in values.items() for x in p)), c), otherwise)


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")


def projects(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = orders.join(customers, "c_custkey").join(nations(spark, sf_dir), "c_nationkey")
    rows = dealt_out(rows, like=orders) if spread else rows
    k, high = F.col("o_orderkey"), F.floor(F.col("o_totalprice") / 4000).cast("int")
    month = F.add_months(F.trunc("o_orderdate", "month"), (k % 3).cast("int"))
    style = F.when(F.col("o_orderpriority") == "3-MEDIUM", F.when(k % 2 == 0, "リモート可").otherwise("常駐"))
    return rows.select(
        k.alias("project_id"),
        F.concat_ws(" ", F.lit("order"), k.cast("string"), F.col("o_orderpriority")).alias("title"),
        F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "P", "DRAFT").otherwise("ARCHIVED").alias("status"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_focus"),
        high.alias("unit_max"),
        F.when(k % 3 != 0, F.floor(high * 8 / 10).cast("int")).alias("unit_min"),
        F.when(k % 5 == 0, high + 5).alias("upper_max"),
        (k % 5).cast("int").alias("recruiting"),
        choice(F.col("n_regionkey"), PLACES).alias("place"),
        lookup(F.col("o_orderpriority"), REMOTE_TYPES, F.lit("UNKNOWN")).alias("remote_type"),
        style.alias("style_text"),
        lookup(F.col("c_mktsegment"), CONTRACTS, F.lit("")).alias("contract"),
        F.when(k % 11 != 0, month).alias("start_month"),
        F.col("o_orderdate").alias("created_at"),
        (k % 7 == 0).alias("needs_review"),
        (k % 4 - 1).cast("int").alias("issues"),
    )


def project_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("brand"))
    kind = F.when(F.col("l_returnflag") == "A", "REQUIRED").when(F.col("l_returnflag") == "N", "PREFERRED").otherwise("USED_TECHNOLOGY")
    return table(spark, sf_dir, "lineitem").join(parts, "l_partkey").select(F.col("l_orderkey").alias("project_id"), choice(F.pmod(F.col("brand") - 1, F.lit(25)), SPELLINGS).alias("skill_name"), kind.alias("skill_type"))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(nations(spark, sf_dir), "c_nationkey")
    k = F.col("c_custkey")
    return rows.select(
        k.alias("person_id"),
        F.concat(F.lit("customer "), F.col("c_mktsegment"), F.lit(" order "), (k % 6).cast("string")).alias("summary"),
        F.floor(F.col("c_acctbal") / 90).cast("int").alias("desired"),
        F.when(k % 13 != 0, F.add_months(F.lit("1995-01-01").cast("date"), (k % 84).cast("int"))).alias("available"),
        choice(F.col("n_regionkey"), PLACES).alias("place"),
        choice(k % 5, REMOTE_WISHES).alias("remote_wish"),
        F.when(k % 10 == 0, "ARCHIVED").when(k % 10 == 1, "JOINED").otherwise("AVAILABLE").alias("status"),
        F.date_add(F.lit("1995-01-01").cast("date"), (k % 2400).cast("int")).cast("timestamp").alias("created_at"),
        (k % 9 == 0).alias("needs_review"),
    )


def person_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    offset = F.explode(F.array(*map(F.lit, PERSON_OFFSETS)))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), offset.alias("k"))
    return rows.select("person_id", choice(F.col("person_id") * F.col("k") % 25, SPELLINGS).alias("skill_name"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _case(column: str, values: dict[str, str], otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {otherwise} END"


#: CTEs of the same tables.
SQL = f"""
projects AS (
  SELECT o_orderkey AS project_id, concat_ws(' ', 'order', o_orderkey::VARCHAR, o_orderpriority) AS title,
    CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'DRAFT' ELSE 'ARCHIVED' END AS status,
    o_orderpriority = '1-URGENT' AS is_focus, floor(o_totalprice / 4000)::INT AS unit_max,
    CASE WHEN o_orderkey % 3 <> 0 THEN floor(floor(o_totalprice / 4000) * 8 / 10)::INT END AS unit_min,
    CASE WHEN o_orderkey % 5 = 0 THEN floor(o_totalprice / 4000)::INT + 5 END AS upper_max, (o_orderkey % 5)::INT AS recruiting,
    {_list(PLACES)}[n_regionkey + 1] AS place, {_case("o_orderpriority", REMOTE_TYPES, "'UNKNOWN'")} AS remote_type,
    CASE WHEN o_orderpriority = '3-MEDIUM' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'リモート可' ELSE '常駐' END END AS style_text,
    {_case("c_mktsegment", CONTRACTS, "''")} AS contract,
    CASE WHEN o_orderkey % 11 <> 0 THEN (date_trunc('month', o_orderdate) + to_months((o_orderkey % 3)::INT))::DATE END AS start_month,
    o_orderdate AS created_at, o_orderkey % 7 = 0 AS needs_review, (o_orderkey % 4 - 1)::INT AS issues
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
project_skills AS (
  SELECT l_orderkey AS project_id, {_list(SPELLINGS)}[(regexp_extract(p_brand, '(\\d+)$', 1)::INT + 24) % 25 + 1] AS skill_name,
    CASE l_returnflag WHEN 'A' THEN 'REQUIRED' WHEN 'N' THEN 'PREFERRED' ELSE 'USED_TECHNOLOGY' END AS skill_type
  FROM lineitem JOIN part ON l_partkey = p_partkey),
persons AS (
  SELECT c_custkey AS person_id, 'customer ' || c_mktsegment || ' order ' || (c_custkey % 6)::VARCHAR AS summary, floor(c_acctbal / 90)::INT AS desired,
    CASE WHEN c_custkey % 13 <> 0 THEN (DATE '1995-01-01' + to_months((c_custkey % 84)::INT))::DATE END AS available,
    {_list(PLACES)}[n_regionkey + 1] AS place, {_list(REMOTE_WISHES)}[c_custkey % 5 + 1] AS remote_wish,
    CASE c_custkey % 10 WHEN 0 THEN 'ARCHIVED' WHEN 1 THEN 'JOINED' ELSE 'AVAILABLE' END AS status,
    (DATE '1995-01-01' + to_days((c_custkey % 2400)::INT))::TIMESTAMP AS created_at, c_custkey % 9 = 0 AS needs_review
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
person_skills AS (
  SELECT c_custkey AS person_id, {_list(SPELLINGS)}[c_custkey * k % 25 + 1] AS skill_name FROM customer, (SELECT unnest({list(PERSON_OFFSETS)}) AS k))
"""
