"""Deep pages against offset and limit, and checks of typed-in values."""

import random

from pyspark.sql import functions as F

from deskmatch.operators import imports, lists


def test_deep_pages_equal_offset_and_limit(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([None, *range(4), 100, -5]), rnd.choice([None, "a", "b", "B", "é"])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, n int, s string").cache()
    for order in ([("n", True), ("s", False), ("id", False)], [("s", True), ("n", False), ("id", True)], [("id", False)]):
        by = [F.desc(c) if d else F.asc(c) for c, d in order]
        whole = [r.id for r in df.orderBy(*by).collect()]
        for page, size in ((1, 10), (17, 30), (70, 10), (3, 250), (99, 20)):
            got = lists.deep_page(df, order, page, size, cuts=5, most=40).orderBy("place_no").collect()
            pages = -(-700 // size)
            at = min(page, pages)
            assert [r.id for r in got] == whole[(at - 1) * size : at * size], (order, page, size)
            assert {(r.page, r.pages) for r in got} == {(at, pages)} and [r.place_no for r in got] == list(range((at - 1) * size + 1, (at - 1) * size + 1 + len(got)))
    assert lists.deep_page(df.filter("false"), [("id", False)], 3, 10).count() == 0


def test_inputs(spark):
    rows = [(1, " 1,234.9 ", "2026-07", "2024-02-29", "a@b.c", "A、B/A", "募集中", None, "週3日出社"), (2, "x", "2026-7", "2024-02-30", "a b@c.d", None, "?", "常駐", None), (3, None, " ", "", None, ",,", " ", "何か", "リモート")]
    df = spark.createDataFrame(rows, "id int, price_text string, month_text string, date_text string, email string, list_text string, status_text string, remote_text string, remote_note string")
    got = {r.id: r for r in imports.validate_entity_input(df, {"募集中": "OPEN"}).collect()}
    assert (got[1].price_value, str(got[1].month_value), str(got[1].date_value), got[1].list_value, got[1].status_value, got[1].remote_value, got[1].errors) == (1234, "2026-07-01", "2024-02-29", ["A", "B"], "OPEN", "HYBRID", [])
    assert got[2].errors == ["PRICE", "MONTH", "DATE", "EMAIL", "STATUS"] and got[2].remote_value == "ONSITE"
    assert got[3].errors == ["REMOTE"] and got[3].list_value == [] and got[3].status_value is None
