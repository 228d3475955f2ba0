"""Roundings agree with the SQL's engine on decimals that lie half-way but are stored a little off."""

import duckdb
from barweave.functions.rounding import rounded, rounded_sql
from pyspark.sql import functions as F


def test_stored_halves_round_as_in_sql(spark):
    closes = [211.7, 209.1, 66.365, *(round(40 + k * 0.1, 1) for k in range(1200))]
    rows = [(c, f) for c in closes for f in (1.0025, 1.005, 0.9975, 1.0)]
    duck = duckdb.connect()
    df = spark.createDataFrame(rows, "c double, f double")
    for digits in (1, 2, 4):
        want = [duck.execute(f"SELECT round({c!r}::DOUBLE * {f!r}::DOUBLE, {digits})").fetchall()[0][0] for c, f in rows]
        got = df.select(rounded(F.col("c") * F.col("f"), digits).alias("a"), F.expr(rounded_sql("c * f", digits)).alias("b")).collect()
        assert [r["a"] for r in got] == want and [r["b"] for r in got] == want
    assert df.filter("c = 211.7 and f = 1.0025").select(rounded(F.col("c") * F.col("f"), 4)).first()[0] == 212.2293
