"""Source and sink queries on what the driver's tables offer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relational import first_source
from ..sources import readers
from ..sources.fixtures import table, walk_bars
from .registry import query, r6


@query("s01_load_symbol", f"SELECT dt, {r6('close')} AS close FROM bars WHERE symbol = 7")
def load_symbol(spark, sf_dir):
    return walk_bars(spark, sf_dir).filter("symbol = 7").selectExpr("dt", f"{r6('close')} AS close")


@query("s02_list_symbols", "SELECT DISTINCT symbol FROM bars")
def list_symbols(spark, sf_dir):
    return readers.symbols(walk_bars(spark, sf_dir))


@query("s03_column_pruned_read", "SELECT l_suppkey, l_quantity FROM lineitem")
def pruned(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")


@query("s04_canonical_bars", "SELECT CAST(symbol AS VARCHAR) AS symbol, dt, close FROM bars WHERE volume IS NOT NULL")
def canonical(spark, sf_dir):
    b = walk_bars(spark, sf_dir).withColumn("symbol", F.col("symbol").cast("string")).withColumn("dt", F.col("dt").cast("timestamp"))
    return readers.canonical(b.unionByName(b.filter("dt < TIMESTAMP '1996-01-01'"))).select("symbol", "dt", "close")


@query("s12_comma_numbers", "SELECT o_orderkey, o_totalprice AS v FROM orders")
def comma_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.format_number("o_totalprice", 2).alias("raw"))
    return o.select("o_orderkey", readers.number(F.col("raw")).alias("v"))


@query("s15_sheets_union", "SELECT DISTINCT n FROM (SELECT trim(s_name) AS n FROM supplier UNION ALL SELECT trim(c_name) FROM customer)")
def sheets(spark, sf_dir):
    return readers.sheets([table(spark, sf_dir, "supplier").select(F.col("s_name").alias("n")), table(spark, sf_dir, "region"), table(spark, sf_dir, "customer").select(F.col("c_name").alias("n"))], "n")


@query("s20_exclude_prefixes", "SELECT DISTINCT upper(trim(p_type)) AS symbol FROM part WHERE NOT starts_with(upper(trim(p_type)), 'ECO')")
def exclude(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.upper(F.trim("p_type")).alias("symbol")).filter(~F.col("symbol").rlike("^(ECO)")).distinct()


@query("s21_page_links", r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href="/([^"/]+)"', 1)) AS slug FROM pages""")
def page_links(spark, sf_dir):
    return readers.page_links(table(spark, sf_dir, "pages"))


@query("s25_instrument_keys", """WITH p AS (SELECT p_partkey AS token, 'E' || p_partkey % 2 AS exch, upper(p_brand) || '-EQ' AS full_, upper(p_brand) AS short, upper(p_name) AS name FROM part),
    k AS (SELECT exch, token, unnest([full_, short, name]) AS key, unnest([0, 1, 2]) AS form FROM p)
    SELECT exch AS exch_seg, key, token FROM k QUALIFY row_number() OVER (PARTITION BY exch, key ORDER BY form, token) = 1""")  # fmt: skip
def instrument_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = p.select(F.concat(F.lit("E"), F.col("p_partkey") % 2).alias("exch_seg"), F.col("p_partkey").alias("token"), F.concat("p_brand", F.lit("-EQ")).alias("symbol"), F.col("p_name").alias("name"), F.col("p_partkey").alias("line"))
    return readers.instruments(raw, "line")


@query("s26_provider_chain", """WITH s AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS p FROM orders)
    SELECT o_custkey, o_orderkey FROM (SELECT *, min(p) OVER (PARTITION BY o_custkey) AS m FROM s) WHERE p = m""")  # fmt: skip
def provider_chain(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return first_source([o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus not in ('F', 'O')")], "o_custkey").select("o_custkey", "o_orderkey")


@query("s28_date_chunks", "SELECT o_orderkey, CAST(g AS DATE) AS lo, least(CAST(g AS DATE) + 29, CAST(o_orderdate AS DATE) + 70) AS hi FROM (SELECT o_orderkey, o_orderdate, unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 70, INTERVAL 30 DAY)) AS g FROM orders)")
def date_chunks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return o.select("o_orderkey", F.explode(readers.date_chunks(F.col("d"), F.date_add("d", 70), 30)).alias("c")).select("o_orderkey", "c.lo", "c.hi")


@query("s31_market_cap", f"SELECT s_suppkey, {r6('coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal * 1e6 END, s_suppkey * 1e5 * 25) / 1e7')} AS cap FROM supplier")
def market_cap(spark, sf_dir):
    direct = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal") * 1e6)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(readers.market_cap(direct, F.col("s_suppkey") * 1e5, F.lit(25)) + 1e-9, 6).alias("cap"))


@query("s35_ticker_forms", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'X' || s_suppkey || '.BO' ELSE 'X' || s_suppkey || '.NS' END AS full_, 'X' || s_suppkey AS bare FROM supplier")
def ticker_forms(spark, sf_dir):
    raw = F.concat(F.lit("X"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, ".BO").otherwise(""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", readers.to_suffixed(raw).alias("full_"), readers.from_suffixed(raw).alias("bare"))


@query("k06_watchlist_tickers", "SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'BSE:X' ELSE 'NSE:X' END || s_suppkey AS value FROM supplier")
def watchlist(spark, sf_dir):
    t = ticker_forms(spark, sf_dir)
    return t.select(F.concat(F.when(F.col("full_").endswith(".BO"), "BSE:").otherwise("NSE:"), F.col("bare")).alias("value")).distinct()


@query("t04_weekly_window", "SELECT CAST(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-03') AS TIMESTAMP) AS week_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def weekly_window(spark, sf_dir):
    """The streaming aggregate on the events as a batch: both run the same plan."""
    from ..streaming.bars import weekly_totals

    return weekly_totals(table(spark, sf_dir, "events")).select(F.col("week_start").cast("timestamp_ntz").alias("week_start"), "event_type", "n")
