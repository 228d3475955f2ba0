"""Queries that write files in their real format and read them back: caches, listings, settings, sheets, logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import learn
from ..operators.groups import rotation
from ..operators.relational import first_source
from ..sources import readers, sinks, storage
from ..sources.fixtures import fundamentals, table, walk_bars
from .groups import _INDEX, _index, _out
from .registry import ORACLES, query, r6
from .windows import _BENCH_SQL, benchmark


def stored(df, name: str):
    """``df`` written as Parquet and read back."""
    path = storage.scratch(df.sparkSession, name)
    sinks.snapshot(df, path)
    return df.sparkSession.read.parquet(path)


def as_text(df, name: str) -> str:
    """The single value of ``df`` as a text file; its path."""
    path = storage.scratch(df.sparkSession, name)
    df.coalesce(1).write.text(path)
    return path


@query("s05_benchmark_load", f"WITH {_BENCH_SQL} SELECT dt, {r6('bench')} AS bench FROM b WHERE dt >= DATE '1996-01-01'")
def benchmark_load(spark, sf_dir):
    return stored(benchmark(walk_bars(spark, sf_dir)), "benchmark").filter("dt >= DATE '1996-01-01'").selectExpr("dt", f"{r6('bench')} AS bench")


@query("s06_fundamentals_load", "SELECT s_suppkey AS symbol, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS market_cap FROM supplier WHERE s_nationkey % 6 = 1")
def fundamentals_load(spark, sf_dir):
    return stored(fundamentals(spark, sf_dir), "fundamentals").filter("sector = 'S1'").select("symbol", "market_cap")


@query("s07_group_index_load", f"WITH {_INDEX} SELECT grp, dt, {r6('level')} AS level FROM idx WHERE grp IN ('G1', 'G3')")
def group_index_load(spark, sf_dir):
    path = storage.scratch(spark, "group_index")
    storage.save_group_index(_index(spark, sf_dir)[2], path)
    return storage.load_group_index(spark, path, ["G1", "G3"]).selectExpr("grp", "dt", f"{r6('level')} AS level")


def theme_file(spark, sf_dir, keep: str) -> str:
    """A JSON map of groups; even ones are objects with constituents, odd ones plain lists; names need trimming."""
    s = table(spark, sf_dir, "supplier").filter(keep).groupBy("s_nationkey").agg(F.to_json(F.collect_list(F.concat(F.lit(" x"), F.col("s_suppkey")))).alias("l"))
    body = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit('{"description": "d", "constituents": '), "l", F.lit("}"))).otherwise(F.col("l"))
    one = s.select(F.concat(F.lit('"T'), F.col("s_nationkey"), F.lit('": '), body).alias("e")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list("e"), ", "), F.lit("}")).alias("value"))
    return as_text(one, "themes")


_THEMES = "SELECT DISTINCT 'T' || s_nationkey AS theme, 'X' || s_suppkey AS symbol FROM supplier"


@query("s08_theme_json", _THEMES)
def theme_json(spark, sf_dir):
    return readers.themes(spark, theme_file(spark, sf_dir, "true"))


@query("s09_seed_json", f"{_THEMES} WHERE s_nationkey < 5")
def seed_json(spark, sf_dir):
    return readers.themes(spark, theme_file(spark, sf_dir, "s_nationkey < 5"))


SETTINGS = """# settings
scan:
  stride_days: 1
  thresholds: [0.15, 0.22]  # watch, trigger
  regime:
    enabled: true
    name: 'bench > 200'
model:
  eta: 0.05
  monotone: null
"""


_FIXED_SETTINGS = "('scan.stride_days', '1'), ('scan.thresholds', '[0.15, 0.22]'), ('scan.regime.enabled', 'true'), ('scan.regime.name', '\"bench > 200\"'), ('model.eta', '0.05'), ('model.monotone', 'null')"


@query("s10_typed_config", f"""SELECT * FROM (VALUES {_FIXED_SETTINGS}) v(key, value)
    UNION ALL SELECT 'nation_' || n_nationkey || '.name', '"' || n_name || '"' FROM nation UNION ALL SELECT 'nation_' || n_nationkey || '.region', CAST(n_regionkey AS VARCHAR) FROM nation
    UNION ALL SELECT 'nation_' || n_nationkey || '.scan.even', CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END FROM nation""")  # fmt: skip
def typed_config(spark, sf_dir):
    """A settings file of fixed lines and of a block for each nation, read back with its types."""
    path = storage.scratch(spark, "settings")
    n = table(spark, sf_dir, "nation")
    block = ["nation_%s:", "  name: %s", "  region: %s  # by key", "  scan:", "    even: %s"]
    lines = F.format_string("\n".join(block), F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"), (F.col("n_nationkey") % 2 == 0).cast("string"))
    fixed = spark.createDataFrame([(SETTINGS.strip("\n"),)], "value string")
    fixed.unionByName(n.select(lines.alias("value"))).coalesce(1).write.text(path)
    return spark.createDataFrame(storage.flat(storage.config(spark, path)), "key string, value string")


@query("s11_optional_csv", "SELECT p_partkey, p_size FROM part")
def optional_csv(spark, sf_dir):
    path, kind = storage.scratch(spark, "optional"), "p_partkey long, p_size int"
    sinks.csv(table(spark, sf_dir, "part").select("p_partkey", "p_size"), path)
    return readers.optional_csv(spark, path, kind).unionByName(readers.optional_csv(spark, f"{path}-missing", kind))


@query("s13_nested_band_json", "SELECT DISTINCT 'B' || p_partkey % 40 AS symbol, CAST(p_partkey % 40 * 1000 + 0.5 AS DOUBLE) AS ltp FROM part WHERE p_partkey % 40 < 30")
def nested_band_json(spark, sf_dir):
    """Two tiers without a list of all securities; a symbol is in both, its first row stays."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("k")).distinct().filter("k < 30")
    row = F.struct(F.concat(F.lit(" b"), F.col("k")).alias("symbol"), F.lit("EQ").alias("series"), F.format_number(F.col("k") * 1000 + F.lit(0.5), 1).alias("ltp"))
    tiers = p.agg(F.sort_array(F.collect_list(F.when(F.col("k") < 20, row))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("k") >= 10, row))).alias("b"))
    text = F.to_json(F.struct(F.struct(F.struct(F.col("a").alias("data")).alias("U05"), F.struct(F.col("b").alias("data")).alias("U10")).alias("upper")))
    return readers.price_band_json(spark, as_text(tiers.select(text.alias("value")), "bands")).select("symbol", "ltp")


@query("s16_symbols_csv", "SELECT DISTINCT upper(p_brand) AS ticker FROM part")
def symbols_csv(spark, sf_dir):
    path = storage.scratch(spark, "symbols")
    sinks.csv(table(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.upper("p_brand"), F.lit(" ")).alias("ticker")), path)
    return readers.tickers_csv(spark, path)


@query("s17_listing_csv", "SELECT DISTINCT upper(trim(s_name)) || '.NS' AS ticker, upper(trim(s_name)) AS symbol FROM supplier UNION SELECT DISTINCT upper(trim(c_name)) || '.BO', upper(trim(c_name)) FROM customer WHERE c_custkey < 50")
def listing_csv(spark, sf_dir):
    """Two boards with headers of their own."""
    a, b = storage.scratch(spark, "board"), storage.scratch(spark, "board")
    sinks.csv(table(spark, sf_dir, "supplier").select(F.lower("s_name").alias("SYMBOL"), F.col("s_name").alias("NAME OF COMPANY")), a)
    sinks.csv(table(spark, sf_dir, "customer").filter("c_custkey < 50").select(F.col("c_name").alias("Security Id"), F.col("c_name").alias("Issuer Name")), b)
    read = lambda path, suffix, *names: readers.listing(spark.read.option("header", True).csv(path), suffix, *names)
    both = read(a, ".NS", "SYMBOL", "NAME OF COMPANY").unionByName(read(b, ".BO", "Security Id", "Issuer Name"))
    return both.select("ticker", "symbol").distinct()


def listing_file(spark, sf_dir) -> str:
    path = storage.scratch(spark, "listing")
    group = F.element_at(F.array(*[F.lit(x) for x in "ABTX"]), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("SCRIP_CD"), F.concat(F.lit("c"), F.col("c_custkey")).alias("scrip_id"), group.alias("GROUP"), F.when(F.col("c_custkey") % 5 == 0, "Delisted").otherwise("Active").alias("Status"))
    rows.write.json(path)
    return path


@query("s18_listing_json", "SELECT c_custkey AS code FROM customer WHERE c_custkey % 4 < 2 AND c_custkey % 5 <> 0")
def listing_json(spark, sf_dir):
    return readers.active_in_groups(spark.read.json(listing_file(spark, sf_dir)), ["A", "B"]).select(F.col("SCRIP_CD").alias("code"))


@query("s19_listing_fallback_map", "SELECT c_custkey AS code, CASE WHEN c_custkey % 4 < 2 AND c_custkey % 5 <> 0 THEN 'C' || c_custkey || '.BO' ELSE 'C' || c_custkey || '.NS' END AS ticker FROM customer")
def listing_fallback(spark, sf_dir):
    """Code to ticker by the filtered listing, else by the full one."""
    full = spark.read.json(listing_file(spark, sf_dir))
    named = lambda df, suffix: df.select(F.col("SCRIP_CD").alias("code"), F.concat(F.upper("scrip_id"), F.lit(suffix)).alias("ticker"))
    return first_source([named(readers.active_in_groups(full, ["A", "B"]), ".BO"), named(full, ".NS")], "code")


PERIODS = {"5d": 5, "2w": 14, "1mo": 30, "6mo": 183, "1y": 365, "2y": 730}


_PERIOD = f"[{', '.join(f"'{p}'" for p in PERIODS)}][1 + o_custkey % {len(PERIODS)}]"


@query("s27_period_bounds", f"""WITH c AS (SELECT o_custkey, {_PERIOD} AS period, CAST(max(o_orderdate) AS DATE) AS hi FROM orders GROUP BY o_custkey)
    SELECT o_custkey, period, hi - d AS lo, hi FROM c JOIN (VALUES {', '.join(f"('{p}', {d})" for p, d in PERIODS.items())}) v(p, d) ON p = period""")  # fmt: skip
def period_bounds(spark, sf_dir):
    """The days that a fetch of each customer's period would ask for, up to their last order."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("hi"))
    period = F.element_at(F.array(*[F.lit(p) for p in PERIODS]), (F.col("o_custkey") % len(PERIODS) + 1).cast("int"))
    c = last.withColumn("period", period)
    return c.select("o_custkey", "period", readers.period_start(F.col("period"), F.col("hi")).alias("lo"), "hi")


@query("s29_bulk_history", "SELECT CAST(symbol AS VARCHAR) AS symbol, count(*) AS bars, min(dt) AS first, max(dt) AS last FROM bars GROUP BY symbol")
def bulk_history(spark, sf_dir):
    """Chunks of dates that meet at their edges, stitched, one row a day kept, stored by symbol."""
    bars = walk_bars(spark, sf_dir).withColumn("symbol", F.col("symbol").cast("string"))
    edges = ["1900-01-01", "1994-01-01", "1996-06-30", "2100-01-01"]
    chunks = [bars.filter(f"dt between DATE '{a}' and DATE '{b}'").withColumn("chunk", F.lit(i)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    stitched = chunks[0].unionByName(chunks[1]).unionByName(chunks[2])
    kept = stored(readers.canonical(stitched, "chunk"), "history")
    return kept.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("dt").alias("first"), F.max("dt").alias("last"))


@query("s32_primary_or_fallback", "SELECT o_custkey AS key, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'NS' ELSE 'BO' END AS board, count(*) FILTER (WHERE o_orderstatus = 'F') + CASE WHEN bool_or(o_orderstatus = 'F') THEN 0 ELSE count(*) END AS n FROM orders GROUP BY o_custkey")
def primary_or_fallback(spark, sf_dir):
    """Rows of the primary ticker, or those of the fallback where the primary has none."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderstatus")
    primary = o.filter("o_orderstatus = 'F'").withColumn("board", F.lit("NS"))
    return first_source([primary, o.withColumn("board", F.lit("BO"))], "key").groupBy("key", "board").agg(F.count("*").alias("n"))


@query("s33_enough_history", "SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol HAVING count(*) >= 50")
def enough_history(spark, sf_dir):
    return readers.enough_history(walk_bars(spark, sf_dir), 50).groupBy("symbol").agg(F.count("*").alias("bars"))


@query("s34_long_from_wide", "SELECT CAST(symbol AS VARCHAR) AS symbol, dt, close, CAST(volume AS DOUBLE) AS volume FROM bars WHERE symbol IN (1, 2, 3)")
def long_from_wide(spark, sf_dir):
    b = walk_bars(spark, sf_dir).filter("symbol in (1, 2, 3)")
    fields = ["open", "high", "low", "close", "volume"]
    cells = b.select("dt", F.explode(F.array(*[F.struct(F.concat(F.lit(f"{c}|"), F.col("symbol")).alias("cell"), F.col(c).cast("double").alias("v")) for c in fields])).alias("x"))
    wide = cells.groupBy("dt").pivot("x.cell", [f"{c}|{s}" for c in fields for s in (1, 2, 3)]).agg(F.first("x.v"))
    return readers.long_from_wide(wide).select("symbol", "dt", "close", "volume")


def _sheet(spark, path: str):
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


@query("k01_csv_sink", "SELECT p_partkey, p_name, p_retailprice FROM part")
def csv_sink(spark, sf_dir):
    path = storage.scratch(spark, "csv")
    sinks.csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), path)
    return spark.read.schema("p_partkey long, p_name string, p_retailprice double").option("header", True).csv(path)


@query("k02_latest_snapshot", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def latest_snapshot(spark, sf_dir):
    """A second snapshot replaces the first."""
    path, o = storage.scratch(spark, "snapshot"), table(spark, sf_dir, "orders")
    for status in ("F", "O"):
        sinks.snapshot(o.filter(F.col("o_orderstatus") == status).select("o_orderkey", "o_totalprice"), path)
    return spark.read.parquet(path)


@query("k03_workbook", "SELECT 'region' AS sheet, count(*) AS n FROM region UNION ALL SELECT 'a_sheet_name_longer_than_thirty', count(*) FROM nation")
def workbook(spark, sf_dir):
    """Sheet names are cut to 31 characters, a missing sheet is skipped."""
    path = storage.scratch(spark, "book")
    done = sinks.workbook({"region": table(spark, sf_dir, "region"), "a_sheet_name_longer_than_thirty_one": table(spark, sf_dir, "nation"), "none": None}, path)
    out = [_sheet(spark, f"{path}/{s}").select(F.lit(s.rstrip("_")).alias("sheet")) for s in done]
    return out[0].unionAll(out[1]).groupBy("sheet").agg(F.count("*").alias("n"))


@query("k05_placeholder_sheet", "SELECT 'No matches' AS note")
def placeholder(spark, sf_dir):
    path = storage.scratch(spark, "book")
    sinks.screen_book(table(spark, sf_dir, "region").filter("false"), path)
    return _sheet(spark, f"{path}/summary")


@query("k07_append_log", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS run FROM orders WHERE o_orderstatus IN ('F', 'O')")
def append_log(spark, sf_dir):
    path, o = storage.scratch(spark, "log"), table(spark, sf_dir, "orders")
    for run, status in ((1, "F"), (2, "O")):
        sinks.append_log(o.filter(F.col("o_orderstatus") == status).select("o_orderkey", F.lit(run).alias("run")), path)
    return spark.read.parquet(path)


@query("k10_best_params", "SELECT o_orderkey AS trial, o_totalprice AS score FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_params(spark, sf_dir):
    path = storage.scratch(spark, "params")
    sinks.best_params(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_totalprice").alias("score")), path)
    return spark.read.schema("trial long, score double").json(path)


@query("t06_ttl_cache", "SELECT 0 AS at, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders UNION ALL SELECT 50, count(*) FILTER (WHERE o_orderstatus = 'F') FROM orders UNION ALL SELECT 100, count(*) FILTER (WHERE o_orderstatus = 'O') FROM orders")
def ttl_cache(spark, sf_dir):
    """Made at 0, still read at 50, made again at 100."""
    cache, o = storage.Cache(spark, storage.scratch(spark, "cache"), 60), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    out = None
    for at, status in ((0, "F"), (50, "O"), (100, "O")):
        one = cache.get("orders", at, lambda s=status: o.filter(F.col("o_orderstatus") == s)).agg(F.lit(at).alias("at"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


def event_files(spark, sf_dir, parts: int = 3):
    """The events as a stream of files in time order, some rows late and repeated."""
    path = storage.scratch(spark, "events")
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e.withColumn("part", F.col("event_id") % parts).repartition(parts, "part").drop("part").write.parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream, name: str, sink=None):
    """Run a stream over all that is there; its rows, or what ``sink`` leaves."""
    spark = stream.sparkSession
    out, marks = storage.scratch(spark, name), storage.scratch(spark, f"{name}_marks")
    w = stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True)
    (w.foreachBatch(sink(out)) if sink else w.format("parquet").outputMode("append").option("path", out)).start().awaitTermination()
    return out


@query("t01_incremental_upsert", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def incremental_upsert(spark, sf_dir):
    """The newest event of each user, merged batch by batch."""
    from ..streaming.bars import upsert_latest

    out = drained(event_files(spark, sf_dir).select("user_id", "event_id"), "latest", lambda path: upsert_latest(path, ["user_id"], "event_id"))
    return spark.read.parquet(out).groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query("t02_late_duplicates", "SELECT DISTINCT event_id, event_type FROM events")
def late_duplicates(spark, sf_dir):
    from ..streaming.bars import first_seen

    s = event_files(spark, sf_dir)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return spark.read.parquet(drained(first_seen(twice, "3650 days").select("event_id", "event_type"), "seen"))


@query("t05_append_log_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def append_log_stream(spark, sf_dir):
    return spark.read.parquet(drained(event_files(spark, sf_dir).select("event_id", "event_type"), "log")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("c21_rotation_pipeline")
def rotation_pipeline(spark, sf_dir):
    """Indices built and stored, the snapshot from the stored ones, its leaders and the snapshot written as a book."""
    path = storage.scratch(spark, "group_index")
    bars, members, index = _index(spark, sf_dir)
    storage.save_group_index(index, path)
    index = storage.load_group_index(spark, path)
    rot = rotation(bars, index, benchmark(bars).withColumnRenamed("bench", "level"), members)
    rot = stored(rot.selectExpr(*_out()), "rotation")
    sinks.workbook({"rotation": rot, "leaders": rot.orderBy("rank", "grp").limit(5)}, storage.scratch(spark, "rotation_book"))
    return rot


ORACLES["c21_rotation_pipeline"] = ORACLES["c12_rotation_snapshot"]


@query("k09_model_artefacts", "SELECT 1 AS models, 2 AS calibration_points_at_least, 'market_cap,pe' AS feature_order, 0.0 AS worst_difference")
def model_artefacts(spark, sf_dir):
    """A classifier, its calibration and the frozen feature order saved, loaded and used again: scores are the same."""
    f = fundamentals(spark, sf_dir).withColumn("y", (F.col("symbol") % 3 == 0).cast("int")).withColumn("weight", F.lit(1.0))
    features = ["market_cap", "pe"]
    model = learn.linear(features).fit(f)
    path = storage.scratch(spark, "model")
    learn.save(model, features, learn.calibration_points(learn.score(model, f, "p"), "p"), path)
    again, order, points = learn.load(spark, path)
    a, b = learn.score(model, f, "p").select("symbol", "p"), learn.score(again, f, "q").select("symbol", "q")
    worst = a.join(b, "symbol").agg(F.lit(1).alias("models"), F.max(F.abs(F.col("p") - F.col("q"))).alias("worst_difference"))
    few = points.agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("calibration_points_at_least"))
    return worst.crossJoin(few).select("models", "calibration_points_at_least", F.lit(",".join(order)).alias("feature_order"), "worst_difference")


@query("k04_scanner_workbook", """WITH s AS (SELECT s_suppkey AS symbol, s_acctbal / 100 AS score, s_suppkey % 10 = 0 AS high_conviction, s_suppkey % 3 = 0 AS triggered FROM supplier)
    SELECT 'summary' AS sheet, count(*) AS n FROM s UNION ALL SELECT 'watchlist', count(*) FILTER (WHERE score >= 65 OR high_conviction) FROM s
    UNION ALL SELECT 'triggers', count(*) FILTER (WHERE triggered AND (score >= 65 OR high_conviction)) FROM s UNION ALL SELECT 'high_conviction', count(*) FILTER (WHERE high_conviction) FROM s""")  # fmt: skip
def scanner_workbook(spark, sf_dir):
    path = storage.scratch(spark, "scanner")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_acctbal") / 100).alias("score"), (F.col("s_suppkey") % 10 == 0).alias("high_conviction"), (F.col("s_suppkey") % 3 == 0).alias("triggered"))
    out = None
    for name in sinks.scanner_book(s, path):
        one = _sheet(spark, f"{path}/{name}").agg(F.lit(name).alias("sheet"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


@query("t03_cooldown_state", """WITH RECURSIVE ev AS (SELECT user_id, CAST(ts AS DATE) AS d, min(event_id) AS e FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1 GROUP BY 1, 2),
    c AS (SELECT user_id, min(d) AS d FROM ev GROUP BY user_id UNION ALL SELECT user_id, nx FROM (SELECT c.user_id, (SELECT min(v.d) FROM ev v WHERE v.user_id = c.user_id AND v.d >= c.d + 15) AS nx FROM c) WHERE nx IS NOT NULL)
    SELECT c.user_id, ev.e AS event_id FROM c JOIN ev ON ev.user_id = c.user_id AND ev.d = c.d""")  # fmt: skip
def cooldown_state(spark, sf_dir):
    """One file in one batch, so that the state meets every user's events in time order."""
    from ..streaming.bars import cooldown

    return spark.read.parquet(drained(cooldown(event_files(spark, sf_dir, 1)).select("user_id", "event_id"), "cooldown"))
