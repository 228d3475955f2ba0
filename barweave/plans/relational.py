"""Projection, join, aggregation, sort and set queries over the star schema and the bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..sources.fixtures import fundamentals, table, walk_bars
from .registry import query, r6
from .windows import _BENCH_SQL, _FUND, benchmark

_ASOF = "DATE '1998-06-30'"


@query("p01_asof_slice", f"SELECT symbol, count(*) AS n, max(dt) AS last_dt FROM bars WHERE dt <= {_ASOF} GROUP BY symbol")
def asof_slice(spark, sf_dir):
    return walk_bars(spark, sf_dir).filter(f"dt <= {_ASOF}").groupBy("symbol").agg(F.count("*").alias("n"), F.max("dt").alias("last_dt"))


@query("p02_base_slice", f"WITH s AS (SELECT symbol, dt AS base_start FROM (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY close DESC, dt) AS k FROM bars) WHERE k = 1) SELECT b.symbol, count(*) AS n, {r6('min(low)')} AS base_low, {r6('max(high)')} AS base_high FROM bars b JOIN s ON b.symbol = s.symbol AND b.dt >= s.base_start GROUP BY b.symbol")
def base_slice(spark, sf_dir):
    b = walk_bars(spark, sf_dir)
    start = F.max_by("dt", F.struct("close", F.negate(F.unix_date("dt")))).over(Window.partitionBy("symbol"))
    g = b.withColumn("base_start", start).filter("dt >= base_start").groupBy("symbol").agg(F.count("*").alias("n"), F.min("low").alias("l"), F.max("high").alias("h"))
    return g.selectExpr("symbol", "n", f"{r6('l')} AS base_low", f"{r6('h')} AS base_high")


@query("p03_null_row_drop", f"WITH {_FUND} SELECT symbol, sector FROM f WHERE market_cap IS NOT NULL AND roe IS NOT NULL")
def null_rows(spark, sf_dir):
    return fundamentals(spark, sf_dir).na.drop(subset=["market_cap", "roe"]).select("symbol", "sector")


@query("p04_universe_filter", "SELECT symbol, count(*) AS n, count(*) FILTER (WHERE dt >= DATE '1999-01-01' - 200) AS recent FROM bars WHERE dt <= DATE '1999-01-01' GROUP BY symbol HAVING count(*) >= 200 AND count(*) FILTER (WHERE dt >= DATE '1999-01-01' - 200) >= 30")
def universe(spark, sf_dir):
    return universe_filter(walk_bars(spark, sf_dir).filter("dt <= DATE '1999-01-01'"), F.lit("1999-01-01").cast("date"))


def universe_filter(bars, today, least: int = 200, days: int = 200, least_recent: int = 30):
    """Symbols with enough bars at all and enough in the last calendar days."""
    g = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("dt") >= F.date_sub(today, days)).alias("recent"))
    return g.filter((F.col("n") >= least) & (F.col("recent") >= least_recent))


@query("p05_min_history", "SELECT symbol, dt FROM (SELECT symbol, dt, count(*) OVER (PARTITION BY symbol) AS k FROM bars) WHERE k >= 530")
def min_history(spark, sf_dir):
    k = F.count("*").over(Window.partitionBy("symbol"))
    return walk_bars(spark, sf_dir).withColumn("k", k).filter("k >= 530").select("symbol", "dt")


@query("p11_threshold_filter", "SELECT doc_id, n_chars FROM documents WHERE n_chars / 10000.0 >= 0.22")
def threshold(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("n_chars / 10000.0 >= 0.22").select("doc_id", "n_chars")


@query("p12_holdout_split", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) > (SELECT CAST(max(CAST(o_orderdate AS DATE)) - INTERVAL 12 MONTH AS DATE) FROM orders) THEN 1 ELSE 0 END AS holdout FROM orders")
def holdout_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    cut = o.agg(F.add_months(F.max("d"), -12).alias("cut"))
    return o.join(F.broadcast(cut)).select("o_orderkey", (F.col("d") > F.col("cut")).cast("int").alias("holdout"))


@query("p13_numeric_features", "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def numeric_features(spark, sf_dir):
    """Numeric columns that are not keys."""
    li = table(spark, sf_dir, "lineitem")
    meta = {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"}
    return li.select([c for c, t in li.dtypes if t in ("double", "int", "bigint", "float") and c not in meta])


@query("p14_frozen_projection", "SELECT s_suppkey, s_acctbal, CAST(NULL AS DOUBLE) AS missing_feature FROM supplier")
def frozen_projection(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(*[F.col(c) if c in s.columns else F.lit(None).cast("double").alias(c) for c in ("s_suppkey", "s_acctbal", "missing_feature")])


@query("p15_infinite_to_null", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS v FROM supplier")
def infinite(spark, sf_dir):
    v = F.when(F.col("s_suppkey") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("s_acctbal"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(~v.isin(float("inf"), float("-inf")) & ~F.isnan(v), v).alias("v"))


@query("p18_toggle_matrix", """WITH m AS (SELECT * FROM (VALUES ('main', true, true), ('small', false, true)) t(universe, use_cap, use_list)), u AS (SELECT s_suppkey, s_acctbal, CASE WHEN s_suppkey % 4 = 0 THEN 'small' ELSE 'main' END AS universe FROM supplier)
    SELECT s_suppkey, universe FROM u JOIN m USING (universe) WHERE (NOT use_cap OR s_acctbal BETWEEN 350 AND 7000) AND (NOT use_list OR s_suppkey % 5 <> 0)""")  # fmt: skip
def toggle_matrix(spark, sf_dir):
    m = spark.createDataFrame([("main", True, True), ("small", False, True)], "universe string, use_cap boolean, use_list boolean")
    u = table(spark, sf_dir, "supplier").withColumn("universe", F.when(F.col("s_suppkey") % 4 == 0, "small").otherwise("main"))
    keep = (~F.col("use_cap") | F.col("s_acctbal").between(350, 7000)) & (~F.col("use_list") | (F.col("s_suppkey") % 5 != 0))
    return u.join(F.broadcast(m), "universe").filter(keep).select("s_suppkey", "universe")


@query("p27_type_filter", "SELECT p_partkey, p_type FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') OR p_type IS NULL")
def type_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_type").isin("ECONOMY", "STANDARD") | F.col("p_type").isNull()).select("p_partkey", "p_type")


@query("p28_present_columns", "SELECT n_nationkey, n_name FROM nation")
def present_columns(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select([c for c in ("n_nationkey", "n_name", "n_population") if c in n.columns])


@query("p29_rounding", "SELECT s_suppkey, round_even(s_acctbal / 8, 1) AS even_1 FROM supplier")
def rounding(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.bround(F.col("s_acctbal") / 8, 1).alias("even_1"))


@query("p30_section_tag", "SELECT * FROM (SELECT c_custkey, 'TOP' AS section FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) UNION ALL SELECT * FROM (SELECT c_custkey, 'BOTTOM' AS section FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5)")
def section_tag(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    top = c.orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(5).select("c_custkey", F.lit("TOP").alias("section"))
    return top.unionByName(c.orderBy("c_acctbal", "c_custkey").limit(5).select("c_custkey", F.lit("BOTTOM").alias("section")))


@query("j02_group_alignment", f"""WITH g AS (SELECT symbol % 5 AS grp, dt, avg(close) AS level FROM bars GROUP BY 1, 2)
    SELECT b.symbol, b.dt, {r6("last_value(g.level IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.dt ROWS UNBOUNDED PRECEDING)")} AS level FROM bars b LEFT JOIN g ON g.grp = b.symbol % 5 AND g.dt = b.dt AND g.grp <> 0""")  # fmt: skip
def group_alignment(spark, sf_dir):
    b = walk_bars(spark, sf_dir).withColumn("grp", F.col("symbol") % 5)
    g = b.filter("grp <> 0").groupBy("grp", "dt").agg(F.avg("close").alias("level"))
    w = Window.partitionBy("symbol").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return b.join(g, ["grp", "dt"], "left").withColumn("l", F.last("level", ignorenulls=True).over(w)).selectExpr("symbol", "dt", f"{r6('l')} AS level")


@query("j01_benchmark_alignment", f"WITH {_BENCH_SQL} SELECT x.symbol, x.dt, {r6('x.close / last_value(b.bench IGNORE NULLS) OVER (PARTITION BY x.symbol ORDER BY x.dt ROWS UNBOUNDED PRECEDING)')} AS ratio FROM bars x LEFT JOIN b USING (dt)")
def benchmark_alignment(spark, sf_dir):
    from .windows import with_benchmark

    b = walk_bars(spark, sf_dir)
    return with_benchmark(b, benchmark(b)).selectExpr("symbol", "dt", f"{r6('close / b')} AS ratio")


@query("j03_date_intersection", f"WITH {_BENCH_SQL} SELECT x.symbol, count(*) AS common FROM bars x JOIN b USING (dt) GROUP BY x.symbol")
def date_intersection(spark, sf_dir):
    b = walk_bars(spark, sf_dir)
    return b.join(benchmark(b), "dt").groupBy("symbol").agg(F.count("*").alias("common"))


@query("j05_dictionary_lookup", "SELECT c_custkey, coalesce(n_name, '') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON c_nationkey = n_nationkey")
def dictionary(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_nationkey % 3 <> 0")
    return table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("")).alias("nation"))


@query("j06_fundamentals_lookup", f"WITH {_FUND} SELECT b.symbol, b.dt, f.sector, f.market_cap FROM bars b LEFT JOIN f USING (symbol)")
def fundamentals_lookup(spark, sf_dir):
    return walk_bars(spark, sf_dir).join(fundamentals(spark, sf_dir), "symbol", "left").select("symbol", "dt", "sector", "market_cap")


@query("j08_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_join(spark, sf_dir):
    f = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(f, "c_custkey", "left_anti").select("c_custkey")


@query("j09_upsert_keep_last", """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, value, event_id, event_id % 2 AS p FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY p DESC, event_id DESC) AS k FROM e) SELECT user_id, day, value FROM r WHERE k = 1""")  # fmt: skip
def upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "value", "event_id")
    return rel.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "day"], [F.col("event_id").desc()]).select("user_id", "day", "value")


@query("j10_outer_alignment", "SELECT dt, max(CASE WHEN symbol = 1 THEN close END) AS s1, max(CASE WHEN symbol = 2 THEN close END) AS s2 FROM bars WHERE symbol IN (1, 2) GROUP BY dt")
def outer_alignment(spark, sf_dir):
    return walk_bars(spark, sf_dir).filter("symbol in (1, 2)").groupBy("dt").pivot("symbol", [1, 2]).agg(F.max("close")).select("dt", F.col("1").alias("s1"), F.col("2").alias("s2"))


@query("j15_priority_fallback", "SELECT c_custkey, coalesce(n.n_name, r.r_name, 'none') AS place FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) n ON c_nationkey = n.n_nationkey LEFT JOIN region r ON c_nationkey % 7 = r.r_regionkey")
def priority_fallback(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 10").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.join(F.broadcast(table(spark, sf_dir, "region")), F.col("c_nationkey") % 7 == F.col("r_regionkey"), "left").select("c_custkey", F.coalesce("n_name", "r_name", F.lit("none")).alias("place"))


@query("j16_common_to_periods", f"""WITH p AS (SELECT symbol, d, (arg_max(close, dt) - max(high)) / max(high) * 100 AS pct FROM bars, (VALUES (90), (180), (365)) v(d) WHERE dt >= DATE '1999-06-30' - d AND dt <= DATE '1999-06-30' GROUP BY symbol, d)
    SELECT symbol, {r6("min(pct)")} AS worst FROM p WHERE pct <= -2 GROUP BY symbol HAVING count(*) = 3""")  # fmt: skip
def common_to_periods(spark, sf_dir):
    """Symbols down in every period, with their worst figure."""
    b, day = walk_bars(spark, sf_dir), F.lit("1999-06-30").cast("date")
    out = None
    for d in (90, 180, 365):
        p = b.filter((F.col("dt") >= F.date_sub(day, d)) & (F.col("dt") <= day)).groupBy("symbol").agg(((F.max_by("close", "dt") - F.max("high")) / F.max("high") * 100).alias(f"p{d}")).filter(f"p{d} <= -2")
        out = p if out is None else out.join(p, "symbol")
    return out.select("symbol", F.least("p90", "p180", "p365").alias("w")).selectExpr("symbol", f"{r6('w')} AS worst")


@query("j17_suffix_join", "SELECT a.s_suppkey, a.s_acctbal AS bal_l, b.s_acctbal AS bal_r FROM supplier a JOIN supplier b ON a.s_suppkey = b.s_suppkey + 1")
def suffix_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    left, right = s.select("s_suppkey", F.col("s_acctbal").alias("bal_l")), s.select((F.col("s_suppkey") + 1).alias("s_suppkey"), F.col("s_acctbal").alias("bal_r"))
    return left.join(right, "s_suppkey")


@query("j18_align_frames", "SELECT a.dt, a.close AS left_close, b.close AS right_close FROM bars a JOIN bars b ON a.dt = b.dt AND a.symbol = 1 AND b.symbol = 3")
def align_frames(spark, sf_dir):
    b = walk_bars(spark, sf_dir)
    return b.filter("symbol = 1").select("dt", F.col("close").alias("left_close")).join(b.filter("symbol = 3").select("dt", F.col("close").alias("right_close")), "dt")


@query("a01_group_members", f"WITH {_FUND} SELECT sector, array_to_string(list(symbol ORDER BY symbol), ',') AS members FROM f WHERE sector IS NOT NULL GROUP BY sector")
def group_members(spark, sf_dir):
    g = fundamentals(spark, sf_dir).filter("sector is not null").groupBy("sector").agg(F.array_sort(F.collect_list("symbol")).alias("m"))
    return g.select("sector", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


@query("a02_equal_weight_return", f"""WITH r AS (SELECT symbol, dt, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY dt), 0) - 1 AS ret FROM bars), k AS (SELECT symbol % 5 AS grp, count(DISTINCT symbol) AS members FROM bars GROUP BY 1)
    SELECT CAST(symbol % 5 AS BIGINT) AS grp, dt, {r6("sum(coalesce(ret, 0)) / any_value(members)")} AS ret FROM r JOIN k ON k.grp = symbol % 5 GROUP BY symbol % 5, dt""")  # fmt: skip
def equal_weight(spark, sf_dir):
    b = walk_bars(spark, sf_dir).withColumn("grp", F.col("symbol") % 5)
    ret = F.try_divide("close", F.lag("close").over(Window.partitionBy("symbol").orderBy("dt"))) - 1
    k = b.groupBy("grp").agg(F.count_distinct("symbol").alias("members"))
    g = b.withColumn("ret", ret).groupBy("grp", "dt").agg(F.sum(F.coalesce("ret", F.lit(0.0))).alias("t")).join(F.broadcast(k), "grp")
    return g.selectExpr("grp", "dt", f"{r6('t / members')} AS ret")


@query("a03_summary_statistics", f"SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, {r6('avg(l_quantity)')} AS mean_q, {r6('median(l_quantity)')} AS median_q FROM lineitem GROUP BY l_returnflag")
def summary(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.avg("l_quantity").alias("a"), F.median("l_quantity").alias("m"))
    return g.selectExpr("l_returnflag", "n", "suppliers", f"{r6('a')} AS mean_q", f"{r6('m')} AS median_q")


@query("a04_breadth", f"""WITH x AS (SELECT symbol, close, avg(close) OVER (PARTITION BY symbol ORDER BY dt ROWS 49 PRECEDING) AS m50, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS k, count(*) OVER (PARTITION BY symbol) AS t FROM bars)
    SELECT 'G' || (symbol % 5) AS grp, {r6("CASE WHEN count(*) >= 5 THEN avg(CAST(close > m50 AS INT)) * 100 END")} AS breadth FROM x WHERE k = 1 AND t >= 200 GROUP BY 1""")  # fmt: skip
def breadth(spark, sf_dir):
    from ..operators import groups
    from ..sources.fixtures import membership

    b = walk_bars(spark, sf_dir)
    return groups.breadth(b, membership(b)).selectExpr("grp", f"{r6('breadth_above_50dma')} AS breadth")


@query("a09_tag_prevalence", """WITH t AS (SELECT unnest(string_split(CASE WHEN l_discount >= 0.08 THEN 'deep,' ELSE '' END || CASE WHEN l_quantity >= 40 THEN 'bulk,' ELSE '' END || l_returnflag, ',')) AS tag FROM lineitem) SELECT tag, count(*) AS n FROM t GROUP BY tag""")
def tags(spark, sf_dir):
    s = F.concat(F.when(F.col("l_discount") >= 0.08, "deep,").otherwise(""), F.when(F.col("l_quantity") >= 40, "bulk,").otherwise(""), F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select(F.explode(F.split(s, ",")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("a10_cohort_medians", f"SELECT {r6('median(l_quantity)')} AS quantity, {r6('median(l_extendedprice)')} AS price, {r6('median(l_discount)')} AS discount FROM lineitem WHERE l_returnflag = 'R'")
def cohort_medians(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").agg(F.median("l_quantity").alias("a"), F.median("l_extendedprice").alias("b"), F.median("l_discount").alias("c"))
    return g.selectExpr(f"{r6('a')} AS quantity", f"{r6('b')} AS price", f"{r6('c')} AS discount")


@query("a11_by_band", f"SELECT p_size, count(*) AS n, {r6('median(p_retailprice)')} AS mid, count(*) FILTER (WHERE p_brand = 'Brand#2') AS at_brand FROM part GROUP BY p_size")
def by_band(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n"), F.median("p_retailprice").alias("m"), F.count_if(F.col("p_brand") == "Brand#2").alias("at_brand"))
    return g.selectExpr("p_size", "n", f"{r6('m')} AS mid", "at_brand")


@query("a12_conditional_share", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') || '/' || count(*) || ' (' || CAST(CAST(floor(count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0 / count(*)) AS INT) AS VARCHAR) || ' %)' AS share FROM orders GROUP BY o_orderpriority")
def share(spark, sf_dir):
    k, n = F.count_if(F.col("o_orderstatus") == "F"), F.count("*")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.concat(k, F.lit("/"), n, F.lit(" ("), F.floor(k * 100 / n).cast("int"), F.lit(" %)")).alias("share"))


@query("a13_move_histogram", """WITH r AS (SELECT (close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY dt), 0) - 1) * 100 AS m FROM bars)
    SELECT count(*) FILTER (WHERE m >= 2.95) AS top, count(*) FILTER (WHERE m >= 2 AND m < 3) AS high, count(*) FILTER (WHERE m >= 1 AND m < 2) AS mid, count(*) FILTER (WHERE m < 1) AS rest FROM r""")  # fmt: skip
def move_histogram(spark, sf_dir):
    """Buckets of moves; the top one overlaps the next, as in the cohort report."""
    r = walk_bars(spark, sf_dir).select(((F.try_divide("close", F.lag("close").over(Window.partitionBy("symbol").orderBy("dt"))) - 1) * 100).alias("m"))
    m = F.col("m")
    return r.agg(F.count_if(m >= 2.95).alias("top"), F.count_if((m >= 2) & (m < 3)).alias("high"), F.count_if((m >= 1) & (m < 2)).alias("mid"), F.count_if(m < 1).alias("rest"))


@query("a14_dedup_by_max", "SELECT CAST(ts AS DATE) AS day, max(value) AS value FROM events GROUP BY 1")
def dedup_max(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.max("value").alias("value"))


def weekly(bars):
    """Weeks that end on Friday: first, highest, lowest, last, total."""
    return bars.groupBy("symbol", F.next_day(F.date_sub("dt", 1), "FRI").alias("week")).agg(
        F.min_by("open", "dt").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "dt").alias("close"), F.sum("volume").alias("volume")
    )


@query("a16_weekly_bars", f"""SELECT symbol, CAST(dt + CAST((12 - dayofweek(dt)) % 7 AS INT) AS DATE) AS week, {r6("arg_min(open, dt)")} AS open, {r6("max(high)")} AS high, {r6("min(low)")} AS low, {r6("arg_max(close, dt)")} AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2""")
def weekly_bars(spark, sf_dir):
    return weekly(walk_bars(spark, sf_dir)).selectExpr("symbol", "week", *[f"{r6(c)} AS {c}" for c in ("open", "high", "low", "close")], "volume")


@query("a17_drop_reason_counts", "SELECT CASE WHEN l_quantity < 5 THEN 'small' WHEN l_discount > 0.08 THEN 'discount' WHEN l_tax > 0.06 THEN 'tax' ELSE 'pass' END AS drop_reason, count(*) AS n FROM lineitem GROUP BY 1")
def drop_reasons(spark, sf_dir):
    gates = [("small", F.col("l_quantity") < 5), ("discount", F.col("l_discount") > 0.08), ("tax", F.col("l_tax") > 0.06)]
    return rel.funnel(table(spark, sf_dir, "lineitem").withColumn("drop_reason", rel.first_failure(gates)))


@query("a18_pattern_counts", "SELECT count(*) FILTER (WHERE p_size > 25) AS large, count(*) FILTER (WHERE p_type = 'ECONOMY') AS economy, count(*) FILTER (WHERE p_size > 25 AND p_type = 'ECONOMY') AS both_ FROM part")
def pattern_counts(spark, sf_dir):
    a, b = F.col("p_size") > 25, F.col("p_type") == "ECONOMY"
    return table(spark, sf_dir, "part").agg(F.count_if(a).alias("large"), F.count_if(b).alias("economy"), F.count_if(a & b).alias("both_"))


@query("a19_stratified_sample", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE substr(md5(year(o_orderdate) || ':' || o_orderkey), 1, 4) < '6666'")
def stratified(spark, sf_dir):
    """Four tenths of every year, by hash of year and key: the same rows however they are dealt."""
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    drawn = F.substring(F.md5(F.concat(F.col("year"), F.lit(":"), F.col("o_orderkey")).cast("binary")), 1, 4)
    return o.filter(drawn < "6666").select("o_orderkey", "year")  # 0x6666 is 0.4 of 0x10000


@query("a21_max_abs_difference", f"WITH r AS (SELECT o_orderkey, o_totalprice, round(o_totalprice, 1) AS p FROM orders) SELECT {r6('max(abs(o_totalprice - p))')} AS worst FROM r")
def max_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.max(F.abs(F.col("o_totalprice") - F.round("o_totalprice", 1))).alias("w"))
    return o.selectExpr(f"{r6('w')} AS worst")


@query("a22_zscore_blend", f"SELECT c_custkey, {r6('coalesce((c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey)) / nullif(stddev_samp(c_acctbal) OVER (PARTITION BY c_nationkey), 0), 0)')} AS z FROM customer")
def zscore(spark, sf_dir):
    w = Window.partitionBy("c_nationkey")
    z = F.coalesce((F.col("c_acctbal") - F.avg("c_acctbal").over(w)) / F.nullif(F.stddev_samp("c_acctbal").over(w), F.lit(0.0)), F.lit(0.0))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(z + 1e-9, 6).alias("z"))


@query("a23_weighted_composite", f"SELECT l_returnflag, {r6('0.15 * avg(l_quantity) + 0.40 * avg(l_discount) + 0.30 * avg(l_tax) + 0.15 * min(l_quantity)')} AS score FROM lineitem GROUP BY l_returnflag")
def composite(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg((0.15 * F.avg("l_quantity") + 0.40 * F.avg("l_discount") + 0.30 * F.avg("l_tax") + 0.15 * F.min("l_quantity")).alias("s"))
    return g.selectExpr("l_returnflag", f"{r6('s')} AS score")


@query("o01_sort_by_time", "SELECT event_id, ts FROM events")
def sort_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts").orderBy("ts", "event_id")


@query("o02_sort_descending", "SELECT o_orderkey, o_totalprice FROM orders")
def sort_desc(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey")


@query("o05_best_candidate", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def best_candidate(spark, sf_dir):
    """First by several keys: a minimum of structs, combined before the shuffle."""
    key = F.struct("o_orderpriority", (-F.col("o_totalprice")).alias("p"), "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(key).alias("b")).select("o_custkey", "b.o_orderkey")


@query("o07_first_match", "SELECT symbol, min(dt) AS first_dt FROM bars WHERE close > 1.1 * open GROUP BY symbol")
def first_match(spark, sf_dir):
    return walk_bars(spark, sf_dir).filter("close > 1.1 * open").groupBy("symbol").agg(F.min("dt").alias("first_dt"))


@query("o08_first_argmax", "SELECT symbol, dt AS high_dt FROM (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY high DESC, dt) AS k FROM bars) WHERE k = 1")
def first_argmax(spark, sf_dir):
    return walk_bars(spark, sf_dir).groupBy("symbol").agg(F.min_by("dt", F.struct((-F.col("high")).alias("h"), "dt")).alias("high_dt"))


@query("o09_universe_cap", "SELECT DISTINCT symbol FROM bars ORDER BY symbol LIMIT 20")
def universe_cap(spark, sf_dir):
    return walk_bars(spark, sf_dir).select("symbol").distinct().orderBy("symbol").limit(20)


@query("u01_union_all", "SELECT s_suppkey AS k, 'supplier' AS kind FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer")
def union_all(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("kind"))
    return s.unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("kind")))


def _nations(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return s, table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))


_S, _C = "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000"


@query("u02_set_union", f"{_S} UNION {_C}")
def set_union(spark, sf_dir):
    a, b = _nations(spark, sf_dir)
    return a.union(b).distinct()


@query("u03_intersection", f"{_S} INTERSECT {_C}")
def intersection(spark, sf_dir):
    a, b = _nations(spark, sf_dir)
    return a.intersect(b)


@query("u04_difference", f"{_C} EXCEPT {_S}")
def difference(spark, sf_dir):
    a, b = _nations(spark, sf_dir)
    return b.subtract(a)


@query("u05_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@query("f01_safe_divide", f"SELECT l_orderkey, l_linenumber, {r6('coalesce(l_quantity / nullif(l_discount * 100, 0), -1)')} AS q FROM lineitem")
def safe_divide(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.coalesce(F.try_divide(F.col("l_quantity"), F.col("l_discount") * 100), F.lit(-1.0)) + 1e-9, 6).alias("q"))


@query("f02_clip_sign", "SELECT s_suppkey, abs(s_acctbal) AS a, CAST(sign(s_acctbal) AS DOUBLE) AS s, least(greatest(s_acctbal, 0), 5000) AS clipped FROM supplier")
def clip(spark, sf_dir):
    x = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.abs(x).alias("a"), F.signum(x).alias("s"), F.least(F.greatest(x, F.lit(0.0)), F.lit(5000.0)).alias("clipped"))


@query("f03_log_positive", f"SELECT s_suppkey, {r6('CASE WHEN s_acctbal > 0 THEN log10(s_acctbal) END')} AS l FROM supplier")
def log_positive(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.when(F.col("s_acctbal") > 0, F.log10("s_acctbal")) + 1e-9, 6).alias("l"))


@query("f04_to_number", "SELECT p_partkey, TRY_CAST(replace(CASE WHEN p_partkey % 3 = 0 THEN 'n/a' ELSE '1,' || (100 + p_size) END, ',', '') AS DOUBLE) AS v FROM part")
def to_number(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(F.concat(F.lit("1,"), 100 + F.col("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.trim(raw), ",", "").try_cast("double").alias("v"))


@query("f05_null_replacement", f"WITH {_FUND} SELECT symbol, coalesce(sector, 'Unknown') AS sector, coalesce(market_cap, 0) AS cap FROM f")
def null_replacement(spark, sf_dir):
    return fundamentals(spark, sf_dir).select("symbol", F.coalesce("sector", F.lit("Unknown")).alias("sector"), F.coalesce("market_cap", F.lit(0.0)).alias("cap"))


@query("f06_strings", "SELECT p_partkey, upper(trim(p_name)) AS u, replace(p_name, ' ', '_') AS r, ends_with(p_name, 'ring') AS e, string_split(p_name, ' ')[1] AS first_word, regexp_matches(p_brand, '^Brand#[0-9]+$') AS digits FROM part")
def strings(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.upper(F.trim(n)).alias("u"), F.replace(n, F.lit(" "), F.lit("_")).alias("r"), n.endswith("ring").alias("e"), F.split(n, " ")[0].alias("first_word"), F.col("p_brand").rlike("^Brand#[0-9]+$").alias("digits"))


@query("f07_regex_extract", r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links FROM pages""")
def regex(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).cast("long").alias("links"))


@query("f08_contains", "SELECT p_partkey, contains(p_name, 'small') AS hit FROM part")
def contains(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").contains("small").alias("hit"))


@query("f09_array_join", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def array_join(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"))


@query("f10_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS s, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(DATE '2000-01-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS d, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS m FROM orders")
def dates(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("s"), F.year(d).alias("y"), F.datediff(F.lit("2000-01-01").cast("date"), d).alias("d"), F.add_months(d, 3).alias("m"))


@query("f11_midnight", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def midnight(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))


@query("f12_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.absent'), 'none') AS absent FROM events")
def json_get(spark, sf_dir):
    p = F.from_json("props", "k bigint, absent string")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["absent"], F.lit("none")).alias("absent"))


@query("f13_round", "SELECT o_orderkey, round(o_totalprice / 7, 2) AS r FROM orders")
def round_(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 7, 2).alias("r"))


@query("f16_tristate", f"WITH {_FUND} SELECT symbol, market_cap > 5000 AS large FROM f")
def tristate(spark, sf_dir):
    return fundamentals(spark, sf_dir).select("symbol", (F.col("market_cap") > 5000).alias("large"))


@query("f17_candle", f"SELECT symbol, dt, {r6('abs(close - open) / greatest(high - low, 1e-9) * 100')} AS body, {r6('(high - greatest(close, open)) / greatest(high - low, 1e-9) * 100')} AS upper_wick, {r6('(least(close, open) - low) / greatest(high - low, 1e-9) * 100')} AS lower_wick FROM bars")
def candle(spark, sf_dir):
    rng = "greatest(high - low, 1e-9) * 100"
    return walk_bars(spark, sf_dir).selectExpr("symbol", "dt", f"{r6(f'abs(close - open) / {rng}')} AS body", f"{r6(f'(high - greatest(close, open)) / {rng}')} AS upper_wick", f"{r6(f'(least(close, open) - low) / {rng}')} AS lower_wick")


@query("f18_volume_multiple", f"SELECT symbol, dt, {r6('volume / greatest(avg(volume) OVER (PARTITION BY symbol ORDER BY dt ROWS 19 PRECEDING), 1)')} AS times FROM bars")
def volume_multiple(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("dt").rowsBetween(-19, 0)
    return walk_bars(spark, sf_dir).select("symbol", "dt", F.round(F.col("volume") / F.greatest(F.avg("volume").over(w), F.lit(1.0)) + 1e-9, 6).alias("times"))


@query("f22_kelly", f"WITH k AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS p, greatest(abs(l_tax * 30 - 1), 0.5) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, {r6('least(greatest((p * b - (1 - p)) / b, 0), 0.25)')} AS f FROM k")
def kelly(spark, sf_dir):
    p, b = F.col("l_discount") * 10, F.greatest(F.abs(F.col("l_tax") * 30 - 1), F.lit(0.5))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(kelly_fraction(p, b) + 1e-9, 6).alias("f"))


def kelly_fraction(p, b):
    """Share of capital at win probability p and payoff b, between 0 and a quarter."""
    return F.least(F.greatest((p * b - (1 - p)) / b, F.lit(0.0)), F.lit(0.25))


@query("f27_units", f"WITH {_FUND} SELECT symbol, {r6('coalesce(market_cap, pe * 1000) / 1e3')} AS cap FROM f")
def units(spark, sf_dir):
    return fundamentals(spark, sf_dir).selectExpr("symbol", f"{r6('coalesce(market_cap, pe * 1000) / 1e3')} AS cap")
