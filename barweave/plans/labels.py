"""Label, split and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ranks import tiles
from ..operators import evaluate, labels, validation
from ..operators.indicators import staged_sql, with_indicators
from ..sources.fixtures import walk_bars
from .registry import query, r6

_ENTRIES = f"{staged_sql()}, e AS (SELECT symbol, dt, n, close, atr20 AS atr, c50max AS resistance, close + 3 * atr20 AS top, close - atr20 AS bottom FROM ind WHERE n >= 21 AND atr20 > 0)"
PATH = "p AS (SELECT e.*, f.n - e.n AS i, f.dt AS f_dt, f.high AS f_high, f.low AS f_low, f.close AS f_close FROM e JOIN ind f ON f.symbol = e.symbol AND f.n BETWEEN e.n + 1 AND e.n + 10)"


def entries(spark, sf_dir):
    ind = with_indicators(walk_bars(spark, sf_dir))
    return ind.filter("n >= 21").selectExpr("symbol", "dt", "n", "close", "atr20 AS atr", "c50max AS resistance"), ind.select("symbol", "dt", "n", "high", "low", "close")


@query("j04_forward_path", f"WITH {_ENTRIES}, {PATH} SELECT symbol, dt, count(*) AS bars_ahead, {r6('max(f_high)')} AS best_high, {r6('min(f_low)')} AS worst_low FROM p GROUP BY symbol, dt")
def forward_path(spark, sf_dir):
    e, bars = entries(spark, sf_dir)
    g = labels.forward_path(e.filter("atr > 0"), bars, 10).groupBy("symbol", "dt").agg(F.count("*").alias("bars_ahead"), F.max("f_high").alias("h"), F.min("f_low").alias("l"))
    return g.selectExpr("symbol", "dt", "bars_ahead", f"{r6('h')} AS best_high", f"{r6('l')} AS worst_low")


OUTCOME = """g AS (SELECT symbol, dt, close, atr, top, bottom, min(i) FILTER (WHERE f_low <= bottom) AS il, min(i) FILTER (WHERE f_high >= top) AS ih,
      max(i) AS ie, arg_max(f_close, i) AS ce, arg_max(f_dt, i) AS de, arg_min(f_dt, i) FILTER (WHERE f_low <= bottom) AS dl, arg_min(f_dt, i) FILTER (WHERE f_high >= top) AS dh, bool_or(i <= 5 AND f_close > resistance) AS ok
      FROM p GROUP BY ALL),
    k AS (SELECT *, CASE WHEN il IS NOT NULL AND (ih IS NULL OR il <= ih) THEN 's' WHEN ih IS NOT NULL THEN 'g' ELSE 'e' END AS how FROM g),
    x AS (SELECT *, CASE how WHEN 's' THEN bottom WHEN 'g' THEN top ELSE ce END AS price FROM k)"""
OUTCOME_COLUMNS = f"""symbol, dt, CASE how WHEN 's' THEN -1 WHEN 'g' THEN CASE WHEN ok THEN 1 ELSE 0 END ELSE 0 END AS label, CASE how WHEN 's' THEN dl WHEN 'g' THEN dh ELSE de END AS exit_date,
      {r6("price")} AS exit_price, {r6("(price - close) / atr")} AS r_multiple, CAST(CASE how WHEN 's' THEN il WHEN 'g' THEN ih ELSE ie END AS INTEGER) AS days_held"""


@query("c03_triple_barrier", f"WITH {_ENTRIES}, {PATH}, {OUTCOME} SELECT {OUTCOME_COLUMNS} FROM x")
def triple_barrier(spark, sf_dir):
    e, bars = entries(spark, sf_dir)
    return labels.triple_barrier(e, bars).selectExpr("symbol", "dt", "label", "exit_date", f"{r6('exit_price')} AS exit_price", f"{r6('r_multiple')} AS r_multiple", "days_held")


def _trend_sql() -> str:
    fits = []
    for h in range(5, 31):
        f = f"(PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        fits.append(f"SELECT symbol, dt, close, {h} AS h, lead(dt, {h}) OVER w AS d, lead(close, {h}) OVER w AS c, count(close) OVER {f} AS k, corr(close, n) OVER {f} AS r FROM x WINDOW w AS (PARTITION BY symbol ORDER BY dt)")
    return f"""WITH x AS (SELECT symbol, dt, close, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS n FROM bars), f AS ({" UNION ALL ".join(fits)}),
      t AS (SELECT *, r * sqrt(h - 2.0) / sqrt(nullif(greatest(1 - r * r, 0), 0)) AS t FROM f WHERE k = h),
      b AS (SELECT *, row_number() OVER (PARTITION BY symbol, dt ORDER BY round(abs(t), 4) DESC, h) AS o FROM t WHERE t IS NOT NULL AND NOT isnan(t))
      SELECT symbol, dt, CASE WHEN round(abs(t), 4) < 2 THEN 0 WHEN t > 0 THEN 1 ELSE -1 END AS label, h AS best_horizon, round(round(t, 4) + 1e-9, 3) AS t_stat, d AS exit_date, {r6("(c - close) / greatest(close * 0.01, 1e-6)")} AS r_multiple FROM b WHERE o = 1"""


@query("c04_trend_scanning", _trend_sql())
def trend_scan(spark, sf_dir):
    bars = walk_bars(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("dt")))
    return labels.trend_scan(bars).selectExpr("symbol", "dt", "label", "best_horizon", "round(t_stat + 1e-9, 3) AS t_stat", "exit_date", f"{r6('r_multiple')} AS r_multiple")


_SPANS = "sp AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS entry, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 10 AS INT) AS exit_date FROM orders)"


def spans(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("asof"), F.expr("date_add(to_date(o_orderdate), cast(o_orderkey % 10 as int))").alias("exit_date"))


@query("c05_uniqueness_weights", f"""WITH {_SPANS}, dd AS (SELECT id, unnest(generate_series(entry, exit_date, INTERVAL 1 DAY)) AS day FROM sp), l AS (SELECT day, count(*) AS k FROM dd GROUP BY day),
    w AS (SELECT id, avg(1.0 / k) AS raw FROM dd JOIN l USING (day) GROUP BY id) SELECT id, {r6("raw / (SELECT avg(raw) FROM w)")} AS weight FROM w""")  # fmt: skip
def uniqueness(spark, sf_dir):
    return validation.uniqueness_weights(spans(spark, sf_dir)).selectExpr("id", f"{r6('weight')} AS weight")


@query("j13_interval_expansion", f"WITH {_SPANS}, dd AS (SELECT unnest(generate_series(entry, exit_date, INTERVAL 1 DAY)) AS day FROM sp) SELECT CAST(day AS DATE) AS day, count(*) AS load FROM dd GROUP BY day")
def expansion(spark, sf_dir):
    return validation.daily_load(spans(spark, sf_dir))


@query("j14_interval_average", f"""WITH {_SPANS}, dd AS (SELECT id, unnest(generate_series(entry, exit_date, INTERVAL 1 DAY)) AS day FROM sp), l AS (SELECT day, count(*) AS k FROM dd GROUP BY day)
    SELECT id, {r6("avg(1.0 / k)")} AS raw FROM dd JOIN l USING (day) GROUP BY id""")  # fmt: skip
def interval_average(spark, sf_dir):
    return validation.span_means(spans(spark, sf_dir)).selectExpr("id", f"{r6('raw')} AS raw")


_FOLDS = f"""{_SPANS}, t AS (SELECT *, ntile(5) OVER (ORDER BY entry, id) AS own FROM sp), bo AS (SELECT own AS fold, min(entry) AS lo, max(entry) AS hi FROM t GROUP BY own),
    pf AS (SELECT fold, id, CASE WHEN own = fold THEN 'test' WHEN NOT (entry <= hi AND exit_date >= lo) AND NOT (entry > hi AND entry <= hi + 25) THEN 'train' END AS part FROM t, bo)"""


@query("c06_purged_kfold", f"WITH {_FOLDS} SELECT CAST(fold AS INTEGER) AS fold, id, part FROM pf WHERE part IS NOT NULL")
def purged(spark, sf_dir):
    return validation.purged_folds(spans(spark, sf_dir))


@query("j12_interval_overlap", f"WITH {_FOLDS} SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (WHERE part IS NULL) AS purged, count(*) FILTER (WHERE part = 'train') AS train FROM pf GROUP BY fold")
def overlap(spark, sf_dir):
    s = spans(spark, sf_dir)
    sizes = validation.purged_folds(s).groupBy("fold").agg(F.count("*").alias("kept"), F.count_if(F.col("part") == "train").alias("train"))
    return sizes.join(F.broadcast(s.agg(F.count("*").alias("all")))).select("fold", (F.col("all") - F.col("kept")).alias("purged"), "train")


@query("c07_walk_forward", f"""WITH {_SPANS}, en AS (SELECT min(entry) AS a, max(entry) AS z FROM sp),
    st AS (SELECT CAST(k AS INTEGER) AS fold, a + 1095 + CAST(k AS INTEGER) * 90 AS start FROM en, range(200) r(k) WHERE a + 1095 + CAST(k AS INTEGER) * 90 + 180 <= z),
    ro AS (SELECT fold, id, CASE WHEN entry >= start THEN 'test' ELSE 'train' END AS part FROM sp JOIN st ON entry <= start - 15 OR (entry >= start AND entry < start + 180))
    SELECT * FROM ro WHERE fold IN (SELECT fold FROM ro GROUP BY fold HAVING count(*) FILTER (WHERE part = 'train') > 100 AND count(*) FILTER (WHERE part = 'test') > 20)""")  # fmt: skip
def walk(spark, sf_dir):
    return validation.walk_forward(spans(spark, sf_dir))


_SCORED = """sc AS (SELECT l.doc_id AS id, l.quality AS y, (d.n_chars % 97) / 97.0 AS p0, CAST((d.n_chars % 97) AS DOUBLE) / 97 AS prob, CAST(l.doc_id % 7 AS DOUBLE) - 2 AS r_multiple,
    CAST(2000 + l.doc_id % 5 AS INTEGER) AS year, CAST(l.doc_id % 4 AS INTEGER) AS fold FROM labels l JOIN documents d USING (doc_id))"""


def scored(spark, sf_dir):
    lab, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    return lab.join(docs.select("doc_id", "n_chars"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y"), ((F.col("n_chars") % 97).cast("double") / 97).alias("prob"), ((F.col("doc_id") % 7).cast("double") - 2).alias("r_multiple"),
        (2000 + F.col("doc_id") % 5).cast("int").alias("year"), (F.col("doc_id") % 4).cast("int").alias("fold"),
    )


def _rounded(df, keys: list[str], counts: list[str], numbers: list[str]):
    return df.selectExpr(*keys, *counts, *[f"{r6(c)} AS {c}" for c in numbers])


_DEC = f"""{_SCORED}, ed AS (SELECT list_sort(list_distinct(quantile_cont(prob, [{", ".join(str(i / 10) for i in range(11))}]))) AS e FROM sc),
    de AS (SELECT sc.*, CAST(len(list_filter(e[2:len(e)-1], lambda z: z < prob)) AS INTEGER) AS decile FROM sc, ed)"""


@query("a05_decile_table", f"WITH {_DEC} SELECT decile, count(*) AS n, {r6('avg(y)')} AS hit_rate, {r6('avg(r_multiple)')} AS mean_r, {r6('median(r_multiple)')} AS median_r, {r6('avg(prob)')} AS mean_prob FROM de GROUP BY decile")
def deciles(spark, sf_dir):
    return _rounded(evaluate.decile_table(scored(spark, sf_dir)), ["decile"], ["n"], ["hit_rate", "mean_r", "median_r", "mean_prob"])


@query("f14_quantile_bins", f"WITH {_DEC} SELECT id, decile FROM de")
def quantile_bins(spark, sf_dir):
    return evaluate.quantile_bin(scored(spark, sf_dir)).select("id", "decile")


_EDGES = ", ".join(str(i / 10) for i in range(1, 10))


@query("f15_fixed_bins", f"WITH {_SCORED} SELECT id, CAST(len(list_filter([{_EDGES}], lambda z: CAST(z AS DOUBLE) < prob)) AS INTEGER) AS bin FROM sc")
def fixed_bins(spark, sf_dir):
    return scored(spark, sf_dir).select("id", evaluate.fixed_bin(F.col("prob")).alias("bin"))


@query("a06_calibration_table", f"WITH {_SCORED} SELECT CAST(len(list_filter([{_EDGES}], lambda z: CAST(z AS DOUBLE) < prob)) AS INTEGER) AS bin, count(*) AS n, {r6('avg(prob)')} AS predicted, {r6('avg(y)')} AS actual FROM sc GROUP BY 1")
def calibration(spark, sf_dir):
    return _rounded(evaluate.calibration_table(scored(spark, sf_dir)), ["bin"], ["n"], ["predicted", "actual"])


_T = [0.1, 0.3, 0.5, 0.7, 0.9]


@query("a07_threshold_sweep", f"WITH {_SCORED} SELECT threshold, count(*) AS n, {r6('avg(y)')} AS hit_rate, {r6('avg(r_multiple)')} AS mean_r, {r6('sum(r_multiple)')} AS total_r FROM sc JOIN (SELECT CAST(unnest([{', '.join(map(str, _T))}]) AS DOUBLE) AS threshold) ON prob >= threshold GROUP BY threshold HAVING count(*) >= 5")
def sweep(spark, sf_dir):
    return _rounded(evaluate.sweep(scored(spark, sf_dir), _T), ["threshold"], ["n"], ["hit_rate", "mean_r", "total_r"])


@query("a08_by_year", f"WITH {_SCORED} SELECT year, count(*) AS n, {r6('avg(y)')} AS hit_rate, {r6('sum(r_multiple)')} AS total_r FROM sc WHERE prob >= 0.22 GROUP BY year")
def by_year(spark, sf_dir):
    g = scored(spark, sf_dir).filter("prob >= 0.22").groupBy("year").agg(F.count("*").alias("n"), F.avg("y").alias("hit_rate"), F.sum("r_multiple").alias("total_r"))
    return _rounded(g, ["year"], ["n"], ["hit_rate", "total_r"])


@query("a20_fold_statistics", f"WITH {_SCORED}, f AS (SELECT fold, avg(power(y - prob, 2)) AS brier FROM sc GROUP BY fold) SELECT {r6('avg(brier)')} AS mean, {r6('stddev_samp(brier)')} AS std, {r6('median(brier)')} AS mid FROM f")
def fold_statistics(spark, sf_dir):
    f = scored(spark, sf_dir).groupBy("fold").agg(F.avg(F.pow(F.col("y") - F.col("prob"), 2)).alias("brier"))
    return _rounded(f.agg(F.avg("brier").alias("mean"), F.stddev_samp("brier").alias("std"), F.median("brier").alias("mid")), [], [], ["mean", "std", "mid"])


@query("m07_auc", f"""WITH {_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS k FROM sc)
    SELECT {r6("(sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))")} AS auc FROM r""")  # fmt: skip
def auc(spark, sf_dir):
    return _rounded(evaluate.auc(scored(spark, sf_dir)), [], [], ["auc"])


@query("m08_average_precision", f"""WITH {_SCORED}, g AS (SELECT prob, sum(y) AS pos, count(*) AS k FROM sc GROUP BY prob), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(k) OVER w AS seen FROM g WINDOW w AS (ORDER BY prob DESC ROWS UNBOUNDED PRECEDING))
    SELECT {r6("sum(pos * CAST(tp AS DOUBLE) / seen) / sum(pos)")} AS average_precision FROM c""")  # fmt: skip
def average_precision(spark, sf_dir):
    return _rounded(evaluate.average_precision(scored(spark, sf_dir)), [], [], ["average_precision"])


@query("m09_brier_mae", f"WITH {_SCORED} SELECT {r6('avg(power(y - prob, 2))')} AS brier, {r6('avg(abs(y - prob))')} AS mae FROM sc")
def brier(spark, sf_dir):
    return _rounded(scored(spark, sf_dir).agg(F.avg(F.pow(F.col("y") - F.col("prob"), 2)).alias("brier"), F.avg(F.abs(F.col("y") - F.col("prob"))).alias("mae")), [], [], ["brier", "mae"])


@query("m10_out_of_fold", f"WITH {_SCORED}, f AS (SELECT id, prob + k AS pred, k FROM sc, range(3) r(k) WHERE k <= fold) SELECT id, {r6('arg_max(pred, k)')} AS oof FROM f GROUP BY id")
def out_of_fold(spark, sf_dir):
    """Overlapping test folds: the last fold's prediction stands."""
    f = scored(spark, sf_dir).select("id", "prob", "fold", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).filter("k <= fold")
    return f.groupBy("id").agg(F.max_by(F.col("prob") + F.col("k"), "k").alias("oof")).selectExpr("id", f"{r6('oof')} AS oof")


_KS = [10, 25, 50]
_REPORT = f"""WITH {_DEC.replace("FROM sc)", "FROM ho)").replace("FROM sc, ed", "FROM ho, ed").replace("sc.*", "ho.*").replace(", ed AS", ", ho AS (SELECT * FROM sc WHERE year = 2004), ed AS", 1)},
    r AS (SELECT y, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS k FROM ho),
    g AS (SELECT prob, sum(y) AS pos, count(*) AS k FROM ho GROUP BY prob), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(k) OVER w AS seen FROM g WINDOW w AS (ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)),
    best AS (SELECT y, row_number() OVER (ORDER BY prob DESC, id) AS place FROM ho),
    m AS (SELECT 'metric' AS part, 'base_rate' AS item, count(*) AS n, avg(y) AS value FROM ho
      UNION ALL SELECT 'metric', 'brier', count(*), avg(power(y - prob, 2)) FROM ho UNION ALL SELECT 'metric', 'mae', count(*), avg(abs(y - prob)) FROM ho
      UNION ALL SELECT 'metric', 'auc', count(*), (sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) FROM r
      UNION ALL SELECT 'metric', 'average_precision', CAST(max(seen) AS BIGINT), sum(pos * CAST(tp AS DOUBLE) / seen) / sum(pos) FROM c
      UNION ALL SELECT 'decile', CAST(decile AS VARCHAR), count(*), avg(y) FROM de GROUP BY decile
      UNION ALL SELECT 'sweep', CAST(t AS VARCHAR), count(*), avg(y) FROM ho JOIN (SELECT CAST(unnest([{", ".join(map(str, _T))}]) AS DOUBLE) AS t) ON prob >= t GROUP BY t HAVING count(*) >= 5
      UNION ALL SELECT 'top', CAST(k AS VARCHAR), count(*), avg(y) FROM best JOIN (SELECT unnest({_KS}) AS k) ON place <= k GROUP BY k)
    SELECT part, item, n, {r6("value")} AS value FROM m"""


@query("m13_holdout_report", _REPORT)
def holdout(spark, sf_dir):
    report = evaluate.holdout_report(scored(spark, sf_dir).filter("year = 2004"), _T, _KS)
    return _rounded(report, ["part", "item"], ["n"], ["value"])


@query("m14_spearman", f"""WITH {_SCORED}, r AS (SELECT rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS a, rank() OVER (ORDER BY r_multiple) + (count(*) OVER (PARTITION BY r_multiple) - 1) / 2.0 AS b FROM sc)
    SELECT {r6("corr(a, b)")} AS spearman FROM r""")  # fmt: skip
def spearman(spark, sf_dir):
    return _rounded(evaluate.spearman(scored(spark, sf_dir), "prob", "r_multiple"), [], [], ["spearman"])


@query("o06_top_decile_precision", f"WITH {_SCORED}, t AS (SELECT y, ntile(10) OVER (ORDER BY prob DESC, id) AS tenth FROM sc) SELECT CAST(tenth AS INTEGER) AS tenth, count(*) AS n, {r6('avg(y)')} AS precision_ FROM t GROUP BY tenth")
def top_decile(spark, sf_dir):
    t = tiles(scored(spark, sf_dir), 10, -F.col("prob").cast("double"), [F.col("prob").desc(), "id"], "tenth")
    return _rounded(t.groupBy("tenth").agg(F.count("*").alias("n"), F.avg("y").alias("precision_")), ["tenth"], ["n"], ["precision_"])


@query("f23_binary_label", "SELECT doc_id, CASE WHEN quality - toxic * 2 = 1 THEN 1 ELSE 0 END AS y FROM labels")
def binary_label(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", labels.to_binary(F.col("quality") - F.col("toxic") * 2).alias("y"))


@query("x03_cooldown", """WITH RECURSIVE ev AS (SELECT DISTINCT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS dt FROM lineitem WHERE l_returnflag = 'R'),
    k AS (SELECT symbol, min(dt) AS dt FROM ev GROUP BY symbol UNION ALL SELECT symbol, nx AS dt FROM (SELECT k.symbol, (SELECT min(e.dt) FROM ev e WHERE e.symbol = k.symbol AND e.dt >= k.dt + 15) AS nx FROM k) WHERE nx IS NOT NULL)
    SELECT symbol, dt FROM k""")  # fmt: skip
def cooldown(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_returnflag = 'R'")
    ev = li.select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("dt")).distinct()
    return labels.cooldown(ev)
