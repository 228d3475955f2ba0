"""Learning queries use and score every labelled bar."""

from datetime import date, timedelta

import numpy as np

from barweave.operators import learn
from barweave.plans import labels as label_plans
from barweave.plans import learning

SF = "/root/testdata/sf0.001"


def test_every_labelled_bar_is_a_row(spark):
    e, _ = label_plans.entries(spark, SF)
    want = label_plans.triple_barrier(spark, SF).join(e.filter("n >= 210").select("symbol", "dt"), ["symbol", "dt"]).count()
    rows = learning.labelled(spark, SF)
    assert rows.count() == rows.select("id").distinct().count() == want > 1000
    m = learning.calibrated(spark, SF).toPandas()
    assert len(m) == m["id"].nunique() == want and m["prob"].notna().all() and m["prob_cal"].between(0, 1).all()


def test_later_rows_are_not_learned_from(spark):
    rows = [(i, date(2020, 1, 1) + timedelta(days=i), date(2020, 1, 1) + timedelta(days=i + 5)) for i in range(100)]
    got = {r["id"]: r["part"] for r in learn.by_time(spark.createDataFrame(rows, "id long, asof date, exit_date date")).collect()}
    first = min(i for i, p in got.items() if p == "test")
    assert 78 <= first <= 80 and len(got) == 100
    assert got == {i: "test" if i >= first else "train" if i + 5 < first else None for i in range(100)}


def test_blend_and_regimes_score_every_row(spark):
    want = learning.labelled(spark, SF).count()
    b = learning.blended(spark, SF).toPandas()
    assert len(b) == b["id"].nunique() == want and 0.1 < b["held_out"].mean() < 0.3
    heads = ["prob_calibrated", "prob_stack", "prob_regime"]
    assert np.allclose(b["prob_blend"], b[heads].mean(axis=1), atol=1e-12) and b["r_multiple_pred"].notna().all()
    r = learning.regimes(spark, SF).toPandas()
    assert len(r) == r["id"].nunique() == want and r["prob"].notna().all()


def test_walk_forward_scores(spark):
    w = learning.learned_out_of_fold(spark, SF).toPandas()
    assert 100 < len(w) == w["id"].nunique() < learning.labelled(spark, SF).count() and w["oof"].between(0, 1).all()
