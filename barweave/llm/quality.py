"""Quality rules: a learned decision list over interpretable document statistics.

Statistics of every document are written once. Sequential covering on labelled documents grows
one conjunction of thresholds at a time by information gain on two thirds of the rows, prunes it on
the other third, removes what it covers, and stops when the next rule isn't precise enough. The
rules come out as one ordered ``CASE WHEN`` expression that Spark evaluates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, fresh, slices, texts, written

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_upper", "n_stops", "n_distinct"]
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
CAPITALS, MARKS = bytes(range(65, 91)), b"!?;:"
#: Most labelled rows that the list is learned from.
MAX_LABELLED = 20_000
#: The columns of the rules, each a ratio of statistics.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"), "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "word_chars"),
    "stops_per_word": ("n_stops", "n_words"), "distinct_share": ("n_distinct", "n_words"), "word_length": ("word_chars", "n_words"), "words": ("n_words", None),
}


def statistics(text: bytes | None, window: int = 5) -> tuple[int, ...]:
    """BASE and EXTRA statistics of one text as UTF-8 bytes (null: all 0). Windows are compared exactly: a
    window's number stands for its words, doubling up numbers of shorter runs."""
    if not text:
        return (0,) * 8
    words = text.split()
    n = len(words)
    chars = len(text.decode()) - len(text) + len(text.translate(None, SPACES))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > window:
        ids: dict[bytes, int] = {}
        h = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        distinct = len(ids)
        w = h[: n - window + 1]
        for j in range(1, window):  # a number for each distinct run of j + 1 words, exact
            w = np.unique(w * len(ids) + h[j : n - window + 1 + j], return_inverse=True)[1]
        order = np.argsort(w, kind="stable")
        same = np.flatnonzero(w[order][1:] == w[order][:-1])
        if len(same):
            cover = np.zeros(n + 1, np.int64)
            at = np.union1d(order[same], order[same + 1])
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            repeated = int((np.cumsum(cover[:n]) > 0).sum())
    else:
        distinct = len(set(words))
    return (
        n, chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(text) - len(text.translate(None, CAPITALS)), len(text) - len(text.translate(None, MARKS)), distinct,
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = np.array([statistics(t) for t in texts(b)], np.int64).reshape(-1, 8)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(rows[:, i]) for i in range(8)], b.column("h")], names=["doc_id", *BASE, *EXTRA, "h"])


def measure(docs: DataFrame) -> DataFrame:
    """A written table of doc_id, the statistics and h (hash of the text) per row."""
    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(_measure, f"doc_id {kind}, {', '.join(f'{c} long' for c in [*BASE, *EXTRA])}, h long")
    return written(out, "quality_stats")


def ratio(name: str) -> Column:
    a, b = RATIOS[name]
    return F.col(a).cast("double") if b is None else F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


Rule = list[tuple[str, str, float]]


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], most: int) -> Rule:
    """Add the threshold test with the best gain until the rule is pure or ``most`` tests long."""
    rule, on = [], np.ones(len(y), bool)
    while len(rule) < most and on.any() and y[on].mean() < 1:
        p0, n0 = y[on].sum(), on.sum()
        top = (1e-9, None, None)
        for j, name in enumerate(names):
            for cut in np.unique(np.quantile(x[on, j], np.linspace(0.02, 0.98, 49))):
                for sign in (">", "<="):
                    hit = on & ((x[:, j] > cut) if sign == ">" else (x[:, j] <= cut))
                    p, n = y[hit].sum(), hit.sum()
                    if p and n < n0 and (gain := p * (np.log2(p / n) - np.log2(p0 / n0))) > top[0]:
                        top = (gain, (name, sign, float(cut)), hit)
        if top[1] is None:
            break
        rule.append(top[1])
        on = top[2]
    return rule


def covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    on = np.ones(len(x), bool)
    for name, sign, cut in rule:
        v = x[:, names.index(name)]
        on &= (v > cut) if sign == ">" else (v <= cut)
    return on


def learn_list(x: np.ndarray, y: np.ndarray, names: list[str], max_rules: int = 12, max_tests: int = 4, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """Ordered conjunctions that name the rows of ``y`` (True: to be rejected) by sequential covering."""
    rules: list[Rule] = []
    third = np.arange(len(y)) % 3 == 2
    left = np.ones(len(y), bool)
    while len(rules) < max_rules and y[left & ~third].any():
        g, p = left & ~third, left & third
        rule = _grow(x[g], y[g], names, max_tests)
        worth = lambda r: ((hit := covers(r, x[p], names)) & y[p]).sum() - (hit & ~y[p]).sum()
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = covers(rule, x, names) & left
        if not rule or (hit & y).sum() < least or y[hit].mean() < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def as_column(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression: the number of the rule that rejects, else null."""
    out = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules):
        test = F.lit(True)
        for name, sign, cut in rule:
            test = test & ((ratio(name) > cut) if sign == ">" else (ratio(name) <= cut))
        out = out.when(test, F.lit(i))
    return out


def fit(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learn from labelled rows: all of them, or a sample of about ``max_labelled`` by hash of the id if there are more."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("bad"))
    share = min(1.0, max_labelled / max(1, labels.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    names = list(RATIOS)
    # rows that repeat a doc_id with one text are one; of a doc_id's texts the one with the smallest hash is learned from
    own = stats.join(known, "doc_id").groupBy("doc_id", "bad").agg(F.min_by(F.struct(*BASE, *EXTRA), "h").alias("s"))
    rows = own.select("doc_id", "bad", "s.*").select("doc_id", "bad", *[ratio(c).alias(c) for c in names]).toPandas()
    rows = rows.sort_values(["doc_id", *names], ignore_index=True)
    return learn_list(rows[names].to_numpy(float), rows["bad"].to_numpy(bool), names) if len(rows) else []


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, the statistics, h, base_failed, rule (the list's rule
    that rejects it, or null), kept.

    Defined cases: null or empty text has zero statistics and fails the base rule (under 10 words);
    without usable labels the list is empty and only the base rule rejects; contradictory
    labels of one document count by their mean; repeated rows are judged alike; an empty table gives
    no rows; further columns are ignored.
    """
    stats = measure(docs)
    verdict = stats.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return verdict.withColumn("rule", as_column(fit(stats, labels, max_labelled))).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns, whatever their names.

    Defined cases are those of ``judge``: null, empty and short texts go, rows without doc_id are judged like others, repeated
    rows stay or go together, very long texts are measured whole, an empty table gives no rows.
    """
    i, h = fresh(docs, "_id"), fresh(docs, "_h")
    bad = judge(docs, labels).filter("not kept").select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct()
    bad = checked(written(bad, "quality_bad"))
    return docs.join(bad, (F.col("doc_id").eqNullSafe(F.col(i))) & (F.xxhash64("text") == F.col(h)), "left_anti")
