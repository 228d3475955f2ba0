"""Line dedup, by DataFrame functions only.

Lines are exploded as 96-bit hashes of their normalised form, distinct doc_ids are counted per hash with
map-side combine, and the positions of lines over the threshold go back to their document, whose
text is rebuilt from the remaining positions. Only hashes and positions are shuffled unless the
positions to drop are too many to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WHITE, checked, dropped, written


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def frequent_line_positions(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """uid, dropped array<int>: 0-based positions of the lines whose key is in ``min_docs`` documents."""
    keys = F.transform(F.split(F.col("text"), "\n", -1), line_key)
    hashed = F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.hash(k).alias("b"))))
    lines = written(docs.filter(F.col("text") != "").select("uid", hashed.alias("keys")), "line_keys")  # hashes and ids only
    counts = (
        lines.select("uid.doc_id", F.explode(F.filter("keys", lambda k: k.isNotNull())).alias("key"))
        .select("key.a", "key.b", "doc_id").distinct().groupBy("a", "b").agg(F.count("doc_id").alias("n")).filter(F.col("n") >= min_docs).select("a", "b")
    )
    frequent = written(counts, "frequent_lines")
    exploded = lines.select("uid", F.posexplode("keys").alias("pos", "key")).filter(F.col("key").isNotNull()).select("uid", "pos", "key.a", "key.b")
    # a document's own positions are gathered together: they are no more than its lines
    hit = exploded.join(checked(frequent), ["a", "b"]).groupBy("uid").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    hit = written(hit, "dropped_lines")
    dropped(lines, frequent)
    return hit


def kept_lines(lines: Column, gone: Column) -> Column:
    """The text of ``lines`` without the ascending positions ``gone``: the runs between them, so that the work is linear in
    the lines. Both arrays are bound to a variable first, as a lambda would compute them again for every run."""

    def join(x: Column) -> Column:
        cuts = F.concat(F.array(F.lit(-1)), x["gone"], F.array(F.size(x["lines"])))
        runs = F.transform(F.array(F.struct(cuts.alias("cuts"), x["lines"].alias("lines"))), _runs)[0]
        return F.array_join(F.flatten(runs), "\n")

    return F.transform(F.array(F.struct(lines.alias("lines"), gone.alias("gone"))), join)[0]


def _runs(x: Column) -> Column:
    at = F.sequence(F.lit(0), F.size(x["cuts"]) - 2)
    return F.transform(at, lambda i: F.slice(x["lines"], F.get(x["cuts"], i) + 2, F.get(x["cuts"], i + 1) - F.get(x["cuts"], i) - 1))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with text replaced by its kept lines, and n_lines, n_dropped (long) added.

    Defined cases: null and empty text are one empty line, kept, and give ``""``; a line of white
    space only has an empty key and stays (``min_chars`` 1); rows that repeat a doc_id count as one
    document and rows without doc_id as none, and a line repeated inside one document counts once; a text of very many
    lines takes time in proportion to them;
    an empty table gives no rows; further columns pass through (``uid``, ``dropped``, ``n_lines``, ``n_dropped`` are replaced where they exist).
    """
    docs = docs.drop("uid", "dropped", "n_lines", "n_dropped").withColumn(
        "uid", F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))
    )
    hit = frequent_line_positions(docs, min_docs, min_chars)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = kept_lines(lines, F.col("dropped"))
    gone = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped"))
    return (
        docs.join(checked(hit), "uid", "left")
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", gone.cast("long"))
        .withColumn("text", F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept))
        .drop("uid", "dropped")
    )
