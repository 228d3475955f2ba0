"""The contract queries of the training-data operators, one per operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, jaccard, langid, linededup, maintext, mixing, pieces, quality, records, sharding, suffix, topk, trie

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs))
    return out.select("doc_id", langid.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), k=4, num=85)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), n_shards=40, overhead=16)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_substrings(_table(spark, sf_dir, "documents"), length=50)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), PIECES)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.binary_output(_table(spark, sf_dir, "documents"), WORDS, end_id=1)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"), span=5, heads=9)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(_table(spark, sf_dir, "documents"), min_docs=3, top=200)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(_table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_language_id, op2_ngram_jaccard, op3_exact_topk, op4_quality_rules, op5_sharding, op6_suffix_dedup, op7_sentencepiece,
            op8_line_dedup, op9_source_mixing, op10_binary_output, op11_prefix_trie, op12_source_divergence,
            op13_html_extraction,
        )
    }


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = {
    "op3_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        e AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
        k AS (SELECT doc_id, pos, line, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
        f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    # crc32 as bit steps over the decimal digits: a byte is mixed in, then -1 stands for one shift
    "op11_prefix_trie": """
        WITH o AS (
          SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
          FROM conversations WHERE conv_id IS NOT NULL),
        h AS (
          SELECT c, xor(4294967295, list_reduce(
                   flatten(list_transform(range(length(CAST(c AS VARCHAR))), lambda k: [CAST(ascii(CAST(c AS VARCHAR)[k + 1]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
                   lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295)) % 9 AS h
          FROM (SELECT DISTINCT c FROM o)),
        b AS (
          SELECT h.c, o.i, o.r, o.t FROM h JOIN o ON o.c = h.c - h.c % 5 AND o.i < h.h
          UNION ALL SELECT h.c, o.i, o.r, o.t FROM h JOIN o ON o.c = h.c AND o.i >= h.h),
        p AS (
          SELECT c, CAST(row_number() OVER w AS BIGINT) AS d, string_agg(md5(r) || md5(t), '') OVER w AS k,
                 coalesce(string_agg(md5(r) || md5(t), '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS up, strlen(t) AS size
          FROM b WINDOW w AS (PARTITION BY c ORDER BY i)
          UNION ALL SELECT c, 0, '', NULL, 0 FROM h),
        e AS (SELECT c, max(d) AS d FROM p GROUP BY c),
        n AS (
          SELECT k, any_value(up) AS up, min(p.c) AS conv_id, any_value(p.d) AS depth, count(*) AS n_convs, any_value(size) AS size,
                 sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (WHERE e.d = p.d), '')) AS ends_sha256
          FROM p JOIN e USING (c) GROUP BY k),
        kids AS (SELECT up AS k, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY up),
        u AS (SELECT DISTINCT a.k AS top, z.k FROM p a JOIN p z ON z.c = a.c AND z.d >= a.d),
        s AS (
          SELECT top AS k, CAST(count(*) FILTER (WHERE kids.k IS NULL) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens
          FROM u JOIN n ON n.k = u.k LEFT JOIN kids ON kids.k = u.k GROUP BY top)
        SELECT n.conv_id, n.depth, above.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
        FROM n JOIN s ON s.k = n.k LEFT JOIN kids ON kids.k = n.k LEFT JOIN n above ON above.k = n.up""",
    "op12_source_divergence": r"""
        WITH d AS (
          SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
          FROM documents),
        g AS (SELECT DISTINCT lang, source FROM d),
        t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
        k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
        l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM k GROUP BY lang),
        o AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
        s AS (SELECT g.lang, g.source, CAST(coalesce(sum(o.n), 0) AS HUGEINT) AS total FROM g LEFT JOIN o ON o.lang = g.lang AND o.source = g.source GROUP BY ALL),
        p AS (
          SELECT s.lang, s.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000 * (coalesce(o.n, 0) + 1)) // (s.total + l.v) AS p,
                 1 + (1000000000 * (k.n + 1)) // (l.total + l.v) AS q
          FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term),
        pairs AS (
          SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        w AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM w)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200""",
}
