"""Conversation trie, divergence audit and main text against brute force, on small tables with nulls, empty and long texts, ties,
repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from barweave.llm import divergence, maintext, trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, base string, digest string, n string, depth string"
EXTRA = ["x"] * 4


def turns():
    hello, long = ("user", "hello ü"), ("user", "w " * 60000)
    rows = []
    for c in (0, 1, 2, 3, 4, 7, 9, 12, 25, 26, 27, 33):
        said = [hello, ("assistant", f"a{c % 3}"), ("user", None), (None, "x"), ("user", ""), ("tool", "same"), ("user", f"own {c % 2}"), ("assistant", "z"), ("user", "bye"), ("user", f"end {c % 4}")]
        rows += [(c, i, *x) for i, x in enumerate(said[: 3 + c % 9])]
    rows += [(c, i, "user", f"t{i}") for c in (50, 51, 53) for i in range(40)]  # copies, deep
    rows += [(60, None, "system", "first"), (60, 0, "user", "second"), (61, 5, *long), (61, 5, *long)]  # null first, repeated rows
    rows += [(71, 0, "user", "alone"), (None, 0, "user", "lost")]  # own turns fewer than h, base absent; no conversation
    return [(*r, *EXTRA) for r in rows]


def brute_trie(rows):
    conv = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}
    built = {c: said.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + v[zlib.crc32(str(c).encode()) % 9 :] for c, v in said.items()}
    members, kids = defaultdict(list), defaultdict(set)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
            if d:
                kids[tuple(built[c][: d - 1])].add(tuple(built[c][:d]))
    sums, out = {}, []
    for k in sorted(members, key=len, reverse=True):
        m, below = members[k], [sums[x] for x in kids[k]]
        sums[k] = (sum(x[0] for x in below) or 1, (len(m) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(x[1] for x in below))
        ends = ",".join(str(c) for c in m if len(built[c]) == len(k))
        out.append((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids[k]), *sums[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("merged", [4096, 3, 0])
def test_prefix_trie(spark, merged):
    """Also where families merge only the first turns in memory, or none."""
    df = spark.createDataFrame(turns(), CONVERSATIONS).repartition(3)
    got = trie.prefix_trie(df, merged=merged)
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(turns())
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]


def test_prefix_trie_pieces_of_id_lists(spark):
    """One leaf that more conversations share than a piece has ids."""
    rows = [(c, 0, "user", "same", *EXTRA) for c in range(0, 60000, 5)]
    got = {r.depth: r for r in trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS)).collect()}
    assert got[1].ends_sha256 == hashlib.sha256(",".join(str(c) for c in range(0, 60000, 5)).encode()).hexdigest()
    assert (got[1].n_convs, got[1].saved_tokens, got[0].n_leaves) == (12000, 4 * 11999, 1)


def test_prefix_trie_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).collect() == []


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, term string, tile string, item string, value string"


def documents():
    rows, words = [], ["the", "The", "über", "Über", "data", "spark", "x-ray", "日本", "it's", "a1b", "zz"]
    for i in range(60):
        text = " ".join(words[(i * k) % (5 + i % 7)] for k in range(1, 12 + i % 5))
        rows.append((i, text, ["en", "de", None][i % 3], [f"s{i % 4}", None, "", "t"][(i // 5) % 4]))
    rows += [(100, None, "en", "bare"), (101, "", "xx", "s1"), (102, "once only", "xx", "s2"), (103, "..123..", "yy", "s1"), (104, "big " * 50000, "en", "s1"), (105, "big", "de", "s1"), (106, "tie same tie same", "en", "s9")]
    rows += [(107, "copy copy", "zz", "one")] * 4
    return [(*r[:2], *r[2:], 0, *EXTRA) for r in rows]


def brute_audit(rows, min_docs=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        found = [t.translate(lower) for t in term.findall(text or "")]
        df[lang or ""].update(set(found))
        counts[lang or "", source or ""].update(found)
        groups.add((lang or "", source or ""))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in df[lang].items() if n >= min_docs), key=str.encode)
        total = Counter()
        for g in groups:
            if g[0] == lang:
                total.update(counts[g])

        def p(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (n + len(kept)) for t in kept}

        own, every = {g[1]: p(counts[g]) for g in groups if g[0] == lang}, p(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(own[s][t], every[t]), t) for t in kept if counts[lang, s][t] and own[s][t] > every[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"tile": 2, "block_bytes": 70, "wave": 1}, {"tile": 3, "block_bytes": 1, "wave": 2}])
def test_divergence_audit(spark, settings):
    """Also with many tiles, a block per group and several waves of rounds."""
    got = divergence.divergence_audit(spark.createDataFrame(documents(), DOCUMENTS).repartition(3), **settings)
    assert sorted(map(tuple, got.collect())) == brute_audit(documents())
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]


def test_divergence_heaps(spark):
    got = divergence.divergence_audit(spark.createDataFrame(documents(), DOCUMENTS), top=2, tile=2)
    assert sorted(map(tuple, got.collect())) == brute_audit(documents(), top=2)
    assert divergence.divergence_audit(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_blocks_meet_once(spark):
    from pyspark.sql import functions as F

    for b in (2, 3, 6, 7):
        df = spark.range(b).select(F.col("id").cast("int").alias("i")).crossJoin(spark.range(b).select(F.col("id").cast("int").alias("j"))).filter("i < j")
        rounds = defaultdict(list)
        for r in df.withColumn("r", divergence.meeting_round(F.col("i"), F.col("j"), F.lit(b))).collect():
            assert 0 <= r.r < b - 1 + b % 2
            rounds[r.r] += [r.i, r.j]
        assert all(len(x) == len(set(x)) for x in rounds.values())


def test_shares_of_huge_counts(spark):
    from pyspark.sql import functions as F

    c, n, v = 7 * 10**17, 9 * 10**17, 12345
    got = spark.range(1).select(divergence.share(F.lit(c), F.lit(n), F.lit(v))).first()[0]
    assert got == 1 + 10**9 * (c + 1) // (n + v)


P = "long running text of the story. " * 6
CASES = {
    "article": (f"<body><nav><a href=a>Home</a></nav><!-- x --><div class='ad'>Buy</div><article><h1>T</h1><p>Hi.<p><b>{P}<br><p>End.</article><footer>&copy; f</footer>", f"T\nHi.\n{P.strip()}\nEnd."),
    "containers": (f"<div id=top-nav>Home</div><div class='site-header'>My site</div><div class='layout has-sidebar'><div class=content><h1>T</h1><p>{P}</p><p>Short.</p><div class=advert>x</div><p>{P}</p></div><div class=sidebar>{P}</div></div><div class=comments><p>{P}</p></div>", f"T\n{P.strip()}\nShort.\n{P.strip()}"),
    "flat": (f"<p><a href=x>Home</a> | <a href=y>News</a></p><h2>T</h2><p>{P}<p>short end<p>Copyright 2020", f"T\n{P.strip()}\nshort end"),
    "comments": (f"<article><header><h1>A &amp; B</h1></header><p>one</p><section class='comment-list'><article class=comment>{P}</article></section><p>two</article>", "A & B\none\ntwo"),
    "unclosed menu": (f"<nav><a href=1>x</a><article><p>{P}</p></article>", P.strip()),
    "references": ("<main><p>a &lt;b&gt; &#x41;&nbsp;&nbsp;c &amp d&hellip;</p></main>", "a <b> A c & d…"),
    "scripts": ('<article><script>var t="</p><p>no</p>";</script><style>p{}</style><p>x<!-- <p>no --> y</p><form><p>name</p></form><div hidden>no</div></article>', "x y"),
    "items": ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><pre>d\n  e</pre></article>", "one\ntwo\na\nb\nc\nd e"),
    "quote": ('<article><p title="never closed>text</p><p>b</p></article>', "text\nb"),
    "less": ("<article><p>1 < 2 and 3<4</p></article>", "1 < 2 and 3<4"),
    "menu only": ("<nav><a href=a>Home</a></nav><footer>f</footer>", ""),
    "cut": ("<article><p>begun <b>and", "begun and"),
}


@pytest.mark.parametrize("name", list(CASES))
def test_main_text(name):
    page, want = CASES[name]
    assert maintext.main_text(page) == want


def test_surge_and_dive():
    assert maintext.stretches([0, 0, 5, 90, 0, 0, 3, 0, 0, 0, 2, 0], 3, 86) == [(2, 7)]
    assert maintext.stretches([40, 40, 40], 3, 86) == [(0, 3)]
    assert maintext.stretches([40, 0, 0, 0, 40], 3, 86) == []


def test_extract_pages(spark):
    rows = [(i, f"u{i}", page) for i, (page, _) in enumerate(CASES.values())] + [(None, None, None), (90, "e", ""), (91, "b", "<article>" + f"<p>{P}</p>" * 20000), (0, "u0", CASES["article"][0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long").repartition(3)
    got = maintext.extract(df)
    want = [*(w for _, w in CASES.values()), "", "", "\n".join([P.strip()] * 20000), CASES["article"][1]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((r[0], r[1], w, len(w))) for r, w in zip(rows, want, strict=True))
    assert maintext.extract(df.limit(0)).collect() == []


def test_main_text_is_linear():
    import time

    began = time.time()
    for page in ("<p><b>x<br>" * 100000, '<a "' * 100000, "<div>" * 100000 + "x", "<" * 200000, "<li>" * 100000, "<!--" * 50000, "</div>" * 100000):
        maintext.main_text(page)
    assert time.time() - began < 60


def test_whole_pages_table(spark):
    """The page table's articles are found as they are written, block by block."""
    import html

    from barweave.llm import queries

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in queries.op13_html_extraction(spark, "/root/testdata/sf0.001").collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.DOTALL)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", inner))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_stages_keep_columns_of_any_name(spark):
    """Inputs that have the columns an operator would add to a join, in any spelling."""
    from barweave.llm import jaccard, quality

    good = "the quick onti reou shon whin lath neor tise brou fenn gale " * 2
    rows = [(1, good, "a", "b"), (2, good, "a", "b"), (3, "short", "a", "b"), (None, good + "x", "a", "b"), (4, None, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _H string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    one = jaccard.keep_one(df)
    assert one.columns == df.columns and sorted(r.doc_id or 0 for r in one.collect()) == [0, 1, 3, 4]


def test_lines_in_proportion(spark):
    """A text of a million lines, a third of them found in twelve documents."""
    import time

    from barweave.llm import linededup

    lines = [f"line {i}" if i % 3 else "common" for i in range(1_000_000)]
    rows = [(0, "\n".join(lines)), *((i, f"common\nown {i}\n\ncommon") for i in range(1, 12))]
    began = time.time()
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 60
    assert (got[0].n_lines, got[0].n_dropped, got[0].text) == (1_000_000, 333_334, "\n".join(x for x in lines if x != "common"))
    assert (got[3].n_dropped, got[3].text) == (2, "own 3\n")


@pytest.mark.parametrize(
    "rows, weights",
    [
        ([(0, "w " * 4000, "a")] + [(i, "w", "a") for i in range(1, 4001)] + [(5000 + i, "w " * 100, "b") for i in range(55)], (3, 1, 2)),
        ([(0, "w " * 4000, "a"), (1, "w " * 10, "b"), (2, "w " * 30, "b")], (3, 1, 2)),
        ([(i, "w", "abc"[i % 3]) for i in range(900)], (3, 1, 2)),
        ([(i, "w " * (i % 50 + 1), "a") for i in range(1000)] + [(2000 + i, "w " * (i % 50 + 1), "b") for i in range(3000)], (1, 2000)),
    ],
    ids=["heavy tail", "one document", "words", "thousandth"],
)
def test_mixing_encloses_the_dual(spark, rows, weights):
    """Sources of any shape come as near to their targets as their smallest documents allow."""
    from barweave.llm import mixing

    got = [r.asDict() for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=weights).collect()]
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        slack = {"a": 2000, "b": 20} if len(own) < 3 else {}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= slack.get(s, max(1, min(r["size"] for r in own)))


def dual(cells, target):
    """Bounded tilt by bisection in plain Python: the multiplier at which rates 2 / (1 + exp(-lam * size)) meet the target."""
    import math

    def taken(lam):
        return sum(n * z * 2 / (1 + math.exp(min(700, -lam * z))) for z, n in cells)

    lo, hi = -10.0, 10.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if taken(mid) > target else (mid, hi)
    return {z: 2 / (1 + math.exp(min(700, -lo * z))) for z, _ in cells}


def test_mixing_rates_solve_the_dual(spark):
    """Copies per size follow the exponential tilt that plain bisection finds."""
    from barweave.llm import mixing

    rows = [(i, "w " * (1 + i % 4 * 10), "ab"[i % 3 > 0]) for i in range(6000)]
    got = [r.asDict() for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    for s in "ab":
        cells = Counter(r["size"] for r in got if r["source"] == s)
        target = next(r["target"] for r in got if r["source"] == s)
        if target >= 2 * sum(z * n for z, n in cells.items()):
            continue
        for z, rate in dual(list(cells.items()), target).items():
            copies = sum(r["copies"] for r in got if r["source"] == s and r["size"] == z)
            assert abs(copies - rate * cells[z]) <= 0.02 * cells[z] + 3


def test_jaccard_beyond_the_filter(spark, monkeypatch):
    """The exact semi-join takes the filter's place and finds the same components."""
    from barweave.llm import jaccard

    def prose(seed, n=60):
        return [f"w{(seed * 7919 + i * 104729) % 997}" for i in range(n)]

    rows = []
    for g in range(12):
        base = prose(g)
        for c in range(1 + g % 4):
            words = list(base)
            words[10 * c % 60] = f"x{c}"
            rows.append((g * 10 + c, " ".join(words)))
    df = spark.createDataFrame([*rows, (500, None), (501, "a b"), (501, "a b")], "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, jaccard.jaccard_components(df, k=3, num=70).collect()))
    monkeypatch.setattr(jaccard, "FILTER_KEYS", 0)
    assert sorted(map(tuple, jaccard.jaccard_components(df, k=3, num=70).collect())) == want
    assert len({c for _, _, c in want}) < len(rows)


def test_topk_in_many_groups(spark, monkeypatch):
    """Groups by bytes: a table many times a task's share gives the same lists, from floats as from doubles."""
    import numpy as np
    from barweave.llm import topk

    r = np.random.default_rng(2)
    v = [(i, [float(np.float32(x)) for x in r.normal(size=8) * (40 if i % 7 else 4000)]) for i in range(400)]
    monkeypatch.setattr(topk, "GROUP_BYTES", 300)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 2000)
    m = {i: [int(np.floor(1024 * x)) for x in e] for i, e in v}
    want = set()
    for q in range(0, 400, 50):
        s = sorted(((-sum(a * b for a, b in zip(m[q], m[i], strict=True)), i) for i in m if i != q))[:5]
        want |= {(q, n, i, -x) for n, (x, i) in enumerate(s, 1)}
    for kind in ("float", "double"):
        df = spark.createDataFrame(v, f"vec_id long, embedding array<{kind}>").repartition(4)
        assert set(map(tuple, topk.top_k(df, k=5, every=50).collect())) == want


@pytest.mark.parametrize("name", ["op3_exact_topk", "op8_line_dedup", "op11_prefix_trie", "op12_source_divergence"])
def test_queries_equal_their_sql(spark, name):
    import duckdb
    from barweave.llm import queries

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    rel = c.sql(queries.ORACLE[name])
    at = [rel.columns.index(x) for x in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
