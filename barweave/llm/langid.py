"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. One binary n-gram classifier per bit separates the
languages on either side: a linear log-odds score over hashed byte n-grams. The bits of a
document are decoded to the codeword of least weighted loss, the weights being each classifier's accuracy on
each language; a small lead over the runner-up flags the document as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

BUCKETS, SLICE = 4096, 1 << 18
#: Weights and shares are whole multiples of these parts, so that sums of them are exact in any order.
WEIGHT, SHARE = 1 << 16, 1 << 30
#: Most training documents of a language (by hash of the id, about).
MAX_PER_LANG = 4000
_MULT = {1: 0x9E3779B1, 2: 0x85EBCA6B, 3: 0xC2B2AE35, 4: 0x27D4EB2F}


def profiles(bufs: list[bytes]) -> np.ndarray:
    """One row per text: int64 counts of its hashed byte 1- to 4-grams, A-Z lower-cased. Texts are counted side
    by side, long ones in slices, but no gram crosses the end of a text, so a row depends on its text only."""
    out = np.zeros((len(bufs), BUCKETS), np.int64)
    pieces: list[tuple[int, bytes, bool]] = []
    held = 0

    def count():
        rows = sorted({i for i, *_ in pieces})
        local = {i: k for k, i in enumerate(rows)}
        size = np.array([len(d) for _, d, _ in pieces])
        end = np.cumsum(size)
        a = np.frombuffer(b"".join(d for _, d, _ in pieces) + bytes(4), np.uint8).astype(np.uint32)
        n, spare = len(a) - 4, len(rows) * BUCKETS
        owner = np.repeat(np.array([local[i] for i, *_ in pieces]) * BUCKETS, size)
        for e in end[[not last for *_, last in pieces]]:
            owner[e - 3 : e] = spare  # the next slice of the text begins with these bytes
        gram, total = np.zeros(n, np.uint32), np.zeros(spare + BUCKETS, np.int64)
        for k in range(1, 5):
            gram = (gram << np.uint32(8)) | a[k - 1 : n + k - 1]
            across = end - k + 1
            owner[across[(k > 1) & (across >= end - size)]] = spare
            total += np.bincount(owner + ((gram * np.uint32(_MULT[k])) >> np.uint32(20)), minlength=len(total))
        out[rows] += total[:spare].reshape(len(rows), BUCKETS)

    for i, b in enumerate(bufs):
        b = b.lower()
        for at in range(0, max(1, len(b) - 3), SLICE):
            pieces.append((i, b[at : at + SLICE + 3], at + SLICE + 3 >= len(b)))
            held += len(pieces[-1][1])
            if held >= SLICE or len(pieces) == 64:
                count()
                pieces, held = [], 0
    if pieces:
        count()
    return out


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1: all distinct splits for up to 5 languages, else the random code of
    10 log2 n bits with the largest least distance among 64 draws."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 5:
        bits = [[1 if (i == 0 or not (c >> (i - 1)) & 1) else -1 for i in range(n)] for c in range(1, 2 ** (n - 1))]
        return np.array(bits, float).T.reshape(n, -1)
    rng, length = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    best = (-1, None)
    for _ in range(64):
        m = rng.choice([-1.0, 1.0], (n, length))
        m = m[:, np.abs(m.sum(0)) < n]
        gap = min((m[i] != m[j]).sum() for i in range(n) for j in range(i))
        if gap > best[0]:
            best = (gap, m)
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    trust: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """Mean weight of the grams against each bit's cut: sums of whole numbers under 2**53, exact in any batch."""
        total = np.maximum(1, counts.sum(1, keepdims=True))
        return (counts.astype(float) @ self.weights / (total * float(WEIGHT)) - self.bias) / self.scale

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of exp(-4 loss), and whether the lead is small."""
        if len(self.langs) == 1:
            one = np.ones(len(margins))
            return np.zeros(len(margins), int), one, one < 0
        m = np.clip(margins, -3, 3)
        loss = np.einsum("dlb,lb->dl", np.exp(-m[:, None, :] * self.code[None]), self.trust)
        like = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        share = like / like.sum(1, keepdims=True)
        top = share.argmax(1)
        score = share[np.arange(len(top)), top]
        return top, score, score < 0.6


def is_held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _sums(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs), np.int64)
        for b in batches:
            who = np.array([langs.index(x) for x in b.column("lang").to_pylist()], int)
            bufs = texts(b)
            for at in range(0, len(bufs), 256):
                x = profiles(bufs[at : at + 256])
                np.add.at(total, who[at : at + 256], (x * SHARE) // np.maximum(1, x.sum(1, keepdims=True)))
                np.add.at(n, who[at : at + 256], 1)
        on = [i for i in range(len(langs)) if n[i]]
        yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in on], pa.string()), pa.array([int(n[i]) for i in on], pa.int64()), pa.array([total[i].tolist() for i in on], pa.list_(pa.float64()))], names=["lang", "n", "total"])

    return run


def _tests(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.code.shape[1]
        for b in batches:
            who = np.array([model.langs.index(x) for x in b.column("lang").to_pylist()], int)
            bufs = texts(b)
            for at in range(0, len(bufs), 256):
                m, w = model.margins(profiles(bufs[at : at + 256])), who[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(w, k)), pa.array(np.tile(np.arange(k), len(w))), pa.array(m.ravel().astype(float))], names=["lang", "bit", "margin"])

    return run


def fit(docs: DataFrame, max_per_lang: int = MAX_PER_LANG) -> Model:
    """Learn from (doc_id, lang, text) rows with non-null lang and text that are not held out; each language by about ``max_per_lang``
    documents at most, chosen by hash of the id."""
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    model = Model(langs, codewords(len(langs)))
    if len(langs) < 2:
        return model
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, max_per_lang / n))]), F.col("lang"))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text").filter(F.col("text").rlike(r"\p{L}"))
    sums = sample.mapInArrow(_sums(langs), "lang string, n long, total array<double>").select("lang", "n", F.posexplode("total").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    mean = np.zeros((len(langs), BUCKETS))
    t = sums.toPandas()  # a row per language and bucket
    mean[[langs.index(x) for x in t["lang"]], t["at"]] = t["v"] / (t["n"] * SHARE)
    p = (mean + 1e-6) / (mean + 1e-6).sum(1, keepdims=True)
    plus, minus = np.maximum(model.code, 0), np.maximum(-model.code, 0)
    side = lambda s: (p.T @ s) / s.sum(0)
    model.weights = np.round((np.log(side(plus)) - np.log(side(minus))) * WEIGHT)
    # a bit's cut lies halfway between its two nearest languages
    centre = p @ model.weights / WEIGHT
    low = np.where(model.code > 0, centre, np.inf).min(0)
    high = np.where(model.code < 0, centre, -np.inf).max(0)
    model.bias, model.scale = (low + high) / 2, np.maximum(np.abs(low - high) / 2, 1e-9)
    right = sample.mapInArrow(_tests(model), "lang long, bit long, margin double").groupBy("lang", "bit").agg(
        F.avg((F.col("margin") > 0).cast("double")).alias("positive")
    ).toPandas()
    acc = np.full(model.code.shape, 0.5)
    for r in right.itertuples():
        acc[r.lang, r.bit] = r.positive if model.code[r.lang, r.bit] > 0 else 1 - r.positive
    model.trust = acc / np.maximum(acc.sum(1, keepdims=True), 1e-9)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every whole text.

    Defined cases: a text that is null or has no letter is ``und`` with score 0 and not ambiguous;
    so is every text if no language was learned; one learned language is always predicted with
    score 1; a text is predicted alike in any batch, order and repetition; an empty table gives no rows; lang, source and
    other columns are never read.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bufs = texts(b)
            on = np.array(b.column("letters").to_pylist(), bool) & bool(model.langs)
            lang = np.full(len(bufs), "und", object)
            score, vague = np.zeros(len(bufs)), np.zeros(len(bufs), bool)
            at = np.flatnonzero(on)
            for i in range(0, len(at), 256):
                part = at[i : i + 256]
                x = profiles([bufs[j] for j in part])
                top, s, v = model.decode(model.margins(x) if len(model.langs) > 1 else x[:, :0])
                lang[part], score[part], vague[part] = np.array(model.langs, object)[top], np.round(s, 9), v
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(vague)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    read = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return read.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
