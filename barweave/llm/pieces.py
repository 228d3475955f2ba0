"""SentencePiece (merge type) encoding and decoding by a prefix table.

The encoding of a text is the only token sequence in which every neighbouring pair is
compatible, i.e. would be encoded as these two tokens on its own. So each prefix has one last token:
among the vocabulary matches that end at a position, the one compatible with the last token of
what precedes it. One automaton pass fills the table; the ids are read backwards from its end.
Texts are cut where no piece can cross (before a run of spaces, and between characters that have neighbours in pieces and others), and encoded chunks are kept in a
bounded memo, as words repeat.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

SPACE = "▁"
#: Most chunks that a worker remembers; later ones are encoded each time.
MEMO = 100_000
#: Most pairs of tokens whose compatibility a worker remembers before it starts afresh.
PAIRS = 200_000
#: Rows of an output batch.
ROWS = 256
#: Stands for no token.
START = (1 << 24) - 1


def _fields(message: bytes):
    """(number, value) of a protobuf message: integers for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = message[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, message[at : at + size]
        at += size


def settings(model: bytes) -> dict[str, int | bool]:
    """What the codec relies on, by field numbers of the model format: type, byte fallback, white space rules, character map."""
    parts = {n: dict(_fields(v)) for n, v in _fields(model) if n in (2, 3)}
    trainer, normalizer = parts.get(2, {}), parts.get(3, {})
    return {
        "merge_type": trainer.get(3, 1) == 2, "byte_fallback": bool(trainer.get(35, 0)), "space_is_prefix": not trainer.get(24, 0),
        "identity": not normalizer.get(2, b""), "dummy_prefix": bool(normalizer.get(3, 1)), "keeps_spaces": not normalizer.get(4, 1), "escapes_spaces": bool(normalizer.get(5, 1)),
    }


class PieceCodec:
    """Encoder and decoder of a merge-type model with byte fallback and identity normaliser."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if missing := [k for k, v in settings(sp.serialized_model_proto()).items() if not v]:
            raise ValueError(f"the model lacks what this codec relies on: {', '.join(missing)}")
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.piece: list[bytes] = []
        for i in range(sp.vocab_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
                self.piece.append(bytes([int(p[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.piece.append(b"")
            else:
                self.id[p], self.score[p] = i, sp.get_score(i)
                self.piece.append(p.encode())
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("the model has pieces across words")
        self.auto = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.auto.add_word(p, (i, len(p)))
        self.auto.make_automaton()
        self.vocab = list(map(sp.id_to_piece, range(sp.vocab_size())))
        #: Whether a token may follow another, by the id of the first and of the second; START: whether it stands first.
        self.fits: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.size, self.names = list(map(len, self.vocab)), list(map(str, range(len(self.vocab))))
        # characters that have a neighbour in some piece; a piece crosses no border of a run of them, or of a run of others
        inner = "".join(sorted({x for p in self.id if len(p) > 1 for x in p} - {SPACE}))
        own = f"[{re.escape(inner)}]+" if inner else "(?!)"
        self.chunks = re.compile(f"{SPACE}*{own}|{SPACE}+|[^{SPACE}{re.escape(inner)}]+").findall
        #: Place of a piece in the order of merging (equal scores share one); the last merge that makes a piece, None if it isn't encoded as itself.
        place = {x: i for i, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank: dict[str, int] = {p: place[x] for p, x in self.score.items()}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.memo: dict[str, str] = {}
        self.by_text = {str(i): p for i, p in enumerate(self.piece)}

    def merged(self, text: str, log: list | None = None) -> list[str]:
        """The pieces of a short string by merging the best pair, leftmost first, until none is left; ``log`` takes the merges."""
        left, right = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        part: list[str | None] = list(text)
        queue: list = []

        def offer(i: int, j: int):
            if i >= 0 and j < len(part) and (s := self.score.get(both := part[i] + part[j])) is not None:
                heapq.heappush(queue, (-s, i, j, both))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if part[i] is None or part[j] is None or right[i] != j or part[i] + part[j] != both:
                continue
            if log is not None:
                log.append((part[i], part[j]))
            part[i], part[j] = both, None
            right[i] = right[j]
            if right[j] < len(part):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in part if p is not None]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts that a piece of several characters is merged from last; None if it isn't encoded as itself."""
        if piece not in self.halves:
            log: list[tuple[str, str]] = []
            self.halves[piece] = log[-1] if self.merged(piece, log) == [piece] else None
        return self.halves[piece]

    def apart(self, x: str, y: str) -> bool:
        """Whether two pieces, each encoded as itself, stay as they are side by side. Their merges are undone from the last one on:
        they would have been joined if parts that once stood at the border make a piece that comes before the merge just undone
        (leftmost first, so also before an equal one to the right)."""
        rank, limit = self.rank, len(self.rank) + 1
        while True:
            joined = rank.get(x + y)
            if joined is not None and joined < limit:
                return False
            a, b = rank[x] if len(x) > 1 else -1, rank[y] if len(y) > 1 else -1
            if a > b:
                limit, x = a, self.split(x)[1]
            elif b >= 0:
                limit, y = b + 1, self.split(y)[0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow ``a``; a may be START (nothing, or a character that no piece holds)."""
        y = self.vocab[b]
        whole = len(y) == 1 or self.split(y) is not None
        self.pairs += 1
        hit = self.after(a)[b] = whole and (a == START or self.apart(self.vocab[a], y))
        return hit

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a chunk, spaces written as SPACE."""
        # last[e]: the last token of the prefix of e characters; START at 0 and after a character outside the vocabulary
        size_of = len(chunk)
        last: list[int | None] = [START] + [None] * size_of
        # after[e]: what is known of the tokens that may follow it
        after: list[dict[int, bool] | None] = [self.after(START)] + [None] * size_of
        for end, (token, size) in self.auto.iter(chunk):
            end += 1
            if last[end] is not None:
                continue
            known = after[end - size]
            if known is None:  # no piece ends there
                last[end - size] = START
                known = after[end - size] = after[0]
            hit = known.get(token)
            if self.compatible(last[end - size], token) if hit is None else hit:
                last[end] = token
                after[end] = self.after(token)
        back: list[int] = []
        at = size_of
        while at:
            token = last[at]
            if token is None or token == START:
                back.extend(self.byte[x] for x in reversed(chunk[at - 1].encode()))
                at -= 1
            else:
                back.append(token)
                at -= self.size[token]
        return back[::-1]

    def after(self, token: int) -> dict[int, bool]:
        """Whether tokens may follow ``token``, as far as known."""
        known = self.fits.get(token)
        if known is None:
            known = self.fits[token] = {}
        return known

    def encode_text(self, text: str) -> str:
        """Ids in decimal, joined by commas."""
        if not text:
            return ""
        chunks = self.chunks(SPACE + text.replace(" ", SPACE))
        out = list(map(self.memo.get, chunks))
        try:
            return ",".join(out)
        except TypeError:  # a chunk that is not remembered
            pass
        memo, names = self.memo, self.names
        for i, ids in enumerate(out):
            if ids is None:
                c = chunks[i]
                out[i] = ids = memo.get(c) or ",".join([names[x] for x in self.chunk_ids(c)])
                if len(c) <= 64 and len(memo) < MEMO:
                    memo[c] = ids
                if self.pairs > PAIRS:
                    self.fits.clear()
                    self.pairs = 0
        return ",".join(out)

    def decode_text(self, ids: str) -> str:
        """The text of joined ids: pieces and bytes put together, SPACE read as a space, the leading one dropped."""
        if not ids:
            return ""
        return b"".join(map(self.by_text.__getitem__, ids.split(","))).decode("utf-8", "replace").replace(SPACE, " ")[1:]


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The worker's codec of a model file (every worker must be able to open the path)."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids array<int>) per row of ``docs``.

    Defined cases: null and empty text have no tokens and decode to the empty string; repeated rows
    are encoded alike; an empty table gives no rows; further columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in slices(batches, ROWS):
            encoded = [c.encode_text(t.decode()) if t else "" for t in texts(part)]
            n = [s.count(",") + 1 if s else 0 for s in encoded]
            columns = {
                "doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(s.encode()).hexdigest() for s in encoded], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(c.decode_text(s).encode()).hexdigest() for s in encoded], pa.string()),
            }
            if with_ids:
                ids = np.array(",".join(filter(None, encoded)).split(",") if any(n) else [], np.int32)
                columns["ids"] = pa.ListArray.from_arrays(np.cumsum([0, *n], dtype=np.int32), ids)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (doc_id, ids) as doc_id, text; null ids give null."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else c.decode_text(",".join(map(str, x))) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", F.col("ids")).mapInArrow(run, f"doc_id {kind}, text string")
