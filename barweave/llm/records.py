"""Token ids as length-delimited binary records.

A record is: payload length (u64), masked crc32 of these 8 bytes (u32), payload, masked crc32 of the
payload (u32), all little-endian; a payload is whether there is a doc_id (u8), doc_id (i64), the bytes per id
(u8: 2 if the vocabulary is under 65,536, else 4) and the ids. Beside each
data file stands an index of (offset u64, has doc_id u8, doc_id i64, ids u64) per record, so that a shuffled reader
can seek. Documents are range-partitioned by doc_id and hash of the text: file after file, record after record
is ascending, rows without doc_id first. A task writes under a name of its own attempt and reports it, so a repeated task
never mixes with a lost one.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, texts, written

#: Most words that a worker remembers; later ones are encoded each time.
MEMO = 1_200_000
#: Layout of an index entry: offset, whether there is a doc_id, doc_id, number of ids; of a payload before its ids.
INDEX, HEAD = "<Q?qQ", "<?qB"
#: Bytes of text for one file, beyond one file for every shuffle partition.
FILE_BYTES = 256 << 20


def masked(data: bytes) -> int:
    """crc32 rotated and offset, so that a checksum of checksums stays sound."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframed(f) -> bytes | None:
    """The next payload of a file, None at its end; raises ValueError if a checksum is wrong."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("record length is damaged")
    size = struct.unpack("<Q", head[:8])[0]
    body = f.read(size + 4)
    if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
        raise ValueError("record is damaged")
    return body[:size]


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id (or None) and u32 ids of a payload."""
    known, doc_id, width = struct.unpack(HEAD, payload[:10])
    return doc_id if known else None, np.frombuffer(payload[10:], f"<u{width}").astype("<u4")


class WordIds:
    """Ids of whole texts by the tokenizer, word by word: its normaliser and splitter never join
    over ASCII white space, and no added token holds or takes in any, so words are encoded once and remembered."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        # Spark's tasks are the threads: the library's own take twice the CPU time for the same words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        for token in self.tok.get_added_tokens_decoder().values():
            if token.lstrip or token.rstrip or len(token.content.split()) != 1 or token.content.strip() != token.content:
                raise ValueError(f"added token {token.content!r} takes in white space")
        self.width = 2 if self.tok.get_vocab_size() < 1 << 16 else 4
        self.memo: dict[bytes, bytes] = {}

    def encode_all(self, bufs: list[bytes | None]) -> list[bytes]:
        """Little-endian ids of every text, without end ids."""
        words = [t.split() if t else [] for t in bufs]
        memo, pack = self.memo, {2: "<%dH", 4: "<%dI"}[self.width]
        found = [list(map(memo.get, ws)) for ws in words]
        out: list[bytes | None] = []
        for ids in found:
            try:
                out.append(b"".join(ids))
            except TypeError:  # a word that is not remembered
                out.append(None)
        gaps = {i: [j for j, x in enumerate(found[i]) if x is None] for i, x in enumerate(out) if x is None}
        new = list({words[i][j] for i, at in gaps.items() for j in at})
        fresh = {}
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for w, e in zip(part, self.tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                fresh[w] = struct.pack(pack % len(e.ids), *e.ids)
        for i, at in gaps.items():
            for j in at:
                found[i][j] = fresh[words[i][j]]
            out[i] = b"".join(found[i])
        if len(memo) + len(fresh) <= MEMO:
            memo.update(fresh)
        return out


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The worker's encoder of a vocabulary file (every worker must be able to open the path)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, files: int | None = None) -> DataFrame:
    """Write all rows of ``docs`` (doc_id, text) below ``folder`` (a URI that all executors reach);
    a written table of file, seq, records, ids."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    if files is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        seq = TaskContext.get().partitionId()
        name = f"{seq:06d}-{uuid.uuid4().hex}"
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        records = ids = 0
        offset, tail = 0, end_id.to_bytes(enc.width, "little")
        with fs.open_output_stream(f"{root}/{name}.rec") as data, fs.open_output_stream(f"{root}/{name}.idx") as index:
            for b in batches:
                col = b.column("doc_id").to_pylist()
                bufs = texts(b)
                for at in range(0, len(bufs), 512):
                    for doc_id, own in zip(col[at : at + 512], enc.encode_all(bufs[at : at + 512]), strict=True):
                        known = doc_id is not None, doc_id or 0
                        r = framed(struct.pack(HEAD, *known, enc.width) + own + tail)
                        data.write(r)
                        n = len(own) // enc.width + 1
                        index.write(struct.pack(INDEX, offset, *known, n))
                        offset, records, ids = offset + len(r), records + 1, ids + n
        if records:
            yield pa.RecordBatch.from_pylist([{"file": name, "seq": seq, "records": records, "ids": ids}])

    # the hash splits a doc_id (or none) that many rows have
    dealt = rows.repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return written(dealt.mapInArrow(run, "file string, seq long, records long, ids long"), "record_files")


_DIGEST = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read back from the files with all checksums verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        for b in batches:
            for f in b.to_pylist():
                at, start, rows = 0, f["before"], []
                with fs.open_input_stream(f"{root}/{f['file']}.idx") as i:
                    index = list(struct.iter_unpack(INDEX, i.read()))
                with fs.open_input_stream(f"{root}/{f['file']}.rec") as d:
                    for offset, known, doc_id, n in index:
                        payload = unframed(d)
                        if payload is None:
                            raise ValueError(f"{f['file']} has fewer records than its index")
                        doc_id = doc_id if known else None
                        own, ids = parsed(payload)
                        if offset != at or own != doc_id or len(ids) != n:
                            raise ValueError(f"{f['file']} and its index differ")
                        rows.append({"doc_id": doc_id, "start": start, "n_tokens": n, "ids_crc32": zlib.crc32(ids.tobytes())})
                        at, start = at + len(payload) + 16, start + n
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_DIGEST)
                            rows = []
                    if unframed(d) is not None:
                        raise ValueError(f"{f['file']} has records beyond its index")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_DIGEST)

    up = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = manifest.select("file", "seq", F.coalesce(F.sum("ids").over(up), F.lit(0)).alias("before"))
    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(parts, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_at(folder: str, file: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by the offset from its index, for shuffled reads: doc_id and ids."""
    fs, root = _fs(folder)
    with fs.open_input_file(f"{root}/{file}.rec") as f:
        f.seek(offset)
        payload = unframed(f)
    return parsed(payload)


def binary_output(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the records of ``docs`` to a new folder in the shared directory and give their digest rows.

    Defined cases: null and empty text give a record with the end id only; rows without doc_id come first;
    rows that share a doc_id, or have none, are ordered by hash of their text; repeated rows are separate
    records; an empty table gives no files and no rows; further columns are ignored. Special tokens
    in a text are encoded as the library does by default.
    """
    folder = f"{shared_dir(docs.sparkSession)}/records-{uuid.uuid4().hex}"
    return read_records(write_records(docs, folder, tokenizer, end_id), folder)
