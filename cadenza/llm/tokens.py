"""Operator 9, token ids as length-delimited binary records.

A record is: length of the payload (8 bytes, little endian), masked checksum of those 8 bytes (4), the payload, masked
checksum of the payload (4).  The checksum is CRC-32 (zlib's), masked by rotating right by 15 bits and adding
0xA282EAD8, so that a checksum stored inside checked data does not check itself.  A payload is: flags (1 byte: 1 = the
document has an id, 2 = ids are 4 bytes wide, else 2), document id (8), ids.  Beside each data file lies an index file:
for each record its offset, its length in all, and the document id (8 bytes each), for reads in any order.

Texts are encoded word by word (runs without ASCII white space, which the tokenizer drops and never joins across): each
worker keeps the ids of words it has met, and of their letters and signs, and encodes only the others, in batches.

Scale: one range shuffle puts documents in order; each task writes one pair of files, through pyarrow's filesystems, into
a folder that all executors share.  File names hold a random part, and only the files named by a task that succeeded
enter the manifest (one row a file, written as Parquet), so a retried or doubled task leaves no trace.  Reading back is
one task a file, streamed record by record.

Defined cases: a null or empty text is the end id alone; a null id comes first and is flagged; equal ids are ordered by
XXH64 of the text, then by text; an empty table writes nothing; other columns are left behind.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import CHUNK_BYTES, kept, raw_text, shared_dir, text_batches

END_ID = 2
#: Words a worker remembers, and as many runs of letters or signs: about 350 bytes for one of each.
REMEMBERED = 450_000
MANIFEST = "part long, path string, index_path string, records long, ids long, bytes long"
_ENCODERS: dict[str, Encoder] = {}


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(read) -> Iterator[bytes]:
    """Payloads of a stream; read(n) gives n bytes.  Raises ValueError where a checksum or length is wrong."""
    while head := read(12):
        if len(head) < 12 or masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError("broken record length")
        n = struct.unpack("<Q", head[:8])[0]
        body = read(n + 4)
        if len(body) < n + 4 or masked_crc(body[:n]) != struct.unpack("<I", body[n:])[0]:
            raise ValueError("broken record")
        yield body[:n]


#: Latin letters and ASCII signs after them: a pre-token, or two with signs (an apostrophe may begin a contraction and is none).
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_SIMPLE = re.compile(f"([{_LETTERS}]+)([{_SIGNS}]*)").fullmatch
_GROUP = 2000


class Encoder:
    """ids of texts, as bytes of fixed width; remembers words.

    A vocabulary whose tokens mark the end of a word drops white space, so that texts can go word by word; with any
    other vocabulary whole texts go to the tokenizer."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        mark = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(size, dtype=bool)
        if mark:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(mark)]] = True
        self.by_word = bool(mark)
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        self.parted, self.lowers = self._habits() if mark else (False, False)
        self.remembered = remembered

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self._plain(texts)
        words, ends = [], [0]
        for t in texts:
            words += t.split()  # bytes.split() cuts at ASCII white space
            ends.append(len(words))
        known = self.known
        ids = list(map(known.get, words))  # one look into the large dictionary for each word
        new = [k for k, x in enumerate(ids) if x is None]
        if new:
            found = self._unseen({words[k] for k in new})
            for k in new:
                ids[k] = found[words[k]]
            if len(known) < self.remembered:
                known.update(found)
        return [b"".join(ids[a:b]) for a, b in pairwise(ends)]

    def _habits(self) -> tuple[bool, bool]:
        """Whether signs after letters are a pre-token of their own, and whether letters count as lower case."""
        every = [c for c in map(chr, range(256)) if re.fullmatch(f"[{_LETTERS}{_SIGNS}]", c)]
        letters, signs = "".join(c for c in every if c.isalpha()), "".join(c for c in every if not c.isalpha())
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        same = lambda t: normal.normalize_str(t) if normal else t
        added = any(_SIMPLE(t.content.strip()) for t in self.tokenizer.get_added_tokens_decoder().values())
        pieces = lambda t: len(cut.pre_tokenize_str(t)) if cut else 0
        parted = not added and same(signs) == signs and all(pieces(f"{c}{s}") == pieces(f"{c}{s}{signs}") == 2 for c in "aé" for s in signs)
        return parted, same(letters) == letters.lower()

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in found]

    def _unseen(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of a simple word are those of its letters, then those of its signs; each worker remembers both by themselves."""
        split, rest, parts = [], [], self.parts
        for w in words:
            m = _SIMPLE(w.decode("utf-8", "replace")) if self.parted else None
            if m is None:
                rest.append(w)
            else:
                split.append((w, m[1].lower() if self.lowers else m[1], m[2]))
        found = self._together(list({x for _, x, _ in split}.difference(parts)))
        signs = list({x for _, _, x in split}.difference(parts))
        found.update(zip(signs, self._plain([x.encode() for x in signs]), strict=True))
        parts.update(found)
        out = {w: parts[a] + parts[b] for w, a, b in split}
        out.update(zip(rest, self._plain(rest), strict=True))
        if len(parts) > self.remembered + len(found):  # it was full before
            for x in found:
                del parts[x]
        return out

    def _together(self, words: list[str]) -> dict[str, bytes]:
        """Words of one pre-token go as one text of many words, cut again after every word end."""
        out, width = {}, self.kind.itemsize
        for at in range(0, len(words), _GROUP):
            some = words[at : at + _GROUP]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=self.kind)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some) and cut[-1] == len(ids):
                raw, cut = ids.tobytes(), (cut * width).tolist()
                out.update(zip(some, (raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)), strict=True))
            else:
                out.update(zip(some, self._plain([w.encode() for w in some]), strict=True))
        return out


def _writer(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        gc.disable()  # millions of small objects and no cycles among them
        try:
            yield from write(batches)
        finally:
            gc.enable()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyarrow import fs
        from pyspark import TaskContext

        store = out = index = None
        encoder, at, records, ids = Encoder.at(path), 0, 0, 0
        part = TaskContext.get().partitionId()
        end, wide = np.array([end_id], dtype=encoder.kind).tobytes(), encoder.kind.itemsize == 4
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        for batch in text_batches(batches, 2 * CHUNK_BYTES):
            if store is None:
                store, base = fs.FileSystem.from_uri(folder)
                store.create_dir(base, recursive=True)
                base = f"{base}/{name.rsplit('/', 1)[1]}"
                out, index = store.open_output_stream(f"{base}.rec"), store.open_output_stream(f"{base}.idx")
            body, off = raw_text(batch.column("text"))
            body = body.tobytes()
            texts = [body[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            lines = []
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                record = frame(struct.pack("<Bq", (doc_id is not None) + 2 * wide, doc_id or 0) + x + end)
                lines.append(struct.pack("<QQq", at, len(record), doc_id or 0))
                out.write(record)
                at += len(record)
                records += 1
                ids += len(x) // encoder.kind.itemsize + 1
            index.write(b"".join(lines))
        if store is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{name}.rec"], "index_path": [f"{name}.idx"], "records": [records], "ids": [ids], "bytes": [at]})

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, order: list[str] | None = None) -> DataFrame:
    """Write docs (doc_id long, text) in ascending order of ``order`` (default: doc_id), then of XXH64 of the text and of the
    text, and return the manifest: MANIFEST, a row for each data file, parts in order."""
    folder = folder or shared_dir(docs.sparkSession, "tokens")
    order = order or ["doc_id"]
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *[c for c in order if c not in ("doc_id", "text")])
    docs = docs.withColumn("_hash", F.xxhash64("text"))  # so that rows of one id need not be one range
    ranged = docs.repartitionByRange(*order, "_hash").sortWithinPartitions(*dict.fromkeys([*order, "_hash", "text"])).drop("_hash")
    return kept(ranged.mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST), "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for row in batch.to_pylist():
            store, path = fs.FileSystem.from_uri(row["path"])
            start, rows = row["before"], []
            with store.open_input_stream(path, buffer_size=4 << 20) as f:
                for payload in unframe(f.read):
                    flags, doc_id = struct.unpack("<Bq", payload[:9])
                    ids = np.frombuffer(payload, dtype="<u4" if flags & 2 else "<u2", offset=9)
                    rows.append((doc_id if flags & 1 else None, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 8192:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """READ: of each record of the files, checksums verified; start counts the ids of all records before it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.select("part", "path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    n = max(1, manifest.count())
    return files.repartition(n).mapInArrow(_reader, READ)


def read_at(spark: SparkSession, path: str, offset: int, length: int) -> tuple[int | None, np.ndarray]:
    """One record, found by the index: its document id and ids."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        f.seek(offset)
        payload = next(unframe(f.read))
    flags, doc_id = struct.unpack("<Bq", payload[:9])
    return doc_id if flags & 1 else None, np.frombuffer(payload, dtype="<u4" if flags & 2 else "<u2", offset=9)
