"""Operator 10, Lempel-Ziv phrase fingerprints.

A text is parsed from left to right into phrases: each is the longest one already in the dictionary and one more code
point, and enters the dictionary.  The set of phrases is hashed (upper half of XXH64) and the ``size`` smallest hashes
are the fingerprint, 8 hex digits each, ascending.  The likeness of two fingerprints is the share of the ``size``
smallest hashes of both together that are in both: an estimate of the Jaccard index of the phrase sets, exact where both
sets are no larger than ``size``.  Texts that share long passages share phrases, as they would compress well together.

One dictionary serves a whole text, of any length: about a hundred bytes for each of its phrases, which are some n / log n for
n code points, held for one text and the one before it.  A parse can be forked, so an edited text that shares its
beginning is parsed from where it differs.

Scale: one shuffle by ranges of doc_id and, where ids repeat, of a hash of the text.  Each task walks its sorted rows, each row meeting the next; of each task only
the first and the last row (texts and all) are left to a second, small pass that joins every last row with the first
row of the next range.  No window and no sort takes the whole table, and nothing goes to the driver.

Defined cases: a null text is an empty one, which has the empty fingerprint; two empty fingerprints have likeness 1, an
empty and another 0; equal ids are ordered by XXH64 of the text, then by text; in a table of one row the next document is the row itself; rows
with a null id come first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cadenza.llm.common import kept, text_batches

SIZE = 64
RESULT = "doc_id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double"
ROWS, FIRST, LAST = 0, 1, 2


class Parse:
    """A parse under way; feed() goes on with it."""

    __slots__ = ("known", "fresh", "hashes", "open", "size")

    def __init__(self, size: int = SIZE):
        self.known: set[str] = set()
        self.fresh: list[str] = []  # phrases whose hashes are not yet in hashes
        self.hashes = np.zeros(0, dtype=np.uint32)
        self.open, self.size = "", size

    def fork(self) -> Parse:
        x = Parse(self.size)
        x.hashes, x.known, x.open = self.signature(), set(self.known), self.open
        return x

    def feed(self, text: str) -> Parse:
        known, phrase = self.known, self.open
        learn, note = known.add, self.fresh.append
        for c in text:
            phrase += c
            if phrase not in known:
                learn(phrase)
                note(phrase)
                phrase = ""
        self.open = phrase
        return self

    def signature(self) -> np.ndarray:
        """The fingerprint so far; an unfinished phrase equals one that is known already."""
        if self.fresh:
            new = np.fromiter(map(xxh64_intdigest, self.fresh), dtype=np.uint64, count=len(self.fresh)) >> np.uint64(32)
            self.hashes = np.unique(np.concatenate((self.hashes, new.astype(np.uint32))))[: self.size]
            self.fresh = []
        return self.hashes


def signature(text: str, size: int = SIZE) -> np.ndarray:
    return Parse(size).feed(text).signature()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:size]
    return float((np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)).sum() / len(both))


def packed(a: np.ndarray) -> bytes:
    return a.astype(">u4").tobytes()


class Edited:
    """A text, its fingerprint, and the parse of the part that an edit keeps."""

    def __init__(self, doc_id: int | None, text: str, size: int):
        self.doc_id, self.text, self.size = doc_id, text, size
        self.keep = len(text) - len(text) // 2
        self.half = Parse(size).feed(text[: self.keep])
        self.fp = self.half.fork().feed(text[self.keep :]).signature()

    def meet(self, after: Edited) -> tuple:
        """RESULT of this text, once: its kept parse is used up."""
        put = after.text[: len(self.text) // 2]
        edited = self.half.feed(put).signature()
        whole = hashlib.sha256((self.text[: self.keep] + put).encode()).hexdigest()
        return self.doc_id, len(self.text), whole, packed(self.fp), packed(edited), likeness(self.fp, edited, self.size), likeness(self.fp, after.fp, self.size)


TYPES = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _batch(rows: list[tuple], extra: list[tuple[str, pa.DataType]] = ()) -> pa.RecordBatch:
    kinds = [*TYPES, *[x[1] for x in extra]]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*NAMES, *[x[0] for x in extra]])


EXTRA = [("kind", pa.int32()), ("part", pa.int64()), ("text", pa.string())]


def _walk(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        bare = (None,) * 6
        for batch in text_batches(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                now = Edited(doc_id, text, size)
                if last is None:
                    out.append((doc_id, *bare, FIRST, part, text))
                else:
                    out.append((*last.meet(now), ROWS, part, None))
                last = now
            if out:
                yield _batch(out, EXTRA)
        if last is not None:
            yield _batch([(last.doc_id, *bare, LAST, part, last.text)], EXTRA)

    return run


def _meet(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, after in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "after")], strict=True):
                yield _batch([Edited(doc_id, text, size).meet(Edited(None, after, size))])

    return run


def next_compared(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = docs.withColumn("order", F.xxhash64("text"))
    ranged = docs.repartitionByRange("doc_id", "order").sortWithinPartitions("doc_id", "order", "text").select("doc_id", "text")
    walked = kept(ranged.mapInArrow(_walk(size), RESULT + ", kind int, part long, text string"), "lz")
    # two rows a task: the last row of a range meets the first row of the next range that has rows
    order = Window.orderBy("part")
    parts = walked.where(F.col("kind") == FIRST).select("part")
    parts = parts.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next_part"))
    last = walked.where(F.col("kind") == LAST).select("part", "doc_id", "text")
    first = walked.where(F.col("kind") == FIRST).select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    ends = last.join(parts, "part").join(first, "next_part").select("doc_id", "text", "after").mapInArrow(_meet(size), RESULT)
    every = walked.where(F.col("kind") == ROWS).select(*NAMES).unionByName(ends)
    digits = lambda c: F.lower(F.hex(c))
    return every.select("doc_id", "n_chars", "edited_sha256", digits("fp").alias("fingerprint"), digits("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")
