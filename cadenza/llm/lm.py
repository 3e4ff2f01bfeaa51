"""Operator 2, language-model scores from a log-frequency Bloom filter.

Counts of words, of word pairs, and of the different words seen after a word are quantised to levels that grow by
``RATIO``; a count of level q puts the keys (n-gram, 1) to (n-gram, q) into a Bloom filter, and the first of them that
is missing tells the level back.  From the levels' mean values comes Witten and Bell's interpolation of pairs with add-one words:
p(w | v) = (c(v w) + t(v) p(w)) / (c(v) + t(v)), t(v) being the number of different words after v, and p(w) alone after
a word never seen.  A text is its words and one end token, which also stands before its first word.

The filter is cut into segments by the first bits of an n-gram's hash (its bucket); 32 further bits of the hash, with the
level, choose a block of 64 bits in the segment and ``PROBES`` bits of the block, so that a probe reads memory once.

Scale: each task counts its own rows by sorting hashes in bounded runs and sends one packed array for each run and
bucket; hashes spread every word's pairs over all buckets, so a frequent word makes no large one.  The number of
buckets follows the bytes of text without a bound.  Filter and exact word counts are broadcast while they take at most
``broadcast_bytes``.  Beyond that the texts, in chunks of about ``ROUTED_BYTES``, are dealt out once; each chunk sends its
different keys to the segment of their bucket, which is probed there, and gets the levels back: the same filter, the
same levels and the same scores at every size.  A word that is in every chunk is asked for once a chunk.

Defined cases: a null or empty text is the end token alone; repeated rows count and score as often as they come; with no
training row every c, N and V is 0 and scores are 0; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import CHUNK_BYTES, SPACED, Words, crc_mod, kept, mix, raw_text, text_batches

RATIO, BITS, PROBES = 1.25, 8, 4
RUN_TOKENS, BUCKET_GRAMS, BROADCAST_BYTES = 3 << 19, 1 << 20, 256 << 20
ROUTED_BYTES = 4 * CHUNK_BYTES  # text that asks for its different keys at once; more asks for fewer keys in all
WORD, PAIR, AFTER = 0, 1, 2
END = np.uint64(0x5851F42D4C957F2D)
U32, LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def _levels() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out, dtype=np.int64)


LEVELS = _levels()
#: Of level q (from 1) the mean of its least and greatest count; of level 0 nothing.
VALUES = np.concatenate(([0.0], (LEVELS[:-1] + (LEVELS[1:] - 1)) / 2))


def level_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(LEVELS, count, side="right"), len(VALUES) - 1)


def unmix(x: np.ndarray) -> np.ndarray:
    """Inverse of mix()."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    return x ^ (x >> np.uint64(33))


def tokens(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with an end after each text, the hashes before them, first place of each text and one more)."""
    words = Words(body, off, SPACED)
    first = words.first + np.arange(len(words.first))
    out = np.empty(len(words.hash) + len(first) - 1, dtype=np.uint64)
    ends = first[1:] - 1
    inner = np.ones(len(out), dtype=bool)
    inner[ends] = False
    out[inner] = words.hash
    out[ends] = END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[first[:-1]] = END
    return out, before, first


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix((before & ~LOW) | (word >> U32))


def after_key(word: np.ndarray) -> np.ndarray:
    return mix(word >> U32)


# ---- packed arrays


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys: the bytes of a step, the first key, and the steps in as few bytes each as the widest needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = (int(steps.max(initial=0)).bit_length() + 7) // 8
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    first, rest = np.frombuffer(data, dtype="<u8", count=1, offset=1), np.frombuffer(data, dtype=np.uint8, offset=9)
    if not len(rest):
        return first.copy()
    steps = np.zeros((len(rest) // data[0], 8), dtype=np.uint8)
    steps[:, : data[0]] = rest.reshape(-1, data[0])
    return np.cumsum(np.concatenate((first, steps.view("<u8").ravel())), dtype=np.uint64)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the greatest needs: 1, 2, 4 or 8."""
    most = int(counts.max(initial=0))
    return counts.astype(f"<u{next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)}").tobytes()


def _wide(counts: bytes, n: int) -> np.ndarray:
    return np.frombuffer(counts, dtype=f"<u{len(counts) // n if n else 8}").astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The first bits of a hash; buckets is a power of two."""
    return keys >> np.uint64(65 - buckets.bit_length()) if buckets > 1 else np.zeros(len(keys), dtype=np.uint64)


def address(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Of pairs and continuations all that a probe needs: the bucket and, in the lower half, 32 bits of the hash."""
    return (bucket_of(keys, buckets) << U32) | (keys & LOW)


def _spans(bucket: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal buckets."""
    if not len(bucket):
        return []
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist()
    return list(zip(first, [*first[1:], len(bucket)], strict=True))


# ---- counts


def _cut(kind: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket that has keys; keys are sorted."""
    bucket = bucket_of(keys, buckets)
    spans = _spans(bucket)
    columns = [pa.array([kind] * len(spans), pa.int32()), pa.array([int(bucket[a]) for a, _ in spans], pa.int64())]
    columns += [pa.array([_packed(keys[a:b]) for a, b in spans], pa.binary()), pa.array([_narrow(counts[a:b]) for a, b in spans], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "bucket", "keys", "counts"])


def _tally(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different hashes and how often each comes; empties parts, so that a run is held once."""
    x = np.concatenate(parts)
    parts.clear()
    x.sort()
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return x[first], np.diff(first, append=len(x))


COUNTED = "kind int, bucket long, keys binary, counts binary"


def _count(buckets: int, run_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, n = [], [], 0
        for batch in text_batches(batches, CHUNK_BYTES // 2):
            word, before, _ = tokens(*raw_text(batch.column("text")))
            words.append(word)
            pairs.append(pair_key(before, word))
            n += len(word)
            if n >= run_tokens:
                yield _cut(WORD, *_tally(words), buckets)
                yield _cut(PAIR, *_tally(pairs), buckets)
                n = 0
                pa.default_memory_pool().release_unused()
        if n:
            yield _cut(WORD, *_tally(words), buckets)
            yield _cut(PAIR, *_tally(pairs), buckets)

    return run


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    each = [(k := _unpacked(x), _wide(c, len(k))) for x, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True)]
    keys, counts = np.concatenate([x[0] for x in each]), np.concatenate([x[1] for x in each])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


# ---- filter


def _probed(keys: np.ndarray, j: int, size: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Of (key, j) the block, of ``size`` blocks of the segment, and its bits in that block."""
    h = mix((keys & LOW) | np.uint64(j << 32))
    bits = np.uint64(1) << (h & np.uint64(63))
    for i in range(1, PROBES):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return ((h >> U32) * size) >> U32, bits


def segment(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter of some n-grams."""
    level = level_of(counts)
    blocks = max(1, -(-int(level.sum()) * BITS // 64))
    data = np.zeros(blocks, dtype=np.uint64)
    for j in range(1, int(level.max(initial=0)) + 1):
        at, bits = _probed(keys[level >= j], j, np.uint64(blocks))
        np.bitwise_or.at(data, at.astype(np.int64), bits)
    return data.astype("<u8").tobytes()


def levels(data: np.ndarray, keys: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Repeated probes: how many of (key, 1), (key, 2), ... are in a row there.  A key's segment has ``size`` blocks from
    ``place`` on."""
    out = np.zeros(len(keys), dtype=np.int64)
    at, j = np.flatnonzero(size), 0
    keys, place, size = keys[at], place[at], size[at]
    while len(at) and j < len(VALUES) - 1:
        j += 1
        block, bits = _probed(keys, j, size)
        hit = (data[(place + block).astype(np.int64)] & bits) == bits
        at, keys, place, size = at[hit], keys[hit], place[hit], size[hit]
        out[at] = j
    return out


REDUCED = COUNTED + ", segment binary, grams long, total long"
_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in REDUCED.split(", ")]


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def _reduce(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Of words the segment and the exact counts; of pairs the segment and, as kind -1, the words that stand first."""
        kind, bucket = key[0].as_py(), key[1].as_py()
        keys, counts = _summed(table)
        own = (_packed(keys), _narrow(counts)) if kind == WORD else (None, None)
        rows = [(kind, bucket, *own, segment(keys, counts), len(keys), int(counts.sum()))]
        if kind == PAIR:
            word, n = np.unique(unmix(keys) >> U32, return_counts=True)
            after = mix(word)
            order = np.argsort(after)
            part = _cut(AFTER, after[order], n[order], buckets)
            rows += [(-1, b, k, c, None, None, None) for b, k, c in zip(*[part.column(x).to_pylist() for x in ("bucket", "keys", "counts")], strict=True)]
        return _rows(rows)

    return run


def _reduce_after(key: tuple, table: pa.Table) -> pa.Table:
    keys, counts = _summed(table)
    return _rows([(AFTER, key[0].as_py(), None, None, segment(keys, counts), len(keys), int(counts.sum()))])


class Filter:
    """All segments, by kind and bucket, and the exact counts of words."""

    def __init__(self, rows: Iterator, buckets: int, blocks: int, n_words: int):
        """blocks, n_words: of all segments and of all words, so that every array is made once, as large as it has to be."""
        self.buckets, self.place, self.size = buckets, np.zeros((3, buckets), dtype=np.uint64), np.zeros((3, buckets), dtype=np.uint64)
        self.data, words, at = np.empty(blocks, dtype="<u8"), [], 0
        for r in rows:
            part = np.frombuffer(r["segment"], dtype="<u8")
            self.place[r["kind"], r["bucket"]], self.size[r["kind"], r["bucket"]] = at, len(part)
            self.data[at : at + len(part)] = part
            at += len(part)
            if r["kind"] == WORD:
                words.append((r["bucket"], bytes(r["keys"]), bytes(r["counts"])))
        words.sort(reverse=True)
        self.words, self.counts, at = np.empty(n_words, dtype="<u8"), np.empty(n_words, dtype="<i8"), 0
        while words:  # buckets in order are keys in order
            _, k, c = words.pop()
            keys = _unpacked(k)
            self.words[at : at + len(keys)], self.counts[at : at + len(keys)] = keys, _wide(c, len(keys))
            at += len(keys)
        if n_words and self.counts.max() < 1 << 32:
            self.counts = self.counts.astype("<u4")

    def level(self, kind: int, keys: np.ndarray) -> np.ndarray:
        bucket = bucket_of(keys, self.buckets).astype(np.int64)
        return levels(self.data, keys, self.place[kind][bucket], self.size[kind][bucket])

    def exact(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted words."""
        if not len(self.words):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return np.where(self.words[at] == keys, self.counts[at], 0).astype(np.int64)


# ---- scores


def smoothed(pair, before, after, word, size):
    """p(word | before) from counts; size: N + V + 1."""
    p = (word + 1) / size
    pair = np.minimum(pair, before)
    return np.where((before > 0) & (after > 0), (pair + after * p) / np.maximum(before + after, 1), p)


def _scores(batch: pa.RecordBatch, model: Filter | Answers, n: int, v: int) -> pa.RecordBatch:
    size = n + v + 1
    word, before, first = tokens(*raw_text(batch.column("text")))
    pairs, which = np.unique(pair_key(before, word), return_inverse=True)
    del before
    pair = VALUES[model.level(PAIR, pairs)][which]
    del pairs, which
    keys, at = np.unique(word, return_inverse=True)
    exact = model.exact(keys)
    base = np.log10((exact + 1) / size)
    about = VALUES[model.level(WORD, keys)]
    after = VALUES[model.level(AFTER, after_key(keys))]
    prev = np.empty_like(at)
    prev[1:] = at[:-1]
    prev[first[:-1]] = int(np.searchsorted(keys, END))
    p = np.log10(smoothed(pair, about[prev], after[prev], about[at], size))
    add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has its end token
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(first), pa.int64()), pa.array(add((exact > 0).astype(np.int64)[at]), pa.int64()), pa.array(np.full(len(first) - 1, n), pa.int64()), pa.array(add(base[at]), pa.float64()), pa.array(add(p) if n else np.zeros(len(first) - 1), pa.float64())], names=SCORED_NAMES)


def _score(sent, n: int, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier stages left in this worker
        for batch in text_batches(batches, CHUNK_BYTES):
            yield _scores(batch, sent.value, n, v)

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORED_NAMES = [x.split()[0] for x in SCORED.split(", ")]


# ---- scores where the filter is too large to be broadcast


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their chunk, of about ROUTED_BYTES of text."""
    from pyspark import TaskContext

    chunk, used = TaskContext.get().partitionId() << 32, 0
    for batch in text_batches(batches, CHUNK_BYTES):
        size = int(raw_text(batch.column("text"))[1][-1]) + batch.num_rows
        if used and used + size > ROUTED_BYTES:
            chunk, used = chunk + 1, 0
        used += size
        yield pa.RecordBatch.from_arrays([pa.array([chunk] * batch.num_rows, pa.int64()), *[batch.column(c) for c in ("doc_id", "held_out", "text")]], names=["chunk", "doc_id", "held_out", "text"])


ASKED = "chunk long, kind int, bucket long, keys binary"
ANSWERED = "chunk long, kind int, bucket long, levels binary, counts binary"


def _asked(kind: int, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """What is asked for, ascending, and its buckets: words by their whole hash, for their exact counts, others by address."""
    own = np.unique(keys if kind == WORD else address(keys, buckets))
    return own, (bucket_of(own, buckets) if kind == WORD else own >> U32)


def _ask(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The different keys of a chunk, a row for each bucket."""
        word, before, _ = tokens(*raw_text(table.column("text").combine_chunks()))
        rows = []
        words = np.unique(word)
        for kind, keys in ((WORD, words), (PAIR, pair_key(before, word)), (AFTER, after_key(words))):
            own, bucket = _asked(kind, keys, buckets)
            rows += [(key[0].as_py(), kind, int(bucket[a]), _packed(own[a:b])) for a, b in _spans(bucket)]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["chunk", "kind", "bucket", "keys"])

    return run


def _answer(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
    """Levels, and of words the exact counts, of what the chunks ask of a bucket."""
    kind, bucket, model = key[0].as_py(), key[1].as_py(), held.to_pylist()
    data = np.frombuffer(model[0]["segment"], dtype="<u8") if model else np.zeros(0, dtype=np.uint64)
    have = _unpacked(model[0]["keys"]) if model and kind == WORD else np.zeros(0, dtype=np.uint64)
    exact = _wide(model[0]["counts"], len(have)) if len(have) else None
    found, counted = [], []
    for x in asked.column("keys"):
        keys = _unpacked(x.as_py())
        found.append(levels(data, keys, np.zeros(len(keys), dtype=np.uint64), np.full(len(keys), len(data), dtype=np.uint64)).astype(np.uint8).tobytes())
        if kind == WORD and exact is not None:
            at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            counted.append(_narrow(np.where(have[at] == keys, exact[at], 0)))
        else:
            counted.append(_narrow(np.zeros(len(keys), dtype=np.int64)) if kind == WORD else None)
    columns = [pa.array(asked.column("chunk").to_pylist(), pa.int64()), pa.array([kind] * len(found), pa.int32()), pa.array([bucket] * len(found), pa.int64()), pa.array(found, pa.binary()), pa.array(counted, pa.binary())]
    return pa.Table.from_arrays(columns, names=["chunk", "kind", "bucket", "levels", "counts"])


class Answers:
    """Levels and exact counts of the keys of one chunk, asked for like those of a Filter."""

    def __init__(self, rows: list[dict], buckets: int):
        rows, self.buckets = sorted(rows, key=lambda r: (r["kind"], r["bucket"])), buckets
        self.levels = [np.frombuffer(b"".join(r["levels"] for r in rows if r["kind"] == kind), dtype=np.uint8) for kind in (WORD, PAIR, AFTER)]
        self.counts = np.concatenate([_wide(r["counts"], len(r["levels"])) for r in rows if r["kind"] == WORD])

    def level(self, kind: int, keys: np.ndarray) -> np.ndarray:
        own, _ = _asked(kind, keys, self.buckets)
        if len(own) != len(self.levels[kind]):
            raise ValueError("a chunk has other keys than it asked for")
        return self.levels[kind].astype(np.int64)[np.searchsorted(own, keys if kind == WORD else address(keys, self.buckets))]

    def exact(self, keys: np.ndarray) -> np.ndarray:
        return self.counts


def _score_chunk(n: int, v: int, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        batch = docs.combine_chunks().to_batches()[0]
        return pa.Table.from_batches([_scores(batch, Answers(answers.to_pylist(), buckets), n, v)])

    return run


def _routed(docs: DataFrame, held: DataFrame, n: int, v: int, buckets: int) -> DataFrame:
    """Keys spread evenly over the buckets' segments.  Both uses of the chunks are one exchange (Spark finds it again), and a
    chunk that came out otherwise at the second would be refused by Answers."""
    docs = docs.mapInArrow(_chunks, "chunk long, doc_id long, held_out boolean, text string")
    asked = docs.groupBy("chunk").applyInArrow(_ask(buckets), ASKED)
    answers = asked.groupBy("kind", "bucket").cogroup(held.groupBy("kind", "bucket")).applyInArrow(_answer, ANSWERED)
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score_chunk(n, v, buckets), SCORED)


# ---- the operator


@dataclass
class Fit:
    """held: a row for each kind and bucket, with its segment and, of words, keys and exact counts; n: training tokens, v: the
    different ones; blocks: of the filter, 8 bytes each."""

    held: DataFrame
    n: int
    v: int
    buckets: int
    blocks: int

    @property
    def size(self) -> int:
        """Bytes of the filter and of the exact counts."""
        return 8 * self.blocks + 12 * self.v

    def filter(self) -> Filter:
        return Filter(self.held.toLocalIterator(), self.buckets, self.blocks, self.v)


def fitted(train: DataFrame, run_tokens: int = RUN_TOKENS, bucket_grams: int = BUCKET_GRAMS) -> Fit:
    """Of the column text, without nulls."""
    train = train.select("text")
    size = train.agg(F.sum(F.octet_length("text") + 6)).first()[0] or 0
    buckets = 1 << (size // 6 // bucket_grams).bit_length()
    counted = train.mapInArrow(_count(buckets, run_tokens), COUNTED)
    first = kept(counted.groupBy("kind", "bucket").applyInArrow(_reduce(buckets), REDUCED), "grams")
    after = kept(first.where("kind = -1").select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(_reduce_after, REDUCED), "after")
    held = first.where("kind >= 0").unionByName(after)
    sums = {r["kind"]: r for r in held.groupBy("kind").agg(F.sum("grams").alias("grams"), F.sum("total").alias("total"), F.sum(F.octet_length("segment")).alias("bytes")).collect()}
    n, v = (sums[WORD]["total"], sums[WORD]["grams"]) if sums else (0, 0)
    return Fit(held.select("kind", "bucket", "segment", "keys", "counts"), n, v, buckets, sum(r["bytes"] for r in sums.values()) // 8)


def scored(docs: DataFrame, held_out=None, broadcast_bytes: int = BROADCAST_BYTES, run_tokens: int = RUN_TOKENS, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """SCORED for every row of docs (doc_id, text), learnt from the rows that are not ``held_out`` (a Column; by default
    crc32 of the id as text is 2 modulo 7 there, and a null id is not held out).

    ``broadcast_bytes``: bytes up to which the filter is broadcast; the scores are the same on either side."""
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)) if held_out is None else held_out
    docs = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    fit = fitted(docs.where("not held_out"), run_tokens, bucket_grams)
    if fit.size > broadcast_bytes:
        return _routed(docs, fit.held, fit.n, fit.v, fit.buckets)
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(fit.filter()), fit.n, fit.v), SCORED)
