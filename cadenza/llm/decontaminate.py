"""Operator 1, benchmark decontamination by winnowing.

Every text becomes words; every k consecutive words a hash.  Of each ``span - k + 1`` neighbouring hashes the smallest
is kept (the rightmost of equals), so two texts that share ``span`` words share a kept hash.  Kept hashes of documents
meet kept hashes of benchmark items; around each meeting the hit is extended over all windows of ``span`` words, and
the words themselves are compared, so that a hash collision never counts.  An item of fewer than ``span`` words is one
window of its own length (winnowing with k = its length, which keeps every hash).

Scale: with a benchmark of at most ``block_bytes`` its index of windows is broadcast, and documents are read once, without a
shuffle.  Beyond that the windows stay a table.  What is broadcast then are two bit maps of at most 2 ** ``MAP_BITS`` bits,
of the kept hashes and of the windows' hashes: a document's kept hashes meet the first, hits are extended over their
windows, and windows that the second map lets through (the benchmark's, and a few that only seem to be) are sent, words and
all, to meet the benchmark's windows in a join.  So documents are read twice, however large the benchmark is; only windows
that may be hits are dealt out, and what they meet comes back by the hash of the text.  Both ways give the same rows.

Defined cases: a null or empty text has no words and no hits; a null item text has no window; items with a null id
count under the empty id; rows with one item_id are one item; repeated documents are judged one by one; an empty
benchmark leaves every document clean; a document column named like an output column is replaced by the output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import ALNUM, Words, grams, kept, mix, powers, raw_text, text_batches

SPAN, K, BLOCK_BYTES = 13, 5, 4 << 20
MAP_BITS, PIECE_BYTES = 27, 1 << 16
OUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


class Index:
    """Windows of a block of items: by length the sorted hashes, a place of each in the items' words, and its items."""

    def __init__(self, items: list[tuple[str, bytes]], span: int = SPAN, k: int = K):
        self.span, self.k = span, min(k, span)
        self.ids = sorted({i for i, _ in items})
        number = {x: n for n, x in enumerate(self.ids)}
        off = np.cumsum([0, *[len(t) for _, t in items]]).astype(np.int64)
        self.words = words = Words(np.frombuffer(b"".join(t for _, t in items), dtype=np.uint8), off, ALNUM)
        sizes = np.diff(words.first)
        owner = np.repeat(np.array([number[i] for i, _ in items], dtype=np.int64), sizes)
        left = np.repeat(words.first[1:], sizes) - np.arange(len(words.hash))  # words from here to the item's end
        size = np.repeat(sizes, sizes)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({min(span, int(s)) for s in sizes if s}):
            place = np.flatnonzero((left >= n) & ((size >= span) if n == span else (size == n)))
            keys, first, which = np.unique(grams(words.hash, n)[place], return_index=True, return_inverse=True)
            pairs = np.unique(which * max(len(self.ids), 1) + owner[place])
            window, item = np.divmod(pairs, max(len(self.ids), 1))
            self.windows[n] = keys, place[first], np.searchsorted(window, np.arange(len(keys) + 1)), item
        self.kept = np.unique(grams(words.hash, self.k)[winnowed(words, self.span, self.k)]) if span in self.windows else np.zeros(0, dtype=np.uint64)

    def owners(self, n: int, window: int) -> list[int]:
        _, _, at, item = self.windows[n]
        return item[at[window] : at[window + 1]].tolist()


def winnowed(words: Words, span: int, k: int) -> np.ndarray:
    """Places of the kept k-grams: of each span - k + 1 neighbours inside one text the smallest, the last of equals."""
    n = len(words.hash) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    g, width = grams(words.hash, k), span - k + 1
    best, at = g[:n].copy(), np.zeros(n, dtype=np.int8)
    for j in range(1, width):
        lower = g[j : j + n] <= best
        best = np.where(lower, g[j : j + n], best)
        at[lower] = j
    place = np.arange(n, dtype=np.int64)
    inside = np.repeat(words.first[1:], np.diff(words.first))[:n] >= place + span
    return np.unique((place + at)[inside])


def _lookup(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x in sorted keys, or -1."""
    if not len(keys) or not len(x):
        return np.full(len(x), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def candidates(words: Words, n: int, span: int, k: int, meets) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of n words begin that may be the benchmark's, and their hashes.  meets(hashes): which kept hashes are."""
    end = np.repeat(words.first[1:], np.diff(words.first))
    if n == span:
        kept_at = winnowed(words, span, k)
        kept_at = kept_at[meets(grams(words.hash, k)[kept_at])]
        # extend: every window of n words that holds the shared k words
        start = np.unique((kept_at[:, None] - np.arange(span - k + 1)[None, :]).ravel())
        start = start[(start >= 0) & (start + n <= len(words.hash))]
    else:
        start = np.arange(max(0, len(words.hash) - n + 1))
    start = start[end[start] >= start + n]
    g = np.zeros(len(start), dtype=np.uint64)
    if n == span:
        for j, p in enumerate(powers(n)):
            g += words.hash[start + j] * p
        g = mix(g)
    elif len(start):
        g = grams(words.hash, n)[start]
    return start, g


def hits(words: Words, index: Index) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Which words are hit, and for each text with hits the numbers of its items."""
    cover, items = np.zeros(len(words.hash) + 1, dtype=np.int64), {}
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    for n, (keys, place, _, _) in index.windows.items():
        start, g = candidates(words, n, index.span, index.k, lambda h: _lookup(index.kept, h) >= 0)
        at = _lookup(keys, g)
        for s, w in zip(start[at >= 0].tolist(), at[at >= 0].tolist(), strict=True):
            if words.span(s, n) == index.words.span(int(place[w]), n):
                cover[s] += 1
                cover[s + n] -= 1
                items.setdefault(int(text[s]), set()).update(index.owners(n, w))
    return np.cumsum(cover[:-1]) > 0, items


def _pass(broadcast, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = broadcast.value
        for batch in text_batches(batches):
            words = Words(*raw_text(batch.column("text")), ALNUM)
            hit, items = hits(words, index)
            sizes = np.diff(words.first)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            ids = [sorted(index.ids[x] for x in items.get(i, ())) for i in range(batch.num_rows)]
            for i in np.flatnonzero(np.add.reduceat(np.append(hit, False).astype(np.int64), words.first[:-1]) * (sizes > 0)) if len(sizes) else ():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[words.first[i] : words.first[i + 1]].astype(np.int8), [0]))))
                spans[i] = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
            out = [batch.column(c) for c in keep]
            out += [pa.array(sizes, pa.int64()), pa.array(spans, SPANS), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, *OUT.names])

    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


# ---- a benchmark of more than one block


class BitMap:
    """A Bloom filter of hashes: three bits in one block of 64."""

    def __init__(self, bits: int):
        self.shift, self.data = np.uint64(64 - (bits - 6)), np.zeros(1 << (bits - 6), dtype=np.uint64)

    def _at(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(1) << (h & np.uint64(63))
        for k in (6, 12):
            mask |= np.uint64(1) << ((h >> np.uint64(k)) & np.uint64(63))
        return (h >> self.shift).astype(np.int64), mask

    def add(self, h: np.ndarray) -> None:
        at, mask = self._at(h)
        np.bitwise_or.at(self.data, at, mask)

    def has(self, h: np.ndarray) -> np.ndarray:
        at, mask = self._at(h)
        return self.data[at] & mask == mask


def _item_windows(words: Words, span: int) -> Iterator[tuple[int, int, int]]:
    """(item, first word, length) of every window."""
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        n = min(span, b - a)
        for s in range(a, b - n + 1) if n else ():
            yield i, s, n


def _windows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            words, ids = Words(*raw_text(batch.column("text")), ALNUM), batch.column("item_id").to_pylist()
            rows = [(b" ".join(words.span(s, n)), n, ids[i]) for i, s, n in _item_windows(words, span)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int32(), pa.string()), strict=True)], names=["w", "n", "item_id"])

    return run


def _mapped(span: int, k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of the two maps that have bits: 0 of the kept hashes, 1 of the windows."""
        maps = BitMap(bits), BitMap(bits)
        for batch in text_batches(batches):
            words = Words(*raw_text(batch.column("text")), ALNUM)
            maps[0].add(grams(words.hash, k)[winnowed(words, span, k)])
            sizes = np.diff(words.first)
            left, size = np.repeat(words.first[1:], sizes) - np.arange(len(words.hash)), np.repeat(sizes, sizes)
            for n in {min(span, int(x)) for x in sizes if x}:
                place = np.flatnonzero((left >= n) & ((size >= span) if n == span else (size == n)))
                maps[1].add(grams(words.hash, n)[place])
        for kind, m in enumerate(maps):
            data = m.data.astype("<u8").tobytes()
            for piece in range(0, len(data), PIECE_BYTES):
                if any(part := data[piece : piece + PIECE_BYTES]):
                    yield pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "piece": pa.array([piece], pa.int64()), "data": pa.array([part], pa.binary())})

    return run


def _united(key: tuple, table: pa.Table) -> pa.Table:
    data = np.bitwise_or.reduce([np.frombuffer(x.as_py(), dtype="<u8") for x in table.column("data")])
    return pa.table({"kind": pa.array([key[0].as_py()], pa.int32()), "piece": pa.array([key[1].as_py()], pa.int64()), "data": pa.array([data.tobytes()], pa.binary())})


def _maybe(sent, lengths: list[int], span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, whole = sent.value
        for batch in text_batches(batches):
            words, ids = Words(*raw_text(batch.column("text")), ALNUM), batch.column("_t")
            text = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
            for n in lengths:
                start, g = candidates(words, n, span, k, near.has)
                start = start[whole.has(g)]
                if len(start):
                    own = text[start]
                    columns = [ids.take(pa.array(own)), pa.array(start - words.first[own], pa.int64()), pa.array([b" ".join(words.span(s, n)) for s in start.tolist()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["_t", "start", "w"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a text as ranges that do not touch."""
    for batch in batches:
        out = []
        for windows in batch.column("windows").to_pylist():
            spans: list[dict] = []
            for x in sorted((x["start"], x["start"] + x["n"]) for x in windows):
                if spans and x[0] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], x[1])
                else:
                    spans.append({"start": x[0], "end": x[1]})
            out.append(spans)
        yield pa.RecordBatch.from_arrays([batch.column("_t"), pa.array(out, SPANS), batch.column("sets")], names=["_t", "hit_spans", "sets"])


def _sized(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            sizes = np.diff(Words(*raw_text(batch.column("text")), ALNUM).first)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], batch.column("_t"), pa.array(sizes, pa.int64())], names=[*keep, "_t", "n_words"])

    return run


def _by_join(docs: DataFrame, bench: DataFrame, keep: list[str], span: int, k: int, total: int) -> DataFrame:
    spark, k = docs.sparkSession, min(k, span)
    bits = min(MAP_BITS, max(16, int(2 * total).bit_length()))
    pieces = bench.mapInArrow(_mapped(span, k, bits), "kind int, piece long, data binary").groupBy("kind", "piece").applyInArrow(_united, "kind int, piece long, data binary")
    maps = BitMap(bits), BitMap(bits)
    for r in pieces.toLocalIterator():  # at most 2 ** (MAP_BITS - 2) bytes
        data = np.frombuffer(r["data"], dtype="<u8")
        maps[r["kind"]].data[r["piece"] // 8 : r["piece"] // 8 + len(data)] = data
    windows = bench.mapInArrow(_windows(span), "w binary, n int, item_id string")
    sets = windows.groupBy("w", "n").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    sets = kept(sets.withColumn("set", F.md5(F.to_json(F.struct("items")))), "windows")
    lengths = [r[0] for r in sets.select("n").distinct().orderBy("n").collect()]  # span at most
    tagged = docs.withColumn("_t", F.md5(F.coalesce(F.col("text"), F.lit(""))))
    maybe = tagged.select("_t", "text").mapInArrow(_maybe(spark.sparkContext.broadcast(maps), lengths, span, k), "_t string, start long, w binary")
    met = maybe.join(sets.select("w", "n", "set"), "w").select("_t", F.struct("start", "n").alias("window"), "set")
    met = met.groupBy("_t").agg(F.collect_set("window").alias("windows"), F.collect_set("set").alias("sets"))
    met = kept(met.mapInArrow(_merged, "_t string, hit_spans array<struct<start:bigint,end:bigint>>, sets array<string>"), "hits")
    items = sets.select("set", "items").dropDuplicates(["set"])
    found = met.select("_t", F.explode("sets").alias("set")).join(items, "set").select("_t", F.explode("items").alias("item_id")).groupBy("_t").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    met = met.select("_t", "hit_spans").join(found, "_t")
    fields = {f.name: f for f in tagged.schema.fields}
    sized = tagged.mapInArrow(_sized(keep), T.StructType([fields[c] for c in keep] + [fields["_t"], OUT.fields[0]]))
    rows = sized.join(met, "_t", "left")
    nothing = {f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in OUT.fields[1:]}
    return rows.withColumns(nothing).select(*keep, *OUT.names)


def contamination(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, span: int = SPAN, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``columns`` of docs (default: all) with n_words, hit_spans (merged word ranges, end exclusive) and item_ids (as
    text, sorted).  docs needs ``text``, benchmark ``item_id`` and ``text``."""
    spark = docs.sparkSession
    keep = [f.name for f in docs.schema.fields if f.name in (columns if columns is not None else docs.columns) and f.name not in OUT.names]
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]
    df = docs.select(*dict.fromkeys([*keep, "text"]))
    if total > block_bytes:
        return _by_join(df, bench, keep, span, k, total)
    index = Index([(r[0], bytes(r[1])) for r in bench.toLocalIterator()], span, k)
    fields = {f.name: f for f in df.schema.fields}
    return df.mapInArrow(_pass(spark.sparkContext.broadcast(index), keep), T.StructType([fields[c] for c in keep] + OUT.fields))


def judged(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated: at least a twentieth of the words is hit."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    found = found.withColumns(
        {
            "n_hit": n_hit,
            "n_items": F.size("item_ids").cast("long"),
            "items_sha256": F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256),
        }
    )
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
