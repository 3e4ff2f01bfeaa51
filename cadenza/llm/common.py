"""What several operators of this subpackage share: reading text columns as raw bytes, hashing words with numpy,
ranking rows without a hot task, and a place for files that every executor sees."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII letters are lower-cased, everything else stays (fixed by the word rules of the queries).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

#: Bytes of words ``[^\x20\x09-\x0D]+``: everything but ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once lower-cased: digits, letters and all of non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Text handled at once by numpy; only a single word longer than this makes a chunk larger.
CHUNK_BYTES = 2 << 20
ARROW_BYTES = 2 * CHUNK_BYTES

_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, so that every bit of a key decides every bit of its hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    """The first n powers of the odd multiplier."""
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << max(10, (n - 1).bit_length())
        p = np.full(size, _P, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without decoding it; a null is an empty text."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return body[off[0] : off[-1]], off - off[0]


def pieces(body: np.ndarray, off: np.ndarray, word: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``size`` that end between documents, or between words of a document that is longer."""
    at, end = 0, len(body)
    while at < end:
        to = min(end, at + size)
        if to < end:
            k = off[np.searchsorted(off, to, side="right") - 1]
            if k > at:
                to = int(k)
            else:
                while to < end and word[body[to]] and to not in off[np.searchsorted(off, to) : np.searchsorted(off, to) + 1]:
                    to += 1
        yield at, to
        at = to


class Words:
    """The words of a batch of texts: where each starts, its length, a 64-bit hash, and each text's range of words."""

    def __init__(self, body: np.ndarray, off: np.ndarray, word: np.ndarray):
        self.body, starts, lens, hashes = LOWER[body] if len(body) else body, [], [], []
        for a, b in pieces(self.body, off, word):
            s, n, h = _hash_words(self.body[a:b], off[(off > a) & (off < b)] - a, word)
            starts.append(s + a)
            lens.append(n)
            hashes.append(h)
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
        self.start, self.len, self.hash = cat(starts, np.int64), cat(lens, np.int64), cat(hashes, np.uint64)
        #: word k of text i has first[i] <= k < first[i + 1]
        self.first = np.searchsorted(self.start, off, side="left")

    def __getitem__(self, k: int) -> bytes:
        return self.body[self.start[k] : self.start[k] + self.len[k]].tobytes()

    def span(self, k: int, n: int) -> tuple[bytes, ...]:
        return tuple(self[i] for i in range(k, k + n))


def _hash_words(body: np.ndarray, cuts: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cuts: where another text begins inside body; a word never goes across one."""
    inside = np.zeros(len(body) + 2, dtype=np.int8)
    inside[1:-1] = word[body]
    step = np.diff(inside)
    begins, ends = step[:-1] == 1, step[1:] == -1
    if len(cuts):
        cuts = cuts[(cuts > 0) & (cuts < len(body))]
        both = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        begins[both] = True
        ends[both - 1] = True
    starts = np.flatnonzero(begins)
    lens = np.flatnonzero(ends) + 1 - starts
    if not len(starts):
        return starts, lens, np.zeros(0, dtype=np.uint64)
    total = int(lens.sum())
    firsts = np.cumsum(lens) - lens
    at = np.arange(total, dtype=np.int64) - np.repeat(firsts, lens)
    letters = body[inside[1:-1] == 1].astype(np.uint64) + np.uint64(1)
    letters *= powers(int(lens.max()))[at]
    h = np.add.reduceat(letters, firsts)
    return starts, lens, mix(h ^ (lens.astype(np.uint64) << np.uint64(56)))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words; the last k - 1 places have none."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    n, out = len(h) - k + 1, np.zeros(len(h) - k + 1, dtype=np.uint64)
    p = powers(k)
    for j in range(k):
        out += h[j : j + n] * p[j]
    return mix(out)


def text_batches(batches: Iterator[pa.RecordBatch], size: int = 2 * CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``size`` bytes of text, so that memory follows bytes and not rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = raw_text(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of a value as text, modulo n."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which driver and executors share."""
    return f"{checkpoint_root(spark)}/{what}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of this machine's own only where driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def kept(df: DataFrame, what: str = "kept") -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: list[str], order: list[Column | str], at: Column, rank: str, rows: int, total: str | None = None, per_bucket: int = 4096) -> DataFrame:
    """``rank``: 0-based place of each row among those of its group by ``order``, with no group in one task.

    ``at`` is a number in [0, 1) that grows with the first column of ``order``; it cuts each group into buckets.  Rows
    are counted in each bucket, a running sum over the bucket counts gives each bucket its first rank, and a window
    over (group, bucket) does the rest; both sides are dealt by the same keys.  ``total``: the rows of the group.
    """
    n = max(256, min(-(-rows // per_bucket), 65536 + rows // 262144))
    df = df.withColumn("_bucket", F.least(F.floor(at * F.lit(float(n))), F.lit(n - 1)).cast("int"))
    keys = [*group, "_bucket"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *[F.col(k).alias(f"_c{k}") for k in keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("_total"),
    )
    within = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_within", F.row_number().over(within) - 1)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_c{k}"))
    df = df.join(counts, cond, "left").withColumn(rank, (F.col("_before") + F.col("_within")).cast("long"))
    if total:
        df = df.withColumn(total, F.col("_total").cast("long"))
    return df.drop("_bucket", "_within", "_before", "_total", *[f"_c{k}" for k in keys])


def shuffle_key(seed: int, *columns: str) -> Column:
    """31 bits that deal rows into a seeded random order: of the MD5 of the seed and the columns as text, parted by |.

    With all columns of a row in it, rows that share an id lie apart, and only rows that are equal throughout meet."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *texts)), 1, 8)
    return F.shiftright(F.conv(digits, 16, 10).cast("long"), 1)


SHUFFLE_RANGE = float(1 << 31)


def told_apart(df: DataFrame, *but: str) -> list[str]:
    """The other columns that can be compared, by name: they tell rows of one id apart."""
    return sorted(f.name for f in df.schema.fields if f.name not in but and f.dataType.typeName() not in ("map", "variant"))


def by_share(df: DataFrame, table: DataFrame, key: str, rows: str, total: int, share: int = 4096) -> DataFrame:
    """Inner join on ``key``, which is unique in ``table``; its column ``rows`` says how many of df's ``total`` rows have it.

    Keys with more than one of ``share`` rows (at most ``share`` keys can have that) are broadcast and leave their rows
    where they are; only the others are dealt out, so no task gets more than its share for a key."""
    frequent = F.col(rows) * share > total
    heavy, light = table.where(frequent).drop(rows), table.where(~frequent).drop(rows)
    at_home = df.join(F.broadcast(heavy), key)
    dealt = df.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return at_home.unionByName(dealt)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a context, so that a job does not depend on how they were started; and let
    Arrow batches hold at most ARROW_BYTES, for rows are long texts and a batch stands in the JVM and in the worker."""
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if getattr(sc, "_cadenza_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp()) / "cadenza.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"cadenza/{f.relative_to(package)}")
    sc.addPyFile(str(path))
    sc._cadenza_shipped = True
