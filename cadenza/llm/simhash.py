"""Operator 4, near duplicates by SimHash and the generalised pigeonhole.

A fingerprint is 64 bits: of the XXH64 hashes (seed 42) of a text's shingles of four words, repeats included, a bit is 1
if more than half have it.  Texts link if their fingerprints differ in at most ``limit`` bits, and groups are what links
reach.

Search over distinct fingerprints: the bits are put into m parts, correlated bits together, and part i gets a threshold
t_i with the sum of (t_i + 1) equal to limit + 1.  Two fingerprints within ``limit`` then lie within t_i on some part i,
for else they would differ in at least limit + 1 bits.  m and the unequal thresholds come from dynamic programming over
an estimate of the rows probed and the candidates met, from counts of all fingerprints' bits and pairs of bits; so the
parts are wide where there are many fingerprints, at any size.  Each fingerprint is sent to its own value of a part and
to all values within t_i; those that meet are compared in full.

Scale: texts are read once, without a shuffle; 16 bytes a document are kept.  Exact copies are one fingerprint.  In a
bucket of many (near copies in thousands) a search from fingerprint to unvisited fingerprint gives one link for each
found, never all pairs.  A bucket of more than ``bucket`` distinct fingerprints goes another exact way: two
fingerprints differ in at most 4 bits if and only if some value lies within 2 bits of both, so each sends itself to all
values within 2 bits (within ceil(limit / 2) and floor(limit / 2) in general), and all that meet link to the smallest,
each meeting checked in full where limit is odd.  Buckets that would also take more than one of ``SHARE`` fingerprints are
found by counts beforehand and never dealt out.  A fingerprint, or a group, that has more than its share of the rows is
joined where its rows are (``by_share``).

Defined cases: a null or empty text has fingerprint zero, linked like any other; fewer than four words are one shingle;
repeated rows are in one group; a null id never is the smallest id, and a group of null ids has a null component; of
rows that share the smallest id ``deduplicated`` keeps that of the least hash over its columns, the same at every run; an
empty table gives no rows; a column named like an output is no input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cadenza.llm.common import CHUNK_BYTES, LOWER_BYTES, by_share, kept, raw_text, text_batches, told_apart
from cadenza.llm.components import components

WORDS, SEED, LIMIT, BUCKET = 4, 42, 4, 1 << 16
#: A bucket with more than one of so many fingerprints is not dealt out, so at most so many of a part are looked up.
SHARE = 512
#: Relative costs of a row sent and of two fingerprints compared.
ROW_COST, PAIR_COST = 1.0, 0.01
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprints_of(texts: list[bytes], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    split = [t.translate(LOWER_BYTES).split() for t in texts]
    counts = np.array([len(x) for x in split], dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    flat = [w for x in split for w in x]
    lens = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    joined = b" ".join(flat)
    start = np.cumsum(lens + 1) - lens - 1
    n = np.maximum(counts[some] - words + 1, 1)  # shingles of each text
    first = (np.cumsum(counts) - counts)[some]
    at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    last = at + np.repeat(np.minimum(counts[some], words), n) - 1
    a, b = start[at].tolist(), (start[last] + lens[last]).tolist()
    h = np.fromiter((xxh64_intdigest(joined[i:j], seed) for i, j in zip(a, b, strict=True)), dtype=np.uint64, count=len(a))
    begins = np.cumsum(n) - n
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint(keep: list[str], words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, CHUNK_BYTES // 2):
            body, off = raw_text(batch.column("text"))
            body, off = body.tobytes(), off.tolist()
            fp = fingerprints_of([body[a:b] for a, b in zip(off[:-1], off[1:], strict=True)], words, seed)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return run


def fingerprints(docs: DataFrame, columns: list[str], words: int = WORDS, seed: int = SEED) -> DataFrame:
    """columns of docs and fp long, the 64 bits of the fingerprint."""
    keep = [f for f in docs.schema.fields if f.name in columns and f.name != "fp"]
    names, kinds = [f.name for f in keep], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(_fingerprint(names, words, seed), f"{kinds}, fp long")


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both, n = np.zeros((64, 64), dtype=np.int64), 0
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for k in range(0, len(fp), 1 << 16):
            x = ((fp[k : k + (1 << 16), None] & _BITS[None, :]) != 0).astype(np.float32)
            both += np.rint(x.T @ x).astype(np.int64)
        n += len(fp)
    if n:
        i, j = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "n": both.ravel()})
        yield pa.RecordBatch.from_pydict({"i": [64], "j": [64], "n": [n]})


class Plan:
    """parts: for each part with a threshold of 0 or more its bits and that threshold."""

    def __init__(self, n: int, both: np.ndarray, limit: int = LIMIT):
        self.n = n
        p = both / max(n, 1)
        one = np.diag(p).copy()
        var = np.sqrt(np.maximum(one * (1 - one), 1e-12))
        corr = np.abs((p - np.outer(one, one)) / np.outer(var, var))
        np.fill_diagonal(corr, 0)
        # chance that two fingerprints agree on bit i, and on both i and j
        agree = one**2 + (1 - one) ** 2
        p11, p10, p01 = p, one[:, None] - p, one[None, :] - p
        agree2 = p11**2 + p10**2 + p01**2 + (1 - p11 - p10 - p01) ** 2
        self.cost, self.parts = np.inf, []
        for m in range(2, limit + 2):
            groups = _grouped(corr, m)
            costs = [_costs(g, n, agree, agree2, limit) for g in groups]
            best = {0: (0.0, [])}
            for c in costs:
                step: dict[int, tuple[float, list[int]]] = {}
                for s, (v, t) in best.items():
                    for own in range(limit + 2 - s):  # own = t + 1, 0: the part is not probed
                        x = (v + (c[own - 1] if own else 0.0), [*t, own - 1])
                        if s + own not in step or x[0] < step[s + own][0]:
                            step[s + own] = x
                best = step
            v, t = best[limit + 1]
            if v < self.cost:
                self.cost, self.parts = v, [(g, x) for g, x in zip(groups, t, strict=True) if x >= 0]


def _grouped(corr: np.ndarray, m: int) -> list[list[int]]:
    left, out = set(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        order = sorted(left)
        group = [max(order, key=lambda b: (corr[b, order].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            b = max(sorted(left), key=lambda b: (corr[b, group].mean(), -b))
            group.append(b)
            left.remove(b)
        out.append(group)
    return out


def _costs(bits: list[int], n: int, agree: np.ndarray, agree2: np.ndarray, limit: int) -> list[float]:
    """Of thresholds 0 to limit: rows sent and pairs met, the bits taken as a chain in which each hangs on the last."""
    differ = [1 - agree[bits[0]]] + [1 - agree2[a, b] / max(agree[a], 1e-12) for a, b in zip(bits, bits[1:], strict=False)]
    dist = np.zeros(limit + 1)
    dist[0] = 1.0
    for d in differ:
        d = min(max(d, 0.0), 1.0)
        dist = dist * (1 - d) + np.concatenate(([0.0], dist[:-1])) * d
    rows, out = 0, []
    for t in range(limit + 1):
        rows += comb(len(bits), t)
        out.append(ROW_COST * n * rows + PAIR_COST * n * n / 2 * dist[: t + 1].sum())
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits: list[int], most: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for k in range(most + 1) for c in combinations(bits, k)]


def _close(x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= limit


def _searched(fp: np.ndarray, limit: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of one bucket, one for each fingerprint found from another."""
    left, us, vs = fp, [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            u = front.pop()
            near = _close(left, u, limit)
            if near.any():
                found, left = left[near], left[~near]
                us.append(np.full(len(found), u, dtype=np.uint64))
                vs.append(found)
                front += list(found)
    return us, vs


def _links(limit: int, bucket: int, small: int = 16):
    def pairs(part: np.ndarray, key: np.ndarray, fp: np.ndarray):
        """Of whole buckets, sorted."""
        new = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (key[1:] != key[:-1]))))
        size = np.diff(np.append(new, len(fp)))
        us, vs = [], []
        for a, n in zip(new[size > small].tolist(), size[size > small].tolist(), strict=True):
            u, v = _searched(np.unique(fp[a : a + n]), limit)
            us += u
            vs += v
        number = np.repeat(np.arange(len(size)), size)
        keep = (size <= small)[number]
        number, some = number[keep], fp[keep]
        for lag in range(1, small):
            if lag >= len(some):
                break
            same = (number[lag:] == number[:-lag]) & _close(some[lag:], some[:-lag], limit) & (some[lag:] != some[:-lag])
            us.append(some[:-lag][same])
            vs.append(some[lag:][same])
        return (np.concatenate(us), np.concatenate(vs)) if us else (fp[:0], fp[:0])

    def rows(u, v, hot=False):
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(np.full(len(u), hot))], names=["u", "v", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.zeros(0, dtype=np.int32)
        key, fp, over = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), None
        for batch in batches:
            p, k = batch.column("part").to_numpy(), batch.column("key").to_numpy()
            f = batch.column("fp").to_numpy().view(np.uint64)
            if over is not None:  # the bucket that is too large goes on
                same = (p == over[0]) & (k == over[1])
                if same.any():
                    yield rows(f[same], f[same], True)
                    p, k, f = p[~same], k[~same], f[~same]
            if not len(p):
                continue
            part, key, fp, over = np.concatenate((part, p)), np.concatenate((key, k)), np.concatenate((fp, f)), None
            last = int(np.flatnonzero((part != part[-1]) | (key != key[-1]))[-1]) + 1 if (part[0], key[0]) != (part[-1], key[-1]) else 0
            u, v = pairs(part[:last], key[:last], fp[:last]) if last else (fp[:0], fp[:0])
            if len(u):
                yield rows(u, v)
            part, key, fp = part[last:], key[last:], fp[last:]
            if len(fp) > bucket:
                yield rows(fp, fp, True)
                over = (part[-1], key[-1])
                part, key, fp = part[:0], key[:0], fp[:0]
        if len(fp):
            u, v = pairs(part, key, fp)
            if len(u):
                yield rows(u, v)

    return run


def plan_for(fps: DataFrame, limit: int = LIMIT) -> Plan:
    found = fps.select("fp").mapInArrow(_pair_counts, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    both, n = np.zeros((64, 64)), 0
    for r in found:
        if r["i"] == 64:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return Plan(n, both, limit)


def _crowded(fps: DataFrame, plan: Plan, bucket: int) -> DataFrame | None:
    """part, key of the buckets that get more than ``bucket`` fingerprints and one of SHARE: those round a value that so many
    have themselves.  At most SHARE values a part are collected."""
    masks = [F.lit(_signed(sum(1 << b for b in bits))).cast("long") for bits, _ in plan.parts]
    own = fps.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(m) for m in masks])).alias("part", "key"))
    counts = own.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > bucket) & (F.col("n") * SHARE > plan.n))
    found = [(r["part"], _signed((r["key"] ^ x) & ((1 << 64) - 1))) for r in counts.collect() for x in _flips(*plan.parts[r["part"]])]
    return fps.sparkSession.createDataFrame(sorted(set(found)), "part int, key long") if found else None


def linked(fps: DataFrame, limit: int = LIMIT, bucket: int = BUCKET, plan: Plan | None = None) -> DataFrame:
    """u, v: links among distinct fingerprints ``fp`` that connect all that are within ``limit`` bits."""
    plan = plan or plan_for(fps, limit)
    probes = []
    for k, (bits, t) in enumerate(plan.parts):
        mask = F.lit(_signed(sum(1 << b for b in bits))).cast("long")
        own = F.col("fp").bitwiseAND(mask)
        keys = F.explode(F.transform(F.lit(_flips(bits, t)).cast("array<bigint>"), lambda x: own.bitwiseXOR(x))) if t else own
        probes.append(fps.select(F.lit(k).alias("part"), keys.alias("key"), "fp"))
    sent = probes[0]
    for p in probes[1:]:
        sent = sent.union(p)
    crowded, hot = _crowded(fps, plan, bucket), None
    if crowded is not None:
        hot = sent.join(F.broadcast(crowded), ["part", "key"], "left_semi").select("fp")
        sent = sent.join(F.broadcast(crowded), ["part", "key"], "left_anti")
    dealt = sent.repartition("part", "key").sortWithinPartitions("part", "key")
    met = kept(dealt.mapInArrow(_links(limit, bucket), "u long, v long, hot boolean"), "met")
    links, late = met.where("not hot").select("u", "v"), met.where("hot").select(F.col("u").alias("fp"))
    if hot is not None or not late.limit(1).isEmpty():
        links = links.union(_by_midpoint((late if hot is None else late.union(hot)).distinct(), limit))
    return links


def _by_midpoint(fps: DataFrame, limit: int) -> DataFrame:
    """Links by values within half the limit of both; for an odd limit the far half reaches one bit more and is checked."""
    fps = kept(fps, "hot")
    ball = lambda most: F.explode(F.transform(F.lit(_flips(list(range(64)), most)).cast("array<bigint>"), lambda x: F.col("fp").bitwiseXOR(x)))
    near = fps.select("fp", ball(limit // 2).alias("mid"))
    least = near.groupBy("mid").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    if limit % 2 == 0:
        return near.join(least, "mid").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    even = near.join(least, "mid").where("fp <> v").select(F.col("fp").alias("u"), "v")
    last = near.select(F.col("fp").alias("v"), "mid").join(fps.select("fp", ball(limit - limit // 2).alias("mid")), "mid")
    odd = last.where("fp <> v").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= limit).select(F.col("fp").alias("u"), "v")
    return even.union(odd).distinct()


def near_groups(docs: DataFrame, limit: int = LIMIT, words: int = WORDS, seed: int = SEED, bucket: int = BUCKET, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the columns ``carry`` of docs, fp, root (the smallest fingerprint of the group, as a signed number) and
    component_id: a row for each row."""
    own = ["doc_id", *(carry or [])]
    docs = kept(fingerprints(docs, own, words, seed), "fingerprints")
    fps = kept(docs.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n")), "distinct")
    found = components(linked(fps.select("fp"), limit, bucket))
    roots = found.select("node", "root").union(found.select(F.col("root").alias("node"), "root").distinct())
    known = kept(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "doc", "n", "root"), "classes")
    linked_ones = known.where("root is not null")
    least = kept(linked_ones.groupBy("root").agg(F.min("doc").alias("component_id"), F.count(F.lit(1)).alias("m")), "least")
    rows, members = fps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], least.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    classes = by_share(linked_ones.select("fp", "n", "root"), least, "root", "m", members).select("fp", "n", "root", "component_id")
    classes = kept(classes.union(known.where("root is null").select("fp", "n", F.col("fp").alias("root"), F.col("doc").alias("component_id"))), "known")
    return by_share(docs, classes, "fp", "n", rows).select(*own, "fp", "root", "component_id")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs without all rows but one of each group: that of the smallest id (null last), and of rows with that id the one
    with the least hash over all columns; of rows that are equal in every column one stays."""
    mark = "_row"
    while mark in docs.columns:
        mark += "_"
    marked = docs.withColumn(mark, F.xxhash64(*[F.col(f"`{c}`") for c in told_apart(docs)]))
    groups = kept(near_groups(marked, carry=[mark], **options), "groups")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("d"), F.col(mark).alias("r"))).alias("x"))
    first = first.select(F.col("x.d").alias("_d"), F.col("x.r").alias("_r"))
    stay = marked.join(first, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col(mark) == F.col("_r")), "left_semi")
    if not groups.groupBy("doc_id", mark).count().where("count > 1").isEmpty():  # rows that are equal throughout
        stay = stay.dropDuplicates(["doc_id", mark])
    return stay.drop(mark)
