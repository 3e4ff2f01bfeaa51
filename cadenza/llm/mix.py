"""Operator 5, mixing sources to target weights by Pfair scheduling, DataFrame functions only.

Rows of a source, in a seeded random order, form blocks of ``block_rows``.  With integer weights w of sum W, block j of
a source is released at slot floor(j W / w) and due at slot ceil((j + 1) W / w); earliest-deadline-first over released
blocks meets every deadline, so after any number of slots each source has had its share to within one block.  The
schedule repeats after W slots, so W entries describe it at any size.  When the first source has no block left the rest
go on by their own weights from there (the next phase), until all rows are placed: phase 0 holds the target mixture,
and no row is dropped.  Sources of weight 0 follow in equal shares when the others are used up.

The schedule is the same at any number of sources and for any weights.  Up to ``MAX_SOURCES`` sources, with weights of sum
up to ``MAX_WEIGHT_SUM``, it is a plan; beyond, it is a table of all blocks.  Only a caller who gives ``max_sources`` himself
gets another mixture: a place of its own for as many sources but one, first those of the greatest weight (where weights are
given), then those with the most rows, then by name, and one pool of all others.  The pool's weight is the sum of what its
sources would have had, its rows come in one seeded random order, and no row is dropped.

Scale: one pass counts rows by source.  The plan (a period of W slots for each source and phase) is made on the driver and
joined by source; ranks inside sources are bucketed windows (``ranked``), so a source with a third of the rows is dealt like
the rest; block, slot and position are arithmetic.  The table of blocks (``slots``) is made on the driver too, slot by slot,
or by whole periods where a phase has several, and written in pieces of ``AT_ONCE`` blocks; the driver holds numbers for
each source and no names.  Buckets of a source, not rows, meet that table, so rows are dealt once, as with a plan.  The random order looks at all columns of a
row, so neither a source nor a repeated or null id makes a large bucket.

Defined cases: a null source is a source; a source without a weight has weight 0; repeated rows are rows, those that are
equal in every column may change places; the last block of a source may be short; an empty table gives no rows; columns
named like the outputs are replaced.
"""

from __future__ import annotations

import heapq
import json
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import SHUFFLE_RANGE, kept, ranked, shared_dir, shuffle_key, told_apart

BLOCK_ROWS, SEED, MAX_SOURCES, MAX_WEIGHT_SUM = 16, 42, 64, 4096
#: Blocks of the table that the driver makes at once.
AT_ONCE = 1 << 19
#: Beyond the greatest number of sources: names are marked, so that none is that of the pool or of the null source.
OWN, POOL = "=", "pool"
PLAN = "array<struct<source:string,first:array<bigint>,base:array<bigint>,w:array<bigint>,period:array<bigint>,slots:array<array<bigint>>>>"


def tempered(counts: dict[str | None, int], alpha: float = 0.5, total: int = 1000) -> dict[str | None, int]:
    """Integer weights in proportion to count ** alpha, at least 1 each, of sum about ``total``."""
    return _shares({k: n**alpha for k, n in counts.items()}, total)


def _shares(parts: dict[str | None, float], total: int = 1000) -> dict[str | None, int]:
    whole = sum(parts.values()) or 1.0
    return {k: max(1, round(total * x / whole)) for k, x in parts.items()}


def _tempered(counts: np.ndarray, alpha: float = 0.5, total: int = 1000) -> np.ndarray:
    """The same for many sources."""
    parts = counts.astype(np.float64) ** alpha
    return np.maximum(1, np.rint(total * parts / parts.sum())).astype(np.int64)


def edf(weights: list[int]) -> list[int]:
    """The source that runs in each of sum(weights) slots."""
    period, out = sum(weights), []
    done, due = [0] * len(weights), []
    release: list[list[int]] = [[] for _ in range(period + 1)]
    for i, w in enumerate(weights):
        if w:
            release[0].append(i)
    for t in range(period):
        for i in release[t]:
            heapq.heappush(due, (-(-(done[i] + 1) * period // weights[i]), i))
        _, i = heapq.heappop(due)
        out.append(i)
        done[i] += 1
        if done[i] < weights[i]:
            at = done[i] * period // weights[i]
            if at <= t:
                at = t + 1
            release[at].append(i)
    return out


def plan(blocks: dict[str | None, int], weights: dict[str | None, int]) -> list[dict]:
    """For each source its phases: first block, first slot, weight, period, and slots of its blocks in a period."""
    names = sorted(blocks, key=lambda x: (x is not None, x or ""))
    out = {x: {"source": x, "first": [], "base": [], "w": [], "period": [], "slots": []} for x in names}
    left, base = {x: n for x, n in blocks.items() if n}, 0
    while left:
        active = [x for x in names if x in left and weights.get(x, 0) > 0] or [x for x in names if x in left]
        w = [max(1, weights.get(x, 0)) for x in active]
        g = math.gcd(*w)
        w = [x // g for x in w]
        period, at = sum(w), [[] for _ in active]
        for t, i in enumerate(edf(w)):
            at[i].append(t)
        last = [(left[x] - 1) // w[i] * period + at[i][(left[x] - 1) % w[i]] for i, x in enumerate(active)]
        end = min(last) + 1
        for i, x in enumerate(active):
            used = end // period * w[i] + sum(s < end % period for s in at[i])
            o = out[x]
            o["first"].append(blocks[x] - left[x])
            o["base"].append(base)
            o["w"].append(w[i])
            o["period"].append(period)
            o["slots"].append(at[i])
            left[x] -= used
            if not left[x]:
                del left[x]
        base += end
    return list(out.values())


def slot_of(p: dict, block: int) -> int:
    k = sum(f <= block for f in p["first"]) - 1
    b = block - p["first"][k]
    return p["base"][k] + b // p["w"][k] * p["period"][k] + p["slots"][k][b % p["w"][k]]


def slots(blocks: np.ndarray, weights: np.ndarray, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of source, block and phase of all slots, in their order, about ``at_once`` of them each time.

    The same as ``plan``; ties of blocks due at one slot go by the number of the source.  In a phase first blocks of one weight
    are due together, so of those that have not run only the first of each weight is looked at, and a phase costs no look
    at each source."""
    blocks, weights = np.asarray(blocks, dtype=np.int64), np.asarray(weights, dtype=np.int64)
    left, ran, phase, out = array("q", blocks.tobytes()), array("q", bytes(8 * len(blocks))), 0, (array("q"), array("q"), array("q"))

    def made(now: int) -> Iterator[tuple[np.ndarray, ...]]:
        if len(out[0]) >= now:
            yield tuple(np.array(x, dtype=np.int64) for x in out)
            for x in out:
                del x[:]

    for among, w in ((weights > 0, weights), (weights <= 0, np.ones_like(weights))):
        members = np.flatnonzero(among & (blocks > 0))
        members = members[np.argsort(w[members], kind="stable")]
        same = w[members[1:]] == w[members[:-1]]
        after, before = np.full_like(blocks, -1), np.full_like(blocks, -1)
        after[members[:-1][same]], before[members[1:][same]] = members[1:][same], members[:-1][same]
        after, before, weight = (array("q", x.tobytes()) for x in (after, before, w))
        heads = {weight[i]: i for i in members[np.r_[len(members) > 0, ~same][: len(members)]].tolist()}  # the first source of each weight
        total = (int((w[members] >> 32).sum()) << 32) + int((w[members] & 0xFFFFFFFF).sum())
        while heads:
            first, again, later, t, begun = [(-(-total // x), i) for x, i in heads.items()], [], [], 0, len(out[0])
            heapq.heapify(first)
            while True:
                while later and later[0][0] <= t:
                    heapq.heappush(again, heapq.heappop(later)[1:])
                if first and not (again and again[0] < (*first[0], 0)):
                    (due, i), done = first[0], 1
                    heapq.heapreplace(first, (due, after[i])) if after[i] >= 0 else heapq.heappop(first)
                else:
                    _, i, done = heapq.heappop(again)
                for x, value in zip(out, (i, ran[i], phase), strict=True):
                    x.append(value)
                ran[i] += 1
                left[i] -= 1
                if not left[i]:  # used up: without it a new phase begins
                    p, k, x = before[i], after[i], weight[i]
                    if p >= 0:
                        after[p] = k
                    elif k >= 0:
                        heads[x] = k
                    else:
                        del heads[x]
                    if k >= 0:
                        before[k] = p
                    total, phase = total - x, phase + 1
                    break
                x, t = weight[i], t + 1
                heapq.heappush(later, (done * total // x, -(-(done + 1) * total // x), i, done + 1))
                if t == total <= at_once:  # a whole period: those that follow and use no source up are the same
                    rest, at = np.array(left), members[np.array(left)[members] > 0]
                    more = int(((rest[at] - 1) // w[at]).min())
                    run, block = (np.array(x[begun:], dtype=np.int64) for x in out[:2])
                    yield from made(1)
                    step = max(1, at_once // total)
                    for a in range(1, more + 1, step):
                        k = min(step, more + 1 - a)
                        further = (np.arange(a, a + k)[:, None] * w[run] + block).ravel()
                        yield np.tile(run, k), further, np.full(k * total, phase, dtype=np.int64)
                    rest[at] -= more * w[at]
                    done_now = np.array(ran)
                    done_now[at] += more * w[at]
                    left, ran = array("q", rest.tobytes()), array("q", done_now.tobytes())
                    break
                if total > at_once:
                    yield from made(at_once)
            yield from made(at_once)
    yield from made(1)


def _literal(x, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(x)), kind)


def source_counts(docs: DataFrame, source: str = "source", max_sources: int = MAX_SOURCES) -> dict[str | None, int] | None:
    """Rows by source; None if there are more than ``max_sources``."""
    found = docs.groupBy(F.col(source).cast("string")).count().limit(max_sources + 1).collect()
    return {r[0]: r[1] for r in found} if len(found) <= max_sources else None


def pooled(docs: DataFrame, weights: dict[str | None, int] | None, source: str, max_sources: int, alpha: float = 0.5) -> tuple[dict[str | None, int], dict[str | None, int], list[str | None]]:
    """Rows and weights of max_sources - 1 sources, by OWN and their name, and of POOL; and the names."""
    if max_sources < 2:
        raise ValueError(f"more than {max_sources} sources, and no room for a pool beside one of them")
    each = kept(docs.groupBy(F.col(source).cast("string").alias("s")).agg(F.count(F.lit(1)).alias("n")), "sources")
    given = docs.sparkSession.range(1).select(F.inline(_literal([{"g": k, "w": w} for k, w in (weights or {}).items()], "array<struct<g:string,w:bigint>>")))
    each = each.join(F.broadcast(given), F.col("s").eqNullSafe(F.col("g")), "left")  # a row for each given weight
    each = each.select("s", "n", F.coalesce("w", F.lit(0)).alias("w"), F.round(F.pow("n", F.lit(alpha)) * 1e6).cast("long").alias("part"))
    whole = each.agg(F.sum("n"), F.sum("w"), F.sum("part")).first()
    top = each.orderBy(F.desc("w"), F.desc("n"), F.asc_nulls_first("s")).limit(max_sources - 1).collect()
    label = lambda x: None if x is None else OWN + x
    counts, own, parts = ({label(r["s"]): r[c] for r in top} for c in ("n", "w", "part"))
    for found, total in zip((counts, own, parts), whole, strict=True):
        found[POOL] = total - sum(found.values())
    return counts, _shares(parts) if weights is None else own, [r["s"] for r in top]


def scheduled(docs: DataFrame, weights: dict[str | None, int] | None, block_rows: int, seed: int, key: str, source: str, at_once: int = AT_ONCE) -> DataFrame:
    """``mixed`` for any number of sources and any weights: the place of each block is looked up in a table of all blocks."""
    spark, others = docs.sparkSession, told_apart(docs, key)
    marked = lambda x: "" if x is None else OWN + x
    label = F.coalesce(F.concat(F.lit(OWN), F.col(source).cast("string")), F.lit(""))
    docs = docs.select(F.struct(*docs.columns).alias("row"), shuffle_key(seed, key, *others).alias("_h"), label.alias("_s"))
    each = kept(docs.groupBy("_s").agg(F.count(F.lit(1)).alias("_n")), "sources")
    given = spark.range(1).select(F.inline(_literal([{"_s": marked(k), "_w": w} for k, w in (weights or {}).items()], "array<struct<_s:string,_w:bigint>>")))
    each = each.join(F.broadcast(given), "_s", "left").orderBy("_s")  # a row for each given weight
    each = kept(each.select(F.monotonically_increasing_id().alias("_k"), "_s", "_n", F.coalesce("_w", F.lit(0)).alias("_w")), "sources")
    found = each.select("_k", "_n", "_w").toArrow()  # three numbers for each source
    number, n, w = (found.column(c).to_numpy() for c in ("_k", "_n", "_w"))
    order = np.argsort(number)
    number, n, w = number[order], n[order], w[order]
    if weights is None:
        w = _tempered(n)
    path, slot, position = shared_dir(spark, "blocks"), 0, 0
    for i, b, phase in slots(-(-n // block_rows), w, at_once):
        size = np.minimum(block_rows, n[i] - b * block_rows)
        ends = position + np.cumsum(size)
        made = pa.table({"_k": number[i], "_b": b, "mix_phase": phase.astype(np.int32), "mix_slot": slot + np.arange(len(i)), "_start": ends - size})
        spark.createDataFrame(made).write.mode("append").parquet(path)
        slot, position = slot + len(i), int(ends[-1])
    places = spark.read.schema("_k long, _b long, mix_phase int, mix_slot long, _start long").parquet(path)
    n_buckets = max(256, min(-(-position // 4096), 65536 + position // 262144))  # as in ranked
    docs = docs.withColumn("_bucket", F.least(F.floor(F.col("_h") / F.lit(SHUFFLE_RANGE) * F.lit(float(n_buckets))), F.lit(n_buckets - 1)).cast("int"))
    earlier = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = docs.groupBy("_s", "_bucket").agg(F.count(F.lit(1)).alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(earlier), F.lit(0)))
    spans = counts.join(each.select("_s", "_k"), "_s").repartition("_s", "_bucket")
    spans = spans.withColumn("_b", F.explode(F.expr(f"sequence(_before div {block_rows}L, (_before + _m - 1) div {block_rows}L)"))).join(places, ["_k", "_b"])
    spans = spans.groupBy("_s", "_bucket").agg(F.first("_before").alias("_before"), F.sort_array(F.collect_list(F.struct("_b", "mix_phase", "mix_slot", "_start"))).alias("_at"))
    within = Window.partitionBy("_s", "_bucket").orderBy("_h", *[F.col("row")[c] for c in (key, *others)])
    df = docs.withColumn("_within", F.row_number().over(within) - 1).join(spans, ["_s", "_bucket"])
    df = df.withColumn("_r", F.col("_before") + F.col("_within"))
    df = df.withColumn("_place", F.expr(f"element_at(_at, cast(_r div {block_rows}L - _before div {block_rows}L as int) + 1)"))
    return df.select("row.*", "_place.mix_phase", "_place.mix_slot", F.expr(f"_place._start + _r % {block_rows}L").alias("mix_position"))


def mixed(docs: DataFrame, weights: dict[str | None, int] | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED, key: str = "doc_id", source: str = "source", max_sources: int | None = None) -> DataFrame:
    """docs with mix_phase int, mix_slot long (of the row's block) and mix_position long (0-based, gapless).

    ``weights``: integers by source; by default in proportion to the root of its rows.
    ``max_sources`` (2 at least, if there are more): strata, if the sources beyond shall share the last one (then weights are of
    sum up to MAX_WEIGHT_SUM); by default each source has its own, however many there are."""
    spark = docs.sparkSession
    docs = docs.drop("mix_phase", "mix_slot", "mix_position")
    most = max_sources or MAX_SOURCES
    counts, name, names = source_counts(docs, source, most), F.col(source).cast("string"), None
    others = told_apart(docs, key)
    if max_sources is None and (counts is None or sum((weights or {}).get(x, 0) for x in counts) > MAX_WEIGHT_SUM):
        return scheduled(docs, weights, block_rows, seed, key, source)
    if counts is None:
        counts, weights, names = pooled(docs, weights, source, most)
    weights = tempered(counts) if weights is None else weights
    if sum(weights.get(x, 0) for x in counts) > MAX_WEIGHT_SUM + most:
        raise ValueError(f"weights sum to more than {MAX_WEIGHT_SUM}")
    rows = sum(counts.values())
    blocks = {x: -(-n // block_rows) for x, n in counts.items()}
    phases = plan(blocks, weights)
    short = [{"slot": slot_of(p, blocks[p["source"]] - 1), "missing": blocks[p["source"]] * block_rows - counts[p["source"]]} for p in phases if blocks[p["source"]]]
    short = [x for x in short if x["missing"]]
    table = spark.range(1).select(F.inline(_literal(phases, PLAN)))
    table = table.select(*[F.col(c).alias(f"_{c}") for c in table.columns])
    docs = docs.select(F.struct(*docs.columns).alias("row"), shuffle_key(seed, key, *others).alias("_h"), name.alias("_s"))
    if names is not None:
        own = spark.range(1).select(F.inline(_literal([{"_own": x} for x in names], "array<struct<_own:string>>")), F.lit(True).alias("_named"))
        docs = docs.join(F.broadcast(own), F.col("_s").eqNullSafe(F.col("_own")), "left")  # at most max_sources rows
        docs = docs.withColumn("_s", F.when(F.col("_named"), F.concat(F.lit(OWN), "_s")).otherwise(F.lit(POOL))).drop("_own", "_named")
    df = ranked(docs, ["_s"], ["_h", *[F.col("row")[c] for c in (key, *others)]], F.col("_h") / F.lit(SHUFFLE_RANGE), "_r", rows)
    df = df.join(F.broadcast(table), F.col("_s").eqNullSafe(F.col("_source")), "left")  # at most max_sources rows
    df = df.withColumn("_b", F.expr(f"_r div {block_rows}L"))
    df = df.withColumn("_i", F.size(F.filter("_first", lambda x: x <= F.col("_b"))))
    pick = lambda c: F.element_at(c, F.col("_i"))
    df = df.withColumns({"_b": F.col("_b") - pick("_first"), "_w": pick("_w"), "_base": pick("_base"), "_period": pick("_period"), "_slots": pick("_slots")})
    df = df.withColumn("mix_slot", F.expr("_base + (_b div _w) * _period + element_at(_slots, cast(_b % _w as int) + 1)"))
    gone = F.aggregate(_literal(short, "array<struct<slot:bigint,missing:bigint>>"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["slot"] < F.col("mix_slot"), x["missing"]).otherwise(0))
    df = df.withColumn("mix_position", F.expr(f"mix_slot * {block_rows}L + _r % {block_rows}L") - gone)
    starts = sorted({b for p in phases for b in p["base"]})
    df = df.withColumn("mix_phase", (F.array_position(_literal(starts, "array<bigint>"), F.col("_base")) - 1).cast("int"))
    return df.select("row.*", "mix_phase", "mix_slot", "mix_position")
