"""Each operator against a plain version on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, html, langid, lm, lz, mix, shard, simhash, tokens, wordpiece
from cadenza.llm.common import ALNUM, SHUFFLE_RANGE, SPACED, Words, by_share, checkpoint_root, kept, ranked, shuffle_key

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
r = random.Random(5)


def sentence(n, syllables="an ba co de el fi go ha in jo"):
    return " ".join("".join(r.choice(syllables.split()) for _ in range(r.randint(1, 3))) for _ in range(n))


LONG = sentence(30_000)
PASSAGE = sentence(40)
TEXTS = [None, "", " \n\t ", "A.", "???", "one two three", "One\x0bTWO  three", "x" * 5000, LONG, PASSAGE, PASSAGE + " tail", "lead " + PASSAGE.upper(), PASSAGE, "Ünïcode ÉTÉ straße 　   mixed", "\x1c\x1f odd"]
TEXTS += [sentence(r.randint(1, 60)) for _ in range(25)]
ROWS = [(i * 3 + 1, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
ROWS += [(None, "no id here at all", "en", "s0", 1), ROWS[9], ROWS[9], (5000, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def alnum(t):
    return words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_key(rows):
    return sorted((tuple(x) for x in rows), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9 é.\n\x0b- ", max_size=30), min_size=1, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    for table, plain in ((ALNUM, alnum), (SPACED, words)):
        w = Words(np.frombuffer(b"".join(raw), dtype=np.uint8), off, table)
        got = [[w[k].decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(raw))]
        assert got == [plain(t) for t in texts]


# ---- 1


def plain_contamination(text, items):
    w, hit, found = alnum(text), set(), set()
    for item_id, t in items:
        b = alnum(t)
        n = min(13, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add("" if item_id is None else str(item_id))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [8 << 20, 300, 0])
def test_contamination(spark, docs, empty, block_bytes):
    items = [(1, PASSAGE), (2, "one two three"), (10, " ".join(LONG.split()[100:120])), (3, None), (4, ""), (5, "zzz"), (10, " ".join(LONG.split()[5000:5013])), (None, " ".join(LONG.split()[7:21])), (6, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    odd = docs.withColumn("n_words", F.lit("clash")).withColumn("n_hit", F.lit(1))
    found = decontaminate.judged(decontaminate.contamination(odd, bench, block_bytes=block_bytes)).select("doc_id", "text", "n_words", "n_hit", "item_ids", "items_sha256", "contaminated").collect()
    want = []
    for doc in ROWS:
        n, h, ids = plain_contamination(doc[1], items)
        want.append((doc[0], doc[1], n, h, ids, hashlib.sha256(",".join(ids).encode()).hexdigest(), h > 0 and 20 * h >= n))
    assert by_key(found) == by_key(want) and sum(x[6] for x in want) >= 5
    assert decontaminate.contamination(empty, bench, block_bytes=block_bytes).count() == 0
    assert not decontaminate.judged(decontaminate.contamination(docs, bench.limit(0), block_bytes=block_bytes - 1)).where("contaminated").count()


def test_a_large_benchmark_reads_the_documents_twice(spark, docs):
    """Many items of all lengths, some the same, against the way with one block; texts are not written anew."""
    source = LONG.split()
    items = [(k, " ".join(source[(a := r.randrange(29_000)) : a + r.choice((1, 3, 12, 13, 14, 40)) + 2 * (k % 5)])) for k in range(300)]
    items += [(1000 + k, PASSAGE) for k in range(20)] + [(2000 + k, sentence(30)) for k in range(200)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (decontaminate.contamination(docs, bench, ["doc_id", "n_chars"], block_bytes=b) for b in (8 << 20, 2000))
    assert by_key(many.collect()) == by_key(one.collect())
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 4 and "text" not in many.columns


# ---- 2


def plain_scores(rows):
    toks = [[*words(t), None] for _, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    c, pair, after = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for w, h in zip(toks, held, strict=True):
        for a, b in zip([None, *w], w, strict=False):
            if not h:
                c[b] += 1
                pair[a, b] += 1
                after[a].add(b)
    n, v = sum(c.values()), len(c)
    near = lambda k: float(lm.VALUES[lm.level_of(np.array([k]))[0]]) if k else 0.0
    out = []
    for (i, *_), w, h in zip(rows, toks, held, strict=True):
        base = score = 0.0
        for a, b in zip([None, *w], w, strict=False):
            base += math.log10((c[b] + 1) / (n + v + 1))
            u, before, t = (near(c[b]) + 1) / (n + v + 1), near(c[a]), near(len(after[a]))
            score += math.log10((min(near(pair[a, b]), before) + t * u) / (before + t) if before and t else u)
        out.append((i, h, len(w), sum(c[b] > 0 for b in w), n, base, score))
    return out


@pytest.mark.parametrize("options", [{}, {"run_tokens": 500, "bucket_grams": 300}, {"broadcast_bytes": 0, "bucket_grams": 1000}])
def test_scores(docs, empty, options):
    got = sorted(map(tuple, lm.scored(docs, **options).collect()), key=lambda x: (str(x[0]), x[2]))
    want = sorted(plain_scores(ROWS), key=lambda x: (str(x[0]), x[2]))
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=0.05, abs=2)
    assert lm.scored(empty, **options).count() == 0


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}])
def test_scores_follow_from_the_probes(docs, options):
    """The score of each text, token by token, from single probes of the filter and the smoothing written out."""
    train = [x for x in ROWS if x[0] is None or zlib.crc32(str(x[0]).encode()) % 7 != 2]
    spark = docs.sparkSession
    fit = lm.fitted(spark.createDataFrame([(x[1] or "",) for x in train], "text string"), bucket_grams=1000)
    model, known, probes = fit.filter(), {}, {}

    def word_hash(w):
        if w not in known:
            raw = np.frombuffer(w.encode(), dtype=np.uint8) if w is not None else None
            known[w] = lm.END if w is None else Words(raw, np.array([0, len(raw)]), SPACED).hash[0]
        return known[w]

    def count(kind, key):
        if (kind, key) not in probes:
            probes[kind, key] = float(lm.VALUES[model.level(kind, np.array([key]))[0]])
        return probes[kind, key]

    def p(a, b):
        a, b = np.array([word_hash(a)]), np.array([word_hash(b)])
        one = (count(lm.WORD, b[0]) + 1) / (fit.n + fit.v + 1)
        seen, after = count(lm.WORD, a[0]), count(lm.AFTER, lm.after_key(a)[0])
        pair = min(count(lm.PAIR, lm.pair_key(a, b)[0]), seen)
        return (pair + after * one) / (seen + after) if seen and after else one

    want = []
    for i, t, *_ in ROWS:
        w = [*words(t), None]
        want.append((i, len(w), sum(math.log10(p(a, b)) for a, b in zip([None, *w], w, strict=False))))
    got = [(x["doc_id"], x["n_tokens"], x["score"]) for x in lm.scored(docs, bucket_grams=1000, **options).collect()]
    for g, x in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert g[:2] == x[:2] and g[2] == pytest.approx(x[2], rel=1e-9)


def test_scores_do_not_change_with_the_size_of_the_filter(docs, empty):
    near = sorted(map(tuple, lm.scored(docs, bucket_grams=1000).collect()), key=lambda x: (str(x[0]), x[2]))
    far = sorted(map(tuple, lm.scored(docs, bucket_grams=1000, broadcast_bytes=1).collect()), key=lambda x: (str(x[0]), x[2]))
    assert [x[:5] for x in far] == [x[:5] for x in near]
    assert [x[5:] for x in far] == [pytest.approx(x[5:], rel=1e-12) for x in near]
    assert lm.scored(empty, broadcast_bytes=1).count() == 0


def test_texts_are_dealt_out_once_where_the_filter_is_routed(docs):
    found = lm.scored(docs, bucket_grams=1000, broadcast_bytes=1)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_nothing_to_learn_from(docs):
    for options in ({}, {"broadcast_bytes": -1}):
        assert {(x["n_known"], x["score"]) for x in lm.scored(docs, held_out=F.lit(True), **options).collect()} == {(0, 0.0)}


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=30))
def test_packed_keys_come_back(keys):
    keys = np.array(sorted(keys), dtype=np.uint64)
    assert lm._unpacked(lm._packed(keys)).tolist() == keys.tolist()


def test_filter_misses_no_count():
    keys = np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    keys.sort()
    counts = np.random.default_rng(4).geometric(0.02, 5000)
    bits = lm.segment(keys, counts)
    f = lm.Filter(iter([{"kind": lm.PAIR, "bucket": 0, "segment": bits, "keys": None, "counts": None}]), 1, len(bits) // 8, 0)
    assert (f.level(lm.PAIR, keys) >= lm.level_of(counts)).all() and (f.level(lm.PAIR, keys) == lm.level_of(counts)).mean() > 0.9
    assert (f.level(lm.PAIR, lm.mix(keys)) == 0).mean() > 0.94


# ---- 3

LANGS = {"en": "the of and ing tion wh sh", "de": "der die und ung sch keit ver", "fr": "le eau oux é è ment que", "es": "ción os ar ll ñ ue mente"}


def test_languages(spark, docs, empty):
    rows = [(i, sentence(r.randint(4, 40), LANGS[x]), x, "s", 0) for i, x in enumerate(r.choice(sorted(LANGS)) for _ in range(400))]
    df = spark.createDataFrame([*rows, (900, None, "en", "s", 0), (901, "12 34 !!", "en", "s", 0), (902, "é" * 3, None, "s", 0)], SCHEMA)
    model = langid.trained(df.where(langid.in_training()))
    assert model.families == ["germanic", "romance"] and set(model.pairs["romance"]) == {("es", "fr")}
    got = {x["doc_id"]: x for x in langid.predicted(df.withColumn("score", F.lit("clash")), model, ["doc_id", "lang", "score"]).collect()}
    held = [x for x in got.values() if x["doc_id"] < 900 and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    assert sum(x["lang_pred"] == x["lang"] for x in held) >= 0.97 * len(held)
    assert (got[900]["lang_pred"], got[900]["score"], got[901]["lang_pred"]) == ("und", 0.0, "und") and got[902]["lang_pred"] in LANGS
    assert all(0 <= x["score"] <= 1 for x in got.values())
    few = langid.trained(df, max_languages=3)
    rows_of = collections.Counter(x[2] for x in [*rows, (0, "", "en")])
    assert few.langs == sorted(sorted(rows_of, key=lambda x: (-rows_of[x], x))[:3])
    assert {x["lang_pred"] for x in langid.predicted(docs, langid.trained(empty)).collect()} == {"und"}
    assert {x["lang_pred"] for x in langid.predicted(docs, langid.trained(docs)).collect()} == {"en", "und"}
    assert langid.predicted(empty, model).count() == 0


@pytest.mark.parametrize(("text", "letters"), [("½ ² ³", False), ("Ⅷ ⅳ", False), ("① ㈠", False), ("٣ १", False), ("_ - 7", False), ("²a", True), ("½é", True), ("ª", True), ("中", True), ("ʰ", True), ("\u0301", False)])
def test_only_category_l_is_a_letter(spark, text, letters):
    assert langid.has_letter(text.encode()) == letters == any(unicodedata.category(c)[0] == "L" for c in text)
    shares = np.zeros((2, langid.FEATURES), dtype=np.float32)
    got = langid.predicted(spark.createDataFrame([(text,)], "text string"), langid.Model(shares, ["en", "de"])).first()
    assert (got["lang_pred"] == langid.UND, got["score"] == 0.0) == (not letters, not letters)


def test_equal_votes_go_to_the_larger_margins_then_to_the_first():
    model = langid.Model(np.zeros((3, langid.FEATURES), dtype=np.float32), ["ca", "es", "fr"])
    model.families, model.members, pairs = ["romance"], {"romance": ["ca", "es", "fr"]}, [("ca", "es"), ("ca", "fr"), ("es", "fr")]
    model.pairs = {"romance": {x: k for k, x in enumerate(pairs)}}
    for margins, want in (((1, -2, 1), "fr"), ((1, -1, 1), "ca"), ((3, -1, 1), "ca")):
        model.margins = lambda body, off, m=margins: np.array([m], dtype=float)
        assert model.predict(None, None, np.array([True]))[0] == [want]


# ---- 4


def plain_fingerprint(t):
    w = words(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps, limit=4):
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(fps))]


def test_near_groups(docs, empty):
    fps = [plain_fingerprint(x[1]) for x in ROWS]
    group = plain_groups(fps)
    least = {g: min((x[0] for x, k in zip(ROWS, group, strict=True) if k == g and x[0] is not None), default=None) for g in set(group)}
    want = [(x[0], simhash._signed(f), least[g]) for x, f, g in zip(ROWS, fps, group, strict=True)]
    got = simhash.near_groups(docs.withColumn("fp", F.lit("clash")))
    assert by_key(got.select("doc_id", "fp", "component_id").collect()) == by_key(want)
    stay = simhash.deduplicated(docs).collect()
    assert len(stay) == len(set(group)) and stay[0].__fields__ == SCHEMA.replace("string", "").replace("long", "").replace(" ", "").split(",")
    assert {plain_fingerprint(x["text"]) for x in stay} <= set(fps)
    assert simhash.near_groups(empty).count() == 0 and simhash.deduplicated(empty).count() == 0


def test_a_repeated_id_keeps_no_near_copy(spark):
    text, other = sentence(60), sentence(60)
    rows = [(3, text, "en", "s", 1), (5, text, "en", "s", 2), (5, other, "en", "s", 3)]
    stay = simhash.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert by_key(stay) == by_key([rows[0], rows[2]])


def test_repeated_and_null_ids_in_several_groups(spark):
    a, b, c = sentence(60), sentence(60), sentence(60)
    rows = [(3, a, "en", "s", 1), (5, a, "en", "s", 2), (5, b, "en", "s", 3), (None, b, "en", "s", 4), (None, c, "en", "s", 5), (None, c, "de", None, 6), (None, c, "en", "s", 5), (7, a, "en", "s", 1), (7, a, "en", "s", 1), (3, a, "fr", "t", 9)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"fp": F.lit("clash"), "root": F.lit(1), "_row": F.lit("own")})
    got = [simhash.deduplicated(x).collect() for x in (df, df.repartition(7).orderBy("n_chars"))]
    assert by_key(got[0]) == by_key(got[1]) and got[0][0].__fields__ == df.columns
    stay = [tuple(x)[:5] for x in got[0]]
    assert len(stay) == 3 and {x[1]: x[0] for x in stay} == {a: 3, b: 5, c: None} and set(stay) <= set(rows)


@pytest.fixture(scope="module")
def cloud():
    rng, out = random.Random(9), set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(50):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 8)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("bucket", "limit", "parts"), [(1 << 16, 4, None), (15, 4, None), (15, 3, None), (1 << 16, 4, [(range(21), 1), (range(21, 42), 1), (range(42, 64), 0)]), (40, 4, [(range(32), 2), (range(32, 64), 1)])])
def test_links_connect_what_is_close(spark, cloud, bucket, limit, parts):
    plan = None
    if parts:
        plan = simhash.Plan.__new__(simhash.Plan)
        plan.n, plan.parts = len(cloud), [(list(b), t) for b, t in parts]
    signed = [simhash._signed(x) for x in cloud]
    links = simhash.linked(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3), limit, bucket, plan)
    root = {x["node"]: x["root"] for x in simhash.components(links).collect()}
    group = plain_groups(cloud, limit)
    least = {g: min(s for s, k in zip(signed, group, strict=True) if k == g) for g in set(group)}
    assert [root.get(s, s) for s in signed] == [least[g] for g in group]
    assert links.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > limit).count() == 0


@pytest.mark.parametrize("n", [1, 1000, 236_000, 14_000_000, 10**9, 10**11])
def test_thresholds_satisfy_the_pigeonhole(n):
    half = np.full((64, 64), n / 4) + np.eye(64) * n / 4
    for both in (half, np.zeros((64, 64)), np.eye(64) * n / 2):
        parts = simhash.Plan(n, both, 4).parts
        assert sum(t + 1 for _, t in parts) == 5
        bits = [b for g, _ in parts for b in g]
        assert len(bits) == len(set(bits)) <= 64


# ---- 5


def test_schedule_is_within_a_block_and_gapless():
    rng = random.Random(1)
    for _ in range(60):
        w = [rng.randint(1, 40) for _ in range(rng.randint(1, 9))]
        got = [0] * len(w)
        for t, i in enumerate(mix.edf(w), 1):
            got[i] += 1
            assert all(abs(got[k] - t * w[k] / sum(w)) < 1 for k in range(len(w)))
        blocks = {str(i): rng.randint(0, 50) for i in range(len(w))}
        plan = mix.plan(blocks, {str(i): x for i, x in enumerate(w[:-1])})
        assert sorted(mix.slot_of(p, j) for p in plan for j in range(blocks[p["source"]])) == list(range(sum(blocks.values())))


def nulls_first(*values):
    return tuple((v is not None, 0 if v is None else v) for v in values)


def dealt(seed, *values):
    return int(hashlib.md5("|".join([str(seed), *["" if v is None else str(v) for v in values]]).encode()).hexdigest()[:8], 16) >> 1


def shuffled(rows, seed):
    """Rows as dicts, by source, in their random order; told apart by all columns."""
    names = sorted(set(rows[0]) - {"doc_id"})
    order = lambda x: (dealt(seed, x["doc_id"], *[x[c] for c in names]), nulls_first(x["doc_id"], *[x[c] for c in names]))
    out = collections.defaultdict(list)
    for x in sorted(rows, key=order):
        out[x["source"]].append(x)
    return out


def plain_mixture(rows, weights, block_rows, seed=mix.SEED):
    """Slot by slot: of the sources with a released block the one that is due first, then by name."""
    left = {k: [x[i : i + block_rows] for i in range(0, len(x), block_rows)] for k, x in shuffled(rows, seed).items()}
    out, slot, phase = [], 0, 0
    while left:
        active = sorted([k for k in left if weights.get(k, 0) > 0] or left, key=nulls_first)
        w = {k: max(1, weights.get(k, 0)) for k in active}
        total, done, t = sum(w.values()), dict.fromkeys(active, 0), 0
        while all(left[k] for k in active):
            ready = [k for k in active if done[k] * total // w[k] <= t]
            k = min(ready, key=lambda k: (-(-(done[k] + 1) * total // w[k]), active.index(k)))
            out += [(x, phase, slot) for x in left[k].pop(0)]
            done[k], t, slot = done[k] + 1, t + 1, slot + 1
        left, phase = {k: x for k, x in left.items() if x}, phase + 1
    return out


@pytest.mark.parametrize(("weights", "block_rows"), [({"s0": 3, "s1": 1}, 2), (None, 3), ({None: 5, "s2": 2}, 1)])
def test_every_row_has_its_place_in_the_mixture(docs, weights, block_rows):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), x, strict=True)) for x in ROWS]
    given = mix.tempered(collections.Counter(x["source"] for x in rows)) if weights is None else weights
    want = [(*[x[c] for c in docs.columns], phase, slot, k) for k, (x, phase, slot) in enumerate(plain_mixture(rows, given, block_rows))]
    got = mix.mixed(docs, weights, block_rows=block_rows).select(*docs.columns, "mix_phase", "mix_slot", "mix_position").collect()
    assert by_key(got) == by_key(want)


def test_mixed(docs, empty):
    odd = docs.withColumns({"mix_slot": F.lit("clash"), "_s": F.lit("own"), "_h": F.lit(1), "row": F.lit(2), "_bucket": F.lit(3)})
    got = mix.mixed(odd, {"s0": 3, "s1": 1}, block_rows=2).collect()
    assert sorted(x["mix_position"] for x in got) == list(range(len(ROWS))) and {(x["_s"], x["_h"], x["row"], x["_bucket"]) for x in got} == {("own", 1, 2, 3)}
    inside = [x for x in sorted(got, key=lambda x: x["mix_position"]) if x["mix_phase"] == 0]
    seen = collections.Counter()
    for k, x in enumerate(inside, 1):
        seen[x["source"]] += 1
        assert x["source"] in ("s0", "s1")
        if k % 2 == 0:  # after whole blocks
            assert abs(seen["s0"] - 0.75 * k) < 2
    assert by_key(x[:5] for x in got) == by_key(ROWS) and mix.mixed(empty).count() == 0
    with pytest.raises(ValueError, match="more than 1 sources"):
        mix.mixed(docs, max_sources=1)


@pytest.mark.parametrize(("weights", "places"), [(None, 4), (None, 2), ({"h4": 2, "h6": 1, None: 1}, 3)])
def test_sources_beyond_the_plan_share_a_pool(spark, weights, places):
    rows = [(i, "big" if i % 2 else None if i % 10 == 0 else "pool" if i % 10 == 2 else f"h{i % 60}") for i in range(1200)]
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, source string").repartition(3)
    got = sorted(mix.mixed(df, weights, block_rows=2, max_sources=places).collect(), key=lambda x: x["mix_position"])
    assert [x["mix_position"] for x in got] == list(range(1201)) and by_key(x[:2] for x in got) == by_key([*rows, rows[5]])
    counts, given, names = mix.pooled(df, weights, "source", places)
    assert names == {4: ["big", None, "pool"], 2: ["big"], 3: ["h4", None]}[places]
    inside, seen = [x for x in got if x["mix_phase"] == 0], collections.Counter()
    label = lambda x: mix.POOL if x not in names else None if x is None else mix.OWN + x
    assert len(inside) > 10 and sum(counts.values()) == 1201
    for k, x in enumerate(inside, 1):
        seen[label(x["source"])] += 1
        assert all(abs(seen[s] - k * given[s] / sum(given.values())) < 2 * 2 for s in counts)


def test_more_sources_than_the_plan_holds(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), (F.col("id") % 1500).cast("string")).alias("source"))
    got = mix.mixed(df)
    assert got.count() == 4000 and got.agg(F.min("mix_position"), F.max("mix_position"), F.count_distinct("mix_position")).first() == (0, 3999, 4000)


def test_slots_of_many_sources_are_those_of_the_plan():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 14)
        blocks, w = [rng.choice([0, 1, 2, rng.randint(0, 300)]) for _ in range(n)], [rng.choice([0, 1, 1, 2, rng.randint(0, 40)]) for _ in range(n)]
        parts = list(mix.slots(np.array(blocks), np.array(w), rng.choice([1, 7, 50, 1000, mix.AT_ONCE])))
        got = list(zip(*[np.concatenate([x[c] for x in parts]).tolist() if parts else [] for c in range(3)], strict=True))
        plan = mix.plan({f"{i:02d}": b for i, b in enumerate(blocks)}, {f"{i:02d}": x for i, x in enumerate(w)})
        want = {mix.slot_of(p, j): (int(p["source"]), j, max(b for b, f in zip(p["base"], p["first"], strict=True) if f <= j)) for p in plan for j in range(blocks[int(p["source"])])}
        starts = sorted({x[2] for x in want.values()})
        assert got == [(i, j, starts.index(b)) for i, j, b in (want[k] for k in range(len(want)))]


@pytest.mark.parametrize(("weights", "block_rows"), [(None, 3), ({"s0": 3_000_000_000, "s1": 1_000_000_001}, 2), ({None: 5, "s2": 2}, 1)])
def test_every_row_has_its_place_without_a_plan(docs, monkeypatch, weights, block_rows):
    monkeypatch.setattr(mix, "MAX_SOURCES", 2)
    test_every_row_has_its_place_in_the_mixture(docs, weights, block_rows)


def test_large_weights_need_no_plan(docs):
    test_every_row_has_its_place_in_the_mixture(docs, {"s0": 30_000, "s1": 10_001}, 2)


def test_query_on_more_sources_than_the_plan_holds_equals_sql(spark, tmp_path):
    duckdb, queries = pytest.importorskip("duckdb"), pytest.importorskip("cadenza.llm.queries")
    names = F.when(F.col("id") % 3 == 0, "pool").when(F.col("id") % 50 != 1, F.concat(F.lit("h"), (F.col("id") % 1313 % (F.col("id") % 1301 + 1)).cast("string")))
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), names.alias("source"), F.when(F.col("id") % 7 != 0, "x").alias("text"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    assert rows.select("source").distinct().count() > 1024
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = c.execute(queries.ORACLES["op5_mix"]).fetchall()
    assert by_key(queries.QUERIES["op5_mix"](spark, str(tmp_path)).collect()) == by_key(want)


def test_many_sources_without_a_weight_follow_the_others(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("h"), (F.col("id") % 1500).cast("string")).alias("source"))
    weights = {f"h{i}": 1 + i % 3 for i in range(0, 1400, 2)}
    got = sorted(mix.mixed(df, weights, block_rows=2).collect(), key=lambda x: x["mix_position"])
    given = sum(x["source"] in weights for x in got)
    assert all(x["source"] in weights for x in got[:given]) and len(got) == 4000
    assert [x["source"] for x in got if x["mix_slot"] < 2] == sorted(w for w in weights if weights[w] == 3)[0:1] * 2 + sorted(w for w in weights if weights[w] == 3)[1:2] * 2


# ---- 6


@pytest.fixture(scope="module")
def field():
    return html.trained()


def test_blocks_of_unseen_layouts(field):
    wrong = total = 0
    for page in html.labelled_pages(150, seed=77):
        b = html.blocks(page)
        wrong += sum(x.label != y for x, y in zip(b, field.decode(html.features(b)), strict=True))
        total += len(b)
    assert wrong <= 0.01 * total


def test_viterbi_and_marginals_against_enumeration(field):
    from itertools import product

    e = [0.3, -1.2, 2.0, 0.1, -0.4]
    score = lambda y: sum(x for x, k in zip(e, y, strict=True) if k) + sum(field.pair[a, b] for a, b in zip(y, y[1:], strict=False))
    every = list(product((0, 1), repeat=len(e)))
    field2 = html.Field()
    field2.w, field2.pair = {str(k): x for k, x in enumerate(e)}, field.pair
    assert tuple(field2.decode([[str(k)] for k in range(len(e))])) == max(every, key=score)
    p, pairs = field2.expected(e)
    z = sum(math.exp(score(y)) for y in every)
    assert p.tolist() == pytest.approx([sum(math.exp(score(y)) for y in every if y[t]) / z for t in range(len(e))])
    assert pairs.sum() == pytest.approx(len(e) - 1)


def test_pages(spark, field):
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad">Buy it now.</div><article><h1>A &amp; B</h1><p>One&nbsp;two\n three <b>bold</b><br>four.<p>Ende &lt;p&gt; &#8364;.</p><div class="comments"><p>First! Nice text, thanks.</p></div></article><!-- <p>no</p> --><footer>&copy; me</footer></body></html>'
    want = "A & B\n\nOne two three bold four.\n\nEnde <p> €."
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p>open <div"), (5, "u", "<script>x"), (5, "u", page.replace("</body></html>", ""))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(0))
    got = html.extracted(df, field=field).orderBy("page_id").collect()
    assert [x["text"] for x in got if x["page_id"] in (1, 2, 3)] == [want, "", ""] and [x["text"] for x in got if x["page_id"] == 5 and x["text"]] == [want]
    assert all(x["n_chars"] == len(x["text"]) for x in got) and len(got) == 6
    assert html.extracted(df.limit(0), field=field).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<svg class=i />b<math/>c</p>d", ["a bc", "d"]),
        ("<p>a<svg title='x>y'/>b<svg><text>no</text></svg>c", ["a b c"]),
        ("<p>a</p><video-player src=x></video-player><p>b<svg-icon>c</svg-icon><select-menu></select-menu><template-x>d", ["a", "bcd"]),
        ("<html><head><meta charset=utf-8><title>no</title><style>no{}</style><p>a</p><p>b", ["a", "b"]),
        ("<head><title>no</title></head><p>a</p>", ["a"]),
        ("<p>Let <math><mi>x</mi><annotation>no</annotation></math> be real.", ["Let x be real."]),
        ("<p>a<video src=x><p>b<noscript> c<iframe><canvas>d", ["a", "b c d"]),
        ("<p>a <video src=x>b <track></video><object data=x>c</object> <canvas>d</canvas> <noscript>e <img></noscript>f", ["a b c d e f"]),
        ("<p>a<script src=x\">no('>')</script>b<style>no", ["a b"]),
        ("<p>a<SELECT><option>no</Select >b<textarea>no", ["a b"]),
    ],
)
def test_hidden_elements_take_no_more_than_theirs(page, want):
    assert [b.text for b in html.blocks(page)] == want


def test_many_unclosed_elements_take_linear_time():
    import time

    start = time.perf_counter()
    assert html.blocks("<svg><iframe>x" * 50_000)[0].text.startswith("x x")
    assert time.perf_counter() - start < 20


# ---- 7


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12), st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12), st.text("abc", min_size=1, max_size=14))
def test_automaton_counts_greedy_pieces(begin, go_on, word):
    at, n, have = 0, 0, begin
    while at < len(word):
        to = next((j for j in range(len(word), at, -1) if word[at:j] in have), None)
        if to is None:
            n = 1
            break
        at, n, have = to, n + 1, go_on
    assert wordpiece.Automaton(begin, go_on).count(word) == n


def test_token_counts(docs, empty):
    vocabulary = (["an", "one", "two"], ["ba", "co", "e"])
    count = wordpiece.Automaton(*vocabulary).count
    got = wordpiece.token_counts(docs.withColumn("n_words", F.lit("clash")), vocabulary, ["doc_id", "text"]).collect()
    split = lambda t: (t or "").encode().split()
    assert by_key(got) == by_key((x[0], x[1], len(split(x[1])), sum(count(w.decode()) for w in split(x[1]))) for x in ROWS)
    assert wordpiece.token_counts(empty, vocabulary).count() == 0


def greedy(word, begin, go_on, raw):
    """The split of the mark and the word by whole pieces; a character outside is its bytes, or one."""
    text, have, at, n = "▁" + word, {"▁" + p for p in begin} | set(go_on), 0, 0
    while at < len(text):
        to = next((j for j in range(len(text), at, -1) if text[at:j] in have), None)
        b = text[at].encode()
        n += 1 if to or not set(b) <= set(raw) else len(b)
        at = to or at + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", max_size=4), max_size=10), st.sets(st.text("abé", min_size=1, max_size=4), max_size=10), st.sampled_from([range(256), range(128)]), st.text("abéñ", min_size=1, max_size=12))
def test_no_word_is_given_up(begin, go_on, raw, word):
    assert wordpiece.Automaton(begin, go_on, raw).count(word) == greedy(word, begin, go_on, raw)


def test_words_of_the_model_without_a_piece_at_their_start():
    vocabulary = wordpiece.sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    count = wordpiece.Automaton(*vocabulary).count
    assert (count("1999"), count("ñgaó"), count("日本語の文章です")) == (5, 4, 9)
    for w in ("the", "word\U0001f9ff", "\u1234\u1235", "a▁b", "▁", "çedilha", "x" * 300):
        assert count(w) == greedy(w, *vocabulary)


# ---- 8


def test_shards(docs, empty):
    got = shard.sharded(shard.sized(docs.withColumn("shard", F.lit("clash")))).collect()
    sizes = collections.Counter(x["shard"] for x in got)
    assert max(sizes.values()) - min(sizes[k] for k in range(24)) <= 1 and len(got) == len(ROWS)
    for k, n in sizes.items():
        assert sorted(x["slot"] for x in got if x["shard"] == k) == list(range(n))
    assert all(x["size"] == len((x["text"] or "").encode()) + 8 and x["text_crc32"] == zlib.crc32((x["text"] or "").encode()) for x in got)
    assert shard.sharded(empty).count() == 0


def test_every_row_has_its_shard(docs):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), x, strict=True)) for x in ROWS]
    names = sorted(set(rows[0]) - {"doc_id"})
    placed = []
    for source, own in shuffled(rows, shard.SEED).items():
        phase = dealt(shard.SEED, source) / 2**31
        placed += [((k + phase) / len(own), x) for k, x in enumerate(own)]
    placed.sort(key=lambda y: (y[0], nulls_first(y[1]["source"], y[1]["doc_id"], *[y[1][c] for c in names])))
    n, want = len(rows), []
    for p, (_, x) in enumerate(placed):
        k = p * 24 // n
        want.append((*[x[c] for c in docs.columns], k, p - -(-k * n // 24)))
    assert by_key(shard.sharded(docs).select(*docs.columns, "shard", "slot").collect()) == by_key(want)


def test_sources_of_one_row_do_not_meet_in_one_bucket(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"))
    got = shard.sharded(df, shards=3).groupBy("shard").count().collect()
    assert [x["count"] for x in got] == [1000] * 3
    phases = df.select((shuffle_key(shard.SEED, "source") / SHUFFLE_RANGE).alias("u")).groupBy(F.floor(F.col("u") * 10)).count().collect()
    assert len(phases) == 10 and max(x["count"] for x in phases) < 400


def test_every_shard_has_the_mixture(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    got = shard.sharded(df, shards=10).groupBy("shard", "source").count().collect()
    total = {x["source"]: x["count"] for x in df.groupBy("source").count().collect()}
    assert all(abs(x["count"] - total[x["source"]] / 10) <= 2 for x in got)


def test_ranks(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("h"))
    got = ranked(df, ["g"], ["h"], F.col("h") / 50.0, "rank", 500, "total").collect()
    for g in range(3):
        own = sorted((x["rank"], x["h"]) for x in got if x["g"] == g)
        assert [a for a, _ in own] == list(range(len(own))) and [b for _, b in own] == sorted(b for _, b in own) and {x["total"] for x in got if x["g"] == g} == {len(own)}


# ---- 9


def in_order(rows):
    """By id, null first, then by the hash of the text, then by the text."""
    signed = lambda t: simhash._signed(xxhash.xxh64_intdigest(t.encode(), 42))  # noqa: E731  Spark's xxhash64
    return sorted(rows, key=lambda x: (nulls_first(x[0]), signed(x[1] or ""), x[1] or ""))


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    plain, start, want = Tokenizer.from_file(WORD_BPE), 0, []
    for i, t, *_ in in_order(ROWS):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    manifest = tokens.write_tokens(docs.withColumn("ids", F.lit("clash")), WORD_BPE)
    assert by_key(tokens.read_tokens(manifest).collect()) == by_key(want)
    first = manifest.orderBy("part").first()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(first["index_path"])
    index = np.frombuffer(store.open_input_stream(path).read(), dtype=[("at", "<u8"), ("size", "<u8"), ("doc", "<i8")])
    at = index[-1]
    doc_id, ids = tokens.read_at(spark, first["path"], int(at["at"]), int(at["size"]))
    assert len(index) == first["records"] and (doc_id or 0) == at["doc"] and ids[-1] == 2
    assert tokens.read_tokens(tokens.write_tokens(empty, WORD_BPE)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aB. ,'sé́İß \x1c<|endoftext|>9", max_size=30)), max_size=5))
def test_words_encode_as_texts_do(texts):
    e = tokens.Encoder.at(WORD_BPE)
    assert e.encode([t.encode() for t in texts]) == e._plain([t.encode() for t in texts])


@pytest.mark.parametrize("remembered", [0, 3, 1000])
def test_words_that_are_forgotten(remembered):
    e = tokens.Encoder(WORD_BPE, remembered)
    assert e.parted and e.lowers
    texts = ["Été été. ÉTÉ*** don't ab.%% 'll <|endoftext|>, ab", "", "ÿÞ÷ ×a a×! Ab ab' ab\u0301. \ufffd", "x" * 5000 + "!" * 5000] * 2
    for t in [texts, texts[::-1], [texts[0]]]:
        assert e.encode([x.encode() for x in t]) == e._plain([x.encode() for x in t])


def test_damage_is_seen():
    import io

    good = tokens.frame(b"payload") + tokens.frame(b"")
    assert list(tokens.unframe(io.BytesIO(good).read)) == [b"payload", b""]
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 4
        with pytest.raises(ValueError, match="broken"):
            list(tokens.unframe(io.BytesIO(bytes(bad)).read))


# ---- 10


def plain_phrases(text):
    known, p = set(), ""
    for c in text:
        p += c
        if p not in known:
            known.add(p)
            p = ""
    return sorted({xxhash.xxh64_intdigest(x) >> 32 for x in known})[: lz.SIZE]


def test_phrases(docs, empty):
    rows = in_order(ROWS)
    want = []
    for k, (i, t, *_) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = plain_phrases(t), plain_phrases(edited), plain_phrases(after)
        spell = lambda x: "".join(f"{h:08x}" for h in x)
        like = lambda x, y: float(x == y) if not x or not y else len(set(x) & set(y) & set(sorted({*x, *y})[: lz.SIZE])) / len(sorted({*x, *y})[: lz.SIZE])
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), spell(a), spell(b), like(a, b), like(a, c)))
    assert by_key(lz.next_compared(docs.withColumn("kind", F.lit("clash"))).collect()) == by_key(want)
    assert lz.next_compared(empty).count() == 0
    assert lz.next_compared(docs.where("doc_id = 16")).first()["near_next"] == 1.0


def test_one_dictionary_serves_a_long_text():
    """More phrases than the 2^20 after which the dictionary once began anew; beginning and end are alike."""
    rng = np.random.default_rng(8)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9000, 3_200_000)))
    parse = lz.Parse().feed(text)
    assert len(parse.known) > 1 << 20
    before = parse.signature().tolist()
    assert parse.feed("a").signature().tolist() == sorted({*before, *plain_phrases(parse.open + "a")})[: lz.SIZE] or parse.open
    assert before == plain_phrases(text)


# ---- what the operators share


def test_kept_is_the_same(docs):
    assert by_key(kept(docs).collect()) == by_key(ROWS)


def test_no_machine_local_folder_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("", (), {"master": "spark://x:7077", "getConf": lambda self: Conf()})()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        checkpoint_root(Cluster())


@pytest.fixture
def wide(spark):
    """Sixteen partitions that Spark does not put together."""
    put = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def largest(df):
    """The greatest share of the rows that one partition has."""
    n = [x["count"] for x in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) / sum(n)


def test_no_key_makes_a_large_task(wide):
    """A third of the rows under one key (an empty text, a null id, one source)."""
    n = 6000
    text = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat_ws(" ", *[F.md5(F.concat("id", F.lit(str(k)))) for k in range(6)]))
    df = wide.range(n, numPartitions=16).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("source"))
    groups = simhash.near_groups(df)
    assert groups.count() == n and largest(groups) < 2 / 16 + 0.05
    null_ids = df.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 1, F.col("doc_id")))
    buckets = null_ids.groupBy("source", F.floor(shuffle_key(1, "doc_id", "source", "text") / F.lit(SHUFFLE_RANGE) * 256)).count()
    assert buckets.where("source <> 'hot'").agg(F.max("count")).first()[0] < 20
    files = tokens.write_tokens(null_ids.repartition(16), WORD_BPE)
    assert files.agg(F.max("records")).first()[0] < n * (1 / 16 + 1 / 3 / 3) + 700 and files.count() > 8
    table = wide.createDataFrame([("hot", 7, 2000), ("1", 8, 80)], "source string, v int, n long")
    joined = by_share(df, table, "source", "n", n)
    assert joined.where("v = 7").count() == 2000 and joined.where("v = 8").count() == df.where("source = '1'").count()
    assert largest(joined.where("v = 7")) < 2 / 16
