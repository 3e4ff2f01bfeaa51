"""Operator 3, language identification by hierarchical discrimination.

A text's features are the shares of its byte trigrams (ASCII letters lower-cased, other ASCII a space), hashed to
``FEATURES`` places.  A first set of linear support vector machines, one against the rest, tells the family; inside it
linear support vector machines, one for each pair of its languages, vote.  Scores are logistic functions of the margins.

Training takes a bounded sample of labelled rows on the driver: about ``SAMPLE_ROWS`` in all, dealt equally over languages
and chosen by a hash of the id, but ``LEAST_ROWS`` of each language, so about MAX_LANGUAGES * LEAST_ROWS = 8000 at most.  Of
more than ``MAX_LANGUAGES`` labels those with the most rows are in the sample, equals by name; the others are not learned.
Predictions read every text whole, in a narrow pass with the weights broadcast (their size depends on the number of
languages learned only).

Defined cases: a null text or one without a letter (Unicode category L: numerals such as a superscript two or a Roman
eight are none) is ``und`` with score 0; without any labelled row all texts are
``und`` with score 0; with one language every text with letters gets it, score 1; a label outside the table of families
is a family of its own; equal votes go to the larger sum of margins, then to the first in order; other columns may be
carried along, one named like an output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import CHUNK_BYTES, crc_mod, raw_text, text_batches

FEATURES, SAMPLE_ROWS, LEAST_ROWS, MAX_LANGUAGES, STEPS = 4096, 2000, 20, 400, 120
UND = "und"

#: Language families by ISO 639-1 code (fixed values).
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo_aryan": "bn gu hi mr ne pa sd si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "celtic": "br cy ga gd",
    "austronesian": "id jv mg ms su tl",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_LETTER, _ASCII_LETTER = re.compile(r"[^\W\d_]"), re.compile(rb"[A-Za-z]")


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def trigrams(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of a batch and the text of each; runs of spaces have none."""
    x = _LETTERS[body].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h = ((h * np.uint32(0x27D4EB2F)) >> np.uint32(20)) % np.uint32(FEATURES)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = (text[:-2] == text[2:]) & ((x[1:-1] != 32) | ((x[:-2] != 32) & (x[2:] != 32)))
    return h[keep].astype(np.int64), text[:-2][keep]


def has_letter(text: bytes) -> bool:
    """_LETTER also finds numerals that are no decimal digits; isalpha() is category L."""
    return bool(_ASCII_LETTER.search(text)) or any(m[0].isalpha() for m in _LETTER.finditer(text.decode("utf-8", "replace")))


def _svm(x: np.ndarray, y: np.ndarray, steps: int = STEPS, c: float = 30.0) -> tuple[np.ndarray, float]:
    """Squared hinge loss, classes weighed equally, by accelerated gradient steps; y is 1 or -1."""
    n = len(y)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))).astype(np.float32) * np.float32(c / n)
    x = np.hstack((x, np.ones((n, 1), dtype=np.float32)))
    v = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(8):
        v = x.T @ (weight * (x @ v))
        v /= np.linalg.norm(v) + 1e-12
    step = 1.0 / (1.0 + 2.2 * float(np.linalg.norm(x.T @ (weight * (x @ v)))))
    w = z = np.zeros(x.shape[1], dtype=np.float32)
    for k in range(steps):
        miss = np.maximum(0, 1 - y * (x @ z)).astype(np.float32)
        new = z - np.float32(step) * (z - 2 * (x.T @ (weight * y * miss)))
        z = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


class Model:
    def __init__(self, shares: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        names = np.array(langs)
        fam = np.array([family_of(x) for x in langs])
        self.families = sorted(set(fam.tolist()))
        scale = (1 / np.sqrt(shares.mean(axis=0) + 1e-5)).astype(np.float32) if len(shares) else np.ones(FEATURES, dtype=np.float32)
        x = shares * scale
        columns, bias = [], []

        def fit(rows, y):
            w, b = _svm(x[rows], y.astype(np.float32))
            columns.append(w * scale)
            bias.append(b)
            return len(columns) - 1

        every = np.arange(len(names))
        self.rest = {}
        if len(self.families) > 1:
            for f in self.families[: 1 if len(self.families) == 2 else None]:
                self.rest[f] = fit(every, np.where(fam == f, 1, -1))
        self.pairs = {f: {} for f in self.families}
        self.members = {f: sorted(set(names[fam == f].tolist())) for f in self.families}
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                rows = np.flatnonzero((names == a) | (names == b))
                self.pairs[f][a, b] = fit(rows, np.where(names[rows] == a, 1, -1))
        self.w = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((FEATURES, 0), dtype=np.float32)
        self.b = np.array(bias, dtype=np.float32)

    def margins(self, body: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        total, count = np.zeros((n, self.w.shape[1]), dtype=np.float64), np.zeros(n)
        for a in range(0, max(len(body), 1), CHUNK_BYTES // 4):
            b = min(len(body), a + CHUNK_BYTES // 4 + 2)
            h, text = trigrams(body[a:b], np.clip(off - a, 0, b - a))
            if len(h):
                first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
                total[text[first]] += np.add.reduceat(self.w[h], first, axis=0)
                count += np.bincount(text, minlength=n)
        return total / np.maximum(count, 1)[:, None] + self.b

    def predict(self, body: np.ndarray, off: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        m = self.margins(body, off)
        n = len(letters)
        sure = lambda x: 1 / (1 + np.exp(-np.clip(4 * x, -40, 40)))
        if len(self.families) > 2:
            f = np.stack([m[:, self.rest[x]] for x in self.families], axis=1)
        elif len(self.families) == 2:
            one = m[:, self.rest[self.families[0]]]
            f = np.stack([one, -one], axis=1)
        else:
            f = np.ones((n, 1)) * 10
        family, score = f.argmax(axis=1), sure(f.max(axis=1))
        out = np.full(n, UND, dtype=object)
        for k, name in enumerate(self.families):
            rows, own = np.flatnonzero(family == k), self.members[name]
            votes, sums, least = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own))), np.ones((len(rows), len(own)))
            for (a, b), c in self.pairs[name].items():
                i, j, x = own.index(a), own.index(b), m[rows, c]
                votes[:, i] += x >= 0
                votes[:, j] += x < 0
                sums[:, i] += x
                sums[:, j] -= x
                least[:, i] = np.minimum(least[:, i], sure(x))
                least[:, j] = np.minimum(least[:, j], sure(-x))
            best = (votes + 0.5 / (1 + np.exp(-np.clip(sums, -40, 40)))).argmax(axis=1)
            out[rows] = np.array(own, dtype=object)[best]
            score[rows] *= least[np.arange(len(rows)), best]
        out[~letters] = UND
        return out.tolist(), np.where(letters, score, 0.0)


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, CHUNK_BYTES):
        body, off = raw_text(batch.column("text"))
        h, text = trigrams(body, off)
        rows = []
        for i in range(batch.num_rows):
            at, n = np.unique(h[np.searchsorted(text, i) : np.searchsorted(text, i, side="right")], return_counts=True)
            rows.append((at.astype("<u2").tobytes(), n.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), *[pa.array(x, pa.binary()) for x in zip(*rows, strict=True)]], names=["lang", "at", "n"])


def trained(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", max_languages: int = MAX_LANGUAGES) -> Model | None:
    """From rows (key, text, lang): about sample_rows / languages rows of each language (LEAST_ROWS at least), all if it has no
    more; of the ``max_languages`` languages with the most rows."""
    labelled = labelled.where("lang is not null and text is not null").select(F.col(key).alias("_k"), "text", F.col("lang").cast("string"))
    by_lang = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["lang"]: r["n"] for r in by_lang.orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not counts:
        return None
    each = max(LEAST_ROWS, sample_rows // len(counts))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(each / n)).otherwise(share)
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit("langid"), "_k"), F.lit(1 << 31)) < share * F.lit(float(1 << 31)))
    rows = chosen.select("lang", "text").mapInArrow(_shares, "lang string, at binary, n binary").collect()
    rows = sorted((r for r in rows if len(r["at"])), key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"])))
    if not rows:
        return None
    x = np.zeros((len(rows), FEATURES), dtype=np.float32)
    for i, r in enumerate(rows):
        n = np.frombuffer(r["n"], dtype="<u4")
        x[i, np.frombuffer(r["at"], dtype="<u2")] = n / n.sum()
    return Model(x, [r["lang"] for r in rows])


def _predict(model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        for batch in text_batches(batches, CHUNK_BYTES):
            body, off = raw_text(batch.column("text"))
            raw, at = body.tobytes(), off.tolist()
            letters = np.array([has_letter(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], dtype=bool)
            lang, score = m.predict(body, off, letters) if m else ([UND] * len(letters), np.zeros(len(letters)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, model: Model | None, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of docs (default: all) with lang_pred string and score double."""
    keep = [f for f in docs.schema.fields if f.name in (docs.columns if columns is None else columns) and f.name not in ("lang_pred", "score")]
    names = [f.name for f in keep]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(_predict(sent, names), f"{kinds}lang_pred string, score double")


def in_training(key: str = "doc_id"):
    """Not of the fold that is held out: crc32 of the id as text, modulo 5, is 0 there; a null id is in training."""
    return F.coalesce(crc_mod(F.col(key), 5) != 0, F.lit(True))
