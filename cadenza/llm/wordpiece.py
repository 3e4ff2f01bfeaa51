"""Operator 7, token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that begin a word, and pieces that go on with it.  Every node has a
failure link (where to go on when no child fits, once the longest pieces inside its path are cut off) and the number of
pieces so cut off.  A word is read once, letter by letter; the popped counts add up to the number of pieces of the greedy
longest-match split, and no piece is ever built.  A SentencePiece model reads the mark and then the word: where the mark
is a piece of its own, the word goes on after it, and a character that begins no piece is its UTF-8 byte pieces (one
unknown token, where the model has not all of them).  For a vocabulary without that rule, a word that cannot be split is
one (unknown) token.

Scale: a narrow pass over the texts; the vocabulary is broadcast (its size does not follow the data), each worker keeps
the counts of words it has met, up to ``REMEMBERED``.

Defined cases: a null or empty text has no words and no tokens; a text may be of any length; repeated rows are counted
one by one; other columns may be carried along, one named like an output is replaced.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cadenza.llm.common import CHUNK_BYTES, raw_text, text_batches

REMEMBERED = 600_000
MARK = "▁"
_MADE: dict[str, Automaton] = {}


class Automaton:
    """``begin`` may hold the empty piece: a mark of its own before the word.  ``byte_pieces``: the bytes that have a
    piece, for a vocabulary that splits every word; by default a word that cannot be split is one token."""

    def __init__(self, begin: Iterable[str], go_on: Iterable[str], byte_pieces: Iterable[int] | None = None):
        begin = list(begin)
        self.next: list[dict[str, int]] = [{}, {}]  # 0: root of a word's beginning, 1: root of its rest
        self.fail: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        self.known: dict[bytes, int] = {}
        piece = {self._add(0, p) for p in begin if p} | {self._add(1, p) for p in go_on if p}
        self.bytes = None if byte_pieces is None else frozenset(byte_pieces)
        if "" in begin:
            self.fail[0], self.popped[0] = 1, 1
        elif self.bytes is not None:
            self.fail[0], self.popped[0] = 1, self._outside(MARK)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if v in piece:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                z, n = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][c], n
                elif self.bytes is not None:
                    self.fail[v], self.popped[v] = 1, n + self._outside(c)

    def _outside(self, c: str) -> int:
        """Tokens of a character that begins no piece."""
        raw = c.encode("utf-8", "replace")
        return len(raw) if self.bytes.issuperset(raw) else 1

    def _add(self, root: int, piece: str) -> int:
        for c in piece:
            if c not in self.next[root]:
                self.next[root][c] = len(self.next)
                self.next.append({})
                self.fail.append(-1)
                self.popped.append(0)
            root = self.next[root][c]
        return root

    def count(self, word: str) -> int:
        """Pieces of a word; without byte pieces 1 for one that cannot be split."""
        step, fail, popped, u, n = self.next, self.fail, self.popped, 0, 0
        for c in word:
            while c not in step[u]:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    if self.bytes is None:
                        return 1
                    n += self._outside(c)
                    break
            u = step[u][c] if u >= 0 else 1
        while u > 1:
            n += popped[u]
            u = fail[u]
            if u < 0:
                return 1
        return n


def sentencepiece_pieces(path: str, mark: str = MARK) -> tuple[list[str], list[str], list[int]]:
    """Of a SentencePiece model the pieces that begin a word (without their mark), those that may follow (all: a word may
    hold the mark as a letter), and the bytes that have a piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    raw = [int(model.id_to_piece(i)[3:-1], 16) for i in range(model.get_piece_size()) if model.is_byte(i)]
    return [p[len(mark) :] for p in pieces if p.startswith(mark)], pieces, raw


def _count(vocabulary, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces = vocabulary.value
        if key not in _MADE:  # kept by the worker from task to task
            _MADE.clear()
            _MADE[key] = Automaton(*pieces)
        count, known = _MADE[key].count, _MADE[key].known
        for batch in text_batches(batches, CHUNK_BYTES):
            body, off = raw_text(batch.column("text"))
            body, off = body.tobytes(), off.tolist()
            words = [body[a:b].split() for a, b in zip(off[:-1], off[1:], strict=True)]
            new = set().union(*words) - known.keys()
            known.update((w, count(w.decode("utf-8", "replace"))) for w in new)
            get = known.__getitem__
            tokens = [sum(map(get, x)) for x in words]
            if len(known) > REMEMBERED:
                for w in new:
                    del known[w]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(map(len, words), pa.int64()), pa.array(tokens, pa.int64())], names=[*keep, "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: tuple[list[str], list[str]] | tuple[list[str], list[str], list[int]], columns: list[str] | None = None) -> DataFrame:
    """``columns`` of docs (default: all) with n_words (runs without ASCII white space) and n_tokens long.

    ``vocabulary``: pieces that begin a word, pieces that go on with one, and where it has them the byte pieces."""
    keep = [c for c in (docs.columns if columns is None else columns) if c not in ("n_words", "n_tokens")]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name in keep)
    keep = [f.name for f in docs.schema.fields if f.name in keep]
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, vocabulary))
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_count(sent, keep), f"{kinds}n_words long, n_tokens long")
