"""Token counts by a linear longest-match automaton.

A trie of the vocabulary with failure links: each node knows, for the case that the walk can't
go on, to which node the rest of its text belongs after the greedy pieces are cut off, and how
many pieces that cuts. A word's piece count is then one pass over its bytes; no piece is built.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
import regex

from pyspark.sql import DataFrame

from .bpe import byte_symbols, vocabulary
from .common import table, texts

#: Words are runs of letters, marks and digits, or single other characters that aren't white space.
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]")
END = 256
FAIL = -1


class LongestMatch:
    """Greedy longest-match-first piece counts over byte pieces; ``ending`` pieces only end a word.

    A word that has no complete split counts as one unknown piece, as word-piece encoders do.
    """

    def __init__(self, inner: list[bytes], ending: list[bytes], cache: int = 300_000):
        self.next: list[dict[int, int]] = [{}]
        self.depth, final = [0], {}
        for piece in [*map(tuple, inner), *((*p, END) for p in ending)]:
            if not piece:
                continue
            node = 0
            for c in piece:
                at = self.next[node].get(c)
                if at is None:
                    at = len(self.next)
                    self.next[node][c] = at
                    self.next.append({})
                    self.depth.append(self.depth[node] + 1)
                node = at
            final[node] = True
        size = len(self.next)
        self.fail, self.popped = [FAIL] * size, [0] * size
        row = [0]
        while row:
            below = []
            for u in row:
                for c, v in self.next[u].items():
                    if v in final:
                        # the whole node text is one piece
                        self.fail[v], self.popped[v] = 0, 1
                    else:
                        z, n = self.fail[u], self.popped[u]
                        while z != FAIL and c not in self.next[z]:
                            n += self.popped[z]
                            z = self.fail[z]
                        if z != FAIL:
                            self.fail[v], self.popped[v] = self.next[z][c], n
                    below.append(v)
            row = below
        self.cache_size, self.cache = cache, {}

    def count(self, word: bytes) -> int:
        """Pieces of one word: linear, as each failure step gives up bytes that were taken once."""
        u, n = 0, 0
        step, fail, popped = self.next, self.fail, self.popped
        for c in (*word, END):
            v = step[u].get(c)
            while v is None:
                if fail[u] == FAIL:
                    return 1
                n += popped[u]
                u = fail[u]
                v = step[u].get(c)
            u = v
        # what is left must itself fall apart into whole pieces
        while u:
            if fail[u] == FAIL:
                return 1
            n += popped[u]
            u = fail[u]
        return n

    def text(self, text: str) -> tuple[int, int]:
        """Words and pieces of a text."""
        words, pieces, known = 0, 0, self.cache
        for w in WORD.findall(text.lower()):
            n = known.get(w)
            if n is None:
                n = self.count(w.encode())
                if len(w) <= 64:
                    if len(known) >= self.cache_size:
                        known.clear()
                    known[w] = n
            words += 1
            pieces += n
        return words, pieces


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    """Pieces are the vocabulary's tokens as bytes; those with a word end mark only end a word."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    mark = model.get("end_of_word_suffix") or ""
    byte = {s: b for b, s in enumerate(byte_symbols())}
    raw = lambda t: bytes(byte[c] for c in t)
    inner = [raw(t) for t in model["vocab"] if not (mark and t.endswith(mark))]
    ending = [raw(t[: -len(mark)]) for t in model["vocab"] if mark and t.endswith(mark)]
    return LongestMatch(inner, ending or inner)


def count_tokens(docs: DataFrame, vocab: str = "word_bpe_49k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key, ``n_words`` and ``n_tokens`` by greedy longest match.

    Map-only. Null and empty texts count 0; repeated rows are counted one by one; other columns
    are left out, so their names can't clash.
    """

    def run(batches):
        counter = automaton(vocabulary(vocab))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [counter.text(t) for t in texts(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([w for w, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())],
                    [key, "n_words", "n_tokens"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, n_tokens long")


def op10_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLES: dict[str, str] = {}
