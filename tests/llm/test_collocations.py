"""Collocations against a plain count, block by block, and with fingerprints that collide."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from filelake.llm import collocations as P


def brute(rows, longest=3, least=10, top=2000, share=50):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            counts.update((lang or "und", tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    frequent = {k: n for k, n in counts.items() if n >= least}
    out = []
    for lang in totals:
        rows = []
        for (own, words), a in frequent.items():
            if own != lang or len(words) < 2:
                continue
            score, k = min((int(Fraction(10**6 * a * a, counts[lang, words[:k]] * counts[lang, words[k:]])), k) for k in range(1, len(words)))
            inside = lambda w: any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))  # noqa: E731, B023
            if not any(x == lang and len(w) > len(words) and 100 * n >= share * a and inside(w) for (x, w), n in frequent.items()):
                rows.append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    words = ["a", "B", "é", "New", "York", "City", "😀", "x y", "\x0b", "the"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ", ", "\n", ""]) for _ in range(rnd.randrange(40)))
    out = [(rnd.choice(["en", "fr", None, "und", "É"]), text()) for _ in range(300)]
    return out + [("en", "new york city " * 40), ("en", None), (None, None), ("xx", ""), ("yy", " .,"), *[("en", "same words")] * 12]


@pytest.mark.parametrize(("block", "longest", "top"), [(1 << 24, 3, 2000), (50, 3, 2000), (1, 4, 5)])
def test_collocations_equal_brute_force(spark, monkeypatch, rows, block, longest, top):
    monkeypatch.setattr(P, "BLOCK", block)
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "lang string, text string, phrase int")
    got = sorted(tuple(r) for r in P.collocations(docs, longest, 10, top).collect())
    assert got == brute(rows, longest, 10, top)


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch, rows):
    keys = P.Block.keys
    monkeypatch.setattr(P.Block, "keys", lambda self, pointers, n: keys(self, pointers, n) % np.int64(7))
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in P.collocations(docs).collect()) == brute(rows)


def test_no_documents(spark):
    assert P.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_long_text_and_exact_scores(spark):
    rows = [("en", "left right " * 60_000), ("en", "w" * 200_000)]
    got = P.collocations(spark.createDataFrame(rows, "lang string, text string")).where("phrase = 'right left right'").collect()
    assert [(r.a, r.l, r.r, r.n, r.score) for r in got] == [(59_999, 60_000, 60_000, 120_001, 999_966)]
