"""Winnowing against brute force, its guarantee, and hard rows."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from filelake.llm import fingerprints as P


def brute(text, k, w):
    """(hash, position) of every selection, window by window."""
    if not text:
        return []
    codes, mask = [xxhash.xxh64(c.encode(), seed=42).intdigest() for c in text], (1 << 64) - 1
    codes += [0] * (k - len(codes))
    grams = []
    for i in range(len(codes) - k + 1):
        h = 0
        for c in codes[i : i + k]:
            h = (h << 1 & mask) ^ c
        grams.append(h >> 32)
    out = []
    for s in range(max(1, len(grams) - w + 1)):
        window = grams[s : s + w]
        at = max(i for i, x in enumerate(window) if x == min(window))
        if (window[at], s + at) not in out:
            out.append((window[at], s + at))
    return out


def shown(marks):
    return " ".join(f"{h:08x}@{p}" for h, p in marks)


def near(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("block", [100, 1 << 16])
def test_edited_fingerprints_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rnd, k, w = random.Random(5), 8, 16
    texts = ["", "a", "ab", "😀é漢" * 3, "a" * 200, "abc" * 70] + ["".join(rnd.choice("abcd é😀\n") for _ in range(rnd.randrange(400))) for _ in range(60)]
    texts.append(texts[-1])
    rows = [*enumerate(texts), (7, None), (7, None), (None, "no id " * 9)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bucket string, marks int")
    ordered = lambda marks: " ".join(sorted(marks.split()))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, ordered(r.edited_fingerprint), round(r.near_edited, 9), round(r.near_next, 9)) for r in P.edited_fingerprints(docs, k, w).collect()]
    order = sorted(((-i if i is not None else 1, t or "", i) for i, t in rows), key=lambda x: x[:2])
    want = []
    for at, (_, text, doc_id) in enumerate(order):
        following, half = order[(at + 1) % len(order)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = brute(text, k, w), brute(edited, k, w), brute(following, k, w)
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), ordered(shown(b)), round(near(a, b), 9), round(near(a, c), 9)))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_shared_run_is_never_missed(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    rows = []
    for i in range(100):
        shared = word(P.W + P.K - 1)
        rows.append((i, word(rnd.randrange(200)) + shared + word(rnd.randrange(200)), word(rnd.randrange(200)) + shared + word(rnd.randrange(200))))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    hashes = lambda c: F.transform(P.fingerprint(F.col(c)), P.hash_of)
    assert df.where(F.arrays_overlap(hashes("a"), hashes("b"))).count() == 100


def test_fingerprints_keep_rows_and_positions(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "x" * 100, 5), (3, "x" * 100, 5)], "doc_id long, text string, selections int")
    got = sorted((r.doc_id, [tuple(s) for s in r.selections]) for r in P.fingerprints(docs, 4, 8).collect())
    same = brute("x" * 100, 4, 8)
    assert got == [(1, []), (2, []), (3, same), (3, same)] and [p for _, p in same] == [*range(7, 97)]


def test_no_documents(spark):
    assert P.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_document_follows_itself(spark):
    (row,) = P.edited_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1.0
