"""Language identification by bit-sliced Bloom filters over letter n-grams.

One array of language bitmasks serves all languages: the masks at an n-gram's hash positions,
ANDed, name every language whose filter holds the n-gram. A text's votes are popcounts per
language, corrected for each filter's false-positive rate.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, table, texts

#: Languages in one mask word; positions of a filter by their logarithm, at least and at most.
WORD, BITS = 63, (20, 24)
#: Multipliers of the position hashes: odd 64-bit constants.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Letter or not, of every code point."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(parts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed letter n-grams of several texts: grams, the text each is of, letters per text.

    Texts are lower-cased and every other character is a blank; an n-gram that starts or ends
    with a blank run of two is left out. n is at most 3, so a gram is exact in 63 bits.
    """
    joined = "  " + "  ".join(parts) + "  "
    low = joined.lower()
    if len(low) != len(joined):
        parts = [p.lower() for p in parts]
        low = "  " + "  ".join(parts) + "  "
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, 32).astype(np.uint64)
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = 2 + np.r_[0, np.cumsum(sizes + 2)[:-1]] if len(parts) else sizes
    # a text owns its characters and the blanks around them
    owner = np.repeat(np.arange(len(parts)), sizes + 2) if len(parts) else sizes
    count = len(code) - n
    packed = code[:count].copy()
    some = letter[:count].copy()
    for k in range(1, n):
        packed = packed << np.uint64(21) | code[k : count + k]
        some |= letter[k : count + k]
    # one letter at least and no two blanks side by side
    for k in range(n - 1):
        some &= letter[k : count + k] | letter[k + 1 : count + k + 1]
    keep = np.flatnonzero(some)
    letters = np.add.reduceat(letter[2:].astype(np.int64), starts - 2) if len(parts) else sizes
    return packed[keep], owner[np.clip(keep - 1, 0, len(owner) - 1)], letters


def positions(packed: np.ndarray, k: int, bits: int) -> list[np.ndarray]:
    """k positions below 2**bits of each gram."""
    out = []
    for m in _MIX[:k]:
        x = packed * m
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((x >> np.uint64(64 - bits)).astype(np.int64))
    return out


class BitSlicedFilter:
    """Language bitmasks by position, in words of ``WORD`` languages; bit l of all positions is the Bloom filter of language l."""

    def __init__(self, languages: list[str], masks: np.ndarray, n: int, k: int, prior: list[float]):
        self.languages, self.masks, self.n, self.k = languages, masks, n, k
        self.bits = int(masks.shape[1]).bit_length() - 1
        self.false_positive = np.array([self.holds(masks, i).mean() ** k for i in range(len(languages))])
        self.prior = np.array(prior)

    @staticmethod
    def holds(masks: np.ndarray, i: int) -> np.ndarray:
        """Bit of language i in each column."""
        return (masks[i // WORD] >> np.array(i % WORD, masks.dtype)) & 1

    def lookup(self, packed: np.ndarray) -> np.ndarray:
        """Masks (words by n-grams) of the languages that may hold each n-gram."""
        at = positions(packed, self.k, self.bits)
        return np.bitwise_and.reduce([self.masks[:, x] for x in at])

    def predict(self, parts: list[str]) -> tuple[list[str], list[float]]:
        packed, owner, letters = grams(parts, self.n)
        mask = self.lookup(packed)
        total = np.bincount(owner, minlength=len(parts)).astype(float)
        votes = np.zeros((len(parts), len(self.languages)))
        for i, f in enumerate(self.false_positive):
            hits = np.bincount(owner, self.holds(mask, i), minlength=len(parts))
            votes[:, i] = np.clip((hits - total * f) / max(1 - f, 1e-9), 0, None)
        votes += 1e-9 * self.prior  # without any vote the more common language
        best = votes.argmax(1)
        score = votes[np.arange(len(parts)), best] / votes.sum(1)
        known = letters > 0
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], [float(s) if k else 0.0 for s, k in zip(score, known, strict=True)]


def _groups(part: pa.RecordBatch, column: str, chars: int = 1_000_000):
    """Row ranges whose texts make about a million characters, so that scratch arrays stay small."""
    found, start, size = texts(part.column(column)), 0, 0
    for k, t in enumerate(found):
        size += len(t)
        if size >= chars or k == len(found) - 1:
            yield start, k + 1, found[start : k + 1]
            start, size = k + 1, 0


def count_grams(train: DataFrame, n: int = 3, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows with a language: counted in the tasks first, then by Spark."""

    def run(batches):
        seen: dict[str, list] = {}

        def merged(parts):
            g, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, inverse = np.unique(g, return_inverse=True)
            return u, np.bincount(inverse, c).astype(np.int64)

        def flush():
            for name, parts in seen.items():
                g, c = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(c)], ["lang", "gram", "n"])
            seen.clear()

        for batch in batches:
            names = batch.column(1).to_pylist()
            for start, stop, found in _groups(batch, text):
                for name in sorted(set(names[start:stop])):
                    own = [t for t, x in zip(found, names[start:stop], strict=True) if x == name]
                    seen.setdefault(name, []).append(np.unique(grams(own, n)[0], return_counts=True))
                    if len(seen[name]) >= 16:
                        seen[name] = [merged(seen[name])]
                if sum(len(g) for parts in seen.values() for g, _ in parts) > 2_000_000:
                    yield from flush()
        yield from flush()

    rows = train.select(F.col(text), F.col(lang).alias("lang")).where("lang is not null").mapInArrow(run, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, n: int = 3, k: int = 3, share: float = 0.2, least: int = 2, text: str = "text", lang: str = "lang") -> BitSlicedFilter | None:
    """Learn the filters from all rows of ``train``; None if there are none.

    A language's filter takes an n-gram if it occurs ``least`` times there and at least
    ``share`` as often, per n-gram of the language, as in the language where it is most
    frequent: foreign passages don't fill the filters. There are twice as many positions as
    n-grams set, within ``BITS``; what reaches the driver is at most so many and one count per
    language, whatever the size of the corpus. Fuller filters are corrected for, not cut.
    """
    counts = count_grams(train, n, text, lang)
    counts = counts.cache()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        counts.unpersist()
        return None
    spark = train.sparkSession
    dim = spark.createDataFrame([(name, i, float(totals[name])) for i, name in enumerate(languages)], "lang string, bit int, total double")
    rated = counts.where(F.col("n") >= least).join(F.broadcast(dim), "lang").withColumn("rate", F.col("n") / F.col("total"))
    per_gram = rated.groupBy("gram").agg(F.collect_list(F.struct("rate", "bit")).alias("by"), F.max("rate").alias("top"))
    words = -(-len(languages) // WORD)
    mine = f"filter(by, x -> x.rate >= {share} * top and x.bit div {WORD} = word)"
    masks = per_gram.withColumn("word", F.explode(F.sequence(F.lit(0), F.lit(words - 1)))).select(
        "gram", "word", F.expr(f"aggregate({mine}, 0L, (a, x) -> a | shiftleft(1L, cast(x.bit % {WORD} as int)))").alias("mask")
    )
    bits = int(np.clip(np.ceil(np.log2(2 * k * max(per_gram.count(), 1))), *BITS))

    def place(batches):
        for batch in batches:
            at = positions(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64), k, bits)
            word, mask = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(word, k)), pa.array(np.concatenate(at)), pa.array(np.tile(mask, k))], ["word", "at", "mask"])

    sliced = masks.where("mask <> 0").mapInArrow(place, "word int, at long, mask long").groupBy("word", "at").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    counts.unpersist()
    kind = np.uint8 if len(languages) <= 8 else np.uint16 if len(languages) <= 16 else np.uint64
    out = np.zeros((words, 1 << bits), kind)
    out[sliced.column("word").to_numpy(), sliced.column("at").to_numpy()] = sliced.column("mask").to_numpy().astype(kind)
    whole = sum(totals.values())
    return BitSlicedFilter(languages, out, n, k, [totals[x] / whole for x in languages])


def identify(docs: DataFrame, model: BitSlicedFilter | None, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Key, ``lang_pred`` and ``score`` of each row (and the columns ``also``): map-only.

    Null texts and texts without a letter give ``und`` with score 0, as does any text if nothing
    was learned. Repeated rows get the same answer; a tie goes to the language first in name order.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [key, *also]

    def run(batches):
        model = sent.value
        for batch in batches:
            for start, stop, found in _groups(batch, text):
                names, scores = model.predict(found) if model else (["und"] * len(found), [0.0] * len(found))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(start, stop - start) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    [*kept, "lang_pred", "score"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*kept, text).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", lang_pred string, score double")


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    model = fit(docs.where("not held_out and text is not null and lang is not null"))
    return identify(docs, model, also=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
