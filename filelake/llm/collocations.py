"""Phrases that stand together more often than their parts, mined per language.

Phrases are counted by 64-bit fingerprints: Rabin-Karp polynomials over words, which are polynomials
over bytes, both taken from prefix sums in numpy. A task cuts its texts into blocks; in a block
occurrences of one phrase are brought together exactly, by dictionary codes, each with a pointer to its words. Only (fingerprint, count)
is shuffled, length by length: a phrase is counted only where its first and its last words but one
are frequent phrases themselves, as a bitmap of frequent fingerprints tells (of bounded size: it may let more through, never less).
A last pass follows the pointers of frequent fingerprints to the texts and sums by text, so phrases
that share a fingerprint are told apart and everything that comes out is exact.

Null texts are empty, a null language is ``und``; repeated rows all count, other columns are ignored. No documents give no phrases. Memory of a task: a
block of ``BLOCK`` bytes or one text, whichever is more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Bytes of text of a block, and most bits of a bitmap (32 MiB).
BLOCK, BITS = 4 << 20, 1 << 28
#: Odd multipliers of bytes, of words, and their inverses modulo 2^64.
OF_BYTES, OF_WORDS = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Fixed values of the task: 2 parts pieces, 1 parts words.
PARTS = np.zeros(256, np.uint8)
PARTS[[0x20, 0x09]] = 1
PARTS[[*b".,;:!?\n\x0b\x0c\r"]] = 2


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def polynomials(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the byte strings that stand one after another in ``data``, by differences of a prefix polynomial."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(OF_BYTES, len(data)), out=prefix[1:])
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    # a string's sum is brought to the place 0 by the inverse power of where it starts
    back = _powers(pow(OF_BYTES, -1, 1 << 64), len(data) + 1)[starts]
    return _mixed((prefix[ends] - prefix[starts]) * back + (ends - starts).astype(np.uint64))


class Block:
    """Words of some texts as codes, with the phrases of each length and their fingerprints.

    ``langs`` are the languages of the texts and ``offsets`` their ends in ``data``, beginning with 0.
    """

    def __init__(self, langs: list[str], offsets: np.ndarray, data: np.ndarray):
        data = LOWER[data]
        parts = PARTS[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        inside = parts == 0
        starts = np.flatnonzero(inside & (first[:-1] | ~np.r_[False, inside[:-1]])) if len(data) else np.zeros(0, np.int64)
        stops = np.flatnonzero(inside & (first[1:] | ~np.r_[inside[1:], False])) + 1 if len(data) else starts
        text = np.searchsorted(offsets, starts, "right") - 1
        # words of one piece have one number: separators so far, and texts
        self.piece = np.searchsorted(np.flatnonzero(parts == 2), starts) + text
        self.langs, kinds = np.unique(np.array(langs, object).astype(str), return_inverse=True) if langs else (np.array([], str), np.zeros(0, np.int64))
        self.lang = kinds[text] if len(starts) else starts
        lengths = np.r_[0, np.cumsum(stops - starts)]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(lengths.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside]))])
        coded = words.dictionary_encode()
        self.codes, self.words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        _, ends, spelled = self.words.buffers()
        ends = np.frombuffer(ends, np.int64)[1 : len(self.words) + 1]
        self.prints = polynomials(np.frombuffer(spelled or b"", np.uint8)[: ends[-1] if len(ends) else 0], ends)
        self.lang_prints = polynomials(*self._spelled(self.langs))

    @staticmethod
    def _spelled(names) -> tuple[np.ndarray, np.ndarray]:
        raw = [n.encode() for n in names]
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw], dtype=np.int64)

    def phrases(self, longest: int):
        """For each length: (pointers to one occurrence of each phrase, their counts), phrases told apart exactly."""
        at, ids = np.arange(len(self.codes)), self.lang
        size = len(self.words)
        for n in range(1, longest + 1):
            # goes on to the next word where that is in the same piece
            if n > 1:
                at = at[at + n - 1 < len(self.codes)]
                ids = ids[: len(at)]
                fits = self.piece[at] == self.piece[at + n - 1]
                at, ids = at[fits], ids[fits]
            _, pointers, ids, counts = np.unique(ids * size + self.codes[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
            yield n, at[pointers], counts
            # ids of what begins at each word; words that begin nothing get none
            spread = np.full(len(self.codes), -1, np.int64)
            spread[at] = ids
            at = np.flatnonzero(spread >= 0)
            ids = spread[at]

    def keys(self, pointers: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of (language, n words) from each pointer on."""
        sums, factors = self.lang_prints[self.lang[pointers]].copy(), _powers(OF_WORDS, n + 1)[1:]
        for j in range(n):
            sums += self.prints[self.codes[pointers + j]] * factors[j]
        return _mixed(sums + np.uint64(n)).view(np.int64)

    def texts(self, pointers: np.ndarray, n: int) -> pa.Array:
        import pyarrow.compute as pc

        picked = [self.words.take(pa.array(self.codes[pointers + j])) for j in range(n)]
        joined = picked[0] if n == 1 else pc.binary_join_element_wise(*picked, pa.scalar(b" ", pa.large_binary()))
        return joined.view(pa.large_string()).cast(pa.string())


def _held(bitmap: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    if bitmap is None:
        return np.zeros(len(keys), bool)
    at = keys & np.int64(len(bitmap) * 64 - 1)
    return bitmap[at >> 6] >> (at & 63) & 1 == 1


def _blocks(batches):
    """Blocks of Arrow batches of (lang, text), both without nulls."""
    langs, lengths, datas, size = [], [], [], 0
    for batch in batches:
        lang, text = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_string())
        _, ends, data = text.buffers()
        ends = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
        data, row = np.frombuffer(data or b"", np.uint8), 0
        while row < len(text):
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + BLOCK - size, "right")) - 1)
            langs += lang[row:stop]
            lengths.append(np.diff(ends[row : stop + 1]))
            datas.append(data[ends[row] : ends[stop]].copy())
            size, row = size + len(datas[-1]), stop
            if size >= BLOCK or (row < len(text)):
                yield Block(langs, np.r_[0, np.cumsum(np.concatenate(lengths))], np.concatenate(datas))
                langs, lengths, datas, size = [], [], [], 0
    if langs:
        yield Block(langs, np.r_[0, np.cumsum(np.concatenate(lengths))], np.concatenate(datas))


def _counted(docs: DataFrame, n: int, bitmap) -> DataFrame:
    """(key, f) of phrases of n words; of two and more only those whose first and last n - 1 words are in the bitmap."""

    def run(batches):
        for block in _blocks(batches):
            for length, pointers, counts in block.phrases(n):
                if length == n:
                    if n > 1:
                        kept = _held(bitmap.value, block.keys(pointers, n - 1)) & _held(bitmap.value, block.keys(pointers + 1, n - 1))
                        pointers, counts = pointers[kept], counts[kept]
                    keys = block.keys(pointers, n)
                    for k in range(0, len(keys), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)]), pa.array(counts[k : k + (1 << 16)])], ["key", "f"])

    return docs.mapInArrow(run, "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))


def _bitmap(keys: DataFrame):
    """A broadcast bitmap of the keys, about 64 bits for each, of bounded size, filled on the executors."""
    bits = 1 << 16
    while bits < min(64 * keys.count(), BITS):
        bits *= 2
    at = keys.select(F.col("key").bitwiseAND(bits - 1).alias("at"))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out)


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """(lang, n, phrase, f): every phrase of up to ``longest`` words that occurs ``least`` times in its language, and with n 0 the words of each language."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    maps = []
    for n in range(1, longest + 1):
        maps.append(_bitmap(materialise(_counted(docs, n, maps[-1] if maps else None).where(F.col("f") >= least).select("key"))))

    def run(batches):
        for block in _blocks(batches):
            of_lang = np.bincount(block.lang, minlength=len(block.langs))
            yield pa.RecordBatch.from_arrays([pa.array(block.langs.tolist(), pa.string()), pa.array([0] * len(of_lang), pa.int32()), pa.array([""] * len(of_lang), pa.string()), pa.array(of_lang, pa.int64())], ["lang", "n", "phrase", "f"])
            for n, pointers, counts in block.phrases(longest):
                kept = _held(maps[n - 1].value, block.keys(pointers, n))
                if n > 1:
                    kept &= _held(maps[n - 2].value, block.keys(pointers, n - 1)) & _held(maps[n - 2].value, block.keys(pointers + 1, n - 1))
                pointers, counts = pointers[kept], counts[kept]
                for k in range(0, len(pointers), 1 << 16):
                    part = pointers[k : k + (1 << 16)]
                    langs = pa.array(block.langs.tolist(), pa.string()).take(pa.array(block.lang[part]))
                    yield pa.RecordBatch.from_arrays([langs, pa.array([n] * len(part), pa.int32()), block.texts(part, n), pa.array(counts[k : k + (1 << 16)])], ["lang", "n", "phrase", "f"])

    found = docs.mapInArrow(run, "lang string, n int, phrase string, f long").groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
    return found.where((F.col("f") >= least) | (F.col("n") == 0))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two words and more of each language.

    A phrase's score is that of its weakest cut, in millionths. One that a longer frequent phrase holds in ``share`` per cent of its
    occurrences gives way to it. Scores are exact: counts up to 10^13 are multiplied as decimals.
    """
    found = materialise(frequent_phrases(docs, longest, least))
    words = F.split("phrase", " ")
    candidates = found.where("n > 1")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    join = lambda start, count: F.array_join(F.slice("w", start, count), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    part = lambda name, f: found.where("n > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(13,0)")
    scored = scored.withColumns({"up": (whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)")), "down": whole("l") * whole("r")})
    best = scored.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("best"))
    # phrases of two words and more inside longer ones
    n = F.col("n")
    inner = candidates.where("n > 2").select("lang", "f", words.alias("w"), "n", F.explode(F.sequence(F.lit(2), n - 1)).alias("size"))
    inner = inner.select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), n - F.col("size") + 1)).alias("from"))
    inner = inner.select("lang", join(F.col("from"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {share} * a")
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = found.where("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")


def op13_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {"op13_collocations": op13_collocations}
ORACLES: dict[str, str] = {
    "op13_collocations": """with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as p from documents),
 w as (select lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') as w from p where p <> ''),
 t as (select lang, sum(len(w))::bigint as n from w group by lang),
 o as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, w, unnest([1, 2, 3]) as k from w), unnest(range(1, cast(len(w) - k + 2 as bigint))) u(i)),
 f as (select lang, k, phrase, count(*) as f from o group by all having count(*) >= 10),
 c as (select lang, phrase, f as a, string_split(phrase, ' ') as w, unnest(range(1, k)) as k from f where k > 1),
 s as (select c.lang, c.phrase, a, c.k, l.f as l, r.f as r, ((1000000::hugeint * a * a) // (l.f::hugeint * r.f))::bigint as score from c join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[:c.k], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
 b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
 x as (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, f from (select lang, f, string_split(phrase, ' ') as w from f where k = 3)),
 d as (select lang, phrase, max(f) as longer from x group by all),
 q as (select b.*, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from b left join d using (lang, phrase) where longer is null or 100 * longer < 50 * a)
select lang, rank, phrase, a, l, r, n, score from q join t using (lang) where rank <= 2000"""
}
