"""N-gram Jaccard join with several global orders.

Documents are sets of word shingles. Two sets of Jaccard similarity t or more share a token in
the first ``n - ceil(t n) + 1`` tokens of each under *any* global order of tokens, and in fact a
provable number of them. Candidates come from one order, must meet the same test under a second
order, and only what passes both is verified on the whole sets.

Orders put frequent shingles last (how frequent: the sum of counts of two or more within a task;
any consistent order is right, this one keeps prefixes selective) and break ties by a hash of
their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialise, small, table

#: Frequent shingles kept in memory at most: 16 bytes each.
MAX_FREQUENT = 1 << 21
#: Tokens that a pair must share under the first order, where the sizes of its sets allow to ask for so many: more
#: of them leave fewer pairs to verify, but make a row each.
SHARED = 1
#: Sets that share a token beyond which it counts as crowded.
CROWDED = 16
#: Documents that may be broadcast to fetch their texts: 8 bytes each.
BROADCAST_IDS = 1_000_000
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_SEEDS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit scramble."""
    x = x ^ _SEEDS[seed]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of the distinct word shingles of byte texts, all words of a text at once.

    Words are runs of bytes other than blank and 0x09-0x0D; A-Z is lower-cased. A word's hash is
    a polynomial over its bytes by differences of a running sum, moved to one place by the
    inverse power, and scrambled with its length.
    """

    def __init__(self, width: int = 5):
        self.width = width
        self.power = self.inverse = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n powers of the base and of its inverse modulo 2**64."""
        if len(self.power) < n:
            size, inverse = max(n, 1 << 16), np.uint64(pow(int(_R), -1, 1 << 64))
            self.power, self.inverse = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, r)], dtype=np.uint64) for r in (_R, inverse))
        return self.power[:n], self.inverse[:n]

    def set(self, data: bytes) -> np.ndarray:
        """Sorted distinct shingle hashes; a text with fewer words is one shingle, without words none."""
        w = self.words(data)
        if not len(w):
            return w
        k = min(self.width, len(w))
        out = np.full(len(w) - k + 1, np.uint64(k))
        for i in range(k):
            out = mix(out + w[i : len(w) - k + 1 + i])
        return np.unique(out)

    def words(self, data: bytes) -> np.ndarray:
        """Word hashes that don't depend on where in the text, or in how long a text, a word stands."""
        b = np.frombuffer(data.lower(), np.uint8)
        if not len(b):
            return np.zeros(0, np.uint64)
        inside = np.r_[False, (b != 32) & ((b < 9) | (b > 13)), False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edges[::2], edges[1::2]
        if not len(start):
            return np.zeros(0, np.uint64)
        power, inverse = self._powers(len(b))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:], dtype=np.uint64)
        return mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64) * _SEEDS[5])


def signature(s: np.ndarray) -> int:
    """64-bit digest of a set (0 for the empty one)."""
    if not len(s):
        return 0
    both = np.bitwise_xor.reduce(mix(s, 1), keepdims=True) + np.add.reduce(mix(s, 2), keepdims=True)
    return int(mix(both, 3).view(np.int64)[0])


def prefix_length(n: int, t_num: int, t_den: int) -> int:
    return n - -(-n * t_num // t_den) + 1


def least_shared(n_x, n_y, t_num: int, t_den: int):
    """How many tokens two prefixes share at least under any order, if the sets are similar enough.

    The intersection is at least t / (1 + t) of both sizes; what the prefixes don't show of it
    lies in the rest of one set, which has ceil(t n) - 1 tokens.
    """
    return np.maximum(1, -(-(n_x + n_y) * t_num // (t_num + t_den)) - -(-np.maximum(n_x, n_y) * t_num // t_den) + 1)


def _binary(part: pa.RecordBatch, k: int) -> list[bytes]:
    return [x or b"" for x in part.column(k).cast(pa.binary()).to_pylist()]


def _small(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield batch.slice(start, 256)


def _summaries(docs: DataFrame, width: int) -> DataFrame:
    """Rows (key, n, sig) of every document, and rows (null, -count, shingle) of shingles that occur twice in a task."""

    def run(batches):
        shingler, held, size = Shingler(width), [], 0
        schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("sig", pa.int64())])

        def frequent(held):
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c > 1], c[c > 1]
            return pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), pa.array(-c), pa.array(u.view(np.int64))], schema=schema)

        for part in _small(batches):
            sets = [shingler.set(t) for t in _binary(part, 1)]
            sig = [signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.int64())], schema=schema)
            held += sets
            size += sum(map(len, sets))
            if size > 4_000_000:
                yield frequent(held)
                held, size = [], 0
        if size:
            yield frequent(held)

    return docs.mapInArrow(run, "key long, n long, sig long")


def _frequent(counts: DataFrame) -> DataFrame:
    """(sig, n): the most frequent shingles by powers of two, ``MAX_FREQUENT`` of them at most."""
    summed = materialise(counts.groupBy("sig").agg((-F.sum("n")).alias("n")).where("n >= 4"))
    floor, room = 1 << 62, MAX_FREQUENT
    for level, n in sorted(map(tuple, summed.groupBy(F.floor(F.log2("n")).cast("int")).count().collect()), reverse=True):
        room -= n
        if room < 0:
            break
        floor = 1 << level
    return summed.where(F.col("n") >= floor)


class Orders:
    """Rank of shingles under each order: how frequent, then a hash; frequent ones are in a sorted table."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        by = np.argsort(shingles)
        self.shingles = shingles[by]
        self.level = np.clip(np.log2(np.maximum(counts[by], 1)).astype(np.int64), 1, 62)

    def prefix(self, s: np.ndarray, order: int, length: int) -> np.ndarray:
        """The first ``length`` shingles of a set under an order, in that order."""
        h = mix(s, 4 + order) >> np.uint64(6)
        if len(self.shingles):
            at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
            level = np.where(self.shingles[at] == s, self.level[at], 0).astype(np.uint64)
            h |= level << np.uint64(58)
        if length < len(s):
            first = np.argpartition(h, length - 1)[:length]
            s, h = s[first], h[first]
        return s[np.argsort(h)]


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, t_num: int = 4, t_den: int = 5) -> DataFrame:
    """(key, n_shingles, component_id) of every row: components of the links Jaccard >= t_num / t_den.

    Equal sets are one class from the start (by a 64-bit digest of 64-bit shingle hashes), copies
    are never paired. Null, empty and blank texts have no shingle and link with nothing. ``key``
    is an integer; rows that share a key are separate documents; a row with a null key links
    with nothing and has a null component.
    """
    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    both = materialise(_summaries(src, width))
    own = both.where("n >= 0")
    sets = own.where("key is not null and n > 0")
    frequent = _frequent(both.where("n < 0")).toArrow()
    orders = src.sparkSession.sparkContext.broadcast(
        Orders(frequent.column("sig").to_numpy().view(np.uint64), frequent.column("n").to_numpy())
    )
    reps = materialise(sets.groupBy("sig").agg(F.min("key").alias("rep")))
    keyed = src.where("key is not null")
    postings = _live_postings(_prefixes(keyed, orders, width, t_num, t_den))
    groups = components(_links(keyed, postings, reps, orders, width, t_num, t_den))
    placed = reps.join(groups.withColumnRenamed("id", "sig"), "sig").select("sig", "component", "rep")
    least = placed.groupBy("component").agg(F.min("rep").alias("least"))
    named = placed.join(least, "component").select("sig", "least")
    # copies of a class without other links
    named = reps.join(named, "sig", "left").select("sig", F.coalesce("least", "rep").alias("component_id"))
    found = own.join(named, (own["sig"] == named["sig"]) & (own["n"] > 0) & own["key"].isNotNull(), "left")
    return found.select(own["key"].alias(key), own["n"].alias("n_shingles"), F.coalesce("component_id", own["key"]).alias("component_id"))


def _prefixes(src: DataFrame, orders, width: int, t_num: int, t_den: int) -> DataFrame:
    """(token, sig, n, pos): prefix tokens of every set under the first order and their places from 0, once per set and task."""

    def run(batches):
        shingler, seen = Shingler(width), set()
        for part in _small(batches):
            tokens, sigs, sizes, lengths = [], [], [], []
            for t in _binary(part, 0):
                s = shingler.set(t)
                sig = signature(s)
                if not len(s) or sig in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(sig)
                p = orders.value.prefix(s, 0, prefix_length(len(s), t_num, t_den))
                tokens.append(p)
                sigs.append(sig)
                sizes.append(len(s))
                lengths.append(len(p))
            if tokens:
                places = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
                columns = [np.concatenate(tokens).view(np.int64), *(np.repeat(np.array(x, np.int64), lengths) for x in (sigs, sizes)), places]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "sig", "n", "pos"])

    return src.select("text").mapInArrow(run, "token long, sig long, n long, pos int")


def _live_postings(prefixes: DataFrame) -> DataFrame:
    """(token, sig, n, before, after, crowded, lead...) for tokens that two sets or more have; the lead is one of them.

    ``before`` counts tokens of a set that come earlier in the order and are here too, ``after`` all that come later.
    Windows stream or spill, no token's sets are gathered in memory. The lead is the set of which the largest
    share of tokens is here at all: the text that others were made from, if it is there. A token is
    crowded if more than ``CROWDED`` sets have it.
    """
    w = Window.partitionBy("token")
    by = w.orderBy("sig")
    # equal rows from different tasks stand side by side in this order
    once = prefixes.withColumn("before", F.lag("sig").over(by)).where("before is null or before <> sig").drop("before")
    live = materialise(once.withColumn("sets", F.count("*").over(w)).where("sets > 1"))
    own = Window.partitionBy("sig")
    placed = live.withColumns({"before": F.row_number().over(own.orderBy("pos", "token")) - 1, "share": F.count("*").over(own) / F.col("n"), "after": F.col("n") - F.col("pos") - 1})
    first = w.orderBy(F.desc("share"), F.xxhash64("sig"), "sig")
    lead = [F.first(c).over(first).alias(f"lead_{c}") for c in ("n", "before", "after")]
    return materialise(placed.select("token", "sig", "n", "before", "after", (F.col("sets") > CROWDED).alias("crowded"), F.first("sig").over(first).alias("lead"), *lead))


def _links(src: DataFrame, postings: DataFrame, reps: DataFrame, orders, width: int, t_num: int, t_den: int) -> DataFrame:
    """Linked pairs (a, b) of sets by signature, enough to connect every component.

    First each set is compared with the leader of most of its tokens. Sets that this puts into the
    leader's group need no more comparisons there; all others are compared with every set of
    another group that shares enough tokens with them: no link between groups is lost, and a
    large group of near copies costs one comparison a member. Pairs must show the first ``SHARED`` of
    all the tokens that they share, and are made from a token only if its places leave room for
    enough others: earlier ones that both share are prefix tokens of both, so they are here. Pairs
    are made from a crowded token only if both prefixes hold so many crowded ones that these could
    be enough; else what the others must show is greater by that number.
    """
    sized = lambda a, b: F.least(a, b) * t_den >= F.greatest(a, b) * t_num
    ceil = lambda x, d: f"(({x}) * {t_num} + {d} - 1) div {d}"
    both = lambda x, y: F.expr(ceil(f"{x} + {y}", t_num + t_den))  # noqa: E731  tokens that similar sets of these sizes share
    least = lambda x, y: F.expr(f"greatest(1, least({SHARED}, {ceil(f'{x} + {y}', t_num + t_den)} - {ceil(f'greatest({x}, {y})', t_den)} + 1))")
    # of a similar pair's shared tokens, the first ``least`` have all others behind them; and what both
    # may share before a shared token, the token, and what may follow it must be enough
    possible = lambda n, b, a, m, c, d: (F.least(a, d) >= both(n, m) - least(n, m)) & (F.least(b, c) + 1 + F.least(a, d) >= both(n, m))
    pair = lambda a, n, b, m: [
        F.least(a, b).alias("a"), F.when(F.col(a) < F.col(b), F.col(n)).otherwise(F.col(m)).alias("na"),
        F.greatest(a, b).alias("b"), F.when(F.col(a) < F.col(b), F.col(m)).otherwise(F.col(n)).alias("nb"),
    ]
    led = postings.where("sig <> lead").where(sized("n", "lead_n") & possible("n", "before", "after", "lead_n", "lead_before", "lead_after")).groupBy("sig", "n", "lead", "lead_n").count()
    led = led.groupBy("sig", "n").agg(F.max(F.struct("count", "lead", "lead_n")).alias("best")).select("sig", "n", "best.*")
    stars = materialise(led.select(*pair("sig", "n", "lead", "lead_n")).distinct())
    members = postings.select("sig").distinct().join(reps, "sig")
    # two bytes of each token: what is equal stays equal, so that no pair is lost, and few others pass
    second = materialise(
        _sets(src, members, width, lambda s: np.sort(orders.value.prefix(s, 1, prefix_length(len(s), t_num, t_den)).astype(np.uint16)))
    )
    exact = lambda pairs: _verified(src, _sharing(pairs, second, np.uint16, lambda x, y: least_shared(x, y, t_num, t_den)), reps, width, t_num, t_den)
    first = exact(stars)
    own = components(first).select(F.col("id").alias("sig"), F.col("component").alias("own"))
    held = postings.where("crowded").groupBy("sig").agg(F.count("*").alias("held"))
    placed = postings.join(own, "sig", "left").join(held, "sig", "left").join(own.toDF("lead", "led_by"), "lead", "left")
    placed = placed.select("token", "crowded", "sig", "n", "before", "after", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("own", "sig").alias("own"), F.coalesce("led_by", "lead").alias("led_by"))
    placed = materialise(placed)
    outside = placed.where("own <> led_by").select("token", *[F.col(c).alias(f"{c}2") for c in ("sig", "n", "before", "after", "held", "own")])
    # every shared prefix token of two groups counts once
    shared = (
        placed.join(outside, "token")
        .where((F.col("own") != F.col("own2")) & sized("n", "n2") & ((F.col("own") == F.col("led_by")) | (F.col("sig") < F.col("sig2"))))
        .where(possible("n", "before", "after", "n2", "before2", "after2"))
        .where(~F.col("crowded") | (least("n", "n2") <= F.least("held", "held2")))
        .select(*pair("sig", "n", "sig2", "n2"), F.least("held", "held2").alias("held"))
        .groupBy("a", "b", "na", "nb", "held")
        .agg(F.count("*").alias("shared"))
    )
    spare = F.when(least("na", "nb") <= F.col("held"), 0).otherwise(F.col("held"))
    enough = shared.where(F.col("shared") + spare >= least("na", "nb"))
    return materialise(first.union(exact(materialise(enough.select("a", "na", "b", "nb")))))


def _sets(src: DataFrame, members: DataFrame, width: int, part) -> DataFrame:
    """(sig, tokens): of each set in ``members`` (sig, rep) the array that ``part`` gives, as bytes.

    Within each row, no shuffle; documents that share a key may add sets twice, or sets that nobody asked for.
    """

    def run(batches):
        shingler = Shingler(width)
        for batch in _small(batches):
            sets = [shingler.set(t) for t in _binary(batch, 0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([signature(s) for s in sets], pa.int64()), pa.array([part(s).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                ["sig", "tokens"],
            )

    ids = members.select(F.col("rep").alias("key")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return src.join(ids, "key", "left_semi").select("text").mapInArrow(run, "sig long, tokens binary")


def _sharing(pairs: DataFrame, sets: DataFrame, kind, least) -> DataFrame:
    """Pairs (a, na, b, nb) whose arrays share at least ``least(na, nb)`` values."""

    def run(batches):
        for batch in _small(batches):
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            ta, tb = (batch.column(c).to_pylist() for c in ("ta", "tb"))
            shared = np.zeros(len(na), np.int64)
            for k in range(len(na)):
                x, y = np.frombuffer(ta[k], kind), np.frombuffer(tb[k], kind)
                shared[k] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
            keep = pa.array(shared >= least(na, nb))
            yield batch.select(["a", "na", "b", "nb"]).filter(keep)

    both = pairs.join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b")
    return both.mapInArrow(run, "a long, na long, b long, nb long")


def _verified(src: DataFrame, pairs: DataFrame, reps: DataFrame, width: int, t_num: int, t_den: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough."""
    pairs = materialise(pairs.distinct())
    members = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(reps, "sig")
    whole = materialise(_sets(src, members, width, lambda s: s))
    least = lambda x, y: -(-(x + y) * t_num // (t_num + t_den))
    return materialise(_sharing(pairs, whole, np.uint64, least).select("a", "b").distinct())


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: that with the smallest key; rows with a null key stay.

    Of rows that share a key one stays where their key is its component's.
    """
    found = similar_documents(docs, key, text)
    gone = found.where(F.col(key) != F.col("component_id")).select(key).distinct()
    return docs.join(small(gone, 16), key, "left_anti").select(*docs.columns)


def op7_ngram_jaccard(spark, sf_dir):
    return similar_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_ngram_jaccard": op7_ngram_jaccard}
ORACLES: dict[str, str] = {
    "op7_ngram_jaccard": r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
 s as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) as s from w where len(w) > 0),
 n as (select doc_id, count(*) as n from s group by doc_id),
 i as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
 p as (select i.a, i.b from i join n x on x.doc_id = i.a join n y on y.doc_id = i.b where 100 * i.i >= 80 * (x.n + y.n - i.i)),
 r as (select a, b from p union select r.a, p.b from r join p on r.b = p.a), m as (select a as doc_id, min(b) as low from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id from documents d left join n using (doc_id) left join m using (doc_id)"""
}
