"""Trie of conversation prefixes with subtree totals, rolled up by bands of depths.

A prefix is known by the xor of 128-bit hashes of (turn, place), so a turn more is one xor more
and the parent of a prefix is one xor away. Nodes are the distinct prefixes. For the totals depths are cut
into bands of ``BAND``: inside a band a node's figures are exploded to its ancestors in that band only; the roots
of bands, with what lies below them in their band, form a trie of a depth ``BAND`` times smaller, which is
solved the same way, and their completed totals then go to the ancestors in the band above. So a row is exploded
to ``BAND`` rows at most, and there are log(depth) / log(BAND) rounds.

No task holds a conversation or a node's members as a whole: turns are numbered in ranges of a
global order with the counts of earlier ranges carried over, xors run in blocks of places with carries, members
are hashed as a stream of joined pieces.

Null roles and texts are empty; turns of one number are taken by role and text, repeated rows all count; rows without conv_id belong to no
conversation and are left out; other columns are ignored. No conversations make no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small, table

#: Depths of a band, places of a block of a running xor, characters of ids in a piece of a member list.
BAND, BLOCK, PIECE = 16, 1024, 1 << 16
KEY = ["depth", "a", "b"]
FIGURES = ["leaves", "saved"]


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place from 0, digest, bytes) of every turn; digest is of role and text, bytes those of the text.

    One conversation of any length spreads over many ranges: a range numbers its turns by itself, and the ranges before it tell
    where it starts. Texts are left behind here.
    """
    rows = turns.where("conv_id is not null").select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # equal rows can be parted
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), *map(F.col, ("role", "text", "row"))]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    bare = ranged.select("conv_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"), F.spark_partition_id().alias("part"))

    def run(batches):
        conv, at = None, 0
        for batch in batches:
            places = []
            for c in batch.column(0).to_pylist():
                conv, at = c, at + 1 if c == conv else 0
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "place"])

    kind = dict(bare.dtypes)["conv_id"]
    local = materialise(bare.mapInArrow(run, f"conv_id {kind}, digest binary, bytes long, part int, place long"))
    counts = local.groupBy("conv_id", "part").agg((F.max("place") + 1).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a range goes on with one conversation at most
    carried = small(counts.select("conv_id", "part", F.sum("n").over(before).alias("carry")).where("carry > 0"), 24)
    return local.join(carried, ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("carry", F.lit(0))).alias("place"), "digest", "bytes")


def rebuilt_turns(turns: DataFrame, family: int = 5, spread: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another one's turns: (conv_id, place, digest, bytes, last), and (conv_id, n_turns) of all.

    Conversation c takes the first h turns of c - c % family, h = crc32(c) % spread, and goes on with its own after its first h.
    """
    rows = materialise(numbered_turns(turns))
    first = F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"first": first, "donor": F.col("conv_id") - F.col("conv_id") % family})
    convs = materialise(convs)
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("own").alias("given"))
    convs = convs.join(donors, "donor", "left").withColumn("taken", F.least("first", F.coalesce("given", F.lit(0))))
    convs = materialise(convs.select("conv_id", "donor", "first", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("first"), F.lit(0))).alias("n_turns")))
    lent = rows.where((F.col("place") < spread - 1) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "donor")
    head = convs.join(lent, "donor").where("place < first").select("conv_id", "place", "digest", "bytes", "n_turns")
    rest = rows.join(convs, "conv_id").where("place >= first").select("conv_id", (F.col("place") - F.col("first") + F.col("taken")).alias("place"), "digest", "bytes", "n_turns")
    both = head.unionByName(rest).withColumn("last", F.col("place") + 1 == F.col("n_turns"))
    return both.drop("n_turns"), convs.select("conv_id", "n_turns")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, up_a, up_b, bytes, last): the prefix that each turn ends, and the one before it; ``turns`` as ``rebuilt_turns`` gives them."""
    rows = turns.withColumns({"x": F.xxhash64("digest", "place"), "y": F.xxhash64("place", "digest"), "block": F.floor(F.col("place") / BLOCK)})
    rows = materialise(rows.drop("digest"))
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = small(blocks.select("conv_id", "block", F.bit_xor("x").over(before).alias("cx"), F.bit_xor("y").over(before).alias("cy")).where("block > 0"), 32)
    upto = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"px": F.bit_xor("x").over(upto), "py": F.bit_xor("y").over(upto)}).join(carried, ["conv_id", "block"], "left")
    a, b = (F.col(p).bitwiseXOR(F.coalesce(c, F.lit(0).cast("long"))) for p, c in (("px", "cx"), ("py", "cy")))
    return rows.select(
        "conv_id", (F.col("place") + 1).alias("depth"), a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("up_a"), b.bitwiseXOR(F.col("y")).alias("up_b"), "bytes", "last"
    )


def _band(depth: Column) -> Column:
    """The band whose steps lead to a depth; its root is the depth above its first step."""
    return F.floor((depth - 1) / BAND)


def _carried_up(figures: DataFrame, steps: DataFrame, whole: bool) -> DataFrame:
    """Figures of nodes summed at their ancestors of their band; ``whole`` with the band's root among them."""
    paths = steps.groupBy("conv_id", _band(F.col("depth")).alias("band")).agg(F.collect_list(F.struct("depth", "up_a", "up_b")).alias("path"))
    nodes = figures.where("depth > 0").withColumn("band", _band(F.col("depth"))).join(paths, ["conv_id", "band"])
    above = F.filter("path", lambda s: (s["depth"] <= F.col("depth")) & (F.lit(whole) | (s["depth"] % BAND != 1)))
    pairs = nodes.select(F.explode(above).alias("s"), *FIGURES).select((F.col("s.depth") - 1).alias("depth"), F.col("s.up_a").alias("a"), F.col("s.up_b").alias("b"), *FIGURES)
    return pairs.groupBy(*KEY).agg(*(F.sum(c).alias(f"more_{c}") for c in FIGURES))


def _with_more(figures: DataFrame, more: DataFrame) -> DataFrame:
    return figures.join(more, KEY, "left").select(*KEY, "conv_id", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in FIGURES))


def subtree_totals(figures: DataFrame, steps: DataFrame) -> DataFrame:
    """(depth, a, b, conv_id, leaves, saved) summed over subtrees.

    ``figures`` are those of each node, with any conversation that passes it; ``steps`` are (conv_id, depth, a, b, up_a, up_b), a row
    per conversation and depth from 1.
    """
    is_root = F.col("depth") % BAND == 0
    inside = materialise(_with_more(figures, _carried_up(figures.where(~is_root), steps, True)))
    if inside.where(is_root & (F.col("depth") > 0)).isEmpty():
        return inside
    scaled = lambda df, by: df.withColumn("depth", by)
    # a band that is complete is one step between band roots
    long_steps = steps.groupBy("conv_id", _band(F.col("depth")).alias("band")).agg(
        F.max(F.when(is_root, F.struct("a", "b"))).alias("end"), F.min(F.struct("depth", "up_a", "up_b")).alias("start")
    )
    long_steps = materialise(long_steps.where("end is not null").select("conv_id", (F.col("band") + 1).alias("depth"), "end.a", "end.b", "start.up_a", "start.up_b"))
    roots = subtree_totals(scaled(inside.where(is_root), (F.col("depth") / BAND).cast("long")), long_steps)
    roots = materialise(scaled(roots, F.col("depth") * BAND))
    others = _with_more(inside.where(~is_root), _carried_up(roots, steps, False))
    return others.unionByName(roots)


def member_digests(members: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of (depth, a, b, conv_id): the hash of ids in order with commas between.

    Ranges of the members join their ids to pieces, so that what must be hashed in one go are a few long strings, in constant memory.
    """
    kinds = [pa.int64()] * 3
    id_kind = dict(members.dtypes)["conv_id"]

    def pieces(batches):
        now, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if ids and (key != now or size > PIECE):
                    out.append((*now, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    now, first = key, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [*kinds, batch.column(3).type, pa.string()], strict=True)], [*KEY, "first", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, first, ",".join(ids)), [*kinds, batch.column(3).type, pa.string()], strict=True)], [*KEY, "first", "ids"])

    def hashed(batches):
        now, state = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, state.hexdigest()), [*kinds, pa.string()], strict=True)], [*KEY, "ends_sha256"])
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True):
                if key != now:
                    if state:
                        done.append(row())
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if state:
            yield row()

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*KEY, "conv_id"]
    parts = members.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(pieces, f"depth long, a long, b long, first {id_kind}, ids string")
    dealt = parts.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return dealt.mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` are (conv_id, place, digest, bytes, last) and ``convs`` (conv_id, n_turns), as ``rebuilt_turns`` gives them; conversations without turns end at the root.
    """
    steps = materialise(prefixes(turns))
    zero = F.lit(0).cast("long")
    # every conversation passes the root, which has no text
    tops = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *(zero.alias(c) for c in KEY), "conv_id", "n_convs", *(F.lit(None).cast("long").alias(c) for c in ("up_a", "up_b")), zero.alias("bytes")
    )
    nodes = steps.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in ("up_a", "up_b", "bytes")))
    nodes = materialise(nodes.unionByName(tops))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = materialise(nodes.join(parents, ["depth", "up_a", "up_b"], "left"))
    own = nodes.select(*KEY, "conv_id", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    totals = subtree_totals(own, steps).drop("conv_id")
    ends = steps.where("last").select(*KEY, "conv_id").unionByName(convs.where("n_turns = 0").select(*(zero.alias(c) for c in KEY), "conv_id"))
    out = nodes.join(totals, KEY).join(member_digests(ends), KEY, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")
    )


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(*rebuilt_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295)"
ORACLES: dict[str, str] = {
    "op12_prefix_trie": f"""with o as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
 t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as place from o),
 c as (select conv_id, count(*) as own, conv_id - conv_id % 5 as donor, {_CRC} % 9 as h from t group by conv_id),
 k as (select c.*, least(c.h, coalesce(d.own, 0)) as taken from c left join c d on d.conv_id = c.donor),
 r as (select k.conv_id, place, role, text from k join t on t.conv_id = k.donor and place < h union all select k.conv_id, place - h + taken, role, text from k join t on t.conv_id = k.conv_id and place >= h),
 p as (select conv_id, place + 1 as depth, string_agg(md5(length(role) || ':' || role || text), '') over (partition by conv_id order by place rows unbounded preceding) as path, octet_length(encode(text)) as bytes from r union all select conv_id, 0, '', 0 from c),
 n as (select depth, path, left(path, 32 * (depth - 1)) as up, min(conv_id) as conv_id, count(*) as n_convs, min(bytes) as bytes from p group by depth, path),
 ch as (select up as path, count(*) as n_children from n where depth > 0 group by up),
 v as (select n.*, coalesce(n_children, 0) as n_children from n left join ch using (path)),
 s as (select left(path, 32 * j) as path, sum((n_children = 0)::bigint) as n_leaves, sum((n_convs - 1) * bytes) as saved_tokens from (select *, unnest(range(0, depth + 1)) as j from v) group by 1),
 e as (select path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from (select conv_id, arg_max(path, depth) as path from p group by conv_id) group by path)
select v.conv_id, v.depth::bigint as depth, case when v.depth > 0 then u.conv_id end as parent_conv_id, v.n_convs, v.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
 from v join s using (path) left join e using (path) left join n u on u.path = v.up and u.depth = v.depth - 1"""
}
