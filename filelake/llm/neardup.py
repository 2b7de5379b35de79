"""Embedding near-duplicates by NN-descent.

Random-hyperplane leaves start a neighbour graph; rounds of joins among neighbours of neighbours
refine it; edges at the threshold are kept. As a list that is full of such edges is saturated,
groups of such vectors are compared with each other wherever the angle between their centres
allows a link, and lists are then enlarged to the whole group that the threshold graph has around
them, compared block by block. ``audit_recall`` compares with brute force.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialise, table

#: Vectors that meet in one comparison at most.
LEAF = 64


def clean_vectors(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(label, vector, rep, copies): each distinct usable vector of a label once, with its smallest key.

    ``label`` holds the vector's length besides: vectors of different lengths have no cosine.
    """
    v = F.col(vector)
    usable = F.col(label).isNotNull() & F.col(key).isNotNull() & v.isNotNull()
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(usable).where(finite).select(F.col(key).alias("key"), F.struct(F.col(label).alias("label"), F.size(v).alias("length")).alias("label"), v.alias("vector"))
    return rows.groupBy("label", "vector").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as unit vectors in double precision; all have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _top(ids: np.ndarray, sims: np.ndarray, k: int):
    """Directed neighbour suggestions: for each row the k best others."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), int)
    rows = np.repeat(np.arange(len(ids)), k)
    return ids[rows], ids[best.ravel()], sims[rows, best.ravel()]


def _edges(parts) -> pa.Table:
    a, b, s = (np.concatenate(x) if x else np.zeros(0) for x in (zip(*parts, strict=True) if parts else ([], [], [])))
    return pa.table({"a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64)), "sim": pa.array(s.astype(np.float64))})


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k most similar distinct neighbours of each vector."""
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    one = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _compare(groups: DataFrame, by: list[str], k: int) -> DataFrame:
    """All pairs within small groups of (by..., rep, vector); each member's k best of the group."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("rep").to_numpy()
        x = _matrix(t.column("vector"))
        return _edges([_top(ids, x @ x.T, k)] if len(ids) > 1 else [])

    return groups.groupBy(*by).applyInArrow(run, "a long, b long, sim double")


def trees_for(depth: int, threshold: float, miss: float = 0.01, least: int = 10) -> int:
    """Trees after which a pair at the threshold has shared the code of ``depth`` planes at least once, but for a share of ``miss``."""
    together = (1 - np.arccos(min(1.0, threshold)) / np.pi) ** depth
    return least if together >= 1 else max(least, int(np.ceil(np.log(miss) / np.log1p(-together))))


def start_graph(base: DataFrame, k: int, trees: int | None, seed: int, threshold: float = 0.98) -> DataFrame:
    """First neighbour lists: leaves of random hyperplane codes, long leaves cut along one more projection.

    Codes get longer as labels grow; without ``trees`` their number grows with them.
    """
    size = base.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    depth = max(0, int(np.ceil(np.log2(size / (LEAF / 2)))))
    trees = trees or trees_for(depth, threshold)

    def by_length(batch):
        sizes = pc.list_value_length(batch.column(2))
        for n in pc.unique(sizes).to_pylist():
            yield batch.filter(pc.equal(sizes, n))

    def run(batches):
        for batch in (part for whole in batches for part in by_length(whole)):
            column = batch.column(2)
            x = _matrix(column)
            rng = np.random.default_rng(seed)
            for t in range(trees):
                planes = rng.standard_normal((x.shape[1], depth + 1))
                z = x @ planes
                code = (z[:, :depth] > 0) @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(x), t)), pa.array(code.astype(np.int64)), pa.array(z[:, depth]), batch.column(1), column],
                    ["label", "tree", "code", "along", "rep", "vector"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    coded = base.select("label", "rep", "vector").mapInArrow(
        run, f"label {kinds['label']}, tree long, code long, along double, rep long, vector {kinds['vector']}"
    )
    w = Window.partitionBy("label", "tree", "code").orderBy("along", "rep")
    leaves = coded.withColumn("leaf", F.floor((F.row_number().over(w) - 1) / LEAF))
    return materialise(_best(_compare(leaves, ["label", "tree", "code", "leaf"], k), k))


def refine(graph: DataFrame, base: DataFrame, k: int, rounds: int, settle: float = 0.002) -> DataFrame:
    """NN-descent rounds: the neighbours of a vector, forward and reverse, are compared with each other.

    Reverse lists are cut to the 2 k most similar, so a hub costs as much as any other vector.
    Stops when a round changes fewer than ``settle`` of all list entries.
    """
    vectors = base.select("rep", "vector")
    for _ in range(rounds):
        w = Window.partitionBy("b").orderBy(F.desc("sim"), "a")
        back = graph.withColumn("at", F.row_number().over(w)).where(F.col("at") <= 2 * k)
        around = (
            graph.select(F.col("a").alias("hub"), F.col("b").alias("rep"))
            .union(back.select(F.col("b").alias("hub"), F.col("a").alias("rep")))
            .union(graph.select(F.col("a").alias("hub"), F.col("a").alias("rep")))
            .distinct()
        )
        found = _compare(around.join(vectors, "rep"), ["hub"], k)
        better = materialise(_best(found.union(graph.select("a", "b", "sim")), k))
        entries = better.count()
        kept = better.join(graph.select("a", "b"), ["a", "b"], "left_semi").count()
        graph = better
        if entries - kept <= settle * entries:
            break
    return graph


def bridges(graph: DataFrame, groups: DataFrame, base: DataFrame, threshold: float, k: int, block: int = 512, tile: int = 256) -> DataFrame:
    """A link (a, b) for every pair of groups that have one between vectors with saturated lists.

    A link is in neither list only if both are full of better ones. Such vectors are cut into
    blocks by group; two blocks can hold a link only if the angle between their centres is at most
    that of the threshold and both radii, and these pairs are compared whole. Centres are compared
    in tiles, so their number squared is dealt over tasks of ``tile`` by ``tile``.
    """
    full = graph.where((F.col("rank") == k) & (F.col("sim") >= threshold)).select(F.col("a").alias("id"))
    placed = _dealt(full.join(groups, "id"), block)
    placed = materialise(placed.join(base.select(F.col("rep").alias("id"), "label", "vector"), "id"))
    kind = placed.schema["label"].dataType.simpleString()

    def centre(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("vector"))
        c = x.mean(0)
        c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-9 else x[0]
        radius = float(np.arccos(np.clip((x @ c).min(), -1, 1)))
        one = t.select(["label", "component", "block"]).slice(0, 1)
        return one.append_column("vector", pa.array([c.tolist()])).append_column("radius", pa.array([radius]))

    centres = placed.groupBy("component", "block").applyInArrow(centre, f"label {kind}, component long, block long, vector array<double>, radius double")
    centres = materialise(centres)
    most = centres.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    if most < 2:
        return graph.select("a", "b").where("false")
    tiles = -(-most // tile)
    own, other = F.col("own"), F.col("other")
    dealt = centres.withColumn("own", F.pmod(F.xxhash64("component", "block"), F.lit(tiles))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    dealt = dealt.withColumns({"lo": F.least(own, other), "hi": F.greatest(own, other), "side": (own > other).cast("int")})

    def close(t: pa.Table) -> pa.Table:
        c, b, r, side = (t.column(n).to_numpy() for n in ("component", "block", "radius", "side"))
        x = _matrix(t.column("vector"))
        may = np.arccos(np.clip(x @ x.T, -1, 1)) <= np.arccos(threshold) + r[:, None] + r[None] + 1e-6
        may &= c[:, None] != c[None]
        across = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
        i, j = np.nonzero(may & (side[:, None] < side[None]) if across else np.triu(may, 1))
        return pa.table({"ca": c[i], "ba": b[i], "cb": c[j], "bb": b[j]})

    pairs = materialise(dealt.groupBy("label", "lo", "hi").applyInArrow(close, "ca long, ba long, cb long, bb long"))
    columns = ["ca", "ba", "cb", "bb", "side", "id", "vector"]
    left = placed.join(pairs, (placed["component"] == pairs["ca"]) & (placed["block"] == pairs["ba"])).withColumn("side", F.lit(0))
    right = placed.join(pairs, (placed["component"] == pairs["cb"]) & (placed["block"] == pairs["bb"])).withColumn("side", F.lit(1))

    def best(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        ids, x = t.column("id").to_numpy(), _matrix(t.column("vector"))
        a, b = side == 0, side == 1
        s = x[a] @ x[b].T
        i, j = np.unravel_index(s.argmax(), s.shape)
        n = int(s[i, j] >= threshold)
        return _edges([(ids[a][[i]][:n], ids[b][[j]][:n], s[[i], [j]][:n])])

    tiled = left.select(*columns).unionByName(right.select(*columns))
    return tiled.groupBy("ca", "ba", "cb", "bb").applyInArrow(best, "a long, b long, sim double").select("a", "b")


def _dealt(groups: DataFrame, size: int) -> DataFrame:
    """``groups`` (id, component) with a block of about ``size`` members by hash, so no group is ordered in one task."""
    counted = groups.groupBy("component").agg(F.ceil(F.count("*") / size).alias("blocks"))
    return groups.join(counted, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")


def _spanned(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the first row that it is connected with."""
    first = np.arange(len(link))
    while True:
        now = np.minimum(first, np.where(link, first[None], len(link)).min(1, initial=len(link)))
        now = now[now]
        if (now == first).all():
            return first
        first = now


def enlarge(edges: DataFrame, base: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """(id, other, linked): the weight of a vector's links within one comparison of blocks, and a vector it is connected with.

    A list that is full can't name all its links; the members of a group of the threshold graph are cut into
    blocks, and each pair of blocks is one comparison in one task, so a group of any size spreads
    over the cluster. A comparison gives a row a member, not a row a pair.
    """
    placed = _dealt(components(edges), block)
    placed = materialise(placed.join(base.select(F.col("rep").alias("id"), "copies", "vector"), "id"))
    blocks = placed.select("component", "block").distinct()
    pairs = blocks.join(blocks.withColumnRenamed("block", "other"), "component").where("block <= other")
    left = placed.join(pairs, ["component", "block"]).withColumn("side", F.lit(0))
    right = placed.withColumnRenamed("block", "other").join(pairs.where("block < other"), ["component", "other"]).withColumn("side", F.lit(1))
    columns = ["component", "block", "other", "side", "id", "copies", "vector"]

    def run(t: pa.Table) -> pa.Table:
        side, ids, copies = (t.column(c).to_numpy() for c in ("side", "id", "copies"))
        x = _matrix(t.column("vector"))
        link = x @ x.T >= threshold
        np.fill_diagonal(link, False)
        if side.any():
            link &= side[:, None] != side[None]
        on = link.any(1)
        return pa.table({"id": ids[on], "other": ids[_spanned(link)][on], "linked": (link @ copies)[on]})

    tiles = left.select(*columns).unionByName(right.select(*columns))
    return tiles.groupBy("component", "block", "other").applyInArrow(run, "id long, other long, linked long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, k: int = 12, trees: int | None = None, rounds: int = 3, seed: int = 11) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id, kept.

    Only vectors of one label (not null) are compared, by cosine in double precision. Vectors
    that are null, zero, or hold null or non-finite components link with nothing, nor do rows
    with a null key. Equal vectors are one node that counts its copies, so they are never
    paired; vectors of different lengths link with nothing of each other. ``key`` is an integer and unique.
    Other columns of ``vectors`` are left out. ``trees``: see ``start_graph``.
    """
    vectors = vectors.select(key, vector, label)
    base = materialise(clean_vectors(vectors, key, vector, label))
    graph = refine(start_graph(base, k, trees, seed, threshold), base, k, rounds)
    edges = materialise(graph.where(F.col("sim") >= threshold).select("a", "b"))
    # groups that this joins are compared whole below
    edges = materialise(edges.union(bridges(graph, components(edges), base, threshold, k)))
    links = materialise(enlarge(edges, base, threshold))
    weights = links.groupBy(F.col("id").alias("rep")).agg(F.sum("linked").alias("linked"))
    groups = components(links, "id", "other").withColumnRenamed("id", "rep")
    nodes = base.join(weights, "rep", "left").join(groups, "rep", "left")
    nodes = nodes.select(
        F.col("label.label").alias("__label"), F.col("vector").alias("__vector"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"),
    )
    found = vectors.join(nodes, (vectors[label] == nodes["__label"]) & (vectors[vector] == nodes["__vector"]) & vectors[key].isNotNull(), "left")
    component = F.coalesce("component_id", vectors[key])
    return found.select(
        vectors[key], F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(vectors[key] == component, F.lit(True)).alias("kept"),
    )


def audit_recall(vectors: DataFrame, found: DataFrame, every: int = 50, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, block: int = 1024) -> float:
    """Share of the true links of every ``every``-th vector that ``found`` counts.

    That query set meets all vectors of its label by brute force, in blocks of both that are dealt
    over tasks. A vector's links are compared in number: more than the true ones count as none found.
    """
    base = materialise(clean_vectors(vectors, key, vector, label))
    queries = base.where(F.col("rep") % every == 0)
    most = lambda rows: rows.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    n_rows, n_queries = -(-most(base) // block), -(-most(queries) // block)
    own = lambda n: F.pmod(F.xxhash64("rep"), F.lit(n))
    row_tiles = base.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))))
    query_tiles = queries.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))))
    tiles = row_tiles.select("label", "rep", "copies", "vector", F.lit(0).alias("side"), own(n_rows).alias("r"), "q").unionByName(
        query_tiles.select("label", "rep", "copies", "vector", F.lit(1).alias("side"), "r", own(n_queries).alias("q"))
    )

    def run(t: pa.Table) -> pa.Table:
        side, ids, copies = (t.column(c).to_numpy() for c in ("side", "rep", "copies"))
        x, a = _matrix(t.column("vector")), side == 1
        link = (x[a] @ x[~a].T >= threshold) & (ids[a][:, None] != ids[~a][None])
        return pa.table({"id": ids[a], "n": link @ copies[~a]})

    true = tiles.groupBy("label", "r", "q").applyInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    true = true.join(queries.select(F.col("rep").alias("id"), "copies"), "id").select("id", (F.col("n") + F.col("copies") - 1).alias("n"))
    got = F.when(F.col("n_links") <= F.col("n"), F.col("n_links")).otherwise(0)
    both = true.join(found.select(F.col(key).alias("id"), "n_links"), "id").agg(F.sum(got), F.sum("n")).first()
    return 1.0 if not both[1] else both[0] / both[1]


def op6_embedding_neardup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_embedding_neardup": op6_embedding_neardup}
ORACLES: dict[str, str] = {
    "op6_embedding_neardup": """with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
 u as (select * from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
 p as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
 r as (select a, b from p union select r.a, p.b from r join p on r.b = p.a),
 n as (select a as vec_id, count(*) as n_links from p group by a), m as (select a as vec_id, min(b) as low from r group by a)
select v.vec_id, coalesce(n_links, 0) as n_links, least(v.vec_id, coalesce(low, v.vec_id)) as component_id, v.vec_id <= coalesce(low, v.vec_id) as kept from v left join n using (vec_id) left join m using (vec_id)"""
}
