"""Approximate nearest neighbours by inner product, with one small-world graph per shard.

Distinct vectors are dealt into shards by hash. Each shard gets a hierarchical navigable small-world
graph: levels drawn by hash with geometric chances, and on each level links to near
and diverse neighbours, kept as flat arrays. Vectors get one more component that makes all of
them equally long, so that the largest inner product is the nearest point. Every
query descends each shard's levels and searches its ground level with a beam; the
shards' results are merged. All shards are searched, so the work is queries times
shards; larger shards mean fewer of them.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component take no part; vectors of different lengths do not meet; equal
vectors are one node of the graph and share its results, whatever their number; a null
id takes no part; rows that repeat an id and a vector are one; empty tables give empty
results. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trapline.llm import common
from trapline.session import materialise

INDEX = "shard int, dim int, node binary, vectors binary, levels binary, links binary"


def _nearest(x: np.ndarray, width: int, block: int = 1024) -> np.ndarray:
    """The ``width`` other rows of largest inner product, best first."""
    out = np.empty((len(x), width), dtype=np.int32)
    for at in range(0, len(x), block):
        dots = x[at:at + block] @ x.T
        dots[np.arange(len(dots)), np.arange(at, at + len(dots))] = -np.inf
        near = np.argpartition(-dots, min(width, len(x) - 1) - 1, axis=1)[:, :width]
        order = np.argsort(-np.take_along_axis(dots, near, 1), axis=1, kind="stable")
        out[at:at + block] = np.take_along_axis(near, order, 1)
    return out


def _diverse(x: np.ndarray, near: np.ndarray, degree: int, block: int = 512) -> np.ndarray:
    """Of each row's candidates those closer to it than to any one kept before, then the nearest of the rest."""
    n, width = near.shape
    out = np.full((n, degree), -1, dtype=np.int32)
    for at in range(0, n, block):
        some = near[at:at + block]
        points = x[some]
        own = np.einsum("id,iwd->iw", x[at:at + block], points)
        among = np.einsum("iwd,ivd->iwv", points, points)
        kept = np.zeros(some.shape, dtype=bool)
        for w in range(width):
            crowded = (kept & (among[:, w, :] > own[:, w, None])).any(axis=1)
            kept[:, w] = ~crowded & (kept.sum(axis=1) < degree)
        rank = np.where(kept, 0, width) + np.arange(width)
        chosen = np.argsort(rank, axis=1, kind="stable")[:, :degree]
        out[at:at + block, :chosen.shape[1]] = np.take_along_axis(some, chosen, 1)
    return out


def _both_ways(links: np.ndarray, degree: int) -> np.ndarray:
    """Links also lead back, as far as there is room for ``degree``."""
    n, width = links.shape
    source = np.repeat(np.arange(n), width)
    target = links.ravel()
    there = target >= 0
    source, target = source[there], target[there]
    a = np.concatenate([source, target])
    b = np.concatenate([target, source])
    place = np.concatenate([np.tile(np.arange(width), n)[there], np.full(len(target), width) + np.arange(len(target)) % width])
    pair, first = np.unique(a * np.int64(n) + b, return_index=True)
    a, b, place = pair // n, pair % n, place[first]
    order = np.lexsort((place, a))
    a, b = a[order], b[order]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, degree), -1, dtype=np.int32)
    fits = nth < degree
    out[a[fits], nth[fits]] = b[fits]
    return out


class Graph:
    """Levels from the ground up: ``members[l]`` are nodes, ``links[l]`` places in ``members[l]``."""

    def __init__(self, vectors: np.ndarray, level_of: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.level_of, self.links = vectors, level_of, links
        self.members = [np.flatnonzero(level_of >= l) for l in range(len(links))]
        sizes = np.einsum("id,id->i", vectors, vectors)
        self.points = np.column_stack([vectors, np.sqrt(np.maximum(sizes.max() - sizes, 0))]).astype(np.float32)

    @classmethod
    def build(cls, vectors: np.ndarray, chance: np.ndarray, m: int) -> Graph:
        """``chance`` is one number in [0, 1) a vector."""
        level_of = np.floor(-np.log1p(-chance) / np.log(m)).astype(np.int32)
        graph = cls(vectors, level_of, [np.zeros((0, 0), np.int32)] * (int(level_of.max()) + 1))
        for l, members in enumerate(graph.members):
            degree = 2 * m if l == 0 else m
            x = graph.points[members]
            if len(x) == 1:
                graph.links[l] = np.full((1, degree), -1, dtype=np.int32)
                continue
            near = _nearest(x, min(3 * m, len(x) - 1))
            graph.links[l] = _both_ways(_diverse(x, near, degree // 2 if l == 0 else degree), degree)
        return graph

    def search(self, queries: np.ndarray, beam: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, inner products) of the beam of each query, best first; -1 where there are fewer."""
        q = np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32)
        rows = np.arange(len(q))
        entry = np.zeros(len(q), dtype=np.int64)
        for l in range(len(self.links) - 1, 0, -1):
            x = self.points[self.members[l]]
            best = np.einsum("id,id->i", q, x[entry])
            while True:
                around = self.links[l][entry]
                dots = np.where(around >= 0, np.einsum("id,iwd->iw", q, x[around]), -np.inf)
                pick = dots.argmax(axis=1)
                better = dots[rows, pick] > best
                if not better.any():
                    break
                entry = np.where(better, around[rows, pick], entry)
                best = np.where(better, dots[rows, pick], best)
            entry = np.searchsorted(self.members[l - 1], self.members[l][entry])
        n = len(self.points)
        seen = np.zeros((len(q), n + 1), dtype=bool)
        seen[:, n] = True
        nodes = np.full((len(q), beam), n, dtype=np.int64)
        dots = np.full((len(q), beam), -np.inf, dtype=np.float32)
        opened = np.ones((len(q), beam), dtype=bool)
        nodes[:, 0], opened[:, 0] = entry, False
        dots[:, 0] = np.einsum("id,id->i", q, self.points[entry])
        seen[rows, entry] = True
        links = np.vstack([np.where(self.links[0] < 0, n, self.links[0]), np.full((1, self.links[0].shape[1]), n)])
        points = np.vstack([self.points, np.zeros((1, self.points.shape[1]), np.float32)])
        live = rows
        while len(live):
            # Beams are in order, so the first unopened entries are the best ones.
            closed = opened[live]
            places = np.argsort(closed, axis=1, kind="stable")[:, :at_once]
            fresh = ~np.take_along_axis(closed, places, 1)
            chosen = np.where(fresh, np.take_along_axis(nodes[live], places, 1), n)
            opened[live[:, None], places] = True
            around = links[chosen].reshape(len(live), -1)
            around.sort(axis=1)
            around[:, 1:][around[:, 1:] == around[:, :-1]] = n
            new = np.where(seen[live[:, None], around], n, around)
            seen[live[:, None], new] = True
            got = np.where(new < n, np.einsum("id,iwd->iw", q[live], points[new]), -np.inf)
            all_dots = np.concatenate([dots[live], got], axis=1)
            order = np.argsort(-all_dots, axis=1, kind="stable")[:, :beam]
            dots[live] = np.take_along_axis(all_dots, order, 1)
            nodes[live] = np.take_along_axis(np.concatenate([nodes[live], new], axis=1), order, 1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], np.broadcast_to(new == n, new.shape)], axis=1), order, 1)
            live = live[~opened[live].all(axis=1)]
        return np.where(nodes == n, -1, nodes), dots


def _builder(m: int):
    def run(key, shard):
        vectors = np.frombuffer(b"".join(shard.column("vector").to_pylist()), "<f8").reshape(shard.num_rows, -1)
        node = shard.column("node").to_numpy()
        chance = (common.mix(node.astype(np.uint64)) >> np.uint64(11)).astype(float) * 2.0 ** -53
        graph = Graph.build(vectors, chance, m)
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()),
            "node": [node.astype("<i8").tobytes()], "vectors": [vectors.tobytes()],
            "levels": [graph.level_of.astype("<i4").tobytes()],
            "links": pa.array([b"".join(x.astype("<i4").tobytes() for x in graph.links)], pa.binary())})

    return run


def load(row: dict, m: int) -> tuple[np.ndarray, Graph]:
    """(node ids, graph) of an index row."""
    node = np.frombuffer(row["node"], "<i8")
    vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(node), -1)
    level_of = np.frombuffer(row["levels"], "<i4")
    flat, at, links = np.frombuffer(row["links"], "<i4"), 0, []
    for l in range(int(level_of.max()) + 1):
        n, degree = int((level_of >= l).sum()), 2 * m if l == 0 else m
        links.append(flat[at:at + n * degree].reshape(n, degree))
        at += n * degree
    return node, Graph(vectors, level_of, links)


def _searcher(m: int, beam: int, k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                node, graph = load(row, m)
                query = np.frombuffer(row["q_node"], "<i8")
                vectors = np.frombuffer(row["q_vectors"], "<f8").reshape(len(query), -1)
                found, _ = graph.search(vectors, max(beam, k))
                at, place = np.nonzero(found >= 0)
                hit = found[at, place]
                score = np.einsum("id,id->i", vectors[at], graph.vectors[hit])
                # The shard's k best by their exact products, and all that tie with the last of them.
                order = np.lexsort((-score, at))
                at, hit, score = at[order], hit[order], score[order]
                nth = np.arange(len(at)) - np.searchsorted(at, at)
                last = np.full(len(query), -np.inf)
                last[at[nth == k - 1]] = score[nth == k - 1]
                kept = score >= last[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query[at[kept]]), pa.array(node[hit[kept]]), pa.array(score[kept])], ["q_node", "node", "score"])

    return run


def _blocks(key, block):
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()),
                     "q_node": [block.column("node").to_numpy().astype("<i8").tobytes()],
                     "q_vectors": [b"".join(block.column("vector").to_pylist())]})


def _packed(batches):
    for batch in batches:
        vectors = [np.array(v, "<f8").tobytes() for v in batch.column("v").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("dim"), pa.array(vectors, pa.binary())], ["id", "dim", "vector"])


def vectors_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, dim, vector`` of the usable vectors, as bytes of doubles."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    # Zero has two signs, which would tell equal vectors apart.
    plain = F.transform(v, lambda x: F.when(x == 0, 0.0).otherwise(x))
    return (df.where(F.col(id_col).isNotNull() & usable)
            .select(F.col(id_col).cast("long").alias("id"), F.size(v).alias("dim"), plain.alias("v"))
            .mapInArrow(_packed, "id long, dim int, vector binary"))


def build_index(nodes: DataFrame, *, m: int = 16, shard_rows: int = 4_096) -> DataFrame:
    """One row a shard, from ``node, dim, vector``: node ids, vectors, levels and links as flat arrays."""
    counts = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = nodes.join(F.broadcast(counts), "dim").select(
        "node", "dim", "vector", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int").alias("shard"))
    return dealt.groupBy("shard", "dim").applyInArrow(_builder(m), INDEX)


def search(df: DataFrame, queries, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, m: int = 16, beam: int = 160,
           shard_rows: int = 4_096, query_rows: int = 512) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row whose id ``queries`` (a column condition on ``id``) takes."""
    rows = materialise(vectors_of(df, id_col, vector_col).distinct(), "vectors")
    nodes = materialise(rows.groupBy("dim", "vector").agg(F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    index = materialise(build_index(nodes.select("node", "dim", "vector"), m=m, shard_rows=shard_rows), "index")
    ids = materialise(rows.join(nodes.select("dim", "vector", "node"), ["dim", "vector"]).select("id", "node"), "ids")
    asked = ids.where(queries)
    wanted = nodes.join(asked.select("node").distinct(), "node").select("node", "dim", "vector")
    some = F.greatest(F.lit(1), F.ceil(F.count("*") / query_rows)).cast("int").alias("blocks")
    blocks = (wanted.join(F.broadcast(wanted.groupBy("dim").agg(some)), "dim")
              .select("dim", "node", "vector", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("block"))
              .groupBy("dim", "block").applyInArrow(_blocks, "dim int, q_node binary, q_vectors binary"))
    # A block of queries for each shard: the stated query set against all rows.
    shards = index.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    sent = blocks.join(shards, "dim").select("dim", "q_node", "q_vectors", F.explode("shards").alias("shard"))
    hits = sent.join(index, ["dim", "shard"]).select("node", "vectors", "levels", "links", "q_node", "q_vectors").mapInArrow(
        _searcher(m, beam, k + 1), "q_node long, node long, score double")
    # More ids of one vector than a list is long can never be in it; one more, as a query leaves itself out.
    by_id = Window.partitionBy("node").orderBy("id")
    fewest = ids.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1).select("node", "id")
    best = Window.partitionBy("q_node").orderBy(F.col("score").desc(), "id")
    lists = (hits.join(fewest, "node").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
             .groupBy("q_node").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("hits")))
    own = asked.join(lists, asked["node"] == lists["q_node"]).select(F.col("id").alias("query_id"), "hits")
    others = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    return (own.select("query_id", F.posexplode(others).alias("at", "h"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("h.id").alias("vec_id"), "h.score"))
