"""Approximate nearest neighbours by a neighbour graph.

NN-descent builds the graph: starting from neighbours inside small cells, each round joins nodes with a sample of their
neighbours in both directions and offers every two neighbours of a node to each other; a node keeps the best it has been
offered. A query walks the graph greedily: it expands the best nodes that it has met until its best are all expanded.
Queries of one cell walk together and share the vectors that they fetch, so each vector reaches a block of queries once.

Equal vectors are one node; their smallest ids are put back at the end. Every list has a bounded length, so no step has
a row for each pair of a group, and hot vectors cost no more than others. Final scores are computed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftlens.session import materialize

#: Neighbours of a node, members of a local join, offers that a member gets from one, and rounds.
K, MEMBERS, OFFERS, ROUNDS = 24, 24, 4, 4
#: Pivots (a fixed number, broadcast), nodes of a starting cell, and starting partitions.
PIVOTS, CELL, STARTS = 64, 200, 2
#: Queries of a block, best nodes that a query keeps and expands, pivots it starts from, most steps.
QUERIES, BEAM, ENTRIES, STEPS = 128, 48, 8, 30


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(``id``, ``vec`` array<float>) of the rows that take part, one for each id.

    Without null ids, null or zero vectors, null or non-finite components, and vectors of another than the most common
    length. Of rows that share an id the smallest vector stays.
    """
    ok = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists("vec", lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where("id IS NOT NULL").where(ok)
    one = materialize(rows.groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    common = one.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return one.where(F.size("vec") == (common["dim"] if common else 0))


def _matrix(column: pa.Array, kind=np.float32) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(kind).reshape(len(column), -1)


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``scores`` the columns of the n best, and their scores."""
    n = min(n, scores.shape[1])
    at = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    return ids[at], np.take_along_axis(scores, at, 1)


def _edges(u: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    keep = np.isfinite(s) & (u != v)
    return pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep]), pa.array(s[keep].astype(np.float32))], names=["u", "v", "s"])


def best_of(edges: DataFrame, n: int) -> DataFrame:
    """The n best (``u``, ``v``, ``s``) of each u; the same pair counts once, ties go to the smaller v."""
    rank = F.dense_rank().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return edges.withColumn("r", rank).where(F.col("r") <= n).drop("r").distinct()


def _pivots(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and ids of ``PIVOTS`` nodes, those with the smallest hashes."""
    rows = nodes.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    return np.array([r["vec"] for r in rows], np.float32), np.array([r["id"] for r in rows], np.int64)


def start(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """First neighbours (``u``, ``v``, ``s``): the best inside small cells, in ``STARTS`` different partitions."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _matrix(batch.column(1)) @ shared.value.T
                for part in range(STARTS):
                    cell = near[:, part::STARTS].argmax(1) if len(shared.value) > part else np.zeros(batch.num_rows, np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cell * STARTS + part)], names=["id", "half", "cell"])

    def inside(group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        x = np.frombuffer(b"".join(group["half"].to_pylist()), np.float16).reshape(len(ids), -1).astype(np.float32)
        scores = x @ x.T
        np.fill_diagonal(scores, -np.inf)
        v, s = _best(scores, ids, K)
        return pa.Table.from_batches([_edges(np.repeat(ids, v.shape[1]), v.ravel(), s.ravel())])

    placed = materialize(nodes.mapInArrow(cells, "id long, half binary, cell long"), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL).alias("chunks"))
    chunk = F.pmod(F.xxhash64("id", "cell"), F.col("chunks"))
    return (placed.join(sizes, "cell").withColumn("chunk", chunk).groupBy("cell", "chunk")
            .applyInArrow(inside, "u long, v long, s float"))


def both_ways(edges: DataFrame, n: int, salt: int) -> DataFrame:
    """(``a``, ``b``): at most n neighbours of each node in either direction, chosen by hash."""
    pairs = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u")).distinct()
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64(F.least("a", "b"), F.greatest("a", "b"), F.lit(salt)), "b"))
    return pairs.withColumn("r", rank).where(F.col("r") <= n).drop("r")


def descend(nodes: DataFrame, edges: DataFrame, salt: int) -> DataFrame:
    """One round: offers (``u``, ``v``, ``s``) among the neighbours of each node."""
    members = (both_ways(edges, MEMBERS, salt).join(nodes.select(F.col("id").alias("b"), "half"), "b")
               .groupBy("a").agg(F.collect_list(F.struct("b", "half")).alias("m")).select("m.b", "m.half"))

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                ids, length = part.column(0).flatten().to_numpy(), np.diff(part.column(0).offsets.to_numpy())
                flat = np.frombuffer(b"".join(part.column(1).flatten().to_pylist()), np.float16).reshape(len(ids), -1)
                width = int(length.max())
                slot = np.arange(len(ids)) - np.repeat(np.cumsum(length) - length, length)
                row = np.repeat(np.arange(len(length)), length)
                x, name = np.zeros((len(length), width, flat.shape[1]), np.float32), np.full((len(length), width), -1)
                x[row, slot], name[row, slot] = flat, ids
                scores = x @ x.transpose(0, 2, 1)
                scores[(name < 0)[:, None, :] | (name < 0)[:, :, None] | np.eye(width, dtype=bool)] = -np.inf
                n = min(OFFERS, width)
                at = np.argpartition(-scores, n - 1, axis=2)[:, :, :n]
                v = np.take_along_axis(np.broadcast_to(name[:, None, :], scores.shape), at, 2)
                yield _edges(np.broadcast_to(name[:, :, None], v.shape).ravel(), v.ravel(), np.take_along_axis(scores, at, 2).ravel())

    return members.mapInArrow(offer, "u long, v long, s float")


def graph(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(``u``, ``v``, ``s``): the neighbour graph after ``ROUNDS`` rounds."""
    edges = materialize(best_of(start(nodes, pivots), K), "graph")
    for salt in range(ROUNDS):
        edges = materialize(best_of(edges.union(descend(nodes, edges, salt)), K), "graph")
    return edges


def search(nodes: DataFrame, edges: DataFrame, queries: DataFrame, pivots: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(``q``, ``v``, ``s``): the best nodes that each query (``q``, ``at`` a node to start from as well, ``vec``) has met."""
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(pivots)
    near = materialize(both_ways(edges, 2 * K, -1).groupBy("a").agg(F.collect_list("b").alias("near")), "adjacent")

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, ids = shared.value
        for batch in batches:
            if batch.num_rows:
                scores = _matrix(batch.column(2), np.float64) @ vectors.T.astype(np.float64)
                v, s = _best(scores, ids, ENTRIES)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores.argmax(1)), lists(v), lists(s)],
                                                 names=["q", "at", "vec", "cell", "v", "s"])

    entered = materialize(queries.mapInArrow(enter, "q long, at long, vec array<float>, cell long, v array<long>, s array<double>"), "entries")
    sizes = entered.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).alias("chunks"))
    block = F.xxhash64("cell", F.pmod(F.xxhash64("q"), F.col("chunks")))
    asked = materialize(entered.join(sizes, "cell").select(block.alias("block"), "q", "at", "vec", "v", "s"), "queries")
    found = asked.select("block", "q", F.explode(F.arrays_zip("v", "s")).alias("x")).select("block", "q", "x.v", "x.s")
    front = found.select("block", "v").union(asked.select("block", "at")).distinct()
    expanded = seen = None

    def rate(block: pa.Table, fetched: pa.Table) -> pa.Table:
        q, ids = block["q"].to_numpy(), fetched["v"].to_numpy()
        if not len(q) or not len(ids):
            return pa.table({"block": pa.array([], pa.int64()), "q": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
        v, s = _best(_matrix(block["vec"], np.float64) @ _matrix(fetched["vec"], np.float64).T, ids, BEAM)
        return pa.table({"block": pa.array(np.full(v.size, block["block"][0].as_py())), "q": pa.array(np.repeat(q, v.shape[1])),
                         "v": pa.array(v.ravel()), "s": pa.array(s.ravel())})

    rank = F.row_number().over(Window.partitionBy("block", "q").orderBy(F.desc("s"), "v"))
    for _ in range(STEPS):
        front = materialize(front if expanded is None else front.join(expanded, ["block", "v"], "left_anti"), "front")
        if front.isEmpty():
            break
        expanded = front if expanded is None else expanded.union(front)
        met = front.join(near, F.col("v") == F.col("a")).select("block", F.explode("near").alias("v"))
        met = met.union(front).distinct()
        new = materialize(met if seen is None else met.join(seen, ["block", "v"], "left_anti"), "met")
        seen = new if seen is None else seen.union(new)
        fetched = new.join(nodes.select(F.col("id").alias("v"), "vec"), "v").select("block", "v", "vec")
        rated = asked.select("block", "q", "vec").groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(
            rate, "block long, q long, v long, s double")
        both = found.union(rated).dropDuplicates(["block", "q", "v"])
        found = materialize(both.withColumn("r", rank).where(F.col("r") <= BEAM).drop("r"), "found")
        front = found.select("block", "v").distinct()
    return found.select("q", "v", "s")


def nearest(df: DataFrame, is_query: Column, n: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(``query_id``, ``rank`` from 1, ``vec_id``, ``score``): the n rows of largest inner product found for each query row.

    Nearest first, ties to the smaller id, the query's own id left out; fewer rows if there are fewer candidates. What
    takes no part is told in ``valid``; an empty table, or one without queries, gives no rows.
    """
    spark = df.sparkSession
    rows = valid(df, id_col, vec_col)
    classes = rows.groupBy("vec").agg(F.min("id").alias("node"))
    of = materialize(rows.join(classes, "vec").select("id", "node", "vec"), "vector_classes")

    # With one more component that makes all lengths equal, large vectors are not everybody's neighbours in the graph.
    longest = of.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x.cast("double") * x))).first()[0] or 1.0

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), np.float64) / np.sqrt(longest)
                x = np.hstack([x, np.sqrt(np.maximum(1 - (x * x).sum(1, keepdims=True), 0))]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "vec", "half"])

    nodes = materialize(of.where("id = node").select("id", "vec").mapInArrow(halves, "id long, vec array<float>, half binary"), "nodes")
    pivots = _pivots(nodes)
    empty = not len(pivots[1])
    edges = nodes.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0.0).cast("float").alias("s")).limit(0) if empty \
        else graph(nodes.select("id", "vec", "half"), pivots[0])
    asked = df.where(is_query).select(F.col(id_col).cast("long").alias("id")).distinct().join(of, "id").select(
        F.col("id").alias("q"), F.col("node").alias("at"), "vec")
    found = asked.select("q", F.col("at").alias("v"), F.lit(0.0).alias("s")).limit(0) if empty else search(nodes, edges, asked, pivots)
    copies = of.select("id", F.col("node").alias("v")).withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id")))
    pairs = found.select("q", "v").join(copies.where(F.col("r") <= n + 1).drop("r"), "v").where("id != q")
    exact = F.aggregate(F.zip_with("qvec", "vvec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda t, x: t + x)
    scored = (pairs.join(asked.select("q", F.col("vec").alias("qvec")), "q")
              .join(nodes.select(F.col("id").alias("v"), F.col("vec").alias("vvec")), "v").select("q", "id", exact.alias("score")))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= n).select(
        F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
