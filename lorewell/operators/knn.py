"""Exact nearest neighbours by blocked matrix products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.vectors import as_doubles
from lorewell.sources.store import durable, plain_unions, small_batches

#: Rows of a block of vectors and of a block of queries, about.
BLOCK, QUERIES = 8192, 1024
#: Vectors, and queries, of a cell, about, where there are more than tasks ask for.
CELL = 65_536
#: Pairs from which on equal vectors are looked for, and how many of them are one row, about.
MANY, TOGETHER = 1 << 30, 8192
#: Queries of a block whose scores are looked at together.
AT_ONCE = 32
#: Bytes from which on a worker gets no more rows at once: a block of vectors, about.
BATCH_BYTES = 4 << 20


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    lens = np.diff(column.offsets.to_numpy())
    if len(lens) and (lens != lens[0]).any():
        raise ValueError("vectors of several lengths")
    return column.flatten().to_numpy().reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1.0)


def _gather(unit: bool):
    def gather(t: pa.Table) -> pa.Table:
        x = _rows(t["v"])
        x = np.ascontiguousarray(_unit(x) if unit else x)
        return pa.table({"block": t["block"][:1], "ids": pa.array([t["id"].to_pylist()], pa.list_(pa.string())), "v": pa.array([x.tobytes()], pa.binary())})

    return gather


def _best(q: np.ndarray, parts: list[np.ndarray], k: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places in all parts together of the k best vectors for each query, or all if they are fewer; ties go to the earlier vector of its part, and between parts are told by the caller."""
    scores, where, before = [], [], 0
    for c in parts:
        m = min(k, len(c))
        s = q @ c.T
        np.round(s, places, out=s)
        s += 0.0  # no negative zeros
        edge = np.partition(s, s.shape[1] - m, axis=1)[:, -m, None]
        equal, left = s == edge, m - (s > edge).sum(axis=1, keepdims=True)
        # Above the edge all; on it, the first ones: m a query.
        row, col = np.nonzero((s > edge) | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= left)))
        scores.append(s[row, col].reshape(len(q), m))
        where.append(before + col.reshape(len(q), m))
        before += len(c)
    return np.concatenate(scores, axis=1), np.concatenate(where, axis=1)


def _searcher(k: int, places: int):
    """Over rows with vectors (c_ids, c_v), queries (q_ids, q_v) or both; a cell's vectors come before its queries. Rows without a cell are one each."""

    def named(batch: pa.RecordBatch, side: str, i: int) -> tuple[np.ndarray, np.ndarray] | None:
        ids = batch[f"{side}_ids"][i].as_py()
        return ids and (np.array(ids, dtype=object), np.frombuffer(batch[f"{side}_v"][i].as_buffer(), dtype=np.float64).reshape(len(ids), -1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what the worker's task before has freed
        cell, held = None, []
        ids, parts, rank = np.zeros(0, dtype=object), [], np.zeros(0, dtype=np.int64)
        for batch in batches:
            cells = batch["cell"].to_pylist() if "cell" in batch.schema.names else range(batch.num_rows)
            for i, here in enumerate(cells):
                if here != cell:
                    cell, held, parts = here, [], []
                if vectors := named(batch, "c", i):
                    order = np.argsort(vectors[0])  # so that equal scores come out by id
                    held.append((vectors[0][order], vectors[1][order]))
                    parts = []
                queries = named(batch, "q", i)
                if not queries or not held:
                    continue
                if not parts:
                    ids, parts = np.concatenate([n for n, _ in held]), [v for _, v in held]
                    rank = np.empty(len(ids), dtype=np.int64)
                    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
                for a in range(0, len(queries[0]), AT_ONCE):
                    names, x = (y[a : a + AT_ONCE] for y in queries)
                    score, place = _best(x, parts, k, places)
                    if len(parts) > 1:
                        by = np.lexsort((rank[place], -score), axis=1)[:, :k]
                        score, place = np.take_along_axis(score, by, axis=1), np.take_along_axis(place, by, axis=1)
                    own = np.repeat(names, score.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(ids[place.ravel()], pa.string()), pa.array(score.ravel())], ["qid", "id", "score"])

    return search


def _alike(rows: DataFrame, n: int, most: int | None = None) -> DataFrame:
    """v and ids: rows (id, v) with one vector are one row, by TOGETHER of them at most, about. most: so many of the smallest ids are kept of each."""
    ids = F.array_sort(F.collect_list("id"))
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // TOGETHER))))
    return rows.groupBy("v", part.alias("_part")).agg((ids if most is None else F.slice(ids, 1, most)).alias("ids")).select("v", "ids")


def _found(q: DataFrame, c: DataFrame, n_q: int, n_c: int, m: int, raw_query: bool, places: int) -> DataFrame:
    """qid, id, score, rank: the m best of the vectors c (id, v) for the queries q (id, v)."""
    spark = c.sparkSession
    blocks, batches = max(1, -(-n_c // BLOCK)), max(1, -(-n_q // QUERIES))
    least = math.ceil(math.sqrt(2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cols = min(blocks, max(least, -(-blocks * BLOCK // CELL)))
    rows = min(batches, max(-(-least * least // cols), -(-batches * QUERIES // CELL)))
    tasks = min(2 * cols * rows, 100_000)
    form = "block long, ids array<string>, v binary"
    q = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(batches))).groupBy("block").applyInArrow(_gather(not raw_query), form)
    c = c.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block").applyInArrow(_gather(True), form)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    none = lambda side: (F.lit(None).cast("array<string>").alias(f"{side}_ids"), F.lit(None).cast("binary").alias(f"{side}_v"))
    own = lambda side: (F.col("ids").alias(f"{side}_ids"), F.col("v").alias(f"{side}_v"))
    q = q.withColumn("col", every(cols)).select((F.col("block") % rows * cols + F.col("col")).alias("cell"), F.lit(1).alias("side"), *none("c"), *own("q"))
    c = c.withColumn("row", every(rows)).select((F.col("row") * cols + F.col("block") % cols).alias("cell"), F.lit(0).alias("side"), *own("c"), *none("q"))
    cells = c.unionByName(q).repartition(tasks, "cell").sortWithinPartitions("cell", "side").drop("side")
    found = cells.mapInArrow(_searcher(m, places), "qid string, id string, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= m)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, raw_query: bool = False, drop_self: bool = False, places: int = 9) -> DataFrame:
    """The k vectors of highest cosine for each query: qid, id, score (to places), rank. queries: (qid, v), each qid once; vectors: (id, v), arrays of one
    length; null vectors, and those that hold a null, take no part. Ties go to the smaller id. raw_query: the query isn't brought to length 1. drop_self: an id is no neighbour of the query of its name.

    Both sides are dealt into blocks, and blocks into a grid of cells: a vector goes to the cells of its column, a query to those of its row, so what is moved grows with a side of the grid and
    what a task holds doesn't grow: its cell's vectors, while blocks of queries pass in batches of BATCH_BYTES, about. A cell returns k rows a query, ties included. Where pairs are very many, equal queries are one query, and of equal vectors only those stay that can be among
    the k best, the smallest ids: names of single words are alike by the thousand under some embedders."""
    small_batches(plain_unions(vectors.sparkSession), BATCH_BYTES)
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())
    q = queries.select(F.col("qid").cast("string").alias("id"), as_doubles("v").alias("v")).where(fine)
    c = vectors.select(F.col("id").cast("string").alias("id"), as_doubles("v").alias("v")).where(fine)
    n_q, n_c, m = q.count(), c.count(), k + drop_self
    if n_q * n_c < MANY or n_q < QUERIES:
        found = _found(q, c, n_q, n_c, m, raw_query, places)
        if drop_self:
            rank = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
            found = found.where("qid <> id").withColumn("rank", rank).where(F.col("rank") <= k)
        return found
    groups = durable(_alike(q, n_q).withColumn("group", F.monotonically_increasing_id().cast("string")))
    c = durable(_alike(c, n_c, m))
    n_c = c.agg(F.sum(F.size("ids"))).first()[0] or 0
    found = _found(groups.select(F.col("group").alias("id"), "v"), c.select(F.explode("ids").alias("id"), "v"), groups.count(), n_c, m, raw_query, places)
    hits = found.groupBy(F.col("qid").alias("group")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("hits"))
    every = groups.select("group", "ids").join(hits, "group").select(F.explode("ids").alias("qid"), "hits")
    own = F.slice(F.filter("hits", lambda h: h["id"] != F.col("qid")), 1, k) if drop_self else F.col("hits")
    return every.select("qid", F.posexplode(own).alias("at", "h")).select("qid", "h.id", "h.score", (F.col("at") + 1).alias("rank"))
