"""Exact top-k inner products with a bit-sliced index.

Components are quantised to integers. A block of rows keeps, for every dimension and binary digit, a bitmap of
the rows that have it (a slice). A query's scores are added up as bitmaps: a digit of the query moves a slice
to its column, negative digits take the slice's complement, and carry-save adders bring each column down to one bitmap. From
the most significant score slice downward, rows that are certain and rows that are
still level are told apart; what is level in the end has one score, and the smallest ids of it
fill the k places. All is integer arithmetic, so nothing has to be rescored.

Queries are blocks as well, and go to the row blocks: a row block is shuffled once, or a few times where there are too few of them to keep all
tasks busy, and what meets it is the queries, a tenth of its size. Only k rows a query and block come out, and of these k a task.

Scores are 64-bit integers. A query whose scores might exceed them, for the largest components that a block holds, is an error, never a wrong score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.shared import U64, small_batches

SCALE = 256
#: Rows of an index block and of a query block, about.
BLOCK, QUERIES = 16_384, 256
#: Tasks of the search at most.
TASKS = 100_000
#: What the sizes of scores, and of scaled components, stay below.
BOUND = 2.0**62
#: Bytes of the blocks that a worker is given at a time, about.
BATCH_BYTES = 16 << 20


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and floor(scale * component) as v; rows whose id or vector is null, or that hold null or non-finite components, are left out. Scaled components
    of BOUND or more are no 64-bit integers: an error."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
    def whole(c: Column) -> Column:
        scaled = F.lit(scale) * c.cast("double")
        return F.when(F.abs(scaled) < BOUND, F.floor(scaled).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for integer scores")).cast("long"))

    return rows.select("vec_id", F.transform(x, whole).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of integers; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lens), int(lens.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < lens[:, None]] = column.flatten().to_numpy()
    return out


class BitSlices:
    """The index of one block: ids, and for each dimension its least value and its slices, lowest digit first."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, bits: np.ndarray, slices: np.ndarray) -> None:
        self.ids, self.low, self.bits, self.slices = ids, low, bits, slices
        self.first = np.cumsum(bits) - bits
        self.both = np.concatenate((slices, ~slices))
        self.valid = np.zeros(slices.shape[1] * 64, dtype=np.uint8)
        self.valid[: len(ids)] = 1
        self.valid = np.packbits(self.valid, bitorder="little").view(U64)

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray) -> BitSlices:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        low = values.min(axis=0) if len(ids) else np.zeros(values.shape[1], dtype=np.int64)
        up = values - low
        bits = np.array([int(x).bit_length() for x in up.max(axis=0, initial=0)], dtype=np.int64)
        wide = np.zeros((int(bits.sum()), max(1, -(-len(ids) // 64)) * 64), dtype=np.uint8)
        row = 0
        for d in range(values.shape[1]):
            for b in range(bits[d]):
                wide[row, : len(ids)] = (up[:, d] >> b) & 1
                row += 1
        return cls(ids, low, bits, np.packbits(wide, axis=1, bitorder="little").view(U64))

    def scores(self, query: np.ndarray) -> tuple[int, list[np.ndarray]]:
        """A constant and the slices of what each row's inner product exceeds it by."""
        q = np.zeros(len(self.bits), dtype=np.int64)
        q[: len(query)] = query[: len(q)]
        size = np.abs(q)
        high = self.low + (1 << self.bits) - 1
        if float(size.astype(float) @ np.maximum(np.abs(self.low.astype(float)), np.abs(high.astype(float)))) * 2 >= BOUND:
            raise OverflowError("scores of these vectors may exceed 64-bit integers")
        constant = int((q * np.where(q < 0, high, self.low)).sum())
        dims, digits = np.nonzero((size[:, None] >> np.arange(max(1, int(size.max(initial=0)).bit_length()))) & 1)
        n = self.bits[dims]
        b = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        column = np.repeat(digits, n) + b
        place = np.repeat(self.first[dims] + np.where(q[dims] < 0, len(self.slices), 0), n) + b
        by = np.argsort(column, kind="stable")
        cuts = np.searchsorted(column[by], np.arange(int(column.max(initial=-1)) + 2))
        out, carried, w = [], [], 0
        while w + 1 < len(cuts) or carried:
            own = self.both[place[by[cuts[w] : cuts[w + 1]]]] if w + 1 < len(cuts) else self.both[:0]
            sums, carried = np.concatenate([own, *carried]), []
            while len(sums) > 1:
                if len(sums) == 2:
                    carried.append(sums[:1] & sums[1:])
                    sums = sums[:1] ^ sums[1:]
                    break
                t = len(sums) // 3
                x, y, z = sums[:t], sums[t : 2 * t], sums[2 * t : 3 * t]
                half = x ^ y
                carried.append((x & y) | (half & z))
                sums = np.concatenate((half ^ z, sums[3 * t :]))
            out.append(sums[0] if len(sums) else np.zeros(self.both.shape[1], dtype=U64))
            w += 1
        return constant, out

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows whose id is not own, ties to the smaller ids."""
        constant, slices = self.scores(query)
        level = self.valid.copy()
        a, b = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        for i in range(a, b):
            level[i >> 6] &= ~(U64(1) << U64(i & 63))
        sure = np.zeros_like(level)
        for s in reversed(slices):
            more = sure | (level & s)
            n = int(np.bitwise_count(more).sum())
            if n > k:
                level &= s
            else:
                sure, level = more, level & ~s
                if n == k:
                    level = np.zeros_like(level)
                    break
        rows = self._rows(sure)
        rows = np.concatenate((rows, self._rows(level)[: k - len(rows)]))
        scores = np.full(len(rows), constant, dtype=np.int64)
        for w, s in enumerate(slices):
            scores += ((s[rows >> 6] >> (rows & 63).astype(U64)) & U64(1)).astype(np.int64) << w
        return self.ids[rows], scores

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        return words[at] * 64 + bit


def _build(table: pa.Table) -> pa.Table:
    block = table["block"][0].as_py()
    index = BitSlices.build(table["vec_id"].to_numpy(), _matrix(table["v"]))
    parts = (index.ids, index.low, index.bits, index.slices)
    return pa.table({"block": pa.array([block], pa.int64())} | {k: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for k, x in zip(("ids", "low", "bits", "slices"), parts, strict=True)})


def _gather(table: pa.Table) -> pa.Table:
    values = _matrix(table["v"])
    return pa.table({"batch": table["batch"][:1], "query_ids": pa.array([table["vec_id"].to_numpy().tobytes()], pa.binary()), "keys": pa.array([table["key"].to_numpy().tobytes()], pa.binary()), "queries": pa.array([values.tobytes()], pa.binary())})


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: np.frombuffer(batch[c][i].as_buffer(), dtype=np.int64)  # noqa: B023, E731
                ids = get("ids")
                slices = np.frombuffer(batch["slices"][i].as_buffer(), dtype=U64)
                index = BitSlices(ids, get("low"), get("bits"), slices.reshape(-1, max(1, -(-len(ids) // 64))))
                names = get("query_ids")
                queries = get("queries").reshape(len(names), -1)
                found = [index.top(int(q), v, k) for q, v in zip(names, queries, strict=True)]
                n = [len(x[0]) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, n)), pa.array(np.repeat(get("keys"), n)), pa.array(np.concatenate([x[0] for x in found])), pa.array(np.concatenate([x[1] for x in found]))], ["query_id", "key", "vec_id", "score"]
                )

    return search


def _bytes(size: str) -> int:
    """A size of Spark's settings, such as 64MB, as a number."""
    found = re.fullmatch(r"(\d+)([kmgt]?)b?", size.strip().lower())
    return int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[found[2]] if found else 0


def build_index(vectors: DataFrame, rows: int) -> DataFrame:
    """One row for each block of quantised vectors: block and its parts in binary columns."""
    blocks = max(1, -(-rows // BLOCK))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(_build, "block long, ids binary, low binary, bits binary, slices binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k highest inner products of every query with the rows of vectors, both as from quantised(): query_id, rank,
    vec_id, score; all if there are fewer. Ties go to the smaller vec_id; rows that have a query's own id are no candidates for it; other rows that
    share an id each count. Queries that are equal in id and vector are answered once, those equal in id alone each for itself."""
    spark = vectors.sparkSession
    small_batches(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    queries = queries.withColumn("key", F.xxhash64("v")).distinct()
    rows, asked = vectors.count(), queries.count()
    blocks, batches = max(1, -(-rows // BLOCK)), max(1, -(-asked // QUERIES))
    # Copies of a block, each for its share of the queries: one, unless blocks are fewer than the tasks that may run.
    copies = min(batches, max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)))
    index = build_index(vectors, rows).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    dealt = queries.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.lit(batches)))
    dealt = dealt.groupBy("batch").applyInArrow(_gather, "batch long, query_ids binary, keys binary, queries binary")
    # Each query block names every row block: an equi-join, both sides dealt by block and copy.
    asked_of = dealt.withColumn("copy", (F.col("batch") % copies).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    tasks = min(2 * blocks * copies, TASKS)
    pairs = asked_of.repartition(tasks, "block", "copy").join(index.repartition(tasks, "block", "copy").hint("shuffle_hash"), ["block", "copy"])
    found = pairs.mapInArrow(_searcher(k), "query_id long, key long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
