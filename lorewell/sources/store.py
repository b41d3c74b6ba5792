"""Durable intermediates, and the engine's tables as versions of a folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

from lorewell import schemas


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where the session names none: a folder of its own, in the warehouse, or a temporary one where all runs on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        local = re.match(r"local(\[|$)", spark.sparkContext.master)  # executors of local-cluster have folders of their own
        top = tempfile.mkdtemp(prefix="lorewell-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lorewell"
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def plain_unions(spark: SparkSession) -> SparkSession:
    """Unions in this session don't keep their inputs' partitioning: where adaptive execution regroups the partitions of one input alone, such a union of Spark 4.1 fails
    (Can't zip RDDs with unequal numbers of partitions)."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def small_batches(spark: SparkSession, most: int) -> None:
    """From now on, Arrow batches of this session end at most bytes, about (or where it has them end before): a worker holds a batch or two, and a batch else goes on to 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(name).strip().lower())
    if size is None or not 0 < int(size[1]) << 10 * " kmgt".index(size[2] or " ") <= most:
        spark.conf.set(name, str(most))


_written: list[tuple[SparkSession, str, str | None]] = []


def forget(spark: SparkSession, path: str, name: str | None = None) -> None:
    """Deletes what durable() or bucketed() has written."""
    if name is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def release(df: DataFrame) -> None:
    """Deletes what durable() or bucketed() has written and df reads, before the process ends: nothing that is still to run may read it."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for written in [w for w in _written if w[1].rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]]:
            _written.remove(written)
            forget(*written)


def forget_later(spark: SparkSession, path: str) -> None:
    """Deletes a path when the process ends."""
    _written.append((spark, path, None))


@atexit.register
def _forget_all() -> None:
    for written in _written:
        try:
            forget(*written)
        except Exception:  # noqa: BLE001  the session may have ended first
            return


def few_rows(writer: DataFrameWriter) -> DataFrameWriter:
    """For rows of megabytes: Parquet looks at each of them, where it else holds 100 before it ends a page or a group, and a reader gets groups of 16 MB at most, about."""
    for name, value in (("parquet.block.size", 16 << 20), ("parquet.block.size.row.check.min", 1), ("parquet.page.size.row.check.min", 1), ("parquet.enable.dictionary", "false")):
        writer = writer.option(name, str(value))
    return writer


def durable(df: DataFrame, form: Callable[[DataFrameWriter], DataFrameWriter] = lambda writer: writer) -> DataFrame:
    """df after a round trip through Parquet in the shared folder: its lineage ends there, and a lost executor loses nothing. The files go with the process. form: options of the writer."""
    path = f"{shared_folder(plain_unions(df.sparkSession))}/lorewell/{uuid.uuid4().hex}"
    form(df.write).parquet(path)
    _written.append((df.sparkSession, path, None))
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task, about, where more come to it than a shuffle has partitions for.
ROWS = 500_000


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df dealt by columns to more partitions than a shuffle has, if so many rows are more than ROWS for each of those: what a task holds doesn't grow with them."""
    parts = -(-rows // ROWS)
    return df if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(parts, *by)


def bucketed(df: DataFrame, *by: str, path: str | None = None, parts: int | None = None, order: str | None = None, dealt: bool = False, form: Callable[[DataFrameWriter], DataFrameWriter] = lambda writer: writer) -> DataFrame:
    """durable(df), dealt by columns into as many buckets as a shuffle has partitions, or parts: joins on those columns don't shuffle it again. With a path, the files stay there when the
    process ends, see reopened(). order: a column that buckets are sorted by. dealt: df is dealt so already. form: as for durable()."""
    spark = plain_unions(df.sparkSession)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"lorewell_{uuid.uuid4().hex}"
    place = path or f"{shared_folder(spark)}/lorewell/{name}"
    writer = form((df if dealt else df.repartition(parts, *by)).write).bucketBy(parts, *by)
    (writer.sortBy(order) if order else writer).option("path", place).format("parquet").saveAsTable(name)
    if path is None:
        _written.append((spark, place, name))
    return spark.table(name)


def reopened(spark: SparkSession, path: str, schema: str, buckets: int, *by: str) -> DataFrame:
    """What bucketed() has left at a path, with its buckets."""
    name = f"lorewell_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({', '.join(by)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with the numbers 0, 1, 2 ... in a column, in no order: counted by partition, so nothing is sorted and no task sees all rows."""
    bits = 33  # of the rows of a partition, as monotonically_increasing_id has it
    rows = durable(df.withColumn("_row", F.monotonically_increasing_id()))
    per = rows.groupBy(F.shiftright("_row", bits).alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select("_part", before.alias("_before"))  # a row for each partition
    place = rows.join(offsets, F.shiftright("_row", bits) == F.col("_part")).withColumn(name, F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << bits) - 1)))
    return place.drop("_row", "_part", "_before")


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class TableStore:
    """Named tables that change together, by what each import adds. A commit writes a new version folder with its rows alone and then, last, a marker in it; readers put
    together the versions that have their marker, so a crash leaves the state before. After COMPACT_AFTER commits all is written as one version, a base; versions before
    the base before it are deleted, so that readers that have begun can finish."""

    TABLES = {"vectors": schemas.VECTORS, "nodes": schemas.NODES, "edges": schemas.EDGES, "counts": schemas.COUNTS, "stored": schemas.STORED}
    COMPACT_AFTER = 16

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = plain_unions(spark), root.rstrip("/")

    def _exists(self, *parts: str) -> bool:
        fs, p = _file_system(self.spark, "/".join((self.root, *parts)))
        return fs.exists(p)

    def _folders(self) -> list[str]:
        fs, root = _file_system(self.spark, self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")) if fs.exists(root) else []

    def versions(self) -> list[str]:
        """The committed versions that make up the tables: the newest base, if there is one, and all after it."""
        out = []
        for name in reversed(self._folders()):
            if self._exists(name, "_COMMITTED"):
                out.append(name)
                if self._exists(name, "_BASE"):
                    break
        return out[::-1]

    def exists(self) -> bool:
        return bool(self.versions())

    def has(self, *parts: str) -> bool:
        """Whether there is a file or folder of that name in the store."""
        return self._exists(*(p for p in parts if p))

    def same_as(self, version: str) -> list[str]:
        """The version and, for a base, the one that it was written from."""
        fs, folder = _file_system(self.spark, f"{self.root}/{version}")
        return [version, *(n.removeprefix("_OF_") for s in fs.listStatus(folder) if (n := s.getPath().getName()).startswith("_OF_"))]

    def read(self, table: str, versions: list[str] | None = None) -> DataFrame:
        """The table as of the last commit, or what some versions add; empty if there is none yet. Weights and counts of one key add up over versions."""
        paths = [f"{self.root}/{v}/{table}" for v in (self.versions() if versions is None else versions) if self._exists(v, table)]
        if not paths:
            return self.spark.createDataFrame([], self.TABLES[table])
        rows = None
        for path in paths:
            own = self.spark.read.schema(self.TABLES[table]).parquet(path)
            rows = own if rows is None else rows.unionByName(own)
        if len(paths) == 1:
            return rows
        if table == "edges":
            return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.min("create_time").alias("create_time"), F.max("update_time").alias("update_time"))
        if table == "counts":
            return rows.groupBy("hash_key").agg(F.sum("appear_cnt").alias("appear_cnt"))
        return rows.distinct() if table == "stored" else rows

    def read_keys(self, table: str, *keys: str) -> DataFrame:
        """key: 128 bits for each distinct key of a table in which versions have a key once each: 16 bytes are shuffled a row, and none for a single version."""
        versions = [v for v in self.versions() if self._exists(v, table)]
        short = lambda df: df.select(F.unhex(F.md5(F.concat_ws("|", *keys))).alias("key"))
        rows = short(self.read(table, versions[:1]))
        for version in versions[1:]:
            rows = rows.unionByName(short(self.read(table, [version])))
        return rows.distinct() if len(versions) > 1 else rows

    def _write(self, tables: dict[str, DataFrame], *marks: str) -> str:
        name = f"v={time.time_ns():020d}"
        for table, df in tables.items():
            writer = df.select(*(f.split()[0] for f in self.TABLES[table].split(", "))).write.option("compression", "zstd")  # keys are digits
            (writer.partitionBy("namespace") if table == "vectors" else writer).parquet(f"{self.root}/{name}/{table}")
        for mark in (*marks, "_COMMITTED"):
            fs, p = _file_system(self.spark, f"{self.root}/{name}/{mark}")
            fs.create(p, True).close()
        return name

    def commit(self, tables: dict[str, DataFrame], epoch: tuple[str, int] | None = None) -> str:
        """Adds rows to tables, each key of edges and counts once. epoch: the stream and the number of its batch that this commit is, which the commit itself remembers."""
        name = self._write(tables, *([f"_EPOCH_{epoch[0]}_{epoch[1]}"] if epoch else []))
        if len(self.versions()) > self.COMPACT_AFTER:
            return self.compact()
        return name

    def epochs(self) -> dict[str, int]:
        """The number of the last committed batch of every stream. Batches of a stream come one after the other, so all before it are in, too."""
        out: dict[str, int] = {}
        for version in self.versions():
            fs, folder = _file_system(self.spark, f"{self.root}/{version}")
            for name in (s.getPath().getName() for s in fs.listStatus(folder)):
                if name.startswith("_EPOCH_"):
                    stream, number = name.removeprefix("_EPOCH_").rsplit("_", 1)
                    out[stream] = max(out.get(stream, -1), int(number))
        return out

    def compact(self) -> str:
        """Writes all tables as a base and deletes what no reader can need any more. A mark in it names the version it is the same as."""
        before = self.versions()
        name = self._write({table: self.read(table) for table in self.TABLES}, "_BASE", *(f"_OF_{v}" for v in before[-1:]), *(f"_EPOCH_{stream}_{n}" for stream, n in self.epochs().items()))
        fs, _ = _file_system(self.spark, self.root)
        for old in self._folders():
            if before and old < before[0]:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{old}"), True)
        return name
