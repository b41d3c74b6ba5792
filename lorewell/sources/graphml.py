"""GraphML, plain or compressed, for exchange with other tools. Parquet is the engine's own form."""

from __future__ import annotations

import gzip
import os
import zlib
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.sources.readers import resolve

# Fixed value: the format's namespace.
NAMESPACE = "http://graphml.graphdrawing.org/xmlns"

_DATA = "array<struct<_key: string, _VALUE: string>>"


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def _unpacked(spark: SparkSession, path: str) -> str:
    """The path of a plain copy in the shared folder: the suffix of compressed files is none that Spark knows."""
    from lorewell.sources.store import shared_folder

    whole = spark.read.format("binaryFile").load(path).select(F.udf(lambda b: gzip.decompress(bytes(b)).decode("utf-8"))("content").alias("value"))
    out = f"{shared_folder(spark)}/lorewell/{os.urandom(8).hex()}"
    whole.write.text(out)
    return out


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, attrs) and edges (src, dst, weight, attrs); attrs maps a name to struct(int, float, str), one of which is set. FileNotFoundError, ValueError: no such file, or another suffix."""
    full = resolve(spark, path)
    if not full.endswith((".graphml", ".graphmlz")):
        raise ValueError("a .graphml or .graphmlz file is asked for")
    if full.endswith("z"):
        full = _unpacked(spark, full)
    keys = _rows(spark, full, "key", "_id string, `_attr.name` string, `_attr.type` string").select(F.col("_id").alias("k"), F.col("`_attr.name`").alias("name"), F.col("`_attr.type`").alias("kind"))

    def decoded(rows: DataFrame, *by: str) -> DataFrame:
        flat = rows.select(*by, F.explode_outer("data").alias("d")).join(F.broadcast(keys), F.col("d._key") == F.col("k"), "left")
        value, kind = F.col("d._VALUE"), F.col("kind")
        cell = F.struct(
            F.when(kind == "int", value.cast("bigint")).alias("int"), F.when(kind == "float", value.cast("double")).alias("float"), F.when(~kind.isin("int", "float"), value).alias("str")
        )
        entry = F.when(F.col("name").isNotNull(), F.struct("name", cell.alias("value")))
        return flat.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("attrs"))

    nodes = decoded(_rows(spark, full, "node", f"_id string, data {_DATA}").withColumnRenamed("_id", "id"), "id")
    edges = decoded(_rows(spark, full, "edge", f"_source string, _target string, data {_DATA}").withColumnsRenamed({"_source": "src", "_target": "dst"}), "src", "dst")
    own = F.col("attrs")["weight"]
    return nodes, edges.select("src", "dst", F.coalesce(own["float"], own["int"].cast("double"), F.lit(0.0)).alias("weight"), "attrs")


class _Output:
    """A text file on any file system that Spark writes, gzipped or plain; a megabyte or so is held."""

    def __init__(self, spark: SparkSession, path: str, compressed: bool) -> None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
        self.zip = zlib.compressobj(6, zlib.DEFLATED, 31) if compressed else None
        self.held: list[str] = []
        self.size = 0

    def write(self, text: str) -> None:
        self.held.append(text)
        self.size += len(text)
        if self.size > 1 << 20:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        data = "".join(self.held).encode()
        self.held, self.size = [], 0
        if self.zip is not None:
            data = self.zip.compress(data) + (self.zip.flush() if last else b"")
        if data:
            self.out.write(bytearray(data))

    def __enter__(self) -> _Output:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self._flush(last=True)
        self.out.close()


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, compressed: bool = False) -> None:
    """Streams both frames (as from read_graphml) through the driver into one file, row by row, on any file system that Spark writes. The suffix must fit."""
    if not path.endswith(".graphmlz" if compressed else ".graphml"):
        raise ValueError("the suffix is .graphmlz for compressed files and .graphml for others")
    kinds = {}
    for frame, where in ((nodes, "node"), (edges, "edge")):
        entry = F.explode(F.map_entries("attrs")).alias("e")
        kind = F.when(F.col("e.value.int").isNotNull(), "int").when(F.col("e.value.float").isNotNull(), "float").otherwise("str")
        for row in frame.select(entry).select(F.col("e.key").alias("name"), kind.alias("kind")).groupBy("name").agg(F.min("kind").alias("kind")).orderBy("name").collect():
            kinds.setdefault(row["name"], (f"d{len(kinds)}", where, row["kind"]))

    def data(attrs: dict | None) -> str:
        out = []
        for name, v in (attrs or {}).items():
            value = next((v[k] for k in ("int", "float", "str") if v[k] is not None), None)
            out.append(f'<data key="{kinds[name][0]}">{"" if value is None else escape(str(value))}</data>')
        return "".join(out)

    with _Output(nodes.sparkSession, path, compressed) as f:
        f.write(f'<?xml version="1.0" ?>\n<graphml xmlns="{NAMESPACE}">\n')
        for name, (k, where, kind) in kinds.items():
            f.write(f'\t<key id="{k}" for="{where}" attr.name={quoteattr(name)} attr.type="{kind}"/>\n')
        f.write('\t<graph edgedefault="directed">\n')
        for row in nodes.toLocalIterator():
            f.write(f"\t\t<node id={quoteattr(row['id'])}>{data(row['attrs'])}</node>\n")
        for row in edges.toLocalIterator():
            f.write(f"\t\t<edge source={quoteattr(row['src'])} target={quoteattr(row['dst'])}>{data(row['attrs'])}</edge>\n")
        f.write("\t</graph>\n</graphml>\n")
