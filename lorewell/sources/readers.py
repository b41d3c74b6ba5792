"""Sources of passages, documents, rows and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorewell import schemas
from lorewell.functions.text import content_hash
from lorewell.sources.ordered import json_elements, lines, paragraphs
from lorewell.sources.store import durable


def resolve(spark: SparkSession, path: str, base: str | None = None) -> str:
    """path, below base if it is relative; FileNotFoundError if nothing is there. Any file system that Spark reads will do."""
    full = path if base is None or path.startswith("/") or "://" in path else f"{base.rstrip('/')}/{path}"
    p = spark._jvm.org.apache.hadoop.fs.Path(full)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(full)
    return full


def read_raw_corpus(spark: SparkSession, path: str) -> DataFrame:
    """pg_hash, passage, pos of the JSON array in a file, or in the files of a folder by name: strings alone, the first of equal ones. A file is read by as many tasks as it has splits."""
    items = json_elements(spark, resolve(spark, path)).where(F.col("json").startswith('"'))
    items = items.select("pos", F.from_json(F.concat(F.lit("["), "json", F.lit("]")), "array<string>")[0].alias("passage"))
    return items.groupBy(content_hash("passage").alias("pg_hash")).agg(F.min_by("passage", "pos").alias("passage"), F.min("pos").alias("pos"))


def _blank(line: Column) -> Column:
    return line.rlike(r"(?U)\A[\s\x1c-\x1f]*\z")


def split_paragraphs(text: Column) -> Column:
    """The paragraphs of a text: blank lines part them, every other line keeps its line end."""
    lines = F.split(text, "\n", -1)
    # One line more, a blank one, ends the last paragraph; a paragraph is what stands between two blank lines.
    cuts = F.filter(F.transform(F.array_append(lines, F.lit("")), lambda x, i: F.when(_blank(x), i + 1)), lambda i: i.isNotNull())

    def joined(s: Column) -> Column:
        between = lambda end, k: F.slice(s["lines"], F.when(k == 0, 1).otherwise(F.get(s["cuts"], k - 1) + 1), end - 1 - F.when(k == 0, 0).otherwise(F.get(s["cuts"], k - 1)))
        return F.transform(s["cuts"], lambda end, k: F.array_join(F.transform(between(end, k), lambda x: F.concat(x, F.lit("\n"))), ""))

    # The names s.lines and s.cuts are bound once, in an array of one.
    return F.filter(F.flatten(F.transform(F.array(F.struct(lines.alias("lines"), cuts.alias("cuts"))), joined)), lambda p: p != "")


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """pos, passage of a text file, or of the files of a folder by name, line ends as they are."""
    return paragraphs(spark, resolve(spark, path), _blank(F.col("value")))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None, base: str | None = None) -> DataFrame:
    """Rows of a JSON Lines file: with a schema its columns; without one, value (variant), as rows may differ in shape."""
    full = resolve(spark, path, base)
    if schema is not None:
        return spark.read.schema(schema).json(full)
    return spark.read.text(full).where(F.trim("value") != "").select(F.parse_json("value").alias("value"))


def read_openie(spark: SparkSession, path: str) -> DataFrame:
    """idx, passage, extracted_entities, extracted_triples, pos of an extraction result, unfiltered: the objects of the array in the object in a file, or in the files of a folder by name."""
    docs = json_elements(spark, resolve(spark, path), 2)
    return docs.select(F.from_json("json", schemas.DOCUMENT).alias("doc"), "pos").select("doc.*", "pos")


def read_edge_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """edges (src, dst, weight) and personalization (node, weight) of a text: a line of both counts, then their lines. Line kinds differ in their number of fields; the counts must hold."""
    parts = durable(lines(spark, resolve(spark, path)).select("line", F.split(F.trim("value"), " +").alias("p")))
    count = parts.where("line = 0").select(F.col("p")[0].cast("long").alias("edges"), F.col("p")[1].cast("long").alias("nodes"))
    parts = parts.where("line > 0").crossJoin(F.broadcast(count))  # one row
    edges = parts.where("line <= edges").select(F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"), F.col("p")[2].cast("double").alias("weight"))
    nodes = parts.where("line > edges and line <= edges + nodes").select(F.col("p")[0].alias("node"), F.col("p")[1].cast("double").alias("weight"))
    return edges, nodes


def _cache_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{schemas.DOCUMENT}, error string, _corrupt_record string").option("mode", "PERMISSIVE").json(resolve(spark, path))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Extraction results that are cached as JSON, one a row, one for each idx; rows that don't parse, have no passage or tell of a failure are left out and so done again."""
    rows = _cache_rows(spark, path).where("_corrupt_record is null and passage is not null and error is null")
    return rows.drop("_corrupt_record", "error").dropDuplicates(["idx"])


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """idx and error of passages in the cache that have a failure and no result."""
    failed = _cache_rows(spark, path).where("_corrupt_record is null and error is not null").groupBy("idx").agg(F.max("error").alias("error"))
    return failed.join(read_cache(spark, path).select("idx"), "idx", "left_anti")
