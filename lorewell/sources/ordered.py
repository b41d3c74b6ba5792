"""Large files in many tasks: their order, sums over what comes before, and the elements of one JSON array.

A file is read in splits, as any text file is, cut at a separator. What a row depends on of all that stands before it (its number, whether a quote is open, how deep brackets are, how many
elements have begun) is a sum over earlier rows: summed by split first, a row a split, then within each split. No task sees more than a split, or one element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.sources.store import bucketed, durable

#: Splits whose sums are sent to all tasks; more of them are joined by a shuffle.
SENT = 100_000
_SPLIT = ["file", "start"]
_MARK = "\u0000"  # between elements; no character of JSON outside strings


def rows_in_order(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """file, start (of the split), row (ascending in it) and value: what stands between separators in a file, or in the files of a folder, by name."""
    rows = spark.read.option("lineSep", separator).text(path)
    place = F.col("_metadata")
    return rows.select(place["file_path"].alias("file"), place["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("row"), "value")


def with_sums(rows: DataFrame, **amounts: Column) -> DataFrame:
    """rows with, by each name, the sum of an amount over all rows before."""
    rows = rows.withColumns({f"_{n}": a.cast("long") for n, a in amounts.items()})
    splits = durable(rows.groupBy(*_SPLIT).agg(*(F.sum(f"_{n}").alias(n) for n in amounts)))
    earlier = Window.orderBy(*_SPLIT).rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    ahead = splits.select(*_SPLIT, *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_ahead_{n}") for n in amounts))
    within = Window.partitionBy(*_SPLIT).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({n: F.coalesce(F.sum(f"_{n}").over(within), F.lit(0)) for n in amounts})
    out = out.join(F.broadcast(ahead) if splits.count() <= SENT else ahead, _SPLIT)
    return out.withColumns({n: F.col(n) + F.col(f"_ahead_{n}") for n in amounts}).drop(*(f"_{x}{n}" for n in amounts for x in ("", "ahead_")))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0) and value."""
    return with_sums(durable(rows_in_order(spark, path)), line=F.lit(1)).select("line", "value")


def paragraphs(spark: SparkSession, path: str, blank: Column) -> DataFrame:
    """pos and passage of a text whose paragraphs are parted by rows (value) that are blank; lines keep their ends."""
    rows = with_sums(durable(rows_in_order(spark, path)), gap=blank)  # the lines of a paragraph have as many blank ones before them
    named = rows.where(~blank).groupBy("gap").agg(F.array_sort(F.collect_list(F.struct(*_SPLIT, "row", "value"))).alias("lines"))
    text = named.select(F.col("gap"), F.concat(F.array_join("lines.value", "\n"), F.lit("\n")).alias("passage"))
    # Blank lines in a row leave numbers out; ranks close the gaps, by ranges of them.
    ranged = durable(text.repartitionByRange("gap").sortWithinPartitions("gap").select(F.lit("").alias("file"), F.spark_partition_id().alias("start"), F.col("gap").alias("row"), "passage"))
    return with_sums(ranged, pos=F.lit(1)).select("pos", "passage")


def json_elements(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """pos (from 0) and json: the elements of the JSON array whose brackets are the level-th to be open (one array there), each as its own text.

    The text is cut at quotation marks. One is escaped if an odd number of backslashes stands before it; the others open and close strings in turn. Outside strings, brackets give the
    depth, and a comma at the array's depth ends an element. Rows are dealt by split once, into buckets that all sums are made in."""
    rows = bucketed(rows_in_order(spark, path, '"'), *_SPLIT, order="row")
    ends = durable(rows.groupBy("file").agg(F.max(F.struct("start", "row")).alias("end")))
    small = ends.count() <= SENT
    rows = rows.join(F.broadcast(ends) if small else ends, "file").withColumn("quoted", F.struct("start", "row") < F.col("end")).drop("end")  # a quotation mark follows
    escaped = F.length(F.regexp_extract("value", r"(\\*)$", 1)) % 2 == 1
    rows = with_sums(rows, quotes=(F.col("quoted") & ~escaped).cast("int")).withColumn("inside", F.col("quotes") % 2 == 1)
    count = lambda chars: F.length("value") - F.length(F.regexp_replace("value", chars, ""))
    change = F.when(F.col("inside"), F.lit(0)).otherwise(count(r"[\[{]") - count(r"[\]}]"))
    rows = bucketed(with_sums(rows.withColumn("change", change), depth=F.col("change")), *_SPLIT, order="row", dealt=True)

    def step(acc: Column, x: Column) -> Column:
        d = acc["d"]
        opens, closes, comma = x.isin("[", "{"), x.isin("]", "}"), x == ","
        own = F.when(closes, d - 1 >= level).when(comma, d > level).otherwise(d >= level)
        text = F.when(comma & (d == level), F.lit(_MARK)).when(own, x).otherwise(F.lit(""))
        return F.struct((d + F.when(opens, 1).when(closes, -1).otherwise(0)).cast("long").alias("d"), F.concat(acc["t"], text).alias("t"))

    read = F.aggregate(F.split("value", ""), F.struct(F.col("depth").cast("long").alias("d"), F.lit("").alias("t")), step)["t"]
    plain = ~F.col("value").rlike(r"[\[\]{},]")  # nothing that opens, closes or parts
    text = F.when(F.col("inside") | plain, F.when(F.col("depth") >= level, F.col("value")).otherwise("")).otherwise(read)
    quote = F.when(F.col("quoted") & (F.col("depth") + F.col("change") >= level), '"').otherwise("")
    rows = rows.select(*_SPLIT, "row", "inside", F.concat(text, quote).alias("text"))
    marks = F.when(F.col("inside"), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit(_MARK), F.lit(""))))
    rows = with_sums(rows, pos=marks)
    pieces = F.when(F.col("inside"), F.array("text")).otherwise(F.split("text", _MARK, -1))
    rows = rows.select(*_SPLIT, "row", "pos", F.posexplode(pieces).alias("i", "piece")).where("piece <> ''").select((F.col("pos") + F.col("i")).alias("pos"), *_SPLIT, "row", "piece")
    whole = rows.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct(*_SPLIT, "row", "piece"))).alias("p"))
    json = F.regexp_replace(F.array_join("p.piece", ""), r"^\s+|\s+$", "")
    return whole.select("pos", json.alias("json")).where("json <> ''")
