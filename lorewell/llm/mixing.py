"""Mixing sources to target weights by entropy balancing, on DataFrame functions alone.

Of all document rates between 0 and CAP that give every source its target of tokens, the ones nearest to 1 in relative entropy
are exponentially tilted by size: min(CAP, exp(tilt * size)). The tilts are the dual's variables, one for each source;
distributed Newton iterations, kept inside a bracket, solve for them over the counts of (source, size), which
stand for all documents exactly. Rates become copies in three steps: the copies of a source's size classes, largest size first, are rounded by
their running sum; what the words then lack or exceed is made up by copies of single classes, the largest that fit;
and the classes' copies are dealt to their documents by hash, in sub-blocks so that no class has to meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.shared import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a sub-block within a size class, about, if the class is large.
SUB_BLOCK = 4096
#: Steps of the solver at most; it is an error if they don't do.
ITERATIONS = 300
TOLERANCE = 1e-9
#: Bounds of a tilt before any step has told one.
EDGE = 1e6
#: Running sums of copies are whole numbers of this part of a copy.
PART = 1 << 20


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (number of words; 0 of a null text)."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with turn: their place by code point, null last. Ranges are sorted apart and then counted."""
    spark = sources.sparkSession
    order = F.col("source").asc_nulls_last()
    rows = sources.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order)
    rows = materialize(rows.withColumn("at", F.monotonically_increasing_id()))
    # The number's high bits are the range's, its low ones the place there.
    per = rows.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    rows = rows.join(per.select("range", before.alias("before")), F.shiftright("at", 33) == F.col("range"))
    return rows.withColumn("turn", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "range", "before")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, docs, source_size and target, a row for each source (null is one). Sources by code point, null last, weigh
    weights in turn and share share * all sizes; none gets more than cap * its size, the excess going to the rest by weight.

    That is a water level: sources whose cap / weight lies below it get their cap, the others level * weight. It rises from where no source is
    capped, by one sum over the sources a step."""
    per = _ranked(sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("turn") % len(weights) + 1).cast("int"))
    per = materialize(per.withColumn("weight", weight).withColumn("most", (F.col("source_size") * cap).cast("double")).drop("turn"))
    total = share * float(per.agg(F.sum("source_size")).first()[0] or 0)
    level, held = 0.0, -1
    while True:
        capped = F.col("most") <= F.lit(level) * F.col("weight")
        full, free, count = per.agg(F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped)).first()
        if free is None:
            level = float("inf")
        elif count > held:
            level, held = (total - (full or 0.0)) / free, count
            continue
        break
    return per.select("source", "docs", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def _rate(tilt: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(tilt * F.col("size") / F.col("mean"), F.lit(50.0))))


def solve_tilts(classes: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """source, mean and tilt (on sizes divided by mean). classes: source, size, n. A step that doesn't halve what a source is off by is followed by one that halves its bracket."""
    state = sources.where("source_size > 0").select(
        "source", "target", "source_size", (F.col("source_size") / F.col("docs")).alias("mean"),
        F.lit(0.0).alias("tilt"), F.lit(-EDGE).alias("lo"), F.lit(EDGE).alias("hi"), F.lit(float("inf")).alias("was"), (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)).alias("done"),
    )
    state = materialize(state.withColumn("tilt", F.when(F.col("done"), F.lit(EDGE)).otherwise(F.lit(0.0))))
    for _ in range(ITERATIONS):
        if state.where("not done").isEmpty():
            return state.select("source", "mean", "tilt")
        open_ = state.where("not done")
        held = classes.alias("c").join(open_.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("s.*", "size", "n")
        rate, x = _rate(F.col("tilt"), cap), F.col("size") / F.col("mean")
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < cap, words * x).otherwise(0.0)
        keys = [F.first(c).alias(c) for c in ("target", "source_size", "mean", "tilt", "lo", "hi", "was")]
        step = held.groupBy("source").agg(*keys, (F.sum(words) - F.first("target")).alias("over"), F.sum(slope).alias("slope"))
        step = step.withColumn("lo", F.when(F.col("over") < 0, F.col("tilt")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("over") >= 0, F.col("tilt")).otherwise(F.col("hi")))
        newton = F.col("tilt") - F.try_divide("over", "slope")
        done = (F.abs("over") <= TOLERANCE * F.col("source_size")) | (F.col("hi") - F.col("lo") <= F.abs("tilt") * 1e-15)
        good = (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs("over") <= F.col("was") / 2)
        # A side that no step has bounded yet is searched by doubling.
        stride, low, high = F.abs("tilt") + 1, F.col("lo") <= -EDGE, F.col("hi") >= EDGE
        middle = F.when((F.col("over") >= 0) & low, F.col("tilt") - stride).when((F.col("over") < 0) & high, F.col("tilt") + stride).otherwise((F.col("lo") + F.col("hi")) / 2)
        step = step.withColumn("done", done).withColumn("tilt", F.when(F.col("done"), F.col("tilt")).when(good, newton).otherwise(middle)).withColumn("was", F.abs("over"))
        state = materialize(state.where("done").unionByName(step.select(*state.columns)))
    raise RuntimeError(f"the tilts of some sources have not been found in {ITERATIONS} steps")


def _rounded(rated: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """source, size, n, given: whole copies of each class of rated (source, size, n, rate). Running sums go over ranges of sizes, so that no source's sizes meet in one task."""
    # Whole numbers, so that sums are the same in any order.
    rows = rated.withColumn("want", F.least(F.floor(F.col("n") * F.col("rate") * PART + 0.5), F.col("n") * cap * PART)).withColumn("range", F.floor(F.log2("size") * 32))
    per = rows.groupBy("source", "range").agg(F.sum("want").alias("wants"))
    above = Window.partitionBy("source").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("source", "range", F.coalesce(F.sum("wants").over(above), F.lit(0)).alias("before"))
    rows = rows.alias("r").join(per.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.range") == F.col("p.range"))).select("r.*", "before")
    upto = F.col("before") + F.sum("want").over(Window.partitionBy("source", "range").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
    whole = lambda x: F.expr("(`{0}` + {1}) div {2}".format(x, PART // 2, PART))
    rows = rows.withColumn("upto", upto).withColumn("last", F.col("upto") - F.col("want"))
    rows = materialize(rows.select("source", "size", "n", (whole("upto") - whole("last")).alias("given")))
    # What the words are off by: in every round copies of the largest class that fits in it, so that less than half is left, and in the end one copy for another.
    changed = lambda best: materialize(
        rows.alias("r").join(best.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.size") == F.col("b.size")), "left")
        .select("r.source", "r.size", "n", (F.col("given") + F.coalesce("more", F.lit(0))).alias("given"))
    )
    while True:
        off = rows.groupBy("source").agg(F.sum(F.col("given") * F.col("size")).alias("taken"))
        off = off.alias("o").join(sources.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select("o.source", (F.col("target") - F.col("taken")).cast("long").alias("off"))  # towards 0, so that it can but shrink
        open_ = rows.alias("r").join(off.where("off <> 0").alias("o"), F.col("r.source").eqNullSafe(F.col("o.source"))).select("r.*", "off")
        slack = F.when(F.col("off") > 0, F.col("n") * cap - F.col("given")).otherwise(F.col("given"))
        best = open_.where("size <= abs(off)").withColumn("slack", slack).where("slack > 0").groupBy("source").agg(F.max(F.struct("size", "slack", "off")).alias("b"))
        best = materialize(best.select("source", F.col("b.size").alias("size"), (F.least("b.slack", F.expr("abs(b.off) div b.size")) * F.signum("b.off")).cast("long").alias("more")))
        if best.isEmpty():
            break
        rows = changed(best)
    up, down = open_.where(F.col("given") < F.col("n") * cap), open_.where("given > 0")
    pairs = up.alias("u").join(down.alias("d"), F.col("u.source").eqNullSafe(F.col("d.source")) & (F.col("u.size") == F.col("d.size") + F.col("d.off")))
    best = pairs.groupBy("u.source").agg(F.max(F.struct(F.col("u.size").alias("up"), F.col("d.size").alias("down"))).alias("b"))
    best = best.select("source", F.explode(F.array(F.struct(F.col("b.up").alias("size"), F.lit(1).alias("more")), F.struct(F.col("b.down").alias("size"), F.lit(-1).alias("more")))).alias("c"))
    return changed(materialize(best.select("source", "c.size", "c.more")))


def _copied(docs: DataFrame, weights: tuple, share: float, cap: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, text, copies) for every row of docs, text being its hash, and the sources with their targets."""
    hashed = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text"), F.spark_partition_id().alias("part"))
    sized = materialize(hashed)
    sources = materialize(targets(sized, weights, share, cap))
    classes = materialize(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    tilts = solve_tilts(classes, sources, cap)
    rated = classes.alias("c").join(tilts.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "size", "n", F.round(_rate(F.col("tilt"), cap), 12).alias("rate"))
    given = _rounded(rated, sources, cap)
    blocks = -(-max(1, sized.count()) // SUB_BLOCK)
    dealt = sized.withColumn("hash", F.xxhash64("doc_id", "size", "text")).withColumn("sub", F.pmod("hash", F.lit(blocks)))
    same = lambda a, b, *more: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & F.expr(" and ".join(f"{a}.{c} = {b}.{c}" for c in more))
    # A sub-block of very many rows holds rows that repeat (all hash alike); they are dealt by the partitions that they were read in.
    hot = dealt.where("size > 0").groupBy("source", "size", "sub").agg(F.count("*").alias("m")).where(F.col("m") > 8 * SUB_BLOCK)
    dealt = dealt.alias("d").join(hot.alias("h"), same("d", "h", "size", "sub"), "left").select("d.*", F.when(F.col("m").isNotNull(), F.col("part")).otherwise(-1).alias("cut"))
    parts = dealt.where("size > 0").groupBy("source", "size", "sub", "cut").agg(F.count("*").alias("m"))
    parts = parts.alias("p").join(given.alias("g"), same("p", "g", "size")).select("p.*", "n", "given")
    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("sub", "cut").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("upto", upto)
    more = F.col("given") % F.col("n")
    quota = lambda at: F.floor(at.cast("decimal(38,0)") * more / F.col("n"))
    parts = parts.select("source", "size", "sub", "cut", F.floor(F.col("given") / F.col("n")).cast("long").alias("base"), (quota(F.col("upto")) - quota(F.col("upto") - F.col("m"))).cast("long").alias("extra"))
    place = F.row_number().over(Window.partitionBy("source", "size", "sub", "cut").orderBy("hash", "doc_id"))
    ranked = dealt.withColumn("place", place)
    joined = ranked.alias("d").join(parts.alias("p"), same("d", "p", "size", "sub", "cut"), "left").select("d.doc_id", "d.source", "d.size", "d.text", "d.place", "base", "extra")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("base") + (F.col("place") <= F.col("extra")).cast("long"))
    return joined.select("doc_id", "source", "size", "text", F.coalesce(copies, F.lit(0)).cast("long").alias("copies")), sources


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies (0 to cap) and taken (copies * size), a row for each row of docs.

    A null text has size 0; documents of size 0 are taken once, which costs no words. The words taken of a source differ from its
    target by less than its smallest document that can be taken once more or less, and by less than a word where one document can give way to another. Equal input gives equal output; rows that are equal in id, source and
    text may differ in copies, by one. Null ids are ids like any other; docs may be empty."""
    copied, sources = _copied(docs, weights, share, cap)
    out = copied.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return out.select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target", "d.copies", (F.col("d.copies") * F.col("d.size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mix itself: the rows of docs, with all their columns, each as often as mix() takes it. Of rows that are equal in id, source and
    text, as many are taken once more as mix() says. docs may be empty."""
    copied, _ = _copied(docs, weights, share, cap)
    key = ["doc_id", "source", "size", "text"]
    taken = copied.groupBy(*key).agg(F.count("*").alias("m"), F.min("copies").alias("low"), F.sum("copies").alias("all"))
    taken = materialize(taken.where("all > 0").select(*key, "m", "low", (F.col("all") - F.col("m") * F.col("low")).alias("extra")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # The row travels in a struct, so no column of docs can clash with the others.
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text"), F.spark_partition_id().alias("part"))
    same = lambda a, b: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in key))
    some = materialize(taken.where("extra > 0 and extra < m"))  # of these, not all rows are taken alike
    if some.isEmpty():
        before, place = F.lit(0), F.lit(1)
        joined = rows.alias("r").join(taken.alias("t").hint("merge"), same("r", "t")).select("row", "low", "extra")
    else:
        # The rows of such a key are counted by partition, so that they need not meet.
        per = rows.alias("r").join(some.alias("s"), same("r", "s")).groupBy(*(f"r.{c}" for c in key), "part").agg(F.count("*").alias("rows"))
        before = F.coalesce(F.sum("rows").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        per = materialize(per.select(*key, "part", before.alias("before")))
        joined = rows.alias("r").join(taken.alias("t").hint("merge"), same("r", "t")).select("r.*", "low", "extra", "m")
        whole = joined.where("extra = 0 or extra = m").select("row", "low", (F.col("extra") > 0).cast("long").alias("extra"), F.lit(0).cast("long").alias("before"), F.lit(1).alias("place"))
        place = F.row_number().over(Window.partitionBy(*(f"j.{c}" for c in key), "j.part").orderBy(F.lit(1)))
        cut = joined.where("extra > 0 and extra < m").alias("j").join(per.alias("p"), same("j", "p") & F.expr("j.part = p.part"))
        cut = cut.select("row", "low", "extra", "before", place.alias("place"))
        joined, before, place = whole.unionByName(cut), F.col("before"), F.col("place")
    # Always a shuffled join above, so that the plan is the same at every size.
    copies = F.col("low") + (before + place <= F.col("extra")).cast("long")
    return joined.withColumn("copies", copies).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
