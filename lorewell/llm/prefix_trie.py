"""The trie of conversation prefixes, with sums over its subtrees by leaf peeling.

A node is a distinct sequence of the first turns of a conversation; it's told by its depth and 128 bits: two hashes of every (turn, place), joined by xor, so that the prefixes of a
conversation are a running xor. Members are counted by combinable aggregates, so a beginning that a third of all conversations share is no hot key. Conversations may be as long as they
like: turns are ranged by (conversation, turn) over all tasks, their places and running hashes come from parts with the totals of the parts before.

Sums go up by messages. Every node holds a counter of children that haven't reported, and the xor of their names; a node whose counter is 0 is complete and sends its totals to its
parent. A node with one child left knows its name, and waits for it by pointer: pointers that lead to nodes which wait too are doubled each round. So long chains and combs don't take as many
rounds as they are deep, but about the logarithm. Nodes of one member need no rounds: below them is that conversation's own rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.shared import lean, materialize, plain_unions

#: Places of a conversation in a part: running hashes are worked out part by part.
PART = 4096
#: Bytes of ids that are joined in a row before the checksum.
CHUNK = 1 << 16


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn_key and size (UTF-8 bytes of the text) of every turn, in the order of turn (null first), then role, then the text's SHA-256. Null roles and texts are
    empty. Rows that repeat are turns of their own; rows without conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sha = F.unhex(F.sha2(text, 256))
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"), sha.alias("sha"), F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"),
    )
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha"), F.col("row")]
    # Ranges split a long conversation; row parts even turns that are alike.
    ranged = materialize(turns.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), _long(0)))
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*by[1:])).cast("long")
    numbered = ranged.withColumn("own", own).join(parts.where("ahead > 0").select("conv_id", "part", "ahead"), ["conv_id", "part"], "left")
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.hex("sha")), 256)
    return numbered.select("conv_id", (F.coalesce("ahead", _long(0)) + F.col("own") - 1).alias("place"), F.unhex(key).alias("turn_key"), "size")


def rebuilt(turns: DataFrame, family: int = 5, shared: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where every conversation c has its first h turns (h: the checksum of its id modulo shared) from conversation c - c % family, all if that has fewer,
    none if there is none, and then its own after its first h. conversations: conv_id and n, its number of turns, 0 too."""
    known = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    own = known.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % shared).alias("h"))
    bases = known.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = own.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", _long(0))))
    convs = materialize(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(_long(0), F.col("n") - F.col("h"))).alias("n")))
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn_key", "size")
    given = turns.where(F.col("place") < shared).withColumnRenamed("conv_id", "base")
    first = given.join(convs.where("taken > 0").select("conv_id", "base", "taken"), "base").where("place < taken").select("conv_id", "place", "turn_key", "size")
    return first.unionByName(rest), convs.select("conv_id", "n")


def _members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and prefix but the empty one: conv_id, depth, the prefix (x, y) and its parent's (px, py), size, ends (no turn follows)."""
    hashed = turns.withColumns({"hx": F.xxhash64("turn_key", "place"), "hy": F.xxhash64(F.lit("y"), "place", "turn_key"), "part": F.floor(F.col("place") / PART)})
    hashed = materialize(hashed.select("conv_id", "place", "part", "size", "hx", "hy"))
    inner = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of several parts have anything to carry over.
    several = hashed.where("part > 0").select("conv_id").distinct()
    sums = hashed.join(several, "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.bit_xor("hx").alias("hx"), F.bit_xor("hy").alias("hy"))
    carried = sums.select("conv_id", "part", F.bit_xor("hx").over(before).alias("cx"), F.bit_xor("hy").over(before).alias("cy")).where("cx IS NOT NULL")
    running = hashed.withColumns({"x": F.bit_xor("hx").over(inner), "y": F.bit_xor("hy").over(inner)}).join(carried, ["conv_id", "part"], "left")
    x, y = (F.col(a).bitwiseXOR(F.coalesce(F.col(c), _long(0))) for a, c in (("x", "cx"), ("y", "cy")))
    depth = F.col("place") + 1
    found = running.join(convs, "conv_id").select("conv_id", depth.alias("depth"), x.alias("x"), y.alias("y"), "hx", "hy", "size", (depth == F.col("n")).alias("ends"))
    return found.select("conv_id", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("hx")).alias("px"), F.col("y").bitwiseXOR(F.col("hy")).alias("py"), "size", "ends")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (x, y, depth, conv_id) to rows of joined ids: x, y, depth, at (the first id) and ids."""
    key, at, held, size = None, None, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"x": [key[0]], "y": [key[1]], "depth": [key[2]], "at": [at], "ids": [",".join(held)]})

    for batch in batches:
        for x, y, depth, conv in zip(*(batch[c].to_pylist() for c in ("x", "y", "depth", "conv_id")), strict=True):
            if (x, y, depth) != key or size > CHUNK:
                if held:
                    yield row()
                key, at, held, size = (x, y, depth), conv, [], 0
            held.append(str(conv))
            size += len(held[-1]) + 1
    if held:
        yield row()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (x, y, depth, at) to a checksum each of (x, y, depth)."""
    key, state = None, None
    for batch in batches:
        out = []
        for x, y, depth, ids in zip(*(batch[c].to_pylist() for c in ("x", "y", "depth", "ids")), strict=True):
            if (x, y, depth) == key:
                state.update(b",")
            else:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (x, y, depth), sha256()
            state.update(ids.encode())
        yield _sums(out)
    if key:
        yield _sums([(*key, state.hexdigest())])


def _sums(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["x", "y", "depth", "ends_sha256"])


def ends_of(several: DataFrame) -> DataFrame:
    """SHA-256 of the conv_ids (ascending, comma-joined) of each (x, y, depth). Ids are ranged over all tasks and joined to chunks there, so what a checksum, which can't be
    split, reads alone are some chunks, one at a time."""
    key = ["x", "y", "depth"]
    ids = several.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(_listed, "x long, y long, depth long, at long, ids string")
    return ids.repartition(*key).sortWithinPartitions(*key, "at").mapInArrow(lean(_summed), "x long, y long, depth long, ends_sha256 string")


def peeled(nodes: DataFrame) -> DataFrame:
    """Totals of subtrees by messages from complete children to parents: conv_id, depth, n_leaves, saved.

    nodes: conv_id and depth (the name together), up (the parent's conv_id, null at the root), left (number of children), child (the xor of their conv_ids), n_leaves and saved (their own
    part). A node of left = 0 is complete. n_leaves of a node with children counts nothing of its own."""
    state = materialize(nodes.select("conv_id", "depth", "up", "left", "child", (F.col("depth") + 1).alias("child_depth"), "n_leaves", "saved", (F.col("left") == 0).alias("complete")))
    rounds = [state]
    while not state.where("NOT complete").isEmpty():
        told, open_ = state.where("complete"), state.where("NOT complete")
        # Nodes with several children left hear from those that are complete now.
        sums = told.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
            F.count("*").alias("n"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"), F.bit_xor("conv_id").alias("c"))
        heard = open_.where("left > 1").join(sums, ["conv_id", "depth"], "left").select(
            "conv_id", "depth", "up", (F.col("left") - F.coalesce("n", _long(0))).alias("left"), F.col("child").bitwiseXOR(F.coalesce("c", _long(0))).alias("child"), "child_depth",
            (F.col("n_leaves") + F.coalesce("l", _long(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", _long(0))).alias("saved"),
        ).withColumn("complete", F.col("left") == 0)
        # Nodes with one child left look at it: if it is complete, so are they; if it waits itself, they wait for what it waits for.
        waits = open_.where("left = 1")
        there = told.select(F.col("conv_id").alias("child"), F.col("depth").alias("child_depth"), F.col("n_leaves").alias("l"), F.col("saved").alias("s"))
        looked = waits.join(there, ["child", "child_depth"], "left").withColumn("complete", F.col("l").isNotNull())
        looked = looked.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("l", _long(0)), "saved": F.col("saved") + F.coalesce("s", _long(0))}).drop("l", "s")
        still = looked.where("NOT complete")
        beyond = still.select(F.col("conv_id").alias("child"), F.col("depth").alias("child_depth"), F.col("child").alias("c"), F.col("child_depth").alias("d"), F.col("n_leaves").alias("l"), F.col("saved").alias("s"))
        jumped = still.join(beyond, ["child", "child_depth"], "left").select(
            "conv_id", "depth", "up", "left", F.coalesce("c", "child").alias("child"), F.coalesce("d", "child_depth").alias("child_depth"),
            (F.col("n_leaves") + F.coalesce("l", _long(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", _long(0))).alias("saved"), "complete",
        )
        state = materialize(heard.unionByName(looked.where("complete").select(*heard.columns)).unionByName(jumped))
        rounds.append(state)
    done = rounds[0].where("complete")
    for r in rounds[1:]:
        done = done.unionByName(r.where("complete"))
    return done.select("conv_id", "depth", "n_leaves", "saved")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves (nodes without children in the
    subtree, the node included), saved_tokens (bytes that keeping shared turns once saves in the subtree) and ends_sha256 (SHA-256 of the ids of conversations that end there, ascending,
    comma-joined).

    turns: conv_id, place, turn_key, size; convs: conv_id, n. Conversations without turns are members of the root alone; no conversations give no nodes."""
    plain_unions(turns.sparkSession)
    members = materialize(_members(turns, convs))
    key = ["depth", "x", "y"]
    grouped = members.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends"),
        F.min(F.when(F.col("ends"), F.col("conv_id"))).alias("end"), F.first("size").alias("size"), F.first("px").alias("px"), F.first("py").alias("py"),
    )
    nodes = materialize(grouped)
    least, n, bare, one = convs.agg(F.min("conv_id"), F.count("*"), F.sum((F.col("n") == 0).cast("long")), F.min(F.when(F.col("n") == 0, F.col("conv_id")))).first()
    if not n:
        return convs.sparkSession.createDataFrame([], _NODE)
    # A node of several members gives its name to its children; below a node of one member all is that conversation's.
    shared = nodes.where("n_convs > 1").select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("shared"))
    top = F.when(F.col("depth") == 1, F.lit(least).cast("long"))
    linked = nodes.where("depth > 1").join(shared, ["depth", "px", "py"], "left").unionByName(nodes.where("depth = 1").withColumn("shared", F.lit(None).cast("long")))
    linked = linked.withColumn("up", F.coalesce(top, "shared", "conv_id")).withColumn("under", F.col("shared").isNotNull() | (F.col("depth") == 1))
    root = convs.sparkSession.range(1).select(
        _long(0).alias("depth"), _long(0).alias("x"), _long(0).alias("y"), _long(least).alias("conv_id"), _long(n).alias("n_convs"), _long(bare or 0).alias("n_ends"), F.lit(one).cast("long").alias("end"),
        _long(0).alias("size"), F.lit(None).cast("long").alias("up"), F.lit(False).alias("under"),
    )
    linked = materialize(linked.select(*root.columns).unionByName(root))

    # Children of shared nodes and of the root are counted; a node of one member has one child unless it ends there.
    children = linked.where("under").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n"), F.bit_xor("conv_id").alias("child"))
    many = (F.col("n_convs") > 1) | (F.col("depth") == 0)
    branching = linked.where(many).join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n", _long(0)))
    single = linked.where(~many).withColumn("n_children", 1 - F.col("n_ends"))
    own = F.when(F.col("n_children") == 0, _long(1)).otherwise(_long(0))
    saved = (F.col("n_convs") - 1) * F.col("size")
    inner = materialize(branching.select(*linked.columns, "n_children", F.coalesce("child", _long(0)).alias("child")))
    start = inner.select("conv_id", "depth", "up", F.col("n_children").alias("left"), "child", own.alias("n_leaves"), saved.alias("saved"))
    start = start.unionByName(single.where("under").select("conv_id", "depth", "up", _long(0).alias("left"), _long(0).alias("child"), _long(1).alias("n_leaves"), _long(0).alias("saved")))
    totals = peeled(start)
    out = inner.drop("child").join(totals, ["conv_id", "depth"]).unionByName(single.select(*linked.columns, "n_children", _long(1).alias("n_leaves"), _long(0).alias("saved")))

    # Checksums of several ids.
    several = nodes.where("n_ends > 1").select(*key)
    ended = members.where("ends").join(several, key, "left_semi").select(*key, "conv_id")
    if (bare or 0) > 1:
        ended = ended.unionByName(convs.where("n = 0").select(_long(0).alias("depth"), _long(0).alias("x"), _long(0).alias("y"), "conv_id"))
    summed = ends_of(ended)
    alone = F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")), 256)
    told = out.where("n_ends > 1").join(summed, key).unionByName(out.where("n_ends <= 1").withColumn("ends_sha256", alone))
    return told.select("conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
