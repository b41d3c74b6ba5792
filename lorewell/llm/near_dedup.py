"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of SLOTS hashes, each of ROWS minhashes, are computed for
a document: 2 * SLOTS * ROWS minhashes. Every pair of one hash from each forms
the key of a table, so SLOTS * SLOTS tables of 2 * ROWS minhashes come from about
the square root of the minhashes that separate tables would take. Two
documents are candidates if they share a key, that is, one hash of either
collection. At the threshold of 0.75 a pair is missed with probability
2 * (1 - 0.75 ** ROWS) ** SLOTS = 5e-4 at most; at 0.8 with 7e-5.

No table emits the pairs of a bucket. Documents of one shingle set are one node; equal buckets count once. Then

1. each bucket tests its smallest node against its others, on the full sets, which joins
   a group of n near copies by n tests;
2. candidates that are still in different components are joined exactly: of all nodes of buckets with more than one component, pairs that
   share a shingle of their prefixes (rarest shingles first) are tested, but never two of one component.

So no bucket has a cap, and no link between candidates of different components is lost.

Sets are sets of 64-bit hashes of shingles, and equal sets are told by 128 bits and their size. Texts are nodes, not ids: rows that share an id but not
their text get names of their own for the search, and their components are joined through the id in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.shared import U64, documents_text, lean, lower_ascii, materialize, mix, prefix_hash, span_hash, text_buffers, words

SHINGLE = 5
SLOTS = 10
ROWS = 2


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of the rows: (first, last + 1, distinct shingle hashes row by row, offsets)."""
    coef = mix(np.arange(11, 11 + SHINGLE, dtype=U64)) | U64(1)
    salt = mix(np.arange(101, 101 + SHINGLE, dtype=U64))
    for row, last, buf, offs in text_buffers(column):
        starts, ends, first = words(buf, offs)
        h = span_hash(prefix_hash(lower_ascii(buf)), starts, ends)
        count = np.diff(first)
        whole = np.zeros(max(len(h) - SHINGLE + 1, 0), dtype=U64)
        for k in range(SHINGLE):
            whole += h[k : k + len(whole)] * coef[k]
        whole = mix(whole)
        sets = []
        for i in range(last - row):
            a, n = first[i], count[i]
            if n >= SHINGLE:
                x = np.sort(whole[a : a + n - SHINGLE + 1])
                sets.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
            elif n:
                sets.append(mix((h[a : a + n] * coef[:n]).sum(dtype=U64, keepdims=True) + salt[n]))
            else:
                sets.append(np.zeros(0, dtype=U64))
        lens = np.array([len(s) for s in sets])
        yield row, last, np.concatenate(sets), np.concatenate(([0], np.cumsum(lens)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = 2 * SLOTS * ROWS
    mul = mix(np.arange(1001, 1001 + hashes, dtype=U64)) | U64(1)
    add = mix(np.arange(5001, 5001 + hashes, dtype=U64))
    slot = mix(np.arange(9001, 9001 + 2 * SLOTS, dtype=U64))
    for batch in batches:
        for row, last, h, offs in shingle_sets(batch["text"]):
            n = np.diff(offs)
            full = np.flatnonzero(n)
            low = np.zeros((hashes, last - row), dtype=U64)
            hi, lo = np.zeros(last - row, dtype=U64), np.zeros(last - row, dtype=U64)
            if len(h):
                at = offs[:-1][full]
                for k in range(hashes):
                    low[k, full] = np.minimum.reduceat(h * mul[k] + add[k], at)
                hi[full] = np.add.reduceat(mix(h + U64(77)), at)
                lo[full] = np.add.reduceat(mix(h + U64(99)), at)
            keys = np.zeros((last - row, 2 * SLOTS), dtype=U64)
            for s in range(2 * SLOTS):
                x = slot[s]
                for r in range(ROWS):
                    x = mix(x + mix(low[s * ROWS + r]))
                keys[:, s] = x
            values = pa.array(keys.view(np.int64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, 2 * SLOTS), pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"][row:last], pa.array(n.astype(np.int64)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), lists],
                ["doc_id", "n_shingles", "set_hi", "set_lo", "slots"],
            )


def _same(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, None
        for batch in batches:
            centers = batch["center"].to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.concatenate(([True], centers[1:] != centers[:-1]))) if len(centers) else []
            own: dict[int, np.ndarray] = {}
            for row, last, h, offs in shingle_sets(batch["center_text"].take(pa.array(new, pa.int64()))):
                for i in range(row, last):
                    own[int(new[i])] = h[offs[i - row] : offs[i - row + 1]]
            ok = np.zeros(len(centers), dtype=bool)
            for row, last, h, offs in shingle_sets(batch["member_text"]):
                for i in range(row, last):
                    if i in own:
                        held, known = centers[i], own.pop(i)
                    assert held == centers[i]
                    ok[i] = _same(known, h[offs[i - row] : offs[i - row + 1]], percent)
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(ok)) for c in ("u", "v")], ["u", "v"])

    return verify


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): (node, comp), comp the smallest node that is
    reachable. Minimum labels spread along the edges and then jump to the label's label,
    so the number of rounds grows with the logarithm of the longest path."""
    both = materialize(edges.select("u", "v").union(edges.select("v", "u").toDF("u", "v")).where("u <> v").distinct())
    label = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("comp")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(label.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        spread = label.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        spread = materialize(spread)
        jump = spread.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        label = materialize(spread.join(jump, "comp").select("node", F.least("comp", "top").alias("comp"), "old"))
        if label.where("comp <> old").isEmpty():
            return label.select("node", "comp")
        label = label.select("node", "comp")


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) of docs with a name for doc_id that no two different texts share, and (name, owner, h: the text's hash) of the names that aren't ids: of texts whose id has several."""
    texts = documents_text(docs)
    # Ids alone are read first: hardly any table repeats some.
    twice = materialize(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if twice.isEmpty():
        return texts, None
    hashed = texts.withColumn("h", F.xxhash64("text"))
    several = hashed.join(twice, "doc_id").groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    several = materialize(several.join(several.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"), "doc_id").select("doc_id", "h"))
    if several.isEmpty():
        return texts, None
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    more = F.monotonically_increasing_id()
    if high < 1 << 62:
        name = F.lit(max(high, 0) + 1) + more
    elif low > -(1 << 62):
        name = F.lit(min(low, 0) - 1) - more
    else:
        raise ValueError("ids that repeat with different texts need room beside the others, and these fill 64 bits")
    names = materialize(several.withColumn("name", name))
    out = hashed.join(names, ["doc_id", "h"], "left").select(F.coalesce("name", "doc_id").alias("doc_id"), "text")
    return out, names.select("name", F.col("doc_id").alias("owner"), "h")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Links documents whose sets of word shingles have 100 * intersection >= percent * union.

    Returns a row for each row of docs: doc_id, n_shingles, component_id (smallest doc_id
    reachable) and kept (it is its component's smallest). A null or blank text has no shingles and
    links with nothing; a text of fewer than SHINGLE words is one shingle. Rows that
    share a doc_id are linked by it, whatever their texts; a null doc_id links with nothing, has a null component and is kept. Equal sets
    are one node of the search, so exact copies cost nothing. Other columns of docs are not read."""
    texts, names = _named(docs)
    out = _classes(texts, percent)
    if names is not None:
        rows = materialize(out.alias("o").join(names.alias("n"), F.col("o.doc_id") == F.col("n.name"), "left").select(F.coalesce("n.owner", "o.doc_id").alias("doc_id"), "n_shingles", "comp", "n.owner"))
        through = rows.where("owner IS NOT NULL").select("owner", "comp").distinct()
        edges = through.join(through.groupBy("owner").agg(F.min("comp").alias("u")), "owner").where("u <> comp").select("u", F.col("comp").alias("v"))
        rows = materialize(rows.drop("owner").join(components(edges).toDF("comp", "whole"), "comp", "left").select("doc_id", "n_shingles", F.coalesce("whole", "comp").alias("comp")))
        out = rows.join(rows.where("doc_id IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least")), "comp", "left").select("doc_id", "n_shingles", F.col("least").alias("comp"))
    return out.select("doc_id", "n_shingles", F.col("comp").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("comp"), F.lit(True)).alias("kept"))


def _classes(texts: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n_shingles, comp), a row for each row of texts (doc_id, text): comp is the smallest doc_id reachable. Rows of one doc_id have one text."""
    # Read twice, computed twice: that is cheaper than writing it.
    sigs = texts.mapInArrow(lean(_signatures), "doc_id long, n_shingles long, set_hi long, set_lo long, slots array<long>")
    live = sigs.where("n_shingles > 0 and doc_id is not null")
    node = ["n_shingles", "set_hi", "set_lo"]
    reps = live.groupBy(*node).agg(F.min("doc_id").alias("rep"), F.min("slots").alias("slots"))
    reps = materialize(reps)

    # Hashes of the small collections that more than one node has.
    slots = reps.select("rep", "n_shingles", F.posexplode("slots").alias("at", "slot"))
    met = slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1").select("slot")
    side = lambda a: F.collect_list(F.when(F.col("at") < SLOTS if a else F.col("at") >= SLOTS, F.col("slot")))
    pair = slots.join(met, "slot").groupBy("rep", "n_shingles").agg(side(True).alias("a"), side(False).alias("b"))
    keys = pair.select("rep", "n_shingles", F.explode("a").alias("a"), "b").select("rep", "n_shingles", "a", F.explode("b").alias("b"))
    keys = materialize(keys.select("rep", "n_shingles", F.xxhash64("a", "b").alias("key")).distinct())
    who = F.xxhash64("rep")
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(who).alias("x"), F.sum(F.shiftright(who, 24)).alias("y")).where("n > 1")
    buckets = buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    members = materialize(keys.join(buckets, "key"))
    if members.isEmpty():
        linked = None
    else:
        flagged = members.select(F.col("rep").alias("doc_id")).distinct()
        # Always a shuffled join, so that the plan is the same at every size.
        flagged = materialize(texts.join(flagged.hint("merge"), "doc_id"))
        linked = _link(members, flagged, percent)
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in node]
    out = sigs.alias("s").join(reps.alias("r"), same, "left").select(
        "s.doc_id", "s.n_shingles", F.when(F.col("s.doc_id").isNotNull(), F.coalesce("r.rep", "s.doc_id")).alias("rep")
    )
    if linked is None:
        return out.select("doc_id", "n_shingles", F.col("rep").alias("comp"))
    return out.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("comp"))


def _token_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, last, h, offs in shingle_sets(batch["text"]):
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"][row:last], lists], ["node", "tokens"])


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The components (u, v) of those pairs (center, member, u, v) whose full sets are similar enough."""
    with_member = pairs.join(texts.toDF("member", "member_text"), "member")
    whole = with_member.join(texts.toDF("center", "center_text"), "center").sortWithinPartitions("center")
    return materialize(whole.select("center", "u", "v", "center_text", "member_text").mapInArrow(lean(_verifier(percent)), "u long, v long"))


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, comp) after the components that links (u, v) connect have become one."""
    if links.isEmpty():
        return label
    new = components(links).toDF("comp", "new")
    return materialize(label.join(new, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")))


def _crossing(label: DataFrame, sizes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (center, member, u, v) of nodes in different components that can be similar enough. sizes: (node, n), the sizes of the sets.

    Order all shingles from rare to frequent. Two sets of n and m shingles that are similar have k = ceil(percent * (n + m) / (100 + percent)) in common; the
    first of them stands before place n - k of the one and m - k of the other. So prefixes meet, by that place. What sets a document
    apart fills its prefix, and shingles that a whole group of copies shares hardly ever make a pair."""
    tokens = materialize(texts.mapInArrow(lean(_token_sets), "node long, tokens array<long>").select("node", F.explode("tokens").alias("token")))
    seen = materialize(tokens.groupBy("token").agg(F.count("*").alias("seen")).where("seen > 1"))
    shared = tokens.join(seen, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("seen", "token"))).alias("shared")).join(sizes, "node")
    # Shingles that no other node has come first of all; of the others, those stay that can be the first in common.
    alone = F.col("n") - F.size("shared")
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    first = F.slice("shared", F.lit(1), F.greatest(most, F.lit(0)).cast("int"))
    rows = shared.select("node", "n", alone.alias("alone"), F.posexplode(first).alias("at", "t")).select("node", "n", (F.col("alone") + F.col("at")).alias("at"), "t.token")
    rows = materialize(rows.join(label, "node"))
    largest = rows.groupBy("token", "comp").agg(F.count("*").alias("size")).groupBy("token").agg(F.max(F.struct("size", "comp"))["comp"].alias("largest"), F.count("*").alias("comps"))
    y = rows.join(materialize(largest.where("comps > 1").select("token", "largest")), "token").alias("y")
    x = y.where("comp <> largest").alias("x")
    # Within the largest component of a shingle no pair is formed.
    place = f"(x.n - x.at) * {100 + percent} >= {percent} * (x.n + y.n) and (y.n - y.at) * {100 + percent} >= {percent} * (x.n + y.n)"
    found = x.join(y, F.expr(f"x.token = y.token and x.comp <> y.comp and (y.comp = y.largest or x.node < y.node) and {place}"))
    found = found.select(F.least(F.struct("x.node", "x.comp"), F.struct("y.node", "y.comp")).alias("a"), F.greatest(F.struct("x.node", "x.comp"), F.struct("y.node", "y.comp")).alias("b"))
    return found.select(F.col("a.node").alias("center"), F.col("b.node").alias("member"), F.col("a.comp").alias("u"), F.col("b.comp").alias("v")).distinct()


def _link(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """members: (key, rep, n_shingles); texts of their reps. Returns (node, comp)."""
    label = members.select(F.col("rep").alias("node"), F.col("rep").alias("comp")).distinct()
    center = members.groupBy("key").agg(F.min(F.struct("rep", "n_shingles")).alias("c"))
    stars = members.join(materialize(center), "key").where("rep <> c.rep").where(f"100 * least(n_shingles, c.n_shingles) >= {percent} * greatest(n_shingles, c.n_shingles)")
    stars = materialize(stars.select(F.col("c.rep").alias("center"), F.col("rep").alias("member"), F.col("c.rep").alias("u"), F.col("rep").alias("v")).distinct())
    label = _joined(label, _verified(stars, texts, percent))
    # Buckets of more than two nodes, in more than one component: a bucket of two is done.
    placed = members.join(label.withColumnRenamed("node", "rep"), "rep")
    open_ = placed.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("m > 2 and x < y").select("key")
    nodes = materialize(placed.join(open_, "key").select(F.col("rep").alias("node"), F.col("n_shingles").alias("n"), "comp").distinct())
    if nodes.isEmpty():
        return label
    some = texts.join(nodes.select(F.col("node").alias("doc_id")), "doc_id")
    rest = materialize(_crossing(nodes.select("node", "comp"), nodes.select("node", "n"), some, percent).join(stars, ["center", "member"], "left_anti"))
    return _joined(label, _verified(rest, texts, percent))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs, with all their columns, without the near copies: of each component of texts one stays, that of the smallest doc_id. Texts alone
    link here: rows that share an id but no text are documents of their own, rows that share both are copies. Rows with a null id all stay, and so do all without words but
    those that repeat an id and its text. docs may be empty."""
    texts, names = _named(docs)
    found = materialize(_classes(texts, percent))
    if names is not None:  # of a component, the row of the smallest id stays, not of the smallest name
        first = F.min(F.struct(F.coalesce("n.owner", "f.doc_id").alias("owner"), F.coalesce("n.h", F.lit(0)).alias("h"), F.col("f.doc_id").alias("doc_id")))
        least = found.alias("f").join(names.alias("n"), F.col("f.doc_id") == F.col("n.name"), "left").groupBy("f.comp").agg(first.alias("first"))
        found = materialize(found.join(least, "comp", "left").select("doc_id", "n_shingles", F.col("first.doc_id").alias("comp")))
    gone = found.where("doc_id <> comp").select("doc_id").distinct()
    again = materialize(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    # The row travels in a struct, so no column of docs can clash with the names.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("name"))
    if names is not None:
        own = names.select(F.col("name").alias("known"), "owner", "h").alias("k")
        rows = rows.alias("r").join(own, (F.col("r.name") == F.col("owner")) & (F.xxhash64(F.coalesce("r.row.text", F.lit(""))) == F.col("h")), "left").select("row", F.coalesce("known", "name").alias("name"))
    rows = rows.alias("r").join(gone.hint("merge").alias("g"), F.col("r.name") == F.col("g.doc_id"), "left_anti")
    if again.isEmpty():
        return rows.select("row.*")
    copies = rows.join(again.alias("a"), F.col("name") == F.col("a.doc_id"), "left_semi")
    one = copies.groupBy("name").agg(F.min_by("row", F.xxhash64(*(F.col(f"row.`{c}`") for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()))).alias("row"))
    return rows.join(again.alias("a"), F.col("name") == F.col("a.doc_id"), "left_anti").select("row.*").unionByName(one.select("row.*"))
