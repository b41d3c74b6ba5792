"""Benchmark items in documents, by a prefix-filtered set join.

An item is cut into windows of WINDOW consecutive words (a shorter item is one window), a window into its shingles of SHINGLE words (a shorter window is one shingle), and distinct
windows are one. A document holds a window only if it holds all its shingles, so the one that is rarest in all documents, the window's prefix at a containment of 1, is joined and no other:

1. One pass over the documents finds the stretches of words that shingles of items cover. Shingles are told by a Bloom filter of at most BITS bits, so what is sent to the
   tasks has a bound; it passes some others, and loses none. Nothing else of the documents is moved, and long stretches are cut into overlapping parts.
2. Their shingles are counted. Every window takes its rarest one; a window with one that never occurs is done.
3. Shingles of documents meet the windows of that prefix. The place of the prefix in the window tells where the window would begin; if it begins in the document and ends in it (bounds by
   position and length), the words there are compared with the window's, one by one.

What occurs is joined to spans of hit words, a document at a time and in order. Documents with the same items are told them once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.shared import U64, lean, lower_ascii, materialize, mix, prefix_hash, small_batches, span_hash, text_buffers, words

WINDOW = 10
SHINGLE = 5
#: Bits of the filter at most, and bits for each shingle of the items as long as these are less.
BITS = 1 << 26
BITS_EACH = 256
#: Words of a stretch in a row, beside those that the next one has too.
PART = 2048
#: Longer words (bytes of UTF-8) stand for themselves by their checksum.
LONG = 64

#: Letters and digits of ASCII, and all bytes of other characters.
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the rows: (first, last + 1, lower-case bytes, words' starts and ends, texts' first words, words' hashes)."""
    for row, last, buf, offs in text_buffers(column):
        buf = lower_ascii(buf)
        starts, ends, first = words(buf, offs, _INSIDE)
        yield row, last, buf, starts, ends, first, span_hash(prefix_hash(buf), starts, ends)


def _shingled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Of size words from each on; those that cross texts are wrong."""
    coef = mix(np.arange(31, 31 + size, dtype=U64)) | U64(1)
    out = np.full(max(len(hashes) - size + 1, 0), mix(np.array([size], dtype=U64))[0])
    for k in range(size):
        out += hashes[k : k + len(out)] * coef[k]
    return mix(out)


def _item_shingles(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, _, _, first, hashes in _words(batch["text"]):
                n = np.diff(first)
                for size in range(1, shingle + 1):
                    # Windows are alike in size but for short items.
                    own = np.flatnonzero(n >= size if size == min(shingle, window) else n == size if size < min(shingle, window) else n < 0)
                    whole = _shingled(hashes, size)
                    at = np.concatenate([np.arange(first[i], first[i] + n[i] - size + 1) for i in own]) if len(own) else np.zeros(0, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size)), pa.array(whole[at].view(np.int64))], ["size", "hash"])

    return run


class _Filter:
    """A Bloom filter with two bits a hash: words of 64 bits."""

    def __init__(self, bits: int) -> None:
        self.table, self.mask = np.zeros(bits // 64, dtype=U64), U64(bits - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        def bit(at: np.ndarray) -> np.ndarray:
            return (self.table[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1

        out = bit(h & self.mask)
        some = np.flatnonzero(out)
        out[some] = bit((h[some] >> U64(32)) & self.mask)
        return out


def _filled(shingles: DataFrame) -> _Filter:
    """The filter of all hashes. The driver gets its words of 64 bits that aren't 0, BITS / 64 at most, however many hashes there are."""
    bits = min(BITS, max(1 << 12, 1 << (BITS_EACH * shingles.count()).bit_length()))
    out = _Filter(bits)
    places = shingles.select(F.explode(F.array(F.col("hash").bitwiseAND(bits - 1), F.shiftright("hash", 32).bitwiseAND(bits - 1))).alias("at"))
    table = places.groupBy(F.shiftright("at", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("w")).toArrow()
    out.table[table["i"].to_numpy()] = table["w"].to_numpy().view(U64)
    return out


def _texts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Words as strings, long ones by their checksum behind a character that no word has."""
    lens = ends - starts
    offs = np.concatenate(([0], np.cumsum(lens)))
    data = buf[np.repeat(starts - offs[:-1], lens) + np.arange(offs[-1])]
    if (lens <= LONG).all():
        return pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(offs), pa.py_buffer(data)).cast(pa.string())
    raw = data.tobytes()
    each = (raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True))
    return pa.array(["/" + hashlib.sha256(w).hexdigest() if len(w) > LONG else w.decode("utf-8", "replace") for w in each], pa.string())


def _stretches(filled, sizes: list[int], window: int):
    names = ["rid", "doc_id", "n_words", "first", "words"]

    def rows(rid: pa.Array, doc_id: pa.Array, n_words: np.ndarray, first: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rid, doc_id, pa.array(n_words), first, texts], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: _Filter = filled.value
        for batch in batches:
            rid, doc_id = batch["rid"], batch["doc_id"]
            for row, last, buf, starts, ends, first, hashes in _words(batch["text"]):
                n, k = np.diff(first), last - row
                yield rows(rid[row:last], doc_id[row:last], n, pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.string())))
                change = np.zeros(len(hashes) + 1, dtype=np.int32)
                text_end = np.repeat(first[1:], n)
                for size in sizes:
                    at = np.flatnonzero(known.has(_shingled(hashes, size)))
                    at = at[at + size <= text_end[at]]
                    change[at] += 1
                    np.subtract.at(change, at + size, 1)
                covered = np.cumsum(change[:-1]) > 0
                if not covered.any():
                    continue
                edge = np.concatenate(([True], covered[1:] != covered[:-1]))
                edge[first[first < len(covered)]] = True
                begin = np.flatnonzero(edge)
                stop = np.append(begin[1:], len(covered))
                begin, stop = begin[covered[begin]], stop[covered[begin]]
                # Parts of PART words and window - 1 more: a window lies whole in the one in which it begins.
                parts = np.maximum(1, -(-(stop - begin - window + 1) // PART))
                step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
                a = np.repeat(begin, parts) + step * PART
                b = np.minimum(np.repeat(stop, parts), a + PART + window - 1)
                own = np.searchsorted(first, a, side="right") - 1
                lens = b - a
                offs = np.concatenate(([0], np.cumsum(lens)))
                at = np.repeat(a - offs[:-1], lens) + np.arange(offs[-1])
                texts = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), _texts(buf, starts[at], ends[at]))
                yield rows(rid.take(pa.array(row + own)), pa.nulls(len(a), doc_id.type), n[own], pa.array(a - first[own]), texts)

    return run


def _shingles_of(column: str, size: Column) -> Column:
    """Of an array of words: (at, key) of all shingles of size words."""
    return F.transform(F.sequence(F.lit(0), F.size(column) - size), lambda i: F.struct(i.alias("at"), F.xxhash64(F.array_join(F.slice(column, i + 1, size), " ")).alias("key")))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """words (an array) of the distinct windows, and item_ids (sorted, of each once; without nulls): at most as many as there are items."""
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    short = F.transform(own, lambda w: F.when(F.octet_length(w) > LONG, F.concat(F.lit("/"), F.sha2(w, 256))).otherwise(w))
    split = items.select("item_id", short.alias("own")).where(F.size("own") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("own") - (window - 1)))
    return split.select("item_id", F.explode(at).alias("i"), "own").select("item_id", F.slice("own", F.col("i"), window).alias("words")).groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(documents: rid, doc_id, n_words; what occurs: rid, start and size in words, item_ids of the window). rid is a number of the row."""
    if not 0 < shingle <= window:
        raise ValueError("a window is of one shingle's words at least")
    spark = docs.sparkSession
    small_batches(spark)
    hashes = materialize(items.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(_item_shingles(window, shingle), "size long, hash long").distinct())
    sizes = sorted(r[0] for r in hashes.select("size").distinct().collect())  # some of 1 to shingle
    filled = spark.sparkContext.broadcast(_filled(hashes))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = materialize(numbered.mapInArrow(lean(_stretches(filled, sizes, window)), f"rid long, doc_id {id_type}, n_words long, first long, words array<string>"))

    parts = found.where("first IS NOT NULL").select("rid", "n_words", "first", "words")
    if sizes:
        each = F.concat(*(F.when(F.size("words") >= s, _sized(s, window)).otherwise(F.array().cast(_KEYED)) for s in sizes))
    else:
        each = F.array().cast(_KEYED)
    keyed = parts.select("rid", "n_words", "first", "words", F.explode(each).alias("x")).select("rid", "n_words", "first", "words", "x.*")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))

    windows = materialize(item_windows(items, window).withColumn("wid", F.monotonically_increasing_id()))
    inner = windows.select("wid", "words", F.explode(_shingles_of("words", F.least(F.size("words"), F.lit(shingle)))).alias("x")).select("wid", "x.at", "x.key")
    rare = inner.join(counts, "key", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "key", "at")).alias("rare")).where("rare.n > 0")
    prefixes = windows.join(rare, "wid").select(F.col("rare.key").alias("key"), F.col("rare.at").alias("place"), F.col("words").alias("window"), "item_ids")

    # What stands around a shingle in its part of the document: window - size words to both sides.
    near = keyed.select("rid", "n_words", "key", (F.col("first") + F.col("at")).alias("at"), F.least("at", F.col("side")).alias("before"),
                        F.slice("words", F.greatest(F.lit(1), F.col("at") - F.col("side") + 1), F.least("at", F.col("side")) + F.col("size") + F.col("side")).alias("around"))
    start = F.col("at") - F.col("place")
    fits = (F.col("place") <= F.col("before")) & (start + F.size("window") <= F.col("n_words"))
    same = F.slice("around", F.col("before") - F.col("place") + 1, F.size("window")) == F.col("window")
    return (
        found.where("first IS NULL").select("rid", "doc_id", "n_words"),
        near.join(prefixes, (near["key"] == prefixes["key"]) & fits & same).select("rid", start.alias("start"), F.size("window").alias("size"), "item_ids"),
    )


_KEYED = "array<struct<at:int,key:bigint,size:int,side:int>>"


def _sized(size: int, window: int) -> Column:
    return F.transform(_shingles_of("words", F.lit(size)), lambda x: F.struct(x["at"].alias("at"), x["key"].alias("key"), F.lit(size).alias("size"), F.lit(window - size).alias("side")))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Every document with the items it holds windows of: doc_id, n_words, n_hit (words inside any occurrence of a window), spans of them (start, end; maximal), n_items, item_ids
    (as strings, sorted as such) and contaminated (n_hit > 0).

    Each row of docs is a document of its own, ids that repeat or are null included. A null text has no words. Items without words occur nowhere; rows of items that share an id are one
    item; an item of null id makes hits, but has no id to be listed. No items: nothing is hit; no documents: no rows. Other columns are not read."""
    documents, found = occurrences(docs, items, window, shingle)
    sets = F.xxhash64("item_ids")
    found = materialize(found.withColumn("items", sets))
    # Spans of words that touch or overlap, in the order of their starts.
    before = Window.partitionBy("rid").orderBy("start", F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("rid").orderBy("start", F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("start") + F.col("size")
    opened = found.select("rid", "start", end.alias("end"), "items", "size").withColumn("fresh", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("long"))
    spans = opened.withColumn("span", F.sum("fresh").over(upto)).groupBy("rid", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.collect_set("items").alias("items"))
    hit = spans.groupBy("rid").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    hit = materialize(hit)
    listed = found.select("items", "item_ids").dropDuplicates(["items"])
    several = hit.select(F.col("items").alias("group")).distinct().select("group", F.explode("group").alias("items"))
    names = several.join(listed, "items").select("group", F.explode("item_ids").alias("item_id")).groupBy("group").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    named = hit.select("rid", "n_hit", "spans", F.col("items").alias("group")).join(names, "group", "left").drop("group")
    out = documents.join(named, "rid", "left")
    none, no_spans = F.array().cast("array<string>"), F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", no_spans).alias("spans"),
        F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
