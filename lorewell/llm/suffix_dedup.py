"""Exact removal of repeated byte strings with a sampled, bucketed suffix array.

A suffix of every byte would be 200 bytes of shuffle for one of text. Suffixes are
taken only at anchors instead: the places whose GRAM-byte string has the
smallest hash of some 200-byte window. A window's anchor depends on its bytes
alone, so equal windows have equal anchors at the same offset, and no repeat is missed.

1. Anchors whose leading GRAM bytes occur once in the corpus go (counts with map-side combine). Anchors of periodic text whose surroundings are all alike are one row.
2. Each other anchor becomes a context: the suffix from the anchor and the
   text before it, as far as the windows with this anchor reach. Equal
   contexts of an Arrow batch are merged before they are shuffled.
3. Contexts are range-partitioned by the leading bytes of the suffix, the text before it and a document's id, with splitters that
   Spark samples, into buckets of about BUCKET contexts. So a frequent beginning, and even a frequent context, is parted.
4. A bucket sorts its suffixes, and its reversed left texts, by multikey quicksort with
   8-byte keys and gets both LCP arrays. A window that begins i bytes before its anchor is
   a prefix class of either order, so windows repeat where both classes agree.
5. Comparison across boundaries: a class of suffixes that has the bucket's first or last suffix (or its first SPLIT bytes) may go on in the next bucket. The
   windows of such classes, each distinct one of a bucket once, meet by their hash of 128 bits, and those of two buckets repeat.
6. All windows of a context contain its anchor, so what is removed there is one span. Spans meet
   their document again by its key, and are cut out of its bytes. Documents without spans stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.shared import U64, documents_text, lean, materialize, mix, prefix_hash, span_hash, text_buffers

LENGTH = 200
GRAM = 32
#: Contexts of a bucket, about.
BUCKET = 100_000
#: Leading bytes of suffixes, and bytes before them, that splitters are made of.
SPLIT, SPLIT_BEFORE = 128, 32
#: Bits, at most, that tell documents with spans.
MOST_BITS = 1 << 26
_TOP = U64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, w: int, op: np.ufunc, pad) -> np.ndarray:
    """op over x[i : i + w] for every i."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    y = np.full(rows * w, pad, dtype=x.dtype)
    y[: len(x)] = x
    y = y.reshape(rows, w)
    ahead = op.accumulate(y, axis=1).reshape(-1)
    behind = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: the anchors' row, place, hash and how far their windows reach to the
    left and to the right (from the anchor)."""
    none = np.zeros(0, dtype=np.int64)
    if len(buf) < length:
        return none, none, none.astype(U64), none, none
    w = length - gram + 1
    at = np.arange(len(buf) - gram + 1)
    h = span_hash(prefix_hash(buf), at, at + gram) | U64(1)
    low = _sliding(h, w, np.minimum, _TOP)  # of the window that begins there
    ok = np.zeros(len(low) + 1, dtype=np.int64)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if b - a >= length:
            ok[a] += 1
            ok[b - length + 1] -= 1
    low[np.cumsum(ok)[:-1] == 0] = 0
    wide = np.zeros(len(low) + 2 * (w - 1), dtype=U64)
    wide[w - 1 : w - 1 + len(low)] = low
    p = np.flatnonzero(_sliding(wide, w, np.maximum, U64(0)) == h)
    edge = np.ones(len(low), dtype=bool)
    edge[1:] = low[1:] != low[:-1]
    run = np.flatnonzero(edge)
    i = np.searchsorted(run, np.maximum(p - w + 1, 0), side="right") - 1
    while len(bad := np.flatnonzero(low[run[i]] != h[p])):
        i[bad] += 1
    ends = np.append(run[1:], len(low)) - 1
    left, right = p - np.maximum(run[i], p - w + 1), np.minimum(ends[i], p) + length - p
    return np.searchsorted(offs, p, side="right") - 1, p, h[p], left, right


def alike(buf: np.ndarray, r: np.ndarray, p: np.ndarray, h: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of anchors at equal steps of a text, up to LENGTH bytes, whose contexts are the same: first anchor, number and step of each run."""
    n = len(p)
    gap = np.diff(p)
    same = np.zeros(n, dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1]) & (gap <= LENGTH)
    if not same.any():
        return np.arange(n), np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    some = np.flatnonzero(same)
    prefix = prefix_hash(buf)
    context = lambda k: span_hash(prefix, p[k] - left[k], p[k] + right[k])
    same[some] = context(some) == context(some - 1)
    step = np.concatenate(([0], gap))
    begins = ~same
    begins[1:] |= same[1:] & same[:-1] & (step[1:] != step[:-1])
    run = np.cumsum(begins) - 1
    place = np.arange(n) - np.flatnonzero(begins)[run]
    # A run stays short enough for its span to be told in 20 bits.
    begins |= place % np.maximum(1, (1 << 19) // np.maximum(step, 1)) == 0
    first = np.flatnonzero(begins)
    count = np.diff(np.append(first, n))
    return first, count, np.where(count > 1, step[np.minimum(first + 1, n - 1)], 0)


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, last, buf, offs in text_buffers(batch["text"]):
            r, p, h, left, right = anchors(buf, offs)
            first, count, step = alike(buf, r, p, h, left, right)
            r, p, h, left, right = (x[first] for x in (r, p, h, left, right))
            where = ((p - offs[r]) << 20) | (left << 10) | right
            own = pa.array(r)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), batch["a"][row:last].take(own), batch["b"][row:last].take(own), pa.array(where), pa.array((count << 10) | step)], ["gram", "a", "b", "at", "run"]
            )


def _binary(data: np.ndarray, lens: np.ndarray) -> pa.Array:
    offs = np.zeros(len(lens) + 1, dtype=np.int32)
    np.cumsum(lens, out=offs[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])


def _ragged(starts: np.ndarray, lens: np.ndarray, step: int = 1) -> np.ndarray:
    """starts[0], starts[0] + step, ... lens[0] of them, then those of starts[1], ..."""
    total = int(lens.sum())
    first = np.repeat(np.cumsum(lens) - lens, lens)
    return np.repeat(starts, lens) + step * (np.arange(total) - first)


def _distinct(buf: np.ndarray, p: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts told apart: the first of each kind, and the kind of each. Found by a hash, compared by their bytes."""
    same = span_hash(prefix_hash(buf), p - left, p + right) + mix((left << 10 | right).astype(U64))
    _, first, back = np.unique(same, return_index=True, return_inverse=True)
    more = np.flatnonzero(first[back] != np.arange(len(p)))
    if len(more):
        lens = (left + right)[more]
        ends = np.cumsum(lens)
        like = first[back[more]]
        fits = (left[more] == left[like]) & (right[more] == right[like])
        differs = buf[_ragged((p - left)[more], lens)] != buf[np.minimum(_ragged((p - left)[like], lens), len(buf) - 1)]
        odd = more[np.logical_or.reduceat(differs, ends - lens) | ~fits]
        back[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate((first, odd))
    return first, back


def _emit_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, last, buf, offs in text_buffers(batch["text"]):
            spots = batch["spots"][row:last]
            counts = np.diff(spots.offsets.to_numpy())
            at, run = (spots.flatten().field(c).to_numpy() for c in ("at", "run"))
            if not len(at):
                continue
            r = np.repeat(np.arange(last - row), counts)
            p, left, right = (at >> 20) + offs[r], (at >> 10) & 1023, at & 1023
            first, back = _distinct(buf, p, left, right)
            order = np.argsort(back, kind="stable")
            refs = np.concatenate(([0], np.cumsum(np.bincount(back, minlength=len(first))))).astype(np.int32)
            columns = (batch["a"][row:last].take(pa.array(r[order])), batch["b"][row:last].take(pa.array(r[order])), pa.array(p[order] - offs[r[order]]), pa.array(run[order]))
            lists = [pa.ListArray.from_arrays(pa.array(refs), x) for x in columns]
            p, left, right = p[first], left[first], right[first]
            yield pa.RecordBatch.from_arrays(
                [_binary(buf[_ragged(p, right)], right), _binary(buf[_ragged(p - 1, left, -1)], left), *lists], ["suffix", "before", "a", "b", "p", "run"]
            )


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as rows of big-endian 8-byte keys, filled up with zeros, and the lengths."""
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    lens = np.diff(offs)
    width = max(8, -(-int(lens.max(initial=0)) // 8) * 8)
    out = np.zeros((len(column), width), dtype=np.uint8)
    if lens.any():
        out[np.arange(width) < lens[:, None]] = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]]
    return out.view(">u8").astype(U64), lens


def multikey_quicksort(keys: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings and the LCP of each with the one before it (0 for the first).

    keys: a row of 8-byte characters for each string. A pass partitions every open group by one character;
    strings that are alone in their part are placed, equal ones go on with the next character."""
    n = len(keys)
    order = np.argsort(lens, kind="stable")  # of equal padded strings, the shorter come first
    place = np.arange(n)  # slots that are still open
    group = np.zeros(n, dtype=np.int64)
    for depth in range(keys.shape[1]):
        char = keys[order[place], depth]
        by = np.lexsort((char, group))
        order[place] = order[place][by]
        char, group = char[by], group[by]
        new = np.ones(len(place), dtype=bool)
        new[1:] = (char[1:] != char[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
        open_ = np.bincount(group)[group] > 1
        place, group = place[open_], group[open_]
        if not len(place):
            break
    lcp = np.zeros(n, dtype=np.int64)
    for a in range(1, n, 1 << 16):
        x, y = order[a - 1 : min(n - 1, a - 1 + (1 << 16))], order[a : a + (1 << 16)]
        xor = keys[x] ^ keys[y]
        k = np.argmax(xor != 0, axis=1)
        v = xor[np.arange(len(k)), k]
        zero = sum((v < (U64(1) << U64(8 * b))).astype(np.int64) for b in range(8))
        lcp[a : a + len(k)] = np.minimum(np.where(v == 0, 8 * keys.shape[1], 8 * k + zero), np.minimum(lens[x], lens[y]))
    return order, lcp


def repeated(suffix: pa.Array, before: pa.Array, copies: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each context: how far the span that repeats reaches to the left and the right of the anchor (0, 0: nowhere). And the windows that may repeat
    in the buckets before and after: the context, how many bytes before its anchor the window begins, and whether it repeats here."""
    n = len(suffix)
    ends, n_right = _matrix(suffix)
    heads, n_left = _matrix(before)
    far, near = np.full(n, -1), np.full(n, length + 1)
    own = copies > 1
    far[own], near[own] = n_left[own], (length - n_right)[own]
    sides = []
    for keys, lens in ((heads, n_left), (ends, n_right)):
        order, lcp = multikey_quicksort(keys, lens)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        best = np.empty(n, dtype=np.int64)
        best[order] = np.maximum(lcp, np.append(lcp[1:], 0))
        sides.append((rank, lcp, best))
    (rank_l, lcp_l, best_l), (rank_r, lcp_r, best_r) = sides
    # What a suffix shares with the bucket's first and last one: the least LCP on the way.
    with_first = np.concatenate(([length], np.minimum.accumulate(lcp_r[1:]))) if n else lcp_r
    with_last = np.concatenate((np.minimum.accumulate(lcp_r[:0:-1])[::-1], [length])) if n else lcp_r
    reach = np.minimum(np.maximum(with_first, with_last)[rank_r], n_right)
    # Splitters see SPLIT bytes of a suffix: those that share them may be parted whatever follows.
    reach = np.where(reach >= SPLIT, n_right, reach)
    edge = np.flatnonzero(reach + n_left >= length)
    live = np.flatnonzero(best_l + best_r >= length)
    open_: list[tuple] = []
    for i in range(int(n_left.max(initial=0)) + 1):
        hit = live[:0]
        c = live[(best_l[live] >= i) & (best_r[live] >= length - i) & (n_left[live] >= i) & (n_right[live] >= length - i)]
        if len(c) > 1:
            key = (np.cumsum(lcp_l < i)[rank_l[c]] << 32) | np.cumsum(lcp_r < length - i)[rank_r[c]]
            by = np.argsort(key)
            twin = np.zeros(len(c) + 1, dtype=bool)
            twin[1:-1] = key[by[1:]] == key[by[:-1]]
            hit = c[by[twin[1:] | twin[:-1]]]
            far[hit], near[hit] = np.maximum(far[hit], i), np.minimum(near[hit], i)
        e = edge[(n_left[edge] >= i) & (reach[edge] >= length - i)]
        if len(e):
            here = own.copy()
            here[hit] = True
            open_.append((e, np.full(len(e), i), here[e]))
    found = far >= 0
    at, back, here = (np.concatenate(x) for x in zip(*open_, strict=True)) if open_ else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    return np.where(found, far, 0), np.where(found, length - near, 0), (at, back, here)


def _window_hashes(suffix: pa.Array, before: pa.Array, at: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows that begin back bytes before the anchors of contexts at, and of that number: a window of several anchors is in as many
    contexts, and must not meet itself."""
    of, place = np.unique(at, return_inverse=True)
    texts = [b.as_buffer().to_pybytes()[::-1] + s.as_buffer().to_pybytes() for b, s in zip(before.take(pa.array(of)), suffix.take(pa.array(of)), strict=True)]
    heads = np.array([len(b.as_buffer()) for b in before.take(pa.array(of))], dtype=np.int64)
    ends = np.cumsum([len(t) for t in texts])
    start = (ends - [len(t) for t in texts] + heads)[place] - back
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return tuple(mix(span_hash(prefix_hash(x), start, start + LENGTH) + back.astype(U64)) for x in (buf, buf ^ np.uint8(0xA5)))


def _emit_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that repeat within the bucket (u and v null), and windows that may repeat beyond it: u, v their hashes, span null where they repeat here too."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows).combine_chunks()
    suffix, before, a, b, p, run = (t[c].chunk(0) for c in ("suffix", "before", "a", "b", "p", "run"))
    refs = np.diff(a.offsets.to_numpy())
    r = np.repeat(np.arange(len(refs)), refs)
    at, runs, ids, texts = p.flatten().to_numpy(), run.flatten().to_numpy(), a.flatten(), b.flatten()
    copies = np.bincount(r, weights=runs >> 10, minlength=len(refs)).astype(np.int64)
    # Equal contexts of different batches stay apart here and find each other as neighbours.
    left, right, (context, back, here) = repeated(suffix, before, copies)
    keep = np.flatnonzero(right[r] > 0)
    start, end = at[keep] - left[r[keep]], at[keep] + right[r[keep]] + ((runs[keep] >> 10) - 1) * (runs[keep] & 1023)
    names = ["a", "b", "span", "u", "v"]
    none = pa.nulls(len(keep), pa.int64())
    own = pa.array(keep)
    yield pa.RecordBatch.from_arrays([ids.take(own), texts.take(own), pa.array((start << 20) | (end - start)), none, none], names)
    for k in range(0, len(context), 1 << 18):
        x, i, known = context[k : k + (1 << 18)], back[k : k + (1 << 18)], here[k : k + (1 << 18)]
        u, v = _window_hashes(suffix, before, x, i)
        # Of windows that repeat here, one row of each is enough.
        known_at = np.flatnonzero(known)
        _, first = np.unique(u[known_at], return_index=True)
        rows = np.concatenate((np.flatnonzero(~known), known_at[first]))
        ref = pa.array(a.offsets.to_numpy()[x[rows]] - a.offsets.to_numpy()[0])
        span = pa.array(((at[ref.to_numpy()] - i[rows]) << 20) | LENGTH, mask=known[rows])
        yield pa.RecordBatch.from_arrays([ids.take(ref), texts.take(ref), span, pa.array(u[rows].view(np.int64)), pa.array(v[rows].view(np.int64))], names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            raw, spans = text.as_buffer().to_pybytes(), spans.values
            removed, runs, last, kept = 0, 0, 0, hashlib.sha256()
            parts = []
            if spans is not None and len(spans):
                x = np.sort(spans.to_numpy())
                start, end = x >> 20, np.maximum.accumulate((x >> 20) + (x & 0xFFFFF))
                cut = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
                for s, e in zip(start[cut].tolist(), end[np.append(cut[1:], len(x)) - 1].tolist(), strict=True):
                    parts.append(raw[last:s])
                    removed, runs, last = removed + e - s, runs + 1, e
            parts.append(raw[last:])
            whole = b"".join(parts)
            kept.update(whole)
            rows.append((len(raw), removed, runs, kept.hexdigest(), whole))
        n, removed, runs, digest, whole = zip(*rows, strict=True) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(whole, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Removes every byte of a text that a LENGTH-byte string covers which starts anywhere else too.

    A row for each row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    (lowercase hex) and kept (the remaining bytes, which may end inside a character). A null text is the empty one; a text
    shorter than LENGTH keeps all; equal texts lose all of their bytes, rows that are equal in every column included; a null or repeated doc_id is
    like any other. Other columns of docs are not read."""
    texts = documents_text(docs).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("a"), F.xxhash64("text").alias("b"), F.col("text").cast("binary").alias("text")
    )
    spark = docs.sparkSession
    found = texts.select("a", "b", "text").mapInArrow(lean(_emit_anchors), "gram long, a long, b long, at long, run long")
    # Written, so that the join below meets plain exchanges and Spark can split a frequent gram.
    often = materialize(found.groupBy("gram").agg(F.sum(F.shiftright("run", 10)).alias("n"), F.count("*").alias("rows")).where("n > 1"))
    contexts_at_most = often.agg(F.sum("rows")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-contexts_at_most // BUCKET))
    spots = found.join(often.select("gram"), "gram").groupBy("a", "b").agg(F.collect_set(F.struct("at", "run")).alias("spots"))
    flagged = texts.join(spots, ["a", "b"]).select("a", "b", "text", "spots")
    contexts = flagged.mapInArrow(lean(_emit_contexts), "suffix binary, before binary, a array<long>, b array<long>, p array<long>, run array<long>")
    buckets = contexts.repartitionByRange(parts, F.substring("suffix", 1, SPLIT), F.substring("before", 1, SPLIT_BEFORE), F.col("a")[0])
    told = materialize(buckets.mapInArrow(lean(_emit_spans), "a long, b long, span long, u long, v long"))
    # A window of two buckets repeats; a bucket has it in one row.
    beyond = told.where("u IS NOT NULL")
    twice = beyond.groupBy("u", "v").agg(F.count("*").alias("n")).where("n > 1").select("u", "v")
    across = beyond.where("span IS NOT NULL").join(twice, ["u", "v"], "left_semi").select("a", "b", "span")
    spans = told.where("u IS NULL").select("a", "b", "span").unionByName(across).groupBy("a", "b").agg(F.collect_set("span").alias("spans"))
    spans = materialize(spans)
    # Texts without spans aren't shuffled: a bit for each document with spans goes to all tasks, and what has none there is cut nowhere.
    bits = min(MOST_BITS, max(64, 1 << (16 * spans.count()).bit_length()))
    place = F.xxhash64("a", "b").bitwiseAND(F.lit(bits - 1))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    marks = spans.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    marked = texts.withColumn("word", word).join(F.broadcast(marks), "word", "left")
    own = F.coalesce(F.col("bits"), F.lit(0).cast("long")).bitwiseAND(bit) != 0
    cut = marked.where(own).select("a", "b", "doc_id", "text").join(spans, ["a", "b"], "left").select("doc_id", "text", "spans")
    out = cut.unionByName(marked.where(~own).select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    return out.mapInArrow(lean(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
