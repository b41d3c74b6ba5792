"""Runs of repeated words, found on harmonic grids.

A run is a stretch of consecutive words with smallest period p, TIMES * p words long at least, that neither neighbour extends. For every period p the words at
jp, (j + 1)p, ... are compared: a run holds TIMES grid points in a row, which are all equal, so the grids of all periods together have n/1 + n/2 + ... points and miss none.
Grid points that pass are extended to both sides by comparing chunks of the word array with itself p words on. Periods are tried from small to large. TIMES grid points that lie in a
found run of smaller period are passed over: two periods in so long an overlap have a common divisor as period there (Fine and Wilf), so they'd give the same run again.

Words are numbered exactly (by a dictionary of their bytes), so nothing is told by a hash. Texts of a batch are probed side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm.shared import documents_text, lean, text_buffers, words

#: A run has so many times its period, and so many words, at least.
TIMES = 4
LEAST = 6
#: Grid points probed at a time, about; a period of one text isn't split.
PROBED = 200_000
_CHUNK = 32
_SCHEMA = "doc_id {}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _same_ahead(codes: np.ndarray, a: int, b: int, end: int) -> int:
    """How many words from a on equal those from b on, before end (a < b)."""
    done, size = 0, _CHUNK
    while b + done < end:
        n = min(size, end - b - done)
        differ = codes[a + done : a + done + n] != codes[b + done : b + done + n]
        if differ.any():
            return done + int(differ.argmax())
        done, size = done + n, size * 2
    return done


def _same_behind(codes: np.ndarray, a: int, b: int, start: int) -> int:
    """How many words before a equal those before b, not before start (a < b)."""
    done, size = 0, _CHUNK
    while a - done > start:
        n = min(size, a - done - start)
        differ = (codes[a - done - n : a - done] != codes[b - done - n : b - done])[::-1]
        if differ.any():
            return done + int(differ.argmax())
        done, size = done + n, size * 2
    return done


def runs_of(codes: np.ndarray, first: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs in texts of word numbers that stand one after the other, text i from first[i] to first[i + 1]; by period."""
    if times < 3:
        raise ValueError("with less than three periods, a run may be hidden by one of a smaller period that overlaps it")
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    sizes, begins = sizes[order], first[:-1][order]
    total = np.concatenate(([0], np.cumsum(sizes)))
    reach = np.zeros(len(codes), dtype=np.int64)  # the furthest end of a found run over each word
    found, p = [], 1
    last = int(sizes[0]) // times if len(sizes) else 0
    while p <= last:
        long = int(np.searchsorted(-sizes, -max(least, times * p), side="right"))  # texts long enough for this period, the longest first
        if not long:
            p += 1  # periods below least / times need longer texts than their own multiples
            continue
        upto = min(last, p + int(PROBED * p // total[long]))
        some = np.arange(p, upto + 1)
        fit = np.searchsorted(-sizes, -np.maximum(least, times * some), side="right")
        per = np.repeat(some, fit)
        text = np.arange(len(per)) - np.repeat(np.cumsum(fit) - fit, fit)
        points = (sizes[text] - 1 - (times - 1) * per) // per + 1
        at = np.repeat(begins[text] - per * (np.cumsum(points) - points), points)
        per = np.repeat(per, points)
        at += per * np.arange(len(at))
        for k in range(1, times):
            same = codes[at + (k - 1) * per] == codes[at + k * per]
            at, per = at[same], per[same]
        fresh = reach[at] <= at + (times - 1) * per
        at, per = at[fresh], per[fresh]
        for q in np.unique(per).tolist():
            seeds = np.sort(at[per == q])
            while len(seeds := seeds[reach[seeds] <= seeds + (times - 1) * q]):
                x = int(seeds[0])
                own = int(np.searchsorted(first, x, side="right")) - 1
                start = x - _same_behind(codes, x, x + q, int(first[own]))
                end = x + q + _same_ahead(codes, x, x + q, int(first[own + 1]))
                # A seed whose points reach beyond the stretch leaves it to one whose points all lie in it.
                if end - start >= max(least, times * q) and end > x + (times - 1) * q:
                    found.append((start, end, q))
                    np.maximum(reach[start:end], end, out=reach[start:end])
                seeds = seeds[np.searchsorted(seeds, max(x + 1, end - (times - 1) * q)) :]  # the others of this stretch would give it again
        p = upto + 1
    return found


def _gather(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    return data[np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))]


def _found(times: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for row, last, buf, offs in text_buffers(batch["text"]):
                starts, ends, first = words(buf, offs)
                lens = ends - starts
                # Every word with one space behind it, and its number.
                spaced = np.concatenate(([0], np.cumsum(lens + 1)))
                data = np.full(int(spaced[-1]), 32, dtype=np.uint8)
                data[np.repeat(spaced[:-1], lens) + np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)] = _gather(buf, starts, lens)
                codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(spaced), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy()
                found = np.array(runs_of(codes, first, times, least), dtype=np.int64).reshape(-1, 3)
                found = found[np.lexsort((found[:, 2], found[:, 0]))]
                own = np.searchsorted(first, found[:, 0], side="right") - 1
                drop = np.zeros(len(codes) + 1, dtype=np.int64)
                np.add.at(drop, found[:, 0] + found[:, 2], 1)
                np.add.at(drop, found[:, 1], -1)
                keep = np.cumsum(drop[:-1]) == 0
                kept = data if keep.all() else _gather(data, spaced[:-1][keep], lens[keep] + 1)
                to = np.concatenate(([0], np.cumsum(np.where(keep, lens + 1, 0))))[first]
                # Texts lie one after the other with a space behind each that isn't empty: their ends are one less.
                solid = np.ones(len(kept), dtype=bool)
                solid[to[1:][np.diff(to) > 0] - 1] = False
                text_at = to - np.concatenate(([0], np.cumsum(np.diff(to) > 0)))
                texts = pa.LargeStringArray.from_buffers(last - row, pa.py_buffer(text_at), pa.py_buffer(kept[solid]))
                counts = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=last - row))))
                fields = [pa.array(x) for x in (found[:, 0] - first[own], found[:, 1] - found[:, 0], found[:, 2])]
                lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"])).cast(kind)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][row:last], pa.array(np.diff(first)), lists, texts.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """The runs of every whole text: doc_id, n_words, runs (start, length and period in words, by start, then period) and collapsed, the words that no run holds after its first
    period, joined by one space.

    A null or blank text has no words, no runs and an empty collapsed text. Every row is a text of its own, ids that repeat or are null included; no rows give none. Other columns are not
    read. No shuffle: a worker holds a chunk of texts, or one longer text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return documents_text(docs).mapInArrow(lean(_found(times, least)), _SCHEMA.format(id_type))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, where a tenth of the texts (by the checksum h of the id: h % 10 = 0, g = h / 10) are made periodic from word a on: a = g % n, the period
    1 + (n - a) / (3 + g % 8), n the number of words. A null id has no checksum, and its text stays; so does a null text."""
    h = F.crc32(F.col("doc_id").cast("string"))
    w = F.filter(F.split("text", r"[ \x09-\x0D]+"), lambda x: x != "")

    def periodic(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # The words are bound to a variable, so that they are split once and not once a word.
    made = F.transform(F.array(w), lambda w: F.when(F.size(w) > 0, periodic(w)))[0]
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), F.coalesce(made, "text")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The runs told by their number, the one with most periods (ties: the first, then the shortest period; nulls without runs) and checksums."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", F.aggregate("runs", none, more)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
