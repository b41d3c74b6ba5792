"""Toxic passages by maximum-scoring segments.

A word has several features: itself, and each of its beginnings of PREFIXES bytes that goes on after it. A
feature's weight is its log-odds between toxic and other labelled documents under an informative Dirichlet prior
(document counts, pseudo-counts in proportion to the feature's share); only
features whose z value reaches Z are kept, so the model is small. A word scores the weight of its surest
feature, and -DRIFT without one. The linear scan of Ruzzo and Tompa finds every
maximal passage of positive score. Karlin-Altschul statistics, from the scores of words in clean documents,
give the number of passages that chance would score as high in a text of that
length; the negative logarithms of it, summed over the passages that are significant, are a text's evidence, and a logistic curve over its square root makes the
probability. The curve is fitted on documents scored with weights that other documents have told.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.shared import U64, documents_text, lean, lower_ascii, materialize, mix, prefix_hash, small_batches, span_hash, text_buffers

PREFIXES = (3, 4, 5, 6, 7, 8, 9)
Z = 2.8
#: Least log-odds of a kept feature.
ODDS = 3.0
DRIFT = 0.05
#: Labelled documents that the model is fitted on at most: those whose ids hash lowest. With it the number of features is bounded too: all that pass Z, ODDS and SEEN are kept.
SAMPLE = 10_000
#: Toxic documents that a feature is seen in, at least.
SEEN = 3
#: Passages whose expected number by chance is below this count.
SIGNIFICANT = 1.0
#: Words whose documents the model is fitted on, and those that are held out.
FOLDS, HELD_OUT = 4, 2


def _word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, digits and bytes above 127; for each text the index of its first run."""
    body = (buf >= 128) | ((buf >= 97) & (buf <= 122)) | ((buf >= 48) & (buf <= 57))
    first = np.zeros(len(buf) + 1, dtype=bool)
    first[offs] = True
    before = np.concatenate(([False], body[:-1])) if len(buf) else body
    after = np.concatenate((body[1:], [False])) if len(buf) else body
    starts = np.flatnonzero(body & (~before | first[:-1]))
    ends = np.flatnonzero(body & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the word, hash of the feature) for each kind of feature."""
    prefix = prefix_hash(buf)
    yield np.arange(len(starts)), span_hash(prefix, starts, ends)
    for k in PREFIXES:
        long = np.flatnonzero(ends - starts > k)
        yield long, mix(span_hash(prefix, starts[long], starts[long] + k) + U64(k))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the documents of either label that have a feature."""
    keys, toxic, clean = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    held = []

    def merge() -> None:
        nonlocal keys, toxic, clean
        k, back = np.unique(np.concatenate([keys, *(x[0] for x in held)]), return_inverse=True)
        t, c = (np.zeros(len(k), dtype=np.int64) for _ in range(2))
        np.add.at(t, back, np.concatenate([toxic, *(x[1] for x in held)]))
        np.add.at(c, back, np.concatenate([clean, *(x[2] for x in held)]))
        keys, toxic, clean = k, t, c
        held.clear()

    for batch in batches:
        label = batch["toxic"].to_numpy()
        for row, last, buf, offs in text_buffers(batch["text"]):
            buf = lower_ascii(buf)
            starts, ends, first = _word_spans(buf, offs)
            doc = np.searchsorted(first, np.arange(len(starts)), side="right") - 1
            for word, h in _features(buf, starts, ends):
                d = doc[word]
                by = np.lexsort((h, d))
                h, d = h[by], d[by]
                one = np.ones(len(h), dtype=bool)
                one[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, y = h[one], label[row:last][d[one]].astype(np.int64)
                held.append((h, y, 1 - y))
        if sum(len(x[0]) for x in held) > 1 << 20:
            merge()
    if held:
        merge()
    for a in range(0, len(keys), 1 << 16):
        s = slice(a, a + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(keys[s].view(np.int64)), pa.array(toxic[s]), pa.array(clean[s])], ["feature", "toxic", "clean"])


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (first, last + 1, score), by the linear scan of Ruzzo and Tompa."""
    kept: list[list] = []  # first, end, sum before it, sum after it
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        seg = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= seg[2]:
                j -= 1
            if j < 0 or kept[j][3] >= seg[3]:
                kept.append(seg)
                break
            seg = [kept[j][0], seg[1], kept[j][2], seg[3]]
            del kept[j:]
    return [(a, b, after - before) for a, b, before, after in kept]


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of the kept features
    weights: np.ndarray
    z: np.ndarray
    steep: float = 1.0  # lambda of Karlin and Altschul
    often: float = 1e-3  # of words that score, in place of K
    intercept: float = -2.0
    slope: float = 0.0

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << 16, dtype=bool)
        self.sieve[(self.keys >> U64(48)).astype(np.int64)] = True

    def word_scores(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, best = np.full(len(starts), -DRIFT), np.zeros(len(starts))
        if not len(self.keys):
            return out
        for word, h in _features(buf, starts, ends):
            maybe = np.flatnonzero(self.sieve[(h >> U64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == h[maybe]
            w, at = word[maybe[hit]], at[hit]
            surer = self.z[at] > best[w]
            out[w[surer]], best[w[surer]] = self.weights[at[surer]], self.z[at[surer]]
        return out

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(first word, last + 1, score, expected number by chance) of the significant passages."""
        high = np.flatnonzero(scores > 0)
        if not len(high):
            return []
        # Between two words of positive score all score -DRIFT: one entry stands for them.
        runs, at = [], []
        last = -1
        for i in high.tolist():
            if runs and i > last + 1:
                runs.append(-DRIFT * (i - last - 1))
                at.append(-1)
            runs.append(float(scores[i]))
            at.append(i)
            last = i
        out = []
        for a, b, s in maximal_segments(runs):
            chance = self.often * len(scores) * float(np.exp(-self.steep * s))
            if chance < SIGNIFICANT:
                out.append((at[a], at[b - 1] + 1, s, chance))
        return out

    def evidence(self, passages: list) -> float:
        """The square root keeps texts of very much evidence from telling the curve where there is little."""
        return float(np.sqrt(sum(-np.log(max(p[3], 1e-300)) for p in passages)))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * evidence, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a small ridge."""
    a = np.stack([np.ones(len(x)), x], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (y - p) - 1e-2 * beta
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, grad), -5, 5)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


def held_out(doc_id: str = "doc_id"):
    """True for the fold whose labels are never learnt: crc32 of the id's text modulo FOLDS."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from the labelled documents outside the held-out fold, SAMPLE of them at most (a bounded
    sample; its ids and labels are broadcast). Null labels and ids are left out."""
    texts = documents_text(docs)
    sample = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # Written once, as it is read several times: SAMPLE documents at most.
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    known = materialize(texts.join(F.broadcast(sample), "doc_id").select("text", "toxic", half.alias("half")))
    model = _weighed(known)
    if not len(model.keys):
        return model
    # Either half is scored with weights of the other one, so that no document tells the curve what it has told the weights.
    halves = known.groupBy("half").agg(F.min("toxic").alias("a"), F.max("toxic").alias("b")).where("a < b").count()
    pairs = [(_weighed(known.where(F.col("half") != h)), known.where(F.col("half") == h)) for h in (0, 1)] if halves == 2 else [(model, known)]
    seen = [told.select("text", "toxic").mapInArrow(lean(_evidence(part)), "toxic int, evidence double").toPandas() for part, told in pairs]
    x, y = (np.concatenate([s[c].to_numpy(float) for s in seen]) for c in ("evidence", "toxic"))
    model.intercept, model.slope = _logistic(x, y)
    return model


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for toxic, row_scores in _scored(model, batches, "toxic"):
            yield pa.RecordBatch.from_arrays([toxic, pa.array([model.evidence(model.passages(s)) for s in row_scores], pa.float64())], ["toxic", "evidence"])

    return run


def _weighed(known: DataFrame) -> Model:
    """The features of known (text, toxic) that count, their weights, and what chance makes of them in clean documents."""
    known = known.select("text", "toxic")
    counts = known.mapInArrow(lean(_count), "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = known.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    n1, n0 = float(total["t"] or 0), float((total["n"] or 0) - (total["t"] or 0))
    empty = np.zeros(0)
    if not n1 or not n0:
        return Model(empty.astype(U64), empty, empty, intercept=-2.0 if not n1 else 0.0)
    # Pseudo-counts: half a document of either label at least, else the feature's share of ten.
    share = (F.col("toxic") + F.col("clean")) / F.lit(n1 + n0)
    prior1, prior0 = (F.greatest(F.lit(0.5), share * 10 * n / (n1 + n0)) for n in (n1, n0))
    y1, y0 = F.col("toxic") + prior1, F.col("clean") + prior0
    odds = F.log(y1 / (F.lit(n1 + 10) - y1 + 1)) - F.log(y0 / (F.lit(n0 + 10) - y0 + 1))
    kept = counts.where(F.col("toxic") >= SEEN).select("feature", odds.alias("odds"), (odds / F.sqrt(1 / y1 + 1 / y0)).alias("z"))
    rows = sorted((int(r["feature"]) % (1 << 64), r["odds"], r["z"]) for r in kept.where((F.col("z") >= Z) & (F.col("odds") >= ODDS)).collect())
    model = Model(np.array([r[0] for r in rows], dtype=U64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for toxic, row_scores in _scored(model, batches, "toxic"):
            high = [s[s > 0] for s in row_scores]
            yield pa.RecordBatch.from_arrays([toxic, pa.array([len(s) for s in row_scores], pa.int64()), pa.array([h.tolist() for h in high], pa.list_(pa.float64()))], ["toxic", "n", "high"])

    clean = known.mapInArrow(lean(profile), "toxic int, n long, high array<double>").where("toxic = 0")
    words = clean.agg(F.sum("n")).first()[0] or 1
    by_score = clean.select(F.explode("high").alias("s")).groupBy(F.round("s", 2).alias("s")).count().collect()
    s, n = np.array([r["s"] for r in by_score] or [1.0]), np.array([r["count"] for r in by_score] or [0.5], dtype=float)
    # lambda: the positive root of sum(p * exp(lambda * s)) = 1, over clean words.
    p = n / max(words, n.sum() + 1)
    lo, hi = 1e-3, 5.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * s)).sum() + (1 - p.sum()) * np.exp(-mid * DRIFT) < 1 else (lo, mid)
    model.steep, model.often = lo, float(p.sum())
    return model


def _scored(model: Model, batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        for row, last, buf, offs in text_buffers(batch["text"]):
            buf = lower_ascii(buf)
            starts, ends, first = _word_spans(buf, offs)
            scores = model.word_scores(buf, starts, ends)
            yield batch[key][row:last], [scores[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def toxic_passages(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Scores whole texts. A row for each row of docs: doc_id, score (0 to 1), predicted (1 from the threshold on),
    passages (first word, last word + 1, score, expected number by chance). A null or blank text has no passage and gets the score
    of texts without one. Only text is read; other columns don't matter."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))
        for ids, row_scores in _scored(model, batches, "doc_id"):
            found = [model.passages(s) for s in row_scores]
            p = model.probability(np.array([model.evidence(f) for f in found]))
            spans = pa.array([[dict(zip(("first", "end", "score", "chance"), x, strict=True)) for x in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([ids, pa.array(p), pa.array((p >= threshold).astype(np.int32)), spans], ["doc_id", "score", "predicted", "passages"])

    return documents_text(docs).mapInArrow(lean(score), "doc_id long, score double, predicted int, passages array<struct<first: long, end: long, score: double, chance: double>>")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, whole and with all their columns, whose score is below the threshold. A null text is scored as the empty one."""
    small_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            text = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("text"))] * 2, ["text", "doc_id"])
            for _, row_scores in _scored(model, [text], "doc_id"):
                marks += [model.evidence(model.passages(s)) for s in row_scores]
            if marks:
                yield batch.filter(pa.array(model.probability(np.array(marks)) < threshold))

    return docs.mapInArrow(lean(keep), docs.schema)
