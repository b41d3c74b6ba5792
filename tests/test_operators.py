import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorewell.operators import dedup, kg, knn, openie, search, selection
from lorewell.operators.graph import DiGraph
from lorewell.operators.knn import top_k
from lorewell.operators.pagerank import pagerank, prepared, ranked

DOCS = "idx string, passage string, extracted_entities array<string>, extracted_triples array<array<string>>, pos long"


def _docs(spark):
    rows = [
        ("a", "pa", ["x", None, " ", "　", "他", "x", "y", "我"], [["x", "r", "y"], ["x", "r", "y"], ["x", "r"], ["", "r", "y"], ["x", None, "y"], ["他", "r", "y"]], 0),
        ("b", "pb", [], [["x", "r", "x"]], 1),
        ("c", "pc", None, None, 2),
        ("a", "pa2", ["z z"], [["z z", "r", "q"]], 3),
    ]
    return spark.createDataFrame(rows, DOCS)


def test_validation(spark):
    rows = openie.validated(_docs(spark)).orderBy("pos").collect()
    assert [r["extracted_entities"] for r in rows] == [["x", "y", "我"], [], [], ["z z"]]
    assert [r["extracted_triples"] for r in rows] == [[["x", "r", "y"], ["他", "r", "y"]], [["x", "r", "x"]], [], [["z z", "r", "q"]]]
    assert openie.validated(_docs(spark), True).orderBy("pos").first()["extracted_triples"] == [["x", "r", "y"]]


def test_projections_completeness_and_stats(spark):
    docs = openie.validated(_docs(spark))
    assert {(r["idx"], r["passage"]) for r in openie.passages(docs).collect()} == {("a", "pa2"), ("b", "pb"), ("c", "pc")}
    assert openie.entities(docs).count() == 4 and openie.triples(docs).count() == 4
    assert [r["idx"] for r in openie.incomplete(docs).orderBy("idx").collect()] == ["b", "c"]
    assert openie.complete(docs).count() == 2
    with pytest.raises(Exception, match="without entities or triples"):
        openie.complete(docs, strict=True).collect()
    stats = openie.corpus_stats(docs).first()
    assert (stats["avg_ent_chars"], stats["avg_ent_words"]) == (1.5, 1.25)
    assert openie.corpus_stats(docs.limit(0)).first()["avg_ent_chars"] is None


def test_answers(spark):
    df = spark.createDataFrame([('Sure: ["a", "他", null, "b"] done',), ("[]",), ('["a", "b',), ("no list",)], "t string")
    assert [r[0] for r in df.select(openie.entity_answer("t")).collect()] == [["a", "b"], None, ["a"], None]
    df = spark.createDataFrame([('x [["a","b","c"]]',), ('[["a","b","c"],["d","",""]]',), ('[["a","b"]]',)], "t string")
    assert [r[0] for r in df.select(openie.triple_answer("t")).collect()] == [[["a", "b", "c"]], None, None]


def test_dedup(spark):
    rows = spark.createDataFrame([("t", 3), ("u", 1), ("t", 2)], "text string, pos long")
    first = dedup.keep_first(rows, "text", "pos")
    assert sorted((r["passage"], r["pos"]) for r in first.collect()) == [("t", 2), ("u", 1)]
    h = lambda *x: spark.createDataFrame([(v,) for v in x], "pg_hash string")
    assert {r[0] for r in dedup.unseen(h("a", "b", "c"), h("a", "b"), h("b", "c")).collect()} == {"a", "c"}
    assert {r[0] for r in dedup.missing_vectors(h("a", "b", "b"), h("a")).collect()} == {"b"}
    assert dedup.insert_absent(h("a"), h("a", "b", "b"), "pg_hash").count() == 2


def test_golden_graph(spark):
    """Four triples of one subject in one passage: eight entity edges of weight 1, one of weight 4 to the passage."""
    t = spark.createDataFrame([("p", "s", "r", f"o{i}") for i in range(4)], "idx string, subj string, pred string, obj string")
    edges = {(r["src"], r["dst"]): r["weight"] for r in kg.entity_edges(t, F.col).collect()}
    assert edges == {(a, b): 1.0 for i in range(4) for a, b in (("s", f"o{i}"), (f"o{i}", "s"))}
    assert [tuple(r) for r in kg.passage_edges(t, of=F.col).collect()] == [("s", "paragraph-p", 4.0)]
    assert kg.passage_edges(t, True, F.col).count() == 5
    assert {tuple(r) for r in kg.entity_counts(t, F.col).collect()} == {(x, 1.0) for x in ("s", "o0", "o1", "o2", "o3")}
    assert kg.relations(t).count() == 4


def test_loops_make_passage_edges_alone(spark):
    t = spark.createDataFrame([("p", "s", "r", "s")], "idx string, subj string, pred string, obj string")
    assert kg.entity_edges(t).count() == 0 and kg.entity_counts(t).count() == 0 and kg.passage_edges(t).count() == 1


def test_upsert_and_synonym_merge(spark):
    e = lambda *rows: spark.createDataFrame(rows, "src string, dst string, weight double")
    none = e(("x", "x", 0.0)).limit(0).withColumn("create_time", F.lit(0.0)).withColumn("update_time", F.lit(0.0))
    once = kg.upserted(none, e(("a", "b", 1.0)), 1.0)
    twice = kg.upserted(once, e(("a", "b", 2.0), ("b", "c", 1.0)), 2.0)
    assert {tuple(r) for r in twice.collect()} == {("a", "b", 3.0, 1.0, 2.0), ("b", "c", 1.0, 2.0, 2.0)}
    rel, syn = e(("a", "b", 2.0), ("c", "d", 1.0)), e(("a", "b", 0.5), ("e", "f", 0.9))
    assert {tuple(r) for r in kg.with_synonyms(rel, syn).collect()} == {("a", "b", 0.5), ("c", "d", 1.0), ("e", "f", 0.9)}
    assert {tuple(r) for r in kg.with_synonyms(rel, syn, "add").collect()} == {("a", "b", 2.5), ("c", "d", 1.0), ("e", "f", 0.9)}


def test_new_nodes(spark):
    edges = spark.createDataFrame([("entity-1", "paragraph-2"), ("entity-3", "entity-1")], "src string, dst string")
    nodes = spark.createDataFrame([("entity-3",)], "id string")
    texts = spark.createDataFrame([("entity-1", "a long name"), ("paragraph-2", "line\nand more"), ("entity-3", "x")], "id string, str string")
    assert {tuple(r) for r in kg.new_nodes(edges, nodes, texts, 5.0).collect()} == {("entity-1", "a long name", "ent", 5.0), ("paragraph-2", "line and...", "pg", 5.0)}


def test_leaders_are_the_greedy_ones(spark):
    rng = random.Random(5)
    for _ in range(6):
        names = [f"n{i:02d}" for i in range(12)]
        hits = {(a, b) for a in names for b in names if a != b and rng.random() < 0.18}
        covered, kept = set(), set()
        for a in sorted({a for a, _ in hits}):
            if a not in covered:
                own = {(x, b) for x, b in hits if x == a}
                kept |= own
                covered |= {b for _, b in own}
        got = kg.leader_hits(spark.createDataFrame([(a, b, 1.0) for a, b in hits], "a string, b string, score double"))
        assert {(r["a"], r["b"]) for r in got.collect()} == kept


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    v[7] = 0
    df = spark.createDataFrame([(f"{i:02d}", x.tolist()) for i, x in enumerate(v)], "id string, v array<double>")
    got = {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in top_k(df.toDF("qid", "v"), df, 4, drop_self=True).collect()}
    n = np.linalg.norm(v, axis=1)
    u = v / np.where(n > 0, n, 1)[:, None]
    for i in range(60):
        best = sorted(((-round(float(u[i] @ u[j]), 9), f"{j:02d}") for j in range(60) if j != i))[:4]
        assert [got[f"{i:02d}", k + 1][0] for k in range(4)] == [b for _, b in best]
    raw = top_k(df.toDF("qid", "v").limit(1), df, 1, raw_query=True).first()
    assert raw["score"] == pytest.approx(float(n[0]), abs=1e-6) or raw["score"] >= float(n[0]) - 1e-6
    assert top_k(df.toDF("qid", "v").limit(0), df, 3).count() == 0


def test_neighbours_of_odd_vectors(spark):
    df = lambda rows: spark.createDataFrame(rows, "id string, v array<double>")
    v = df([("a", [1.0, 0.0]), ("b", None), ("c", [1.0, None]), ("d", [0.0, 1.0])])
    got = top_k(v.toDF("qid", "v"), v, 3).collect()
    assert sorted((r["qid"], r["id"], r["score"]) for r in got) == [("a", "a", 1.0), ("a", "d", 0.0), ("d", "a", 0.0), ("d", "d", 1.0)]
    with pytest.raises(Exception, match="several lengths|mismatch"):
        top_k(v.toDF("qid", "v"), v.union(df([("e", [1.0])])), 2).collect()


def test_ties_stay_k(spark, monkeypatch):
    out = []
    search = knn._searcher(3, 9)
    many = pa.table({"q_ids": pa.array([["q"]]), "c_ids": pa.array([[f"{i:04d}" for i in range(3000)]]), "q_v": pa.array([np.ones(2).tobytes()]), "c_v": pa.array([np.ones((3000, 2)).tobytes()])})
    out = pa.Table.from_batches(list(search(iter(many.to_batches())))).to_pydict()
    assert out["id"] == ["0000", "0001", "0002"]
    monkeypatch.setattr(knn, "BLOCK", 40)
    monkeypatch.setattr(knn, "QUERIES", 9)
    df = spark.createDataFrame([(f"{i:03d}", [1.0, float(i % 2)]) for i in range(200)], "id string, v array<double>")
    got = top_k(df.toDF("qid", "v"), df, 2, drop_self=True).where("qid = '000' or qid = '003'").collect()
    assert sorted((r["qid"], r["rank"], r["id"]) for r in got) == [("000", 1, "002"), ("000", 2, "004"), ("003", 1, "001"), ("003", 2, "005")]


def test_blocks_of_a_cell_come_to_a_worker_a_few_at_a_time(spark, monkeypatch):
    """Else a batch holds all of a task's cells, up to 64 MB of them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    for key, value in (("BLOCK", 256), ("QUERIES", 64), ("BATCH_BYTES", 200_000)):
        monkeypatch.setattr(knn, key, value, raising=False)
    real = knn._searcher

    def searcher(k, places):
        def search(batches):
            from pyarrow import RecordBatch

            for b in batches:  # 256 vectors of 64 numbers are 131 KB
                yield RecordBatch.from_pydict({"qid": [f"{b.nbytes}"], "id": [""], "score": [0.0]})

        return search

    v = spark.range(3000).select(F.col("id").cast("string"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.rand(3) - 0.5 + i * 0).alias("v"))
    try:
        monkeypatch.setattr(knn, "_searcher", searcher)
        sizes = [int(r["qid"]) for r in top_k(v.toDF("qid", "v"), v, 3).collect()]
        assert max(sizes) < 500_000 < 3_000_000 < sum(sizes)
        monkeypatch.setattr(knn, "_searcher", real)
        monkeypatch.setattr(knn, "BLOCK", 4096)
        rows = lambda: {tuple(r) for r in top_k(v.toDF("qid", "v"), v, 3).collect()}
        small = rows()
        monkeypatch.setattr(knn, "BATCH_BYTES", 64 << 20)
        spark.conf.set(name, "64MB")
        assert len(small) == 9000 and rows() == small
        assert spark.conf.get(name) == "64MB"
        monkeypatch.setattr(knn, "BATCH_BYTES", 4 << 20)
        top_k(v.toDF("qid", "v"), v, 3)
        assert spark.conf.get(name) == str(4 << 20)
        spark.conf.set(name, "1m")
        top_k(v.toDF("qid", "v"), v, 3)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, old)


def test_a_search_holds_few_scores():
    rng = np.random.default_rng(2)
    c, q = rng.normal(size=(8192, 8)), rng.normal(size=(256, 8))
    names = lambda n: pa.array([[f"{i:04d}" for i in range(n)]])
    rows = pa.table({"q_ids": names(256), "c_ids": names(8192), "q_v": pa.array([q.tobytes()]), "c_v": pa.array([c.tobytes()])}).to_batches()
    search = knn._searcher(5, 9)
    tracemalloc.start()
    try:
        out = pa.Table.from_batches(list(search(iter(rows)))).to_pydict()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    want = np.argsort(-np.round(q @ c.T, 9), axis=1, kind="stable")[:, :5]
    assert {(a, b) for a, b in zip(out["qid"], out["id"])} == {(f"{i:04d}", f"{j:04d}") for i in range(256) for j in want[i]}
    assert peak < 16e6  # 128 queries' scores alone are 8.4 MB, and there were five such arrays


def _dynamic(scores, jmp=0.5, var=1.0):
    if not scores:
        return set()
    low, high = min(scores.values()), max(scores.values())
    if low == high:
        return set(scores)
    norm = {k: (s - low) / (high - low) for k, s in scores.items()}
    mean = sum(norm.values()) / len(norm)
    bar = jmp + (1 - jmp) * (mean + var * sum((x - mean) ** 2 for x in norm.values()) / len(norm))
    return {k for k, x in norm.items() if x > bar}


def test_dynamic_selection(spark):
    rng = random.Random(2)
    cases = {f"q{i}": {f"h{j}": round(rng.random(), 3) for j in range(rng.randint(1, 12))} for i in range(30)} | {"flat": {"a": 0.4, "b": 0.4}, "one": {"a": 0.1}}
    hits = spark.createDataFrame([(q, h, s) for q, c in cases.items() for h, s in c.items()], "qid string, id string, score double")
    got = {}
    for r in selection.dynamic_top_k(hits).collect():
        got.setdefault(r["qid"], set()).add(r["id"])
    assert got == {q: _dynamic(c) for q, c in cases.items()}
    assert selection.dynamic_top_k(hits.limit(0)).count() == 0
    gap = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.9), ("q", "c", 0.1)], "qid string, id string, score double")
    assert {r["id"] for r in selection.dynamic_top_k(gap, jump="gap").collect()} == {"a", "b"}
    assert {r["qid"] for r in selection.gated(hits, 0.99).collect()} == {q for q, c in cases.items() if max(c.values()) >= 0.99}
    asked = hits.select("qid").distinct().unionByName(spark.createDataFrame([("none",)], "qid string"))
    assert selection.activation(hits.limit(0).withColumn("norm", F.lit(1.0)), asked).where("activation <> 0").count() == 0


def _dense(n, edges, p, d=None, init=None, alpha=0.85, rounds=40):
    t, out = np.zeros((n, n)), np.zeros(n)
    for s, _, w in edges:
        out[s] += w
    for s, e, w in edges:
        if out[s] > 0:
            t[e, s] += w / out[s]
    d, r = p if d is None else d, np.full(n, 1 / n) if init is None else init
    for _ in range(rounds):
        r = alpha * r[out == 0].sum() * d + (1 - alpha) * p + alpha * t @ r
    return r


def test_pagerank_against_a_dense_model(spark):
    rng = np.random.default_rng(4)
    n = 30
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (90, 2)) if a != b and a > 3}  # 0 to 3 are dangling
    edges = [(a, b, float(rng.random())) for a, b in pairs] + [(3, 5, 0.0)]  # weighs nothing: dangling as well
    nodes = spark.createDataFrame([(str(i),) for i in range(n)], "id string")
    e = spark.createDataFrame([(str(a), str(b), w) for a, b, w in edges], "src string, dst string, weight double")
    q = spark.createDataFrame([("u",), ("p",)], "qid string")
    w = {i: float(rng.random()) for i in range(0, n, 4)}
    per = spark.createDataFrame([("p", str(i), x) for i, x in w.items()], "qid string, id string, weight double")
    p = np.array([w.get(i, 0.0) for i in range(n)]) / sum(w.values())
    got = pagerank(nodes, e, q, per, max_iter=12, tol=None).toPandas()
    for name, vec in (("u", np.full(n, 1 / n)), ("p", p)):
        x = got[got.qid == name].set_index("id").score
        assert np.allclose([x[str(i)] for i in range(n)], _dense(n, edges, vec, rounds=12), atol=1e-12)
        assert x.sum() == pytest.approx(1.0)
    stopped = pagerank(nodes, e, q, per, tol=1e-6).toPandas()
    assert np.abs(stopped[stopped.qid == "p"].set_index("id").score[[str(i) for i in range(n)]].to_numpy() - _dense(n, edges, p, rounds=100)).sum() < n * 1e-5
    with pytest.raises(Exception, match="negative"):
        pagerank(nodes, e.withColumn("weight", F.lit(-1.0)), q, max_iter=1)
    assert pagerank(nodes.limit(0), e.limit(0), q).count() == 0


def test_entity_and_passage_weights(spark):
    scores = spark.createDataFrame([("q", "a", 0.2, 1.0), ("q", "b", 0.9, 3.0), ("q", "c", 0.5, 2.0), ("r", "a", 0.1, 5.0)], "qid string, id string, mean double, weight double")
    got = {(r["qid"], r["id"]): r["weight"] for r in search.scaled_weights(scores, 0.05).collect()}
    assert got == {("q", "a"): 0.05, ("q", "b"): 1.0, ("q", "c"): pytest.approx(0.525), ("r", "a"): 1.0}
    assert {(r["qid"], r["id"]) for r in search.best_entities(scores, 2).collect()} == {("q", "b"), ("q", "c"), ("r", "a")}
    assert {(r["qid"], r["id"]) for r in search.best_entities(scores, 2, True).collect()} == {("r", "a")}
    hits = spark.createDataFrame([("q", "x", 0.8), ("q", "y", 0.4), ("r", "x", 0.5)], "qid string, id string, score double")
    got = {(r["qid"], r["id"]): r["weight"] for r in search.passage_weights(hits, 0.05).collect()}
    assert got == {("q", "x"): pytest.approx(0.05), ("q", "y"): 0.0, ("r", "x"): 0.05}


def test_graph_store(spark):
    g = DiGraph.empty(spark).add_nodes([("a", {"t": 1}), ("b", {})])
    g = g.add_edges([("a", "b", {"weight": 2}), ("b", "c", {})])
    assert "c" in g and ("a", "b") in g and ("b", "a") not in g and g["a"] == {"t": 1} and g["b", "c"]["weight"] == 0.0
    for bad in (lambda: g.add_nodes([("a", {})]), lambda: g.add_nodes([("n", {}), ("n", {})]), lambda: g.add_edges([("a", "b", {})]), lambda: g.update_nodes([("z", {})]), lambda: g.update_edges([("a", "c", {})]),
                lambda: g.remove_nodes(["z"]), lambda: g.remove_edges([("c", "a")]), lambda: g["z"], lambda: g.without("z")):
        with pytest.raises(KeyError):
            bad()
    with pytest.raises(TypeError):
        g[1]
    assert g.update_nodes([("a", {"t": 2})])["a"] == {"t": 2} and g.update_edges([("a", "b", {"weight": 5.0})])["a", "b"]["weight"] == 5.0
    less = g.without("b")
    assert less.edges.count() == 0 and less.nodes.count() == 2 and g.without(("a", "b")).edges.count() == 1
    assert {tuple(r) for r in g.out_degrees().collect()} == {("a", 1), ("b", 1)} and g.clear().nodes.count() == 0


def test_the_largest_gap_is_found_by_ranges(spark, monkeypatch):
    """Against sorted neighbours, with so few ranges that they are cut again and again."""
    monkeypatch.setattr(selection, "CELLS", 12)
    rng = random.Random(8)
    cases = {f"q{i}": [0.0, 1.0] + [rng.choice([rng.random(), round(rng.random(), 2), rng.random() ** 9]) for _ in range(rng.randrange(0, 60))] for i in range(25)}
    cases["even"] = [i / 8 for i in range(9)]
    norms = spark.createDataFrame([(q, x) for q, c in cases.items() for x in c], "qid string, norm double").repartition(3)
    got = {r["qid"]: r["_top"] for r in selection.below_largest_gap(norms).collect()}

    def plain(c):
        c = sorted(c, reverse=True)
        return max((a - b, b) for a, b in zip(c, c[1:]))[1]

    assert got == {q: plain(c) for q, c in cases.items()}


def test_selection_has_no_window_over_a_ranking(spark):
    hits = spark.range(500).selectExpr("string(id % 2) AS qid", "string(id) AS id", "rand(3) AS score")
    for kept in (selection.dynamic_top_k(hits), selection.gated(hits, 0.2), selection.scaled(hits), selection.dynamic_top_k(hits, jump="gap")):
        assert "Window" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_transitions_that_grow(spark):
    """Imports add tables; ranks are those of the whole graph; a dangling node that gets edges has the tables made anew."""
    rng = np.random.default_rng(9)
    names = lambda rows: spark.createDataFrame([(str(a), str(b), w) for a, b, w in rows], "src string, dst string, weight double")
    ids = lambda some: spark.createDataFrame([(str(i),) for i in some], "id string")
    first = [(int(a), int(b), float(rng.random())) for a, b in rng.integers(0, 12, (40, 2)) if a != b] + [(a, 20 + a, 1.0) for a in range(5)]
    more = [(int(a), int(b), float(rng.random())) for a, b in rng.integers(0, 16, (40, 2)) if a != b] + [(a, 24 + a, 2.0) for a in range(6)] + [first[0]]
    one = prepared(ids([*range(12), *range(20, 25)]), names(first))
    both = prepared(ids([*range(16), *range(20, 30)]), names(more), one)
    assert len(both.edges) == len(both.sinks) == 2
    q = spark.createDataFrame([("u",)], "qid string")
    every = [*range(16), *range(20, 30)]
    at = {x: i for i, x in enumerate(every)}
    got = ranked(both, q, max_iter=9, tol=None).toPandas().set_index("id").score
    want = _dense(len(every), [(at[a], at[b], w) for a, b, w in first + more], np.full(len(every), 1 / len(every)), rounds=9)
    assert np.allclose([got[str(x)] for x in every], want, atol=1e-12)
    assert prepared(ids([20, 21]), names([(20, 21, 1.0)]), both) is None


def test_neighbours_among_equal_vectors(spark, monkeypatch):
    """Vectors of few kinds, in cells of several blocks: equal ones are one query and the smallest ids of a kind, and the results are those of brute force."""
    rng = np.random.default_rng(5)
    kinds = rng.integers(-1, 2, (7, 3)).astype(float)
    v = kinds[rng.integers(0, 7, 150)]
    df = spark.createDataFrame([(f"{i:03d}", x.tolist()) for i, x in enumerate(v)], "id string, v array<double>").repartition(3)
    n = np.linalg.norm(v, axis=1)
    u = v / np.where(n > 0, n, 1)[:, None]
    want = {}
    for drop in (False, True):
        want[drop] = {(f"{i:03d}", r + 1, b) for i in range(150) for r, (_, b) in enumerate(sorted((-round(float(u[i] @ u[j]), 9), f"{j:03d}") for j in range(150) if not drop or j != i)[:4])}
    for name, value in (("BLOCK", 16), ("QUERIES", 8), ("CELL", 48), ("TOGETHER", 40)):
        monkeypatch.setattr(knn, name, value)
    looked_at = []
    real = knn._found
    monkeypatch.setattr(knn, "_found", lambda q, c, n_q, n_c, *more: looked_at.append((n_q, n_c)) or real(q, c, n_q, n_c, *more))
    for many in (1 << 40, 1):
        monkeypatch.setattr(knn, "MANY", many)
        for drop in (False, True):
            got = top_k(df.toDF("qid", "v"), df, 4, drop_self=drop)
            assert {(r["qid"], r["rank"], r["id"]) for r in got.collect()} == want[drop]
    assert looked_at[0] == (150, 150) and looked_at[2][0] <= 7 * 4 and looked_at[2][1] <= 7 * 4 * 4
