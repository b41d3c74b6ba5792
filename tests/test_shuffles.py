"""What is shuffled: not keys, not both ways of a pair, not an edge of a prepared graph."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lorewell.llm import suffix_dedup
from lorewell.operators import kg, pagerank
from lorewell.operators.pagerank import by_cell, prepared, ranked
from lorewell.plans import catalog, exchange
from lorewell.sources import readers, sinks, store


def _triples(spark):
    rows = [("1", "a", "r", "b"), ("1", "b", "s", "a"), ("2", "a", "r", "b"), ("2", "c", "r", "c"), ("3", None, "r", "b")]
    return spark.createDataFrame(rows, "idx string, subj string, pred string, obj string")


def test_pairs_are_counted_once_and_read_both_ways(spark):
    edges = kg.entity_edges(_triples(spark), F.col)
    assert sorted(map(tuple, edges.collect())) == [("a", "b", 3.0), ("b", "a", 3.0)]
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # the plan's root comes first


def test_an_upsert_of_orders_shuffles_names(spark, small):
    plan = catalog.edge_upsert(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" in plan[: plan.index("Union")] and "sha2(" not in plan[plan.index("Union") :]


def _edges(spark, n, m):
    rng = np.random.default_rng(3)
    rows = [(str(a), str(b), float(rng.random())) for a, b in rng.integers(0, n, (m, 2)) if a != b] + [(str(a), f"end{a}", 1.0) for a in range(0, n, 3)]
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_rounds_leave_edges_where_they_lie(spark):
    """A join of ranks with the edges shuffles the ranks alone."""
    edges = _edges(spark, 40, 300)
    graph = prepared(kg.endpoints(edges), edges)
    ranks = graph.nodes.select((F.col("node") % 9).cast("int").alias("cell"), F.col("node").alias("src"), "out")
    with by_cell(spark):
        plan = graph.edges[0].join(ranks.hint("shuffle_hash"), ["cell", "src"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and "Bucketed: true" in plan
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    cells = graph.edges[0].select("cell").distinct().count()
    assert cells == graph.side**2 == len(graph.edges[0].inputFiles())


def test_nodes_whose_numbers_are_the_same_get_others(spark, monkeypatch):
    edges = _edges(spark, 30, 120)
    q = spark.createDataFrame([("u",)], "qid string")
    want = {r["id"]: r["score"] for r in ranked(prepared(kg.endpoints(edges), edges), q, max_iter=4, tol=None).collect()}
    real = pagerank.code
    monkeypatch.setattr(pagerank, "code", lambda id, seed: real(id, seed) % 5 if seed == 0 else F.lit(-1).cast("long") if seed == 1 else real(id, seed))
    graph = prepared(kg.endpoints(edges), edges)
    assert graph.seed == 2
    got = {r["id"]: r["score"] for r in ranked(graph, q, max_iter=4, tol=None).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    # A new node with the number of an old one has the tables made anew.
    monkeypatch.setattr(pagerank, "code", lambda id, seed: F.when(F.col(id) == "new", F.xxhash64(F.lit(seed), F.lit("0"))).otherwise(real(id, seed)))
    assert prepared(spark.createDataFrame([("new",)], "id string"), edges.limit(0), graph) is None


def test_a_stream_is_written_by_as_many_tasks_as_read_it(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(exchange, "_folder", lambda _: str(tmp_path / "top"))
    spark.read.parquet(f"{small}/documents.parquet").repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in exchange.stream_import(spark, str(tmp_path)).collect()}
    assert len(list((tmp_path / "top" / "in").glob("*.json"))) > 6
    monkeypatch.setattr(exchange, "_folder", lambda _: str(tmp_path / "again"))
    assert got == {tuple(r) for r in exchange.stream_import(spark, small).collect()}


def test_exchange_files_are_written_down_and_dealt_once(spark, tmp_path, monkeypatch):
    kept = []
    real = sinks.durable
    monkeypatch.setattr(sinks, "durable", lambda df: kept.append(df.columns) or real(df))
    texts = ['a "b" [c', "d, \\", "{e}", "f", 'a "b" [c']
    rows = spark.createDataFrame(list(enumerate(texts)), "pos int, passage string").repartition(3)
    sinks.write_passages(rows, str(tmp_path / "p"))
    assert len(kept) == 1
    got = readers.read_raw_corpus(spark, str(tmp_path / "p"))
    assert sorted((r["pos"], r["passage"]) for r in got.collect()) == list(enumerate(texts))[:4]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(file") == 0
    sinks.write_passages(rows.limit(0), str(tmp_path / "none"))
    assert readers.read_raw_corpus(spark, str(tmp_path / "none")).count() == 0


def test_cached_results_are_packed(spark, tmp_path):
    rows = spark.createDataFrame([("1", "x y", ["x"], [["x", "y", "z"]], None), ("2", "w", None, None, "no")], "idx string, passage string, extracted_entities array<string>, extracted_triples array<array<string>>, error string")
    sinks.append_cache(rows, str(tmp_path))
    assert list(tmp_path.glob("*.json.gz")) and not list(tmp_path.glob("*.json"))
    assert [r["idx"] for r in readers.read_cache(spark, str(tmp_path)).collect()] == ["1"]
    assert [r["idx"] for r in readers.read_failures(spark, str(tmp_path)).collect()] == ["2"]


def test_many_rows_are_dealt_to_more_tasks(spark, small, monkeypatch):
    """Edges with synonyms, and new nodes: the same rows in as many tasks as they ask for."""
    kept = {q: {tuple(r) for r in catalog.queries()[q](spark, small).collect()} for q in ("synonym_override", "new_node_attrs")}
    monkeypatch.setattr(store, "ROWS", 500)
    for name, want in kept.items():
        frame = catalog.queries()[name](spark, small)
        parts = [int(n) for n in re.findall(r"hashpartitioning\([^)]*\b(?:src|id)[^)]*, (\d+)\)", frame._jdf.queryExecution().executedPlan().toString())]
        assert max(parts) > 6000 // 500 - 1
        assert {tuple(r) for r in frame.collect()} == want


def test_documents_without_repeats_stay_where_they_are(spark, monkeypatch):
    """Their texts go around the last join, also where bits of documents coincide."""
    text = lambda i: "".join(hashlib.sha256(f"{i} {j}".encode()).hexdigest() for j in range(5))[:300]
    long = text("long")
    rows = [(i, text(i)) for i in range(40)] + [(50, long + "x"), (51, "y" + long), (52, None), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = []
    for bits in (64, 1 << 26):
        monkeypatch.setattr(suffix_dedup, "MOST_BITS", bits)
        out = suffix_dedup.remove_repeats(docs)
        kept.append(sorted((tuple(r) for r in out.collect()), key=repr))
    assert kept[0] == kept[1] and sum(r[2] == 300 for r in kept[0]) == 3
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()


def test_transitions_are_told_without_a_prepared_graph(spark, small, monkeypatch):
    monkeypatch.setattr(catalog, "prepared", None)
    monkeypatch.setattr(catalog, "durable", None)
    monkeypatch.setattr(catalog, "_kept_graphs", {})
    monkeypatch.setattr(catalog, "_kept_triples", {})
    shares = catalog.graph_transitions(spark, small).groupBy("src").agg(F.sum("share").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert all(abs(x - 1) < 1e-5 for x in shares)


def test_ranks_in_blocks(spark, monkeypatch):
    """Many chunks, packs and blocks of queries give the ranks of one of each, and rounds leave no ranks behind but the last ones."""
    edges = _edges(spark, 40, 300)
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "qid string")
    given = spark.createDataFrame([("a", "3", 1.0), ("a", "end3", 2.0), ("b", "5", 1.0), ("b", "nowhere", 1.0)], "qid string, id string, weight double")
    made = len(store._written)
    graph = prepared(kg.endpoints(edges), edges)
    assert len(store._written) - made == 3  # nodes, edges, sinks
    every = {"personalization": given, "init": given, "dangling": given.where("qid = 'a'"), "tol": None}
    want = {(r["qid"], r["id"]): r["score"] for r in ranked(graph, q, max_iter=2, **every).collect()}
    for name, value in (("VALUES", 8), ("PACKED", 16), ("CHUNK", 4)):
        monkeypatch.setattr(pagerank, name, value)
    left = []
    for rounds in (2, 3):
        made = len(store._written)
        found = ranked(graph, q, max_iter=rounds, prefix="end", **every)
        left.append(len(store._written) - made)
        if rounds == 2:
            got = {(r["qid"], r["id"]): r["score"] for r in found.collect()}
    assert left[0] == left[1]
    assert got.keys() == {k for k in want if k[1].startswith("end")} and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_ranks_move_in_chunks(spark, monkeypatch):
    """Rows of ranks and of edges are of a chunk, not of a line; blocks of queries come one after the other where a task holds the sums of one alone."""
    edges = _edges(spark, 60, 400)
    names = [str(i) for i in range(6)]
    q = spark.createDataFrame([(n,) for n in names], "qid string")
    given = spark.createDataFrame([(n, n, 1.0) for n in names], "qid string, id string, weight double")
    graph = prepared(kg.endpoints(edges), edges)
    want = {(r["qid"], r["id"]): r["score"] for r in ranked(graph, q, given, max_iter=3, tol=None).collect()}
    for name, value in (("VALUES", 60), ("PACKED", 8), ("CHUNK", 5), ("HELD", 20), ("OPEN", 1)):
        monkeypatch.setattr(pagerank, name, value)
    kept = []
    real = pagerank.durable
    monkeypatch.setattr(pagerank, "durable", lambda df, *form: kept.append(real(df, *form)) or kept[-1])
    got = {(r["qid"], r["id"]): r["score"] for r in ranked(graph, q, given, max_iter=3, tol=None).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    states = [df for df in kept if {"x", "sunk"} <= set(df.columns)]
    n = graph.nodes.where("live").count()
    width = -(-6 // states[-1].select("block").distinct().count())
    sizes = [len(r["x"]) // 8 // width for r in states[-1].collect()]
    assert sum(sizes) == n * 6 // width and max(sizes) < n / graph.side / 2


def test_a_graph_without_live_nodes_has_ranks(spark):
    nodes = spark.createDataFrame([(str(i),) for i in range(5)], "id string")
    edges = spark.createDataFrame([("0", "1", 0.0)], "src string, dst string, weight double")
    q = spark.createDataFrame([("a",), ("b",)], "qid string")
    given = spark.createDataFrame([("a", "3", 1.0)], "qid string, id string, weight double")
    got = {(r["qid"], r["id"]): r["score"] for r in ranked(prepared(nodes, edges), q, given, max_iter=4).collect()}
    assert got == {(x, str(i)): float(i == 3) if x == "a" else pytest.approx(0.2) for x in "ab" for i in range(5)}


def test_rows_of_megabytes_are_written_in_small_groups(spark):
    rows = spark.range(12, numPartitions=1).select("id", F.expr("cast(array_join(transform(sequence(1, 20000), i -> sha2(concat(id, '-', i), 512)), '') as binary)").alias("x"))
    files = store.durable(rows, store.few_rows).inputFiles()
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    assert max(g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups)) < 12


def test_numbers_in_few_bytes_come_back():
    for x in ([], [1.0, 2.0, 255.0], [1.0, 300.0], [70000, 1], [-1, 5], [2.0**53, 0.5], [float("inf"), -1.0], [1e300], [-(2**63), 2**63 - 1]):
        x = np.array(x)
        assert (pagerank._wide(pa.scalar(pagerank._small(x)), x.dtype) == x).all()
    assert len(pagerank._small(np.ones(1000))) == 1001


def test_an_import_keeps_pairs_by_name(spark, tmp_path):
    """Pairs with synonyms by name, keyed in the end, are those by key; edges of several versions are counted by short keys."""
    t = spark.createDataFrame([("1", f"n{i}", "r", f"n{i * 7 % 12}") for i in range(12)] + [("2", "n1", "s", "n7")], "idx string, subj string, pred string, obj string")
    v = kg.entity_names(t).select(kg.entity_id("entity").alias("id"), F.array(*(F.cos(F.substring("entity", 2, 2).cast("int") % 5 + i) for i in range(3))).alias("v"), F.col("entity").alias("str"))
    own = v.where("str <> 'n3'").select("id")
    for mode in ("all_pairs", "leader"):
        for merge in ("replace", "add"):
            want = kg.with_synonyms(kg.entity_edges(t), kg.synonym_pairs_of(own, v, 3, 0.8, mode), merge)
            pairs = kg.pairs_with_synonyms(kg.entity_pairs(t), kg.synonym_names_of(own, v, 3, 0.8, mode), merge)
            got = sorted(tuple(r) for r in kg.both_ways(pairs).collect())
            assert got == sorted(tuple(r) for r in want.select("src", "dst", "weight").collect()) and len(got) > 6
    tables = store.TableStore(spark, str(tmp_path))
    row = lambda a, b: (a, b, 1.0, 1.0, 1.0)
    for rows in ([row("a", "b"), row("b", "a")], [row("a", "b"), row("a", "c")]):
        tables.commit({"edges": spark.createDataFrame(rows, store.TableStore.TABLES["edges"])})
    assert tables.read_keys("edges", "src", "dst").count() == tables.read("edges").count() == 3
