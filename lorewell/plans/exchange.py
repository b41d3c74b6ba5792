"""Registered queries that go through sources, sinks, the table store, the graph store and the engine, with their SQL counterparts.

What a sink writes here goes to a folder below the shared one, and the source reads it back; the SQL tells from the tables what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.config import Config, Qa
from lorewell.functions.prompts import ANSWER_PROMPT
from lorewell.functions.text import content_hash, json_list_slice, key, parse_triple_text, typed
from lorewell.operators import dedup, kg, openie, selection
from lorewell.operators.graph import ATTRS, DiGraph
from lorewell.operators.pagerank import pagerank
from lorewell.plans import catalog as base
from lorewell.plans.catalog import table
from lorewell.plans.engine import Engine
from lorewell.sources import readers, sinks
from lorewell.sources.store import TableStore, durable, forget, forget_later, shared_folder
from lorewell.streaming.ingest import ingest_stream, read_documents, stream_id


def _folder(spark: SparkSession, suffix: str = "") -> str:
    path = f"{shared_folder(spark)}/lorewell/{uuid.uuid4().hex}{suffix}"
    forget_later(spark, path)
    return path


# Sources and sinks.

def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_passages(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("passage")), path)
    return readers.read_raw_corpus(spark, path)


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their first three words as entities, and these as a triple."""
    words = F.slice(F.split(F.coalesce("text", F.lit("")), " ", -1), 1, 3)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("idx"), F.coalesce("text", F.lit("")).alias("passage"), words.alias("extracted_entities"), F.array(words).alias("extracted_triples"))


def openie_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = _folder(spark), _extracted(spark, sf_dir)
    sinks.write_openie(docs, openie.corpus_stats(docs), path)
    return readers.read_openie(spark, path).select("idx", F.char_length("passage").cast("long").alias("n_chars"), F.array_join("extracted_entities", "|").alias("entities"), F.array_join(F.col("extracted_triples")[0], "|").alias("triple"))


def extraction_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the documents, by the stand-in for a model: half of them, and then all, of which the first half comes from the cache."""
    path = _folder(spark)
    engine = Engine.open(spark, f"{path}/store", Config())
    rows = durable(table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(content_hash("text").alias("pg_hash"), F.col("text").alias("passage")).agg(F.min("doc_id").alias("pos")))
    engine.extract(rows.where("pos % 2 = 0"), pause=0.0, cache=f"{path}/cache")
    docs, _ = engine.extract(rows, pause=0.0, cache=f"{path}/cache")
    return docs.select("idx", F.size("extracted_entities").cast("long").alias("n_entities"), F.size("extracted_triples").cast("long").alias("n_triples"), F.sha2("passage", 256).alias("passage_hash"))


def jsonl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    table(spark, sf_dir, "events").select("event_id", "event_type", F.parse_json("props").alias("props")).write.json(path)
    rows = readers.read_jsonl(spark, path)
    return rows.select(*(F.variant_get("value", f"$.{p}", t).alias(n) for n, p, t in (("event_id", "event_id", "bigint"), ("event_type", "event_type", "string"), ("k", "props.k", "bigint"))))


def edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations as edges and account balances as a personalization, in one text."""
    c, path = table(spark, sf_dir, "customer"), _folder(spark)
    n = F.lit(c.count())
    head = spark.range(1).select(F.lit(0).alias("o"), F.concat_ws(" ", n, n).alias("line"))
    edges = c.select(F.lit(1).alias("o"), F.concat_ws(" ", F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.col("c_custkey") % 7 + 0.5).alias("line"))
    nodes = c.select(F.lit(2).alias("o"), F.concat_ws(" ", F.concat(F.lit("c"), "c_custkey"), F.col("c_custkey") % 3).alias("line"))
    head.union(edges).union(nodes).orderBy("o").select("line").write.text(path)
    e, p = readers.read_edge_list(spark, path)
    return e.join(p.withColumnRenamed("weight", "personal"), F.col("src") == F.col("node")).select("src", "dst", "weight", "personal")


def paragraph_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of parts, a blank line after every third, as a text file."""
    path = _folder(spark)
    lines = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "\n \t").otherwise("")).alias("line"))
    lines.orderBy("p_partkey").select("line").write.text(path)
    return readers.read_paragraphs(spark, path).select(F.col("pos").cast("long").alias("pos"), "passage")


def store_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two imports of edges, one after the other: pairs by name, read both ways."""
    store = TableStore(spark, _folder(spark))
    for now, t in enumerate(base._halves(spark, sf_dir), 1):
        stamp = F.lit(float(now))
        store.commit({"edges": kg.entity_pairs(t).withColumn("create_time", stamp).withColumn("update_time", stamp), "counts": kg.entity_counts(t)})
    return kg.both_ways(store.read("edges"))


def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two imports of counts, put together in a base."""
    store = TableStore(spark, _folder(spark))
    for t in base._halves(spark, sf_dir):
        store.commit({"counts": kg.entity_counts(t)})
    store.compact()
    return store.read("counts")


# The graph store.

def _nations(spark: SparkSession, sf_dir: str) -> DiGraph:
    """Nations and regions; an edge from each nation to its region."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    cell = lambda **kinds: F.struct(*(kinds.get(k, F.lit(None).cast(t)).cast(t).alias(k) for k, t in (("int", "bigint"), ("float", "double"), ("str", "string"))))
    attrs = lambda name, number: F.create_map(F.lit("content"), cell(str=F.col(name)), F.lit("number"), cell(int=F.col(number)), F.lit("half"), cell(float=F.col(number) + 0.5))
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), attrs("n_name", "n_nationkey").alias("attrs"))
    nodes = nodes.unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), attrs("r_name", "r_regionkey").alias("attrs")))
    edges = n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), (F.col("n_nationkey") * 1.5).alias("weight"), F.create_map().cast(ATTRS).alias("attrs"))
    return DiGraph(nodes, edges)


def graphml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with attributes of three types and the weight of their edge, through a compressed file."""
    path = _folder(spark, ".graphmlz")
    _nations(spark, sf_dir).save(path, compressed=True)
    graph = DiGraph.load(spark, path)
    nodes = graph.nodes.select("id", F.col("attrs")["content"]["str"].alias("content"), F.col("attrs")["number"]["int"].alias("number"), F.col("attrs")["half"]["float"].alias("half"))
    return nodes.join(graph.edges.select(F.col("src").alias("id"), "dst", "weight"), "id", "left")


def _changed(spark: SparkSession, sf_dir: str) -> DiGraph:
    """Nodes and edges added, changed and removed."""
    n, graph = table(spark, sf_dir, "nation"), _nations(spark, sf_dir)
    none = F.create_map().cast(ATTRS).alias("attrs")
    nation = F.concat(F.lit("n"), "n_nationkey")
    graph = graph.add_nodes(n.where("n_nationkey < 5").select(F.concat(F.lit("x"), "n_nationkey").alias("id"), none))
    graph = graph.add_edges(n.select(nation.alias("src"), F.concat(F.lit("x"), F.col("n_nationkey") % 7).alias("dst"), F.lit(0.25).alias("weight"), none))
    graph = graph.update_edges(n.where("n_nationkey % 2 = 0").select(nation.alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit(9.0).alias("weight"), none))
    graph = graph.remove_edges(n.where("n_nationkey % 3 = 0").select(nation.alias("src"), F.concat(F.lit("x"), F.col("n_nationkey") % 7).alias("dst")))
    return graph.settled().remove_nodes(["r0", "x5"])


def graph_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).edges.select("src", "dst", "weight")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).nodes.select("id")


# Functions.

def relation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = kg.relations(base.order_triples(spark, sf_dir)).select(parse_triple_text("str").alias("t"))
    return parts.select(*(F.col("t")[i].alias(n) for i, n in enumerate(("subj", "pred", "obj"))))


def list_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", json_list_slice(F.concat(F.lit("so ["), F.coalesce("text", F.lit("")), F.lit("] and ] on"))).alias("list"))


def typed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(F.lit("int"), F.lit("float"), F.lit("string")), (F.col("event_id") % 3 + 1).cast("int"))
    t = typed(F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5"))), kind)
    return e.select("event_id", t.alias("t")).select("event_id", F.coalesce("t.int", F.lit(-1)).alias("int"), F.coalesce("t.float", F.lit(-1.0)).alias("float"), F.coalesce("t.str", F.lit("")).alias("str"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities and triples in answers, with words around them and the end missing; a triple that the cut takes a part of makes an answer none."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    ents = openie.entity_answer(F.concat(F.lit('Here: ["'), "c_name", F.lit('", "'), "c_mktsegment", F.lit('", "他", "half')))
    triples = openie.triple_answer(F.concat(F.lit('[["'), "c_name", F.lit('", "buys in", "'), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, '"]] ').otherwise('"], ["cut')))
    return c.select("c_custkey", F.array_join(ents, "|").alias("entities"), F.array_join(F.flatten(triples), "|").alias("triple"))


def triple_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = openie.complete(openie.validated(_extracted(spark, sf_dir).withColumn("pos", F.lit(0)), True))
    return openie.triples(docs).select("idx", F.col("pos").cast("long").alias("pos"), "subj", "pred", "obj")


def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(content_hash("text").alias("pg_hash"))
    return dedup.insert_absent(d.join(table(spark, sf_dir, "documents").where("doc_id % 4 = 0").select(content_hash("text").alias("pg_hash")).distinct(), "pg_hash", "left_semi").distinct(), d, "pg_hash")


# Selection and rank.

def dyn_topk_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = selection.dynamic_top_k(base._search_hits(spark, sf_dir, 1000), jump="gap")
    return kept.select("qid", "id", F.round("score", 6).alias("score"), F.round("norm", 6).alias("norm"))


def ranked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = selection.dynamic_top_k(base._search_hits(spark, sf_dir, 1000))
    return kg.first_rank(kept, "qid", F.desc("score"), F.col("id")).where("rank <= 3").select("qid", "id", F.col("rank").cast("long").alias("rank"))


def synonym_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base._with_synonyms(spark, sf_dir, "add")


def ppr_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Until nothing changes any more, by the tolerance."""
    t = base.event_triples(spark, sf_dir)
    edges = kg.entity_edges(t).unionByName(kg.passage_edges(t, True))
    return pagerank(kg.endpoints(edges), edges, base._one_query(spark), alpha=0.2, tol=1e-15).withColumn("score", F.round("score", 9))


# The engine.

_engines: dict[tuple[str, str], Engine] = {}


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The documents, extracted and imported in two batches, with synonyms at the shipped threshold: once for a session and a folder of tables, and asked by several queries."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name not in _engines:
        engine = Engine.open(spark, _folder(spark), Config())
        rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(content_hash("text").alias("pg_hash"), F.col("text").alias("passage"), F.col("doc_id").alias("pos"))
        for part in (0, 1):
            engine.ingest(engine.extract(rows.where(F.pmod("pos", F.lit(2)) == part), pause=0.0)[0], float(part + 1))
        _engines[name] = engine
    return _engines[name]


def engine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _engine(spark, sf_dir).store.read("edges")
    return edges.select("src", "dst", F.round("weight", 6).alias("weight"), "create_time", "update_time")


def engine_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).status()


def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages are candidates for every hundredth document's first six words: relations, gate, entities, synonyms, five rounds of PageRank, selection."""
    asked = table(spark, sf_dir, "documents").where("doc_id % 100 = 0 AND text IS NOT NULL")
    asked = asked.select(F.col("doc_id").cast("string").alias("qid"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("question"))
    found = _engine(spark, sf_dir).search(asked, max_iter=5, tol=None)
    return found.select("qid", "id", F.round("score", 9).alias("score"), F.round("norm", 6).alias("norm"))


def stream_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' sources and languages as a graph, imported from a stream in three starts, and before the last of them a batch whose import was committed but not noted by Spark, so that
    it comes again. The number of passages that an entity is in."""
    top = _folder(spark)
    engine = Engine.open(spark, f"{top}/store", Config())
    ends = F.array("source", "lang")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL").select(
        F.col("doc_id").cast("string").alias("idx"), F.col("text").alias("passage"), ends.alias("extracted_entities"),
        F.array(F.array("source", F.lit("writes"), "lang")).alias("extracted_triples"), F.col("doc_id").alias("pos"),
    )
    for start in range(3):
        docs.where(F.pmod("pos", F.lit(3)) == start).write.mode("append").json(f"{top}/in")
        if start == 2:
            forget(spark, f"{top}/checkpoint/commits/{engine.store.epochs()[stream_id(spark, f'{top}/checkpoint')]}")
        ingest_stream(engine, read_documents(spark, f"{top}/in"), f"{top}/checkpoint").awaitTermination()
    return engine.store.read("counts")


_WORDS = "string_split(coalesce(text, ''), ' ')[1:3]"
_NATIONS = "SELECT n_nationkey AS k, 'n' || n_nationkey AS n, 'r' || n_regionkey AS r, 'x' || (n_nationkey % 7) AS x FROM nation"
# The engine's SQL. A text is a vector of its words' signed places; all that is asked of it are inner products, so they are summed over the places that two texts share.
_VECTORS = """(SELECT id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM (
  SELECT id, ('0x' || left(sha256(w), 8))::BIGINT % 64 AS dim, sum(2 * (('0x' || substr(sha256(w), 9, 2))::BIGINT % 2) - 1)::DOUBLE AS v FROM (
    SELECT id, unnest(regexp_extract_all(lower(replace(str, chr(10), ' ')), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {}) GROUP BY id, dim) WHERE v <> 0)"""
_ENGINE = f"""
  en_p AS MATERIALIZED (SELECT sha256(text) AS pg, text, min(doc_id % 2) AS batch, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents WHERE text IS NOT NULL GROUP BY text),
  en_t AS MATERIALIZED (SELECT DISTINCT pg, batch + 1 AS batch, w[i] AS subj, w[i + 1] AS pred, w[i + 2] AS obj FROM (SELECT pg, batch, w, unnest(range(1, len(w) - 1, 3)) AS i FROM en_p WHERE len(w) > 2)),
  en_e AS MATERIALIZED (SELECT DISTINCT e, 'entity-' || sha256(e) AS id, e AS str, batch FROM (SELECT subj AS e, batch FROM en_t UNION SELECT obj, batch FROM en_t)),
  en_ev AS MATERIALIZED (SELECT * FROM {_VECTORS.format("(SELECT DISTINCT id, str FROM en_e)")}),
  en_k AS MATERIALIZED (SELECT id, min(batch) AS since FROM en_e GROUP BY id),
  en_s AS MATERIALIZED (SELECT batch, qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY batch, qid ORDER BY score DESC, id) AS place FROM (
    SELECT q.batch, a.id AS qid, b.id, round(sum(a.v * b.v), 9) AS score FROM (SELECT DISTINCT id, batch FROM en_e) q JOIN en_ev a ON a.id = q.id JOIN en_ev b ON a.dim = b.dim
      JOIN en_k k ON k.id = b.id AND k.since <= q.batch GROUP BY q.batch, a.id, b.id HAVING round(sum(a.v * b.v), 9) >= 0.8)) WHERE place <= 10 AND qid <> id),
  en_b AS MATERIALIZED (SELECT src, dst, batch, coalesce(max(s), sum(r)) AS weight FROM (
    SELECT 'entity-' || sha256(subj) AS src, 'entity-' || sha256(obj) AS dst, batch, 1.0::DOUBLE AS r, NULL::DOUBLE AS s FROM en_t WHERE subj <> obj
    UNION ALL SELECT 'entity-' || sha256(obj), 'entity-' || sha256(subj), batch, 1.0, NULL FROM en_t WHERE subj <> obj
    UNION ALL SELECT 'entity-' || sha256(subj), 'paragraph-' || pg, batch, 1.0, NULL FROM en_t
    UNION ALL SELECT qid, id, batch, NULL, score FROM en_s UNION ALL SELECT id, qid, batch, NULL, score FROM en_s) GROUP BY src, dst, batch),
  en_edges AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight, min(batch)::DOUBLE AS create_time, max(batch)::DOUBLE AS update_time FROM en_b GROUP BY src, dst)"""
_ENGINE_EDGES = f"WITH {_ENGINE} SELECT src, dst, round(weight, 6) AS weight, create_time, update_time FROM en_edges"
_ASKED = f"""{_ENGINE},
  en_q AS MATERIALIZED (SELECT doc_id::VARCHAR AS id, array_to_string(string_split(text, ' ')[1:6], ' ') AS str FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL),
  en_qv AS MATERIALIZED (SELECT * FROM {_VECTORS.format("en_q")}),
  en_rel AS MATERIALIZED (SELECT DISTINCT 'relation-' || sha256('(''' || subj || ''', ''' || pred || ''', ''' || obj || ''')') AS id, '(''' || subj || ''', ''' || pred || ''', ''' || obj || ''')' AS str, subj, obj FROM en_t),
  en_rv AS MATERIALIZED (SELECT * FROM {_VECTORS.format("en_rel")}),
  en_rh AS MATERIALIZED (SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM (
    SELECT qid, id, round(sum(s), 9) AS score FROM (SELECT q.id AS qid, r.id, 0.0::DOUBLE AS s FROM en_q q CROSS JOIN en_rel r
      UNION ALL SELECT a.id, b.id, a.v * b.v FROM en_qv a JOIN en_rv b ON b.dim = a.dim) GROUP BY qid, id)) WHERE place <= 10),
  en_r AS MATERIALIZED (SELECT qid, id, score FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM ({base._dynamic_sql("SELECT * FROM en_rh")})) WHERE best >= 0.5),
  en_pv AS MATERIALIZED (SELECT * FROM {_VECTORS.format("(SELECT 'paragraph-' || pg AS id, text AS str FROM en_p WHERE len(w) > 2)")}),
  en_ph AS MATERIALIZED (SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM (
    SELECT qid, id, round(sum(s), 9) AS score FROM (SELECT q.id AS qid, 'paragraph-' || pg AS id, 0.0::DOUBLE AS s FROM en_q q CROSS JOIN en_p WHERE len(w) > 2
      UNION ALL SELECT a.id, b.id, a.v * b.v FROM en_qv a JOIN en_pv b ON b.dim = a.dim) GROUP BY qid, id)) WHERE place <= 1000),
  en_c AS MATERIALIZED (SELECT 'entity-' || sha256(e) AS id, count(DISTINCT pg)::DOUBLE AS n FROM (SELECT pg, subj AS e FROM en_t WHERE subj <> obj UNION ALL SELECT pg, obj FROM en_t WHERE subj <> obj) GROUP BY e),
  en_w AS MATERIALIZED (SELECT qid, w.id, mean, total / coalesce(n, 1.0) AS weight FROM (SELECT qid, 'entity-' || sha256(e) AS id, sum(score) AS total, avg(score) AS mean FROM (
    SELECT qid, score, unnest([subj, obj]) AS e FROM en_r h JOIN en_rel r ON r.id = h.id) GROUP BY qid, e) w LEFT JOIN en_c c ON c.id = w.id),
  en_m AS MATERIALIZED (SELECT qid, id, CASE WHEN max(weight) OVER u = min(weight) OVER u THEN 1.0 ELSE (weight - min(weight) OVER u) * 0.95 / (max(weight) OVER u - min(weight) OVER u) + 0.05 END AS weight,
    row_number() OVER (PARTITION BY qid ORDER BY mean DESC, id) AS place FROM en_w WINDOW u AS (PARTITION BY qid))"""
_PERSONAL = f"SELECT qid, id, weight FROM en_m WHERE place <= 10 UNION ALL SELECT qid, id, weight FROM ({base._weights_sql('SELECT * FROM en_ph WHERE qid IN (SELECT qid FROM en_r)')})"
_RANKS = base._ppr_sql("SELECT src, dst, weight FROM en_edges", "SELECT DISTINCT qid FROM en_r", Qa.ppr_damping, _PERSONAL, rounds=5).removeprefix("WITH ").rsplit(" SELECT qid, id, r AS score FROM ", 1)[0]
_ENGINE_SEARCH = f"""WITH {_ASKED}, {_RANKS},
  en_all AS (SELECT qid, id, r AS score FROM s5 WHERE id LIKE 'paragraph-%' UNION ALL SELECT qid, id, score FROM en_ph WHERE qid NOT IN (SELECT qid FROM en_r))
  SELECT qid, id, round(score, 9) AS score, round(norm, 6) AS norm FROM ({base._dynamic_sql("SELECT * FROM en_all")})"""
_EVENT_EDGES = f"SELECT * FROM ({base._edges_sql(base.EVENT_TRIPLES)}) UNION ALL SELECT * FROM ({base._passage_edges_sql(base.EVENT_TRIPLES, True)})"
_STORED = f"""SELECT src, dst, sum(weight) AS weight, min(made) AS create_time, max(made) AS update_time FROM (
  SELECT *, 1.0::DOUBLE AS made FROM ({base._edges_sql(f'SELECT * FROM ({base.ORDER_TRIPLES}) WHERE idx::BIGINT % 2 = 0')}) UNION ALL
  SELECT *, 2.0::DOUBLE FROM ({base._edges_sql(f'SELECT * FROM ({base.ORDER_TRIPLES}) WHERE idx::BIGINT % 2 = 1')})) GROUP BY src, dst"""
_QUOTED_PROMPT = ANSWER_PROMPT.replace("'", "''")

_PAIRS: dict[str, tuple] = {
    "raw_corpus": (raw_corpus, "SELECT sha256(text) AS pg_hash, text AS passage, min(pos) AS pos FROM (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) WHERE text IS NOT NULL GROUP BY text"),
    "openie_file": (openie_file, f"SELECT doc_id::VARCHAR AS idx, length(coalesce(text, '')) AS n_chars, array_to_string({_WORDS}, '|') AS entities, array_to_string({_WORDS}, '|') AS triple FROM documents"),
    "extraction_cache": (
        extraction_cache,
        """SELECT idx, len(list_distinct(w))::BIGINT AS n_entities, (len(w) // 3)::BIGINT AS n_triples, idx AS passage_hash FROM (
          SELECT sha256(text) AS idx, any_value(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM documents WHERE text IS NOT NULL GROUP BY text) WHERE len(w) > 0""",
    ),
    "jsonl_rows": (jsonl_rows, "SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events"),
    "edge_list": (edge_list, "SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, c_custkey % 7 + 0.5::DOUBLE AS weight, (c_custkey % 3)::DOUBLE AS personal FROM customer"),
    "paragraph_file": (paragraph_file, "SELECT g - min(g) OVER () AS pos, passage FROM (SELECT (p_partkey + 2) // 3 AS g, string_agg(p_name || chr(10), '' ORDER BY p_partkey) AS passage FROM part GROUP BY 1)"),
    "store_edges": (store_edges, _STORED),
    "store_counts": (store_counts, base._df_sql(base.ORDER_TRIPLES)),
    "graphml_roundtrip": (
        graphml_roundtrip,
        """SELECT 'n' || n_nationkey AS id, n_name AS content, n_nationkey::BIGINT AS number, n_nationkey + 0.5::DOUBLE AS half, 'r' || n_regionkey AS dst, n_nationkey * 1.5::DOUBLE AS weight FROM nation
          UNION ALL SELECT 'r' || r_regionkey, r_name, r_regionkey, r_regionkey + 0.5, NULL, NULL FROM region""",
    ),
    "graph_changes": (
        graph_changes,
        f"""SELECT n AS src, r AS dst, CASE WHEN k % 2 = 0 THEN 9.0 ELSE k * 1.5 END::DOUBLE AS weight FROM ({_NATIONS}) WHERE r <> 'r0'
          UNION ALL SELECT n, x, 0.25 FROM ({_NATIONS}) WHERE k % 3 <> 0 AND x <> 'x5'""",
    ),
    "graph_nodes": (graph_nodes, f"SELECT DISTINCT id FROM (SELECT n AS id FROM ({_NATIONS}) UNION ALL SELECT 'r' || r_regionkey FROM region UNION ALL SELECT x FROM ({_NATIONS})) WHERE id NOT IN ('r0', 'x5')"),
    "relation_parts": (relation_parts, f"SELECT DISTINCT subj, pred, obj FROM ({base.ORDER_TRIPLES})"),
    "list_slices": (list_slices, "SELECT conv_id, turn, '[' || coalesce(text, '') || '] and ]' AS list FROM conversations"),
    "typed_attributes": (
        typed_attributes,
        """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN event_id ELSE -1 END AS int, CASE WHEN event_id % 3 = 1 THEN v::DOUBLE ELSE -1.0 END AS float, CASE WHEN event_id % 3 = 2 THEN v ELSE '' END AS str
          FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE event_id || '.5' END AS v FROM events)""",
    ),
    "model_answers": (
        model_answers,
        """SELECT c_custkey, c_name || '|' || c_mktsegment AS entities, CASE WHEN c_custkey % 2 = 0 THEN c_name || '|buys in|' || c_mktsegment END AS triple FROM customer""",
    ),
    "triple_rows": (
        triple_rows,
        f"""SELECT doc_id::VARCHAR AS idx, 0::BIGINT AS pos, w[1] AS subj, w[2] AS pred, w[3] AS obj FROM (SELECT doc_id, {_WORDS} AS w FROM documents)
          WHERE len(w) = 3 AND len(list_filter(w, lambda x: trim(x, {base._BLANKS}) = '')) = 0 AND w[1] NOT IN ({base._STOP}) AND w[3] NOT IN ({base._STOP})""",
    ),
    "insert_absent": (insert_absent, "SELECT DISTINCT sha256(text) AS pg_hash FROM documents WHERE text IS NOT NULL"),
    "dyn_topk_gap": (
        dyn_topk_gap,
        f"""WITH h AS (SELECT qid, id, score, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm
            FROM ({base._hits_sql(1000)}) WINDOW w AS (PARTITION BY qid)),
          g AS (SELECT *, coalesce(lag(norm) OVER (PARTITION BY qid ORDER BY score DESC, id) - norm, 0.0) AS step FROM h),
          j AS (SELECT *, first_value(norm) OVER (PARTITION BY qid ORDER BY step DESC, norm DESC) AS jump, avg(norm) OVER (PARTITION BY qid) + var_pop(norm) OVER (PARTITION BY qid) AS spread, min(norm) OVER (PARTITION BY qid) AS least FROM g)
          SELECT qid, id, round(score, 6) AS score, round(norm, 6) AS norm FROM j WHERE norm > 0.5 * jump + 0.5 * spread OR least = 1.0""",
    ),
    "ranked_passages": (ranked_passages, f"SELECT qid, id, rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ({base._dynamic_sql(base._hits_sql(1000))})) WHERE rank <= 3"),
    "synonym_add": (
        synonym_add,
        f"""SELECT src, dst, round(sum(weight), 6) AS weight FROM (SELECT src, dst, weight FROM ({base._SYNONYMS_SQL}) UNION ALL
          SELECT l_partkey::VARCHAR, l_suppkey::VARCHAR, count(*)::DOUBLE FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2) GROUP BY src, dst""",
    ),
    "ppr_tolerance": (ppr_tolerance, f"SELECT qid, id, round(score, 9) AS score FROM ({base._ppr_sql(_EVENT_EDGES, 'SELECT ' + repr('all') + ' AS qid', 0.2, rounds=26)})"),
    "engine_edges": (engine_edges, _ENGINE_EDGES),
    "engine_status": (
        engine_status,
        f"""WITH {_ENGINE} SELECT (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM en_edges UNION ALL SELECT dst FROM en_edges)) AS nodes, (SELECT count(*) FROM en_edges) AS edges,
          (SELECT count(*) FROM en_p WHERE len(w) > 2) AS passages, 0::BIGINT AS without_vector""",
    ),
    "engine_search": (engine_search, _ENGINE_SEARCH),
    "stream_import": (
        stream_import,
        """SELECT 'entity-' || sha256(e) AS hash_key, count(DISTINCT text)::DOUBLE AS appear_cnt FROM (SELECT text, unnest([source, lang]) AS e FROM (
          SELECT text, arg_min(source, doc_id::VARCHAR) AS source, arg_min(lang, doc_id::VARCHAR) AS lang FROM (
            SELECT *, min(doc_id % 3) OVER (PARTITION BY text) AS first FROM documents WHERE text IS NOT NULL) WHERE doc_id % 3 = first AND source <> lang GROUP BY text)) GROUP BY e""",
    ),
}

#: SQL for queries of the first catalog.
ALSO = {
    "json_repair": """SELECT event_id, '[["a",{"e":"x,]","p":{"k":' || json_extract(props, '$.k') || '}},[1]]]' AS json FROM events""",
    "prompt_context": f"""SELECT qid, '[{{"role":"system","content":' || to_json('{_QUOTED_PROMPT}') || '}},{{"role":"user","content":' || to_json('问题：' || chr(10) || 'query ' || qid || chr(10) || chr(10) || '可能有帮助的信息：' || chr(10) || lines) || '}}]' AS messages
      FROM (SELECT qid, string_agg(n || '. 相关性：' || score || chr(10) || text, chr(10) ORDER BY n) AS lines FROM (
        SELECT qid, text, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS n FROM ({base._dynamic_sql(base._hits_sql(1000))}) h JOIN documents ON doc_id::VARCHAR = id) GROUP BY qid)""",
    "synonym_leader": f"""WITH RECURSIVE h AS MATERIALIZED (SELECT qid AS a, id AS b, score FROM ({base._hits_sql(9, '')}) WHERE score >= {base.SYNONYMS}),
      n AS MATERIALIZED (SELECT a, list(b) AS hit, row_number() OVER (ORDER BY a) AS i FROM h GROUP BY a),
      s(i, seen, leads) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[] UNION ALL
        SELECT n.i, CASE WHEN list_contains(seen, a) THEN seen ELSE list_concat(seen, hit) END, CASE WHEN list_contains(seen, a) THEN leads ELSE list_append(leads, a) END FROM s JOIN n ON n.i = s.i + 1),
      l AS (SELECT unnest(leads) AS a FROM s WHERE i = (SELECT max(i) FROM s)), k AS (SELECT h.* FROM h JOIN l USING (a))
      SELECT src, dst, round(max(score), 6) AS weight FROM (SELECT a AS src, b AS dst, score FROM k UNION ALL SELECT b, a, score FROM k) GROUP BY src, dst""",
}


def queries() -> dict:
    return {name: run for name, (run, _) in _PAIRS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _PAIRS.items()} | ALSO
