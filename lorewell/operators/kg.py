"""Edges, counts and upserts of the knowledge graph. Triples are rows (idx, subj, pred, obj), idx being the passage's hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.config import ENTITY, PARAGRAPH, RELATION
from lorewell.functions.text import key, label, triple_text
from lorewell.operators.knn import top_k
from lorewell.sources.store import durable, spread


def entity_id(text: str) -> Column:
    return key(ENTITY, text)


def paragraph_id(pg_hash: str) -> Column:
    return F.concat_ws("-", F.lit(PARAGRAPH), F.col(pg_hash))


def entity_names(triples: DataFrame) -> DataFrame:
    """Distinct ends of triples: entity."""
    return triples.select(F.explode(F.array("subj", "obj")).alias("entity")).distinct()


def relations(triples: DataFrame) -> DataFrame:
    """Distinct triples with their text and key: subj, pred, obj, str, hash."""
    text = triple_text("subj", "pred", "obj")
    return triples.select("subj", "pred", "obj").distinct().withColumn("str", text).withColumn("hash", key(RELATION, "str"))


def entity_pairs(triples: DataFrame) -> DataFrame:
    """src, dst, weight: triples between two different entities by name, src being the lesser of the two."""
    pairs = triples.where("subj <> obj").groupBy(F.least("subj", "obj").alias("src"), F.greatest("subj", "obj").alias("dst"))
    return pairs.agg(F.count("*").cast("double").alias("weight"))


def both_ways(pairs: DataFrame, of: Callable[[str], Column] = entity_id) -> DataFrame:
    """pairs (src, dst by name, and more), by key and both ways."""
    more = [c for c in pairs.columns if c not in ("src", "dst")]
    keyed = pairs.select(of("src").alias("a"), of("dst").alias("b"), *more)
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return keyed.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e"), *more).select("e.src", "e.dst", *more)


def entity_edges(triples: DataFrame, of: Callable[[str], Column] = entity_id) -> DataFrame:
    """src, dst, weight: triples between two different entities, both ways. Both weigh the same, so a pair is counted once, by name, and then named by key: neither keys nor second ways are shuffled."""
    return both_ways(entity_pairs(triples), of)


def entity_counts(triples: DataFrame, of: Callable[[str], Column] = entity_id) -> DataFrame:
    """hash_key, appear_cnt: passages that an entity is in, by triples of two different entities."""
    ends = triples.where("subj <> obj").select("idx", F.explode(F.array("subj", "obj")).alias("entity")).distinct()
    return ends.groupBy("entity").agg(F.count("*").cast("double").alias("appear_cnt")).select(of("entity").alias("hash_key"), "appear_cnt")


def merged_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("hash_key").agg(F.sum("appear_cnt").alias("appear_cnt"))


def passage_edges(triples: DataFrame, link_objects: bool = False, of: Callable[[str], Column] = entity_id) -> DataFrame:
    """src, dst, weight: from the subject of a triple to its passage; link_objects: from both ends."""
    ends = triples.select("idx", F.explode(F.array("subj", "obj")).alias("entity")) if link_objects else triples.select("idx", F.col("subj").alias("entity"))
    edges = ends.groupBy("entity", "idx").agg(F.count("*").cast("double").alias("weight"))
    return edges.select(of("entity").alias("src"), paragraph_id("idx").alias("dst"), "weight")


def synonym_pairs(vectors: DataFrame, k: int, threshold: float, mode: str = "all_pairs") -> DataFrame:
    """src, dst, weight, both ways: entities among the k nearest of one another (an entity is one of its own k) that are
    similar enough. vectors: (id, v).

    mode "leader": an entity that an earlier leader hits leads no more, in the order of ids."""
    return _synonyms(top_k(vectors.select(F.col("id").alias("qid"), "v"), vectors, k), threshold, mode)


def _synonyms(hits: DataFrame, threshold: float, mode: str) -> DataFrame:
    hits = hits.where((F.col("qid") != F.col("id")) & (F.col("score") >= threshold)).select(F.col("qid").alias("a"), F.col("id").alias("b"), "score")
    if mode == "leader":
        hits = leader_hits(durable(hits))
    both = hits.select("a", "b", "score").union(hits.select("b", "a", "score"))
    return both.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.max("score").alias("weight"))


def synonym_pairs_of(own: DataFrame, vectors: DataFrame, k: int, threshold: float, mode: str = "all_pairs") -> DataFrame:
    """As synonym_pairs, with the entities of a batch alone as queries. own: (id)."""
    queries = vectors.join(own, "id", "left_semi").select(F.col("id").alias("qid"), "v")
    return _synonyms(top_k(queries, vectors, k), threshold, mode)


def synonym_names_of(own: DataFrame, vectors: DataFrame, k: int, threshold: float, mode: str = "all_pairs") -> DataFrame:
    """synonym_pairs_of one way and by name, as entity_pairs: src, dst, weight. own: (id); vectors: (id, v, str), ids being those of entities and str their names, which go along behind the ids, as
    these are of one length and ties are told by them."""
    named = vectors.select(F.concat("id", "str").alias("id"), "v", F.col("id").alias("own"))
    queries = named.join(own.select(F.col("id").alias("own")), "own", "left_semi").select(F.col("id").alias("qid"), "v")
    hits = top_k(queries, named.select("id", "v"), k).where((F.col("qid") != F.col("id")) & (F.col("score") >= threshold)).select(F.col("qid").alias("a"), F.col("id").alias("b"), "score")
    if mode == "leader":
        hits = leader_hits(durable(hits))
    a, b = (F.substring(c, len(ENTITY) + 66, (1 << 31) - 1) for c in ("a", "b"))  # behind the name of the kind, a dash and 64 digits
    return hits.groupBy(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).agg(F.max("score").alias("weight"))


def pairs_with_synonyms(pairs: DataFrame, synonyms: DataFrame, merge: str = "replace") -> DataFrame:
    """with_synonyms for entity_pairs: both sides have a pair once and by name, so the pairs stay where they were counted."""
    both = pairs.join(synonyms.withColumnRenamed("weight", "s"), ["src", "dst"], "full")
    r, s = F.col("weight"), F.col("s")
    return both.select("src", "dst", (F.coalesce(s, r) if merge == "replace" else F.coalesce(s, F.lit(0.0)) + F.coalesce(r, F.lit(0.0))).alias("weight"))


def leader_hits(hits: DataFrame) -> DataFrame:
    """The hits (a, b, score) of leaders: in the order of ids, an entity leads unless a leader before it hits it.

    In each round, those whose earlier hitters are all decided are decided; chains of undecided ones make the number of rounds."""
    nodes = hits.select(F.col("a").alias("n")).distinct()
    before = hits.where("a < b").select(F.col("a").alias("h"), F.col("b").alias("n")).distinct()
    state = durable(nodes.join(before, "n", "left_anti").withColumn("leads", F.lit(True)))
    while True:
        open_ = nodes.join(state, "n", "left_anti")
        seen = before.join(open_, "n").join(state.select(F.col("n").alias("h"), "leads"), "h", "left")
        # A hitter that has no hits of its own can't be here: hitters are rows of nodes.
        told = seen.groupBy("n").agg(F.bool_or("leads").alias("hit"), F.count_if(F.col("leads").isNull()).alias("unknown"))
        told = durable(told.where("hit or unknown = 0").select("n", (~F.coalesce("hit", F.lit(False))).alias("leads")))
        if told.isEmpty():
            break
        state = durable(state.unionByName(told))
    return hits.join(state.where("leads").select(F.col("n").alias("a")), "a", "left_semi")


def with_synonyms(relation_edges: DataFrame, synonyms: DataFrame, merge: str = "replace", rows: int | None = None) -> DataFrame:
    """Edges of one batch; where both have an edge, the synonym's weight replaces the other, or is added to it. An edge may come in several rows, whose weights add up. rows: so many there are of
    both, about, and tasks by them."""
    both = relation_edges.withColumn("s", F.lit(None).cast("double")).unionByName(synonyms.select("src", "dst", F.lit(None).cast("double").alias("weight"), F.col("weight").alias("s")))
    both = both if rows is None else spread(both, rows, "src", "dst")
    r, s = F.sum("weight"), F.sum("s")
    weight = F.coalesce(s, r) if merge == "replace" else F.coalesce(s, F.lit(0.0)) + F.coalesce(r, F.lit(0.0))
    return both.groupBy("src", "dst").agg(weight.alias("weight"))


def upserted(edges: DataFrame, batch: DataFrame, now: float) -> DataFrame:
    """edges with the batch's weights added; new edges are created now, changed ones updated now."""
    new = batch.select("src", "dst", "weight", F.lit(now).alias("create_time"), F.lit(now).alias("update_time"))
    return edges.unionByName(new).groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.min("create_time").alias("create_time"), F.max("update_time").alias("update_time"))


def endpoints(edges: DataFrame) -> DataFrame:
    return _ends(edges).distinct()


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id"))


def new_nodes(edges: DataFrame, nodes: DataFrame, texts: DataFrame, now: float, rows: int | None = None) -> DataFrame:
    """Nodes for the ends of edges that nodes lacks. texts: (id, str). A passage's content is its label. rows: of each of the three there are so many at most, about, and tasks by them."""
    ends = _ends(edges)
    if rows is not None:
        ends, nodes, texts = (spread(x, rows, "id") for x in (ends, nodes.select("id"), texts))
    fresh = ends.distinct().join(nodes, "id", "left_anti").join(texts, "id")
    passage = F.col("id").startswith(PARAGRAPH + "-")
    return fresh.select("id", F.when(passage, label("str")).otherwise(F.col("str")).alias("content"), F.when(passage, "pg").otherwise("ent").alias("type"), F.lit(now).alias("create_time"))


def first_rank(df: DataFrame, by: str, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
