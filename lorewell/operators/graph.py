"""A directed graph as two frames: nodes (id, attrs) and edges (src, dst, weight, attrs). Graphs don't change; every operation returns a new one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lorewell.sources.graphml import read_graphml, write_graphml
from lorewell.sources.store import durable

ATTRS = "map<string, struct<int: bigint, float: double, str: string>>"
NODES = f"id string, attrs {ATTRS}"
EDGES = f"src string, dst string, weight double, attrs {ATTRS}"


def _cell(value) -> tuple:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return (None, None, str(value))
    return (value, None, None) if isinstance(value, int) else (None, value, None)


def _attrs(values: dict | None) -> dict:
    return {k: _cell(v) for k, v in (values or {}).items()}


def _plain(attrs: dict | None) -> dict:
    return {k: next((v[c] for c in ("int", "float", "str") if v[c] is not None), None) for k, v in (attrs or {}).items()}


@dataclass(frozen=True)
class DiGraph:
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> DiGraph:
        return cls(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DiGraph:
        nodes, edges = read_graphml(spark, path)
        return cls(nodes, edges.select("src", "dst", "weight", "attrs"))

    def save(self, path: str, compressed: bool = False) -> None:
        own = F.create_map(F.lit("weight"), F.struct(F.lit(None).cast("bigint").alias("int"), F.col("weight").alias("float"), F.lit(None).cast("string").alias("str")))
        rest = F.map_filter(F.coalesce("attrs", F.create_map().cast(ATTRS)), lambda k, _: k != "weight")
        write_graphml(self.nodes, self.edges.withColumn("attrs", F.map_concat(rest, own)), path, compressed)

    def settled(self) -> DiGraph:
        """The same graph, written down: what it has gone through is no part of its plan any more, and what was removed takes no room. After every few changes."""
        return DiGraph(durable(self.nodes), durable(self.edges))

    def clear(self) -> DiGraph:
        return DiGraph.empty(self.nodes.sparkSession)

    # Rows given by the caller.

    def _node_rows(self, items: list[tuple[str, dict | None]]) -> DataFrame:
        return self.nodes.sparkSession.createDataFrame([(n, _attrs(a)) for n, a in items], NODES)

    def _edge_rows(self, items: list[tuple[str, str, dict | None]]) -> DataFrame:
        return self.edges.sparkSession.createDataFrame([(s, d, float((a or {}).get("weight", 0.0)), _attrs(a)) for s, d, a in items], EDGES)

    @staticmethod
    def _clash(rows: DataFrame, have: DataFrame, keys: list[str], there: bool) -> None:
        """KeyError if a key is in have (there) or isn't (not there), or, when adding, comes twice."""
        found = rows.join(have, keys, "left_semi" if there else "left_anti").select(keys).first()
        if found is None and there:
            found = rows.groupBy(keys).count().where("count > 1").select(keys).first()
        if found is not None:
            raise KeyError(tuple(found) if len(keys) > 1 else found[0])

    def add_nodes(self, rows: DataFrame | list) -> DiGraph:
        rows = self._node_rows(rows) if isinstance(rows, list) else rows
        self._clash(rows, self.nodes, ["id"], True)
        return DiGraph(self.nodes.unionByName(rows), self.edges)

    def add_edges(self, rows: DataFrame | list) -> DiGraph:
        """Ends that are no nodes yet become nodes."""
        rows = self._edge_rows(rows) if isinstance(rows, list) else rows
        self._clash(rows, self.edges, ["src", "dst"], True)
        ends = self.absent_ends(rows).withColumn("attrs", F.create_map().cast(ATTRS))
        return DiGraph(self.nodes.unionByName(ends), self.edges.unionByName(rows))

    def absent_ends(self, edges: DataFrame) -> DataFrame:
        return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(self.nodes, "id", "left_anti")

    def update_nodes(self, rows: DataFrame | list) -> DiGraph:
        rows = self._node_rows(rows) if isinstance(rows, list) else rows
        self._clash(rows, self.nodes, ["id"], False)
        return DiGraph(self.nodes.join(rows, "id", "left_anti").unionByName(rows), self.edges)

    def update_edges(self, rows: DataFrame | list) -> DiGraph:
        rows = self._edge_rows(rows) if isinstance(rows, list) else rows
        self._clash(rows, self.edges, ["src", "dst"], False)
        return DiGraph(self.nodes, self.edges.join(rows, ["src", "dst"], "left_anti").unionByName(rows))

    def remove_edges(self, keys: DataFrame | list) -> DiGraph:
        keys = self.edges.sparkSession.createDataFrame(keys, "src string, dst string") if isinstance(keys, list) else keys
        self._clash(keys, self.edges, ["src", "dst"], False)
        return DiGraph(self.nodes, self.edges.join(keys, ["src", "dst"], "left_anti"))

    def remove_nodes(self, keys: DataFrame | list) -> DiGraph:
        """Nodes go with their edges."""
        keys = self.nodes.sparkSession.createDataFrame([(k,) for k in keys], "id string") if isinstance(keys, list) else keys
        self._clash(keys, self.nodes, ["id"], False)
        left = self.edges.join(keys.withColumnRenamed("id", "src"), "src", "left_anti").join(keys.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return DiGraph(self.nodes.join(keys, "id", "left_anti"), left.select(self.edges.columns))

    def out_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))

    # Single items, by id or by (src, dst).

    def _one(self, key: str | tuple) -> Row | None:
        if isinstance(key, str):
            return self.nodes.where(F.col("id") == key).first()
        if isinstance(key, tuple) and len(key) == 2 and all(isinstance(k, str) for k in key):
            return self.edges.where((F.col("src") == key[0]) & (F.col("dst") == key[1])).first()
        raise TypeError("a node's id or an edge's (src, dst) is asked for")

    def __contains__(self, key: str | tuple) -> bool:
        return self._one(key) is not None

    def __getitem__(self, key: str | tuple) -> dict:
        """The attributes of a node or an edge; KeyError if there is none."""
        row = self._one(key)
        if row is None:
            raise KeyError(key)
        return _plain(row["attrs"]) | ({} if isinstance(key, str) else {"weight": row["weight"]})

    def without(self, key: str | tuple) -> DiGraph:
        if self._one(key) is None:
            raise KeyError(key)
        return self.remove_nodes([key]) if isinstance(key, str) else self.remove_edges([key])
