"""Parameters of the retrieval engine."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

# Namespaces of node ids.
PARAGRAPH, ENTITY, RELATION = "paragraph", "entity", "relation"

# Words that are no entities.
STOP_ENTITIES = ("", "你", "他", "她", "它", "我们", "你们", "他们", "她们", "它们")


@dataclass(frozen=True)
class Rag:
    synonym_search_top_k: int = 10
    synonym_threshold: float = 0.8


@dataclass(frozen=True)
class Qa:
    relation_search_top_k: int = 10
    relation_threshold: float = 0.5
    paragraph_search_top_k: int = 1000
    paragraph_node_weight: float = 0.05
    ent_filter_top_k: int = 10
    ppr_damping: float = 0.8
    res_top_k: int = 3


@dataclass(frozen=True)
class Compatibility:
    """Where literal behaviour and intent differ: the defaults and what they can be set to."""

    jump: str = "literal"  # or "gap": the threshold at the largest gap between neighbours
    legacy_entity_filter: bool = False  # drop every entity once there are more than the top k
    synonyms: str = "all_pairs"  # or "leader": greedy stars in the order of the ids
    raw_query: bool = False  # score by the inner product with the query as it is
    synonym_merge: str = "replace"  # or "add": how synonym weights meet relation weights of one batch
    strict: bool = False  # a document without entities or triples aborts an import
    link_objects: bool = False  # link passages to objects too, not to subjects alone
    filter_triples_by_stoplist: bool = False


@dataclass(frozen=True)
class Config:
    providers: dict = field(default_factory=dict)
    models: dict = field(default_factory=dict)
    dimension: int = 1024
    rag: Rag = Rag()
    qa: Qa = Qa()
    compatibility: Compatibility = Compatibility()
    persistence: dict = field(default_factory=dict)


def _known(kind: type, values: dict):
    names = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in values.items() if k in names})


def load_config(path: str | None = None, base: Config | None = None) -> Config:
    """base with the sections of a TOML file in place of its own: whole sections are replaced, providers are merged by name. A file that is not there changes nothing."""
    config = base or Config()
    if path is None or not Path(path).exists():
        return config
    with open(path, "rb") as f:
        read = tomllib.load(f)
    providers = dict(config.providers)
    for p in read.get("llm_providers", []):
        providers[p["name"]] = {"base_url": p["base_url"], "api_key": p["api_key"]}
    models = dict(config.models)
    for section in ("entity_extract", "rdf_build", "qa"):
        if "llm" in read.get(section, {}):
            models[section] = read[section]["llm"]
    if "embedding" in read:
        models["embedding"] = {k: v for k, v in read["embedding"].items() if k != "dimension"}
    return replace(
        config, providers=providers, models=models,
        dimension=read.get("embedding", {}).get("dimension", config.dimension),
        rag=_known(Rag, read["rag"].get("params", {})) if "rag" in read else config.rag,
        qa=_known(Qa, read["qa"].get("params", {})) if "qa" in read else config.qa,
        compatibility=_known(Compatibility, read["compatibility"]) if "compatibility" in read else config.compatibility,
        persistence=read.get("persistence", config.persistence),
    )
