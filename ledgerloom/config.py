"""Settings: nested defaults, overrides by file content or environment, checks, and the
operators run by them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import constants as K
from .operators import chat, cleaning, formatting, memory
from .operators.tables import Store

DEFAULTS: dict[str, Any] = {
    "cleaning": {"filtering": dict(K.CLEANING), "sources": {k: {"filtering": dict(v)} for k, v in K.CLEANING_BY_SOURCE.items()},
                 "dedup": {"enabled": True, "threshold": K.FUZZY_THRESHOLD, "use_fuzzy": True, "block_prefix": K.BLOCK_PREFIX}, "profiling_exclusion": {"enabled": True}},
    "format": {"schema": "chat-v1", "system_prompt": None},
    "split": {"train": 0.8, "val": 0.1, "test": 0.1, "seed": 42, "stratify_by_source": True},
    "memory": {"top_k": memory.TOP_K, "relevance_threshold": memory.RELEVANT, "dedup_similarity_threshold": memory.SAME, "max_turns_in_context": memory.HISTORY,
               "retriever": "keyword", "default_user_id": "anonymous"},
    "evaluation": {"good_rubric": K.GOOD_RUBRIC},
    "store": {"path": "warehouse/store"},
}
#: Environment variables that override a setting, by its dotted name.
ENVIRONMENT = {"store.path": "LEDGERLOOM_STORE"}


def merged(base: Mapping[str, Any], over: Mapping[str, Any] | None) -> dict[str, Any]:
    """A new mapping in which nested mappings merge key by key and other values replace."""
    out = {k: merged(v, None) if isinstance(v, Mapping) else v for k, v in base.items()}
    for k, v in (over or {}).items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def settings(over: Mapping[str, Any] | None = None, environ: Mapping[str, str] | None = None) -> dict[str, Any]:
    """The defaults with overrides, then the environment's. Raises if split shares miss 1."""
    out = merged(DEFAULTS, over)
    for dotted, name in ENVIRONMENT.items():
        value = (os.environ if environ is None else environ).get(name)
        if value:
            section, key = dotted.split(".")
            out[section][key] = value
    shares = [out["split"][k] for k in ("train", "val", "test")]
    if abs(sum(shares) - 1.0) > 1e-6:
        raise ValueError(f"split shares must sum to 1, got {shares}")
    return out


def for_source(config: Mapping[str, Any], source: str) -> dict[str, Any]:
    """The cleaning settings with those of one source on top."""
    return merged(config["cleaning"], config["cleaning"]["sources"].get(source))


def read_yaml(path: str) -> dict[str, Any]:
    """The mapping of a YAML file; empty for an empty one. Needs PyYAML."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def clean(records: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """Records with the reason to go, by the settings' limits and those of single sources."""
    c = config["cleaning"]
    own = {k: v.get("filtering", {}) for k, v in c["sources"].items()}
    return cleaning.with_reason(records, limits=c["filtering"], by_source=own, profiling=c["profiling_exclusion"]["enabled"])


def dedup(records: DataFrame, config: Mapping[str, Any], order: str = "ord") -> DataFrame:
    """Records with ``kind``, exact or fuzzy as the settings have it; all kept if it is off."""
    d = config["cleaning"]["dedup"]
    if not d["enabled"]:
        return records.withColumn("kind", F.lit("kept"))
    return cleaning.dedup_fuzzy(records, order, d["threshold"], d["block_prefix"]) if d["use_fuzzy"] else cleaning.dedup_exact(records, order)


def chat_records(records: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    return formatting.chat_records(records, config["format"]["schema"], config["format"]["system_prompt"])


def split(records: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """Records with ``split``, in each source or over all of them."""
    s = config["split"]
    if s["stratify_by_source"]:
        return formatting.split(records, s["seed"], (s["train"], s["val"]))
    return formatting.split(records.withColumn("__all", F.lit("")), s["seed"], (s["train"], s["val"]), by="__all").drop("__all")


def retrieve(queries: DataFrame, memories: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    m = config["memory"]
    return memory.retrieve(queries, memories, m["top_k"], m["relevance_threshold"], m["retriever"])


def upserted(rows: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    return memory.upserted(rows, config["memory"]["dedup_similarity_threshold"])


def run_chat(requests: DataFrame, turns: DataFrame, memories: DataFrame, config: Mapping[str, Any], author: chat.Author = chat.echo_author) -> chat.ChatTurns:
    known = requests.withColumn("user_id", F.coalesce("user_id", F.lit(config["memory"]["default_user_id"])))
    return chat.run_chat(known, turns, memories, author, config["format"]["system_prompt"] or "", config["memory"]["max_turns_in_context"])


def store(spark: SparkSession, config: Mapping[str, Any]) -> Store:
    return Store(spark, config["store"]["path"])
