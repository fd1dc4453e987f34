"""Intent keyword configuration.

The configuration is a JSON object intent -> list of keywords. It is read
with Spark (``wholetext`` + ``from_json``) and its keyword lists become
regex literals on the driver - a handful of strings, never rows.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickgap.config import DEFAULT_INTENT_KEYWORDS, INTENT_ORDER, Config
from clickgap.functions.rules import parse_term_text

CONFIG_TYPE = "map<string, array<string>>"


def read_keyword_config(spark: SparkSession, path: str) -> DataFrame:
    """(intent, keywords) rows of a keyword JSON file; fails if the file is
    not a JSON object of string lists."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", CONFIG_TYPE).alias("m"))
    if parsed.filter(F.col("m").isNull()).limit(1).count():
        raise ValueError("keyword config must be a JSON object of intent -> list of keywords")
    return parsed.select(F.explode("m").alias("intent", "keywords"))


def keyword_counts(config: DataFrame) -> DataFrame:
    """Number of keywords per intent."""
    return config.select("intent", F.size("keywords").alias("keywords"))


def to_dict(config: DataFrame) -> dict[str, list[str]]:
    """Collect the (tiny) config for rule building; unknown intents dropped."""
    out = {r["intent"]: list(r["keywords"] or []) for r in config.collect()}
    return {k: out[k] for k in INTENT_ORDER if k in out}


def write_keyword_config(spark: SparkSession, keywords: dict[str, list[str]], path: str) -> None:
    """Write the configuration as one JSON document (S5 write)."""
    df = spark.createDataFrame([(json.dumps(keywords, indent=2),)], "value string")
    df.coalesce(1).write.mode("overwrite").text(path)


def parse_keyword_text(text: str | None) -> list[str]:
    """Comma- or newline-separated keywords, trimmed, empties dropped."""
    return parse_term_text(text)


def keyword_lists_from_text(texts: dict[str, str | None]) -> dict[str, list[str]]:
    """Per-intent keyword text boxes -> keyword lists (an empty box gives [])."""
    return {k: parse_keyword_text(v) for k, v in texts.items()}


def default_keywords() -> dict[str, list[str]]:
    return {k: list(v) for k, v in DEFAULT_INTENT_KEYWORDS.items()}


def with_keywords(cfg: Config, config: DataFrame | dict[str, list[str]]) -> Config:
    """``cfg`` with the intent keywords of a read configuration (or of a
    plain dict); intents it does not name keep their defaults."""
    given = config if isinstance(config, dict) else to_dict(config)
    return replace(cfg, intent_keywords=default_keywords() | given)
