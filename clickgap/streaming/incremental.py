"""Stateless enrichment on a stream of export files.

The per-row layer (P1-P24: parsing, normalisation, exclusion, intent,
brand and term flags, segment, URL slug and tokens) needs no state, so
the same column expressions run unchanged on ``readStream``: new export
files landing in a folder are enriched as they arrive and appended to a
sink. Medians, quantiles, TF-IDF and clustering need the whole table and
stay batch jobs over the accumulated output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickgap.config import Config
from clickgap.operators import enrich

RAW_QUERY_SCHEMA = "query string, clicks string, impressions string, ctr_raw string, position string"


def stream_queries(spark: SparkSession, folder: str, schema: str = RAW_QUERY_SCHEMA) -> DataFrame:
    """Streaming source of query exports already in the fixed field names
    (CSV with a header), with the file each row came from. Row ids are
    assigned when the accumulated output is read as a batch table."""
    raw = (spark.readStream.schema(schema).option("header", True).option("escape", '"')
           .csv(folder))
    return raw.withColumn("source_file", F.input_file_name())


def enrich_stream(stream: DataFrame, cfg: Config) -> DataFrame:
    """The batch enrichment, applied to a streaming DataFrame."""
    return enrich.preprocess_queries(stream, cfg)


def start_enrichment(stream: DataFrame, cfg: Config, sink_path: str, checkpoint: str,
                     trigger_once: bool = False):
    """Append enriched rows to a parquet folder; ``checkpoint`` must be a
    shared folder (the stream's progress survives driver restarts)."""
    w = (enrich_stream(stream, cfg).writeStream.format("parquet").outputMode("append")
         .option("path", sink_path).option("checkpointLocation", checkpoint))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
