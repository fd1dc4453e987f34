"""Result writers.

Each writes a directory with Spark's own writers: CSV with a header for
the cluster and page tables (optionally partitioned by segment), one
JSON document and one markdown text for the brief, or a table in the
catalog for reuse by later views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def _flat(df: DataFrame) -> DataFrame:
    """CSV cannot hold arrays or structs: turn them into JSON text."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import ArrayType, MapType, StructType
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            cols.append(F.to_json(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Header CSV; ``partition_by='segment'`` writes one folder per segment."""
    w = _flat(df).write.mode("overwrite").option("header", True)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """A one-row document column as a single text file."""
    df.select(column).coalesce(1).write.mode("overwrite").text(path)


def save_results(results: dict[str, DataFrame], prefix: str) -> None:
    """Keep the result tables as catalog tables for later views."""
    for name, df in results.items():
        df.write.mode("overwrite").saveAsTable(f"{prefix}_{name}")
