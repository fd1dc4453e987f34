"""Numeric parsing of exported metric columns.

Missing numbers are Spark nulls, never NaN: ``greatest``/``median``/``sum``
skip nulls, but NaN compares as the largest double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# A plain decimal / scientific number, or an infinity word.
_NUMBER_TEXT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_INF_TEXT = r"(?i)^\s*[+-]?(inf|infinity)\s*$"


def _no_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def number_or_null(c: Column, is_string: bool) -> Column:
    """Lenient number parse: unparsable text ("1,234", "3,4", "5d") -> null."""
    if not is_string:
        return _no_nan(c.cast("double"))
    s = c.cast("string")
    ok = s.rlike(_NUMBER_TEXT) | s.rlike(_INF_TEXT)
    return _no_nan(F.when(ok, F.trim(s).try_cast("double")))


def number_or_zero(c: Column, is_string: bool) -> Column:
    return F.coalesce(number_or_null(c, is_string), F.lit(0.0))


def parse_ctr(c: Column, is_string: bool) -> Column:
    """"5.3%" -> 0.053; "0.053" -> 0.053; a number stays as is; else null."""
    if not is_string:
        return _no_nan(c.cast("double"))
    s = F.trim(c.cast("string"))
    pct_body = F.trim(F.substring_index(s, "%", 1))
    pct = F.when(pct_body.rlike(_NUMBER_TEXT) | pct_body.rlike(_INF_TEXT),
                 pct_body.try_cast("double") / F.lit(100.0))
    plain = F.when(s.rlike(_NUMBER_TEXT) | s.rlike(_INF_TEXT), s.try_cast("double"))
    # only a single trailing '%' counts as a percentage
    is_pct = s.endswith("%") & (F.length(s) - F.length(F.regexp_replace(s, "%", "")) == 1)
    return _no_nan(F.when(s.endswith("%"), F.when(is_pct, pct)).otherwise(plain))


def backfill_ctr(ctr: Column, clicks: Column, impressions: Column) -> Column:
    """Missing CTR with impressions > 0 -> clicks / impressions."""
    return F.when(ctr.isNull() & (impressions > 0), clicks / impressions).otherwise(ctr)


def is_string_col(df: DataFrame, name: str) -> bool:
    """Numeric columns are cast directly; anything else is parsed as text."""
    return not isinstance(df.schema[name].dataType, NumericType)


def pos_bucket(position: Column) -> Column:
    return (F.when(position.isNull(), "unknown")
            .when(position <= 3, "1-3")
            .when(position <= 6, "4-6")
            .when(position <= 10, "7-10")
            .when(position <= 20, "11-20")
            .otherwise("21+"))
