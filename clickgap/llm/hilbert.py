"""Sharding along a Hilbert curve, in DataFrame functions only.

Metadata columns are quantised to 2^BITS buckets each by their quantiles,
the bucket tuple is turned into its Hilbert index, rows are ordered by it
and the order is cut into runs of equal count. Rows that are close on the
curve are close in every dimension, so the minimum / maximum of each
column in a run is narrow and files can be pruned by several columns.

Global positions without a global sort in one task: rows are counted per
curve cell (at most 2^(BITS * columns) of them), a cell with c rows is
split by a hash into about min(c / 256, sqrt(c)) parts, and a row's
position is rows in earlier cells + rows in earlier parts + rank in its
part. A cell that holds a third of all rows is many small parts.

Defined cases: a null dimension sorts before every value; a null text has
size 1 and the checksum of the empty text; rows that tie in everything are
repeated rows and interchangeable; an empty table gives no rows; fewer rows
than shards leave shards empty; helper columns take free names, so extra
columns of any name stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh, stage

BITS = 5            # buckets per dimension, as a power of two
BROADCAST_BITS = 18 # cells (as a power of two) up to which their table is broadcast
PART_ROWS = 256     # least rows that a part of a cell is meant to hold


def order_number(c: Column, kind: T.DataType) -> Column:
    """A double in the order of ``c``: numbers and times as they are, other
    types by the first six bytes of their text."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.BooleanType)):
        return c.cast("timestamp").cast("double") if not isinstance(kind, T.BooleanType) else c.cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    lead = F.substring(F.encode(c.cast("string"), "UTF-8"), 1, 6)
    return F.conv(F.rpad(F.hex(lead), 12, "0"), 16, 10).cast("double")


def hilbert_index(df: DataFrame, axes: str, out: str, dims: int, bits: int) -> DataFrame:
    """Column ``out``: Hilbert index of the array column ``axes`` of
    ``dims`` integers below 2^bits (Skilling's transpose form, then the
    bits interleaved). ``axes`` stays as it is."""
    def lit(v):
        return F.lit(v).cast("int")

    def turn(x, q):
        def one(x, i):
            x0, xi = F.get(x, lit(0)), F.get(x, i)
            on = xi.bitwiseAND(q) != 0
            t = F.when(on, lit(0)).otherwise(x0.bitwiseXOR(xi).bitwiseAND(q - 1))
            first = F.when(on, q - 1).otherwise(t)
            return F.transform(x, lambda v, j: v.bitwiseXOR(F.when(j == 0, first).otherwise(lit(0)))
                               .bitwiseXOR(F.when(j == i, t).otherwise(lit(0))))
        return F.aggregate(F.array(*[lit(i) for i in range(dims)]), x, one)

    kept = df.columns
    turned, gray, flip = fresh(df, "turned", "gray", "flip")
    steps = F.array(*[lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else None
    df = df.withColumn(turned, F.col(axes) if steps is None else F.aggregate(steps, F.col(axes), turn))
    # Gray code: each axis becomes the exclusive or of all up to it
    upto, marks = None, []
    for i in range(dims):
        x = F.get(F.col(turned), lit(i))
        upto = x if upto is None else upto.bitwiseXOR(x)
        marks.append(upto)
    df = df.withColumn(gray, F.array(*marks))
    if steps is None:
        df = df.withColumn(flip, lit(0))
    else:
        df = df.withColumn(flip, F.aggregate(steps, lit(0), lambda t, q: F.when(
            F.element_at(F.col(gray), -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)))
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            bit = F.shiftright(F.get(F.col(gray), lit(i)).bitwiseXOR(F.col(flip)), b).bitwiseAND(lit(1))
            index = index * 2 + bit.cast("long")
    return df.withColumn(out, index).select(*[F.col(f"`{c}`") for c in kept], out)


def quantile_axes(df: DataFrame, dims: list[str], out: str, bits: int = BITS) -> DataFrame:
    """``df`` with the array column ``out``: each dimension's quantile
    bucket. The cut points are approximate quantiles of the whole table (at
    most 2^bits - 1 numbers a dimension reach the driver)."""
    if not dims or bits < 1 or bits * len(dims) > 62:
        raise ValueError("1 to 62 bits in all")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numbers = [order_number(F.col(f"`{d}`"), kinds[d]) for d in dims]
    marks = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(*[F.percentile_approx(n, marks, 10_000).alias(f"q{i}")
                    for i, n in enumerate(numbers)]).first()
    axes = []
    for i, n in enumerate(numbers):
        at = sorted({v for v in (cuts[f"q{i}"] or []) if not math.isnan(v)})
        below = F.lit(0)
        if at:
            points = F.array(*[F.lit(v) for v in at])
            below = F.when(n.isNull(), F.lit(0)).otherwise(F.size(F.filter(points, lambda p: p < n)))
        axes.append(below.cast("int"))
    return df.withColumn(out, F.array(*axes))


def curve_cells(df: DataFrame, dims: list[str], out: str, bits: int = BITS) -> DataFrame:
    """``df`` with column ``out``: the Hilbert index of its quantised
    ``dims``."""
    name, = fresh(df, "axes")
    return hilbert_index(quantile_axes(df, dims, name, bits), name, out, len(dims), bits).drop(name)


def shards(df: DataFrame, dims: list[str], n_shards: int, ties: list[Column],
           names: tuple[str, str, str] = ("shard", "slot", "curve"), bits: int = BITS) -> DataFrame:
    """``df`` with its shard (counts at most one apart), the slot in the
    shard (0 upwards without gaps) and the curve index. ``ties``: columns
    that tell rows of one cell apart."""
    shard, slot, curve = names
    if {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {names} are taken; choose other names")
    spread, part, parts, before, rank, axes = fresh(df, "spread", "part", "parts", "before", "rank", "axes")
    base = quantile_axes(df, dims, axes, bits).withColumn(spread, F.xxhash64(*ties))

    # the index is worked out once per cell, not per row
    cells = hilbert_index(base.groupBy(axes).agg(F.count("*").alias(rank)), axes, curve, len(dims), bits)
    cells = stage(cells.withColumn(                     # at most 2^(bits * dims) rows
        before, F.sum(rank).over(Window.orderBy(curve).rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn(parts, F.ceil(F.least(F.col(rank) / PART_ROWS, F.sqrt(rank)))))
    total = cells.agg(F.sum(rank)).first()[0] or 0
    small = cells.select(axes, curve, F.coalesce(before, F.lit(0)).alias(before), parts)
    if bits * len(dims) <= BROADCAST_BITS:
        small = F.broadcast(small)
    split = base.join(small, axes).drop(axes).withColumn(part, F.pmod(F.col(spread), F.col(parts)))

    counted = split.groupBy(curve, part, before).agg(F.count("*").alias(rank))
    w = Window.partitionBy(curve).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(curve, part, (F.col(before) + F.coalesce(F.sum(rank).over(w), F.lit(0))).alias(before))
    own = Window.partitionBy(curve, part).orderBy(spread, *ties)
    placed = split.drop(before).withColumn(rank, F.row_number().over(own)) \
        .join(starts, [curve, part])
    at = F.col(before) + F.col(rank) - 1
    n = max(total, 1)
    out = placed.withColumn(before, at) \
        .withColumn(shard, F.floor(F.col(before) * n_shards / F.lit(n)).cast("int") if n * n_shards < 2 ** 52
                    else F.expr(f"cast(`{before}` * {n_shards} div {n} AS int)")) \
        .withColumn(slot, F.col(before) - F.expr(f"(cast(`{shard}` AS bigint) * {n} + {n_shards - 1}) div {n_shards}"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], shard, slot, curve)


def document_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                    dims: tuple = ("lang", "source", "n_chars"), **kw) -> DataFrame:
    """``docs`` sharded over its metadata, with ``size`` (UTF-8 bytes of the
    text plus 1) and ``text_crc32``."""
    size, crc = fresh(docs, "size", "text_crc32")
    whole = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.withColumn(size, (F.octet_length(whole) + 1).cast("long")).withColumn(crc, F.crc32(whole))
    return shards(df, list(dims), n_shards, [F.col(f"`{id_col}`"), F.col(crc), F.col(size)], **kw)


def write_shards(sharded: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder per shard, rows in curve order: ranges of (shard, slot)
    are dealt to tasks, so each file covers a short run of the curve."""
    sharded.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot) \
        .write.partitionBy(shard).parquet(path)
