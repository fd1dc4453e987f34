"""Mixing sources to target weights by Poisson replication.

A source with n rows and target share w of T rows is repeated at the mean
rate w * T / n. Each document's count is the Poisson distribution at that
rate inverted at a number in [0, 1) that a hash of seed, id and text fixes,
so the same document always gets the same count; it is exploded into as
many replicas and all replicas are ordered by another hash - a global
shuffle dealt by range, with no hot key.

Rates above PIECE are split into equal pieces, each inverted with its own
hash and summed (a sum of Poisson counts is Poisson), which keeps exp(-rate)
in range and the distribution tables short.

Scale: the only table beside the documents has one row per source; it is
broadcast when it has at most BROADCAST_SOURCES rows and joined by a
(skew-split) shuffle beyond. A source that holds a third of all rows adds
one pre-aggregated count.

Defined cases: null source is a source of its own; null text counts as
empty; rows repeated with the same id and text get the same count each; a
source without target weight (explicit weights) has rate 0 and disappears;
an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage

SEED = 17
ALPHA = 0.7                     # default target: share of n^ALPHA
PIECE = 500.0                   # largest rate inverted at once
BROADCAST_SOURCES = 20_000


def source_rates(docs: DataFrame, source: str, total: int | None = None,
                 weights: dict | None = None, alpha: float = ALPHA) -> DataFrame:
    """(source, n, rate): mean repetitions that give each source its share
    of ``total`` rows (all rows, unless given). Shares follow ``weights``,
    or n^alpha without them."""
    counts = stage(docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count("*").alias("n")))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        pairs = [(k, float(v)) for k, v in weights.items()]
        given = docs.sparkSession.createDataFrame(pairs, "k string, w double")
        counts = counts.join(F.broadcast(given), F.col("source").cast("string").eqNullSafe(F.col("k")), "left") \
            .select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    got = counts.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    if not got["n"] or not got["w"]:
        return counts.select("source", "n", F.lit(0.0).alias("rate"))
    goal = float(got["n"] if total is None else total)
    return counts.select("source", "n", (F.col("w") * goal / F.lit(float(got["w"])) / F.col("n")).alias("rate"))


def poisson_table(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, 2, ... at ``rate``, far
    enough that the rest is below double precision."""
    far = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("term"), F.array(F.exp(-rate)).alias("cdf"))

    def more(acc, k):
        term = acc["term"] * rate / k
        return F.struct(term.alias("term"),
                        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + term)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), far), start, more, lambda acc: acc["cdf"])


def unit_hash(*parts: Column) -> Column:
    """52 hashed bits as a number in [0, 1)."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, source: str = "source", id_col: str = "doc_id", text_col: str = "text",
        total: int | None = None, weights: dict | None = None, alpha: float = ALPHA, seed: int = SEED,
        names: tuple[str, str, str] = ("copies", "replica", "shuffle_key"), keep_order: bool = True) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in shuffled
    order: added columns copies (its count), replica (1 to copies) and the
    hash that orders the result."""
    copies, replica, order = names
    if {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {names} are taken; choose other names")
    who, tables, key = fresh(docs, "who", "tables", "source_key")
    rates = source_rates(docs, source, total, weights, alpha)
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int")
    rates = stage(rates.withColumn("pieces", pieces)
                  .withColumn("cdf", poisson_table(F.col("rate") / F.col("pieces")))
                  .select(F.col("source").alias(key), F.struct("pieces", "cdf").alias(tables)))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    df = docs.withColumn(who, F.concat_ws(
        ":", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("?")),
        F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))
    df = df.join(rates, F.col(f"`{source}`").eqNullSafe(F.col(key)))
    drawn = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.col(tables)["pieces"]),
                    lambda j: unit_hash(F.lit(str(seed)), j.cast("string"), F.col(who))), F.lit(0),
        lambda acc, u: acc + F.size(F.filter(F.col(tables)["cdf"], lambda c: c <= u)))
    df = df.withColumn(copies, drawn).where(F.col(copies) > 0)
    df = df.withColumn(replica, F.explode(F.sequence(F.lit(1), F.col(copies))))
    df = df.withColumn(order, F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.col(who),
                                                F.col(replica).cast("string"))))
    df = df.select(*[F.col(f"`{c}`") for c in docs.columns], copies, replica, order)
    return df.orderBy(order) if keep_order else df
