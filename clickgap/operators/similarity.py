"""Cosine similarity joins over TF-IDF long tables.

``similarity_pairs`` finds every pair of unit vectors with cosine above
``min_sim`` inside a stratum. The vectors of a stratum are cut into blocks of
at most ROWS by a hash of their key, every pair of blocks is a group, and a
task joins the two blocks by their inverted lists (``blocks.near_pairs``):
partial products stay in the task's arrays, only pairs above the cut are
written. Each vector is shuffled once a block of its stratum: SPREAD times
while a stratum has up to SPREAD * ROWS vectors, and with the square of the
vectors beyond (as the pairs to be excluded). Terms are told apart by 64-bit
hashes.

``candidates`` is the same bound as joins of rows (a row a partial product,
some thousand a vector), without Python; the tests hold both to it.

Terms are grouped into levels by the power of two below their document
frequency, rare ones first. u(x, l) is the norm of vector x from level l on,
and m(x, l) the sum of its weights there times each term's largest weight.
What a pair can gain from level l on is at most

    gain(l) = min(u(x, l) * u(y, l), m(x, l), m(y, l)),

so a pair above ``min_sim`` shares a term on a level with gain(l) >=
``min_sim``. Joined are the terms on levels with gain(l) >= JOINED *
``min_sim``: frequent terms meet only between vectors that are made of
frequent terms. (JOINED below 1 joins more and leaves less to bound.)

* Norm buckets: in a term's posting list the vectors are put in buckets by
  u, each twice as large in u^2 as the one before, and only bucket pairs
  whose product can reach that gain are join keys.
* Position bound: a candidate's joined terms are all it shares up to its
  highest joined level; above it the gain of the next level bounds what is
  left. Sum plus bound must exceed ``min_sim``; few survive, and those get
  their exact cosine from the whole vectors.
* Blocks: a bucket of a list longer than ``block`` is cut into blocks by
  vector, and each pair of blocks is a join key of its own, so no task reads
  more of a term than two blocks, whatever its frequency.

Join keys are 64-bit hashes of stratum, term and bucket pair. A collision
could only add to a candidate's sum, never lose a pair; the exact cosine is
worked out on the terms themselves.

``dot_products`` is the plain inverted-index join used by the page match.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickgap.session import materialize, ship_package

_EPS = 1e-9
BLOCK = 1024        # postings of one side that a join key holds
ROWS = 1 << 16      # most vectors of a block of the block join
SMALL = 1 << 12     # vectors that are not cut into blocks
SPREAD = 6          # blocks that a stratum is cut into for parallel work alone
MOST_TASKS = 20_000
JOINED = 0.5        # share of min_sim below which what is left of a pair is bounded, not joined


def term_levels(weights: DataFrame, strata: list[str], key: str) -> DataFrame:
    """(strata, _s, key, term, w, lv, maxw, nd): stratum hash, level of the
    term, its largest weight and the number of vectors that have it."""
    s = F.xxhash64(*strata) if strata else F.lit(0).cast("long")
    w = weights.select(*strata, s.alias("_s"), key, "term", "w", F.floor(F.log2(F.col("df").cast("double"))).cast("int").alias("lv"))
    terms = w.groupBy("_s", "term").agg(F.max("w").alias("maxw"), F.count("*").alias("nd"))
    return w.join(terms, ["_s", "term"])


def vector_levels(w: DataFrame, key: str) -> DataFrame:
    """(_s, key, lv, u, m, next_u, next_m): norm and largest product of the
    vector from each of its levels on, and from the level after."""
    levels = w.groupBy("_s", key, "lv").agg(F.sum(F.col("w") * F.col("w")).alias("sq"),
                                            F.sum(F.col("w") * F.col("maxw")).alias("most"))
    down = Window.partitionBy("_s", key).orderBy(F.col("lv").desc())
    here, after = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1)

    def tail(col, over):
        return F.coalesce(F.sum(col).over(over), F.lit(0.0))
    return levels.select("_s", key, "lv", F.sqrt(tail("sq", here)).alias("u"), tail("most", here).alias("m"),
                         F.sqrt(tail("sq", after)).alias("next_u"), tail("most", after).alias("next_m"))


def postings(w: DataFrame, levels: DataFrame, key: str, gain: float) -> DataFrame:
    """(_s, tk, key, w, u, m, next_u, next_m, bucket) of the terms that
    another vector has, on levels that can give ``gain``."""
    low = F.lit(gain - _EPS)
    return (w.where("nd > 1").join(levels.where((F.col("u") >= low) & (F.col("m") >= low)), ["_s", key, "lv"])
             .select("_s", F.xxhash64("_s", "term").alias("tk"), key, "w", "u", "m", "next_u", "next_m",
                     # a hair upwards: a norm on the edge counts as above it
                     F.greatest(F.floor(2 * F.log2(F.col("u") / gain) + 1e-7), F.lit(0)).cast("int").alias("bucket")))


def bucket_pairs(gain: float) -> list[tuple[int, int]]:
    """(lower, upper) buckets whose norms can multiply to ``gain``: bucket k
    holds norms below gain * 2^((k + 1) / 2)."""
    last = int(2 * math.log2(1 / gain) + 1e-7)
    need = 2 * math.log2(1 / gain) - 2
    return [(j, k) for j in range(last + 1) for k in range(j, last + 1) if j + k > need + 1e-6]


def block_pairs(post: DataFrame, key: str, gain: float, block: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of the candidate join. A posting goes to each bucket
    pair of its bucket and there, where the partner's list is longer than
    ``block``, to each of the partner's blocks."""
    pairs = bucket_pairs(gain)
    last = max(k for _, k in pairs)
    sizes = (post.groupBy("tk").agg(*[F.count_if(F.col("bucket") == b).alias(f"n{b}") for b in range(last + 1)])
                 .where(" OR ".join(f"n{b} > {block}" for b in range(last + 1)))
                 .select("tk", F.array(*[F.greatest(F.ceil(F.col(f"n{b}") / block), F.lit(1)).cast("int")
                                         for b in range(last + 1)]).alias("blocks")))
    cut = post.where(F.col("bucket") <= last).join(sizes, "tk", "left") \
        .withColumn("blocks", F.coalesce("blocks", F.array(*[F.lit(1)] * (last + 1))))

    def side(name, mine, partner):
        """Rows of one side: ``mine`` is this side's place in the pairs."""
        of = {b: [p[partner] for p in pairs if p[mine] == b] for b in range(last + 1)}
        choice = F.lit(None).cast("array<int>")
        for b, partners in of.items():
            choice = F.when(F.col("bucket") == b, F.array(*[F.lit(x) for x in partners]).cast("array<int>")).otherwise(choice)
        rows = cut.withColumn("partner", F.explode(choice)) \
            .withColumn("here", F.pmod(F.xxhash64(key), F.get("blocks", F.col("bucket"))).cast("int")) \
            .withColumn("there", F.explode(F.sequence(F.lit(0), F.get("blocks", F.col("partner")) - 1)))
        low, high = (F.col("bucket"), F.col("partner")) if mine == 0 else (F.col("partner"), F.col("bucket"))
        lb, rb = (F.col("here"), F.col("there")) if mine == 0 else (F.col("there"), F.col("here"))
        return rows.select(F.xxhash64("tk", low, high, lb, rb).alias("jk"), F.col("_s").alias(f"s_{name}"),
                           F.col(key).alias(f"k_{name}"), F.col("w").alias(f"w_{name}"), F.col("bucket").alias(f"b_{name}"),
                           *[F.col(c).alias(f"{c}_{name}") for c in ("u", "m", "next_u", "next_m")])
    return side("l", 0, 1), side("r", 1, 0)


def candidates(post: DataFrame, key: str, min_sim: float, block: int = BLOCK) -> DataFrame:
    """(_s, a, b), a < b: pairs whose joined products plus the most that
    the levels above can add exceed ``min_sim``."""
    left, right = block_pairs(post, key, JOINED * min_sim, block)
    low = F.lit(JOINED * min_sim - _EPS)
    # two vectors of one bucket meet from both sides: take one
    met = left.join(right, "jk").where("s_l = s_r AND (k_l < k_r OR (b_l < b_r AND k_l <> k_r))") \
        .where((F.col("u_l") * F.col("u_r") >= low) & (F.least("m_l", "m_r") >= low))
    rest = F.least(F.col("next_u_l") * F.col("next_u_r"), "next_m_l", "next_m_r")
    return (met.groupBy(F.col("s_l").alias("_s"), F.least("k_l", "k_r").alias("a"), F.greatest("k_l", "k_r").alias("b"))
               .agg(F.sum(F.col("w_l") * F.col("w_r")).alias("joined"), F.min(rest).alias("rest"))
               .where(F.col("joined") + F.col("rest") > F.lit(min_sim - _EPS)).select("_s", "a", "b"))


def similarity_pairs(weights: DataFrame, strata: list[str], key: str, min_sim: float,
                     block: int = ROWS) -> DataFrame:
    """(strata, a, b, sim) with a < b and sim > min_sim (exact).

    weights: strata, key (a long), term, w (unit vectors, positive), df; a
    term of df 1 is in no other vector."""
    from clickgap.operators.blocks import pack_lists

    ship_package(weights.sparkSession)
    lists = weights.where("df > 1").groupBy(*strata, key).agg(
        F.collect_list(F.struct(F.xxhash64("term").alias("tk"), F.col("w").cast("double").alias("w"))).alias("e")) \
        .select(*strata, F.col(key).cast("long").alias(key), F.col("e.tk").alias("tk"), F.col("e.w").alias("w"))
    kinds = ", ".join(f"`{c}` {lists.schema[c].dataType.simpleString()}" for c in (*strata, key))
    return vector_pairs(lists.mapInArrow(pack_lists, f"{kinds}, tk binary, w binary"), strata, key, min_sim, block)


def vector_pairs(vectors: DataFrame, strata: list[str], key: str, min_sim: float, block: int = ROWS) -> DataFrame:
    """``similarity_pairs`` of packed vectors: strata, key (a long), tk and w
    (term hashes and weights as bytes)."""
    from clickgap.operators.blocks import block_kernel

    ship_package(vectors.sparkSession)
    s = F.xxhash64(*strata) if strata else F.lit(0).cast("long")
    packed = materialize(vectors.select(*strata, s.alias("_s"), F.col(key).cast("long").alias("k"), "tk", "w"))
    counts = packed.groupBy("_s").agg(F.count("*").alias("n"))
    counts = materialize(counts.select("_s", F.greatest(
        F.ceil(F.col("n") / block), F.least(F.lit(SPREAD), F.ceil(F.col("n") / SMALL))).alias("blocks")))
    tasks = counts.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2).cast("long")).first()[0] or 1
    cut = packed.select("_s", "k", "tk", "w").join(counts, "_s") \
        .withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # a fixed number of partitions: the pairs cost by their products, not by their bytes
    sides = cut.select("_s", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "k",
                       F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int"))
                       .alias("side"), "tk", "w") \
        .repartition(int(min(2 * tasks, MOST_TASKS)), "_s", "lo", "hi")
    sims = sides.groupBy("_s", "lo", "hi").applyInPandas(block_kernel(min_sim), "_s long, a long, b long, sim double")
    if not strata:
        return sims.select("a", "b", "sim")
    names = packed.select(*strata, "_s").distinct()
    return sims.join(names, "_s").select(*strata, "a", "b", "sim")


def dot_products(left: DataFrame, right: DataFrame, lkey: str, rkey: str) -> DataFrame:
    """(lkey, rkey, score) = sum of w_l * w_r over shared terms (positive pairs only)."""
    a = left.select(F.col(lkey), "term", F.col("w").alias("wl"))
    b = right.select(F.col(rkey), "term", F.col("w").alias("wr"))
    return a.join(b, "term").groupBy(lkey, rkey).agg(F.sum(F.col("wl") * F.col("wr")).alias("score"))
