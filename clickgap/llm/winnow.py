"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every window of N = 13 words is represented by one fingerprint: the
smallest hash among the K-grams inside it. With K = 7 a window holds
W = N - K + 1 = 7 of them, so two texts that share 13 words or more share
the fingerprint of that window - the winnowing guarantee. Training
fingerprints (one per run of equal minima) meet the benchmark's, the hits
are extended to every window with that fingerprint and confirmed word by
word, and the covered words are counted.

Items of fewer than N words are one window as a whole; for each such
length L that occurs in the benchmark (at most N - 1 lengths), the L-grams
of the documents are looked up the same way.

Scale: the document side is narrow until the fingerprint join; the
benchmark side of each join is broadcast only when its counted rows are
below ``BROADCAST_ROWS`` and shuffled otherwise. Nothing is collected but
the set of short lengths.

Defined cases: null or empty text has no words, is never hit and never
contaminated; benchmark items without words are ignored; rows repeated
with the same id and text each get the same result; an item id that is
null counts no item but its windows still hit; an empty benchmark or
document table gives zero hits or no rows; extra columns are kept by
``clean`` and ignored by ``report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, row_key, stage

N = 13                      # words of a window
K = 7                       # words of a hashed gram
BROADCAST_ROWS = 500_000    # largest side that is broadcast, in rows

#: characters outside words (fixed by the contract, after lower-casing)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: the same before lower-casing
ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the lower-cased text; null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1),
                    lambda w: w != "")


def _paired(array: str, shift: int, lam: str) -> str:
    """``lam`` over (x[i], x[i + shift]) of an array, as long as both exist."""
    return (f"CASE WHEN size({array}) > {shift} THEN zip_with("
            f"slice({array}, 1, size({array}) - {shift}), "
            f"slice({array}, {shift + 1}, size({array}) - {shift}), {lam}) "
            f"ELSE cast(array() AS array<bigint>) END")


def _runs(df: DataFrame, src: str, out: str, size: int, lam: str) -> DataFrame:
    """Column ``out``: ``lam`` folded over each ``size`` neighbours of the
    array ``src``, by doubling (1, 2, 4, ...; the last step overlaps)."""
    have, name = 1, src
    df = df.withColumn(out, F.col(src))
    while have < size:
        step = min(have, size - have)
        df = df.withColumn(out, F.expr(_paired(out, step, lam)))
        have += step
    return df


def gram_hashes(df: DataFrame, out: str, size: int) -> DataFrame:
    """Column ``out``: hash of each run of ``size`` words, by start."""
    return _runs(df, "h", out, size, "(x, y) -> xxhash64(x, y)")


def window_minima(df: DataFrame, src: str, out: str, width: int) -> DataFrame:
    """Column ``out``: least of each ``width`` neighbouring hashes."""
    return _runs(df, src, out, width, "(x, y) -> least(x, y)")


def _fingerprinted(df: DataFrame, n: int, k: int, short: list[int]) -> DataFrame:
    """``words`` to columns ``fp<L>``: fingerprint of the window at each
    start, for L = n (winnowed) and for every short length (whole)."""
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    df = window_minima(gram_hashes(df, "g", k), "g", f"fp{n}", n - k + 1).drop("g")
    for size in short:
        df = gram_hashes(df, f"fp{size}", size)
    return df.drop("h")


def benchmark_windows(items: DataFrame, id_col: str, text_col: str,
                      n: int = N, k: int = K) -> DataFrame:
    """One row per distinct window of the benchmark: ``size``, ``fp``,
    ``window`` (its words, joined by a space), ``items`` (sorted ids)."""
    w = items.select(F.col(id_col).cast("string").alias("item"),
                     words_of(F.col(text_col)).alias("words")) \
        .where(F.size("words") > 0) \
        .withColumn("size", F.least(F.size("words"), F.lit(n)))
    short = [r[0] for r in w.where(F.col("size") < n).select("size").distinct().collect()]
    w = _fingerprinted(w, n, k, sorted(short))      # at most n - 1 lengths
    fps = F.col(f"fp{n}")
    for size in short:
        fps = F.when(F.col("size") == size, F.col(f"fp{size}")).otherwise(fps)
    w = w.withColumn("fps", fps)
    w = w.select("item", "words", "size", F.posexplode_outer("fps").alias("at", "fp"))
    w = w.select("item", "size", "fp",
                 F.concat_ws(" ", F.expr("slice(words, at + 1, size)")).alias("window"))
    return (w.groupBy("size", "fp", "window")
            .agg(F.array_sort(F.collect_set("item")).alias("items")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text", n: int = N, k: int = K) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``row_key``, ``n_words``, ``n_hit``
    (words inside an occurrence of a benchmark window), ``spans`` (the hit
    word ranges: start, end exclusive), ``items`` (sorted ids of the items
    that occur), ``contaminated`` (n_hit > 0 and at least 1 word in 20)."""
    if not 1 <= k <= n:
        raise ValueError("a window must hold a whole gram")
    windows = stage(benchmark_windows(items, item_id, item_text, n, k))
    n_windows = windows.count()
    short = sorted(r["size"] for r in windows.where(F.col("size") < n)
                   .select("size").distinct().collect())     # at most n - 1 values
    sizes = [n, *short]
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = row_key(F.col("id"), F.col("text")).alias("row_key")
    keyed = base.select(key, words_of(F.col("text")).alias("words"))

    # 1. fingerprints of documents that the benchmark has too
    fps = _fingerprinted(keyed, n, k, short)
    fps = fps.select("row_key", F.explode_outer(F.array_distinct(
        F.concat(*[F.col(f"fp{s}") for s in sizes]))).alias("fp"))
    hits = (fps.join(_small(windows.select("fp").distinct(), n_windows), "fp", "left_semi")
            .groupBy("row_key").agg(F.collect_set("fp").alias("shared")))
    hits = stage(hits)
    n_hits = hits.agg(F.sum(F.size("shared"))).first()[0] or 0

    # 2. every window with such a fingerprint, confirmed word by word
    cand = keyed.join(_small(hits, n_hits), "row_key")
    cand = _fingerprinted(cand, n, k, short)
    cand = cand.withColumn("c", F.flatten(F.array(*[F.expr(
        f"""transform(filter(transform(fp{s}, (f, i) -> struct(i AS at, f AS f)),
                             x -> array_contains(shared, x.f)),
                      x -> struct(x.at AS at, {s} AS size, x.f AS fp,
                                  concat_ws(' ', slice(words, x.at + 1, {s})) AS window))""")
        for s in sizes])))
    cand = cand.select("row_key", F.inline_outer("c"))
    found = cand.join(_small(windows, n_windows), ["size", "fp", "window"]) \
        .groupBy("row_key").agg(
            F.array_sort(F.collect_set(F.struct("at", "size"))).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    found = found.withColumn("spans", F.expr("""
        aggregate(runs, cast(array() AS array<struct<start:int,end:int>>),
          (acc, r) -> CASE
            WHEN size(acc) > 0 AND r.at <= element_at(acc, -1).end
            THEN concat(slice(acc, 1, size(acc) - 1), array(struct(
                   element_at(acc, -1).start AS start,
                   greatest(element_at(acc, -1).end, r.at + r.size) AS end)))
            ELSE concat(acc, array(struct(r.at AS start, r.at + r.size AS end))) END)""")) \
        .select("row_key", "spans", "items")

    # 3. back to every row
    count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), ANY_CASE, -1), lambda w: w != ""))
    out = base.select("id", key, count.cast("long").alias("n_words")) \
        .join(found, "row_key", "left")
    n_hit = F.expr("coalesce(aggregate(spans, 0L, (a, s) -> a + s.end - s.start), 0L)")
    out = out.withColumn("n_hit", n_hit)
    return out.select(
        F.col("id").alias(id_col), "row_key", "n_words", "n_hit",
        F.coalesce("spans", F.expr("cast(array() AS array<struct<start:int,end:int>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() AS array<string>)")).alias("items"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
          text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without its contaminated rows, columns as they were."""
    key, = fresh(docs, "row_key")
    bad = report(docs, items, id_col, text_col, **kw).where("contaminated") \
        .select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key(F.col(id_col), F.col(text_col))) \
        .join(bad, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
