"""Vector code compression: product codes learned over a trie of parts.

Every vector becomes integers floor(SCALE * x) and is cut into PARTS equal
consecutive parts; each part is coded by the nearest of at most ENTRIES
codebook entries of its position (squared Euclidean distance, ties to the
lower index). The codebooks start as the parts of the vectors with the
smallest ids and take ROUNDS rounds of exact integer means (rounded down).

Assignment walks a lexicographic trie: the distinct parts of a position,
with their number of rows, are written in lexicographic order, which is the
depth-first order of the trie whose level j branches on the j-th number.
Runs of consecutive leaves are walked level by level: a node at depth j
adds, for all entries at once, the squared differences of its own number to
the distances accumulated by its parent, so parts with a common prefix share
the work of the prefix. Once no two leaves of a run share a node, what is
left of the parts is added in one product. At the leaves the smallest
distance gives the entry, and the part counts with its number of rows in the
entry's sum. Because the table is range-partitioned in that order, longer
tables have longer common prefixes.

Everything is integer arithmetic; sums of squares below 2^53 are exact in
doubles and run there, larger ones in Python integers (``wide``).

Per round the driver sees one row per entry of a position (ENTRIES * PARTS
sums for each vector length), never rows.

Defined cases: vectors that are null or hold null or non-finite components
are dropped; vectors of another length are coded with codebooks of their own
length (``codebooks_sha256`` differs by length, and error sums of equal
labels run over all lengths); a length not divisible by PARTS is cut at
floor(i * length / PARTS); with fewer vectors than ENTRIES the codebook has
one entry for each; null ids come after all others, equal ids in order of
their vectors; repeated rows are coded alike; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, stage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
RUN = 1024              # leaves walked together
EXACT = 2 ** 53         # doubles hold all integers below
FEW_LABELS = 100_000    # label sums up to this many rows are broadcast


def cuts(length: int) -> list[int]:
    return [i * length // PARTS for i in range(PARTS + 1)]


def number_type(largest: int, length: int):
    """float64 where every sum of squared differences stays exact, Python
    integers beyond."""
    return np.float64 if (2 * largest) ** 2 * max(length, 1) < EXACT else object


def walk(leaves: np.ndarray, entries: np.ndarray, dtype):
    """(entry, distance) of every leaf. ``leaves``: distinct parts in
    lexicographic order, one a row; ``entries``: the codebook."""
    n, d = leaves.shape
    where, dist = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=object if dtype is object else np.int64)
    book = entries.astype(dtype)
    tail = [(book[:, j:] ** 2).sum(axis=1) for j in range(d + 1)]       # entries' squares from level j on
    for lo in range(0, n, RUN):
        run = leaves[lo:lo + RUN]
        m = len(run)
        shared = np.zeros(m, dtype=np.int64)        # numbers in common with the leaf before
        if m > 1:
            differ = run[1:] != run[:-1]
            shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), d)
        acc = np.zeros((1, len(book)), dtype=dtype)
        node = np.zeros(m, dtype=np.int64)          # node of each leaf at the level above
        j = 0
        while j < d and len(acc) < m:
            opens = shared <= j                     # a leaf that starts a node of level j
            opens[0] = True
            first = np.flatnonzero(opens)
            gap = run[first, j].astype(dtype)[:, None] - book[:, j][None, :]
            acc = acc[node[first]] + gap * gap
            node = np.cumsum(opens) - 1
            j += 1
        if j < d:
            rest = run[:, j:].astype(dtype)
            acc = acc + (rest * rest).sum(axis=1)[:, None] - 2 * (rest @ book[:, j:].T) + tail[j][None, :]
        best = acc.argmin(axis=1)
        where[lo:lo + m] = best[node]
        dist[lo:lo + m] = acc[np.arange(len(acc)), best][node]
    return where, dist


def part_sums(leaves: np.ndarray, rows: np.ndarray, where: np.ndarray):
    """(entries used, rows of each, component sums of each)."""
    order = np.argsort(where, kind="stable")
    used, first = np.unique(where[order], return_index=True)
    weighted = leaves[order] * rows[order][:, None]
    return used, np.add.reduceat(rows[order], first), np.add.reduceat(weighted, first, axis=0)


def whole(x: float) -> int:
    """floor(SCALE * x), exact for every double."""
    return math.floor(x * SCALE) if abs(x) < 2.0 ** 53 else int(x) * SCALE


def matrix(column, width: int, dtype) -> np.ndarray:
    """Rows of an Arrow list column (longs, or doubles when wide), all of
    one width, as integers."""
    if dtype is not object:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    out = np.empty((len(column), width), dtype=object)
    for i, row in enumerate(column.to_pylist()):
        out[i] = [whole(x) for x in row]
    return out


def kept_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str, dtype) -> DataFrame:
    """(id, label, v) of the usable vectors: integers, or the doubles as
    they are when wide (tasks make Python integers of them)."""
    x = F.col(vec_col).cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = x if dtype is object else F.transform(x, lambda c: F.floor(c * SCALE))
    return df.where(F.coalesce(good, F.lit(False))) \
        .select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))


class Codebooks:
    """Entries by (vector length, part position), int64 or Python integers."""

    def __init__(self, entries: dict, dtype):
        self.entries, self.dtype = entries, dtype

    def digest(self, length: int) -> str:
        text = ",".join(str(int(x)) for p in range(PARTS) for e in self.entries[length, p] for x in e)
        return hashlib.sha256(text.encode()).hexdigest()


def first_books(vectors: DataFrame, dtype) -> Codebooks:
    """The parts of the ENTRIES vectors with the smallest ids, per length:
    each task keeps its own ENTRIES smallest before they meet."""
    entries: dict = {}
    lengths = [r["n"] for r in vectors.select(F.size("v").alias("n")).distinct().collect()]
    for n in lengths:
        rows = vectors.where(F.size("v") == n).orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()
        book = np.array([[whole(x) for x in r["v"]] if dtype is object else list(r["v"]) for r in rows],
                        dtype=object if dtype is object else np.int64).reshape(len(rows), n)
        cut = cuts(n)
        for p in range(PARTS):
            entries[n, p] = book[:, cut[p]:cut[p + 1]]
    return Codebooks(entries, dtype)


def distinct_parts(vectors: DataFrame) -> DataFrame:
    """(n, pos, part, rows): distinct parts in lexicographic order."""
    n = F.size("v")
    parts = F.array(*[F.struct(F.lit(p).alias("pos"), F.expr(
        f"slice(v, int(floor({p} * size(v) / {PARTS}) + 1), "
        f"int(floor({p + 1} * size(v) / {PARTS}) - floor({p} * size(v) / {PARTS})))").alias("part"))
        for p in range(PARTS)])
    long = vectors.select(n.alias("n"), F.inline(parts)).groupBy("n", "pos", "part") \
        .agg(F.count("*").alias("rows"))
    return stage(long.repartitionByRange("n", "pos", "part").sortWithinPartitions("n", "pos", "part"))


def _groups(batch):
    """(length, position, first row, last row) of the runs of a batch."""
    n, pos = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    edge = np.flatnonzero(np.r_[True, (n[1:] != n[:-1]) | (pos[1:] != pos[:-1]), True])
    for lo, hi in zip(edge[:-1], edge[1:]):
        yield int(n[lo]), int(pos[lo]), int(lo), int(hi)


def in_order(rows: np.ndarray):
    """(distinct rows in lexicographic order, place of each row there)."""
    if rows.dtype != object and rows.shape[1]:
        leaves, back = np.unique(rows, axis=0, return_inverse=True)
        return leaves, back.ravel()
    found: dict = {}
    for i, row in enumerate(map(tuple, rows)):
        found.setdefault(row, []).append(i)
    names = sorted(found)
    back = np.empty(len(rows), dtype=np.int64)
    for i, name in enumerate(names):
        back[found[name]] = i
    return np.array(names, dtype=rows.dtype).reshape(len(names), rows.shape[1]), back


def assign_round(parts: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every distinct part to its nearest entry, entries to the
    mean of their parts."""
    sent = parts.sparkSession.sparkContext.broadcast(books)     # PARTS * ENTRIES entries a length

    def run(batches):
        import pyarrow as pa
        books = sent.value
        total: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for n, pos, lo, hi in _groups(batch):
                book = books.entries[n, pos]
                leaves = matrix(batch.column(2).slice(lo, hi - lo), book.shape[1], books.dtype)
                rows = batch.column(3).slice(lo, hi - lo).to_numpy()
                if books.dtype is object:       # parts equal as integers come together
                    leaves, back = in_order(leaves)
                    rows = np.bincount(back, weights=rows).astype(np.int64)
                where, _ = walk(leaves, book, books.dtype)
                used, count, sums = part_sums(leaves, rows, where)
                c, s = total.setdefault((n, pos), (np.zeros(len(book), dtype=np.int64), np.zeros_like(book)))
                c[used] += count
                s[used] += sums
        out = [(n, pos, e, int(c[e]), d, str(s[e, d])) for (n, pos), (c, s) in total.items()
               for e in np.flatnonzero(c) for d in range(s.shape[1])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)],
                                             names=["n", "pos", "entry", "rows", "dim", "total"])

    part = parts.select("n", "pos", "part", "rows").mapInArrow(
        run, "n long, pos long, entry long, rows long, dim long, total string")
    keys = ["n", "pos", "entry", "dim"]
    if books.dtype is object:
        def add(key, pdf):      # one number a task: sums that no column type holds
            import pandas as pd
            return pd.DataFrame({**{k: [x] for k, x in zip(keys, key)}, "rows": [int(pdf["rows"].sum())],
                                 "total": [str(sum(int(x) for x in pdf["total"]))]})
        sums = part.groupBy(*keys).applyInPandas(add, part.schema)
    else:
        sums = part.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum(F.col("total").cast("long")).alias("total"))
    fresh = {k: v.copy() for k, v in books.entries.items()}
    for r in sums.collect():
        fresh[r["n"], r["pos"]][r["entry"], r["dim"]] = int(r["total"]) // r["rows"]
    return Codebooks(fresh, books.dtype)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, n, code, error) of every row: the distinct parts of each
    Arrow batch are walked as a trie of their own, so no row moves."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        import pyarrow as pa
        books = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(2).to_numpy()
            code = np.empty(batch.num_rows, dtype=object)
            error = np.zeros(batch.num_rows, dtype=object)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                full = matrix(batch.column(3).take(pa.array(at)), int(n), books.dtype)
                cut, text, err = cuts(int(n)), np.full(len(at), "", dtype=object), np.zeros(len(at), dtype=object)
                for p in range(PARTS):
                    leaves, back = in_order(full[:, cut[p]:cut[p + 1]])
                    where, dist = walk(leaves, books.entries[int(n), p], books.dtype)
                    text = text + np.array([f"{w:02x}" for w in where], dtype=object)[back]
                    err = err + dist.astype(object)[back]
                code[at], error[at] = text, err
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(list(code)),
                 pa.array([str(x) for x in error])], names=["id", "label", "n", "code", "error"])

    kind = vectors.schema
    out = T.StructType([T.StructField("id", kind["id"].dataType), T.StructField("label", kind["label"].dataType),
                        T.StructField("n", T.IntegerType()), T.StructField("code", T.StringType()),
                        T.StructField("error", T.StringType())])
    return vectors.select("id", "label", F.size("v").alias("n"), "v").mapInArrow(run, out)


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(codes, codebooks). Codes per kept row: ``id_col``, ``label_col``,
    ``code``, ``error``, ``label_error`` (of equal labels together) and
    ``codebooks_sha256``. Distances and their sums are longs, or decimals
    where the numbers need them (too large ones are null)."""
    prepare(df.sparkSession)
    size = df.select(F.max(F.aggregate(F.filter(F.col(vec_col).cast("array<double>"),
                                                lambda c: F.abs(c) < float("inf")), F.lit(0.0),
                                       lambda a, c: F.greatest(a, F.abs(c)))).alias("top"),
                     F.max(F.size(vec_col)).alias("n")).first()
    dtype = number_type(int((size["top"] or 0.0) * SCALE) + 1, size["n"] or 1)
    vectors = stage(kept_vectors(df, id_col, vec_col, label_col, dtype))
    books = first_books(vectors, dtype)
    if rounds and books.entries:
        parts = distinct_parts(vectors)
        for _ in range(rounds):
            books = assign_round(parts, books)
    number = "decimal(38,0)" if dtype is object else "long"
    rows = stage(encode(vectors, books).withColumn("error", F.expr(f"try_cast(error AS {number})")))
    sums = rows.groupBy("label").agg(F.try_sum("error").cast(number).alias("label_error"))
    sums = stage(sums)
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    digests = F.lit(None).cast("string")
    for n in {n for n, _ in books.entries}:
        digests = F.when(F.col("n") == n, F.lit(books.digest(n))).otherwise(digests)
    sums = sums.withColumnRenamed("label", "label2")
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("label2"))).select(
        F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error",
        digests.alias("codebooks_sha256"))
    return out, books
