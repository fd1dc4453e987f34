"""Ranked lexical search: exact inner products by sparse ball trees.

An item asks for the K documents with the largest sum of w(t) * impact(t, d)
over its terms, repeats included: the inner product of its term counts times
weights with the document's sparse vector of impacts. All of it is integer
arithmetic (``impacts``, ``term_weight``).

Documents become vectors over the items' vocabulary; the counts that weights
and impacts need (documents, terms, documents with a term) come from all
documents. A task takes its documents in runs of at most TREE_ROWS and
builds a ball tree of each: halves along the line between two far-apart
documents, FANOUT balls under a node, LEAF documents in a leaf. A ball keeps
its centroid c and radius R, and by Cauchy and Schwarz no document in it
scores above

    q.c + |q| R,   q restricted to the terms that occur in the ball

(the others have impact 0 in all its documents). An item walks the tree best
bound first and skips a ball, with all below it, whose bound is under its
K-th best score so far. Bounds are doubles, scores are integers: radii and
bounds are rounded up by more than their error, so nothing is lost; leaves
are scored in 64-bit integers. Scores so far carry from tree to tree of a
task, and a first search over a hash sample of the documents gives every
task a K-th best score to start from; it only saves work, the second search
covers all documents.

The items are a stated query set: they are taken in blocks of at most
BLOCK_TERMS terms (one item at least), each searched against all documents;
a block's vocabulary and weights are what is sent to the tasks.

Defined cases: null or empty documents have no terms and are never found;
an item without terms, or whose terms are in no document, has no rows; equal
scores go by ascending document id, null ids last; repeated documents and
items count one by one (items of the same id are ranked each on its own);
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import ascii_lower, equal_words, letter_spans, prepare, stage, text_chunks, word_hashes

K = 10
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TREE_ROWS = 8192        # documents under one root
TREE_TERMS = 4_000_000  # their vectors' entries together, one document at least
FANOUT = 16
LEAF = 32
BLOCK_TERMS = 16_384    # terms of the items searched together
SAMPLE = 32             # one document of so many is searched first, for the first thresholds
SLACK = 1e-9            # relative error that radii and bounds are rounded up by


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of a term with ``tf`` occurrences in a document of ``size`` terms."""
    m = 100 - 75 + (75 * size * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Vocabulary:
    """Distinct terms of a block of items, found in texts by hash and then
    byte by byte."""

    def __init__(self, terms):
        self.terms = sorted(set(terms))
        raw = [t.encode() for t in self.terms]
        ends = np.cumsum([len(r) for r in raw])
        self.book = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.ends = ends.astype(np.int64)
        self.starts = self.ends - np.array([len(r) for r in raw], dtype=np.int64)
        self.seed = 41
        while True:
            h = word_hashes(self.book, self.starts, self.ends, lower=False, seed=self.seed)
            self.order = np.argsort(h)
            self.hashes = h[self.order]
            if len(np.unique(h)) == len(h):
                break
            self.seed += 1

    def count(self, data, bounds):
        """Of a chunk of texts: terms of each, and (text, term, occurrences)
        of the vocabulary, by text, then term."""
        n = len(bounds) - 1
        starts, ends, owner = letter_spans(data, bounds)
        h = word_hashes(data, starts, ends, lower=True, seed=self.seed)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        term = self.order[at[hit]]
        same = equal_words(data, starts[hit], ends[hit], True, self.book, self.starts[term], self.ends[term])
        v = len(self.terms)
        pair, tf = np.unique(owner[hit[same]] * v + term[same], return_counts=True)
        return np.bincount(owner, minlength=n), pair // v, pair % v, tf


class Ball:
    """A node: documents lo to hi (in tree order), ``cols`` and ``centre``
    over the terms that occur in them, ``radius``; ``below``: its balls."""

    __slots__ = ("lo", "hi", "cols", "centre", "radius", "below")


class Tree:
    """Documents as rows of (term, value) lists: ``ptr``, ``col``, ``val``
    (integers)."""

    def __init__(self, ptr, col, val):
        self.ptr, self.col, self.val = ptr, col, val
        self.real = val.astype(np.float64)
        self.order = np.arange(len(ptr) - 1)
        self.root = self._ball(0, len(self.order))
        self._lay_out()

    def _entries(self, rows):
        size = self.ptr[rows + 1] - self.ptr[rows]
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(self.ptr[rows], size)
        return at, np.repeat(np.arange(len(rows)), size)

    def _ball(self, lo: int, hi: int) -> Ball:
        """Centre and radius of the documents lo to hi, and the balls below."""
        rows = self.order[lo:hi]
        at, of = self._entries(rows)
        cols, local = np.unique(self.col[at], return_inverse=True)
        x = self.real[at]
        b = Ball()
        b.lo, b.hi, b.cols = lo, hi, cols
        b.centre = np.bincount(local, weights=x, minlength=len(cols)) / len(rows)
        norm = np.bincount(of, weights=x * x, minlength=len(rows))
        cc = float(b.centre @ b.centre)
        away = norm - 2 * np.bincount(of, weights=x * b.centre[local], minlength=len(rows)) + cc
        error = 1e-12 * (norm.max() + cc)
        b.radius = math.sqrt(max(float(away.max()), 0.0) + error) * (1 + SLACK)
        b.below = []
        if hi - lo > LEAF:
            pieces = [(lo, hi)]
            while len(pieces) < FANOUT and max(h - l for l, h in pieces) > LEAF:
                pieces = [p for l, h in pieces for p in (self._halve(l, h) if h - l > LEAF else [(l, h)])]
            b.below = [self._ball(l, h) for l, h in pieces]
        return b

    def _halve(self, lo: int, hi: int):
        """Documents lo to hi ordered along the line between two far-apart
        ones and cut in the middle."""
        rows = self.order[lo:hi]
        at, of = self._entries(rows)
        cols, local = np.unique(self.col[at], return_inverse=True)
        x = self.real[at]
        norm = np.bincount(of, weights=x * x, minlength=len(rows))

        def against(vector):
            return np.bincount(of, weights=x * vector[local], minlength=len(rows))

        def document(i):
            v = np.zeros(len(cols))
            v[local[of == i]] = x[of == i]
            return v
        centre = np.bincount(local, weights=x, minlength=len(cols)) / len(rows)
        a = document(int(np.argmax(norm - 2 * against(centre))))
        z = document(int(np.argmax(norm - 2 * against(a))))
        self.order[lo:hi] = rows[np.argsort(against(a - z), kind="stable")]
        mid = (lo + hi) // 2
        return [(lo, mid), (mid, hi)]

    def _lay_out(self):
        """Rows in tree order, so a leaf's entries lie together."""
        at, _ = self._entries(self.order)
        size = self.ptr[self.order + 1] - self.ptr[self.order]
        self.col, self.val = self.col[at], self.val[at]
        self.ptr = np.concatenate([[0], np.cumsum(size)])
        self.real = None
        self._table(self.root)

    def _table(self, ball: Ball):
        """One (terms, balls below) array of centres, for bounds of all the
        balls below a node at once."""
        if not ball.below:
            ball.cols = ball.centre = None if ball is not self.root else ball.centre
            return
        table = np.zeros((len(ball.cols), len(ball.below)))
        for j, b in enumerate(ball.below):
            table[np.searchsorted(ball.cols, b.cols), j] = b.centre
        for b in ball.below:
            self._table(b)
        ball.centre = table

    def search(self, query: "Query", top: "Top") -> int:
        """Documents scored; ``top`` takes what this tree adds to it."""
        heap, tie, scored = [(-math.inf, 0, self.root)], 0, 0
        while heap:
            bound, _, ball = heapq.heappop(heap)
            if -bound < top.least:
                break
            if not ball.below:
                lo, hi = self.ptr[ball.lo], self.ptr[ball.hi]
                part = query.exact[self.col[lo:hi]] * self.val[lo:hi]
                # every document here has a term; reduceat needs no empty rows
                scores = np.add.reduceat(part, self.ptr[ball.lo:ball.hi] - lo)
                scored += ball.hi - ball.lo
                for i in np.flatnonzero(scores >= top.least):
                    top.add(int(scores[i]), int(self.order[ball.lo + i]))
                continue
            at = np.searchsorted(ball.cols, query.cols)
            at[at == len(ball.cols)] = 0
            found = ball.cols[at] == query.cols
            c = ball.centre[at[found]]
            q = query.real[found]
            reach = np.sqrt((q * q) @ (c > 0))
            radius = np.array([b.radius for b in ball.below])
            bounds = (q @ c + reach * radius) * (1 + SLACK) + 1
            for b, x in zip(ball.below, bounds):
                if x >= top.least:
                    tie += 1
                    heapq.heappush(heap, (-float(x), tie, b))
        return scored


class Query:
    """An item: the places of its terms and their weights, as doubles
    (``real``) and as dense integers (``exact``)."""

    def __init__(self, cols, weight, v: int):
        self.cols, self.real = cols, weight.astype(np.float64)
        self.exact = np.zeros(v, dtype=np.int64)
        self.exact[cols] = weight


class Top:
    """The best K of an item so far: (-score, no id, id). ``least``: a score
    below it can no longer enter."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.found, self.ids = k, max(least, 1), [], None

    def add(self, score: int, row: int):
        name = self.ids[row]
        insort(self.found, (-score, name is None, 0 if name is None else name))
        if len(self.found) > self.k:
            self.found.pop()
        if len(self.found) == self.k:
            self.least = max(self.least, -self.found[-1][0])


class Block:
    """A block of items over its vocabulary, with the weights of its terms."""

    def __init__(self, keys, term_lists, vocabulary: Vocabulary, n_docs: int, n_terms: int, df: dict):
        place = {t: i for i, t in enumerate(vocabulary.terms)}
        weight = np.array([term_weight(n_docs, df.get(i, 0)) for i in range(len(place))], dtype=np.int64)
        self.keys, self.queries = keys, []
        self.n_docs, self.n_terms = n_docs, n_terms
        for terms in term_lists:
            cols, count = np.unique([place[t] for t in terms], return_counts=True)
            self.queries.append(Query(cols, count * weight[cols], len(place)))


def vectors(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(id, size, terms, tfs) of every document, whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for lo, hi, data, bounds in text_chunks(batch.column(1)):
                size, text, term, tf = sent.value.count(data, bounds)
                cut = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size.astype(np.int64)),
                     pa.ListArray.from_arrays(cut, pa.array(term.astype(np.int32))),
                     pa.ListArray.from_arrays(cut, pa.array(tf.astype(np.int32)))],
                    names=["id", "size", "terms", "tfs"])

    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("size", T.LongType()),
                        T.StructField("terms", T.ArrayType(T.IntegerType())),
                        T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def runs(batches):
    """(ids, size, ptr, terms, tfs) of runs of documents that hold a term,
    at most TREE_ROWS and TREE_TERMS each."""
    held, rows, entries = [], 0, 0

    def joined():
        ids = [x for h in held for x in h[0]]
        count = np.concatenate([h[2] for h in held])
        return ids, np.concatenate([h[1] for h in held]), np.concatenate([[0], np.cumsum(count)]), \
            np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, size = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        terms, tfs = batch.column(2), batch.column(3)
        off = terms.offsets.to_numpy()
        off = off - off[0]
        col, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
        i = 0
        while i < n:
            j = min(n, i + TREE_ROWS - rows)
            fit = int(np.searchsorted(off, off[i] + TREE_TERMS - entries, side="right")) - 1
            j = min(j, fit)
            if j > i:
                held.append((ids[i:j], size[i:j], np.diff(off[i:j + 1]), col[off[i]:off[j]], tf[off[i]:off[j]]))
                rows, entries = rows + j - i, entries + int(off[j] - off[i])
                i = j
            elif not rows:      # one document larger than a run
                held.append((ids[i:i + 1], size[i:i + 1], np.diff(off[i:i + 2]), col[off[i]:off[i + 1]],
                             tf[off[i]:off[i + 1]]))
                rows, i = 1, i + 1
            if rows and (i < n):
                yield joined()
                held, rows, entries = [], 0, 0
    if rows:
        yield joined()


def search(found: DataFrame, block: Block, k: int, least: dict) -> DataFrame:
    """(item, score, id): the best ``k`` of each task's documents for each
    item of the block, scores of at least ``least[item]`` only."""
    sent = found.sparkSession.sparkContext.broadcast(block)
    kind = found.schema["id"].dataType

    def run(batches):
        import pyarrow as pa
        block = sent.value
        tops = [Top(k, least.get(key, 1)) for key in block.keys]
        for ids, size, ptr, col, tf in runs(batches):
            value = impacts(tf, np.repeat(size, np.diff(ptr)), block.n_docs, block.n_terms)
            tree = Tree(ptr, col, value)
            for query, top in zip(block.queries, tops):
                top.ids = ids
                tree.search(query, top)
        rows = [(key, -s, None if none else name) for key, top in zip(block.keys, tops) for s, none, name in top.found]
        if rows:
            item, score, name = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, type=pa.int64()), pa.array(score, type=pa.int64()),
                 pa.array(name, type=to_arrow(kind))], names=["item", "score", "id"])

    from pyspark.sql.pandas.types import to_arrow_type as to_arrow
    out = T.StructType([T.StructField("item", T.LongType()), T.StructField("score", T.LongType()),
                        T.StructField("id", kind)])
    return found.where(F.size("terms") > 0).select("id", "size", "terms", "tfs").mapInArrow(run, out)


def best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): each item's ``k`` best documents."""
    spark = docs.sparkSession
    prepare(spark)
    asked = stage(items.select(F.col(item_col).alias("name"), F.regexp_extract_all(
        ascii_lower(F.coalesce(F.col(item_text), F.lit(""))), F.lit(TERM), F.lit(0)).alias("terms"))
        .where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()))
    size = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-size // BLOCK_TERMS)
    found = []
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "terms").collect()
        if not mine:
            continue
        vocabulary = Vocabulary(t for r in mine for t in r["terms"])
        vec = stage(vectors(docs, vocabulary, id_col, text_col))
        total = vec.agg(F.count_if(F.col("size") > 0).alias("docs"), F.sum("size").alias("terms")).first()
        if not total["docs"]:
            continue
        df = {r["term"]: r["count"] for r in vec.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
        block = Block([r["item"] for r in mine], [r["terms"] for r in mine], vocabulary, total["docs"],
                      total["terms"], df)
        some = vec.where(F.pmod(F.xxhash64("id", "size", "terms"), F.lit(SAMPLE)) == 0)
        least = {r["item"]: r["score"] for r in best(search(some, block, k, {}), k).where(F.col("rank") == k).collect()}
        found.append(best(search(vec, block, k, least), k))
    kind = docs.schema[id_col].dataType
    if not found:
        return spark.createDataFrame([], T.StructType([
            T.StructField(item_col, items.schema[item_col].dataType), T.StructField("rank", T.IntegerType()),
            T.StructField(id_col, kind), T.StructField("score", T.LongType())]))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.join(asked.select("item", "name"), "item") \
        .select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")
