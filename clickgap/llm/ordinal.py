"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document x has one score w . x from hashed text features shared by all
grades, and ordered thresholds cut the score into grades:
P(grade <= k) = sigmoid(theta_k - w . x), theta_0 < theta_1 < ...
From it come the expected grade and the tail probability P(grade >= k)
that selection uses.

Features: presence of each lower-cased word (letters, digits and all
non-ASCII characters) and of the leading bytes of longer words, hashed into
2^BITS places, and a few dozen shape
numbers (shares of capitals, digits and each punctuation sign, repeated
words, logarithm of the length).

Fitting uses at most SAMPLE rated documents, those with the smallest id
hashes, in one task: the documented bound on its memory (about SAMPLE x
distinct words of a document x 8 bytes). Scoring covers every document and
whole texts; the weights (2^BITS numbers) are the only thing sent to all
tasks.

Defined cases: null and empty texts have no words and are scored by their
shape alone; ratings that are null, or of unknown ids, are ignored; several
ratings of an id count one by one; without any usable rating, or with one
grade only, nothing is rejected and the numbers are null; rows are scored
one by one, so repeated rows and ids score alike; an empty table gives no
rows; extra columns are kept by ``select`` .
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, mix64, prepare, segment_ids, text_chunks, word_hashes

BITS = 20
PREFIXES = (4, 5, 6)    # leading bytes of longer words that are features too
SAMPLE = 16_000         # largest number of rated documents that fit the model
STEPS = 300             # full passes over the sample
RATE = 0.05             # Adam step
L2 = 1e-4               # weight penalty per document
MIN_DOCS = 3            # sample documents that must hold a word
SCREEN = 5.0            # standard errors by which a word's mean grade must be off

_WORDY = np.zeros(256, dtype=bool)
_WORDY[48:58] = _WORDY[65:91] = _WORDY[97:123] = True
_WORDY[128:] = True
_SIGNS = [b for b in range(33, 127) if not _WORDY[b]]
SHAPES = len(_SIGNS) + 8


def _words(data, bounds):
    """Spans of runs of word bytes, cut at text bounds."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    solid = _WORDY[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = bounds[:-1][bounds[:-1] < n]
    first[cut] = solid[cut]
    end = bounds[1:][bounds[1:] > 0] - 1
    last[end] = solid[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(bounds, starts, side="right") - 1


def features(data, bounds, used=None):
    """Of a chunk of texts: hashed words (text index, place), each once per
    text, and the shape numbers (texts x SHAPES). ``used``: the places that
    matter, all without it."""
    n = len(bounds) - 1
    size = np.maximum(np.diff(bounds), 1).astype(np.float64)
    starts, ends, owner = _words(data, bounds)
    places = []
    for j, lead in enumerate((0, *PREFIXES)):
        use = np.arange(len(starts)) if not lead else np.flatnonzero(ends - starts > lead)
        stop = ends if not lead else starts[use] + lead
        h = word_hashes(data, starts[use], stop, lower=True, seed=3 + j)
        places.append((owner[use].astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)))
    different = np.bincount((np.unique(places[0]) >> np.uint64(BITS)).astype(np.int64), minlength=n)
    packed = np.concatenate(places)
    if used is not None:
        packed = packed[used[(packed & np.uint64((1 << BITS) - 1)).astype(np.int64)]]
    packed = np.unique(packed)
    place = (packed & np.uint64((1 << BITS) - 1)).astype(np.int64)
    text = (packed >> np.uint64(BITS)).astype(np.int64)

    words = np.bincount(owner, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    of_byte = segment_ids(np.diff(bounds))
    shape = np.zeros((n, SHAPES))
    for j, sign in enumerate(_SIGNS):
        hit = of_byte[data == sign]
        if len(hit):
            shape[:, j] = np.minimum(np.bincount(hit, minlength=n) / some, 3.0)
    at = len(_SIGNS)
    upper = (data >= 65) & (data <= 90)
    letters = np.bincount(of_byte[upper | ((data >= 97) & (data <= 122))], minlength=n)
    shape[:, at] = np.bincount(of_byte[upper], minlength=n) / np.maximum(letters, 1)
    shape[:, at + 1] = np.bincount(of_byte[(data >= 48) & (data <= 57)], minlength=n) / size * 10
    shape[:, at + 2] = 1 - different / some
    shape[:, at + 3] = np.log1p(words) / 5
    shape[:, at + 4] = np.bincount(owner, weights=ends - starts, minlength=n) / some / 10
    shape[:, at + 5] = np.bincount(of_byte[data == 10], minlength=n) / some
    shape[:, at + 6] = words == 0
    shape[:, at + 7] = words < 5
    return text, place, shape


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


def associated(place, text, grade) -> np.ndarray:
    """Places whose documents' mean grade is off the whole mean by SCREEN
    standard errors or more, among those with MIN_DOCS documents."""
    held = np.bincount(place, minlength=1 << BITS)
    total = np.bincount(place, weights=grade[text].astype(np.float64), minlength=1 << BITS)
    off = np.abs(total - held * grade.mean())
    return (held >= MIN_DOCS) & (off >= SCREEN * np.sqrt(held * max(grade.var(), 1e-9)))


def fit_arrays(text, place, shape, grade, grades: int, steps: int = STEPS, rate: float = RATE,
               l2: float = L2):
    """(word weights, shape weights, thresholds) by full-batch Adam on the
    cumulative-link likelihood. Thresholds are theta_0 and the logarithms
    of the gaps, so they stay ordered."""
    n = len(grade)
    keep = associated(place, text, grade)[place]
    text, place = text[keep], place[keep]
    names, col = np.unique(place, return_inverse=True)
    k = grades - 1
    share = np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n
    theta0 = np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1))
    p = np.concatenate([np.zeros(len(names) + SHAPES), [theta0[0]],
                        np.log(np.maximum(np.diff(theta0), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    nw, ns = len(names), len(names) + SHAPES
    low, high = grade - 1, grade            # thresholds around the grade
    for t in range(1, steps + 1):
        gaps = np.exp(p[ns + 1:])
        theta = p[ns] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(text, weights=p[:nw][col], minlength=n) + shape @ p[nw:ns]
        up = np.where(high < k, _sigmoid(theta[np.minimum(high, k - 1)] - s), 1.0)
        lo = np.where(low >= 0, _sigmoid(theta[np.maximum(low, 0)] - s), 0.0)
        like = np.maximum(up - lo, 1e-12)
        dup, dlo = up * (1 - up) / like, lo * (1 - lo) / like     # d log like / d theta
        ds = (dup - dlo) / n                                       # minus d log like / d s
        g = np.empty_like(p)
        g[:nw] = np.bincount(col, weights=ds[text], minlength=nw) + l2 * p[:nw]
        g[nw:ns] = shape.T @ ds + l2 * p[nw:ns]
        dt = np.zeros(k)
        np.add.at(dt, high[high < k], -dup[high < k] / n)
        np.add.at(dt, low[low >= 0], dlo[low >= 0] / n)
        tail = np.cumsum(dt[::-1])[::-1]
        g[ns] = tail[0]
        g[ns + 1:] = tail[1:] * gaps
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    word = np.zeros(1 << BITS)
    word[names] = p[:nw]
    return word, p[nw:ns], p[ns] + np.concatenate([[0.0], np.cumsum(np.exp(p[ns + 1:]))])


def _fit_task(batches, grades: int):
    import pandas as pd
    import pyarrow as pa

    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches).sort_by([("tie", "ascending"), ("grade", "ascending")])
    texts, places, shapes, at = [], [], [], 0
    column = rows.column("text").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    for lo, hi, data, bounds in text_chunks(column):
        t, p, s = features(data, bounds)
        texts.append((t + at).astype(np.int32))
        places.append(p.astype(np.int32))
        shapes.append(s)
        at += hi - lo
    grade = rows.column("grade").to_numpy().astype(np.int64)
    if len(np.unique(grade)) < 2:
        return
    w, s, theta = fit_arrays(np.concatenate(texts), np.concatenate(places), np.concatenate(shapes),
                             grade, grades)
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_pandas(pd.DataFrame({
        "kind": ["w"] * len(at) + ["s"] * len(s) + ["t"] * len(theta),
        "place": np.concatenate([at, np.arange(len(s)), np.arange(len(theta))]).astype(np.int64),
        "value": np.concatenate([w[at], s, theta])}), preserve_index=False)


class Model:
    """Fitted weights: ``word`` by place, ``shape``, ``theta`` ascending."""

    def __init__(self, word, shape, theta):
        self.word, self.shape, self.theta = word, shape, theta
        self.used = word != 0

    def tails(self, data, bounds) -> np.ndarray:
        """P(grade >= 1), ..., P(grade >= top) for the texts of a chunk."""
        text, place, shape = features(data, bounds, self.used)
        s = np.bincount(text, weights=self.word[place], minlength=len(bounds) - 1) + shape @ self.shape
        return 1 - _sigmoid(self.theta[None, :] - s[:, None])


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, id_col: str = "doc_id",
        text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """Model of ``grade`` (0 to ``grades`` - 1, a column over ``ratings``),
    or None without two grades to tell apart."""
    prepare(docs.sparkSession)
    rated = ratings.select(F.col(id_col).alias("id"), grade.cast("int").alias("grade")) \
        .where(F.col("id").isNotNull() & F.col("grade").between(0, grades - 1)) \
        .withColumn("tie", F.xxhash64("id")).orderBy("tie", "id", "grade").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .join(F.broadcast(rated), "id").select("tie", "grade", "text") \
        .orderBy("tie", "grade", F.xxhash64("text")).limit(sample)      # rows of repeated ids count too
    got = rows.repartition(1).mapInArrow(lambda it: _fit_task(it, grades),
                                         "kind string, place long, value double").collect()
    if not got:
        return None
    parts = {"w": np.zeros(1 << BITS), "s": np.zeros(SHAPES), "t": np.zeros(grades - 1)}
    for r in got:                   # at most 2^BITS + SHAPES + grades - 1 numbers
        parts[r["kind"]][r["place"]] = r["value"]
    return Model(parts["w"], parts["s"], parts["t"])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
          top: int | None = None, least: float = 0.5) -> DataFrame:
    """Per row: ``id_col``, ``expected_grade``, ``p_tail`` = P(grade >= top;
    the highest, unless given) and ``kept`` (p_tail >= least)."""
    if model is None:
        return docs.select(F.col(id_col), F.lit(None).cast("double").alias("expected_grade"),
                           F.lit(None).cast("double").alias("p_tail"), F.lit(True).alias("kept"))
    kind = docs.schema[id_col].dataType
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rank = (top or len(model.theta)) - 1

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for lo, hi, data, bounds in text_chunks(batch.column(1)):
                tails = sent.value.tails(data, bounds)
                p = tails[:, rank]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.round(tails.sum(axis=1), 6)),
                     pa.array(np.round(p, 6)), pa.array(p >= least)],
                    names=["id", "expected_grade", "p_tail", "kept"])

    from pyspark.sql import types as T
    out = T.StructType([T.StructField("id", kind), T.StructField("expected_grade", T.DoubleType()),
                        T.StructField("p_tail", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, out).withColumnRenamed("id", id_col)


def select(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
           top: int | None = None, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that ``score`` rejects, columns as they
    were (rows are judged in place, nothing is joined)."""
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rank = (top or len(model.theta)) - 1
    place = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            ok = [sent.value.tails(data, bounds)[:, rank] >= least
                  for _, _, data, bounds in text_chunks(batch.column(place))]
            if ok:
                yield batch.filter(pa.array(np.concatenate(ok)))

    return docs.mapInArrow(run, docs.schema)
