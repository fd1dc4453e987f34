"""Toxicity: a convolutional text classifier trained in numpy.

A text is its sequence of lower-cased words (letters, digits and all
non-ASCII characters). Each word's vector is the sum of the hashed
embeddings of the whole word and of its leading 4, 5 and 6 bytes, so unseen
inflections of a known stem have one. Filters of WIDTHS words slide over the
sequence (padded with empty words at both ends), each filter keeps its
largest response in the text (max pooling over whole texts), and a logistic
layer over all pooled responses gives the score. Embeddings, filters and the
last layer are trained together by Adam on the logistic loss; the gradient
of a pooled response goes to the window that gave it.

Only hash places whose documents' share of the label is off by SCREEN
standard errors have an embedding; the others stay at zero, and a window of
zeros gives every filter its bias. So scoring runs the filters on windows
around known words only, which is exactly what all windows would give.

Fitting uses at most SAMPLE labelled documents (those with the smallest id
hashes) in one task: the documented bound. Three quarters train the network;
the rest calibrate it: a logistic map of the network's output to the score,
and one decision threshold for each language (largest F1 among the scores of
that language's rows, with the overall threshold where a language has fewer
than FEW labelled 1). Score never sees language; only the decision does.

Defined cases: null and empty texts have no words, so all of them get the
score of the biases; labels that are null or of unknown ids are ignored;
several labels of an id count one by one; without two label values in the
sample scores and decisions are null; an unknown or null language takes the
overall threshold; rows are scored one by one, so repeated rows and ids
score alike; an empty table gives no rows; columns besides the three read
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import letter_spans, prepare, text_chunks, word_hashes

BITS = 18               # hash places of the embeddings: 2^BITS
LEADS = (4, 5, 6)       # leading bytes of longer words that have an embedding too
DIM = 8                 # numbers of a word vector
WIDTHS = (1, 2, 3)      # words under a filter
FILTERS = 8             # filters of each width
SAMPLE = 8_000          # largest number of labelled documents that fit the model
EPOCHS = 10
BATCH = 256             # documents a step
RATE = 0.02             # Adam step
DECAY = 1e-4            # weight penalty
MIN_DOCS = 3            # sample documents that must hold a place
SCREEN = 3.0            # standard errors by which a place's label share must be off
FEW = 20                # labelled 1 that a language needs for its own threshold
SEED = 13

_MASK = np.uint64((1 << BITS) - 1)


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


def word_places(data, bounds):
    """(text of each word, number of the word in its text, places): places
    has one column for the whole word and one for each lead, -1 where the
    word is no longer than the lead."""
    starts, ends, owner = letter_spans(data, bounds)
    first = np.searchsorted(owner, np.arange(len(bounds) - 1))
    places = np.full((len(starts), 1 + len(LEADS)), -1, dtype=np.int64)
    for j, lead in enumerate((0, *LEADS)):
        use = np.arange(len(starts)) if not lead else np.flatnonzero(ends - starts > lead)
        stop = ends if not lead else starts[use] + lead
        h = word_hashes(data, starts[use], stop, lower=True, seed=31 + j)
        places[use, j] = (h & _MASK).astype(np.int64)
    return owner, np.arange(len(starts)) - first[owner], places


def known_words(owner, number, places, row_of):
    """Words with a known place: (text, number, rows of the embedding table,
    0 for none). Row 0 is the zero vector; ``row_of`` maps a place to its row."""
    rows = np.where(places >= 0, row_of[np.maximum(places, 0)], 0)
    use = rows.any(axis=1)
    return owner[use], number[use], rows[use]


def windows(text, number, width: int):
    """Windows of ``width`` words that hold a known word, in text order:
    (text of each window, (windows, width) indexes of known words, -1 for a
    word without a vector)."""
    n = len(text)
    span = np.int64(1 << 40)        # larger than any word number of a text
    at = text.astype(np.int64) * span + number + width
    start = np.unique((at[:, None] - np.arange(width)).ravel())
    want = start[:, None] + np.arange(width)
    found = np.minimum(np.searchsorted(at, want), max(n - 1, 0))
    return start // span, np.where(at[found] == want, found, -1) if n else want - 1


class Network:
    """Embedding table, filters and last layer. ``row_of`` maps places to
    rows of ``emb``; row 0 stays zero."""

    def __init__(self, row_of, rows: int, rng):
        self.row_of = row_of
        self.p = {"emb": rng.normal(0, 0.3, (rows, DIM)), "out": rng.normal(0, 0.1, FILTERS * len(WIDTHS)),
                  "bias": np.zeros(1)}
        self.p["emb"][0] = 0
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, 0.5 / np.sqrt(w), (w * DIM, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)

    def pooled(self, text, number, rows, n: int, keep: list | None = None):
        """(n, filters) largest responses after max(0, .). ``keep`` collects
        what the gradient needs, by width."""
        vec = np.concatenate([self.p["emb"][rows].sum(axis=1), np.zeros((1, DIM))])
        parts = []
        for w in WIDTHS:
            of, idx = windows(text, number, w)
            x = vec[idx].reshape(len(of), w * DIM)
            y = x @ self.p[f"f{w}"] + self.p[f"b{w}"]
            top = np.broadcast_to(self.p[f"b{w}"], (n, FILTERS)).copy()     # the window of zeros
            who = np.full((n, FILTERS), -1)
            if len(of):
                cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                best = np.maximum.reduceat(y, cut, axis=0)
                at = of[cut]
                if keep is not None:
                    hit = np.where(y == np.repeat(best, np.diff(np.r_[cut, len(of)]), axis=0),
                                   np.arange(len(of))[:, None], len(of))
                    first = np.minimum.reduceat(hit, cut, axis=0)
                    who[at] = np.where(best > top[at], first, -1)
                top[at] = np.maximum(top[at], best)
            if keep is not None:
                keep.append((w, idx, x, who, top))
            parts.append(np.maximum(top, 0))
        return np.concatenate(parts, axis=1)

    def logits(self, text, number, rows, n: int):
        return self.pooled(text, number, rows, n) @ self.p["out"] + self.p["bias"][0]

    def gradient(self, text, number, rows, label):
        """Gradient of the mean logistic loss of one batch."""
        n = len(label)
        keep: list = []
        h = self.pooled(text, number, rows, n, keep)
        d = (sigmoid(h @ self.p["out"] + self.p["bias"][0]) - label) / n
        g = {"out": h.T @ d, "bias": np.array([d.sum()])}
        dvec = np.zeros((len(text) + 1, DIM))
        for j, (w, idx, x, who, top) in enumerate(keep):
            back = d[:, None] * self.p["out"][j * FILTERS:(j + 1) * FILTERS] * (top > 0)
            g[f"b{w}"] = back.sum(axis=0)
            doc, filt = np.nonzero((who >= 0) & (back != 0))
            win, b = who[doc, filt], back[doc, filt]
            gf = np.zeros((FILTERS, w * DIM))
            np.add.at(gf, filt, x[win] * b[:, None])
            g[f"f{w}"] = gf.T
            dx = (self.p[f"f{w}"].T[filt] * b[:, None]).reshape(-1, w, DIM)
            np.add.at(dvec, idx[win], dx)       # -1 is the last row, thrown away
        ge = np.zeros_like(self.p["emb"])
        np.add.at(ge, rows, dvec[:len(text), None, :].repeat(rows.shape[1], axis=1))
        ge[0] = 0
        g["emb"] = ge
        return g


def train(owner, number, rows, label, row_of, table_rows: int, epochs: int = EPOCHS) -> Network:
    """Adam over batches of texts; words come in text order."""
    rng = np.random.default_rng(SEED)
    net = Network(row_of, table_rows, rng)
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    net.p["bias"][0] = np.log(share / (1 - share))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    n, t = len(label), 0
    begin = np.searchsorted(owner, np.arange(n + 1))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            pick = order[lo:lo + BATCH]
            size = begin[pick + 1] - begin[pick]
            of = np.repeat(np.arange(len(pick)), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[pick], size)
            t += 1
            for k, gk in net.gradient(of, number[at], rows[at], label[pick]).items():
                if k not in ("bias",):
                    gk = gk + DECAY * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
            net.p["emb"][0] = 0
    return net


def platt(logit, label, steps: int = 200):
    """(a, b) of sigmoid(a * logit + b), the logistic map that fits the
    labels best (Newton steps, a little ridge towards a = 1, b = 0)."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * logit + b)
        e, s = p - label, p * (1 - p)
        ga, gb = (e * logit).sum() + (a - 1), e.sum() + b
        haa, hab, hbb = (s * logit * logit).sum() + 1, (s * logit).sum(), s.sum() + 1
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def best_threshold(score, label) -> float:
    """Score from which calling a text toxic gives the largest F1, half way
    to the next lower score; the highest of equals."""
    order = np.argsort(-score, kind="stable")
    s, y = score[order], label[order]
    last = np.r_[s[1:] != s[:-1], True]
    hit = np.cumsum(y)
    f1 = np.where(last, 2 * hit / (np.arange(1, len(y) + 1) + y.sum()), -1.0)
    at = int(np.argmax(f1))
    return float((s[at] + (s[at + 1] if at + 1 < len(s) else 0.0)) / 2)


class Model:
    """A trained network, its calibration and the thresholds."""

    def __init__(self, net: Network, a: float, b: float, overall: float, by_lang: dict):
        self.net, self.a, self.b, self.overall, self.by_lang = net, a, b, overall, by_lang

    def scores(self, data, bounds) -> np.ndarray:
        known = known_words(*word_places(data, bounds), self.net.row_of)
        return sigmoid(self.a * self.net.logits(*known, len(bounds) - 1) + self.b)


def known_places(chunks, label, learn) -> np.ndarray:
    """Places that MIN_DOCS of the ``learn`` texts hold and whose share of
    the label is off by SCREEN standard errors. ``chunks()`` gives (owner,
    number, places) of runs of whole texts."""
    held, toxic = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for owner, _, places in chunks():
        for j in range(places.shape[1]):
            use = (places[:, j] >= 0) & learn[owner]
            pair = np.unique((places[use, j] << 32) | owner[use])
            place, doc = pair >> 32, pair & 0xFFFFFFFF
            held += np.bincount(place, minlength=1 << BITS)
            toxic += np.bincount(place, weights=label[doc], minlength=1 << BITS)
    share = label[learn].mean()
    return np.flatnonzero((held >= MIN_DOCS)
                          & (np.abs(toxic - held * share) >= SCREEN * np.sqrt(held * share * (1 - share))))


def fit_chunks(chunks, label, lang, check) -> Model | None:
    """Model from the words of the sample texts (in text order), their
    labels and languages; ``check`` marks the texts kept for calibration.
    Two passes over the texts: places, then words with a known one."""
    learn = ~check
    if len(np.unique(label[learn])) < 2:
        return None
    known = known_places(chunks, label, learn)
    row_of = np.zeros(1 << BITS, dtype=np.int32)
    row_of[known] = np.arange(1, len(known) + 1)
    words = [known_words(*c, row_of) for c in chunks()]
    text, number, rows = (np.concatenate(x) for x in zip(*words))

    def part(mask):
        mine = mask[text]
        return (np.cumsum(mask) - 1)[text[mine]], number[mine], rows[mine]
    net = train(*part(learn), label[learn].astype(np.float64), row_of, len(known) + 1)
    held_out = check if len(np.unique(label[check])) == 2 else learn
    logit = net.logits(*part(held_out), int(held_out.sum()))
    y, z = label[held_out], lang[held_out]
    a, b = platt(logit, y)
    s = sigmoid(a * logit + b)
    by_lang = {c: best_threshold(s[z == c], y[z == c]) for c in sorted(set(z) - {""}) if y[z == c].sum() >= FEW}
    return Model(net, a, b, best_threshold(s, y), by_lang)


def _fit_task(batches):
    import pickle

    import pyarrow as pa

    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches).sort_by([("tie", "ascending"), ("label", "ascending"), ("again", "ascending")])
    column = pa.chunked_array(rows.column("text").chunks).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)

    def chunks():
        for lo, hi, data, bounds in text_chunks(column):
            owner, number, places = word_places(data, bounds)
            yield owner + lo, number, places

    label = rows.column("label").to_numpy().astype(np.int64)
    lang = np.array([x or "" for x in rows.column("lang").to_pylist()], dtype=object)
    check = rows.column("tie").to_numpy() % 4 == 0
    model = fit_chunks(chunks, label, lang, check)
    if model is not None:
        # places as the list of known ones: the table of rows is mostly zero
        net = model.net
        known = np.flatnonzero(net.row_of)
        state = (known, net.p, model.a, model.b, model.overall, model.by_lang)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], type=pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, label: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Model of ``label`` (0 or 1, a column over ``labels``; its ``toxic``
    unless given), or None without both values to tell apart."""
    import pickle

    prepare(docs.sparkSession)
    y = F.col("toxic") if label is None else label
    marked = labels.select(F.col(id_col).alias("id"), y.cast("int").alias("label")) \
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1)) \
        .withColumn("tie", F.xxhash64("id")).orderBy("tie", "id", "label").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.col(lang_col).cast("string").alias("lang")) \
        .join(F.broadcast(marked), "id").withColumn("again", F.xxhash64("text")) \
        .select("tie", "label", "again", "text", "lang").orderBy("tie", "label", "again").limit(sample)
    got = rows.repartition(1).mapInArrow(_fit_task, "model binary").collect()     # one row of bounded size
    if not got:
        return None
    known, p, a, b, overall, by_lang = pickle.loads(got[0]["model"])
    row_of = np.zeros(1 << BITS, dtype=np.int32)
    row_of[known] = np.arange(1, len(known) + 1)
    net = Network(row_of, 1, np.random.default_rng(SEED))
    net.p = p
    return Model(net, a, b, overall, by_lang)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> DataFrame:
    """Per row: ``id_col``, ``score`` (0 to 1), ``threshold`` of its
    language and ``toxic`` (score >= threshold)."""
    kind = docs.schema[id_col].dataType
    if model is None:
        return docs.select(F.col(id_col), F.lit(None).cast("double").alias("score"),
                           F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("boolean").alias("toxic"))
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)     # 2^BITS places and the known ones' vectors

    def run(batches):
        import pyarrow as pa
        model = sent.value
        for batch in batches:
            for lo, hi, data, bounds in text_chunks(batch.column(1)):
                s = np.round(model.scores(data, bounds), 6)
                langs = batch.column(2).slice(lo, hi - lo).to_pylist()
                least = np.array([model.by_lang.get(x, model.overall) for x in langs], dtype=np.float64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(s), pa.array(least), pa.array(s >= least)],
                    names=["id", "score", "threshold", "toxic"])

    out = T.StructType([T.StructField("id", kind), T.StructField("score", T.DoubleType()),
                        T.StructField("threshold", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.col(lang_col).cast("string").alias("lang")).mapInArrow(run, out).withColumnRenamed("id", id_col)
