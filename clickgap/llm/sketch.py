"""Near-duplicate documents by fast similarity sketching.

A document's set holds its distinct shingles of ``SHINGLE`` words. Its
sketch has T coordinates. Round i < T throws every element into a hashed
bin with a hashed value i + [0, 1); round T + j throws all of them into
bin j. Each bin keeps its smallest value and the rounds end when all bins
are filled, which is certain after 2 T rounds and usual after
(T ln T) / |set| of them. Two coordinates agree with the Jaccard
similarity of the sets as probability, with concentration like
independent trials.

BANDS bands of ROWS coordinates make the buckets. At similarity 0.8 a pair
misses one band with probability 1 - 0.8^5 = 0.67 and all 48 with 5e-9.

Groups are found without writing all pairs of a group:

1. documents with equal sets are one class (pre-aggregated before any
   exchange), named by its smallest id;
2. each bucket links its members to its smallest class, its leader L,
   confirmed on the whole shingle sets;
3. two members m, x of a bucket may be linked though m is not linked to L.
   Write D for the symmetric difference with L. Similarity t means
   |m ^ x| <= r (|m| + |x|), r = (1 - t) / (1 + t), and m not linked to L
   means |D_m| > r (|m| + |L|); so D_m and D_x share more than
   (|D_x| + r (|L| - |x|)) / 2 elements, and at least |D| - |own| (1 - t) / t
   of either. By the prefix principle such a pair meets in the first few
   elements of both differences under any fixed order. The order puts
   elements outside L first and frequent ones last, so a large group of
   near copies meets only where copies share changes.
   Pairs of different components that meet are confirmed; this step is
   exact for all pairs that share a bucket.

Components come from label propagation with pointer jumping, staged each
round; no links or labels are collected.

Defined cases: null or empty text and texts without words have an empty
set, are linked with nothing and form their own group; texts of fewer
than SHINGLE words have one shingle, the whole sequence; rows that share
an id count as linked; a null id takes no part and gets a null component
and kept = true; an empty table gives no rows; extra columns are ignored
by ``groups`` and kept by ``representatives``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (fresh, mix64, prepare, segment_ids, stage, text_chunks,
                     word_hashes, word_spans)

SHINGLE = 2
THRESHOLD = (80, 100)       # intersection / union, as whole numbers
BANDS, ROWS = 48, 5
BROADCAST_PAIRS = 1_000_000     # largest table of id pairs that is broadcast
ORDER_SAMPLE = 2_000        # texts whose frequent shingles come last in the order
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW48 = np.uint64((1 << 48) - 1)
_LOW52 = np.uint64((1 << 52) - 1)


# --- sketches ------------------------------------------------------------------

def shingle_elements(data, bounds, size: int):
    """Distinct shingle hashes (52 bits) of the texts of a chunk, sorted by
    text: (element, text index)."""
    starts, ends, owner = word_spans(data, bounds)
    h = word_hashes(data, starts, ends, lower=True)
    n_docs = len(bounds) - 1
    words = np.bincount(owner, minlength=n_docs)
    # shingle at each word that has size - 1 followers in its text; texts of
    # fewer words hash all they have
    first = np.concatenate([[0], np.cumsum(words)])[:-1]
    rank = np.arange(len(owner)) - first[owner]
    have = words[owner]
    use = np.where(have >= size, rank + size <= have, rank == 0)
    length = np.minimum(have, size)
    at = np.flatnonzero(use)
    e = mix64(length[at].astype(np.uint64))
    for j in range(size):
        more = length[at] > j
        e[more] = mix64(e[more] * np.uint64(0x9E3779B97F4A7C15) + h[at[more] + j])
    packed = (owner[at].astype(np.uint64) << np.uint64(52)) | (e >> np.uint64(12))
    packed = np.unique(packed)
    return packed & _LOW52, (packed >> np.uint64(52)).astype(np.int64)


def sketch_matrix(elements, owner, n_docs: int, t: int) -> np.ndarray:
    """Sketch of each text (n_docs x t, uint64; rows of empty sets hold the
    largest value)."""
    out = np.full(n_docs * t, _LAST, dtype=np.uint64)
    e, o = elements, owner
    for i in range(2 * t):
        v = mix64(e + mix64(np.full(1, i + 1, dtype=np.uint64)))
        if i < t:
            bins = (((v >> np.uint64(48)) * np.uint64(t)) >> np.uint64(16)).astype(np.int64)
        else:
            bins = i - t
        np.minimum.at(out, o * t + bins, (np.uint64(i) << np.uint64(48)) | (v & _LOW48))
        open_ = (out.reshape(n_docs, t) == _LAST).any(axis=1)
        keep = open_[o]
        if not keep.all():
            e, o = e[keep], o[keep]
        if not len(e):
            break
    return out.reshape(n_docs, t)


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    h = mix64(np.arange(1, bands + 1, dtype=np.uint64))[None, :] + np.zeros((len(sketch), 1), np.uint64)
    for j in range(rows):
        h = mix64((h ^ parts[:, :, j]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j))
    return h.view(np.int64)


def _sketch_batches(batches, size: int, bands: int, rows: int):
    import pyarrow as pa

    for batch in batches:
        for lo, hi, data, bounds in text_chunks(batch.column(1)):
            e, owner = shingle_elements(data, bounds, size)
            n = hi - lo
            counts = np.bincount(owner, minlength=n)
            keys = band_hashes(sketch_matrix(e, owner, n, bands * rows), bands, rows)
            cut = np.concatenate([[0], np.cumsum(counts)])
            names = [hashlib.blake2b(e[cut[i]:cut[i + 1]].tobytes(), digest_size=16).hexdigest()
                     for i in range(n)]
            keys = keys.copy()
            full = counts > 0
            offsets = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n), pa.array(names, pa.string()),
                 pa.array(counts, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel(), pa.int64()))],
                names=["id", "set_key", "n", "bands"])


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE,
             bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: ``id``, ``set_key`` (equal for equal sets), ``n`` (set
    size), ``bands`` (bucket keys; none for an empty set)."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(lambda it: _sketch_batches(it, size, bands, rows),
                    "id long, set_key string, n long, bands array<long>")


# --- exact confirmation ------------------------------------------------------------

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_set(text: str | None, size: int) -> set:
    """The whole set of a text, by the words themselves."""
    w = _WORD.findall((text or "").encode("utf-8").translate(_FOLD))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return set(zip(*[w[i:] for i in range(size)]))


def _agrees(a: set, b: set, threshold) -> bool:
    num, den = threshold
    both = len(a & b)
    return both > 0 and den * both >= num * (len(a) + len(b) - both)


def _pair_sets(batch, size: int, recent: dict):
    """Shingle sets of the two texts of each row; leaders repeat."""
    for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
        b = recent.get(y)
        if b is None:
            if len(recent) >= 16:
                recent.clear()
            b = recent[y] = shingle_set(y, size)
        yield shingle_set(x, size), b


def _linked(batches, size: int, threshold):
    import pyarrow as pa

    recent: dict = {}
    for batch in batches:
        keep = pa.array([_agrees(a, b, threshold) for a, b in _pair_sets(batch, size, recent)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)],
                                         names=["a", "b"])


def _name(element: tuple) -> int:
    return int.from_bytes(hashlib.blake2b(b"\x00".join(element), digest_size=8).digest(), "little", signed=True)


def _element_batches(batches, size: int):
    import pyarrow as pa

    for batch in batches:
        for x in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array([_name(e) for e in shingle_set(x, size)], pa.int64())],
                                             names=["element"])


def common_elements(pairs: DataFrame, texts: DataFrame, size: int) -> dict:
    """Document counts of the frequent shingles of ORDER_SAMPLE involved
    texts (those with the smallest id hashes). Only the order of elements
    uses it, which is right whatever the counts are."""
    nodes = pairs.select(F.col("a").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(ORDER_SAMPLE)
    rows = texts.join(F.broadcast(nodes), "id").select("text") \
        .mapInArrow(lambda it: _element_batches(it, size), "element long") \
        .groupBy("element").agg(F.count("*").alias("times")).where(f"times >= {ORDER_SAMPLE // 200}")
    return {r["element"]: r["times"] for r in rows.collect()}


def difference_prefix(a: set, lead: set, linked: bool, threshold, common: dict) -> tuple[list, int]:
    """(elements, n): the first elements of the difference of ``a`` and its
    leader in the fixed order; a linked member needs the first n as partner
    of an unlinked one, an unlinked member all of them."""
    num, den = threshold
    d = a ^ lead
    # floor of (|D| + r (|L| - |a|)) / 2, plus one: elements shared at least
    shared = (len(d) * (den + num) + (den - num) * (len(lead) - len(a))) // (2 * (den + num)) + 1
    reach = len(a) * (den - num) // num + 1
    n = max(0, min(len(d) - shared + 1, reach))
    most = n if linked else min(max(reach, n), len(d))
    if not most:
        return [], n
    ranked = sorted((e in lead, common.get(h, 0), h) for e, h in ((e, _name(e)) for e in d))
    return [h for _, _, h in ranked[:most]], n


def _star_batches(batches, size: int, threshold, common: dict):
    import pyarrow as pa

    recent: dict = {}
    for batch in batches:
        linked, first, counts, na = [], [], [], []
        for a, b in _pair_sets(batch, size, recent):
            ok = _agrees(a, b, threshold)
            elements, n = difference_prefix(a, b, ok, threshold, common)
            linked.append(ok)
            first.append(elements)
            counts.append(n)
            na.append(len(a))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(na, pa.int64()),
             pa.array(first, pa.list_(pa.int64())), pa.array(counts, pa.int32())],
            names=["a", "b", "linked", "n", "first", "as_partner"])


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with both texts. Only texts of involved rows travel, and
    ids are broadcast while the pairs are at most BROADCAST_PAIRS; beyond,
    and for the texts themselves, joins shuffle and hot ids split."""
    small = pairs.count() <= BROADCAST_PAIRS
    sent = F.broadcast if small else (lambda df: df)
    involved = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = stage(texts.join(sent(involved), "id", "left_semi"))
    with_b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).join(sent(pairs), "b")
    full = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return full.select("a", "b", "text_a", "text_b")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, threshold) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    return _with_texts(pairs, texts).mapInArrow(lambda it: _linked(it, size, threshold), "a long, b long")


def stars(pairs: DataFrame, texts: DataFrame, size: int, threshold) -> DataFrame:
    """Pairs (member a, leader b) with ``linked``, the member's set size
    ``n`` and its difference prefix (``first``, ``as_partner``)."""
    sent = pairs.sparkSession.sparkContext.broadcast(common_elements(pairs, texts, size))
    return _with_texts(pairs, texts).mapInArrow(
        lambda it: _star_batches(it, size, threshold, sent.value),
        "a long, b long, linked boolean, n long, first array<long>, as_partner int")


# --- components -----------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node reachable over ``edges`` (a, b), for
    every node on an edge. Each round takes the smallest neighbouring label,
    then jumps to that label's own label; rounds grow with the logarithm of
    a chain of groups in practice and end when nothing changes."""
    both = stage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
                 .where("a <> b").distinct())
    labels = stage(both.groupBy(F.col("a").alias("node"))
                   .agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = stage(labels.join(near, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = stage(step.join(jump, "label", "left").select(
            "node", "old", F.least("label", "far").alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


# --- groups ------------------------------------------------------------------------------

def _with_label(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
           threshold=THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_shingles``, ``component_id``
    (smallest id reachable over links), ``kept`` (it is that id)."""
    prepare(docs.sparkSession)
    num, den = threshold
    found = stage(sketches(docs, id_col, text_col, size, bands, rows))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    classes = stage(found.where("id IS NOT NULL AND n > 0").groupBy("set_key")
                    .agg(F.min("id").alias("node"), F.first("bands").alias("bands")))
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    shared = stage(banded.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("top"))
                   .where("lead <> top").select("bucket", "lead"))
    members = banded.join(shared, "bucket")

    pairs = stage(members.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
                  .distinct())
    star = stage(stars(pairs, texts, size, threshold))
    links = star.where("linked").select("a", "b")
    labels = components(links)

    of_node = _with_label(star.select(F.col("a").alias("node"), F.col("b").alias("lead"), "linked", "n", "first",
                                      "as_partner"), labels)
    # a pair that shares several stars is decided by any one of them: if it is
    # the largest star of both members, only there
    sizes = star.groupBy(F.col("b").alias("lead")).agg(F.count("*").alias("members"))
    of_node = stage(of_node.join(stage(sizes), "lead"))
    main = of_node.groupBy("node").agg(F.max(F.struct("members", "lead"))["lead"].alias("main"))
    of_node = of_node.join(main, "node")
    apart = of_node.where("NOT linked").select(
        "lead", F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"),
        F.col("main").alias("ma"), F.explode("first").alias("element"))
    partner = of_node.select(
        "lead", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"),
        F.col("main").alias("mb"), F.explode(F.slice("first", F.lit(1), F.col("as_partner"))).alias("element"))
    # elements whose members all carry one label already join nothing new:
    # their keys go before the join, not their pairs after it
    mixed = stage(apart.select("lead", "element", F.col("la").alias("label"))
                  .union(partner.select("lead", "element", F.col("lb").alias("label")))
                  .groupBy("lead", "element").agg(F.min("label").alias("low"), F.max("label").alias("high"))
                  .where("low <> high").select("lead", "element"))
    apart = apart.join(mixed, ["lead", "element"], "left_semi")
    partner = partner.join(mixed, ["lead", "element"], "left_semi")
    rest = apart.join(partner, ["lead", "element"]).where(
        f"la <> lb AND (ma <> mb OR lead = ma) AND {den} * least(na, nb) >= {num} * greatest(na, nb)") \
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = stage(rest)
    if not rest.isEmpty():
        links = links.union(stage(confirmed(rest, texts, size, threshold)))
        labels = components(links)

    named = classes.select("set_key", "node").join(labels, "node", "left") \
        .select("set_key", F.coalesce("label", "node").alias("of_class"))
    # rows that share an id are one node: the smallest label of its classes
    by_id = named.join(found.where("id IS NOT NULL").select("id", "set_key"), "set_key") \
        .groupBy("id").agg(F.min("of_class").alias("component"))
    return found.select("id", F.col("n").alias("n_shingles")).join(by_id, "id", "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
        (F.col("id").isNull() | (F.coalesce("component", "id") == F.col("id"))).alias("kept"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest
    id; of rows that repeat that id, one. Columns as they were."""
    key, = fresh(docs, "kept_id")
    kept = groups(docs, id_col, text_col, **kw).where("kept").groupBy(id_col).agg(F.count("*").alias("times")) \
        .select(F.col(id_col).alias(key), "times")
    kept = stage(kept)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    once, again = kept.where(f"times = 1 AND {key} IS NOT NULL"), kept.where(f"times > 1 AND {key} IS NOT NULL")
    match = F.col(f"`{id_col}`").cast("long") == F.col(key)
    single = docs.join(once, match, "left_semi").select(*cols)
    repeated = docs.join(again, match, "left_semi").select(*cols).dropDuplicates([id_col])
    return single.union(repeated).union(docs.where(F.col(f"`{id_col}`").isNull()).select(*cols))
