"""Substring de-duplication by relative Lempel-Ziv parsing.

The reference is every document; its indexed blocks are the runs of
WINDOW = 20 consecutive words, each known by its earliest start (smallest
id, then smallest position). A document is parsed left to right: where a
window has an earlier start, the longest factor of such windows is taken,
elsewhere a word is a literal. Windows that straddle a factor's end are
looked up too, so a factor covers every word of every repeated window and
nothing else.

To index every block that can repeat, and only those:

1. each window is named by its anchor, the smallest hash among its GRAM-word
   grams; equal windows have equal anchors, and a document has about
   2 / (WINDOW - GRAM + 2) anchors a word. Anchors are counted over all
   documents (pre-aggregated); the ones seen in one document only go back
   to it;
2. each document emits the hash (96 bits) of its windows with a shared
   anchor, once per document - repeats inside a document are found in it;
   the smallest id of each hash is the aggregate, so a passage that a third
   of all documents share is one row per task before the exchange;
3. that smallest id gets the window back, and the document parses itself:
   shared windows that did not come back start earlier elsewhere.

No pairs of documents are made and no join meets a hot key: both ways
back are keyed by document.

Defined cases: null, empty and short texts have no window and keep all
words; rows that share an id are no earlier than one another; a null id
comes after every id and shares its place with other null ids; equal rows
get equal results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, prepare, segment_ids, stage, text_chunks, word_hashes, word_spans

WINDOW = 20
GRAM = 6
_LAST_ID = (1 << 63) - 1
_P = np.uint64(0x9E3779B97F4A7C15)


def _fold(x: np.ndarray, size: int, step) -> np.ndarray:
    """``step`` folded over each ``size`` neighbours, by doubling."""
    have = 1
    while have < size and len(x):
        s = min(have, size - have)
        x = step(x[:-s], x[s:]) if len(x) > s else x[:0]
        have += s
    return x


class Parsed:
    """Words of a chunk of texts and, for each window inside one text, its
    first word (``at``), text (``text``), anchor and two hashes."""

    def __init__(self, data, bounds, window: int, gram: int):
        self.starts, self.ends, self.owner = word_spans(data, bounds)
        n = len(self.starts)
        h = word_hashes(data, self.starts, self.ends, lower=False)
        joined = lambda a, b: mix64(a * _P + b)                               # noqa: E731
        inside = np.zeros(0, dtype=bool)
        if n >= window:
            inside = self.owner[:n - window + 1] == self.owner[window - 1:]
        self.at = np.flatnonzero(inside)
        self.text = self.owner[self.at]
        anchors = _fold(_fold(h, gram, joined), window - gram + 1, np.minimum)
        self.anchor = anchors[self.at] if n >= window else h[:0]
        self.hash = _fold(h, window, joined)[self.at] if n >= window else h[:0]
        other = _fold(mix64(h + np.uint64(5)), window, joined)
        self.check = (other[self.at] >> np.uint64(32)).astype(np.int64) if n >= window else self.at
        # first start of each window in its text
        order = np.lexsort((self.at, self.hash, self.text))
        new = np.ones(len(order), dtype=bool)
        if len(order):
            new[1:] = (self.hash[order][1:] != self.hash[order][:-1]) | \
                      (self.text[order][1:] != self.text[order][:-1])
        self.first = np.zeros(len(order), dtype=bool)
        self.first[order[new]] = True


def _own(lists, text_of, values, n: int) -> np.ndarray:
    """Whether each value is in the list of its text (lists: n arrays)."""
    out = np.zeros(len(values), dtype=bool)
    cut = np.searchsorted(text_of, np.arange(n + 1))
    for i in range(n):
        got = lists[i]
        if got is not None and len(got) and cut[i] < cut[i + 1]:
            out[cut[i]:cut[i + 1]] = np.isin(values[cut[i]:cut[i + 1]], got)
    return out


def _lists(column, lo: int, hi: int) -> list:
    """Rows lo..hi of an Arrow list<long> column as uint64 arrays."""
    import pyarrow as pa

    part = column.slice(lo, hi - lo)
    offsets = part.offsets.to_numpy()
    values = part.values.to_numpy(zero_copy_only=False).view(np.uint64)
    valid = ~part.is_null().to_numpy(zero_copy_only=False)
    return [values[offsets[i]:offsets[i + 1]] if valid[i] else None for i in range(hi - lo)]


def _anchor_batches(batches, window, gram):
    import pyarrow as pa

    for batch in batches:
        for lo, hi, data, bounds in text_chunks(batch.column(1)):
            p = Parsed(data, bounds, window, gram)
            if not len(p.at):
                continue
            order = np.lexsort((p.anchor, p.text))
            a, t = p.anchor[order], p.text[order]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
            ids = batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(ids[t[new]]), pa.array(a[new].view(np.int64))],
                                             names=["id", "anchor"])


def _window_batches(batches, window, gram):
    import pyarrow as pa

    for batch in batches:
        for lo, hi, data, bounds in text_chunks(batch.column(1)):
            p = Parsed(data, bounds, window, gram)
            if not len(p.at):
                continue
            alone = _own(_lists(batch.column(2), lo, hi), p.text, p.anchor, hi - lo)
            go = np.flatnonzero(~alone & p.first)
            ids = batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[p.text[go]]), pa.array(p.hash[go].view(np.int64)),
                 pa.array(p.check[go].astype(np.uint32).view(np.int32))], names=["id", "hash", "check"])


def _factors(starts, text, window: int):
    """Word ranges covered by windows at the (ascending) starts; touching
    ones of a text are one."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero((np.diff(starts) > window) | (np.diff(text) != 0)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(starts)]]) - 1
    return starts[first], starts[last] + window


def _parsed_batches(batches, window, gram, with_text):
    import pyarrow as pa

    for batch in batches:
        for lo, hi, data, bounds in text_chunks(batch.column(1)):
            n = hi - lo
            p = Parsed(data, bounds, window, gram)
            alone = _own(_lists(batch.column(2), lo, hi), p.text, p.anchor, n)
            mine = _own(_lists(batch.column(3), lo, hi), p.text, p.hash, n)
            earlier = ~p.first | ~(alone | mine)
            f0, f1 = _factors(p.at[earlier], p.text[earlier], window)
            step = np.zeros(len(p.starts) + 1, dtype=np.int64)
            np.add.at(step, f0, 1)
            np.add.at(step, f1, -1)
            gone = np.cumsum(step[:-1]) > 0
            words = np.bincount(p.owner, minlength=n)
            removed = np.bincount(p.owner[gone], minlength=n)
            begin = np.concatenate([[0], np.cumsum(words)])[:-1]

            # kept words and one space after each, gathered in one go
            keep = ~gone
            s, length = p.starts[keep], p.ends[keep] - p.starts[keep] + 1
            total = np.concatenate([[0], np.cumsum(length)])
            idx = np.arange(total[-1]) - np.repeat(total[:-1] - s, length)
            out = np.concatenate([data, [32]]).astype(np.uint8)[idx] if len(idx) else np.zeros(0, np.uint8)
            out[total[1:] - 1] = 32
            per = np.bincount(p.owner[keep], weights=length, minlength=n).astype(np.int64)
            cut = np.concatenate([[0], np.cumsum(per)])
            kept = [out[cut[i]:max(cut[i + 1] - 1, cut[i])].tobytes() for i in range(n)]
            fo = p.owner[f0] if len(f0) else f0
            spans = pa.StructArray.from_arrays(
                [pa.array((f0 - begin[fo]) if len(f0) else f0, pa.int64()),
                 pa.array((f1 - begin[fo]) if len(f0) else f1, pa.int64())], names=["start", "end"])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(fo, minlength=n))]).astype(np.int32)
            cols = [batch.column(0).slice(lo, n), pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), spans)]
            names = ["id", "n_words", "n_removed", "kept_sha256", "factors"]
            if with_text:
                cols.append(pa.array([k.decode("utf-8") for k in kept], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names=names)


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
          gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_words``, ``n_removed`` (words in
    factors), ``kept_sha256`` (of the kept words joined by a space),
    ``factors`` (word ranges, end exclusive) and, ``with_text``, the
    ``kept_text``."""
    if not 1 <= gram <= window:
        raise ValueError("a window must hold a whole gram")
    prepare(docs.sparkSession)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("id"),
                       F.col(text_col).alias("text"))
    anchors = base.mapInArrow(lambda it: _anchor_batches(it, window, gram), "id long, anchor long")
    alone = anchors.groupBy("anchor").agg(F.count("*").alias("times"), F.min("id").alias("id")) \
        .where("times = 1").groupBy("id").agg(F.collect_list("anchor").alias("alone"))
    alone = stage(alone)

    placed = base.join(alone, "id", "left").select("id", "text", "alone")
    first = placed.mapInArrow(lambda it: _window_batches(it, window, gram),
                              "id long, hash long, check int") \
        .groupBy("hash", "check").agg(F.min("id").alias("id")) \
        .groupBy("id").agg(F.collect_list("hash").alias("mine"))
    lists = alone.join(first, "id", "full")
    out = base.join(lists, "id", "left").select("id", "text", "alone", "mine")
    schema = ("id long, n_words long, n_removed long, kept_sha256 string, "
              "factors array<struct<start:long,end:long>>" + (", kept_text string" if with_text else ""))
    out = out.mapInArrow(lambda it: _parsed_batches(it, window, gram, with_text), schema)
    kind = docs.schema[id_col].dataType
    return out.withColumn("id", F.when(F.col("id") != _LAST_ID, F.col("id")).cast(kind)) \
        .withColumnRenamed("id", id_col)
