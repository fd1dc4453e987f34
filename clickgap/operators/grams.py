"""Word 1-3-grams of texts and their counts over all texts, as arrays.

A block of texts is read as one byte array: tokens are its runs of word
characters, a gram is known by a 64-bit hash of its tokens, and tf, df and
weights are counted by sorting. What goes between tasks are arrays in binary
columns, never a row a gram:

* ``count_kernel``: a block's distinct (stratum, gram) hashes with the number
  of documents that have them, cut into buckets by hash;
* ``df_kernel``: a bucket's document frequencies over all blocks, sent back to
  each block in the order in which it asked;
* ``weight_kernel``: the block again, now with the frequencies: one row a
  document with its grams' tf, df, idf and L2-normalised weights.

Memory: one block (BLOCK_BYTES of text, some sixty bytes a gram) or one bucket
(the hashes of a few blocks). Two grams of one hash would be counted as one;
the chance is n^2 / 2^65 for n different grams.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
_RANDOM = np.random.default_rng(20240229)
BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers, in place."""
    h ^= h >> np.uint64(32)
    h *= _A
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


@functools.lru_cache(maxsize=1)
def _powers(log: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log
    up, down = np.full(n, _P, dtype=np.uint64), np.full(n, _P_INV, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


class Grams:
    """Every 1-, 2- and 3-gram occurrence of some texts: ``row`` and ``hash``,
    and where its text starts and ends among ``letters``, the tokens with one
    space between."""

    def __init__(self, column: pa.Array):
        raw, offsets = _bytes(column)
        n = len(raw)
        word = WORD[raw]
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner] = after[inner - 1] = False
        first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
        long = last > first                 # a token has two characters at least
        self.raw, self.first, self.end = raw, first[long], last[long] + 1
        up, down = _powers(max(10, int(n).bit_length()))
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE[raw] * up[:n], out=total[1:])
        one = _mix((total[self.end] - total[self.first]) * down[self.first]
                   + (self.end - self.first).astype(np.uint64) * _B)
        at = np.searchsorted(offsets, self.first, side="right") - 1        # row of each token
        two_ok = at[1:] == at[:-1]
        two = _mix(one[:-1] * _A + one[1:] + np.uint64(2))
        three_ok = two_ok[1:] & two_ok[:-1]
        three = _mix(two[:-1] * _B + one[2:] + np.uint64(3)) if len(one) > 2 else one[:0]
        self.token = np.concatenate([np.arange(len(one)), np.flatnonzero(two_ok), np.flatnonzero(three_ok)])
        self.size = np.repeat(np.array([1, 2, 3]), [len(one), two_ok.sum(), three_ok.sum()])
        self.row = at[self.token]
        self.hash = np.concatenate([one, two[two_ok], three[three_ok]])

    def strings(self, of: np.ndarray) -> pa.Array:
        """The texts of the occurrences ``of``."""
        size = self.end - self.first
        place = np.concatenate([[0], np.cumsum(size + 1)])         # of each token among the letters
        letters = np.full(place[-1], 32, dtype=np.uint8)            # a space after each
        letters[_spans(place[:-1], size)] = self.raw[_spans(self.first, size)]
        token, n = self.token[of], self.size[of]
        start = place[token]
        length = place[token + n] - 1 - start
        offsets = np.concatenate([[0], np.cumsum(length)])
        data = letters[_spans(start, length)]
        return pa.LargeStringArray.from_buffers(len(of), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)) \
            .cast(pa.string())


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def _counted(column: pa.Array, doc: np.ndarray, stratum: np.ndarray) -> tuple:
    """(grams, keys, doc, code, tf, sample): the block's distinct (stratum,
    gram) keys in order; by document and key its tf and one occurrence."""
    g = Grams(column)
    full = _mix(g.hash + _mix(stratum.astype(np.uint64) + _P)[g.row])
    order = order_of(full)
    ordered = full[order]
    new = np.ones(len(full), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    keys = ordered[new]
    code = np.empty(len(full), dtype=np.int64)
    code[order] = np.cumsum(new) - 1
    sample = order[new]
    pair = np.sort(doc[g.row] * max(len(keys), 1) + code)
    start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    tf = np.diff(np.append(start, len(pair)))
    of, code = np.divmod(pair[start], max(len(keys), 1))
    return g, keys, of, code, tf, sample


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin: buckets are ranges of the hash."""
    step = (1 << 64) // buckets
    return np.append(np.searchsorted(keys, np.array([i * step for i in range(buckets)], dtype=np.uint64)), len(keys))


def order_of(values: np.ndarray) -> np.ndarray:
    """``argsort`` of 64-bit numbers of no sign: places are sorted along in the
    low bits, which is several times faster; a tie of what is left of the values
    that hides another order falls back."""
    low = int(len(values)).bit_length()
    cut = max((int(values.max()).bit_length() if len(values) else 0) + low - 64, 0)
    packed = (values >> np.uint64(cut)) << np.uint64(low)
    packed |= np.arange(len(values), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << low) - 1)).astype(np.int64)
    if cut:
        sorted_ = values[order]
        if (sorted_[1:] < sorted_[:-1]).any():
            return np.argsort(values, kind="stable")
    return order


def _documents(table: pa.Table, names: list[str]) -> tuple[np.ndarray, int]:
    """Rows of equal ``names`` are one document: (number of each row, documents)."""
    codes = table.select(names).to_pandas().groupby(names, dropna=False, sort=False).ngroup().to_numpy()
    return codes.astype(np.int64), int(codes.max()) + 1 if len(codes) else 0


def count_kernel(buckets: int):
    """Rows (_block, _s, _doc, _m, _text) of a block to (bucket, block, keys, counts)."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc, n = _documents(table, ["_s", "_doc", "_m"])
        mult = np.zeros(n, dtype=np.int64)
        mult[doc] = table["_m"].to_numpy()
        _, keys, of, code, _, _ = _counted(_whole(table["_text"]), doc, table["_s"].to_numpy())
        count = np.bincount(code, mult[of], minlength=len(keys)).astype(np.int64) if len(code) else np.zeros(0, np.int64)
        edge = _edges(keys, buckets)
        some = [i for i in range(buckets) if edge[i + 1] > edge[i]]
        return pa.table({
            "bucket": pa.array(some, pa.int32()),
            "block": pa.array([table["_block"][0].as_py()] * len(some), pa.int64()),
            "keys": pa.array([keys[edge[i]:edge[i + 1]].tobytes() for i in some], pa.binary()),
            "counts": pa.array([count[edge[i]:edge[i + 1]].tobytes() for i in some], pa.binary())})
    return run


def df_kernel(table: pa.Table) -> pa.Table:
    """Rows (bucket, block, keys, counts) of a bucket to (block, bucket, df)."""
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["keys"]]
    every = np.concatenate(keys)
    order = order_of(every)
    ordered = every[order]
    new = np.ones(len(every), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    count = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table["counts"]])[order]
    start = np.flatnonzero(new)
    df = np.empty(len(every), dtype=np.int64)
    df[order] = np.repeat(np.add.reduceat(count, start), np.diff(np.append(start, len(every))))
    edge = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    return pa.table({"block": table["block"], "bucket": table["bucket"],
                     "df": pa.array([df[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:])], pa.binary())})


def weight_kernel(max_df: float | None, words: bool, each: bool = False):
    """The block and its frequencies to one row a document: its columns that do
    not start with "_", ``kept`` (grams left by ``max_df``) and ``grams``, an
    array of (term, tf, df, idf, w), or else tk and w, the hashes and weights of
    the grams that another document may have, as bytes. ``each``: a row for
    every pair of a text and a document of its stratum and key."""
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        doc, n = _documents(texts, ["_s", "_doc", "_m"])
        norm, norms = _documents(texts, ["_s", "_doc"])
        g, keys, of, code, tf, sample = _counted(_whole(texts["_text"]), doc, texts["_s"].to_numpy())
        first = np.full(n, len(doc), dtype=np.int64)
        np.minimum.at(first, doc, np.arange(len(doc)))
        parts = sorted(zip(found["bucket"].to_pylist(), found["df"].to_pylist()), key=lambda x: x[0])
        df = np.frombuffer(b"".join(x for _, x in parts), dtype=np.int64)[code]
        total = texts["_n"].to_numpy().astype(np.float64)[first][of]
        if max_df is not None:
            keep = df <= float(max_df) * total
            of, code, tf, df, total = of[keep], code[keep], tf[keep], df[keep], total[keep]
        idf = np.log((total + 1.0) / (df + 1.0)) + 1.0
        raw = tf * idf
        owner = norm[first][of]
        w = raw / np.sqrt(np.bincount(owner, raw * raw, minlength=norms))[owner]
        kept = np.bincount(of, minlength=n)
        out = {"kept": pa.array(kept, pa.int64())}
        if words:
            edge = np.concatenate([[0], np.cumsum(kept)])
            out["grams"] = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays(
                [g.strings(sample[code]), pa.array(tf, pa.int64()), pa.array(df, pa.int64()), pa.array(idf), pa.array(w)],
                ["term", "tf", "df", "idf", "w"]))
        else:
            if norms < n:                   # one vector a stratum and key
                order = np.argsort(owner, kind="stable")
                of, code, df, w, n = owner[order], code[order], df[order], w[order], norms
                first = np.full(n, len(doc), dtype=np.int64)
                np.minimum.at(first, norm, np.arange(len(doc)))
                out["kept"] = pa.array(np.bincount(of, minlength=n), pa.int64())
            shared = df > 1
            edge = np.concatenate([[0], np.cumsum(np.bincount(of[shared], minlength=n))])
            out |= {"tk": _packed(keys[code[shared]], edge), "w": _packed(w[shared], edge)}
        row, entry = first, np.arange(n)
        if each and n < len(doc):           # two texts of one key
            by = np.argsort(norm[first], kind="stable")
            size = np.bincount(norm[first], minlength=norms)
            row = np.repeat(np.arange(len(doc)), size[norm])
            entry = by[_spans((np.cumsum(size) - size)[norm], size[norm])]
        rows = texts.select([c for c in texts.column_names if not c.startswith("_")]).take(pa.array(row))
        for name, column in out.items():
            rows = rows.append_column(name, column if row is first else column.take(pa.array(entry)))
        return rows
    return run


def _packed(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(edge) - 1, [None, pa.py_buffer((edge * values.itemsize).astype(np.int64)), pa.py_buffer(values)]
    ).cast(pa.binary())


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
