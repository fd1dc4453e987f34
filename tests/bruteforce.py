"""Plain-Python restatements used as brute-force oracles in tests."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

TOKEN = re.compile(r"(?u)\b\w\w+\b")


def grams(text: str) -> list[str]:
    toks = TOKEN.findall(text.lower())
    out = list(toks)
    for n in (2, 3):
        out += [" ".join(toks[i:i + n]) for i in range(len(toks) - n + 1)]
    return out


def tfidf_matrix(docs: list[str], max_df: float | None):
    """Dense TF-IDF rows (smooth idf, L2 norm); None when the vocabulary is empty."""
    counts = [Counter(grams(d)) for d in docs]
    n = len(docs)
    df = Counter(t for c in counts for t in c)
    if not df:
        return None, []
    if max_df is not None:
        if max_df * n < 1:
            return None, []
        vocab = sorted(t for t, v in df.items() if v <= max_df * n)
    else:
        vocab = sorted(df)
    if not vocab:
        return None, []
    idx = {t: i for i, t in enumerate(vocab)}
    x = np.zeros((n, len(vocab)))
    for r, c in enumerate(counts):
        for t, v in c.items():
            if t in idx:
                x[r, idx[t]] = v * (math.log((1 + n) / (1 + df[t])) + 1)
    norms = np.sqrt((x * x).sum(axis=1))
    norms[norms == 0] = 1
    return x / norms[:, None], vocab


def naive_average_linkage(d: np.ndarray, threshold: float) -> list[set[int]]:
    clusters = [{i} for i in range(d.shape[0])]
    while len(clusters) > 1:
        best, pair = None, None
        for i in range(len(clusters)):
            for j in range(i + 1, len(clusters)):
                a, b = list(clusters[i]), list(clusters[j])
                avg = d[np.ix_(a, b)].mean()
                if best is None or avg < best:
                    best, pair = avg, (i, j)
        if best >= threshold:
            break
        i, j = pair
        clusters[i] |= clusters[j]
        del clusters[j]
    return clusters


def segment_partition(rows: list[tuple[int, str]], threshold: float) -> set[frozenset[int]]:
    """rows = [(row_id, query_norm)] of one segment -> partition of row ids."""
    ids = [r for r, _ in rows]
    x, _ = tfidf_matrix([t for _, t in rows], 0.95)
    if x is None:
        return {frozenset(ids)}
    d = 1 - x @ x.T
    d[d < 0] = 0
    return {frozenset(ids[i] for i in c) for c in naive_average_linkage(d, threshold)}
