import hashlib
import random
import re

import pytest

from clickgap.llm import rlz

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """(n_words, n_removed, sha) per row, by the definition."""
    words = [WORD.findall(t or "") for _, t in rows]
    order = [(1 << 63) - 1 if i is None else i for i, _ in rows]
    first = {}
    for i, w in zip(order, words):
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in zip(order, words):
        gone, seen = set(), set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            if first[k] < i or k in seen:       # rows of one id are no earlier than one another
                gone.update(range(s, s + window))
            seen.add(k)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(spark, docs, window=20, gram=6):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = rlz.parse(docs, window=window, gram=gram).collect()
    want = [(i, *b) for (i, _), b in zip(rows, brute(rows, window))]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert sum(f.end - f.start for f in r.factors) == r.n_removed


def test_tables(spark, sf001_docs):
    check(spark, sf001_docs)


def test_odd_rows(spark, odd_docs, no_docs):
    check(spark, odd_docs)
    assert rlz.parse(no_docs).count() == 0


@pytest.mark.parametrize("window,gram", [(5, 2), (4, 4), (3, 1), (1, 1)])
def test_small_windows_on_few_words(spark, window, gram):
    rng = random.Random(window)
    rows = [(i // 2 if i % 5 == 0 else i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 60))))
            for i in range(60)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"), window, gram)


def test_factor_ends_at_text_ends(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = spark.createDataFrame([(1, passage), (2, passage), (3, passage + " tail"), (4, "head " + passage)],
                                 "doc_id long, text string")
    check(spark, docs)
