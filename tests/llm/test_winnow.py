import re

import pytest

from clickgap.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def brute(docs, items, n=13):
    wins = {}
    for i, t in items:
        w = words(t)
        size = min(n, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            wins.setdefault(tuple(w[s:s + size]), set()).add(i)
    sizes = {len(k) for k in wins}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                got = wins.get(tuple(w[s:s + size]))
                if got is not None:
                    hit.update(range(s, s + size))
                    found |= {str(x) for x in got if x is not None}
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def check(docs, items):
    d = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    b = [(r.item_id, r.text) for r in items.select("item_id", "text").collect()]
    got = winnow.report(docs, items).collect()
    mine = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got]
    assert sorted(map(str, mine)) == sorted(map(str, brute(d, b)))
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
    left = winnow.clean(docs, items)
    assert left.columns == docs.columns and left.schema.simpleString() == docs.schema.simpleString()
    assert left.count() == sum(not r[4] for r in mine)


PASSAGE = "The quick-brown fox; jumps over 2 lazy dogs and THEN rests, near the old Mühle by night"


@pytest.fixture
def items(spark):
    return spark.createDataFrame(
        [(10, PASSAGE, "z"), (9, PASSAGE + " again", "z"), (2, "Short item", "z"), (3, None, "z"), (4, "...", "z"),
         (None, "single", None), (5, "a b c d e f g h i j k l", "z")], "item_id long, text string, size string")


def test_short_and_long_items(spark, odd_docs, items):
    rows = [(100, "x " + PASSAGE.upper() + " y", None, None, None, None, None),
            (101, " ".join(PASSAGE.split()[:14]), None, None, None, None, None),
            (102, "this short  ITEM; is in " + "filler words go here " * 40, None, None, None, None, None),
            (103, "a b c d e f g h i j k l m", None, None, None, None, None), (103, "a b c", None, None, None, None, None)]
    check(odd_docs.union(spark.createDataFrame(rows, odd_docs.schema)), items)


def test_shuffled_sides_give_the_same(spark, odd_docs, items, monkeypatch):
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", -1)
    check(odd_docs, items)


def test_empty_sides(no_docs, odd_docs, items):
    assert winnow.report(no_docs, items).count() == 0
    check(odd_docs, items.limit(0))
