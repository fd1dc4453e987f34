import re

import corpus_pipeline
from clickgap.llm import hilbert, ordinal, poisson, queries, winnow
from clickgap.llm.common import stage, table

SF = "/root/testdata/sf0.001"


def kept_by_five_words(rows):
    """Ids of the documents that stay: the smallest of each group linked by
    80 % of equal five-word shingles, all pairs compared."""
    def shingles(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    p, q = root(a), root(b)
                    up[max(p, q)] = min(p, q)
    return [i for i in ids if root(i) == i]


def test_stages_take_effect_and_keep_columns(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    model = queries.quality_model(docs, table(spark, SF, "labels"))
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "near-duplicate removal", "benchmark decontamination", "source mixture", "sharding"]

    good = stage(steps["quality classifier"](spark, docs, SF))
    assert good.columns == names
    kept = {r.doc_id for r in ordinal.score(docs, model).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept

    single = stage(steps["near-duplicate removal"](spark, good, SF))
    assert single.columns == names
    assert sorted(r.doc_id for r in single.collect()) == kept_by_five_words(good.collect())

    clean = stage(steps["benchmark decontamination"](spark, single, SF))
    assert clean.columns == names
    bad = {r.doc_id for r in winnow.report(single, table(spark, SF, "benchmark")).where("contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - bad

    mixed = stage(steps["source mixture"](spark, clean, SF))
    assert mixed.columns == names
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in poisson.mix(clean).collect())

    last = steps["sharding"](spark, mixed, SF).collect()
    want = hilbert.document_shards(mixed).collect()
    assert sorted((r.shard, r.slot) for r in last) == sorted((r.shard, r.slot) for r in want)
    assert len(last) == mixed.count()


def test_run_equals_the_stages(spark):
    a, b = (corpus_pipeline.run(spark, SF) for _ in range(2))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 0


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, SF).count() == 0
