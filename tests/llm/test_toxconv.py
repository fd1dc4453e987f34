import numpy as np
from pyspark.sql import functions as F

from clickgap.llm import queries, toxconv as T


def sample_net(rng, places=6):
    row_of = np.zeros(1 << T.BITS, dtype=np.int32)
    row_of[np.arange(places) * 7 + 1] = np.arange(1, places + 1)
    net = T.Network(row_of, places + 1, rng)
    for w in T.WIDTHS:
        net.p[f"b{w}"] = rng.normal(0, 0.2, T.FILTERS)
    return net


def sample_words(rng, texts=9):
    """(text, number, rows) of known words and the length of each text."""
    lengths = rng.integers(0, 12, texts)
    lengths[0] = 0
    out = [(t, i, rng.integers(0, 7, 4)) for t in range(texts) for i in range(lengths[t]) if rng.random() < 0.5]
    out = [(t, i, r) for t, i, r in out if r.any()]
    return (np.array([o[0] for o in out]), np.array([o[1] for o in out]), np.array([o[2] for o in out])), lengths


def plain_logits(net, words, lengths):
    """Every window of every padded text, one by one."""
    out = []
    for t, n in enumerate(lengths):
        pad = max(T.WIDTHS)
        seq = np.zeros((n + 2 * pad, T.DIM))
        for of, i, rows in zip(*words):
            if of == t:
                seq[pad + i] = net.p["emb"][rows].sum(axis=0)
        h = []
        for w in T.WIDTHS:
            y = [seq[s:s + w].ravel() @ net.p[f"f{w}"] + net.p[f"b{w}"] for s in range(len(seq) - w + 1)]
            h.append(np.maximum(np.max(y, axis=0), 0))
        out.append(np.concatenate(h) @ net.p["out"] + net.p["bias"][0])
    return np.array(out)


def test_pooling_over_known_windows_equals_all_windows():
    rng = np.random.default_rng(1)
    for _ in range(20):
        net = sample_net(rng)
        words, lengths = sample_words(rng)
        if len(words[0]):
            assert np.allclose(net.logits(*words, len(lengths)), plain_logits(net, words, lengths))


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(2)
    net = sample_net(rng)
    words, lengths = sample_words(rng)
    label = rng.integers(0, 2, len(lengths)).astype(float)

    def loss():
        z = plain_logits(net, words, lengths)
        return np.mean(np.logaddexp(0, z) - label * z)
    g = net.gradient(*words, label)
    for name, value in net.p.items():
        for at in list(np.ndindex(value.shape))[::7]:
            if name == "emb" and at[0] == 0:
                continue
            old, eps = value[at], 1e-5
            value[at] = old + eps
            up = loss()
            value[at] = old - eps
            down = loss()
            value[at] = old
            assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-5, (name, at)


def test_threshold_has_the_best_f1():
    rng = np.random.default_rng(3)
    for _ in range(50):
        s, y = np.round(rng.random(30), 1), rng.integers(0, 2, 30)
        if y.sum():
            def f1(t):
                return 2 * (y & (s >= t)).sum() / ((s >= t).sum() + y.sum())
            assert f1(T.best_threshold(s, y)) >= max(f1(t) for t in s) - 1e-12


def test_word_places_are_those_of_each_word():
    texts = ["Ab abcdefg, x", "", "ÄB-abcdefg"]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0] + [len(r) for r in raw])
    owner, number, places = T.word_places(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)
    assert owner.tolist() == [0, 0, 0, 2, 2] and number.tolist() == [0, 1, 2, 0, 1]
    assert (places[1] == places[4]).all() and (places[1] >= 0).all()
    assert (places[0] >= 0).tolist() == [True, False, False, False]


def test_held_out_accuracy(spark):
    got = queries.op13_convolutional_toxicity(spark, "/root/testdata/sf0.1")
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    by = {(r.toxic, r.predicted): r["count"] for r in
          got.where("held_out").select("doc_id", "predicted").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert by[1, 1] >= 0.9 * (by[1, 1] + by.get((1, 0), 0)) and by.get((0, 1), 0) <= 0.01 * by[0, 0]
    assert got.count() == 10_000 and got.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(i, i % 2, f"l{i}") for i in range(1, 10)] + [(7, 0, "x"), (None, 1, "y"), (3, None, "z"), (99, 1, "w")]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int, text string")
    model = T.fit(odd_docs, labels)
    got = T.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.toxic is not None for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[2] == by[3] == by[4]      # no words
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert T.score(no_docs, model).count() == 0
    for docs, lab in ((odd_docs, labels.limit(0)), (no_docs, labels), (odd_docs, labels.where("toxic = 1"))):
        assert T.fit(docs, lab) is None
        assert all(r.score is None for r in T.score(docs, None).collect())
