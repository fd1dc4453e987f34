import hashlib
import random
import re

from pyspark.sql import functions as F

from clickgap.llm import contextual

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(ds):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
               for i, d in enumerate(int(c) for c in reversed(ds))) % 10 == 0


def base(text):
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)      # noqa: E731
    for kind, rx, ok in (
            ("email", EMAIL, lambda s: True),
            ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
            ("card", CARD, lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
            ("phone", PHONE, lambda s: 8 <= len(digits(s)) <= 15)):
        out += [f"{kind}:{m.start()}:{m.end()}" for m in rx.finditer(text) if ok(m.group())]
    return ",".join(out)


EDGE = ["a@b.com_x@c.de", "x@y", "1.2.3.4.5.6.7.8", "0255.001.1.1 256.1.1.1 1.2.3", "4111 1111 1111 1111",
        "4111-1111-1111-1111-0 4111111111111111", "+1 (017) 555-7713 +1+2+34567890", "é😀 a@b.co +49 30 1234567é",
        "9" * 30_000, "a." * 20_000 + "@x.y", "(" * 5000 + "+1" + "(" * 5000, "12 34-56  78 " * 50, "", None,
        "+12345678.", "1.2.3.4@5.6.7.8", "4111  1111 1111 1111 11 11 11"]


def test_base_spans_equal_plain_expressions(spark, odd_docs, sf001_docs):
    edge = spark.createDataFrame(list(enumerate(EDGE)), "doc_id long, text string")
    for docs in (edge, odd_docs, sf001_docs):
        got = contextual.extract(docs).select("doc_id", contextual.span_text(F.col("base")).alias("b")).collect()
        want = [(r.doc_id, base(r.text)) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_contexts_find_unseen_identifiers_and_leave_the_rest(spark):
    seeds = ["ann@x.org", "bob@y.org", "cyd@z.org", "dan@q.org"]
    rows = [(i, f"please write to {s} today") for i, s in enumerate(seeds)]
    rows += [(10, "please write to eve1(at)w today"), (11, "please write to frank77 today"), (12, "order number frank88 shipped"),
             (13, "page 123456 of it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in contextual.extract(docs, least=0.6).select(
        "doc_id", contextual.span_text(F.col("spans")).alias("s")).collect()}
    assert got[11] == "email:16:23"
    assert got[12] == "" and got[13] == ""
    assert all(got[i] == f"email:16:{16 + len(s)}" for i, s in enumerate(seeds))


def test_any_token_fills_the_slot_of_a_pattern(spark):
    """Unseen values of any characters and length, in contexts of any length."""
    long = "k" * 300
    seeds = ["ann@x.org", "bob@y.org", "cyd@z.org", "dan@q.org", "eva@q.org", "fay@q.org", "gus@q.org", "hal@q.org"]
    values = ["eve1(at)w", "jane(at)corp.com", "jane@localhost", "fe80::1:2", "x7", "user123(at)corp.com", "t" * 100 + "9"]
    rows = [(i, f"please write {long} {s} today") for i, s in enumerate(seeds)]
    rows += [(100 + i, f"please write {long} {v} today") for i, v in enumerate(values)]
    rows += [(200, f"please write {'j' * 5 + long[5:]} other today"), (201, f"please write {long} (nobody), then"),
             (202, "plain words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in contextual.extract(docs, least=0.4).select(
        "doc_id", contextual.span_text(F.col("spans")).alias("s")).collect()}
    at = len("please write ") + 301
    assert all(got[i] == f"email:{at}:{at + len(s)}" for i, s in enumerate(seeds))
    assert all(got[100 + i] == f"email:{at}:{at + len(v)}" for i, v in enumerate(values))
    assert got[200] == got[202] == "" and got[201] == f"email:{at}:{at + 9}"
    # the planted value of the bootstrapping test
    few = [(i, f"please write to {s} today") for i, s in enumerate(seeds[:4])]
    few += [(10, "please write to eve1(at)w today"), (11, "please write to frank77 today")]
    got = {r.doc_id: r.s for r in contextual.extract(spark.createDataFrame(few, "doc_id long, text string"), least=0.6)
           .select("doc_id", contextual.span_text(F.col("spans")).alias("s")).collect()}
    assert got[10] == "email:16:25" and got[11] == "email:16:23"


def plain_scores(edges, rounds, support, share):
    """The scores of the graph, by its definition."""
    values, seeds = {}, {}
    for p, v, k in edges:
        values.setdefault(p, {})[v] = k
        if k is not None:
            seeds.setdefault((p, k), set()).add(v)
    able = [(p, k) for (p, k), s in seeds.items() if len(s) >= support and len(s) >= share * len(values[p])]
    score = {(p, k, v): float(values[p][v] == k) for p, k in able for v in values[p]}
    for turn in range(rounds):
        conf = {(p, k): sum(score[p, k, v] for v in values[p]) / len(values[p]) for p, k in able}
        for p, k, v in score if turn < rounds - 1 else ():
            if values[p][v] is None:
                miss = 1.0
                for q, j in able:
                    if j == k and q != p and v in values[q]:
                        miss *= max(1 - conf[q, j], 1e-12)
                score[p, k, v] = 1 - miss
    return conf


def test_graph_scores_equal_a_plain_version(spark):
    rng = random.Random(5)
    rows = []
    for p in range(12):
        for v in rng.sample(range(40), rng.randint(3, 20)):
            kind = ["email", "ip", None, None][v % 4]
            rows += [(p, f"v{v}", kind)] * rng.randint(1, 3)
    found = spark.createDataFrame([([f"p{p}"], v, k) for p, v, k in rows],
                                  "patterns array<string>, value string, kind string")
    for share in (0.0, 0.25, 0.4):
        got = {(r.pattern, r.kind): r.confidence
               for r in contextual.scored_patterns(found, rounds=4, support=2, share=share).collect()}
        want = plain_scores({(f"p{p}", v, k) for p, v, k in rows}, 4, 2, share)
        assert got.keys() == want.keys() and want
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_contexts_of_secrets_and_common_words(spark):
    """Hexadecimal seeds open their context to other secrets, alone they
    are no span; a context that mostly holds other words says nothing."""
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(38)) + "a1" for _ in range(8)]
    rows = [(i, f'Some words. token = "{h}" and more.') for i, h in enumerate(hexes)]
    rows += [(20, 'Some words. token = "sk-Live_88" and more.'), (21, f"lone {hexes[0]}x and {hexes[1]} here")]
    rows += [(30 + i, f"ask the u{i}@x.org of it") for i in range(4)]
    rows += [(40 + i, f"ask the w{i} of it, and the z{i} of that") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in contextual.extract(docs).select(
        "doc_id", contextual.span_text(F.col("spans")).alias("s")).collect()}
    assert all(got[i] == "secret:21:61" for i in range(8))
    assert got[20] == "secret:21:31" and got[21] == ""
    assert all(got[40 + i] == "" for i in range(30)) and got[30] == "email:8:16"


def test_base_spans_stay_and_sort(odd_docs):
    for r in contextual.extract(odd_docs).select("base", "spans").collect():
        assert set(map(str, r.base)) <= set(map(str, r.spans))
        assert [(s["rank"], s.start) for s in r.spans] == sorted((s["rank"], s.start) for s in r.spans)


def test_empty_table(no_docs):
    assert contextual.extract(no_docs).count() == 0


def test_digest_of_nothing(odd_docs):
    empty = hashlib.sha256(b"").hexdigest()
    got = contextual.extract(odd_docs.where("text IS NULL")).select(
        F.sha2(contextual.span_text(F.col("base")), 256).alias("h")).collect()
    assert {r.h for r in got} == {empty}


def test_other_texts_are_sieved_before_the_join(spark):
    """Few texts of those without a wanted key reach the join, none with one is lost."""
    from clickgap.llm import contextual as C
    df = spark.range(20_000).selectExpr("concat('k', id) AS row_key", "id")
    keys = spark.range(0, 20_000, 40).selectExpr("concat('k', id) AS row_key")
    left = {r["id"] for r in C._sieve(df, keys).collect()}
    assert left >= set(range(0, 20_000, 40)) and len(left) < 600
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (3, None)], "doc_id long, text string")
    want = docs.where("doc_id IS NULL OR doc_id <> 1").select(
        C.row_key(docs["doc_id"], docs["text"]).alias("row_key")).distinct()
    got = sorted((str(r["id"]), str(r["text"])) for r in C._keyed(docs, "doc_id", "text", want).collect())
    assert got == [("2", "b"), ("2", "b"), ("3", "None"), ("None", "c")]
