"""Personal data: rule-based spans, and more of them by bootstrapped
contextual extraction, in DataFrame functions only.

``base_spans`` finds the four fixed kinds by expression and check.

Bootstrapping: the words around a mention are lexical patterns (the two
words before it; the word before with the word after). Base values are
seeds with score 1 for their kind; long hexadecimal strings are seeds of a
kind "secret", which no expression reports by itself: only those (and other
words) in an accepted pattern become spans, after the kinds of the base.
A pattern enters if it has SUPPORT distinct seeds of a kind and they are
SHARE of the distinct values in its slot: identifier-like mentions (numbers,
tokens with a digit) and whichever other word fills it, of any characters
and length, the unseen instances. Brackets and quotes that open a word and
punctuation that ends it count as the words around; a word that opens with
a bracket is also read whole. Rounds then score the pattern-instance graph:

  pattern confidence = mean score of its distinct instances,
  instance score     = 1 - product of (1 - confidence) over its other
                       patterns, of those that entered,

and after ROUNDS rounds (a parameter of the result), occurrences of unseen
instances in a pattern of confidence >= LEAST become spans of that kind. A pattern must therefore
hold mostly known identifiers before it says anything about others.

Scale: a pattern's values are first counted in the documents that hold its
seeds, then with one in PROBE of the others. All its seeds are there, so a
share too small there is too small in the whole corpus: patterns of common
words go early, and the pass over all texts, which decides, meets few. It
cuts only texts into words that hold the word in front of a slot. Patterns
that entered have at most 1 / SHARE values a seed, so the graph grows with
the seeds; joins are plain equi-joins that split when skewed.

Defined cases: null text is empty and has no spans; overlapping kinds all
count; rows repeated with the same id and text each get the same result;
a null id keeps its row; no seeds means no added spans; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_key, stage

# The base kinds (fixed by the contract, in order). Written with possessive
# repeats and, for runs, a check that a match starts where the run or the
# last match does: same matches, no backtracking over long runs.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?+[0-9]){15,}+"     # shorter runs never pass the check
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
_PATTERN = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: numbers of six digits or more, as mentions
LONG_NUMBER = r"[0-9](?:[\x20-]?+[0-9]){5,}+(?![A-Za-z0-9])"
#: other identifier-like tokens: 6 to 64 characters with a digit
TOKEN = (r"(?<![A-Za-z0-9])(?=[A-Za-z_-]{0,63}[0-9])[A-Za-z0-9][A-Za-z0-9._/-]{4,62}"
         r"[A-Za-z0-9](?![A-Za-z0-9])")

#: seeds of secrets: hexadecimal strings of one case with letters and digits
SECRET = (r"(?<![A-Za-z0-9])(?=[0-9]{0,128}[A-Fa-f])(?=[A-Fa-f]{0,128}[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})"
          r"(?![A-Za-z0-9])")
SEEDS = (*KINDS, "secret")
#: where a mention may start, and what its first letters must lead to: true of
#: every mention, and soon false of plain words
_MAY_START = r"(?:(?<![A-Za-z0-9])|(?=[+0-9])|\G)(?=[A-Za-z_-]{0,64}+[A-Za-z0-9@._%+/-])"

ROUNDS = 3
SUPPORT = 3         # distinct seeds that a pattern must hold
PROBE = 32          # one document in so many is read for hopeless patterns first; no result depends on it
SHARE = 0.25        # of a pattern's distinct values must be seeds
LEAST = 0.8         # confidence that accepts a pattern
SHIFT = 4
BLOCK = 1 << SHIFT  # matches, and blocks, whose sizes are summed together
SIEVE = 1 << 22     # bits that row keys are sieved by
CELL = 64           # characters of a cell in which spans are compared
OPENS = "<([{\"'"
STOPS = ",.;:!?"     # these end a word, and closing brackets if one opens it
CLOSES = ">)]}\"'"


def located(df: DataFrame, wanted: dict) -> DataFrame:
    """``df`` with a column per item of ``wanted`` (name: text, pattern and
    condition): the leftmost non-overlapping matches as an array of (start,
    end, value) in code points, end exclusive.

    Start places are sums over the sizes of the matches before: over blocks
    of blocks, blocks, and inside a block, so a text costs its length (an
    accumulated array would be copied at every step). Every step is a column
    of its own projection, as each is read many times by the next; whatever
    explodes the result must be an outer explode, as an inner one pushes a
    size filter down with the whole expression in it."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    parts = ("found", "between", "size", "block", "upper", "lower")
    names = {k: dict(zip(parts, fresh(df, *[f"{p}_{k}" for p in parts]))) for k in wanted}

    def add(df, part, one):
        old = [F.col(f"`{c}`") for c in df.columns]
        return df.select(*old, *[one({p: F.col(f"`{n}`") for p, n in names[k].items()}, *wanted[k])
                                 .alias(names[k][part]) for k in wanted])

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def total(values, first, last):
        return F.aggregate(F.sequence(first, last), F.lit(0), lambda acc, i: acc + F.get(values, i))

    def sums(values):
        """Sums over runs of BLOCK values."""
        return F.transform(upto(F.shiftright(F.size(values) + BLOCK - 1, SHIFT)), lambda k: total(
            values, k * BLOCK, F.least((k + 1) * BLOCK, F.size(values)) - 1))

    def before(values, i):
        """The sum of the values before ``i`` in its run."""
        return total(values, F.shiftleft(F.shiftright(i, SHIFT), SHIFT), i) - F.get(values, i)
    def held(value, *cols):
        # read again outside the lambda: a column read once is inlined into
        # it, and would be worked out anew for every element
        return F.when(F.least(F.lit(0), *[F.size(c) for c in cols]) == 0, value)
    nothing = F.array().cast("array<string>")
    df = add(df, "found", lambda c, t, p, may: F.when(may, F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(nothing))
    df = add(df, "between", lambda c, t, p, may: F.when(F.size(c["found"]) > 0, F.split(t, p, -1)).otherwise(nothing))
    df = add(df, "size", lambda c, *_: held(F.transform(
        c["found"], lambda v, i: F.length(v) + F.length(F.get(c["between"], i))), c["between"]))
    df = add(df, "block", lambda c, *_: held(sums(c["size"]), c["size"]))
    df = add(df, "upper", lambda c, *_: F.aggregate(
        sums(c["block"]), F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))))
    df = add(df, "lower", lambda c, *_: held(F.transform(
        c["block"], lambda _v, b: F.get(c["upper"], F.shiftright(b, SHIFT)) + before(c["block"], b)), c["upper"]))

    def spans(c):
        ends = F.transform(c["size"], lambda v, i: F.get(c["lower"], F.shiftright(i, SHIFT)) + before(c["size"], i) + v)
        return held(F.zip_with(c["found"], ends, lambda v, e: F.struct(
            (e - F.length(v)).alias("start"), e.alias("end"), v.alias("value"))), c["lower"])
    return df.select(*kept, *[spans({p: F.col(f"`{n}`") for p, n in names[k].items()}).alias(k) for k in wanted],
                     *[F.col(f"`{names[k]['between']}`").alias(f"{k}_between") for k in wanted])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check sum over a string of digits, doubled from the right."""
    ds = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    """Whether a match of the kind's pattern passes its check."""
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(_digits(v)).between(16, 19), luhn(_digits(v))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(v)).between(8, 15)
    return F.lit(True)


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a column per kind: its checked spans. ``text`` names a
    column without nulls."""
    t = F.col(text)
    kept = [F.col(f"`{c}`") for c in df.columns]
    df = located(df, {kind: (t, _PATTERN[kind], t.rlike("[0-9]") if _NEEDS[kind] is None else t.contains(_NEEDS[kind]))
                      for kind in KINDS})

    def checked(kind):
        return F.filter(kind, lambda m: valid(kind, m["value"])).alias(kind)
    return df.select(*kept, *[checked(kind) for kind in KINDS])


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per identifier-like mention: ``row_key``, ``start``, ``end``,
    ``value``, ``kind`` (null unless it passes as a seed of one) and
    ``patterns`` (the contexts it stands in)."""
    any_of = f"{_MAY_START}(?:{'|'.join([EMAIL, IP, PHONE, SECRET, LONG_NUMBER, TOKEN])})"
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row_key"), text.alias("text")) \
        .where(F.col("text").rlike("[0-9]|@"))
    df = located(df, {"found": (F.col("text"), any_of, F.lit(True))}).select(
        "row_key", F.posexplode_outer("found").alias("i", "m"), F.col("found_between").alias("between")) \
        .where("m IS NOT NULL")
    df = df.select("row_key", "m", F.expr("reverse(try_element_at(between, i + 1))").alias("left"),
                   F.expr("try_element_at(between, i + 2)").alias("right"))
    # anchored, on the reversed text: long gaps and words cost their length
    df = df.select("row_key", "m.start", "m.end", "m.value",
                   F.lower(F.reverse(F.regexp_extract("left", r"^\s*+\S++\s++(\S++)", 1))).alias("l2"),
                   F.lower(F.reverse(F.regexp_extract("left", r"^\s*+(\S++)", 1))).alias("l1"),
                   F.lower(F.regexp_extract("right", r"^\s*+(\S++)", 1)).alias("r1"))
    kind = F.when(F.col("value").rlike(f"^{SECRET}$"), F.lit("secret"))
    for k in reversed(KINDS):
        kind = F.when(F.col("value").rlike(f"^(?:{_PATTERN[k]})$") & valid(k, F.col("value")), F.lit(k)).otherwise(kind)
    return df.select("row_key", "start", "end", "value", kind.alias("kind"), _patterns().alias("patterns"))


def _patterns() -> Column:
    """The patterns of the words l2, l1 and r1 around a slot."""
    return F.filter(F.array(
        F.when((F.col("l2") != "") & (F.col("l1") != ""), F.concat(F.lit("before: "), "l2", F.lit(" "), "l1")),
        F.when((F.col("l1") != "") & (F.col("r1") != ""), F.concat(F.lit("around: "), "l1", F.lit(" _ "), "r1"))),
        lambda p: p.isNotNull())


def _edges(found: DataFrame) -> DataFrame:
    """The distinct (pattern, value, kind)."""
    return found.select(F.explode("patterns").alias("pattern"), "value", "kind").distinct()


def seeded(edges: DataFrame, support: int, share: float = 0.0) -> DataFrame:
    """(pattern, for_kind) of the patterns with ``support`` distinct seeds
    that are ``share`` of their distinct values."""
    per = edges.groupBy("pattern", "kind").agg(F.count("*").alias("n"))
    able = per.where(f"kind IS NOT NULL AND n >= {support}").select("pattern", F.col("kind").alias("for_kind"), "n")
    if share:
        able = able.join(per.groupBy("pattern").agg(F.sum("n").alias("all")), "pattern").where(f"n >= {share} * all")
    return able.select("pattern", "for_kind")


def _slot_words(able: DataFrame) -> DataFrame:
    """The words in front of the slots of the patterns."""
    part = F.split("pattern", " ")
    return able.select(F.when(F.col("pattern").startswith("before: "), F.get(part, F.lit(2))).otherwise(
        F.get(part, F.lit(1))).alias("l1")).distinct()


def _holding(docs: DataFrame, id_col: str, text_col: str, able: DataFrame) -> DataFrame:
    """``docs`` that hold a word in front of a slot of the patterns; an
    opening bracket or quote may be one."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    words = F.array_union(F.split(text, r"\s++"), F.regexp_extract_all(
        text, F.lit(r"(?<!\S)[" + re.escape(OPENS) + "]++"), F.lit(0)))
    some = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.explode_outer(words).alias("l1")) \
        .join(_slot_words(able), "l1", "left_semi").select("row_key").distinct()
    return _keyed(docs, id_col, text_col, some)


def _sieve(df: DataFrame, keys: DataFrame) -> DataFrame:
    """``df`` without most of the rows whose row_key is not in ``keys``: the
    keys' hashes as SIEVE bits in words of 64, at most SIEVE / 64 rows to
    broadcast however many keys. What it leaves is still to be joined."""
    def place(c):
        return F.pmod(F.xxhash64(F.lit(5), c), F.lit(SIEVE))
    bits = keys.select(place(F.col("row_key")).alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(
        F.expr("bit_or(shiftleft(1L, int(_at & 63)))").alias("_bits"))
    return df.withColumn("_at", place(F.col("row_key"))).withColumn("_word", F.shiftright("_at", 6)) \
        .join(F.broadcast(bits), "_word").where(F.expr("shiftrightunsigned(_bits, int(_at & 63)) & 1 = 1")) \
        .select(*df.columns)


def _keyed(docs: DataFrame, id_col: str, text_col: str, keys: DataFrame) -> DataFrame:
    """(id, text) of the ``docs`` whose key is in ``keys`` (row_key); the
    other texts are sieved out before the join, which may shuffle."""
    keys = stage(keys)
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                     row_key(F.col(id_col), F.col(text_col)).alias("row_key"))
    return _sieve(df, keys).join(keys, "row_key", "left_semi").select("id", "text")


def slots(docs: DataFrame, id_col: str, text_col: str, able: DataFrame) -> DataFrame:
    """Words that fill a slot of the patterns ``able``, in the columns of
    ``mentions`` with a null kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row_key"), text.alias("text"))
    df = located(df, {"w": (F.col("text"), r"\S++", F.lit(True))}).select("row_key", "w")
    w = F.col("w")
    df = df.select("row_key", F.explode_outer(F.transform(w, lambda x, i: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"),
        F.get(w, i - 2)["value"].alias("l2"), F.get(w, i - 1)["value"].alias("l1"),
        F.get(w, i + 1)["value"].alias("r1")))).alias("x")).where("x IS NOT NULL").select("row_key", "x.*")

    def trimmed(v, side, chars):
        fn = F.ltrim if side == "left" else F.rtrim
        return fn(v, F.lit(chars))
    df = df.withColumn("rest", trimmed(F.col("value"), "left", OPENS))
    df = df.withColumn("core", F.when(F.col("rest") == F.col("value"), trimmed(F.col("rest"), "right", STOPS))
                       .otherwise(trimmed(F.col("rest"), "right", STOPS + CLOSES)))
    n_pre = F.length("value") - F.length("rest")
    pre, post = F.expr("substring(value, 1, length(value) - length(rest))"), F.expr("substring(rest, length(core) + 1)")
    names = ("start", "end", "value", "l2", "l1", "r1")

    def reading(*cols):
        return F.struct(*[c.alias(n) for c, n in zip(cols, names)])
    whole = reading(*[F.col(n) for n in names])
    opened = F.col("rest") != F.col("value")
    core = reading(F.col("start") + n_pre, F.col("start") + n_pre + F.length("core"), F.col("core"),
                   F.when(opened, F.col("l1")).otherwise(F.col("l2")), F.when(opened, pre).otherwise(F.col("l1")),
                   F.when(post != "", post).otherwise(F.col("r1")))
    df = df.select("row_key", F.explode_outer(F.when(F.col("core") == "", F.array(whole)).when(opened, F.array(core, whole))
                                        .otherwise(F.array(core))).alias("x")).select("row_key", "x.*")
    df = df.select("row_key", "start", "end", "value", *[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in names[3:]])
    # the word before the slot first: few words pass it
    df = df.join(_slot_words(able), "l1", "left_semi") \
        .select("row_key", "start", "end", "value", F.explode(_patterns()).alias("pattern"))
    return df.join(able.select("pattern").distinct(), "pattern", "left_semi") \
        .select("row_key", "start", "end", "value", F.lit(None).cast("string").alias("kind"),
                F.array("pattern").alias("patterns"))


def _filled(docs: DataFrame, id_col: str, text_col: str, able: DataFrame, found: DataFrame) -> DataFrame:
    """The ``slots`` that are instances: a word that holds a seed, or is a
    part of a longer mention of ``found``, is none of its own."""
    filled = stage(slots(docs, id_col, text_col, able))
    cell = F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL)))
    a = filled.select("row_key", "start", "end", cell.alias("cell")).distinct().alias("a")
    b = found.select("row_key", "start", "end", "kind", cell.alias("cell")).alias("b")
    taken = a.join(b, F.expr("a.row_key = b.row_key AND a.cell = b.cell AND a.start < b.end AND b.start < a.end AND "
                             "(b.kind IS NOT NULL OR b.start < a.start OR b.end > a.end)"), "left_semi") \
        .select("row_key", "start", "end").distinct()
    return filled.join(taken, ["row_key", "start", "end"], "left_anti")


def instances(docs: DataFrame, id_col: str, text_col: str, support: int, share: float) -> DataFrame:
    """``mentions`` and the words that fill slots of patterns with
    ``support`` seeds which can be ``share`` of their values."""
    found = stage(mentions(docs, id_col, text_col))
    able = stage(seeded(_edges(found), support))
    # first in the documents of the seeds: shares there bound those of all
    placed_seeds = found.where("kind IS NOT NULL").select("row_key", "kind", F.explode("patterns").alias("pattern"))
    homes = placed_seeds.join(able.withColumnRenamed("for_kind", "kind"), ["pattern", "kind"], "left_semi") \
        .select("row_key").distinct()
    met = stage(_filled(_keyed(docs, id_col, text_col, homes), "id", "text", able, found))
    able = _possible(found, met, able, support, share)
    key = row_key(F.col(id_col), F.col(text_col))
    some = docs.where(F.pmod(F.xxhash64(F.lit(11), key), F.lit(PROBE)) == 0)
    met = met.unionByName(stage(_filled(_holding(some, id_col, text_col, able), "id", "text", able, found)))
    able = _possible(found, met, able, support, share)
    return stage(found.unionByName(_filled(_holding(docs, id_col, text_col, able), "id", "text", able, found)))


def _possible(found: DataFrame, met: DataFrame, able: DataFrame, support: int, share: float) -> DataFrame:
    """The patterns ``able`` that keep their share among the values ``met``."""
    mine = _edges(found.unionByName(met)).join(able.select("pattern").distinct(), "pattern", "left_semi")
    return stage(seeded(mine, support, share))


def scored_patterns(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """(pattern, kind, confidence) after scoring the graph of the distinct
    (pattern, value) pairs of ``found``."""
    edges = _edges(found)
    able = stage(seeded(edges, support, share))
    # edges of patterns that can say something, once for each kind they may mean
    edges = stage(edges.join(able, "pattern"))
    score = F.when(F.col("kind") == F.col("for_kind"), 1.0).otherwise(0.0)
    scores = edges.withColumn("score", score)
    out = None
    for turn in range(rounds):
        out = stage(scores.groupBy("pattern", "for_kind").agg(F.avg("score").alias("confidence")))
        if turn == rounds - 1:
            break
        rated = edges.join(out, ["pattern", "for_kind"]).withColumn(
            "doubt", F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12))))
        doubts = rated.where("kind IS NULL").groupBy("value", "for_kind").agg(F.sum("doubt").alias("all"))
        # an unseen value counts by what its other contexts say, a pattern
        # does not confirm itself
        scores = stage(rated.join(doubts, ["value", "for_kind"], "left").withColumn(
            "score", F.when(F.col("kind").isNull(), 1 - F.exp(F.least(F.col("all") - F.col("doubt"), F.lit(0.0))))
            .otherwise(score)).select("pattern", "value", "kind", "for_kind", "score"))
    return out.select("pattern", F.col("for_kind").alias("kind"), "confidence")


def discovered(docs: DataFrame, id_col: str, text_col: str, rounds: int = ROUNDS,
               support: int = SUPPORT, least: float = LEAST, share: float = SHARE) -> DataFrame:
    """(row_key, kind, start, end) of the spans that contexts add."""
    found = instances(docs, id_col, text_col, support, share)
    good = stage(scored_patterns(found, rounds, support, share).where(F.col("confidence") >= least))
    unseen = found.where("kind IS NULL OR kind = 'secret'").select(
        "row_key", "start", "end", F.col("kind").alias("seed"), F.explode("patterns").alias("pattern"))
    return unseen.join(good, "pattern").where("seed IS NULL OR seed = kind").groupBy("row_key", "start", "end") \
        .agg(F.max(F.struct("confidence", "kind"))["kind"].alias("kind")) \
        .groupBy("row_key", "start", "kind").agg(F.max("end").alias("end"))     # the longest reading at a place


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
            support: int = SUPPORT, least: float = LEAST, share: float = SHARE) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``base`` and ``spans`` - arrays of
    (rank of the kind, start, end, kind, value; null value if added) - by
    kind as listed, then start."""
    whole = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"),
                       whole.alias("text"))
    base = base_spans(base, "text")
    parts = [F.transform(F.col(k), lambda s: F.struct(
        F.lit(i).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind"),
        s["value"].alias("value"))) for i, k in enumerate(KINDS)]
    base = base.select("id", "row_key", F.concat(*parts).alias("base"))
    rank = F.array_position(F.array(*[F.lit(k) for k in SEEDS]), F.col("kind")).cast("int") - 1
    more = discovered(docs, id_col, text_col, rounds, support, least, share).groupBy("row_key").agg(F.collect_set(F.struct(
        rank.alias("rank"), "start", "end", "kind", F.lit(None).cast("string").alias("value"))).alias("more"))
    out = base.join(more, "row_key", "left")
    return out.select(F.col("id").alias(id_col), "row_key", "base", F.when(F.col("more").isNull(), F.col("base"))
                      .otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
