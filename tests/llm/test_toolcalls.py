import json

from clickgap.llm import queries, toolcalls

MESSAGES = ("conv_id long, turn long, role string, text string, "
            "calls array<struct<id:string,name:string,arguments:string>>, result_of string, level int")
SCHEMAS = "tool string, field string, type string, required boolean"


def brute(messages, schemas):
    """(conv_id, call_id, call_turn, place, result_turn, status, level,
    errors, json) by the definition, row by row."""
    tools = {}
    for t, f, kind, need in schemas:
        tools.setdefault(t, {})[f] = (kind, need)
    calls, results = [], []
    for m in messages:
        for p, c in enumerate(m["calls"] or []):
            if c is not None:
                calls.append((m["conv_id"], m["turn"], p, *c))
        if m["role"] == "tool":
            results.append((m["conv_id"], m["turn"], m["result_of"], m["text"]))
    key = lambda t: tuple((x is not None, x) for x in t)       # noqa: E731
    first_c, first_r = {}, {}
    for c in calls:
        if c[0] is not None and c[3] is not None:
            first_c[c[0], c[3]] = min(first_c.get((c[0], c[3]), c), c, key=lambda c: key((c[1], c[2], c[4], c[5])))
    for r in results:
        if r[0] is not None and r[2] is not None:
            first_r[r[0], r[2]] = min(first_r.get((r[0], r[2]), r), r, key=lambda r: key((r[1], r[3])))

    def given(a):
        try:
            v = json.loads(a) if a is not None else None
        except ValueError:
            return None
        return v if isinstance(v, dict) else None

    def uses(c):
        return {v[1:] for v in (given(c[5]) or {}).values() if isinstance(v, str) and v.startswith("$") and len(v) > 1}

    levels = {}
    changed = True
    while changed:
        changed = False
        for k, c in first_c.items():
            known = [(k[0], u) for u in uses(c) if (k[0], u) in first_c]
            if k not in levels and all(u in levels for u in known):
                levels[k] = 1 + max((levels[u] for u in known), default=-1)
                changed = True
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}

    def fits(v, kind):
        return isinstance(v, kinds[kind]) and (kind == "boolean" or not isinstance(v, bool))

    def errors(c, mine):
        a, out = given(c[5]), []
        if a is None:
            out = ["not an object"]
        elif c[4] not in tools:
            out = ["unknown tool"]
        else:
            for f, (kind, need) in tools[c[4]].items():
                if f not in a:
                    out += [f"missing {f}"] if need else []
                elif not fits(a[f], kind):
                    out.append(f"type of {f}")
            out += [f"unknown {f}" for f in a if f not in tools[c[4]]]
        if mine and any((c[0], u) not in first_c for u in uses(c)):
            out.append("unknown use")
        if mine and (c[0], c[3]) not in levels:
            out.append("cycle")
        return sorted(out)

    def plain(v):
        """Whole numbers are written without a fraction."""
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() else v

    def text(c, r, status):
        a = plain(given(c[5])) if c else None
        return json.dumps({"arguments": a if a is not None else (c[5] if c else None), "id": c[3] if c else r[2],
                           "name": c[4] if c else None, "result": r[3] if r else None, "status": status},
                          sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    out = []
    seen = set()
    for c in calls:
        k = (c[0], c[3])
        mine = None not in k and first_c[k] == c
        r = first_r.get(k) if mine else None
        if None in k:
            status = "no id"
        elif not mine:
            status = "repeated call"
        else:
            status = "unanswered" if r is None else "early" if r[1] < c[1] else "linked"
            seen.add(k)
        out.append((c[0], c[3], c[1], c[2], r[1] if r else None, status, levels.get(k) if mine else None,
                    errors(c, mine), text(c, r, status)))
    for r in results:
        k = (r[0], r[2])
        mine = None not in k and first_r[k] == r
        if mine and k in seen:
            continue
        status = "no id" if None in k else "stray" if mine else "repeated result"
        out.append((r[0], r[2], None, None, r[1], status, None, [], text(None, r, status)))
    return out


def check(spark, messages, schemas=queries.TOOLS):
    got = toolcalls.link(messages, spark.createDataFrame(schemas, SCHEMAS)).collect()
    mine = [(r.conv_id, r.call_id, r.call_turn, r.place, r.result_turn, r.status, r.level, list(r.errors), r.json)
            for r in got]
    want = brute([r.asDict() for r in messages.collect()], schemas)
    assert sorted(map(str, mine)) == sorted(map(str, want))


def test_links_levels_errors_and_json(spark):
    call = lambda i, n, a: (i, n, a)        # noqa: E731
    rows = [
        (1, 1, "assistant", "x", [call("a", "search", '{"query":"q","limit":3}'),
                                  call("b", "lookup", '{"key":"$a","strict":"no"}'),
                                  call("c", "convert", '{"value":1.5,"unit":"$b"}')], None, 0),
        (1, 2, "tool", 'said "hi"\n', None, "a", 0), (1, 0, "tool", "too soon", None, "b", 0),
        (1, 3, "tool", "again", None, "a", 0), (1, 4, "tool", "nobody", None, "zz", 0),
        (2, 1, "assistant", None, [call("a", "nope", '{"b":{"z":1,"y":[1,{"k":2,"j":3}]},"a":null}')], None, 0),
        (2, 2, "assistant", None, [call("a", "search", "{}"), call(None, "search", "[1]"), None], None, 0),
        (3, 1, "assistant", "", [call("p", "search", '{"query":"$q"}'), call("q", "search", '{"query":"$p"}'),
                                 call("r", "search", '{"query":"$q"}'), call("s", "search", '{"query":"$none"}')], None, 0),
        (None, 1, "assistant", "", [call("p", "search", None)], None, 0), (4, 1, "tool", None, None, None, 0),
        (5, 1, "assistant", "", [call(f"k{i}", "search", '{"query":"$k%d"}' % (i - 1)) for i in range(6)], None, 0),
        (6, 1, "assistant", "", [call("a", "search", '{"limit":true,"query":5,"extra":"é"}'),
                                 call("b", "search", "{not json")], None, 0), (7, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, MESSAGES)
    check(spark, df)
    assert toolcalls.link(df.limit(0), spark.createDataFrame(queries.TOOLS, SCHEMAS)).count() == 0


def test_table(spark):
    check(spark, queries.tool_conversations(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")))


def test_whole_texts_reach_the_result(spark):
    """Texts that differ only behind their start, with quotes, newlines and
    escapes there; every assistant text is whole in its call."""
    rows = []
    for n in range(60, 66):
        for i, tail in enumerate(['"q"', "\\\\n", "a\nb", "\té/", "{1:", "\U0001f600$x"]):
            rows.append((10 * n + i, 1, "assistant", ("same start of all " * 5)[:n] + tail))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = queries.tool_conversations(df)
    check(spark, messages)
    out = toolcalls.link(messages, spark.createDataFrame(queries.TOOLS, SCHEMAS)).where("call_id = 'c1'").collect()
    got = {r.conv_id: list(json.loads(r.json)["arguments"].values()) for r in out}
    assert all(t in got[c] for c, _, _, t in rows)
