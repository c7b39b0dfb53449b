"""Linked tool calls: order, faults, validation and canonical JSON."""

from cellframe.llm import toolcalls

CALL = "conv_id long, call_id string, name string, arguments string, waits_for string, turn long, depth string"
RESULT = "conv_id long, call_id string, content string, turn long, status string"
GOOD = '{"question": "a\\nb", "limit": 3}'


def run(spark, calls, results):
    out = toolcalls.linked(spark.createDataFrame([(*c, "x") for c in calls], CALL), spark.createDataFrame([(*r, "y") for r in results], RESULT), toolcalls.tool_table(spark))
    return [tuple(r) for r in out.collect()]


def test_order_links_and_faults(spark):
    n = 300
    calls = [(1, f"k{i}", "answer", GOOD, f"k{i - 1}" if i else None, 1000 - i) for i in range(n)]
    calls += [(2, "a", "answer", GOOD, "b", 1), (2, "b", "answer", GOOD, "a", 2), (2, "c", "answer", GOOD, "a", 3), (2, "d", "answer", GOOD, "nowhere", 4), (2, "e", "answer", GOOD, "d", 5), (2, "self", "answer", GOOD, "self", 6)]
    calls += [(3, "x", "answer", GOOD, None, 1), (3, "x", "answer", GOOD, None, 1), (3, "x", "answer", GOOD, None, 2), (3, None, "answer", GOOD, None, 3), (None, "z", "answer", GOOD, None, 1)]
    results = [(1, f"k{i}", str(i), i) for i in range(n)] + [(3, "x", "late", 9), (3, "x", "early", 8), (3, "y", None, 8), (3, None, "q", 1), (9, "k1", "other", 1)]
    got = run(spark, calls, results)
    assert len(got) == len(calls) + len(results)
    by = {}
    for c, kind, i, turn, depth, status, _ in got:
        by.setdefault((c, kind, i), []).append((turn, depth, status))
    assert all(by[1, "call", f"k{i}"] == [(1000 - i, i, "ok")] and by[1, "result", f"k{i}"] == [(i, i, "ok")] for i in range(n))
    assert [by[2, "call", k][0][1:] for k in ("a", "b", "c", "d", "e", "self")] == [(None, "circular")] * 3 + [(None, "dangling")] * 2 + [(None, "circular")]
    assert sorted(by[3, "call", "x"], key=str) == sorted([(1, 0, "ok"), (1, None, "repeated"), (2, None, "repeated")], key=str)
    assert by[3, "call", None] == [(3, None, "unnamed")] and sorted(s for *_, s in by[3, "result", "x"]) == ["ok", "repeated"] and (8, 0, "ok") in by[3, "result", "x"]
    assert by[3, "result", "y"] == [(8, None, "orphan")] and by[3, "result", None] == [(1, None, "orphan")] and by[9, "result", "k1"] == [(1, None, "orphan")]


def test_validation_and_canonical_json(spark):
    cases = {
        "a": ('{"limit":1,"question":"q","strict":false}', "unanswered", '{"limit":1,"question":"q","strict":false}'),
        "b": ('{ "question" : "\\u00e9\\"", "limit" : 2 }', "unanswered", '{"limit":2,"question":"é\\""}'),
        "c": ('{"limit":1.5,"question":3}', "invalid: kind of limit, kind of question", '{"limit":1.5,"question":3}'),
        "d": ('{"zz":{"b":1,"a":[true,null]}}', "invalid: missing limit, missing question, unknown zz", '{"zz":{"a":[true,null],"b":1}}'),
        "e": ("[1]", "invalid: not an object", "[1]"),
        "f": ("{oops", "invalid: not an object", "null"),
        "g": (None, "invalid: not an object", "null"),
        "h": ("", "invalid: not an object", "null"),
        "i": ('{"limit":null,"question":"q"}', "invalid: kind of limit", '{"limit":null,"question":"q"}'),
    }
    got = {r[2]: r for r in run(spark, [(1, k, "answer", v[0], None, 1) for k, v in cases.items()], [])}
    for k, (_, status, canonical) in cases.items():
        assert got[k][5] == status, k
        assert got[k][6] == f'{{"arguments":{canonical},"id":"{k}","name":"answer","type":"tool_call","waits_for":null}}'
    assert run(spark, [(1, "k", None, GOOD, None, 1)], [])[0][5] == "invalid: unknown tool"


def test_empty(spark):
    assert run(spark, [], []) == []
    assert [r[5] for r in run(spark, [], [(1, "a", "b", 1)])] == ["orphan"]


def test_turns_of_any_other_role_have_a_row(spark):
    import duckdb

    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "tool", 'x "y"'), (1, 3, None, None), (2, 0, "function", "f"), (2, 1, "system", "s"), (None, 5, "User", "case")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls, results = toolcalls.from_conversations(turns)
    got = [tuple(r) for r in toolcalls.linked(calls, results, toolcalls.tool_table(spark)).unionByName(toolcalls.other_turns(turns)).collect()]
    assert len(got) == len(rows)
    assert sorted((r[0] or 0, r[3]) for r in got if r[5] == "unknown role") == [(0, 5), (1, 2), (1, 3), (2, 0)]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(got, key=str) == sorted(con.execute(toolcalls.ORACLE_SQL).fetchall(), key=str)
