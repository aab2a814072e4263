import json

from sparkwell.llm import chat

SCHEMA = "conv_id long, turn long, role string, content string, call_id string, name string, arguments string, depends_on array<string>, result_of string, level int"
TOOLS = [("add", [("a", "integer", True), ("b", "number", False)]), ("say", [("text", "string", True), ("opt", "object", False)])]


def linked(spark, rows):
    msgs = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA)
    return chat.link(msgs, spark.createDataFrame(TOOLS, chat.SCHEMA)).collect()


def call(turn, i, name="add", args='{"b":1.5,"a":1}', deps=(), conv=1):
    return (conv, turn, "assistant", None, i, name, args, list(deps), None)


def result(turn, of, conv=1, text="ok"):
    return (conv, turn, "tool", text, None, None, None, None, of)


def test_links_levels_and_json(spark):
    rows = [call(1, "x"), call(2, "y", deps=["x"]), call(3, "z", deps=["y", "nowhere"]), result(4, "x"), result(5, "z"), result(6, "none"), result(0, "y"), (1, 7, "user", 'q"\n', None, None, None, None, None), call(9, "x")]
    got = {(r.turn, r.call_id): r for r in linked(spark, rows)}
    assert len(got) == len(rows)
    assert [got[k].level for k in ((1, "x"), (2, "y"), (3, "z"), (4, "x"), (5, "z"))] == [0, 2, 4, 1, 5]
    assert got[4, "x"].linked and not got[6, "none"].linked and not got[0, "y"].linked and not got[9, "x"].linked
    assert got[1, "x"].json == '{"arguments":{"a":1,"b":1.5},"id":"x","kind":"call","name":"add","role":"assistant","turn":1}'
    assert json.loads(got[7, None].json) == {"content": 'q"\n', "kind": "message", "role": "user", "turn": 7}


def test_cycles_and_conversations_apart(spark):
    got = {(r.conv_id, r.call_id): r for r in linked(spark, [call(1, "p", deps=["q"]), call(2, "q", deps=["p"]), call(1, "p", conv=2), result(2, "p", conv=3)])}
    assert got[1, "p"].level is None and got[1, "q"].level is None and got[2, "p"].level == 0 and not got[3, "p"].linked


def test_validation(spark):
    cases = [('{"a":1}', None), ('{"a":"1"}', "type of a"), ("{}", "missing a"), ('{"a":1,"c":2}', "undeclared c"), ("[1]", "arguments are no object"), ("{bad", "arguments are no object"), (None, "arguments are no object"), ('{"a":1,"b":2}', None), ('{"a":1.5}', "type of a")]
    got = {r.turn: r.problem for r in linked(spark, [call(i, f"c{i}", args=a) for i, (a, _) in enumerate(cases)] + [call(99, "u", name="nope"), call(98, "s", "say", '{"text":"t","opt":{"k":[1]}}')])}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases] and got[99] == "unknown tool" and got[98] is None


def test_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 3, "assistant", "b"), (None, 0, "user", "n"), (2, None, "user", "x"), (1, 0, "user", None), (3, 0, None, "r")], "conv_id long, turn long, role string, text string")
    out = chat.link(chat.from_turns(df), spark.createDataFrame([("reply", [("text", "string", True)])], chat.SCHEMA))
    assert out.count() == 7
    assert chat.link(chat.from_turns(df.limit(0)), spark.createDataFrame([("reply", [])], chat.SCHEMA)).count() == 0


def test_chains_of_any_length_and_their_branches(spark):
    n = 1_500
    rows = [(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(n)]
    rows += [(1, "join", ["c7", f"c{n - 1}", "c3"]), (1, "after", ["join"]), (1, "x", ["y"]), (1, "y", ["z"]), (1, "z", ["x"]), (1, "behind", ["x", "c1"])]
    rows += [(2, "c1", ["c0"]), (2, "c0", [])]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in chat.levels(calls).collect()}
    assert len(got) == len(rows) and all(got[1, f"c{i}"] == 2 * i for i in range(n))
    assert got[1, "join"] == 2 * n and got[1, "after"] == 2 * n + 2 and got[2, "c1"] == 2
    assert all(got[1, c] is None for c in ("x", "y", "z", "behind"))


def test_levels_of_random_graphs(spark):
    import random

    rng = random.Random(6)
    rows = []
    for conv in range(12):
        rows += [(conv, str(i), [str(rng.randrange(i)) for _ in range(rng.choice([0, 1, 1, 2]))] if i else []) for i in range(40)]
    got = {(r.conv_id, r.call_id): r.level for r in chat.levels(spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")).collect()}
    want: dict = {}
    for conv, i, deps in rows:
        want[conv, i] = max((want[conv, d] + 2 for d in deps), default=0)
    assert got == want


def test_levels_by_blocks_of_turns(spark, monkeypatch):
    import random

    monkeypatch.setattr(chat, "BLOCK", 8)
    monkeypatch.setattr(chat, "WIDER", 4)
    monkeypatch.setattr(chat, "BLOCK_EDGES", 24)
    monkeypatch.setattr(chat, "TERMS", 3)
    rng = random.Random(7)
    rows = [(0, i, str(i), [str(i - 2), str(i - 4)]) for i in range(300)]
    for conv in range(1, 9):  # near and far, later turns, several calls a turn, no turn
        for i in range(60):
            deps = [str(d) for d in (i - 1 - rng.randrange(5), i - 1 - rng.randrange(5), rng.randrange(i + 1) - 1) if d >= 0 and rng.random() < 0.7]
            turn = {1: i, 2: 59 - i, 3: i // 4, 4: i * 1_000_003, 5: 0, 6: None if i % 7 == 0 else i}.get(conv, rng.randrange(60))
            rows.append((conv, turn, str(i), deps))
    rows += [(9, i, str(i), [str((i + 1) % 30)] if i < 30 else [str(i - 1)]) for i in range(60)] + [(None, 1, "0", ["1"]), (None, 2, "1", [])]
    got = {(r.conv_id, r.call_id): r.level for r in chat.levels(spark.createDataFrame(rows, "conv_id long, turn long, call_id string, depends_on array<string>")).collect()}
    want: dict = {}
    for conv, _, i, deps in rows:
        want[conv, i] = None if conv in (9, None) else max((want[conv, d] + 2 for d in deps if (conv, d) in want), default=0)
    assert got == want


def test_turns_call_several_tools_in_levels(spark):
    turns = [(1, 0, "user", "a b"), (1, 1, "assistant", "r"), (1, 2, "user", "two\nlines"), (1, 4, "user", "w " * 70), (1, 6, "user", "w " * 70 + "\n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    tools = spark.createDataFrame([(n, list(p)) for n, p in chat.TOOLS], chat.SCHEMA)
    got = {r.turn: r for r in chat.link(chat.from_turns(df), tools).collect()}
    assert [got[t].level for t in (0, 1, 2, 4, 6)] == [0, 1, 2, 4, 6]
    assert [got[t].problem for t in (0, 2, 4, 6)] == [None, None, "undeclared long", None]
