"""Real calls: schema faults, references of all directions, cycles, against a walk in Python."""

import random

from tidemark.llm.chat import Parameter, link_tool_calls

SCHEMAS = {"get": (Parameter("n", "integer", least=0, most=9), Parameter("unit", "string", False, allowed=("c", "f"))), "ping": ()}
EVENTS = "conv_id string, turn int, kind string, call_id string, name string, arguments string, after string, role string, content string, status string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], EVENTS)
    return link_tool_calls(df, SCHEMAS).collect()


def call(conv, turn, id, after=None, name="ping", arguments="{}"):
    return (conv, turn, "call", id, name, arguments, after, None, None)


def result(conv, turn, id):
    return (conv, turn, "result", id, None, None, None, None, f"of {id}")


def test_schema_faults_and_canonical_numbers(spark):
    given = [
        ('{"n": 1.0, "a": "1.0,", "b": [1e0, -2.50, {"z": 1, "y": null}]}', "", '{"a":"1.0,","b":[1,-2.5,{"y":null,"z":1}],"n":1}'),
        ('{"n": 10, "unit": "k"}', "allowed:unit,most:n", '{"n":10,"unit":"k"}'),
        ('{"unit": 3}', "missing:n,type:unit", '{"unit":3}'),
        ("[1.0]", "not_an_object", "[1]"),
        ("no json", "not_an_object", '"no json"'),
        (None, "not_an_object", "null"),
    ]
    out = run(spark, [call("a", k, f"i{k}", name="get", arguments=g[0]) for k, g in enumerate(given)])
    for r in out:
        _, errors, arguments = given[r.turn]
        assert (r.errors, r.status) == (errors, "no_result")
        assert r.json == f'{{"arguments":{arguments},"id":"i{r.turn}","name":"get","type":"tool_call"}}'
    unknown = run(spark, [call("a", 1, "x", name="other"), call("a", 1, "x", name=None), (None, None, "call", None, None, None, None, None, None)])
    assert sorted(r.errors for r in unknown) == ["not_an_object", "unknown_tool", "unknown_tool"]


def expected(rows):
    """Places by walking every reference; cycles are what a walk comes back to."""
    first = {}
    for r in sorted((r for r in rows if r[2] == "call"), key=lambda r: r[1]):
        first.setdefault((r[0], r[3]), r)
    last = {}
    for r in rows:
        if r[2] == "result":
            last[r[0], r[3]] = max(r[1], last.get((r[0], r[3]), -1))

    def on_cycle(key):
        at = key
        for _ in range(len(first) + 1):
            at = (at[0], first[at][6]) if at in first else None
            if at is None or at == key:
                return at == key
        return False

    def call_at(key):
        own, ref = (first[key][1], 0), (key[0], first[key][6])
        return own if on_cycle(key) or result_at(ref) is None else max(own, up(result_at(ref)))

    def result_at(key):
        if key not in last:
            return None
        return max((last[key], 0), up(call_at(key))) if key in first else (last[key], 0)

    def up(place):
        return (place[0], place[1] + 1)

    out = {}
    for r in rows:
        key = (r[0], r[3])
        place = (r[1], 0)
        if r[2] == "call":
            place = call_at(key)
        elif key in first:
            place = max(place, up(call_at(key)))
        out[r[0], r[1], r[2], r[3]] = (*place, "cycle" if r[2] == "call" and on_cycle(key) else "")
    return out


def test_references_of_all_directions_and_cycles(spark):
    rng = random.Random(7)
    rows = [call("self", 1, "x", "x"), result("self", 2, "x"), call("fwd", 1, "a", "b"), result("fwd", 2, "a"), call("fwd", 5, "b"), result("fwd", 6, "b")]
    rows += [call("ring", 1, "a", "c"), call("ring", 2, "b", "a"), call("ring", 3, "c", "b"), call("ring", 4, "d", "a")]
    rows += [result("ring", t, i) for t, i in ((5, "a"), (6, "b"), (1, "c"), (2, "d"))]
    for conv in range(30):  # "hot" has a third of all rows
        name, n = ("hot", 120) if conv == 0 else (f"c{conv}", 8)
        for t in range(n):
            after = rng.choice([None, f"k{rng.randrange(n)}", f"k{max(0, t - 1)}", f"k{t + 1}"])
            rows.append(call(name, 2 * t, f"k{t}", after))
            if rng.random() < 0.8:
                rows.append(result(name, rng.randrange(2 * n), f"k{t}"))
    out = run(spark, rows)
    want = expected(rows)
    assert len(out) == len(rows)
    assert {(r.conv_id, r.turn, r.kind, r.call_id): (r.order_turn, r.order_level, r.errors) for r in out} == want
    assert want["fwd", 1, "call", "a"] == (6, 1, "") and want["ring", 1, "call", "a"][2] == "cycle" and want["ring", 4, "call", "d"][2] == ""


def test_duplicates_orphans_and_an_empty_table(spark):
    rows = [call("a", 1, "x"), call("a", 9, "x", "y"), call("a", 5, "y", "x"), result("a", 10, "x"), result("a", 10, "x"), result("a", 6, "y"), result("a", 0, "z")]
    got = sorted((r.kind, r.call_id, r.turn, r.status, r.order_turn, r.order_level) for r in run(spark, rows))
    assert got == [
        ("call", "x", 1, "duplicate", 1, 0), ("call", "x", 9, "duplicate", 10, 3), ("call", "y", 5, "linked", 10, 1),
        ("result", "x", 10, "linked", 10, 0), ("result", "x", 10, "linked", 10, 0), ("result", "y", 6, "linked", 10, 2), ("result", "z", 0, "orphan", 0, 0),
    ]
    assert run(spark, []) == []
