"""Tool calls: odd arguments, several predecessors, large conversations, odd tables."""

import json
import random

import pytest

from millrace.llm import toolcalls

CALLS = "conv_id long, turn int, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, turn int, call_id string, content string"
ANY = {"f": {}}


def plain_depths(links):
    """By relaxation, a call at a time; links: call -> set of calls it waits for, all of which exist."""
    depth = {c: 0 for c, ups in links.items() if not ups}
    for _ in links:
        for c, ups in links.items():
            if ups and all(u in depth for u in ups):
                depth[c] = 1 + max(depth[u] for u in ups)
    return {c: depth.get(c) for c in links}


def graphs():
    rng = random.Random(7)
    out = {1: {f"c{k}": {f"c{k - 1}"} if k else set() for k in range(40)}}  # a chain
    out[2] = {f"c{k}": {f"c{j}" for j in rng.sample(range(k), min(k, rng.choice([0, 1, 1, 2, 3])))} for k in range(60)}
    out[3] = {"a": {"b"}, "b": {"a"}, "d": {"a", "e"}, "e": set(), "g": {"e"}, "h": {"d"}, "i": {"h", "g"}, "self": {"self"}}
    out[4] = {f"c{k}": {f"c{k - 1}", f"c{k - 2}"} - {"c-1", "c-2"} for k in range(8)}  # each waits for two
    out[5] = {"lone": set()}
    out[6] = {f"c{k}": {f"c{(k + 1) % 5}"} for k in range(5)} | {"tail": {"c0"}, "end": {"tail", "free"}, "free": set()}
    return out


@pytest.mark.parametrize("small", [10**6, 30, 0])
def test_depths_are_longest_ways(spark, small):
    rows, want = [], {}
    for conv, links in graphs().items():
        want.update({(conv, c): d for c, d in plain_depths(links).items()})
        for k, (c, ups) in enumerate(links.items()):
            own = sorted(ups) + ["nowhere", None]
            rows += [(conv, k, c, "f", "{}", own[: len(own) // 2]), (conv, k, c, "f", "{}", own[len(own) // 2 :])]  # repeated, each names a part
    rows += [(9, 0, "none", "f", "{}", None), (9, 0, "none", "f", "{}", None), (None, 1, "x", "f", "{}", ["none"]), (9, 1, None, "f", "{}", ["none"])]
    want[9, "none"] = 0
    got = {(r["conv_id"], r["call_id"]): r["depth"] for r in toolcalls.depths(spark.createDataFrame(rows, CALLS), small).collect()}
    assert got == want


ARGUMENTS = {
    '{"turn":1e400}': "$: number",
    '{"turn":-1e400}': "$: number",
    '{"a":NaN}': "$: number",
    "9" * 5000: "$: number",
    '{"a":"\\ud800"}': "$: surrogate",
    '{"\\udc00":1}': "$: surrogate",
    "[" * 3000 + "]" * 3000: "$: nesting",
    "[" * 200_000 + "]" * 200_000: "$: nesting",
    "[" * 101 + "]" * 101: "",
    "[" * 102 + "]" * 102: "$: nesting",
    "[" * 3000: "$: json",
    '{"a":1,"a":2}': "$: repeated key",
    "": "$: json",
    "{": "$: json",
    "9" * 4000: "",
    '"\\ud83d\\ude00"': "",
    json.dumps({"text": "é x " * 400_000}): "",
}


def test_no_argument_kills_the_job(spark):
    rows = [(1, k, f"c{k}", "f", a, None) for k, a in enumerate(ARGUMENTS)] + [(1, 99, "c99", "f", None, []), (1, 98, "c98", None, "{}", [])]
    got = {r["call_id"]: r for r in toolcalls.link(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), ANY).collect()}
    for k, (a, error) in enumerate(ARGUMENTS.items()):
        if a in ("[" * 200_000 + "]" * 200_000, "[" * 3000):
            assert got[f"c{k}"]["errors"] in ("$: nesting", "$: json")
        else:
            assert got[f"c{k}"]["errors"] == error, a[:50]
        message = json.loads(got[f"c{k}"]["message"])
        assert message["arguments"] == (json.loads(a) if not error else None)
    assert got["c99"]["errors"] == "$: no arguments" and got["c98"]["errors"] == "$: no schema"


def test_whole_numbers_of_any_size_are_whole():
    schema = {"type": "integer", "minimum": 3}
    assert toolcalls.errors(10**400, schema) == [] and toolcalls.errors(-(10**400), schema) == ["$: minimum"]
    assert toolcalls.errors(2.5, schema) == ["$: type"] and toolcalls.canonical({"b": 2.0, "a": [1e22, True]}) == '{"a":[1e+22,true],"b":2}'


def test_clashing_columns_and_plan(spark):
    names = "conv_id long, turn int, role string, text string, call_id string, after string, depth long, hops long, up string, n_results long, first string"
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}", "x", "y", 5, 6, "z", 7, "w") for c in (1, 2) for t in range(6)]
    rows += [(None, 0, "user", "a", *[None] * 7), (3, None, "user", None, *[None] * 7), (3, 0, None, "b", *[None] * 7), (1, 0, "user", "text 1 0", "x", "y", 5, 6, "z", 7, "w")]
    frame = spark.createDataFrame(rows, names)
    asked, said = toolcalls.exchanges(frame)
    asked = asked.withColumns({"up": asked["call_id"], "content": asked["name"], "n": asked["turn"], "status": asked["name"]})
    out = toolcalls.link(asked, said.withColumnsRenamed({}).withColumn("name", said["content"]), toolcalls.REPLY)
    assert "ShuffledHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert len(got) == sum(r[2] == "user" for r in rows)
    assert sorted(r["depth"] for r in got if r["conv_id"] == 1) == [0, 0, 1, 2]
    assert toolcalls.link(asked.limit(0), said.limit(0), toolcalls.REPLY).count() == 0


def test_schemas_that_are_not_implemented_are_refused(spark):
    for schema in ({"const": 1}, {"type": "text"}, {"properties": {"a": {"pattern": "x"}}}, {"items": {"anyOf": []}}, {"additionalProperties": {}}, {"type": ["string", "any"]}, 7):
        with pytest.raises(ValueError):
            toolcalls.check_schema(schema)
    toolcalls.check_schema({"type": ["object", "null"], "title": "x", "properties": {"a": {"items": {"type": "integer"}}}})
    assert toolcalls.errors(True, {"enum": [1]}) == ["$: enum"] and toolcalls.errors(1.0, {"enum": [1]}) == [] and toolcalls.errors(1, {"enum": [True, "1"]}) == ["$: enum"]
    assert toolcalls.errors({"a": [1]}, {"enum": [{"a": [1.0]}]}) == []
