"""Chat formatting: tool calls linked to their results, ordered, validated, in canonical JSON.

* Calls and results meet in a shuffled hash join by (conv_id, call_id). The first result by (turn,
  content) answers; results are reduced to one row for each id first, so repeated rows multiply nothing.
* A call may name calls it comes ``after`` (one, or an array). Its depth is the length of the longest way
  to it from a call that waits for none, so (depth, turn, call_id) is a topological order. Calls on a
  cycle, or behind one, get no depth. A conversation of up to SMALL such links is ordered in one task.
  Larger ones are ordered across tasks: calls that wait for one other are hung on the first ancestor that
  waits for none or for several, by pointer doubling, in log2(n) rounds of a join; the calls that wait for
  several are then settled level by level, a round for each level of theirs.
* Arguments are validated against the tool's JSON schema (type, required, properties, items, enum,
  additionalProperties, minimum, maximum, minLength, maxLength).
* Canonical JSON: keys sorted by code point, no white space, no escapes but the required ones,
  numbers in shortest form. Refused, as an error of the arguments: repeated keys, numbers that aren't
  finite or have more than 4300 digits, lone surrogates, and more than NESTING levels.

Defined results: a null or unparsable argument text is an error of its own; a call without id or
conversation is returned unlinked, with no depth; a name ``after`` that no call has counts as none, and is
listed; repeated calls are each returned, and wait for all that any of them names; results that tie are
equal, so either answers; a tool without schema is an error; arguments and contents may be of any length;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, materialize

#: Links of a conversation that one task orders; levels of arguments; digits of a whole number.
SMALL, NESTING, DIGITS = 50_000, 100, 4300
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _refuse(text: str) -> None:
    raise ValueError("number")


def _whole(text: str) -> int:
    return int(text) if len(text) <= DIGITS else _refuse(text)


def _finite(text: str) -> float:
    value = float(text)
    return value if math.isfinite(value) else _refuse(text)


def parse(text: str | None) -> object:
    """The value of a JSON text; ValueError says in a word why there is none."""
    if text is None:
        raise ValueError("no arguments")
    try:
        value = json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse, parse_int=_whole, parse_float=_finite)
    except json.JSONDecodeError:
        raise ValueError("json") from None
    except RecursionError:
        raise ValueError("nesting") from None
    level = [value]
    for _ in range(NESTING + 1):
        level = [v for x in level if isinstance(x, (dict, list)) for v in (x.values() if isinstance(x, dict) else x)]
        if not level:
            break
    else:
        raise ValueError("nesting")
    try:
        canonical(value).encode("utf-8")
    except UnicodeEncodeError:
        raise ValueError("surrogate") from None
    return value


def _plain(value: object) -> object:
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, float) and value.is_integer() and abs(value) < 1 << 53:
        return int(value)
    return value


def canonical(value: object) -> str:
    return json.dumps(_plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def _is(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _KINDS[kind])


#: The keywords that are checked, and those that only say something.
_CHECKED = {"type", "required", "properties", "items", "enum", "additionalProperties", "minimum", "maximum", "minLength", "maxLength"}
_SAID = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}


def check_schema(schema: object, at: str = "$") -> None:
    """ValueError for a schema with keywords or types that aren't implemented: passing over them would call wrong arguments right."""
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema is an object")
    if unknown := sorted(set(schema) - _CHECKED - _SAID):
        raise ValueError(f"{at}: {', '.join(unknown)} not implemented")
    kinds = schema.get("type", [])
    if unknown := sorted(set([kinds] if isinstance(kinds, str) else kinds) - set(_KINDS) - {"integer", "number"}):
        raise ValueError(f"{at}: no type {', '.join(unknown)}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"{at}: additionalProperties must be true or false")
    for k, own in schema.get("properties", {}).items():
        check_schema(own, f"{at}.{k}")
    if "items" in schema:
        check_schema(schema["items"], f"{at}[]")


def errors(value: object, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value, as "path: rule", in order of the paths."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: type"]
    found = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):  # 1 is 1.0 and isn't true
        found.append(f"{at}: enum")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"{at}.{k}: required" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in own:
                found += errors(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: additionalProperties")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            found += errors(item, schema["items"], f"{at}[{i}]")
    if isinstance(value, str):
        found += [f"{at}: {k}" for k, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", len(value)))) if bad]
    if _is(value, "number"):
        found += [f"{at}: {k}" for k, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    return found


def levels(links: list[tuple[str, str]]) -> dict[str, int | None]:
    """The depth of every call that waits, from all links (call, call it waits for) of a conversation."""
    waits: dict[str, int] = Counter(call for call, _ in links)
    behind: dict[str, list[str]] = defaultdict(list)
    for call, up in links:
        behind[up].append(call)
    depth = {up: 0 for up in behind if up not in waits}
    ready = list(depth)
    for up in ready:  # grows as calls come free
        for call in behind.get(up, ()):
            depth[call] = max(depth.get(call, 0), depth[up] + 1)
            waits[call] -= 1
            if not waits[call]:
                ready.append(call)
    return {call: None if left else depth[call] for call, left in waits.items()}


def _levels_by_conversation(links: DataFrame) -> DataFrame:
    """conv_id, call_id, depth of the calls that wait; each conversation in one task."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(conv, held):
            found = levels(held)
            arrays = [pa.array([conv] * len(found), pa.int64()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "call_id", "depth"])

        conv, held = None, []
        for batch in batches:
            for own, call, up in zip(*(c.to_pylist() for c in batch.columns)):
                if own != conv and held:
                    yield out(conv, held)
                    held = []
                conv = own
                held.append((call, up))
        if held:
            yield out(conv, held)

    return links.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(step, "conv_id long, call_id string, depth long")


def _levels_across(links: DataFrame) -> DataFrame:
    """conv_id, call_id, depth of the calls that wait, with joins only."""
    key = ["conv_id", "call_id"]
    counted = links.groupBy(key).agg(F.count("*").alias("n"), F.min("up").alias("up"))
    several = materialize(counted.where("n > 1").select(key), "several")
    steps = materialize(counted.where("n = 1").select(*key, "up", F.lit(1).cast("long").alias("hops")), "hops")
    bound = max(1, steps.count()).bit_length() + 1  # by then every chain without a cycle is at its end
    for _ in range(bound):
        parent = steps.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("hops").alias("more"))
        ahead = steps.join(parent, ["conv_id", "up"], "left")
        ahead = ahead.select(*key, F.coalesce("next", "up").alias("up"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("more").isNotNull().alias("moved"))
        ahead = materialize(ahead, "hops")
        moved = not ahead.where("moved").isEmpty()
        drop_table(steps)
        steps = ahead.drop("moved")
        if not moved:
            break
    # an ancestor that still waits for one other is on a cycle
    single = steps.select("conv_id", F.col("call_id").alias("up"), F.lit(True).alias("cyclic"))
    steps = steps.join(single, ["conv_id", "up"], "left").select(*key, F.col("up").alias("top"), "hops", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    steps = materialize(steps, "hung")
    known = several.select(*key, F.lit(None).cast("long").alias("depth")).limit(0)
    if not several.isEmpty():
        # links of the calls that wait for several, each to the ancestor its way hangs on
        hung = steps.select("conv_id", F.col("call_id").alias("up"), "top", "hops", "cyclic")
        ways = links.join(several, key, "left_semi").join(hung, ["conv_id", "up"], "left")
        ways = ways.select(*key, F.coalesce("top", "up").alias("top"), (F.coalesce("hops", F.lit(0)) + 1).alias("hops"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
        waiting = several.select("conv_id", F.col("call_id").alias("top"), F.lit(True).alias("waiting"))
        ways = materialize(ways.join(waiting, ["conv_id", "top"], "left"), "ways")
        settled = -1
        while True:
            tops = known.select("conv_id", F.col("call_id").alias("top"), "depth")
            each = ways.join(tops, ["conv_id", "top"], "left").withColumn("reach", F.when(~F.col("cyclic"), F.coalesce("depth", F.when(F.col("waiting").isNull(), F.lit(0))) + F.col("hops")))
            after = materialize(each.groupBy(key).agg(F.max("reach").alias("depth"), F.count_if(F.col("reach").isNull()).alias("open")).where("open = 0").select(*key, "depth"), "known")
            now = after.count()
            if settled > 0:
                drop_table(known)
            known = after
            if now == settled or now == 0:
                break
            settled = now
    # a chain's top waits for none, or is settled, or is on a cycle
    tops = several.select("conv_id", F.col("call_id").alias("top"), F.lit(True).alias("waiting")).join(known.select("conv_id", F.col("call_id").alias("top"), "depth"), ["conv_id", "top"], "left")
    chained = steps.join(tops, ["conv_id", "top"], "left")
    chained = chained.select(*key, F.when(~F.col("cyclic"), F.when(F.col("waiting").isNull(), F.lit(0)).otherwise(F.col("depth")) + F.col("hops")).alias("depth"))
    return chained.unionByName(several.join(known, key, "left").select(*key, "depth"))


def depths(calls: DataFrame, small: int = SMALL) -> DataFrame:
    """conv_id, call_id and depth (null on a cycle or behind one) of every distinct call that has both ids."""
    named = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    after = F.col("after") if isinstance(calls.schema["after"].dataType, T.ArrayType) else F.array("after")
    nodes = materialize(named.select("conv_id", "call_id").distinct(), "nodes")
    links = named.select("conv_id", "call_id", F.explode(after).alias("up")).where("up is not null").distinct()
    links = materialize(links.join(nodes.select("conv_id", F.col("call_id").alias("up")), ["conv_id", "up"], "left_semi").select("conv_id", "call_id", "up"), "links")
    large = materialize(links.groupBy("conv_id").count().where(F.col("count") > small).select("conv_id"), "large")
    if large.isEmpty():
        found = _levels_by_conversation(links)
    else:
        found = _levels_by_conversation(links.join(large, "conv_id", "left_anti")).unionByName(_levels_across(materialize(links.join(large, "conv_id", "left_semi"), "links")))
    found = found.select("conv_id", "call_id", "depth", F.lit(True).alias("waits"))
    return nodes.join(found, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.when(F.col("waits").isNull(), F.lit(0)).otherwise(F.col("depth")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], small: int = SMALL) -> DataFrame:
    """conv_id, turn, call_id, name, depth, status, errors, n_results, result_turn and message (the
    canonical JSON of all that) of every call.

    calls: conv_id, turn, call_id, name, arguments (JSON), after (a call_id or an array of them). results:
    conv_id, turn, call_id, content. status: ``cycle``, else ``invalid`` (arguments), else ``open`` (no
    result) or ``linked``. A schema with a keyword or type that isn't implemented is refused at once."""
    for name, schema in schemas.items():
        check_schema(schema, name)
    many = isinstance(calls.schema["after"].dataType, T.ArrayType)
    kinds = (("conv_id", "long"), ("turn", "int"), ("call_id", "string"), ("name", "string"), ("arguments", "string"), ("after", "array<string>" if many else "string"))
    calls = materialize(calls.select(*(F.col(c).cast(t).alias(c) for c, t in kinds)), "calls")
    answers = results.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"))
    answers = answers.agg(F.min(F.struct(F.col("turn").cast("int").alias("turn"), F.col("content").cast("string").alias("content"))).alias("first"), F.count("*").alias("n_results"))
    rows = calls.join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(depths(calls, small).hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    rows = rows.select("conv_id", "turn", "call_id", "name", "arguments", "after", "depth", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.col("first.turn").alias("result_turn"), F.col("first.content").alias("content"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, problems, messages = [], [], []
            for r in batch.to_pylist():
                try:
                    value = parse(r["arguments"])
                    found = errors(value, schemas[r["name"]]) if r["name"] in schemas else ["$: no schema"]
                except ValueError as e:
                    value, found = None, [f"$: {e}"]
                known = r["conv_id"] is not None and r["call_id"] is not None
                state = "cycle" if known and r["depth"] is None else "invalid" if found else "linked" if r["n_results"] else "open"
                status.append(state)
                problems.append("; ".join(found))
                result = {"content": r["content"], "turn": r["result_turn"]} if r["n_results"] else None
                after = sorted({a for a in r["after"] or [] if a is not None}) if many else r["after"]
                messages.append(canonical({"after": after, "arguments": value, "call_id": r["call_id"], "conv_id": r["conv_id"], "depth": r["depth"], "errors": found, "name": r["name"], "result": result, "status": state, "turn": r["turn"]}))
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            arrays = [get("conv_id"), get("turn"), get("call_id"), get("name"), get("depth"), pa.array(status, pa.string()), pa.array(problems, pa.string()), get("n_results"), get("result_turn"), pa.array(messages, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "turn", "call_id", "name", "depth", "status", "errors", "n_results", "result_turn", "message"])

    return rows.mapInArrow(step, "conv_id long, turn int, call_id string, name string, depth long, status string, errors string, n_results long, result_turn int, message string")


#: The tool that a plain exchange of turns amounts to.
REPLY = {
    "reply": {
        "type": "object",
        "required": ["text", "turn"],
        "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    }
}


def _id(turn: Column) -> Column:
    return F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls and results: each user turn calls ``reply`` with its text, and
    waits for the user turn two before; the assistant's next turn is the result."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    asked = own.where("role = 'user'").select(
        "conv_id", "turn", _id(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct("text", "turn")).alias("arguments"), F.when(F.col("turn") >= 2, _id(F.col("turn") - 2)).alias("after"),
    )
    said = own.where("role = 'assistant'").select("conv_id", "turn", _id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return asked, said


__all__ = ["REPLY", "canonical", "depths", "errors", "exchanges", "levels", "link", "parse"]
