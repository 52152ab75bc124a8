"""Chat formatting: link tool calls to results, order, validate, serialise.

Calls and results are hash-joined by conversation and identifier.  Every event gets
a place (turn, level) that grows along each dependency: a result never comes before
its call, and a call never before the result it refers to.  Places start at the
turns of the transcript and are raised where a dependency is violated until nothing
changes; that works on one narrow row per call, and references that form a cycle are
found by pointer doubling first and left out.
Arguments are checked against per-tool schemas, and every event becomes one line of
canonical JSON (keys sorted at every depth, no blanks).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.storage import stored


@dataclass(frozen=True)
class Parameter:
    """One argument: its JSON type (string, integer, number, boolean, array, object) and limits."""

    name: str
    type: str
    required: bool = True
    least: float | None = None
    most: float | None = None
    allowed: tuple[str, ...] = ()


EVENT_COLUMNS = ("kind", "call_id", "name", "arguments", "after", "role", "content")
Schemas = dict[str, tuple[Parameter, ...]]


def _json_type(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number")
        .otherwise("null")
    )


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted error strings for a call; ``arguments`` is a variant, null if not JSON."""

    def of(p: Parameter) -> Column:
        path = "$." + p.name
        value = F.try_variant_get(arguments, path, "variant")
        kind = _json_type(value)
        fits = kind.isin(p.type, "integer") if p.type == "number" else kind == p.type
        bad = F.when(value.isNull(), F.lit(f"missing:{p.name}") if p.required else F.lit(None).cast("string"))
        bad = bad.when(~fits, F.lit(f"type:{p.name}"))
        number = F.try_variant_get(arguments, path, "double")
        if p.least is not None:
            bad = bad.when(number < p.least, F.lit(f"least:{p.name}"))
        if p.most is not None:
            bad = bad.when(number > p.most, F.lit(f"most:{p.name}"))
        if p.allowed:
            bad = bad.when(~F.try_variant_get(arguments, path, "string").isin(*p.allowed), F.lit(f"allowed:{p.name}"))
        return bad

    none = F.array().cast("array<string>")
    out = F.array(F.lit("unknown_tool"))
    for tool, parameters in sorted(schemas.items()):
        found = F.array_sort(F.array_compact(F.array(*map(of, parameters)))) if parameters else none
        out = F.when(name == tool, found).otherwise(out)
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    return F.when(name.isNull(), none).when(~is_object, F.array(F.lit("not_an_object"))).otherwise(out)


def canonical_json(fields: dict[str, Column]) -> Column:
    """One object with sorted keys; values are canonical JSON already."""
    parts = [F.concat(F.to_json(F.array(F.lit(k))).substr(F.lit(2), F.lit(len(k) + 2)), F.lit(":"), v) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def whole_numbers(json: Column) -> Column:
    """JSON whose whole numbers have no fraction (1.0 and 1e0 become 1); texts stay.

    From 10^7 on a number that was written with an exponent keeps one.
    """
    bare = F.regexp_replace(json, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|(-?\d+)\.0(?=[,}\]]|$)', "$1$2")
    return F.when(json.rlike(r"\d\.0(?:[,}\]]|$)"), bare).otherwise(json)


def quoted(text: Column) -> Column:
    """A string as a JSON string."""
    whole = F.to_json(F.array(text))
    return F.when(text.isNull(), "null").otherwise(F.substring(whole, 2, F.length(whole) - 2))


def _at(turn: Column, level: Column) -> Column:
    return F.struct(turn.cast("long").alias("turn"), level.cast("int").alias("level"))


def _next(place: Column) -> Column:
    return _at(place["turn"], place["level"] + 1)


def _calls(events: DataFrame) -> DataFrame:
    """One narrow row per conversation and identifier: its linking call, counts and turns, no texts."""
    keyed = events.where("call_id is not null and conv_id is not null and kind in ('call', 'result')")
    turn = F.coalesce("turn", F.lit(0))
    called, answered = (F.when(F.col("kind") == k, turn) for k in ("call", "result"))
    first = F.when(F.col("kind") == "call", F.struct(turn, "name", "after"))
    return keyed.groupBy(F.col("conv_id").alias("c"), F.col("call_id").alias("i")).agg(
        F.count(called).alias("calls"),
        F.count(answered).alias("results"),
        F.min(called).alias("call_turn"),
        F.max(answered).alias("result_turn"),
        F.min_by("name", first).alias("call_name"),
        F.min_by("after", first).alias("ref"),
    )


def _on_cycles(calls: DataFrame) -> DataFrame | None:
    """(c, i) of calls whose references lead back to themselves; None where none can.

    References to calls of earlier turns cannot close a cycle alone, so only the
    conversations with another one are looked at.  Pointers double until they have
    gone further than a conversation has calls: what they then point at is a cycle.
    """
    linked = calls.where("calls > 0")
    target = linked.select(F.col("c").alias("tc"), F.col("i").alias("ti"), F.col("call_turn").alias("tt"))
    refers = linked.join(target, (F.col("c") == F.col("tc")) & (F.col("ref") == F.col("ti")))
    suspects = refers.where("tt >= call_turn").select("c").distinct()
    jumps = stored(refers.join(suspects, "c", "left_semi").select("c", "i", "ref"), "jumps")
    longest = jumps.groupBy("c").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0]
    if not longest:
        return None
    reach = 1
    while reach < longest:
        onward = jumps.select("c", F.col("i").alias("ref"), F.col("ref").alias("further"))
        jumps = stored(jumps.join(onward, ["c", "ref"]).select("c", "i", F.col("further").alias("ref")), "jumps")
        reach *= 2
    return jumps.select("c", F.col("ref").alias("i")).distinct().withColumn("cycle", F.lit(True))


def _placed(calls: DataFrame) -> DataFrame:
    """``calls`` with ``call_at`` and ``result_at``, raised until every dependency holds.

    A reference that is part of a cycle is not followed.  Without cycles a round settles
    every call whose reference is settled, so rounds number at most the longest chain of
    violated dependencies, and none of them moves a text.
    """
    start = _at(F.col("call_turn"), F.lit(0))
    cycles = _on_cycles(calls)
    marked = calls.withColumn("cycle", F.lit(False)) if cycles is None else calls.join(cycles, ["c", "i"], "left")
    marked = marked.withColumns({"cycle": F.coalesce("cycle", F.lit(False)), "call_at": start})
    answered = F.when(F.col("results") > 0, F.greatest(_at(F.col("result_turn"), F.lit(0)), _next(F.col("call_at"))))
    while True:
        marked = marked.withColumn("result_at", answered)
        target = marked.select(F.col("c").alias("tc"), F.col("i").alias("ti"), _next(F.col("result_at")).alias("need"), F.col("result_at").isNotNull().alias("bound"))
        follows = (F.col("c") == F.col("tc")) & (F.col("ref") == F.col("ti")) & ~F.col("cycle")
        raised = marked.join(target, follows, "left")
        moved = F.coalesce(F.col("bound") & (F.col("need") > F.col("call_at")), F.lit(False))
        raised = raised.withColumn("moved", moved).withColumn("call_at", F.when(F.col("moved"), F.col("need")).otherwise(F.col("call_at")))
        marked = stored(raised.drop("tc", "ti", "need", "bound"), "calls")
        if marked.where("moved").isEmpty():
            return marked.drop("moved")
        marked = marked.drop("moved", "result_at")


def link_tool_calls(events: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per event, in canonical JSON, with its link, place and errors.

    ``events``: conv_id, turn, kind (call, result or message), call_id, name,
    arguments (JSON text), after (call whose result a call uses), role, content.
    Status of a call: linked or no_result; of a result: linked or orphan; calls whose
    identifier repeats in the conversation are ``duplicate``.  Null conversations or
    identifiers never link; a null turn counts as turn 0 in the order.  Results and
    references link to the smallest turn's call.  References to earlier, the same and
    later turns are all followed; calls whose references lead back to themselves keep
    their turn and have the error ``cycle``.  Repeated rows stay; texts may be of any
    length; an empty table gives no rows; further columns are not looked at.  No
    conversation is gathered: order is the pair (order_turn, order_level), with ties
    in order of the turn.
    """
    events = events.select("conv_id", F.col("turn").cast("long").alias("turn"), *EVENT_COLUMNS)
    known = _placed(stored(_calls(events), "calls"))
    own = known.select("c", "i", "calls", "results", "call_name", "call_turn", "call_at", "cycle")
    referred = known.select(F.col("c").alias("rc"), F.col("i").alias("ri"), "result_at")
    e = events.join(own, (F.col("conv_id") == F.col("c")) & (F.col("call_id") == F.col("i")), "left")
    e = e.join(referred, (F.col("conv_id") == F.col("rc")) & (F.col("after") == F.col("ri")) & (F.col("kind") == "call"), "left")
    turn = F.coalesce("turn", F.lit(0))
    need = F.when((F.col("kind") == "result") & F.col("call_at").isNotNull(), _next(F.col("call_at"))).when(
        (F.col("kind") == "call") & (turn > F.col("call_turn")) & F.col("result_at").isNotNull(), _next(F.col("result_at"))
    )
    place = F.greatest(_at(turn, F.lit(0)), need)
    links = (F.col("kind") == "call") & (turn == F.col("call_turn"))
    e = e.withColumn("place", F.when(links, F.col("call_at")).otherwise(place))
    calls, results = F.coalesce("calls", F.lit(0)), F.coalesce("results", F.lit(0))
    status = (
        F.when(F.col("kind") == "call", F.when(calls > 1, "duplicate").when(results > 0, "linked").otherwise("no_result"))
        .when(F.col("kind") == "result", F.when(calls > 0, "linked").otherwise("orphan"))
        .otherwise("message")
    )
    e = e.withColumns({"status": status, "parsed": F.expr("try_parse_json(arguments)")})
    name = F.when(F.col("kind") == "call", F.coalesce("name", F.lit(""))) 
    circular = F.when(links & F.col("cycle"), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>"))
    errors = F.array_sort(F.concat(argument_errors(name, F.col("parsed"), schemas), circular))
    e = e.withColumn("errors", F.when(F.col("kind") == "call", errors).otherwise(F.array().cast("array<string>")))
    arguments = F.coalesce(whole_numbers(F.to_json("parsed")), quoted(F.col("arguments")))
    call = canonical_json({"arguments": arguments, "id": quoted(F.col("call_id")), "name": quoted(F.col("name")), "type": F.lit('"tool_call"')})
    result = canonical_json(
        {"content": quoted(F.col("content")), "id": quoted(F.col("call_id")), "name": quoted(F.col("call_name")), "type": F.lit('"tool_result"')}
    )
    message = canonical_json({"content": quoted(F.col("content")), "role": quoted(F.col("role")), "type": F.lit('"message"')})
    line = F.when(F.col("kind") == "call", call).when(F.col("kind") == "result", result).otherwise(message)
    return e.select(
        "conv_id", "turn", "kind", "call_id", "status",
        F.col("place.turn").alias("order_turn"), F.col("place.level").cast("int").alias("order_level"),
        F.concat_ws(",", "errors").alias("errors"), line.alias("json"),
    )


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """Read a plain transcript as tool use: a user turn calls the assistant.

    A user turn is a call ``answer`` (with the turn number and the whole text as
    arguments) and the assistant's turn right after it is its result; a call uses the
    result two turns before.  Other roles are plain messages.
    """
    turn, role = F.col("turn").cast("long"), F.col("role")
    name = lambda n: F.concat(F.lit("call_"), n.cast("string"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    call, result = role == "user", role == "assistant"
    return conversations.select(
        "conv_id",
        turn.alias("turn"),
        F.when(call, "call").when(result, "result").otherwise("message").alias("kind"),
        F.when(call, name(turn)).when(result, name(turn - 1)).alias("call_id"),
        F.when(call, "answer").alias("name"),
        F.when(call, canonical_json({"prompt": quoted(text), "turn": F.coalesce(turn.cast("string"), F.lit("null"))})).alias("arguments"),
        F.when(call, name(turn - 2)).alias("after"),
        role.cast("string").alias("role"),
        F.when(~call | role.isNull(), text).alias("content"),
    )
