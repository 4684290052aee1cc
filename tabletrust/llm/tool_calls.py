"""Chat formatting: tool calls linked to their results, ordered, validated and written as JSON.

Calls and results meet in one hash join on (conversation, call identifier). A call may name the call
whose result it uses; waves, the topological order of a conversation, come from pointer doubling
over these names, so a chain of n calls takes log2(n) joins. Arguments are parsed in the JVM,
checked against the tool's schema, and written back as canonical JSON: keys sorted, no blanks.

Defined results: calls with a null identifier or conversation are kept and linked to nothing. Of
several calls or results under one identifier the one with the smallest (turn, text) is linked;
`copies` counts the calls and `n_results` the results. A call that names a call which is not there
is `missing`; calls on a cycle, or behind one, have no wave and are `cyclic`. Arguments that are
null, empty or no JSON object are `malformed`. Results without a call are counted by
`orphan_results`. Extra columns are ignored. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletrust.session import materialize

#: One parameter of one tool; `type` is string, integer, number or boolean.
SCHEMA_COLUMNS = "tool string, param string, type string, required boolean"


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row per identifier: the first call, its copies, its first result and the number of results.

    `calls` has (conv_id, call_id, turn, tool, arguments, uses), `results` (conv_id, call_id, turn,
    content).
    """
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    body = F.struct("turn", "tool", "arguments", "uses")
    firsts = (
        calls.where(keyed)
        .groupBy("conv_id", "call_id")
        .agg(F.min(body).alias("call"), F.count(F.lit(1)).alias("copies"))
    )
    answers = (
        results.where(keyed)
        .groupBy("conv_id", "call_id")
        .agg(
            F.min(F.struct("turn", "content")).alias("answer"),
            F.count(F.lit(1)).alias("n_results"),
        )
    )
    loose = calls.where(~keyed).select(
        "conv_id", "call_id", body.alias("call"), F.lit(1).cast("bigint").alias("copies"),
        F.lit(None).cast(answers.schema["answer"].dataType).alias("answer"),
        F.lit(None).cast("bigint").alias("n_results"),
    )
    return (
        firsts.join(answers, ["conv_id", "call_id"], "left").unionByName(loose)
        .select(
            "conv_id", "call_id", "call.*", "copies",
            F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"),
            F.col("answer.content").alias("content"),
        )
    )


def orphan_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, n) results whose identifier no call has."""
    return (
        results.join(calls.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
        .groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def waves(links: DataFrame) -> DataFrame:
    """(conv_id, call_id, wave, order_state) of each identified call.

    Wave 0 uses no other call. Every doubling replaces a call's pointer by its pointer's pointer and
    adds up the steps; a pointer that never ends lies on a cycle or behind one.
    """
    nodes = links.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    nodes = nodes.select("conv_id", "call_id", "uses")
    there = nodes.select("conv_id", F.col("call_id").alias("uses"), F.lit(True).alias("there"))
    state = materialize(
        nodes.join(there, ["conv_id", "uses"], "left").select(
            "conv_id", "call_id",
            F.when(F.col("there"), F.col("uses")).alias("to"),
            F.when(F.col("there"), 1).otherwise(0).cast("bigint").alias("wave"),
            (F.col("uses").isNotNull() & F.col("there").isNull()).alias("missing"),
        ),
        "call-pointers",
    )
    most = state.where("to is not null").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    longest = most.agg(F.max("n")).first()[0] or 0
    done, moving = state.where("to is null"), state.where("to is not null")
    for _ in range(longest.bit_length()):
        # Only calls whose pointer has not ended yet are joined again.
        ahead = done.unionByName(moving).select(
            "conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"),
            F.col("wave").alias("more"),
        )
        moved = materialize(
            moving.join(ahead, ["conv_id", "to"]).select(
                "conv_id", "call_id", F.col("next").alias("to"),
                (F.col("wave") + F.col("more")).alias("wave"), "missing",
            ),
            "call-pointers",
        )
        done = done.unionByName(moved.where("to is null"))
        moving = moved.where("to is not null")
        if moving.isEmpty():
            break
    state = done.unionByName(moving)
    cyclic = F.col("to").isNotNull()
    return state.select(
        "conv_id", "call_id", F.when(~cyclic, F.col("wave")).alias("wave"),
        F.when(cyclic, "cyclic").when(F.col("missing"), "missing").otherwise("ordered")
        .alias("order_state"),
    )


def _kind(value: Column) -> Column:
    """string, integer, number, boolean, or the variant's own name, of a variant value."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", "string")
        .when(kind == "BIGINT", "integer")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "number")
        .otherwise(F.lower(kind))
    )


def check_arguments(calls: DataFrame, schemas: list[tuple[str, str, str, bool]]) -> DataFrame:
    """`calls` with `json`, the canonical arguments, and `faults`, a sorted list of what is wrong.

    A fault is malformed, unknown_tool, missing:param, type:param or extra:param.
    """
    parsed = calls.withColumn("_v", F.try_parse_json("arguments"))
    whole = F.schema_of_variant("_v").startswith("OBJECT")
    tools: dict[str, list[tuple[str, str, bool]]] = {}
    for tool, param, kind, required in schemas:
        tools.setdefault(tool, []).append((param, kind, required))
    by_tool = F.lit(None).cast("array<string>")
    for tool, params in tools.items():
        found = []
        for param, kind, required in params:
            path = "$['" + param.replace("'", "\\'") + "']"
            value = F.try_variant_get("_v", path, "variant")
            right = (_kind(value) == kind) | ((kind == "number") & (_kind(value) == "integer"))
            absent = F.lit(f"missing:{param}") if required else F.lit(None).cast("string")
            wrong = F.when(~F.coalesce(right, F.lit(False)), F.lit(f"type:{param}"))
            found.append(F.when(value.isNull(), absent).otherwise(wrong))
        names = F.json_object_keys(F.to_json("_v"))
        extra = F.transform(
            F.array_except(names, F.array(*(F.lit(p) for p, _, _ in params))),
            lambda x: F.concat(F.lit("extra:"), x),
        )
        faults = F.array_sort(F.concat(F.array_compact(F.array(*found)), extra))
        by_tool = F.when(F.col("tool") == tool, faults).otherwise(by_tool)
    malformed = F.array(F.lit("malformed"))
    return (
        parsed.withColumn("json", F.when(whole, F.to_json("_v")))
        .withColumn(
            "faults",
            F.when(~F.coalesce(whole, F.lit(False)), malformed).otherwise(
                F.coalesce(by_tool, F.array(F.lit("unknown_tool")))
            ),
        )
        .drop("_v")
    )


def formatted(
    calls: DataFrame, results: DataFrame, schemas: list[tuple[str, str, str, bool]]
) -> DataFrame:
    """Every call with its wave, faults, and one canonical JSON message holding call and result.

    Sorting by (conv_id, wave, turn, call_id) puts each call behind the call it uses.
    """
    links = materialize(linked(calls, results), "tool-links")
    checked = check_arguments(links, schemas)
    order = waves(links)
    on = ["conv_id", "call_id"]
    message = F.to_json(
        F.struct(
            F.col("json").alias("arguments"), F.col("call_id").alias("id"),
            F.col("tool").alias("name"), F.col("content").alias("result"),
        )
    )
    return checked.join(order, on, "left").select(
        *on, "turn", "tool", "wave", F.coalesce("order_state", F.lit("loose")).alias("order_state"),
        "copies", "n_results", F.array_join("faults", ",").alias("faults"),
        message.alias("message"),
    )


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a plain chat: each user turn calls a tool, the next turn is its result.

    A user turn calls `ask`, or `tell` if its text has no line break. It uses the call two turns
    earlier. Arguments are the text, its length, and whether it ends a sentence; a text of more
    than 400 characters gives its length as text, which the schema refuses.
    """
    name = lambda turn: F.concat_ws(
        "_", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string")
    )
    text = F.coalesce("text", F.lit(""))
    asked = turns.where(F.col("role") == "user")
    long = F.char_length(text) > 400
    base = [text.alias("text"), F.endswith(text, F.lit(".")).alias("closed")]
    size = F.char_length(text)
    arguments = F.when(
        long, F.to_json(F.struct(*base, size.cast("string").alias("size")))
    ).otherwise(F.to_json(F.struct(*base, size.alias("size"))))
    turn = F.col("turn").cast("bigint")
    calls = asked.select(
        "conv_id", name(turn).alias("call_id"), turn.alias("turn"),
        F.when(F.contains(text, F.lit("\n")), "ask").otherwise("tell").alias("tool"),
        arguments.alias("arguments"),
        F.when(turn >= 2, name(turn - 2)).alias("uses"),
    )
    results = turns.where(F.col("role") == "assistant").select(
        "conv_id", name(turn - 1).alias("call_id"), turn.alias("turn"),
        F.col("text").alias("content"),
    )
    return calls, results


#: The tools that `calls_of_turns` calls.
CHAT_TOOLS = [
    (tool, param, kind, required)
    for tool in ("ask", "tell")
    for param, kind, required in (
        ("text", "string", True),
        ("size", "integer", True),
        ("closed", "boolean", False),
    )
]
