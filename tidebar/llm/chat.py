"""Chat formatting (operator 8): tool calls linked to their results, in DataFrame operations only.

Messages are JSON: a call has id, name, arguments and optionally the id of the call it comes ``after``;
a result has the id of its call and content. Calls and results are hash-joined by (conversation, id).
Calls are ordered topologically: a call's level is its distance from a call that comes after none. The
levels are found by pointer doubling, so a chain of n calls takes log2(n) joins. Arguments are validated
against the schema of the named tool, and the linked pair is serialised as canonical JSON: keys sorted,
no spaces, numbers in one form (a variant value prints so).

``linked`` returns a row for each call and each result without one:
status   answered, unanswered, orphan (a result without call), repeated (a call or result after the first)
level    0 for calls that come after none; null on a cycle and for results alone
errors   sorted: cycle, unknown predecessor, unknown tool, not an object, <key>: missing / type / range / unknown

Defined cases: a message whose JSON cannot be read is a message without id; ids that are null or repeated
link to nothing beyond the first of their turn order: of calls with one id the first counts and the rest
are "repeated", and so with results; a null turn comes last, and rows of one turn are ordered by the hash
of their body, equal bodies as they lie; a null conversation is a conversation of its own; texts of any length go whole; an empty
table gives an empty table; columns of the input beyond those named are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import written


@dataclass(frozen=True)
class Parameter:
    """``least``/``most`` bound a number, or the length of a string; ``among`` lists the values allowed."""

    kind: str  # string, integer, number, boolean, array, object
    required: bool = False
    least: float | None = None
    most: float | None = None
    among: tuple[str, ...] | None = None


Schemas = dict[str, dict[str, Parameter]]

KINDS = {
    "string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",),
}


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Array of what is wrong with a variant of arguments under the schema of the tool ``name``."""
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    keys = F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array().cast("array<string>"))
    per_tool = F.array(F.lit("unknown tool"))
    for tool, parameters in schemas.items():
        checks = []
        for key, p in sorted(parameters.items()):
            path = f"$.{key}"
            value = F.try_variant_get(arguments, path, "variant")
            # a JSON null has the type VOID and counts as absent
            kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
            absent = kind == "VOID"
            typed = F.lit(False)
            for prefix in KINDS[p.kind]:
                typed = typed | kind.startswith(prefix)
            size = (
                F.length(F.try_variant_get(arguments, path, "string")) if p.kind == "string"
                else F.try_variant_get(arguments, path, "double") if p.kind in ("integer", "number") else F.lit(None)
            )
            beyond = F.lit(False)
            if p.least is not None:
                beyond = beyond | (size < p.least)
            if p.most is not None:
                beyond = beyond | (size > p.most)
            if p.among is not None:
                beyond = beyond | ~F.try_variant_get(arguments, path, "string").isin(*p.among)
            checks.append(
                F.when(absent, F.lit(f"{key}: missing") if p.required else F.lit(None))
                .when(~typed, F.lit(f"{key}: type")).when(beyond, F.lit(f"{key}: range"))
            )
        known = F.array(*[F.lit(k) for k in parameters]) if parameters else F.array().cast("array<string>")
        unknown = F.transform(F.array_except(keys, known), lambda k: F.concat(k, F.lit(": unknown")))
        found = F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), unknown)
        per_tool = F.when(name == tool, found).otherwise(per_tool)
    return F.when(is_object, per_tool).otherwise(F.array(F.lit("not an object")))


def levels(calls: DataFrame) -> DataFrame:
    """(node, level) for ``calls`` (node, parent): distance from the root; null on a cycle.

    Pointer doubling: every node knows an ancestor and how far it is; in each round it takes over what
    that ancestor knows. Nodes that have met a root rest.
    """
    nodes = calls.count()
    state = written(
        calls.select(
            "node", F.coalesce("parent", "node").alias("up"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("level"),
            F.col("parent").isNull().alias("done"),
        ),
        "levels",
    )
    for _ in range(math.ceil(math.log2(max(2, nodes))) + 1):
        if not state.filter("NOT done").limit(1).count():
            break
        ahead = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"), F.col("done").alias("met"))
        moved = state.filter("NOT done").join(ahead, "up").select(
            "node", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"), F.col("met").alias("done")
        )
        state = written(state.filter("done").unionByName(moved), "levels")
    return state.select("node", F.when(F.col("done"), F.col("level")).alias("level"))


def linked(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """Rows as described above, from ``messages`` (conv_id, turn, kind call/result, body JSON)."""
    body = F.try_parse_json("body")
    # written, as the numbers of rows must stay as they are
    numbered = written(messages.select("conv_id", "turn", "kind", "body", F.monotonically_increasing_id().alias("rid")), "messages")
    read = numbered.withColumn("v", body).select(
        "conv_id", "turn", "kind", "v", "rid",
        F.struct(F.col("turn").isNull().alias("late"), "turn", F.xxhash64("body").alias("h"), "rid").alias("rank"),
        F.try_variant_get("v", "$.id", "string").alias("id"),
        F.try_variant_get("v", "$.after", "string").alias("after"),
    )
    node = F.concat_ws("\x1f", F.coalesce(F.col("conv_id").cast("string"), F.lit("\x1e")), "id")
    named = F.col("id").isNotNull()
    calls = read.filter("kind = 'call'").withColumn("node", F.when(named, node))
    results = read.filter("kind = 'result'").withColumn("node", F.when(named, node))
    # the first of a repeated id: aggregates on the id, so repeats are combined before they are shuffled
    first_call = calls.filter("node IS NOT NULL").groupBy("node").agg(F.min("rank").alias("r")).select("node", F.col("r.rid").alias("first"))
    first_result = results.filter("node IS NOT NULL").groupBy("node").agg(F.min("rank").alias("r")).select("node", F.col("r.rid").alias("answer"))
    heads = written(
        calls.join(first_call, "node").filter("rid = first")
        .select(
            "node", "conv_id", "turn", "id", F.to_json("v").alias("call"),
            F.when(F.col("after").isNotNull(), F.concat_ws("\x1f", F.coalesce(F.col("conv_id").cast("string"), F.lit("\x1e")), "after")).alias("wanted"),
        ),
        "calls",
    )
    parents = heads.select(F.col("node").alias("wanted"), F.lit(True).alias("known"))
    placed = heads.join(parents, "wanted", "left").select(
        *heads.columns, F.coalesce("known", F.lit(False)).alias("known")
    )
    edges = written(placed.select("node", F.when(F.col("known"), F.col("wanted")).alias("parent"),
                                  (F.col("wanted").isNotNull() & ~F.col("known")).alias("lost")), "edges")
    level = levels(edges.select("node", "parent"))
    answers = (
        results.join(first_result, "node").filter("rid = answer")
        .select("node", F.to_json("v").alias("result"))
    )
    v = F.try_parse_json("call")
    own = argument_errors(F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$.arguments", "variant"), schemas)
    marks = F.array_compact(F.array(
        F.when(F.col("level").isNull(), F.lit("cycle")), F.when(F.col("lost"), F.lit("unknown predecessor")),
    ))
    pairs = (
        heads.join(answers, "node", "left").join(edges.select("node", "lost"), "node").join(level, "node")
        .select(
            "conv_id", "turn", "id", F.when(F.col("result").isNull(), "unanswered").otherwise("answered").alias("status"),
            "level", F.array_sort(F.concat(marks, own)).alias("errors"),
            F.concat(F.lit('{"call":'), "call", F.lit(',"result":'), F.coalesce("result", F.lit("null")), F.lit("}")).alias("json"),
        )
    )
    seen = heads.select("node", F.lit(True).alias("has_call"))
    lone = results.join(seen, "node", "left").join(first_result, "node", "left").select(
        "conv_id", "turn", "id",
        F.when(F.col("has_call").isNull(), "orphan").when(F.col("rid") != F.col("answer"), "repeated").alias("status"),
        "v", F.lit("result").alias("part"),
    ).filter("status IS NOT NULL")
    again = calls.join(first_call, "node", "left").filter("first IS NULL OR rid <> first").select(
        "conv_id", "turn", "id", F.lit("repeated").alias("status"), "v", F.lit("call").alias("part")
    )
    rest = lone.unionByName(again).select(
        "conv_id", "turn", "id", "status", F.lit(None).cast("long").alias("level"),
        F.array().cast("array<string>").alias("errors"),
        F.concat(F.lit('{"'), "part", F.lit('":'), F.coalesce(F.to_json("v"), F.lit("null")), F.lit("}")).alias("json"),
    )
    return pairs.unionByName(rest)


def turns_as_messages(conversations: DataFrame) -> DataFrame:
    """Conversation turns as calls and results: a user's turn asks, an assistant's answers the turn before.

    A user turn calls ``ask``, or ``follow_up`` after the call two turns earlier where the turn between
    is an assistant's; turns are matched by number, so a conversation of any length needs no sort.
    Turns of other roles (system, tool, null) are neither calls nor results and take no part.
    """
    t = conversations.select("conv_id", "turn", "role", "text")
    spoken = t.filter("role = 'assistant'").select(
        F.col("conv_id").alias("c"), (F.col("turn") + 1).alias("n"), F.lit(True).alias("answered")
    ).dropDuplicates(["c", "n"])
    user = t.filter("role = 'user'").join(
        spoken, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("n")), "left"
    )
    named = lambda turn: F.concat(F.lit("call-"), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit("-"), turn.cast("string"))
    after = F.when(F.col("answered"), named(F.col("turn") - 2))
    calls = user.select(
        "conv_id", "turn", F.lit("call").alias("kind"),
        F.to_json(F.struct(
            named(F.col("turn")).alias("id"),
            F.when(F.col("answered"), "follow_up").otherwise("ask").alias("name"),
            after.alias("after"),
            F.struct("text", "turn", F.length("text").alias("chars"), after.alias("after")).alias("arguments"),
        )).alias("body"),
    )
    results = t.filter("role = 'assistant'").select(
        "conv_id", "turn", F.lit("result").alias("kind"),
        F.to_json(F.struct(named(F.col("turn") - 1).alias("id"), F.col("text").alias("content"))).alias("body"),
    )
    return calls.unionByName(results)


#: The tools of ``turns_as_messages``: questions of up to 2,000 characters, in the first 100 turns.
TURN_SCHEMAS: Schemas = {
    "ask": {
        "text": Parameter("string", True, 1, 2000), "turn": Parameter("integer", True, 0, 100),
        "chars": Parameter("integer", True, 1),
    },
    "follow_up": {
        "text": Parameter("string", True, 1, 2000), "turn": Parameter("integer", True, 2, 100),
        "chars": Parameter("integer", True, 1), "after": Parameter("string", True),
    },
}
