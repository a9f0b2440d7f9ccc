"""Chat formatting: tool calls linked to their results, in DataFrame operations only.

Calls and results meet in a hash join by conversation and call id; both sides have one
row per id by then, so a hot conversation is only as large as its calls and can be split
by adaptive execution. Calls are put after those they depend on: a call's ``ready`` is
the latest turn among itself and all it depends on, and where a dependency has the same
``ready``, ``depth`` counts them. Order by ready, depth, turn is topological, and no
group is brought together to number it. Dependencies on earlier turns settle
themselves; only calls that wait for later ones take part in the rounds.

Arguments are parsed as variants and checked against the tools' schemas (a parameter;
each becomes column expressions); the line of a call is JSON with keys in order and no
spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverloop.llm.common import stage

# The part of JSON Schema that is checked: type, required, properties, enum, additionalProperties.
KINDS = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)",
    "boolean": "BOOLEAN",
    "array": "ARRAY.*",
    "object": "OBJECT.*",
    "null": "VOID",
}


def _errors(tools: dict[str, dict]) -> Column:
    """What is wrong with ``_args`` (variant) of ``arguments`` for the tool ``name``, in order."""
    kind = F.schema_of_variant("_args")
    none = F.array().cast("array<string>")
    found = F.when(F.col("name").isNull() | ~F.col("name").isin(*tools), F.array(F.lit("unknown tool"))) if tools else F.when(F.lit(True), F.array(F.lit("unknown tool")))
    found = found.when(F.col("_args").isNull(), F.array(F.lit("arguments are not JSON"))).when(~kind.startswith("OBJECT"), F.array(F.lit("arguments are not an object")))
    for tool, schema in sorted(tools.items()):
        checks = []
        for field, rule in sorted(schema.get("properties", {}).items()):
            path = "$['" + field.replace("\\", "\\\\").replace("'", "\\'") + "']"
            value = F.try_variant_get("_args", path, "variant")
            there = value.isNotNull()
            if field in schema.get("required", []):
                checks.append(F.when(~there, F.lit(f"{field}: missing")))
            if "type" in rule:
                fits = F.schema_of_variant(value).rlike(f"^{KINDS[rule['type']]}$")
                checks.append(F.when(there & ~fits, F.lit(f"{field}: not {rule['type']}")))
            if "enum" in rule:
                checks.append(F.when(there & ~F.coalesce(F.try_variant_get("_args", path, "string").isin(*rule["enum"]), F.lit(False)), F.lit(f"{field}: not in enum")))
        for field in sorted(set(schema.get("required", [])) - set(schema.get("properties", {}))):
            checks.append(F.when(~F.array_contains(F.json_object_keys("arguments"), field), F.lit(f"{field}: missing")))
        errors = F.array_compact(F.array(*checks)) if checks else none
        if schema.get("additionalProperties") is False:
            extra = F.array_sort(F.array_except(F.json_object_keys("arguments"), F.array(*[F.lit(f) for f in schema.get("properties", {})]).cast("array<string>")))
            errors = F.concat(errors, F.transform(extra, lambda f: F.concat(f, F.lit(": not allowed"))))
        found = found.when(F.col("name") == tool, errors)
    return F.coalesce(found, none)


def _ordered(calls: DataFrame) -> DataFrame:
    """``_conv``, ``_call``, ``ready``, ``depth``, ``cyclic`` of calls that have one row per id."""
    edges = calls.select("_conv", "_call", "turn", F.explode("after").alias("_on")).distinct()
    of = calls.select(F.col("_conv").alias("_c"), F.col("_call").alias("_d"), F.col("turn").alias("_t"))
    same = F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_on") == F.col("_d"))
    edges = stage(edges.join(of, same).select("_conv", "_call", "turn", "_on", "_t"), "edges")

    def grown(now: DataFrame, push: DataFrame) -> DataFrame:
        """The larger of what is known and what dependencies push, per call."""
        return stage(now.unionByName(push).groupBy("_conv", "_call").agg(F.max("v").alias("v")), "order")

    def settle(start: DataFrame, push_of, limit: DataFrame | None) -> DataFrame:
        now = stage(start, "order")
        before = None
        while True:
            total = now.agg(F.count(F.lit(1)), F.sum("v")).first()
            if total == before or not total[0]:
                return now
            before = total
            now = grown(now, push_of(now))
            if limit is not None:  # a depth beyond the number of calls goes round in a circle
                now = now.join(limit, (now["_conv"].eqNullSafe(limit["_lc"]))).select("_conv", "_call", F.least("v", F.col("_most") + 1).alias("v"))

    late = edges.where("_t > turn").select("_conv", "_call", F.col("_t").alias("v"))
    dep = edges.select(F.col("_conv").alias("_ec"), F.col("_call").alias("_to"), F.col("_on"), F.col("turn").alias("_tt"))

    def push_ready(now: DataFrame) -> DataFrame:
        on = now["_conv"].eqNullSafe(dep["_ec"]) & (now["_call"] == dep["_on"])
        return now.join(dep, on).where("v > _tt").select("_conv", F.col("_to").alias("_call"), "v")

    ready = settle(late.groupBy("_conv", "_call").agg(F.max("v").alias("v")), push_ready, None)
    ready = ready.select(F.col("_conv").alias("_rc"), F.col("_call").alias("_rcall"), F.col("v").alias("_ready"))
    timed = calls.select("_conv", "_call", "turn").join(ready, F.col("_conv").eqNullSafe(F.col("_rc")) & (F.col("_call") == F.col("_rcall")), "left")
    timed = stage(timed.select("_conv", "_call", F.coalesce("_ready", "turn").alias("ready")), "ready")

    a = timed.select(F.col("_conv").alias("_ac"), F.col("_call").alias("_aid"), F.col("ready").alias("_ar"))
    b = timed.select(F.col("_conv").alias("_bc"), F.col("_call").alias("_bid"), F.col("ready").alias("_br"))
    tied = edges.join(a, F.col("_conv").eqNullSafe(F.col("_ac")) & (F.col("_call") == F.col("_aid"))).join(b, F.col("_conv").eqNullSafe(F.col("_bc")) & (F.col("_on") == F.col("_bid")))
    tied = stage(tied.where("_ar = _br").select(F.col("_conv").alias("_ec"), F.col("_call").alias("_to"), F.col("_on")), "tied")
    most = tied.groupBy(F.col("_ec").alias("_lc")).agg(F.count(F.lit(1)).alias("_most"))

    def push_depth(now: DataFrame) -> DataFrame:
        on = now["_conv"].eqNullSafe(tied["_ec"]) & (now["_call"] == tied["_on"])
        return now.join(tied, on).select("_conv", F.col("_to").alias("_call"), (F.col("v") + 1).alias("v"))

    start = tied.select(F.col("_ec").alias("_conv"), F.col("_to").alias("_call"), F.lit(1).cast("bigint").alias("v")).distinct()
    depth = settle(start, push_depth, most).join(most, F.col("_conv").eqNullSafe(F.col("_lc")))
    depth = depth.select(F.col("_conv").alias("_dc"), F.col("_call").alias("_did"), F.col("v").alias("_depth"), (F.col("v") > F.col("_most")).alias("_cyclic"))
    out = timed.join(depth, F.col("_conv").eqNullSafe(F.col("_dc")) & (F.col("_call") == F.col("_did")), "left")
    return out.select("_conv", "_call", "ready", F.coalesce("_depth", F.lit(0)).cast("bigint").alias("depth"), F.coalesce("_cyclic", F.lit(False)).alias("cyclic"))


def link(calls: DataFrame, results: DataFrame, tools: dict[str, dict], conv_col: str = "conv_id") -> DataFrame:
    """Tool calls with their results, order and verdict.

    ``calls``: ``conv_col``, ``call_id`` string, ``turn``, ``name``, ``arguments`` (JSON
    text), ``after`` (ids it depends on, may be null); ``results``: ``conv_col``,
    ``call_id``, ``turn``, ``content``. A row per id of ``calls``: ``conv_col``,
    ``call_id``, ``turn``, ``name``, ``ready``, ``depth``, ``n_results``, ``errors``,
    ``line``. Other columns are left aside.

    Of repeated ids in a conversation the first by turn, then name and arguments,
    stands, with the error ``repeated id``; of several results the first by turn, then
    content, is linked. A null id links nothing and has the error ``no id``; null ids of a
    conversation are one row. Unknown dependencies are errors and don't count, those
    in a circle are ``circular`` and come last of their turn. Results of unknown calls
    are left out. A null conversation is a conversation. Empty tables give an empty
    result.
    """
    calls = calls.select(
        F.col(conv_col).alias("_conv"), F.col("call_id").alias("_call"), F.col("turn").cast("bigint").alias("turn"), "name", "arguments", F.array_sort(F.array_distinct(F.array_compact(F.coalesce("after", F.array().cast("array<string>"))))).alias("after")
    )
    first = F.min(F.struct("turn", "name", "arguments", "after")).alias("_first")
    calls = stage(calls.groupBy("_conv", "_call").agg(first, F.count(F.lit(1)).alias("_n")).select("_conv", "_call", "_first.*", "_n"), "calls")
    results = results.where(F.col("call_id").isNotNull()).groupBy(F.col(conv_col).alias("_c"), F.col("call_id").alias("_r"))
    results = results.agg(F.count(F.lit(1)).alias("n_results"), F.min(F.struct("turn", "content")).alias("_result"))
    linked = calls.join(results, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_call") == F.col("_r")), "left").drop("_c", "_r")

    known = calls.select(F.col("_conv").alias("_c"), F.col("_call").alias("_k"))
    on = calls.select("_conv", "_call", F.explode("after").alias("_on"))
    lost = on.join(known, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_on") == F.col("_k")), "left_anti")
    lost = lost.groupBy(F.col("_conv").alias("_c"), F.col("_call").alias("_l")).agg(F.array_sort(F.collect_set("_on")).alias("_lost"))
    linked = linked.join(lost, F.col("_conv").eqNullSafe(F.col("_c")) & F.col("_call").eqNullSafe(F.col("_l")), "left").drop("_c", "_l")

    order = _ordered(calls.where(F.col("_call").isNotNull()))
    order = order.select(F.col("_conv").alias("_c"), F.col("_call").alias("_o"), "ready", "depth", "cyclic")
    linked = linked.join(order, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_call") == F.col("_o")), "left")

    linked = linked.withColumn("_args", F.try_parse_json("arguments"))
    more = F.array(
        F.when(F.col("_call").isNull(), F.lit("no id")), F.when(F.col("_n") > 1, F.lit("repeated id")), F.when(F.col("cyclic"), F.lit("circular")), F.when(F.col("n_results").isNull(), F.lit("no result"))
    )
    lost = F.transform(F.coalesce("_lost", F.array().cast("array<string>")), lambda x: F.concat(F.lit("after: unknown "), x))
    line = F.to_json(F.struct(F.col("_args").alias("arguments"), F.col("_call").alias("id"), F.col("name"), F.col("_result.content").alias("result")), {"ignoreNullFields": "false"})
    return linked.select(
        F.col("_conv").alias(conv_col), F.col("_call").alias("call_id"), "turn", "name", F.coalesce("ready", "turn").alias("ready"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
        F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"), F.concat(_errors(tools), lost, F.array_compact(more)).alias("errors"), line.alias("line"),
    )
