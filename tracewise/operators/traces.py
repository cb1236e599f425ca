"""Call structure of ordered traces, by windows over (agent, instance, test, side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.schemas import TRACE_KEY


def _trace(key: list[str]) -> Window:
    return Window.partitionBy(*key).orderBy("event_id")


def with_depth(events: DataFrame, key: list[str] | None = None, opens: Column | None = None, closes: Column | None = None) -> DataFrame:
    """Adds depth: calls open before an event. A call belongs to its caller, a return to what it ends.

    An exception ends its block only if the next event is a return, which does the closing.
    """
    key = key or TRACE_KEY
    opens = F.col("event_type") == "Function" if opens is None else opens
    closes = F.col("event_type") == "Return" if closes is None else closes
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    before = _trace(key).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0)).cast("int"))


def with_block(events: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Adds depth, block_id (the call event that opened an event's block; -1 at the top) and raises."""
    key = key or TRACE_KEY
    deep = with_depth(events, key)
    # an event's owner is the last call that opened its depth; a call opens the depth below its own
    parts = deep.withColumn("_level", F.col("depth"))
    calls = parts.where("event_type = 'Function'").select(*key, (F.col("depth") + 1).alias("_level"), "event_id", F.col("event_id").alias("_call"))
    marks = parts.select(*key, "_level", "event_id").withColumn("_call", F.lit(None).cast("bigint")).unionByName(calls)
    order = Window.partitionBy(*key, "_level").orderBy("event_id", F.col("_call").isNotNull())
    owner = marks.withColumn("block_id", F.last("_call", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_call").isNull()).select(*key, "event_id", F.coalesce("block_id", F.lit(-1)).alias("block_id"))
    follows = F.lead("event_type").over(_trace(key))
    raises = (F.col("event_type") == "Exception") & (F.coalesce(follows, F.lit("")) == "Return")
    return deep.withColumn("raises", raises).join(owner, [*key, "event_id"])


def blocks(events: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row per call: parent, name, depth, parameters, return value, exception, and where it returns."""
    key = key or TRACE_KEY
    owned = events if "block_id" in events.columns else with_block(events, key)
    calls = owned.where("event_type = 'Function'").select(*key, F.col("event_id").alias("block"), F.col("block_id").alias("parent_id"), F.col("function_name").alias("name"), (F.col("depth") + 1).alias("block_depth"), "parameters")
    ends = owned.where("block_id >= 0").groupBy(*key, F.col("block_id").alias("block")).agg(
        F.count("*").alias("n_events"),
        F.max_by(F.when(F.col("event_type") == "Return", F.col("return_value")), F.when(F.col("event_type") == "Return", F.col("event_id"))).alias("return_value"),
        F.max_by(F.when(F.col("raises"), F.struct(F.col("exception_type").alias("type"), F.col("exception_value").alias("message"))), F.when(F.col("raises"), F.col("event_id"))).alias("exception"),
        F.max(F.when(F.col("event_type") == "Return", F.col("event_id"))).alias("_returns"),
        F.max(F.when(F.col("raises"), F.col("event_id"))).alias("_raises"),
    )
    out = calls.join(ends, [*key, "block"], "left")
    stopped = F.col("return_value").isNotNull() & (F.col("exception.type") == "StopIteration")
    clean = F.when(~F.coalesce(stopped, F.lit(False)), F.col("exception"))
    return out.withColumn("exception", clean).withColumn("return_event", F.when(F.col("exception").isNotNull(), F.col("_raises")).otherwise(F.col("_returns"))).drop("_returns", "_raises")


def entry(calls: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The first top-level call of each trace."""
    key = key or TRACE_KEY
    return calls.where("parent_id = -1").groupBy(*key).agg(F.min("block").alias("entry"))


def occurrence(events: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Adds event_count: events other than calls on the same line of the same function so far, itself included."""
    key = key or TRACE_KEY
    same = Window.partitionBy(*key, "filepath", "line_number", "function_name").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("event_count", F.sum(F.when(F.col("event_type") != "Function", 1).otherwise(0)).over(same))


def on_patch(events: DataFrame, lines: DataFrame, on: list[str]) -> DataFrame:
    """Adds excluded: whether an event's line is one of the patch's. lines: on + path, line; distinct."""
    marks = lines.select(*on, F.col("path").alias("filepath"), F.col("line").alias("line_number"), F.lit(True).alias("_hit")).distinct()
    return events.join(marks, [*on, "filepath", "line_number"], "left").withColumn("excluded", F.coalesce("_hit", F.lit(False))).drop("_hit")


def patched_functions(marked: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Functions that have an event on a line of the patch."""
    return marked.where("excluded").select(*(key or TRACE_KEY), "function_name").distinct()


def visible(events: DataFrame, calls: DataFrame, key: list[str] | None = None) -> DataFrame:
    """A block's events as they are walked: none on patch lines but calls, and of a patched block only from its return on. Adds position."""
    key = key or TRACE_KEY
    ends = calls.select(*key, F.col("block").alias("block_id"), "return_event", "is_pmf")
    kept = events.join(ends, [*key, "block_id"], "left").where(~(F.col("excluded") & (F.col("event_type") == "Line")))
    kept = kept.where(~F.coalesce("is_pmf", F.lit(False)) | (F.col("event_id") >= F.col("return_event")))
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(*key, "block_id").orderBy("event_id")))


def same_outcome(a_value: Column, a_exception: Column, b_value: Column, b_exception: Column) -> Column:
    """Whether two blocks returned equal canonical values, or raised the same."""
    return F.when(a_exception.isNotNull() | b_exception.isNotNull(), a_exception.eqNullSafe(b_exception)).otherwise(a_value.eqNullSafe(b_value))


def functions_by_target(stacks: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Functions on the stacks of the wanted targets, sorted: on, functions."""
    wanted = stacks.join(targets.select(*on, "target").distinct(), [*on, "target"], "left_semi")
    names = wanted.select(*on, F.explode("stack").alias("f")).select(*on, F.concat_ws(":", F.get("f", F.lit(0)), F.get("f", F.lit(1))).alias("name"))
    return names.groupBy(*on).agg(F.array_sort(F.collect_set("name")).alias("functions"))


def innermost(points: DataFrame, ranges: DataFrame, on: list[str], at: str, start: str, end: str, keep: list[str]) -> DataFrame:
    """The range with the largest start that holds each point; points in no range go.

    Ranges meet points by buckets of the axis, no pair outside a bucket is formed. A range
    lies in buckets of the first power of two that isn't below its length, so in two of them
    at most; a point is looked up once for each power that occurs among the ranges of its
    keys. Repeated points are looked up once and all returned; ranges that hold nothing go.
    """
    widths = ranges.where(F.col(start) <= F.col(end)).withColumn("_k", F.length(F.bin(F.col(end) - F.col(start))))

    def bucket(x: str) -> Column:
        return F.call_function("shiftright", F.col(x).cast("bigint"), F.col("_k"))

    spans = widths.withColumn("_b", F.explode(F.array_distinct(F.array(bucket(start), bucket(end))))).select(*on, "_k", "_b", *{start, end, *keep} - set(on))
    powers = widths.groupBy(*on).agg(F.collect_set("_k").alias("_k"))  # 64 at most
    asked = points.select(*on, at).distinct().join(powers, on).withColumn("_k", F.explode("_k"))
    met = asked.withColumn("_b", bucket(at)).join(spans, [*on, "_k", "_b"]).where((F.col(start) <= F.col(at)) & (F.col(end) >= F.col(at)))
    found = met.groupBy(*on, at).agg(F.max_by(F.struct(*keep), F.struct(F.col(start), -F.col(end))).alias("_r"))
    return points.join(found, [*on, at]).select(*points.columns, "_r.*")


def first_difference(a: DataFrame, b: DataFrame, key: list[str], order: str, compared: list[str]) -> DataFrame:
    """Per key, the first position at which two ordered streams differ in a compared column, or at which one ends."""
    w = Window.partitionBy(*key).orderBy(order)
    x = a.select(*key, F.row_number().over(w).alias("position"), F.struct(*compared).alias("x"))
    y = b.select(*key, F.row_number().over(w).alias("position"), F.struct(*compared).alias("y"))
    both = x.join(y, [*key, "position"], "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.groupBy(*key).agg(F.min("position").alias("position"))
