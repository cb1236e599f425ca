"""The trace walk and structural differences over traces and values made of the driver's events, each compared with SQL that tells what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.functions import scores, text, values
from tracewise.operators import divergence, joins, scoring, structdiff, traces
from tracewise.plans.queries import query, t
from tracewise.schemas import EVENTS


def _s(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def _object(**parts: Column) -> Column:
    """A JSON object of numbers."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), _s(v)) for k, v in parts.items())), F.lit("}"))


def _call_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two traces for each event, by id modulo 4: a parameter of the call that differs, a variable that differs inside, none, a return value that differs.

    main calls f(v), which runs one line several times, then another; main goes on and returns.
    Parameters stand on the call's row only. In the first kind, main's last line differs for ids divisible by 8.
    """
    e = t(spark, sf_dir, "events").select("event_id", "user_id", F.explode(F.array(F.lit("buggy"), F.lit("patched"))).alias("side"))
    k, patched = F.col("event_id") % 4, (F.col("side") == "patched").cast("bigint")
    given = F.col("user_id") + F.when(k == 0, patched).otherwise(F.lit(0))
    seen = given + F.when(k == 1, 100 + 10 * patched).otherwise(F.lit(0))
    n = (F.col("event_id") % 3 + 1).cast("int")
    none, empty = F.lit(None).cast("string"), F.lit("{}")

    def row(at: Column, kind: str, function: str, line: int, statement: str, state: Column = empty, parameters: Column = empty, returned: Column = none) -> Column:
        return F.struct(
            at.cast("bigint").alias("event_id"), F.lit(kind).alias("event_type"), F.lit(line).alias("line_number"), F.lit(function).alias("function_name"), F.lit(statement).alias("statement"),
            state.alias("seen_variables"), parameters.alias("parameters"), returned.alias("return_value"),
        )

    loop = F.transform(F.sequence(F.lit(0), n - 1), lambda i: row(3 + i, "Line", "m:f", 7, "u += 1", F.lit('{"u":1}')))
    last = F.when(F.col("event_id") % 8 == 0, patched).otherwise(F.lit(0))
    rows = F.concat(
        F.array(row(F.lit(0), "Function", "m:main", 1, "main()"), row(F.lit(1), "Line", "m:main", 2, "x = 1", F.lit('{"x":1}')), row(F.lit(2), "Function", "m:f", 3, "f(v)", parameters=_object(v=given))),
        loop,
        F.array(
            row(3 + n, "Line", "m:f", 7, "u += 1", _object(u=F.lit(1), v=seen)), row(4 + n, "Return", "m:f", 8, "return v", _object(u=F.lit(1)), returned=_s(F.when(k == 3, patched).otherwise(F.lit(0)))),
            row(5 + n, "Line", "m:main", 4, "r = f(v)", _object(r=last)), row(6 + n, "Return", "m:main", 5, "return", returned=F.lit("0")),
        ),
    )
    out = e.select(F.lit("gold").alias("agent"), F.concat(F.lit("r__r-"), _s("event_id")).alias("instance_id"), F.lit(0).alias("test_id"), "side", F.explode(rows).alias("r")).select("agent", "instance_id", "test_id", "side", "r.*")
    return _whole(out.withColumn("filepath", F.when(F.col("side") == "buggy", "old.py").otherwise("new.py")))


def _whole(rows: DataFrame) -> DataFrame:
    """EVENTS and excluded, with nulls for what isn't given."""
    return rows.select(*(F.col(n) if n in rows.columns else F.lit(None).cast(kind).alias(n) for n, kind in (c.split(" ", 1) for c in EVENTS.split(", "))), F.lit(False).alias("excluded"))


@query("""WITH e AS (SELECT event_id AS id, user_id AS u, event_id % 4 AS k, event_id % 3 + 1 AS n, event_id % 4 IN (1, 3) OR event_id % 8 = 0 AS found FROM events)
SELECT 'r__r-' || id AS instance_id, CASE WHEN found THEN 'ok' ELSE 'empty' END AS status,
CASE WHEN found THEN CASE k WHEN 0 THEN 'm:main' ELSE 'm:f' END END AS function_name, CASE WHEN found THEN 'new.py' END AS file_path,
CASE WHEN found THEN CASE k WHEN 0 THEN 5 + n WHEN 1 THEN 3 + n ELSE 4 + n END END AS buggy_event_id,
CASE WHEN found THEN CASE k WHEN 0 THEN 'root[''seen_variables''][''r'']' WHEN 1 THEN 'root[''seen_variables''][''v'']' ELSE 'root[''return_value'']' END END AS diff_path,
CASE WHEN found THEN CASE k WHEN 0 THEN '{"r":0}' WHEN 1 THEN '{"v":' || (u + 100) || '}' ELSE '{"__return__":0}' END END AS buggy_variables,
CASE WHEN found THEN CASE k WHEN 0 THEN '{"r":1}' WHEN 1 THEN '{"v":' || (u + 110) || '}' ELSE '{"__return__":1}' END END AS patched_variables,
CASE WHEN found THEN CASE k WHEN 0 THEN '{}' ELSE '{"v":' || u || '}' END END AS buggy_function_param,
CASE WHEN found THEN CASE k WHEN 3 THEN 'after' ELSE 'before' END END AS before_or_after,
CASE WHEN found THEN CASE k WHEN 0 THEN 'r = f(v)' WHEN 1 THEN 'u += 1' ELSE 'The return statement in the provided function' END END AS location,
CASE WHEN found THEN CASE k WHEN 1 THEN n + 1 ELSE 1 END END AS buggy_line_count, CASE WHEN found THEN CASE k WHEN 1 THEN n + 1 ELSE 1 END END AS patched_line_count FROM e""")
def first_divergence_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk over calls whose parameters differ, with views and counts of the picked events."""
    found = divergence.first_divergence(_call_traces(spark, sf_dir), counts=True)
    return found.select("instance_id", "status", "function_name", "file_path", "buggy_event_id", "diff_path", "buggy_variables", "patched_variables", "buggy_function_param", "before_or_after", "location", "buggy_line_count", "patched_line_count")


@query("""WITH e AS (SELECT user_id, CAST(event_id % 4 AS INT) AS test_id, min(CASE WHEN event_id % 11 = 3 THEN event_id END) AS hit FROM events GROUP BY 1, 2)
SELECT 'r__r-' || user_id AS instance_id, coalesce(min(test_id) FILTER (hit IS NOT NULL), min(test_id)) AS test_id, CASE WHEN count(hit) > 0 THEN 'ok' ELSE 'empty' END AS status, arg_min(hit, test_id) FILTER (hit IS NOT NULL) AS buggy_event_id FROM e GROUP BY 1""")
def first_divergence_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tests a user, tried in turn until one diverges."""
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "props", F.explode(F.array(F.lit("buggy"), F.lit("patched"))).alias("side"))
    line = e.select(
        F.lit("m").alias("agent"), F.concat(F.lit("r__r-"), _s("user_id")).alias("instance_id"), (F.col("event_id") % 4).cast("int").alias("test_id"), "side", "event_id", F.lit("Line").alias("event_type"), F.lit("f.py").alias("filepath"), F.lit(1).alias("line_number"),
        F.lit("m:f").alias("function_name"), F.lit("x").alias("statement"), F.when((F.col("event_id") % 11 == 3) & (F.col("side") == "patched"), F.lit('{"k":-1}')).otherwise(F.col("props")).alias("seen_variables"),
    )
    calls = line.groupBy("agent", "instance_id", "test_id", "side").agg(F.lit(-1).cast("bigint").alias("event_id")).withColumns({"event_type": F.lit("Function"), "filepath": F.lit("f.py"), "line_number": F.lit(1), "function_name": F.lit("m:f"), "statement": F.lit("f()"), "seen_variables": F.lit("{}")})
    return divergence.first_useful_in_waves(_whole(line.unionByName(calls))).select("instance_id", "test_id", "status", "buggy_event_id")


@query("""WITH e AS (SELECT event_id AS id, event_id % 3 AS z FROM events)
SELECT id, 'iterable_item_added' AS kind, 'root[''x''][' || (id % 5) || ']' AS path, NULL AS old_value, '-1' AS new_value FROM e
UNION ALL SELECT id, 'iterable_item_removed', 'root[''vars_used''][2]', '"z' || z || '"', NULL FROM e
UNION ALL SELECT id, 'iterable_item_added', 'root[''vars_used''][0]', NULL, '"z' || (z + 1) || '"' FROM e
UNION ALL SELECT id, 'values_changed', 'root[''n''][''d''][1][''y'']', CAST(id AS VARCHAR), CAST(id + 1 AS VARCHAR) FROM e WHERE id % 2 = 1
UNION ALL SELECT id, 'type_changes', 'root[''w'']', '1', '1.0' FROM e WHERE id % 7 = 0""")
def json_diff_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values: an insertion somewhere in a list, a field whose order doesn't count, a change deep inside, a type."""
    e, i = t(spark, sf_dir, "events"), F.col("event_id")
    items = F.array(i, i + 1, i + 2, i + 3)
    pos = (i % 5).cast("int")
    inserted = F.concat(F.slice(items, F.lit(1), pos), F.array(F.lit(-1).cast("bigint")), F.slice(items, pos + 1, F.lit(4)))
    shown = lambda xs: F.concat(F.lit('"x":['), F.array_join(xs.cast("array<string>"), ","), F.lit("]"))

    def whole(xs: Column, used: Column, y: Column, w: Column) -> Column:
        return F.concat(F.lit("{"), shown(xs), F.lit(',"vars_used":['), used, F.lit('],"n":{"d":[[],{"y":'), _s(y), F.lit(',"s":[["a"],2]}]},"w":'), w, F.lit("}"))

    z = i % 3
    old = whole(items, F.concat(F.lit('"p","q","z'), _s(z), F.lit('","p"')), i, F.lit("1"))
    new = whole(inserted, F.concat(F.lit('"z'), _s(z + 1), F.lit('","q","p"')), i + i % 2, F.when(i % 7 == 0, "1.0").otherwise("1"))
    rows = e.select(i.alias("id"), old.alias("old"), new.alias("new"))
    return structdiff.diffs(rows, "old", "new", ["id"]).select("id", "kind", "path", "old_value", "new_value")


#: Differences made of line items: kinds and paths vary by line number, variables by supplier.
_DIFF_ROWS = """d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 4 AS k, l_suppkey % 5 AS v, l_partkey % 3 AS a,
CASE l_linenumber % 4 WHEN 0 THEN 'values_changed' WHEN 1 THEN 'dictionary_item_added' WHEN 2 THEN 'type_changes' ELSE 'values_changed' END AS kind,
CASE l_linenumber % 4 WHEN 3 THEN 'root[''return_value''][''x' || (l_suppkey % 5) || ''']' ELSE 'root[''seen_variables''][''x' || (l_suppkey % 5) || ''']' || CASE l_partkey % 3 WHEN 0 THEN '[''_hash'']' WHEN 1 THEN '[''_my_cache''][2]' ELSE '[''unit''][''b'']' END END AS path FROM lineitem)"""


def _diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v, a = F.col("l_linenumber") % 4, F.concat(F.lit("x"), _s(F.col("l_suppkey") % 5)), F.col("l_partkey") % 3
    below = F.when(a == 0, "['_hash']").when(a == 1, "['_my_cache'][2]").otherwise("['unit']['b']")
    path = F.when(k == 3, F.concat(F.lit("root['return_value']['"), v, F.lit("']"))).otherwise(F.concat(F.lit("root['seen_variables']['"), v, F.lit("']"), below))
    return t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(k == 1, "dictionary_item_added").when(k == 2, "type_changes").otherwise("values_changed").alias("kind"), path.alias("path"),
        F.when(a == 0, '"one two three"').otherwise('"one two three four"').alias("old_value"), F.lit('"short"').alias("new_value"), F.lit("str").alias("old_type"), F.lit("str").alias("new_type"),
        F.lit('{"x1":1,"x3":{}}').alias("seen_variables"), F.when(v != "x4", F.array(v)).otherwise(F.array().cast("array<string>")).alias("vars_used"), F.when(v == "x2", F.array(F.lit("x0"))).otherwise(F.array().cast("array<string>")).alias("vars_defined"),
    )


@query(f"""WITH {_DIFF_ROWS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN k = 3 THEN 1 ELSE CASE a WHEN 0 THEN 2 ELSE 3 END END <= 2 AS shallow,
kind <> 'dictionary_item_added' OR v NOT IN (1, 3) AS unseen, k = 3 OR a <> 1 AS not_cached, k <> 3 AS first_key, k = 3 OR a <> 2 AS not_ignored, true AS on_line, v <> 4 AS used,
NOT (kind = 'values_changed' AND a <> 0) AS not_docstring, k = 3 OR a <> 0 AS not_hash FROM d""")
def structural_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter over differences says of each row."""
    rules = {
        "shallow": structdiff.shallow(2), "unseen": structdiff.unseen_additions(), "not_cached": structdiff.not_cached(), "first_key": structdiff.first_key_not("parameter_sources", "return_value", "caller_name"),
        "not_ignored": structdiff.no_ignored_key(), "on_line": structdiff.on_this_line(), "used": structdiff.used_here(), "not_docstring": structdiff.not_docstring(), "not_hash": structdiff.not_hash(),
    }
    return _diff_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(c.alias(n) for n, c in rules.items()))


@query(f"""WITH {_DIFF_ROWS}, f AS (SELECT *, CASE WHEN kind = 'values_changed' AND a <> 0 THEN 0 WHEN k <> 3 AND a = 1 THEN 1 WHEN k <> 3 AND a = 0 THEN 2 WHEN k = 3 THEN 3 WHEN a = 2 AND k <> 3 AND l_linenumber > 5 THEN 4 ELSE 5 END AS fails FROM d),
n AS (SELECT l_orderkey, s AS stage, count(*) FILTER (fails >= s) AS n FROM f, range(0, 6) x(s) GROUP BY 1, 2), stop AS (SELECT l_orderkey, coalesce(min(stage) FILTER (n <= 1), 5) AS stop FROM n GROUP BY 1),
kept AS (SELECT f.* FROM f JOIN stop USING (l_orderkey) WHERE fails >= stop), c AS (SELECT l_orderkey, count(*) AS n, bool_or(kind = 'type_changes') AS t FROM kept GROUP BY 1)
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_changes, string_agg(path || kind, ',' ORDER BY path || kind) AS paths FROM kept JOIN c USING (l_orderkey) WHERE n <= 1 OR NOT t OR kind = 'type_changes' GROUP BY 1""")
def filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters one after the other until an order has one difference at most, then only changes of type where there is one; what is left, counted."""
    stages = [structdiff.not_docstring, structdiff.not_cached, structdiff.not_hash, lambda: structdiff.first_key_not("return_value"), lambda: structdiff.no_ignored_key() | (F.col("l_linenumber") <= 5)]
    left = structdiff.only_type_changes(structdiff.cascade(_diff_rows(spark, sf_dir), ["l_orderkey"], stages), ["l_orderkey"])
    names = left.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat("path", "kind"))), ",").alias("paths"))
    return structdiff.change_count(left, ["l_orderkey"]).join(names, "l_orderkey")


@query("""WITH e AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_custkey % 5 AS x FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN false WHEN 1 THEN x IN (0, 1) WHEN 2 THEN x IN (0, 1) ELSE true END AS changed, x = 0 AS missing_name, x = 1 AS missing_attribute FROM e""")
def changed_truth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an expression changed, by values and exceptions of both sides."""
    k, x = F.col("o_orderkey") % 4, F.col("o_custkey") % 5
    failed = F.struct(
        F.when(x == 2, "serialization").otherwise("evaluation").alias("stage"), F.when(x.isin(0, 2), "NameError").when(x.isin(1, 3), "AttributeError").otherwise("KeyError").alias("type"),
        F.when(x == 1, "'NoneType' object has no attribute 'y'").otherwise("no such thing").alias("message"),
    )
    none = F.lit(None).cast(joins.EXCEPTION)
    old, new = F.when(k != 1, "1"), F.when(k == 0, "1").when(k != 2, "2")
    changed = scores.changed(old, F.when(k == 1, failed).otherwise(none), new, F.when(k == 2, failed).otherwise(none))
    return t(spark, sf_dir, "orders").select("o_orderkey", changed.alias("changed"), scores.missing_name(failed).alias("missing_name"), scores.missing_attribute(failed).alias("missing_attribute"))


@query("""WITH e AS (SELECT event_id, ['Line', 'Return', 'Exception'][1 + event_id % 3] AS a, ['Line', 'Return', 'Exception'][1 + event_id // 3 % 3] AS b, event_type AS s, props FROM events)
SELECT event_id, CASE WHEN a = 'Line' THEN s ELSE 'The return statement in the provided function' END AS location, CASE WHEN a = 'Line' AND b = 'Line' THEN 'before' ELSE 'after' END AS moment,
CASE WHEN event_id % 2 = 0 OR a = b THEN s ELSE '# Before Patch:' || chr(10) || s || CASE a WHEN 'Exception' THEN ' (crashed here)' ELSE ' (normally executed)' END || chr(10) || chr(10) || '# After Patch:' || chr(10) || s || '2' || CASE b WHEN 'Exception' THEN ' (crashed here)' ELSE ' (normally executed)' END END AS block,
CASE WHEN event_id % 2 = 0 THEN true ELSE a = b END AS same_outcome, CAST(json_extract(props, '$.k') AS VARCHAR) AS view FROM e""")
def divergence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where and when a divergence shows, its statements, and whether two outcomes are the same."""
    i = F.col("event_id")
    kinds = F.array(F.lit("Line"), F.lit("Return"), F.lit("Exception"))
    a, b = F.get(kinds, (i % 3).cast("int")), F.get(kinds, (F.floor(i / 3) % 3).cast("int"))
    other = F.when((i % 2 == 0) | (a == b), F.col("event_type")).otherwise(F.concat("event_type", F.lit("2")))
    none = F.lit(None).cast("string")
    same = F.when(i % 2 == 0, traces.same_outcome(a, none, a, none)).otherwise(traces.same_outcome(none, a, none, b))
    return t(spark, sf_dir, "events").select("event_id", scores.location(a, F.col("event_type")).alias("location"), scores.moment(a, b).alias("moment"), text.statement_block(F.col("event_type"), other, a, b).alias("block"), same.alias("same_outcome"), structdiff.variable_view(F.col("props"), F.lit("k")).alias("view"))


@query("""SELECT event_id, '{"a":{"b":{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '},"c":[1,2,{"py/object":"builtins.dict"}],"l":[{"__dir__":["n"],"py/object":"C"},{"len":2,"py/object":"builtins.list"}]}}' AS pruned,
'{''k'': ' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' || chr(10) AS printed FROM events""")
def pruned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values cut at a depth, with stubs for what lies below, and as they are printed."""
    nested = F.concat(F.lit('{"a": {"b": '), F.col("props"), F.lit(', "c": [1, 2, {"d": 1}], "l": [{"py/object": "C", "n": 1}, [3, 4]]}}'))
    return t(spark, sf_dir, "events").select("event_id", values.simplified(nested, 2).alias("pruned"), values.printed(F.col("props")).alias("printed"))


@query("""SELECT doc_id, lang || '_1776_' || doc_id AS image, '-p plug --trace-functions=' || CASE WHEN doc_id % 2 = 0 THEN lang || ',' || source ELSE 'none' END AS flags, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'B:' || lang || chr(10) || chr(10) || 'A:' || source END AS block FROM documents""")
def command_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image names, tracer flags and collapsed blocks."""
    even, third = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    names = F.when(even, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    block = text.collapsed(F.col("lang"), F.when(third, F.col("lang")).otherwise(F.col("source")), "B:", "A:")
    return t(spark, sf_dir, "documents").select("doc_id", text.image_name(F.concat("lang", F.lit("__"), _s("doc_id"))).alias("image"), text.tracer_flags(names, F.lit("plug")).alias("flags"), block.alias("block"))


@query("""SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def predictions_without_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.unmatched(t(spark, sf_dir, "documents").select("doc_id"), t(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


@query("""WITH o AS (SELECT o_custkey, o_orderpriority AS p, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT x.o_custkey, x.p AS patch, CASE WHEN x.s = 'F' THEN '' ELSE x.p END AS model_patch FROM o x WHERE k = 1""")
def patch_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first order takes its patch, where there is one."""
    first = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by(F.struct("o_orderpriority", "o_orderstatus"), "o_orderkey").alias("o")).select("o_custkey", "o.*")
    patches = first.where("o_orderstatus <> 'F'").select("o_custkey", F.col("o_orderpriority").alias("model_patch"))
    return joins.with_patch(first.select("o_custkey", F.col("o_orderpriority").alias("patch")), patches, ["o_custkey"])
