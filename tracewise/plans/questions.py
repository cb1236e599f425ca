"""Questions from end to end over the driver's tables: outcomes of runs, options and letters, prompts, answers of a provider and their scores, each compared with SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewise.functions import source, text
from tracewise.operators import joins, outcomes, patches, structdiff, traces
from tracewise.plans import jobs
from tracewise.plans.queries import _trace_events, query, t
from tracewise.sources import keyed, sinks
from tracewise.sources.scratch import new_path, stored

_OUTCOMES = """r AS (SELECT o_orderkey, o_orderkey % 9 + 1 AS b, o_custkey % 4 AS f, o_orderkey % 6 AS z FROM orders),
o AS (SELECT o_orderkey, z, 'The test failed at line ' || b || ' with exception: ValueError.' AS bo, CASE WHEN f = 0 THEN 'The test passed.' ELSE 'The test failed at line ' || (f + 3) || ' with exception: Exception.' END AS af, b = f + 3 AND f <> 0 AS same FROM r),
s AS (SELECT o_orderkey, z, af, CASE WHEN same THEN af ELSE bo END AS bf FROM o),
c AS (SELECT o_orderkey, bf, af, list_distinct(['The test passed.', af, bf]) AS seeds, list_transform(range(z, z + 4), lambda k: 'The test failed at line ' || (k + 20) || ' with exception: E' || k || '.') AS extra FROM s),
q AS (SELECT o_orderkey, bf, af, list_sort(list_concat(list_slice(list_concat(list_concat(['The test passed.'], list_filter(list_distinct([af, bf]), lambda x: x <> 'The test passed.')), extra), 1, 4), ['The question cannot be answered based on the explanation alone.'])) AS choices,
len(seeds) AS n, extra, list_filter([af, bf], lambda x: x <> 'The test passed.') AS rest FROM c)"""


@query(f"""WITH {_OUTCOMES}, f AS (SELECT o_orderkey, bf, af, list_sort(list_concat(list_slice(list_concat(CASE WHEN len(rest) = 2 AND rest[1] = rest[2] THEN ['The test passed.', rest[1]] ELSE list_concat(['The test passed.'], rest) END, extra), 1, 4), ['The question cannot be answered based on the explanation alone.'])) AS choices FROM q)
SELECT CAST(o_orderkey AS VARCHAR) AS instance_id, '1: def prop_' || o_orderkey || '(x):' || chr(10) || '2:     return x' AS test_content, array_to_string(choices, '|') AS choices,
substr('abcde', list_position(choices, bf)::INT, 1) || '|' || substr('abcde', list_position(choices, af)::INT, 1) AS pair FROM f""")
def outcome_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, tests and reports of further outcomes, read from files, become questions, which are written as files and read back."""
    orders, path = t(spark, sf_dir, "orders"), new_path(spark, "outcomes")
    key = F.col("o_orderkey").cast("string").alias("instance_id")
    place = 'File "/testbed/reproducer.py", line '
    b, f, z = F.col("o_orderkey") % 9 + 1, F.col("o_custkey") % 4, F.col("o_orderkey") % 6
    runs = orders.select(
        key, F.lit(1).alias("buggy_returncode"), f.alias("fixed_returncode"), F.concat(F.lit(place), b.cast("string"), F.lit("\n  | ValueError: bad value\n")).alias("buggy_stdout"),
        F.concat(F.lit(place), (f + 3).cast("string"), F.lit("\n")).alias("fixed_stdout"),
    )
    runs.write.json(f"{path}/runs")
    code = F.concat(F.lit("def prop_"), F.col("o_orderkey").cast("string"), F.lit("(x):\n    return x"))
    sinks.write_json_array(orders.select(key, code.alias("pbt")), f"{path}/tests", "instance_id")
    reports = F.transform(F.sequence(z, z + 3), lambda k: F.struct((k + 20).cast("int").alias("lineno"), F.concat(F.lit("E"), k.cast("string")).alias("exception_type")))
    orders.select(key, F.to_json(F.struct(reports.alias("info_list"))).alias("report")).write.json(f"{path}/reports")

    seeds = outcomes.seeded(keyed.json_lines(spark, f"{path}/runs", "instance_id string, buggy_returncode int, fixed_returncode int, buggy_stdout string, fixed_stdout string", suffix="*.json"))
    tests = keyed.property_tests(spark, f"{path}/tests").withColumnRenamed("pbt", "test_content")
    read = keyed.json_lines(spark, f"{path}/reports", "instance_id string, report string", suffix="*.json")
    extra = read.select("instance_id", F.transform(outcomes.error_infos(F.col("report")), lambda e: outcomes.option(e["lineno"].cast("string"), e["exception_type"])).alias("extra"))
    # both files are dealt out by sampled ranges, so each would form the questions twice
    asked = stored(outcomes.questions(seeds.join(tests, "instance_id"), extra, ["instance_id"]), "asked")
    sinks.write_keyed_json(asked.select("instance_id", "test_content", "choices"), f"{path}/context", ["instance_id"])
    sinks.write_keyed_json(asked.select("instance_id", "before_answer", "after_answer"), f"{path}/truths", ["instance_id"])
    context = keyed.contexts(spark, f"{path}/context", "struct<test_content: string, choices: array<string>>")
    truth = keyed.ground_truths(spark, f"{path}/truths").select("instance_id", F.array_join("pair", "|").alias("pair"))
    return context.join(truth, "instance_id").select("instance_id", "test_content", F.array_join("choices", "|").alias("choices"), "pair")


@query("""SELECT doc_id, CAST(k AS INT) AS trial, CASE WHEN chr(CAST(97 + (doc_id + k) % 3 AS INT)) = chr(CAST(97 + doc_id % 3 AS INT)) THEN 1.0 ELSE 0.0 END::DOUBLE AS score, row_number() OVER (PARTITION BY k ORDER BY doc_id) - 1 AS position
FROM documents, range(0, 3) x(k)""")
def answers_and_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider that answers in a wrong form first: asked again, read by the answer's schema, scored, in the order of the documents."""
    docs = t(spark, sf_dir, "documents").select("doc_id", F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("choices"), "lang")
    none = spark.createDataFrame([], "doc_id bigint, explanations array<string>")
    asked = jobs.prompts(jobs.TASKS["local_intent"], docs.withColumn("id", F.col("doc_id").cast("string")), none, ["doc_id"], ["id", "lang"])

    def provider(model: str, prompt: str, n: int) -> tuple[list[str], int, int]:
        number = int(prompt.partition("Id:\n")[2].partition("\n")[0])
        right = [json.dumps({"answer": ["abc"[(number + k) % 3]]}) for k in range(3)]
        return (right[:1] + ["[]"] if n == 3 else right[3 - n :]), 1, len(prompt)

    predictions, _ = jobs.generate(asked, provider, "m", ["doc_id"], 3, order=["doc_id"], schema="choice", wait=0.0)
    truths = docs.select("doc_id", F.array(F.chr(97 + F.col("doc_id") % 3)).alias("answer"))
    found, _ = jobs.evaluate(jobs.TASKS["local_intent"], predictions, truths, ["doc_id"])
    return found.join(predictions.select("doc_id", "position"), "doc_id").select("doc_id", "trial", "score", "position")


@query("""SELECT doc_id, doc_id % 4 IN (0, 3) AS valid, 'Function:' || chr(10) || 'f' || chr(10) || chr(10) || 'Line:' || chr(10) || lang || chr(10) || chr(10) || 'Variables Before:' || chr(10) || source || chr(10) || chr(10) || 'Task:' || chr(10) || 'Give 10 expressions that change at this line and 20 that don''t.' AS prompt FROM documents""")
def probe_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that ask for expressions, and which answers are one."""
    k, none = F.col("doc_id") % 4, F.lit(None).cast("string")
    answer = F.when(k == 0, F.concat("lang", F.lit(" + 1"))).when(k == 1, "'text'").when(k == 2, F.concat("lang", F.lit(" = 1"))).otherwise(F.concat(F.lit("  f(x)["), F.col("doc_id").cast("string"), F.lit("] ")))
    prompt = text.probe_prompt(F.lit("f"), F.col("lang"), none, F.col("source"), none, 10, 20)
    return t(spark, sf_dir, "documents").select("doc_id", source.valid_expression(answer).alias("valid"), prompt.alias("prompt"))


@query("""SELECT l_orderkey, count(*) FILTER (l_linenumber % 3 <> 0) AS kept, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber % 3 <> 0) > 0""")
def lines_without_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touched lines, less those of files that are tests by their repository's rule."""
    k = F.col("l_linenumber") % 3
    owner = F.when(F.col("l_orderkey") % 2 == 0, "django").otherwise("pytest-dev")
    path = F.when(k != 0, "src/tests/a.py").when(F.col("l_orderkey") % 2 == 0, "tests/b/c.py").otherwise("testing/test_c.py")
    lines = t(spark, sf_dir, "lineitem").select(F.concat(owner, F.lit("__x-"), F.col("l_orderkey").cast("string")).alias("instance_id"), "l_orderkey", path.alias("path"))
    kept = patches.without_tests(lines).groupBy("l_orderkey").agg(F.count("*").alias("kept"))
    return kept.join(lines.groupBy("l_orderkey").agg(F.count("*").alias("n")), "l_orderkey")


@query("""WITH e AS (SELECT event_id, ['Line', 'Return', 'Exception'][1 + event_id % 3] AS a, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_id % 2 = 0 AS back, event_type FROM events)
SELECT event_id, CASE a WHEN 'Line' THEN CASE WHEN event_id % 5 = 0 THEN '' ELSE 'k=' || k END WHEN 'Return' THEN '__return__=' || coalesce(CASE WHEN back THEN k END, 'null')
ELSE '__exception__=["' || event_type || '",null]' || CASE WHEN back THEN ',__return__=' || k ELSE '' END END AS view FROM e""")
def variable_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an event shows of a difference: variables, what came back, or what was raised."""
    i = F.col("event_id")
    kind = F.get(F.array(F.lit("Line"), F.lit("Return"), F.lit("Exception")), (i % 3).cast("int"))
    none = F.lit(None).cast("string")
    back = F.when(i % 2 == 0, F.get_json_object("props", "$.k"))
    view = structdiff.view_of(kind, F.col("props"), F.array(F.when(i % 5 == 0, "other").otherwise("k")), back, F.when(kind == "Exception", F.col("event_type")).otherwise(none), none)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(view)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ",")
    return t(spark, sf_dir, "events").select("event_id", shown.alias("view"))


@query("""WITH d AS (SELECT l_orderkey, 'root[''x' || l_suppkey || ''']' || CASE l_linenumber % 2 WHEN 0 THEN '[''y'']' ELSE '' END AS path, 1 + (l_linenumber % 2 = 0)::INT AS depth FROM lineitem)
SELECT l_orderkey, path FROM d QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY depth, md5('42' || chr(31) || path), path) = 1""")
def shallowest_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the shallowest differences of each order, by a digest."""
    path = F.concat(F.lit("root['x"), F.col("l_suppkey").cast("string"), F.lit("']"), F.when(F.col("l_linenumber") % 2 == 0, "['y']").otherwise(""))
    return structdiff.shallowest(t(spark, sf_dir, "lineitem").select("l_orderkey", path.alias("path")), ["l_orderkey"]).select("l_orderkey", "path")


@query("""WITH e AS (SELECT user_id, event_id, event_id % 5 AS k, event_id % 13 = 0 AS x, event_type, coalesce(sum(CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM events),
o AS (SELECT x.user_id, x.event_id, x.k, x.x, x.event_type, coalesce(max(y.event_id), -1) AS owner FROM e x LEFT JOIN e y ON x.user_id = y.user_id AND y.k = 0 AND y.depth + 1 = x.depth AND y.event_id < x.event_id GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT user_id, owner, max(event_id) FILTER (k = 1) AS r FROM o WHERE owner >= 0 GROUP BY 1, 2),
v AS (SELECT o.user_id, o.event_id, o.owner FROM o LEFT JOIN o c ON c.user_id = o.user_id AND c.event_id = o.owner LEFT JOIN b ON b.user_id = o.user_id AND b.owner = o.owner
WHERE NOT (o.x AND o.k NOT IN (0, 1)) AND (c.event_type IS NULL OR c.event_type <> 'click' OR o.event_id >= b.r))
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id, owner ORDER BY event_id) AS INT) AS position FROM v""")
def visible_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a block as they are walked: without lines of the patch, and of a patched block only from its return on."""
    events = traces.with_block(_trace_events(spark, sf_dir)).withColumn("excluded", F.col("event_id") % 13 == 0)
    calls = traces.blocks(events).withColumn("is_pmf", F.col("name") == "click")
    return traces.visible(events, calls).select("user_id", "event_id", F.col("position").cast("int").alias("position"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'null,null' ELSE o_orderstatus || ',' || o_orderstatus END AS broadcasted, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE '' END AS given, o_orderpriority || '|' || o_orderstatus || '|' || o_orderstatus AS bag FROM orders""")
def operands_and_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar at every place, variables that are parameters too, and pools put together."""
    scalar = joins.as_list(F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderstatus")), F.lit(2))
    given = joins.from_parameters(F.array("o_orderstatus", F.lit("q")), F.when(F.col("o_custkey") % 2 == 0, F.array("o_orderstatus", "o_orderpriority")).otherwise(F.array("o_orderpriority")))
    bag = F.concat(F.array("o_orderpriority"), F.array("o_orderstatus", "o_orderstatus"))
    return t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(scalar, ",", "null").alias("broadcasted"), F.array_join(given, ",").alias("given"), F.array_join(bag, "|").alias("bag"))


@query("""SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS place FROM customer""")
def sorted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written in an order: their place within files and from file to file is that of the order."""
    path = new_path(spark, "sorted")
    sinks.write_sorted(t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, "c_mktsegment", "c_custkey")
    rows = keyed.json_lines(spark, path, "c_custkey bigint, c_name string", suffix="*.json").select("*", F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("m"))
    before = rows.groupBy("f").agg(F.count("*").alias("n")).select("f", F.coalesce(F.sum("n").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("f").orderBy("m")) - 1
    return rows.withColumn("i", inside).join(F.broadcast(before), "f").select("c_custkey", "c_name", (F.col("start") + F.col("i")).alias("place"))
