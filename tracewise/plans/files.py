"""Readers and writers over the driver's tables: each query writes its table to the shared folder in a file format, reads it back, and is compared with SQL over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.operators import joins, ordering, patches
from tracewise.plans.queries import query, t
from tracewise.sources import keyed, sinks
from tracewise.sources.scratch import new_path


def _id(name: str) -> Column:
    return F.col(name).cast("string").alias("instance_id")


@query("""SELECT CAST(doc_id AS VARCHAR) AS instance_id, CASE doc_id % 3 WHEN 0 THEN chr(CAST(97 + doc_id % 5 AS INT)) || ',z' WHEN 1 THEN chr(CAST(97 + doc_id % 5 AS INT)) END AS answer,
CASE doc_id % 3 WHEN 2 THEN lang || '|' || chr(CAST(97 + doc_id % 5 AS INT)) END AS pair FROM documents""")
def read_ground_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truths as lists, as letters and as pairs."""
    docs, k = t(spark, sf_dir, "documents"), F.col("doc_id") % 3
    one = F.chr(97 + F.col("doc_id") % 5)
    value = (
        F.when(k == 0, F.to_json(F.struct(F.array(one, F.lit("z")).alias("answer"))))
        .when(k == 1, F.to_json(F.struct(one.alias("answer"))))
        .otherwise(F.to_json(F.struct(F.col("lang").alias("before_answer"), one.alias("after_answer"))))
    )
    path = new_path(spark, "truths")
    sinks.write_keyed_json(docs.select(_id("doc_id"), "doc_id", "lang"), path, ["instance_id"], value)
    return keyed.ground_truths(spark, path).select("instance_id", F.array_join("answer", ",").alias("answer"), F.array_join("pair", "|").alias("pair"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS instance_id, o_orderstatus AS status, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS priority, o_custkey AS customer FROM orders")
def read_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "contexts")
    rows = t(spark, sf_dir, "orders").select(_id("o_orderkey"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("priority"), F.col("o_custkey").alias("customer"))
    sinks.write_keyed_json(rows, path, ["instance_id"])
    return keyed.contexts(spark, path, "struct<status: string, priority: string, customer: bigint>")


@query("""SELECT 'en' AS agent, CAST(doc_id AS VARCHAR) AS instance_id, source || '|' || CAST(n_chars AS VARCHAR) AS explanations FROM documents WHERE lang = 'en'""")
def read_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations of one agent out of a file of all."""
    path = new_path(spark, "explanations")
    rows = t(spark, sf_dir, "documents").select(F.col("lang").alias("agent"), _id("doc_id"), F.array("source", F.col("n_chars").cast("string")).alias("e"))
    sinks.write_keyed_json(rows, path, ["agent", "instance_id"], F.to_json("e"))
    return keyed.explanations(spark, path, "en").select("agent", "instance_id", F.array_join("explanations", "|").alias("explanations"))


@query("SELECT CAST(page_id AS VARCHAR) AS instance_id, CASE WHEN page_id % 3 <> 0 THEN html END AS model_patch FROM pages")
def read_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages as patches; empty patches are null."""
    path = new_path(spark, "patches")
    rows = t(spark, sf_dir, "pages").select(_id("page_id"), F.struct(_id("page_id"), F.when(F.col("page_id") % 3 != 0, F.col("html")).otherwise("").alias("model_patch")).alias("v"))
    sinks.write_keyed_json(rows, path, ["instance_id"], F.to_json("v"))
    return keyed.patches(spark, path)


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS instance_id, max(l_linenumber)::VARCHAR || '-' || max_by(f, l_linenumber) AS model_patch FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey""")
def read_prediction_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several records of an id under different keys: the last one counts."""
    path = new_path(spark, "predictions")
    line = F.col("l_linenumber").cast("string")
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"))
    own = rows.select(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.lpad(line, 4, "0")).alias("outer"), F.struct(F.col("l_orderkey").cast("string").alias("instance_id"), F.concat(line, F.lit("-"), F.col("l_returnflag")).alias("model_patch")).alias("v"))
    sinks.write_keyed_json(own, path, ["outer"], F.to_json("v"))
    return keyed.prediction_patches(spark, path)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS instance_id, 'import hypothesis' || chr(10) || chr(10) || '@given(x=' || p_size || ')' || chr(10) || 'def prop_' || p_partkey || '(x):' || chr(10) || '    return x' || chr(10) || 'prop_' || p_partkey || '()' AS pbt FROM part""")
def read_property_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a JSON array, without their main guards and with calls of what is decorated."""
    path, key = new_path(spark, "tests"), F.col("p_partkey").cast("string")
    code = F.concat(F.lit("import hypothesis\n\n@given( x = "), F.col("p_size").cast("string"), F.lit(")\ndef prop_"), key, F.lit("(x):\n  return x  # as it is\n\nif __name__ == '__main__':\n    prop_"), key, F.lit("()\n"))
    sinks.write_json_array(t(spark, sf_dir, "part").select(key.alias("instance_id"), code.alias("pbt")), path, "instance_id")
    return keyed.property_tests(spark, path)


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'click'")
def read_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-wise JSON below folders, chosen by a part of the path."""
    path = new_path(spark, "lines")
    t(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.col("event_type").alias("kind")).write.partitionBy("kind").json(path)
    return keyed.json_lines(spark, path, "event_id bigint, event_type string, user_id bigint", "kind=click", "*.json")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of traces, one per user and side: even ids on the buggy side, odd ones on the patched side. The agent is the event's type."""
    e = t(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    return e.select(
        F.col("event_type").alias("agent"), F.concat(F.lit("r__r-"), F.col("user_id").cast("string")).alias("instance_id"), (F.col("event_id") % 2).cast("int").alias("test_id"), F.when(F.col("event_id") % 4 < 2, "buggy").otherwise("patched").alias("side"),
        "event_id", F.lit("Line").alias("event_type"), F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string"), F.lit(".py")).alias("filepath"), (F.col("event_id") % 7).cast("int").alias("line_number"), F.lit("f").alias("function_name"),
        F.lit("x").alias("statement"), F.array().cast("array<string>").alias("vars_used"), F.array().cast("array<string>").alias("vars_defined"), F.col("props").alias("seen_variables"), F.lit("{}").alias("parameters"), none.alias("return_value"), none.alias("exception_type"), none.alias("exception_value"),
    )


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "traces")
    _events(spark, sf_dir).write.partitionBy("agent", "side").json(path)
    return keyed.trace_events(spark, path)


@query("""SELECT event_type AS agent, 'r__r-' || user_id AS instance_id, CAST(event_id % 2 AS INT) AS test_id, CASE WHEN event_id % 4 < 2 THEN 'buggy' ELSE 'patched' END AS side, event_id, 'f' || (event_id % 3) || '.py' AS filepath, CAST(event_id % 7 AS INT) AS line_number, props AS seen_variables FROM events""")
def read_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traces(spark, sf_dir).select("agent", "instance_id", "test_id", "side", "event_id", "filepath", "line_number", "seen_variables")


@query("""WITH u AS (SELECT DISTINCT 'r__r-' || user_id AS instance_id FROM events), k AS (SELECT DISTINCT event_type AS agent FROM events), s(side, least) AS (VALUES ('buggy', 0), ('patched', 2)), n(test_id) AS (VALUES (0), (1))
SELECT agent, instance_id, test_id, side FROM u, k, s, n WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = agent AND 'r__r-' || e.user_id = instance_id AND e.event_id % 2 = test_id AND (e.event_id % 4 < 2) = (side = 'buggy'))""")
def missing_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected traces without an event: each user and type should have both sides of both tests."""
    e = t(spark, sf_dir, "events")
    sides = F.explode(F.array(F.lit("buggy"), F.lit("patched")))
    users = e.select(F.concat(F.lit("r__r-"), F.col("user_id").cast("string")).alias("instance_id")).distinct()
    kinds = e.agg(F.collect_set("event_type")).first()[0]  # a handful
    expected = users.select(F.explode(F.array(*map(F.lit, kinds))).alias("agent"), "instance_id").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("test_id")).select("*", sides.alias("side"))
    return keyed.empty_traces(_traces(spark, sf_dir), expected)


@query("""WITH l AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN 'removed' ELSE 'added' END AS side, 'f' || (page_id % 5) || '.py' AS path, CAST(page_id % 11 AS INT) AS line FROM pages),
m AS (SELECT CASE side WHEN 'removed' THEN 'buggy' ELSE 'patched' END AS side, path, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM l GROUP BY 1, 2),
f AS (SELECT min(user_id) AS u FROM events),
e AS (SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'buggy' ELSE 'patched' END AS side, 'f' || (event_id % 3) || '.py' AS path FROM events, f WHERE event_type = 'click' AND event_id % 2 = 0 AND user_id = u)
SELECT event_id, e.side, path AS filepath, coalesce(lines, '') AS patch_lines FROM e LEFT JOIN m USING (side, path)""")
def read_trace_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of one test of one user, with the lines of their files that the patch touched."""
    name = F.concat(F.lit("f"), (F.col("page_id") % 5).cast("string"), F.lit(".py"))
    user = t(spark, sf_dir, "events").agg(F.min("user_id")).first()[0]
    lines = t(spark, sf_dir, "pages").select(F.lit("click").alias("agent"), F.lit(f"r__r-{user}").alias("instance_id"), F.when(F.col("page_id") % 2 == 0, "removed").otherwise("added").alias("side"), name.alias("path"), (F.col("page_id") % 11).cast("int").alias("line"))
    pair = keyed.trace_pair(_traces(spark, sf_dir), "click", f"r__r-{user}", 0, lines)
    return pair.select("event_id", "side", "filepath", F.array_join("patch_lines", ",").alias("patch_lines"))


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 3 <> 0 AS a, o_custkey % 4 <> 0 AS b, o_orderstatus AS s, o_orderpriority AS p FROM orders)
SELECT o_orderkey, CASE WHEN a AND b THEN s END AS buggy_value, CASE WHEN a AND b THEN p END AS patched_value FROM r WHERE a OR b""")
def inspection_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspections of which one side may be missing."""
    o = t(spark, sf_dir, "orders")
    row = lambda side, value: (F.lit(side).alias("side"), F.lit("x").alias("expr"), F.col(value).alias("value"), F.lit(None).cast("string").alias("exception"))
    both = o.where("o_orderkey % 3 <> 0").select("o_orderkey", *row("buggy", "o_orderstatus")).unionByName(o.where("o_custkey % 4 <> 0").select("o_orderkey", *row("patched", "o_orderpriority")))
    return keyed.inspection_pairs(both, ["o_orderkey"]).select("o_orderkey", "buggy_value", "patched_value")


@query("""SELECT p_brand || '__' || p_type || '-' || p_partkey AS instance_id FROM part WHERE (p_brand || '__' || p_type) LIKE '%#1%' AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)""")
def instance_ids_by_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of repositories by a part of their names, less a text list of exclusions with comments."""
    part = t(spark, sf_dir, "part")
    name = F.concat("p_brand", F.lit("__"), "p_type", F.lit("-"), F.col("p_partkey").cast("string"))
    path = new_path(spark, "excluded")
    # a number sign starts a comment in such a list, so ids are written by their number
    part.where("p_size > 40").select(F.concat(F.lit('    "'), F.col("p_partkey").cast("string"), F.lit('",  # too large')).alias("value")).write.text(path)
    ids = part.select(name.alias("instance_id"), F.col("p_partkey").cast("string").alias("number"))
    excluded = keyed.id_list(spark, path).withColumnRenamed("instance_id", "number")
    return keyed.instance_ids(joins.without_excluded(ids, excluded, "number").select("instance_id"), "#1")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS instance_id, CAST(k - 1 AS INT) AS test_id, CASE WHEN l_orderkey % 5 = 0 THEN ['own', 'second'][k] ELSE a[k] END AS test
FROM (SELECT l_orderkey, list(l_returnflag || l_linenumber ORDER BY l_returnflag || l_linenumber) AS a FROM lineitem GROUP BY 1), unnest(range(1, 1 + CASE WHEN l_orderkey % 5 = 0 THEN 2 ELSE len(a) END)) AS x(k)""")
def failing_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test lists in JSON text, some overridden."""
    lists = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.concat("l_returnflag", F.col("l_linenumber").cast("string")))).alias("a"))
    dataset = lists.select(_id("l_orderkey"), F.to_json("a").alias("FAIL_TO_PASS"))
    own = lists.where("l_orderkey % 5 = 0").select(_id("l_orderkey"), F.array(F.lit("own"), F.lit("second")).alias("tests"))
    return keyed.failing_tests(dataset, own)


@query("SELECT c_name AS instance_id, c_name LIKE '%7' AS by_suffix, c_name LIKE '%01%' AS by_part FROM customer WHERE c_name LIKE '%7' OR c_name LIKE '%01%'")
def ids_by_suffix_and_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = t(spark, sf_dir, "customer").select(F.col("c_name").alias("instance_id"))
    suffix, part = keyed.by_suffix(ids, "7").withColumn("by_suffix", F.lit(True)), keyed.by_pattern(ids, "01").withColumn("by_part", F.lit(True))
    return suffix.join(part, "instance_id", "full").select("instance_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("by_suffix", "by_part")))


@query("""SELECT c_mktsegment AS agent, CAST(c_nationkey AS VARCHAR) AS instance_id, string_agg(DISTINCT 'm:' || substr(c_name, 17, 2), ',' ORDER BY 'm:' || substr(c_name, 17, 2)) AS functions FROM customer GROUP BY 1, 2""")
def allow_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An allow list of sorted names, written and read."""
    path = new_path(spark, "allowed")
    sinks.write_allow_list(t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("agent"), _id("c_nationkey"), F.array(F.concat(F.lit("m:"), F.substring("c_name", 17, 2))).alias("functions")), path)
    return keyed.allowed_functions(spark, path).select("agent", "instance_id", F.array_join("functions", ",").alias("functions"))


@query("""SELECT doc_id, 'e2e_effect' AS task, source AS agent, lang || '-x' AS model, doc_id % 2 = 0 AS audit FROM documents""")
def result_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the path of a result file tells."""
    path = F.concat(F.lit("results/evaluation/e2e_effect/"), F.when(F.col("doc_id") % 2 == 0, "audit_").otherwise(""), F.col("source"), F.lit("__"), F.col("lang"), F.lit("-x.json"))
    return t(spark, sf_dir, "documents").select("doc_id", keyed.result_parts(path).alias("p")).select("doc_id", "p.*")


@query("""WITH p AS (SELECT conv_id, list(role ORDER BY turn, role) AS r FROM conversations GROUP BY 1), s AS (SELECT sum(length(text)) AS c, sum(turn) AS p FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS instance_id, CAST(k - 1 AS INT) AS trial, r[k] AS answer, CAST(s.c AS BIGINT) AS completion_tokens, CAST(s.p AS BIGINT) AS prompt_tokens FROM p, s, unnest(range(1, len(r) + 1)) AS x(k)""")
def generation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions and token usage, written as generation files and read."""
    talk, path = t(spark, sf_dir, "conversations"), new_path(spark, "generation")
    lists = talk.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: F.array(s["role"])).alias("predictions"))
    usage = talk.agg(F.sum(F.char_length("text")).alias("completion_tokens"), F.sum("turn").alias("prompt_tokens"), F.sum(F.char_length("text") + F.col("turn")).alias("total_tokens"))
    sinks.write_generation_json(lists.select(_id("conv_id"), "predictions"), usage, path)
    return keyed.generations(spark, path).select("instance_id", "trial", F.array_join("answer", ",").alias("answer"), "completion_tokens", "prompt_tokens")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber AS k, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC) = 1)
SELECT CAST(l_orderkey AS VARCHAR) AS instance_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY k) - 1 AS INT) AS trial, score, 0.5::DOUBLE AS stated_mean FROM s""")
def evaluation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and statistics, written as evaluation files and read."""
    path = new_path(spark, "evaluation")
    rows = t(spark, sf_dir, "lineitem").groupBy(_id("l_orderkey"), F.col("l_linenumber").alias("trial")).agg(F.max("l_quantity").alias("q"))
    found = rows.select("instance_id", "trial", F.when(F.col("q") > 25, 1.0).otherwise(0.5).alias("score"))
    sinks.write_evaluation_json(found, spark.range(1).select(F.lit(0.5).alias("mean"), F.lit(0.0).alias("sem")), path)
    return keyed.evaluation_results(spark, path).select("instance_id", "trial", "score", "stated_mean")


@query("SELECT p_partkey, p_brand AS agent, p_brand = 'Brand#11' AS gold FROM part")
def gold_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One agent's rows go to a place of their own."""
    path = new_path(spark, "apart")
    rows = t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_brand") == "Brand#11", "gold").otherwise(F.col("p_brand")).alias("agent"))
    sinks.write_gold_apart(rows, f"{path}/rest", f"{path}/gold")
    gold, rest = spark.read.parquet(f"{path}/gold"), spark.read.parquet(f"{path}/rest")
    return gold.select("p_partkey", F.lit("Brand#11").alias("agent"), F.lit(True).alias("gold")).unionByName(rest.select("p_partkey", "agent", F.lit(False).alias("gold")))


@query("""SELECT p_brand AS agent, CAST(p_partkey AS VARCHAR) AS instance_id, p_name || '|' || p_type AS choices, substr(p_type, 1, 1) AS answer FROM part""")
def question_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts and truths of questions, written a folder per agent and read from all of them."""
    path = new_path(spark, "questions")
    q = t(spark, sf_dir, "part").select(F.col("p_brand").alias("agent"), _id("p_partkey"), F.array("p_name", "p_type").alias("options"), F.array(F.substring("p_type", 1, 1)).alias("answer"), F.lit(1).alias("unused"))
    sinks.write_questions(q, path, {"options": "choices"}, ["choices"], ["answer"])
    context = keyed.contexts(spark, f"{path}/context/*", "struct<choices: array<string>>").select("instance_id", F.array_join("choices", "|").alias("choices"))
    truth = keyed.ground_truths(spark, f"{path}/ground_truths/*").select("instance_id", F.array_join("answer", "").alias("answer"), F.url_decode(F.url_decode(F.regexp_extract("source_path", "agent=([^/]+)", 1))).alias("agent"))
    return context.join(truth, "instance_id").select("agent", "instance_id", "choices", "answer")


@query("SELECT o_orderkey, o_custkey * 2 AS v FROM orders")
def checkpointed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that is appended batch by batch: a part of it is there already, the rest is added."""
    path, orders = new_path(spark, "batches"), t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    work = lambda rows: rows.select("o_orderkey", (F.col("o_custkey") * 2).alias("v"))
    work(orders.where("o_orderkey % 3 = 0")).write.parquet(path)
    sinks.append_by_batches(orders, work, ["o_orderkey"], path, batches=4)
    return spark.read.parquet(path)


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS position FROM customer")
def places_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's place by balance, in ranges."""
    rows = t(spark, sf_dir, "customer").select("c_custkey", (-F.col("c_acctbal")).alias("b"))
    return ordering.with_position(rows, "b", "c_custkey").select("c_custkey", "position")


@query("""SELECT doc_id, 'class A:' || chr(10) || chr(10) || '    def f(self):' || chr(10) || '        return ' || doc_id AS bare,
'A.f' || ',A' AS names, '    def f(self):' || chr(10) || '        "doc"' || chr(10) || '        return ' || doc_id AS code FROM documents""")
def python_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions, one function's code, and source without docstrings."""
    from tracewise.functions import source

    code = F.concat(F.lit('class A:\n    def f(self):\n        "doc"\n        return '), F.col("doc_id").cast("string"), F.lit("\n"))
    names = F.array_join(F.transform(F.array_sort(F.transform(source.def_ranges(code), lambda d: F.struct((-d["start"]).alias("s"), d["qualname"].alias("q")))), lambda d: d["q"]), ",")
    return t(spark, sf_dir, "documents").select("doc_id", source.docstrings_removed(code).alias("bare"), names.alias("names"), source.function_code(code, F.lit("f")).alias("code"))


@query("""SELECT doc_id, side, path, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM (
SELECT doc_id, 'added' AS side, 'b' || (doc_id % 5) || '.py' AS path, unnest(range(1, 2 + len(string_split(text, chr(10))))) AS line FROM documents
UNION ALL SELECT doc_id, 'removed', 'a' || (doc_id % 5) || '.py', 1 + n_chars % 40 FROM documents) GROUP BY ALL""")
def document_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of whole texts: the lines of a document are added where one line is removed, at a line that varies."""
    docs, number = t(spark, sf_dir, "documents"), (F.col("doc_id") % 5).cast("string")
    text = F.concat(F.lit("+"), F.replace("text", F.lit("\n"), F.lit("\n+")), F.lit("\n+last"))
    at, n = (1 + F.col("n_chars") % 40).cast("string"), F.size(F.split("text", "\n")) + 1
    patch = F.concat(F.lit("diff --git a/x b/x\n--- a/a"), number, F.lit(".py\n+++ b/b"), number, F.lit(".py\n@@ -"), at, F.lit(" +1,"), n.cast("string"), F.lit(" @@\n-old\n"), text, F.lit("\n"))
    lines = patches.patch_lines(docs.select("doc_id", patch.alias("model_patch")), ["doc_id"])
    return patches.lines_by_file(lines, ["doc_id"]).select("doc_id", "side", "path", F.array_join("lines", ",").alias("lines"))
