"""The engine's operators over the driver's star schema, each with an equivalent SQL text where there is one.

A query uses the operators of this library on columns that stand in for theirs; the SQL
states the same result independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewise.functions import paths, scores, text, values
from tracewise.operators import divergence, joins, outcomes, patches, scoring, selection, structdiff, traces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scoring -------------------------------------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predictions per user and trial, truths per user: event types of large values, and of even ids."""
    events = t(spark, sf_dir, "events")
    predicted = events.where("value >= 100").groupBy("user_id", (F.col("event_id") % 5).cast("int").alias("trial")).agg(F.array_sort(F.collect_set("event_type")).alias("answer"))
    truth = events.where("event_id % 2 = 0").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("answer"))
    return predicted, truth


_ANSWERS = """
p AS (SELECT user_id, CAST(event_id % 5 AS INT) AS trial, list_sort(list(DISTINCT event_type)) AS a FROM events WHERE value >= 100 GROUP BY 1, 2),
g AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS b FROM events WHERE event_id % 2 = 0 GROUP BY 1),
s AS (SELECT user_id, trial, CASE WHEN len(list_filter(a, lambda x: NOT list_contains(b, x))) > 0 THEN 0.0::DOUBLE
  ELSE len(list_filter(a, lambda x: list_contains(b, x)))::DOUBLE / len(b) END AS score FROM p JOIN g USING (user_id))
"""


@query(f"WITH {_ANSWERS} SELECT user_id, trial, round(score, 9) AS score FROM s")
def mcq_score_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score_trials(*_answers(spark, sf_dir), ["user_id"])
    return scored.select("user_id", "trial", F.round("score", 9).alias("score"))


@query(f"""WITH {_ANSWERS}, m AS (SELECT trial, avg(score) AS m FROM s GROUP BY 1)
SELECT round(avg(m), 9) AS mean, round(stddev_samp(m) / sqrt(count(*)), 9) AS sem FROM m""")
def trial_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.statistics(scoring.score_trials(*_answers(spark, sf_dir), ["user_id"]))
    return out.select(F.round("mean", 9).alias("mean"), F.round("sem", 9).alias("sem"))


@query("""WITH m AS (SELECT l_returnflag, l_linenumber, avg(CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS m FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, round(avg(m), 9) AS mean, round(stddev_samp(m) / sqrt(count(*)), 9) AS sem FROM m GROUP BY 1""")
def trial_mean_sem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_linenumber").alias("trial"), (F.col("l_quantity") > 25).cast("double").alias("score"))
    return scoring.statistics(rows, ["l_returnflag"]).select("l_returnflag", F.round("mean", 9).alias("mean"), F.round("sem", 9).alias("sem"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def answer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = t(spark, sf_dir, "events").select(F.explode(F.array("event_type")).alias("event_type"))
    return lists.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS pass_rate, count(*) AS n FROM orders GROUP BY 1""")
def pass_rate_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 9).alias("pass_rate"), F.count("*").alias("n"))


@query("""SELECT user_id, trial, CASE WHEN len(a) > 0 AND len(list_filter(a, lambda x: NOT regexp_full_match(x, '[a-zA-Z]'))) = 0 THEN true ELSE false END AS valid
FROM (SELECT user_id, CAST(event_id % 5 AS INT) AS trial, list_sort(list(DISTINCT CASE WHEN event_id % 7 = 0 THEN event_type ELSE substr(event_type, 1, 1) END)) AS a FROM events GROUP BY 1, 2)""")
def valid_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.substring("event_type", 1, 1))
    lists = t(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 5).cast("int").alias("trial")).agg(F.collect_set(short).alias("a"))
    return lists.select("user_id", "trial", scores.valid_choice(F.col("a")).alias("valid"))


@query("""SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 2 AS pair,
0.0::DOUBLE AS shipped FROM orders""")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "H").otherwise("L")
    given, truth = F.array(F.col("o_orderstatus"), high), F.array(F.lit("F"), F.lit("H"))
    return t(spark, sf_dir, "orders").select("o_orderkey", scores.pair_score(given, truth).alias("pair"), scores.pair_key_score(given, truth).alias("shipped"))


@query("""WITH u AS (SELECT role AS model, sum(length(text)) AS p, sum(turn) AS c, sum(length(text) + turn) AS tot FROM conversations GROUP BY 1)
SELECT model, p::BIGINT AS prompt_tokens, c::BIGINT AS completion_tokens, tot::BIGINT AS total_tokens,
round(CASE model WHEN 'user' THEN (p * 0.25::DOUBLE + c * 2.0::DOUBLE) / 1e6 WHEN 'assistant' THEN (p * 0.05::DOUBLE + c * 0.4::DOUBLE) / 1e6 END, 9) AS cost FROM u""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = t(spark, sf_dir, "conversations")
    tokens = talk.select(F.col("role").alias("model"), F.char_length("text").cast("bigint").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"), (F.char_length("text") + F.col("turn")).alias("total_tokens"))
    prices = spark.createDataFrame([("user", 0.25, 2.0), ("assistant", 0.05, 0.4)], "model string, input_price double, output_price double")
    return scoring.usage(tokens, prices).select("model", "prompt_tokens", "completion_tokens", "total_tokens", F.round("cost", 9).alias("cost"))


@query("""SELECT c_custkey, CASE WHEN n >= 1e6 THEN printf('%.2fMt', n / 1e6) WHEN n >= 1e3 THEN printf('%.2fKt', n / 1e3) ELSE n::BIGINT || 't' END AS shown
FROM (SELECT c_custkey, (abs(c_acctbal) * c_custkey % 400000)::BIGINT * 10 + 3 AS n FROM (SELECT c_custkey, floor(c_acctbal) AS c_acctbal FROM customer))""")
def token_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.abs(F.floor("c_acctbal")) * F.col("c_custkey") % 400000).cast("bigint") * 10 + 3
    return t(spark, sf_dir, "customer").select("c_custkey", text.token_count(n).alias("shown"))


# --- joins and sets ------------------------------------------------------------------------------


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'EMPTY') AS explanation FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    expl = t(spark, sf_dir, "labels").select("doc_id", F.array(F.col("quality").cast("string")).alias("explanations"))
    return joins.with_explanation(t(spark, sf_dir, "documents").select("doc_id"), expl, ["doc_id"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unmatched_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.unmatched(t(spark, sf_dir, "customer").select("c_custkey"), t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""SELECT d.doc_id, (d.doc_id % 3 = 0) AS is_fallback_to_gold, CAST(CASE WHEN d.doc_id % 3 = 0 THEN l.quality ELSE d.n_chars END AS BIGINT) AS v
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id % 3 <> 0 OR l.doc_id IS NOT NULL""")
def fallback_to_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("v"))
    gold = t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("v"))
    return joins.with_fallback(rows, gold, ["doc_id"], F.col("doc_id") % 3 == 0, ["v"]).select("doc_id", "is_fallback_to_gold", "v")


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def exclusion_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return joins.without_excluded(t(spark, sf_dir, "part").select("p_partkey", "p_brand"), out, "p_partkey")


@query("""WITH r AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)
SELECT c_nationkey FROM r GROUP BY 1 HAVING count(DISTINCT c_mktsegment) = (SELECT count(DISTINCT c_mktsegment) FROM r)""")
def id_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.in_every_group(t(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct(), "c_nationkey", "c_mktsegment")


@query("""WITH c AS (SELECT user_id, event_type, count(*) FILTER (value >= 100) AS a, count(*) FILTER (value < 100) AS b FROM events GROUP BY 1, 2)
SELECT user_id, event_type, a, b FROM c WHERE user_id IN (SELECT user_id FROM c GROUP BY 1 HAVING bool_and(a >= 1 AND b >= 1))""")
def min_pool_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.when(F.col("value") >= 100, 1)).alias("a"), F.count(F.when(F.col("value") < 100, 1)).alias("b"))
    none = F.lit(None).cast("array<string>")
    ok = scores.enough_options(none, F.array_repeat(F.lit("x"), F.col("a").cast("int")), F.array_repeat(F.lit("x"), F.col("b").cast("int")), 1, 1)
    return joins.all_pass(c, "user_id", ok)


@query("""SELECT b.event_type, CAST(count(*) - count(*) FILTER (b.value >= 100) AS BIGINT) AS removed FROM events b GROUP BY 1""")
def removal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t(spark, sf_dir, "events")
    return joins.removal_counts(events, events.where("value >= 100"), "event_type")


@query("SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus)), ',') AS names FROM lineitem GROUP BY 1")
def union_distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("name"))
    return joins.union_sorted(rows, ["l_suppkey"], "name", "names").select("l_suppkey", F.array_join("names", ",").alias("names"))


@query("""WITH p AS (SELECT l_orderkey, list(l_returnflag || CAST(l_linenumber % 3 AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter(a, lambda x: NOT list_contains(['N1', 'R2'], x)), ',') AS rest FROM p""")
def bag_difference_keep_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat("l_returnflag", (F.col("l_linenumber") % 3).cast("string")).alias("x"))
    p = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["x"]).alias("a"))
    return p.select("l_orderkey", F.array_join(selection.minus(F.col("a"), F.array(F.lit("N1"), F.lit("R2"))), ",").alias("rest"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000")
def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t(spark, sf_dir, "orders")
    return joins.only_new(orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey"), orders.where("o_totalprice > 200000"), ["o_orderkey"]).distinct()


@query("""WITH a AS (SELECT l_orderkey, l_suppkey AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_linenumber) AS k FROM lineitem WHERE l_returnflag = 'N'),
b AS (SELECT l_orderkey, l_partkey AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS k FROM lineitem WHERE l_returnflag <> 'N')
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, CAST(coalesce(a.k, b.k) AS BIGINT) AS k, a.v AS a, b.v AS b FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.k = b.k""")
def zip_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag") == "N"
    both = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.when(flag, F.col("l_suppkey")))).alias("a"), F.sort_array(F.collect_list(F.when(~flag, F.col("l_partkey")))).alias("b"))
    rows = both.select("l_orderkey", F.posexplode(joins.zip_longest(a=F.col("a"), b=F.col("b"))).alias("k", "z"))
    return rows.select("l_orderkey", (F.col("k") + 1).cast("bigint").alias("k"), "z.a", "z.b")


@query("""WITH e AS (SELECT user_id, list(event_type ORDER BY event_id) AS e, list(event_id % 3 ORDER BY event_id) AS v, list(event_id % 2 ORDER BY event_id) AS w FROM events GROUP BY 1),
u AS (SELECT user_id, unnest(e) AS e, unnest(v) AS v, unnest(w) AS w, generate_subscripts(e, 1) AS k FROM e),
l AS (SELECT user_id, e, v <> w AS c, row_number() OVER (PARTITION BY user_id, e ORDER BY k DESC) AS r FROM u)
SELECT user_id, CAST(count(*) FILTER (c) AS BIGINT) AS changed, CAST(count(*) FILTER (NOT c) AS BIGINT) AS unchanged FROM l WHERE r = 1 GROUP BY 1""")
def expression_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("event_id", "event_type", (F.col("event_id") % 3).cast("string").alias("v"), (F.col("event_id") % 2).cast("string").alias("w"))
    lists = t(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(row)).alias("s"))
    none = F.transform("s", lambda s: F.lit(None).cast(joins.EXCEPTION))
    pick = lambda c: F.transform("s", lambda s: s[c])
    changed, same = joins.split_map(joins.change_map(pick("event_type"), pick("v"), none, pick("w"), none))
    return lists.select("user_id", F.size(changed).cast("bigint").alias("changed"), F.size(same).cast("bigint").alias("unchanged"))


# --- similarity and selection --------------------------------------------------------------------


def _pool_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts with their places within their pools of 64 consecutive keys; small ones are those up to size 16."""
    return t(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 64).alias("pool"), "p_partkey", "p_name", (F.col("p_size") <= 16).alias("small"), F.col("p_partkey").alias("pos"))


def _pool_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pool, the names of its small and of its other parts by key."""

    def names(cond: Column):
        return F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("p_partkey", "p_name")))), lambda s: s["p_name"])

    return _pool_parts(spark, sf_dir).groupBy("pool").agg(names(F.col("small")).alias("small"), names(~F.col("small")).alias("large"))


_POOLS = "p AS (SELECT p_partkey // 64 AS pool, p_partkey, p_name, p_size <= 16 AS small FROM part)"
_SIM = "1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}), 1)"


@query(f"""SELECT a.p_brand, a.p_partkey AS x, b.p_partkey AS y, CAST(levenshtein(a.p_name, b.p_name) AS BIGINT) AS d, round({_SIM.format(a="a.p_name", b="b.p_name")}, 9) AS s
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey""")
def similarity_pairs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of parts of a brand. Names are compared once for two lists of parts that have them, 1,024 at most a list, and then each part of one is paired with each of the other.

    Similarity is the same both ways, so of two lists the first meets the second only. First lists
    are dealt to 16 blocks, each of which meets all second ones, so that a brand isn't one task.
    """
    part = t(spark, sf_dir, "part").where("p_brand is not null and p_partkey is not null").select("p_brand", "p_partkey", "p_name")
    place = F.row_number().over(Window.partitionBy("p_brand", "p_name").orderBy("p_partkey")) - 1
    lists = part.withColumn("list", F.floor(place / 1024)).groupBy("p_brand", "p_name", "list").agg(F.collect_list("p_partkey").alias("keys"))
    own = F.struct(F.col("p_name").isNull().alias("none"), F.coalesce("p_name", F.lit("")).alias("name"), F.col("list")).alias("own")
    a = lists.select("p_brand", own, "p_name", "keys", F.pmod(F.xxhash64("p_name", "list"), F.lit(16)).cast("int").alias("block")).repartition(96, "p_brand", "block").alias("a")
    b = lists.select("p_brand", own, "p_name", "keys", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("block")).repartition(96, "p_brand", "block").alias("b")
    met = a.join(b.hint("merge"), (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.own") <= F.col("b.own")))
    d, s = F.levenshtein("a.p_name", "b.p_name").cast("bigint"), F.round(text.similarity(F.col("a.p_name"), F.col("b.p_name")), 9)
    once = met.select("a.p_brand", F.col("a.keys").alias("us"), F.col("b.keys").alias("vs"), (F.col("a.own") == F.col("b.own")).alias("same"), d.alias("d"), s.alias("s"))
    pairs = once.select("p_brand", F.explode("us").alias("u"), "vs", "same", "d", "s").select("p_brand", "u", F.explode("vs").alias("v"), "same", "d", "s")
    return pairs.where("u < v or u > v and not same").select("p_brand", F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"), "d", "s")


@query(f"""SELECT a.p_partkey, round(avg({_SIM.format(a="a.p_name", b="b.p_name")}), 9) AS mean, round(max({_SIM.format(a="a.p_name", b="b.p_name")}), 9) AS best
FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_size > 16 WHERE a.p_size <= 16 GROUP BY 1""")
def avg_max_similarity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every small part against all others of its brand. Different names are compared once, and count as often as they stand there."""
    part, small = t(spark, sf_dir, "part"), F.col("p_size") <= 16
    names = part.where(small).select("p_brand", "p_name").distinct()
    others = part.where(~small).groupBy("p_brand", F.col("p_name").alias("other")).agg(F.count("*").alias("n"))
    pairs = names.join(others.hint("merge"), "p_brand").withColumn("s", text.similarity(F.col("p_name"), F.col("other")))
    mean = F.sum(F.col("s") * F.col("n")) / F.sum(F.when(F.col("s").isNotNull(), F.col("n")))
    found = pairs.groupBy(F.col("p_brand").alias("brand"), F.col("p_name").alias("name")).agg(F.round(mean, 9).alias("mean"), F.round(F.max("s"), 9).alias("best"))
    same = (F.col("p_brand") == F.col("brand")) & F.col("p_name").eqNullSafe(F.col("name"))
    return part.where(small).join(found, same).select("p_partkey", "mean", "best")


@query(f"""WITH {_POOLS}, s AS (SELECT a.pool, a.p_partkey, coalesce(round(avg({_SIM.format(a="a.p_name", b="b.p_name")}), 9), 0) AS r FROM p a LEFT JOIN p b ON a.pool = b.pool AND NOT b.small WHERE a.small GROUP BY 1, 2),
k AS (SELECT pool, r, row_number() OVER (PARTITION BY pool ORDER BY r DESC) AS rank FROM s)
SELECT pool, CAST(rank AS INT) AS rank, r AS relevance FROM k WHERE rank <= 2""")
def hard_anchor_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relevance of each pool's two best anchors."""
    pools = _pool_parts(spark, sf_dir)
    found = selection.hard_anchors(pools.where("small"), ["pool"], "p_name", pools.where("not small").select("pool", "p_name"), 2)
    return found.select("pool", F.col("rank").cast("int").alias("rank"), F.round("relevance", 9).alias("relevance"))


@query(f"""WITH RECURSIVE {_POOLS}, rel AS (SELECT x.pool, x.p_name, x.p_partkey AS pos, coalesce(max({_SIM.format(a="x.p_name", b="a.p_name")}), 0) AS rel FROM p x LEFT JOIN p a ON a.pool = x.pool AND a.small WHERE NOT x.small GROUP BY 1, 2, 3),
step AS (SELECT pool, 0 AS k, []::VARCHAR[] AS chosen, []::BIGINT[] AS ats FROM (SELECT DISTINCT pool FROM rel)
UNION ALL SELECT pool, k + 1, list_append(chosen, p_name), list_append(ats, pos) FROM (SELECT s.pool, s.k, s.chosen, s.ats, r.p_name, r.pos,
row_number() OVER (PARTITION BY s.pool ORDER BY 0.7 * r.rel - (1 - 0.7) * coalesce(list_max(list_transform(s.chosen, lambda c: {_SIM.format(a="r.p_name", b="c")})), 0) DESC, r.pos) AS n
FROM step s JOIN rel r ON s.pool = r.pool AND NOT list_contains(s.ats, r.pos) WHERE s.k < 3) WHERE n = 1)
SELECT pool, array_to_string(chosen, '|') AS chosen FROM step WHERE k = 3""")
def mmr_select_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _pool_lists(spark, sf_dir).where(F.size("large") >= 3)
    return lists.select("pool", F.array_join(selection.diverse(F.col("large"), F.col("small"), 3), "|").alias("chosen"))


@query("""SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5('42' || chr(31) || p_brand || chr(31) || p_partkey), p_partkey) <= 3""")
def hash_sample_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.sample_rows(t(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", 3)


@query("""WITH o AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS c, min(o_orderpriority) AS truth FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT o_custkey, array_to_string(list_concat(list_slice(c, 1, 4), ['unknown']), '|') AS choices, substr('abcde', list_position(list_sort(list_concat(list_slice(c, 1, 4), ['unknown'])), truth)::INT, 1) AS letter FROM o WHERE len(c) >= 4""")
def choices_sorted_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("c"), F.min("o_orderpriority").alias("truth"))
    out = o.withColumn("e", selection.expanded(F.slice("c", 1, 2), F.col("c"), "unknown")).where(F.col("e").isNotNull())
    return out.select("o_custkey", F.array_join("e", "|").alias("choices"), selection.sorted_letter(F.col("e"), F.col("truth")).alias("letter"))


@query()
def question_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pool's parts, the small ones are the correct options; every fifth pool has none."""
    lists = _pool_lists(spark, sf_dir)
    done = selection.assemble(F.col("small"), F.col("large"), F.col("pool") % 5 == 1, 42, "pool")
    return lists.select("pool", done.alias("q")).select("pool", F.array_join("q.choices", "|").alias("choices"), F.array_join("q.answer", "").alias("answer"))


@query("""SELECT conv_id, (k - 1) // 26 AS block, string_agg(chr((97 + (k - 1) % 26)::INT) || ') ' || role, chr(10) ORDER BY k) AS choices FROM
(SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS k FROM conversations) GROUP BY 1, 2""")
def labelled_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of a conversation, in blocks of as many as there are letters."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    rows = t(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(w) - 1)
    lists = rows.groupBy("conv_id", F.floor(F.col("k") / 26).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "role"))), lambda s: s["role"]).alias("r"))
    return lists.select("conv_id", "block", text.labelled_choices(F.col("r")).alias("choices"))


# --- traces --------------------------------------------------------------------------------------

def _trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a trace: ids divisible by 5 call, those with rest 1 return where something is open, others are lines."""
    events = t(spark, sf_dir, "events")
    k = F.col("event_id") % 5
    kind = F.when(k == 0, "Function").when(k == 1, "Return").otherwise("Line")
    return events.select(
        F.lit("a").alias("agent"), F.concat(F.lit("repo__x-"), F.col("user_id").cast("string")).alias("instance_id"), F.lit(0).alias("test_id"), F.lit("buggy").alias("side"),
        "event_id", kind.alias("event_type"), F.col("event_type").alias("filepath"), (F.col("event_id") % 7).cast("int").alias("line_number"), F.col("event_type").alias("function_name"),
        F.concat("event_type", F.lit("()")).alias("statement"), F.array("event_type").alias("vars_used"), F.array(F.lit("k")).alias("vars_defined"), F.col("props").alias("seen_variables"),
        F.lit("{}").alias("parameters"), F.col("props").alias("return_value"), F.lit(None).cast("string").alias("exception_type"), F.lit(None).cast("string").alias("exception_value"), "user_id",
    )


@query("""SELECT user_id, event_id, CAST(coalesce(sum(CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS depth FROM events""")
def call_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.with_depth(_trace_events(spark, sf_dir)).select("user_id", "event_id", "depth")


@query("""WITH e AS (SELECT user_id, event_id, event_id % 5 AS k, coalesce(sum(CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM events)
SELECT x.user_id, x.event_id, CAST(coalesce(max(y.event_id), -1) AS BIGINT) AS block_id FROM e x LEFT JOIN e y ON x.user_id = y.user_id AND y.k = 0 AND y.depth + 1 = x.depth AND y.event_id < x.event_id GROUP BY 1, 2""")
def call_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.with_block(_trace_events(spark, sf_dir)).select("user_id", "event_id", "block_id")


@query("""WITH e AS (SELECT user_id, event_id, event_id % 5 AS k, event_type, coalesce(sum(CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM events),
o AS (SELECT x.user_id, x.event_id, x.k, x.event_type, x.depth, coalesce(max(y.event_id), -1) AS owner FROM e x LEFT JOIN e y ON x.user_id = y.user_id AND y.k = 0 AND y.depth + 1 = x.depth AND y.event_id < x.event_id GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT user_id, owner, count(*) AS n, max(event_id) FILTER (k = 1) AS r FROM o WHERE owner >= 0 GROUP BY 1, 2)
SELECT 'repo__x-' || c.user_id AS instance_id, c.event_id AS block, CAST(c.owner AS BIGINT) AS parent_id, c.event_type AS name, CAST(c.depth + 1 AS INT) AS block_depth, b.n AS n_events, b.r AS return_event FROM o c LEFT JOIN b ON b.user_id = c.user_id AND b.owner = c.event_id WHERE c.k = 0""")
def call_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.blocks(_trace_events(spark, sf_dir)).select("instance_id", "block", "parent_id", "name", "block_depth", "n_events", "return_event")


@query("""SELECT user_id, event_id, CAST(sum(CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type, event_id % 7 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS event_count FROM events""")
def running_event_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.occurrence(_trace_events(spark, sf_dir)).select("user_id", "event_id", "event_count")


@query("""WITH m AS (SELECT user_id, event_type, event_id % 7 AS ln FROM events WHERE value > 300)
SELECT DISTINCT e.user_id, e.event_type AS function_name FROM events e WHERE EXISTS (SELECT 1 FROM m WHERE m.user_id = e.user_id AND m.event_type = e.event_type AND m.ln = e.event_id % 7)""")
def patched_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _trace_events(spark, sf_dir)
    lines = t(spark, sf_dir, "events").where("value > 300").select("user_id", F.col("event_type").alias("path"), (F.col("event_id") % 7).cast("int").alias("line"))
    return traces.patched_functions(traces.on_patch(e, lines, ["user_id"]), ["user_id"])


@query("""SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type || ':' || CAST(event_id % 7 AS VARCHAR))), ',') AS functions FROM events WHERE event_id % 3 = 0 GROUP BY 1""")
def semi_join_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    stacks = e.select("user_id", (F.col("event_id") % 3).cast("string").alias("target"), F.array(F.array("event_type", (F.col("event_id") % 7).cast("string"))).alias("stack"))
    targets = e.select("user_id", F.lit("0").alias("target"))
    return traces.functions_by_target(stacks, targets, ["user_id"]).select("user_id", F.array_join("functions", ",").alias("functions"))


@query("""SELECT p_partkey, p_size, nm FROM part JOIN (SELECT p_partkey AS s, p_partkey + 40 AS f, p_name AS nm FROM part WHERE p_partkey % 16 = 0) r ON p_partkey BETWEEN s AND f
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY s DESC) = 1""")
def innermost_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part")
    ranges = part.where("p_partkey % 16 = 0").select(F.lit(1).alias("path"), F.col("p_partkey").alias("s"), (F.col("p_partkey") + 40).alias("f"), F.col("p_name").alias("nm"))
    points = part.select(F.lit(1).alias("path"), "p_partkey", "p_size")
    return traces.innermost(points, ranges, ["path"], "p_partkey", "s", "f", ["nm"]).select("p_partkey", "p_size", "nm")


@query("""WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events WHERE event_id % 2 = 0),
b AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events WHERE event_id % 2 = 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CAST(min(coalesce(a.p, b.p)) AS INT) AS position FROM a FULL JOIN b ON a.user_id = b.user_id AND a.p = b.p WHERE a.event_type IS DISTINCT FROM b.event_type GROUP BY 1""")
def first_divergence_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return traces.first_difference(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "event_id", ["event_type"])


@query()
def first_divergence_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _trace_events(spark, sf_dir).drop("user_id").withColumn("excluded", F.lit(False))
    b = a.withColumn("side", F.lit("patched")).withColumn("seen_variables", F.when(F.col("event_id") % 11 == 3, F.lit('{"k": -1}')).otherwise(F.col("seen_variables")))
    found = divergence.first_useful(divergence.first_divergence(a.unionByName(b)))
    return found.select("instance_id", "status", "buggy_event_id", "patched_event_id", "location", "before_or_after", "diff_kind", "diff_path")


# --- structural differences ----------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, lag(CAST(json_extract(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events)
SELECT user_id, event_id, 'values_changed' AS kind, 'root[''k'']' AS path, CAST(was AS VARCHAR) AS old_value, CAST(k AS VARCHAR) AS new_value FROM e WHERE was IS NOT NULL AND was <> k""")
def json_diff_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = t(spark, sf_dir, "events").select("user_id", "event_id", "props", F.lag("props").over(w).alias("was")).where("was is not null")
    return structdiff.diffs(e, "was", "props", ["user_id", "event_id"]).select("user_id", "event_id", "kind", "path", "old_value", "new_value")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 5) = round(l_extendedprice - l_extendedprice * l_discount, 5) AS same FROM lineitem""")
def tolerant_equality_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item."""
    a, b = F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice") - F.col("l_extendedprice") * F.col("l_discount")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", values.same_value(F.to_json(F.struct(a.alias("x"))), F.to_json(F.struct(b.alias("x")))).alias("same"))


_PATH = "CASE p_partkey % 3 WHEN 0 THEN 'root[''seen_variables''][''' || p_brand || ''']' WHEN 1 THEN 'root[''' || p_brand || '''][' || p_size || ']' ELSE 'root' END"


@query(f"""WITH p AS (SELECT p_partkey, {_PATH} AS path FROM part)
SELECT p_partkey, CAST(len(regexp_extract_all(path, '\\[(.*?)\\]')) - CASE WHEN path LIKE 'root[''seen_variables'']%' THEN 1 ELSE 0 END AS INT) AS depth,
coalesce(regexp_extract_all(path, '\\[''(.*?)''\\]', 1)[2], '') AS variable, regexp_extract_all(path, '\\[''(.*?)''\\]', 1)[-1] AS attribute FROM p""")
def path_depth_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, brand = F.col("p_partkey") % 3, F.col("p_brand")
    path = F.when(k == 0, F.concat(F.lit("root['seen_variables']['"), brand, F.lit("']"))).when(k == 1, F.concat(F.lit("root['"), brand, F.lit("']["), F.col("p_size"), F.lit("]"))).otherwise("root")
    p = t(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return p.select("p_partkey", paths.depth(F.col("path")).alias("depth"), paths.variable(F.col("path")).alias("variable"), paths.attribute(F.col("path")).alias("attribute"))


@query("""WITH d AS (SELECT conv_id, turn, text AS n, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS o FROM conversations)
SELECT conv_id, turn FROM d WHERE o IS NOT NULL AND o <> n AND len(string_split_regex(trim(o), '\\s+')) <= 30 AND len(string_split_regex(trim(n), '\\s+')) <= 30""")
def docstring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("new_value"), F.lag("text").over(w).alias("old_value")).where("old_value is not null and old_value <> new_value")
    kinds = d.withColumns({"kind": F.lit("values_changed"), "old_type": F.lit("str"), "new_type": F.lit("str")})
    return kinds.where(structdiff.not_docstring(30)).select("conv_id", "turn")


@query()
def trace_filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("instance_id").orderBy("event_id")
    e = _trace_events(spark, sf_dir).withColumn("was", F.lag("seen_variables").over(w)).where("was is not null")
    d = structdiff.diffs(e, "was", "seen_variables", ["instance_id", "event_id", "seen_variables", "vars_used", "vars_defined"])
    stages = [structdiff.unseen_additions, structdiff.not_cached, lambda: structdiff.first_key_not("parameter_sources", "return_value", "caller_name"), structdiff.no_ignored_key, structdiff.on_this_line, structdiff.not_docstring, structdiff.not_hash]
    return structdiff.shallowest(structdiff.cascade(d, ["instance_id", "event_id"], stages), ["instance_id", "event_id"]).select("instance_id", "event_id", "kind", "path")


@query("""SELECT event_id, '{"a":{"b":{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '},"c":[1,2,{"py/object":"builtins.dict"}]}}' AS v FROM events""")
def simplify_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.concat(F.lit('{"a": {"b": '), F.col("props"), F.lit(', "c": [1, 2, {"d": 1}]}}'))
    return t(spark, sf_dir, "events").select("event_id", values.simplified(nested, 2).alias("v"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"x":"inf","y":["' || CAST(9007199254740992 + event_id AS VARCHAR) || '",' || CAST(event_id AS VARCHAR) || ']}'
WHEN 1 THEN '{"x":' || CAST(9007199254740992 + event_id AS VARCHAR) || '}' WHEN 2 THEN '{"x":"-inf"}' ELSE '{"x":' || CAST(event_id AS VARCHAR) || '}' END AS v FROM events""")
def canonical_json_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event: infinite numbers become text, and wide whole numbers beside them; wide ones alone stay."""
    k, one = F.col("event_id") % 4, F.col("event_id").cast("string")
    wide = (F.lit(2**53) + F.col("event_id")).cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit('{ "y" : ['), wide, F.lit(", "), one, F.lit('], "x" : 1e999 }')))
        .when(k == 1, F.concat(F.lit('{ "x" : '), wide, F.lit("}")))
        .when(k == 2, F.lit('{ "x" : -1e999 }'))
        .otherwise(F.concat(F.lit('{ "x" : '), one, F.lit("}")))
    )
    return t(spark, sf_dir, "events").select("event_id", values.sanitised(raw).alias("v"))


# --- text, patches, outcomes ---------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || ' ...(truncated)' ELSE text END AS text FROM documents")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text"), 2000).alias("text"))


@query("""SELECT conv_id, turn, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CAST(i AS VARCHAR) || ': ' || x), chr(10)) AS numbered FROM conversations""")
def number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", text.numbered_lines(F.col("text")).alias("numbered"))


@query("""SELECT conv_id, turn, 'What was said?' || chr(10) || chr(10) || 'Role Name:' || chr(10) || role || chr(10) || chr(10) || 'Turn Text:' || chr(10) || text AS prompt FROM conversations""")
def title_case_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = text.context_block({"role_name": F.col("role"), "turn_text": F.col("text")})
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", text.prompt("What was said?", block).alias("prompt"))


@query("""SELECT page_id, CASE WHEN m = '' THEN '<unknown_module>' ELSE m END AS module, string_split(string_split(q, ':')[-1], '.')[-1] AS simple, regexp_replace(q, '^[^:]*:', '') AS qualified FROM
(SELECT page_id, url AS q, array_to_string(list_filter(string_split(regexp_replace(regexp_replace('src/' || page_id || '/' || substr(url, 9) || '.py', '^src/', ''), '\\.py$', ''), '/'), lambda x: x <> ''), '.') AS m FROM pages)""")
def dotted_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/"), F.col("page_id").cast("string"), F.lit("/"), F.expr("substring(url, 9)"), F.lit(".py"))
    return t(spark, sf_dir, "pages").select("page_id", text.dotted_module(path).alias("module"), text.simple_name(F.col("url")).alias("simple"), text.qualified_name(F.col("url")).alias("qualified"))


@query("""SELECT page_id, regexp_extract_all(html, '<(\\w+)', 1)[-1] AS last FROM pages""")
def last_regex_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", text.last_match(F.col("html"), r"<([A-Za-z0-9_]+)").alias("last"))


@query("""SELECT o_orderkey, CASE WHEN b <> 0 AND a = 0 THEN 'reproduced' WHEN b = 0 THEN 'pass_in_buggy' ELSE 'fail_in_fixed' END AS status, (b <> 0 AND a = 0) AS reproduced
FROM (SELECT o_orderkey, o_orderkey % 3 AS b, o_custkey % 2 AS a FROM orders)""")
def status_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("buggy_returncode"), (F.col("o_custkey") % 2).alias("fixed_returncode"))
    return outcomes.statuses(runs).select("o_orderkey", "status", "reproduced")


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 9 + 1 AS b, o_custkey % 4 AS f FROM orders),
x AS (SELECT o_orderkey, 'The test failed at line ' || b || ' with exception: ValueError.' AS bo, CASE WHEN f = 0 THEN 'The test passed.' ELSE 'The test failed at line ' || (f + 3) || ' with exception: Exception.' END AS ao, b = f + 3 AND f <> 0 AS same FROM r)
SELECT o_orderkey, CASE WHEN same THEN ao ELSE bo END AS before, ao AS after FROM x""")
def outcome_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = 'File "/testbed/reproducer.py", line '
    b, f = F.col("o_orderkey") % 9 + 1, F.col("o_custkey") % 4
    runs = t(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit(1).alias("buggy_returncode"), f.alias("fixed_returncode"),
        F.concat(F.lit(place + "1\n" + place), b.cast("string"), F.lit("\n  | ValueError: bad value\n")).alias("buggy_stdout"),
        F.concat(F.lit(place), (f + 3).cast("string"), F.lit("\n")).alias("fixed_stdout"),
    )
    return outcomes.seeded(runs).select("o_orderkey", "before", "after")


@query("""SELECT doc_id, side, 'f' || CAST(doc_id % 5 AS VARCHAR) || '.py' AS path, CASE side WHEN 'added' THEN '2,3' ELSE '2' END AS lines FROM documents, (VALUES ('added'), ('removed')) s(side)""")
def diff_lines_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document."""
    name = F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string"), F.lit(".py"))
    patch = F.concat(F.lit("diff --git a/x b/x\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1,3 +1,4 @@ def f\n a\n-b\n+c\n+d\n e\n"))
    lines = patches.patch_lines(t(spark, sf_dir, "documents").select("doc_id", patch.alias("model_patch")), ["doc_id"])
    return patches.lines_by_file(lines, ["doc_id"]).select("doc_id", "side", "path", F.array_join("lines", ",").alias("lines"))


@query("""SELECT doc_id, 'A.f' || doc_id || '.<locals>.<lambda>,g' AS names FROM documents""")
def modified_qualnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("class A:\n    def f"), F.col("doc_id").cast("string"), F.lit("(self):\n        return [x for x in (lambda: 1)()]\n\ndef g():\n    return 2\n"))
    docs = t(spark, sf_dir, "documents").select("doc_id", F.lit("m.py").alias("path"), code.alias("text"))
    lines = docs.select("doc_id", "path", F.lit("added").alias("side"), F.explode(F.array(F.lit(3), (F.col("doc_id") % 2 + 5).cast("int"))).alias("line"))
    return patches.modified_names(lines, docs, ["doc_id"], "added").select("doc_id", F.array_join("qualnames", ",").alias("names"))
