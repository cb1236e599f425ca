"""Queries over whole tables, against their SQL and plain rules."""

from functools import cache

import duckdb
import pytest

import __spark_entry__
from tests.test_selection import distance
from tracewise.operators import selection

TABLES = {"canonical_json_all": "events", "tolerant_equality_all": "lineitem", "diff_lines_all": "documents"}


def in_duckdb(sql, sf_dir):
    db = duckdb.connect()
    for name in ("events", "lineitem", "documents", "part"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def ordered(rows):
    return sorted(map(repr, (sorted(r.items()) for r in rows)))


@pytest.mark.parametrize("name", TABLES)
def test_every_row_is_read_and_equals_sql(spark, sf_dir, name):
    got = [r.asDict() for r in __spark_entry__.queries()[name](spark, sf_dir).collect()]
    assert ordered(got) == ordered(in_duckdb(__spark_entry__.oracle_sql()[name], sf_dir))
    rows = spark.read.parquet(f"{sf_dir}/{TABLES[name]}.parquet").count()
    assert len(got) == (2 * rows if name == "diff_lines_all" else rows)


def test_infinite_and_wide_numbers_become_text(spark, sf_dir):
    v = {r["event_id"]: r["v"] for r in __spark_entry__.queries()["canonical_json_all"](spark, sf_dir).collect()}
    assert v[4] == '{"x":"inf","y":["9007199254740996",4]}'
    assert (v[5], v[6], v[7]) == ('{"x":9007199254740997}', '{"x":"-inf"}', '{"x":7}')


@cache
def sim(a, b):
    return 1 - distance(a, b) / max(len(a), len(b), 1)


def mean(x, pool):
    return sum(sim(x, y) for y in pool) / len(pool)


def greedy(pool, anchors, k):
    pool, chosen = list(pool), []
    while pool and len(chosen) < k:
        worth = [0.7 * max([sim(x, a) for a in anchors], default=0.0) - (1 - 0.7) * max([sim(x, c) for c in chosen], default=0.0) for x in pool]
        chosen.append(pool.pop(worth.index(max(worth))))
    return chosen


@pytest.fixture(scope="module")
def larger():
    """Some thirty pools."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pools(spark, larger):
    out = {}
    for r in sorted(spark.read.parquet(f"{larger}/part.parquet").collect(), key=lambda r: r["p_partkey"]):
        out.setdefault(r["p_partkey"] // 64, ([], []))[r["p_size"] > 16].append((r["p_partkey"], r["p_name"]))
    assert len(out) > 25
    return out


def test_every_pair_of_a_brand(spark, larger):
    got = [r.asDict() for r in __spark_entry__.queries()["similarity_pairs_all"](spark, larger).collect()]
    assert ordered(got) == ordered(in_duckdb(__spark_entry__.oracle_sql()["similarity_pairs_all"], larger))
    sizes = [r["count"] for r in spark.read.parquet(f"{larger}/part.parquet").groupBy("p_brand").count().collect()]
    assert len(got) == sum(n * (n - 1) // 2 for n in sizes)


def test_names_are_compared_once_however_many_parts_have_them(spark, tmp_path):
    rows = [(k % 1200, ("red bolt", "old ring", "", None)[k % 4 if k < 1500 else 0], (None if k % 9 == 0 else "B#1") if k < 1500 else "B#2") for k in range(2700)] + [(None, "red bolt", "B#1")]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE TABLE part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    sums = ["count(*)", "count(DISTINCT x, y)", "sum(x)", "sum(y)", "sum(x * y)", "sum(d)", "sum(x * d)", "count(d)", "round(sum(s), 2)", "round(sum(s * y), 0)"]
    found = __spark_entry__.queries()["similarity_pairs_all"](spark, str(tmp_path))
    told = ", ".join(sums).replace("x, y)", "(x, y))")
    assert tuple(found.selectExpr(*sums).first()) == db.execute(f"SELECT {told} FROM ({__spark_entry__.oracle_sql()['similarity_pairs_all']})").fetchone()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(vs") < plan.index("levenshtein")


def test_small_parts_meet_all_others_of_their_brand(spark, larger):
    got = [r.asDict() for r in __spark_entry__.queries()["avg_max_similarity_all"](spark, larger).collect()]
    assert ordered(got) == ordered(in_duckdb(__spark_entry__.oracle_sql()["avg_max_similarity_all"], larger))
    parts = spark.read.parquet(f"{larger}/part.parquet").collect()
    for r in got[::50]:
        own = next(p for p in parts if p["p_partkey"] == r["p_partkey"])
        pool = [p["p_name"] for p in parts if p["p_brand"] == own["p_brand"] and p["p_size"] > 16]
        assert (r["mean"], r["best"]) == pytest.approx((mean(own["p_name"], pool), max(sim(own["p_name"], x) for x in pool)), abs=2e-9)


def test_anchors_of_whole_pools(spark, larger, pools):
    got = {}
    for r in __spark_entry__.queries()["hard_anchor_topk_all"](spark, larger).collect():
        got.setdefault(r["pool"], {})[r["rank"]] = r["relevance"]
    for b, (small, large) in pools.items():
        values = sorted((mean(x, [n for _, n in large]) for _, x in small), reverse=True)
        assert [got[b][k] for k in (1, 2)] == pytest.approx(values[:2], abs=1e-8)


def test_diverse_choice_of_whole_pools(spark, larger, pools):
    got = {r["pool"]: r["chosen"] for r in __spark_entry__.queries()["mmr_select_all"](spark, larger).collect()}
    assert got == {b: "|".join(greedy([n for _, n in large], [n for _, n in small], 3)) for b, (small, large) in pools.items()}


def test_questions_of_whole_pools(spark, larger, pools):
    got = {r["pool"]: (r["choices"].split("|"), r["answer"]) for r in __spark_entry__.queries()["question_choices"](spark, larger).collect()}
    for b, pools in pools.items():
        small, large = ([n for _, n in p] for p in pools)
        choices, answer = got[b]
        right = [] if b % 5 == 1 else [max(small, key=lambda x: mean(x, large))]
        wrong = greedy(large, right, 3) if right else greedy(large + small, [], 4)
        assert sorted(choices[:4]) == sorted(right + wrong) and choices[4:] == [selection.NONE, selection.UNKNOWN]
        assert [choices["abcdef".index(x)] for x in answer] == (right or [selection.NONE])
