"""Writers and readers together, orders of rows, and answers of a form."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tracewise.operators import ordering
from tracewise.plans import jobs
from tracewise.sources import keyed, sinks


def objects(path, suffix="part-*"):
    return [json.loads(p.read_text()) for p in sorted(Path(path).rglob(suffix)) if p.stat().st_size]


def test_keyed_json_is_written_in_parts_and_read_again(spark, tmp_path):
    keys = ["é\"q", "a\\b", "x y", "\n"] + [f"k{i:04}" for i in range(3000)]
    rows = spark.createDataFrame([(k, i, None if i % 7 == 0 else "v\n\"" + k) for i, k in enumerate(keys)], "instance_id string, n int, t string").repartition(5)
    sinks.write_keyed_json(rows, f"{tmp_path}/x", ["instance_id"], files=3)
    parts = objects(f"{tmp_path}/x")
    assert len(parts) > 1 and sum(map(len, parts)) == len(keys)
    got = {r["instance_id"]: (r["value"]["n"], r["value"]["t"]) for r in keyed.keyed_json(spark, f"{tmp_path}/x", "struct<n: int, t: string>").collect()}
    assert got == {k: (i, None if i % 7 == 0 else "v\n\"" + k) for i, k in enumerate(keys)}
    sinks.write_keyed_json(rows, f"{tmp_path}/one", ["instance_id"], files=1)
    assert [k for p in objects(f"{tmp_path}/one") for k in p] == sorted(keys)


def test_a_document_is_bounded_whatever_a_task_holds(spark, tmp_path):
    wide = F.lpad(F.col("id").cast("string"), 1000, "x")
    rows = spark.range(20000).select((F.col("id") % 2).cast("string").alias("agent"), F.col("id").cast("string").alias("instance_id"), wide.alias("t")).coalesce(1)
    sinks.write_keyed_json(rows.drop("agent"), f"{tmp_path}/x", ["instance_id"], files=1)
    sinks.write_keyed_json(rows, f"{tmp_path}/by", ["instance_id"], by="agent", files=1)
    sinks.write_keyed_json(rows, f"{tmp_path}/two", ["agent", "instance_id"], files=1)
    sinks.write_json_array(rows.drop("agent"), f"{tmp_path}/a", "instance_id")
    assert [k for p in objects(f"{tmp_path}/x") for k in p] == sorted(map(str, range(20000)))
    for agent in "01":
        assert [k for p in objects(f"{tmp_path}/by/agent={agent}") for k in p] == sorted(str(i) for i in range(20000) if i % 2 == int(agent))
        assert [k for p in objects(f"{tmp_path}/two") for k in p.get(agent, {})] == sorted(str(i) for i in range(20000) if i % 2 == int(agent))
    assert [x["instance_id"] for p in objects(f"{tmp_path}/a") for x in p] == sorted(map(str, range(20000)))
    for p in tmp_path.rglob("part-*"):
        assert p.stat().st_size < sinks.DOCUMENT + 10_000
    assert keyed.keyed_json(spark, f"{tmp_path}/x", "struct<t: string>").count() == 20000


def test_two_keys_folders_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([("m", "b", ["g", "f"]), ("m", "b", ["f", "a"]), ("n", "a", []), ("m", "a", ["h"]), ("n", None, ["z"])], "agent string, instance_id string, functions array<string>")
    sinks.write_allow_list(rows, f"{tmp_path}/allow")
    got = {(r["agent"], r["instance_id"]): r["functions"] for r in keyed.allowed_functions(spark, f"{tmp_path}/allow").collect()}
    assert got == {("m", "a"): ["h"], ("m", "b"): ["a", "f", "g"], ("n", "null"): ["z"]}
    many = spark.range(4000).select((F.col("id") % 3).cast("string").alias("agent"), F.col("id").cast("string").alias("instance_id"), F.col("id").alias("v"))
    sinks.write_keyed_json(many, f"{tmp_path}/by", ["instance_id"], by="agent", files=4)
    for agent in "012":
        found = {k: x["v"] for o in objects(f"{tmp_path}/by/agent={agent}") for k, x in o.items()}
        assert found == {str(i): i for i in range(4000) if i % 3 == int(agent)}
    sinks.write_keyed_json(many.limit(0), f"{tmp_path}/none", ["instance_id"])
    assert keyed.keyed_json(spark, f"{tmp_path}/none", "struct<v: int>").count() == 0


def test_generation_and_evaluation_files(spark, tmp_path):
    predictions = spark.createDataFrame([("i", [["a"], ["b", "c"]]), ("j", [["d"], []])], "instance_id string, predictions array<array<string>>")
    usage = spark.createDataFrame([(5, 7, 12)], "completion_tokens bigint, prompt_tokens bigint, total_tokens bigint")
    sinks.write_generation_json(predictions, usage, f"{tmp_path}/g")
    rows = keyed.generations(spark, f"{tmp_path}/g").collect()
    assert {(r["instance_id"], r["trial"]): r["answer"] for r in rows} == {("i", 0): ["a"], ("i", 1): ["b", "c"], ("j", 0): ["d"], ("j", 1): []}
    assert {(r["completion_tokens"], r["prompt_tokens"], r["total_tokens"]) for r in rows} == {(5, 7, 12)}
    found = spark.createDataFrame([("i", 1, 0.5), ("i", 0, 1.0), ("j", 0, 0.0), ("j", 1, 0.25)], "instance_id string, trial int, score double")
    sinks.write_evaluation_json(found, spark.createDataFrame([(0.4375, None)], "mean double, sem double"), f"{tmp_path}/e")
    got = sorted((r["instance_id"], r["trial"], r["score"], r["stated_mean"], r["stated_sem"]) for r in keyed.evaluation_results(spark, f"{tmp_path}/e").collect())
    assert got == [("i", 0, 1.0, 0.4375, None), ("i", 1, 0.5, 0.4375, None), ("j", 0, 0.0, 0.4375, None), ("j", 1, 0.25, 0.4375, None)]


def test_questions_go_to_a_folder_per_agent(spark, tmp_path):
    q = spark.createDataFrame([("m", "i", ["x", "y"], ["a"]), ("n", "i", ["z"], ["b"])], "agent string, instance_id string, options array<string>, answer array<string>")
    sinks.write_questions(q, f"{tmp_path}", {"options": "choices"}, ["choices"], ["answer"])
    assert objects(f"{tmp_path}/context/agent=m") == [{"i": {"choices": ["x", "y"]}}]
    assert keyed.ground_truths(spark, f"{tmp_path}/ground_truths/agent=n").first()["answer"] == ["b"]


def test_empty_trace_files_are_errors(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.jsonl").write_text('{"event_id": 1}\n')
    (tmp_path / "a" / "t wo.jsonl").write_text("")
    (tmp_path / "a" / "other.txt").write_text("")
    got = {r["path"].rsplit("/", 1)[-1]: (r["length"], r["error"]) for r in keyed.listed_traces(spark, str(tmp_path)).collect()}
    assert got == {"one.jsonl": (16, None), "t%20wo.jsonl": (0, "empty trace: t%20wo.jsonl")}


def test_lists_of_ids(spark, tmp_path):
    (tmp_path / "ids").write_text("IDS = [\n    # a reason\n".replace("IDS = [", "[") + '    "a__a-1",\n    "b__b-2", # another\n]\nc__c-3\nc__c-3\n')
    excluded = keyed.id_list(spark, str(tmp_path / "ids"))
    assert sorted(r[0] for r in excluded.collect()) == ["a__a-1", "b__b-2", "c__c-3"]
    every = spark.createDataFrame([("a__a-1",), ("a__a-9",)], "instance_id string")
    assert [r[0] for r in keyed.instance_ids(every, "all", excluded).collect()] == ["a__a-9"]


@pytest.mark.parametrize("partitions", [1, 7])
def test_places_in_an_order(spark, partitions):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("_part2")).repartition(11)
    got = ordering.with_position(rows, "k", partitions=partitions)
    assert all(r["k"] == r["position"] for r in got.collect())
    assert ordering.with_position(rows.limit(0), "k").count() == 0


def test_answers_come_with_their_prompts_place(spark):
    asked = spark.createDataFrame([(f"id{k:03}", f"prompt {k}") for k in range(200)], "id string, prompt string").repartition(7)
    found, tokens = jobs.generate(asked, lambda model, prompt, n: ([["a"], ["b"]], len(prompt), 1), "m", ["id"], 2, order=["id"])
    rows = sorted((r["position"], r["id"], r["predictions"]) for r in found.collect())
    assert rows == [(k, f"id{k:03}", [["a"], ["b"]]) for k in range(200)]
    assert tokens.agg(F.sum("prompt_tokens")).first()[0] == 200


def test_answers_of_another_form_are_asked_for_again(spark):
    asked = spark.createDataFrame([("good",), ("bad",), ("half",)], "prompt string").coalesce(1)

    def provider(model, prompt, n, tried=[]):  # noqa: B006  counts calls of a worker
        tried.append(prompt)
        if prompt == "bad":
            return ['{"answer": ["ab"]}', "no json"][:n], 1, 2
        right = ['{"answer": ["a"]}', '{"answer": ["b", "c"]}']
        if prompt == "half" and tried.count("half") == 1:
            return [right[0], '{"answer": []}'], 1, 2
        return right[:n], 1, 2

    got = {r["prompt"]: r for r in jobs.answered(asked, provider, "m", 2, tries=3, wait=0.0, schema="choice").collect()}
    assert (got["good"]["predictions"], got["good"]["error"], got["good"]["total_tokens"]) == ([["a"], ["b", "c"]], None, 3)
    assert (got["half"]["predictions"], got["half"]["error"], got["half"]["total_tokens"]) == ([["a"], ["a"]], None, 6)
    assert got["bad"]["predictions"] == [] and got["bad"]["error"].startswith(("ValueError", "JSONDecodeError")) and got["bad"]["total_tokens"] == 9


def test_forms_of_answers():
    assert jobs.checked('{"before_answer": "a", "after_answer": "b"}', "pair") == ["a", "b"]
    assert jobs.checked('{"expressions": ["x + 1", "f(y)"]}', "expressions") == ["x + 1", "f(y)"]
    for text, kind in (('{"expressions": ["x ="]}', "expressions"), ('{"answer": "a"}', "choice"), ("[]", "choice"), ('{"before_answer": "a"}', "pair"), ('{"answer": [1]}', "choice")):
        with pytest.raises(ValueError):
            jobs.checked(text, kind)


def test_questions_are_formed_once_for_both_files(spark, sf_dir, monkeypatch):
    plans, write = [], sinks.write_keyed_json
    monkeypatch.setattr(sinks, "write_keyed_json", lambda rows, *a, **b: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), write(rows, *a, **b)))
    assert __spark_entry__.queries()["outcome_questions"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert len(plans) == 2 and not any("Join" in p or "EvalPython" in p for p in plans)


def test_a_keyed_document_is_parsed_once(spark, tmp_path):
    for name, text in (("a", '{"a": {"x": "1", "y": null}, "b": {}, "c": null}'), ("b", "{}")):
        (tmp_path / f"{name}.json").write_text(text)
    two = keyed.keyed_json(spark, str(tmp_path), "string", ("outer", "inner"))
    assert sorted((r["outer"], r["inner"], r["value"]) for r in two.collect()) == [("a", "x", "1"), ("a", "y", None)]
    one = keyed.keyed_json(spark, str(tmp_path), "map<string, string>")
    assert sorted(r["instance_id"] for r in one.collect()) == ["a", "b", "c"]
    assert all(df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1 for df in (one, two))
