from pyspark.sql import functions as F

from tracewise.operators.joins import EXCEPTION
from tracewise.plans import jobs


def test_generate_and_evaluate(spark):
    contexts = spark.createDataFrame([("a", "x = 1", ["p", "q"]), ("b", "y = 2", ["r", "s"])], "id string, line string, choices array<string>")
    expl = spark.createDataFrame([("a", ["because"])], "id string, explanations array<string>")
    asked = jobs.prompts(jobs.TASKS["local_effect"], contexts, expl, ["id"], ["line"])
    shown = {r["id"]: r["prompt"] for r in asked.collect()}
    assert "Explanation:\nbecause" in shown["a"] and "Explanation:\nEMPTY" in shown["b"] and "a) p\nb) q" in shown["a"]

    def provider(model, prompt, n):
        if "y = 2" in prompt:
            raise TimeoutError("no answer")
        return [["a"], ["b"], ["ab"]][:n], 7, len(prompt)

    predictions, tokens = jobs.generate(asked, provider, "m", ["id"], 3, tries=2, wait=0.0)
    assert {r["id"]: r["predictions"] for r in predictions.collect()} == {"a": [["a"], ["b"]], "b": []}
    assert tokens.agg(F.sum("completion_tokens")).first()[0] == 7
    truths = spark.createDataFrame([("a", ["a"]), ("b", ["b"])], "id string, answer array<string>")
    scored, stats = jobs.evaluate(jobs.TASKS["local_effect"], predictions, truths, ["id"])
    assert sorted(tuple(r) for r in scored.collect()) == [("a", 0, 1.0), ("a", 1, 0.0)]
    assert stats.first()["mean"] == 0.5


def test_validated_questions(spark):
    found = spark.createDataFrame([("m", "i")], "agent string, instance_id string")
    none = F.array_repeat(F.lit(None).cast(EXCEPTION), 4)
    pairs = spark.createDataFrame([("m", "i", ["a", "b", "c", "d"], ["1", "2", "3", "4"], ["9", "2", "3", "4"])], "agent string, instance_id string, buggy_expr array<string>, buggy_value array<string>, patched_value array<string>")
    out = jobs.validated(found, pairs.withColumn("buggy_exception", none).withColumn("patched_exception", none), ["agent", "instance_id"])
    row = out.first()
    assert (row["valid_changed_expressions"], row["valid_unchanged_expressions"]) == (["a"], ["b", "c", "d"])
    q = jobs.build_questions(out.withColumn("is_fallback_to_gold", F.lit(False))).first()
    assert q["choices"]["abcdef".index(q["answer"][0])] == "a"
