import json

import pytest
from pyspark.sql import functions as F

from tracewise.functions import source, values
from tracewise.operators import outcomes, patches
from tracewise.sources import keyed, sinks

PATCH = """diff --git a/f.py b/f.py
--- a/f.py
+++ b/f.py
@@ -1,3 +1,4 @@ def f
 a
-b
+c
+d
@@ -10 +11 @@
-x

+y
\\ No newline at end of file
diff --git a/new.py b/new.py
--- /dev/null
+++ b/new.py
@@ -0,0 +1,2 @@
+p
+q
"""


def test_touched_lines(spark):
    odd = "diff --git a/x b/x\nBinary files differ\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n\\ No newline at end of file\n"
    df = spark.createDataFrame([(0, PATCH), (1, ""), (2, None), (3, odd)], "id int, p string").select("id", patches.patch_rows(F.col("p")).alias("l"))
    got = {r["id"]: [tuple(x) for x in r["l"]] for r in df.collect()}
    assert got[1] == got[2] == [] and got[3] == [("removed", "y", 1)]
    assert got[0] == [("added", "f.py", 2), ("added", "f.py", 3), ("added", "f.py", 11), ("added", "new.py", 1), ("added", "new.py", 2), ("removed", "f.py", 2), ("removed", "f.py", 10)]


def test_names_of_modified_definitions(spark):
    code = "class A:\n    @dec\n    def f(self):\n        def g():\n            return 1\n        return g\n"
    assert source.definitions(code) == [(1, 6, "A"), (2, 6, "A.f"), (4, 5, "A.f.<locals>.g")]
    lines = spark.createDataFrame([(1, "m.py", "added", 5), (1, "m.py", "added", 2), (1, "m.py", "added", 99), (1, "m.txt", "added", 1)], "id int, path string, side string, line int")
    files = spark.createDataFrame([(1, "m.py", code), (1, "m.txt", "x")], "id int, path string, text string")
    assert patches.modified_names(lines, files, ["id"], "added").first()["qualnames"] == ["A.f", "A.f.<locals>.g"]


def test_source_rewrites():
    text = 'import x\n@given(s())\ndef p(a):\n    "doc"\n    return a\nif __name__ == "__main__":\n    p()\n'
    done = source.runnable_properties(text)
    assert "__main__" not in done
    assert done.endswith("p()")
    assert "doc" not in source.without_docstrings(text)
    assert source.without_docstrings("def (") == "def ("
    assert source.find_function("class A:\n    def f(self):\n        return 1\n\ndef f():\n    return 2", "f", "return 2") == "def f():\n    return 2"
    assert source.is_expression("a.b + 1") and not source.is_expression("3") and not source.is_expression("a = 1")


def test_values():
    assert values.parse("[1e999, 123456789012345678901, 3]") == ["inf", "123456789012345678901", 3]
    assert values.pruned({"a": {"b": {"c": 1}}, "d": [1]}, 1) == {"a": {"b": {"py/object": "builtins.dict"}}, "d": [1]}
    assert list(values.difference([1, 2], [1])) == [("iterable_item_removed", "root[1]", 2, None)]
    assert list(values.difference({"a": 1}, {"a": "1"})) == [("type_changes", "root['a']", 1, "1")]


def test_outcomes(spark):
    place = 'File "/testbed/reproducer.py", line '
    rows = [
        (1, place + "3\nValueError: no\n", 1, "", 0),
        (2, place + "3\n  | KeyError: k\n", 1, place + "5\n", 1),
        (3, place + "3\nValueError\n", 1, place + "3\nOSError", 1),
        (4, "", 1, "", 0),
        (5, "", 0, "", 0),
    ]
    runs = spark.createDataFrame(rows, "id int, buggy_stdout string, buggy_returncode int, fixed_stdout string, fixed_returncode int")
    got = {r["id"]: (r["before"], r["after"], len(r["options"])) for r in outcomes.seeded(runs).collect()}
    assert got[1] == ("The test failed at line 3 with exception: ValueError.", outcomes.PASSED, 2)
    assert got[2] == ("The test failed at line 3 with exception: KeyError.", "The test failed at line 5 with exception: Exception.", 3)
    assert got[3][0] == got[3][1]
    assert got[4][0] == "The test failed at line NA with exception: Timeout."
    assert 5 not in got
    assert {r["id"]: r["status"] for r in outcomes.statuses(runs).collect()}[1] == "reproduced"


def test_keyed_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"a": {"answer": ["d"]}, "b": {"answer": "c"}, "e": {"before_answer": "b", "after_answer": "e"}}))
    got = {r["instance_id"]: (r["answer"], r["pair"]) for r in keyed.ground_truths(spark, str(tmp_path / "g.json")).collect()}
    assert got == {"a": (["d"], None), "b": (["c"], None), "e": (None, ["b", "e"])}
    (tmp_path / "r.json").write_text(json.dumps({"statistics": {"mean": 0.5, "sem": 0.5}, "raw": {"a": [1.0, 0.0], "b": [1.0, 0.0]}}))
    assert keyed.evaluation_results(spark, str(tmp_path / "r.json")).count() == 4
    (tmp_path / "p.json").write_text(json.dumps({"x": {"instance_id": "a", "model_patch": ""}}))
    assert keyed.patches(spark, str(tmp_path / "p.json")).first()["model_patch"] is None
    (tmp_path / "e.json").write_text(json.dumps({"m": {"a": ["t"]}, "n": {"a": ["u"]}}))
    assert keyed.explanations(spark, str(tmp_path / "e.json"), "n").first()["explanations"] == ["u"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("m", "a", ["g", "f"]), ("m", "b", ["h"])], "agent string, instance_id string, functions array<string>")
    assert json.loads(sinks.allow_list(rows).first()["value"]) == {"a": ["f", "g"], "b": ["h"]}
    path = str(tmp_path / "t")
    sinks.append_new(rows, None, ["instance_id"], path)
    sinks.append_new(rows, spark.read.parquet(path), ["instance_id"], path)
    assert spark.read.parquet(path).count() == 2
    assert json.loads(sinks.keyed_json_text(rows.drop("agent")).first()["value"])["b"] == {"functions": ["h"]}


@pytest.mark.parametrize("wanted,expected", [("all", 2), ("django", 1), (["django__django-1", "sympy"], 2)])
def test_instances(spark, wanted, expected):
    ids = spark.createDataFrame([("django__django-1",), ("sympy__sympy-2",)], "instance_id string")
    assert keyed.instance_ids(ids, wanted).count() == expected
    assert keyed.instance_ids(ids, wanted, ids.where(F.lit(True))).count() == 0


def test_printed_parameters(spark):
    df = spark.createDataFrame([('{"a": [1, true, null, "x"]}',), ("oops",), (None,)], "v string")
    assert [r[0] for r in df.select(values.printed(F.col("v"))).collect()] == ["{'a': [1, True, None, 'x']}\n", None, None]


def test_inspections_with_a_missing_side(spark):
    rows = [("i", "buggy", ["e"], ["1"]), ("i", "patched", ["e"], ["2"]), ("j", "buggy", ["e"], ["1"]), ("k", "patched", ["e"], ["1"])]
    df = spark.createDataFrame(rows, "instance_id string, side string, expr array<string>, value array<string>").withColumn("exception", F.lit(None).cast("array<string>"))
    got = {r["instance_id"]: (r["buggy_value"], r["patched_value"]) for r in keyed.inspection_pairs(df, ["instance_id"]).collect()}
    assert got == {"i": (["1"], ["2"]), "j": (None, None), "k": (None, None)}


def test_trace_pair_with_patch_lines(spark):
    events = spark.createDataFrame([("m", "i", 0, "buggy", "f.py", 1), ("m", "i", 0, "patched", "f.py", 2), ("m", "i", 0, "patched", "g.py", 3), ("m", "j", 0, "buggy", "f.py", 4)], "agent string, instance_id string, test_id int, side string, filepath string, line_number int")
    lines = spark.createDataFrame([("m", "i", "removed", "f.py", 9), ("m", "i", "added", "f.py", 8), ("m", "i", "added", "f.py", 7), ("m", "j", "added", "f.py", 1)], "agent string, instance_id string, side string, path string, line int")
    got = {r["line_number"]: r["patch_lines"] for r in keyed.trace_pair(events, "m", "i", lines=lines).collect()}
    assert got == {1: [9], 2: [7, 8], 3: []}
    assert keyed.trace_pair(events, "m", "i").columns == events.columns


def test_batches_go_on_where_they_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(f"i{k}", k) for k in range(20)], "instance_id string, n int")
    seen, path = [], str(tmp_path / "out")

    def work(df, fail_after):
        seen.append(df.count())
        if len(seen) > fail_after:
            raise RuntimeError("stopped")
        return df

    with pytest.raises(RuntimeError):
        sinks.append_by_batches(rows, lambda df: work(df, 2), ["instance_id"], path, batches=4)
    done = sum(seen[:2])
    seen.clear()
    sinks.append_by_batches(rows, lambda df: work(df, 99), ["instance_id"], path, batches=4)
    assert sum(seen) == 20 - done
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == sorted((f"i{k}", k) for k in range(20))


def test_gold_apart_and_sorted_files(spark, tmp_path):
    rows = spark.createDataFrame([("gold", "b"), ("m", "c"), ("m", "a")], "agent string, instance_id string")
    sinks.write_gold_apart(rows, str(tmp_path / "rest"), str(tmp_path / "gold"))
    assert [r["instance_id"] for r in spark.read.parquet(str(tmp_path / "gold")).collect()] == ["b"]
    assert spark.read.parquet(str(tmp_path / "rest")).where("agent = 'gold'").count() == 0
    sinks.write_sorted(rows, str(tmp_path / "sorted"), "instance_id")
    files = sorted((tmp_path / "sorted").glob("part-*"))
    assert [json.loads(x)["instance_id"] for f in files for x in f.read_text().splitlines()] == ["a", "b", "c"]


def test_error_reports(spark):
    def infos(text):
        return spark.createDataFrame([(text,)], "v string").select(outcomes.error_infos(F.col("v"))).first()[0]

    assert infos(None) is None
    assert infos('{"info_list": []}') == []
    assert [tuple(x) for x in infos('{"info_list": [{"lineno": 3, "exception_type": "KeyError"}]}')] == [(3, "KeyError")]
    for wrong in ('{"info_list": [{"lineno": 3}]}', "{}", "nope"):
        with pytest.raises(Exception):  # noqa: B017
            infos(wrong)
