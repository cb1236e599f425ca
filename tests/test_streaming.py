import json

from tracewise.functions.scores import choice_score
from tracewise.streaming import landing


def test_scores_of_landed_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.jsonl").write_text(json.dumps({"id": f"i{k}", "p": ["a"], "t": ["a", "b"][: k + 1]}) + "\n\n")
    rows = landing.landed_json(spark, str(tmp_path / "in"), "id string, p array<string>, t array<string>")
    landing.append_scores(rows.select("id", choice_score(rows["p"], rows["t"]).alias("score")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("i0", 1.0), ("i1", 0.5)}


def test_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("".join(json.dumps({"k": "x", "ts": f"2024-01-01 00:{m:02}:00"}) + "\n" for m in (1, 2, 11)))
    rows = landing.landed_json(spark, str(tmp_path / "in"), "k string, ts timestamp")
    for name, df in (("w", landing.windowed_counts(rows, "ts", ["k"])), ("s", landing.sessions(rows, "ts", ["k"]))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(r["n"] for r in spark.table(name).collect()) == [1, 2]
