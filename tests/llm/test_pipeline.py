"""The pipeline, stage by stage, against plain statements of its stages' rules."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.llm.test_documents import plain_counts
from tests.llm.test_near_duplicates import components, plain_lines
from tracewise.llm import shared


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows before and after each stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
    return out


def texts(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_all_but_the_last_keep_the_columns(stages):
    for rows in stages[1:5]:
        assert set(rows[0].asDict()) == set(stages[0][0].asDict())
        assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_rules_keep_good_documents(stages, spark, sf_dir):
    kept = {r["doc_id"] for r in stages[1]}
    for i, t in texts(stages[0]):
        n, _, _, _, repeated = plain_counts(t)
        assert not (i in kept and (n < 50 or 100 * repeated > 50 * n))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    passed = [i for i, t in texts(stages[0]) if i in labels and plain_counts(t)[0] >= 50 and 2 * plain_counts(t)[4] <= plain_counts(t)[0]]
    assert sum((i in kept) == (labels[i] == 1) for i in passed) >= 0.97 * len(passed)


def test_lines(stages):
    """Documents that lost all their words go; what else has none was so before."""
    before = dict(texts(stages[1]))
    assert dict(texts(stages[2])) == {i: t for i, t in plain_lines(texts(stages[1])).items() if re.search(r"[^\x20\x09-\x0D]", t) or t == before[i]}


def test_near_duplicates(stages):
    found = components(texts(stages[2]), 5, 800)
    assert {i for i, _ in texts(stages[3])} == {i for i, (_, c) in found.items() if i == c}


def test_personal_data(stages):
    pattern = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}")
    before, after = dict(texts(stages[3])), dict(texts(stages[4]))
    assert set(before) == set(after)
    assert any(pattern.search(t) for t in before.values())
    assert not any(set(pattern.findall(before[i])) & set(pattern.findall(t)) for i, t in after.items())
    assert all(after[i] == t for i, t in before.items() if not re.search(r"[0-9@]", t))


def test_packing_keeps_every_token(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts(stages[4])}
    got = {}
    for r in stages[5]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == total


CLASHING = ["kept", "n_words", "clean", "base_failed", "_w", "_l", "_c", "_pattern", "_gone", "_hit", "_at", "_p", "_rest", "row", "gone", "n_lines", "n_removed", "n_found", "h1", "first", "key", "rank", "salt", "a column"]


def test_any_table_passes_through(spark, tmp_path):
    """Nulls, an empty text, repeated rows, a shared doc_id, names that the stages use themselves."""
    prose = [" ".join(f"word{(7 * i + j * j) % 97}x{j % (11 + i)}" for j in range(70)) for i in range(4)]
    rows = [(1, prose[0]), (2, prose[1]), (2, prose[1]), (3, None), (4, ""), (None, prose[2]), (5, prose[0]), (6, prose[0] + " end"), (7, prose[3]), (None, None)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, "doc_id bigint, text string").withColumn("n_chars", F.char_length("text").cast("bigint")).withColumns({c: F.lit(c) for c in CLASHING})
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{len(given)}-{k}"
            stage(spark, docs, "").write.parquet(path)
            columns, docs = docs.columns, spark.read.parquet(path)
            assert k == 4 or docs.columns == columns and all(r[c] == c for r in docs.collect() for c in CLASHING), name
            if k == 3:
                assert sorted((r["doc_id"] or 0) for r in docs.collect()) == ([0, 1, 2, 2, 7] if given else [])
        assert (docs.count() > 0) == bool(given)


def test_run_is_registered(spark, sf_dir, stages):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    first = corpus_pipeline.run(spark, sf_dir)
    second = corpus_pipeline.run(spark, sf_dir)
    assert first.count() == second.count() == len(stages[5])


def test_a_run_leaves_nothing_but_its_result(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 89}x{j}" for j in range(80))) for i in range(1, 9)], "doc_id bigint, text string").withColumn("n_chars", F.lit(1).cast("bigint"))
    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    for module in (shared, corpus_pipeline):
        monkeypatch.setattr(module, "shared_folder", lambda spark: f"file://{tmp_path}/scratch")
    runs = [corpus_pipeline.run(spark, f"{tmp_path}/sf") for _ in range(2)]
    left = [p for p in (tmp_path / "scratch").iterdir() if not p.name.startswith(".")]
    assert [p.name.split("-")[0] for p in left] == ["pipeline", "pipeline"]
    assert [[q.name for q in p.iterdir() if not q.name.startswith(".")] for p in left] == [["4"], ["4"]]
    assert runs[0].count() == runs[1].count() > 0
