"""Writers: tables partitioned by what readers filter on, and keyed JSON where a file format asks for it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from tracewise.operators.joins import only_new

#: Characters of a JSON document after which a writer begins another file: readers take a file's document as one value.
DOCUMENT = 1 << 22


def write_generation(predictions: DataFrame, usage: DataFrame, path: str) -> None:
    """Predictions and token usage as two tables."""
    predictions.write.mode("overwrite").partitionBy("task", "agent", "model").parquet(f"{path}/predictions")
    usage.write.mode("overwrite").parquet(f"{path}/token_usage")


def write_evaluation(scores: DataFrame, statistics: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").partitionBy("task", "agent", "model").parquet(f"{path}/scores")
    statistics.write.mode("overwrite").parquet(f"{path}/statistics")


def append_new(rows: DataFrame, existing: DataFrame | None, on: list[str], path: str) -> None:
    """Append rows whose key isn't there yet."""
    (only_new(rows, existing, on) if existing is not None else rows).write.mode("append").parquet(path)


def append_by_batches(pending: DataFrame, work: Callable[[DataFrame], DataFrame], on: list[str], path: str, batches: int = 16) -> None:
    """Append work(rows) batch by batch, so that a run that failed goes on where it stopped: keys that path has aren't worked on again.

    Keys are dealt to batches by hash. A batch is one write, which shows in whole or not at all.
    """
    spark = pending.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    for k in range(batches):
        rows = pending.where(F.pmod(F.xxhash64(*on), F.lit(batches)) == k)
        there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        append_new(work(only_new(rows, spark.read.parquet(path), on) if there else rows), None, on, path)


def write_sorted(rows: DataFrame, path: str, *keys: str) -> None:
    """JSON lines in the order of keys, within files and from file to file."""
    rows.orderBy(*keys).write.mode("overwrite").json(path)


def write_gold_apart(rows: DataFrame, path: str, gold_path: str) -> None:
    """Rows of gold in a place of their own, the others without them."""
    gold = F.col("agent").eqNullSafe(F.lit("gold"))
    rows.where(gold).write.mode("overwrite").parquet(gold_path)
    rows.where(~gold).write.mode("overwrite").parquet(path)


def write_by_agent(rows: DataFrame, path: str) -> None:
    """One folder per agent; gold is one of them."""
    rows.write.mode("overwrite").partitionBy("agent").parquet(path)


def context_and_truth(questions: DataFrame, renames: dict[str, str], context: list[str], truth: list[str]) -> tuple[DataFrame, DataFrame]:
    """The two column subsets of a question, with renames."""
    out = questions.withColumnsRenamed(renames)
    keys = [c for c in ("agent", "instance_id") if c in out.columns]
    return out.select(*keys, *context), out.select(*keys, *truth)


def write_questions(questions: DataFrame, path: str, renames: dict[str, str], context: list[str], truth: list[str]) -> None:
    """Keyed JSON of contexts and of truths, a folder of each per agent."""
    for name, part in zip(("context", "ground_truths"), context_and_truth(questions, renames, context, truth), strict=True):
        write_keyed_json(part, f"{path}/{name}", ["instance_id"], by="agent")


def allow_list(rows: DataFrame) -> DataFrame:
    """agent, and instance_id -> sorted functions as one JSON object: for a look at a list. write_allow_list writes lists of any size."""
    own = rows.groupBy("agent", "instance_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("functions")))).alias("functions"))
    return own.groupBy("agent").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("instance_id", "functions"))))).alias("value"))


def keyed_json_text(rows: DataFrame, key: str = "instance_id") -> DataFrame:
    """One row: {key: {other columns}} with sorted keys. For a look at a small table, as all rows meet in it; write_keyed_json writes tables of any size."""
    rest = [c for c in rows.columns if c != key]
    return rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, F.struct(*rest).alias("v")))))).alias("value"))


def write_keyed_json(rows: DataFrame, path: str, keys: list[str], value: Column | None = None, by: str | None = None, wrap: str | None = None, head: Column | None = None, files: int | None = None) -> None:
    """{key: value}, or {key: {key: value}} for two keys, as JSON text files that the keyed readers take.

    Tasks hold ranges of the keys in order and write files of them, each of which is one JSON object
    with a line per innermost key. One ends with the key by which it has DOCUMENT characters, so
    neither a task nor a reader holds the table, and one file is one JSON document where the rows
    make one partition of fewer. value: the JSON value of a row, its other columns
    as an object if not given. by: a folder per value of this column. wrap: the object is under
    this name; head: JSON members, the same in all rows, that stand before it. Rows without a
    key are under "null"; keys are to be unique. files: how many ranges; else by their size. An empty table gives no rows when read.
    """
    rest = [c for c in rows.columns if c not in {*keys, by}]
    text = value if value is not None else F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    own = [F.lit("") if by is None else F.col(by).cast("string"), *(F.col(k).cast("string") for k in keys)]
    lines = rows.select(*(c.alias(f"k{i}") for i, c in enumerate(own)), text.alias("v"), (F.lit(None).cast("string") if head is None else head).alias("head"))
    order = [f"k{i}" for i in range(len(own))]
    inside = len(keys) > 1

    def start(head: str | None) -> str:
        return "{" + (f"{head}, " if head else "") + (f"{json.dumps(wrap)}: {{" if wrap else "")

    end = "}}" if wrap else "}"

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, folder, outer, size, n = [], None, None, 0, 0
        for batch in batches:
            done = []
            for where, *key, v, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and (where != folder or size >= DOCUMENT):
                    done.append((folder, "\n".join([*now, "}" * inside + end])))
                    now = []
                if not now:
                    now, folder, outer, size, comma = [start(h)], where, (), 0, ""
                if inside and (key[0],) != outer:
                    now.append(("}, " if outer else "") + f"{json.dumps(key[0] or 'null', ensure_ascii=False)}: {{")
                    outer, comma = (key[0],), ""
                now.append(f"{comma}{json.dumps(key[-1] or 'null', ensure_ascii=False)}: {v if v is not None else 'null'}")
                size, comma = size + len(now[-1]) + 1, ", "
            yield _documents(done, n)
            n += len(done)
        if now:
            yield _documents([(folder, "\n".join([*now, "}" * inside + end]))], n)

    done = lines.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order).mapInArrow(run, "folder string, n bigint, value string")
    if by is None:
        _one_a_file(done.select("value")).text(path)
    else:  # the writer would sort by folder alone, which needn't keep the documents' order
        _one_a_file(done.withColumnRenamed("folder", by).sortWithinPartitions(by, "n").select(by, "value")).partitionBy(by).text(path)


def _documents(rows: list[tuple], n: int) -> pa.RecordBatch:
    folders, texts = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(folders, pa.string()), pa.array(range(n, n + len(rows)), pa.int64()), pa.array(texts, pa.string())], ["folder", "n", "value"])


def _one_a_file(documents: DataFrame) -> DataFrameWriter:
    return documents.write.mode("overwrite").option("maxRecordsPerFile", 1)


def write_json_array(rows: DataFrame, path: str, *order: str) -> None:
    """[{...}, ...] in JSON text files, one array each, over ranges of the order. An array ends with the item by which it has DOCUMENT characters."""
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("v"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, size = [], 0
        for batch in batches:
            done = []
            for v in batch.column("v").to_pylist():
                now.append((", " if now else "[") + v)
                size += len(now[-1]) + 1
                if size >= DOCUMENT:
                    done.append("\n".join([*now, "]"]))
                    now, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["value"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array(["\n".join([*now, "]"])], pa.string())], ["value"])

    _one_a_file(own.mapInArrow(run, "value string")).text(path)


def write_generation_json(predictions: DataFrame, usage: DataFrame, path: str) -> None:
    """{token_usage: {...}, predictions: {instance_id: [{answer: [...]}]}}. usage: one row; every file states it."""
    total = usage.select(F.to_json(F.struct("completion_tokens", "prompt_tokens", "total_tokens"))).first()[0]
    answers = F.to_json(F.transform("predictions", lambda a: F.struct(a.alias("answer"))))
    write_keyed_json(predictions.select("instance_id", "predictions"), path, ["instance_id"], answers, wrap="predictions", head=F.lit(f'"token_usage": {total}'))


def write_evaluation_json(found: DataFrame, statistics: DataFrame, path: str) -> None:
    """{statistics: {mean, sem}, raw: {instance_id: [scores]}}. found: instance_id, trial, score; every file states the statistics."""
    total = statistics.select(F.to_json(F.struct("mean", "sem"), {"ignoreNullFields": "false"})).first()[0]
    lists = found.groupBy("instance_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("trial", "score"))), lambda x: x["score"]).alias("scores"))
    write_keyed_json(lists, path, ["instance_id"], F.to_json("scores"), wrap="raw", head=F.lit(f'"statistics": {total}'))


def write_allow_list(rows: DataFrame, path: str) -> None:
    """{agent: {instance_id: [functions]}}, all sorted."""
    own = rows.select("agent", "instance_id", F.explode("functions").alias("f")).groupBy("agent", "instance_id").agg(F.array_sort(F.collect_set("f")).alias("functions"))
    write_keyed_json(own, path, ["agent", "instance_id"], F.to_json("functions"))


def exclude_columns(rows: DataFrame, *names: str) -> DataFrame:
    return rows.drop(*names)
