"""Readers of keyed JSON documents, line-wise JSON, traces and patch files. Every schema is given."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewise import schemas
from tracewise.functions.scores import truth_list
from tracewise.functions.source import properties_called


def keyed_json(spark: SparkSession, path: str, value: str, levels: tuple[str, ...] = ("instance_id",)) -> DataFrame:
    """One JSON object per file, {key: value} or {key: {key: value}}: a row per innermost key, with value."""
    kind = value
    for _ in levels:
        kind = f"map<string, {kind}>"
    out = spark.read.text(path, wholetext=True).select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("value"), F.col("_metadata.file_path").alias("source_path"))
    for name in levels:
        rest = [c for c in out.columns if c != "value"]
        # without "outer" Spark adds a filter on the map, which parses each document twice more
        out = out.select(*rest, F.explode_outer("value").alias(name, "value")).where(F.col(name).isNotNull())
    return out


def ground_truths(spark: SparkSession, path: str) -> DataFrame:
    """instance_id, answer as a list, and the pair form's two answers as a list."""
    rows = keyed_json(spark, path, schemas.GROUND_TRUTH_VALUE)
    pair = F.when(F.col("value.before_answer").isNotNull(), F.array("value.before_answer", "value.after_answer"))
    return rows.select("instance_id", F.when(F.col("value.answer").isNotNull(), truth_list(F.col("value.answer"))).alias("answer"), pair.alias("pair"), "source_path")


def contexts(spark: SparkSession, path: str, value: str) -> DataFrame:
    return keyed_json(spark, path, value).select("instance_id", "value.*")


def explanations(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Explanations of one agent."""
    rows = keyed_json(spark, path, "array<string>", ("agent", "instance_id"))
    return rows.where(F.col("agent") == split).select("agent", "instance_id", F.col("value").alias("explanations"))


def patches(spark: SparkSession, path: str) -> DataFrame:
    """instance_id, model_patch; an empty patch is null."""
    return keyed_json(spark, path, schemas.PATCH_VALUE).select("instance_id", F.nullif(F.col("value.model_patch"), F.lit("")).alias("model_patch"))


def prediction_patches(spark: SparkSession, path: str) -> DataFrame:
    """As patches, keyed by the id inside each record; of several the last outer key counts."""
    rows = keyed_json(spark, path, schemas.PATCH_VALUE, ("outer",))
    w = Window.partitionBy("value.instance_id").orderBy(F.desc("outer"))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("value.instance_id", "value.model_patch")


def evaluation_results(spark: SparkSession, path: str) -> DataFrame:
    """instance_id, trial, score of evaluation files, with the statistics they state."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.RESULT_FILE, {"mode": "FAILFAST"}).alias("v"), F.col("_metadata.file_path").alias("source_path"))
    rows = whole.select("source_path", F.col("v.statistics.mean").alias("stated_mean"), F.col("v.statistics.sem").alias("stated_sem"), F.explode("v.raw").alias("instance_id", "scores"))
    return rows.select("source_path", "stated_mean", "stated_sem", "instance_id", F.posexplode("scores").alias("trial", "score"))


def generations(spark: SparkSession, path: str) -> DataFrame:
    """instance_id, trial, answer of generation files, with the token usage they state."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.GENERATION_FILE, {"mode": "FAILFAST"}).alias("v"), F.col("_metadata.file_path").alias("source_path"))
    rows = whole.select("source_path", "v.token_usage.*", F.explode("v.predictions").alias("instance_id", "answers"))
    return rows.select("*", F.posexplode("answers").alias("trial", "a")).select("source_path", "completion_tokens", "prompt_tokens", "total_tokens", "instance_id", "trial", F.col("a.answer").alias("answer"))


def listed_traces(spark: SparkSession, path: str, suffix: str = "*.jsonl") -> DataFrame:
    """path and length of the files below a folder, and an error for those that are empty. Contents aren't read.

    Scans leave empty files out; the listing that Spark makes for any scan has them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(path)
    every = spark.createDataFrame([(x,) for x in files.inputFiles()], "path string")
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  both forms of local paths occur
    own = files.select(same(F.col("_metadata.file_path")).alias("_at"), "length")
    found = every.withColumn("_at", same(F.col("path"))).join(own, "_at", "left").select("path", F.coalesce("length", F.lit(0)).alias("length"))
    return found.withColumn("error", F.when(F.col("length") == 0, F.concat(F.lit("empty trace: "), F.substring_index("path", "/", -1))))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct instance_id of a text list: one a line, quotes, commas and what follows a # aside."""
    line = F.regexp_extract(F.regexp_replace("value", "#.*", ""), r"([^\s\"',\[\]]+)", 1)
    return spark.read.text(path).select(line.alias("instance_id")).where("instance_id != ''").distinct()


def property_tests(spark: SparkSession, path: str) -> DataFrame:
    """instance_id and normalised source of a JSON array of tests."""
    return spark.read.schema(schemas.PBT).option("multiLine", True).json(path).select("instance_id", properties_called(F.col("pbt")).alias("pbt"))


def json_lines(spark: SparkSession, path: str, schema: str, keyword: str = "", suffix: str = "*.jsonl") -> DataFrame:
    """Line-wise JSON below a folder, files chosen by suffix and by a part of their path; blank lines are skipped."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", suffix).json(path)
    return rows.where(F.col("_metadata.file_path").contains(keyword)) if keyword else rows


def trace_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a table partitioned by agent, instance, test and side; filters on those prune folders."""
    return spark.read.schema(schemas.EVENTS).json(path)


def empty_traces(events: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected traces without an event."""
    return expected.join(events.select(*schemas.TRACE_KEY).distinct(), schemas.TRACE_KEY, "left_anti")


def trace_pair(events: DataFrame, agent: str, instance_id: str, test_id: int = 0, lines: DataFrame | None = None) -> DataFrame:
    """Both sides' events of a test. lines (agent, instance_id, PATCH_LINES) adds patch_lines, the lines of the event's file that the patch removed (buggy side) or added (patched side)."""
    one = (F.col("agent") == agent) & (F.col("instance_id") == instance_id)
    pair = events.where(one & (F.col("test_id") == test_id))
    if lines is None:
        return pair
    touched = lines.where(one).groupBy(F.when(F.col("side") == "removed", "buggy").otherwise("patched").alias("side"), F.col("path").alias("filepath")).agg(F.array_sort(F.collect_set("line")).alias("patch_lines"))
    return pair.join(touched, ["side", "filepath"], "left").select(*events.columns, F.coalesce("patch_lines", F.array().cast("array<int>")).alias("patch_lines"))


def inspection_pairs(inspections: DataFrame, on: list[str]) -> DataFrame:
    """Inspections side by side. Where one side is missing, all values are null, of the other side too."""
    values = ["expr", "value", "exception"]
    a, b = (inspections.where(F.col("side") == s).select(*on, *(F.col(c).alias(f"{s}_{c}") for c in values), F.lit(True).alias(f"_{s}")) for s in ("buggy", "patched"))
    both = F.col("_buggy") & F.col("_patched")
    return a.join(b, on, "full").select(*on, *(F.when(both, F.col(f"{s}_{c}")).alias(f"{s}_{c}") for s in ("buggy", "patched") for c in values))


def instance_ids(instances: DataFrame, wanted: str | list[str], exclusions: DataFrame | None = None) -> DataFrame:
    """all, parts of repository names, or ids; less the exclusions."""
    parts = [wanted] if isinstance(wanted, str) else wanted
    repo = F.substring_index("instance_id", "-", 1)
    found = instances
    if parts != ["all"]:
        keep: Column = F.col("instance_id").isin(*parts)
        for p in parts:
            keep = keep | repo.contains(p)
        found = instances.where(keep)
    return found.join(exclusions.select("instance_id"), "instance_id", "left_anti") if exclusions is not None else found


def failing_tests(dataset: DataFrame, overrides: DataFrame) -> DataFrame:
    """instance_id, test_id, test of the tests that a fix must repair. overrides: instance_id, tests."""
    parsed = dataset.select("instance_id", F.from_json("FAIL_TO_PASS", "array<string>").alias("parsed"))
    joined = parsed.join(overrides, "instance_id", "left")
    return joined.select("instance_id", F.posexplode(F.coalesce("tests", "parsed")).alias("test_id", "test"))


def by_suffix(rows: DataFrame, suffix: str) -> DataFrame:
    return rows.where(F.col("instance_id").endswith(suffix))


def by_pattern(rows: DataFrame, part: str) -> DataFrame:
    return rows.where(F.col("instance_id").contains(part))


def patch_files(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """instance_id (the file's name) and text of patch files; expected ids without a file have null."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.(?:diff|patch)$", 1)
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(name.alias("instance_id"), F.col("value").alias("model_patch")).where("instance_id != ''")
    return expected.select("instance_id").join(files, "instance_id", "left") if expected is not None else files


def listed_instances(spark: SparkSession, path: str) -> DataFrame:
    return patch_files(spark, path).select("instance_id").distinct().orderBy("instance_id")


def allowed_functions(spark: SparkSession, path: str) -> DataFrame:
    """agent, instance_id, functions of an allow list."""
    return keyed_json(spark, path, "array<string>", ("agent", "instance_id")).select("agent", "instance_id", F.col("value").alias("functions"))


def predictions_path(folder: str, agent: str) -> str:
    """Where an agent's predictions lie; gold is a name of its own."""
    return "gold" if agent == "gold" else posixpath.join(folder, f"{agent}.json")


def result_path(folder: str, mode: str, task: str, agent: str, model: str, audit: bool = False) -> str:
    return posixpath.join(folder, mode, task, f"{'audit_' * audit}{agent}__{model.replace('/', '-')}.json")


def result_parts(path: Column) -> Column:
    """task, agent, model and audit of a result file's path."""
    name = F.regexp_extract(path, r"([^/]+)\.json$", 1)
    agent = F.substring_index(name, "__", 1)
    return F.struct(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("task"), F.regexp_replace(agent, "^audit_", "").alias("agent"), F.substring_index(name, "__", -1).alias("model"), agent.startswith("audit_").alias("audit"))
