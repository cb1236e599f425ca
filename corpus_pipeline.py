"""A corpus pipeline of five stages over documents: quality rules, line dedup, near duplicates, personal data, packing.

Each stage works on all that its predecessor kept, written as Parquet in between. A run owns its
scratch tables: those of a stage go once its result is written, and that result goes once the
next stage's is. What run() returns is a written table, which other runs don't touch. A stage that
is called by itself leaves its scratch tables until the stage after it is called for the same
sf_dir, as its result is written by then.

Cases: null texts go with the first stage, as they have no words. Rows without a doc_id are
kept by the stages that compare documents. Rows that share a doc_id are one document: they
stay or go together in the near-duplicate stage, and each is packed. Repeated documents stay
once, by their smallest doc_id. Columns beside doc_id, text and n_chars pass through, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.llm import jaccard, lines, packing, pii, rules
from tracewise.llm.queries import pii_key, tokenizer
from tracewise.llm.shared import collected, collecting, drop, quoted, shared_folder, shuffles_dropped, store, table, with_hit

#: Scratch tables of stages that were called by themselves: (sf_dir, stage) -> paths.
_left: dict[tuple[str, int], list[str]] = {}


def _stage(number: int):
    """A stage that, called outside of a run, drops the scratch tables of the stage before it."""

    def add(f):
        @wraps(f)
        def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if collecting():
                return f(spark, docs, sf_dir)
            for path in _left.pop((sf_dir, number - 1), []):
                drop(spark, path)
            with collected() as written:
                out = f(spark, docs, sf_dir)
            _left.setdefault((sf_dir, number), []).extend(written)
            return out

        return staged

    return add


def _on_texts(docs: DataFrame, stage, keep: Column | None = None) -> DataFrame:
    """docs with the texts that stage makes of doc_id and text, and n_chars counted anew. Its other columns stay apart from the stage's."""
    own = docs.select("doc_id", "text", F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_rest"))
    done = stage(own)
    done = done if keep is None else done.where(keep)
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return done.select(*(new[c].alias(c) if new.get(c) is not None else F.col(f"_rest.{quoted(c)}") for c in docs.columns))


@_stage(0)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base check or are probably poor go. Null and empty texts fail it."""
    own = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_rest"), "text")
    return rules.score(own, keep=("_rest",)).where("kept").select("_rest.*")


@_stage(1)
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies and near copies of lines are taken out of the texts. Documents that lost all their words so go."""
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _on_texts(docs, lines.dedup_lines, left)


@_stage(2)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, the smallest doc_id stays."""
    found = jaccard.join(docs, size=5, per_mille=800)
    copies = store(found.where("component_id < doc_id").select("doc_id").distinct(), "copies")
    own = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_rest"), "doc_id")
    split = with_hit(own, copies, "doc_id")  # only what may be a copy is shuffled
    maybe = split.where("_hit").join(copies, "doc_id", "left_anti").select("_rest.*")
    return maybe.unionByName(split.where("not _hit").select("_rest.*"))


@_stage(3)
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers, dates, addresses and secrets become pseudonyms."""
    return _on_texts(docs, lambda d: pii.pseudonymise(d, pii_key(spark), counts=False))


@_stage(4)
def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("pii", personal_data),
    ("packing", token_packing),
]

#: Estimation, set-similarity joins, keyed permutations and tokenisers aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with collected() as scratch:
            out = stage(spark, docs, sf_dir)
            with shuffles_dropped(spark):
                out.write.parquet(f"{folder}/{k}")
        for path in [*scratch, *([f"{folder}/{k - 1}"] if k else [])]:
            drop(spark, path)
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
