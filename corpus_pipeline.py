"""The corpus pipeline: language ID, near-duplicates, repeated passages, source mix, packing.

Every stage reads the table its predecessor wrote. Stages fit their models and statistics on their own
input. All but the last return the columns of ``documents``; more columns, whatever their names, pass through.
All stages take empty tables and read texts of any length whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.language import fit, language
from hopweave.llm.mixing import mixed
from hopweave.llm.near_dup import near_groups
from hopweave.llm.packing import packed
from hopweave.llm.repeats import without_repeats
from hopweave.llm.shared import discard, documents, fresh, materialise, scratch, shared_dir, small_batches


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with that language in ``lang``. Null, empty and letterless texts
    are rejected; repeated rows fare alike; ties between languages go to the first in the alphabet."""
    small_batches(spark)
    r = fresh(docs, "found")[0]
    named = docs.withColumn(r, language(docs, fit(docs), "text")).where(~F.col(r)["rejected"])
    return named.select(*[F.col(r)["language"].alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate group, of the smallest doc_id (then hash of the text), and all rows
    without a near copy. Rows repeated in doc_id and text come back once; null and empty texts and rows
    without a doc_id stay as they are; one doc_id on several texts is several documents."""
    small_batches(spark)
    own, th, copies, keep = fresh(docs, "own", "th", "copies", "keep")
    groups = materialise(near_groups(docs).select(F.col("doc_id").alias(own), F.col("th").alias(th), F.col("copies").alias(copies), F.col("keep").alias(keep)), "near")
    same = (docs["doc_id"].cast("long") == F.col(own)) & (F.xxhash64(docs["text"].cast("string")) == F.col(th))
    # hash joins at every size, so the plan that is measured on small tables is the one that runs on large ones
    kept = docs.join(groups.where(~F.col(keep) | (F.col(copies) > 1)).hint("shuffle_hash"), same, "left_anti").select(*_columns(docs))
    several = groups.where(F.col(keep) & (F.col(copies) > 1))
    if several.isEmpty():
        return kept
    # rows kept that are there several times come back once
    again = docs.join(several.hint("shuffle_hash"), same).dropDuplicates([own, th]).select(*_columns(docs))
    return kept.union(again)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they occur first, by doc_id and position; n_chars follows the
    text, and texts that are all such passages go. Null and empty texts and rows without a doc_id stay as they
    are; rows repeated in doc_id and text count as one and are changed alike."""
    small_batches(spark)
    cut = without_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix has copies of them. Null and empty texts stay once; a null source
    or language is a value of its own; repeated rows have the same number of copies each."""
    small_batches(spark)
    return mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training windows. Texts without words have none; a null doc_id stays null; repeated rows
    are packed once each; ties between neighbours go to the smaller hash."""
    small_batches(spark)
    return packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dup", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express k-means centroids, minhash components, suffix trees, Newton steps or greedy paths.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over ``documents``. What a stage writes on its way is deleted once the next table is
    written, as is that table once the one after is."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            path = f"{shared_dir(spark)}/hopweave-{name}-{uuid.uuid4().hex}"
            out.write.parquet(path)
        if i:
            discard(docs)
        docs = spark.read.schema(out.schema).parquet(path)
        docs._written_to = path
    return STAGES[-1][1](spark, docs, sf_dir)
