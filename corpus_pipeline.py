"""A corpus pipeline: quality, language, near copies, benchmark passages, packing. Each stage is one operator's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tmspark.cluster import ship
from tmspark.llm import decontaminate, jaccard_join, langid, packing, quality
from tmspark.llm.common import fold_of, materialize


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives 0.7 or more; it learns from the labelled ones outside the held-out fold.

    Null and empty texts get the score of no evidence; repeated rows are judged alike and all stay or go; very long
    texts are judged whole; an empty table gives an empty one. Other columns, whatever their names, pass through."""
    ship(spark)
    held_out = fold_of("doc_id", 4, 2)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    model = quality.train(docs.where(~held_out), labels)
    return docs.where(quality.score_column(F.col("text"), model, spark) >= 0.7)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; they learn from those with a language outside the held-out fold.

    Texts that are null or have no letter are of no language and go; repeated rows are judged alike; an empty table, or
    one without any known language, gives an empty one. Other columns pass through."""
    ship(spark)
    model = langid.train(docs.where(~fold_of("doc_id", 4, 2)))
    return docs.where(langid.language_column(F.col("text"), model, spark)["accepted"])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word similarities of 0.8 or more connect, the one of the smallest id; one row of it.

    A row is told by its id and its text, so unrelated texts of one id are different documents; ids before none. Rows
    without a word (null, empty) are in no group and stay, all of them. Other columns pass through, of repeated rows
    those of one of them. An empty table gives an empty one."""
    ship(spark)
    name = "_document"
    while name in docs.columns:
        name += "_"
    number = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    textless, numbered = docs.where("text is null"), docs.where("text is not null").withColumn(name, number)
    found = jaccard_join.join(numbered.select(name, "text"), n=5, threshold=0.8, id_col=name).where("n_links > 0").distinct()
    found = materialize(found.select(name, (F.col("class_id") == F.col(name)).alias("_stays")))
    # Texts that can't be among the linked ones, by a residue of their number, aren't shuffled.
    residue = F.pmod(F.xxhash64(name), F.lit(1 << 20))
    some = F.broadcast(found.select(residue.alias("_residue")).distinct())
    near, others = (numbered.join(some, residue == F.col("_residue"), kind) for kind in ("left_semi", "left_anti"))
    met = near.select(F.struct(*docs.columns).alias("_row"), name).join(found.hint("merge"), name, "left")
    alone, first = met.where("_stays is null"), met.where("_stays").dropDuplicates([name])
    return textless.unionByName(others.select(docs.columns)).unionByName(alone.select("_row.*")).unionByName(first.select("_row.*"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item.

    Null and empty texts have no window and stay; repeated rows stay or go together; long texts are scanned whole; an
    empty table gives an empty one. Other columns pass through."""
    ship(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10, remove="documents")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 1024 tokens.

    Null texts are empty and are packed as their end id; repeated rows are packed each by itself; longer documents are
    cut; an empty table gives an empty one. Columns but the id aren't read."""
    ship(spark)
    return packing.pack(docs, capacity=1024, end_id=2)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_passages),
    ("best-fit packing", pack_sequences),
]

#: Trained models, a similarity join and tokenisers are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
