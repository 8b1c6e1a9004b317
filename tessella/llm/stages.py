"""The stages of the corpus pipeline, each written as Parquet and read again as the next one's documents.

Each stage works on all documents that its predecessor kept. All but the last return the columns of
`documents`; quality and toxicity drop what they reject, near duplicates keep one row of each
group, mixing drops documents that the mix doesn't take and repeats those that it takes twice.

A stage takes any table with doc_id, text and source: null and repeated ids, null and empty texts, repeated rows and
further columns, also of names that operators give to results, which come out as they were. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import jaccard, mixing, quality, tokens, toxicity
from tessella.llm.common import documents, stored

TOKENIZER = "byte_bpe_50k.json"
ROW, ALL, TEXT = "__row", "__all", "__whole"


def packed(docs: DataFrame) -> DataFrame:
    """All columns as one, which no result's name can clash with, and the text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ALL), F.col("text").alias(TEXT))


def unpacked(docs: DataFrame) -> DataFrame:
    return docs.select(f"{ALL}.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands, fitted to the labelled ones among docs, and the base rules keep; not those without words."""
    slim = packed(docs)
    bands = quality.fit_bands(docs, documents(spark, sf_dir, "labels"))
    return unpacked(quality.quality(slim, text=TEXT, keep=(ALL,), bands=bands).where("kept"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labelled ones among docs, doesn't find toxic; all where there are no labels."""
    chain = toxicity.fit(*toxicity.sample(docs, documents(spark, sf_dir, "labels")))
    return unpacked(toxicity.classify(packed(docs), chain, text=TEXT, keep=(ALL,)).where(~F.col("is_toxic")))


def with_row_key(docs: DataFrame) -> DataFrame:
    """docs with a unique key a row, written before anything joins on it, so that it can't change when a part is computed again."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts: that of the least id, null ids last; of equal ids, any one row.

    Rows are told apart by a key of their own, so repeated and null ids lose and keep no row that they shouldn't.
    """
    docs = with_row_key(docs)
    classes = stored(jaccard.jaccard_join(docs, id=ROW).withColumnRenamed("component_id", "__component"), "classes")
    ids = docs.select(ROW, "doc_id").join(classes.where("n_shingles > 0"), ROW)
    # a least row of each component: partial minima travel, so a component of any size makes no task large
    least = ids.groupBy("__component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW].alias(ROW)).select(ROW)
    wordless = classes.where("n_shingles = 0").select(ROW)
    return docs.join(least.unionByName(wordless), ROW, "left_semi").drop(ROW)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, row by row: none without words. Null sources are a source."""
    docs = with_row_key(docs)
    plan = mixing.mix(docs, documents(spark, sf_dir, "labels"), row=ROW).where("n_copies > 0").select(ROW, F.col("n_copies").alias("__copies"))
    taken = docs.join(plan, ROW)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).drop(ROW, "__copies", "__copy")


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256, a row per row."""
    return tokens.encode_digest(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("bpe", bpe_round_trip),
]

#: The stages train, compress and tokenize, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
