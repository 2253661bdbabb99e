"""From raw documents to packed sequences: classifier, rules, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bandwalk.llm import dart_minhash, factorisation, line_quality, mixing
from bandwalk.llm.queries import packed
from bandwalk.session import settled

ORACLE_SQL = None


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; the labels are those of ``sf_dir``.

    Null and empty texts are scored by their statistics, long ones whole; a null id is only never
    held out. Repeated rows are all judged alike. An empty table gives none. Columns stay as they are.
    """
    model = factorisation.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return factorisation.score(docs, model).filter("predicted = 1").select("row.*")


def cleaned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that they remove; ``n_chars`` follows the text.

    Null, empty and blank texts fail. Long texts are judged whole, repeated rows alike, whatever
    their other columns hold. An empty table gives none.
    """
    judged = line_quality.line_quality(docs).filter("kept")
    row = F.col("row").withField("text", F.col("cleaned"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("cleaned").cast(docs.schema["n_chars"].dataType))
    return judged.select(row.alias("row")).select("row.*")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id, of equal ids any one.

    Documents without words are alike to nothing and all stay.
    """
    classes = settled(dart_minhash.near_classes(docs))
    chosen = classes.filter("node is not null").groupBy("class_node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("m"))
    keep = chosen.select(_name(F.col("m.doc_id"), F.col("m.node")).alias("name"))
    rows = dart_minhash.with_nodes(docs.select(F.struct("*").alias("row"), "doc_id", F.col("text").cast("string").alias("text")))
    named = rows.filter("node is not null").select("row", _name(F.col("doc_id"), F.col("node")).alias("name"))
    # rows that repeat both id and words: one stays
    nth = F.row_number().over(Window.partitionBy("name").orderBy(F.lit(0)))
    first = named.join(keep, "name", "left_semi").withColumn("nth", nth).filter("nth = 1")
    return first.select("row.*").unionByName(rows.filter("node is null").select("row.*"))


def _name(doc_id: Column, node: Column) -> Column:
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.hex(node))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source of its own. Texts without words have size 0 and are repeated as the order
    of hashes has it. Equal ids tie by size; equal rows are interchangeable. An empty table gives none.
    """
    return mixing.repeated(mixing.mix(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with the columns of the packing query.

    Null and empty texts are one end token, long ones span sequences. Repeated rows, as the mix makes
    them, are packed each; null ids stay null. An empty table gives none.
    """
    return packed(docs)


STAGES = [
    ("quality classifier", classified),
    ("quality rules", cleaned),
    ("near-duplicates", deduplicated),
    ("mixing", mixed),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
