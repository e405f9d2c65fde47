"""Problems 2 and 7 to 9: runs of packets, and packing, leaked test passages and splitting of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mistrail.llm import packet_runs
from mistrail.llm.leaks import find_leaks
from mistrail.llm.packing import pack_items
from mistrail.llm.splitting import SplitModel, split_texts
from mistrail.llm.tokens import token_count
from mistrail.sources.tables import table

CAPACITY = 2048


def containers(spark: SparkSession, data_dir: str) -> DataFrame:
    sized = table(spark, data_dir, "documents", "doc_id", "text").select("doc_id", token_count(F.col("text")).alias("size"))
    return pack_items(sized, "doc_id", "size", CAPACITY)


def p7_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return containers(spark, data_dir).groupBy("doc_id").agg(F.min("container").alias("a"), F.max("container").alias("b")).filter("a < b").select("doc_id")


def p7_containers(spark: SparkSession, data_dir: str) -> DataFrame:
    return containers(spark, data_dir)


def p7_fill(spark: SparkSession, data_dir: str) -> DataFrame:
    """Containers used, the least number possible, and how full they are."""
    per = containers(spark, data_dir).groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("texts"))
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"), F.ceil(F.sum("tokens") / CAPACITY).alias("least_containers"), F.max("tokens").alias("fullest"),
        F.round(F.sum("tokens") / (F.count(F.lit(1)) * CAPACITY), 6).alias("filled"), F.sum("texts").alias("n_pieces"),
    )


def p7_documents(spark: SparkSession, data_dir: str) -> DataFrame:
    """Of each text its tokens in all containers, the pieces it lies in, and whether a container of it holds too much."""
    rows = containers(spark, data_dir).withColumn("held", F.sum("tokens").over(Window.partitionBy("container")))
    return rows.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_pieces"), (F.max("held") > CAPACITY).alias("overfull"))


def leaks(spark: SparkSession, data_dir: str) -> DataFrame:
    return find_leaks(table(spark, data_dir, "documents", "doc_id", "text"), "doc_id", "text", table(spark, data_dir, "eval_items", "item_id", "item_text"), "item_id", "item_text")


def p8_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return leaks(spark, data_dir).select("doc_id", "item_id")


def p8_per_item(spark: SparkSession, data_dir: str) -> DataFrame:
    """Which test items leaked, into how many documents, and how much of them."""
    found = leaks(spark, data_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("most_words"))
    return table(spark, data_dir, "eval_items", "item_id", "suite").join(found, "item_id").select("item_id", "suite", "n_documents", "most_words")


def pieces(spark: SparkSession, data_dir: str) -> DataFrame:
    return split_texts(table(spark, data_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p9_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return pieces(spark, data_dir).filter("n_pieces > 1 AND piece_no = 0").select("doc_id")


def p9_pieces(spark: SparkSession, data_dir: str) -> DataFrame:
    return pieces(spark, data_dir)


def p9_documents(spark: SparkSession, data_dir: str) -> DataFrame:
    """Of each text its tokens, whether it is cut, its largest piece's excess, and pieces that don't begin with the end of
    the one before or whose text hasn't the tokens they are said to have."""
    model, order = SplitModel(), Window.partitionBy("doc_id").orderBy("piece_no")
    end = F.col("first_token") + F.col("n_tokens")
    before = F.lag(end).over(order)
    wrong = F.coalesce(F.col("first_token") != before - F.least(before, F.lit(model.overlap)), F.col("first_token") != 0) | (token_count(F.col("piece")) != F.col("n_tokens"))
    rows = pieces(spark, data_dir).select("doc_id", "n_pieces", "n_tokens", end.alias("end"), wrong.alias("wrong"))
    return rows.groupBy("doc_id").agg(
        F.max("end").alias("tokens"), (F.max("n_pieces") > 1).alias("divided"), F.greatest(F.max("n_tokens") - model.limit, F.lit(0)).alias("excess"), F.count_if("wrong").alias("n_wrong")
    )


QUERIES = packet_runs.QUERIES | {f.__name__: f for f in (p7_found, p7_containers, p7_documents, p7_fill, p8_found, p8_per_item, p9_found, p9_pieces, p9_documents)}
#: The WordPunct rule in the regular expressions of the SQL engine, whose \\w is ASCII only.
_TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s\p{Z}]+'))"
SQL = packet_runs.SQL | {
    "p7_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > 2048",
    "p7_documents": f"SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, CAST(greatest(1, ceil(tokens / 2048)) AS BIGINT) AS n_pieces, false AS overfull FROM (SELECT doc_id, {_TOKENS} AS tokens FROM documents)",
    "p9_documents": f"SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, tokens > 1000 AS divided, CAST(0 AS BIGINT) AS excess, CAST(0 AS BIGINT) AS n_wrong FROM (SELECT doc_id, {_TOKENS} AS tokens FROM documents)",
    "p9_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > 1000",
}
