"""Readers for review corpora, labels, verdict batches and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from voxtable.functions import text as tx
from voxtable.operators import positions
from voxtable.operators.labeling import known_topic
from voxtable.operators.sampling import prefix
from voxtable.sources import schemas
from voxtable.sources.scratch import materialize, small
from voxtable.sources.stage import exists

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def ingest_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw JSON lines -> text, rating, title, product_id. The schema names the four wanted
    fields, so the others are never parsed into columns. Ratings written as decimals are cut to integers."""
    raw = spark.read.schema(schemas.RAW).json(path)
    return raw.select("text", F.col("rating").cast("int").alias("rating"), "title", F.col("parent_asin").alias("product_id"))


def ingest_with_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ingest and number the rows by file position.

    The rows of a file split stay together in reading order, so a row's number is the number of
    rows in the splits before it plus its place in its own split. One row per split is sorted;
    the texts are neither sorted nor shuffled.
    """
    raw = spark.read.schema(schemas.RAW).json(path).select(
        "text", F.col("rating").cast("int").alias("rating"), "title", F.col("parent_asin").alias("product_id"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"))
    splits = raw.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(splits.select("_file", "_block", (
        F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")), "split-starts")
    numbered = raw.join(small(starts, starts.count()), ["_file", "_block"], "left")
    known = F.when(F.col("_shift").isNull(), F.raise_error(F.lit("the second read of the input was split differently"))).otherwise(F.col("_row") + F.col("_shift"))
    return numbered.select(tx.formatted_id(known).alias("review_id"),
                           "text", "rating", "title", "product_id")


def read_csv(spark: SparkSession, path: str, schema: str = schemas.REVIEW) -> DataFrame:
    """CSV with header and quoted multi-line fields."""
    decimal = schema.replace("rating int", "rating double")
    return spark.read.options(**CSV_OPTIONS).schema(decimal).csv(path).select(
        *(F.col("rating").cast("int").alias("rating") if "rating int" in schema and f.name == "rating" else F.col(f.name)
          for f in StructType.fromDDL(schema)))


def read_table(spark: SparkSession, path: str, schema: str = schemas.REVIEW) -> DataFrame:
    """Parquet when the path says so, else CSV."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path, schema)


def decoded_sentences(c) -> Column:
    """JSON text -> ARRAY<STRING>; malformed text -> null, the row stays."""
    return F.from_json(F.col(c) if isinstance(c, str) else c, "array<string>")


def typed_reviews(df: DataFrame) -> DataFrame:
    """The review columns with their types; missing optional columns become '' or null."""
    text_or_empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    kinds = dict(df.dtypes)
    sentences = (F.lit(None).cast("array<string>") if "sentences" not in kinds
                 else decoded_sentences("sentences") if kinds["sentences"] == "string" else F.col("sentences"))
    topic = known_topic("topic") if "topic" in kinds else F.lit(None).cast("string")
    return df.select(
        F.col("review_id").cast("string").alias("review_id"), F.col("text").cast("string").alias("text"),
        F.col("rating").cast("int").alias("rating"), text_or_empty("title").alias("title"),
        text_or_empty("product_id").alias("product_id"), sentences.alias("sentences"), topic.alias("topic"))


def load_reviews(spark: SparkSession, main: str, sample_path: str | None = None, path: str | None = None,
                 sample: bool = False, limit: int | None = None, schema: str = schemas.TOKENIZED) -> DataFrame:
    """Explicit path, else sample or main corpus; ``limit`` 0 or None reads everything."""
    chosen = path or (sample_path if sample else main)
    df = read_table(spark, chosen, schema)
    if limit:
        df = positions.first(df, limit)
    return typed_reviews(df)


def labels_of(curated: DataFrame | None, labeled: DataFrame) -> DataFrame:
    """Training rows with a ``label``: verified topics when there is a curated table with such a
    column, else its automatic topics, else the labeled corpus."""
    if curated is None:
        return labeled.withColumn("label", F.col("topic_label"))
    source = "verified_topic" if "verified_topic" in curated.columns else "auto_topic"
    return curated.where(F.col(source).isNotNull()).withColumn("label", F.col(source))


def load_labeled_reviews(spark: SparkSession, labeled_path: str, curated_path: str | None = None,
                         use_curated: bool = True) -> DataFrame:
    labeled = read_table(spark, labeled_path, schemas.LABELED)
    use = use_curated and curated_path and exists(spark, curated_path)
    return labels_of(read_table(spark, curated_path, schemas.CURATED) if use else None, labeled)


def training_set(labeled: DataFrame, dataset: str = "sample", n: int = 5000) -> DataFrame:
    """First n labeled rows, or all of them. ``n`` bounds the rows that a classifier is fitted on."""
    rows = prefix(labeled, n) if dataset == "sample" else labeled
    return rows.withColumn("label", F.col("topic_label"))


def gold_set(curated: DataFrame) -> DataFrame:
    return curated.where(F.col("verified_topic").isNotNull()).withColumn("label", F.col("verified_topic"))


def read_verdict_batches(spark: SparkSession, folder: str) -> DataFrame:
    """All ``batch_*.csv`` files: row_index, verified_topic, file, position in the file."""
    df = spark.read.option("header", "true").schema(schemas.VERDICT).csv(f"{folder.rstrip('/')}/batch_*.csv")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(batch_[^/]*\.csv)", 1)
    return df.select(F.col("index").alias("row_index"), "verified_topic", name.alias("file"),
                     F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("position"))


def read_term_cache(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the term cache, or an empty one."""
    if not exists(spark, path):
        return spark.createDataFrame([], "term string, is_relevant boolean")
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version")).scalar()
    return versions.where(F.col("version") == newest).select("term", "is_relevant")


def with_columns_from_documents(documents: DataFrame) -> DataFrame:
    """Documents seen as reviews. The rating is made up from the id; the data has none."""
    return documents.select(
        tx.formatted_id("doc_id").alias("review_id"), "text", (1 + F.pmod("doc_id", F.lit(5))).cast("int").alias("rating"),
        F.substring("text", 1, 40).alias("title"), F.col("source").alias("product_id"), "lang", "doc_id")
