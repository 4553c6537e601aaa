"""The library's tables over a folder of Parquet tables: documents are chapters, sources are books, lines are paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifiers of paragraphs leave room for as many lines of a document; more are an error.
LINES = 100_000_000
#: What the vectors of the ``embeddings`` table are taken to be made by.
MODEL = "hash-64"
COLOURS = ("yellow", "green", "blue", "pink")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def book_of(source):
    return F.substring(source, 4, 10).cast("bigint") + 1


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each source. Added a day after the one before."""
    rows = table(spark, sf_dir, "documents").select("source").distinct()
    out = rows.select(book_of("source").alias("book_id"), F.col("source").alias("title"), F.lit(None).cast("string").alias("author"))
    return out.withColumn("added_at", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(book_id as int))"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter for each document, titled by the beginning of its first line."""
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("chapter_id"), book_of("source").alias("book_id"), F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"), "text")


def block_id(chapter: Column, idx: Column) -> Column:
    return F.when(idx < LINES, chapter * LINES + idx).otherwise(F.raise_error(F.lit(f"a document of more than {LINES} lines")).cast("bigint"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph for each line."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter_id"), book_of("source").alias("book_id"), F.posexplode(F.split("text", "\n")).alias("block_idx", "text"))
    return rows.select("chapter_id", "book_id", F.col("block_idx").cast("bigint").alias("block_idx"), block_id(F.col("chapter_id"), F.col("block_idx").cast("bigint")).alias("block_id"), "text")


def marks(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Events of a kind with the paragraph that each one falls on: ``event_id``, ``user_id``, ``ts``, ``value``, ``props``,
    ``chapter_id``, ``book_id``, ``block_idx``, ``block_id``, ``text``."""
    docs = table(spark, sf_dir, "documents")
    size = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    events = table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("event_id", "user_id", "ts", "value", "props")
    events = events.crossJoin(F.broadcast(size)).withColumn("chapter_id", F.col("event_id") % F.nullif(F.col("n_docs"), F.lit(0))).drop("n_docs")
    lines = docs.select(F.col("doc_id").alias("chapter_id"), book_of("source").alias("book_id"), F.split("text", "\n").alias("lines"))
    out = events.join(lines, "chapter_id").withColumn("block_idx", F.col("event_id") % F.size("lines"))
    out = out.withColumn("text", F.get("lines", F.col("block_idx").cast("int"))).drop("lines")
    return out.withColumn("block_id", block_id(F.col("chapter_id"), F.col("block_idx")))


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each folder (user) and paragraph: the first."""
    rows = marks(spark, sf_dir, "click").groupBy(F.col("user_id").alias("folder_id"), "block_id", "chapter_id", "book_id", "block_idx")
    return rows.agg(F.min("event_id").alias("bookmark_id"))


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marks(spark, sf_dir, "purchase").withColumn("len", F.length("text")).where("len > 0")
    # The optimiser may ask for a start before it leaves empty texts out, so those have none instead of an error.
    start = (F.floor("value") % F.nullif(F.col("len"), F.lit(0))).cast("bigint")
    colour = F.get(F.array(*map(F.lit, COLOURS)), (F.col("event_id") % 4).cast("int"))
    return rows.select(F.col("event_id").alias("highlight_id"), "book_id", "chapter_id", "block_id", "block_idx", start.alias("start_offset"), F.least(start + 20, F.col("len")).cast("bigint").alias("end_offset"), colour.alias("color"), "text")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on paragraphs; of a paragraph that has highlights, on the first of them. One for each anchor: the first."""
    first = highlights(spark, sf_dir).groupBy("block_id").agg(F.min("highlight_id").alias("highlight_id"))
    rows = marks(spark, sf_dir, "error").groupBy("block_id", "chapter_id", "book_id", "block_idx").agg(F.min(F.struct("event_id", "props")).alias("n"))
    out = rows.join(first, "block_id", "left")
    return out.select(F.col("n.event_id").alias("note_id"), "book_id", "chapter_id", "block_id", "block_idx", "highlight_id", F.col("n.props").alias("body"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each book was last read."""
    rows = marks(spark, sf_dir, "view").groupBy("book_id").agg(F.max(F.struct("ts", "event_id", "chapter_id", "block_idx", "block_id")).alias("p"))
    return rows.select("book_id", "p.chapter_id", "p.block_idx", "p.block_id", F.col("p.ts").alias("read_at"))


def chunk_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks of chapters (labels), one after the other."""
    from lexforge.operators.prefix import running

    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("chapter_id"), "vec_id", F.col("embedding").alias("vec"))
    numbered = running(rows.withColumn("one", F.lit(1)), ["chapter_id"], "vec_id", {"one": "chunk_idx"})
    out = numbered.select("chapter_id", "vec_id", "chunk_idx", (F.col("chunk_idx") * 1400).alias("char_start"), (F.col("chunk_idx") * 1400 + 1600).alias("char_end"), F.lit(MODEL).alias("model"), "vec")
    return out
