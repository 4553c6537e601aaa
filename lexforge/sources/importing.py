"""From files to a published version of a library: scan, parse by format, leave out what is there, number, append.

Every step is a table; a file that cannot be read costs itself alone, and a run that is repeated adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.text import tidy_stem
from lexforge.operators.mutations import dedup_import, report
from lexforge.operators.prefix import placed
from lexforge.operators.scratch import written

from . import pdf_pages
from .epub import CHAPTER_SCHEMA, library_rows, read_epubs
from .files import read_files
from .snapshot import Library

#: Room in identifiers: chapters of a book, paragraphs of a chapter.
CHAPTERS, PARAGRAPHS = 1 << 16, 1 << 20
BOOKS = "book_id bigint, title string, author string, path string, file_hash string, added_at timestamp_ntz"
CHAPTERS_OF = "chapter_id bigint, book_id bigint, idx bigint, title string"
BLOCKS = "block_id bigint, chapter_id bigint, book_id bigint, block_idx bigint, char_start bigint, char_end bigint, text string"


def read_pdfs(files: DataFrame, extractor: Callable[[bytes], list[str]]) -> DataFrame:
    """Chapters of PDF files, in the shape of ``read_epubs``: pages as the ``extractor`` gives them, without running lines, in blocks of
    pages; titled by the file's name. A book without text is an error."""
    pages = written(pdf_pages.extract_pages(files, extractor), "pages")
    named = files.select("path", "file_hash")
    lines = pages.where("error is null").select(F.col("path").alias("book_id"), "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    paragraphs = pdf_pages.book_paragraphs(pdf_pages.without_running_lines(lines))
    sizes = pages.where("error is null").groupBy(F.col("path").alias("book_id")).agg(F.max("page").alias("n_pages"))
    rows = pdf_pages.assemble(paragraphs, pdf_pages.page_blocks(sizes))
    own = rows.groupBy(F.col("book_id").alias("path"), F.col("idx").alias("spine_pos"), F.col("title").alias("chapter_title")).agg(F.sort_array(F.collect_list(F.struct("block_idx", "text"))).alias("ps"))
    stem = tidy_stem(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    none = F.lit(None).cast("string")
    good = own.join(named, "path").select("file_hash", "path", stem.alias("title"), none.alias("author"), "spine_pos", "chapter_title", none.alias("href"), F.transform("ps", lambda p: p["text"]).alias("paragraphs"), none.alias("error"))
    why = pages.groupBy("path").agg(F.max("error").alias("error"))
    empty = named.join(own.select("path").distinct(), "path", "left_anti").join(why, "path", "left")
    bad = empty.select("file_hash", "path", F.coalesce("error", F.lit("the book has no text")).alias("error"))
    columns = [c.split()[0] for c in CHAPTER_SCHEMA.split(", ")]
    return good.select(*columns).unionByName(bad, allowMissingColumns=True).select(*columns)


def parse_books(files: DataFrame, extractor: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Chapters of book files (``path``, ``content``, ``file_hash``, ``format``), each read by its format. Without an extractor a PDF is a
    row with an ``error``."""
    columns = [c.split()[0] for c in CHAPTER_SCHEMA.split(", ")]
    out = read_epubs(files.where("format = 'epub'"))
    pdfs = files.where("format = 'pdf'")
    if extractor is None:
        return out.unionByName(pdfs.select("file_hash", "path", F.lit("there is no reader for PDF files").alias("error")), allowMissingColumns=True).select(*columns)
    return out.select(*columns).unionByName(read_pdfs(pdfs, extractor).withColumn("spine_pos", F.col("spine_pos").cast(out.schema["spine_pos"].dataType)))


def import_folder(spark: SparkSession, folder: str, root: str, extractor: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Add the books under a folder to the library at ``root``, as a new version. Returns (``path``, ``outcome``, ``error``): ``imported``,
    ``already`` (the content is there, or in an earlier file), ``conflict`` (the path is there with another content) or ``failed``."""
    library = Library(spark, root)
    new_library = library.current() is None
    have = {} if new_library else library.tables()
    table = lambda name, schema: have[name] if name in have else spark.createDataFrame([], schema)
    books, chapters, blocks = table("books", BOOKS), table("chapters", CHAPTERS_OF), table("blocks", BLOCKS)
    files = read_files(spark, folder)
    outcome = written(dedup_import(files.select("path", "file_hash"), books.select("path", "file_hash", "book_id")).select("path", "file_hash", "outcome"), "outcomes")
    wanted = outcome.where("outcome = 'imported'").select("path")
    parsed = written(parse_books(files.join(F.broadcast(wanted) if wanted.count() <= 1_000_000 else wanted, "path", "left_semi"), extractor), "parsed")
    found, parts, lines = library_rows(parsed)
    top = books.agg(F.coalesce(F.max("book_id"), F.lit(0)).alias("top")).first()["top"]
    numbered = written(placed(found, F.asc("path")).withColumn("book_id", F.col("place") + top), "books")
    chapter = lambda: (F.col("book_id") * CHAPTERS + F.col("idx")).alias("chapter_id")
    of = numbered.select("file_hash", "book_id")
    new_books = numbered.select("book_id", "title", "author", "path", "file_hash", F.to_timestamp_ntz(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).alias("added_at"))
    new_chapters = parts.join(of, "file_hash").select(chapter(), "book_id", "idx", "title")
    rows = lines.join(of, "file_hash").select("*", chapter())
    new_blocks = rows.select((F.col("chapter_id") * PARAGRAPHS + F.col("block_idx")).alias("block_id"), "chapter_id", "book_id", F.col("block_idx").cast("bigint").alias("block_idx"), "char_start", "char_end", "text")
    failed = parsed.where("error is not null").select("path", "error")
    if new_library or not numbered.isEmpty():
        whole = {"books": books.unionByName(new_books), "chapters": chapters.unionByName(new_chapters), "blocks": blocks.unionByName(new_blocks)}
        library.write({**have, **whole})
    told = outcome.join(failed, "path", "left")
    return told.select("path", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("outcome")).alias("outcome"), "error")


def import_report(outcomes: DataFrame) -> DataFrame:
    """How often there was each outcome."""
    return report(outcomes)
