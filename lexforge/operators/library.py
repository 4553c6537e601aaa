"""The library's read views: books, chapters, reading progress, bookmarks, annotations, counts.

Children are counted before they are joined, so a join never multiplies rows; what the store's SQL did with correlated
subqueries are joins and running sums here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexforge.functions.text import composed, cut, list_phrase, nocase, percent

from .prefix import running


def counted(parents: DataFrame, children: DataFrame, key: str, name: str, child_key: str | None = None) -> DataFrame:
    """``parents`` with the number of their ``children`` (0 if none)."""
    n = children.groupBy(F.col(child_key or key).alias(key)).agg(F.count(F.lit(1)).alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def list_books(books: DataFrame, chapters: DataFrame, bookmarks: DataFrame, highlights: DataFrame, notes: DataFrame) -> DataFrame:
    """Books with the counts of what they have, newest first."""
    out = counted(books, chapters, "book_id", "chapter_count")
    out = counted(out, bookmarks, "book_id", "bookmark_count")
    out = counted(out, highlights, "book_id", "highlight_count")
    return counted(out, notes, "book_id", "note_count").orderBy(F.desc("added_at"), F.desc("book_id"))


def chapter_sizes(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chapters with their number of characters, 0 for those without paragraphs."""
    sums = blocks.groupBy("chapter_id").agg(F.sum(F.length("text")).cast("bigint").alias("char_count"))
    return chapters.join(sums, "chapter_id", "left").withColumn("char_count", F.coalesce("char_count", F.lit(0)))


def with_idx(chapters: DataFrame) -> DataFrame:
    """Chapters with ``idx``, their place in the book from 0."""
    return running(chapters.withColumn("__one", F.lit(1)), ["book_id"], "chapter_id", {"__one": "idx"}).drop("__one")


def book_chapters(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    return chapter_sizes(with_idx(chapters), blocks).select("book_id", "chapter_id", "idx", "title", "char_count").orderBy("book_id", "idx")


def chapter_content(blocks: DataFrame, chapter_id: int | None = None) -> DataFrame:
    """Chapters with their paragraphs in order, as an array; of one, which has to be there, or of all."""
    rows = blocks if chapter_id is None else only(blocks, "chapter", chapter_id=chapter_id)
    some = rows.groupBy("chapter_id", "book_id").agg(F.sort_array(F.collect_list(F.struct("block_idx", "block_id", "text"))).alias("blocks"))
    return some


def reading_progress(positions: DataFrame, chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """Where each book stands: chapter number of how many, whole percent of the characters before the paragraph, and
    whether it is finished (at the last paragraph of the last chapter that has any text)."""
    sizes = chapter_sizes(chapters.select("chapter_id", "book_id", "title"), blocks.select("chapter_id", "text"))
    placed = running(sizes.withColumn("one", F.lit(1)), ["book_id"], "chapter_id", {"one": "idx", "char_count": "chars_before"})
    totals = placed.groupBy("book_id").agg(F.count(F.lit(1)).alias("chapter_count"), F.sum("char_count").alias("total"), F.max(F.when(F.col("char_count") > 0, F.col("chapter_id"))).alias("last_chapter"))
    here = positions.join(placed.select("chapter_id", "title", "idx", "chars_before"), "chapter_id")
    # Only the paragraphs of chapters where someone stands are summed; positions are one for a book.
    own = blocks.join(positions.select("chapter_id", F.col("block_idx").alias("at")), "chapter_id")
    inside = own.groupBy("chapter_id").agg(F.coalesce(F.sum(F.when(F.col("block_idx") < F.col("at"), F.length("text"))), F.lit(0)).alias("inside"), F.max("block_idx").alias("last_block"))
    rows = here.join(inside, "chapter_id").join(totals, "book_id")
    finished = F.coalesce((F.col("chapter_id") == F.col("last_chapter")) & (F.col("block_idx") == F.col("last_block")), F.lit(False))
    rows = rows.withColumn("finished", finished)
    return rows.select(
        "book_id", "chapter_id", "block_id", "title", (F.col("idx") + 1).alias("chapter_number"), "chapter_count",
        percent(F.col("chars_before") + F.col("inside"), F.col("total"), F.col("finished")).alias("percent"), "finished", "read_at",
    )


def continue_reading(progress: DataFrame, limit: int = 3) -> DataFrame:
    return progress.where(~F.col("finished")).orderBy(F.desc("read_at"), F.desc("book_id")).limit(limit)


def recent_books(books: DataFrame, reading: DataFrame, limit: int = 3) -> DataFrame:
    """The newest books that are not being read."""
    return books.join(reading.select("book_id"), "book_id", "left_anti").orderBy(F.desc("added_at"), F.desc("book_id")).limit(limit)


def folders_newest_first(folders: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Folders with the number of their bookmarks, the newest (``created_at``, then number) first."""
    return counted(folders, bookmarks, "folder_id", "bookmark_count").orderBy(F.desc("created_at"), F.desc("folder_id"))


def passages_of(folder_id: int, folders: DataFrame, bookmarks: DataFrame, blocks: DataFrame, chapters: DataFrame, books: DataFrame) -> DataFrame:
    """The passages of one folder, which has to be there."""
    there = only(folders, "folder", folder_id=folder_id).select("folder_id")
    own = bookmarks.where(F.col("folder_id") == folder_id)
    return folder_passages(there.join(own, "folder_id"), blocks, chapters, books)


def folder_passages(bookmarks: DataFrame, blocks: DataFrame, chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Bookmarks of folders with their text and titles, in the order in which they were made."""
    # Paragraphs of other chapters are left out before any are dealt.
    few = blocks.join(bookmarks.select("chapter_id").distinct(), "chapter_id", "left_semi").select("block_id", "text")
    out = bookmarks.select("folder_id", "bookmark_id", "block_id", "chapter_id", "book_id").join(few, "block_id")
    out = out.join(chapters.select("chapter_id", F.col("title").alias("chapter_title")), "chapter_id")
    return out.join(books.select("book_id", F.col("title").alias("book_title")), "book_id").orderBy("folder_id", "bookmark_id")


def annotated_books(books: DataFrame, highlights: DataFrame, notes: DataFrame) -> DataFrame:
    """Books with a highlight or a note, by title (case aside in ASCII), those without a title first."""
    out = counted(counted(books, highlights, "book_id", "highlight_count"), notes, "book_id", "note_count")
    return out.where("highlight_count > 0 or note_count > 0").orderBy(nocase(F.col("title")).asc_nulls_first(), "book_id")


def chapter_annotations(highlights: DataFrame, notes: DataFrame) -> DataFrame:
    """Highlights and notes of chapters in one table: ``kind``, offsets (null for a paragraph's note), and text or body. Highlights come
    first; both are in order of their paragraph and of where they begin in it, notes on the paragraph before those on
    highlights."""
    marks = highlights.select("chapter_id", F.lit("highlight").alias("kind"), F.col("highlight_id").alias("id"), "block_id", "start_offset", "end_offset", F.col("color").alias("shown"))
    at = highlights.select("highlight_id", "start_offset", "end_offset")
    own = notes.join(at, "highlight_id", "left").select("chapter_id", F.lit("note").alias("kind"), F.col("note_id").alias("id"), "block_id", "start_offset", "end_offset", F.col("body").alias("shown"))
    idx = lambda rows: rows.select("block_id", "block_idx").distinct()
    rows = marks.unionByName(own).join(idx(highlights.select("block_id", "block_idx").unionByName(notes.select("block_id", "block_idx"))), "block_id")
    return rows.orderBy("chapter_id", "kind", "block_idx", F.coalesce("start_offset", F.lit(-1)), "id").drop("block_idx")


def book_annotations(highlights: DataFrame, notes: DataFrame) -> DataFrame:
    """All of a book in reading order: highlights with the note on them, and notes on paragraphs, which come before the
    paragraph's highlights (offset -1)."""
    on = notes.where("highlight_id is not null").select("highlight_id", "note_id", "body")
    marks = highlights.join(on, "highlight_id", "left").select(
        "book_id", "chapter_id", "block_idx", "block_id", "highlight_id", "note_id", F.col("start_offset").alias("at"),
        cut(F.col("text"), F.col("start_offset"), F.col("end_offset")).alias("quote"), "body",
    )
    loose = notes.where("highlight_id is null").select(
        "book_id", "chapter_id", "block_idx", "block_id", F.lit(None).cast("bigint").alias("highlight_id"), "note_id", F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast("string").alias("quote"), "body"
    )
    return marks.unionByName(loose).orderBy("book_id", "chapter_id", "block_idx", "at", "highlight_id")


def overlaps(highlights: DataFrame) -> DataFrame:
    """Pairs of highlights of one paragraph that overlap; touching is not overlapping. Told by a running maximum first, so
    that paragraphs without any overlap are not joined with themselves."""
    w = W.partitionBy("block_id").orderBy("start_offset", "highlight_id").rowsBetween(W.unboundedPreceding, -1)
    seen = highlights.withColumn("reach", F.max("end_offset").over(w))
    some = seen.where(F.col("start_offset") < F.col("reach")).select("block_id").distinct()
    own = highlights.join(some, "block_id", "left_semi").select("block_id", "highlight_id", "start_offset", "end_offset")
    a, b = own.alias("a"), own.alias("b")
    hit = (F.col("a.block_id") == F.col("b.block_id")) & (F.col("a.highlight_id") < F.col("b.highlight_id")) & (F.col("a.start_offset") < F.col("b.end_offset")) & (F.col("a.end_offset") > F.col("b.start_offset"))
    return a.join(b, hit).select(F.col("a.highlight_id").alias("a"), F.col("b.highlight_id").alias("b"))


def library_counts(books: DataFrame, folders: DataFrame, bookmarks: DataFrame, highlights: DataFrame, notes: DataFrame) -> DataFrame:
    """One row of five counts."""
    parts = [d.select(F.lit(name).alias("what")) for name, d in (("books", books), ("bookmark_folders", folders), ("bookmarks", bookmarks), ("highlights", highlights), ("notes", notes))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    of = lambda name: F.sum(F.when(F.col("what") == name, 1).otherwise(0)).cast("bigint").alias(name)
    # Without any row there would be no sums: coalesce them.
    sums = every.agg(*[of(n) for n in ("books", "bookmark_folders", "bookmarks", "highlights", "notes")])
    return sums.fillna(0)


def highlight_segments(highlights: DataFrame) -> DataFrame:
    """Each highlighted paragraph as its segments, in order: ``block_id``, ``seg_start``, ``seg_end``, ``highlight_id`` (null: plain).
    Overlapping highlights are not stored; here a later one begins where the one before ends."""
    w = W.partitionBy("block_id").orderBy("start_offset", "highlight_id")
    before = F.coalesce(F.max("end_offset").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = highlights.select("block_id", "highlight_id", "start_offset", "end_offset", "text").withColumn("low", before).withColumn("begin", F.greatest("start_offset", "low"))
    rows = rows.withColumn("last", F.lead("highlight_id").over(w).isNull())
    segment = lambda s, e, h: F.struct(s.cast("bigint").alias("seg_start"), e.cast("bigint").alias("seg_end"), h.cast("bigint").alias("highlight_id"))
    null = F.lit(None)
    reach = F.greatest("end_offset", "low")
    parts = F.array(segment(F.col("low"), F.col("begin"), null), segment(F.col("begin"), F.col("end_offset"), F.col("highlight_id")), F.when(F.col("last"), segment(reach, F.length("text"), null)))
    out = rows.withColumn("s", F.explode(parts)).where("s is not null").select("block_id", "s.*")
    return out.where("seg_start < seg_end")


def chapter_openings(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """The paragraph that repeats a chapter's title, if its first does, and the first of the next four with 100 characters."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(composed(c), r"(?U)\s+", " ")))
    first = blocks.where("block_idx <= 4").join(chapters.select("chapter_id", "title"), "chapter_id")
    # Only a first paragraph can be the heading, and only its beginning counts then.
    start = F.when(F.col("block_idx") == 0, F.col("text"))
    heading = F.coalesce(flat(start) == flat(F.col("title")), F.lit(False))
    rows = first.withColumn("heading", heading)
    return rows.groupBy("chapter_id").agg(F.min(F.when(F.col("heading"), F.col("block_id"))).alias("heading_block"), F.min(F.when((~F.col("heading")) & (F.length("text") >= 100), F.col("block_id"))).alias("opening_block"))


def neighbours(chapters: DataFrame) -> DataFrame:
    """Chapters (``book_id``, ``chapter_id``) with ``previous`` and ``next`` of their book, null at its ends."""
    own = with_idx(chapters.select("book_id", "chapter_id"))
    at = lambda name, by: own.select("book_id", (F.col("idx") + by).alias("idx"), F.col("chapter_id").alias(name))
    out = own.join(at("previous", 1), ["book_id", "idx"], "left").join(at("next", -1), ["book_id", "idx"], "left")
    return out.select("book_id", "chapter_id", "idx", "previous", "next")


def annotation_groups(annotations: DataFrame, chapters: DataFrame) -> DataFrame:
    """A book's annotations (of ``book_annotations``) under their chapters: the chapter's title, and the annotations in reading order
    as an array of ``highlight_id``, ``note_id``, ``quote`` and ``body``."""
    item = F.struct("block_idx", "at", "highlight_id", "note_id", "quote", "body")
    own = annotations.groupBy("book_id", "chapter_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    rows = own.join(chapters.select("chapter_id", "title"), "chapter_id")
    return rows.select("book_id", "chapter_id", "title", F.transform("items", lambda x: x.dropFields("block_idx", "at")).alias("annotations"))


def paragraph_marks(blocks: DataFrame, highlights: DataFrame, notes: DataFrame) -> DataFrame:
    """Paragraphs (``chapter_id``, ``block_id``) with the highlights on each in order, and the notes; empty arrays if none."""
    on = highlights.groupBy("block_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("start_offset", "highlight_id"))), lambda h: h["highlight_id"]).alias("highlights"))
    own = notes.groupBy("block_id").agg(F.sort_array(F.collect_list("note_id")).alias("notes"))
    rows = blocks.select("chapter_id", "block_id").join(on, "block_id", "left").join(own, "block_id", "left")
    none = F.array().cast("array<bigint>")
    return rows.select("chapter_id", "block_id", F.coalesce("highlights", none).alias("highlights"), F.coalesce("notes", none).alias("notes"))


def home_sums(listed: DataFrame, folders: DataFrame) -> DataFrame:
    """The numbers of the home screen's cards: sums over the lists of books (of ``list_books``) and of folders (with
    ``bookmark_count``)."""
    books = listed.agg(F.count(F.lit(1)).alias("books"), *[F.coalesce(F.sum(f"{c}_count"), F.lit(0)).alias(f"{c}s") for c in ("chapter", "highlight", "note")])
    passages = folders.agg(F.count(F.lit(1)).alias("folders"), F.coalesce(F.sum("bookmark_count"), F.lit(0)).alias("passages"))
    return books.crossJoin(passages)  # a row each


def with_state_and_cover(listed: DataFrame, states: DataFrame, covers: DataFrame) -> DataFrame:
    """Listed books with ``index_state`` (of ``index_states``) and ``cover_key`` (null without a cover)."""
    out = listed.join(states.select("book_id", "index_state"), "book_id", "left").join(covers.select("book_id", F.col("key").alias("cover_key")), "book_id", "left")
    return out.withColumn("index_state", F.coalesce("index_state", F.lit("none")))


def counts_line(listed: DataFrame, shown: DataFrame) -> DataFrame:
    """One row: how many books are shown of how many, as a line says it."""
    n = listed.agg(F.count(F.lit(1)).alias("n")).crossJoin(shown.agg(F.count(F.lit(1)).alias("k")))  # a row each
    line = F.when(F.col("n") == F.col("k"), list_phrase(F.col("n"), "book", "books")).otherwise(F.concat(F.col("k").cast("string"), F.lit(" of "), list_phrase(F.col("n"), "book", "books")))
    return n.select(line.alias("line"))


def only(rows: DataFrame, what: str, **at) -> DataFrame:
    """The rows with these values; that there are none is an error."""
    found = rows
    for c, v in at.items():
        found = found.where(F.col(c) == v)
    if found.isEmpty():
        raise LookupError(f"no {what} with " + ", ".join(f"{c} {v}" for c, v in at.items()))
    return found
