"""Changes to immutable tables: upserts, inserts that keep what is there, cascades, and the checks a store would enforce.

Each takes a table and a change and returns the new table (and what was rejected); snapshots publish them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. Kept per task before the shuffle, so a key with many rows is a few."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*").select(*rows.columns)


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``base`` with the last row of each key of ``delta`` in place of its own."""
    new = latest(delta, keys, order).select(*base.columns)
    return base.join(new.select(*keys), keys, "left_anti").select(*base.columns).unionByName(new)


def insert_or_ignore(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``base`` with the first row of each key of ``delta`` that it does not have."""
    rest = [c for c in delta.columns if c not in keys]
    first = delta.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
    return base.unionByName(first.join(base.select(*keys), keys, "left_anti").select(*base.columns))


def dedup_import(files: DataFrame, library: DataFrame) -> DataFrame:
    """Outcome of each file to import (``path``, ``file_hash``): ``imported``, ``already`` (its content is there, or in an earlier
    file), or ``conflict`` (its path is there with another content)."""
    here = library.groupBy("file_hash").agg(F.min("book_id").alias("known"))
    paths = library.select("path", F.col("file_hash").alias("path_hash")).dropDuplicates(["path"])
    w = W.partitionBy("file_hash").orderBy("path")
    rows = files.join(here, "file_hash", "left").join(paths, "path", "left").withColumn("k", F.row_number().over(w))
    outcome = F.when(F.col("known").isNotNull(), "already").when(F.col("path_hash").isNotNull() & (F.col("path_hash") != F.col("file_hash")), "conflict").when(F.col("k") > 1, "already").otherwise("imported")
    return rows.select("path", "file_hash", "known", outcome.alias("outcome"))


#: What goes with a book, and by which column.
CASCADE = {
    "books": "book_id", "chapters": "book_id", "blocks": "book_id", "bookmarks": "book_id", "highlights": "book_id", "notes": "book_id",
    "chunk_embeddings": "book_id", "book_embeddings": "book_id", "positions": "book_id", "covers": "book_id",
}


def delete_books(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the books of ``gone`` (``book_id``) and what is theirs."""
    keys = gone.select("book_id").distinct()
    return {name: t.join(keys, "book_id", "left_anti") if CASCADE.get(name) in t.columns else t for name, t in tables.items()}


def delete_folder(folders: DataFrame, bookmarks: DataFrame, folder_id: int) -> tuple[DataFrame, DataFrame]:
    return folders.where(F.col("folder_id") != folder_id), bookmarks.where(F.col("folder_id") != folder_id)


def delete_highlights(highlights: DataFrame, notes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Highlights go with the notes on them."""
    keys = gone.select("highlight_id").distinct()
    return highlights.join(keys, "highlight_id", "left_anti"), notes.join(keys, "highlight_id", "left_anti")


def forget_highlights(notes: DataFrame, gone: DataFrame) -> DataFrame:
    """Notes whose highlight went are notes on the paragraph: the reference is set to null."""
    keys = gone.select("highlight_id").distinct().withColumn("__gone", F.lit(True))
    out = notes.join(keys, "highlight_id", "left").withColumn("highlight_id", F.when(F.col("__gone").isNull(), F.col("highlight_id")))
    return out.select(*notes.columns)


def update_where(table: DataFrame, key: str, value, changes: dict[str, Column]) -> DataFrame:
    """``table`` with some columns of the rows of a key changed."""
    return table.select(*[F.when(F.col(key) == value, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns])


# --- checks


@dataclass(frozen=True)
class Checked:
    valid: DataFrame
    rejected: DataFrame


def check(rows: DataFrame, **rules: Column) -> Checked:
    """Rows that keep all rules, and the others with the names of those they break. A rule that is null is broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda n: n.isNotNull())
    marked = rows.withColumn("broken", broken)
    return Checked(marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0))


def check_highlights(rows: DataFrame) -> Checked:
    """Offsets inside the text, and a known colour."""
    from lexforge.sources.corpus import COLOURS

    inside = (F.col("start_offset") >= 0) & (F.col("start_offset") < F.col("end_offset")) & (F.col("end_offset") <= F.length("text"))
    return check(rows, range=inside, color=F.col("color").isin(*COLOURS))


def check_folders(rows: DataFrame) -> Checked:
    """Names that are not blank, and differ by more than ASCII case: the first of equals (by ``folder_id``) is valid."""
    from lexforge.functions.text import nocase, trim_all

    w = W.partitionBy(nocase(F.col("name"))).orderBy("folder_id")
    numbered = rows.withColumn("__k", F.row_number().over(w))
    out = check(numbered, blank=F.length(trim_all(F.col("name"))) > 0, unique=F.col("__k") == 1)
    return Checked(out.valid.drop("__k"), out.rejected.drop("__k"))


def add_highlights(highlights: DataFrame, new: DataFrame) -> Checked:
    """New highlights that overlap neither with one of their paragraph that is there, nor with a new one of a smaller number; the
    others are rejected. Touching is not overlapping."""
    there = highlights.select("block_id", "start_offset", "end_offset", F.lit(None).cast("bigint").alias("of"))
    both = there.unionByName(new.select("block_id", "start_offset", "end_offset", F.col("highlight_id").alias("of"))).alias("a")
    n = new.select("highlight_id", "block_id", "start_offset", "end_offset").alias("n")
    before = F.col("a.of").isNull() | (F.col("a.of") < F.col("n.highlight_id"))
    hit = (F.col("a.block_id") == F.col("n.block_id")) & before & (F.col("a.start_offset") < F.col("n.end_offset")) & (F.col("a.end_offset") > F.col("n.start_offset"))
    bad = n.join(both, hit, "left_semi").select(F.col("highlight_id"))
    rejected = new.join(bad, "highlight_id", "left_semi").withColumn("broken", F.array(F.lit("overlap")))
    return Checked(new.join(bad, "highlight_id", "left_anti"), rejected)


def add_notes(notes: DataFrame, new: DataFrame) -> Checked:
    """New notes with a body, on anchors (a highlight, or else a paragraph) that have none yet; of new ones on one anchor the one of the
    smallest number."""
    from lexforge.functions.text import trim_all

    anchor = ["block_id", "highlight_id"]
    taken = notes.select(*[F.col(c).alias(f"__{c}") for c in anchor]).distinct().withColumn("__taken", F.lit(True))
    same = F.col("block_id").eqNullSafe(F.col("__block_id")) & F.col("highlight_id").eqNullSafe(F.col("__highlight_id"))
    first = new.groupBy(*anchor).agg(F.min("note_id").alias("__first"))
    own = F.col("n.block_id").eqNullSafe(F.col("f.block_id")) & F.col("n.highlight_id").eqNullSafe(F.col("f.highlight_id"))
    numbered = new.alias("n").join(first.alias("f"), own).select("n.*", "__first").join(taken, same, "left")
    out = check(numbered, free=F.col("__taken").isNull() & (F.col("note_id") == F.col("__first")), body=F.length(trim_all(F.col("body"))) > 0)
    return Checked(out.valid.select(*new.columns), out.rejected.select(*new.columns, "broken"))


def update_notes(notes: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """``notes`` with the bodies of ``changes`` (``note_id``, ``body``) and ``updated_at`` set to ``now`` where they are."""
    new = changes.select("note_id", F.col("body").alias("__body"))
    out = notes.join(new, "note_id", "left")
    out = out.withColumn("updated_at", F.when(F.col("__body").isNotNull(), now).otherwise(F.col("updated_at"))).withColumn("body", F.coalesce("__body", "body"))
    return out.select(*notes.columns)


def check_renames(folders: DataFrame, wanted: DataFrame) -> Checked:
    """New names (``folder_id``, ``name``) that are not blank and that no other folder has, whatever the ASCII case. A folder without
    a number is another one than any that has one."""
    from lexforge.functions.text import nocase, trim_all

    others = folders.select(F.col("folder_id").alias("__of"), nocase(F.col("name")).alias("__name"))
    taken = wanted.withColumn("__low", nocase(F.col("name"))).join(others, (F.col("__low") == F.col("__name")) & ~F.col("folder_id").eqNullSafe(F.col("__of")), "left_semi")
    marked = wanted.join(taken.select("folder_id").distinct().withColumn("__taken", F.lit(True)), "folder_id", "left")
    out = check(marked, blank=F.length(trim_all(F.col("name"))) > 0, unique=F.col("__taken").isNull())
    return Checked(out.valid.drop("__taken"), out.rejected.drop("__taken"))


#: Characters of a title or author, at most.
FIELD = 500


def check_fields(rows: DataFrame, fields: list[str]) -> Checked:
    """Rows whose fields are not blank and have ``FIELD`` characters at most; a null field is not known, and fine."""
    from lexforge.functions.text import trim_all

    rules = {}
    for c in fields:
        size = F.length(trim_all(F.col(c)))
        rules |= {f"{c} blank": F.col(c).isNull() | (size > 0), f"{c} long": F.col(c).isNull() | (size <= FIELD)}
    return check(rows, **rules)


def default_folder(folders: DataFrame, bookmarks: DataFrame, folder_id: int, name: str = "Bookmarks") -> tuple[DataFrame, DataFrame]:
    """Bookmarks without a folder go to one of this number, which is there from then on."""
    own = folders.sparkSession.range(1).select(*[F.lit({"folder_id": folder_id, "name": name}.get(c)).cast(folders.schema[c].dataType).alias(c) for c in folders.columns])
    new = own.join(folders.select("folder_id"), "folder_id", "left_anti").select(*folders.columns)
    return folders.unionByName(new), bookmarks.withColumn("folder_id", F.coalesce("folder_id", F.lit(folder_id).cast(bookmarks.schema["folder_id"].dataType)))


def backfill_markers(markers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Markers (``book_id``, ``model``), with one for each book and model that has chunks and no marker."""
    have = chunks.select("book_id", "model").distinct()
    return markers.select("book_id", "model").unionByName(have.join(markers, ["book_id", "model"], "left_anti"))


def report(outcomes: DataFrame) -> DataFrame:
    """How often there was each outcome."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are there more than once."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose parent is missing; a null key has none and needs none."""
    keys = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(keys, key, "left_anti")


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(``rule``, ``n``): how often each rule of the library is broken, for the tables that are given."""
    keys = {"books": ["book_id"], "chapters": ["chapter_id"], "blocks": ["block_id"], "bookmarks": ["folder_id", "block_id"], "positions": ["book_id"], "highlights": ["highlight_id"], "notes": ["note_id"], "covers": ["book_id"]}
    parents = [("chapters", "books", "book_id"), ("blocks", "chapters", "chapter_id"), ("bookmarks", "blocks", "block_id"), ("highlights", "blocks", "block_id"), ("notes", "blocks", "block_id"), ("notes", "highlights", "highlight_id"), ("positions", "books", "book_id")]
    found = [duplicates(tables[t], k).select(F.lit(f"unique {t}").alias("rule")) for t, k in keys.items() if t in tables]
    found += [orphans(tables[c], tables[p], k).select(F.lit(f"{c} without {p}").alias("rule")) for c, p, k in parents if c in tables and p in tables]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
