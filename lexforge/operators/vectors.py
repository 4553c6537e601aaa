"""Search by meaning: chunks, eligibility, ranking by the best chunk, and the way from an offset to a paragraph."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.functions.excerpts import preview
from lexforge.functions.text import ends_like_sentence, trim_all
from lexforge.functions.words import KEPT, words

# Fixed values of the chunks and the ranking.
CHUNK, STEP = 1600, 1400
MIN_SCORE, LENGTH_PENALTY = 0.63, 0.01
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def chunk_spans(chapters: DataFrame, text: str = "text") -> DataFrame:
    """``chapters`` with a row for each chunk: ``chunk_idx``, ``char_start``, ``char_end``. Chunks overlap, and the last ends with
    the text; an empty text has none."""
    n = F.length(text)
    last = F.greatest(F.ceil((n - CHUNK) / F.lit(float(STEP))), F.lit(0)).cast("int")
    spans = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * STEP).cast("bigint").alias("char_start"), F.least(i * STEP + CHUNK, n).cast("bigint").alias("char_end")))
    rows = chapters.where(n > 0).select("*", F.posexplode(spans).alias("chunk_idx", "span"))
    return rows.withColumn("chunk_idx", F.col("chunk_idx").cast("bigint")).select("*", "span.char_start", "span.char_end").drop("span")


def indexable(chapters: DataFrame, paragraphs: Column) -> DataFrame:
    """``chapters`` with ``is_indexable``, by their array of ``paragraphs``: long enough, and not a page of short lines that do
    not end as sentences do (a table of contents, say)."""
    n = F.size(paragraphs)
    chars = F.aggregate(paragraphs, F.lit(0), lambda s, p: s + F.length(p)) + F.greatest(n - 1, F.lit(0))
    lengths = F.sort_array(F.transform(paragraphs, lambda p: F.length(trim_all(p))))
    median = F.get(lengths, F.floor(n / 2).cast("int"))
    sentences = F.size(F.filter(paragraphs, ends_like_sentence))
    ok = F.when(chars < 200, F.lit(False)).when(n < 10, F.lit(True)).otherwise(~((median < 40) & (sentences * 100 < n * 35)))
    return chapters.withColumn("is_indexable", ok)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scored_chunks(chunks: DataFrame, query: list[float], models: list[str]) -> DataFrame:
    """Chunks of compatible models with their ``score``. A vector of another length than the query's is an error."""
    rows = chunks.where(F.col("model").isin(models))
    q = F.array(*[F.lit(float(x)) for x in query])
    checked = F.when(F.size("vec") == len(query), F.col("vec")).otherwise(F.raise_error(F.concat(F.lit("vector of length "), F.size("vec").cast("string"))))
    return rows.withColumn("score", dot(checked, q))


#: Query vectors that are sent to all tasks at once.
QUERY_BLOCK = 4096
#: Of them, those that are compared with a thousand rows at once.
AT_ONCE = 256


def top_for_queries(rows: DataFrame, asked: DataFrame, k: int, item: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``query``, ``item``, ``score``): for each of ``asked`` (``query``, ``q``) the ``k`` rows with the largest dot products, itself left out,
    equal ones in order of ``item``. Queries go to the rows in blocks of bounded size; a task keeps the best of its rows."""
    n = asked.count()
    blocks = -(-n // QUERY_BLOCK)
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect()
        if not part:
            continue
        names, vectors = np.array([r["query"] for r in part], np.int64), np.array([r["q"] for r in part], np.float64)

        def run(batches: Iterator[pa.RecordBatch], names=names, vectors=vectors) -> Iterator[pa.RecordBatch]:
            items, scores = np.full((len(names), k), np.iinfo(np.int64).max), np.full((len(names), k), -np.inf)
            for batch in batches:
                for s in range(0, batch.num_rows, 1024):
                    own = batch.slice(s, 1024)
                    x = own.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.num_rows, -1)
                    one = own.column(0).to_numpy()
                    for q in range(0, len(names), AT_ONCE):
                        part = slice(q, q + AT_ONCE)
                        # Every product is summed alike, so equal vectors have equal scores.
                        new = np.einsum("ij,kj->ik", vectors[part], x)
                        new[names[part, None] == one[None, :]] = -np.inf
                        # Only what comes up to a query's last row of its best is put in order with them.
                        who, at = np.nonzero((new >= scores[part, -1:]) & np.isfinite(new))
                        if not len(who):
                            continue
                        m = len(new)
                        who, score = np.concatenate([np.repeat(np.arange(m), k), who]), np.concatenate([scores[part].ravel(), new[who, at]])
                        name = np.concatenate([items[part].ravel(), one[at]])
                        order = np.lexsort((name, -score, who))
                        start = np.searchsorted(who[order], np.arange(m))
                        best = order[start[:, None] + np.arange(k)]
                        items[part], scores[part] = name[best], score[best]
            some = np.isfinite(scores).ravel()
            who = np.repeat(names, k)
            yield pa.RecordBatch.from_arrays([pa.array(who[some]), pa.array(items.ravel()[some]), pa.array(scores.ravel()[some])], ["query", "item", "score"])

        found = rows.select(F.col(item).cast("bigint"), vector).mapInArrow(run, "query bigint, item bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query bigint, item bigint, score double")
    w = W.partitionBy("query").orderBy(F.desc("score"), "item")
    return out.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).drop("k")


def best_for_queries(rows: DataFrame, asked: DataFrame, group: str = "item", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``query``, ``item``, ``score``, ``n_chunks``): for each of ``asked`` (``query``, ``q``) and each group of rows the largest dot product, the
    query's own row left out, and the number of rows. Queries go to the rows in blocks; a task sums its rows up."""
    n = asked.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect()
        names, vectors = np.array([r["query"] for r in part], np.int64), np.array([r["q"] for r in part], np.float64)

        def run(batches: Iterator[pa.RecordBatch], names=names, vectors=vectors) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in range(0, batch.num_rows, 1024):
                    own = batch.slice(s, 1024)
                    x = own.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.num_rows, -1)
                    keys, which = own.column(0).to_numpy(), own.column(1).to_numpy()
                    scores = np.einsum("ij,kj->ik", vectors, x) if len(names) else np.zeros((0, len(keys)))
                    scores[names[:, None] == keys[None, :]] = -np.inf
                    order = np.argsort(which, kind="stable")
                    groups, starts = np.unique(which[order], return_index=True)
                    best = np.maximum.reduceat(scores[:, order], starts, axis=1)
                    count = np.add.reduceat(np.isfinite(scores[:, order]).astype(np.int64), starts, axis=1)
                    some = count.ravel() > 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, len(groups))[some]), pa.array(np.tile(groups, len(names))[some]), pa.array(best.ravel()[some]), pa.array(count.ravel()[some])], ["query", "item", "score", "n"])

        found = rows.select(F.col(key).cast("bigint"), F.col(group).cast("bigint"), vector).mapInArrow(run, "query bigint, item bigint, score double, n bigint")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("query", "item").agg(F.max("score").alias("score"), F.sum("n").alias("n_chunks"))


def replace_chunks(chunks: DataFrame, chapter_id: int, model: str, new: DataFrame) -> DataFrame:
    """``chunks`` with those of a chapter and model replaced by ``new``; other chapters' and models' stay."""
    return chunks.where(~((F.col("chapter_id") == chapter_id) & (F.col("model") == model))).unionByName(new.select(*chunks.columns))


def model_names(names: list[str]) -> str:
    """A list of model names as JSON."""
    return json.dumps(names)


def models_of(column: Column) -> Column:
    """The names in such a list."""
    return F.explode(F.from_json(column, "array<string>"))


def rank_chapters(chunks: DataFrame, query: list[float], models: list[str], min_score: float = MIN_SCORE, penalty: float = LENGTH_PENALTY, limit: int | None = 20) -> DataFrame:
    """Chapters by their best chunk: ``chapter_id``, ``score``, ``n_chunks``, ``char_start``, ``char_end``. The floor is for the score
    itself; the penalty for many chunks only changes the order. Of equal chunks the first counts. Best chunks are
    kept per task, so a chapter's chunks are not gathered."""
    best = scored_chunks(chunks, query, models).groupBy("chapter_id").agg(
        F.max_by(F.struct("score", "char_start", "char_end"), F.struct(F.col("score"), -F.col("chunk_idx"))).alias("b"), F.count(F.lit(1)).alias("n_chunks")
    )
    rows = best.select("chapter_id", "b.score", "n_chunks", "b.char_start", "b.char_end").where(F.col("score") >= min_score)
    order = [F.round(F.col("score") - penalty * F.log("n_chunks"), 9).desc(), F.col("chapter_id")]
    return rows.orderBy(*order).limit(limit) if limit is not None else rows


def block_spans(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``span_start`` and ``span_end`` in their chapter's text, in which one character parts them: a
    paragraph's separator belongs to the next one. The last one's end is open."""
    w = W.partitionBy("chapter_id").orderBy("block_idx")
    before = F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = F.lead("block_idx").over(w).isNull()
    out = blocks.withColumn("span_start", before.cast("bigint"))
    # The separator before a paragraph is part of it.
    low = F.when(F.col("span_start") > 0, F.col("span_start") - 1).otherwise(F.lit(0))
    return out.withColumn("span_low", low.cast("bigint")).withColumn("span_end", F.when(last, F.lit(1 << 62)).otherwise(F.col("span_start") + F.length("text")).cast("bigint"))


def locate(offsets: DataFrame, blocks: DataFrame) -> DataFrame:
    """``offsets`` (``chapter_id``, ``off``, and others) with the ``block_id`` that holds each. Paragraphs and offsets of a chapter are
    read together in order: an offset is in the paragraph that began last."""
    starts = block_spans(blocks).select("chapter_id", F.col("span_low").alias("at"), F.col("block_idx").alias("turn"), F.col("block_id").alias("own"))
    wanted = offsets.select("*", F.col("off").alias("at"), F.lit(1 << 62).alias("turn"), F.lit(True).alias("asked"))
    w = W.partitionBy("chapter_id").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)
    rows = wanted.unionByName(starts, allowMissingColumns=True).withColumn("block_id", F.last("own", ignorenulls=True).over(w))
    return rows.where("asked and block_id is not null").select(*offsets.columns, "block_id")


def paragraph_offsets(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``char_start`` and ``char_end`` as they are stored: two characters part them."""
    w = W.partitionBy("chapter_id").orderBy("block_idx").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0)).cast("bigint")
    return blocks.withColumn("char_start", start).withColumn("char_end", (start + F.length("text")).cast("bigint"))


@F.pandas_udf(T.StringType())
def preview_column(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([preview(t, int(s), int(e)) for t, s, e in zip(text, start, end, strict=True)])


def chapter_matches(ranked: DataFrame, chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """The ranked chapters with titles, the paragraph where the best chunk begins, and a preview. ``ranked`` is bounded by
    its limit, so it may be broadcast; one join, not a query for each."""
    few = F.broadcast(ranked)
    own = chapters.join(few, "chapter_id")
    at = locate(few.select("chapter_id", F.col("char_start").alias("off")), blocks.join(F.broadcast(ranked.select("chapter_id")), "chapter_id", "left_semi"))
    out = own.join(at.select("chapter_id", "block_id"), "chapter_id")
    return out.withColumn("preview", preview_column("text", "char_start", "char_end")).drop("text")


# --- embedding


class HashEmbedder:
    """A stand-in for a sentence encoder that needs no model file: signed hashes of tokens, at unit length. Takes the place
    that a real model plugs into: a name, a length, a bound on tokens, and ``embed``."""

    def __init__(self, dim: int = 64, bound: int = 512):
        self.name, self.dim, self.bound = f"hash-{dim}", dim, bound
        self.known: dict[str, int] = {}  # places of words, while they are few

    def embed(self, text: str) -> tuple[list[float], bool]:
        """The vector, and whether the text was cut at the bound."""
        own = words(text)
        known, code = self.known, []
        for w in own[: self.bound]:
            c = known.get(w)
            if c is None:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                if len(known) >= KEPT:
                    known.clear()
                c = known[w] = h % self.dim * 2 + (h >> 63)
            code.append(c)
        count = np.bincount(code, minlength=2 * self.dim).astype(np.float64) if code else np.zeros(2 * self.dim)
        out = count[1::2] - count[::2]
        size = float(np.sqrt(out @ out))
        return (out / size if size else out).astype(np.float32).tolist(), len(own) > self.bound

    def embed_query(self, text: str) -> list[float]:
        return self.embed(text)[0]


def embed_chunks(chunks: DataFrame, embedder: HashEmbedder, text: str = "text") -> DataFrame:
    """``chunks`` (with their chapter's ``text``) with ``model``, ``vec`` and ``truncated``; the model is made once in a worker."""
    kind = T.StructType([T.StructField("vec", T.ArrayType(T.FloatType())), T.StructField("truncated", T.BooleanType())])

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([embedder.embed(t) for t in texts], columns=["vec", "truncated"])

    piece = F.substring(F.col(text), F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int"))
    return chunks.withColumn("e", run(piece)).select("*", F.lit(embedder.name).alias("model"), "e.vec", "e.truncated").drop("e")


def vec_to_blob(vec: list[float]) -> bytes:
    return struct.pack(f"<{len(vec)}f", *vec)


def blob_to_vec(blob: bytes) -> list[float]:
    if len(blob) % 4:
        raise ValueError("not a whole number of floats")
    return list(struct.unpack(f"<{len(blob) // 4}f", blob))


# --- what is indexed


def index_states(books: DataFrame, markers: DataFrame, chunks: DataFrame, models: list[str]) -> DataFrame:
    """``books`` with ``index_state``: ``indexed`` by a marker of a compatible model, with or without chunks; ``partial`` by chunks
    alone; else ``none``."""
    done = markers.where(F.col("model").isin(models)).select("book_id").distinct().withColumn("done", F.lit(True))
    some = chunks.where(F.col("model").isin(models)).select("book_id").distinct().withColumn("some", F.lit(True))
    state = F.when(F.col("done"), "indexed").when(F.col("some"), "partial").otherwise("none")
    return books.join(done, "book_id", "left").join(some, "book_id", "left").withColumn("index_state", state).drop("done", "some")


def books_to_index(books: DataFrame, markers: DataFrame, chunks: DataFrame, models: list[str]) -> DataFrame:
    """Books that are not indexed, newest first."""
    return index_states(books, markers, chunks, models).where("index_state <> 'indexed'").orderBy(F.desc("added_at"), F.desc("book_id"))


def semantic_status(books: DataFrame, markers: DataFrame, models: list[str]) -> DataFrame:
    """One row: books with a marker of a compatible model, and books."""
    indexed = markers.where(F.col("model").isin(models)).join(books, "book_id", "left_semi").agg(F.countDistinct("book_id").alias("indexed"))
    return indexed.crossJoin(books.agg(F.count(F.lit(1)).alias("total")))  # a row each
