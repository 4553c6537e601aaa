import pytest
from pyspark.sql import functions as F

from lexforge.operators import evaluate, library, mutations, prefix, vectors
from lexforge.sources.snapshot import BadSnapshot, Library


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_running_sums_do_not_depend_on_ranges(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("v"), F.lit(1).alias("one"))
    whole = prefix.running(df, ["k"], "id", {"v": "before", "one": "idx"}, ends=[])
    parted = prefix.running(df, ["k"], "id", {"v": "before", "one": "idx"}, ends=[100, 101, 500, 900])
    assert rows(whole.select("id", "before", "idx"), "id") == rows(parted.select("id", "before", "idx"), "id")
    assert prefix.ranges(df, "id", 100)[0] < 200


@pytest.fixture
def marks(spark):
    return spark.createDataFrame([(1, 10, 0, 5), (2, 10, 5, 8), (3, 10, 4, 6), (4, 11, 0, 3)], "highlight_id long, block_id long, start_offset long, end_offset long").withColumn("text", F.lit("abcdefghij"))


def test_overlaps_touching_is_fine(marks):
    assert rows(library.overlaps(marks), "a", "b") == [(1, 3), (2, 3)]


def test_segments_cover_a_paragraph(marks):
    got = rows(library.highlight_segments(marks.where("highlight_id <> 3")), "block_id", "seg_start")
    assert got == [(10, 0, 5, 1), (10, 5, 8, 2), (10, 8, 10, None), (11, 0, 3, 4), (11, 3, 10, None)]


def test_checks(spark):
    good = spark.createDataFrame([(0, 5, "yellow", "abcdefgh"), (9, 19, "green", "x" * 18), (3, 3, "red", "abc"), (0, 1, None, "a")], "start_offset int, end_offset int, color string, text string")
    out = mutations.check_highlights(good)
    assert out.valid.count() == 1 and sorted(tuple(r["broken"]) for r in out.rejected.collect()) == [("color",), ("range",), ("range", "color")]
    folders = spark.createDataFrame([(1, "To Read"), (2, "to read"), (3, "  "), (4, "Ünder")], "folder_id long, name string")
    assert rows(mutations.check_folders(folders).valid.select("folder_id"), "folder_id") == [(1,), (4,)]


def test_upsert_and_ignore(spark):
    base = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k long, t long, v string")
    delta = spark.createDataFrame([(1, 6, "x"), (1, 7, "y"), (3, 1, "z")], "k long, t long, v string")
    assert rows(mutations.upsert(base, delta, ["k"], ["t"]), "k") == [(1, 7, "y"), (2, 5, "b"), (3, 1, "z")]
    assert rows(mutations.insert_or_ignore(base, delta, ["k"], ["t"]), "k") == [(1, 5, "a"), (2, 5, "b"), (3, 1, "z")]
    twice = mutations.upsert(mutations.upsert(base, delta, ["k"], ["t"]), delta, ["k"], ["t"])
    assert rows(twice, "k") == [(1, 7, "y"), (2, 5, "b"), (3, 1, "z")]


def test_import_outcomes(spark):
    files = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h2"), ("d", "h9")], "path string, file_hash string")
    have = spark.createDataFrame([("x", "h2", 7), ("d", "h3", 8)], "path string, file_hash string, book_id long")
    assert {r["path"]: r["outcome"] for r in mutations.dedup_import(files, have).collect()} == {"a": "imported", "b": "already", "c": "already", "d": "conflict"}


def test_cascades(spark):
    books = spark.createDataFrame([(1,), (2,)], "book_id long")
    notes = spark.createDataFrame([(1, 1, 5), (2, 2, None), (3, 2, 6)], "note_id long, book_id long, highlight_id long")
    marks = spark.createDataFrame([(5, 1), (6, 2)], "highlight_id long, book_id long")
    left = mutations.delete_books({"books": books, "notes": notes, "highlights": marks}, books.where("book_id = 1"))
    assert {k: v.count() for k, v in left.items()} == {"books": 1, "notes": 2, "highlights": 1}
    gone = marks.where("highlight_id = 6")
    assert rows(mutations.forget_highlights(notes, gone).select("note_id", "highlight_id"), "note_id") == [(1, 5), (2, None), (3, None)]
    assert rows(mutations.delete_highlights(marks, notes, gone)[1].select("note_id"), "note_id") == [(1,), (2,)]


def test_violations(spark):
    books = spark.createDataFrame([(1,), (1,)], "book_id long")
    chapters = spark.createDataFrame([(1, 1), (2, 9)], "chapter_id long, book_id long")
    assert {r["rule"]: r["n"] for r in mutations.violations({"books": books, "chapters": chapters}).collect()} == {"unique books": 1, "chapters without books": 1}


def test_chunks(spark):
    texts = spark.createDataFrame([(0, ""), (1, "x" * 1600), (2, "x" * 3000), (3, "x" * 3001)], "chapter_id long, text string")
    got = rows(vectors.chunk_spans(texts).select("chapter_id", "char_start", "char_end"), "chapter_id", "char_start")
    assert got == [(1, 0, 1600), (2, 0, 1600), (2, 1400, 3000), (3, 0, 1600), (3, 1400, 3000), (3, 2800, 3001)]


def test_indexable(spark):
    contents, short, prose, verse = ["Chapter heading with words"[:25]] * 20, ["a dedication"], ["word " * 60] * 3, ["a half line of verse,", "and one without"] * 10
    texts = spark.createDataFrame([(0, contents), (1, short), (2, prose), (3, verse)], "id long, ps array<string>")
    assert rows(vectors.indexable(texts, F.col("ps")).select("is_indexable"), "id") == [(False,), (False,), (True,), (True,)]


def test_offsets_to_blocks(spark):
    blocks = spark.createDataFrame([(1, i, i, "ā" * n) for i, n in enumerate((10, 5, 20))], "chapter_id long, block_idx long, block_id long, text string")
    offs = spark.createDataFrame([(1, o) for o in (0, 9, 10, 11, 15, 16, 17, 36, 37)], "chapter_id long, off long")
    assert [r["block_id"] for r in vectors.locate(offs, blocks).orderBy("off").collect()] == [0, 0, 1, 1, 1, 2, 2, 2, 2]
    stored = rows(vectors.paragraph_offsets(blocks).select("char_start", "char_end"), "block_idx")
    assert stored == [(0, 10), (12, 17), (19, 39)]


def chunk_rows(spark, data):
    return spark.createDataFrame(data, "chapter_id long, chunk_idx long, char_start long, char_end long, model string, vec array<float>")


def test_ranking_by_the_best_chunk(spark):
    chunks = chunk_rows(spark, [(1, 0, 0, 1600, "m", [0.0, 1.0]), (1, 1, 1400, 3000, "m", [1.0, 0.0]), (2, 0, 0, 1600, "m", [0.9, 0.1]), (2, 1, 1400, 3000, "m", [0.9, 0.1]), (3, 0, 0, 9, "other", [1.0, 0.0]), (4, 0, 0, 9, "m", [0.6, 0.8])])
    got = rows(vectors.rank_chapters(chunks, [1.0, 0.0], ["m"]))
    assert [(r[0], r[2], r[3], r[4]) for r in got] == [(1, 2, 1400, 3000), (2, 2, 0, 1600)]
    bad = chunk_rows(spark, [(1, 0, 0, 9, "m", [1.0])])
    with pytest.raises(Exception, match="vector of length 1"):
        vectors.rank_chapters(bad, [1.0, 0.0], ["m"]).collect()


def test_the_penalty_reorders_only(spark):
    chunks = chunk_rows(spark, [(1, 0, 0, 9, "m", [0.80])] + [(2, k, k, 9, "m", [0.70]) for k in range(19)] + [(2, 19, 19, 9, "m", [0.82])])
    assert [r[0] for r in rows(vectors.rank_chapters(chunks, [1.0], ["m"], penalty=0.0))] == [2, 1]
    assert [r[0] for r in rows(vectors.rank_chapters(chunks, [1.0], ["m"], penalty=0.01))] == [1, 2]


def test_states(spark):
    books = spark.createDataFrame([(k, k) for k in range(1, 5)], "book_id long, added_at long")
    markers = spark.createDataFrame([(3, "m"), (4, "old")], "book_id long, model string")
    chunks = spark.createDataFrame([(2, "m")], "book_id long, model string")
    assert [r["index_state"] for r in vectors.index_states(books, markers, chunks, ["m"]).orderBy("book_id").collect()] == ["none", "partial", "indexed", "none"]
    assert [r["book_id"] for r in vectors.books_to_index(books, markers, chunks, ["m"]).collect()] == [4, 2, 1]
    assert rows(vectors.semantic_status(books, markers, ["m"])) == [(1, 4)]


def test_embedding_and_codec():
    model = vectors.HashEmbedder(dim=16, bound=3)
    vec, cut = model.embed("one two three four")
    assert cut and abs(sum(x * x for x in vec) - 1) < 1e-6 and model.embed("one two three")[0] == vec
    assert vectors.blob_to_vec(vectors.vec_to_blob(vec)) == pytest.approx(vec)
    with pytest.raises(ValueError):
        vectors.blob_to_vec(b"abc")


def test_evaluation(spark):
    res = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.8), ("a", 3, 0.3), ("o", 1, 0.2)], "query string, item long, score double")
    asked = spark.createDataFrame([("a", "answered"), ("b", "answered"), ("o", "off_corpus")], "query string, kind string")
    labels = spark.createDataFrame([("a", 2, 2), ("a", 9, 1), ("b", 1, 1)], "query string, item long, grade int")
    out = {r["floor"]: r for r in evaluate.evaluate(res, asked, labels, [0.0, 0.5]).collect()}
    import math

    dcg, ideal = 3 / math.log2(3), 3 + 1 / math.log2(3)
    assert out[0.0]["recall"] == pytest.approx(0.25) and out[0.0]["ndcg"] == pytest.approx(dcg / ideal / 2)
    assert (out[0.0]["emptied"], out[0.0]["leaks"], out[0.0]["no_answer"]) == (1, 1, 0.0)
    assert (out[0.5]["emptied"], out[0.5]["leaks"], out[0.5]["no_answer"]) == (1, 0, 1.0)


def test_snapshots(spark, tmp_path):
    books = spark.createDataFrame([(1, "A")], "book_id long, title string")
    chapters = spark.createDataFrame([(1, 1)], "chapter_id long, book_id long")
    lib = Library(spark, str(tmp_path / "lib"))
    assert lib.current() is None
    first = lib.write({"books": books, "chapters": chapters})
    lib.verify()
    manifest = lib.backup(str(tmp_path / "bak"))
    assert manifest["tables"]["books"]["rows"] == 1
    lib.write({"books": books.unionByName(spark.createDataFrame([(2, "B")], books.schema)), "chapters": chapters})
    assert lib.read("books").count() == 2 and lib.read("books", first).count() == 1
    assert lib.restore(str(tmp_path / "bak")) == {"books": 1, "chapters": 1}
    assert lib.read("books").count() == 1
    with pytest.raises(BadSnapshot):
        lib.backup(lib.root)
    with pytest.raises(BadSnapshot):
        lib.restore(str(tmp_path / "nothing"))


def test_damaged_backups_are_refused(spark, tmp_path):
    books = spark.createDataFrame([(1, "A")], "book_id long, title string")
    lib = Library(spark, str(tmp_path / "lib"))
    lib.write({"books": books})
    bad = Library(spark, str(tmp_path / "bad"))
    bad.write({"books": books})
    at = bad.current()
    bad.files.write(f"{at}/manifest.json", bad.files.read(f"{at}/manifest.json").replace('"rows": 1', '"rows": 2'))
    with pytest.raises(BadSnapshot, match="damaged"):
        lib.restore(bad.root)
    bad.files.write(f"{at}/manifest.json", bad.files.read(f"{at}/manifest.json").replace('"schema_version": 8', '"schema_version": 99'))
    with pytest.raises(BadSnapshot, match="later"):
        lib.restore(bad.root)
    assert lib.read("books").count() == 1
    broken = Library(spark, str(tmp_path / "broken"))
    broken.write({"books": books, "chapters": spark.createDataFrame([(1, 5)], "chapter_id long, book_id long")})
    with pytest.raises(BadSnapshot, match="chapters without books"):
        lib.restore(broken.root)


def test_null_columns_of_older_versions(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "old"))
    lib.write({"books": spark.createDataFrame([(1, "A")], "book_id long, title string")})
    at = lib.current()
    lib.files.write(f"{at}/manifest.json", lib.files.read(f"{at}/manifest.json").replace('"schema_version": 8', '"schema_version": 2'))
    assert lib.read("books").columns == ["book_id", "title", "file_hash"]


def test_what_is_not_there_is_an_error(spark):
    blocks = spark.createDataFrame([(1, 5, 0, 10, "a")], "chapter_id long, book_id long, block_idx long, block_id long, text string")
    assert library.chapter_content(blocks, 1).count() == 1
    with pytest.raises(Exception, match="no chapter with chapter_id 2"):
        library.chapter_content(blocks, 2).collect()
    folders = spark.createDataFrame([(7, "f")], "folder_id long, name string")
    marks = spark.createDataFrame([], "folder_id long, bookmark_id long, block_id long, chapter_id long, book_id long")
    chapters, books = spark.createDataFrame([(1, "c")], "chapter_id long, title string"), spark.createDataFrame([(5, "b")], "book_id long, title string")
    assert library.passages_of(7, folders, marks, blocks, chapters, books).count() == 0
    with pytest.raises(Exception, match="no folder with folder_id 8"):
        library.passages_of(8, folders, marks, blocks, chapters, books).collect()


def test_changed_notes(spark):
    notes = spark.createDataFrame([(1, "old", "then"), (2, "same", "then")], "note_id long, body string, updated_at string")
    got = {r["note_id"]: (r["body"], r["updated_at"]) for r in mutations.update_notes(notes, spark.createDataFrame([(1, "new"), (9, "x")], "note_id long, body string"), F.lit("now")).collect()}
    assert got == {1: ("new", "now"), 2: ("same", "then")}


def test_notes_have_one_anchor_each(spark):
    kind = "note_id long, block_id long, highlight_id long, body string"
    there = spark.createDataFrame([(1, 10, None, "a"), (2, 10, 5, "b")], kind)
    new = spark.createDataFrame([(3, 10, None, "c"), (4, 10, 6, "d"), (5, 10, 6, "e"), (6, 11, None, " "), (7, 12, 5, "f")], kind)
    out = mutations.add_notes(there, new)
    assert sorted(r["note_id"] for r in out.valid.collect()) == [4, 7]
    assert {r["note_id"]: r["broken"] for r in out.rejected.collect()} == {3: ["free"], 5: ["free"], 6: ["body"]}


def test_places_are_those_of_one_sort(spark):
    rows = [((k * 7919) % 1000, k) for k in range(1000)]
    got = prefix.placed(spark.createDataFrame(rows, "a int, b int").repartition(6), F.desc("a"), F.asc("b")).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["place"])] == sorted(rows, key=lambda r: (-r[0], r[1])) and {r["place"] for r in got} == set(range(1, 1001))


def test_ranges_are_counted_alike(spark):
    for ends in ([], [5], [1, 4, 9], list(range(0, 3000, 3))):
        frame = spark.createDataFrame([(k,) for k in (-5, 0, 1, 4, 5, 9, 100, 2997, 5000)], "k long")
        if ends:
            assert all(r["n"] == sum(e < r["k"] for e in ends) for r in frame.select("k", prefix.range_number(F.col("k"), ends, "bigint").alias("n")).collect())


def test_best_items_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    rows = [(k, [float((k * 37) % 11), float(k % 5)]) for k in range(40)] + [(41, [3.0, 3.0]), (40, [3.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = frame.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    got = {}
    for r in vectors.top_for_queries(frame, asked, 4).collect():
        got.setdefault(r["query"], set()).add((r["item"], round(r["score"], 6)))
    table = dict(rows)
    for q in (0, 9, 18, 27, 36):
        every = sorted(((i, sum(a * b for a, b in zip(table[q], v, strict=True))) for i, v in rows if i != q), key=lambda x: (-x[1], x[0]))
        assert got[q] == set(every[:4])
    assert vectors.top_for_queries(frame, asked.limit(0), 4).count() == 0


def test_best_rows_for_queries_in_small_blocks(spark, monkeypatch):
    import numpy as np

    from lexforge.operators import vectors

    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(3000, 8)), 1)  # many equal products
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 50 = 0").selectExpr("vec_id as query", "embedding as q")
    monkeypatch.setattr(vectors, "AT_ONCE", 7)
    got = {}
    for row in vectors.top_for_queries(rows, asked, 5).collect():
        got.setdefault(row["query"], []).append((-row["score"], row["item"]))
    for q in range(0, 3000, 50):
        score = np.einsum("j,kj->k", x[q], x)
        want = sorted((-s, i) for i, s in enumerate(score) if i != q)[:5]
        assert [(i, round(s, 9)) for s, i in sorted(got[q])] == [(i, round(s, 9)) for s, i in want]


def test_an_embedder_gives_what_hashes_of_tokens_give():
    import hashlib

    import numpy as np

    from lexforge.functions.excerpts import token_spans
    from lexforge.operators import vectors

    for text in ("Äpfel und naïve cafés, cafés", "", "日本語 ½ x²", "a " * 600):
        out = np.zeros(64)
        for w in [s.term for s in token_spans(text)][:512]:
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[h % 64] += 1.0 if h >> 63 else -1.0
        size = float(np.sqrt(out @ out))
        assert vectors.HashEmbedder().embed(text) == ((out / size if size else out).astype(np.float32).tolist(), len(token_spans(text)) > 512)
