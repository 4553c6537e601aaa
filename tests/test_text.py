import pytest
from pyspark.sql import functions as F

from lexforge.functions import porter
from lexforge.functions import text as T
from lexforge.functions.excerpts import marked_runs, preview, snippet, token_spans


def values(spark, make, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokens_fold_and_keep_marks_inside(spark):
    got = values(spark, T.tokens, ["Paṭācārā's self-aware Éß", "̣ a b́c 12th", "", None, "日本 x"])
    assert got == [["patacara", "s", "self", "aware", "eß"], ["a", "bc", "12th"], [], [], ["日本", "x"]]


def test_python_and_column_folding_agree(spark):
    rows = ["Nibbāna", "ÀÉÎõü", "Straße", "ŁØ", "ṝṣi"]
    assert values(spark, T.fold, rows) == [T.fold_py(r) for r in rows]


def test_white_space(spark):
    assert values(spark, T.collapse_or_null, [" a  \n b ", " \t "]) == ["a b", None]
    assert values(spark, T.trim_all, ["\n a b\t"]) == ["a b"]


def test_code_points(spark):
    assert values(spark, lambda c: T.cut(c, F.lit(0), F.lit(8)), ["Paṭācārā went home"]) == ["Paṭācārā"]
    assert values(spark, lambda c: T.cut(c, F.lit(1), F.lit(3)), ["😀ab"]) == ["ab"]


@pytest.mark.parametrize(("word", "want"), [("12", True), ("12345", False), ("xiv", True), ("XIV", True), ("xIv", False), ("iiii", False), ("cxcix", True), ("cc", False), ("", False), ("mix", False)])
def test_page_numbers(spark, word, want):
    assert values(spark, T.is_page_number, [word]) == [want]


def test_running_key(spark):
    assert values(spark, T.running_key, ["6   Buddhist Life", "Buddhist Life  7", " 12 ", "iv", "A mix"]) == ["Buddhist Life", "Buddhist Life", "", "", "A mix"]


def test_titles(spark):
    assert values(spark, T.tidy_stem, ["my_bookTitle-two"]) == ["my book Title two"]
    assert values(spark, T.is_junk, ["Untitled", "Slide 3", "draft.docx", "Microsoft Word - x", "123", "A Book"]) == [True] * 5 + [False]
    keys = values(spark, T.catalogue_key, ["The Book 10", "Book 9", "éclair", "Eagle", "Eclipse"])
    assert keys[1] < keys[0] and keys[3] < keys[2] < keys[4]


def test_percent(spark):
    rows = spark.createDataFrame([(16, 18, False), (1, 2, False), (1, 3, False), (2, 3, False), (0, 0, False), (1, 9, True)], "b long, t long, f boolean")
    assert [r[0] for r in rows.select(T.percent(F.col("b"), F.col("t"), F.col("f"))).collect()] == [89, 50, 33, 67, 0, 100]


def test_filter(spark):
    rows = spark.createDataFrame([("Nibbāna", None), (None, "Thich Nhat Hanh"), ("Heart", "Nhat Hanh")], "t string, a string")
    hit = lambda q: [r["t"] for r in rows.where(T.matches_words(T.shown_title(F.col("t"), F.col("a")), q)).collect()]
    assert hit("NIBBANA") == ["Nibbāna"] and hit("nhat hanh heart") == ["Heart"] and hit("untitled") == [None] and len(hit("  ")) == 3


def test_percent_decode(spark):
    assert values(spark, T.percent_decode, ["a%20b+c", "100%", "%C3%A9"]) == ["a b+c", "100%", "é"]


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("generalization", "gener"), ("controll", "control"), ("go", "go"), ("sky", "sky"), ("triplicate", "triplic"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("plastered", "plaster"), ("bled", "bled"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("tanned", "tan"), ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail")],
)
def test_stems(word, want):
    assert porter.stem(word) == want


def test_long_tokens_are_not_stemmed():
    assert porter.stem("a" * 62 + "ing") == "a" * 62 + "ing"


def test_stems_of_the_vocabulary(spark):
    rows = porter.stems_of(spark.createDataFrame([("running",), ("runs",), ("running",)], "term string")).collect()
    assert {(r["term"], r["stem"]) for r in rows} == {("running", "run"), ("runs", "run")}


def test_snippets():
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    spans = token_spans(text)
    at = [s.term for s in spans].index("thirteen")
    assert snippet(text, [(at, 0, 1)]) == "...three four five six seven eight nine ten eleven twelve [thirteen] fourteen"
    assert snippet("He explained the dhamma.", [(3, 0, 1)]) == "He explained the [dhamma]."
    assert snippet("a b c", [(0, 0, 2), (1, 1, 2)]) == "[a b c]"
    assert marked_runs("x [y] z") == [("x ", False), ("y", True), (" z", False)]


def test_snippet_prefers_both_phrases():
    words = ["w%d" % i for i in range(40)]
    words[5], words[30], words[33] = "alpha", "alpha", "beta"
    shown = snippet(" ".join(words), [(5, 0, 1), (30, 0, 1), (33, 1, 1)])
    assert "[beta]" in shown and "[alpha]" in shown and shown.startswith("...")


def test_previews():
    assert preview("One line.\nTwo.", 0, 14) == "One line. Two."
    assert preview("alpha beta gamma delta", 2, 13) == "…beta…"
    assert len(preview("word " * 100, 0, 500)) <= 201


def test_paths_below_a_folder(spark):
    rows = spark.createDataFrame([("/a/b/c.epub", "/a"), ("/a/c.epub", "/a/"), ("c:\\x\\y.pdf", "c:\\x"), ("/other/z.pdf", "/a")], "p string, f string")
    assert [r[0] for r in rows.select(T.relative_path(F.col("p"), F.col("f"))).collect()] == ["b/c.epub", "c.epub", "y.pdf", "/other/z.pdf"]


def test_composed_letters_are_alike(spark):
    rows = spark.createDataFrame([("Cafe\u0301",), ("Café",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.composed(F.col("t"))).collect()] == ["Café", "Café", None]
