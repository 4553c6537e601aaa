import pytest
from pyspark.sql import functions as F

from lexforge.plans.query import Spellings, bundled, compile_query, fold_spelling, read, written

NONE = Spellings()


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("don't", '"don\'t"'), ("(foo) bar:baz NEAR", '"(foo)" "bar:baz" "NEAR"'), ('"deep learn"*', '"deep learn"*'), ('don"t', '"don""t"'),
        ('a "b" c"', '"a" "b" "c"""'), ("OR a", '"OR" "a"'), ("a OR", '"a"'), ("a or b", '"a" "or" "b"'), ("AND", '"AND"'), ("", None), ('""', None), ("*", None), ("dharm*", '"dharm"*'),
    ],
)
def test_written(query, want):
    assert written(read(query, NONE)) == want


def test_operators_after_operators_are_terms():
    assert written(read("a OR AND b", NONE)) == '"a" OR "AND" "b"'


def test_spellings():
    own = Spellings("dhamma, dharma\n# no\nalone\nkamma, karma # yes")
    assert own.groups == [["dhamma", "dharma"], ["kamma", "karma"]]
    assert written(read("dharma", own)) == '("dhamma" OR "dharma")'
    assert written(read("dharma monks", own)) == '("dhamma" OR "dharma") AND "monks"'
    assert written(read("dharma NOT monks", own)) == '("dhamma" OR "dharma") NOT "monks"'
    assert written(read('"the dharma" dharm*', own)) == '"the dharma" "dharm"*'
    with pytest.raises(ValueError):
        Spellings("a, b\nb, c")


def test_bundled_spellings():
    assert len(bundled().groups) == 27 and bundled().group("Nibbāna") == ["nibbana", "nirvana"]
    assert fold_spelling("ṝṣi") == "rsi" and fold_spelling("saṃsāra") == "samsara"


def test_spellings_file(spark, tmp_path):
    from lexforge.sources.files import parse_spellings

    (tmp_path / "s.txt").write_text("a, b\n# c\n")
    assert parse_spellings(spark, str(tmp_path / "s.txt")) == [["a", "b"]]


def truth(spark, query, counts, spellings=NONE):
    q = compile_query(query, spellings)
    row = spark.range(1).select(q.matches([F.lit(c) for c in counts]).alias("m"), *[c.alias(f"u{i}") for i, c in enumerate(q.contributing([F.lit(c) for c in counts]))]).first()
    return row["m"], [row[f"u{i}"] for i in range(len(counts))]


def test_precedence(spark):
    # x NOT (a b): neighbours first.
    assert truth(spark, "x NOT a b", [1, 1, 0])[0] and not truth(spark, "x NOT a b", [1, 1, 1])[0]
    # (x NOT (dhamma OR dharma)) AND cats: beside a group, AND is looser.
    own = Spellings("dhamma, dharma")
    assert truth(spark, "x NOT dharma cats", [1, 0, 0, 1], own)[0]
    assert not truth(spark, "x NOT dharma cats", [1, 0, 0, 0], own)[0]
    # a OR (b AND c)
    assert truth(spark, "a OR b AND c", [1, 0, 0])[0] and not truth(spark, "a OR b AND c", [0, 1, 0])[0]


def test_what_contributes(spark):
    assert truth(spark, "a OR b c", [1, 1, 0])[1] == [True, False, False]
    assert truth(spark, "a NOT b", [1, 0])[1] == [True, False]


def test_parts_without_tokens():
    assert compile_query("-- a", NONE).root.kind == "phrase"
    assert compile_query("--", NONE).root.kind == "none"
    assert compile_query("self-aware", NONE).phrases[0].terms == ("self", "aware")
    assert len(compile_query("a a", NONE).phrases) == 2
