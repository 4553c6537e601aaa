"""Queries on tables with what the given ones lack: empty texts, empty lines, many marks of one line."""

import datetime
import random

import duckdb
import pytest

from lexforge.plans import catalogue

TEXTS = ["", "hello there this is a line of words\n\nanother one here", "", "x", "\n", "one two three four five six seven\nand more words in this second line", "\n\nabc", None]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, t, f"src{i % 3}") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    r, day = random.Random(1), datetime.datetime(2024, 1, 1)
    kinds = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame([(i, day, i % 5, r.choice(["purchase", "error", "click"]), r.random() * 60, "{}") for i in range(300)], kinds).write.parquet(f"{path}/events.parquet")
    return path


@pytest.fixture(scope="module")
def duck(odd):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    return con


def same(spark, odd, duck, name):
    df = catalogue.QUERIES[name](spark, odd)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=repr)
    assert got and got == sorted(duck.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.SQL[name]})").fetchall(), key=repr)


@pytest.mark.parametrize("name", ["highlight_adds", "highlight_overlaps", "locate_block"])
def test_empty_texts(spark, odd, duck, name):
    same(spark, odd, duck, name)


def test_edited_texts_make_no_fingerprints(spark, odd):
    from lexforge.llm.queries import edited_texts

    assert "xxhash64" in edited_texts.__globals__["op9_fingerprints"](spark, odd)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in edited_texts(spark, odd)._jdf.queryExecution().optimizedPlan().toString()
