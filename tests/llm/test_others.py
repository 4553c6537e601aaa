import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import common, fingerprints, mixing, sharding, toxicity, warc

# --- shards


def brute_shards(rows, limit):
    h = {i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:14], 16) for i, _ in rows}
    out = {}
    for i, _ in rows:
        for depth in range(57):
            own = [s for j, s in rows if h[j] >> (56 - depth) == h[i] >> (56 - depth)]
            if sum(own) <= limit or depth == 56:
                out[i] = (h[i] >> (56 - depth), depth, sum(own), len(own))
                break
    return out


@pytest.mark.parametrize("step", [2, 12])
def test_shards(spark, step, monkeypatch):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([0, 3, 50, 400])) for i in range(300)] + [(7, 60), (None, 9), (None, 8), (1000, 5000)]
    docs = spark.createDataFrame([(i, "x" * n, 1) for i, n in rows], "doc_id long, text string, shard_depth int")
    old = sharding.directory
    monkeypatch.setattr(sharding, "directory", lambda s, limit: old(s, limit, step))
    got = sharding.assign_shards(docs, limit=2000).collect()
    want = brute_shards(rows, 2000)
    assert len(got) == len(rows) and all((r["shard_prefix"], r["shard_depth"], r["shard_bytes"], r["shard_rows"]) == want[r["doc_id"]] for r in got)
    assert all(r["shard_bytes"] <= 2000 or r["shard_rows"] == 1 for r in got)


def test_shard_edges(spark):
    docs = spark.createDataFrame([(1, "x" * 100), (1, "x" * 100), (2, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_bytes"]): r["shard_bytes"] for r in sharding.assign_shards(docs, limit=50).collect()}
    assert got[1, 100] == 200 and got[2, 0] == 0  # one key cannot be parted
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(100)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "s"), limit=2500)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and back.groupBy("shard_depth", "shard_prefix").agg(F.sum(F.length("text")).alias("n")).where("n > 2500").isEmpty()


# --- mixing


def targets(spark, rows, policy=None):
    sized = spark.createDataFrame(rows, "source string, size long")
    policy = policy or mixing.Policy()
    return {r["source"]: r["target"] for r in mixing.with_targets(mixing.numbered_sources(sized, policy), policy).collect()}


def test_targets_share_the_excess(spark):
    rows = [("a", 100), ("b", 100), ("c", 1000), (None, 10)]
    got = targets(spark, rows)
    assert sum(got.values()) == pytest.approx(1.5 * 1210) and got["a"] == 200 and all(got[s] <= 2 * n + 1e-9 for s, n in rows)
    assert targets(spark, [("a", 0)]) == {"a": 0.0} and targets(spark, []) == {}
    # Code points, null last: weights 5, 2, 1, 5.
    even = targets(spark, [("b", 1000), (None, 1000), ("a", 1000), ("Z", 1000)], mixing.Policy(share=0.13))
    assert [round(even[s] / 40) for s in ("Z", "a", "b", None)] == [5, 2, 1, 5]
    assert sorted(targets(spark, [("a", 10), ("b", 20)], mixing.Policy(share=2.0)).values()) == [20.0, 40.0]


def plain_mix(rows, policy):
    """Targets and rates by hand: shares until none is above, and a bisection for each source's multiplier."""
    size = {}
    for _, n, s in rows:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: policy.weights[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, policy.share * sum(size.values()), set(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        above = {s for s in free if unit * weight[s] > policy.cap * size[s]}
        if not above:
            target |= {s: unit * weight[s] for s in free}
            break
        target |= {s: float(policy.cap * size[s]) for s in above}
        left -= sum(policy.cap * size[s] for s in above)
        free -= above
    rates = {}
    for s in order:
        own = np.array([n for _, n, t in rows if t == s], float)
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            given = (own * np.minimum(policy.cap, np.exp(np.minimum(700, mid * own)))).sum()
            low, high = (mid, high) if given < target[s] else (low, mid)
        rates[s] = lambda n, t=low: min(policy.cap, math.exp(min(700, t * n))) if n else 1.0
    return target, rates


def test_mix_by_hand(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([0, 1, 3, 7, 20, 90, 400]), rnd.choice(["s1", "s2", "t", None, "é", "z"])) for i in range(1500)]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], "doc_id long, text string, source string")
    target, rates = plain_mix(rows, mixing.Policy())
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    for i, n, s in rows:
        assert got[i]["target"] == pytest.approx(target[s], rel=1e-9) and got[i]["rate"] == pytest.approx(rates[s](n), rel=1e-4)
    for s in target:
        assert abs(sum(got[i]["taken"] for i, _, t in rows if t == s) - target[s]) <= 1


def test_copies_of_a_hot_row_and_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 16)
    rows = [(7, "a b c", "s")] * 500 + [(k, "d e f", "s") for k in range(600)] + [(k, "g " * 40, "t") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(docs).collect()
    assert len(got) == 1150 and all(0 <= r["copies"] <= 2 for r in got)
    for size in (3, 40):
        own = [r for r in got if r["size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= size
        if own[0]["rate"] < 2:  # evenly dealt
            assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1
    out = mixing.apply_mix(docs)
    assert out.count() == sum(r["copies"] for r in got) and out.where("doc_id = 7").count() > 400


def test_mix(spark):
    rnd = random.Random(2)
    rows = [(i, "w " * min(3000, int(rnd.paretovariate(1)) * 5), f"s{i % 5}" if i % 11 else None, 3) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    sizes = {i: len(t.split()) for i, t, _, _ in rows}
    source = {i: s for i, _, s, _ in rows}
    assert all(r["size"] == sizes[r["doc_id"]] and 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] for r in got)
    for s in set(source.values()):
        own = [r for r in got if source[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 20
        x = np.array([(r["size"], r["rate"]) for r in own if r["rate"] < 2 and r["size"]])
        if len(x):  # exponentially tilted: the logarithm of the rate is a multiple of the size
            tilt = np.log(x[:, 1]) / x[:, 0]
            assert np.allclose(tilt, tilt[0], atol=1e-6)
    again = mixing.mix(docs.repartition(5, F.rand(1))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "x y", "b"), (2, "", None), (3, "w " * 50_000, "c"), (3, "w " * 50_000, "c")], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == 6 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("text is null")).agg(F.sum("taken")).first()[0] == 0


def test_applied_mix(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9 + 1), f"s{i % 3}", i) for i in range(300)], "doc_id long, text string, source string, copies long")
    docs = docs.withColumn("__often", F.lit(1)).withColumn("__key", F.lit("x"))
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_words(spark):
    rows = ["a b", " a\t\nb\x0b\x0cc\r ", "", None, "a\u00a0b", "\x1c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    assert [r[0] for r in df.select(mixing.n_words(F.col("t"))).collect()] == [2, 3, 0, 0, 1, 1]


# --- archives


def test_both_versions_of_arc():
    for version in (1, 2):
        records = [("http://a/", "1.2.3.4", "20200102030405", "text/html", b"HTTP/1.0 200 OK\r\nX-Page-Id: 5\r\n\r\nbody\n\nURL x"), ("http://b/", "0.0.0.0", "202001020304", "text/plain", b"")]
        got = list(warc.parse_arc(b"".join(warc.arc_file(version, iter(records)))))
        assert [r.block for r in got] == [records[0][4], b""] and got[0].version == version and got[0].headers["URL"] == "http://a/"
        headers, block = warc.convert(got[0])
        assert headers["WARC-Date"] == "2020-01-02T03:04:05Z" and headers["WARC-Type"] == "response" and headers["WARC-IP-Address"] == "1.2.3.4"
        assert headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"body\n\nURL x").digest()).decode()
        assert warc.convert(got[1])[0]["WARC-Type"] == "resource" and "WARC-IP-Address" not in warc.convert(got[1])[0]
        assert warc.convert(got[0])[0]["WARC-Record-ID"] == headers["WARC-Record-ID"]


@pytest.mark.parametrize("data", [b"http://x 1 2\n", b"filedesc://x 0.0.0.0 19960923142103 text/plain 999\n1 0 x\n", b"filedesc://x 0.0.0.0 19960923142103 text/plain 6\n3 0 x\n", b"no end"])
def test_broken_arc(data):
    with pytest.raises(warc.ArchiveError):
        list(warc.parse_arc(data))


def test_warc_round_trip():
    block = b"HTTP/1.0 200 OK\r\n\r\nWARC/1.0\r\nContent-Length: 9\r\n\r\n\r\n\r\n"
    data = b"".join(warc.warc_bytes({"WARC-Type": "response", "Content-Length": str(len(b))}, b) + b"\r\n\r\n" for b in (block, b"", b"\r\n"))
    assert [r.block for r in warc.parse_warc(data)] == [block, b"", b"\r\n"]
    with pytest.raises(warc.ArchiveError):
        list(warc.parse_warc(data[:-12] + b"x"))


def test_archived_pages(spark, tmp_path):
    rows = [(1, "http://a", "same"), (2, "http://b c\n", "same"), (3, None, "other é"), (4, "x", None), (5, "y", ""), (6, "z", "q" * 200_000), (7, "u", "WARC/1.0\r\n\r\n"), (9, "http://a", "same"), (9, "http://a", "same"), (None, "n", "same")]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, payload_digest string")
    for least in (0, 3):
        got = sorted(map(tuple, warc.archive_pages(pages, least).collect()), key=repr)
        want = []
        for k, u, t in rows:
            body = (t or "").encode()
            same = [(-1 if j is None else j, v) for j, v, s in rows if (s or "") == (t or "")]
            best = max(same)
            revisit = len(body) >= least and len(same) > 1 and best != (-1 if k is None else k, u)
            want.append((k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", best[0] if revisit else None))
        assert got == sorted(want, key=repr)
    assert warc.archive_pages(pages.limit(0)).count() == 0
    path = str(tmp_path / "w")
    warc.to_warc(pages, path)
    kept = warc.read_warc(spark, path).where("record_type = 'response' and page_id = '3'").first()
    assert bytes(kept["payload"]).decode() == "other é"


def test_archives_from_storage(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    http = b"HTTP/1.0 200 OK\r\nContent-Type: x\r\n\r\n"
    wild = http + bytes(range(256)) * 40 + b"\r\n\r\nhttp://x 1.1.1.1 20200101000000 text/html 5\n"
    one = [("http://a/ b", "1.2.3.4", "20200102030405", "text/html", wild), ("http://b/", "0.0.0.0", "202001020304", "image/png", b"\xff\xfe\x00")]
    two = [("http://c/", "9.9.9.9", "20210102030405", "text/html", wild), ("http://d/", "9.9.9.9", "20190102030405", "text/html", wild), ("dns:e", "-", "20190102030405", "text/dns", b"")]
    folder = tmp_path / "arc" / "deep"
    folder.mkdir(parents=True)
    (folder / "plain.arc").write_bytes(b"".join(warc.arc_file(1, iter(one))))
    (folder / "members.arc.gz").write_bytes(b"".join(gzip.compress(x) for x in warc.arc_file(2, iter(two))))
    (folder / "whole.arc.gz").write_bytes(gzip.compress(b"".join(warc.arc_file(2, iter(one[1:])))))
    got = sorted((r["version"], r["url"], r["date"], bytes(r["block"])) for r in warc.read_arc(spark, str(tmp_path / "arc")).collect())
    assert got == sorted([(1, u, d, b) for u, _, d, _, b in one] + [(2, u, d, b) for u, _, d, _, b in two + one[1:]])
    out = str(tmp_path / "warc")
    warc.convert_archives(spark, str(tmp_path / "arc"), out, least=1)
    rows = {(r["target_uri"], r["record_type"]): r for r in warc.read_warc(spark, out).collect()}
    assert set(rows) == {("http://c/", "response"), ("http://a/ b", "revisit"), ("http://d/", "revisit"), ("http://b/", "resource"), ("dns:e", "resource")}
    assert bytes(rows["http://c/", "response"]["payload"]) == wild[len(http) :] and bytes(rows["http://b/", "resource"]["payload"]) == b"\xff\xfe\x00"
    assert all(rows[u, "revisit"]["refers_to_id"] == rows["http://c/", "response"]["record_id"] for u in ("http://a/ b", "http://d/"))
    # A gzip member for each record, which can be read alone, and files of bounded size.
    for file in (tmp_path / "warc").glob("part-*"):
        data, at, records = file.read_bytes(), 0, 0
        while at < len(data):
            unpack = warc.zlib.decompressobj(31)
            alone = unpack.decompress(data[at:])
            records += len(list(warc.parse_warc(alone)))
            assert not alone or alone.startswith(b"WARC/1.0") and len(list(warc.parse_warc(alone))) == 1
            at = len(data) - len(unpack.unused_data)
        assert records and (records == 1 or len(data) <= 3000 + len(warc.EMPTY_MEMBER))


# --- fingerprints


def jaccard(a, b, n=fingerprints.SHINGLE):
    s = [{tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for w in (a.split(), b.split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_fingerprints(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i * 3, " ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([1, 4, 5, 30, 200, 900])))) for i in range(60)] + [(1000, rnd_text := "é😀 " * 50), (999, rnd_text), (998, "")]
    docs = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, fingerprint string")
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 6000)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    error = []
    for k, (i, t) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + other[:m]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        error.append(got[i]["near_edited"] - jaccard(t, edited))
        error.append(got[i]["near_next"] - jaccard(t, other))
        assert len(got[i]["fingerprint"]) == fingerprints.BINS * fingerprints.BITS // 4
    assert np.sqrt(np.mean(np.square(error))) < 0.04 and abs(np.mean(error)) < 0.02
    assert got[1000]["fingerprint"] == got[999]["fingerprint"] and got[1000]["near_next"] == 1.0


def test_fingerprints_do_not_depend_on_ranges(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c d e {i % 4} f g") for i in range(50)] + [(7, "x"), (7, "x"), (None, "y"), (None, None)], "doc_id long, text string")
    want = sorted(map(tuple, fingerprints.fingerprints(docs).collect()), key=repr)
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 200)
    assert sorted(map(tuple, fingerprints.fingerprints(docs.repartition(5)).collect()), key=repr) == want and len(want) == 54
    one = fingerprints.fingerprints(docs.where("doc_id = 3")).first()
    assert one["near_next"] == 1.0
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = fingerprints.fingerprints(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_ranges_of_keys(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 1000)
    rows = [(k, f"{k % 7}", 100) for k in range(60)] + [(70, "huge", 5000), (None, "a", 900), (None, "b", 900), (80, "t", 700), (80, "u", 700), (80, "u", 700)]
    ids = spark.createDataFrame(rows, "key long, tie string, bytes long").repartition(3)
    table, repeated = fingerprints.key_ranges(ids)
    assert [tuple(r) for r in repeated.collect()] == [(80, "u", 2)]
    got = sorted((r["part"], -1 if r["key"] is None else r["key"], r["tie"], r["bytes"], r["top"], r["n"]) for r in fingerprints.in_ranges(ids, table).collect())
    assert [x[1:3] for x in got] == sorted(x[1:3] for x in got)
    parts = sorted({x[0] for x in got})
    assert parts == list(range(got[0][5])) and len(parts) > 6
    for p in parts:
        own = [x for x in got if x[0] == p]
        assert [x[4] for x in own if x[1:3] == own[-1][1:3]] == [True] * sum(x[1:3] == own[-1][1:3] for x in own) and not any(x[4] for x in own if x[1:3] != own[-1][1:3])
        assert sum(x[3] for x in own) <= 1000 + max(x[3] for x in own)
    # Rows without a key, and rows of one key, are parted too.
    assert len({x[0] for x in got if x[1] == -1}) == 2 and len({x[0] for x in got if x[1] == 80}) == 2


def plain_fingerprint(spark, text):
    """The bits of a fingerprint, word by word and bin by bin; hashes of words and of runs come from the engine."""
    w = [x for x in re.split("[ \t\n\x0b\x0c\r]", text) if x]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    hashes = [r[0] for r in frame([(k, x) for k, x in enumerate(w)], "k int, w string").orderBy("k").select(F.xxhash64("w")).collect()] if w else []
    n = fingerprints.SHINGLE
    if len(w) >= n:
        runs = [hashes[k : k + n] for k in range(len(w) - n + 1)]
        values = [r[0] for r in frame([(r,) for r in runs], "r array<long>").select(F.xxhash64(*[F.col("r")[k] for k in range(n)])).collect()]
    else:
        values = [frame([(hashes,)], "r array<long>").select(F.xxhash64("r")).first()[0]]
    low = 64 - 8
    least = {}
    for v in values:  # bins by the top bits; within one, the smallest
        b = (v % (1 << 64)) >> low
        least[b] = min(least.get(b, v), v)
    order = sorted(range(256), key=lambda b: b - 256 if b >= 128 else b)  # of signed numbers
    bins = [least.get(b) for b in order]
    tries = {(r["j"], r["a"]): r["h"] % 256 for r in spark.range(256).crossJoin(spark.range(fingerprints.TRIES).withColumnRenamed("id", "a")).select(F.col("id").cast("int").alias("j"), F.col("a").cast("int").alias("a")).withColumn("h", F.xxhash64("j", "a")).collect()}
    out = []
    for j, x in enumerate(bins):
        if x is None:
            x = next((bins[tries[j, a]] for a in range(fingerprints.TRIES) if bins[tries[j, a]] is not None), None)
        if x is None:
            far = frame([(j, q, -1) for q in range(256) if bins[q] is not None], "j int, q int, a int").withColumn("o", F.xxhash64("j", "q", "a")).orderBy("o").first()
            x = bins[far["q"]]
        out.append(x % 256)
    return "".join("".join(f"{v:02x}" for v in out[k : k + 8][::-1]) for k in range(0, 256, 8))


def test_bits_of_a_fingerprint(spark):
    rnd = random.Random(8)
    texts = ["", "one", "a b c d e", " ".join(f"w{rnd.randrange(40)}" for _ in range(60)), "\t".join(f"é{k}" for k in range(1500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs).collect()}
    assert got == {k: plain_fingerprint(spark, t) for k, t in enumerate(texts)}


def test_fingerprints_of_any_keys_and_a_hot_row(spark):
    rows = [("b", "x y z"), ("a", "hot row here"), ("c", "p q r")] + [("a", "hot row here")] * 40
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r["doc_id"], r["edited_sha256"]) for r in fingerprints.fingerprints(docs).collect())
    edit = lambda t, o: hashlib.sha256((t[: len(t) - len(t) // 3] + o[: len(t) // 3]).encode()).hexdigest()
    hot = "hot row here"
    assert got == sorted([("c", edit("p q r", "x y z")), ("b", edit("x y z", hot)), ("a", edit(hot, "p q r"))] + [("a", edit(hot, hot))] * 40)


# --- toxicity


def toxic_rows(n=600, seed=5):
    rnd = random.Random(seed)
    bad = ["grumble", "snarlwort", "hexbile"]
    rows, labels = [], []
    for i in range(n):
        w = [f"word{rnd.randrange(300)}" for _ in range(rnd.randint(3, 150))]
        y = rnd.random() < 0.2
        if y:
            w[rnd.randrange(len(w))] = rnd.choice(bad) + rnd.choice(["", "s", "ing"])
        rows.append((i, " ".join(w)))
        if rnd.random() < 0.7:
            labels.append((i, int(y)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, marks).collect()}
    truth = {i: int(any(b in t for b in ("grumble", "snarlwort", "hexbile"))) for i, t in rows}
    held = [i for i in got if got[i]["held_out"]]
    assert {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0} == set(held)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) >= 0.97
    # Labels of held-out rows are never learnt from.
    flipped = spark.createDataFrame([(i, 1 - y if i in held else y) for i, y in labels], "doc_id long, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, flipped).collect()}
    assert all(again[i] == got[i]["score"] for i in got)
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())


def test_toxicity_edges(spark):
    rows, labels = toxic_rows(200)
    docs = spark.createDataFrame([*rows, (None, "a"), (1, None), (1, ""), (2, "x " * 200_000)], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (5, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, marks).collect()
    assert len(got) == 204 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_documents(docs.limit(0), marks).count() == 0
    assert all(r["predicted"] == 0 for r in toxicity.score_documents(docs, marks.limit(0)).collect())


def test_long_texts_score_alike(monkeypatch):
    s = toxicity.Settings(buckets=1 << 16)
    data = np.frombuffer(("abc defgh " * 3000 + "zz").encode(), np.uint8)
    weight = np.random.default_rng(1).random(1 << 16).astype(np.float32)
    f, row = toxicity.distinct(*toxicity.features(data, np.array([0, len(data)]), s), weight)
    assert toxicity._long(data, weight, s) == pytest.approx(weight[f].astype(float).sum(), rel=1e-5)


def plain_fit(positive, unlabelled, prior, s):
    """The same estimator with dense matrices and slopes by hand, text by text."""
    every = sorted({int(f) for x in [*positive, *unlabelled] for f in x})
    p, u = (np.array([[f in set(x.tolist()) for f in every] for x in rows], float) for rows in (positive, unlabelled))
    kept = (p.sum(0) >= s.least) & (p.mean(0) >= s.ratio * u.mean(0))
    p, u = p[:, kept], u[:, kept]
    w, b = np.zeros(p.shape[1]), math.log(prior / (1 - prior))
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, s.steps + 1):
        gp, gu = (1 / (1 + np.exp(-(x @ w + b))) for x in (p, u))
        negative = np.mean([-math.log(1 - g) for g in gu]) - prior * np.mean([-math.log(1 - g) for g in gp])
        up, un = np.append(p, np.ones((len(p), 1)), 1), np.append(u, np.ones((len(u), 1)), 1)
        as_positive, as_negative_p, as_negative_u = ((gp - 1) @ up / len(p), gp @ up / len(p), gu @ un / len(u))
        slope = prior * as_positive + as_negative_u - prior * as_negative_p if negative >= 0 else prior * as_negative_p - as_negative_u
        slope = slope + np.append(np.full(len(w), s.shrink), 0.0)
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.999 * m2 + 0.001 * slope**2
        move = s.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(0, w - move[:-1]), b - move[-1]
    return [f for f, k in zip(every, kept, strict=True) if k], w, b


def test_the_fit_is_that_of_a_plain_version():
    rnd = np.random.default_rng(2)
    rows = lambda n, odd: [np.unique(np.append(rnd.integers(0, 40, 6), rnd.integers(50, 55, 2) if rnd.random() < odd else [])).astype(np.int64) for _ in range(n)]
    positive, unlabelled = rows(60, 0.95), rows(200, 0.15)
    s = toxicity.Settings(buckets=64, steps=120)
    got, (numbers, w, b) = toxicity.fit_rows(positive, unlabelled, 0.12, s), plain_fit(positive, unlabelled, 0.12, s)
    assert got.numbers.tolist() == numbers and np.allclose(got.weights, w, atol=1e-6) and got.bias == pytest.approx(b, abs=1e-6)
    assert (toxicity.logits(positive, got) >= 0).mean() > 0.85 and (toxicity.logits(unlabelled, got) >= 0).mean() < 0.3


def test_the_prior_needs_no_negatives():
    rnd = np.random.default_rng(3)
    for prior in (0.05, 0.2):
        positive, negative = rnd.normal(3, 1, 3000), rnd.normal(-1, 1, 20_000)
        unlabelled = np.concatenate([rnd.normal(3, 1, int(20_000 * prior / (1 - prior))), negative])
        assert toxicity.prior_of(positive, unlabelled) == pytest.approx(prior, abs=0.02)
    assert toxicity.prior_of(np.array([1.0, 2.0]), np.array([0.0, 1.0])) == toxicity.PRIOR


def test_few_labels_do_not_reject_everything(spark):
    rows, labels = toxic_rows(120, seed=9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (0, 3, 40):
        kept = toxicity.drop_toxic(docs, spark.createDataFrame(labels[:n], "doc_id long, toxic int")).count()
        assert kept >= 80


def test_the_risk_is_kept_from_falling_below_zero():
    s = toxicity.Settings(least=1, ratio=0.0, steps=400, buckets=64)
    m = toxicity.fit_rows([np.array([1])] * 20, [np.array([1])] * 5 + [np.array([2])] * 15, 0.25, s)
    t = m.table()
    assert t[1] > t[2] >= 0 and np.isfinite(m.bias)


# --- the pipeline and its parts


def test_durable_tables(spark):
    df = common.durable(spark.range(5).withColumn("x", F.lit("a")), "t")
    assert df.count() == 5 and df.schema["x"].dataType.simpleString() == "string"
    common.release(df)


def test_pipeline_against_brute_force(spark, sf):
    """Each stage on all that the one before kept, held against a plain version."""
    import corpus_pipeline as cp
    import sentencepiece
    from test_duplicates import WORD, brute_components, brute_repeats, sets_of

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    out, now = [], docs
    for name, stage in cp.STAGES:
        now = common.durable(stage(spark, now, sf), name)
        out.append(now)
        if name != cp.STAGES[-1][0]:
            assert now.columns == docs.columns
    texts = rows(docs)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    texts = {i: t for i, t in texts.items() if scores[i] < 0.5}
    assert rows(out[0]) == texts
    root = brute_components(sets_of(texts.items(), 5), 0.8)
    texts = {i: t for i, t in texts.items() if root[i] == i}
    assert rows(out[1]) == texts
    _, removed = brute_repeats(list(texts.items()), 50)
    cut = rows(out[2])
    assert set(cut) == set(texts)
    for i, t in texts.items():
        words = WORD.findall(t or "")
        assert WORD.findall(cut[i] or "") == [w for k, w in enumerate(words) if k not in removed.get(i, ())]
        assert i in removed or cut[i] == t
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(out[2]).collect()}
    copies = {}
    for r in out[3].collect():
        assert r["text"] == cut[r["doc_id"]]
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert copies == {i: n for i, n in want.items() if n} and max(copies.values()) <= 2
    lib = sentencepiece.SentencePieceProcessor(model_file=str(cp.tokenizer_path("piece_bpe_32k.model")))
    got = {}
    for r in out[4].collect():
        n = lib.encode(cut[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(n) and r["ids_sha256"] == hashlib.sha256(np.array(n, "<u4").tobytes()).hexdigest()
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == copies and cp.run(spark, sf).count() == sum(copies.values())


def test_queries_that_sql_can_say(spark, sf):
    import duckdb

    from lexforge.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        cur = con.execute(sql)
        columns = [d[0] for d in cur.description]
        order = sorted(columns)
        df = queries.queries()[name](spark, sf)
        assert sorted(df.columns) == order
        assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == sorted((tuple(r[columns.index(c)] for c in order) for r in cur.fetchall()), key=repr), name


def test_nothing_else_depends_on_this_folder():
    import pathlib

    root = pathlib.Path(__file__).parents[2]
    for f in [*root.glob("lexforge/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" not in f.parts and f.exists():
            assert "lexforge.llm" not in f.read_text() and "corpus_pipeline" not in f.read_text(), f
