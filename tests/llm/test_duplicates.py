import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import common, components, embedding_dedup, ngram_jaccard, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sets_of(texts, n):
    out = {}
    for i, t in texts:
        w = WORD.findall(lower(t or ""))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def brute_components(sets, t):
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common_ = len(sets[a] & sets[b])
            if common_ and common_ >= t * (len(sets[a]) + len(sets[b]) - common_):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def near_texts(seed=1, groups=12):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(groups):
        base = rnd.choices(vocabulary, k=rnd.choice([3, 6, 12, 30, 80, 200, 700]))
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 9)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            out.append((" " if rnd.random() < 0.5 else "\n").join(w).upper() if rnd.random() < 0.2 else " ".join(w))
    return list(enumerate(out + ["", "  \n", "one", "ONE", "one two"]))


def test_words_hash_alike_wherever_they_stand():
    import pyarrow as pa

    data, off = common.text_bytes(pa.array(["ab cd\tab", None, "", "cdab", "  ab"]))
    h, row = common.hash_words(data, off)
    assert row.tolist() == [0, 0, 0, 3, 4] and h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
    assert common.hash_words(*common.text_bytes(pa.array(["AB É", "ab É"])), lower=True)[0].reshape(2, 2).tolist()[0] == common.hash_words(*common.text_bytes(pa.array(["ab É"])))[0].tolist()


def test_long_words_and_blocks(monkeypatch):
    import pyarrow as pa

    t = "x" * 500 + " " + " ".join(f"w{k}" for k in range(300))
    want = common.hash_words(*common.text_bytes(pa.array([t])))[0].tolist()
    monkeypatch.setattr(common, "BLOCK", 64)
    assert common.hash_words(*common.text_bytes(pa.array([t])))[0].tolist() == want


@pytest.mark.parametrize(("n", "t", "seed"), [(4, Fraction(85, 100), 1), (5, Fraction(4, 5), 2)])
def test_jaccard_components(spark, n, t, seed, monkeypatch):
    texts = near_texts(seed)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_POINTS", 4)
    docs = spark.createDataFrame([(i, x, 7) for i, x in texts], "doc_id long, text string, component_id int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs, n, t).collect()}
    sets = sets_of(texts, n)
    want = brute_components(sets, t)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_edges(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, None), (8, ""), (7, "solo"), (6, "solo"), (4, "q " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_jaccard.jaccard_components(docs, 4, Fraction(85, 100)).collect()), key=repr)
    assert got == sorted([(5, 3, 3), (5, 3, 3), (3, 3, 3), (None, 3, None), (9, 0, 9), (8, 0, 8), (7, 1, 6), (6, 1, 6), (4, 1, 4)], key=repr)
    assert ngram_jaccard.jaccard_components(docs.limit(0)).count() == 0
    kept = ngram_jaccard.drop_near_duplicates(docs, 4, Fraction(85, 100))
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([3, None, 9, 8, 6, 4], key=repr) and kept.columns == docs.columns


@pytest.mark.parametrize("inner", [True, False])
def test_links_of_a_block_are_those_of_a_scan(inner):
    rnd = np.random.default_rng(4)
    t = Fraction(4, 5)
    for _ in range(20):
        base = [rnd.integers(1, 1 << 62, 60, dtype=np.uint64) for _ in range(6)]
        sets = []
        for _ in range(40):
            s = base[rnd.integers(6)].copy()
            s[: rnd.integers(0, 12)] = rnd.integers(1, 1 << 62, 1, dtype=np.uint64)
            sets.append(np.unique(s))
        labels, side = rnd.integers(0, 25, 40), rnd.integers(0, 2, 40)
        links = ngram_jaccard.block_links(np.arange(40), labels, sets, side, inner, t)
        assert all(ngram_jaccard.reaches(sets[a], sets[b], t) for a, b in links)

        def roots(edges, labels=labels):
            up = labels.copy()
            for a, b in edges:
                up[up == up[a]] = up[b]
            return up

        may = [(a, b) for a in range(40) for b in range(a) if (side[a] != side[b] or inner and side[a] == 1) and ngram_jaccard.reaches(sets[a], sets[b], t)]
        x, y = roots(links), roots(may)
        sizes = np.array([len(s) for s in sets])
        points = np.array([np.bincount(s % ngram_jaccard.GROUPS, minlength=ngram_jaccard.GROUPS) for s in sets]).astype(np.uint16)
        some, pairs = ngram_jaccard.block_partners(labels, sizes, points, side, inner, t)
        assert pairs is None or {tuple(sorted(x)) for x in pairs} >= {tuple(sorted(x)) for x in may if labels[x[0]] != labels[x[1]]}
        assert all(some[a] and some[b] for a, b in may if labels[a] != labels[b])
        assert all((x[a] == x[b]) == (y[a] == y[b]) for a in range(40) for b in range(40))


def test_tree_finds_what_a_scan_finds():
    rnd = np.random.default_rng(3)
    points = rnd.poisson(3, (700, ngram_jaccard.GROUPS)).astype(np.uint16)
    sizes = points.sum(1).astype(np.int64)
    tree = ngram_jaccard.RTree(points, sizes)
    t = Fraction(7, 10)
    for k in range(0, 700, 50):
        want = {i for i in range(700) if (c := min(np.minimum(points[i], points[k]).sum(), sizes[i], sizes[k])) * 17 >= 7 * (max(sizes[i], c) + sizes[k])}
        got = set(tree.order[tree.search(points[k], int(sizes[k]), t, np.ones(700, bool))].tolist())
        assert got == want and k in got


def kept_signatures(sets, t, rank):
    """What each set keeps when it leaves out as many of each class as it may, by the order of ``rank``."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sig, at, of, cls, spare = ngram_jaccard.signatures(np.concatenate([np.sort(s) for s in sets]), row, len(sets), t)
    out = []
    for k in range(len(sets)):
        mine, own = sig[at == k], set()
        for c, n in zip(cls[of == k], spare[of == k], strict=True):
            of_class = sorted((x for x in mine.tolist() if x & ngram_jaccard.CLASS_BITS == c), key=lambda x: (rank(x), x))
            own |= set(of_class[: len(of_class) - n])
        out.append(own)
    return out


@pytest.mark.parametrize("t", [Fraction(85, 100), Fraction(4, 5), Fraction(2, 3), Fraction(1, 2), Fraction(3, 10)])
def test_linked_sets_share_a_signature_that_both_keep(t):
    rnd = np.random.default_rng(5)
    for size in (1, 2, 4, 5, 6, 9, 10, 15, 20, 40, 60, 100, 333, 1000):
        for _ in range(6):
            base = rnd.integers(1, 1 << 62, size, dtype=np.uint64)
            left = rnd.integers(-(-size * t.numerator // t.denominator), size + 1)
            other = base[:left]
            if rnd.random() < 0.5:  # as many new ones as the threshold allows
                more = int(left / t) - size
                other = np.concatenate([other, rnd.integers(1, 1 << 62, max(0, more), dtype=np.uint64)])
            assert left * t.denominator >= t.numerator * (size + len(other) - left)
            x, y = kept_signatures([base, other], t, rank=lambda v: hash((v, 7)))
            assert x & y, (size, left, len(other))


def test_unrelated_sets_share_no_signature():
    rnd = np.random.default_rng(7)
    for t, size in ((Fraction(4, 5), 400), (Fraction(4, 5), 1000), (Fraction(85, 100), 1602), (Fraction(1, 2), 400)):
        sig, at, *_ = ngram_jaccard.signatures(rnd.integers(1, 1 << 62, 2000 * size, dtype=np.uint64), np.repeat(np.arange(2000), size), 2000, t)
        assert len(np.unique(sig)) == len(sig) and len(sig) < 2.0 * 2000 * size


def test_unrelated_documents_are_in_no_neighbourhood(spark):
    rnd = np.random.default_rng(8)
    texts = [" ".join(map(str, rnd.integers(0, 2_000, 400))) for _ in range(5000)]
    docs = spark.createDataFrame([(k, b"", t) for k, t in enumerate(texts)], "key long, same binary, text string")
    sets = common.durable(ngram_jaccard.shingle_sets(docs, 5, Fraction(4, 5)), "sets")
    assert ngram_jaccard.neighbourhoods(sets).count() == 0


@pytest.mark.parametrize(("frequent", "block", "few"), [(2, 2, 4), (64, 2048, 0), (64, 2048, 4)])
def test_jaccard_at_a_low_threshold(spark, frequent, block, few, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "PAIRS_PER_SET", few)
    monkeypatch.setattr(ngram_jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_POINTS", block)
    rnd = random.Random(11)
    texts = []
    for _ in range(8):  # groups of all degrees of likeness
        base = [f"v{rnd.randrange(10**6)}" for _ in range(rnd.choice([12, 40, 90]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.randint(0, len(w) // 8)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(w[: rnd.randint(len(w) // 2, len(w))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(docs, 3, Fraction(1, 2)).collect()}
    assert got == brute_components(sets_of(enumerate(texts), 3), Fraction(1, 2))


def test_many_near_copies_with_frequent_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "FREQUENT", 1000)
    monkeypatch.setattr(ngram_jaccard, "HOT", 20)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_POINTS", 16)
    rnd = random.Random(12)
    line = [f"l{k}" for k in range(60)]
    texts = []
    for size in (120, 70):  # own words beside a line that all share
        base = [f"{size}b{k}" for k in range(size)]
        for _ in range(60):
            w = list(base)
            for _ in range(rnd.randint(0, size // 12)):
                w[rnd.randrange(size)] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(line + w))
    texts += [" ".join(line + [f"y{rnd.randrange(10**6)}" for _ in range(30)]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(docs, 5, Fraction(4, 5)).collect()}
    assert got == brute_components(sets_of(enumerate(texts), 5), Fraction(4, 5))


@pytest.mark.parametrize(("together", "pack"), [(1, 200), (5, 1 << 21), (64, 200)])
def test_packed_signatures_meet_as_they_would_in_a_table(spark, together, pack, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "TOGETHER", together)
    monkeypatch.setattr(ngram_jaccard, "PACK", pack)
    monkeypatch.setattr(ngram_jaccard, "FREQUENT", 1000)
    rnd = random.Random(13)
    base = [f"b{k}" for k in range(80)]
    texts = [" ".join(base[: rnd.randint(70, 80)] + [f"z{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 9))]) for _ in range(30)]
    texts += [" ".join(f"y{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(10)]
    keys = [(-1) ** k * (k << 40) for k in range(len(texts))]
    docs = spark.createDataFrame(list(zip(keys, [b""] * len(texts), texts, strict=True)), "key long, same binary, text string").repartition(3)
    sets = common.durable(ngram_jaccard.shingle_sets(docs, 5, Fraction(4, 5)), "sets")
    size = ngram_jaccard.NAME_BITS // 8
    assert sets.where(f"length(parts) <> {size} * n_parts or n_parts <> aggregate(widths, 0L, (x, y) -> x + y)").isEmpty()
    none = np.array([1 << ngram_jaccard.NAME_BITS], np.uint64), np.zeros(1, np.int64)
    of = {}
    for b in sets.select("key", "parts", "widths", "spare").toArrow().combine_chunks().to_batches():
        for name, key in zip(*(x.tolist() for x in ngram_jaccard.kept_signatures(b, *none)), strict=True):
            of.setdefault(name, set()).add(key)
    met = {}
    for r in ngram_jaccard.meeting(sets, {}).collect():
        met.setdefault(r["sig"], set()).add(r["rep"])
    assert {k: v for k, v in met.items() if len(v) > 1} == {k: v for k, v in of.items() if len(v) > 1}
    want = {(min(v), x) for v in of.values() for x in v if x != min(v)}
    assert {tuple(r) for r in ngram_jaccard.neighbourhoods(sets).collect()} == want and len(want) > 20


def test_unlike_neighbours_of_a_hub_move_no_text(spark, monkeypatch):
    verified, verify = [], ngram_jaccard.verify
    monkeypatch.setattr(ngram_jaccard, "verify", lambda pairs, *x: verified.extend(map(tuple, pairs.collect())) or verify(pairs, *x))
    monkeypatch.setattr(ngram_jaccard, "FREQUENT", 1000)
    rnd = random.Random(14)
    line = [f"l{k}" for k in range(200)]  # what all share, so that they meet; half of each text
    texts = [" ".join(line + [f"y{rnd.randrange(10**6)}" for _ in range(200)]) for _ in range(12)]
    texts.append(texts[5] + " end")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(docs, 5, Fraction(4, 5)).collect()}
    assert got == {k: min(k, 5 if k == 12 else k) for k in range(13)}
    assert set(verified) == {(5, 12)}


def test_jaccard_of_string_keys(spark):
    a = " ".join(f"a{k}" for k in range(60))
    docs = spark.createDataFrame([("x", a), ("b", a + " end"), (None, a), ("c", "other words altogether here")], "doc_id string, text string")
    got = sorted((tuple(r) for r in ngram_jaccard.jaccard_components(docs, 4, Fraction(85, 100)).collect()), key=repr)
    assert got == sorted([("x", 57, "b"), ("b", 58, "b"), (None, 57, None), ("c", 1, "c")], key=repr)
    assert {r["doc_id"] for r in ngram_jaccard.drop_near_duplicates(docs, 4, Fraction(85, 100)).collect()} == {"b", None, "c"}


def test_rows_that_repeat_a_key_keep_their_own_links(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (5, a + " end"), (6, b + " end"), (7, a + " more"), (8, "alone here"), (8, None), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_jaccard.jaccard_components(docs, 4, Fraction(85, 100)).collect()), key=repr)
    assert got == sorted([(1, 57, 1), (1, 57, 1), (5, 58, 1), (6, 58, 1), (7, 58, 1), (8, 1, 8), (8, 0, 8), (None, 57, None)], key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 99), (99, 98), (200, 200)] + [(500, 500 + k) for k in range(1, 80)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict.fromkeys(range(1, 61), 0) | {100: 98, 99: 98} | dict.fromkeys(range(501, 580), 500)
    assert got == want


# --- suffixes


def brute_repeats(texts, least):
    words = {i: WORD.findall(t or "") for i, t in texts}
    first, count = {}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - least + 1):
            g = tuple(words[i][k : k + least])
            count[g] = count.get(g, 0) + 1
            first.setdefault(g, (i, k))
    repeat, removed = {}, {}
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            g = tuple(w[k : k + least])
            if count[g] > 1:
                repeat.setdefault(i, set()).update(range(k, k + least))
                if first[g] != (i, k):
                    removed.setdefault(i, set()).update(range(k, k + least))
    return repeat, removed


def passages(seed=2):
    rnd = random.Random(seed)
    fresh = lambda n: [f"{rnd.randrange(10**9)}" for _ in range(n)]
    shared = [fresh(60), fresh(51), fresh(200)]
    out = []
    for k in range(40):
        w = fresh(rnd.randint(5, 120))
        if k % 3 == 0:
            p = shared[rnd.randrange(3)]
            w[rnd.randint(0, len(w)) : 0] = p
        if k % 7 == 0:
            w += shared[2][:49]  # too short to count
        out.append(" ".join(w))
    return list(enumerate(out + [out[0], "", "a b"]))


@pytest.mark.parametrize("parts", [1, 4])
def test_repeated_passages(spark, parts, monkeypatch):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts * 4))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 1).lower())
    texts = passages()
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, start int")
    rows = suffix_dedup.repeated_passages(docs).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    cover = lambda spans: {x for s in spans for x in range(s["start"], s["stop"])}
    repeat, removed = brute_repeats(texts, 50)
    assert {r["doc_id"]: cover(r["repeats"]) for r in rows} == repeat
    assert {r["doc_id"]: cover(r["removed"]) for r in rows if r["removed"]} == removed


def hidden_passages(seed):
    """Passages whose copies stand among many others that share a shorter run of them, at either side or in the middle."""
    rnd = random.Random(seed)
    fresh = lambda n: [f"{rnd.randrange(10**9)}" for _ in range(n)]
    line, out = fresh(45), []
    for _ in range(6):
        a, b = fresh(15), fresh(15)
        out += [fresh(20) + a + line + fresh(20) for _ in range(2)] + [fresh(20) + line + b + fresh(20) for _ in range(2)]
        out += [fresh(9) + a[9:] + line[:44] + fresh(9), fresh(9) + a[9:] + line + b[:3], a + line + b, fresh(3) + a + line + b + fresh(3)]
    out += [fresh(20) + line + fresh(20) for _ in range(150)]
    rnd.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("parts", [1, 4])
def test_repeats_hidden_by_others(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts * 4))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 1).lower())
    texts = hidden_passages(parts)
    rows = suffix_dedup.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    cover = lambda spans: {x for s in spans for x in range(s["start"], s["stop"])}
    repeat, removed = brute_repeats(texts, 50)
    assert {r["doc_id"]: cover(r["repeats"]) for r in rows} == repeat
    assert {r["doc_id"]: cover(r["removed"]) for r in rows if r["removed"]} == removed


def test_minimisers_cover_each_window():
    rnd = np.random.default_rng(1)
    words = common.mix64(rnd.integers(0, 50, 3000).astype(np.uint64))
    w = suffix_dedup.window_of(50)
    _, at = suffix_dedup.minimisers(words, np.zeros(3000, np.int64), w)
    assert all(((at >= s) & (at < s + w)).any() for s in range(3000 - 49))
    shifted, at2 = suffix_dedup.minimisers(words[100:], np.zeros(2900, np.int64), w)
    assert set((at2 + 100).tolist()) >= {a for a in at.tolist() if 100 + w <= a}


def test_dropped_repeats(spark):
    p = " ".join(f"p{k}" for k in range(55))
    rows = [(1, f"start {p} end", 1), (2, f"other\n{p}\ttail here", 2), (3, p, 3), (4, None, 4), (None, p, 5), (5, "short", 6), (6, f"{p} and {p}", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["n_chars"] if r["doc_id"] is None else r["doc_id"]: r["text"] for r in suffix_dedup.drop_repeats(docs).collect()}
    assert got == {1: f"start {p} end", 2: "other\ttail here", 3: "", 4: None, 5: "short", 6: "and"} | {5: got[5]} and len(got) >= 6
    assert suffix_dedup.drop_repeats(docs).where("doc_id is null").first()["text"] == p
    assert suffix_dedup.repeated_passages(docs.limit(0)).count() == 0
    assert suffix_dedup.drop_repeats(docs).where("doc_id = 2").first()["n_chars"] == len("other\ttail here")


def test_rows_of_one_key_have_their_own_repeats(spark):
    a, five = " ".join(f"a{k}" for k in range(3000)), "one two three four five"
    for rows in ([(1, five), (1, a), (2, a)], [(1, a), (1, five), (2, a)], [(2, a), (1, five), (1, a)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((r["doc_id"], r["n_repeated"], r["n_removed"]) for r in suffix_dedup.repeated_passages(docs).collect())
        assert got == [(1, 3000, 0), (2, 3000, 3000)]
        assert sorted((r["doc_id"], r["text"]) for r in suffix_dedup.drop_repeats(docs).collect()) == sorted([(1, a), (1, five), (2, "")])
    # Rows of one key and text are one document; keys may be strings, and columns may have any names.
    docs = spark.createDataFrame([("y", a, 1), ("y", a, 2), ("x", "own " + a, 3), (None, a, 4)], "doc string, text string, cut int").withColumnRenamed("cut", "__cut")
    got = sorted((r["doc"], r["n_repeated"], r["n_removed"]) for r in suffix_dedup.repeated_passages(docs, key="doc").collect())
    assert got == [("x", 3000, 0), ("y", 3000, 3000)]
    left = suffix_dedup.drop_repeats(docs, key="doc")
    assert left.columns == docs.columns and sorted((str(r["doc"]), r["text"], r["__cut"]) for r in left.collect()) == [("None", a, 4), ("x", "own " + a, 3), ("y", "", 1), ("y", "", 2)]


def test_only_what_a_copy_has_goes(spark):
    # Spans that the sorted suffixes claim are held against the words of both places.
    a = [f"a{k}" for k in range(80)]
    b = [*a[:60], "other", *a[61:]]
    rows = spark.createDataFrame([(1, " ".join(a)), (2, "\n".join(b)), (3, "\t ".join(a))], "doc long, text string")
    claims = [(suffix_dedup.REMOVE, 2, 0, 60, 1, 0), (suffix_dedup.REMOVE, 2, 5, 70, 1, 5), (suffix_dedup.REMOVE, 3, 10, 80, 1, 10), (suffix_dedup.REMOVE, 3, 0, 60, 1, 1)]
    claims = spark.createDataFrame(claims, "kind int, doc long, start int, stop int, copy long, copy_start int")
    got = sorted(tuple(r) for r in suffix_dedup.confirmed(claims, rows).collect())
    assert got == [(suffix_dedup.REMOVE, 2, 0, 60, 1, 0), (suffix_dedup.REMOVE, 3, 10, 80, 1, 10)]


def test_covers_hold_all_words_in_few_spans(spark):
    rnd = random.Random(3)
    rows = [(suffix_dedup.REMOVE, d, s, s + rnd.randint(1, 60), 0, 0) for d in range(20) for s in [rnd.randint(0, 400) for _ in range(60)]]
    frame = spark.createDataFrame(rows, "kind int, doc long, start int, stop int, copy long, copy_start int")
    words = lambda got: {(r[1], w) for r in got for w in range(r[2], r[3])}
    kept = [tuple(r) for r in suffix_dedup.covers(frame).collect()]
    assert words(kept) == words(rows) and set(kept) <= set(rows) and len(kept) < len(rows) / 2


def test_repeats_inside_a_document(spark):
    line = " ".join(f"l{k}" for k in range(10))
    docs = spark.createDataFrame([(1, "\n".join([line] * 20)), (1, "\n".join([line] * 20)), (2, "w " * 5000)], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in suffix_dedup.drop_repeats(docs, length=None).collect()}
    assert left[1].startswith(line) and len(left[1]) < 7 * len(line) and 0 < len(left[2]) < 400


# --- vectors


def test_vectors(spark, monkeypatch):
    rnd = np.random.default_rng(7)
    base = rnd.standard_normal((30, 16))
    x = np.concatenate([base, base[:10] + 0.05 * rnd.standard_normal((10, 16)), base[:5] * 3, np.repeat(base[:1], 20, 0) + 0.08 * rnd.standard_normal((20, 16)), base[3:4], base[3:4]]).astype(np.float32)
    monkeypatch.setattr(embedding_dedup, "BLOCK_POINTS", 6)
    monkeypatch.setattr(embedding_dedup, "MISS", 1e-9)
    monkeypatch.setattr(embedding_dedup, "plan", lambda n, t: (6, 60))
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    odd = [(100, None, 1), (101, [], 1), (102, [0.0] * 16, 1), (103, [float("nan")] * 16, 1), (104, [None] + [1.0] * 15, 1), (105, [1.0] * 15, 1), (None, rows[0][1], 1), (0, rows[0][1], 1)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, kept int")
    got = embedding_dedup.near_duplicates(vectors, 0.95).collect()
    full = np.concatenate([x, x[:1]]).astype(np.float64)
    names = [*range(len(x)), 0]
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    up = {i: i for i in names}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in zip(*np.nonzero(near), strict=True):
        p, q = root(names[a]), root(names[b])
        up[max(p, q)] = min(p, q)
    want = [(names[k], int(near[k].sum()), root(names[k]), names[k] == root(names[k])) for k in range(len(names))]
    want += [(i, 0, i, True) for i in range(100, 106)] + [(None, 0, None, False)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_plan_finds_pairs_at_the_threshold():
    for n in (10, 10_000, 10**9):
        bits, tables = embedding_dedup.plan(n, 0.95)
        meet = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - meet) ** tables <= embedding_dedup.MISS * 1.01


def test_recall_on_the_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(rows, 0.3).collect()}
    pdf = rows.toPandas()
    x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.3
    np.fill_diagonal(near, False)
    assert sum(got.values()) >= 0.99 * near.sum() and all(got[i] <= n for i, n in zip(pdf["vec_id"], near.sum(1), strict=True))


def test_results_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(near_texts(4), "doc_id long, text string")
    one = ngram_jaccard.jaccard_components(docs.coalesce(1)).orderBy("doc_id").collect()
    assert ngram_jaccard.jaccard_components(docs.repartition(7, F.rand(3))).orderBy("doc_id").collect() == one
