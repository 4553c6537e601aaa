import hashlib
import random
import struct

import pytest

P = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from lexforge.llm import sentencepiece_codec as sc  # noqa: E402
from lexforge.llm import token_counts as tc  # noqa: E402

TEXTS = ["", " ", "  Hello  world\n\t ▁x", "a" * 5000, "é😀ß <s> </s>", "don't we'll I'm 'S", "x" + " " * 70 + "y", "\n\n", "日本語テキスト", "<|endoftext|> a <|startoftext|>b<|endoftext|>", "ΣΑΣ σς İ K Å", "1234 5.6", "a b c​d", "٣٤ ½ Ⅷ"]


def fuzz(n, seed=3):
    rnd = random.Random(seed)
    letters = list("abcdeioustnr   '.,\n\t▁éßñ0129ÀΣİ中文😀́ <|>")
    return ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def piece():
    path = P.path("piece_bpe_32k.model")
    return sc.Codec(open(path, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=path)


@pytest.fixture(scope="module")
def counter():
    path = P.path("word_bpe_49k.json")
    return tc.Counter(open(path, "rb").read()), Tokenizer.from_file(path)


def ids(codec, text):
    return [i for b in codec.encode(text) for i in struct.unpack(f"<{len(b) // 4}I", b)]


def decoded(codec, numbers):
    import numpy as np

    return "".join(codec.decode(iter([np.array(numbers, np.int64)])))


def test_encoding_is_the_librarys(piece):
    codec, lib = piece
    for t in TEXTS + fuzz(1500):
        assert ids(codec, t) == lib.encode(t), t
        assert decoded(codec, lib.encode(t)) == lib.decode(lib.encode(t))


def test_any_ids_decode_as_the_librarys(piece):
    codec, lib = piece
    rnd = random.Random(1)
    for _ in range(1500):
        numbers = [rnd.choice([rnd.randrange(1, 32000), rnd.randrange(3, 259)]) for _ in range(rnd.randint(0, 12))]
        assert decoded(codec, numbers) == lib.decode(numbers)


def test_parts_decode_as_the_whole(piece):
    import numpy as np

    codec, lib = piece
    numbers = lib.encode("日本 x 😀😀 ꙮ", add_bos=True)
    for k in range(len(numbers)):
        assert "".join(codec.decode(iter([np.array(numbers[:k], np.int64), np.array(numbers[k:], np.int64)]))) == lib.decode(numbers)


def test_words_come_out_alike_from_both_searches(piece):
    codec, lib = piece
    for word in ("▁unbelievable", "▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁x", "aaaaaaaaaaaaaaaa", "▁thththe"):
        assert codec._short(word) == codec._backtrack(word)


def test_small_tables_change_nothing(piece, monkeypatch):
    codec, lib = piece
    codec.words.limit, codec.marked.limit, codec.fits.limit = 5, 5, 7
    for t in fuzz(300, seed=9):
        assert ids(codec, t) == lib.encode(t)


def test_documents(spark, piece):
    _, lib = piece
    rows = [(1, "a b"), (1, "a b"), (2, None), (None, "x"), (3, ""), (4, "long " * 100_000), (5, "z" * 300_000)]
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = sc.encode_documents(docs, P.path("piece_bpe_32k.model"), with_ids=True).collect()
    want = []
    for i, t in rows:
        n = lib.encode(t or "", add_bos=True, add_eos=True)
        packed = struct.pack(f"<{len(n)}I", *n)
        want.append((i, len(n), hashlib.sha256(packed).hexdigest(), hashlib.sha256(lib.decode(n).encode()).hexdigest(), packed))
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got), key=repr) == sorted(want, key=repr)
    assert sc.encode_documents(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        sc.PieceModel(b"")


def test_counts_are_the_librarys(counter):
    own, lib = counter
    for t in TEXTS + fuzz(1500, seed=4):
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids), t


def test_chunk_maps_compose(counter, monkeypatch):
    own, lib = counter
    texts = [t for t in TEXTS + fuzz(200, seed=5)]
    want = [own.count(t) for t in texts]
    for size, warm in ((1, 1), (1, 64), (3, 2), (7, 64)):
        monkeypatch.setattr(tc, "CHUNK", size)
        monkeypatch.setattr(tc, "WARM", warm)
        assert [own.count(t) for t in texts] == want
    word = "unbelievablyinternationalisationalism" * 40
    for size, warm in ((1, 1), (5, 3), (64, 64), (1000, 8)):
        monkeypatch.setattr(tc, "CHUNK", size)
        monkeypatch.setattr(tc, "WARM", warm)
        maps = list(own.chunks(["stop", word, "it"]))
        assert len(maps) >= len(word) // size
        in_order, n = tc.FIRST, 0
        for m in maps:
            in_order, more = m.of(in_order)
            n += more
        a, b, c = maps[: len(maps) // 3] or maps[:1], maps[len(maps) // 3 : -1], maps[-1:]
        left, right = (tc.Composed(tc.Composed(own.scan(a), own.scan(b)), own.scan(c)), tc.Composed(own.scan(a), tc.Composed(own.scan(b), own.scan(c)))) if len(maps) > 2 else (own.scan(maps),) * 2
        assert left.of(tc.FIRST) == right.of(tc.FIRST) == own.scan(maps).of(tc.FIRST) == (tc.FIRST, n)
        assert n == own.transducer.run(own.symbols("stop")) + own.transducer.run(own.symbols(word)) + own.transducer.run(own.symbols("it"))


def test_a_long_run_without_spaces(counter):
    own, lib = counter
    rnd = random.Random(3)
    text = "".join(rnd.choice(["token", "iser", "über", "z", "ing", "qx", "the"]) for _ in range(150_000))
    assert own.count(text) == len(lib.encode(text, add_special_tokens=False).ids)
    # The states that chunks were made for are those that arrive: no chunk inside the word is run twice.
    maps = list(own.chunks([own.normal(text)]))
    assert len(maps) > 5 and own.scan(maps).of(tc.FIRST)[0] == tc.FIRST and max(len(m.table) for m in maps) <= 2


def test_transitions_add_up(counter):
    own, _ = counter
    t = own.transducer
    merged = t.run("unbelievabl" + chr(ord("e") + 256))
    state, total = 0, 0
    for s in "unbelievabl" + chr(ord("e") + 256):
        state, add = t.moves[state][s]
        total += add
    assert total == merged and any(add <= 0 for m in t.moves for _, add in m.values())


def test_a_small_table_of_states_changes_nothing(counter, monkeypatch):
    own, lib = counter
    monkeypatch.setattr(tc, "KEPT_STATES", 20)
    own.words.clear(), own.words.old.clear()
    for t in fuzz(200, seed=6):
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids)


def test_common_letters_have_the_librarys_case_and_class(counter):
    own, lib = counter
    for code in [*range(0x21, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        t = f"a{chr(code)}b"
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids), hex(code)


def test_counted_documents(spark, counter):
    _, lib = counter
    rows = [(1, "a b"), (1, "a b"), (2, None), (None, "x"), (3, ""), (4, "long " * 3000), (5, "é" * 70_000), (6, "<|endoftext|>")]
    docs = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, over_limit boolean")
    got = tc.count_tokens(docs, P.path("word_bpe_49k.json"), limit=2048).collect()
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tc.count_tokens(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0
