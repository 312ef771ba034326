from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from pastward.llm import bpe as op

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return op.Encoder(op.read_ranks(PATH))


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(encoder, text):
    return [i for run in op.text_ids(op._Memory(encoder), op.Cutter(public_tokenizers.PATTERN), text) for i in run]


def odd_texts(seed, n):
    rnd = random.Random(seed)
    sources = ["abcdeſtion", "aaaab", "éèüßñ", "日本語のテ", "  \n\t\r  \x1c\x85", "0123٣५", "'s't're've'm'll'd", "<|endoftext|>", "🙂👩‍💻é", "€$#_-—…"]
    for _ in range(n):
        yield "".join(rnd.choice(rnd.choice(sources)) * rnd.choice([1, 1, 1, 2, 7]) for _ in range(rnd.randint(0, 60)))


def test_equals_the_library_on_odd_texts(encoder, library):
    for text in odd_texts(1, 3000):
        assert ids(encoder, text) == library.encode_ordinary(text)


def test_equals_the_library_on_every_character(encoder, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(every), 4096):
        for text in ("a".join(every[k : k + 4096]), " ".join(every[k : k + 4096])):
            assert ids(encoder, text) == library.encode_ordinary(text)


def test_long_pieces_and_long_texts(encoder, library, monkeypatch):
    rnd = random.Random(2)
    texts = ["a" * 3000, "ab" * 1500, "".join(rnd.choice("etaoin") for _ in range(5000)), "the cat sat. " * 20000]
    for text in texts:
        assert ids(encoder, text) == library.encode_ordinary(text)
    monkeypatch.setattr(op, "AT_ONCE", 50)
    assert ids(encoder, texts[3][:5000]) == library.encode_ordinary(texts[3][:5000])


def test_pairs_are_valid_as_merging_says(encoder):
    rnd = random.Random(7)
    words = ["the", "ation", "ing", "aaaa", "ent", "éé", "日本", "000", "----", "ss", "er", " of"]
    tokens = [t for w in words for k in range(200) for t in encoder.merged(("".join(rnd.choices("etaoin s日é0-a", k=4)) + w).encode())]
    seen = set()
    for _ in range(20000):
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        if rnd.random() < 0.3:
            b = a
        got = encoder.pair(a, b)
        seen.add(got)
        assert got == (encoder.merged(encoder.tokens[a] + encoder.tokens[b]) == [a, b])
    assert seen == {True, False}


def test_the_plain_pattern_cuts_as_the_full_one():
    cutter = op.Cutter(public_tokenizers.PATTERN)
    assert cutter.plain and op.Cutter(r"\p{Lu}+|.").plain is None
    plain = [chr(c) for c in range(0x250) if not op._UNPLAIN.search(chr(c))]
    rnd = random.Random(8)
    for _ in range(3000):
        text = "".join(rnd.choice(plain) if rnd.random() < 0.5 else rnd.choice(" a'sé1.\n\x1c") for _ in range(rnd.randint(0, 30)))
        assert cutter.of(text) is cutter.plain
        assert cutter.plain.findall(text) == cutter.usual.findall(text) == cutter.careful.findall(text)


def test_appends_and_edits(encoder):
    rnd = random.Random(3)
    letters = [c.encode() for c in "etaoinshr éü日 "]
    piece = op.Piece(encoder)
    for _ in range(60):
        piece.append(b"".join(rnd.choices(letters, k=rnd.randint(0, 30))))
        assert piece.last == encoder.extend(piece.bytes, [])
    whole = len(piece.bytes)
    work = []
    for _ in range(60):
        start = rnd.randint(0, len(piece.bytes))
        work.append(piece.replace(start, min(len(piece.bytes), start + rnd.randint(0, 5)), b"".join(rnd.choices(letters, k=rnd.randint(0, 5)))))
        assert piece.last == encoder.extend(piece.bytes, [])
        assert encoder.decode(piece.ids()) == piece.bytes
    assert min(work) < whole / 2


def test_digests_and_round_trip(spark, library):
    texts = [None, "", "Hello wörld's\n\n  x", "日本 語", "a" * 500, "Hello", "Hello", "\x00"]
    rows = [(i if i != 3 else None, t, "r", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rest string, ids int")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for doc_id, t, *_ in rows:
        i = library.encode_ordinary(t or "")
        expected.append((doc_id, len(i), sha(",".join(map(str, i)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, op.token_digests(df, PATH, public_tokenizers.PATTERN).collect()), key=repr) == sorted(expected, key=repr)
    back = op.decode(op.encode(df, PATH, public_tokenizers.PATTERN), PATH)
    assert back.columns == [*df.columns, "token_ids", "decoded"]
    assert all(bytes(r.decoded).decode() == (r.text or "") and r.rest == "r" and r.ids == 7 for r in back.collect())
    assert op.token_digests(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_a_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        op.Encoder(b"YQ== 0\n")
