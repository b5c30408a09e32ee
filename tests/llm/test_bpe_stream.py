from __future__ import annotations

import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hourglass.llm import bpe_stream, queries
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe_stream.Encoder(PATH)


def ids_of(own, text):
    return np.frombuffer(b"".join(own.pieces(text)), "<u4").tolist()


ODD = ["", " ", "\n\n  a", "don't we'LL it's 'sx", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b<|endoftext", "漢字 かな 🙂👍🏽 é \x85　x\x1c y", "1234 5.6 ²½ Ⅷ",
       "   lots   of\t\tspace \r\n end  ", "Ünïcödé ſtraße İ ǅ", "࢏ a՘b \U0001df1f1", "� \x00\x01", "x" * 700 + " " + "ab" * 3000, " " * 5000 + "z", "=" * 9000 + "-" * 77, "é" * 4000]


def test_ids_equal_the_library(own, library):
    for text in ODD:
        assert ids_of(own, text) == library.encode(text, add_special_tokens=False).ids, text[:50]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("ab '\n1é漢=<|endoftx>", max_size=200))
def test_any_text_equals_the_library(text):
    known, library = bpe_stream.encoder(PATH), Tokenizer.from_file(PATH) if not hasattr(test_any_text_equals_the_library, "t") else test_any_text_equals_the_library.t
    test_any_text_equals_the_library.t = library
    want = library.encode(text, add_special_tokens=False).ids
    assert ids_of(known, text) == want
    assert "".join(known.decode(known.pieces(text))) == library.decode(want, skip_special_tokens=False)


def test_every_character_is_classed_as_the_library_does(own, library):
    for base in range(0, sys.maxunicode, 512):
        chars = [chr(c) for c in range(base, min(base + 512, sys.maxunicode + 1)) if not 0xD800 <= c <= 0xDFFF]
        text = "".join(f"a{c}b 1{c}1!{c}! {c}{c} x" for c in chars)
        if text and not bpe_stream._UNSURE.search(text):
            assert bpe_stream.WORDS.findall(text) == [text[a:b] for _, (a, b) in own.library_words(text)], hex(base)


def random_rules(rng: random.Random, n: int):
    tokens, merges, seen = [b"a", b"b", b"c"], [], set()
    while len(merges) < n:
        rule = (rng.choice(tokens), rng.choice(tokens))
        if rule not in seen and len(rule[0] + rule[1]) <= 9 and rule[0] + rule[1] not in tokens:
            seen.add(rule)
            merges.append(rule)
            tokens.append(rule[0] + rule[1])
    vocab = {t: i for i, t in enumerate(dict.fromkeys([*tokens, *(bytes([b]) for b in range(256))]))}
    return vocab, merges


def test_stable_ids_never_change():
    """Of many random merge lists: every emitted id is the whole text's, and borders beyond the lookahead are those of any longer text."""
    rng = random.Random(5)
    for _ in range(150):
        bpe = bpe_stream.Bpe(*random_rules(rng, rng.randint(1, 25)))
        for _ in range(12):
            text = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 120)))
            stream, got, at = bpe_stream.Transducer(bpe), [], 0
            while at < len(text):
                step = rng.randint(1, 6)
                got += stream.feed(text[at:at + step])
                at += step
                assert len(stream.held) <= bpe.lookahead + 9 + 6
            assert got + stream.finish() == bpe.encode(text)
            assert bpe._encode_long([bpe.byte_ids[b] for b in text]) == bpe.encode(text)


def test_rules_in_order_give_the_same_ids():
    """A brute-force twin: every rule in rank order, from left to right."""
    rng = random.Random(7)
    for _ in range(100):
        vocab, merges = random_rules(rng, 20)
        bpe, text = bpe_stream.Bpe(vocab, merges), bytes(rng.choice(b"abc") for _ in range(60))
        parts = [bytes([b]) for b in text]
        for a, b in merges:
            i = 0
            while i < len(parts) - 1:
                if parts[i] == a and parts[i + 1] == b:
                    parts[i:i + 2] = [a + b]
                i += 1
        assert bpe.encode(text) == [vocab[p] for p in parts]


def test_lookahead_of_the_file_and_memory_of_a_long_word(own):
    assert 128 <= own.bpe.lookahead < 2000
    stream, most, text = bpe_stream.Transducer(own.bpe), 0, b"abracadabra" * 20_000
    for at in range(0, len(text), 1000):
        stream.feed(text[at:at + 1000])
        most = max(most, len(stream.held))
    assert most <= own.bpe.lookahead + 128
    with pytest.raises(ValueError):
        bpe_stream.sufficient_lookahead([(b"ab", b"c")])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=12))
def test_byte_to_text_machine(parts):
    decoder = bpe_stream.Utf8Decoder()
    out = ""
    for part in parts:
        out += decoder.feed(part)
        assert len(decoder.state) <= 3
    assert out + decoder.finish() == b"".join(parts).decode("utf-8", "replace")


def test_bytes_that_are_no_text_decode_as_the_library(own, library):
    rng = random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 30))]
        assert "".join(own.decode(iter([np.array(ids, "<u4").tobytes()]))) == library.decode(ids, skip_special_tokens=False)


def test_cache_of_two_generations(own, library, monkeypatch):
    monkeypatch.setattr(bpe_stream, "CACHED_WORDS", 7)
    text = " ".join(f"word{i % 13} w{i}" for i in range(300))
    assert ids_of(own, text) == library.encode(text, add_special_tokens=False).ids and len(own.young) <= 7


def test_slices_of_long_texts(own, library, monkeypatch):
    text = "Some words, isn't it  so? " * 500 + "漢" * 2000 + "1" * 3000 + "࢏ end"
    monkeypatch.setattr(bpe_stream, "SLICE", 100)
    assert ids_of(own, text) == library.encode(text, add_special_tokens=False).ids


def want_of(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_over_all_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in queries.op13_bpe_round_trip(spark, SF).collect()), key=str)
    assert got == want_of(library, docs)


def test_odd_tables(spark, odd_docs, no_docs, library):
    got = sorted((tuple(r) for r in bpe_stream.round_trip(odd_docs.withColumnRenamed("stays", "part"), PATH).collect()), key=str)
    assert got == want_of(library, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert bpe_stream.round_trip(no_docs, PATH).count() == 0 and bpe_stream.encode(no_docs, PATH).count() == 0


def test_encode_and_decode_tables(spark, library, monkeypatch):
    texts = [*ODD, None, "long words and é漢 " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = bpe_stream.encode(docs, PATH)
    parts = {}
    for r in encoded.orderBy("doc_id", "part").collect():
        parts.setdefault(r.doc_id, []).append(bytes(r.ids))
        assert len(r.ids) <= 4 * bpe_stream.PIECE_IDS
    for i, text in enumerate(texts):
        assert np.frombuffer(b"".join(parts[i]), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids
    back = {}
    for r in bpe_stream.decode(encoded, PATH).orderBy("doc_id", "part").collect():
        back[r.doc_id] = back.get(r.doc_id, "") + r.text
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts] and len(parts[len(texts) - 1]) > 1
