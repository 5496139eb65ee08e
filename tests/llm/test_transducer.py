"""Streaming BPE against the tokenizers library and, for the lookahead, brute force."""

import hashlib
import itertools
import random

import pytest
from tokenizers import Tokenizer

from panelkiln.llm import transducer as X

WORD, BYTE = "/opt/tokenizers/word_bpe_49k.json", "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module", params=[WORD, BYTE])
def pair(request):
    return Tokenizer.from_file(request.param), X.load(request.param)


def _ids(text, table, part=X.PART):
    encoder, out = X.Encoder(table), []
    for k in range(0, len(text), part):
        out += encoder.feed(text[k : k + part])
    return out + encoder.close()


def _decoded(ids, table, part=10**9):
    back = X.Decoder(table)
    return "".join(back.feed(ids[k : k + part]) for k in range(0, len(ids), part)) + back.close()


def test_texts_as_the_library(pair, spark):
    lib, table = pair
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", "   ", "\n\n a", "!'s 'RE it'll 12", "<|endoftext|> x<|startoftext|><|endof", "a\x00b​", "ΣΑΣ İ", "ẹ́", "x" * 9000, "漢字" * 4000, "\t" * 500 + "a"]
    for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert _ids(text, table) == want.ids
        assert _decoded(want.ids, table, 3) == lib.decode(want.ids, skip_special_tokens=False)


def test_parts_do_not_matter(pair, monkeypatch):
    lib, table = pair
    monkeypatch.setattr(X, "PART", 16)
    monkeypatch.setattr(X, "BLOCK", 8)
    draw = random.Random(1)
    some = [*"aaabbs'tvrledm  \n\t1290!?<|>ΣİñÁ漢字가", "é", "가", "<|endoftext|>", "<|startoftext|>", "'re", "  "]
    for _ in range(300):
        text = "".join(draw.choice(some) for _ in range(draw.randint(0, 90)))
        want = lib.encode(text, add_special_tokens=False).ids
        for part in (1, 3, 40):
            assert _ids(text, table, part) == want
    for _ in range(3):  # words without an end
        text = "".join(draw.choice(["a", "b", "ing", "the", "ex", "hil", "arating", "guarantee", "é"]) for _ in range(1500))
        assert _ids(text, table, 5) == lib.encode(text, add_special_tokens=False).ids


def test_an_open_word_keeps_a_bounded_part():
    table = X.load(WORD)
    stream, n = X.WordStream(table), 0
    for _ in range(40):
        n += len(stream.feed("exhilarating" * 400))
        assert len(stream.held) <= table.lookahead + X.BLOCK
    assert n > 0


@pytest.mark.parametrize("seed", range(12))
def test_lookahead_suffices(seed):
    """Over small random merge lists: tokens that far before the end do not depend on what follows."""
    draw = random.Random(seed)
    tokens, rules = ["a", "b"], []
    while len(rules) < 7:
        u, v = draw.choice(tokens), draw.choice(tokens)
        if u + v not in tokens:
            rules.append((u, v))
            tokens.append(u + v)
    number = {t: k for k, t in enumerate(tokens)}
    numbered = [(number[u], number[v], number[u + v]) for u, v in rules]
    ranked = {(a, b): (k, c) for k, (a, b, c) in enumerate(numbered)}
    reach = X.lookahead(numbered, {k: len(t) for t, k in number.items()})

    def ends(text):
        return list(itertools.accumulate(len(tokens[i]) for i in X.merge([number[c] for c in text], ranked)))

    for _ in range(400):
        head = "".join(draw.choice("ab") for _ in range(draw.randint(reach, reach + 12)))
        settled = [[e for e in ends(head + tail) if e <= len(head) - reach] for tail in ("", "a", "b", "ab", "ba", "bbb", "abab")]
        assert all(s == settled[0] for s in settled)


def test_a_token_with_two_rules_has_no_bound():
    assert X.lookahead([(0, 1, 2), (1, 0, 3), (0, 3, 4), (2, 0, 4)], {0: 1, 1: 1, 2: 2, 3: 2, 4: 3}) is None
    assert X.lookahead([(2, 0, 3), (0, 1, 2)], {0: 1, 1: 1, 2: 2, 3: 3}) is None


def test_rows_of_any_kind(spark, documents, nothing):
    lib, table = Tokenizer.from_file(WORD), X.load(WORD)
    got = X.encode(documents, table, carry=["doc_id", "text", "ids"], outputs=("n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == documents.count()
    for r in got:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert X.encode(nothing, table).count() == 0


def test_decoding_a_table(spark):
    lib, table = Tokenizer.from_file(BYTE), X.load(BYTE)
    coded = X.encode(spark.createDataFrame([(1, "né 漢字 <|endoftext|>"), (2, None)], "doc_id long, text string"), table, carry=["doc_id", "text"])
    rows = X.decode(coded.union(spark.createDataFrame([(3, None, None), (4, None, [-1, 99999999, 12520])], coded.schema)), table).orderBy("doc_id").collect()
    assert [r.decoded for r in rows[:3]] == ["né 漢字 <|endoftext|>", "", None]
    assert rows[3].decoded == lib.decode([12520], skip_special_tokens=False)


def test_special_strings_as_plain_text():
    lib, table = Tokenizer.from_file(BYTE), X.load(BYTE, special=False)
    lib.encode_special_tokens = True
    text = "a<|endoftext|> b"
    assert _ids(text, table) == lib.encode(text, add_special_tokens=False).ids


def test_query(spark):
    lib = Tokenizer.from_file(WORD)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = X.op11_bpe_transducer(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
