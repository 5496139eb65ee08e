"""Alignment of two tokenizers against their libraries and plain counting."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelkiln.llm import alignment as L
from panelkiln.llm import sentencepieces, transducer


@pytest.fixture(scope="module")
def plain():
    lib_a, lib_b = Tokenizer.from_file(L.TOKENIZER_A), sentencepiece.SentencePieceProcessor(model_file=L.MODEL_B)
    lib_a.encode_special_tokens = True
    shown_a = transducer.load(L.TOKENIZER_A, special=False).shown

    def spell_b(i):
        piece = lib_b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if lib_b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(text):
        """(ids of A, ids of B) of each group, or None."""
        if not text:
            return None
        a, b, whole = lib_a.encode(" " + text, add_special_tokens=False).ids, lib_b.encode(text), (" " + text).encode()
        of_a, of_b = [shown_a[i] for i in a], [spell_b(i) for i in b]
        if b"".join(of_a) != whole or b"".join(of_b) != whole:
            return None
        ends = [{}, {}]
        for k, shown in enumerate((of_a, of_b)):
            at = 0
            for n, piece in enumerate(shown, 1):
                at += len(piece)
                ends[k][at] = n
        out, i, j = [], 0, 0
        for at in sorted(set(ends[0]) & set(ends[1])):
            out.append((a[i : ends[0][at]], b[j : ends[1][at]]))
            i, j = ends[0][at], ends[1][at]
        return out

    def rows(texts):
        found = [groups(t) for t in texts]
        links = [Counter((x, y) for a, b in g for x in a for y in b) if g else Counter() for g in found]
        counts = Counter(p for c in links for p in c)
        most = Counter()
        for (x, _), n in counts.items():
            most[x] = max(most[x], n)
        out = []
        for g, c in zip(found, links):
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g) if g else ""
            out.append((
                sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), c.total(),
                sum(n for p, n in c.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else "",
            ))
        return out

    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [L.MAX_PAIRS, 5])
def test_equal_to_the_libraries(spark, plain, monkeypatch, most):
    monkeypatch.setattr(L, "MAX_PAIRS", most)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    odd = [None, "", " ", "   \n\t x", "a▁b", "<|endoftext|> a<s>b</s><unk><0x41>", "né 漢字 😀 x\x00y", "éa​", "x" * 5000, "word " * 900, "\n\n\n", "漢字" * 3000, " lead", "trail ", "\r\n a　b"]
    texts += odd + odd[5:8]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, pairs int, n_a int").repartition(3)
    got = L.link_statistics(docs.select("doc_id", "text"), transducer.load(L.TOKENIZER_A, special=False), sentencepieces.load()).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == plain(texts)


def test_small_chunks_and_memos_change_nothing(spark, plain, monkeypatch):
    for name, n in (("CHUNK_BYTES", 700), ("MEMO_WORDS", 90), ("MEMO_WINDOWS", 90), ("MEMO_PAIRS", 90)):
        monkeypatch.setattr(L, name, n)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(12).collect()] + [None, "", "a b"]
    aligner, got = L.Aligner(transducer.load(L.TOKENIZER_A, special=False), sentencepieces.load()), []
    for k in range(0, len(texts), 4):
        found = aligner.rows([t.encode() if t else None for t in texts[k : k + 4]])
        got += zip(*(found[c].to_pylist() for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")))
    assert got == [(*r[:4], r[6]) for r in plain(texts)]


def test_rows_of_any_kind(spark, documents, nothing, plain):
    a, b = transducer.load(L.TOKENIZER_A, special=False), sentencepieces.load()
    rows = L.align(documents, a, b, carry=["doc_id", "text", "ids", "n"], outputs=("groups", "n_groups")).collect()
    assert len(rows) == documents.count()
    assert all(r.n_groups == (r.groups.count(";") + 1 if r.groups else 0) for r in rows)
    assert L.link_statistics(nothing, a, b).count() == 0


def test_query(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = L.op12_token_alignment(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == plain([d.text for d in docs])


def test_words_merged_together_have_the_ids_of_the_stream():
    for path in (L.TOKENIZER_A, transducer.TOKENIZER):
        table = transducer.load(path, special=False)
        words = ["", "a", " the", "international", "é", " 日本語", "x" * 64, "x" * 65, "ab" * 3000, "   ", "'ll", "é" * 40, " z", "the"]
        ids, sizes = transducer.encode_many(words, table)
        want = []
        for w in words:
            stream = transducer.WordStream(table)
            want.append([i for i in [*stream.feed(w), *stream.close()] if i >= 0])
        assert sizes.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]
    assert transducer.encode_many([], table)[0].tolist() == []


def test_parts_of_words_put_together_are_the_words_of_the_text():
    table = transducer.load(L.TOKENIZER_A, special=False)
    for text in ("ab  cd \n ef'll g h " * 9000, " " * 70_000 + "a b" * 30_000, "x" * 150_000 + " y", ""):
        assert [w for part in transducer.word_lists(text, table) for w in part] == table.words.findall(text)
