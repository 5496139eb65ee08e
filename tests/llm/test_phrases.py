"""Phrase mining against plain counting in Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from panelkiln.llm import phrases as P


def _plain(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase of every text."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        good = {p: n for p, n in found.items() if n >= least}
        scored = []
        for p, a in good.items():
            inside = any(len(q) > len(p) and 100 * n >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, n in good.items())
            if len(p) == 1 or inside:
                continue
            score, k = min((1000 * a * totals[lang] // (good[p[:k]] * good[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), good[p[:k]], good[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    words = ["a", "b", "B", "cc", "é", "ÉX", "ab", "d\x00e", "f​g"]
    some = [("en" if k % 3 else None if k % 2 else "und", "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", "\n", "\x0b", ",", " \x1c "]) for _ in range(draw.randint(0, 60)))) for k in range(150)]
    return [*some, *some[:20], ("en", None), ("en", ""), ("fr", " \n. "), ("de", "x y"), ("en", "hot hot " * 900)]


@pytest.mark.parametrize("most", [10**6, 7])
def test_equal_to_counting(spark, rows, monkeypatch, most):
    monkeypatch.setattr(P, "MAX_PHRASES", most)
    least = 9 if most > 7 else 40
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, n int, phrase int").repartition(3)
    got = P.collocations(docs, least=least, top=25).collect()
    want = _plain(rows, least, 25)
    assert len(want) > 25 and sorted(map(tuple, got)) == want


def test_small_buffers_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(P, "HELD", 20)
    monkeypatch.setattr(P, "CHUNK_BYTES", 64)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, P.collocations(docs, least=30).collect())) == _plain(rows, 30, 2000)


def test_no_rows_or_nothing_frequent(spark, documents, nothing):
    assert P.collocations(nothing).count() == 0
    assert P.collocations(documents, least=10**6).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert P.collocations(documents, least=10**6).count() == 0
    assert P.collocations(documents, least=2).count() > 0


@pytest.mark.parametrize("seed", range(4))
def test_double_array_holds_its_paths_only(seed):
    draw = np.random.default_rng(seed)
    paths = np.unique(draw.integers(1, [4, 40, 400][seed % 3], (600, 1 + seed)), axis=0).astype(np.int32)
    trie = P.Trie(paths)
    known = {tuple(p): k for k, p in enumerate(paths.tolist())}
    tries = np.concatenate((paths, draw.integers(0, paths.max() + 1, (2000, 1 + seed))))
    for path in tries.tolist():
        ends = trie.ends(P.Trie.ROOT, np.array(path, dtype=np.int32), len(path))
        assert ends[0] == known.get(tuple(path), -1)


def test_scores_beyond_64_bits_are_exact(spark):
    rows = [(10**12 + 7, 10**16 + 9, 10**13 + 1, 10**12 + 39), (99, 10**17, 100, 101), (1, 1, 1, 1)]
    got = [r.s for r in spark.createDataFrame(rows, "a long, total long, l long, r long").selectExpr(f"{P.SCORE} as s").collect()]
    assert got == [1000 * a * n // (l * r) for a, n, l, r in rows]
