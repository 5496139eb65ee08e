"""Cases that once gave wrong rows."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from panelkiln.llm import recompression, sentencepieces, stages


def _thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_long_words_that_a_polynomial_confuses(spark):
    same, word = [f"w{k}" for k in range(34)], _thue_morse(2048)
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, " ".join([*same[:17], word, *same[17:]])), (2, " ".join([*same[:17], other, *same[17:]]))], "doc_id long, text string")
    assert [r.n_removed for r in recompression.dedup_substrings(docs).collect()] == [0, 0]
    docs = spark.createDataFrame([(k, " ".join([*same, word])) for k in (1, 2)], "doc_id long, text string")
    assert [r.n_removed for r in recompression.dedup_substrings(docs).collect()] == [35, 35]


def test_word_names_tell_words_apart():
    words = sorted({"".join(w) for n in range(1, 10) for w in itertools.product("ab", repeat=n)} | {_thue_morse(n) for n in range(10, 3000, 7)})
    found = recompression.Words([" ".join(words).encode()])
    for names in (found.name, found.other):
        assert len(np.unique(names)) == len(words)
    assert not set(found.name.tolist()) & set(found.other.tolist())
    alone = [recompression.Words([w.encode()]).name[0] for w in words[:50]]
    assert alone == found.name[:50].tolist()  # whatever stands around a word


def test_ties_go_to_the_leftmost_pair_everywhere(spark):
    table = sentencepieces.Pieces("bpe", {"a": (0, 0.0), "b": (1, 0.0), "ab": (2, -1.0), "ba": (3, -1.0), "aab": (4, -2.0), "bb": (5, -1.0)}, [], 9, [b"a", b"b", b"ab", b"ba", b"aab", b"bb"])
    words = ["".join(w) for n in range(1, 10) for w in itertools.product("ab", repeat=n)]
    one_by_one = [sentencepieces._merge(w, table) for w in words]
    ids, sizes = sentencepieces._merge_many(words, table)
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == one_by_one
    some = words[::7]
    folded = {r.word: r.ids for r in sentencepieces.lattice(spark.createDataFrame([(w,) for w in some], "word string"), table).collect()}
    assert [folded[w] for w in some] == [one_by_one[words.index(w)] for w in some]


def test_near_dedup_with_columns_that_have_no_hash(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text, {"a": 1}), (1, text, {"a": 1}), (2, text + " more", {"b": 2}), (3, "something else entirely", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>").withColumn("deep", F.array(F.struct("m")))
    assert sorted(r.doc_id for r in stages.near_dedup(spark, docs, "").collect()) == [1, 3]
