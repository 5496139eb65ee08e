"""Alignment of two tokenizers over the same bytes, by white-space anchors.

Both tokenise the whole text (the byte-level BPE of ``transducer``, the pieces of
``sentencepieces``).  Byte offsets where a token of either ends are shared ends; a shared
end before a token that begins with a space in both vocabularies is an anchor.  Anchors are
verified by the bytes: the tokens of both must spell the text.  They cut a document into
windows, a tuple of ids of one kind and a tuple of the other, and a window's alignment (its
groups between shared ends, and the id pairs linked in them) depends on these ids alone.
Windows repeat, so a task keeps their alignments by id tuples.

Pair counts over the corpus take two steps: documents with their id pairs are written once,
pairs are counted by Spark (summed in each task first), and the counts are looked up where
the documents lie.  Counts travel to all tasks if they are at most ``MAX_PAIRS``; beyond
that documents and counts meet in a salted join.  Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sentencepieces, transducer
from .shared import passing, unused, written

TOKENIZER_A, MODEL_B = "/opt/tokenizers/byte_bpe_50k.json", sentencepieces.MODEL
CHUNK_BYTES = 1 << 20
MEMO_WORDS, MEMO_WINDOWS, MEMO_PAIRS = 150_000, 150_000, 1_000_000
HELD_WORDS = 1 << 17  # words held as strings before they are put into an array
MAX_PAIRS = 4_000_000  # counts that are broadcast: 36 MB
SALTS = 16


class _Words:
    """Ids of words, each encoded once by ``encode``, which takes many; emptied when it is full."""

    def __init__(self, encode):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.place: dict = {}
        self.ids, self.first = np.empty(0, np.int32), np.zeros(1, np.int64)

    def ids_of(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) from their words, so many each."""
        coded = words.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.place) > MEMO_WORDS:
            self._clear()
        new = [w for w in words if w not in self.place]
        ids, sizes = self.encode([w.decode("utf-8", "replace") for w in new])
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.first = np.append(self.first, len(self.ids) + np.cumsum(sizes))
        self.ids = np.append(self.ids, ids)
        at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
        at = at[np.asarray(coded.indices)]
        size = self.first[at + 1] - self.first[at]
        flat = self.ids[_ranges(self.first[at], size)]
        ends = np.append(0, np.cumsum(size))
        return flat, np.diff(ends[np.append(0, np.cumsum(counts))])


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each pair, one after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _shared_ends(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the tokens of either, whether the other has one that ends at the same byte."""
    total = int(end_a[-1]) if len(end_a) else 0
    in_a, in_b = np.zeros(total + 1, dtype=bool), np.zeros(total + 1, dtype=bool)
    in_a[end_a], in_b[end_b] = True, True
    return in_b[end_a], in_a[end_b]


def _joined_lists(strings: pa.Array, sizes: np.ndarray, by: str) -> pa.Array:
    """Neighbouring strings put together, so many each."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), strings), by)


class _Windows:
    """Alignments by id tuples, each worked out once; emptied when it is full.  A window's
    key is its number of ids of A, these, and its ids of B, as 4-byte integers."""

    def __init__(self, size_a: np.ndarray, size_b: np.ndarray):
        self.size_a, self.size_b = size_a, size_b
        self.shown = pa.array([str(i) for i in range(max(len(size_a), len(size_b)))], pa.string())
        self._clear()

    def _clear(self) -> None:
        self.place: dict = {}
        self.groups, self.links, self.pairs, self.times = [np.empty(0, np.int64)] * 4
        self.first = np.zeros(1, np.int64)  # of each window's pairs
        self.texts = pa.array([], pa.string())

    def at(self, windows: pa.Array) -> np.ndarray:
        """The place of each of different windows."""
        if len(self.place) > MEMO_WINDOWS or len(self.pairs) > MEMO_PAIRS:
            self._clear()
        keys = windows.to_pylist()
        new = [k for k, w in enumerate(keys) if w not in self.place]
        if new:
            self.place.update(zip((keys[k] for k in new), range(len(self.place), len(self.place) + len(new))))
            self._add(windows.take(pa.array(new, pa.int64())))
        return np.fromiter(map(self.place.__getitem__, keys), dtype=np.int64, count=len(keys))

    def _add(self, windows: pa.Array) -> None:
        flat = np.frombuffer(windows.buffers()[2], dtype=np.int32)
        first = np.frombuffer(windows.buffers()[1], dtype=np.int64, count=len(windows) + 1) // 4
        of_a = flat[first[:-1]].astype(np.int64)
        of_b = np.diff(first) - 1 - of_a
        a, b = flat[_ranges(first[:-1] + 1, of_a)], flat[_ranges(first[:-1] + 1 + of_a, of_b)]
        shared_a, shared_b = _shared_ends(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        last_a, last_b = np.flatnonzero(shared_a), np.flatnonzero(shared_b)  # of each group
        in_group_a, in_group_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        groups = np.diff(np.append(0, np.cumsum(shared_a))[np.append(0, np.cumsum(of_a))])
        window = np.repeat(np.arange(len(windows)), groups)
        names = [_joined_lists(self.shown.take(pa.array(ids)), sizes, ",") for ids, sizes in ((a, in_group_a), (b, in_group_b))]
        texts = _joined_lists(pc.binary_join_element_wise(*names, "|"), groups, ";")

        # the different ids of a group with their counts, then all pairs of these
        group = np.arange(len(last_a))
        kind_a, times_a = np.unique(np.repeat(group, in_group_a) * len(self.size_a) + a, return_counts=True)
        kind_b, times_b = np.unique(np.repeat(group, in_group_b) * len(self.size_b) + b, return_counts=True)
        group_a, many_b = kind_a // len(self.size_a), np.bincount(kind_b // len(self.size_b), minlength=len(group))
        begin_b = np.cumsum(many_b) - many_b
        at_a, at_b = np.repeat(np.arange(len(kind_a)), many_b[group_a]), _ranges(begin_b[group_a], many_b[group_a])
        every = len(self.size_a) * len(self.size_b)
        pair = window[group_a[at_a]] * every + kind_a[at_a] % len(self.size_a) * len(self.size_b) + kind_b[at_b] % len(self.size_b)
        order = np.argsort(pair, kind="stable")
        pair, times = pair[order], (times_a[at_a] * times_b[at_b])[order]
        new = np.flatnonzero(np.diff(pair, prepend=-1))
        self.groups = np.append(self.groups, groups)
        self.links = np.append(self.links, np.bincount(window, in_group_a * in_group_b, len(windows)).astype(np.int64))
        self.first = np.append(self.first, len(self.pairs) + np.cumsum(np.bincount(pair[new] // every, minlength=len(windows))))
        self.pairs = np.append(self.pairs, pair[new] % every)
        self.times = np.append(self.times, np.add.reduceat(times, new))
        self.texts = pa.concat_arrays([self.texts, texts])


class Aligner:
    """Both vocabularies and what a worker remembers of them."""

    def __init__(self, a: transducer.Bpe, b: sentencepieces.Pieces):
        self.a, self.b, self.made = a, b, None

    def __getstate__(self):
        return {"a": self.a, "b": self.b, "made": None}

    def _make(self):
        shown_a, shown_b = ([*table.shown] for table in (self.a, self.b))
        sizes = [np.fromiter(map(len, shown), dtype=np.int64, count=len(shown)) for shown in (shown_a, shown_b)]
        spaced = [np.array([s.startswith(b" ") for s in shown]) for shown in (shown_a, shown_b)]
        arrays = [pa.array(shown, pa.large_binary()) for shown in (shown_a, shown_b)]
        self.a.known().most = MEMO_WORDS
        words = _Words(lambda new: transducer.encode_many(new, self.a)), _Words(lambda new: sentencepieces.encode_words(new, self.b))
        self.made = sizes, spaced, arrays, words, _Windows(*sizes), sentencepieces._kinds(self.b)
        return self.made

    def _ids_a(self, texts: list, words: _Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of A of all texts, number of ids of each)."""
        if self.a.plain or self.a.special:
            lists = [[i for part in transducer.encoded_parts(" " + t.decode(), self.a) for i in part] if t else [] for t in texts]
            sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(texts))
            return np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(sizes.sum())), sizes
        cut, counts, held = [], np.zeros(len(texts), dtype=np.int64), []
        for k, t in enumerate(texts):
            for part in transducer.word_lists(" " + t.decode(), self.a) if t else ():
                counts[k] += len(part)
                held += part
                if len(held) >= HELD_WORDS:
                    cut.append(pa.array(held, pa.large_string()))
                    held = []
        cut.append(pa.array(held, pa.large_string()))
        return words.ids_of(pa.concat_arrays(cut).cast(pa.large_binary()), counts)

    @staticmethod
    def _spelt(ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray, shown: pa.Array) -> list:
        """The bytes of each text's ids."""
        data = memoryview(shown.take(pa.array(ids, pa.int32())).buffers()[2] or b"").cast("B")
        ends = np.append(0, np.cumsum(sizes[ids]))[np.append(0, np.cumsum(counts))].tolist()
        return [data[x:y] for x, y in zip(ends[:-1], ends[1:])]

    def rows(self, texts: list) -> dict:
        """Columns for some texts (UTF-8 or None): see ``align``."""
        (size_a, size_b), (space_a, space_b), (shown_a, shown_b), (words_a, words_b), windows, kinds = self.made or self._make()
        many = len(texts)
        ids_a, n_a = self._ids_a(texts, words_a)
        cut = sentencepieces.Cut(texts, kinds)
        ids_b, n_b = words_b.ids_of(cut.words, cut.counts)
        spelt = zip(texts, self._spelt(ids_a, n_a, size_a, shown_a), self._spelt(ids_b, n_b, size_b, shown_b))
        sound = np.fromiter((bool(t) and a == (whole := b" " + t) and b == whole for t, a, b in spelt), dtype=bool, count=many)
        ids_a, ids_b = ids_a[np.repeat(sound, n_a)], ids_b[np.repeat(sound, n_b)]
        n_a, n_b = np.where(sound, n_a, 0), np.where(sound, n_b, 0)

        shared_a, shared_b = map(np.flatnonzero, _shared_ends(np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])))
        closes = np.zeros(len(ids_a), dtype=bool)
        closes[np.cumsum(n_a)[sound] - 1] = True
        closes = closes[shared_a]
        next_a, next_b = np.minimum(shared_a + 1, max(len(ids_a) - 1, 0)), np.minimum(shared_b + 1, max(len(ids_b) - 1, 0))
        anchor = closes | (space_a[ids_a[next_a]] & space_b[ids_b[next_b]]) if len(ids_a) else closes
        last_a, last_b = shared_a[anchor], shared_b[anchor]

        of_a, of_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        first = np.append(0, np.cumsum(1 + of_a + of_b))
        flat = np.empty(int(first[-1]), dtype=np.int32)
        flat[first[:-1]] = of_a
        flat[np.arange(len(ids_a)) + np.repeat(first[:-1] + 1 - (last_a + 1 - of_a), of_a)] = ids_a
        flat[np.arange(len(ids_b)) + np.repeat(first[:-1] + 1 + of_a - (last_b + 1 - of_b), of_b)] = ids_b
        tuples = pa.Array.from_buffers(pa.large_binary(), len(of_a), [None, pa.py_buffer(first * 4), pa.py_buffer(flat)]).dictionary_encode()
        codes, kinds_n = np.asarray(tuples.indices), len(tuples.dictionary)
        place = windows.at(tuples.dictionary)
        at = place[codes] if kinds_n else codes

        past = np.cumsum(closes[anchor])
        doc = np.flatnonzero(sound)[past - closes[anchor]] if len(codes) else np.empty(0, np.int64)
        ends = np.searchsorted(doc, np.arange(many + 1))
        groups, links = (np.diff(np.append(0, np.cumsum(of[at]))[ends]) for of in (windows.groups, windows.links))
        texts_out = _joined_lists(windows.texts.take(pa.array(at, pa.int64())), np.diff(ends), ";").to_pylist()

        keys, times = np.unique(doc * max(kinds_n, 1) + codes, return_counts=True)
        kind = place[keys % kinds_n] if kinds_n else keys
        size = windows.first[kind + 1] - windows.first[kind]
        at = _ranges(windows.first[kind], size)
        linked = np.repeat(keys // max(kinds_n, 1), size) * (len(size_a) * len(size_b)) + windows.pairs[at]
        order = np.argsort(linked, kind="stable")
        linked, weight = linked[order], (np.repeat(times, size) * windows.times[at])[order]
        new = np.flatnonzero(np.diff(linked, prepend=-1))
        weight = np.add.reduceat(weight, new) if len(new) else weight
        linked = linked[new]
        ends = np.searchsorted(linked // (len(size_a) * len(size_b)), np.arange(many + 1)).astype(np.int32)
        return {
            "n_a": pa.array(n_a),
            "n_b": pa.array(n_b),
            "n_groups": pa.array(groups),
            "n_links": pa.array(links),
            "groups_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts_out], pa.string()),
            "groups": pa.array(texts_out, pa.string()),
            "pairs": pa.ListArray.from_arrays(pa.array(ends), pa.array(linked % (len(size_a) * len(size_b)))),
            "times": pa.ListArray.from_arrays(pa.array(ends), pa.array(weight.astype(np.int64))),
        }


_LONGS = T.ArrayType(T.LongType())
_KINDS = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups_sha256": T.StringType(), "groups": T.StringType(), "pairs": _LONGS, "times": _LONGS}


def align(docs: DataFrame, a: transducer.Bpe, b: sentencepieces.Pieces, text_col: str = "text", carry: list[str] | None = None, outputs=("groups",)) -> DataFrame:
    """``carry`` (default: doc_id) and ``outputs``: n_a and n_b (tokens), n_groups, n_links,
    groups (``a1,a2|b1;a3|b2,b3``), groups_sha256, pairs (the id pairs linked in the document,
    as id of A times the size of B plus id of B) and times (links of each pair).

    Texts that are null or empty, or that the tokens of either do not spell with a space
    before, have no tokens.  Equal rows are rows of their own.  No shuffle."""
    carried = list(carry or ["doc_id"])
    schema = T.StructType([*docs.select(*carried).schema.fields, *[T.StructField(o, _KINDS[o]) for o in outputs]])
    _ = b.pairs if b.kind == "bpe" else None  # made once, travels with the table
    shared = docs.sparkSession.sparkContext.broadcast(Aligner(a, b))  # its size is the vocabularies'

    def run(batches):
        aligner = shared.value
        for batch in batches:
            texts, first, size = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist(), 0, 0
            for k, t in enumerate(texts):
                size += len(t or b"")
                if size >= CHUNK_BYTES or k + 1 == len(texts):
                    found = aligner.rows(texts[first : k + 1])
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, k + 1 - first) for c in batch.columns[:-1]), *(found[o] for o in outputs)], [*carried, *outputs])
                    first, size = k + 1, 0

    return docs.select(*carried, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): the documents that hold a pair linked, and whether no pair of its
    id of A has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    of = F.expr(f"pair div {size_b}L")
    most = counts.groupBy(of.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", of).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(aligned: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    """Sums by document where counts are few enough to travel."""
    table = counts.toArrow().sort_by("pair")
    arrays = [np.asarray(table[c].combine_chunks()) if c != "best" else table[c].to_numpy() for c in ("pair", "n", "best")]
    shared = aligned.sparkSession.sparkContext.broadcast((arrays[0], arrays[1].astype(np.int64), arrays[2].astype(bool)))
    schema = T.StructType([*aligned.select(*names).schema.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(batches):
        pair, n, best = shared.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 2)
            ends = np.append(0, np.cumsum(np.asarray(lists.value_lengths())))
            times = np.asarray(batch.column(batch.num_columns - 1).flatten())
            at = np.searchsorted(pair, np.asarray(lists.flatten()))
            sums = [np.diff(np.append(0, np.cumsum(v))[ends]) for v in (np.where(best[at], times, 0), n[at] * times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *map(pa.array, sums)], [*names, "n_best", "count_sum"])

    return aligned.select(*names, "pairs", "times").mapInArrow(run, schema)


def _joined(aligned: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    """The same by a join: counts are copied to ``SALTS`` salts, so that a pair of most
    documents is spread over as many tasks.  ``aligned`` lies in a table, so its rows keep
    their numbers."""
    row = unused(aligned, "_row")
    numbered = written(aligned.withColumn(row, F.monotonically_increasing_id()), "numbered")
    one = numbered.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(row, F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"), F.pmod(F.hash(row), F.lit(SALTS)).alias("salt"))
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sums = one.join(salted, ["pair", "salt"]).groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    found = numbered.join(sums, row, "left")
    return found.select(*names, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])


def link_statistics(docs: DataFrame, a: transducer.Bpe, b: sentencepieces.Pieces, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` and n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many
    documents as any of its id of A), count_sum (documents of the pair, over links),
    groups_sha256 ('' without tokens)."""
    digests = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    carried = list(carry or ["doc_id"])
    with passing(docs.sparkSession):
        aligned = written(align(docs, a, b, text_col, carried, (*digests, "pairs", "times")), "aligned")
        counts = written(pair_counts(aligned, len(b.shown)), "pair_counts")
        way = _looked_up if counts.count() <= MAX_PAIRS else _joined
        return written(way(aligned, counts, [*carried, *digests]), "link_statistics", keep=True)


def op12_token_alignment(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER_A, model: str = MODEL_B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole
    text of ``documents``; zeros and '' for texts without tokens, as ``align`` states."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = link_statistics(docs, transducer.load(tokenizer, special=False), sentencepieces.load(model))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
