"""SentencePiece encoding and decoding as a relational lattice.

A text is cut into words (a run of spaces with what follows it; characters that no piece
of several characters contains stand alone).  No piece crosses such a cut, so a word's
pieces do not depend on its surroundings.

The frequent words of the corpus are encoded as tables: substrings of bounded length are
exploded, equi-joined to the piece table (its size is fixed by the model), the edges are
grouped by word, and a higher-order ``aggregate`` folds each group into ids.

* Unigram models: a Viterbi fold over end positions.
* BPE models: a fold over merges, each joining the best-scored neighbouring pair that is
  an edge (leftmost of ties).  Viterbi over BPE scores gives other ids than the model
  does, so it is used for unigram models only (figures in the README).

The dictionary so made has at most ``MAX_WORDS`` words, which bounds the broadcast.  The
exact way for all other words, and for words above ``MAX_LENGTH`` characters, is to merge
them in the task that meets them: all words of a chunk together, a pair of each in a round
(or by a heap, above ``ROUNDS_LENGTH`` characters; or Viterbi).
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rounds import ROUNDS_LENGTH, PairTable, merge_rounds
from .shared import shuffle_partitions, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_SPACE_UTF8 = SPACE.encode()
MAX_WORDS, MIN_COUNT, MAX_LENGTH = 300_000, 8, 32
HELD = 2_000_000  # words a task counts before it hands them on


@dataclass(frozen=True)
class Pieces:
    """A piece table: plain pieces with id and score, byte pieces, and the model's kind."""

    kind: str  # "bpe" or "unigram"
    pieces: dict  # text -> (id, score)
    bytes_: list  # ids of the 256 byte pieces, or empty
    unknown: int
    shown: list  # bytes of each id when decoded

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @cached_property
    def floor(self) -> float:
        """The score of a character that is no piece."""
        return min((s for _, s in self.pieces.values()), default=0.0) - 10.0

    @cached_property
    def pairs(self) -> "_Pairs":
        return _Pairs(self)

    def alone(self) -> str:
        """Control characters that stand alone: in no piece of several characters."""
        used = {c for p in self.pieces if len(p) > 1 for c in p}
        return "".join(c for c in "\n\t\r" if c not in used)


def load(path: str = MODEL) -> Pieces:
    """Read a model file; only models without a character map, with a leading space
    and untouched white space are supported."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, kind = model.normalizer_spec, {1: "unigram", 2: "bpe"}.get(model.trainer_spec.model_type)
    if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or kind is None:
        raise ValueError("only unigram and BPE models with identity normalisation are supported")
    plain, bytes_, unknown, shown = {}, [], 0, []
    for i, p in enumerate(model.pieces):
        if p.type == 6:
            bytes_.append(i)
            shown.append(bytes([int(p.piece[3:5], 16)]))
            continue
        shown.append(p.piece.replace(SPACE, " ").encode() if p.type in (1, 4) else b"")
        if p.type == 2:
            unknown = i
        if p.type in (1, 4):
            plain.setdefault(p.piece, (i, p.score))
    return Pieces(kind, plain, bytes_ if len(bytes_) == 256 else [], unknown, shown)


# Kinds of a byte, and whether a word begins at one that follows another: a run of spaces
# begins a word, and a character that stands alone is one.
_REST, _BLANK, _ALONE = 0, 1, 2
_BEGINS = np.array([before * 3 + this in (_REST * 3 + _BLANK, _ALONE * 3 + _BLANK, _ALONE * 3 + _REST) or this == _ALONE for before in range(3) for this in range(3)])
CHUNK_BYTES = 8 << 20


def _kinds(table: Pieces) -> np.ndarray:
    kinds = np.full(256, _REST, dtype=np.uint8)
    kinds[ord(" ")] = _BLANK
    for c in table.alone():
        kinds[ord(c)] = _ALONE
    return kinds


class Cut:
    """Some texts cut into words: ``words`` (bytes, U+2581 as a space), the number of words
    of each text in ``counts``.  A text gets the leading space that the model adds."""

    def __init__(self, texts: list, kinds: np.ndarray):
        texts = [b" " + t.replace(_SPACE_UTF8, b" ") if t else b"" for t in texts]
        data = b"".join(texts)
        edges = np.cumsum([0, *map(len, texts)])
        kind = kinds[np.frombuffer(data, dtype=np.uint8)]
        begins = np.empty(len(data), dtype=bool)
        begins[1:] = _BEGINS[kind[:-1] * np.uint8(3) + kind[1:]]
        begins[edges[:-1][np.diff(edges) > 0]] = True
        first = np.flatnonzero(begins)
        self.counts = np.diff(np.searchsorted(first, edges))
        offsets = np.append(first, len(data)).astype(np.int32)
        self.words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _cuts(column: pa.Array, kinds: np.ndarray):
    """A string column in chunks of about CHUNK_BYTES: (first row, past last row, Cut)."""
    texts, first, size = column.cast(pa.binary()).to_pylist(), 0, 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size >= CHUNK_BYTES or k + 1 == len(texts):
            yield first, k + 1, Cut(texts[first : k + 1], kinds)
            first, size = k + 1, 0


# --- the fold in a task, for rare and long words


def _fallback(char: str, table: Pieces) -> list[int]:
    if char in table.pieces:
        return [table.pieces[char][0]]
    return [table.bytes_[b] for b in char.encode("utf-8", "replace")] if table.bytes_ else [table.unknown]


def _merge(word: str, table: Pieces) -> list[int]:
    """BPE with a heap of neighbouring pairs."""
    n, pieces = len(word), table.pieces
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    live, heap = [True] * n, []

    def push(a: int, b: int) -> None:
        found = pieces.get(word[a : end[b]])
        if found is not None:
            heapq.heappush(heap, (-found[1], a, b, end[b]))

    for a in range(n - 1):
        push(a, a + 1)
    while heap:
        _, a, b, stop = heapq.heappop(heap)
        if not (live[a] and live[b] and end[a] == b and end[b] == stop):
            continue
        live[b], end[a] = False, stop
        if stop < n:
            before[stop] = a
            push(a, stop)
        if before[a] >= 0:
            push(before[a], a)
    ids, at = [], 0
    while at < n:
        found = pieces.get(word[at : end[at]])
        ids += [found[0]] if found else _fallback(word[at], table)
        at = end[at]
    return ids


def _viterbi(word: str, table: Pieces) -> list[int]:
    n, longest, low = len(word), table.longest, table.floor
    best: list = [(0.0, None)] + [None] * n
    for stop in range(1, n + 1):
        for start in range(max(0, stop - longest), stop):
            found = table.pieces.get(word[start:stop])
            if found is None and stop - start > 1:
                continue
            score = best[start][0] + (found[1] if found else low)
            if best[stop] is None or score > best[stop][0]:
                best[stop] = (score, start)
    ids, at = [], n
    while at:
        start = best[at][1]
        found = table.pieces.get(word[start:at])
        ids[:0] = [found[0]] if found else _fallback(word[start:at], table)
        at = start
    return ids


def encode_word(word: str, table: Pieces) -> list[int]:
    return _merge(word, table) if table.kind == "bpe" else _viterbi(word, table)


class _Pairs(PairTable):
    """A BPE table as pairs of symbols that make a symbol.  Symbols are the pieces and the
    single characters in them; other characters are -1 - code point."""

    def __init__(self, table: Pieces):
        names = sorted({*table.pieces, *(c for p in table.pieces for c in p)})
        number = {p: k for k, p in enumerate(names)}
        self.id = np.array([table.pieces[p][0] if p in table.pieces else -1 for p in names], dtype=np.int32)
        self.char = np.array([ord(p) if len(p) == 1 else 0 for p in names], dtype=np.int32)
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)
        single = self.char > 0
        self.symbol[self.char[single]] = np.flatnonzero(single)
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        ranks = {x: k for k, x in enumerate(sorted({x for _, x in table.pieces.values()}, reverse=True))}
        made = [(number[p[:k]] << 32 | number[p[k:]], number[p], ranks[x]) for p, (_, x) in table.pieces.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        super().__init__(*((np.array(x, dtype=np.int64) for x in zip(*made)) if made else [np.empty(0, dtype=np.int64)] * 3))


def _merge_many(words: list[str], table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of ids of each): ``_merge`` of many words together.  In
    each round every open word joins its best pair, the leftmost of ties."""
    pairs = table.pairs
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    symbol = pairs.symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    word, symbol = merge_rounds(symbol, np.repeat(np.arange(len(words)), sizes), pairs)
    ids = np.where(symbol >= 0, pairs.id[symbol], -1)
    lost = np.flatnonzero(ids < 0)  # characters that are no piece
    if len(lost):
        chars = np.where(symbol[lost] >= 0, pairs.char[symbol[lost]], -1 - symbol[lost])
        known = {c: _fallback(chr(c), table) for c in np.unique(chars).tolist()}
        spelt = [known[c] for c in chars.tolist()]
        n = np.ones(len(ids), dtype=np.int64)
        n[lost] = [len(x) for x in spelt]
        ids, word = np.repeat(ids, n), np.repeat(word, n)
        ids[ids < 0] = [i for x in spelt for i in x]
    return ids.astype(np.int32), np.bincount(word, minlength=len(words))


def encode_words(words: list[str], table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of ids of each)."""
    if table.kind == "bpe" and max(map(len, words), default=0) <= ROUNDS_LENGTH:
        return _merge_many(words, table)
    short = [w for w in words if len(w) <= ROUNDS_LENGTH] if table.kind == "bpe" else []
    ids, sizes = _merge_many(short, table)
    parts = iter(np.split(ids, np.cumsum(sizes)[:-1])) if short else iter(())
    lists = [next(parts) if short and len(w) <= ROUNDS_LENGTH else np.array(encode_word(w.replace(" ", SPACE), table), dtype=np.int32) for w in words]
    return np.concatenate([*lists, np.empty(0, dtype=np.int32)]), np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))


# --- the relational lattice


def lattice(words: DataFrame, table: Pieces) -> DataFrame:
    """(word, ids) of a table of distinct ``word`` by explode, equi-join, group and fold."""
    spark = words.sparkSession
    schema = "piece string, id int, score double"
    rows = [(p, i, float(s)) for p, (i, s) in table.pieces.items()]
    pieces = F.broadcast(spark.createDataFrame(rows, schema))  # its size is the model's
    sized = words.repartition(shuffle_partitions(spark), "word").select("word", F.length("word").alias("n"))  # the one shuffle: edges stay with their word
    starts = sized.select("word", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("a"))
    spans = starts.select("word", "n", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(table.longest), F.col("n") - F.col("a") + 1))).alias("len"))
    edges = spans.withColumn("piece", F.col("word").substr(F.col("a"), F.col("len"))).join(pieces, "piece")
    entry = F.struct((F.col("a") * 1024 + F.col("a") + F.col("len")).alias("key"), F.struct("score", "id").alias("value"))
    grouped = edges.groupBy("word").agg(F.map_from_entries(F.collect_list(entry)).alias("edges"))
    whole = sized.join(grouped, "word", "left")
    fold = _merge_fold if table.kind == "bpe" else _viterbi_fold
    return whole.select("word", fold(F.col("word"), F.col("n"), F.col("edges"), table).alias("ids"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _edge(edges: Column, a: Column, b: Column) -> Column:
    return F.element_at(edges, a * 1024 + b)


def _char_ids(char: Column, table: Pieces) -> Column:
    """Ids of a character that is no piece: its bytes or the unknown piece."""
    if not table.bytes_:
        return F.array(F.lit(table.unknown))
    ids = F.array(*[F.lit(i) for i in table.bytes_])
    hexed = F.hex(F.encode(char, "UTF-8"))
    places = F.sequence(F.lit(1), F.length(hexed), F.lit(2))
    return F.transform(places, lambda k: F.element_at(ids, F.conv(hexed.substr(k, F.lit(2)), 16, 10).cast("int") + 1))


def _merge_fold(word: Column, n: Column, edges: Column, table: Pieces) -> Column:
    def step(bounds: Column, _: Column) -> Column:
        scored = F.transform(
            F.sequence(F.lit(1), F.size(bounds) - 2),
            lambda k: F.struct(_edge(edges, F.element_at(bounds, k), F.element_at(bounds, k + 2))["score"].alias("score"), (-k).alias("k")),
        )
        best = F.array_max(F.filter(scored, lambda s: s["score"].isNotNull()))["k"]
        cut = _let(best, lambda k: F.when(k.isNull(), bounds).otherwise(F.concat(F.slice(bounds, F.lit(1), -k), F.slice(bounds, 2 - k, F.size(bounds)))))
        return F.when(F.size(bounds) > 2, cut).otherwise(bounds)

    bounds = F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(1), n + 1), step)

    def ids(b: Column) -> Column:
        pairs = F.arrays_zip(F.slice(b, F.lit(1), F.size(b) - 1).alias("a"), F.slice(b, F.lit(2), F.size(b)).alias("z"))
        found = F.transform(pairs, lambda p: F.struct(p["a"].alias("a"), _edge(edges, p["a"], p["z"])["id"].alias("id")))
        return F.flatten(F.transform(found, lambda f: F.when(f["id"].isNotNull(), F.array(f["id"])).otherwise(_char_ids(word.substr(f["a"], F.lit(1)), table))))

    return _let(bounds, ids)


def _viterbi_fold(word: Column, n: Column, edges: Column, table: Pieces) -> Column:
    low = table.floor
    empty = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids")))

    def step(state: Column, stop: Column) -> Column:
        def arrive(start: Column) -> Column:
            edge, here = _edge(edges, start, stop + 1), F.element_at(state, start)
            single = start == stop
            return F.struct(
                F.when(edge.isNotNull(), here["score"] + edge["score"]).when(single, here["score"] + low).alias("score"),
                (-start).alias("k"),
                F.concat(here["ids"], F.when(edge.isNotNull(), F.array(edge["id"])).otherwise(_char_ids(word.substr(start, F.lit(1)), table))).alias("ids"),
            )

        first = F.greatest(F.lit(1), stop - table.longest + 1)
        options = F.filter(F.transform(F.sequence(first, stop), arrive), lambda o: o["score"].isNotNull())
        # ascending start wins ties, as in the task's fold
        return F.concat(state, F.transform(F.array(F.array_max(options)), lambda b: F.struct(b["score"].alias("score"), b["ids"].alias("ids"))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), empty, step), -1)["ids"]


# --- whole texts


def _text_of(words: pa.Array) -> pa.Array:
    """Words as the model sees them; bytes that are no UTF-8 become U+FFFD."""
    try:
        texts = words.cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([w.decode("utf-8", "replace") for w in words.to_pylist()], pa.string())
    return pc.replace_substring(texts, " ", SPACE)


def word_counts(docs: DataFrame, table: Pieces, text_col: str = "text") -> DataFrame:
    """(word, n) of all texts, summed in each task before the shuffle (whenever a task holds
    ``HELD`` words).  Null and empty texts have no words."""
    kinds = _kinds(table)

    def run(batches):
        parts: list = []

        def summed() -> pa.Table:
            return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def out(counts: pa.Table) -> pa.RecordBatch:
            words = counts["word"].combine_chunks()
            return pa.RecordBatch.from_arrays([_text_of(words), counts["n"].combine_chunks()], ["word", "n"])

        for batch in batches:
            for _, _, cut in _cuts(batch.column(0), kinds):
                coded = cut.words.dictionary_encode()
                n = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
                parts.append(pa.table([coded.dictionary, pa.array(n, pa.int64())], names=["word", "n"]))
                if sum(p.num_rows for p in parts) > HELD:
                    parts = [summed()]
                    if parts[0].num_rows > HELD // 2:
                        yield out(parts.pop())
        if parts:
            yield out(summed())

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, table: Pieces, text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """(word, ids) of the words that occur ``MIN_COUNT`` times or more (for rarer ones a
    lattice costs more than it saves), ``max_words`` at most: those above the frequency (in
    steps of a quarter of a power of two) where they become too many."""
    counts = written(word_counts(docs, table, text_col).where((F.length("word") <= MAX_LENGTH) & (F.col("n") >= MIN_COUNT)), "words")
    step = F.floor(F.log2("n") * 4).cast("int")
    steps = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    least, total = None, 0
    for row in steps:
        total += row["count"]
        if total > max_words:
            break
        least = row["step"]
    frequent = counts.where(step >= least) if least is not None else counts.limit(0)
    return lattice(frequent.select("word"), table)


class _Book:
    """The dictionary in a task: words and their ids, as one array of all ids."""

    def __init__(self, words: bytes, spans: np.ndarray, ids: np.ndarray, sizes: np.ndarray, table: Pieces):
        ends = np.cumsum(spans, dtype=np.int64)
        self.place = {words[a:b]: k for k, (a, b) in enumerate(zip((ends - spans).tolist(), ends.tolist()))}
        self.ids, self.table = ids, table
        self.first = np.cumsum(np.append(0, sizes), dtype=np.int64)

    def ids_of(self, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of the chunk, number of ids of each text).  Each different word is
        looked up once, those that the dictionary lacks are merged together."""
        coded = cut.words.dictionary_encode()
        words = coded.dictionary.to_pylist()
        at = np.fromiter((self.place.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        rare = np.flatnonzero(at < 0)
        more, sizes = encode_words([words[k].decode("utf-8", "replace") for k in rare.tolist()], self.table)
        first, size = self.first[at], self.first[at + 1] - self.first[at]  # of -1: not used
        first[rare], size[rare] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
        starts = np.cumsum(size) - size
        flat = np.concatenate((self.ids, more))[np.repeat(first - starts, size) + np.arange(size.sum())]
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)), pa.int32()), pa.array(flat, pa.int32()))
        ids = np.asarray(lists.take(coded.indices).flatten())
        of_word = np.append(0, np.cumsum(size[np.asarray(coded.indices)]))
        return ids, np.diff(of_word[np.append(0, np.cumsum(cut.counts))])


def _texts(ids: np.ndarray, sizes: np.ndarray, shown: pa.Array) -> list[bytes]:
    """The text of each row's ids as UTF-8; ids outside the table give nothing."""
    inside = np.where((ids >= 0) & (ids < len(shown) - 1), ids, len(shown) - 1)
    taken = shown.take(pa.array(inside, pa.int32()))
    data, ends = memoryview(taken.buffers()[2] or b""), np.asarray(_offsets(taken))
    rows = ends[np.append(0, np.cumsum(sizes))].tolist()
    return [bytes(data[a:b]).removeprefix(b" ").decode("utf-8", "replace").encode() for a, b in zip(rows[:-1], rows[1:])]


def _offsets(binary: pa.Array) -> np.ndarray:
    return np.frombuffer(binary.buffers()[1], dtype=np.int32 if binary.type == pa.binary() else np.int64, count=len(binary) + 1 + binary.offset)[binary.offset :]


def _shown(table: Pieces) -> pa.Array:
    return pa.array([*table.shown, b""], pa.large_binary())  # the last one for ids outside the table


def _digests(ids: np.ndarray, sizes: np.ndarray) -> list[str]:
    whole, ends = memoryview(np.ascontiguousarray(ids, dtype="<i4")).cast("B"), np.append(0, np.cumsum(sizes) * 4).tolist()
    return [hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])]


def encode(docs: DataFrame, table: Pieces, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS, carry: list[str] | None = None, outputs=("ids",)) -> DataFrame:
    """``carry`` (default: the id) and ``outputs``: ids (the piece ids of the whole text),
    n_pieces, ids_sha256 (of the ids as 4-byte little-endian integers), decoded_sha256 (of
    the text that the ids decode to).  Null and empty texts have no pieces; repeated rows
    are rows of their own."""
    spark = docs.sparkSession
    known = written(dictionary(docs, table, text_col, max_words), "dictionary").toArrow()
    ids = known["ids"].combine_chunks() if known.num_rows else pa.array([], pa.list_(pa.int32()))
    sizes = np.diff(np.asarray(ids.offsets)) if known.num_rows else np.empty(0, np.int64)
    words = [w.replace(SPACE, " ").encode() for w in known["word"].to_pylist()]  # any character may be in a word
    spans = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
    _ = table.pairs if table.kind == "bpe" else None  # made once, travels with the table
    shared = spark.sparkContext.broadcast((b"".join(words), spans, np.asarray(ids.flatten()).astype(np.int32), sizes.astype(np.uint8), table))
    carried = list(carry or [id_col])
    kinds = {"ids": T.ArrayType(T.IntegerType()), "n_pieces": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    schema = T.StructType([*docs.select(*carried).schema.fields, *[T.StructField(o, kinds[o]) for o in outputs]])

    def run(batches):
        book = _Book(*shared.value)
        byte_kinds, shown = _kinds(book.table), _shown(book.table)
        make = {
            "ids": lambda ids, sizes: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids, pa.int32())),
            "n_pieces": lambda ids, sizes: pa.array(sizes, pa.int64()),
            "ids_sha256": lambda ids, sizes: pa.array(_digests(ids, sizes), pa.string()),
            "decoded_sha256": lambda ids, sizes: pa.array([hashlib.sha256(t).hexdigest() for t in _texts(ids, sizes, shown)], pa.string()),
        }
        for batch in batches:
            for first, past, cut in _cuts(batch.column(batch.num_columns - 1), byte_kinds):
                ids, sizes = book.ids_of(cut)
                rows = [c.slice(first, past - first) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*rows, *[make[o](ids, sizes) for o in outputs]], [*carried, *outputs])

    return docs.select(*carried, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, table: Pieces, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give null, ids outside the table and
    control pieces give nothing, broken byte sequences the replacement character."""
    names = [c for c in encoded.columns if c != into]
    schema = T.StructType([*encoded.select(*names).schema.fields, T.StructField(into, T.StringType())])
    shared = encoded.sparkSession.sparkContext.broadcast(table.shown)

    def run(batches):
        shown = pa.array([*shared.value, b""], pa.large_binary())
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            ids = np.asarray(pc.fill_null(lists.flatten(), -1))
            texts = _texts(ids, np.asarray(pc.fill_null(pc.list_value_length(lists), 0)), shown)
            column = pa.array([t.decode() if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*names, into])

    return encoded.select(*names).mapInArrow(run, schema)


def op10_piece_lattice(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids_sha256, decoded_sha256 (that of the text itself, with U+2581 as
    a space), round_trip.  Null and empty texts have no pieces and the digests of nothing."""
    table = load(model)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    with_sha = docs.withColumn("want", F.sha2(F.replace("text", F.lit(SPACE), F.lit(" ")), 256))
    coded = encode(with_sha, table, carry=["doc_id", "want"], outputs=("n_pieces", "ids_sha256", "decoded_sha256"))
    return coded.select("doc_id", "n_pieces", "ids_sha256", "decoded_sha256", (F.col("decoded_sha256") == F.col("want")).alias("round_trip"))
