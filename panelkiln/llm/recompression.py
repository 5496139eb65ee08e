"""Exact removal of long repeats by recompression.

A word is removed if some window of ``WINDOW`` consecutive words around it also starts
anywhere else.  Comparing every window with every other is avoided by *recompression*:

Rounds.  A document is a string of symbols, at first one for each word.  A round names
short runs of a symbol (first round) and pairs: a symbol's name decides whether it is a
left or a right one in this round, and a left symbol followed by a right one becomes a
new symbol.  Names are 64-bit hashes of what they stand for, so all tasks give the same
name to the same run or pair without asking each other; two words of a symbol's
neighbourhood decide, so equal passages get equal symbols but near their ends.

Reveal.  From each symbol the shortest row of symbols with at least ``COVER`` words is
an *anchor*.  With runs of at most two words, symbols of at most ``MAX_SYMBOL`` = 4 and
three rounds, an end of a passage spoils at most 2+2, 3 and 3 words, so the inner
35 - 20 = 15 words of two equal windows have the same symbols and hold a whole anchor
(12 + 3 words): no repeat is missed.  Anchors meet in buckets by their hash; only the
windows around anchors that occur twice go on.

Verify.  Those windows are hashed whole, twice, from two independent hashes of each word:
64 bits, and other bits that choose the bucket in which they meet; what occurs once is
given back to its shard, the rest is removed.  The words of windows that meet are not
compared.  Two different windows count as equal only if both hashes agree: with a bucket for each
8 MB, that is 64 + 23 bits at 100 TB, for some 5e12 candidate windows 0.1 expected in all
(and less than one within a shard, where 64 bits decide).

Shuffles carry packed 8-byte hashes of a (bucket, shard) cell, not rows.  What repeats
inside a task is known there: it goes to its bucket once, so that a passage found in a
third of all documents is no hot key.  Shards and buckets are dealt by hashes and their
number follows the input's size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import shuffle_partitions, written

WINDOW, COVER, ROUNDS, MAX_SYMBOL, MAX_RUN = 35, 12, 3, 4, 2
SHARD_BYTES, CHUNK_BYTES, FLUSH = 8 << 20, 1 << 20, 500_000
U = np.uint64
_P, _Q = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
_R = U(0xA0761D6478BD642F)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: U, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    if n:
        out[0] = U(1)
    return np.cumprod(out, dtype=U)


def _range_hash(values: np.ndarray, first: np.ndarray, past: np.ndarray, base: U = _Q) -> np.ndarray:
    """A hash of values[first:past] for each pair, from one prefix sum."""
    n = len(values)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(values * _powers(base, n), out=total[1:])
    inverse = U(pow(int(base), -1, 1 << 64))
    return _mix((total[past] - total[first]) * _powers(inverse, n + 1)[first] ^ past.astype(U) - first.astype(U))


def _word_names(data: bytes, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word.  A word's bytes are mixed into the state
    eight at a time, each step by a bijection of both, so that no algebra of the letters is
    left: words of eight bytes or less never share a name with another of their length."""
    padded = np.frombuffer(data + bytes(16), dtype=np.uint8)
    blocks = np.ndarray(len(data) + 8, dtype="<u8", buffer=padded.data, strides=(1,))
    names = tuple(_mix(length.astype(U) * _Q ^ seed) for seed in (_P, _R))
    at, left, open_ = start.copy(), length.copy(), np.arange(len(start))
    while len(open_):
        block = blocks[at].astype(U)
        part = left < 8
        block[part] &= (U(1) << (left[part].astype(U) * U(8))) - U(1)
        for name in names:
            name[open_] = _mix(name[open_] ^ block) + _Q
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    return names


class Words:
    """The words of some documents: byte ranges in ``data``, document numbers, names (and
    ``other``, names of another seed)."""

    def __init__(self, texts: list[bytes]):
        self.data = b"".join(texts)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.offset = np.concatenate(([0], np.cumsum(sizes)))
        raw = np.frombuffer(self.data, dtype=np.uint8)
        word = ~_SPACE[raw]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        edges = self.offset[:-1][sizes > 0]
        begins[edges] = word[edges]
        self.start = np.nonzero(begins)[0]
        self.doc = np.searchsorted(self.offset, self.start, side="right") - 1
        count = np.bincount(self.doc, minlength=len(texts)) if len(self.start) else np.zeros(len(texts), dtype=np.int64)
        self.count = count.astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        at = np.nonzero(word)[0]
        if len(self.start):
            head = np.searchsorted(at, self.start)
            length = np.diff(np.append(head, len(at)))
            self.end = self.start + length
            self.name, self.other = _word_names(self.data, self.start, length)
        else:
            self.end, self.name, self.other = self.start, np.empty(0, dtype=U), np.empty(0, dtype=U)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first word, past last word) of each anchor in documents of a window or more."""
        use = np.nonzero(self.count[self.doc] >= WINDOW)[0] if len(self.doc) else np.empty(0, dtype=np.int64)
        name, doc, size, begin = self.name[use], self.doc[use], np.ones(len(use), dtype=np.int64), use
        name, doc, size, begin = _runs(name, doc, size, begin)
        for r in range(ROUNDS):
            name, doc, size, begin = _pairs(name, doc, size, begin, r)
        if not len(name):
            return name, begin, begin
        total = np.concatenate(([0], np.cumsum(size)))
        past = np.searchsorted(total, total[:-1] + COVER)
        inside = past < len(total)
        last = np.minimum(past, len(name)) - 1
        inside &= doc[last] == doc
        i, j = np.nonzero(inside)[0], past[inside]
        return _range_hash(name, i, j), begin[i], begin[j - 1] + size[j - 1]

    def windows(self, at: np.ndarray) -> np.ndarray:
        return _range_hash(_mix(self.name ^ _P), at, at + WINDOW)

    def window_buckets(self, at: np.ndarray) -> np.ndarray:
        """Bits of the windows that windows() does not depend on."""
        return _range_hash(_mix(self.other + _R), at, at + WINDOW, _R)


def _runs(name, doc, size, begin):
    """Name the maximal runs of one symbol that have at most MAX_RUN words."""
    n = len(name)
    if n < 2:
        return name, doc, size, begin
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    head = np.nonzero(fresh)[0]
    length = np.diff(np.append(head, n))
    short = (length > 1) & (length * size[head] <= MAX_RUN)
    name, size, keep = name.copy(), size.copy(), np.ones(n, dtype=bool)
    h, k = head[short], length[short]
    name[h] = _mix(name[h] * U(3) + k.astype(U))
    size[h] *= k
    for step in range(1, MAX_RUN):
        keep[(h + step)[k > step]] = False
    return name[keep], doc[keep], size[keep], begin[keep]


def _pairs(name, doc, size, begin, r):
    """Name the pairs of a left and a right symbol of this round."""
    n = len(name)
    if n < 2:
        return name, doc, size, begin
    left = (_mix(name + U(0x632BE59BD9B4E019 * (r + 1) & (2**64 - 1))) & U(1)).astype(bool)
    pair = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1]) & (size[1:] + size[:-1] <= MAX_SYMBOL)
    i = np.nonzero(pair)[0]
    name, size, keep = name.copy(), size.copy(), np.ones(n, dtype=bool)
    name[i] = _mix(name[i] * U(5) + _mix(name[i + 1] + U(r + 1)))
    size[i] += size[i + 1]
    keep[i + 1] = False
    return name[keep], doc[keep], size[keep], begin[keep]


def _bytes(column) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    binary = column.cast(pa.binary())
    return [x if x is not None else b"" for x in binary.to_pylist()]


def _in_blobs(rows: DataFrame) -> DataFrame:
    """(shard, blob): the rows of a shard in one Arrow batch, as a zstd-compressed stream.
    Texts travel at half the size that the shuffle's own codec gives."""

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            order = np.argsort(shard, kind="stable")
            cuts = np.append(np.nonzero(np.append(True, np.diff(shard[order]) != 0))[0], len(order)) if len(order) else []
            shards, blobs = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(batch.take(pa.array(order[a:b])))
                shards.append(int(shard[order[a]]))
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    return rows.mapInArrow(run, "shard int, blob binary")


def _from_blobs(table: pa.Table) -> pa.Table | None:
    """The rows of _in_blobs; None for no blob."""
    parts = [pa.ipc.open_stream(b).read_all() for b in table["blob"].to_pylist()]
    return pa.concat_tables(parts) if parts else None


def _chunks(texts: list[bytes]):
    """Row ranges of about CHUNK_BYTES."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


CELL = "bucket int, shards binary, known binary, hashes binary"
_CELL_NAMES = ["bucket", "shards", "known", "hashes"]


def _packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Binary values: the pieces of ``values`` that begin at ``first``."""
    offsets = (np.append(first, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _cells(bucket: np.ndarray, shard: np.ndarray, known: np.ndarray, hashes: np.ndarray) -> list[pa.Array]:
    """Columns of CELL: one row for each bucket, its hashes packed in the order of shards."""
    order = np.argsort((bucket.astype(np.int64) << np.int64(32)) | shard.astype(np.int64), kind="stable")
    bucket = bucket[order]
    first = np.nonzero(np.append(True, bucket[1:] != bucket[:-1]))[0] if len(bucket) else np.empty(0, dtype=np.int64)
    parts = (shard[order].astype(np.int32), known[order].astype(np.uint8), hashes[order])
    return [pa.array(bucket[first].astype(np.int32)), *[_packed(x, first) for x in parts]]


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, shard, known) of all cells of a table."""
    whole = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), dtype=kind)  # noqa: E731
    return whole("hashes", U), whole("shards", np.int32), whole("known", np.uint8).astype(bool)


def _meet(cells: DataFrame, buckets: int, repeated: bool) -> DataFrame:
    """(shard, hashes): for each shard its hashes that occur more than once anywhere
    (``repeated``) or exactly once.  Groups from ``buckets`` on hold, by shard, what a
    task already knew to repeat, and are only handed on."""

    def run(table):
        bucket = table["bucket"][0].as_py()
        hashes, shard, known = _unpacked(table)
        if bucket < buckets:
            values, place, count = np.unique(hashes, return_inverse=True, return_counts=True)
            many = count > 1
            many[place[known]] = True
            keep = (many[place] if repeated else ~many[place]) & ~known
            hashes, shard = hashes[keep], shard[keep]
        order = np.argsort(shard, kind="stable")
        shard, hashes = shard[order], hashes[order]
        first = np.nonzero(np.append(True, shard[1:] != shard[:-1]))[0] if len(shard) else np.empty(0, dtype=np.int64)
        return pa.table([pa.array(shard[first]), _packed(hashes, first)], names=["shard", "hashes"])

    return cells.groupBy("bucket").applyInArrow(run, "shard int, hashes binary")


def _to_buckets(hashes: np.ndarray, shard: np.ndarray, buckets: int, chosen_by: np.ndarray, direct: bool):
    """Cells: each distinct hash once to the bucket that ``chosen_by`` says and, if
    ``direct``, what repeats here to every shard that has it."""
    values, index, place, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    many = count > 1
    bucket = ((chosen_by[index] >> U(11)) % U(buckets)).astype(np.int64)
    yield _cells(bucket, shard[index], many.astype(np.int64), values)
    at = np.nonzero(many[place])[0]
    if direct and len(at):
        order = at[np.lexsort((hashes[at], shard[at]))]
        h, s = hashes[order], shard[order]
        new = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]))
        h, s = h[new], s[new]
        yield _cells(buckets + s.astype(np.int64), s, np.ones(len(h), dtype=np.int64), h)


def _reveal(docs: DataFrame, buckets: int) -> DataFrame:
    """Cells of the anchors of all documents."""

    def run(batches):
        for batch in batches:
            texts, shards = _bytes(batch.column(1)), batch.column(0).to_numpy()
            found, of, n = [], [], 0
            for a, b in _chunks(texts):
                words = Words(texts[a:b])
                h, begin, _ = words.anchors()
                found.append(h)
                of.append(shards[a:b][words.doc[begin]])
                n += len(h)
                if n and (n >= FLUSH or b == len(texts)):
                    hashes = np.concatenate(found)
                    for columns in _to_buckets(hashes, np.concatenate(of), buckets, _mix(hashes + U(1)), True):
                        yield pa.RecordBatch.from_arrays(columns, _CELL_NAMES)
                    found, of, n = [], [], 0

    return docs.select("shard", "text").mapInArrow(run, CELL)


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _shard_hashes(table) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(table["hashes"].to_pylist()), dtype=U))


def _candidate_windows(words: Words, shared: np.ndarray) -> np.ndarray:
    """First words of the windows that hold a shared anchor."""
    hashes, begin, past = words.anchors()
    hit = _member(hashes, shared)
    begin, past = begin[hit], past[hit]
    doc = words.doc[begin]
    low = np.maximum(words.first[doc], past - WINDOW)
    high = np.minimum(begin, words.first[doc + 1] - WINDOW)
    good = low <= high
    mark = np.zeros(len(words.start) + 1, dtype=np.int64)
    np.add.at(mark, low[good], 1)
    np.add.at(mark, high[good] + 1, -1)
    return np.nonzero(np.cumsum(mark)[:-1] > 0)[0]


def _ranges(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers as ranges [a, b)."""
    if not len(at):
        return at, at
    cut = np.nonzero(np.diff(at) > 1)[0]
    return at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1


def _without(words: Words, k: int, gone: np.ndarray, as_text: bool) -> bytes:
    """Document k without the words flagged in ``gone`` (of all words): its other bytes,
    or its other words joined by one space."""
    a, b = words.first[k], words.first[k + 1]
    flags = gone[a:b]
    if not as_text:
        keep = np.nonzero(~flags)[0] + a
        return b" ".join([words.data[s:e] for s, e in zip(words.start[keep].tolist(), words.end[keep].tolist())])
    low, high = words.offset[k], words.offset[k + 1]
    out, at = [], low
    for x, y in zip(*_ranges(np.nonzero(flags)[0] + a)):
        out.append(words.data[at : words.start[x]])
        at = words.end[y - 1]
    out.append(words.data[at:high])
    return b"".join(out)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, result: str = "text") -> DataFrame:
    """``carry`` (default: the id) and n_words, n_removed and the kept part of each row.

    ``result`` "text" adds kept_text, the text without the removed words (untouched if
    none is removed); "sha256" adds kept_sha256 of the kept words joined by one space.
    Windows are judged on the input.  Null and empty texts have no words; texts below 35
    words have no window; equal rows repeat each other, so lose all their windows (rows
    with the same id and the same long text are one shard).
    """
    spark, as_text = docs.sparkSession, result == "text"
    carried = list(carry or [id_col])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    parts = max(shuffle_partitions(spark), -(-int(size) // SHARD_BYTES))
    packs = [f"_c{k}" for k in range(len(carried))]  # names that no column of a table has
    # texts too short for a window may be anywhere, so that many empty ones of one id are no hot shard
    dealt = F.when(F.octet_length(text) < 2 * WINDOW - 1, F.monotonically_increasing_id()).otherwise(F.xxhash64(F.col(id_col), text))
    source = docs.select(*[F.col(c).alias(p) for c, p in zip(carried, packs)], F.pmod(dealt, F.lit(parts)).cast("int").alias("shard"), text.alias("text"))
    shared = _meet(_reveal(source, parts), parts, repeated=True)
    carry_schema = [T.StructField(p, source.schema[p].dataType) for p in packs]
    kept = T.StructField("kept", T.StringType())
    done_schema = [*carry_schema, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), kept]
    rest_schema = [T.StructField("shard", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("ranges", T.BinaryType())]
    cell_schema = [T.StructField("bucket", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in _CELL_NAMES[1:]]]
    judged_schema = T.StructType([*done_schema, *rest_schema, *cell_schema])
    names = [f.name for f in judged_schema]
    judged_type, done_type = to_arrow_schema(judged_schema), to_arrow_schema(T.StructType(done_schema))

    def finish(data: bytes) -> str:
        return data.decode("utf-8", "replace") if as_text else hashlib.sha256(data).hexdigest()

    def table_of(columns: dict, n: int, types) -> pa.Table:
        return pa.table([columns.get(c, pa.nulls(n, types[c])) for c in names], names=names)

    def judge(left, right):
        """Finished rows of documents without a candidate window, the others with theirs,
        and the cells of all candidate windows."""
        left = _from_blobs(left)
        if left is None:
            return judged_type.empty_table()
        types = {p: left[p].type for p in packs} | {"n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string(), "shard": pa.int32(), "text": pa.string(), "ranges": pa.binary(), "bucket": pa.int32()} | {c: pa.binary() for c in _CELL_NAMES[1:]}  # fmt: skip
        known, texts, out = _shard_hashes(right), _bytes(left["text"]), []
        windows, choices = [], []
        for a, b in _chunks(texts):
            words = Words(texts[a:b])
            at = _candidate_windows(words, known)
            windows.append(words.windows(at))
            choices.append(words.window_buckets(at))
            has = np.zeros(b - a, dtype=bool)
            has[words.doc[at]] = True
            clean, open_ = np.nonzero(~has)[0], np.nonzero(has)[0]
            if len(clean):
                ends = [finish(texts[a + k] if as_text else b" ".join(texts[a + k].split())) for k in clean.tolist()]
                rows = {p: left[p].take(pa.array(clean + a)) for p in packs} | {"n_words": pa.array(words.count[clean]), "n_removed": pa.array(np.zeros(len(clean), dtype=np.int64)), "kept": pa.array(ends, pa.string())}
                out.append(table_of(rows, len(clean), types))
            if len(open_):
                packed = []
                split = np.searchsorted(at, np.stack((words.first[open_], words.first[open_ + 1])))
                for k, (x, y) in zip(open_.tolist(), split.T.tolist()):
                    packed.append(np.stack(_ranges(at[x:y] - words.first[k])).astype("<i8").tobytes())
                rows = {p: left[p].take(pa.array(open_ + a)) for p in packs} | {"shard": left["shard"].slice(0, 1).take(pa.array([0] * len(open_))), "text": left["text"].take(pa.array(open_ + a)), "ranges": pa.array(packed, pa.binary())}
                out.append(table_of(rows, len(open_), types))
        hashes = np.concatenate(windows or [np.empty(0, dtype=U)])
        if len(hashes):
            shard = np.full(len(hashes), left["shard"][0].as_py(), dtype=np.int64)
            for columns in _to_buckets(hashes, shard, parts, np.concatenate(choices), False):
                rows = dict(zip(_CELL_NAMES, columns))
                out.append(table_of(rows, len(columns[0]), types))
        return pa.concat_tables(out) if out else table_of({}, 0, types)

    judged = written(_in_blobs(source).groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(judge, judged_schema), "judged")
    cells = judged.where("bucket is not null").select(*_CELL_NAMES)
    unique = _meet(cells, parts, repeated=False)

    def settle(left, right):
        left = _from_blobs(left)
        if left is None:
            return done_type.empty_table()
        once, texts = _shard_hashes(right), _bytes(left["text"])
        ranges, ends, total, removed = left["ranges"].to_pylist(), [], [], []
        for a, b in _chunks(texts):
            words = Words(texts[a:b])
            pairs = np.concatenate([np.frombuffer(ranges[a + k], dtype="<i8").reshape(2, -1) + words.first[k] for k in range(b - a)], axis=1)
            inside = np.zeros(len(words.start) + 1, dtype=np.int64)
            np.add.at(inside, pairs[0], 1)
            np.add.at(inside, pairs[1], -1)
            at = np.nonzero(np.cumsum(inside)[:-1])[0]
            at = at[~_member(words.windows(at), once)]
            gone = np.zeros(len(words.start) + 1, dtype=np.int64)
            gone[at] += 1
            gone[at + WINDOW] -= 1
            flags = np.cumsum(gone)[:-1] > 0
            for k in range(b - a):
                ends.append(finish(_without(words, k, flags, as_text)))
                removed.append(int(flags[words.first[k] : words.first[k + 1]].sum()))
            total += words.count.tolist()
        columns = [*[left[p] for p in packs], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(ends, pa.string())]
        return pa.table(columns, names=[*packs, "n_words", "n_removed", "kept"])

    pending = judged.where("ranges is not null").select(*packs, "shard", "text", "ranges")
    settled = _in_blobs(pending).groupBy("shard").cogroup(unique.groupBy("shard")).applyInArrow(settle, T.StructType(done_schema))
    done = judged.where("n_words is not null").select(*packs, "n_words", "n_removed", "kept")
    named = [F.col(p).alias(c) for c, p in zip(carried, packs)]
    return done.unionByName(settled).select(*named, "n_words", "n_removed", F.col("kept").alias("kept_text" if as_text else "kept_sha256"))


def op9_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and the digest of the kept ones of every document; null and
    empty texts have none and the digest of nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs, result="sha256")


# Windows by hash join; for tables of a size that DuckDB holds.
ORACLE_OP9 = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[ 	

]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS h
  FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)
), d AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1
), e AS (
  SELECT r, unnest(range(1, len(words) + 1)) AS j, unnest(words) AS word FROM w
), g AS (
  SELECT e.r, e.j, e.word,
         coalesce(sum(CASE WHEN d.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY e.r ORDER BY e.j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM e LEFT JOIN d ON d.r = e.r AND d.i = e.j
), k AS (
  SELECT r, count(*) AS n_words, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone), '') AS kept
  FROM g GROUP BY r
)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.r = k.r
"""
