"""Phrase collocations: frequent phrases found level by level with broadcast tries.

A phrase of k words can be frequent only if its first and its last k - 1 words are.  So the
candidates of level k are the pairs of frequent phrases of level k - 1 that overlap, and
their trie is that of level k - 1 with one level more.  That last level is not stored (it
would hold every pair that could meet, far more than do): a candidate's accepting state is
the pair of the states at a position and at the next one.

A pass broadcasts the trie of level k - 1 as a double array (``base``, ``check``).  A task
turns its texts into symbols and moves the states of all positions at once, one level at a
time, with numpy; accepting pairs are compacted and bincounted, and Spark sums the counts
of all tasks.  Each pass is one scan of the texts, and only counts are shuffled.

A trie has at most ``MAX_PHRASES`` phrases on either side, which bounds what is broadcast.
Where a level has more, its phrases are dealt by the words that overlap (and within one
overlap by themselves), with a pass for each block of pairs: no candidate is left out.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import passing, written

LEAST, LONGEST, TOP = 100, 5, 2000
MAX_PHRASES = 1_000_000
CHUNK_BYTES = 4 << 20
HELD = 1_000_000  # counts a task holds before it hands them on
UNKNOWN_LANG = "und"

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.ones(256, dtype=np.uint8)  # 1: of a word, 0: blank, 2: between pieces
_KIND[list(b" \t")] = 0
_KIND[list(_BREAKS)] = 2
_BLANKED = bytes(32 if kind != 1 else b for b, kind in enumerate(_KIND.tolist()))


def _chunks(batch: pa.RecordBatch):
    """(language, texts of it in UTF-8 as one, A-Z in lower case) of a batch of (lang, text)."""
    held: dict = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
        if not text:
            continue
        texts = held.setdefault(lang, [0])
        texts[0] += len(text)
        texts.append(text)
        if texts[0] >= CHUNK_BYTES:
            yield lang, b"\n".join(held.pop(lang)[1:]).lower()
    for lang, texts in held.items():
        yield lang, b"\n".join(texts[1:]).lower()


def _words(data: bytes) -> list[bytes]:
    return data.translate(_BLANKED).split()


def _symbols(data: bytes, number: dict) -> np.ndarray:
    """The symbol of each word, 0 for others and between pieces."""
    kind = _KIND[np.frombuffer(data, dtype=np.uint8)]
    word = kind == 1
    word[1:] &= kind[:-1] != 1
    words = _words(data)
    found = np.fromiter(map(number.get, words, repeat(0)), dtype=np.int32, count=len(words))
    piece = np.searchsorted(np.flatnonzero(kind == 2), np.flatnonzero(word))
    gap = np.zeros(len(words), dtype=np.int64)
    gap[1:] = np.cumsum(piece[1:] != piece[:-1])
    out = np.zeros(len(words) + (int(gap[-1]) if len(gap) else 0) + 1, dtype=np.int32)
    out[np.arange(len(words)) + gap] = found
    return out


# --- counts of words


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of a table (lang, text); the row of a null word is the language's total."""

    def run(batches):
        held: dict = {}

        def out():
            for lang, counts in held.items():
                words = pa.array([None, *counts], pa.binary()).cast(pa.string())
                n = pa.array([sum(counts.values()), *counts.values()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, n], ["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, data in _chunks(batch):
                held.setdefault(lang, Counter()).update(_words(data))
                if sum(map(len, held.values())) > HELD // 2:
                    yield from out()
        yield from out()

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


# --- the trie


class Trie:
    """A double array over paths of symbols: the child of slot s by symbol c is ``base[s] + c``
    if ``check`` of that slot is s.  ``path`` is the path that ends at a slot, or -1."""

    ROOT, DEAD = 0, 1

    def __init__(self, paths: np.ndarray):
        """``paths``: different rows of positive symbols."""
        n, depth = paths.shape
        order = np.lexsort(paths.T[::-1])
        rows = paths[order]
        symbols, parents, node, nodes = [np.zeros(1, np.int64)], [np.full(1, -1)], np.zeros(n, np.int64), 1
        for d in range(depth):
            new = np.ones(n, dtype=bool)
            new[1:] = (rows[1:, d] != rows[:-1, d]) | (node[1:] != node[:-1])
            symbols.append(rows[new, d].astype(np.int64))
            parents.append(node[new])
            node = nodes + np.cumsum(new) - 1
            nodes += int(new.sum())
        symbol, parent = np.concatenate(symbols), np.concatenate(parents)
        base = self._place(symbol, parent, nodes)
        slot = np.zeros(nodes, dtype=np.int64)
        slot[1:] = base[parent[1:]] + symbol[1:]
        size = int(max(base.max(initial=0) + paths.max(initial=0), 1)) + 2
        self.base, self.check, self.path = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent[1:]]
        self.path[slot[node]] = order

    @staticmethod
    def _place(symbol: np.ndarray, parent: np.ndarray, nodes: int) -> np.ndarray:
        """A base for each node such that no two children share a slot: parents of many
        children first, at the first of some random places where all of theirs are free."""
        draw = np.random.default_rng(7)
        span = int(symbol.max(initial=0)) + 1
        room = 3 * nodes + 64
        used = np.zeros(room + span + 1, dtype=bool)
        used[:2] = True
        base = np.zeros(nodes, dtype=np.int64)
        edges = 1 + np.argsort(parent[1:], kind="stable")
        owners, first, counts = np.unique(parent[edges], return_index=True, return_counts=True)
        several = np.flatnonzero(counts > 1)
        for k in several[np.argsort(-counts[several], kind="stable")].tolist():
            wanted, tries = symbol[edges[first[k] : first[k] + counts[k]]], 0
            while True:
                places = draw.integers(1, room, max(4, min(64, 4096 // len(wanted))))
                free = np.flatnonzero(~used[places[:, None] + wanted].any(axis=1))
                if len(free):
                    break
                tries += 1
                if tries % 16 == 0:  # too full for so many children
                    room += room // 4
                    used = np.append(used, np.zeros(room + span + 1 - len(used), dtype=bool))
            base[owners[k]] = places[free[0]]
            used[places[free[0]] + wanted] = True
        single = np.flatnonzero(counts == 1)
        wanted = symbol[edges[first[single]]]
        free = np.flatnonzero(~used)
        free = free[free > span]  # so that no base is negative
        if len(free) < len(single):
            free = np.append(free, len(used) + np.arange(len(single)))
        base[owners[single]] = free[: len(single)] - wanted
        return base

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        to = self.base[states] + symbols
        return np.where((self.check[to] == states) & (symbols > 0), to, self.DEAD)

    def ends(self, start: int, symbols: np.ndarray, depth: int) -> np.ndarray:
        """For each position the path from ``start`` that its next ``depth`` symbols spell."""
        states = np.full(len(symbols), start, dtype=np.int32)
        for d in range(depth):  # all positions together, level by level
            ahead = np.zeros(len(symbols), dtype=np.int32)
            ahead[: max(len(symbols) - d, 0)] = symbols[d:]
            states = self.step(states, ahead)
        return self.path[states]


class _Sums:
    """Counts by code, as sorted arrays."""

    def __init__(self):
        self.parts: list = []
        self.size = 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((codes, counts))
        self.size += len(codes)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes, counts = (np.concatenate(x) for x in zip(*self.parts))
        kept, place = np.unique(codes, return_inverse=True)
        out = np.zeros(len(kept), dtype=np.int64)
        np.add.at(out, place, counts)
        return kept, out


def _count_pairs(docs: DataFrame, left: list, right: list, depth: int) -> DataFrame:
    """(lang, phrase, n) of the candidates whose first words are a phrase of ``left`` and whose
    last words one of ``right``: lists of (lang, words), ``depth`` words each."""
    spark = docs.sparkSession
    every = sorted({*left, *right})
    number = {w: k + 1 for k, w in enumerate(sorted({w for _, words in every for w in words}))}
    langs = {lang: k + 1 for k, lang in enumerate(sorted({lang for lang, _ in every}))}
    trie = Trie(np.array([[langs[lang], *(number[w] for w in words)] for lang, words in every], dtype=np.int32))
    sides = (set(left), set(right))
    opens, shuts = (np.array([p in side for p in every] + [False]) for side in sides)  # the last for -1
    encoded = {w.encode(): k for w, k in number.items()}
    shared = spark.sparkContext.broadcast((trie, encoded, langs, opens, shuts))
    many = len(every)

    def run(batches):
        trie, number, langs, opens, shuts = shared.value
        sums = _Sums()

        def out():
            codes, counts = sums.total()
            sums.__init__()
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])

        for batch in batches:
            for lang, data in _chunks(batch):
                if lang not in langs:
                    continue
                start = int(trie.step(np.array([trie.ROOT]), np.array([langs[lang]]))[0])
                ends = trie.ends(start, _symbols(data, number), depth)
                hit = np.flatnonzero(opens[ends[:-1]] & shuts[ends[1:]])
                states, place = np.unique(ends[hit].astype(np.int64) * many + ends[hit + 1], return_inverse=True)
                sums.add(states, np.bincount(place, minlength=len(states)))
                if sums.size > HELD:
                    sums.parts = [sums.total()]
                    sums.size = len(sums.parts[0][0])
                    if sums.size > HELD // 2:
                        yield from out()
        yield from out()

    counted = docs.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    names = spark.createDataFrame(pa.table({"place": pa.array(range(many), pa.int64()), "lang": pa.array([p[0] for p in every], pa.string()), "phrase": pa.array([" ".join(p[1]) for p in every], pa.string())}))
    final = names.select(F.col("place").alias("last"), F.element_at(F.split("phrase", " "), -1).alias("word"))
    found = counted.select("n", F.expr(f"code div {many}L").alias("place"), F.expr(f"code % {many}L").alias("last"))
    return found.join(names, "place").join(final, "last").select("lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "n")


def _blocks(level: DataFrame, depth: int):
    """Pairs of bounded lists of (lang, words) that together hold every two phrases of
    ``level`` that may overlap."""
    words = F.split("phrase", " ")
    total = level.count()
    deals = -(-total // MAX_PHRASES) if depth > 1 else min(total, 1)

    def dealt(first: int) -> DataFrame:
        overlap = F.array_join(F.slice(words, first, depth - 1), " ") if depth > 1 else F.lit("")
        return level.withColumn("deal", F.pmod(F.xxhash64(F.col("lang") if depth > 1 else F.lit(0), overlap), F.lit(max(deals, 1))))

    lefts, rights = dealt(2), dealt(1)

    def read(side: DataFrame, deal: int, cut: int, of: int) -> list:
        part = side.where((F.col("deal") == deal) & (F.pmod(F.hash("lang", "phrase"), F.lit(of)) == cut))
        rows = part.select("lang", "phrase").toArrow()
        return [(lang, tuple(phrase.split(" "))) for lang, phrase in zip(rows["lang"].to_pylist(), rows["phrase"].to_pylist())]

    sizes = [{r["deal"]: r["count"] for r in side.groupBy("deal").count().collect()} for side in (lefts, rights)]
    for deal in range(deals):
        if not (sizes[0].get(deal) and sizes[1].get(deal)):
            continue
        cuts = [-(-size[deal] // MAX_PHRASES) for size in sizes]
        for i, j in product(*map(range, cuts)):
            yield read(lefts, deal, i, cuts[0]), read(rights, deal, j, cuts[1])


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): phrases of 1 to ``longest`` words that occur ``least`` times or more
    in a language, as (lang, phrase, k, n), and words in all of each language, as (lang, total).

    A null language is ``und``; null and empty texts have no words; repeated rows count again."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = written(word_counts(texts).where(F.col("word").isNull() | (F.col("n") >= least)), "phrase_words")
    totals = counted.where(F.col("word").isNull()).select("lang", F.col("n").alias("total"))
    level = counted.where(F.col("word").isNotNull()).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), "n")
    levels = [level]
    for k in range(2, longest + 1):
        found = [_count_pairs(texts, left, right, k - 1) for left, right in _blocks(level, k - 1) if left and right]
        if not found:
            break
        level = written(reduce(DataFrame.union, found).where(F.col("n") >= least).select("lang", "phrase", F.lit(k).alias("k"), "n"), f"phrases_{k}")
        levels.append(level)
    return reduce(DataFrame.union, levels), totals


#: floor(1000 a n / (l r)) in 38 digits: exact, and an error rather than a wrong value beyond.
SCORE = "cast((cast(1000 as decimal(4,0)) * (cast(a as decimal(18,0)) * cast(total as decimal(18,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as long)"


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 words or more of each
    language, by their weakest cut; a phrase inside a longer one that is as frequent is left out.

    Language and text are the only columns read."""
    with passing(docs.sparkSession):
        phrases, totals = frequent_phrases(docs, least, longest, lang_col, text_col)
        words = F.split("phrase", " ")
        several = phrases.where("k > 1").select("lang", "phrase", F.col("n").alias("a"), "k", words.alias("words"))
        spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda s: F.array_join(F.slice("words", s, m), " "))))
        around = several.where("k > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        kept = several.join(around, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
        cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "words", "k").select(
            "lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest")
        )
        firsts = phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
        rests = phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
        parts = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"]).join(totals, "lang")
        scored = parts.withColumn("score", F.expr(SCORE))
        best = scored.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return written(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first 2000 phrases of each language over
    every whole text of ``documents``; without a phrase that is frequent enough, no rows."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_OP13 = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents where text is not null
), words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces
), grams as (
  select lang, k, array_to_string(ws[i : i + k - 1], ' ') as phrase
  from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from words, range(1, 6) as t(k) where len(ws) >= k)
), f as (select lang, k, phrase, count(*) as n from grams group by all having count(*) >= 100
), totals as (select lang, sum(len(ws)) as n from words group by lang
), c as (select lang, k, phrase, n as a, string_split(phrase, ' ') as ws from f where k > 1
), inner_ as (
  select lang, array_to_string(ws[s : s + m - 1], ' ') as phrase, max(a) as longer
  from (select lang, ws, a, m, unnest(range(1, k - m + 2)) as s from c, range(2, 5) as t(m) where m < k) group by all
), cuts as (select c.lang, c.phrase, a, ws, k, unnest(range(1, k)) as cut from c left join inner_ i on i.lang = c.lang and i.phrase = c.phrase where longer is null or 100 * longer < 100 * a
), scored as (
  select cuts.lang, cuts.phrase, cuts.a, cut, l.n as l, r.n as r, t.n as n, (1000::hugeint * a * t.n) // (l.n::hugeint * r.n) as score
  from cuts join totals t on t.lang = cuts.lang
  join f l on l.lang = cuts.lang and l.phrase = array_to_string(cuts.ws[1 : cut], ' ')
  join f r on r.lang = cuts.lang and r.phrase = array_to_string(cuts.ws[cut + 1 : cuts.k], ' ')
), best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
"""
