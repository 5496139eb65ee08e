"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier over character n-grams predicts each
bit, and the language whose codeword has the least weighted logistic loss wins.

A bit's classifier is the log ratio of hashed 1- to 3-gram frequencies between the
languages with and without the bit (languages weigh alike, whatever their number of
documents), so training is one distributed count of n-grams by language over *all*
labelled rows; what reaches the driver is ``languages x DIM`` counts at most.  A bit weighs as
much in decoding as its two sides differ.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import held_out

DIM = 1 << 14
AMBIGUOUS_GAP = 0.2
UNKNOWN = "und"
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def gram_counts(text: str | None) -> tuple[np.ndarray, int]:
    """Counts of hashed 1- to 3-grams of lower-case letters (all else is a space), and
    the number of letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    known = _is_letter()[points]
    letters = int(known.sum())
    if not letters:
        return np.zeros(DIM, dtype=np.int64), 0
    x = np.zeros(len(points) + 2, dtype=np.uint32)
    x[1:-1] = np.where(known, points, 0)
    one = x * np.uint32(2654435761)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(3266489917) + one[2:]
    a, b, c = one[x > 0], two[(x[:-1] | x[1:]) > 0], three[x[1:-1] > 0]
    grams = np.concatenate((a ^ np.uint32(0x9E3779B9), b ^ np.uint32(0x85EBCA6B), c))
    grams ^= grams >> np.uint32(16)
    return np.bincount(grams & np.uint32(DIM - 1), minlength=DIM), letters


def codewords(n: int) -> np.ndarray:
    """(languages, bits) of +-1: all distinct splits for few languages, all balanced ones
    for 7 and 8, else 48 seeded random splits (more from 4096 languages on); each bit has
    languages on both sides and no two languages have the same word."""
    if n < 2:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 6:
        rows = np.array([[1 if (k >> i) & 1 else -1 for k in range(1, 2 ** (n - 1))] for i in range(n - 1)] + [[-1] * (2 ** (n - 1) - 1)], dtype=np.int8)
        return rows
    rng, bits = np.random.default_rng(7), []
    if n <= 8:
        rows = [[1 if k in part else -1 for k in range(n)] for part in combinations(range(n), n // 2) if n % 2 or 0 in part]
        return np.array(rows, dtype=np.int8).T
    while len(bits) < max(48, 4 * n.bit_length()) or len({tuple(w) for w in np.array(bits).T.tolist()}) < n:
        bit = rng.permutation(np.where(np.arange(n) < n // 2, 1, -1))
        if not any(abs(int(bit @ b)) == n for b in bits):
            bits.append(bit)
    return np.array(bits, dtype=np.int8).T


@dataclass(frozen=True)
class LanguageCodes:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray  # (DIM, bits)
    trust: np.ndarray  # of each bit

    def decode(self, counts: np.ndarray, letters: int) -> tuple[str, float, bool]:
        if not letters or not self.languages:
            return UNKNOWN, 0.0, False
        n = counts.sum()
        margin = counts @ self.weights / n * np.sqrt(n)
        loss = (self.trust * np.logaddexp(0.0, -self.codes * np.clip(margin, -30, 30))).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        gap = p[order[0]] - p[order[1]] if len(p) > 1 else 1.0
        return self.languages[order[0]], float(p[order[0]]), bool(gap < AMBIGUOUS_GAP)


def _fit(languages: list[str], counts: np.ndarray) -> LanguageCodes:
    codes = codewords(len(languages))
    if len(languages) < 2:
        return LanguageCodes(languages, codes, np.zeros((DIM, 1)), np.ones(1))
    frequency = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * DIM)
    weights, trust = [], []
    for bit in codes.T:
        yes, no = frequency[bit > 0].mean(axis=0), frequency[bit < 0].mean(axis=0)
        ratio = np.log(yes) - np.log(no)
        weights.append(ratio)
        trust.append(float(((yes - no) * ratio).sum()))
    trust_of = np.array(trust)
    return LanguageCodes(languages, codes, np.array(weights).T, trust_of / trust_of.mean())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageCodes:
    """Learn every label of the rows that are not held out and have a letter, however rare.
    Null, empty and letterless texts add nothing; without labelled rows every text is
    unknown."""
    labelled = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        sums = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts, letters = gram_counts(text.as_py())
                if letters:
                    sums[lang] = sums[lang] + counts if lang in sums else counts.copy()
        for lang, counts in sums.items():
            at = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "gram", "n"])

    rows = labelled.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(pc.unique(rows["lang"]).to_pylist()))
    counts, place = np.zeros((len(languages), DIM)), {x: k for k, x in enumerate(languages)}
    if rows.num_rows:
        counts[np.array([place[x] for x in rows["lang"].to_pylist()]), rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return _fit(languages, counts)


def identify(docs: DataFrame, model: LanguageCodes, text_col: str = "text", prefix: str = "lang_", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with <prefix>pred, <prefix>score and <prefix>ambiguous from the whole text.
    A null text or one without a letter is ``und`` with score 0."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [f"{prefix}pred", f"{prefix}score", f"{prefix}ambiguous"]
    carried = [c for c in (docs.columns if carry is None else carry) if c not in names]
    kept = docs.select(*carried, F.col(text_col).cast("string").alias("_text"))
    more = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())]
    schema = T.StructType([*docs.select(*carried).schema.fields, *more])

    def run(batches):
        codes = shared.value
        for batch in batches:
            found = [codes.decode(*gram_counts(t.as_py())) for t in batch.column(batch.num_columns - 1)]
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*carried, *names])

    return kept.mapInArrow(run, schema)


def op4_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs)
    named = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model, carry=["doc_id", "held_out"])
    return named.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
