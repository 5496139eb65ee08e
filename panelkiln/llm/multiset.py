"""Document fingerprints as a homomorphic multiset hash, in DataFrame functions only.

A text is a multiset of pieces: its paragraphs (lines), each cut further at sentence
ends so that texts of one paragraph have parts as well.  Every piece is hashed to a
wide vector of longs, and the fingerprint is the sum of these vectors modulo 2**60:

* ``STRONG`` lanes of 60 bits of the piece's SHA-256, for equality;
* one lane with the piece's weight (bit length of its character count);
* ``2 * STRIDE`` longs with two 30-bit counters each.  A counter adds the weight if
  the counter's bit of the piece's 64-bit hash is set, so ``2 * counter - weight`` is a
  sum of random signs and differences of such sums estimate how much two multisets
  share.

The sum does not depend on the order of pieces, and :func:`insert` and
:func:`delete` keep a fingerprint up to date without reading the text again.  A counter
has room for a billion units of weight, more than the pieces of any text that a row holds.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shuffle_partitions

STRONG, STRIDE, LANES_A_LONG, LANE_BITS = 4, 30, 2, 30
MASK = (1 << 60) - 1
_SPREAD = sum(1 << (LANE_BITS * k) for k in range(LANES_A_LONG))
WIDTH = STRONG + 1 + 2 * STRIDE
PIECE_END = r"[\n\r]+|(?<=[.!?]) +"


def pieces(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), PIECE_END), lambda p: p != "")


def insert(fp: Column, other: Column) -> Column:
    """The fingerprint of the union of two multisets."""
    return F.zip_with(fp, other, lambda a, b: (a + b).bitwiseAND(MASK))


def delete(fp: Column, other: Column) -> Column:
    """The fingerprint without the pieces of ``other``."""
    return F.zip_with(fp, other, lambda a, b: (a - b).bitwiseAND(MASK))


def fingerprint(text: Column) -> Column:
    """array<long> of ``WIDTH`` lanes; null and empty texts are all zero."""
    weight = lambda p: F.length(F.bin(F.length(p).cast("long"))).cast("long")
    parts = lambda s: [F.conv(F.substring(s, 1 + 15 * k, 15), 16, 10).cast("long") for k in range(STRONG)]
    names = [f"s{k}" for k in range(STRONG)]
    hashed = F.transform(pieces(text), lambda p: F.struct(F.xxhash64(p).alias("h"), F.xxhash64(p, F.lit(1)).alias("g"), weight(p).alias("w"), F.sha2(p, 256).alias("s")))
    wide = F.transform(hashed, lambda p: F.struct(p["h"].alias("h"), p["g"].alias("g"), p["w"].alias("w"), *[x.alias(n) for x, n in zip(parts(p["s"]), names)]))
    zero = F.lit(0).cast("long")
    strong = lambda ps, n: F.aggregate(ps, zero, lambda acc, p: (acc + p[n]).bitwiseAND(MASK))
    counter = lambda ps, h, k: F.aggregate(ps, zero, lambda acc, p: acc + F.shiftrightunsigned(p[h], k).bitwiseAND(_SPREAD) * p["w"])
    sums = F.transform(F.array(wide), lambda ps: F.array(*[strong(ps, n) for n in [*names, "w"]], *[counter(ps, h, k) for h in ("h", "g") for k in range(STRIDE)]))
    return F.element_at(sums, 1)


def as_hex(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 15, "0")), ""))


def _signs(fp: Column) -> Column:
    """The signed sums behind the counters."""
    weight = F.element_at(fp, STRONG + 1)
    lanes = F.flatten(
        F.transform(F.slice(fp, STRONG + 2, 2 * STRIDE), lambda x: F.array(*[F.shiftright(x, LANE_BITS * k).bitwiseAND((1 << LANE_BITS) - 1) for k in range(LANES_A_LONG)]))
    )
    return F.transform(lanes, lambda c: (c * 2 - weight).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, about 0 for texts without a common piece:
    one less the squared distance over the sum of squared lengths, within 0 and 1."""
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    u, v = _signs(a), _signs(b)
    apart, total = square(F.zip_with(u, v, lambda x, y: x - y)), square(u) + square(v)
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - apart / total))
    return F.when(a == b, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(near)


def _count_below(key: Column, cuts: list[tuple[int, int, int]]) -> Column:
    """How many cuts are at or below the key, found in two steps of about sqrt(n)."""
    if not cuts:
        return F.lit(0)
    literal = lambda c: F.struct(F.lit(c[0]).alias("some"), F.lit(c[1]).cast("long").alias("id"), F.lit(c[2]).cast("long").alias("tie"))
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    coarse = F.size(F.filter(F.array(*[literal(g[0]) for g in groups]), lambda c: c <= key))
    fine = F.size(F.filter(F.element_at(F.array(*[F.array(*map(literal, g)) for g in groups]), F.greatest(coarse, F.lit(1))), lambda c: c <= key))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + fine)


def _cuts(ids: DataFrame, n: int) -> list[tuple[int, int, int]]:
    """At most ``2 * n`` cuts between ranges of about equal size: (0 for null ids, id, tie).
    An id (or null) that fills several ranges is cut by its rows' ties, which are hashes."""
    facts = ids.agg(F.count("*").alias("n"), F.count("i").alias("some"), F.min("i").alias("least")).first()
    slices = lambda r: [-(2**63) + (2**64 * k) // r for k in range(1, r)]
    cuts = [(0, 0, x) for x in slices(1 + (facts["n"] - facts["some"]) * n // max(1, facts["n"]))]
    if facts["some"]:
        for value, r in sorted(Counter(map(int, ids.stat.approxQuantile("i", [k / n for k in range(1, n)], 0.25 / n))).items()):
            first = [] if value == facts["least"] and facts["n"] == facts["some"] else [(1, value, -(2**63))]
            cuts += [*first, *[(1, value, x) for x in slices(r)]]
    return cuts


def with_next(docs: DataFrame, id_col: str, columns: list[str], tie: str) -> DataFrame:
    """``docs`` with ``next_<c>``: each column of the next row in ascending id order, of
    the first row after the last.  Null ids come first, equal ids in the order of ``tie`` (of
    its hash, for an id or null that fills several ranges); the only row of a table is its
    own next one.

    The rows are cut into ranges at quantiles (a number for each shuffle partition, so
    bounded), each range is a window, and the first row of a range is also sent to the
    range before it, so no row waits for a single global window, whatever repeats."""
    i = F.col(id_col).cast("long")
    cuts = _cuts(docs.select(i.alias("i")), 4 * shuffle_partitions(docs.sparkSession))
    hot = [c[1] for c in cuts if c[0] and c[2] > -(2**63)]
    sliced = i.isin(sorted(set(hot))) if hot else F.lit(False)
    sliced = F.coalesce(sliced, F.lit(any(not c[0] for c in cuts)))
    key = F.struct(i.isNotNull().cast("int").alias("some"), F.coalesce(i, F.lit(0)).alias("id"), F.when(sliced, F.xxhash64(tie)).otherwise(F.lit(0).cast("long")).alias("tie"))
    keyed = docs.withColumns({"_key": key, "_row": F.monotonically_increasing_id()}).withColumn("_range", _count_below(F.col("_key"), cuts))
    firsts = sorted((r["_range"], r["row"]) for r in keyed.groupBy("_range").agg(F.min_by("_row", F.struct("_key", tie, "_row")).alias("row")).collect())  # a row for each range
    before, first = [-1] * (len(cuts) + 1), [-1] * (len(cuts) + 1)
    for (k, row), previous in zip(firsts, [firsts[-1], *firsts[:-1]] if firsts else []):
        before[k], first[k] = previous[0], row
    at = lambda values: F.element_at(F.lit(values), F.col("_range") + 1)
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("extra"))
    other = F.when(F.col("_row") == at(first), F.struct(at(before).alias("range"), F.lit(1).alias("extra")))
    dealt = keyed.withColumn("_place", F.explode(F.array_compact(F.array(own, other))))
    w = Window.partitionBy(F.col("_place.range")).orderBy(F.col("_place.extra"), "_key", F.col(tie).asc_nulls_first(), "_row")
    ahead = dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return ahead.where("_place.extra = 0").drop("_place", "_key", "_row", "_range")


def op5_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text is empty.  The only document of a table is its own next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs.withColumn("fp", fingerprint(F.col("text"))), "doc_id", ["text", "fp"], "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = pairs.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half)))
    scored = edited.withColumn("efp", fingerprint(F.col("edited")))
    return scored.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
