"""SimHash near-duplicates with BK-trees.

A document's fingerprint is the bitwise majority of its shingles' XXH64 values.
Documents whose fingerprints differ in at most ``radius`` bits are linked, and a
group is a connected component of links.

Search.  All fingerprints never meet in one place: a BK-tree (children keyed by
their Hamming distance to the parent) is built for each *shard*, and a query
follows only edges whose distance lies within the radius of its own.  A shard is
the set of fingerprints that agree on a key.  Two kinds of key:

``blocks``   the fingerprint is cut into ``radius + 2`` blocks and the key is a pair
             of blocks.  Two fingerprints within the radius agree on at least two
             blocks (pigeonhole), so no link is lost.
``minhash``  for a similarity: 18 bands of three min-wise hashes of the shingle set.  Sets
             with a Jaccard similarity of 0.8 agree on a band but for (1 - 0.8**3)**18 = 2.5e-6,
             while texts that share a common passage only (0.1) do so in 2 % of cases.  One
             hash a key would gather all texts with a common line in a shard, whose pairs
             grow with the square of the input.

For fingerprints a shard above ``leaf`` members is dealt out as blocks and every pair of
blocks is searched, each in a task of at most ``2 * leaf`` rows, so that a hot key is
neither dropped nor gathered in one task.  A searched block returns only a spanning forest
of its links (union-find), not all pairs.

For a similarity, pairs that agree in a byte of the 64 hashes at a rate of at least the similarity
less ``LOOSE`` (3e-6 of those at 0.8 do not) are candidates, tried in the first table whose key they share in a shard of at most
``leaf`` members, and a link is a candidate whose shingle sets have the similarity.  Only
nodes with a candidate travel with their sets.  That leaves pairs that share keys of larger
shards only, be it a single one: all members of such shards are searched in blocks that differ
from table to table, which joins groups of near copies; then those outside a shard's largest
group meet all its blocks, for all other pairs are joined.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components, with_least
from .shared import written

SEED = 42
N_KEYS, BAND, N_SIGNS = 18, 3, 64  # keys are of the first 54 hashes, signs a byte of each of the 64
LOOSE = 0.25  # below the similarity: five standard deviations of the estimate
_rng = np.random.default_rng(20240229)
_ODD = (_rng.integers(0, 2**63, N_SIGNS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle, repeats included, as big-endian uint64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=">u8")
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if n <= width:
        return np.frombuffer(digest(joined, SEED), dtype=">u8")
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
    starts = np.concatenate(([0], ends[: n - width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, stops)]), dtype=">u8")


def simhash64(hashes: np.ndarray) -> int:
    """A bit is one if it is set in over half of the hashes; zero for no hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(np.ascontiguousarray(hashes[k : k + (1 << 15)]).view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _signature(hashes: np.ndarray) -> np.ndarray:
    """Min-wise hashes of the shingle set under fixed multiplications."""
    native = hashes.astype(np.uint64)
    native ^= native >> np.uint64(29)
    best = np.full(N_SIGNS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(native), 1 << 9):
        best = np.minimum(best, (native[k : k + (1 << 9), None] * _ODD).min(axis=0))
    return best


def _band_keys(best: np.ndarray) -> np.ndarray:
    """A hash of each band of min-wise hashes."""
    data, size = best.astype("<u8").tobytes(), 8 * BAND
    return np.array([xxhash.xxh64_intdigest(data[k * size : (k + 1) * size], SEED) for k in range(N_KEYS)], dtype=np.uint64).view(np.int64)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


FINGERPRINT = "row_id long, fp long"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, signs: bool = False) -> DataFrame:
    """(row_id, fp[, keys, signs, node, row]) per document.  Null, empty and all-space texts
    have fingerprint zero, texts below ``shingle`` words are one shingle.  ``node`` is a hash
    of the shingle set, ``row`` of id and text."""

    def run(batches):
        for batch in batches:
            ids, fps, keys, rest, nodes = batch.column(0), [], [], [], []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), shingle)
                fps.append(_signed(simhash64(h)))
                if signs:
                    best = _signature(h)
                    keys.append(_band_keys(best))
                    rest.append((best >> np.uint64(56)).astype(np.uint8).tobytes())
                    nodes.append(_signed(xxhash.xxh64_intdigest(_set(h), SEED)))
            columns = [ids, pa.array(fps, pa.int64())]
            names = ["row_id", "fp"]
            if signs:
                columns += [pa.array(keys, pa.list_(pa.int64())), pa.array(rest, pa.binary()), pa.array(nodes, pa.int64()), batch.column(2)]
                names += ["keys", "signs", "node", "row"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = FINGERPRINT + (", keys array<long>, signs binary, node long, row long" if signs else "")
    return docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"), _row(id_col, text_col).alias("row")).mapInArrow(run, schema)


def _row(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.lit("text"), F.col(text_col).cast("string"))


def _set(hashes: np.ndarray) -> bytes:
    """The shingle set: distinct hashes in ascending order."""
    return np.unique(hashes.astype("<u8")).tobytes()


def _sets(picked: DataFrame, shingle: int) -> DataFrame:
    """(node, signs, places, set) of rows (node, signs, places, text)."""

    def run(batches):
        for batch in batches:
            sets = [_set(shingle_hashes(text.as_py(), shingle)) for text in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(3)], pa.array(sets, pa.binary())], ["node", "signs", "places", "set"])

    rows = picked.select("node", "signs", "places", "text")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:3], T.StructField("set", T.BinaryType())]))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two ascending arrays of distinct values have the Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


class BKTree:
    """Children keyed by integer Hamming distance to the parent."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    def add(self, value: int, item: int) -> None:
        if self.root is None:
            self.root = (value, [item], {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                node[1].append(item)
                return
            child = node[2].get(d)
            if child is None:
                node[2][d] = (value, [item], {})
                return
            node = child

    def search(self, value: int, radius: int):
        """Items within ``radius``; only edges within it are followed."""
        stack = [self.root] if self.root is not None else []
        while stack:
            at, items, children = stack.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                yield from items
            for edge in range(max(1, d - radius), d + radius + 1):
                child = children.get(edge)
                if child is not None:
                    stack.append(child)


def _forest(trees: list, asks: list, same: bool, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks (or within one).
    Members are (node, fp)."""
    members = trees if same else trees + asks
    find, join = _union_find(len(members))
    tree, mask, out = BKTree(), (1 << 64) - 1, []

    def ask(i: int) -> None:
        mine = find(i)
        for j in tree.search(members[i][1] & mask, radius):
            if join(mine, j):
                out.append((members[i][0], members[j][0]))

    for i in range(len(trees)):
        if same:
            ask(i)
        tree.add(members[i][1] & mask, i)
    if not same:
        for i in range(len(trees), len(members)):
            ask(i)
    return out


def _agree(signs: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """In how many of 64 one-byte hashes each row agrees."""
    words = (signs == sign).view(np.uint64).sum(axis=1, dtype=np.uint64)  # eight flags at once: no byte exceeds eight
    return (words * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _similar_forest(trees: list, asks: list, same: bool, least: float, similarity: float) -> list[tuple[int, int]]:
    """As ``_forest``, for links by signs (node, signs, None) that agree in ``least``, or by
    sets (node, signs, set): then only links that the sets confirm join anything."""
    members = trees if same else trees + asks
    find, join = _union_find(len(members))
    signs = np.frombuffer(b"".join([m[1] for m in members]), dtype=np.uint8).reshape(-1, N_SIGNS)
    sets = [None if m[2] is None else np.frombuffer(m[2], dtype="<u8") for m in members]
    out = []
    for i in range(1 if same else len(trees), len(members)):
        mine = find(i)
        agree = _agree(signs[: i if same else len(trees)], signs[i])
        for j in np.nonzero(agree >= least * N_SIGNS)[0].tolist():
            if find(j) != mine and (sets[i] is None or similar(sets[i], sets[j], similarity)):
                join(mine, j)
                out.append((members[i][0], members[j][0]))
    return out


def _union_find(n: int):
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(root: int, x: int) -> bool:
        other = find(x)
        parent[other] = root
        return other != root

    return find, join


def _search(blocks: DataFrame, radius: int) -> DataFrame:
    """blocks: one row per pair of blocks, with arrays ``trees`` and ``asks``."""

    def run(batches):
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                same, trees, asks = (batch.column(c)[k].as_py() for c in ("same", "trees", "asks"))
                found += _forest([(x["node"], x["fp"]) for x in trees], [(x["node"], x["fp"]) for x in asks], same, radius)
            yield _pairs(found)

    return blocks.mapInArrow(run, "a long, b long")


def _pairs(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _shards(nodes: DataFrame) -> DataFrame:
    """(node, table, key, n) of shards with n > 1 members."""
    keyed = nodes.select("node", F.posexplode("keys").alias("table", "key"))
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(sizes, ["table", "key"])


def _block(parts, *of):
    return F.pmod(F.xxhash64(*of, F.lit("part")), parts).cast("int")


def links(nodes: DataFrame, radius: int, leaf: int = 512) -> DataFrame:
    """Spanning links (a, b) between nodes within ``radius``.  ``nodes`` has node, fp and
    keys (the shards it belongs to).  Shards of one member are dropped before anything else."""
    members = _shards(nodes).withColumn("parts", F.ceil(F.col("n") / leaf).cast("int")).join(nodes.select("node", "fp"), "node")
    dealt = members.withColumn("mine", _block(F.col("parts"), "node")).select("table", "key", "node", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    entry = F.struct("node", "fp")
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    grouped = (
        dealt.select("table", "key", low.alias("i"), high.alias("j"), (F.col("mine") == low).alias("tree"), entry.alias("entry"))
        .repartition("table", "key", "i", "j")  # else the join's partitioning keeps all blocks of a hot key in one task
        .groupBy("table", "key", "i", "j")
        .agg(F.collect_list(F.when(F.col("tree"), F.col("entry"))).alias("trees"), F.collect_list(F.when(~F.col("tree"), F.col("entry"))).alias("asks"))
        .select((F.col("i") == F.col("j")).alias("same"), "trees", "asks")
    )
    return _search(grouped, radius)


_PLACE = ["table", "key", "block"]


def _with_partner(groups: DataFrame, least: float) -> DataFrame:
    """(table, key, block, node) of the members that have a candidate in their group.

    ``members`` hold node, signs, keys, comp, asks and large.  In a second search candidates
    are one that asks and one that does not, of different comps; in a first search those
    that share no earlier key, but for keys of large shards (the bits of ``large``)."""

    def run(batches):
        for batch in batches:
            members = batch.column(3)
            flat = members.flatten()
            node, comp, asks, large = (np.asarray(flat.field(c)) for c in ("node", "comp", "asks", "large"))
            small = (large[:, None] >> np.arange(N_KEYS) & 1) == 0
            signs = np.frombuffer(b"".join(flat.field("signs").to_pylist()), dtype=np.uint8).reshape(-1, N_SIGNS)
            keys = np.asarray(flat.field("keys").flatten()).reshape(-1, N_KEYS)
            ends = np.append(0, np.cumsum(np.asarray(members.value_lengths()))).tolist()
            has, group = np.zeros(len(flat), dtype=bool), np.repeat(np.arange(len(members)), np.diff(ends))
            for a, b, table, second in zip(ends[:-1], ends[1:], batch.column(0).to_pylist(), batch.column(4).to_pylist()):
                trees = a + np.flatnonzero(~asks[a:b]) if second else np.arange(a, b)
                for i in (a + np.flatnonzero(asks[a:b])).tolist() if second else range(a + 1, b):
                    seen = trees if second else trees[: i - a]
                    near = seen[_agree(signs[seen] if second else signs[a:i], signs[i]) >= least * N_SIGNS]
                    near = near[comp[near] != comp[i]] if second else near[((keys[near] == keys[i]) & small[i]).argmax(axis=1) == table]
                    if len(near):
                        has[i] = has[near] = True
            at = np.flatnonzero(has)
            rows = pa.array(group[at])
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in range(3)], pa.array(node[at], pa.int64())], [*_PLACE, "node"])

    return groups.select(*_PLACE, "members", "second").mapInArrow(run, "table int, key long, block int, node long")


def _grouped(members: DataFrame, second: bool) -> DataFrame:
    entry = F.struct("node", "signs", "keys", "comp", "asks", "large")
    return members.repartition(*_PLACE).groupBy(*_PLACE).agg(F.collect_list(entry).alias("members")).withColumn("second", F.lit(second))


def _confirmed(placed: DataFrame, sets_of, least: float, similarity: float) -> DataFrame:
    """Spanning links (a, b) of the members of each place whose sets have the similarity.
    A set is made once and goes straight to all its places."""
    sets = sets_of(placed.groupBy("node").agg(F.collect_set(F.struct(*_PLACE)).alias("places")))
    dealt = sets.select("node", "signs", "set", F.explode("places").alias("place")).select("node", "signs", "set", "place.*")
    groups = dealt.repartition(*_PLACE).groupBy(*_PLACE).agg(F.collect_list(F.struct("node", "signs", "set")).alias("members")).select("members")

    def run(batches):
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                members = [(x["node"], x["signs"], x["set"]) for x in batch.column(0)[k].as_py()]
                found += _similar_forest(members, [], True, least, similarity)
            yield _pairs(found)

    return groups.mapInArrow(run, "a long, b long")


def similar_links(reps: DataFrame, sets_of, similarity: float, leaf: int = 512) -> DataFrame:
    """Spanning links (a, b) between nodes whose shingle sets have the similarity.

    ``reps``: node, keys, signs; ``sets_of`` adds signs and set to a table of different nodes,
    each in one row."""
    least = max(similarity - LOOSE, 1 / N_SIGNS)
    shards = written(_shards(reps), "shards")
    small, hot = shards.where(F.col("n") <= leaf), shards.where(F.col("n") > leaf).withColumn("parts", F.ceil(F.col("n") / leaf).cast("int"))
    large = shards.groupBy("node").agg(F.sum(F.when(F.col("n") > leaf, F.pow(F.lit(2.0), F.col("table"))).otherwise(0)).cast("int").alias("large"))
    known = reps.select("node", "signs", "keys").join(large, "node")
    alone = small.join(known, "node").withColumns({"block": F.lit(0), "comp": F.lit(0).cast("long"), "asks": F.lit(False)})
    dealt = hot.select("table", "key", _block(F.col("parts"), "node", "table").alias("block"), "node")
    placed = _with_partner(_grouped(alone, False), least).unionByName(dealt)
    found = written(_confirmed(placed, sets_of, least, similarity), "links")
    if hot.isEmpty():
        return found
    comps = connected_components(found).select("node", F.col("component").alias("comp"))
    named = hot.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = named.groupBy("table", "key", "comp").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("table", "key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most")).where("all > most")
    others = F.ceil((F.col("all") - F.col("most")) / (8 * leaf)).cast("int").alias("others")
    split = written(named.join(largest, ["table", "key"]).select("table", "key", "node", "parts", "comp", others, (F.col("comp") != F.col("main")).alias("asks")), "split")
    # a place is a block of the whole shard and a part of what is not in its largest group
    block, row, column = F.col("block"), _block(F.col("parts"), "node"), _block(F.col("others"), "node", F.lit("ask"))
    everyone = split.withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("others") - 1)), "asks": F.lit(False)}).withColumn("block", row * F.col("others") + block)
    rest = split.where("asks").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", block * F.col("others") + column)
    spread = everyone.unionByName(rest)
    more = _with_partner(_grouped(spread.join(known, "node"), True), least)
    return found.union(written(_confirmed(more, sets_of, least, similarity), "links"))


def _block_keys(radius: int):
    """Pairs of blocks of the fingerprint, each as one long."""
    n = radius + 2
    cuts = [64 * k // n for k in range(n + 1)]
    block = lambda k: F.shiftrightunsigned("fp", cuts[k]).bitwiseAND((1 << (cuts[k + 1] - cuts[k])) - 1)
    return F.array(*[F.shiftleft(block(a), cuts[b + 1] - cuts[b]).bitwiseOR(block(b)) for a, b in combinations(range(n), 2)])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, similarity: float | None = None, leaf: int = 512
) -> DataFrame:
    """(row_id, fp, component_id) per document; component_id is the least id reachable.

    With ``similarity`` None links are exactly the fingerprint pairs within ``radius``
    (shards by blocks).  With a similarity, links are the pairs whose shingle sets have that
    Jaccard similarity or more (``radius`` is not used: it would lose some).  Shards and
    candidates are by min-wise hashes; the sets of all nodes with a candidate are then
    compared in the shards, and no other link joins anything.

    Null ids take part in links but not in minima (a group of null ids has a null
    component).  Repeated rows share a group.  An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle, signs=similarity is not None), "fingerprints")
    if similarity is None:
        node = F.col("fp")
        reps = fps.select("fp").distinct().select(F.col("fp").alias("node"), "fp", _block_keys(radius).alias("keys"))
        found = written(links(reps, radius, leaf), "links")
    else:
        node = F.col("node")
        reps = written(fps.groupBy("node").agg(F.first("keys").alias("keys"), F.first("signs").alias("signs"), F.min("row").alias("row")), "nodes")

        def sets_of(asked: DataFrame) -> DataFrame:
            # a table, so that its size is known: texts are shuffled only if it is too large to broadcast
            picked = written(reps.join(asked, "node").select("row", "node", "signs", "places"), "picked")
            texts = docs.select(_row(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text")).join(picked, "row")
            return _sets(texts, shingle).dropDuplicates(["node"])

        found = similar_links(reps, sets_of, similarity, leaf)
    labels = connected_components(found)
    base = fps.select("row_id", "fp", node.alias("node"))
    least_ids = base.groupBy("node").agg(F.min("row_id").alias("component_id"))
    # nodes of more than one, whose group has the least id of them all; the others keep their own
    linked = with_least(least_ids.join(labels, "node"), "component", "component_id", "node", "least").select("node", F.col("least").alias("component_id"))
    named = written(linked.union(least_ids.join(labels, "node", "left_anti")), "named")
    return base.join(named, "node", "left").select("row_id", "fp", "component_id")


def hex16(fp):
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op3_simhash_near_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle=3, radius=2).select(F.col("row_id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), "component_id")
