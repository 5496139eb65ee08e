import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelkiln.llm import langid, multiset, packing, quality, recompression, sentencepieces, simhash, stages

SF = "/root/testdata/sf0.001"


# --- fingerprints and near-duplicates


def test_simhash_of_words():
    assert simhash.simhash64(simhash.shingle_hashes(None, 3)) == 0
    assert len(simhash.shingle_hashes("a b", 3)) == 1 and len(simhash.shingle_hashes("a b a b a", 3)) == 3
    assert simhash.shingle_hashes("A\tB  c", 3)[0] == simhash.shingle_hashes("a b c", 3)[0]


def test_native_hash_is_sparks(spark):
    want = spark.range(1).select(F.xxhash64(F.lit("ein zwei drei"))).first()[0] & (2**64 - 1)
    assert int(simhash.shingle_hashes("ein zwei drei", 3)[0]) == want


def test_bk_tree_against_all_pairs():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(5)]
    for radius in (0, 2, 9):
        tree = simhash.BKTree()
        for i, v in enumerate(values):
            tree.add(v, i)
        for v in values[::7]:
            assert sorted(tree.search(v, radius)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= radius]


@pytest.mark.parametrize("leaf", [512, 3])
def test_groups_against_brute_force(spark, leaf):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(20)]
    fps += [f ^ (1 << rng.randrange(64)) for f in fps for _ in range(4)] + [0] * 9
    d = spark.createDataFrame([(i, simhash._signed(f)) for i, f in enumerate(fps)], "row_id long, fp long")
    nodes = d.select("fp").distinct().select(F.col("fp").alias("node"), "fp", simhash._block_keys(2).alias("keys"), F.lit(None).cast("binary").alias("signs"))
    found = {(r.a, r.b) for r in simhash.links(nodes, 2, leaf=leaf).collect()}
    parent = {f: f for f in map(simhash._signed, fps)}

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    mine = dict(parent)
    for a, b in found:
        mine[find(mine, a)] = find(mine, b)
    for a in parent:
        for b in parent:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                parent[find(parent, a)] = find(parent, b)
    same = lambda p: {frozenset(x for x in p if find(p, x) == r) for r in {find(p, x) for x in p}}
    assert same(mine) == same(parent)


def plain_components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("held", [200_000, 5])
def test_components_against_union_find(spark, held, monkeypatch):
    """Long chains, stars around a large and a small node, rings, ties and random edges."""
    from panelkiln.llm import components

    monkeypatch.setattr(components, "HELD", held)
    rng = random.Random(2)
    chain = list(range(1000, 1400))
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:])) + [(9000, 2000 + k) for k in range(300)] + [(3000, 3001 + k) for k in range(300)]
    pairs += [(5000 + k, 5000 + (k + 1) % 50) for k in range(50)] + [(6001, 6002), (6002, 6001), (6001, 6002), (6003, 6003)]
    pairs += [(rng.randrange(7000, 7200), rng.randrange(7000, 7200)) for _ in range(150)] + [(-5, 12), (12, -(2**62))]
    d = spark.createDataFrame([*pairs, (None, 3), (4, None)], "a long, b long").repartition(7)
    got = [(r.node, r.component) for r in components.connected_components(d).collect()]
    want = plain_components([p for p in pairs if p[0] != p[1]])
    assert len(got) == len(want) and dict(got) == want
    assert components.connected_components(d.limit(0)).count() == 0


def test_fingerprints_and_groups_of_a_table(spark):
    """op3 against a plain version over all pairs of fingerprints."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = {}
    for r in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        fps[r.doc_id] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
    ids = sorted(fps)
    want = plain_components([(a, b) for a in ids for b in ids if a <= b and (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash_near_dedup(spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


@pytest.mark.parametrize("leaf", [512, 6])
def test_groups_of_near_copies(spark, leaf):
    """Groups far above the block size, some of texts that only share a passage."""
    rng = random.Random(11)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for size, changed in ((80, 6), (40, 12), (30, 60)):
        base = fresh(300)
        for _ in range(size):
            t = base.copy()
            at = rng.randrange(300 - changed)
            t[at : at + changed] = fresh(changed)
            texts.append(t)
    rng.shuffle(texts)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    alike = [(i, j) for i in range(len(sets)) for j in range(i, len(sets)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.row_id: r.component_id for r in simhash.near_duplicates(d, shingle=5, similarity=0.8, leaf=leaf).collect()}
    assert got == plain_components(alike) and 10 < len(set(got.values())) < 60


def test_near_duplicates_edge_rows(spark, documents, nothing):
    out = {}
    for r in simhash.near_duplicates(documents).collect():
        out.setdefault(r.row_id, []).append(r)
    assert len(out[2]) == 2 and {r.component_id for r in out[2]} == {1}
    assert {out[k][0].fp for k in (3, 4, 5)} == {0} and {out[k][0].component_id for k in (3, 4, 5)} == {3}
    assert simhash.near_duplicates(nothing).count() == 0


def test_near_duplicates_by_similarity(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(900)]
    texts = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(300)]
        texts.append(base)
        near = base.copy()
        for _ in range(4):
            near[rng.randrange(300)] = "changed"
        texts.append(near)
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.row_id: r.component_id for r in simhash.near_duplicates(d, shingle=5, similarity=0.8).collect()}
    assert got == {i: i - i % 2 for i in range(24)}


def test_similarity_is_exact(spark):
    """Pairs from 0.70 to 0.90, and repeated shingles, against all pairs of sets."""
    rng = random.Random(5)
    texts, serial = [], iter(range(10**6))
    fresh = lambda n: [f"u{next(serial)}" for _ in range(n)]
    for g in range(150):
        base = fresh(104 + g)
        shared = round((0.70 + 0.2 * g / 150) * len(base) / (1 + 0.5 * (g % 2)))
        texts += [base, base[:shared] + fresh(rng.randrange(0, 4) if g % 2 else len(base) // 12)]
    for g in range(20):  # a passage that only one of the two repeats: equal sets, other counts
        base = fresh(100)
        texts += [base, base + base * 4]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    alike = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8 for i in range(0, len(texts), 2)}
    assert 20 < sum(alike.values()) < len(alike) - 20
    got = {r.row_id: r.component_id for r in simhash.near_duplicates(d, shingle=5, similarity=0.8).collect()}
    assert got == {i: i - i % 2 if alike[i - i % 2] else i for i in range(len(texts))}


def test_false_candidates_join_nothing():
    """Of three candidates only a pair that the others would hide is a link."""
    a, b, c = np.arange(1000), np.arange(150, 1150), np.arange(100, 1100)
    sign = np.arange(64, dtype=np.uint8).tobytes()
    members = [(k, sign, x.astype("<u8").tobytes()) for k, x in enumerate((np.arange(300, 1300), a, c, b))]
    jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    assert jaccard(a, c) >= 0.8 > jaccard(a, b) and jaccard(members_of(members, 0), a) < 0.8
    assert sorted(simhash._similar_forest(members, [], True, 0.55, 0.8)) == [(2, 1), (3, 2)]


def members_of(members, k):
    return np.frombuffer(members[k][2], dtype="<u8")


# --- multiset hash


def test_multiset_order_insert_delete(spark):
    d = spark.createDataFrame([("a b.\nc d.\ne f.", "c d.\ne f.\na b.", "a b.", "c d.\ne f.")], "x string, y string, p string, rest string")
    fp = lambda c: multiset.fingerprint(F.col(c))
    r = d.select(fp("x").alias("x"), fp("y").alias("y"), multiset.insert(fp("rest"), fp("p")).alias("i"), multiset.delete(fp("x"), fp("p")).alias("d"), fp("rest").alias("rest")).first()
    assert r.x == r.y == r.i and r.d == r.rest != r.x


def test_op5_against_plain_python(spark):
    d = multiset.op5_multiset_fingerprints(spark, SF).toPandas().sort_values("doc_id")
    t = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id").text.fillna("").tolist()
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(t, t[1:] + t[:1])]
    assert d.edited_sha256.tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    assert d.n_chars.tolist() == list(map(len, t)) and d.near_edited.between(0, 1).all() and d.near_edited.mean() > d.near_next.mean() + 0.2
    same = collections.defaultdict(set)
    for text, fp in zip(t, d.fingerprint):
        same[text].add(fp)
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_with_next_ties_nulls_and_one_row(spark, nothing):
    d = spark.createDataFrame([(5, "e"), (None, "n"), (1, "b"), (1, "a"), (9, "z")], "doc_id long, text string")
    got = {(r.doc_id, r.text): r.next_text for r in multiset.with_next(d, "doc_id", ["text"], "text").collect()}
    assert got == {(None, "n"): "a", (1, "a"): "b", (1, "b"): "e", (5, "e"): "z", (9, "z"): "n"}
    one = multiset.with_next(d.where("doc_id = 5"), "doc_id", ["text"], "text").collect()
    assert [r.next_text for r in one] == ["e"]
    assert multiset.with_next(nothing.select("doc_id", "text"), "doc_id", ["text"], "text").count() == 0


def test_with_next_of_hot_ids(spark):
    """Null ids, one id and one row that fill many ranges each: every row is in the one ring."""
    rows = [(None, f"n{k}") for k in range(300)] + [(7, f"s{k}") for k in range(300)] + [(9, "same")] * 200 + [(k, f"u{k}") for k in range(20, 220)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("n", F.lit(1))
    out = multiset.with_next(d.cache(), "doc_id", ["doc_id", "text"], "text").collect()
    want = collections.Counter((r[0], r[1]) for r in rows)
    assert collections.Counter((r.doc_id, r.text) for r in out) == want == collections.Counter((r.next_doc_id, r.next_text) for r in out)
    rank = lambda x: -1 if x is None else x
    assert sum(rank(r.doc_id) > rank(r.next_doc_id) for r in out) == 1  # only from the last to the first
    assert all(r.next_doc_id == r.doc_id + 1 for r in out if r.doc_id is not None and 20 <= r.doc_id < 219)


def test_likeness_against_plain_counts(spark):
    """Fingerprints by plain arithmetic, a piece repeated above 2**20, and likeness beside
    the true share of pieces."""
    ends = re.compile(r"[\n\r]+|(?<=[.!?]) +")

    def plain(text):
        lanes = [0] * multiset.WIDTH
        for p in (x for x in ends.split(text) if x):
            w, digest = len(p).bit_length(), hashlib.sha256(p.encode()).hexdigest()
            for k in range(multiset.STRONG):
                lanes[k] += int(digest[15 * k : 15 * k + 15], 16)
            lanes[multiset.STRONG] += w
            for j, seed in enumerate((42, 1)):
                h = hashes[(p, seed)]
                for k in range(multiset.STRIDE):
                    for c in range(multiset.LANES_A_LONG):
                        lanes[multiset.STRONG + 1 + j * multiset.STRIDE + k] += (h >> (k + c * multiset.LANE_BITS) & 1) * w << c * multiset.LANE_BITS
        return [x % 2**60 for x in lanes]

    rng = random.Random(4)
    piece = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(9)) + "."
    base = [piece() for _ in range(200)]
    texts = [" ".join(base[: 200 - k] + [piece() for _ in range(k)]) for k in (0, 50, 100, 150, 200)]
    every = spark.createDataFrame([(p,) for t in texts for p in ends.split(t)], "p string")
    hashes = {}
    for r in every.select("p", F.xxhash64("p").alias("h"), F.xxhash64("p", F.lit(1)).alias("g")).collect():
        hashes[(r.p, 42)], hashes[(r.p, 1)] = r.h % 2**64, r.g % 2**64
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").withColumn("fp", multiset.fingerprint(F.col("text")))
    fps = {r.k: r.fp for r in d.collect()}
    assert all(fps[k] == plain(t) for k, t in enumerate(texts))
    near = {r.k: r.near for r in d.withColumn("near", multiset.likeness(F.col("fp"), F.lit(fps[0]))).collect()}
    assert near[0] == 1.0 and all(abs(near[k] - share) < 0.3 for k, share in ((1, 0.75), (2, 0.5), (3, 0.25), (4, 0.0)))
    long = spark.range(2).select((F.repeat(F.lit("It is so. "), 300_000 - F.col("id").cast("int"))).alias("text")).withColumn("fp", multiset.fingerprint(F.col("text")))
    a, b = [r.fp for r in long.collect()]
    assert a[multiset.STRONG] == 4 * 300_000 and spark.range(1).select(multiset.likeness(F.lit(a), F.lit(b))).first()[0] > 0.99


# --- language and quality


def test_codewords_are_apart():
    for n in (2, 4, 6, 9, 40):
        c = langid.codewords(n).astype(int)
        assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= 1 and all(abs(b.sum()) < n for b in c.T)


def test_codewords_of_all_numbers():
    for n in range(2, 41):
        c = langid.codewords(n).astype(int)
        assert len({tuple(b * b[0]) for b in c.T}) == c.shape[1] and all(abs(b.sum()) < n for b in c.T)
        assert n > 6 or c.shape[1] == 2 ** (n - 1) - 1
        assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= 1


def test_rare_languages_are_learned(spark):
    """Each letterless or rare label by itself: three texts among many, and 300 languages."""
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    text = lambda letters: " ".join(word(letters) for _ in range(40))
    rows = [(text("abcdefg"), "aa") for _ in range(5000)] + [(text("hijklmn"), "bb") for _ in range(5000)] + [(text("αβγδεζη"), "cc") for _ in range(3)] + [("12 34", "dd")] * 9
    d = spark.createDataFrame([(None, *r) for r in rows], "doc_id long, text string, lang string")
    model = langid.train(d)
    assert model.languages == ["aa", "bb", "cc"]
    out = langid.identify(spark.createDataFrame([(text("αβγδεζη"),), (text("abcdefg"),)], "text string"), model).collect()
    assert [r.lang_pred for r in out] == ["cc", "aa"]
    many = spark.createDataFrame([(None, chr(0x4E00 + 3 * k) * 3 + f" {chr(0x4E01 + 3 * k)}", f"l{k:03}") for k in range(300)], "doc_id long, text string, lang string")
    assert len(langid.train(many).languages) == 300


def test_language_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d = langid.op4_language_codes(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert d.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_edge_rows(spark, documents, nothing):
    model = langid.train(documents)
    out = {r.doc_id: r for r in langid.identify(documents, model).collect()}
    assert out[3].lang_pred == out[4].lang_pred == out[5].lang_pred == out[9].lang_pred == "und" and out[3].lang_score == 0.0
    assert langid.identify(documents, langid.train(nothing)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(nothing, model).count() == 0


def test_flat_trees_match_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.5)).astype(float)
    model = quality.grow(x, y)
    walked = []
    for row in x[:50]:
        margin = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > c[at] else 1)
            margin += leaf[at - len(f)]
        walked.append(1 / (1 + np.exp(-margin)))
    assert np.allclose(model.score(x)[:50], walked) and ((model.score(x) > 0.5) == y).mean() > 0.97


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    d = quality.op8_quality_trees(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert d.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.97


def test_quality_edge_rows(spark, documents, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (2, None)], "doc_id long, quality int")
    for model in (quality.train(documents, labels), quality.train(documents, labels.limit(0)), quality.train(nothing, labels)):
        assert quality.score(documents, model, into="p").where("p between 0 and 1").count() == documents.count()
    assert quality.score(nothing, model).count() == 0
    row = quality.with_statistics(documents.where("doc_id = 10"), into="found").first()
    assert np.allclose(row.found, quality.statistics(row.text), rtol=1e-6) and row.score == 7


# --- packing


def _plain_best_fit(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        open_ = [(b[0], i) for i, b in enumerate(bins) if b[0] >= size and source not in b[1] and cluster not in b[2]]
        i = min(open_)[1] if open_ else len(bins)
        if i == len(bins):
            bins.append([capacity, set(), set()])
        bins[i][0] -= size
        bins[i][1].add(source)
        bins[i][2].add(cluster)
        out.append(i)
    return out


def test_best_fit_against_all_bins():
    rng = random.Random(2)
    items = sorted(((rng.randint(1, 100), rng.randrange(5), rng.randrange(40)) for _ in range(600)), reverse=True)
    assert packing.best_fit(items, 100) == _plain_best_fit(items, 100)


def test_packing_keeps_every_token(spark, documents, nothing):
    out = packing.pack(documents, capacity=256).toPandas()
    assert out.groupby("bin").n_tokens.sum().max() <= 256 and (out.groupby("bin").residual.nunique() == 1).all()
    assert out[out.row_id == 7].n_tokens.sum() == 30000 and set(out.row_id.dropna()) == {1, 2, 6, 7, 8, 9, 10}
    assert len(out[out.row_id == 2]["bin"].unique()) == 2 and packing.pack(nothing).count() == 0


# --- substring dedup


def _plain_windows(texts):
    words = [(t or "").encode().split() for t in texts]
    n = recompression.WINDOW
    count = collections.Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone |= set(range(i, i + n))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def _hard_texts():
    """Repeats of 34 to 40 words, runs, short periods, passages at odd offsets."""
    rng, texts = random.Random(9), []
    words = ["a", "b", "the", "of"] + [f"w{k}" for k in range(40)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (34, 35, 36, 40, 60, 35, 35)]
    passages += [["a"] * 35, ["a", "b"] * 18, ["a", "a", "b"] * 12, ["x"] * 20 + ["y"] * 16]
    for k in range(160):
        t = [rng.choice(words[: 4 + k % 40]) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            t[at:at] = rng.choice(passages)
        texts.append(" ".join(t))
    return [*texts, "a " * 300, "a b " * 77, texts[0], None, "", " \n "]


def test_windows_against_brute_force(spark):
    texts = _hard_texts()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.dedup_substrings(d, result="sha256").collect()}
    assert [got[i] for i in range(len(texts))] == _plain_windows(texts)


def test_cut_text_keeps_the_rest_as_it_is(spark, documents, nothing):
    passage = " ".join(f"p{k}" for k in range(50))
    d = spark.createDataFrame([(1, f"head  one\n{passage}\n tail"), (2, passage + "\tother"), (3, "clean  text\n\nhere")], "doc_id long, text string")
    out = {r.doc_id: r.kept_text for r in recompression.dedup_substrings(d).collect()}
    assert out == {1: "head  one\n\n tail", 2: "\tother", 3: "clean  text\n\nhere"}
    edge = recompression.dedup_substrings(documents, carry=documents.columns)
    assert edge.count() == documents.count() and recompression.dedup_substrings(nothing).count() == 0


# --- pieces


def test_pieces_equal_the_library(spark, documents):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepieces.MODEL)
    table = sentencepieces.load()
    odd = ["", "  a", " a\n b", "a b ", "x▁y", "\t\tz", "é é", "日本語テキスト " * 3, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "🙂🙂 ok", "the the the the the the the the the", None]
    d = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    for most in (0, 10_000):
        coded = sentencepieces.encode(d, table, max_words=most, carry=["doc_id", "text"])
        for r in sentencepieces.decode(coded, table).collect():
            assert r.ids == sp.encode(r.text or "") and r.decoded == (r.text or "").replace("▁", " ")


def test_piece_digests(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepieces.MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in sentencepieces.op10_piece_lattice(spark, SF).collect():
        ids = sp.encode(texts[r.doc_id])
        assert r.n_pieces == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<i4").tobytes()).hexdigest() and r.round_trip


def test_pieces_of_words_with_nul(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepieces.MODEL)
    text = "alpha be\x00ta gamma \x00 delta\x00 " * 10 + "zulu " * 9
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert sentencepieces.encode(d, sentencepieces.load()).first().ids == sp.encode(text)


def test_words_merged_together_and_alone():
    table, rng = sentencepieces.load(), random.Random(6)
    words = ["", " ", " a", "x" * 70, "日本", "\x00", " é\u0301", "🙂🙂", "aaaa aaaa", " banana"]
    words += ["".join(rng.choice(" abcdehinorst.,é7ß") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    ids, sizes = sentencepieces.encode_words(words, table)
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    assert [p.tolist() for p in parts] == [sentencepieces.encode_word(w.replace(" ", "▁"), table) for w in words]


def test_words_of_texts(spark):
    table = sentencepieces.load()
    texts = ["a  b\nc", "▁x y", "", None, " \t z", "a\n\n b", "plain"]
    cut = sentencepieces.Cut([None if t is None else t.encode() for t in texts], sentencepieces._kinds(table))
    assert cut.counts.tolist() == [4, 2, 0, 0, 3, 4, 1]
    assert cut.words.to_pylist() == [b" a", b"  b", b"\n", b"c", b"  x", b" y", b"  ", b"\t", b" z", b" a", b"\n", b"\n", b" b", b" plain"]
    d = spark.createDataFrame([(t,) for t in texts * 3], "text string")
    want = {}
    for w in cut.words.to_pylist() * 3:
        want[w.decode().replace(" ", "▁")] = want.get(w.decode().replace(" ", "▁"), 0) + 1
    assert {r.word: r.n for r in sentencepieces.word_counts(d, table).collect()} == want


def test_lattice_folds(spark):
    words = ["▁banana", "▁ban", "ana", "▁zzz", "é", "▁aaaaaaaa"]
    rng = random.Random(4)
    plain = {c: (3 + i, -4.0 - i / 7) for i, c in enumerate("▁banz")} | {p: (20 + i, -rng.random() * 6) for i, p in enumerate(["an", "ana", "ban", "▁b", "▁ban", "na", "aa", "aaa", "▁a"])}
    d = spark.createDataFrame([(w,) for w in words], "word string")
    for kind in ("unigram", "bpe"):
        table = sentencepieces.Pieces(kind, plain, [], 0, [b""] * 40)
        got = {r.word: r.ids for r in sentencepieces.lattice(d, table).collect()}
        assert got == {w: sentencepieces.encode_word(w, table) for w in words}


# --- pipeline


def test_stages_on_edge_rows(spark, documents, nothing):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_dedup", "substring_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        for d in (documents, nothing):
            out = stage(spark, d, SF)
            assert name == "packing" or out.columns == d.columns
            assert out.count() <= 2 * d.count() + 20


def test_near_dedup_stage_keeps_one(spark, documents):
    kept = stages.near_dedup(spark, documents, SF).select("doc_id").collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(1) == 1 and 2 not in ids and None in ids and {6, 7, 8, 10} <= set(ids)


def test_near_dedup_stage_by_row(spark):
    """Rows of one id are apart, and rows without an id are searched as well."""
    rng = random.Random(8)
    text = [[f"t{g}w{rng.randrange(10**6)}" for _ in range(200)] for g in range(5)]
    near = [" ".join([*t[:-1], "other"]) for t in text]
    text = [" ".join(t) for t in text]
    rows = [(1, text[0]), (2, near[0]), (2, text[1]), (3, text[2]), (3, near[2]), (None, text[3]), (None, near[3]), (None, text[4]), (9, near[4])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in stages.near_dedup(spark, d, SF).collect()]
    assert (1, text[0]) in got and (2, text[1]) in got and (2, near[0]) not in got
    assert sum(r in got for r in rows[3:5]) == 1 and sum(r in got for r in rows[5:7]) == 1
    assert (9, near[4]) in got and (None, text[4]) not in got and len(got) == 5
