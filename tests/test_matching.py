"""Name and player matching against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from panelkiln.operators import resolve


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def names():
    draw = random.Random(3)
    targets = ["".join(draw.choice("abcd ") for _ in range(draw.randint(1, 24))).strip() for _ in range(120)] + ["abcdefgh", "a" * 18, "é" * 9]
    sources = ["abcdefghij", "a" * 20, "é" * 10, "zzz", ""]
    for t in targets:
        x = list(t)
        for _ in range(draw.randint(0, 7)):
            k = draw.randint(0, len(x))
            x[k : k + draw.randint(0, 1)] = draw.choice(["", "a", "b", "x"])
        sources.append("".join(x))
    return sorted({s for s in sources if s == s.strip()}), sorted({t for t in targets if t})


@pytest.mark.parametrize("threshold", [0.4, 0.6, 0.75, 0.8, 0.9])
def test_names_at_any_threshold(spark, names, threshold):
    sources, targets = names
    s, t = (spark.createDataFrame([(x,) for x in some], "name string") for some in names)
    clean = {x: r for x, r in spark.createDataFrame([(x,) for x in {*sources, *targets}], "name string").select("name", F.lower(resolve.N.standard_name(F.col("name"), F.lit(None).cast("string")))).collect()}
    got = {r.source_name: (r.mapped_name, round(r.confidence, 9), r.method) for r in resolve.build_name_mapping(s, t, threshold).collect()}
    low = {x.lower() for x in targets}
    for x in sources:
        if clean[x] in low:
            assert got[x][2] == "exact"
            continue
        scored = [(-(1 - _levenshtein(clean[x], clean[y]) / max(len(clean[x]), len(clean[y]), 1)), y) for y in targets]
        best = min((e for e in scored if -e[0] >= threshold - 1e-9), default=None)
        if best is None:
            assert got[x] == (x, 0.0, "none")
        else:
            assert got[x] == (best[1], round(-best[0], 9), "fuzzy"), x


def test_edits_that_decimal_thresholds_allow(spark):
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    for a, b, t in (("abcdefghij", "abcdefgh", 0.8), ("abcdefghijklmnopqrst", "abcdefghijklmnopqr", 0.9)):
        assert resolve.build_name_mapping(one(a), one(b), t).first().mapped_name == b


def test_no_length_pairs_above_the_last_bound(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("pairs by length only")

    monkeypatch.setattr(resolve, "_length_pairs", refuse)
    s, t = (spark.createDataFrame([(x,) for x in some], "name string") for some in (["abcdefghij", "zzzz"], ["abcdefxxij"]))
    assert resolve.build_name_mapping(s, t, 0.75).where("method = 'fuzzy'").count() == 1


def test_containment_is_all_pairs_that_contain(spark):
    draw = random.Random(4)
    text = lambda n: "".join(draw.choice("abé ") for _ in range(draw.randint(0, n)))
    wholes, parts = [(text(40), k % 3) for k in range(150)], [(text(20), k % 3) for k in range(150)] + [("", 0), ("b", None)]
    w, p = spark.createDataFrame(wholes, "w string, g int"), spark.createDataFrame(parts, "p string, g int")
    got = sorted((r.g, r.w, r.p) for r in resolve._containing(w, p, "w", "p", ["g"]).collect())
    assert got == sorted((g, a, b) for a, g in wholes for b, h in parts if g == h and b and b in a)


def test_mates_by_containment(spark):
    """Stage 3 over random players against all pairs of a team."""
    draw = random.Random(6)
    syllables = ["an", "ber", "son", "to", "li", "ma"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 3)))
    place = lambda: draw.choice(["DEF", "GKP", "MID", "FWD"])
    targets = [(k, f"{word()} {word()}", draw.choice(["x", "Y ", None]), place()) for k in range(80)]
    sources = [(k, draw.choice([f"{word()} {word()}", f"{draw.choice(targets)[1]} {word()}", word()]), draw.choice(["X", "y", None]), place()) for k in range(80)]
    s = spark.createDataFrame(sources, "player_id long, player_name string, team string, position string")
    t = spark.createDataFrame(targets, "target_id long, target_name string, target_team string, target_position string")
    got = {r.player_id: (r.target_id, r.confidence) for r in resolve.match_players(s, t, 0.999).where("stage = 3").collect()}
    staged = {r.player_id: r.stage for r in resolve.match_players(s, t, 0.999).collect()}
    assert len(got) > 5
    for pid, name, team, position in sources:
        if staged[pid] in (1, 2):
            continue
        found = [
            (tid, 0.65 if position == p else 0.55)
            for tid, n, tm, p in targets
            if team and tm and team.strip().lower() == tm.strip().lower() and (name.split(" ")[-1] in n or n in name) and (position == p or {position, p} <= {"DEF", "GKP"})
        ]
        assert got.get(pid) == min(found, default=None), name


def test_variations_are_followed_to_their_end(spark, tmp_path):
    from panelkiln.sources import io

    pairs = [(f"s{k}", f"s{k + 1}") for k in range(37)] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), (" t ", " s35"), ("t", "u"), ("me", "me"), ("", "q"), (None, "q"), ("q", None), ("s0", "s1")]
    io.write_csv(spark.createDataFrame([(*p, k) for k, p in enumerate(pairs)], "source string, canonical string, other int"), str(tmp_path / "v"))
    closed, problems = resolve.close_variations(io.read_variations(spark, str(tmp_path / "v")))
    assert sorted(map(tuple, closed.collect())) == sorted([(f"s{k}", "s37", 37 - k) for k in range(37)] + [("t", "s37", 3)])
    assert sorted(map(tuple, problems.collect())) == [("t", "s35", "clash"), ("t", "u", "clash"), ("w", "x", "cycle"), ("x", "y", "cycle"), ("y", "z", "cycle"), ("z", "x", "cycle")]
    empty, none = resolve.close_variations(spark.createDataFrame([], "source string, canonical string"))
    assert empty.count() == 0 == none.count()
    mapped = resolve.build_name_mapping(spark.createDataFrame([("t",)], "name string"), spark.createDataFrame([("s37",), ("tt",)], "name string"), 0.4, variations=closed)
    assert [(r.mapped_name, r.method) for r in mapped.collect()] == [("s37", "known")]


def test_copies_of_a_name_do_not_meet(spark):
    """F2 to F9: many players of one name were paired with all targets of that name."""
    n = 400
    t = spark.range(n).select(F.col("id").alias("target_id"), F.lit("ann berson").alias("target_name"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("t"), F.col("id") % 3)).alias("target_team"), F.lit("DEF").alias("target_position"))
    s = spark.range(n).select((F.col("id") + 1000).alias("player_id"), F.when(F.col("id") % 2 == 0, "Ann Berson").otherwise("ann bersonn").alias("player_name"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("T"), F.col("id") % 4)).alias("team"), F.lit("DEF").alias("position"))
    got = resolve.match_players(s, t)
    rows = {r.player_id: (r.target_id, r.stage, round(r.confidence, 6)) for r in got.collect()}
    first = {f"t{k}": min(i for i in range(n) if i % 4 and i % 3 == k) for k in range(3)}
    for i in range(n):
        team, same = f"t{i % 4}" if i % 5 else None, i % 2 == 0
        if team in first:
            assert rows[i + 1000] == (first[team], 1 if same else 2, 1.0)
        else:
            assert rows[i + 1000] == (0, 4, 0.7 if same else round((1 - 1 / 11) * 0.7, 6))
    seen = got._jdf.queryExecution().executedPlan()
    most, stack = 0, [seen.finalPhysicalPlan() if seen.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else seen]
    got.collect()
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.finalPhysicalPlan())
            continue
        if name.endswith("QueryStageExec"):
            stack.append(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        stack += [node.children().apply(k) for k in range(node.children().size())]
    assert most <= 2 * n
