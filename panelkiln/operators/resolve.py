"""Matching names, players, teams and matches between sources (J-8 to J-18)."""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import names as N
from .lineage import once


EPSILON = 1e-9  # thresholds are decimal fractions: 0.8 of 10 letters allows two edits
BOUNDS = (0.9, 0.75, 0.6)  # similarities that are searched one after the other by segments
LONGEST_GRAM = 16


def _edits(longest, floor: float):
    """Edits that a similarity of ``floor`` allows names of at most so many characters."""
    return F.floor(longest * F.lit(1 - floor) + EPSILON).cast("int")


def _length_pairs(s: DataFrame, t: DataFrame, a: str, b: str, floor: float) -> DataFrame:
    """Pairs of rows whose texts ``a`` and ``b`` may have a similarity of ``floor``: lengths
    apart by no more than it allows.  An equi-join on length class (such lengths are in the
    same class or the next) and block: rows of ``s`` are dealt to blocks, those of ``t`` go
    to every block, so that no class is one task and no table is broadcast."""
    width = log(max(1 / floor, 1.1)) * 1.001
    blocks = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    length_class = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1)).cast("double")) / width).cast("int")
    dealt = s.withColumns({"_class": length_class(a), "_block": F.pmod(F.xxhash64(a), F.lit(blocks)).cast("int")})
    near = t.withColumn("_c", length_class(b)).withColumn("_class", F.explode(F.sequence(F.col("_c") - 1, F.col("_c") + 1))).drop("_c")
    copies = near.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    la, lb = F.length(a), F.length(b)
    return dealt.hint("shuffle_hash").join(copies, ["_class", "_block"]).where(F.abs(la - lb) <= _edits(F.greatest(la, lb), floor)).drop("_class", "_block")


def _segment_pairs(s: DataFrame, t: DataFrame, a: str, b: str, floor: float) -> DataFrame:
    """Rows of pairs whose texts ``a`` and ``b`` may have a similarity of ``floor``, all of
    those that have it and some more than once.

    A text ``b`` of m characters meets none that is more than d edits away, d following from
    its length and the floor.  It is cut into d + 1 segments, of which one must survive all
    edits, moved by no more characters than the edits allow.  So rows of ``t`` are copied
    d + 1 times, those of ``s`` to each place of a segment for each length m that they may
    meet, and the join is on (m, number of the segment, its text)."""
    n, m = F.length(a), F.col("_m")
    most = lambda c: F.floor(c.cast("double") / floor + EPSILON).cast("int")  # noqa: E731  of the longer text
    d = lambda m: _edits(most(m), floor)
    first = lambda m, k: F.floor(k * m / (d(m) + 1)).cast("int")
    cut = t.withColumn("_m", F.length(b)).withColumn("_k", F.explode(F.sequence(F.lit(0), d(m))))
    cut = cut.withColumn("_part", F.substring(b, first(m, F.col("_k")) + 1, first(m, F.col("_k") + 1) - first(m, F.col("_k"))))
    least = F.ceil(n * F.lit(floor) - EPSILON).cast("int")
    meets = s.withColumn("_m", F.explode(F.sequence(F.greatest(least, F.lit(0)), most(n)))).withColumn("_d", _edits(F.greatest(n, m), floor)).withColumn("_off", n - m)
    meets = meets.where(F.abs("_off") <= F.col("_d")).withColumn("_k", F.explode(F.sequence(F.lit(0), d(m))))
    low, high = F.ceil((F.col("_off") - F.col("_d")) / 2).cast("int"), F.floor((F.col("_off") + F.col("_d")) / 2).cast("int")
    moved = meets.withColumn("_by", F.explode(F.sequence(low, high))).withColumn("_at", F.col("_by") + first(m, F.col("_k"))).withColumn("_len", first(m, F.col("_k") + 1) - first(m, F.col("_k")))
    placed = moved.where((F.col("_at") >= 0) & (F.col("_at") + F.col("_len") <= n)).withColumn("_part", F.substring(a, F.col("_at") + 1, F.col("_len")))
    key = ["_m", "_k", "_part"]
    return placed.select(*s.columns, *key).distinct().join(cut, key).drop(*key)


def _containing(whole: DataFrame, part: DataFrame, w: str, p: str, on: list[str]) -> DataFrame:
    """Pairs of rows, equal in ``on``, where the text ``w`` contains the text ``p``, which is
    not empty.  An equi-join on the first characters of ``p``, as many as the largest power of
    two that fits: ``whole`` is copied to its different substrings of these lengths."""
    sizes = [2**k for k in range(LONGEST_GRAM.bit_length())]
    q = F.greatest(*[F.when(F.length(p) >= k, k).otherwise(1) for k in sizes])
    keyed = part.where(F.length(p) > 0).withColumn("_gram", F.substring(p, F.lit(1), q))
    sizes = sorted(r[0] for r in keyed.select(q).distinct().collect())  # those that occur: five at most
    grams = lambda k: F.when(F.length(w) >= k, F.transform(F.sequence(F.lit(1), F.length(w) - k + 1), lambda i: F.substring(w, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    spread = whole.withColumn("_gram", F.explode(F.array_distinct(F.flatten(F.array(*[grams(k) for k in sizes or [1]])))))
    # only what some part asks for travels
    return spread.join(keyed.select(*on, "_gram").distinct(), [*on, "_gram"], "left_semi").join(keyed, [*on, "_gram"]).where(F.contains(w, p)).drop("_gram")


def _one_edit(s: DataFrame, t: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of rows whose texts ``a`` and ``b`` are at most one edit apart, by an equi-join
    on the texts and all their forms that lack one character."""
    forms = lambda c: F.array_distinct(F.concat(F.array(F.col(c)), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda k: F.concat(F.substring(c, F.lit(1), k - 1), F.substring(c, k + 1, F.length(c))))))
    joined = s.withColumn("_form", F.explode(forms(a))).hint("shuffle_hash").join(t.withColumn("_form", F.explode(forms(b))), "_form")
    return joined.drop("_form").where(F.levenshtein(a, b) <= 1).distinct()


def close_variations(variations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P-15, J-10: known variations (source, canonical) followed along their chains.

    Gives (source, canonical, hops), each source with the name at the end of its chain (a -> b,
    b -> c: a is c after 2 hops), and the rows that cannot all be right: (source, canonical,
    kind).  ``clash``: a source with several canonical names, of which the least is used;
    ``cycle``: a source whose chain has no end, left out of the first table and given with its own
    canonical name.  Names are trimmed; rows with a null or empty name and rows of a name with itself say
    nothing.  Chains are halved in each round (pointer jumping), so a chain of n takes log2 n joins."""
    v = variations.select(F.trim("source").alias("source"), F.trim("canonical").alias("canonical"))
    v = v.where("source <> '' and canonical <> '' and source <> canonical").distinct()
    per = v.groupBy("source").agg(F.min("canonical").alias("canonical"), F.count("*").alias("_n"))
    clash = v.join(per.where("_n > 1").select("source"), "source", "left_semi").select("source", "canonical", F.lit("clash").alias("kind"))
    first = once(per.select("source", "canonical"))
    at, open_before = first.withColumns({"hops": F.lit(1).cast("long"), "_open": F.lit(True)}), -1
    while True:
        to = at.select(F.col("source").alias("canonical"), F.col("canonical").alias("_to"), F.col("hops").alias("_more"))
        step = at.join(to, "canonical", "left")
        at = once(step.select("source", F.coalesce("_to", "canonical").alias("canonical"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"), F.col("_to").isNotNull().alias("_open")))
        left = at.where("_open").count()
        if left in (0, open_before):  # unchanged: of chains that end, some end in each round
            break
        open_before = left
    cycle = at.where("_open").select("source").join(first, "source").select("source", "canonical", F.lit("cycle").alias("kind"))
    return at.where("not _open").select("source", "canonical", "hops"), clash.unionByName(cycle)


def build_name_mapping(source: DataFrame, target: DataFrame, threshold: float = 0.75, variations: DataFrame | None = None, name: str = "name", order: str | None = None, below: bool = False) -> DataFrame:
    """J-10: (source_name, mapped_name, confidence, method) per distinct source name.

    A known variation 1.0, if the targets have its name; then the standardised source (with
    variations) equal to a lower-cased target 1.0; then the best similarity of standardised
    names at or above ``threshold``, the first candidate (by ``order``, else by name) of
    ties; else the name itself, with the best score if ``below`` is set, else 0.  Null
    names are left out.

    Names one edit apart are found by an equi-join (from four characters on nothing else can
    be nearer).  Distinct names that are left are searched by segments (``_segment_pairs``)
    at 0.9, then 0.75, then 0.6 as far as the threshold goes: who finds a name at one of
    these has no better one below it, so only the others go on.  Below 0.6 more edits are
    allowed than a name has segments, and what is still left is held against all targets
    of a length that the threshold allows (``_length_pairs``)."""
    rank = F.col(order) if order else F.col(name)
    s = source.select(F.col(name).alias("source_name")).where(F.col(name).isNotNull()).distinct()
    t = target.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("target_name")).agg(F.min(rank).alias("_order"))
    if variations is not None:
        known = variations.groupBy(F.trim("source").alias("_v")).agg(F.min("canonical").alias("_known"))
        s = s.join(known, F.trim("source_name") == F.col("_v"), "left").drop("_v")
        t = t.join(known.withColumnRenamed("_known", "_tknown"), F.trim("target_name") == F.col("_v"), "left").drop("_v")
    else:
        s, t = s.withColumn("_known", F.lit(None).cast("string")), t.withColumn("_tknown", F.lit(None).cast("string"))
    s = s.withColumn("_std", F.lower(N.standard_name(F.col("source_name"), F.col("_known"))))
    t = t.select("target_name", "_order", F.lower("target_name").alias("_low"), F.lower(N.standard_name(F.col("target_name"), F.col("_tknown"))).alias("_tstd"))
    entry = lambda score: F.struct((-score).alias("far"), "_order", "target_name")
    best = lambda pairs, score: pairs.groupBy("source_name").agg(F.min(entry(score)).alias("best"))
    given = s.join(t.select(F.col("target_name").alias("_known")), "_known", "left_semi").select("source_name", F.col("_known").alias("mapped_name"), F.lit(1.0).alias("confidence"), F.lit("known").alias("method"))
    rest = s.join(given, "source_name", "left_anti")
    same = best(rest.join(t, rest["_std"] == t["_low"]), F.lit(1.0)).select("source_name", "best.target_name", F.lit(1.0).alias("confidence"), F.lit("exact").alias("method"))
    left = rest.join(same, "source_name", "left_anti").select("source_name", "_std")
    # distinct standardised names on both sides; of targets that are alike, the first
    asks, targets = left.select("_std").distinct(), t.groupBy("_tstd").agg(F.min(F.struct("_order", "target_name")).alias("first")).select("_tstd", "first._order", "first.target_name")
    score = N.similarity(F.col("_std"), F.col("_tstd"))
    pick = lambda pairs: pairs.select("_std", score.alias("score"), "_order", "target_name").groupBy("_std").agg(F.min(entry(F.col("score"))).alias("best"))
    targets = once(targets)
    near = once(pick(_one_edit(asks.where(F.length("_std") >= 4), targets, "_std", "_tstd")))
    far = once(asks.join(near, "_std", "left_anti"))
    floor = 0.01
    levels = [] if below else [x for x in BOUNDS if x > threshold] + [threshold]
    found = near
    for bound in levels:
        if far.isEmpty():
            break
        pairs = _segment_pairs if bound >= BOUNDS[-1] else _length_pairs
        at = once(pick(pairs(far, targets, "_std", "_tstd", bound).where(score >= bound - EPSILON)))
        found, far = found.unionByName(at), once(far.join(at, "_std", "left_anti"))
    if below:
        found = found.unionByName(pick(_length_pairs(far, targets, "_std", "_tstd", floor)))
    good = F.coalesce(-F.col("best.far") >= threshold - EPSILON, F.lit(False))
    fuzzy = left.join(found, "_std", "left").select(
        "source_name",
        F.when(good, F.col("best.target_name")).otherwise(F.col("source_name")).alias("mapped_name"),
        F.when(good | F.lit(below), F.coalesce(-F.col("best.far"), F.lit(0.0))).otherwise(0.0).alias("confidence"),
        F.when(good, "fuzzy").otherwise("none").alias("method"),
    )
    return given.unionByName(same.withColumnRenamed("target_name", "mapped_name")).unionByName(fuzzy)


def name_match_statistics(mapping: DataFrame, low: float = 0.9) -> DataFrame:
    """J-11: counts by method, names below ``low``, mean confidence."""
    m = F.col("method")
    return mapping.agg(
        F.count("*").alias("total"), F.count_if(m.isin("exact", "known")).alias("exact"), F.count_if(m == "fuzzy").alias("fuzzy"), F.count_if(m == "none").alias("unmatched"),
        F.count_if(F.col("confidence") < low).alias("low_confidence"), F.avg("confidence").alias("mean_confidence"),
    )


def build_crosswalk(source: DataFrame, players: DataFrame, threshold: float = 0.75, source_id: str = "player_id", source_name: str = "player", target_id: str = "id", target_name: str = "web_name", variations: DataFrame | None = None) -> DataFrame:
    """J-12: (source id, name, matched id, matched name, confidence to 3 digits); a source
    id's least name stands for it, the least id of a name is taken, none below threshold."""
    s = source.groupBy(F.col(source_id).alias("source_id")).agg(F.min(source_name).alias("name"))
    t = players.select(F.col(target_name).alias("name"), F.col(target_id).alias("target_id"))
    mapping = build_name_mapping(s, t, threshold, variations, order="target_id")
    ids = t.groupBy(F.col("name").alias("mapped_name")).agg(F.min("target_id").alias("target_id"))
    d = s.join(mapping, s["name"] == mapping["source_name"], "left").join(ids, "mapped_name", "left")
    ok = F.col("method") != "none"
    return d.select("source_id", F.col("name").alias("source_name"), F.when(ok, F.col("target_id")).alias("target_id"), F.when(ok, F.col("mapped_name")).alias("matched_name"), F.round("confidence", 3).alias("confidence"))


def match_rate(crosswalk: DataFrame) -> DataFrame:
    return crosswalk.agg(F.count("*").alias("total"), F.count("target_id").alias("matched"), (F.count("target_id") / F.count("*")).alias("match_rate"))


def match_players(source: DataFrame, target: DataFrame, threshold: float = 0.40, variations: DataFrame | None = None, unknown_position: str = "equal", order: str = "target_id") -> DataFrame:
    """J-13: the target of each source player, in stages.

    ``source``: player_id, player_name, team, position; ``target``: target_id, target_name,
    target_team, target_position; a null or empty team is no team.  Stages, the first that
    gives a target (of several the first in order): 1 same name in the team, 2 the J-10 match
    of the name in the team, 3 the last name in a team mate's name, or their name in the
    player's, with the position, 4 the J-10 match in any team with the position, 5 the same
    name in any team.  Confidence 0 without; ``best_score`` is that of the J-10 match."""
    low = lambda c: F.lower(N.standard_name(F.coalesce(F.col(c), F.lit(""))))
    team = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    s = source.select("player_id", "player_name", low("player_name").alias("sn"), team("team").alias("st"), N.position(F.col("position")).alias("sp"))
    t = target.select("target_id", "target_name", F.col(order).alias("o"), low("target_name").alias("tn"), team("target_team").alias("tt"), N.position(F.col("target_position")).alias("tp"))
    names = once(build_name_mapping(s.select(F.col("player_name").alias("name")), t.select(F.col("target_name").alias("name"), "o"), max(threshold, config.SAME_TEAM_FLOOR), variations, order="o"))
    close = names.where("method <> 'none'").select(F.col("source_name").alias("player_name"), low("mapped_name").alias("mn"), F.col("confidence").alias("score"))
    named = s.join(close, "player_name", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    last = lambda c: F.element_at(F.split(c, " "), -1)
    # a source's target depends on its name, team and position, so each such is asked once; a target is the
    # first in order of those alike in what is asked, so copies of a name on both sides never meet
    first = lambda d, *by: d.groupBy(*by).agg(F.min(F.struct("o", "target_id")).alias("b"))
    who = ["player_name", "sn", "st", "sp"]
    asked = once(named.select(*who, "mn", "score").distinct())
    t = once(first(t, "tn", "tt", "tp"))
    again = lambda d, *by: d.groupBy(*by).agg(F.min("b").alias("b"))
    found = lambda d, k, c: d.select(*who, F.struct(F.lit(k).alias("stage"), "b.o", "b.target_id", c.alias("confidence")).alias("w"))
    of_team = again(t.where("tt is not null"), "tn", "tt").withColumnRenamed("tt", "st")
    of_place = again(t.where("tp is not null"), "tn", "tp").withColumnRenamed("tp", "sp")
    of_name = again(t, "tn")
    at = lambda name, targets, *on: asked.join(targets.withColumnRenamed("tn", name), [name, *on])
    boosted = F.least(F.lit(1.0), F.col("score") + config.SAME_TEAM_BOOST)
    factored, enough = F.col("score") * config.OTHER_TEAM_FACTOR, F.col("score") >= config.OTHER_TEAM_FLOOR
    named_so = [found(at("sn", of_team, "st"), 1, F.lit(config.EXACT)), found(at("mn", of_team, "st"), 2, boosted), found(at("mn", of_place, "sp").where(enough), 4, factored), found(at("sn", of_name), 5, F.lit(config.TRANSFER))]
    if unknown_position != "equal":
        named_so.append(found(at("mn", of_name).where(enough & (F.col("sp") == "")), 4, factored))
        named_so.append(found(at("mn", again(t.where("tp = ''"), "tn")).where(enough & F.col("sp").isNotNull()), 4, factored))
    same_position = F.col("sp") == F.col("tp") if unknown_position == "equal" else (F.col("sp") == F.col("tp")) | (F.col("sp") == "") | (F.col("tp") == "")
    back = F.col("sp").isin("DEF", "GKP") & F.col("tp").isin("DEF", "GKP")
    # what stage 3 finds depends on the team, the position and the text only
    asks, mates = asked.select("st", "sp", last("sn").alias("p")).distinct(), t.where("tt is not null").withColumnsRenamed({"tt": "st"})
    whole = asked.where(last("sn") != "").select("st", "sp", F.col("sn").alias("p")).distinct()
    places = F.when(same_position, config.LAST_NAME).when(back, config.LAST_NAME_DEFENCE)
    least = lambda pairs: pairs.withColumn("c", places).where("c is not null").groupBy("st", "sp", "p").agg(F.min(F.struct("b.o", "b.target_id", F.col("c").alias("confidence"))).alias("w"))
    surname, inside = least(_containing(mates, asks, "tn", "p", ["st"])), least(_containing(whole, mates, "p", "tn", ["st"]))
    to = lambda pairs, p: asked.withColumn("p", p).join(pairs, ["st", "sp", "p"]).select(*who, F.struct(F.lit(3).alias("stage"), "w.o", "w.target_id", "w.confidence").alias("w"))
    every = reduce(DataFrame.unionByName, [*named_so, to(surname, last("sn")), to(inside, F.col("sn"))])
    won = every.groupBy(*who).agg(F.min("w").alias("w")).select(*[F.col(c).alias(f"_{c}") for c in who], "w")
    alike = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in who])
    won = named.select("player_id", *who).join(won, alike).groupBy("player_id").agg(F.min("w").alias("w")).select("player_id", "w.target_id", "w.stage", "w.confidence")
    return named.join(won, "player_id", "left").select("player_id", "player_name", "target_id", "stage", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("score").alias("best_score"))


def with_overrides(matched: DataFrame, overrides: DataFrame, season: str | None = None) -> DataFrame:
    """J-15: manual targets come first, with confidence 1."""
    o = overrides if season is None else overrides.where(F.col("season") == season)
    d = matched.join(o.groupBy(F.col("source_id").alias("player_id")).agg(F.min("target_id").alias("_o")), "player_id", "left")
    return d.select(*[F.coalesce("_o", "target_id").alias("target_id") if c == "target_id" else F.when(F.col("_o").isNotNull(), 1.0).otherwise(F.col(c)).alias(c) if c == "confidence" else F.col(c) for c in matched.columns])


def season_player_mapping(base: DataFrame, sources: dict[str, DataFrame], season: str, overrides: DataFrame | None = None) -> DataFrame:
    """J-14: one row per base player (player_id, player_name, team, position) with one id of
    each other source (the most confident), the mean confidence, a review flag and a label."""
    out = base.select("player_id", "player_name", "team", N.position(F.col("position")).alias("position"))
    confidences = []
    for name, other in sources.items():
        swapped = match_players(other.select("player_id", "player_name", "team", "position"), base.select(F.col("player_id").alias("target_id"), F.col("player_name").alias("target_name"), F.col("team").alias("target_team"), F.col("position").alias("target_position")))
        swapped = with_overrides(swapped, overrides, season) if overrides is not None else swapped
        best = keep_most_confident(swapped.select(F.col("target_id"), F.col("player_id").alias(f"{name}_id"), F.col("confidence")).where("target_id is not null"), "target_id", "confidence", [f"{name}_id"])
        out = out.join(best.select(F.col("target_id").alias("player_id"), f"{name}_id", F.col("confidence").alias(f"_c_{name}")), "player_id", "left")
        confidences.append(F.col(f"_c_{name}"))
    given = F.filter(F.array(*confidences), lambda c: c.isNotNull())
    mean = F.when(F.size(given) > 0, F.aggregate(given, F.lit(0.0), lambda a, c: a + c) / F.size(given)).otherwise(0.0)
    label = F.when(F.col("confidence_score") >= 1.0, "exact").when(F.col("confidence_score") > 0, "fuzzy").otherwise("manual")
    rows = out.withColumn("confidence_score", mean).drop(*[f"_c_{n}" for n in sources])
    return rows.select(N.stable_id("player", F.lit(season), F.col("player_id")).alias("unified_player_id"), F.lit(season).alias("season"), "*", (F.col("confidence_score") < config.REVIEW_BELOW).alias("requires_manual_review"), label.alias("source"))


def keep_most_confident(df: DataFrame, key: str, confidence: str, order=()) -> DataFrame:
    """W-10: one row per key by highest confidence; rows without a key all stay."""
    w = Window.partitionBy(key).orderBy(F.coalesce(F.col(confidence), F.lit(0.0)).desc(), *order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col(key).isNull() | (F.col("_r") == 1)).drop("_r")


def team_list(matches: DataFrame, home: str = "home_team", away: str = "away_team", by=()) -> DataFrame:
    """U-4: distinct home and away names."""
    return matches.select(*by, F.col(home).alias("team_name")).union(matches.select(*by, F.col(away))).where("team_name is not null").distinct()


def team_mapping(base: DataFrame, other: DataFrame, season: str, names: dict | None = None, name: str = "team_name") -> DataFrame:
    """J-16: each base team with the other source's name: the normalised name if the other
    source knows it, else the raw name if it does, else null."""
    known = other.select(F.col(name).alias("_known")).distinct()
    b = base.select(name).distinct().withColumn("_norm", N.team_name(F.col(name), names))
    d = b.join(known.withColumnRenamed("_known", "_k1"), F.col("_norm") == F.col("_k1"), "left").join(known.withColumnRenamed("_known", "_k2"), F.col(name) == F.col("_k2"), "left")
    return d.select(N.stable_id("team", F.lit(season), F.col(name)).alias("unified_team_id"), F.lit(season).alias("season"), name, F.coalesce("_k1", "_k2").alias("other_name"))


def resolve_teams(rows: DataFrame, ids: DataFrame, source: str, raw: str) -> DataFrame:
    """J-17: canonical ids of a source's raw team keys, with the latest season's name.
    ``ids``: source, raw, canonical_id, name, season."""
    latest = ids.groupBy("canonical_id").agg(F.max_by("name", "season").alias("canonical_name"))
    one = ids.where(F.col("source") == source).groupBy("raw").agg(F.max_by("canonical_id", "season").alias("canonical_id"))
    return rows.join(one, F.col(raw) == F.col("raw"), "left").drop("raw").join(latest, "canonical_id", "left")


def mapping_rows(rows: DataFrame, ids: DataFrame, canonical: DataFrame, key: str) -> DataFrame:
    """J-18: rows with a mapped id, canonical names filled in, the rest skipped."""
    return rows.join(ids, key).join(canonical, "canonical_id", "left")


def team_lookup(mapping: DataFrame, columns: dict[str, list[str]], team_id: str = "unified_team_id", names: dict | None = None) -> DataFrame:
    """J-9: (season, source_type, team_key, team id): every name, its normal form and every
    numeric id of each source as a string key; earlier columns win."""
    parts = []
    for source, keys in columns.items():
        for k, c in enumerate(keys):
            raw = F.col(c).cast("string")
            for j, key in enumerate((raw, N.team_name(raw, names))):
                parts.append(mapping.select("season", F.lit(source).alias("source_type"), key.alias("team_key"), F.col(team_id), F.lit(2 * k + j).alias("_o")))
    every = reduce(DataFrame.unionByName, parts).where("team_key is not null")
    return every.groupBy("season", "source_type", "team_key").agg(F.min_by(team_id, F.struct("_o", team_id)).alias(team_id))


def match_mapping(sources: list[tuple[str, DataFrame]], season: str = "season") -> DataFrame:
    """J-8: one row per (season, home, away) of sources in order of precedence; each has
    season, home_team_id, away_team_id, match_id, match_date, home_score, away_score.
    Date and score pair come from the first source that has them, ``match_source`` names
    the last source that has the match; undated matches go.  One group, no outer joins."""
    key = [season, "home_team_id", "away_team_id"]
    parts = [d.select(*key, "match_id", "match_date", "home_score", "away_score", F.lit(k).alias("_p"), F.lit(n).alias("_n")) for k, (n, d) in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, parts).where("home_team_id is not null and away_team_id is not null")
    p = F.struct("_p", "match_date", "match_id")
    pair = F.when(F.col("home_score").isNotNull() & F.col("away_score").isNotNull(), F.struct("home_score", "away_score"))
    ids = [F.min(F.when(F.col("_n") == n, F.col("match_id"))).alias(f"{n}_match_id") for n, _ in sources]
    g = rows.groupBy(*key).agg(F.min_by("match_date", F.when(F.col("match_date").isNotNull(), p)).alias("match_date"), F.min_by(pair, F.when(pair.isNotNull(), p)).alias("_pair"), *ids, F.max_by("_n", "_p").alias("match_source"))
    return g.where("match_date is not null").select(N.stable_id("match", *[F.col(k) for k in key]).alias("match_id"), *key, "match_date", F.col("_pair.home_score"), F.col("_pair.away_score"), *[f"{n}_match_id" for n, _ in sources], "match_source")
