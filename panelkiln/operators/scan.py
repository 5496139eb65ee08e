"""Running values along an order where one group, or the whole table, may exceed a task
(W-1, W-7, W-17, F-2).

The rows are cut into sections at tuples of (group, order) taken from a sample of fixed size.
Windows run inside a section.  A group reaches into more than one section only if a cut lies in
it, so at most as many groups as there are cuts need something carried: for these alone totals
are taken by section, summed along the sections, and joined back (two rows a cut at most).
Results do not depend on the cuts.  ``order`` names columns, ascending, nulls first, and should
be total; rows equal in group and order are not parted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 20  # sampled rows a section
SECTION, AHEAD = "_section", "_ahead"


class Sections:
    """``df`` cut into sections: ``rows`` has the column ``_section``."""

    def __init__(self, df: DataFrame, group=(), order=(), number: int | None = None):
        self.df, self.group, self.order = df, list(group), list(order)
        n = number or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        place = [*self.group, *self.order]
        named = [F.col(c).alias(f"p{k}") for k, c in enumerate(place)]
        sample = df.select(*named).orderBy(F.rand(1)).limit(SAMPLE * n)  # this many rows, whatever the table
        found = sample.orderBy(F.struct(*[f"p{k}" for k in range(len(place))])).collect()
        step = max(1, len(found) // n)
        types = [df.schema[c].dataType for c in place]
        tuples = list(dict.fromkeys(tuple(r) for r in found[step::step]))
        lits = [[F.lit(v).cast(t) for v, t in zip(row, types)] for row in tuples]
        here = F.struct(*named)
        cuts = [F.struct(*[v.alias(f"p{k}") for k, v in enumerate(row)]) for row in lits]
        self.rows = df.withColumn(SECTION, _below(here, cuts))
        same = lambda row: reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(v) for g, v in zip(self.group, row)], F.lit(True))
        self.cut_groups = reduce(lambda a, b: a | b, [same(row) for row in lits], F.lit(False)) if self.group else F.lit(bool(lits))

    def totals(self, **aggregates: Column) -> DataFrame:
        """(group, _section, aggregates) of the groups that a cut lies in."""
        return self.rows.where(self.cut_groups).groupBy(*self.group, SECTION).agg(*[a.alias(n) for n, a in aggregates.items()])

    def before(self) -> Window:
        """The window over a group's earlier sections."""
        return Window.partitionBy(*self.group or [F.lit(1)]).orderBy(SECTION).rowsBetween(Window.unboundedPreceding, -1)

    def within(self) -> Window:
        return Window.partitionBy(SECTION, *self.group).orderBy(*self.order)

    def carry(self, rows: DataFrame, carried: DataFrame, names) -> DataFrame:
        """``rows`` with the carried columns of their section, null where nothing is."""
        c = carried.select(F.col(SECTION).alias("_cs"), *[F.col(g).alias(f"_cg{k}") for k, g in enumerate(self.group)], *names)
        on = [F.col(SECTION) == F.col("_cs"), *[F.col(g).eqNullSafe(F.col(f"_cg{k}")) for k, g in enumerate(self.group)]]
        return rows.join(F.broadcast(c), on, "left").drop("_cs", *[f"_cg{k}" for k in range(len(self.group))])  # two rows a cut


def _below(value: Column, cuts: list[Column]) -> Column:
    """How many of the ascending cuts are below the value."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda c: c < value
    first = F.greatest(F.size(F.filter(F.array(*cuts[::step]), below)) - 1, F.lit(0)) * step
    return first + F.size(F.filter(F.slice(F.array(*cuts), first + 1, F.lit(step)), below))


def row_numbers(df: DataFrame, order, group=(), into: str = "n", number: int | None = None) -> DataFrame:
    """``df`` with the row's number in its group, from 1."""
    s = Sections(df, group, order, number)
    carried = s.totals(_n=F.count("*")).withColumn("_before", F.sum("_n").over(s.before()))
    out = s.carry(s.rows.withColumn("_k", F.row_number().over(s.within())), carried, ["_before"])
    return out.withColumn(into, (F.col("_k") + F.coalesce("_before", F.lit(0))).cast("long")).select(*[c for c in df.columns if c != into], into)


def last_values(df: DataFrame, columns, order, group=(), number: int | None = None) -> DataFrame:
    """``df`` with nulls of the columns replaced by the group's last value before."""
    s = Sections(df, group, order, number)
    at = F.struct(*order)
    names = {c: f"_last{k}" for k, c in enumerate(columns)}
    lasts = s.totals(**{n: F.max_by(c, F.when(F.col(c).isNotNull(), at)) for c, n in names.items()})
    carried = lasts.select(*s.group, SECTION, *[F.last(n, ignorenulls=True).over(s.before()).alias(n) for n in names.values()])
    w = s.within().rowsBetween(Window.unboundedPreceding, 0)
    filled = s.rows.withColumns({f"_v{n}": F.last(c, ignorenulls=True).over(w) for c, n in names.items()})
    out = s.carry(filled, carried, list(names.values()))
    return out.select(*[F.coalesce(f"_v{names[c]}", names[c]).alias(c) if c in names else c for c in df.columns])


def counts_within(df: DataFrame, at: str, spans: dict[str, int], group=(), number: int | None = None) -> DataFrame:
    """``df`` with, for each of ``spans`` (column: width), the number of rows of the group
    whose ``at``, a whole number, is not above the row's and at most the width below it; of a
    row without ``at``, the rows without it.

    A row counts from its ``at`` on and is taken off again behind ``at`` + width, where a mark
    stands for all rows that end there; so counts are running sums, whatever the width."""
    ends = [f"_out{k}" for k in range(len(spans))]
    marks = [df.where(F.col(at).isNotNull()).groupBy(*group, (F.col(at) + width + 1).alias(at)).agg(F.count("*").alias(end)) for end, width in zip(ends, spans.values())]
    rows = df.withColumns({AHEAD: F.lit(False), **{end: F.lit(0).cast("long") for end in ends}})
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [m.withColumn(AHEAD, F.lit(True)) for m in marks], rows)
    s = Sections(every, group, [at], number)
    known = F.col(at).isNotNull()
    sums = {"_in": F.count_if(~F.col(AHEAD) & known), **{f"_s{end}": F.sum(end) for end in ends}}
    carried = s.totals(**sums).select(*s.group, SECTION, *[F.sum(n).over(s.before()).alias(f"_b{n}") for n in sums])
    w = s.within().rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = {n: c.over(w) + F.coalesce(f"_b{n}", F.lit(0)) for n, c in sums.items()}
    without = F.count_if(~known).over(w)
    out = s.carry(s.rows, carried, [f"_b{n}" for n in sums])
    new = [F.when(known, upto["_in"] - F.coalesce(upto[f"_s{end}"], F.lit(0))).otherwise(without).cast("long").alias(n) for end, n in zip(ends, spans)]
    return out.select("*", *new).where(~F.col(AHEAD)).select(*df.columns, *spans)


def rolling(df: DataFrame, order, group=(), mean=(), sums=(), windows=(3, 5), number: int | None = None) -> DataFrame:
    """W-1 by sections: {m}_rolling_mean_{w} and {m}_rolling_sum_{w} as ``rolling_features``
    gives them.  A section of a cut group gets the last rows before it, as many as the widest
    window looks back, and the totals of all rows before it."""
    from .rolling import _value

    s, back = Sections(df, group, order, number), max(windows, default=1) - 1
    metrics = list(dict.fromkeys([*mean, *sums]))
    val = {m: _value(df, m) for m in metrics}
    carried = s.totals(_n=F.count("*"), **{f"_sum{k}": F.sum(val[m]) for k, m in enumerate(metrics)})
    names = ["_n", *[f"_sum{k}" for k in range(len(metrics))]]
    starts = carried.select(*s.group, SECTION, *[F.sum(n).over(s.before()).alias(f"_b{n}") for n in names])
    held = [f"_b{n}" for n in names]
    # the last rows of each section of the cut groups, with their number in the group
    newest = Window.partitionBy(SECTION, *s.group).orderBy(*[F.col(c).desc_nulls_last() for c in s.order])
    tails = s.rows.where(s.cut_groups).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= back)
    ends = carried.select(*s.group, SECTION, F.sum("_n").over(s.before().rowsBetween(Window.unboundedPreceding, 0)).alias("_end"))
    tails = s.carry(tails, ends, ["_end"]).withColumn("_at", F.col("_end") - F.col("_r") + 1).drop("_r", "_end", SECTION)
    to = starts.select(F.col(SECTION), F.col("_b_n").alias("_start"), *[F.col(g).alias(f"_tg{k}") for k, g in enumerate(s.group)]).where("_start is not null")
    on = [(F.col("_at") <= F.col("_start")) & (F.col("_at") > F.col("_start") - back), *[F.col(g).eqNullSafe(F.col(f"_tg{k}")) for k, g in enumerate(s.group)]]
    halo = tails.join(F.broadcast(to), on).select(*df.columns, SECTION, F.lit(True).alias(AHEAD))  # two rows a cut
    rows = s.carry(s.rows.withColumn(AHEAD, F.lit(False)).unionByName(halo), starts, held)
    base = s.within()
    own = F.coalesce("_b_n", F.lit(0)) + F.count_if(~F.col(AHEAD)).over(base.rowsBetween(Window.unboundedPreceding, 0))
    new = {}
    for k, m in enumerate(metrics):
        c = val[m]
        here = F.sum(F.when(~F.col(AHEAD), c)).over(base.rowsBetween(Window.unboundedPreceding, 0))
        total = F.coalesce(F.col(f"_b_sum{k}") + here, here, F.col(f"_b_sum{k}"))
        for w in windows:
            last = base.rowsBetween(-(w - 1), 0)
            full = (own >= w) & (F.count(c).over(last) == w)
            if m in mean:
                new[f"{m}_rolling_mean_{w}"] = F.when(full, F.avg(c).over(last)).when(c.isNull(), F.lit(None)).otherwise(total / own)
            if m in sums:
                new[f"{m}_rolling_sum_{w}"] = F.when(full, F.sum(c).over(last)).when(c.isNull(), F.lit(None)).otherwise(total)
    return rows.select("*", *[c.alias(n) for n, c in new.items()]).where(~F.col(AHEAD)).select(*df.columns, *new)
