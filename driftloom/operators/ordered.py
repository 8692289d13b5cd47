"""Running sums, frames and ranks along an order, without any task that sees more than a stretch of a stream or class.

Rows that are read more than once are written first, so their source is read once. Groups of at most SEGMENT rows are one
window each. Larger ones are cut into stretches along their order: work inside a stretch is a window over (group, stretch);
what crosses its ends is either copied (frames) or summed up for each stretch and added back (running sums). Groups are
kept in one column, so that windows, sums and the join of both share one exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.sources.scratch import materialize

#: Positions in a stretch of a stream, and rows of a group that is not cut; ranges that the values of a larger one are cut into.
SEGMENT, RANGES = 65_536, 64
#: Groups whose cuts (RANGES numbers each) are broadcast; those of more are joined.
MAX_BROADCAST_GROUPS = 10_000

STRETCH, GROUP = "_stretch", "_group"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the right keys go."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def group_of(keys: Sequence[str]) -> Column:
    """The keys as one value, in which null equals null."""
    return F.struct(*keys) if keys else F.lit(0)


def fit_one_task(rows: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no group of keys has more than SEGMENT rows."""
    return (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= SEGMENT


def segmented(rows: DataFrame, order: str) -> DataFrame:
    """Stretches of SEGMENT positions."""
    return rows.withColumn(STRETCH, F.floor(F.col(order) / SEGMENT))


def with_halo(rows: DataFrame, order: str, before: int, after: int) -> DataFrame:
    """Stretches of SEGMENT positions, each with copies of the rows that frames of its own rows reach.

    A frame is `before` positions back and `after` ahead; positions are gapless. `_own` marks the rows of the stretch itself.
    """
    at = F.col(order)
    reach = F.sequence(F.greatest(F.floor((at - after) / SEGMENT), F.lit(0)), F.floor((at + before) / SEGMENT))
    return rows.withColumn(STRETCH, F.explode(reach)).withColumn("_own", F.col(STRETCH) == F.floor(at / SEGMENT))


def in_stretch(keys: Sequence[str], *order: str) -> Window:
    return Window.partitionBy(*keys, STRETCH).orderBy(*order)


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str], ahead: str | None = None) -> DataFrame:
    """Running sums over each group of keys, the row itself included, and the group's totals.

    `sums` maps a column to the suffix of its running sum (`run_`) and total (`all_`). With `ahead`, `_next` is that
    column's value in the next row of the order. Rows without stretches are one window a group; of rows with stretches, only
    one row for each stretch is put in order in one place.
    """
    if not sums and not ahead:
        return rows
    upto = Window.unboundedPreceding, 0
    if STRETCH not in rows.columns:
        group = Window.partitionBy(*keys)
        added = {f"run_{s}": F.sum(c).over(group.orderBy(*order).rowsBetween(*upto)) for c, s in sums.items()} | {f"all_{s}": F.sum(c).over(group) for c, s in sums.items()}
        return rows.withColumns(added | ({"_next": F.lead(ahead).over(group.orderBy(*order))} if ahead else {}))
    rows = rows.withColumn(GROUP, group_of(keys))
    within = Window.partitionBy(GROUP, STRETCH).orderBy(*order)
    inside = rows.withColumns({f"run_{s}": F.sum(c).over(within.rowsBetween(*upto)) for c, s in sums.items()})
    first = [F.min(F.struct(*order, *([ahead] if ahead not in order else [])))[ahead].alias("_first")] if ahead else []
    parts = rows.groupBy(GROUP, STRETCH).agg(*[F.sum(c).alias(f"_sum_{s}") for c, s in sums.items()], *first)
    along = Window.partitionBy(GROUP).orderBy(STRETCH)
    before = {f"_base_{s}": F.coalesce(F.sum(f"_sum_{s}").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for s in sums.values()}
    total = {f"all_{s}": F.sum(f"_sum_{s}").over(Window.partitionBy(GROUP)) for s in sums.values()}
    nexts = {"_next_first": F.lead("_first").over(along)} if ahead else {}
    parts = parts.withColumns(before | total | nexts).drop("_first", *[f"_sum_{s}" for s in sums.values()])
    if ahead:
        inside = inside.withColumn("_next", F.lead(ahead).over(within))
    out = inside.join(parts, [GROUP, STRETCH])
    out = out.withColumns({f"run_{s}": F.col(f"run_{s}") + F.col(f"_base_{s}") for s in sums.values()})
    if ahead:
        out = out.withColumn("_next", F.coalesce("_next", "_next_first")).drop("_next_first")
    return out.drop(GROUP, *[f"_base_{s}" for s in sums.values()])


def ranged(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Stretches of about equally many rows along `value`, by approximate quantiles of each group of keys, of written rows."""
    marked = rows.withColumns({"_at": value, GROUP: group_of(keys)})
    cuts = marked.groupBy(GROUP).agg(F.percentile_approx("_at", [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts"))
    cuts = materialize(cuts, "cuts")
    few = cuts.count() <= MAX_BROADCAST_GROUPS
    stretch = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_at"))), F.lit(0))
    return marked.join(F.broadcast(cuts) if few else cuts, GROUP).withColumn(STRETCH, stretch).drop("_cuts", "_at", GROUP)


def stretched(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """rows, written, with stretches along `value` if a group of keys is too large for one task."""
    rows = materialize(rows, "ordered")
    return rows if fit_one_task(rows, keys) else ranged(rows, keys, value)


def as_number(rows: DataFrame, column: str) -> Column:
    """A number that never falls while the column rises; equal numbers are put in order by the column itself."""
    kind = rows.schema[column].dataType.typeName()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if kind == "date":
        return F.unix_date(column).cast("double")
    return F.lit(0.0) if kind == "string" else F.col(column).cast("double")


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Position from 1 of each row in its group of keys, in the order of all columns of `order`.

    The first of them, a number, date or time, spreads a large group over tasks; a group of equal first values stays together.
    """
    cut = stretched(rows, keys, as_number(rows, order[0])).withColumn("_one", F.lit(1).cast("long"))
    return running(cut, keys, order, {"_one": "one"}).withColumn(name, F.col("run_one")).drop("run_one", "all_one", "_one", STRETCH)


def by_value(counts: DataFrame, keys: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Running sums and totals along `value` of rows that are distinct in keys and value; `_next` is the next value."""
    cut = stretched(counts, keys, F.col("value").cast("double"))
    return running(cut, keys, ["value"], sums, "value").drop(STRETCH)


def mid_ranks(rows: DataFrame, keys: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """Adds for each column of names the rank of its value in its group of keys; equal values share the mean of their places."""
    rows = materialize(rows, "unranked")
    if fit_one_task(rows, keys):
        place = lambda c: F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2
        return rows.withColumns({name: place(c) for c, name in names.items()})
    for c, name in names.items():
        counts = rows.groupBy(*keys, F.col(c).alias("value")).agg(F.count("*").alias("_n"))
        placed = by_value(counts, keys, {"_n": "n"})
        ranks = placed.select(group_of([*keys, "value"]).alias(GROUP), (F.col("run_n") - (F.col("_n") - 1) / 2).alias(name))
        at = F.struct(*keys, F.col(c).alias("value")).alias(GROUP)
        rows = rows.withColumn(GROUP, at).join(ranks, GROUP).drop(GROUP)
    return rows


def quantiles(rows: DataFrame, keys: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of `value` by keys, between two values by linear interpolation; null values don't count."""
    counts = rows.where("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("_n"))
    placed = by_value(counts, keys, {"_n": "n"})
    n, run = F.col("all_n"), F.col("run_n")

    def at(place: Column) -> Column:  # the value at a place from 0
        return F.max(F.when((run > place) & (run - F.col("_n") <= place), F.col("value")))

    low = {s: F.floor((n - 1) * p) for s, p in shares.items()}
    found = placed.groupBy(*keys).agg(
        F.max("all_n").alias("_all"), *[at(low[s]).alias(f"_lo_{s}") for s in shares], *[at(F.least(low[s] + 1, n - 1)).alias(f"_hi_{s}") for s in shares]
    )
    part = lambda p: (F.col("_all") - 1) * p - F.floor((F.col("_all") - 1) * p)
    return found.select(*keys, *[(F.col(f"_lo_{s}") + (F.col(f"_hi_{s}") - F.col(f"_lo_{s}")) * part(p)).alias(s) for s, p in shares.items()])
