"""One-sided outlier verdicts by median and median absolute deviation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sluicebox.storage import park


def _value(metric: str) -> Column:
    """NaN is missing: it neither enters the statistics nor gets a verdict."""
    return F.when(~F.isnan(F.col(metric).cast("double")), F.col(metric).cast("double"))


#: Most values, over all groups and metrics, that the built-in median is used for. It holds all distinct ones, of many
#: groups at once, some 100 bytes each.
MOST_HELD = 4_000_000
#: Most values that a column's median is sorted from on the way to the driver.
MOST_SORTED = 100_000
#: Relative accuracy of the approximate percentiles that bracket a median, and how far from the middle they are.
ACCURACY, MARGIN = 2_000, 0.001


def _exact(rows: DataFrame, group: list[str], values: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*group).agg(*[F.median(v).alias(n) for n, v in values.items()])


def _bracketed(rows: DataFrame, group: list[str], values: dict[str, Column]) -> DataFrame:
    """Exact medians of groups of any size: per group, approximate percentiles (whose buffers are bounded) bracket
    the middle ranks, counts place the brackets, and only the values inside, a few thousandths, are ordered."""
    at = {n: f"_v{i}" for i, n in enumerate(values)}
    rows = rows.select(*group, *[v.alias(at[n]) for n, v in values.items()])
    shares = F.array(F.lit(0.5 - MARGIN), F.lit(0.5 + MARGIN))
    guess = rows.groupBy(*[F.col(g).alias(f"_h_{g}") for g in group]).agg(*[F.percentile_approx(v, shares, ACCURACY).alias(f"{v}b") for v in at.values()], *[F.count(v).alias(f"{v}n") for v in at.values()])
    # One row per group, read several times.
    guess = park(guess, "brackets")
    same = [F.col(g).eqNullSafe(F.col(f"_h_{g}")) for g in group]
    near = rows.join(guess, same)
    low, high = (lambda v: F.col(f"{v}b")[0]), (lambda v: F.col(f"{v}b")[1])
    places = near.groupBy(*[F.col(f"_h_{g}") for g in group]).agg(*[F.first(f"{v}n").alias(f"{v}n") for v in at.values()], *[F.count_if(F.col(v) < low(v)).alias(f"{v}u") for v in at.values()])
    inside = F.array(*[F.when(F.col(v).between(low(v), high(v)), F.col(v)) for v in at.values()])
    each = near.select(*group, F.posexplode(inside).alias("_m", "_v")).filter("_v is not null").groupBy(*group, "_m", "_v").agg(F.count("*").alias("_c"))
    upto = each.withColumn("_upto", F.sum("_c").over(W.partitionBy(*group, "_m").orderBy("_v"))).join(places, same)

    def middle(i: int, v: str) -> Column:
        """Mean of the values at the two middle ranks."""
        here = F.col("_m") == i
        rank = lambda r: F.max(F.when(here & (F.col("_upto") - F.col("_c") <= r - F.col(f"{v}u")) & (r - F.col(f"{v}u") < F.col("_upto")), F.col("_v")))
        return (rank(F.floor((F.col(f"{v}n") - 1) / 2)) + rank(F.floor(F.col(f"{v}n") / 2))) / 2

    found = upto.groupBy(*[F.col(f"_h_{g}") for g in group]).agg(*[middle(i, v).alias(n) for i, (n, v) in enumerate(at.items())])
    keys = guess.select(*[F.col(f"_h_{g}").alias(g) for g in group])
    return park(keys.join(found, same, "left").select(*group, *values), "medians")


def statistics(df: DataFrame, group: list[str], metrics: list[str], large: bool | None = None) -> DataFrame:
    """One row per group: med_<metric> and mad_<metric>, exact. Tables of at most MOST_HELD values go to the built-in
    median; larger ones go by brackets, whatever the sizes of their groups. large says which instead of counting."""
    if large is None:
        large = df.count() * len(metrics) > MOST_HELD
    medians = _bracketed if large else _exact
    side = medians(df, group, {f"med_{m}": _value(m) for m in metrics})
    names = {g: f"_g_{g}" for g in group}
    same = [F.col(g).eqNullSafe(F.col(names[g])) for g in group]
    side = side.withColumnsRenamed(names)
    mads = medians(df.join(side, same), group, {f"mad_{m}": F.abs(_value(m) - F.col(f"med_{m}")) for m in metrics})
    return side.join(mads, same).drop(*names.values())


def global_medians(df: DataFrame, values: list[Column]) -> list[float | None]:
    """The exact medians of columns of any size, in common passes; null and NaN don't count. Approximate percentiles
    bracket the middle ranks, a pass counts what lies below the brackets, and brackets are narrowed until few values
    are left to sort. Only counts and a column's last bracket reach the driver."""
    names = [f"_v{i}" for i in range(len(values))]
    rows = df.select(*[v.cast("double").alias(n) for n, v in zip(names, values)])
    rows = rows.select(*[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])
    found: dict[str, float | None] = {}
    state = {n: (float("-inf"), float("inf"), 0, c, c) for n, c in rows.agg(*[F.count(n).alias(n) for n in names]).first().asDict().items()}
    inside = lambda n, low, high: F.when(F.col(n).between(low, high), F.col(n))
    ranks = lambda c: ((c - 1) // 2, c // 2)
    while True:
        wide = [n for n, (low, high, _, here, _) in state.items() if here > MOST_SORTED and low < high and n not in found]
        if not wide:
            break
        asked = []
        for n in wide:
            low, high, below, here, c = state[n]
            first, last = ranks(c)
            share = [min(1.0, max(0.0, (first - below) / here - MARGIN)), min(1.0, (last - below) / here + MARGIN)]
            asked.append(F.percentile_approx(inside(n, low, high), share, ACCURACY).alias(n))
        guess = rows.agg(*asked).first()
        counts = rows.agg(*[F.struct(F.count_if(inside(n, *state[n][:2]) < guess[n][0]), F.count_if(F.col(n).between(*guess[n]))).alias(n) for n in wide]).first()
        for n in wide:
            low, high, below, here, c = state[n]
            (left, right), (under, between), (first, last) = guess[n], counts[n], ranks(c)
            if between == here or not (below + under <= first and last < below + under + between):
                found[n] = _middle(rows, n, low, high, below, c)
            else:
                state[n] = (left, right, below + under, between, c)
    narrow = [n for n, (low, high, _, here, c) in state.items() if n not in found and c and low < high]
    for n, (low, high, _, _, c) in state.items():
        if n not in found and n not in narrow:
            found[n] = low if c else None
    whole = [n for n in narrow if state[n][3] == state[n][4]]
    if whole:
        # No bracket: the built-in median holds at most MOST_SORTED values of each column.
        found |= rows.agg(*[F.median(n).alias(n) for n in whole]).first().asDict()
    for n in narrow:
        if n not in found:
            low, high, below, _, c = state[n]
            found[n] = _middle(rows, n, low, high, below, c)
    return [found[n] for n in names]


def _middle(rows: DataFrame, name: str, low: float, high: float, below: int, count: int) -> float:
    """The mean of the two middle ranks of a column, of which `below` values lie below its bracket."""
    counts = rows.filter(F.col(name).between(low, high)).groupBy(name).count().orderBy(name)
    found, seen, ranks = [], below, ((count - 1) // 2, count // 2)
    for v, c in counts.toLocalIterator():
        seen += c
        while len(found) < 2 and ranks[len(found)] < seen:
            found.append(v)
        if len(found) == 2:
            break
    return (found[0] + found[1]) / 2


def global_median(df: DataFrame, value: Column) -> float | None:
    """global_medians() of one column."""
    return global_medians(df, [value])[0]


def global_verdicts(df: DataFrame, directions: dict[str, bool], k: float = 3.0) -> DataFrame:
    """verdicts() over all rows as one group of any size: a projection with two medians per metric as constants."""
    values = {m: _value(m) for m in directions}
    meds = dict(zip(values, global_medians(df, list(values.values()))))
    known = [m for m, med in meds.items() if med is not None]
    mads = dict(zip(known, global_medians(df, [F.abs(values[m] - F.lit(meds[m])) for m in known]))) if known else {}
    for metric, higher in directions.items():
        value, med, mad = values[metric], meds[metric], mads.get(metric)
        kept = F.lit(None).cast("boolean") if med is None else F.lit(True) if mad == 0 else value >= med - k * mad if higher else value <= med + k * mad
        df = df.withColumn(f"keep_{metric}", F.when(value.isNotNull(), kept)).withColumn(f"bad_{metric}", ~F.col(f"keep_{metric}"))
    return df


def verdicts(df: DataFrame, group: list[str], directions: dict[str, bool], k: float = 3.0, large: bool | None = None) -> DataFrame:
    """df with keep_<metric> and bad_<metric> for each metric; directions tells whether higher is better.

    Kept are values at or above median - k * MAD, or at or below median + k * MAD. With a MAD of 0 every value is
    kept and none is bad. Missing values have null verdicts. large: see statistics().
    """
    stats = statistics(df, group, list(directions), large)
    names = {g: f"_g_{g}" for g in group}
    out = df.join(stats.withColumnsRenamed(names), [F.col(g).eqNullSafe(F.col(names[g])) for g in group], "left").drop(*names.values())
    for metric, higher in directions.items():
        value, med, mad = _value(metric), F.col(f"med_{metric}"), F.col(f"mad_{metric}")
        inside = value >= med - k * mad if higher else value <= med + k * mad
        out = out.withColumn(f"keep_{metric}", F.when(value.isNotNull(), (mad == 0) | inside))
        out = out.withColumn(f"bad_{metric}", ~F.col(f"keep_{metric}"))
    return out.drop(*[f"{s}_{m}" for s in ("med", "mad") for m in directions])


def all_kept(metrics: list[str]) -> Column:
    """True if no verdict speaks against the row."""
    out = F.lit(True)
    for m in metrics:
        out = out & F.coalesce(F.col(f"keep_{m}"), F.lit(True))
    return out


def any_bad(metrics: list[str]) -> Column:
    out = F.lit(False)
    for m in metrics:
        out = out | F.coalesce(F.col(f"bad_{m}"), F.lit(False))
    return out


def bad_counts(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: bad_<metric> counts, and bad for rows with any."""
    return df.agg(*[F.count_if(F.coalesce(F.col(f"bad_{m}"), F.lit(False))).alias(f"bad_{m}") for m in metrics], F.count_if(any_bad(metrics)).alias("bad"))


def funnel(df: DataFrame, size: Column | None = None, **flags: Column) -> DataFrame:
    """One row: total, a count per flag, bytes (the sum of size over all rows, if it is given) and removal_pct, the
    share of rows that fail the last flag (0 if none)."""
    last = list(flags)[-1]
    bytes_ = [] if size is None else [F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")]
    out = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()], *bytes_)
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.round((F.col("total") - F.col(last)) * 100 / F.col("total"), 2))
    return out.withColumn("removal_pct", share.cast("double"))


def curate(scored: DataFrame, group: list[str], directions: dict[str, bool], k: float = 3.0) -> DataFrame:
    """The rows that all verdicts keep."""
    return verdicts(scored, group, directions, k).filter(all_kept(list(directions))).select(scored.columns)
