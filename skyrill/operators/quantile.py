"""Exact medians and quantiles of groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch errs by one in so many ranks, and the bounds lie several times as far from the quantile.
ACCURACY = 10_000
MARGIN = 5.0 / ACCURACY
#: Values of a column that may be left for one task to rank; bounds are narrowed until no more are.
FEW = 1_000_000


def quantile_by(rows: DataFrame, keys: list[str], value: str, out: str, q: float = 0.5) -> DataFrame:
    """(keys, out): the quantile ``q`` of the values of each group, between neighbours by straight line; null values do not count.

    A mergeable sketch gives bounds around the quantile; values outside are only counted, on the map side, and those
    between, some 1 in 1,000 and equal ones as one entry, are ranked.
    """
    x = F.col(value).cast("double")
    some = rows.where(x.isNotNull()).select(*keys, x.alias("__x"))
    bounds = F.percentile_approx("__x", F.array(F.lit(max(q - MARGIN, 0.0)), F.lit(min(q + MARGIN, 1.0))), F.lit(ACCURACY))
    ends = some.groupBy(*keys).agg(bounds.alias("__b"), F.count(F.lit(1)).alias("__n"))
    ends = ends.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__b")[0].alias("__lo"), F.col("__b")[1].alias("__hi"), (F.lit(q) * (F.col("__n") - 1)).alias("__at"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    met = some.join(ends, same) if keys else some.crossJoin(F.broadcast(ends))
    side = F.when(F.col("__x") < F.col("__lo"), -1).when(F.col("__x") > F.col("__hi"), 1).otherwise(0)
    met = met.withColumn("__side", side).withColumn("__v", F.when(F.col("__side") == 0, F.col("__x")))
    each = met.groupBy(*keys, "__at", "__side", "__v").agg(F.count(F.lit(1)).alias("__c"), F.max("__x").alias("__max"), F.min("__x").alias("__min"))
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__side", "__v")
    # Outside the bounds only the neighbours can be asked for: the largest below and the smallest above.
    ranked = each.withColumn("__last", F.sum("__c").over(order)).withColumn("__w", F.when(F.col("__side") < 0, F.col("__max")).otherwise(F.col("__min")))
    value_at = lambda rank: F.min(F.when(F.col("__last") > rank, F.col("__w")))
    picked = ranked.groupBy(*keys, "__at").agg(value_at(F.floor("__at")).alias("__low"), value_at(F.ceil("__at")).alias("__high"))
    return picked.select(*keys, (F.col("__low") + (F.col("__high") - F.col("__low")) * (F.col("__at") - F.floor("__at"))).alias(out))


def column_quantiles(rows: DataFrame, columns: list[str], q: float = 0.5) -> dict[str, float | None]:
    """The exact quantile ``q`` of each column, between neighbours by straight line; nulls do not count, None for a column without values.

    All columns share each scan. Sketches bound the quantile's place; the bounds are narrowed by sketches of
    what lies between until that is little, then the values between are counted and ranked. The
    driver holds a few numbers for each column.
    """
    of: dict[str, Column] = {c: F.col(f"`{c}`").cast("double") for c in columns}
    bounds: dict[str, tuple[float, float]] = {}

    def scan(make) -> dict[str, tuple]:
        """Aggregates of each column, several in one struct."""
        if not columns:
            return {}
        row = rows.agg(*[F.struct(*[x.alias(f"x{i}") for i, x in enumerate(make(of[c], c))]).alias(f"c{k}") for k, c in enumerate(columns)]).first()
        return {c: tuple(row[f"c{k}"]) for k, c in enumerate(columns)}

    def around(at: float, n: int) -> list[float]:
        return [min(max(at / n + d, 0.0), 1.0) for d in (-MARGIN, MARGIN)]

    sketch = lambda x, ends: F.percentile_approx(x, F.array(*map(F.lit, ends)), F.lit(ACCURACY))
    first = scan(lambda x, c: (F.count(x), sketch(x, [max(q - MARGIN, 0.0), min(q + MARGIN, 1.0)])))
    count = {c: n for c, (n, _) in first.items()}
    columns = [c for c in columns if count[c]]
    bounds = {c: tuple(first[c][1]) for c in columns}
    at = {c: q * (count[c] - 1) for c in columns}
    while True:
        inside = {c: of[c].between(*bounds[c]) for c in columns}
        sides = scan(lambda x, c: (F.count(F.when(x < bounds[c][0], x)), F.count(F.when(inside[c], x)), F.max(F.when(x < bounds[c][0], x)), F.min(F.when(x > bounds[c][1], x))))
        wide = {c for c in columns if sides[c][1] > FEW and bounds[c][0] < bounds[c][1]}
        if not wide:
            break
        ends = {c: around(at[c] - sides[c][0], sides[c][1]) for c in columns if sides[c][1]}
        closer = scan(lambda x, c: (sketch(F.when(inside[c], x), ends[c]) if c in wide else F.lit(None),))
        fresh = {c: tuple(closer[c][0]) if c in wide else bounds[c] for c in columns}
        if fresh == bounds:
            break
        bounds = fresh
    between = F.explode(F.array_compact(F.array(*[F.when(inside[c], F.struct(F.lit(c).alias("column"), of[c].alias("x"))) for c in columns]))) if columns else None
    counted = rows.select(between.alias("e")).groupBy("e.column", "e.x").agg(F.count(F.lit(1)).alias("n")) if columns else None
    out: dict[str, float | None] = {c: None for c in of}
    if not columns:
        return out
    below = F.create_map(*[F.lit(x) for c in columns for x in (c, sides[c][0])])[F.col("column")]
    ranked = counted.withColumn("last", below + F.sum("n").over(Window.partitionBy("column").orderBy("x")))
    wanted = F.create_map(*[F.lit(x) for c in columns for x in (c, at[c])])[F.col("column")]
    value_at = lambda rank: F.min(F.when(F.col("last") > rank, F.col("x")))
    picked = {r.column: r for r in ranked.groupBy("column").agg(value_at(F.floor(wanted)).alias("low"), value_at(F.ceil(wanted)).alias("high")).collect()}
    for c in columns:
        before, n, under, over = sides[c]
        # Next to the bounds the neighbour outside may be asked for.
        pick = lambda rank, found: under if rank < before else over if rank >= before + n else found
        low, high = pick(math.floor(at[c]), picked[c].low), pick(math.ceil(at[c]), picked[c].high)
        out[c] = low + (high - low) * (at[c] - math.floor(at[c]))
    return out
