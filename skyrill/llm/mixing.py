"""Mixing sources to target weights by entropy balancing.

Targets first: the total is shared among the sources by weight; a source that
would get more than its cap stays there and the excess is shared again, until
none is above.

Among all rates r of documents in [0, cap] that meet a source's target of words,
sum(size * r) = target, the one nearest to rate 1 for every document (in relative
entropy, sum r log r - r) is exponentially tilted: r = min(cap, exp(t * size)).
The tilts t, one a source, solve the convex dual by Newton steps inside a bracket
that always holds the root. A step needs only the words and their derivative for
each source, which are grouped sums over (source, size, number of documents);
no row of a document is read again. Documents keep rates near 1 as far as they
can: a source that must shrink gives up long documents first, one that must grow
repeats long ones first.

Rates become whole copies by systematic rounding: documents of a source in
order of size meet a running sum of rates, and each whole number it passes is a
copy. Running sums are exact integers over range partitions (a hot source is cut
into many), with offsets by prefix sums over the parts, so results do not depend
on the partitioning. What a source then lacks or has too much, less than its
largest document, is mended by single documents: a few for each power of two of
size, chosen greedily from the largest that fits.

Defined results: a null or blank text has size 0 and takes nothing; a source
without words has target 0; null sources are one source; repeated rows are
documents of their own; an empty table gives an empty one; other columns are not
read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import scratch, stage, table

#: Weights of the sources in their order, repeating; words of the mix for each word of the input; most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Rates are whole numbers of 1 / UNIT, so running sums are exact.
UNIT = 1 << 20
#: A source is balanced when its words are this near to the target, in parts of it.
TOLERANCE = 1e-9
MAX_STEPS = 60
#: Documents of each power of two of size that the last mending may add or drop, at most.
SPARE = 4


def count_words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII blanks."""
    runs = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(runs == "", 0).otherwise(F.octet_length(runs) - F.octet_length(F.replace(runs, F.lit(" "))) + 1).cast("long")


def running_sums(rows: DataFrame, key: str, order: list[Column], value: str, out: str) -> DataFrame:
    """``rows`` with ``out``, the sum of ``value`` (long) over the rows of equal ``key`` that come before one, and ``row``, a number of its own.

    Rows are dealt by ranges of (key, order), so a key of any size is cut into parts, and each part starts
    at the sum of those before it. Rows equal in ``order`` may stand in any order.
    """
    parts = rows.repartitionByRange(F.col(key).asc_nulls_last(), *order).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    parts = stage(parts, "parts")
    sums = parts.groupBy(key, "part").agg(F.sum(value).alias("sum"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col(key).alias("base_key"), F.col("part").alias("base_part"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    joined = parts.join(base, (F.col("part") == F.col("base_part")) & F.col(key).eqNullSafe(F.col("base_key")))
    within = Window.partitionBy("part", key).orderBy(*order, "row").rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("base_key", "base_part", "base", "part")


def water_fill(sources: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, words, target) from rows (source, words), one a source: ``share`` of all words dealt out by weight and cap.

    Sources are in code-point order, null last. In each round the level is what is left for each unit of weight.
    """
    one = sources.withColumns({"all": F.lit(0), "one": F.lit(1).cast("long")})
    ordered = stage(running_sums(one, "all", [F.col("source").asc_nulls_last()], "one", "place").select("source", "words", "place"), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = ordered.withColumns({"weight": weight, "most": F.col("words") * float(cap)})
    left = share * (ordered.agg(F.sum("words")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("most")
        held, open_weight, n = weighed.agg(F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if n == full or not open_weight:
            return weighed.select("source", "words", F.least(F.col("weight") * level, "most").alias("target"))
        full, level = n, (left - held) / open_weight


def solve_tilts(sizes: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, tilt) of sources with words, from rows (source, size, n) and (source, words, target); null means that all documents are at the cap.

    Newton on the logarithm of a source's words, which has the dual's root and is nearly straight far from it;
    a step that leaves the bracket halves it instead.
    """
    least = sizes.groupBy(F.col("source").alias("s")).agg(F.min("size").alias("least"))
    # With the smallest size alone the root would be at this end; larger sizes need less.
    end = F.log(F.col("target") / F.col("words")) / F.col("least")
    open_ones = (F.col("target") > 0) & (F.col("target") < F.col("words") * float(cap) * (1 - TOLERANCE))
    state = targets.join(least, F.col("s").eqNullSafe(F.col("source"))).where("words > 0")
    capped = state.where(F.col("target") > 0).where(~open_ones).select("source", F.lit(None).cast("double").alias("tilt"))
    # A source without target keeps nothing: its tilt is minus infinity.
    none = state.where(F.col("target") <= 0).select("source", F.lit(float("-inf")).alias("tilt"))
    done = capped.union(none)
    state = stage(state.where(open_ones).select("s", "target", F.lit(0.0).alias("tilt"), F.least(end, F.lit(0.0)).alias("low"), F.greatest(end, F.lit(0.0)).alias("high")), "tilts")
    for _ in range(MAX_STEPS):
        met = sizes.join(state, F.col("s").eqNullSafe(F.col("source")))
        rate = F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(math.log(cap))))
        words = F.col("n") * F.col("size") * rate
        free = F.col("tilt") * F.col("size") < math.log(cap)
        sums = met.groupBy("s", "target", "tilt", "low", "high").agg(F.sum(words).alias("f"), F.sum(F.when(free, words * F.col("size")).otherwise(0.0)).alias("d"))
        over = F.col("f") > F.col("target")
        moved = sums.withColumns({"low": F.when(over, F.col("low")).otherwise(F.col("tilt")), "high": F.when(over, F.col("tilt")).otherwise(F.col("high"))})
        newton = F.col("tilt") + F.log(F.col("target") / F.col("f")) * F.col("f") / F.nullif("d", F.lit(0.0))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        near = F.abs(F.col("f") - F.col("target")) <= TOLERANCE * F.col("target")
        moved = stage(moved.select("s", "target", F.when(near, F.col("tilt")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2).alias("tilt"), "low", "high", near.alias("near")), "tilts")
        done = done.union(moved.where("near").select(F.col("s").alias("source"), "tilt"))
        state = moved.where("not near").drop("near")
        if state.isEmpty():
            return done
    return done.union(state.select(F.col("s").alias("source"), "tilt"))


def rates(docs: DataFrame, tilts: DataFrame, cap: float = CAP) -> DataFrame:
    """Rows (source, size, ...) with ``units``, their rate in parts of 1 / UNIT; 0 for documents without words."""
    known = tilts.select(F.col("source").alias("s"), "tilt", F.lit(True).alias("known"))
    joined = docs.join(known, F.col("s").eqNullSafe(F.col("source")), "left")
    rate = F.when(F.col("tilt").isNull(), float(cap)).otherwise(F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(math.log(cap)))))
    units = F.least(F.round(rate * UNIT), F.lit(float(cap * UNIT))).cast("long")
    return joined.withColumn("units", F.when(F.col("known") & (F.col("size") > 0), units).otherwise(F.lit(0).cast("long"))).drop("s", "tilt", "known")


def round_copies(rated: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size, units) with ``copies``; the running sum of copies of a source never strays by one from that of rates."""
    order = [F.col("size").desc(), F.xxhash64("doc_id").asc(), F.col("doc_id").asc()]
    half = UNIT // 2
    run = running_sums(rated, "source", order, "units", "run")
    whole = lambda x: F.expr(f"({x} + {half}) div {UNIT}")
    return run.withColumn("copies", whole("run + units") - whole("run")).drop("run", "units")


def mend(copied: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """(row, change): single copies to add or drop, by which each source's words come nearer to its target."""
    got = copied.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("size") * F.col("copies")).alias("got"))
    lack = targets.join(got, F.col("s").eqNullSafe(F.col("source"))).select("s", (F.col("target") - F.col("got")).alias("lack"))
    some = copied.where("size > 0").select("source", "row", "size", "copies", F.xxhash64("doc_id", F.lit(1)).alias("hash"), "doc_id")
    change = F.explode(F.array(F.when(F.col("copies") < cap, 1), F.when(F.col("copies") > 0, -1)))
    each = some.withColumn("change", change).where("change is not null")
    each = each.groupBy("source", "change", F.floor(F.log2("size")).alias("power"), F.pmod("hash", F.lit(SPARE)).alias("cell")).agg(F.min(F.struct("hash", "doc_id", "row", "size")).alias("x"))
    spare = each.select("source", "change", "x.row", "x.size").join(lack, F.col("s").eqNullSafe(F.col("source"))).select("source", "lack", "change", "row", "size")

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        """Take the document that leaves the least lack, as long as one makes it less."""
        frame = frame.sort_values(["size", "change", "row"], ascending=False)
        lack, gains = float(frame["lack"].iloc[0]), (frame["size"] * frame["change"]).to_numpy(float)
        open_rows, taken = np.ones(len(frame), bool), []
        rows = frame["row"].to_numpy()
        while open_rows.any():
            after = np.where(open_rows, np.abs(lack - gains), np.inf)
            k = int(after.argmin())
            if after[k] >= abs(lack):
                break
            lack -= gains[k]
            taken.append(k)
            open_rows &= rows != rows[k]
        return frame.iloc[taken][["row", "change"]]

    return spare.groupBy("source").applyInPandas(choose, "row long, change int")


def mix(docs: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every document of the mix, dropped ones with 0 copies."""
    with scratch(docs.sparkSession):
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size"))
        rows = stage(rows, "sized")
        sizes = stage(rows.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
        targets = stage(water_fill(rows.groupBy("source").agg(F.sum("size").alias("words")), share, weights, cap), "targets")
        copied = stage(round_copies(rates(rows, solve_tilts(sizes, targets, cap), cap)), "copies")
        changes = stage(mend(copied, targets, cap), "changes").withColumnRenamed("row", "changed")
        mended = copied.join(changes, F.col("row") == F.col("changed"), "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
        known = targets.select(F.col("source").alias("s"), F.col("words").alias("source_size"), "target")
        out = mended.join(known, F.col("s").eqNullSafe(F.col("source"))).select("doc_id", "source", "size", "source_size", "target", "copies")
        return stage(out, "mix", keep=True)


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
