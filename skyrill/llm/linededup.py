"""Line dedup: a segment-partition edit join in DataFrame operations only.

Lines of at least ``MIN_CHARS`` characters take part, and with ``exact_short``
every shorter line that is not blank. Equal lines form one class; shorter lines
have no other links, as two edits would join unlike ones. A line within ``edits`` edits of a line cut into ``edits + 1`` segments
contains one of the segments unchanged, at a place the number of edits bounds.
Each distinct line therefore publishes its segments and probes, for each line
length it could match, the substrings at those places; keys carry the length
and the segment number. Lines that share a key are candidates, resolved as
stars (``graph.resolve``), large groups of unlike lines of one template being dealt anew by
their rarest grams, and a candidate is a link when a bit-parallel scan
of the band of 2 * edits + 1 diagonals finds at most ``edits`` edits. Linked
lines form groups; of each group the first occurrence (by doc_id, then by
place) stays and every other occurrence is removed.

Lines are known by a 64-bit hash: among n distinct lines about n**2 / 2**65
pairs share one, and only such a pair could be confused.

Defined results: a null text stays null and has no lines; a text of any length or number of lines is split whole; blank lines stay, and
without ``exact_short`` all short ones; rows that repeat a doc_id and text count as one occurrence, and each is
cleaned alike; an empty table gives an empty table; other columns pass through, but
``n_lines`` and ``n_dropped``, which are replaced; rows of a null doc_id are first
occurrences and lose nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import resolve
from .shared import free_name, scratch, stage, stage_bucketed, table

EDITS = 2
MIN_CHARS = 24
#: Disjoint groups of characters: one edit changes their counts by two in all at most.
GROUPS = tuple("abcdefghiklmnoprstuvwyz 0123456789")
COUNTS = tuple(f"c{k}" for k in range(len(GROUPS)))
#: Facts of a line: its length, its counts, and ``p``, whose bits tell of which classes (a hash of any character) it has an odd number.
FACTS = ("n", *COUNTS, "p")
#: Characters of the grams by which large groups are dealt anew.
GRAM = 6


def _line_list(text: Column) -> Column:
    return F.split(text, "\n", -1)


def occurrences(texts: DataFrame, min_chars: int, exact_short: bool = False) -> DataFrame:
    """(doc_id, pos, line, h): every line that takes part, with its place and hash."""
    lines = texts.select("doc_id", F.posexplode(_line_list(F.col("text"))).alias("pos", "line"))
    takes_part = F.length("line") >= min_chars
    if exact_short:
        takes_part |= F.col("line").rlike(r"[^\s\p{Z}]")
    return lines.where(takes_part).select("doc_id", "pos", "line", F.xxhash64("line").alias("h"))


def segments(edits: int) -> list[tuple[str, str]]:
    """SQL (start, length) of each segment of a line of length L: lengths differ by one at most, longer ones last."""
    k = edits + 1
    out, start = [], "0"
    for i in range(k):
        size = f"cast((L + {i}) div {k} as int)"
        out.append((start, size))
        start = f"{start} + {size}" if start != "0" else size
    return out


def keys(lines: DataFrame, edits: int) -> DataFrame:
    """(bucket, node): keys of each line's own segments and of its probes.

    For a line of length s, a target of length L and segment i (from 1) the
    match lies within i - 1 places of the segment's own place, and within
    edits + 1 - i places counted from the right (multi-match-aware windows).
    """
    k = edits + 1
    parts = []
    for delta in range(edits + 1):
        for i, (start, size) in enumerate(segments(edits), 1):
            lo, hi = max(-(i - 1), delta - (k - i)), min(i - 1, delta + (k - i))
            for shift in range(lo, hi + 1):
                s, z = start.replace("L", f"(n - {delta})"), size.replace("L", f"(n - {delta})")
                parts.append(f"xxhash64(substring(line, {s} + {shift} + 1, {z}), n - {delta}, {i})")
    probes = lines.withColumn("n", F.length("line")).select(F.col("h").alias("node"), F.explode(F.expr(f"array({', '.join(parts)})")).alias("bucket"))
    return probes


def may_link(edits: int) -> str:
    """SQL over ``FACTS`` of two lines that holds whenever they are within ``edits`` edits."""
    bags = " + ".join(f"abs({f} - {f}x)" for f in COUNTS)
    return f"abs(n - nx) <= {edits} and bit_count(p ^ px) <= {2 * edits} and {bags} <= {2 * edits}"


def describe(lines: DataFrame) -> DataFrame:
    """(node, line) with ``FACTS``."""
    counts = [(F.length("line") - F.length(F.translate("line", g, ""))).alias(c) for c, g in zip(COUNTS, GROUPS)]
    odd = F.aggregate(F.split("line", ""), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))
    return lines.select("node", "line", F.length("line").alias("n"), *counts, odd.alias("p"))


def rare_grams(open_lines: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """(c, node): groups of ``open_lines`` (c, node) dealt anew by the rarest grams of their lines (node, line).

    An edit takes at most ``GRAM`` distinct grams from a line, so of two lines within ``edits`` edits each
    has all but ``edits * GRAM`` of its distinct grams in the other, and in any one order of grams their first
    ``edits * GRAM + 1`` have one in common. In order of frequency those are the parts in which lines of one
    template differ. A line of fewer distinct grams (one that repeats itself) stays in its old groups,
    with the lines that have at most ``edits * GRAM`` more.
    """
    most = edits * GRAM
    nodes = open_lines.select("node").distinct()
    places = F.sequence(F.lit(1), F.greatest(F.length("line") - (GRAM - 1), F.lit(1)))
    grams = F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.substring(F.col("line"), i, F.lit(GRAM)))))
    told = stage(lines.join(nodes, "node", "left_semi").select("node", grams.alias("grams")), "grams")
    each = told.where(F.size("grams") > most).select("node", F.explode("grams").alias("gram"))
    n = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = each.join(n, "gram").groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "gram"))), 1, most + 1).alias("rare"))
    dealt = rare.select("node", F.explode("rare").alias("r")).where("r.n > 1").select(F.col("r.gram").alias("c"), "node")
    few = told.select("node", F.size("grams").alias("size")).where(F.col("size") <= 2 * most)
    poor = open_lines.join(few, "node").select("c", "node", "size")
    with_poor = poor.where(F.col("size") <= most).select("c").distinct()
    return dealt.union(poor.join(with_poor, "c").select(F.xxhash64("c", F.lit("poor")).alias("c"), "node")).distinct()


def _edit_links(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose described lines differ by at most ``edits`` edits."""
    x = lines.select(F.col("node").alias("a"), F.col("line").alias("x"), *FACTS)
    y = lines.select(F.col("node").alias("b"), F.col("line").alias("y"), *[F.col(f).alias(f"{f}x") for f in FACTS])
    both = pairs.join(x, "a").join(y, "b").where(may_link(edits))
    # Each step is bound to a name once; as columns the optimiser would copy them into every use.
    cut = "named_struct('x', reverse(substring({0}.x, {0}.p + 1)), 'y', reverse(substring({0}.y, {0}.p + 1)))"
    distance = _let("named_struct('x', x, 'y', y)", "s0", _let(_shared_start("s0"), "s1", _let(cut.format("s1"), "s2", _let(_shared_start("s2"), "s3", _let(cut.format("s3"), "s4", banded_distance("s4.x", "s4.y", edits))))))
    return both.where(F.expr(distance) <= edits).select("a", "b").distinct()


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` in which ``name`` is ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _shared_start(s: str) -> str:
    """SQL of the struct ``s`` with p, the length of the longest common prefix of its x and y, found by halving steps."""
    step = "if(p + shiftleft(1, e) <= n and substring({0}.x, p + 1, shiftleft(1, e)) = substring({0}.y, p + 1, shiftleft(1, e)), p + shiftleft(1, e), p)".format(s)
    found = _let(f"least(length({s}.x), length({s}.y))", "n", f"aggregate(sequence(cast(floor(log2(n + 1)) as int), 0, -1), 0, (p, e) -> {step})")
    return f"named_struct('x', {s}.x, 'y', {s}.y, 'p', {found})"


def banded_distance(x: str, y: str, edits: int) -> str:
    """SQL for the edit distance of two texts whose lengths differ by at most ``edits``; any value above ``edits`` stands for more.

    Bit k of each word is row j - edits + k of column j, so one long holds the
    band. ``vp`` and ``vn`` mark where the distance rises or falls from one row
    to the next, ``d`` is the distance at the band's lowest row. After the last
    column the rows below the end of x are taken back.
    """
    w = 2 * edits + 1
    mask = (1 << w) - 1
    top = 1 << (w - 1)
    start = sum(1 << k for k in range(edits, w))
    match = " | ".join(f"if(cx[j + {k}] = cy[j], {1 << k}L, 0L)" for k in range(w))
    step = f"""
      transform(array(st), s -> named_struct('s', s, 'm', {match}))[0]"""
    inner = f"""transform(transform(array({step}),
        z -> named_struct('vp', z.s.vp, 'vn', z.s.vn, 'd', z.s.d, 'd0', (((((z.m & z.s.vp) + z.s.vp) ^ z.s.vp) | z.m | z.s.vn) & {mask}L))),
        z -> named_struct('vp', ((z.d0 & z.vp) | ~(shiftrightunsigned(z.d0, 1) | (z.vn | ~(z.d0 | z.vp)))) & {mask}L,
                          'vn', shiftrightunsigned(z.d0, 1) & (z.vn | ~(z.d0 | z.vp)) & {mask}L,
                          'd', z.d + if((z.d0 & {top}L) = 0L, 1, 0)))[0]"""
    pad = f"array_repeat('', {edits})"
    below = f"({mask >> 1}L - (shiftleft(1L, length({x}) - length({y}) + {edits}) - 1L))"
    return f"""
    aggregate(array(named_struct('cx', concat({pad}, split({x}, ''), array_repeat('', {w + edits})), 'cy', split({y}, ''))), 0, (acc, t) ->
      aggregate(if({y} = '', array(), sequence(0, length({y}) - 1)), named_struct('vp', {start}L, 'vn', 0L, 'd', {edits}),
        (st, j) -> if(st.d > {3 * edits}, st, {inner.replace('cx[', 't.cx[').replace('cy[', 't.cy[')}),
        st -> st.d - cast(bit_count(st.vp & {below}) as int) + cast(bit_count(st.vn & {below}) as int)))"""


def duplicates(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, exact_short: bool = False) -> DataFrame:
    """(doc_id, dropped): places of the lines to remove, for documents that have some."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    occ = occurrences(texts, min_chars, exact_short)
    first = F.min(F.struct("doc_id", "pos")).alias("first")
    last = F.max(F.struct("doc_id", "pos")).alias("last")
    lines = stage_bucketed(occ.groupBy("h").agg(first, last, F.min("line").alias("line")), "lines", "h")
    # The smallest and largest node of each bucket in one sort; equal lines have met already.
    w = Window.partitionBy("bucket")
    shared = keys(lines.where(F.length("line") >= min_chars), edits).withColumn("c", F.min("node").over(w)).withColumn("top", F.max("node").over(w)).where("c <> top")
    shared = stage(shared.select("bucket", "node", "c").distinct(), "shared")
    # Only lines that share a key are read again; the bucketed table is not shuffled for it.
    wanted = shared.select(F.col("node").alias("h")).distinct()
    known = stage(describe(lines.join(wanted, "h", "left_semi").select(F.col("h").alias("node"), "line")), "candidates")
    facts = known.select("node", *FACTS)
    labels = resolve(shared, lambda pairs: _edit_links(pairs, known, edits), facts, may_link(edits), lambda rest: rare_grams(rest, known, edits))
    grouped = lines.select("h", "first", "last").join(labels.withColumnRenamed("node", "h"), "h", "left")
    heads = grouped.where("label is not null").groupBy("label").agg(F.min("first").alias("head"))
    repeated = (
        grouped.join(heads, "label", "left")
        .select("h", F.coalesce("head", "first").alias("head"), "first", "last")
        .where("head <> first or first <> last")
        .select("h", "head")
        .distinct()
    )
    places = occurrences(texts, min_chars, exact_short).select("doc_id", "pos", "h")
    gone = places.join(repeated, "h").where(F.struct("doc_id", "pos") != F.col("head"))
    return gone.groupBy("doc_id").agg(F.collect_set("pos").alias("dropped"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, exact_short: bool = False) -> DataFrame:
    """All columns of ``docs``, ``text`` without its removed lines, and n_lines and n_dropped."""
    id_, dropped, lines = (free_name(x, docs) for x in ("id", "dropped", "lines"))
    with scratch(docs.sparkSession):
        gone = stage(duplicates(docs, edits, min_chars, exact_short), "dropped", keep=True).select(F.col("doc_id").alias(id_), F.col("dropped").alias(dropped))
    # One plan at every size: a broadcast of the removals would turn into a shuffle of the texts as they grow.
    joined = docs.join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col(id_), "left")
    keep = F.expr(f"array_sort(array_except(sequence(0, size({lines}) - 1), {dropped}))")
    text = F.when(F.col(dropped).isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.col(lines)[i]), "\n"))
    out = joined.withColumn(lines, _line_list(F.col("text").cast("string"))).withColumn("text", text)
    out = out.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn("n_dropped", F.coalesce(F.size(dropped), F.lit(0)).cast("long"))
    return out.drop(lines, dropped, id_)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), exact_short=True).select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
