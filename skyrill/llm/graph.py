"""Connected components and exact star resolution of candidate buckets, as DataFrame jobs.

Nodes are longs. Every loop writes its state to the shared folder, so no
lineage grows and no link, label or bucket ever reaches the driver; the driver
reads only counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

#: Rounds of further stars at most before the rest is met block by block; they merge dense groups whose first centre lay outside.
STAR_ROUNDS = 3
#: Parts into which the members of one centre are dealt for joins with facts about the centre.
SALTS = 16
#: Members in one block of a group.
BLOCK = 512


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every edge (u, v) leads a node of one edge to a root: then v is the label of u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    per_node = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per_node.where("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b); label is the smallest node reachable.

    Alternating large-star and small-star rounds: each turns the edges of a
    node towards its smallest neighbour. Minima are pre-aggregated on the map
    side, so a node with very many edges is no hot group.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stage(e, "edges")
    while not _is_forest_of_stars(e):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(low.select("u", F.col("m").alias("v")).union(small).distinct(), "edges")
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots.select("v", "v"))


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links: only the labels that the links join are worked on."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    joined = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    moved = components(joined.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    moved = stage(moved, "moved")
    old = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return old.union(moved.join(labels, "node", "left_anti").select("node", "label"))


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` joined with the one row of their c in ``groups``; a large c is dealt to ``SALTS`` tasks."""
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["c", "salt"]).drop("salt")


def _open(group: DataFrame, labels: DataFrame) -> DataFrame:
    """(c, node, label, main, n_out, n_all): members of the groups that hold more than one label.

    ``main`` is the most frequent label of a group and ``n_out`` counts the members outside it.
    """
    labelled = group.join(labels, "node", "left").select("c", "node", F.coalesce("label", "node").alias("label"))
    per_label = labelled.groupBy("c", "label").agg(F.count(F.lit(1)).alias("n"))
    most = F.max(F.struct("n", "label")).alias("most")
    per_group = per_label.groupBy("c").agg(most, F.sum("n").alias("n_all")).where("most.n < n_all")
    return _with_group(labelled, per_group.select("c", F.col("most.label").alias("main"), (F.col("n_all") - F.col("most.n")).alias("n_out"), "n_all"))


def _as_x(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` as the other side of a pair: node x, label lx, and an x after each of ``names``."""
    return rows.withColumnsRenamed({"node": "x", "label": "lx"} | {f: f"{f}x" for f in names})


def _block_pairs(rows: DataFrame, names: list[str], may_link: str) -> DataFrame:
    """Pairs (a, b) of different labels in one group that may be links, each with a member outside the main label.

    Both sides are cut into blocks of about ``BLOCK`` members, so a large group is many small joins.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    place = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    outside = _as_x(rows.where("label <> main").withColumn("i", place("n_out")).withColumn("j", every("n_all")).drop("main", "n_out", "n_all"), *names)
    inside = rows.withColumn("j", place("n_all")).withColumn("i", every("n_out"))
    met = inside.join(outside, ["c", "i", "j"]).where(f"label <> lx and (label = main or x < node) and ({may_link})")
    return met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def resolve(shared: DataFrame, verify: Callable[[DataFrame], DataFrame], facts: DataFrame | None = None, may_link: str = "true", refine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, label) of all nodes with a link, given buckets that hold both ends of every link.

    ``shared`` (bucket, node, c), a staged table, has the distinct members of each bucket of two
    nodes or more, with its smallest node c. ``verify`` turns candidates (a, b)
    into the links among them. ``facts`` (node and other columns) describes nodes;
    from it the SQL condition ``may_link`` (over the facts of one node and, with
    an x after the name, of the other) rules out pairs that cannot be links; it
    must hold for every link.

    Every bucket is a star: c against the other members, who form the group of c
    (buckets of one c are one group). A group whose members then lie in one
    component can add nothing. In the rest a random member outside the most
    frequent component becomes a further centre, for some rounds. Where there is a ``refine``, only groups of over
    ``BLOCK`` members do so, and what is then still open is dealt anew: it turns (c, node) into smaller groups
    that also hold both ends of every link of a group. At last the
    members outside a group's most frequent component meet, block by block, its members
    of other components; only pairs that ``may_link`` admits are formed and
    verified. Every pair of a bucket is then verified, ruled out or within one
    component, so the components are those of all links that share a bucket.
    """
    group = stage(shared.where("node <> c").select("c", "node").distinct(), "group")
    links = stage(verify(group.select(F.col("c").alias("a"), F.col("node").alias("b"))), "links")
    labels = stage(components(links), "labels")
    if refine is None:
        return _settle(group, labels, verify, facts, may_link, True)[0]
    # Groups of a block or less need no stars: they meet at once in the end.
    sizes = group.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    large = group.join(sizes.where(F.col("size") > BLOCK).select("c"), "c", "left_semi")
    rest = group.join(sizes.where(F.col("size") <= BLOCK).select("c"), "c", "left_semi")
    labels, still_open = _settle(large, labels, verify, facts, may_link, False)
    if still_open is not None:
        rest = rest.union(stage(refine(still_open), "finer"))
    return _settle(rest, labels, verify, facts, may_link, True, small=True)[0]


def _settle(group: DataFrame, labels: DataFrame, verify: Callable[[DataFrame], DataFrame], facts: DataFrame | None, may_link: str, blocks: bool, small: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Labels after the stars of groups (c, node), and with ``blocks`` after all else; without, also the (c, node) that are still open, if any.

    With ``small`` groups that all fit in a block meet at once, without stars.
    """
    names = [c for c in facts.columns if c != "node"] if facts is not None else []
    turn, rows = 0, None
    while True:
        if rows is None:
            rows = _open(group, labels)
            rows = stage(rows.join(facts, "node") if names else rows, "open")
            if rows.isEmpty():
                return labels, None
            # Later turns hold fewer components, so their groups are among these.
            group = rows.select("c", "node").distinct()
            if small and turn < STAR_ROUNDS and rows.where(F.col("n_all") > BLOCK).isEmpty():
                turn = STAR_ROUNDS
        if turn < STAR_ROUNDS:
            one = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "label", *names)).alias("one")
            centre = rows.where("label <> main").groupBy("c").agg(one).select("c", "one.node", "one.label", *[f"one.{f}" for f in names])
            met = _with_group(rows, _as_x(centre, *names)).where(f"label <> lx and ({may_link})")
            pairs = met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
        elif blocks:
            pairs = _block_pairs(rows, names, may_link)
        else:
            return labels, group
        found = stage(verify(stage(pairs, "pairs")), "links")
        more = not found.isEmpty()
        if more:
            labels, rows = stage(_merge(labels, found), "labels"), None
        if turn == STAR_ROUNDS:
            return labels, None
        # A star that finds nothing ends the stars.
        turn = turn + 1 if more else STAR_ROUNDS
