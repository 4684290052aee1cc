"""Directed graphs of any size in a few rounds of joins: levels, cycles, and places in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tabletrust.session import materialize

LINKS = "array<struct<to:string,length:bigint>>"


def levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, level): the longest chain of links from each node; null where it runs into a cycle.

    `nodes(node)` are distinct, `links(node, to)` are distinct and lead from node to node, not to
    itself. Each round settles the nodes whose links all lead to settled ones, and replaces a link to
    a node that has one link left by a longer link past it, so chains take a logarithm of rounds and
    only nodes with several open links at every step are peeled level by level.
    """
    out = links.groupBy("node").agg(
        F.collect_list(F.struct("to", F.lit(1).cast("bigint").alias("length"))).alias("links")
    )
    state = nodes.join(out, "node", "left").select(
        "node", F.lit(0).cast("bigint").alias("level"), F.lit(False).alias("stuck"),
        F.coalesce("links", F.array().cast(LINKS)).alias("links"),
    )
    state, seen = _noted(state, F.count(F.lit(1)))
    most = seen
    while seen:
        state, seen = _noted(_round(state, most), F.max(F.col("moved").cast("int")))
        state = state.drop("moved")
    loose = F.col("stuck") | (F.size("links") > 0)
    return state.select("node", F.when(~loose, F.col("level")).alias("level"))


def _noted(rows: DataFrame, what: Column) -> tuple[DataFrame, int | None]:
    """`rows` written once, and an aggregate of them that is taken on the way."""
    seen = Observation("seen")
    rows = materialize(rows.observe(seen, what.alias("what")), "graph-state")
    return rows, seen.get["what"]


def _round(state: DataFrame, most: int) -> DataFrame:
    """One step of every open link: past a settled node, past a node with one link, or none."""
    ahead = state.select(
        F.col("node").alias("to"), F.col("level").alias("below"), F.col("stuck").alias("lost"),
        F.size("links").alias("n"), F.get("links", F.lit(0)).alias("only"),
    )
    each = state.where(~F.col("stuck") & (F.size("links") > 0))
    each = each.select("node", "level", F.explode("links").alias("link")).select("node", "level", "link.*")
    met = each.join(ahead, "to")
    past = (F.col("n") <= 1) & ~F.col("lost")
    length = F.col("length") + F.when(F.col("n") == 1, F.col("only.length")).otherwise(0)
    to = F.when(past, F.col("only.to")).otherwise(F.col("to"))
    met = met.select(
        "node", F.greatest("level", F.when(past, F.col("length") + F.col("below"))).alias("level"),
        # A chain longer than all nodes goes round.
        (F.col("lost") | (to == F.col("node")) | (length > most)).alias("stuck"),
        to.alias("to"), F.when(past, length).otherwise(F.col("length")).alias("length"),
        (past | F.col("lost")).alias("moved"),
    )
    link = F.struct("to", "length")
    met = met.groupBy("node").agg(
        F.max("level").alias("level"), F.bool_or(F.coalesce("stuck", F.lit(False))).alias("stuck"),
        F.sort_array(F.collect_list(F.when(F.col("to").isNotNull(), link))).alias("links"),
        F.bool_or("moved").alias("moved"),
    )
    # Of links to one node the longest, which is the last of them in the sorted list.
    links = F.filter("links", lambda x, i: F.coalesce(F.get("links", i + 1)["to"] != x["to"], F.lit(True)))
    met = met.withColumn("links", F.when(F.col("stuck"), F.array().cast(LINKS)).otherwise(links))
    rest = state.where(F.col("stuck") | (F.size("links") == 0)).withColumn("moved", F.lit(False))
    return met.unionByName(rest)


def on_cycles(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node): the nodes that lie on a cycle, not those that only lead to one or from one.

    What settles along the links or against them is on no cycle. In the rest, the greatest name that
    reaches a node along the links is its colour; a node of its own colour and what it is reached
    from inside the colour are one strong component, which is taken out before the next round.
    """
    return on_cycles_of_stuck(levels(nodes, links), links)


def on_cycles_of_stuck(found: DataFrame, links: DataFrame) -> DataFrame:
    """`on_cycles` where the levels are known."""
    stuck = materialize(found.where("level IS NULL").select("node"), "stuck-nodes")
    if stuck.isEmpty():
        return stuck
    back = inside(links, stuck).select(F.col("to").alias("node"), F.col("node").alias("to"))
    core = materialize(levels(stuck, back).where("level IS NULL").select("node"), "cycle-core")
    found = core.limit(0)
    while not core.isEmpty():
        own = materialize(inside(links, core), "core-links")
        colours = _spread(core.withColumn("colour", F.col("node")), own)
        a, b = colours.toDF("node", "colour"), colours.toDF("to", "to_colour")
        same = own.join(a, "node").join(b, "to").where("colour = to_colour").select("node", "to")
        reached = _reached(colours.where("node = colour").select("node"), materialize(same, "same-colour"))
        # A component of one node is no cycle: links to itself were left out.
        sizes = colours.join(reached, "node").groupBy("colour").agg(F.count(F.lit(1)).alias("n"))
        strong = colours.join(reached, "node").join(sizes.where("n > 1"), "colour").select("node")
        found = materialize(found.union(strong), "cycle-nodes")
        core = materialize(core.join(reached, "node", "left_anti"), "cycle-core")
    return found


def inside(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links between `nodes`."""
    ends = nodes.withColumnRenamed("node", "to")
    return links.join(nodes, "node", "left_semi").join(ends, "to", "left_semi").select("node", "to")


def _spread(colours: DataFrame, links: DataFrame) -> DataFrame:
    """(node, colour): the greatest colour on any way to each node."""
    while True:
        sent = links.join(colours, "node").select(F.col("to").alias("node"), "colour")
        new = colours.unionByName(sent).groupBy("node").agg(F.max("colour").alias("colour"))
        new = materialize(new, "colours")
        if new.exceptAll(colours).isEmpty():
            return new
        colours = new


def _reached(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes that lead to `nodes`, and these."""
    known = new = materialize(nodes, "reached")
    while True:
        back = links.join(new.withColumnRenamed("node", "to"), "to").select("node").distinct()
        new = materialize(back.join(known, "node", "left_anti"), "reached")
        if new.isEmpty():
            return known
        known = materialize(known.union(new), "reached")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows` with their place, from 1, in the order of some columns, which name each row.

    Rows are sorted by ranges; a partition's places begin after the rows of those before it.
    """
    low = (1 << 33) - 1  # monotonically_increasing_id: partition, then row, in 33 bits
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "sorted-rows")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition.
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit(low)) + 1
    return placed.select(*rows.columns, place.cast("int").alias(name))
