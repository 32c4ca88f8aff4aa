"""Fixity audit of WARC replicas by Merkle trees over records and their offset ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluentrail.llm.common import stored

#: Children of a node.
FANOUT = 16


def warc_record(url: Column, body: Column) -> Column:
    """Bytes of a response record, as text; a null url or body is empty."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def _parts(digest: Column) -> list[Column]:
    """A hex digest as numbers whose sums do not depend on an order."""
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]


def _parent(fanout: int) -> Column:
    return F.expr(f"(node - pmod(node, {fanout})) div {fanout}")


def leaves(records: DataFrame, archive: str, position: str, record: str) -> DataFrame:
    """One leaf per archive and position: ``archive, position, size, digest``.

    Every position counts, also one below 0. Null archives or positions raise no error and take no part; a null record has size 0 and
    differs from an empty one. Records that share a place form one leaf, whose digest does not depend on their order; they
    are summed up before the shuffle, so a place with a third of all rows is no hot task.
    """
    digest = F.sha2(F.col("record").cast("binary"), 256)
    source = records.select(F.col(archive).alias("archive"), F.col(position).cast("long").alias("position"), F.col(record).alias("record"))
    source = source.filter(F.col("archive").isNotNull() & F.col("position").isNotNull())
    source = source.select("archive", "position", F.octet_length(F.coalesce("record", F.lit(""))).alias("size"), digest.alias("digest"))
    sums = [F.sum(part).alias(f"part{i}") for i, part in enumerate(_parts(F.col("digest")))]
    places = source.groupBy("archive", "position").agg(F.count("*").alias("copies"), F.sum("size").alias("size"), *sums)
    own = F.sha2(F.concat_ws(":", "copies", *(f"part{i}" for i in range(4))), 256)
    return places.select("archive", "position", "size", own.alias("digest"))


def _child(node: Column, offset: Column, size: Column, digest: Column, fanout: int) -> Column:
    """What a node's digest covers of a child: its number, its range of offsets in the node, its digest."""
    return F.concat_ws(":", F.pmod(node, F.lit(fanout)), offset, offset + size, digest)


def merkle_tree(records: DataFrame, archive: str = "archive", position: str = "position", record: str = "record", fanout: int = FANOUT) -> DataFrame:
    """Nodes of one tree per archive: ``archive, level, node, offset, size, digest``; leaves have level 0.

    A node of level ``n`` covers ``fanout ** n`` positions; its digest covers its children's digests, numbers and ranges of offsets in
    order. Offsets are counted from where the parent begins, so a record of another length changes the nodes above it
    and none beside them. All archives have as many levels as the farthest position needs, so that one
    node holds those from 0 on and one those below 0, if there are any. An empty table has no nodes.
    No more than ``fanout`` rows are sorted together, however long an archive is.
    """
    nodes = stored(leaves(records, archive, position, record).withColumnRenamed("position", "node"), "merkle-leaves")
    low, high = nodes.agg(F.min("node"), F.max("node")).first()
    levels, top = [], low is None
    while low is not None:
        top = low >= -1 and high <= 0
        low, high = low // fanout, high // fanout
        before = Window.partitionBy("archive", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        placed = nodes.withColumn("parent", F.lit(0).cast("long") if top else _parent(fanout)).withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
        levels.append(placed.select("archive", F.lit(len(levels)).alias("level"), "node", "offset", "size", "digest"))
        if top:
            break
        text = _child(F.col("node"), F.col("offset"), F.col("size"), F.col("digest"), fanout)
        up = placed.groupBy("archive", "parent").agg(F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct("node", text.alias("text")))).alias("children"))
        digest = F.sha2(F.array_join(F.transform("children", lambda c: c["text"]), "|"), 256)
        nodes = stored(up.select("archive", F.col("parent").alias("node"), "size", digest.alias("digest")), "merkle-level")
    if not levels:
        levels = [nodes.select("archive", F.lit(0).alias("level"), "node", F.lit(0).cast("long").alias("offset"), "size", "digest")]
    return stored(reduce(DataFrame.unionByName, levels), "merkle-tree")


def _raised(tree: DataFrame, height: int, wanted: int, fanout: int) -> DataFrame:
    """A tree with more levels above its highest nodes, each with one child."""
    for level in range(height, wanted):
        top = tree.filter(F.col("level") == level)
        none = F.lit(0).cast("long")
        above = F.sha2(_child(F.col("node"), none, F.col("size"), F.col("digest"), fanout), 256)
        lower = tree.filter(F.col("level") < level).unionByName(top.withColumn("offset", none))
        tree = lower.unionByName(top.withColumn("level", F.lit(level + 1)).withColumn("digest", above))
    return tree


def audit(first: DataFrame, second: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Places where two replicas differ: ``archive, position, start, end, kind, shift, first_digest, second_digest``.

    Roots are compared first; a branch is entered only where digests differ, so equal archives cost one row, and offsets are added up
    on the way down. ``kind`` is ``changed``, ``lost`` (only in the first) or ``added`` (only in the second). Offsets are the first
    replica's, the second's where a record was added. What is whole but lies elsewhere is told as one range,
    ``moved``, from the position behind the record that moved it up to the next that does or the end of the
    archive; ``shift`` says how far, and is null in other rows.
    """
    heights = [tree.agg(F.max("level")).first()[0] for tree in (first, second)]
    top = max((h for h in heights if h is not None), default=0)
    trees = [tree if h is None else _raised(tree, h, top, fanout) for tree, h in zip((first, second), heights, strict=True)]
    open_nodes = None
    for level in range(top, -1, -1):
        sides = []
        for side, tree in zip(("first", "second"), trees, strict=True):
            own = tree.filter(F.col("level") == level).withColumn("start", F.col("offset"))
            if open_nodes is not None:
                above = open_nodes.select("archive", "parent", F.col(f"{side}_start").alias("above"))
                own = own.withColumn("parent", _parent(fanout)).join(above, ["archive", "parent"]).withColumn("start", F.col("above") + F.col("offset"))
            sides.append(own.select("archive", "node", *(F.col(c).alias(f"{side}_{c}") for c in ("start", "size", "digest"))))
        both = sides[0].join(sides[1], ["archive", "node"], "full_outer")
        differing = stored(both.filter(~F.col("first_digest").eqNullSafe(F.col("second_digest"))), "merkle-open")
        open_nodes = differing.select("archive", F.col("node").alias("parent"), "first_start", "second_start")
    kind = F.when(F.col("second_digest").isNull(), "lost").when(F.col("first_digest").isNull(), "added").otherwise("changed")
    longer = F.coalesce("second_size", F.lit(0)) - F.coalesce("first_size", F.lit(0))
    start = F.coalesce("first_start", "second_start")
    none = F.lit(None).cast("long")
    found = differing.select(
        "archive", F.col("node").alias("position"), start.alias("start"), (start + F.coalesce("first_size", "second_size")).alias("end"),
        kind.alias("kind"), none.alias("shift"), "first_digest", "second_digest",
    )
    # where the first replica's records go on behind one that is longer or shorter in the second
    sizes = trees[0].filter(F.col("level") == top).groupBy("archive").agg(F.sum("size").alias("whole"))
    by_place = Window.partitionBy("archive").orderBy("position")
    breaks = differing.select("archive", F.col("node").alias("position"), longer.alias("longer"), "first_start", "first_size", "second_start").filter("longer <> 0")
    summed = breaks.withColumn("shift", F.sum("longer").over(by_place))
    # where an added record would be in the first replica
    place = F.coalesce("first_start", F.col("second_start") - (F.col("shift") - F.col("longer")))
    placed = summed.withColumn("place", place).withColumn("behind", F.col("place") + F.coalesce("first_size", F.lit(0)))
    moved = placed.withColumn("next", F.lead("place").over(by_place))
    moved = moved.join(sizes, "archive").withColumn("end", F.coalesce("next", "whole")).filter("shift <> 0 and behind < end")
    text = F.lit(None).cast("string")
    moved = moved.select("archive", (F.col("position") + 1).alias("position"), F.col("behind").alias("start"), "end", F.lit("moved").alias("kind"), "shift", text.alias("first_digest"), text.alias("second_digest"))
    return found.unionByName(moved)
