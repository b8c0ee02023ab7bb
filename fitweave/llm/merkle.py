"""Merkle manifest of a table with a proof for every row, by pointer jumping.

Each row is hashed into a leaf.  Within a group, leaves in order of their id are hashed in runs of 16 into
nodes, level by level until one is left, the subroot; the subroots in order of their group are hashed
the same way into the root.  A node's *step* holds the digests of its run to its left and to its right;
a proof is the steps from a leaf to the root, and folding a leaf over them gives the root again.

Proofs come from self-joins of the table of inner nodes: each holds the steps to an ancestor, first its
parent.  A round joins every node with its ancestor's row, appends that row's steps and takes its
ancestor over, so the distance doubles until all reach the root.  Leaves, fifteen times as many,
take part as the members of their run: they add their own step to the steps of the node above them,
so that what is shuffled for one leaf is its digest and never its kilobytes of proof.

Scale: leaves get their number from a range-partitioned sort, written once with each row's place in its
task, plus the counts of the tasks before; so a group of any size is many tasks.  A run has at most 16
members and a node at most 16^d descendants at distance d.  From distance 8 on that is no bound, but then
ancestors are few, and the side of the ancestors is broadcast where its counted rows allow it.

Defined cases
* null values are hashed as ``-``; a null group comes first, as a group of its own
* null ids come first in their group; rows with equal ids are ordered by their leaf, whole repeats are equal
* empty texts are values of no bytes; very long texts are hashed where they are read and never move
* a lone leaf is the subroot, a lone subroot the root; an empty table gives an empty result
* extra columns are ignored, whatever their names
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitweave.llm.common import materialize, sized

FANOUT = 16
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BROADCAST_NODES = 4096  # rows of at most a proof each, some 20 MB
TOP = "^"  # group of the nodes above the subroots; no key of a source looks like it
STEP = "struct<left: string, right: string>"


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: its bytes and their number, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: tuple[str, ...] = LEAF_COLUMNS, **changed: Column) -> Column:
    """The leaf of a row; ``changed`` gives other values for some of its columns."""
    return digest(F.concat(*(field(changed.get(c, F.col(c))) for c in columns)))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def proof_digest(steps: Column) -> Column:
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with ``rank``, their place among the ``n`` rows of their key by ``order``, and ``n``."""
    # the written place tells equal rows apart, so that they too spread over many ranges
    rows = materialize(rows.withColumn("_place", F.monotonically_increasing_id()), "merkle-leaves")
    by = [key, *order, "_place"]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_place")
    ordered = ordered.withColumn("_row", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_row", 33))
    ordered = materialize(ordered, "merkle-ordered")
    parts = ordered.groupBy(key, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    # one row per key and task: a key has at most as many as there were tasks
    whole = Window.partitionBy(key)
    before = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        key, "_task", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("n")
    )
    placed = ordered.join(parts, [key, "_task"]).withColumn("rank", F.col("_row") - F.col("_first") + F.col("_base"))
    return placed.drop("_row", "_task", "_first", "_base")


def _runs(rows: DataFrame, member: list[str]) -> DataFrame:
    """Runs of 16 neighbours: key, idx of the run, its members in order, and the number n of runs of the key."""
    runs = rows.groupBy("key", F.floor(F.col("rank") / FANOUT).alias("idx")).agg(
        F.sort_array(F.collect_list(F.struct("rank", *member))).alias("members"), F.max("n").alias("n_members")
    )
    return runs.withColumn("n", F.ceil(F.col("n_members") / FANOUT))


def _hashed(digests: Column) -> Column:
    return digest(F.array_join(digests, ""))


def _step(digests: Column, at: Column) -> Column:
    """The step of member ``at`` (from 0) of a run."""
    return F.struct(
        F.array_join(F.slice(digests, F.lit(1), at), "").alias("left"),
        F.array_join(F.slice(digests, at + 2, F.lit(FANOUT)), "").alias("right"),
    )


def _links(runs: DataFrame, child: Column, parent: Column) -> DataFrame:
    """One row per member of each run: its node, the run's node above it, and its step."""
    digests = F.transform("members", lambda m: m["digest"])
    return runs.select(
        "*", F.posexplode("members").alias("at", "member")
    ).select(child.alias("node"), parent.alias("ancestor"), F.array(_step(digests, F.col("at"))).alias("steps"), _hashed(digests).alias("above"))


def _name(key, level: int | Column, idx) -> Column:
    return F.struct(F.col(key).alias("key"), (F.lit(level) if isinstance(level, int) else level).alias("level"), F.col(idx).alias("idx"))


def _climb(nodes: DataFrame, level: int, most: int) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Levels above ``nodes`` (key, rank, digest, n): their links, the last node of each key, and the height."""
    links, tops, height = [], [], 0
    while True:
        tops.append(nodes.where("n = 1").select("key", F.lit(level).alias("level"), F.col("rank").alias("idx"), "digest"))
        if most <= 1:
            return links, tops, height
        runs = materialize(_runs(nodes.where("n > 1"), ["digest"]), "merkle-level")
        member = F.struct(F.col("key"), F.lit(level).alias("level"), F.col("member")["rank"].alias("idx"))
        linked = _links(runs, member, _name("key", level + 1, "idx"))
        alone = (F.col("n") == 1) & (F.col("key") != TOP)
        linked = linked.join(runs.where(alone).select(_name("key", level + 1, "idx").alias("_top")), F.col("ancestor") == F.col("_top"), "left")
        links.append(linked.select("node", "ancestor", "steps", F.when(F.col("_top").isNotNull(), F.col("above")).alias("subroot")))
        nodes = runs.select("key", F.col("idx").alias("rank"), _hashed(F.transform("members", lambda m: m["digest"])).alias("digest"), "n")
        level, most, height = level + 1, -(-most // FANOUT), height + 1


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for other in frames[1:]:
        whole = whole.unionByName(other)
    return whole


def _jump(links: DataFrame, height: int) -> DataFrame:
    """All steps from every linked node to the root, in rounds that double the distance."""
    distance = 1
    while distance < height:
        ancestors = links.select(F.col("ancestor").alias("node")).distinct()
        upper = materialize(links.join(ancestors, "node", "left_semi").select(
            F.col("node").alias("ancestor"), F.col("ancestor").alias("_next"), F.col("steps").alias("_steps"), F.col("subroot").alias("_subroot")
        ), "merkle-upper")
        jumped = links.join(sized(upper, BROADCAST_NODES), "ancestor", "left").select(
            "node",
            F.coalesce("_next", "ancestor").alias("ancestor"),
            F.when(F.col("_steps").isNull(), F.col("steps")).otherwise(F.concat("steps", "_steps")).alias("steps"),
            F.coalesce("subroot", "_subroot").alias("subroot"),
        )
        links = materialize(jumped, "merkle-jump")
        distance *= 2
    return links


def manifest(docs: DataFrame, group: str = "source", order: str = "doc_id", columns: tuple[str, ...] = LEAF_COLUMNS, **carried: Column) -> DataFrame:
    """One row per row of ``docs``: ``order``, leaf, subroot, root, ``steps`` (the proof), and the ``carried`` values.

    ``carried`` are columns over ``docs`` that are computed where a row is hashed, and go with its leaf.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select(key.alias("key"), F.col(order), leaf_digest(columns).alias("digest"), *(v.alias(n) for n, v in carried.items()))
    extra = [order, *carried]
    rows = numbered(leaves, "key", [order, "digest"])
    base = materialize(_runs(rows, ["digest", *extra]), "merkle-runs")
    digests = F.transform("members", lambda m: m["digest"])
    node = F.when(F.col("n_members") == 1, F.element_at(digests, 1)).otherwise(_hashed(digests))
    nodes = base.select("key", F.col("idx").alias("rank"), node.alias("digest"), "n")

    most = nodes.agg(F.max("n")).first()[0]
    if most is None:
        kinds = [f"{order} {docs.schema[order].dataType.simpleString()}", "leaf string, subroot string, root string", f"steps array<{STEP}>"]
        kinds += [f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.select(*carried).schema] if carried else []
        return docs.sparkSession.createDataFrame([], ", ".join(kinds))
    links, tops, height = _climb(nodes, 1, most)
    subroots = materialize(_union(tops), "merkle-subroots")
    number = subroots.count()
    upper = numbered(subroots.withColumn("all", F.lit(TOP)), "all", ["key"])
    upper_links, upper_tops, upper_height = _climb(
        upper.select(F.lit(TOP).alias("key"), "rank", "digest", "n"), 0, number
    )
    if number > 1:
        # the lowest links above start at the subroots' places; name their nodes as they are below
        places = upper.select(_name("all", 0, "rank").alias("_place"), _name("key", F.col("level"), "idx").alias("_node"), "digest")
        first = upper_links[0].join(places, F.col("node") == F.col("_place"))
        upper_links[0] = first.select(F.col("_node").alias("node"), "ancestor", "steps", F.col("digest").alias("subroot"))
    root = upper_tops[-1].select("digest")

    ends = [_name("key", 1, "idx").alias("node"), "members", "n_members"]
    below = base.select(*ends)
    if links + upper_links:
        paths = _jump(materialize(_union(links + upper_links), "merkle-links"), height + upper_height)
        below = below.join(paths.select("node", F.col("steps").alias("path"), "subroot"), "node", "left")
    else:
        below = below.withColumn("path", F.lit(None).cast(f"array<{STEP}>")).withColumn("subroot", F.lit(None).cast("string"))
    # without a path above it, or with one from a subroot on, the run's own node is the subroot
    below = below.withColumn("subroot", F.coalesce("subroot", node)).select(
        "n_members", "path", "subroot", digests.alias("digests"), F.posexplode("members").alias("at", "member")
    )
    own = F.when(F.col("n_members") == 1, F.array().cast(f"array<{STEP}>")).otherwise(F.array(_step(F.col("digests"), F.col("at"))))
    steps = F.concat(own, F.coalesce("path", F.array().cast(f"array<{STEP}>")))
    return below.select(
        F.col("member")[order].alias(order), F.col("member")["digest"].alias("leaf"), "subroot",
        materialize(root, "merkle-root").scalar().alias("root"), steps.alias("steps"),
        *(F.col("member")[n].alias(n) for n in carried),
    )
