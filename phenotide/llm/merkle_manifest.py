"""Merkle manifest of a table: a tree of digests per group of rows, and one over the groups.

Nodes of a group are numbered in the order of their keys and dealt to aligned blocks of 3^HEIGHT. A
block keeps each of its levels as one string of hex digests: a parent is the digest of the next
fixed-width substring (a run of three nodes or what is left of it), and what flanks a node within its
run is its sibling segment. A block's root is a node of the next round, until one is left per group;
these subroots are the nodes of the tree over the groups. Everything is SQL functions; a block is the
most that one task holds, however large the group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenotide.functions.names import literal_col
from phenotide.llm.common import stored

FAN = 3
#: Levels above the nodes of a block.
HEIGHT = 5
BLOCK = FAN**HEIGHT
#: Hex digits of a digest, and of a run.
WIDTH = 64
RUN = FAN * WIDTH
#: Bits of monotonically_increasing_id that count the rows of a partition.
ROW_BITS = 33


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_of(*columns: Column) -> Column:
    """Digest of values, each `-` if null, else its number of UTF-8 bytes, `:` and itself as text."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give; path is a list of (left, right), lowest level first."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def _ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """Nodes with pos, their place in their group by the order, and n, the size of the group.

    Rows are dealt to ranges, which even equal rows are spread over, and numbered within; what lies
    before a range is a sum of one count per range and group.
    """
    by = [F.col("group"), *(F.col(c).asc_nulls_first() for c in order)]
    ranged = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by, "_tie").sortWithinPartitions(*by, "_tie")
    placed = stored(ranged.drop("_tie").withColumn("_row", F.monotonically_increasing_id()), "merkle-order").withColumn("_part", F.shiftright("_row", ROW_BITS))
    runs = placed.groupBy("group", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy("group")
    before = F.sum("_size").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("group", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_start"), F.sum("_size").over(whole).alias("n"))
    return placed.join(runs, ["group", "_part"]).withColumn("pos", F.col("_row") + F.col("_start")).drop("_row", "_part", "_start")


def _levels(nodes: DataFrame) -> DataFrame:
    """One row per block: group, block, n, last (the group has no other), height, members, the strings l0, l1 and so on, top, its root."""
    payload = [c for c in nodes.columns if c not in ("group", "pos", "n")]
    member = F.struct((F.col("pos") % BLOCK).cast("int").alias("at"), *payload)
    depth = sum((F.when(F.col("n") > FAN**k, 1).otherwise(0) for k in range(HEIGHT)), F.lit(0))
    blocks = (
        nodes.groupBy("group", F.floor(F.col("pos") / BLOCK).alias("block"), "n")
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
        .withColumns({"last": F.col("n") <= BLOCK, "height": depth, "l0": F.array_join(F.transform("members", lambda m: m["hash"]), "")})
    )
    for k in range(HEIGHT):
        parents = F.array_join(F.transform(_runs(f"l{k}"), digest), "")
        blocks = blocks.withColumn(f"l{k + 1}", F.when(F.col("height") > k, parents))
    return blocks.withColumn("top", F.coalesce(*(f"l{k}" for k in range(HEIGHT, -1, -1)))).drop(f"l{HEIGHT}")


def _runs(level: str) -> Column:
    """A level cut into runs."""
    starts = F.sequence(F.lit(1), F.length(level), F.lit(RUN))
    return F.transform(starts, lambda at: F.substring(F.col(level), at, F.lit(RUN)))


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The stored blocks of nodes, of their roots, and so on; rounds grow with the logarithm of the largest group."""
    rounds = [stored(_levels(nodes), "merkle-blocks")]
    while not (higher := rounds[-1].where(~F.col("last"))).isEmpty():
        nodes = higher.select("group", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("hash"))
        rounds.append(stored(_levels(nodes), "merkle-blocks"))
    return rounds


def _roots(rounds: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [r.where("last").select("group", F.col("top").alias("root")) for r in rounds])


def _paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """One row per node of the blocks: group, its columns, and path, its siblings up to the root.

    above: group, block, last, the path of a block's root, and columns that its nodes take over.
    """
    taken = [c for c in above.columns if c not in ("group", "block", "last", "path")]
    runs = [F.when(F.col("height") > k, _runs(f"l{k}")).alias(f"r{k}") for k in range(HEIGHT)]
    cut = blocks.join(above, ["group", "block", "last"]).select("group", "block", "height", "path", *taken, "members", *runs)
    each = cut.select("group", "block", "height", F.col("path").alias("rest"), *taken, *(f"r{k}" for k in range(HEIGHT)), F.explode("members").alias("m"))
    steps = []
    for k in range(HEIGHT):
        node = F.floor(F.col("m.at") / FAN**k).cast("int")
        run, place = F.get(f"r{k}", F.floor(node / FAN).cast("int")), node % FAN
        sides = F.struct(F.substring(run, F.lit(1), WIDTH * place).alias("left"), F.substring(run, WIDTH * (place + 1) + 1, F.lit(RUN)).alias("right"))
        steps.append(F.when(F.col("height") > k, sides))
    pos = (F.col("block") * BLOCK + F.col("m.at")).alias("pos")
    own = [f"m.{f.name}" for f in blocks.schema["members"].dataType.elementType if f.name != "at"]
    return each.select("group", pos, *own, *taken, F.concat(F.array_compact(F.array(*steps)), "rest").alias("path"))


def _down(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The nodes of the first round with their paths. tops: group, the path of its root, and columns to take over."""
    tops = tops.withColumns({"block": F.lit(0).cast("long"), "last": F.lit(True)})
    above = tops
    for blocks in rounds[:0:-1]:
        nodes = _paths(blocks, above).withColumnRenamed("pos", "block").drop("hash").withColumn("last", F.lit(False))
        above = tops.unionByName(nodes)
    return _paths(rounds[0], above)


def prove(rows: DataFrame, key: str, group: str, leaf: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: its key and the columns `carry`, leaf, subroot, root and path.

    Leaves of a group ascend by key; while there are several, every three consecutive ones (the last run
    may be shorter) become their digest, inputs concatenated as hex text. What remains is the group's
    subroot; subroots in the order of the groups' names (as text, bytewise, null first) likewise give
    the root. path lists the siblings (left, right) of each level from the leaf to the root, empty
    texts where there are none; a lone row of a lone group has an empty path, and its leaf is the root.

    Null keys come first. Rows of equal keys are ordered by leaf; between equal leaves any order gives
    the same digests. Repeated rows are leaves of their own, a null group is a group, an empty table
    has no rows. Columns that are not named are left out; the named ones may be called anything but
    leaf, subroot, root and path.
    """
    taken = {"leaf", "subroot", "root", "path"} & {key, *carry}
    if taken:
        raise ValueError(f"columns of the result cannot be carried: {sorted(taken)}")
    carried = {c: f"c{i}" for i, c in enumerate(dict.fromkeys((key, *carry)))}
    name = F.coalesce(F.concat(F.lit("="), literal_col(group).cast("string")), F.lit(""))
    nodes = rows.select(name.alias("group"), literal_col(leaf).alias("hash"), *(literal_col(c).alias(w) for c, w in carried.items()))
    rounds = _rounds(_ranked(stored(nodes, "merkle-leaves"), carried[key], "hash"))
    subroots = _roots(rounds).select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("root").alias("hash"))
    outer = _rounds(_ranked(subroots, "name"))
    empty = F.array().cast("array<struct<left: string, right: string>>")
    groups = _down(outer, _roots(outer).select("group", "root", empty.alias("path")))
    tops = groups.select(F.col("name").alias("group"), F.col("hash").alias("subroot"), "root", "path")
    proven = _down(rounds, stored(tops, "merkle-subroots"))
    return proven.select(*(F.col(w).alias(c) for c, w in carried.items()), F.col("hash").alias("leaf"), "subroot", "root", "path")
