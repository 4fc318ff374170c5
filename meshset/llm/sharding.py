"""Sharding by a hierarchical weighted hash tree (operator 10).

The tree is a space of places: regions, racks in a region, shards in a rack, as
many of each as the tree could ever hold, of which some are leaves with weights.
A key makes one draw after another.  A draw descends: one part of its digest picks
a region, one a rack there, one a place in that rack, and the last one is a height
below the largest weight that a leaf may have.  The first draw that meets a leaf
at a height below its weight decides.  So only the branch that was drawn is looked
at, each leaf gets keys in proportion to its weight, and each subtree in proportion
to the sum of its leaves' weights.  Draws don't depend on the weights: when a leaf's
weight grows, or a leaf is added, some keys meet it with an earlier draw and move
to it, and no others move; when it shrinks, only keys of its own move on.  That holds
for the subtrees above it as well.  After ``DRAWS`` draws that met nothing, which few
keys in a well-filled tree make, the leaf with the smallest of the leaves' own
exponential draws decides, which moves keys in the same way.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshset.llm.common import materialise

DRAWS = 16


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


class Tree(NamedTuple):
    """Leaves by (region, rack, place in the rack) and what the levels have room for; room and ``heaviest`` must outlast growth."""

    leaves: dict[tuple[int, int, int], Leaf]
    regions: int = 4
    racks: int = 2
    per_rack: int = 2
    heaviest: float = 1.0


def topology(shards: int, regions: int = 4, racks: int = 2, per_rack: int = 2, weights: dict[int, float] | None = None, heaviest: float = 1.0) -> Tree:
    """Shards numbered from 0, ``per_rack`` to a rack and ``racks`` racks to a region; growth only appends."""
    if shards > regions * racks * per_rack or max((weights or {}).values(), default=0) > heaviest:
        raise ValueError("the tree has no room for these shards")
    places = {(s // (per_rack * racks), s // per_rack % racks, s % per_rack): s for s in range(shards)}
    return Tree({p: Leaf(p[0], p[1], s, (weights or {}).get(s, 1.0)) for p, s in places.items()}, regions, racks, per_rack, heaviest)


def _part(digest: str, first: int, digits: int) -> str:
    return f"cast(conv(substring({digest}, {first}, {digits}), 16, 10) as bigint)"


def _draw(key: str, nth: int, tree: Tree) -> str:
    """The shard that the nth draw of a key meets, or null."""
    d = "d.x"
    region, rack, place = f"{_part(d, 1, 6)} % {tree.regions}", f"{_part(d, 7, 6)} % {tree.racks}", f"{_part(d, 13, 6)} % {tree.per_rack}"
    height = f"{_part(d, 19, 13)} / {float(1 << 52)!r}D * {float(tree.heaviest)!r}D"
    below: dict[int, dict[int, dict[int, Leaf]]] = {}
    for (r, k, p), leaf in sorted(tree.leaves.items()):
        below.setdefault(r, {}).setdefault(k, {})[p] = leaf
    full = lambda leaf: leaf.weight >= tree.heaviest
    at = lambda leaf: str(leaf.shard) if full(leaf) else f"case when {height} < {float(leaf.weight)!r}D then {leaf.shard} end"
    choose = lambda by, options: f"case {by} {' '.join(f'when {k} then {v}' for k, v in options.items())} end"
    down = choose(region, {r: choose(rack, {k: choose(place, {p: at(leaf) for p, leaf in places.items()}) for k, places in racks.items()}) for r, racks in below.items()})
    return f"element_at(transform(array(named_struct('x', md5(concat({key}, '@{nth}')))), d -> {down}), 1)"


def _rest(key: str, tree: Tree) -> str:
    """The leaf with the smallest of its own draws, -ln(u) / weight with u of 52 bits by the leaf's place."""
    u = lambda p: f"({_part(f'md5(concat({key}, {chr(39)}@{p[0]}/{p[1]}/{p[2]}{chr(39)}))', 1, 13)} + 0.5D) / {float(1 << 52)!r}D"
    own = [f"named_struct('d', -ln({u(p)}) / {float(leaf.weight)!r}D, 's', {leaf.shard})" for p, leaf in tree.leaves.items()]
    return f"array_min(array({', '.join(own)})).s"


def shard_of(df: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """Add the column ``out``: the shard that the string column ``key`` descends to; later draws are made only where earlier ones met nothing."""
    return df.withColumn(out, F.expr(f"cast(coalesce({', '.join(_draw(key, n, tree) for n in range(DRAWS))}, {_rest(key, tree)}) as int)"))


def shard(df: DataFrame, tree: Tree, grown: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, law ('key'), shard, slot, grown_shard of every row.

    Only the id and the tree decide, so copies of a row share a shard.  A null
    id is a key of its own; a null text is empty (size 1, checksum 0).  Slots
    number the rows of a shard from 0 in the order of id, checksum and size: a
    range exchange of narrow rows, then local numbers plus the counts of earlier
    partitions; no shard and no crowd of equal rows meets in one task.  Other
    columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("__key"),
    )
    rows = rows.withColumn("__row", F.monotonically_increasing_id())  # tells equal rows apart in the order
    rows = shard_of(shard_of(rows, "__key", tree, "shard"), "__key", grown, "grown_shard").drop("__key")
    return slots(materialise(rows, "shards"), "shard", ["doc_id", "text_crc32", "size", "__row"]).drop("__row")


def slots(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Add ``slot``: 0, 1, ... within each key in the order of ``by``, without gathering a key in one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(n, key, *by).sortWithinPartitions(key, *by)
    # the id of a row is its partition's number and its place there
    spread = materialise(spread.withColumn("__id", F.monotonically_increasing_id()), "slots")
    parts = spread.groupBy(key, F.shiftright("__id", 33).alias("__part")).agg(F.count("*").alias("__n"), F.min("__id").alias("__low"))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select(F.col(key).alias("__key"), "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__low")).alias("__first"))
    joined = spread.withColumn("__part", F.shiftright("__id", 33)).join(first.withColumnRenamed("__part", "__p"), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn("slot", F.col("__id") + F.col("__first")).drop("__id", "__part", "__p", "__key", "__first")
