"""Merkle manifest of a table: a tree for each group, a tree over the groups' roots, and a proof for each row.

Rows are ordered within their group by a range partitioning, so a large group lies in many tasks; numbers come
from the place in a range and the sizes of the ranges before it. A level is a window over group and parent
index: the ordered list of its whole frame, at most `fan` digests, is both the parent's preimage and the
siblings of each node. Parents are deduplicated and written before the next level. Proofs come down from the
top, each level reading the proof of its parents, so the rows of the table meet the steps above them in one join.

Defined results: null fields count as `-`; null groups are a group of their own, before all others; rows of one
group and key are ordered by digest, null keys first; repeated rows are leaves of their own, each with the
proof of its place; a lone leaf is its group's root; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweir.llm.common import discard, work_dir, written

#: Bits of monotonically_increasing_id that count rows within a partition.
_ROW_BITS = 33
STEPS = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Hexadecimal SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 length of the value as text, a colon and that text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that this leaf and the siblings of a proof lead to."""
    return F.aggregate(proof, leaf, lambda d, s: digest(s["before"], d, s["after"]))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, level by level and from left to right."""
    return F.concat_ws("", F.transform(proof, lambda s: F.concat(s["before"], s["after"])))


def _numbered(nodes: DataFrame, order: list[str], folder: str) -> DataFrame:
    """nodes with _i, their place in `_g` by `order`, and _n, the nodes of `_g`."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = written(nodes, f"{folder}/plain")  # digests are computed once; finding the ranges reads this as well
    keys = ["_g", *order]
    ranged = written(plain.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), f"{folder}/ranged")
    discard(spark, f"{folder}/plain")
    part = F.shiftright("_at", _ROW_BITS).alias("_part")
    runs = ranged.groupBy("_g", part).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_rows"))  # at most a row for each range and group
    w = Window.partitionBy("_g")
    before = F.sum("_rows").over(w.orderBy("_part")) - F.col("_rows")
    runs = written(runs.select("_g", "_part", (before - F.col("_from")).alias("_shift"), F.sum("_rows").over(w).alias("_n")), f"{folder}/runs")
    found = ranged.withColumn("_part", part).join(runs, ["_g", "_part"])
    return found.select(*nodes.columns, (F.col("_at") + F.col("_shift")).alias("_i"), "_n")


def _with_runs(nodes: DataFrame, fan: int) -> DataFrame:
    """Nodes that have a parent, with its index _up and digest _above, and their siblings' digests."""
    w = Window.partitionBy("_g", "_up").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.pmod("_i", F.lit(fan)).cast("int")
    run = nodes.where("_n > 1").withColumn("_up", F.floor(F.col("_i") / fan)).withColumn("_run", F.collect_list("_d").over(w))
    side = lambda a, b: F.concat_ws("", F.slice("_run", a, b))
    step = F.struct(side(F.lit(1), place).alias("before"), side(place + 2, F.lit(fan)).alias("after"))
    return run.withColumns({"_above": digest(F.concat_ws("", "_run")), "_step": step}).drop("_run")


def _trees(nodes: DataFrame, order: list[str], fan: int, folder: str, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each level, from the leaves up, and the top of each group as _g, _d and _level."""
    levels = [_numbered(nodes, order, f"{folder}/{name}0")]
    most = levels[0].agg(F.max("_n")).first()[0] or 0
    while most > 1:
        runs = _with_runs(levels[-1], fan).dropDuplicates(["_g", "_up"])
        up = runs.select("_g", F.col("_up").alias("_i"), F.ceil(F.col("_n") / fan).alias("_n"), F.col("_above").alias("_d"))
        levels.append(written(up, f"{folder}/{name}{len(levels)}"))
        most = -(-most // fan)
    tops = [x.where("_n = 1").select("_g", "_d", F.lit(k).alias("_level")) for k, x in enumerate(levels)]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return levels, written(out, f"{folder}/{name}-tops")


def _proofs(levels: list[DataFrame], tops: DataFrame, fan: int, carried: list[str]) -> DataFrame:
    """The leaves with `_proof` and the carried columns; tops holds these for the top node of each group."""
    above = None
    for k in reversed(range(len(levels))):
        here = tops.where(F.col("_level") == k).select("_g", F.lit(-1).cast("long").alias("_up"), F.col("_proof").alias("_rest"), *carried)
        above = here if above is None else here.unionByName(above)
        own = [c for c in levels[k].columns if c not in ("_g", "_i", "_n", "_d")] if k == 0 else []
        kept = ["_g", "_i", "_n", "_d", *own]
        inner = _with_runs(levels[k], fan).select(*kept, "_up", F.array("_step").alias("_steps"))
        lone = levels[k].where("_n = 1").select(*kept, F.lit(-1).cast("long").alias("_up"), F.array().cast(STEPS).alias("_steps"))
        joined = inner.unionByName(lone).join(above, ["_g", "_up"]).withColumn("_proof", F.concat("_steps", "_rest"))
        if k == 0:
            return joined.select("_g", "_d", *own, "_proof", *carried)
        above = joined.select("_g", F.col("_i").alias("_up"), F.col("_proof").alias("_rest"), *carried)
    raise AssertionError("there is a level of leaves")


def prove(leaves: DataFrame, group: str, key: str, leaf: str = "leaf", fan: int = 8) -> DataFrame:
    """leaves with subroot, root and proof: an array of (before, after), what stands beside a node on its way up.

    `leaf` holds each row's digest; further columns are carried along. proof leads from the leaf through the
    subroot to the root: fold(leaf, proof) is the root of an untouched row.
    """
    folder = work_dir(leaves.sparkSession, "merkle")
    names = leaves.columns
    rest = [c for c in names if c not in (group, key, leaf)]
    plain = leaves.toDF(*[f"_c{i}" for i in range(len(names))])
    col = {c: F.col(f"_c{i}") for i, c in enumerate(names)}
    named = F.coalesce(F.concat(F.lit("="), col[group].cast("string")), F.lit(""))  # null groups first, then by bytes
    nodes = plain.select(named.alias("_g"), col[group].alias("_group"), col[key].alias("_key"), col[leaf].alias("_d"), *[col[c].alias(f"_r{i}") for i, c in enumerate(rest)])
    levels, tops = _trees(nodes, ["_key", "_d", *[f"_r{i}" for i in range(len(rest))]], fan, folder, "leaves")

    roots, over = _trees(tops.select(F.lit("").alias("_g"), F.col("_g").alias("_name"), "_d"), ["_name"], fan, folder, "groups")
    over = over.select("_g", "_level", F.array().cast(STEPS).alias("_proof"), F.col("_d").alias("_root"))
    proven = _proofs(roots, over, fan, ["_root"]).select(F.col("_name").alias("_g"), F.col("_d").alias("_subroot"), "_proof", "_root")
    proven = written(proven.join(tops.select("_g", "_level"), "_g"), f"{folder}/groups-proven")

    out = _proofs(levels, proven, fan, ["_subroot", "_root"])
    place = {group: "_group", key: "_key", leaf: "_d"} | {c: f"_r{i}" for i, c in enumerate(rest)}
    return out.select(*[F.col(place[c]).alias(c) for c in names], F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_proof").alias("proof"))
