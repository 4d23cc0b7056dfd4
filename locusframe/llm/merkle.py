"""Merkle manifest of a dataset: parent-preimage paths.

A tree of three children for each parent stands over the rows of each group, and one of the same kind over the groups'
roots. What is stored of a parent is its preimage, the hashes of its children one behind the other. A leaf joins the
preimages of its ancestors; its siblings are what is left of a preimage without its own slot of 64 characters, and the
root comes again by putting a hash into the slot and hashing, level by level.

Three levels are made in one shuffle: a block is a run of 27 nodes with the preimages above them, so blocks get fewer by
27 for each step, and the way of a leaf is one join with its block, which has got the way of its own top before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps

#: Children of a parent, and characters of a hash.
FANOUT, HASH = 3, 64
_BLOCK = FANOUT**3
#: Groups whose roots and ways are broadcast, some 2 kB each; more of them are joined by their key.
MOST_GROUPS = 10_000


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one behind the other."""
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def field(c: Column) -> Column:
    """A value as it goes into a leaf: byte count, colon, text; '-' for null."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return digest(*map(field, fields))


def numbered(df: DataFrame, steps: Steps, key: str, order: list[str], label: str) -> DataFrame:
    """``df`` with _at, the place from 0 of each row among those of its key by ``order``, and _n, their number.

    Rows are sorted by range and written, so that places hold; a row for each key and range carries the counts before
    it. Equal rows are told apart by their place in the input, so that a row that is there very often has many ranges.
    """
    mixed = df.withColumn("_input", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in (key, *order, "_input")]
    ranged = mixed.repartitionByRange(*by).sortWithinPartitions(*by).drop("_input").withColumn("_row", F.monotonically_increasing_id())
    rows = steps.stash(ranged, label).withColumn("_range", F.shiftright("_row", 33))
    counts = rows.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_k"), F.min("_row").alias("_first"))
    of = Window.partitionBy(key)
    before = F.sum("_k").over(of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select(key, "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_k").over(of).alias("_n"))
    return rows.join(shifts, [key, "_range"]).withColumn("_at", F.col("_row") + F.col("_shift")).drop("_row", "_range", "_shift")


def _height() -> Column:
    """Levels above _n leaves until one node is left."""
    return F.size(F.filter(F.array(*[F.lit(FANOUT**k) for k in range(39)]), lambda p: p < F.col("_n")))


def _runs(hashes: Column) -> Column:
    """Preimages of the parents of these nodes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / FANOUT).cast("int")), lambda j: F.array_join(F.slice(hashes, j * FANOUT + 1, FANOUT), ""))


def build(nodes: DataFrame, steps: Steps, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each three levels from the leaves up, and the roots (_g, _root), of ``nodes`` (_g, _at, _n, _hash).

    A block has _g, _block (its number in its step), _n, the preimages of its levels p1, p2, p3 (null above the root) and
    _top, the hash of its highest node.
    """
    most = nodes.agg(F.max("_n")).first()[0] or 1
    blocks, roots, done = [], None, 0
    while not blocks or most > FANOUT**done:
        made = nodes.groupBy("_g", F.expr(f"_at div {_BLOCK}").alias("_block")).agg(F.max("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_at", "_hash"))).alias("_c"))
        level = F.transform("_c", lambda x: x["_hash"])
        made = made.withColumn("_hashes", level).withColumn("_top", F.get("_hashes", F.lit(0)))
        for k in (1, 2, 3):
            made = made.withColumn(f"p{k}", F.when(_height() >= done + k, _runs(F.col("_hashes"))))
            made = made.withColumn("_hashes", F.transform(f"p{k}", lambda x: digest(x))).withColumn("_top", F.coalesce(F.get("_hashes", F.lit(0)), "_top"))
        made = steps.stash(made.select("_g", "_block", "_n", "p1", "p2", "p3", "_top"), f"{label}-{done}")
        blocks.append(made)
        done += 3
        top = made.filter(_height() <= done).select("_g", F.col("_top").alias("_root"))
        roots = top if roots is None else roots.union(top)
        nodes = made.filter(_height() > done).select("_g", F.col("_block").alias("_at"), "_n", F.col("_top").alias("_hash"))
    return blocks, roots


def _climb(nodes: DataFrame, blocks: DataFrame | None, also: tuple[str, ...] = ()) -> DataFrame:
    """``nodes`` (_g, _at, …) with _path, preimage and own slot of each ancestor from the parent to the root, and the columns ``also`` of their block."""
    none = F.array().cast("array<struct<pre:string,slot:int>>")
    if blocks is None:
        return nodes.withColumn("_path", none)
    r = F.expr(f"_at % {_BLOCK}").cast("int")
    step = lambda p, over: F.struct(F.get(p, F.floor(r / (over * FANOUT)).cast("int")).alias("pre"), (F.floor(r / over) % FANOUT).cast("int").alias("slot"))
    own = F.filter(F.array(step("p1", 1), step("p2", FANOUT), step("p3", FANOUT**2)), lambda x: x["pre"].isNotNull())
    above = blocks.select("_g", F.col("_block").alias("_up"), "p1", "p2", "p3", F.col("_path").alias("_above"), *also)
    met = nodes.withColumn("_up", F.expr(f"_at div {_BLOCK}")).join(above, ["_g", "_up"], "left")
    return met.withColumn("_path", F.concat(own, F.coalesce("_above", none))).drop("_up", "p1", "p2", "p3", "_above")


def _with_paths(blocks: list[DataFrame]) -> DataFrame:
    """The lowest blocks, each with the way of its top node."""
    over = None
    for some in reversed(blocks):
        over = _climb(some.select("_g", F.col("_block").alias("_at"), *[F.col(f"p{k}").alias(f"_p{k}") for k in (1, 2, 3)]), over)
        over = over.select("_g", F.col("_at").alias("_block"), *[F.col(f"_p{k}").alias(f"p{k}") for k in (1, 2, 3)], "_path")
    return over


def siblings(step: Column) -> Column:
    """A preimage without its own slot."""
    at = step["slot"] * HASH
    return F.concat(F.substring(step["pre"], F.lit(1), at), F.substring(step["pre"], at + HASH + 1, F.length(step["pre"])))


def proof(path: Column) -> Column:
    """One hash over all siblings, from the leaf's to the root's."""
    return digest(F.array_join(F.transform(path, siblings), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that the leaf gives when it is put into its slot, and each hash into the next one."""

    def splice(acc: Column, step: Column) -> Column:
        at = step["slot"] * HASH
        return digest(F.substring(step["pre"], F.lit(1), at), acc, F.substring(step["pre"], at + HASH + 1, F.length(step["pre"])))

    return F.aggregate(path, leaf, splice)


def manifest(leaves: DataFrame, steps: Steps, group: str, order: list[str], leaf: str) -> DataFrame:
    """``leaves`` with path, subroot (of their group) and root.

    Inside a group rows go by ``order``, nulls first, then by their leaf; groups go by their text, the null group first.
    Equal rows are leaves of their own. An empty table gives no rows. Other columns come along; none may begin with an
    underscore or be named p1, p2, p3, path, subroot or root.
    """
    keyed = leaves.withColumn("_g", F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")))
    rows = numbered(keyed, steps, "_g", [*order, leaf], "merkle-leaves")
    blocks, subroots = build(rows.select("_g", "_at", "_n", F.col(leaf).alias("_hash")), steps, "merkle-blocks")
    groups = numbered(subroots.select(F.lit("").alias("_all"), F.col("_g").alias("_group"), "_root"), steps, "_all", ["_group"], "merkle-groups")
    groups = groups.select(F.col("_all").alias("_g"), "_at", "_n", "_group", F.col("_root").alias("_hash"))
    upper, top = build(groups, steps, "merkle-upper")
    known = _climb(groups, _with_paths(upper)).join(F.broadcast(top.select(F.col("_root").alias("root"))))  # one row
    known = steps.stash(known.select(F.col("_group").alias("_g"), F.col("_hash").alias("subroot"), F.col("_path").alias("_rest"), "root"), "merkle-known")
    lowest = _with_paths(blocks).join(F.broadcast(known) if known.count() <= MOST_GROUPS else known, "_g")
    lowest = lowest.withColumn("_path", F.concat("_path", "_rest"))
    return _climb(rows, lowest, ("subroot", "root")).withColumnRenamed("_path", "path").drop("_g", "_at", "_n")


# What a leaf holds of a document, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each document (FIELDS; groups are sources).

    Line feeds are taken out of the texts of documents whose decimal doc_id has an even CRC-32; the root is then folded
    from the changed leaf and must differ. Nulls are '-', an empty text is '0:'; rows without doc_id go first and are never
    changed. Rows that agree in everything are leaves of their own, and their proofs tell their places apart. Other columns don't count.
    """
    steps = Steps(docs.sparkSession)
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    value = {c: F.col(c) for c in FIELDS}
    text = F.when(changed, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", leaf_of([*value.values()]).alias("leaf"), leaf_of([*(value | {"text": text}).values()]).alias("told"))
    out = manifest(rows, steps, "source", ["doc_id"], "leaf")
    out = out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.col("told"), F.col("path")).alias("folded_root"))
    return steps.keep(out.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle")
