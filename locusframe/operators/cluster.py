"""Clustering of observations and candidates.

Three algorithms with rules of their own: gap merge with a running maximum (window functions), greedy leaders, and
sequential merge into the open group. Observations are written once, since each algorithm goes over them more than once and they may
be dear to make. The latter two fold over what decides, in order: distinct places for leaders, rows for open groups. The order is
cut into chunks of bounded size, each folded with what the chunk before it leaves open, and only chunks for which that has changed
are folded again, so that one deep pile of reads is many tasks. Rows without a neighbour within the window are never folded.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import end_of, similar_lengths
from ..steps import Steps, ship_package
from . import places
from .places import before, stretch_of

_ORDER = ["read_idx", "obs_idx"]
#: Items of a chunk.
CHUNK = 1 << 14


def _median(c: str):
    return F.percentile(c, F.lit(0.5)).cast("int")


def gap_merge(candidates: DataFrame, window: int = 50, min_support: int = 2) -> DataFrame:
    """chrom, start, end, type, support, median_sv_len, reads of clusters of per-read candidates.

    By start, a row joins while it starts within ``window`` of the largest end so far. Support counts distinct
    reads, the median all rows.
    """
    keys = ["chrom", "sv_type"]
    rows = Steps(candidates.sparkSession).stash(candidates.select(*keys, "start", "end", "read_name", "sv_len", stretch_of("start").alias("_stretch")), "gap-merge")
    inside = Window.partitionBy(*keys, "_stretch").orderBy("start", "end", "read_name")
    reach = rows.groupBy(*keys, "_stretch").agg(F.max("end").alias("_end"))
    reach = reach.select(*keys, "_stretch", F.max("_end").over(before(keys)).alias("_carry"))
    largest = F.greatest(F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), "_carry")
    marked = rows.join(reach, [*keys, "_stretch"]).withColumn("_new", F.when(F.col("start") <= largest + window, 0).otherwise(1))
    offsets = marked.groupBy(*keys, "_stretch").agg(F.sum("_new").alias("_k"))
    offsets = offsets.select(*keys, "_stretch", F.coalesce(F.sum("_k").over(before(keys)), F.lit(0)).alias("_offset"))
    counted = marked.withColumn("_inner", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = counted.join(offsets, [*keys, "_stretch"]).withColumn("_c", F.col("_offset") + F.col("_inner"))
    out = numbered.groupBy("chrom", "sv_type", "_c").agg(F.min("start").alias("start"), F.max("end").alias("end"), _median("sv_len").alias("median_sv_len"), F.array_sort(F.collect_set("read_name")).alias("reads"))
    # the names are part of the row, so they are counted there
    return out.withColumn("support", F.size("reads").cast("long")).filter(F.col("support") >= min_support).select("chrom", "start", "end", F.col("sv_type").alias("type"), "support", "median_sv_len", "reads")


def _near(items: DataFrame, keys: list[str], fields: list[str], window: int) -> DataFrame:
    """Chunks (keys, _stretch, _part, _from, items) of the items that have a neighbour within the window, in order of ``fields``."""
    pos = fields[0]
    inside = Window.partitionBy(*keys, "_stretch").orderBy(*fields)
    gap = lambda other: F.coalesce(F.abs(F.col(pos) - other) <= window, F.lit(True))  # noqa: E731  unknown at the edges of a stretch
    near = items.withColumn("_stretch", stretch_of(pos)).withColumn("_near", gap(F.lag(pos).over(inside)) | gap(F.lead(pos).over(inside))).filter("_near")
    numbered = near.withColumn("_part", F.floor((F.row_number().over(inside) - 1) / CHUNK))
    item = F.struct(*fields)
    return numbered.groupBy(*keys, "_stretch", "_part").agg(F.min(pos).alias("_from"), F.array_sort(F.collect_list(item)).alias("items"))


def _settled(chunks: DataFrame, keys: list[str], steps: Steps, fold: Callable[[DataFrame], DataFrame], carry: str, window: int) -> DataFrame:
    """Chunks folded with what those before them leave open; ``fold`` adds labels and out to items and carry (of type ``carry``).

    Chunks are folded as if nothing were open; then those are folded again that get something else, until none does. That ends, as the first
    chunk of a key is right at once and each round settles one more at least; most places settle behind the first gap.
    """
    at, none = [*keys, "_stretch", "_part"], F.array().cast(carry)
    state = steps.stash(fold(chunks.withColumn("carry", none)), "chunks")
    while True:
        told = F.lag("out").over(Window.partitionBy(*keys).orderBy("_stretch", "_part"))
        want = F.coalesce(F.filter(told, lambda x: x["pos"] >= F.col("_from") - window), none)
        changed = state.select(*at, "_from", "carry", "out").withColumn("_want", want).filter(F.col("_want") != F.col("carry")).select(*at, "_want")
        if changed.isEmpty():
            return state
        changed = steps.stash(changed, "changed")
        again = fold(state.join(changed, at).drop("labels", "out", "carry").withColumnRenamed("_want", "carry"))
        settled = steps.stash(state.join(changed, at, "left_anti").unionByName(again), "chunks")
        for old in (state, changed):
            steps.drop(old)
        state = settled


def _in_python(step: Callable, columns: list[str], label: str, carry: str) -> Callable[[DataFrame], DataFrame]:
    """A fold in Python over the Arrow lists of chunks: ``step`` gets the fields of the items and the carry, and gives labels and what it leaves open."""

    def fold(chunks: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
        return chunks.mapInArrow(lambda batches: _folded(batches, step, columns, (label, carry)), f"{schema}, labels array<{label}>, out {carry}")

    return fold


def _folded(batches, step: Callable, columns: list[str], kinds: tuple[str, str]):
    for batch in batches:
        items, carry = batch.column("items"), batch.column("carry").to_pylist()
        fields = [items.values.field(c).to_pylist() for c in columns]
        offsets = items.offsets.to_pylist()
        made = [step([f[a:b] for f in fields], held) for a, b, held in zip(offsets[:-1], offsets[1:], carry, strict=True)]
        labels = [x for x, _ in made]
        out = pa.array([x for _, x in made], batch.schema.field("carry").type)
        kind = items.type if kinds[0].startswith("struct") else pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, kind), out], names=[*batch.schema.names, "labels", "out"])


def _leaders(positions: list[list[int]], lengths: list[int] | None, window: int, held: int = 0) -> tuple[list[int], list[int]]:
    """For each row, in order, the number of its leader, the first earlier leader that matches or itself, and the leaders still open at the end.

    The first ``held`` rows are leaders already. Leaders whose first position lies more than the window behind can't match any more.
    """
    out, live = list(range(held)), list(range(held))
    for i, p in enumerate(zip(*positions, strict=True)):
        if i < held:
            continue
        live = [j for j in live if positions[0][j] >= p[0] - window]
        for j in live:
            if all(abs(x - positions[d][j]) <= window for d, x in enumerate(p)) and (lengths is None or similar_lengths(lengths[i], lengths[j])):
                out.append(j)
                break
        else:
            out.append(i)
            live.append(i)
    return out, live


def greedy_leaders(rows: DataFrame, steps: Steps, keys: list[str], positions: list[str], window: int, length: str | None = None) -> DataFrame:
    """``rows`` with _leader: positions (and length) of the leader that claims them.

    Rows go in the order of (positions, length, read_idx, obs_idx); a row is claimed by the first leader within the
    window on each position and, if given, of similar length, always measured against the leader. Rows of equal places have
    one leader, so distinct places are folded. A single position without lengths is folded by an expression, others in Python.
    """
    places_ = [*positions, *([length] if length else [])]
    fields = [f"_{c}" if c != positions[0] else "pos" for c in places_]
    kind = "struct<" + ",".join(f"{f}:int" for f in fields) + ">"
    named = rows.select(*keys, *[F.col(c).cast("int").alias(f) for c, f in zip(places_, fields, strict=True)]).distinct()

    def claim(items: list[list[int]], carry: list[dict]) -> tuple[list[dict], list[dict]]:
        columns = [[x[f] for x in carry] + some for f, some in zip(fields, items, strict=True)]
        n = len(positions)
        lead, live = _leaders(columns[:n], columns[n] if length else None, window, len(carry))
        told = lambda j: {f: c[j] for f, c in zip(fields, columns, strict=True)}
        return [told(j) for j in lead[len(carry) :]], [told(j) for j in live]

    if len(fields) > 1:
        ship_package(rows.sparkSession)
    fold = _in_python(claim, fields, kind, f"array<{kind}>") if len(fields) > 1 else lambda chunks: _claimed_natively(chunks, window)
    chunks = _settled(_near(named, keys, fields, window), keys, steps, fold, f"array<{kind}>", window)
    pair = F.explode(F.arrays_zip("items", "labels")).alias("x")
    lead = chunks.select(*keys, pair).select(*keys, *[F.col(f"x.items.{f}").alias(c) for c, f in zip(places_, fields, strict=True)], F.col("x.labels").alias("_lead"))
    own = F.struct(*[F.col(c).cast("int").alias(f) for c, f in zip(places_, fields, strict=True)])
    return rows.join(lead, [*keys, *places_], "left").withColumn("_leader", F.coalesce("_lead", own)).drop("_lead")


def _claimed_natively(chunks: DataFrame, window: int) -> DataFrame:
    """Leaders of single positions: the last leader claims what lies within the window behind it. One fold with it as its state."""
    kind = chunks.schema["items"].dataType.simpleString()
    start = F.struct(F.element_at("carry", -1)["pos"].alias("lead"), F.array().cast("array<int>").alias("labels"))
    start = F.when(F.size("carry") > 0, start).otherwise(F.struct(F.lit(None).cast("int").alias("lead"), F.array().cast("array<int>").alias("labels")))

    def step(acc: Column, x: Column) -> Column:
        lead = F.when(x["pos"] <= acc["lead"] + window, acc["lead"]).otherwise(x["pos"])
        return F.struct(lead.alias("lead"), F.array_append(acc["labels"], lead).alias("labels"))

    folded = chunks.withColumn("_acc", F.aggregate("items", start, step))
    wrapped = lambda c: F.transform(c, lambda p: F.struct(p.alias("pos"))).cast(kind)
    return folded.withColumns({"labels": wrapped(F.col("_acc.labels")), "out": wrapped(F.array("_acc.lead"))}).drop("_acc")


def _examples(led: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Names of the first reads of each cluster. Tasks rank and cut their own rows first, so no task gets all rows of a deep cluster."""
    by = [*keys, "_leader"]
    first = led.select(*by, *order, "rname").withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= most)
    return first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "rname"))), lambda x: x["rname"]), ",").alias("example_reads"))


def _clusters(obs: DataFrame, keys: list[str], positions: list[str], window: int, max_names: int, length: str | None, **more: Column) -> DataFrame:
    """Clusters by greedy leaders: medians of positions, length and mapping quality, support by rows and by reads, first names, and ``more`` aggregates."""
    steps = Steps(obs.sparkSession)
    obs = steps.stash(obs, "observations")
    led = greedy_leaders(obs, steps, keys, positions, window, length)
    places_ = [*positions, *([length] if length else [])]
    out = led.groupBy(*keys, "_leader").agg(*[_median(c).alias(c) for c in places_], F.count(F.lit(1)).alias("support"), _median("mapq").alias("median_mapq"), F.countDistinct("rname").alias("support_distinct"), *[c.alias(name) for name, c in more.items()])
    return out.join(_examples(led, keys, [*places_, *_ORDER], max_names), [*keys, "_leader"]).drop("_leader")


def indel_clusters(obs: DataFrame, window: int = 10, max_names: int = 3) -> DataFrame:
    """Greedy-leader clusters of insertions and deletions: medians, row-count support, first names, first inserted sequence, and distinct reads."""
    bases = (F.col("svtype") == "INS") & (F.col("seq") != "")
    first = F.min_by(F.when(bases, F.col("seq")), F.when(bases, F.struct("pos", "length", *_ORDER)))
    out = _clusters(obs, ["chrom", "svtype"], ["pos"], window, max_names, "length", example_ins_seq=F.coalesce(first, F.lit("")))
    end = end_of(F.col("svtype"), F.col("pos"), F.col("length"))
    return out.select("chrom", "pos", end.alias("end"), "svtype", "length", "support", "median_mapq", "example_reads", "example_ins_seq", "support_distinct")


def clip_clusters(obs: DataFrame, window: int = 10, max_names: int = 3) -> DataFrame:
    """Greedy-leader clusters of clips by position."""
    out = _clusters(obs, ["chrom", "side"], ["pos"], window, max_names, None, median_cliplen=_median("cliplen"))
    return out.select("chrom", "pos", "side", "support", "median_mapq", "median_cliplen", "example_reads", "support_distinct")


def split_clusters(obs: DataFrame, window: int = 10, max_names: int = 3) -> DataFrame:
    """Greedy-leader clusters of split reads between chromosomes, by both positions."""
    notes = F.array_join(F.array_sort(F.collect_set("note")), "|")
    out = _clusters(obs.filter(~F.col("same_chrom")), ["chrom1", "chrom2"], ["pos1", "pos2"], window, max_names, None, notes=notes)
    return out.select("chrom1", "pos1", "chrom2", "pos2", "support", "median_mapq", "notes", "example_reads", "support_distinct")


def _open_groups(pos: list[int], ords: list[int], end: list[int], window: int, carry: list[dict]) -> tuple[list[int | None], list[dict]]:
    """For each row, in order of (position, ord), the ord of the first row of its group, and the members of the group that is open at the end.

    Rows of the group that the carry holds have no ord, so what is left open doesn't depend on where a long group began.

    A row joins the open group if it is within the window of one member on both ends, else it opens a new one.
    Members whose position lies more than the window behind can't take anyone in any more; of members at one place one is enough.
    """
    members = {(x["pos"], x["end"]): None for x in carry}
    first, out = None, []
    for p, o, e in zip(pos, ords, end, strict=True):
        members = {m: None for m in members if m[0] >= p - window} if members and next(iter(members))[0] < p - window else members
        if not any(abs(e - f) <= window for _, f in members):
            first, members = o, {}
        members[p, e] = None
        out.append(first)
    return out, [{"pos": p, "end": e} for p, e in sorted(members)]


def sequential_merge(candidates: DataFrame, window: int = 50, min_support: int = 2, compat: bool = False) -> DataFrame:
    """Groups of candidates (ord, chrom, pos, end, svtype, svlen, read, mapq, support) and their representative, a row each.

    chrom, pos, end and baseline_read of the first row of largest support; svlen the truncated mean (exported as
    median_sv_len); mapq the best; support the sum. With ``compat`` the last group of each (chrom, svtype) is
    lost but for the key that comes last by first appearance.
    """
    steps, keys = Steps(candidates.sparkSession), ["chrom", "svtype"]
    ship_package(candidates.sparkSession)
    rows = steps.stash(candidates.withColumn("support", F.coalesce("support", F.lit(1)).cast("long")), "candidates")
    items = rows.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("ord").cast("long").alias("ord"), F.col("end").cast("long").alias("end"))
    follow = lambda fields, carry: _open_groups(*fields, window, carry)
    carry = "array<struct<pos:bigint,end:bigint>>"
    chunks = _settled(_near(items, keys, ["pos", "ord", "end"], window), keys, steps, _in_python(follow, ["pos", "ord", "end"], "bigint", carry), carry, window)
    # a chunk whose rows all belong to the carried group has no label of its own
    latest = F.last(F.element_at("labels", -1), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_stretch", "_part").rowsBetween(Window.unboundedPreceding, -1))
    opened = chunks.select(*keys, "_stretch", "_part", latest.alias("_open"))
    pair = F.explode(F.arrays_zip("items", "labels")).alias("x")
    led = chunks.join(opened, [*keys, "_stretch", "_part"]).select("_open", pair).select(F.col("x.items.ord").alias("ord"), F.coalesce("x.labels", "_open").alias("_first"))
    grouped = rows.join(led, "ord", "left").withColumn("first", F.coalesce("_first", "ord")).drop("_first")
    best = F.max_by(F.struct("pos", "end", "read", "support"), F.struct("support", -F.struct("pos", "ord")["pos"], -F.col("ord")))
    out = grouped.groupBy("chrom", "svtype", "first").agg(
        best.alias("base"),
        F.count(F.lit(1)).alias("merged_count"),
        F.sum("support").alias("support"),
        F.avg("svlen").cast("int").alias("median_sv_len"),
        F.max("mapq").alias("mapq"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ord", F.concat_ws(":", "chrom", "pos", "end").alias("t")))), lambda x: x["t"]), ",").alias("read_positions"),
        F.min("ord").alias("least_ord"),
        F.max(F.struct("pos", "ord")).alias("last_row"),
    )
    if compat:
        keys = candidates.groupBy("chrom", "svtype").agg(F.min("ord").alias("key_ord"))
        final = keys.agg(F.max("key_ord").alias("final_ord"))
        w = Window.partitionBy("chrom", "svtype")
        out = out.withColumn("_last", F.col("last_row") == F.max("last_row").over(w)).join(keys, ["chrom", "svtype"]).join(F.broadcast(final))
        out = out.filter(~F.col("_last") | (F.col("key_ord") == F.col("final_ord")))
    out = out.filter(F.col("support") >= min_support)
    read = F.when(F.col("merged_count") == 1, F.col("base.read")).otherwise(F.format_string("merged_%d_candidates", "merged_count"))
    return out.select("chrom", F.col("base.pos").alias("pos"), F.col("base.end").alias("end"), "svtype", "support", "median_sv_len", "mapq", "merged_count", read.alias("read"), "read_positions", F.col("base.read").alias("baseline_read"), F.col("base.support").alias("baseline_support"), F.lit(0).alias("window_expansion"))
