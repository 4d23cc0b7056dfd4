"""Near-duplicate documents by SetSketch registers, verified on full shingle sets.

Registers are exponentially spaced truncated minima: register i of a set is ``floor(1 - log_b(h))``, cut to
16 bits, where h is the least of the set's exponential hashes i. They merge by maximum, and equal registers
show similar sets. Bands of registers give candidates, the joint likelihood of two sketches estimates their
similarity, and full sets confirm each link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, flat, lowered, mixed, ragged, slices, span_hashes, word_spans

BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
BANDS, ROWS = 32, 3
#: Estimates below the threshold by no more than five standard deviations of the estimator go on to the full sets; infinity sends all.
DEVIATIONS = 5.0
#: Buckets of up to so many sets are paired by a join, larger ones are compared in blocks; both ways are complete.
SMALL = 16
#: Sets of a block, and the sum of their shingles; a larger group has more blocks.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1 << 19
#: Sets with an element up to which their pairs are listed, and elements of an incidence matrix.
FEW, _COLUMNS = 12, 2048

_MULTIPLIERS = np.random.default_rng(20240131).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = np.uint64(0x9E3779B97F4A7C15)
_LOW = lowered()


def shingle_sets(texts: pa.Array | list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, A-Z in lower case; a shorter text is one shingle, an empty one none."""
    data, places = flat(texts)
    start, end, before = word_spans(data, places)
    w = span_hashes(data, start, end, _LOW)
    with np.errstate(over="ignore"):
        h = np.full(max(0, len(w) - k + 1), k, np.uint64)
        for i in range(k):
            h = h * _C + w[i : i + len(h)]
        h = mixed(h)
        out = []
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= k:
                x = np.sort(h[a : b - k + 1])
                new = np.ones(len(x), bool)
                np.not_equal(x[1:], x[:-1], out=new[1:])
                out.append(x[new])
            else:
                x = np.full(min(1, b - a), b - a, np.uint64)
                for i in range(a, b):
                    x = x * _C + w[i]
                out.append(mixed(x))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch of a set that isn't empty."""
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            np.minimum(least, np.multiply.outer(_MULTIPLIERS, shingles[at : at + 512]).min(1), out=least)
    return least


def scaled(least: np.ndarray) -> np.ndarray:
    """Registers from the least hashes: exponentially spaced, cut to 16 bits."""
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(h, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint64)


def band_keys(k: np.ndarray) -> np.ndarray:
    """A key for each band (sets x bands): its number and its registers, 16 bits each."""
    r = k.reshape(-1, BANDS, ROWS)
    return (np.arange(BANDS, dtype=np.uint64) << np.uint64(48) | r[:, :, 0] << np.uint64(32) | r[:, :, 1] << np.uint64(16) | r[:, :, 2]).astype(np.int64)


def _share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def estimate(more: np.ndarray, less: np.ndarray, same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely similarity given how many registers of a are above, below and equal to b's, and both cardinalities.

    With u and v the shares of the cardinalities, a register of a is above with probability p(u - v J), below with
    p(v - u J), p(x) = -log_b(1 - x (b - 1) / b). The likelihood has one peak, found by thirds.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    lo, hi = np.zeros_like(u, float), np.minimum(u / v, v / u)

    def likelihood(j):
        p, q = _share(u - v * j), _share(v - u * j)
        tiny = 1e-12
        return more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))

    for _ in range(24):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = likelihood(a) < likelihood(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2


def _unpack(bands: pa.Array) -> np.ndarray:
    """Registers (sets x registers) of an Arrow array of band keys."""
    flat = bands.flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(bands), BANDS)
    return np.ascontiguousarray(flat).view("<u2").reshape(len(bands), BANDS, 4)[:, :, :ROWS].reshape(len(bands), -1)


def _least_estimate(threshold: float) -> float:
    return threshold - DEVIATIONS * (threshold * (1 - threshold) / (BANDS * ROWS)) ** 0.5


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (hash of the set, null for none) and bands of each row."""

    def run(batches):
        for b in slices(batches):
            sets = shingle_sets(b.column(1), k)
            n = np.array(list(map(len, sets)))
            nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            keys = band_keys(scaled(np.array([registers(s) for s in sets if len(s)]).reshape(-1, BANDS * ROWS)))
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), bands], names=["doc_id", "text_hash", "n_shingles", "node", "bands"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, n_shingles long, node long, bands array<long>")


def likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those whose estimate isn't clearly below the threshold, with the estimate."""
    least = _least_estimate(threshold)
    sides = [nodes.select(F.col("node").alias(x), F.col("bands").alias(f"bands_{x}"), F.col("n_shingles").alias(f"n_{x}")) for x in "ab"]

    def run(batches):
        for t in slices(batches, 8192):
            x, y = _unpack(t.column("bands_a")).astype(np.int32), _unpack(t.column("bands_b")).astype(np.int32)
            n = [t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b")]
            est = estimate((x > y).sum(1), (x < y).sum(1), (x == y).sum(1), *n)
            keep = pa.array(est >= least)
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (t.column("a"), t.column("b"), pa.array(est))], names=["a", "b", "estimate"])

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "bands_a", "bands_b", "n_a", "n_b").mapInArrow(run, "a long, b long, estimate double")


def full_sets(nodes: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """node and its whole set, from the text of its representative row."""
    told = lambda c: F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0"))
    texts = docs.select(told(F.col(id_col)).alias("i"), F.col(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    keys = nodes.select("node", told(F.col("rep.doc_id")).alias("i"), F.col("rep.text_hash").alias("h"))

    def run(batches):
        for b in slices(batches):
            sets = shingle_sets(b.column(1), k)
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "shingles"])

    return texts.join(keys, ["i", "h"]).dropDuplicates(["node"]).select("node", "t").mapInArrow(run, "node long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those with 100 * intersection >= percent * union of the full sets."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("r"))
    both = F.size(F.array_intersect("s", "r"))
    return pairs.join(a, "a").join(b, "b").filter(100 * both >= percent * (F.size("s") + F.size("r") - both)).select("a", "b")


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """node and comp (the least node that is reachable) for each node of the edges (a, b).

    Rounds of least label over neighbours and one pointer jump, until nothing changes; each round is written to
    the shared folder and the one before it deleted. The rounds grow with the logarithm of the diameter as a rule.
    """
    both = steps.stash(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "cc-edges")
    labels = steps.stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "cc")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", F.least("comp", "near").alias("low"), F.col("comp").alias("old"))
        up = labels.select(F.col("node").alias("low"), F.col("comp").alias("up"))
        new = steps.stash(low.join(up, "low", "left").select("node", F.least("low", F.coalesce("up", "low")).alias("comp"), "old"), "cc")
        steps.drop(labels)
        labels = new
        if new.filter("comp <> old").isEmpty():
            steps.drop(both)
            return new.select("node", "comp")


def _hub_pairs(entries: DataFrame) -> DataFrame:
    """Each set of a bucket with the bucket's least set."""
    hubs = entries.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("key", "a")
    return entries.join(hubs, "key").filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def _pairs_within(rows: DataFrame, by: str) -> DataFrame:
    """Pairs of sets of different components that agree in ``by``."""
    other = rows.select(by, F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    return rows.join(other, by).filter("comp <> comp_b and node < b").select(F.col("node").alias("a"), "b").distinct()


def forest(sets: list[np.ndarray], comps: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the sets at the places ``left`` and ``right`` that join different components, each only as far as it joins something new.

    Intersections are counted exactly: elements that are in many of the sets by products of incidence matrices,
    those in a few by listing their pairs. Both are summed up in one matrix of ``left`` by ``right``.
    """
    n = np.array(list(map(len, sets)))
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], elements[1:] != elements[:-1]]))
    times = np.diff(np.append(start, len(elements)))
    common = np.zeros((len(left), len(right)), np.float32)
    at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    for d in range(2, FEW + 1):
        of = owner[start[times == d, None] + np.arange(d)]
        x, y = at_left[of][:, :, None], at_right[of][:, None, :]
        both = (x >= 0) & (y >= 0)
        where = (x * len(right) + y)[both]
        if len(where):
            places, counts = np.unique(where, return_counts=True)
            common.ravel()[places] += counts
    frequent = np.flatnonzero(times > FEW)
    for k in range(0, len(frequent), _COLUMNS):
        some = frequent[k : k + _COLUMNS]
        held = np.zeros((len(sets), len(some)), np.float32)
        held[owner[ragged(start[some], times[some])], np.repeat(np.arange(len(some)), times[some])] = 1
        common += held[left] @ held[right].T
    linked = 100 * common >= percent * (n[left][:, None] + n[right][None] - common)
    linked &= comps[left][:, None] != comps[right][None]
    i, j = np.nonzero(linked)
    root = {c: c for c in comps.tolist()}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    pairs = comps[left[i]].astype(np.int64), comps[right[j]].astype(np.int64)
    _, first = np.unique(np.stack([np.minimum(*pairs), np.maximum(*pairs)], 1), axis=0, return_index=True)
    for k in first.tolist():
        p, q = top(int(pairs[0][k])), top(int(pairs[1][k]))
        if p != q:
            root[p] = q
            out.append((int(left[i[k]]), int(right[j[k]])))
    return out


def _by_blocks(rows: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets of rows (g, node, comp) that are of one group g and different components, of groups of any size.

    A group is dealt into blocks of bounded size, and each two of its blocks (most groups have one) meet in a task, which
    compares their full sets exactly and gives a forest of links. So neither rows nor links are ever listed by pairs; a set of a group of
    k blocks goes to k tasks.
    """
    sized = rows.join(nodes.select("node", "n_shingles"), "node")
    blocks = sized.groupBy("g").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("k"))
    mine = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    dealt = sized.join(blocks, "g").withColumn("x", mine).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("g", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "node", "comp")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, i, j = (t.column(c).to_numpy() for c in ("x", "i", "j"))
        node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
        lists = t.column("shingles").combine_chunks()
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        left, right = np.flatnonzero(x == i[0]), np.flatnonzero(x == j[0])
        if not len(left) or not len(right) or comp.min() == comp.max():
            found = []
        else:
            found = forest([values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], comp, left, right, percent)
        return pa.table({"a": pa.array([int(node[p]) for p, _ in found], pa.int64()), "b": pa.array([int(node[q]) for _, q in found], pa.int64())})

    return dealt.join(sets, "node").groupBy("g", "i", "j").applyInArrow(compare, "a long, b long")


def _mixed_buckets(entries: DataFrame, labels: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """Of buckets with sets of several components: the rows (key, node, comp) of small ones, and (g, node, comp) of large ones.

    Large buckets of one largest component are one group, so that a family of sets meets once, not in each of its buckets.
    """
    size = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    known = entries.join(labels.join(size, "comp"), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"))
    known = steps.stash(known, "near-entries")
    mixed_ = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"), F.max(F.struct("size", "comp"))["comp"].alias("pivot")).filter("lo <> hi")
    rows = steps.stash(known.join(mixed_.select("key", "n", "pivot"), "key"), "near-mixed")
    large = rows.filter(F.col("n") > SMALL).select(F.col("pivot").alias("g"), "node", "comp").distinct()
    return rows.filter(F.col("n") <= SMALL), steps.stash(large, "near-groups")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (least doc_id reachable over links) and kept of each row.

    Texts with equal shingle sets are one node, so exact copies never meet in a bucket. First each set is compared with the least
    set of its buckets of which the estimate is highest, and confirmed links make components. Then the sets that share a bucket but no
    component are searched: small buckets pair by pair, large ones in blocks, whose full sets are compared exactly inside a task. Links are a
    forest and a little more, never all pairs of a group. Rows are linear in the input but for groups of more than a block
    (some thousand sets that collide), whose sets go to as many tasks as the group has blocks. Two sets
    at the threshold share no band with a probability below 1e-9, and a pair's estimate is five deviations too low with one below
    3e-7 (in buckets of up to SMALL sets only; ``DEVIATIONS = inf`` looks at all pairs).

    Identifiers may be of any type that can be ordered. Null and empty texts have no shingles, no links and their own doc_id as component. A null doc_id takes part
    like any other; component_id is the least doc_id that isn't null. Repeated rows are linked like copies. kept:
    doc_id equals component_id (both null counts as equal), so repeated rows are kept or dropped together. An empty table gives
    an empty result.
    """
    threshold, steps = percent / 100, Steps(docs.sparkSession)
    rows = steps.stash(sketches(docs, k, id_col, text_col), "near-rows")
    nodes = steps.stash(rows.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")), "near-nodes")
    spread = nodes.select("node", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    entries = steps.stash(spread.join(shared, "key"), "near-buckets")
    met = steps.stash(nodes.join(entries.select("node").distinct(), "node", "left_semi"), "near-met")
    sets = steps.stash(full_sets(met, docs, k, id_col, text_col), "near-sets")

    best = likely(_hub_pairs(entries), met, threshold).groupBy("b").agg(F.max(F.struct("estimate", "a"))["a"].alias("a")).select("a", "b")
    links = [steps.stash(verified(best, sets, percent), "near-links")]
    labels = components(links[0], steps)
    few, many = _mixed_buckets(entries, labels, steps)
    pairs = steps.stash(likely(_pairs_within(few, "key"), met, threshold), "near-pairs")
    second = steps.stash(verified(pairs, sets, percent).union(_by_blocks(many, met, sets, percent)), "near-links")
    if not second.isEmpty():
        labels = components(links[0].union(second), steps)
    named = labels.join(nodes.select("node", "least"), "node")
    of = named.join(named.groupBy("comp").agg(F.min("least").alias("component")), "comp").select("node", "component")
    single = steps.stash(nodes.select("node", "least").join(of, "node", "left").select("node", F.coalesce("component", "least").alias("component")), "near-of")
    out = rows.select("doc_id", "text_hash", "n_shingles", "node").join(single, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    return steps.keep(out, "near-result")
