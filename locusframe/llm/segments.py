"""Sampled SentencePiece segmentations without replacement, and their decoding.

The pieces of a SentencePiece model span a lattice over the text; a segmentation's probability is in proportion to the
product of its pieces' weights. Gumbel top-k takes k distinct segmentations: each has a perturbed log-probability, and
a best-first (A-star) search over sets of segmentations that share a prefix finds the k largest without listing the rest.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunks, RollingHash, flat, mixed, ragged, slices

SAMPLES, ALPHA = 2, 2e-4
#: Sets whose mass is below exp(-NEGLIGIBLE) of what a segmentation leaves are not told apart from nothing.
NEGLIGIBLE = 50.0
_MODELS: dict[tuple, "Pieces"] = {}
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_ROUND = np.uint64(0xA0761D6478BD642F)


class HashIndex:
    """Finds 64-bit keys: number of the key, or -1. Tables of growing overflow, each probed at other bits of the key."""

    def __init__(self, keys: np.ndarray):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two entries of the vocabulary have one hash")
        self.keys, self.levels, left, shift = keys, [], np.arange(len(keys)), 0
        while len(left):
            bits = max(4, int(16 * len(left)).bit_length())
            table = np.full(1 << bits, -1, np.int32)
            at = (keys[left] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
            table[at] = left
            self.levels.append((table, np.uint64(shift), np.uint64((1 << bits) - 1)))
            left, shift = left[table[at] != left], (shift + 17) % 48

    def __call__(self, found: np.ndarray) -> np.ndarray:
        out = np.full(len(found), -1, np.int32)
        for table, shift, mask in self.levels:
            got = table[(found >> shift) & mask]
            at = np.flatnonzero(got >= 0)
            at = at[self.keys[got[at]] == found[at]]
            out[at] = got[at]
        return out


class Pieces:
    """The vocabulary with blanks for its word-begin marks, and log-weights alpha * score."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text, numbers, least = [b""] * n, [], 0.0
        self.bytes, self.weight = np.zeros(256, np.int32), np.full(n, -np.inf)
        for i in range(n):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(name[3:5], 16)
                self.bytes[b], text[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text[i] = name.replace("▁", " ").encode()
                numbers.append(i)
                least = min(least, sp.get_score(i))
                self.weight[i] = alpha * sp.get_score(i)
        self.weight[self.bytes] = alpha * (least - 1)
        self.blob, self.place = flat(text)
        self.size = np.diff(self.place)
        self.joined = np.zeros((256, 256), bool)  # neighbouring bytes of any piece
        starts: dict[bytes, int] = {}  # all beginnings of pieces, with the number of the piece or -1
        for i in numbers:
            for n in range(1, len(text[i])):
                self.joined[text[i][n - 1], text[i][n]] = True
                starts.setdefault(text[i][:n], -1)
            starts[text[i]] = i
        self.longest = max(map(len, starts))
        blob, place = flat(list(starts))
        self.named = np.array(list(starts.values()), np.int32)
        self.index = HashIndex(mixed(RollingHash(blob)(place[:-1], place[1:])))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of identifiers in a row."""
        return self.blob[ragged(self.place[ids], self.size[ids])]


def pieces(path: str, alpha: float) -> Pieces:
    """One for each process."""
    if (path, alpha) not in _MODELS:
        _MODELS[path, alpha] = Pieces(path, alpha)
    return _MODELS[path, alpha]


def decode(ids, model: Pieces) -> bytes:
    """The text of identifiers: pieces in a row, without the dummy blank."""
    return model.decode(np.asarray(ids, np.int64))[1:].tobytes()


def chunked(data: np.ndarray, places: np.ndarray, model: Pieces) -> Chunks:
    """Texts cut between any two bytes that aren't neighbours in some piece, so no piece spans two chunks."""
    first = np.ones(len(data), bool)
    first[1:] = ~model.joined[data[:-1], data[1:]]
    first[places[:-1][places[:-1] < places[1:]]] = True
    start = np.flatnonzero(first)
    return Chunks(data, np.diff(np.append(start, len(data))), np.searchsorted(start, places))


def _unit(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    with np.errstate(over="ignore"):
        x = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Table:
    """The lattices of distinct chunks as one graph.

    Nodes are byte places, numbered by the bytes that are left in their chunk, edges are pieces, those of a node side
    by side: piece, next node (-1 at the end of the chunk), probability given the node, cumulative probability.
    """

    def __init__(self, model: Pieces, chunks: pa.Array):
        data, places = flat(chunks)
        sizes, total = np.diff(places), len(data)
        left = np.repeat(places[1:], sizes) - np.arange(total)
        order = np.argsort(left.astype(np.int16) if left.max() < 1 << 15 else left, kind="stable").astype(np.int32)
        number = np.empty(total, np.int32)
        number[order] = np.arange(total, dtype=np.int32)
        self.first = number[places[:-1]]
        roll, levels = RollingHash(data), np.cumsum(np.bincount(left))
        lead = data[order]
        width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0).astype(np.int8)
        alone = lead & 0xC0 == 0x80
        begun = []  # (node, number of the piece, length) by length; nodes go on while their bytes begin a piece
        here = np.arange(total, dtype=np.int32)
        bare = ~alone
        for n in range(1, min(model.longest, int(sizes.max())) + 1):
            here = here[np.searchsorted(here, levels[n - 1]) :] if n > 1 else here
            at = order[here]
            got = model.index(mixed(roll(at, at + n)))
            on = got >= 0
            here, named = here[on], model.named[got[on]]
            hit = named >= 0
            begun.append((here[hit], named[hit]))
            if n <= 4:
                full = begun[-1][0]
                bare[full[width[full] == n]] = False
        single = np.flatnonzero(alone | bare).astype(np.int32)  # a character that is no piece has a path of byte pieces
        begun.insert(0, (single, model.bytes[lead[single]]))
        count = np.zeros(total, np.int32)
        for f, _ in begun:
            count[f] += 1
        self.stop = np.cumsum(count, dtype=np.int32)
        self.start = self.stop - count
        edges = int(self.stop[-1])
        self.piece, self.next = np.empty(edges, np.int32), np.empty(edges, np.int32)
        filled = self.start.copy()
        after = np.append(number, -1)
        for n, (f, name) in enumerate(begun):
            e = filled[f]
            filled[f] = e + 1
            self.piece[e] = name
            end = f < levels[max(1, n)]
            self.next[e] = np.where(end, -1, after[np.where(end, total, order[f] + max(1, n))])
        weight, self.p = model.weight[self.piece], np.empty(edges)
        self.logp = np.empty(edges)
        beta = np.zeros(total + 1)  # the last one is that of a chunk's end; logarithms, so no length underflows
        for a, b in zip(levels[:-1].tolist(), levels[1:].tolist(), strict=True):
            if a == b:
                continue
            lo, hi = int(self.start[a]), int(self.stop[b - 1])
            cut, n = self.start[a:b] - lo, count[a:b]
            logs = weight[lo:hi] + beta[self.next[lo:hi]]
            top = np.maximum.reduceat(logs, cut)
            p = np.exp(logs - np.repeat(top, n))
            beta[a:b] = top + np.log(np.add.reduceat(p, cut))
            logs -= np.repeat(beta[a:b], n)
            self.logp[lo:hi] = logs
        np.exp(self.logp, out=self.p)
        self.source = np.repeat(np.arange(total, dtype=np.int32), count)
        run = np.cumsum(self.p)
        self.cum = run - np.concatenate([[0.0], run])[self.start][self.source]

    def draw(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a path from each node to its chunk's end, one behind the other, and the number of each; keys seed the choices."""
        at, cur, who, took, step = np.arange(len(nodes), dtype=np.int32), nodes, [], [], 0
        while len(at):
            e = self.start[cur]
            last = self.stop[cur] - 1
            on = np.flatnonzero(e < last)
            with np.errstate(over="ignore"):
                u = _unit(keys[at[on]] + np.uint64(step) * _C2)
            x, last = e[on], last[on]
            go = np.arange(len(on))
            while len(go):
                go = go[(self.cum[x[go]] <= u[go]) & (x[go] < last[go])]
                x[go] += 1
            e[on] = x
            who.append(at)
            took.append(e)
            nxt = self.next[e]
            go = np.flatnonzero(nxt >= 0)
            at, cur, step = at[go], nxt[go], step + 1
        if not who:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        n = np.bincount(np.concatenate(who), minlength=len(nodes))
        start, out = np.cumsum(n) - n, np.empty(int(n.sum()), np.int32)
        for k, (w, e) in enumerate(zip(who, took, strict=True)):
            out[start[w] + k] = e
        return out, n


def _sets(t: Table, steps: np.ndarray, sizes: np.ndarray, first: np.ndarray, barred: list[tuple[int, ...]], g: np.ndarray, keys: np.ndarray, most: int) -> list[list[tuple[float, int, tuple[int, ...]]]]:
    """What each of several segmentations (``steps``, so many of each) leaves of its set, as sets of one more step: (perturbed maximum, step, edges barred there), the ``most`` largest.

    The set of step s holds the segmentations that agree before s and take another edge there. The largest perturbed
    log-probability of a set of mass m is a Gumbel number at log m, here cut off at the segmentation's own, g.
    """
    start = np.cumsum(sizes) - sizes
    run = t.logp[steps]
    total = np.cumsum(run)
    before = total - run
    most_likely = np.repeat(before[start + np.minimum(first, sizes - 1)], sizes)
    some = before > most_likely - NEGLIGIBLE  # the later sets together have less mass than a rounding error
    some[ragged(start, first)] = False
    at = np.flatnonzero(some)
    node = t.source[steps[at]]
    at, node = (x[t.stop[node] - t.start[node] > 1] for x in (at, node))
    which = np.searchsorted(start, at, "right") - 1
    place = at - start[which]
    rest = 1 - t.p[steps[at]]
    for i, edges in enumerate(barred):
        if edges and (x := np.searchsorted(at, start[i] + first[i])) < len(at) and at[x] == start[i] + first[i]:
            free = set(range(t.start[node[x]], t.stop[node[x]])) - {*edges, int(steps[at[x]])}
            rest[x] = t.p[list(free)].sum() if free else 0.0
    mass = before[at] - before[start][which] + np.log(np.maximum(rest, 1e-300))
    with np.errstate(over="ignore"):
        u = _unit(keys[which] + (place.astype(np.uint64) + np.uint64(1)) * _C1)
    value = np.where(rest > 1e-15, mass - np.log(-np.log(u)), -np.inf)  # cutting it off keeps the order, so that comes last
    out: list[list[tuple[float, int, tuple[int, ...]]]] = [[] for _ in sizes]
    if not len(at):
        return out
    own, begin = np.unique(which, return_index=True)
    n = np.diff(np.append(begin, len(at)))
    for _ in range(most):
        best = np.repeat(np.maximum.reduceat(value, begin), n)
        x = np.flatnonzero((value == best) & (value > -np.inf))
        if not len(x):
            break
        x = x[np.unique(which[x], return_index=True)[1]]
        cut = -np.logaddexp(-g[which[x]], -value[x])
        for i, s, v, e in zip(which[x].tolist(), place[x].tolist(), cut.tolist(), steps[at[x]].tolist(), strict=True):
            out[i].append((v, s, (*(barred[i] if s == first[i] else ()), e)))
        value[x] = -np.inf
    return out


class Samples:
    """Segmentations of several texts: of each its text, identifiers, log-probability, perturbed value, inclusion and its logarithm."""

    def __init__(self):
        self.text, self.ids, self.log_prob, self.perturbed, self.log_inclusion = [], [], [], [], []


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))."""
    if x > 3:
        return -math.exp(-math.exp(min(x, 700.0)))
    return x if x < -30 else math.log(-math.expm1(-math.exp(x)))


def sample(data: np.ndarray, places: np.ndarray, seeds: np.ndarray, k: int, model: Pieces) -> Samples:
    """Up to k distinct segmentations of each text by falling perturbed log-probability; texts come with their dummy blank.

    The inclusion score 1 - exp(-exp(log p - threshold)) is the probability that the segmentation is above the
    threshold, the perturbed value behind the last one given. If there are no more segmentations, it is 1. Of a long text
    each segmentation is so improbable that the score rounds to 0; its logarithm doesn't.
    """
    n, found = len(places) - 1, Samples()
    given: list[list[tuple[float, float, np.ndarray]]] = [[] for _ in range(n)]
    queue: list[list[tuple]] = [[] for _ in range(n)]  # sets that are left: (perturbed maximum, steps, chunk of each step, step, edges barred)
    live = np.flatnonzero(np.diff(places)).tolist()
    if live:
        chunks = chunked(data, places, model)
        t = Table(model, chunks.distinct)
        node = t.first[chunks.at]
        keys = seeds.astype(np.int64).view(np.uint64)
    for round_no in range(k):
        if not live:
            break
        with np.errstate(over="ignore"):
            key = keys[live] + np.uint64(round_no) * _ROUND
            left_key = keys[live] ^ (np.uint64(round_no + 1) * np.uint64(0x9FB21C651E98DF25))
        pick = _unit(key ^ _C2).tolist()
        heads, head_chunk, starts, froms, value, barred = [], [], [], [], [], []
        for i, d in enumerate(live):
            nodes = node[chunks.before[d] : chunks.before[d + 1]]
            if round_no == 0:
                g, head, of, bar, done = -math.log(-math.log(pick[i])), np.zeros(0, np.int64), np.zeros(0, np.int64), (), 0
            else:
                g, steps, of, s, bar = queue[d].pop(0)
                a, b = t.start[t.source[steps[s]]], t.stop[t.source[steps[s]]]
                free = [e for e in range(a, b) if e not in bar]
                c = np.cumsum(t.p[free])
                e = free[min(len(free) - 1, int(np.searchsorted(c, pick[i] * c[-1], "right")))]
                head, of, on = np.append(steps[:s], e), of[: s + 1], int(t.next[e])
                done = int(of[s]) + (on < 0)
                nodes = nodes[done:]
                if on >= 0:
                    nodes = nodes.copy()
                    nodes[0] = on
            heads.append(head)
            head_chunk.append(of)
            starts.append(nodes)
            froms.append(np.arange(done, done + len(nodes)))
            value.append(g)
            barred.append(bar)
        sizes = np.array([len(x) for x in starts])
        of_start = np.concatenate(froms)
        with np.errstate(over="ignore"):
            drawn, lengths = t.draw(np.concatenate(starts), np.repeat(key, sizes) + (of_start.astype(np.uint64) + np.uint64(1)) * _C1)
        drawn_chunk = np.repeat(of_start, lengths)
        cut = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
        if round_no:
            paths = [np.concatenate([h, drawn[cut[i] : cut[i + 1]]]) for i, h in enumerate(heads)]
            ofs = [np.concatenate([h, drawn_chunk[cut[i] : cut[i + 1]]]) for i, h in enumerate(head_chunk)]
            drawn, sizes = np.concatenate(paths), np.array([len(x) for x in paths])
        else:
            paths = [drawn[cut[i] : cut[i + 1]] for i in range(len(live))]
            ofs = [drawn_chunk[cut[i] : cut[i + 1]] for i in range(len(live))]
            sizes = np.diff(cut)
        lp = np.add.reduceat(t.logp[drawn], np.cumsum(sizes) - sizes).tolist()
        first = np.array([max(0, len(h) - 1) for h in heads])
        sets = _sets(t, drawn, sizes, first, barred, np.array(value), left_key, k - round_no)
        for i, d in enumerate(live):
            given[d].append((lp[i], value[i], t.piece[paths[i]]))
            queue[d] = sorted([*queue[d], *((v, paths[i], ofs[i], s, bar) for v, s, bar in sets[i])], key=lambda x: -x[0])[: k - round_no]
        live = [d for d in live if queue[d]]
    for d in range(n):
        if not given[d]:
            given[d].append((0.0, 0.0, np.zeros(0, np.int32)))
        for lp, g, ids in given[d]:
            found.text.append(d)
            found.ids.append(ids)
            found.log_prob.append(lp)
            found.perturbed.append(g)
            found.log_inclusion.append(_log_inclusion(lp - queue[d][0][0]) if queue[d] else 0.0)
    return found


def _with_blank(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a dummy blank in front of each that isn't empty."""
    data, places = flat(texts)
    sizes = np.diff(places)
    lead = sizes > 0
    new = np.concatenate([[0], np.cumsum(sizes + lead)])
    out = np.full(new[-1], 32, np.uint8)
    out[ragged(new[:-1] + lead, sizes)] = data
    return out, new


def sampled_segmentations(docs: DataFrame, path: str, k: int = SAMPLES, alpha: float = ALPHA, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to k rows for each row, its distinct sampled segmentations.

    Identifier, sample (0 is first), n_pieces, log_prob, perturbed, inclusion, log_inclusion, ids_crc32 (identifiers as
    little-endian unsigned 32-bit integers), round_trip (their decoding is the text) and with ``with_ids`` the identifiers. Seeded by the
    identifier and the text, so that a row gives the same samples in any partition; repeated rows give equal samples. Null and
    empty texts have one empty segmentation. Whole texts; narrow; memory is for a slice of about a megabyte, or the longest text.

    Raw texts are segmented: a blank in front, blanks for word-begin marks. The library also normalises texts first (double
    blanks, compatibility characters); of such texts its segmentations differ from these, which decode to the text itself.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "log_inclusion", "ids_crc32", "round_trip"] + ["ids"] * with_ids
    schema = f"`{id_col}` {kind}, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, log_inclusion double, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids

    def run(batches):
        model = pieces(path, alpha)
        for b in slices(batches, 512, 3 << 19):
            data, places = _with_blank(b.column(1))
            found = sample(data, places, b.column(2).to_numpy(), k, model)
            text = np.array(found.text)
            number = np.arange(len(text)) - np.searchsorted(text, text)
            same = np.zeros(len(text), bool)
            for j in range(int(number.max()) + 1):
                which = np.flatnonzero(number == j)
                ids = np.concatenate([found.ids[i] for i in which.tolist()])
                ends = np.cumsum([len(found.ids[i]) for i in which.tolist()])
                made = np.concatenate([[0], np.cumsum(model.size[ids])])[np.concatenate([[0], ends])]
                back = model.decode(ids)
                for x, i in enumerate(which.tolist()):
                    same[i] = np.array_equal(back[made[x] : made[x + 1]], data[places[text[i]] : places[text[i] + 1]])
            score = np.exp(found.log_inclusion)
            columns = [
                b.column(0).take(pa.array(text, pa.int64())), pa.array(number, pa.int32()), pa.array(map(len, found.ids), pa.int64()), pa.array(found.log_prob, pa.float64()), pa.array(found.perturbed, pa.float64()),
                pa.array(score, pa.float64()), pa.array(found.log_inclusion, pa.float64()), pa.array([zlib.crc32(x.astype("<u4")) for x in found.ids], pa.int64()), pa.array(same, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(found.ids, pa.list_(pa.int32()))] * with_ids, names=names)

    return docs.select(id_col, text_col, F.xxhash64(id_col, text_col).alias("_seed")).mapInArrow(run, schema)
