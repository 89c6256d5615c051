"""Near-duplicates by a chosen-path set similarity join over word shingles.

A document's set is its distinct WIDTH-word shingles over lower-cased words; two
documents are linked if 100 * |A & B| >= 75 * |A | B|.

1. Documents of equal sets form a class; one row stands for it from here on.
2. Each class gets COORDINATES minwise tokens.  TREES independent trees start with one
   token each; a node holds the classes that share all tokens on its path.
3. A first round compares neighbours inside each node, in an order that follows the
   node's further tokens; each class's likest pairs are confirmed on full sets and linked
   into components.  A node whose members are one component is finished.
4. A node with at most SMALL members outside its largest component is a leaf.  Another one
   branches: its own hash selects one or two of the next coordinates (3/2 on average),
   and its members go to the children that their tokens name.
5. Branching parts what is unlike.  Where the members outside the largest component agree
   with the others in a share ALIKE of their tokens or more, it would make more rows than
   it parts: such a node ends.  Nodes of all trees and levels that end and have most of
   their members in common are one family, which is compared once, as one large leaf.
6. In a leaf the members outside the largest component are compared with all members by
   their tokens.  Those with a possible partner ask for their full sets, which come to the
   leaf once for each member; there all pairs are decided exactly, and the leaf emits
   links that connect what belongs together: fewer than it has members.

So no pair is ever a row but the few likest of each class, and large groups of linked near
copies cost about as much as their members.  A family that is alike but not linked costs
one comparison of those outside its largest component with all (of tokens, then of the
full sets where tokens leave a link possible), in chunks and cells that are spread over
tasks; each member is sent to one place for each CELL members.  The other nodes make
fewer rows on each level than on the one before: 3/2 * ALIKE for each, on average.  A node
that is still large after MAX_DEPTH levels is compared exhaustively too.

Recall: two documents at the threshold that share a node share one of its children, at
least, with a probability that makes a branching process of mean 9/8: above 1, so a pair
stays together down to any depth with probability 4/9 at least.  TREES is what RECALL
asks for from that, if tokens are independent: 0.99 at any depth, more for pairs that are
more alike or whose nodes end early.  The tokens' estimate leaves out pairs below
POSSIBLE: a pair at the threshold falls below it with probability 1e-5 (the binomial of
256 tokens at 0.75); `possible=0` leaves none out.

Edge cases: a text without words has an empty set and no links; fewer than WIDTH words
are one shingle; a null text is empty; rows that share a doc_id are one document (links
of all its texts count); a null doc_id names no component: its row has its class's
component if there is one, and is kept only if there is none; an empty table gives no
rows; other columns are not looked at; texts of any length are compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, drop, pieces, saved, table
from .ragged import U64, Words, mix, window_hashes, window_mask

WIDTH = 5
#: Links need PART * intersection >= WHOLE * union.
PART, WHOLE = 100, 75
COORDINATES = 256
#: A node is a leaf if at most SMALL members are outside its largest component.
SMALL = 256
#: A node ends where tokens of members outside its largest component agree with other members' so often; measured on so many members and coordinates.
ALIKE, SAMPLED, LOOKED_AT = 0.5, 128, 16
#: Members and shingles of a leaf that one task holds at a time, about; of a family up to LARGE_CELL members, for fewer copies.
CELL, LARGE_CELL, CELL_SHINGLES = 500, 2000, 2_000_000
MAJOR, MINOR, FEW = 0, 1, 2
MAX_DEPTH = 40
#: Probability, at least, that a pair at the threshold meets, however deep its nodes branch.
RECALL = 0.99


def trees_for(recall: float, depth: int, alike: float = WHOLE / PART) -> int:
    """Trees that a pair needs to meet on level `depth` with this probability (roots: level 1)."""
    meets = 1.0
    for _ in range(depth - 1):
        lost = 1 - alike * meets
        # children() takes one coordinate or two, each in half of the nodes.
        meets = 1 - (lost + lost * lost) / 2
    return math.ceil(math.log(1 - recall) / math.log(1 - alike * meets))


TREES = trees_for(RECALL, MAX_DEPTH)
#: Neighbours that the first round compares each member with, and pairs of each class that it confirms.
NEIGHBOURS, LIKEST = 3, 2
#: A sketch of 256 tokens has a standard error of 0.027 at the threshold; pairs 4.4 errors below it are left out.
POSSIBLE = 0.63
#: Ids that are broadcast (8 bytes each) to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Nodes, or rows of a sample, that are broadcast (some 32 bytes each).
BROADCAST_NODES = 500_000
#: Edges that one task unites into components; more are united by rounds over the cluster.
ONE_TASK = 1_000_000
#: Parts that the rows of a hot key are dealt to where they meet its totals.
SALTS = 64
_FACTORS = mix(np.arange(COORDINATES, dtype=U64), 801) | U64(1)
_SHIFTS = mix(np.arange(COORDINATES, dtype=U64), 802)


def sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and their bounds."""
    w = Words(texts, lower=True)
    words = w.hashes(51)
    shingle = window_hashes(words, WIDTH, 52)
    whole = window_mask(w.counts, w.bounds, WIDTH)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            out.append(np.unique(shingle[a:b][whole[a:b]]))
        elif b > a:
            value = np.full(1, b - a, U64)
            for k in range(a, b):
                value = mix(value + words[k : k + 1], 53)
            out.append(value)
        else:
            out.append(shingle[:0])
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in out]))).astype(np.int64)
    return np.concatenate(out) if out else np.zeros(0, U64), bounds


def tokens(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """COORDINATES minwise tokens (16 bits) of each set; an empty set has zeros."""
    out = np.zeros((len(bounds) - 1, COORDINATES), "<u2")
    filled = bounds[1:] > bounds[:-1]
    start = bounds[:-1][filled]
    if len(start):
        for k in range(COORDINATES):
            lowest = np.minimum.reduceat((flat ^ _SHIFTS[k]) * _FACTORS[k], start)
            out[filled, k] = (mix(lowest, 54) >> U64(48)).astype(np.uint16)
    return out


def root_nodes(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The first node of each set in every tree, named by the whole of its token (64 bits)."""
    out = np.zeros((len(bounds) - 1, TREES), U64)
    filled = bounds[1:] > bounds[:-1]
    start = bounds[:-1][filled]
    if len(start):
        for k in range(TREES):
            lowest = np.minimum.reduceat((flat ^ _SHIFTS[k]) * _FACTORS[k], start)
            out[filled, k] = mix(lowest, 900 + k)
    return out


def _folded(flat: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(flat, seed))))
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    offsets = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, 128 bits (k1, k2) that stand for the set, its tokens and its first nodes."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, bounds = sets(as_bytes(batch.column(0)))
            cols = [pa.array(np.diff(bounds)), pa.array(_folded(flat, bounds, 55)), pa.array(_folded(flat, bounds, 56))]
            cols += [_binary(tokens(flat, bounds)), _binary(root_nodes(flat, bounds))]
            return pa.RecordBatch.from_arrays([batch.column(1), *cols], ["doc_id", "n_shingles", "k1", "k2", "tokens", "roots"])

        return each

    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    return arrow_map(rows, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, tokens binary, roots binary", make)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, COORDINATES)


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def roots(classes: DataFrame) -> DataFrame:
    """rep, node and path: each class in its first node of every tree, and where it stands there."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rep, own = _longs(batch.column(1)), _matrix(batch.column(0))
            trees = np.arange(TREES)
            node = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            further = np.stack([own[:, (TREES + 8 * t + np.arange(8)) % COORDINATES] for t in trees], 1).reshape(-1, 8)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(rep, TREES)), pa.array(node), _binary(further)], ["rep", "node", "path"]
            )

        return each

    return arrow_map(classes.select("tokens", "rep", "roots"), "rep bigint, node bigint, path binary", make)


def branched(own: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and child of rows with these tokens in these nodes: each node takes one coordinate or two."""
    node = node.view(U64)
    first = (mix(node, 58) % U64(COORDINATES)).astype(np.int64)
    second = (first + 1 + (mix(node, 59) % U64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    twice = np.flatnonzero(mix(node, 60) % U64(2) == 0)
    at, coordinate = np.concatenate((np.arange(len(node)), twice)), np.concatenate((first, second[twice]))
    token = own[at, coordinate].astype(U64)
    return at, mix(mix(node[at] + coordinate.astype(U64), 63) + token, 64).view(np.int64)


def children(rows: DataFrame) -> DataFrame:
    """rep, node, n_shingles and comp on the next level, of rows (tokens, rep, node, n_shingles, comp)."""
    names = ["rep", "node", "n_shingles", "comp"]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, child = branched(_matrix(batch.column(0)), _longs(batch.column(2)))
            rep, size, comp = (_longs(batch.column(k))[at] for k in (1, 3, 4))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (rep, child, size, comp)], names)

        return each

    return arrow_map(rows.select("tokens", *names), ", ".join(f"{n} bigint" for n in names), make)


def _estimates(own: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows a and b; 0 where their sizes rule a link out."""
    out = np.zeros(len(a))
    fit = np.flatnonzero(PART * np.minimum(size[a], size[b]) >= WHOLE * np.maximum(size[a], size[b]))
    for k in range(0, len(fit), 20_000):
        part = fit[k : k + 20_000]
        out[part] = (own[a[part]] == own[b[part]]).mean(1)
    return out


def _pairs(rep: np.ndarray, a: np.ndarray, b: np.ndarray, like: np.ndarray) -> pa.RecordBatch:
    hit = (like >= POSSIBLE) & (rep[a] != rep[b])
    x, y = rep[a[hit]], rep[b[hit]]
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y)), pa.array(like[hit])], ["u", "v", "near"])


PAIRS = "u bigint, v bigint, near double"


def neighbours(rows: DataFrame) -> DataFrame:
    """Possible pairs among the next NEIGHBOURS members of each node, in the order of their paths.

    Rows are dealt to ranges of (node, path), so that a large node is spread over many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for piece in pieces(batch, 4_000_000):
                now = _matrix(piece.column(0)), *(_longs(piece.column(k)) for k in (1, 2, 3))
                own, rep, node, size = (np.concatenate((x, y)) for x, y in zip(held, now, strict=True)) if held else now
                pairs = []
                for k in range(1, NEIGHBOURS + 1):
                    a = np.flatnonzero(node[:-k] == node[k:])
                    pairs.append((a, a + k))
                a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
                yield _pairs(rep, a, b, _estimates(own, size, a, b))
                held = own[-NEIGHBOURS:], rep[-NEIGHBOURS:], node[-NEIGHBOURS:], size[-NEIGHBOURS:]

    dealt = rows.select("tokens", "rep", "node", "n_shingles", "path").repartitionByRange("node", "path", "rep")
    return dealt.sortWithinPartitions("node", "path", "rep").select("tokens", "rep", "node", "n_shingles").mapInArrow(run, PAIRS)


def _groups(batches: Iterator[pa.RecordBatch], width: int, first: Callable, limit: int) -> Iterator[tuple]:
    """Columns of each group of rows that agree in their last `width` columns; rows come in that order.

    first: what column 0 is turned into; the other columns are longs.
    """
    held = None
    for batch in batches:
        for piece in pieces(batch, limit):
            now = first(piece.column(0)), *(_longs(piece.column(k)) for k in range(1, piece.num_columns))
            held = tuple(np.concatenate((x, y)) for x, y in zip(held, now, strict=True)) if held else now
            if not len(held[1]):
                continue
            differs = np.zeros(len(held[1]) - 1, bool)
            for column in held[-width:]:
                differs |= column[1:] != column[:-1]
            edge = np.concatenate(([0], np.flatnonzero(differs) + 1))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                yield tuple(x[a:b] for x in held)
            held = tuple(x[edge[-1] :] for x in held)
    if held and len(held[1]):
        yield held


def asked(leaves: DataFrame, possible: float | None = None) -> DataFrame:
    """rep, comp, few, node, chunk, cell: members whose full sets are asked for, and where.

    Members inside a leaf's largest component need no look at each other.  All members are
    dealt to cells, the others (the few) also to chunks, and each chunk meets each cell, so
    that two of the few would meet twice: the one of the larger number looks at the other.
    A member is asked for where its tokens leave it a possible partner in another component.
    `few` tells what a row is: FEW, or a member that is MAJOR or MINOR.
    """
    possible = POSSIBLE if possible is None else possible

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, rep, size, comp, few, node, chunk, cell in _groups(batches, 3, _matrix, 4_000_000):
            x, y = np.flatnonzero(few == FEW), np.flatnonzero(few != FEW)
            want = np.zeros(len(rep), bool)
            step = max(1, 100_000 // max(len(y), 1))
            for k in range(0, len(x), step):
                part = x[k : k + step]
                a, b = np.repeat(part, len(y)), np.tile(y, len(part))
                apart = (comp[a] != comp[b]) & ((few[b] == MAJOR) | (rep[a] > rep[b]))
                a, b = a[apart], b[apart]
                hit = _estimates(own, size, a, b) >= max(possible, 1e-9)
                want[a[hit]] = want[b[hit]] = True
            if want.any():
                cols = [pa.array(c[want]) for c in (rep, comp, few, node, chunk, cell)]
                yield pa.RecordBatch.from_arrays(cols, ["rep", "comp", "few", "node", "chunk", "cell"])

    minor = F.col("comp") != F.col("major")
    side = F.least(F.greatest(F.col("others") / 4, F.lit(float(CELL))), F.lit(float(LARGE_CELL)))
    cells = F.ceil(F.greatest(F.col("members") / side, F.col("shingles") / CELL_SHINGLES, F.lit(1.0))).cast("int")
    share = F.col("shingles") * F.col("others") / F.col("members")
    chunks = F.ceil(F.greatest(F.col("others") / F.greatest(side, F.lit(2.0 * SMALL)), share / CELL_SHINGLES, F.lit(1.0))).cast("int")
    place = lambda x, y, few: F.struct(x.cast("long").alias("chunk"), y.cast("long").alias("cell"), few.cast("long").alias("few"))
    own_cell, own_chunk = F.pmod(F.xxhash64("rep"), cells), F.pmod(F.xxhash64("rep", F.lit(1)), chunks)
    as_member = F.transform(F.sequence(F.lit(0), chunks - 1), lambda k: place(k, own_cell, F.when(minor, MINOR).otherwise(MAJOR)))
    as_few = F.transform(F.sequence(F.lit(0), cells - 1), lambda k: place(own_chunk, k, F.lit(FEW)))
    dealt = leaves.select("tokens", "rep", "n_shingles", "comp", "node", F.explode(F.when(minor, F.concat(as_member, as_few)).otherwise(as_member)).alias("p"))
    dealt = dealt.select("tokens", "rep", "n_shingles", "comp", "p.few", "node", "p.chunk", "p.cell")
    dealt = dealt.repartition("node", "chunk", "cell").sortWithinPartitions("node", "chunk", "cell")
    return dealt.mapInArrow(run, "rep bigint, comp bigint, few bigint, node bigint, chunk bigint, cell bigint")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents `ids` (doc_id), equal rows once."""
    # Ids of a checked number are broadcast; beyond it, texts and ids meet in a shuffle.
    few = ids.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return rows.groupBy("doc_id", F.xxhash64("text")).agg(F.first("text").alias("text")).select("doc_id", "text")


def decided(asks: DataFrame, docs: DataFrame) -> DataFrame:
    """u and v of links that connect what the full sets link in each (node, chunk, cell) of `asks`.

    A member's set comes once to each place where it is asked for.  Members of one
    component count as connected, so a place emits fewer links than it has members.
    """

    def make_sets():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, bounds = sets(as_bytes(batch.column(0)))
            own = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * 8), pa.py_buffer(flat)])
            return pa.RecordBatch.from_arrays([batch.column(1), own.cast(pa.binary())], ["rep", "shingles"])

        return each

    def arrays(column: pa.Array) -> np.ndarray:
        out = np.empty(len(column), object)
        out[:] = [np.frombuffer(x, U64) for x in column.to_pylist()] or []
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3, arrays, 16_000_000):
            # Majors, then minors by number, then the few: what one of the few looks at stands in front.
            order = np.lexsort((group[1], group[3]))
            own, rep, comp, few = (c[order] for c in group[:4])
            majors, members = int((few == MAJOR).sum()), int((few != FEW).sum())
            size = np.array([len(x) for x in own])
            first = np.cumsum(size) - size
            kind = np.unique(np.concatenate(own), return_inverse=True)[1]
            marked = np.zeros(len(kind), np.int32)
            root = {int(c): int(c) for c in comp}
            links = []

            def find(x: int) -> int:
                while (up := root[x]) != x:  # noqa: B023
                    root[x] = root[up]  # noqa: B023
                    x = up
                return x

            for x in range(members, len(rep)):
                seen = majors + int(np.searchsorted(rep[majors:members], rep[x]))
                if not seen:
                    continue
                mine = kind[first[x] : first[x] + size[x]]
                marked[mine] = 1
                common = np.add.reduceat(marked[kind[: first[seen - 1] + size[seen - 1]]], first[:seen])
                marked[mine] = 0
                for y in np.flatnonzero(PART * common >= WHOLE * (size[x] + size[:seen] - common)).tolist():
                    a, b = find(int(comp[x])), find(int(comp[y]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        links.append((max(rep[x], rep[y]), min(rep[x], rep[y])))
            if links:
                u, v = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    texts = _texts(docs, saved(asks.select(F.col("rep").alias("doc_id")).distinct(), "ids"))
    whole = arrow_map(texts.select("text", "doc_id"), "rep bigint, shingles binary", make_sets).where(F.length("shingles") > 0)
    met = whole.join(asks, "rep").select("shingles", "rep", "comp", "few", "node", "chunk", "cell")
    met = met.repartition("node", "chunk", "cell").sortWithinPartitions("node", "chunk", "cell")
    return met.mapInArrow(run, "u bigint, v bigint").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) that are links, by their full sets."""
    ends = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
    rows = _texts(docs, saved(ends, "ids"))
    left = rows.toDF("u", "u_text")
    right = rows.toDF("v", "v_text")
    both = pairs.select("u", "v").join(left, "u").join(right, "v").select("u_text", "v_text", "u", "v")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            known: dict[bytes, np.ndarray] = {}
            columns = [[x or b"" for x in as_bytes(batch.column(k))] for k in (0, 1)]
            distinct = list(dict.fromkeys([*columns[0], *columns[1]]))
            flat, bounds = sets(distinct)
            for x, a, b in zip(distinct, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                known[x] = flat[a:b]
            good = []
            for x, y in zip(*columns, strict=True):
                a, b = known[x], known[y]
                common = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
                good.append(common > 0 and PART * common >= WHOLE * (len(a) + len(b) - common))
            return batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

        return each

    return arrow_map(both, "u bigint, v bigint", make).distinct()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and comp of the edges of one task, by union-find with the smaller root on top."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node reachable) of every node with an edge (u, v).

    Up to ONE_TASK edges (16 bytes each; they are counted first) are united in one task.
    More are united by large-star and small-star steps by turns, each a few aggregations
    and joins; every round is written to the shared folder, and the rounds end when the
    edges stay alike.
    """
    now = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if now.count() <= ONE_TASK:
        return now.repartition(1).mapInArrow(_united, "node bigint, comp bigint")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_totals(both, "u", "v", F.least(F.min("v"), F.first("u")).alias("m"))
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_totals(large, "u", "v", F.min("v").alias("m"))
        small = small.select("u", F.col("m").alias("v")).union(small.select("v", "m"))
        after = saved(small.where("u <> v").distinct(), "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        now = after
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def _bits() -> Column:
    """The salts of a group, one bit each."""
    return F.bit_or(F.expr("shiftleft(1L, salt)"))


def _salts(bits: str = "salts") -> Column:
    """One row for each salt whose bit is set."""
    return F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), k -> (shiftright({bits}, k) & 1L) = 1L)")).alias("salt")


def _with_totals(rows: DataFrame, key: str, spread: str, *totals: Column, where: str = "true") -> DataFrame:
    """rows with aggregates of their key; the rows of a hot key meet them in SALTS tasks, parted by `spread`."""
    rows = rows.withColumn("salt", _salt(spread))
    found = rows.groupBy(key).agg(*totals, _bits().alias("salts")).where(where)
    found = found.select("*", _salts()).drop("salts")
    return rows.join(found, [key, "salt"]).drop("salt")


def _counted(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two members or more."""
    return _with_totals(rows, "node", "rep", F.count("*").alias("members"), where="members > 1")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (rep, node, n_shingles, comp) of the nodes that hold more than one component; `major`: the node's largest, `others`: members outside it."""
    rows = rows.withColumn("salt", _salt("rep"))
    parts = rows.groupBy("node", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), _bits().alias("salts"))
    whole = parts.groupBy("node").agg(
        F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("members"), F.sum("shingles").alias("shingles"),
        F.count("*").alias("parts"), F.bit_or("salts").alias("salts"),
    ).where("parts > 1")
    others = (F.col("members") - F.col("top.n")).alias("others")
    whole = whole.select("node", F.col("top.comp").alias("major"), "members", "shingles", others, _salts())
    return rows.join(whole, ["node", "salt"]).drop("salt")


def _on_node(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows joined with one row (node, ...) a node (saved); of a checked number these are broadcast, beyond it the rows of a large node meet them in SALTS tasks."""
    if found.count() <= BROADCAST_NODES:
        return rows.join(F.broadcast(found), "node")
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", _salt("rep")).join(found, ["node", "salt"]).drop("salt")


def likeness(large: DataFrame, own: DataFrame) -> DataFrame:
    """node and `alike`: how often tokens of members outside the largest component agree with those of members, on about SAMPLED of either."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            tokens_, (node, a, b) = _matrix(batch.column(0)), (_longs(batch.column(k)) for k in (1, 2, 3))
            k = np.arange(LOOKED_AT)
            at = (mix(node.view(U64)[:, None] + k.astype(U64), 65) % U64(COORDINATES)).astype(np.int64)
            token = np.take_along_axis(tokens_, at, 1).astype(np.int64)
            # Rows of a batch that agree are counted together.
            rows = np.stack([np.repeat(node, LOOKED_AT), np.tile(k, len(node)), token.ravel()], 1)
            distinct, inverse = np.unique(rows, axis=0, return_inverse=True)
            counts = [np.bincount(inverse.ravel(), np.repeat(x, LOOKED_AT), len(distinct)).astype(np.int64) for x in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (*distinct.T, *counts)], ["node", "k", "token", "a", "b"])

        return each

    drawn = lambda of, seed: (F.pmod(F.xxhash64("rep", "node", F.lit(seed)), F.lit(1 << 20)) * F.col(of) < F.lit(SAMPLED << 20)).cast("long")
    outside = (F.col("comp") != F.col("major")).cast("long")
    rows = saved(large.select("rep", "node", (outside * drawn("others", 1)).alias("a"), drawn("members", 2).alias("b")).where("a + b > 0"), "drawn")
    met = own.join(F.broadcast(rows) if rows.count() <= BROADCAST_NODES else rows, "rep")
    seen = arrow_map(met.select("tokens", "node", "a", "b"), "node bigint, k bigint, token bigint, a bigint, b bigint", make)
    seen = seen.groupBy("node", "k", "token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    whole = F.sum("a").cast("double") * F.sum("b") / LOOKED_AT
    return seen.groupBy("node").agg((F.sum(F.col("a") * F.col("b")) / F.greatest(whole, F.lit(1.0))).alias("alike"))


def families(ended: DataFrame) -> DataFrame:
    """rep, node, n_shingles and comp of ended nodes (rep, node, n_shingles, comp, members), those of one family as one node.

    Each class has a home, the largest node that it ended in.  A node of whose members half
    or more have one home joins that home's family; another one is a family of its own.
    """
    home = ended.groupBy("rep").agg(F.max(F.struct("members", "node")).alias("home")).select("rep", F.col("home.node").alias("home"))
    votes = ended.join(home, "rep").groupBy("node", "home").agg(F.count("*").alias("n"), F.first("members").alias("members"))
    votes = votes.groupBy("node").agg(F.max(F.struct("n", "home")).alias("top"), F.first("members").alias("members"))
    of = votes.select("node", F.when(F.col("top.n") * 2 >= F.col("members"), F.col("top.home")).otherwise(F.col("node")).alias("family"))
    further = of.toDF("family", "next")
    of = of.join(further, "family", "left").select("node", F.coalesce("next", "family").alias("family"))
    return _on_node(ended, saved(of, "of")).select("rep", F.xxhash64("family", F.lit("family")).alias("node"), "n_shingles", "comp").distinct()


def links(docs: DataFrame, classes: DataFrame, possible: float | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """u and v of links that connect every component of the classes (rep, n_shingles, tokens, roots); and tables that they are read from."""
    used = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        used.append(saved(df, label))
        return used[-1]

    own = classes.select("rep", "tokens")
    first = kept(_counted(roots(classes)), "nodes")
    near = neighbours(first.join(classes.select("rep", "n_shingles", "tokens"), "rep")).groupBy("u", "v").agg(F.max("near").alias("near"))
    ends = near.select("u", "v", "near", F.explode(F.array("u", "v")).alias("end"))
    place = F.row_number().over(W.partitionBy("end").orderBy(F.desc("near"), "u", "v"))
    best = kept(ends.withColumn("place", place).where(F.col("place") <= LIKEST).select("u", "v").distinct(), "best")
    found = kept(confirmed(best, docs), "links")
    comps = kept(components(found), "comps").select(F.col("node").alias("rep"), "comp")

    # The levels move numbers only; tokens come to the rows of large nodes, and to all leaves at the end.
    whole = classes.select("rep", "n_shingles").join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    level, leaves = first.select("rep", "node").join(whole, "rep").select("rep", "node", "n_shingles", "comp"), None
    ended = None
    for depth in range(1, MAX_DEPTH + 1):
        mixed, last = kept(_mixed(level), "mixed"), depth == MAX_DEPTH
        small = mixed if last else mixed.where(F.col("others") <= SMALL)
        leaves = small if leaves is None else leaves.unionByName(small)
        large = mixed.where(F.col("others") > SMALL)
        if last or large.isEmpty():
            break
        alike = kept(likeness(large, own), "likeness")
        whole = _on_node(large, alike.where(F.col("alike") >= ALIKE)).select("rep", "node", "n_shingles", "comp", "members")
        ended = whole if ended is None else ended.unionByName(whole)
        parted = alike.where(F.col("alike") < ALIKE)
        if parted.isEmpty():
            break
        rest = kept(_on_node(large, parted).select("rep", "node", "n_shingles", "comp"), "rest")
        few = rest.count() <= BROADCAST_NODES
        level = kept(children(own.join(F.broadcast(rest) if few else rest, "rep")), "children")
    if ended is not None:
        leaves = leaves.unionByName(_mixed(families(ended)).select(leaves.columns))
    asks = kept(asked(leaves.join(own, "rep"), possible), "asks")
    return found.unionByName(decided(asks, docs)), used


def near_duplicates(docs: DataFrame, possible: float | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; `possible` replaces POSSIBLE (0: every pair of a leaf is decided on full sets)."""
    key = ["k1", "k2", "n_shingles"]
    whole = saved(sketched(docs).withColumn("salt", F.floor(F.rand(7) * SALTS).cast("int")), "sketches")
    classes = whole.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(key).agg(
        F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"), F.first("roots").alias("roots")
    )
    classes = saved(classes, "classes")
    rows = saved(whole.select("doc_id", *key, "salt"), "keys")
    drop(whole)
    found, used = links(docs, classes, possible)
    comps = saved(components(found), "comps")
    for t in used:
        drop(t)
    named = classes.join(comps, classes["rep"] == comps["node"], "left").select(*key, F.coalesce("comp", "rep").alias("component"))
    # A class of any number of copies meets its component in SALTS tasks.
    salts = rows.where("n_shingles > 0").groupBy(key).agg(_bits().alias("salts"))
    named = named.join(salts, key).select(*key, "component", _salts())
    out = rows.join(named, [*key, "salt"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), _kept(component).alias("kept"))


def _kept(component: Column) -> Column:
    return F.when(F.col("doc_id").isNull(), component.isNull()).otherwise(F.col("doc_id") == component)


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
