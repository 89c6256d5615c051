"""Hard negatives by a two-dimensional block matrix multiply.

Scores of anchors against all rows are one large product of integer matrices, and nothing
of it is ever held as a whole:

1. Anchors are dealt to blocks of about LEFT rows, all rows to blocks of about RIGHT, and
   dimensions to at most CHUNKS chunks.  Anchor block i meets row block j once for each
   chunk k, in a task that multiplies these two panels and emits one partial int64 tile.
2. A shuffle by (i, j) brings a tile's partial sums together; they are added, and the tile
   is reduced at once to the few best rows of each anchor.  The best of all tiles are then
   ranked for each anchor, after each task has ranked its own.

This runs twice.  First anchors meet rows of their own label (labels are dealt to PARTS
parts, so that few pairs with other labels are looked at), which gives the positives.
Then anchors, with the windows that their positives' scores open, meet all rows, and each
tile gives the first few negatives of every window.

A label that most rows have is many blocks, as any other; a block's rows are chosen by a
hash of the id, so equal vectors and equal labels do not gather.  Work grows with anchors
times rows, as the task itself does; panels are copied once for every LEFT anchors or
RIGHT rows on the other side.

Edge cases: rows without id, label or vector, or with a null or non-finite component, take
no part; of rows that share an id the smallest (label, vector) stands; vectors shorter than
the longest end in zeros; components beyond 2**24 count as 2**24; anchors without positives
or without negatives in a window give no rows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, saved, table
from .vectors import integers, longest, padded, usable

SCALE = 256
#: Rows of a block of anchors and of a block of rows: a tile has about 4 MB.
LEFT, RIGHT = 256, 2048
#: Dimensions of a chunk, unless that makes more than CHUNKS of them.
CHUNK, CHUNKS = 32, 8
#: Parts that labels are dealt to in the search for positives.
PARTS = 64
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is between LOWEST and 100 hundredths of the positive's.
LOWEST = 80

TILE = "part int, i int, j int, k int, a_id array<bigint>, a_label array<bigint>, opens array<bigint>, p_id array<bigint>, b_id array<bigint>, b_label array<bigint>, tile binary"
FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"


def prepared(rows: DataFrame, anchor: Column, scale: int = SCALE) -> DataFrame:
    """id, label, x, is_anchor of rows (id, label, vector) that take part, one row an id."""
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector"))
    rows = rows.select(F.col("id").cast("long"), F.struct(F.col("label").cast("long").alias("label"), integers("vector", scale).alias("x")).alias("row"))
    rows = rows.groupBy("id").agg(F.min("row").alias("row"))
    return rows.select("id", "row.label", "row.x", anchor.alias("is_anchor"))


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def _panel(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, by floating point where every sum is below 2**53 and so exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max()) < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def multiplied(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Partial tiles (TILE) of anchors (part, i, j, k, id, label, opens, x) and rows (part, i, j, k, b_id, b_label, b_x)."""
    names = [x.split()[0] for x in TILE.split(", ")]
    key = ["part", "i", "j", "k"]

    def run(at: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types, strict=True)})
        left, right = left.sort_by("id"), right.sort_by("b_id")
        tile = product(_panel(left.column("x"), left.num_rows), _panel(right.column("b_x"), right.num_rows))
        once = [[]] * 6
        if at[3].as_py() == 0:
            once = [left.column(n).to_pylist() for n in ("id", "label")] + [left.column(n).combine_chunks().flatten().to_pylist() for n in ("opens", "p_id")]
            once += [right.column(n).to_pylist() for n in ("b_id", "b_label")]
        values = [x.as_py() for x in at] + once + [tile.tobytes()]
        return pa.table({n: pa.array([v], t) for n, v, t in zip(names, values, types, strict=True)})

    types = [pa.int32()] * 4 + [pa.list_(pa.int64())] * 6 + [pa.binary()]
    return anchors.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(run, TILE)


def _first(score: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """The n of `among` with the highest scores, ties by place."""
    s = score[among]
    if len(s) > n:
        among = among[s >= np.partition(s, len(s) - n)[len(s) - n]]
        s = score[among]
    return among[np.argsort(-s, kind="stable")[:n]]


def best(tiles: DataFrame, n: int, lowest: int | None = None) -> DataFrame:
    """FOUND: the n first rows that each tile has for each anchor.

    Without `lowest`: among other rows of the anchor's label.  With it: among rows of other
    labels in each of the anchor's windows, which go from lowest hundredths of the
    positive's score to the whole of it.
    """

    def run(tile: pa.Table) -> pa.Table:
        first = int(np.flatnonzero(_numbers(tile.column("k")) == 0)[0])
        a_id, a_label, opens, p_id, b_id, b_label = (np.array(tile.column(n)[first].as_py(), np.int64) for n in ("a_id", "a_label", "opens", "p_id", "b_id", "b_label"))
        score = sum(np.frombuffer(x.as_buffer(), np.int64) for x in tile.column("tile")).reshape(len(a_id), len(b_id))
        opens, p_id = opens.reshape(len(a_id), -1), p_id.reshape(len(a_id), -1)
        out: list[tuple] = []
        for r in range(len(a_id)):
            same, s = b_label == a_label[r], score[r]
            if lowest is None:
                at = _first(s, np.flatnonzero(same & (b_id != a_id[r])), n)
                out += [(int(a_id[r]), None, None, int(b_id[x]), int(s[x])) for x in at]
                continue
            for top, positive in zip(opens[r].tolist(), p_id[r].tolist(), strict=True):
                if top >= 0:  # the window of a score below 0 is empty, as is a place without a positive
                    at = _first(s, np.flatnonzero(~same & (s <= top) & (s >= -(-lowest * top // 100))), n)
                    out += [(int(a_id[r]), positive, top, int(b_id[x]), int(s[x])) for x in at]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor_id", "positive_id", "positive_score", "id", "score"), columns, strict=True)})

    return tiles.groupBy("part", "i", "j").applyInArrow(run, FOUND)


def _ranked(found: DataFrame, key: list[str], n: int) -> DataFrame:
    """The first n of each key, with their rank."""
    order = W.partitionBy(*key).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _upto(n: Column, name: str) -> Column:
    """One row for each of 0 to n - 1; none where n is 0."""
    return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias(name)


def _blocks(counts: dict[int, int], size: int, parts: int) -> Column:
    """How many blocks of about `size` rows the row's part has."""
    return F.element_at(F.array(*[F.lit(-(-counts.get(p, 0) // size)) for p in range(parts)]), F.col("part") + 1)


def tiles(anchors: DataFrame, rows: DataFrame, part: Column, parts: int, width: int) -> DataFrame:
    """Partial tiles of anchors (id, label, opens, p_id, x) against rows (id, label, x); both are dealt to parts."""
    step = max(CHUNK, -(-width // CHUNKS))
    chunks = max(1, -(-width // step))
    anchors, rows = anchors.withColumn("part", part), rows.withColumn("part", part)
    counts = [dict(x.groupBy("part").count().collect()) for x in (anchors, rows)]  # PARTS rows at most
    n_left, n_right = _blocks(counts[0], LEFT, parts), _blocks(counts[1], RIGHT, parts)
    chunk = F.slice(padded("x", chunks * step), F.col("k") * step + 1, F.lit(step)).alias("x")
    ks = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("k")
    left = anchors.select("*", F.pmod(F.xxhash64("id"), n_left).cast("int").alias("i"), _upto(n_right, "j"))
    left = left.select("*", ks).select("part", "i", "j", "k", "id", "label", "opens", "p_id", chunk)
    right = rows.select("*", F.pmod(F.xxhash64("id", F.lit(1)), n_right).cast("int").alias("j"), _upto(n_left, "i"))
    right = right.select("*", ks).select("part", "i", "j", "k", "id", "label", chunk).toDF("part", "i", "j", "k", "b_id", "b_label", "b_x")
    return multiplied(left, right)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (id, label, vector); `anchor`: which ids are anchors."""
    rows = saved(prepared(rows, anchor), "vectors")
    width = longest(rows, "x")
    anchors = rows.where("is_anchor").drop("is_anchor")
    none = F.array().cast("array<bigint>")
    part = F.pmod(F.xxhash64("label"), F.lit(PARTS)).cast("int")
    near = best(tiles(anchors.withColumns({"opens": none, "p_id": none}), rows, part, PARTS, width), positives)
    near = _ranked(near.select("anchor_id", "id", "score"), ["anchor_id"], positives)
    # Windows of every anchor, as many as there can be: -1 stands where a positive is missing.
    own = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))
    filled = lambda of: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda r: F.coalesce(F.get(F.col("near"), r - 1)[of], F.lit(-1).cast("long")))
    own = saved(own.select(F.col("anchor_id").alias("id"), filled("score").alias("opens"), filled("id").alias("p_id")), "windows")
    found = best(tiles(anchors.join(own, "id"), rows, F.lit(0), 1, width), negatives, lowest)
    found = _ranked(found, ["anchor_id", "positive_id"], negatives)
    out = saved(found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    drop(rows)
    drop(own)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0)


ORACLE = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * x::DOUBLE) for x in embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOWEST} * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= {NEGATIVES}
"""
