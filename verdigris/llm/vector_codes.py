"""Vector codes from part codebooks, whose nearest entries a VA-file filter finds.

Vectors of whole numbers are cut into PARTS equal consecutive parts.  Each part has a
codebook of up to ENTRIES entries, which start as the parts of the smallest ids; every
round assigns all parts to their nearest entries and moves each entry to the floor of its
parts' mean.  A code names the entries of a vector's parts.

The nearest entry is found as a VA-file finds it: each coordinate of the entries is
quantised to BITS bits, that is to cells of about equally many entries.  A query's lookup
tables hold, for each coordinate and cell, the least and the greatest squared distance to
what the cell holds; summed by the entries' cells they bound each entry's distance.  Only
entries whose lower bound is not above the least upper bound are refined by their whole
distance, in integers.

Rounds are Spark jobs: each task sums its parts by entry, the sums are added up in a
shuffle, and what comes to the driver is the codebook, whose size does not depend on the
rows.  No entry, label or copy of a vector gathers rows in one task.

Edge cases: a vector that is null or has a null or non-finite component is dropped; vectors
shorter than the longest end in zeros, as do parts if the length is no multiple of PARTS;
components beyond 2**24 count as 2**24; a null id comes last and stays null; repeated ids
are rows of their own, and start entries in the order of their vectors; fewer rows than
ENTRIES make as many entries; an error sum beyond a long is null; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import collected, drop, pieces, saved, table
from .vectors import integers, longest, padded, usable

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Bits of a coordinate's cell.
BITS = 4
#: Rows that one numpy step handles: its bounds and candidates take some 20 MB.
STEP = 500


class CellFilter:
    """Entries (a matrix of int64) approximated by cells."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        n, width = entries.shape
        cells = 1 << BITS
        self.cell = np.zeros((width, n), np.intp)
        self.low, self.high = np.zeros((width, cells), np.int64), np.zeros((width, cells), np.int64)
        for d in range(width):
            x = np.sort(entries[:, d])
            edges = x[np.arange(1, cells) * n // cells]
            self.cell[d] = np.searchsorted(edges, entries[:, d], "right")
            for c in np.unique(self.cell[d]):
                inside = entries[self.cell[d] == c, d]
                self.low[d, c], self.high[d, c] = inside.min(), inside.max()

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each row to each entry."""
        lower, upper = (np.zeros((len(rows), len(self.entries)), np.int64) for _ in range(2))
        for d in range(rows.shape[1]):
            below, above = self.low[d] - rows[:, d, None], rows[:, d, None] - self.high[d]
            least = np.maximum(np.maximum(below, above), 0)
            most = np.maximum(-below, -above)
            lower += np.take(least * least, self.cell[d], axis=1)
            upper += np.take(most * most, self.cell[d], axis=1)
        return lower, upper

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: its nearest entry (ties: the first), their squared distance, and how many entries were refined."""
        lower, upper = self.bounds(rows)
        row, entry = np.nonzero(lower <= upper.min(1)[:, None])
        apart = rows[row] - self.entries[entry]
        distance = np.einsum("ij,ij->i", apart, apart)
        refined = np.bincount(row, minlength=len(rows))
        start = np.cumsum(refined) - refined
        least = np.minimum.reduceat(distance, start)
        at = np.flatnonzero(distance == least[row])
        first = at[np.unique(row[at], return_index=True)[1]]
        return entry[first], least, refined


def _parts(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), PARTS, width)


def _assigned(books: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Slices of the batches with their parts, and the entries, distances and refined candidates of these (rows by PARTS)."""
    filters = [CellFilter(b) for b in books]
    for batch in batches:
        for piece in pieces(batch):
            for at in range(0, piece.num_rows, STEP):
                rows = piece.slice(at, STEP)
                parts = _parts(rows.column(0), books.shape[2])
                found = [f.nearest(parts[:, p]) for p, f in enumerate(filters)]
                yield rows, parts, *(np.stack(x, 1) for x in zip(*found, strict=True))


def moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over vectors (x)."""
    n, width = books.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums of each entry's parts, and how many there are.
        sums = np.zeros((PARTS * n, width + 1), np.int64)
        for _, parts, entry, _, _ in _assigned(books, batches):
            for p in range(PARTS):
                np.add.at(sums, p * n + entry[:, p], np.column_stack((parts[:, p], np.ones(len(parts), np.int64))))
        slots = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(list(sums[slots]), pa.list_(pa.int64()))], ["slot", "sums"])

    sums = vectors.select("x").mapInArrow(run, "slot bigint, sums array<bigint>").select("slot", F.posexplode("sums").alias("place", "value"))
    slot, place, value = collected(sums.groupBy("slot", "place").agg(F.sum("value").alias("value")))
    whole = np.zeros((PARTS * n, width + 1), np.int64)
    whole[slot, place] = value
    used = whole[:, -1] > 0
    out = books.reshape(PARTS * n, width).copy()
    out[used] = whole[used, :-1] // whole[used, -1:]
    return out.reshape(books.shape)


def fitted(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (PARTS, entries, width) of vectors (id, x of equal lengths)."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(entries).toArrow().column("x").combine_chunks()
    width = len(first.flatten()) // max(1, len(first)) // PARTS
    books = np.ascontiguousarray(_parts(first, width).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        books = moved(vectors, books)
    return books


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code (two hex digits a part), error and n_refined of vectors (id, label, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, entry, distance, refined in _assigned(books, batches):
            code = entry.astype(np.uint8).tobytes().hex()
            codes = [code[k : k + 2 * PARTS] for k in range(0, len(code), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(1), rows.column(2), pa.array(codes, pa.string()), pa.array(distance.sum(1)), pa.array(refined.sum(1).astype(np.int64))],
                ["id", "label", "code", "error", "n_refined"],
            )

    kinds = dict(vectors.dtypes)
    return vectors.select("x", "id", "label").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint, n_refined bigint")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, label, x (PARTS parts of one width) of the rows (id, label, vector) that are not dropped."""
    kept = rows.where(usable("vector")).select("id", "label", integers("vector", scale).alias("x"))
    width = max(1, -(-longest(kept, "x") // PARTS))
    return kept.withColumn("x", padded("x", PARTS * width))


def vector_codes(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, code, error, label_error, codebooks_sha256, n_refined of rows (id, label, vector)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    vectors = whole_vectors(rows)
    books = fitted(vectors, entries, rounds)
    codes = saved(coded(vectors, books), "codes")
    # One small row a label, written: its size tells Spark whether to broadcast it.
    by_label = saved(codes.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "errors")
    out = codes.join(by_label, codes["label"].eqNullSafe(by_label["of"]), "left")
    out = saved(out.select("id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "n_refined"), "coded")
    drop(codes)
    drop(by_label)
    return out


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return vector_codes(rows).drop("n_refined").withColumnRenamed("id", "vec_id")


def _oracle() -> str:
    squared = "list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b.x) + list_dot_product(b.x, b.x)"
    nearest = f"SELECT vec_id, part, min(struct_pack(d := {squared}, entry := entry)) AS m FROM p JOIN b{{k}} b USING (part) GROUP BY ALL"
    steps = []
    for k in range(ROUNDS):
        steps.append(f"a{k} AS MATERIALIZED ({nearest.format(k=k)})")
        steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(floor(total / n) ORDER BY place) AS x FROM (
      SELECT part, m.entry AS entry, place, sum(value) AS total, count(*) AS n
      FROM (SELECT part, m, unnest(x) AS value, unnest(range(len(x))) AS place FROM a{k} JOIN p USING (vec_id, part)) GROUP BY ALL)
    GROUP BY ALL) n USING (part, entry))""")
    joined = ",\n".join(steps)
    return f"""
WITH v AS (
  SELECT vec_id, label, [floor({SCALE} * x::DOUBLE) for x in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT vec_id, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS x FROM v, range({PARTS}) t(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < {ENTRIES}),
{joined},
last AS ({nearest.format(k=ROUNDS)}),
c AS (SELECT vec_id, string_agg(lower(printf('%02x', m.entry)), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM last GROUP BY vec_id),
digits AS (
  SELECT sha256(string_agg(value::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS digest
  FROM (SELECT part, entry, unnest(x) AS value, unnest(range(len(x))) AS place FROM b{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256
FROM c JOIN v USING (vec_id), digits
"""


ORACLE = _oracle()
