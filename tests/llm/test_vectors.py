"""Hard negatives, vector codes and shards against brute force, with odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import negatives, sharding, vector_codes
from verdigris.llm.vectors import LARGEST

VEC = "vec_id long, embedding array<float>, label int"


def floors(vector, scale):
    return [max(-LARGEST, min(LARGEST, math.floor(max(-1e300, min(1e300, float(x) * scale))))) for x in vector]


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def random_vectors(n, width=10, seed=1, labels=4):
    rng = np.random.default_rng(seed)
    return [(k, [float(x) for x in rng.normal(size=width).astype(np.float32)], int(rng.integers(labels))) for k in range(n)]


ODD = [
    (None, [0.5] * 10, 1), (900, None, 1), (901, [0.5, None] * 5, 1), (902, [float("nan")] * 10, 2), (903, [float("inf")] + [0.0] * 9, 2),
    (904, [0.5] * 10, None), (905, [], 1), (906, [0.25] * 3, 0), (907, [1e30, -1e30] + [0.0] * 8, 3), (1000, [0.5] * 10, 2), (1001, [0.5] * 10, 2),
]


def brute_negatives(rows, positives=5, found=5):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or not usable(v):
            continue
        row = (label, floors(v, 256))
        best[i] = min(best.get(i, row), row)
    score = lambda a, b: sum(x * y for x, y in zip(best[a][1], best[b][1]))  # noqa: B905, E731
    out = []
    for a in (i for i in best if i % 100 == 0):
        ranked = sorted((-score(a, b), b) for b in best if b != a)
        for s, p in [x for x in ranked if best[x[1]][0] == best[a][0]][:positives]:
            window = [(t, b) for t, b in ranked if best[b][0] != best[a][0] and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, k, b, -s, -t) for k, (t, b) in enumerate(window[:found], 1)]
    return sorted(out)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_negatives_equal_brute_force(spark, monkeypatch, small_blocks):
    """Blocks far smaller than a label, and dimensions in several chunks, give the same rows."""
    if small_blocks:
        for name, value in {"LEFT": 2, "RIGHT": 40, "CHUNK": 3, "PARTS": 3}.items():
            monkeypatch.setattr(negatives, name, value)
    rows = random_vectors(260) + ODD + [(k, [0.5] * 10, 1) for k in range(300, 330)] + random_vectors(3) + [(7, [9.0] * 10, 3)]
    df = spark.createDataFrame(rows, VEC).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"), F.lit("x").alias("part"))
    got = negatives.hard_negatives(df, F.col("id") % 100 == 0)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute_negatives(rows)


def test_products_beyond_floating_point():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(-LARGEST, LARGEST, (3, 40)) for _ in range(2))
    wanted = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    assert negatives.product(a, b).tolist() == wanted
    assert negatives.product(a[:, :0], b[:, :0]).tolist() == [[0] * 3] * 3


def test_vectors_of_an_empty_table(spark):
    none = spark.createDataFrame([], VEC).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    assert negatives.hard_negatives(none, F.col("id") % 100 == 0).count() == 0
    assert vector_codes.vector_codes(none).count() == 0


def brute_codes(rows, entries, rounds):
    kept = [(i, floors(v, 1024), label) for i, v, label in rows if usable(v)]
    width = -(-max([1, *(len(v) for _, v, _ in kept)]) // 4)
    kept = [(i, [tuple((v + [0] * 4 * width)[p * width : (p + 1) * width]) for p in range(4)], label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p] for r in first] for p in range(4)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        held = [[[] for _ in first] for _ in range(4)]
        for _, parts, _ in kept:
            for p in range(4):
                held[p][near(p, parts[p])[1]].append(parts[p])
        books = [[tuple(sum(c) // len(c) for c in zip(*h, strict=True)) if h else e for h, e in zip(held[p], books[p], strict=True)] for p in range(4)]
    out = []
    for i, parts, label in kept:
        found = [near(p, parts[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    sums = {}
    for *_, error, label in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, c, e, sums[y], digest) for i, c, e, y in out], key=str)


@pytest.mark.parametrize(("entries", "n"), [(16, 400), (256, 60)])
def test_codes_equal_brute_force(spark, entries, n):
    rows = random_vectors(n, width=10) + [r for r in ODD if r[0] != 907] + random_vectors(5)
    df = spark.createDataFrame(rows, VEC).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"), F.lit(0).alias("of"))
    got = vector_codes.vector_codes(df, entries=entries, rounds=3)
    own = sorted([tuple(r) for r in got.select("id", "code", "error", "label_error", "codebooks_sha256").collect()], key=str)
    assert own == brute_codes(rows, entries, 3)
    assert got.where("n_refined < 4").isEmpty()


def test_cell_bounds_hold():
    """Bounds are bounds, and spare most entries of clustered data a whole distance."""
    rng = np.random.default_rng(3)
    entries = rng.integers(-500, 500, (256, 16))
    rows = entries[rng.integers(256, size=300)] + rng.integers(-20, 20, (300, 16))
    cells = vector_codes.CellFilter(entries)
    lower, upper = cells.bounds(rows)
    whole = ((rows[:, None] - entries[None]) ** 2).sum(2)
    assert (lower <= whole).all() and (whole <= upper).all()
    entry, distance, refined = cells.nearest(rows)
    assert (entry == whole.argmin(1)).all() and (distance == whole.min(1)).all()
    assert refined.mean() < 20


def test_huge_components_do_not_fail(spark):
    rows = [(k, [(-1.0) ** k * 1e30] * 8, 1) for k in range(600)]
    df = spark.createDataFrame(rows, VEC).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    assert vector_codes.vector_codes(df, entries=1).count() == 600


DOCS = "doc_id long, text string, size int, document string"


def brute_shards(rows, shards):
    line = sorted(((hashlib.md5((t or "").encode()).hexdigest(), i is None, i or 0) for i, t in rows))
    texts = {hashlib.md5((t or "").encode()).hexdigest(): len((t or "").encode()) + 1 for _, t in rows}
    sizes = [texts[h] for h, *_ in line]
    ends = np.cumsum(sizes).tolist()
    starts, total, largest = [e - s for e, s in zip(ends, sizes, strict=True)], sum(sizes), max(sizes)
    cuts = []
    for k in range(1, shards):
        at = next(r for r in range(len(line)) if starts[r] * shards <= k * total < ends[r] * shards)
        group = [r for r in range(len(line)) if line[r][0] == line[at][0]]
        far = lambda x: abs(x * shards - k * total)  # noqa: B023, E731
        near = min((starts[group[0]], ends[group[-1]]), key=far)
        cuts.append(near if 2 * far(near) <= largest * shards else min((starts[at], ends[at]), key=far))
    out, seen = [], {}
    for (h, no_id, i), s in zip(line, starts, strict=True):
        shard = sum(c <= s for c in cuts)
        out.append((None if no_id else i, texts[h], shard, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + 1
    return sorted(out, key=str)


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_shards_equal_brute_force(spark, shards):
    rng = random.Random(4)
    rows = [(k, "é" * rng.randrange(400)) for k in range(150)] + [(k, "copy " * 30) for k in range(200, 290)] + [(None, None), (3, ""), (3, ""), (7, "x" * 20_000)]
    df = spark.createDataFrame([(i, t, 0, "d") for i, t in rows], DOCS).repartition(7)
    got = sharding.sharded(df, shards)
    assert sorted([tuple(r) for r in got.select("doc_id", "size", "shard", "slot").collect()], key=str) == brute_shards(rows, shards)


def test_shards_are_balanced_whole_and_keep_columns(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, "w" * rng.randrange(1, 900)) for k in range(2000)] + [(k, "the same text " * 9) for k in range(2000, 3000)]
    df = spark.createDataFrame([(i, t, 5, "d") for i, t in rows], DOCS).repartition(5)
    got = sharding.sharded(df, 8, keep=df.columns).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2 * 900
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert all(r.text_crc32 == zlib.crc32(r.document["text"].encode()) for r in got.itertuples())
    # Only groups that are larger than the largest document are parted.
    parted = got.groupby("text_crc32").agg({"shard": "nunique", "size": "sum"})
    assert (parted[parted["shard"] > 1]["size"] > 900).all()
    path = str(tmp_path / "shards")
    sharding.write_shards(df, path, 8)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select(df.columns).collect())) == sorted((i, t, 5, "d") for i, t in rows)
    assert back.select("shard_").distinct().count() == 8


def test_shards_of_few_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.sharded(none).count() == 0
    one = sharding.sharded(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["size"], r["text_crc32"], r["slot"]) for r in one] == [(1, 1, 0, 0)]
