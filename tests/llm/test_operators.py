import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import bpe, chat, fingerprints, lines, mixing, neardup, ppm, quality, queries, toxicity
from verdigris.llm.ragged import BYTE_KEYS, U64, hashes_of_spans, mix

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    long = "word " * 30_000 + "z" * 50_000
    rows = [(1, None, "a"), (2, "", None), (3, long, "b"), (4, "one two", "a"), (4, "one two", "a"), (5, " \n\t", "b"), (None, "one two", "c"), (6, "A b c d e f\nA b c d e f", "c")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, wanted = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    text = lambda d: sorted(d[columns].map(lambda x: "" if x is None or x != x else f"{x:.8g}" if isinstance(x, float) else str(x)).agg("|".join, axis=1))
    assert text(got) == text(wanted)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    rows, shared = [], [f"s{k}" for k in range(60)]
    for g in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 40, 200]))]
        for c in range(rng.choice([1, 2, 3, 12])):
            rows.append((len(rows), " ".join(edited(rng, base, rng.randrange(1 + len(base) // 25)) + (shared if g % 3 == 0 else []))))
            if c == 2:
                base = edited(rng, base, 4)
    rows += [(len(rows) + k, t) for k, t in enumerate(["a b", "A  b", "", None, "b a"])]
    chain = [f"c{k}" for k in range(150)]
    for _ in range(70):
        chain = edited(rng, chain, 2)
        rows.append((len(rows), " ".join(chain)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == brute_components(rows)


def test_recall_at_the_threshold(spark, monkeypatch):
    """Pairs just at the threshold, with small nodes so that the trees must branch."""
    monkeypatch.setattr(neardup, "SMALL", 8)
    rng, rows = random.Random(3), []
    for k in range(120):
        base = [f"{k}x{j}" for j in range(204)]
        rows.append((2 * k, " ".join(base), "s"))
        other = list(base)
        for place in (20, 50, 80, 110, 140):
            other[place + rng.randrange(5)] = f"n{rng.random()}"
        rows.append((2 * k + 1, " ".join(other), "s"))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(120)) >= 119


@pytest.mark.parametrize("limit", [0, neardup.ONE_TASK])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(neardup, "ONE_TASK", limit)
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r["node"]: r["comp"] for r in neardup.components(spark.createDataFrame(edges[:-1], "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[102] == 100 and len(got) == 44


def test_ppm_scores(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ka", "to", "mi", "ru") for b in ("la", "ne", "so")]
    rows = [(k, " ".join(rng.choices(words, k=30)), "s") for k in range(120)] + [(500, "", "s"), (501, None, "s"), (502, "zzq qqz", "s"), (None, "ka", "s")]
    docs = frame(spark, rows)
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = {r["doc_id"]: r for r in ppm.scores(docs, ~held).collect()}
    learn = [t for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for t in learn for w in [*(t or "").split(), None])
    n, v = sum(c.values()), len(c)
    for i, t, _ in rows:
        own = [*(t or "").split(), None]
        assert got[i]["n_tokens"] == len(own) and got[i]["train_tokens"] == n and got[i]["n_known"] == sum(c[w] > 0 for w in own)
        assert math.isclose(got[i]["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    mean = lambda ids, col: sum(got[i][col] for i in ids) / sum(got[i]["n_tokens"] for i in ids)
    out = [i for i, _, _ in rows[:120] if zlib.crc32(str(i).encode()) % 7 == 2]
    assert mean([502], "score") < mean(out, "score") < 0


def test_ppm_blocks_do_not_change_scores(spark, monkeypatch):
    rng = random.Random(6)
    docs = frame(spark, [(k, " ".join("".join(rng.choices("abcde", k=5)) for _ in range(40)), "s") for k in range(30)])
    one = {r["doc_id"]: (r["score"], r["base_score"]) for r in ppm.scores(docs, F.lit(True)).collect()}
    monkeypatch.setattr(ppm, "BLOCK", 1000)
    monkeypatch.setattr(ppm, "SHARD", 300)
    monkeypatch.setattr(ppm, "HEAD", 50)
    many = {r["doc_id"]: (r["score"], r["base_score"]) for r in ppm.scores(docs, F.lit(True)).collect()}
    assert all(math.isclose(one[k][j], many[k][j], rel_tol=1e-6) for k in one for j in (0, 1))


def test_lines_near_the_threshold(spark):
    rows = []
    for n in range(1, 9):
        rows += [(100 * n + k, f"own line number {n} {k}\nshared by {n} sites\n", f"s{k}") for k in range(n)]
    rows += [(9000 + k, "often on one site", "s1") for k in range(20)]
    got = {r["doc_id"]: r for r in lines.without_spread_lines(frame(spark, rows)).collect()}
    for n in range(1, 9):
        for k in range(n):
            assert ("shared" in got[100 * n + k]["text"]) == (n < lines.MIN_SITES or k == 0)
            assert "own line" in got[100 * n + k]["text"]
    assert all("often" in got[9000 + k]["text"] for k in range(20))


def test_mix_reaches_its_targets(spark):
    rng = random.Random(1)
    rows = [(k, "w " * rng.randrange(1, 60), rng.choice(["a", "b", "b", "b", "b", None])) for k in range(3000)]
    got = mixing.mix(frame(spark, rows)).groupBy("source").agg(
        F.first("target").alias("target"), F.first("source_size").alias("size"), F.sum(F.col("size") * F.col("times")).alias("taken"), F.max("times").alias("most")
    ).collect()
    for r in got:
        assert abs(r["taken"] - r["target"]) <= 60 and r["most"] <= 3 and r["target"] <= 3 * r["size"] + 1e-6
    assert math.isclose(sum(r["target"] for r in got), sum(r["size"] for r in got), rel_tol=1e-9)


def test_water_fill_clamps_and_shares(spark):
    rows = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 990, 2)], "source string, source_size long, weight int")
    got = {r["source"]: r["target"] for r in mixing.water_fill(rows).collect()}
    assert got["a"] == 30 and math.isclose(got["b"], 1970 / 3) and math.isclose(got["c"], 2 * 1970 / 3)


def test_fingerprints_against_the_next_document(spark):
    rng = random.Random(9)
    rows = [(3 * k, "".join(rng.choices("abcdefé ", k=rng.choice([0, 1, 7, 900]))), "s") for k in range(60)]
    rng.shuffle(rows)
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in fingerprints.compared_with_next(docs.repartition(5)).collect()}
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs).collect()}
    ordered = sorted((i, t) for i, t, _ in rows)
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        text = t[: len(t) - half] + following[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["fingerprint"] == plain[i]


def test_quality_policies_and_ablations(spark):
    rows = [(1, "plain words " + " ".join(f"w{k}" for k in range(60)), "a"), (2, "too short", "a"), (3, " ".join(f"w{k}***" for k in range(60)), "a"), (4, "a b c " * 40, "a")]
    ledger = quality.ledger(frame(spark, rows))
    kept = {r["doc_id"]: r["ok"] for r in ledger.select("doc_id", quality.passes("prose-1").alias("ok")).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}
    got = {r["rule"]: r for r in quality.ablations(ledger, "prose-1").collect()}
    assert got["few_words"]["n_failed_alone"] == 1 and got["few_words"]["n_kept_without"] == 2 and got["symbols"]["n_failed"] == 1


def test_odd_rows(spark, odd):
    path = bpe.public_tokenizers.path(bpe.VOCABULARY)
    ids = bpe.encode(odd.select("doc_id", "text"), path)
    back = bpe.decode(ids, path).collect()
    assert len(back) == 8 and max(len(r["decoded"]) for r in back) == 200_000
    assert lines.without_spread_lines(odd).count() == 8
    assert mixing.mix(odd).count() == 8
    assert fingerprints.compared_with_next(odd).count() == 8
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == 8
    by = {(r["doc_id"], r["n_shingles"]): r for r in got}
    assert by[(None, 1)]["component_id"] == 4 and not by[(None, 1)]["kept"] and by[(1, 0)]["kept"]
    assert ppm.scores(odd, F.lit(True)).count() == 8
    labels = spark.createDataFrame([(4, 1, 1), (6, 1, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(odd, toxicity.train(odd, labels)).count() == 8


def test_empty_tables(spark, none):
    path = bpe.public_tokenizers.path(bpe.VOCABULARY)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert bpe.encode(none, path).count() == 0
    assert quality.ledger(none).count() == 0
    assert lines.without_spread_lines(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert fingerprints.compared_with_next(none).count() == 0
    assert neardup.near_duplicates(none).count() == 0
    assert ppm.scores(none, F.lit(True)).count() == 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert chat.digests(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_clashing_columns(spark, odd):
    """Columns with the names of results and of what operators work with change nothing else."""
    more = odd.withColumns({c: F.lit(7) for c in ("ids", "place", "gone", "size", "k1", "comp", "uid", "n_words")})
    rows = lambda df, *columns: sorted(map(str, df.select(*columns).collect()))
    jobs = {
        "lines": (lines.without_spread_lines, ("doc_id", "source", "text", "n_lines", "n_removed")),
        "mix": (mixing.mixed_documents, ("doc_id", "source", "text")),
        "near": (neardup.near_duplicates, ("doc_id", "n_shingles", "component_id", "kept")),
        "ppm": (lambda d: ppm.scores(d, F.lit(True)), ("doc_id", "score")),
        "quality": (quality.ledger, ("doc_id", *quality.MEASURES, "failed_bits")),
        "fingerprints": (fingerprints.compared_with_next, ("doc_id", "n_chars", "fingerprint", "edited_fingerprint", "near_next")),
    }
    for name, (job, columns) in jobs.items():
        assert rows(job(more), *columns) == rows(job(odd), *columns), name
    assert mixing.mixed_documents(more).select("ids", "size").distinct().collect() == [(7, 7)]


def plain_phrases(symbols):
    """One level of the parse of one text, symbol by symbol, from the definition."""
    runs, k = [], 0
    while k < len(symbols):
        n = 1
        while k + n < len(symbols) and symbols[k + n] == symbols[k]:
            n += 1
        runs.append(symbols[k] if n == 1 else int(mix(np.array([symbols[k] + n & (1 << 64) - 1], U64), 61)[0]))
        k += n
    labels = runs
    for _ in range(4):
        out = []
        for i, x in enumerate(labels):
            differ = x ^ (labels[i - 1] if i else labels[0] ^ 1)
            lowest = (differ & -differ).bit_length() - 1 if differ else 0
            out.append(2 * lowest + (x >> lowest & 1))
        labels = out
    starts = [i for i in range(len(runs)) if i == 0 or (i < len(runs) - 1 and labels[i - 1] > labels[i] < labels[i + 1])]
    spans = list(zip(starts, [*starts[1:], len(runs)], strict=True))
    return [int(hashes_of_spans(np.array(runs[a:b], U64), np.array([0]), np.array([b - a]), 62)[0]) for a, b in spans]


def test_parsing_equals_a_plain_parser():
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abcde ") for _ in range(rng.randrange(300))) for _ in range(12)]
    texts += [b"", b"a", b"aaaaaaa", b"ab" * 40, "é中".encode() * 30, b"aab" * 9 + b"a" * 50]
    for text, got in zip(texts, fingerprints.sketches(texts), strict=True):
        symbols, names = [int(BYTE_KEYS[b]) for b in text], set()
        for level in range(1, max(fingerprints.LEVELS) + 1):
            symbols = plain_phrases(symbols) if symbols else []
            if level in fingerprints.LEVELS and symbols:
                names |= {int(x) >> 32 for x in mix(np.array(symbols, U64), 70 + level)}
        assert sorted(names)[: fingerprints.SKETCH] == got.tolist(), text


def test_conversations(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (None, 0, None, "x")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(rows)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\na\nassistant\nb\n").hexdigest() and got[1]["loss_chars"] == 2
    assert got[None]["loss_sha256"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns
    failed = {r["doc_id"] for r in quality.ledger(docs).where("failed_bits <> 0").collect()}
    assert {r["doc_id"] for r in kept.collect()} == set(texts) - failed
    cut = corpus_pipeline.line_dedup(spark, kept, SF)
    first = corpus_pipeline.near_duplicates(spark, cut, SF)
    wanted = brute_components([(r["doc_id"], r["text"]) for r in cut.collect()])
    assert {r["doc_id"] for r in first.collect()} == {i for i, (_, c) in wanted.items() if i == c}
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and all(len(r["ids"]) == r["n_tokens"] for r in rows)
    mixed = {r["doc_id"]: r["text"] for r in cut.collect()}
    decoded = bpe.decode(out.select("doc_id", "ids"), bpe.public_tokenizers.path(bpe.VOCABULARY)).collect()
    assert all(r["decoded"].decode() == mixed[r["doc_id"]] for r in decoded)
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in first.collect()}


@pytest.mark.parametrize("kind", ["null", "repeated", "outlier"])
def test_ranges_of_odd_ids_are_even(spark, monkeypatch, kind):
    """Ids that one range of numbers would hold are spread, copied once at most, and compared as plain order says."""
    monkeypatch.setattr(fingerprints, "UNEVEN", 1.5)
    monkeypatch.setattr(fingerprints, "FAIR_ROWS", 10)
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(30))
    if kind == "outlier":
        rows = [(f"doc-{k:06d}", text()) for k in range(1500)] + [("a", text())]
    else:
        rows = [(None if kind == "null" else 7, text()) for _ in range(1200)] + [(k, text()) for k in range(300)]
    df = spark.createDataFrame(rows, f"doc_id {'string' if kind == 'outlier' else 'long'}, text string")
    dealt = fingerprints.in_order(df, 6)
    sizes = {r["part"]: (r["n"], r["copies"]) for r in dealt.groupBy("part").agg(F.count("*").alias("n"), F.count_if("edge").alias("copies")).collect()}
    assert len(sizes) >= 4 and max(n for n, _ in sizes.values()) < 900 and all(c == 1 for _, c in sizes.values())
    got = fingerprints.compared_with_next(df).select("doc_id", "edited_sha256").toPandas()
    assert len(got) == len(rows)
    if kind == "outlier":
        texts = dict(rows)
        order = sorted(texts)
        wanted = {}
        for k, i in enumerate(order):
            t, u = texts[i], texts[order[(k + 1) % len(order)]]
            half = len(t) // 2
            wanted[i] = hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()
        assert dict(zip(got["doc_id"], got["edited_sha256"], strict=True)) == wanted


def test_training_rows_are_bounded_by_ids(spark, monkeypatch):
    """1,000 copies of a labelled id are one row of the fitting task, whatever their texts."""
    monkeypatch.setattr(toxicity, "MAX_TRAIN", 5)
    docs = spark.createDataFrame([(k % 10, f"text number {k}") for k in range(10_000)], "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, toxic int")
    chosen = toxicity.sample(labels, 5)
    assert chosen.count() == 5
    rows = toxicity.training_rows(docs, chosen)
    assert rows.count() == 5 and rows.select("digest").distinct().count() == 5
    assert toxicity.train(docs, labels).toPandas().equals(toxicity.train(docs.repartition(3), labels).toPandas())


def test_names_that_meet_are_told_apart(spark, monkeypatch):
    """With hashes of two values, rows that meet in a name keep a name of their own."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    calls = []

    def few(*columns):
        calls.append(columns)
        return F.hash(*columns).cast("long") % (2 if len(calls) == 1 else 10**9)

    docs = frame(spark, [(1, "a b c", "s"), (2, "d e f", "s"), (3, "g h i", "s")])
    own = type("functions", (), {"__getattr__": lambda self, n: few if n == "xxhash64" else getattr(F, n)})()
    monkeypatch.setattr(corpus_pipeline, "F", own)
    assert docs.select(corpus_pipeline._names(docs).alias("n")).distinct().count() == 3
