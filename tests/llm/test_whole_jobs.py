"""Jobs that an operator or the pipeline must do whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import bpe, neardup
from verdigris.llm.ragged import U64, mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_last_stage_decodes(spark, monkeypatch):
    """The stage decodes the ids of every text and tells where they do not give it back."""
    import corpus_pipeline

    texts = [None, "", "one  two\n", "wörter 文字", "word " * 3000 + "z" * 9000, "one  two\n"]
    docs = frame(spark, [(k, t, "s") for k, t in enumerate(texts)])
    docs = docs.unionByName(docs.where("doc_id = 0").withColumn("text", F.expr("cast(unhex('61FF62') as string)")))
    rows = corpus_pipeline.tokenized(spark, docs, "").collect()
    assert len(rows) == 7 and all(r["decodes"] and len(r["ids"]) == r["n_tokens"] for r in rows)
    wrong = bpe.Vocabulary(bpe.read_ranks(bpe.public_tokenizers.path(bpe.VOCABULARY)))
    wrong.tokens = [b"?"] * len(wrong.tokens)
    monkeypatch.setattr(bpe, "vocabulary", lambda spark, path: spark.sparkContext.broadcast(wrong))
    rows = corpus_pipeline.tokenized(spark, docs, "").collect()
    assert all(r["decodes"] == (r["n_tokens"] == 0) for r in rows) and any(r["n_tokens"] for r in rows)


def test_trees_meet_their_recall_on_the_last_level():
    """A pair at 0.75 whose nodes all branch down to the last level, by an own count of its chances."""
    q = 0.75
    for _ in range(neardup.MAX_DEPTH - 1):
        q = 0.75 * (1 / 2 * q + 1 / 2 * (1 - (1 - q) ** 2))
    assert 1 - (1 - q) ** neardup.TREES >= 0.99


def test_pairs_stay_together_in_nodes_that_all_branch():
    """1500 pairs whose tokens agree at 0.75, sent down 14 levels of all trees by the code itself."""
    rng = np.random.default_rng(5)
    left = rng.integers(0, 1 << 16, (1500, neardup.COORDINATES)).astype("<u2")
    right = np.where(rng.random(left.shape) < 0.75, left, left + 1).astype("<u2")
    met = np.zeros(1500, bool)
    for tree in range(neardup.TREES):
        pair = np.flatnonzero(rng.random(1500) < 0.75)
        node = mix(pair.astype(U64), 7 + tree).view(np.int64)
        for _ in range(14):
            (i, a), (j, b) = neardup.branched(left[pair], node), neardup.branched(right[pair], node)
            both = (i == j) & (a == b)
            pair, node = pair[i[both]], a[both]
        met[pair] = True
    print(f"recall {met.mean():.4f}")
    assert met.mean() >= 0.98


def test_exact_decision_in_leaves_equals_brute_force(spark, monkeypatch):
    """A leaf of many members in several cells: every link of its outsiders is found, and fewer links come out than members."""
    monkeypatch.setattr(neardup, "CELL", 16)
    rng = np.random.default_rng(6)
    base = [f"b{j}" for j in range(60)]
    rows = []
    for k in range(60):
        words = list(base)
        for place in rng.choice(60, rng.integers(0, 5), replace=False):
            words[place] = f"r{rng.integers(1 << 30)}"
        rows.append((k, " ".join(words), "s"))
    docs = frame(spark, rows)
    leaf = spark.createDataFrame([(k, 9, 56, k if k < 30 else 100, 100, 60, 60 * 56, 30) for k in range(60)], "rep long, node long, n_shingles long, comp long, major long, members long, shingles long, others long")
    own = neardup.sketched(docs).select(F.col("doc_id").alias("rep"), "tokens")
    asks = neardup.asked(leaf.join(own, "rep"))
    got = [tuple(r) for r in neardup.decided(asks, docs).collect()]
    flat, bounds = neardup.sets([t.encode() for _, t, _ in rows])
    sets = [set(flat[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    links = {(b, a) for b in range(60) for a in range(b) if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert set(got) <= links and len(got) < 60 * 4

    def united(edges):
        root = list(range(30)) + [100] * 30 + list(range(60, 101))
        for u, v in edges:
            a, b = root[u], root[v]
            root = [min(a, b) if x in (a, b) else x for x in root]
        return root[:60]

    assert united(got) == united(links)


@pytest.mark.parametrize("alike", [1.1, neardup.ALIKE])
def test_pairs_of_a_large_family_are_kept(spark, monkeypatch, alike):
    """A family 0.65 alike with pairs at 0.766, larger than SMALL: its nodes branch, or else end and are compared once; the recall is measured."""
    levels, whole = [], neardup.children
    monkeypatch.setattr(neardup, "SMALL", 30)
    monkeypatch.setattr(neardup, "ALIKE", alike)
    monkeypatch.setattr(neardup, "children", lambda rows: levels.append(rows.count()) or whole(rows))
    common, rows = [f"c{j}" for j in range(300)], []
    for k in range(100):
        own = [f"{k}o{j}" for j in range(81)]
        rows += [(2 * k, " ".join(common + own), "s"), (2 * k + 1, " ".join(common + own[:31] + [f"{k}n{j}" for j in range(50)]), "s")]
    found = neardup.near_duplicates(frame(spark, rows)).select("doc_id", "component_id").collect()
    flat, bounds = neardup.sets([t.encode() for _, t, _ in rows])
    own = [set(flat[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    links = {(a, b) for b in range(len(own)) for a in range(b) if 4 * len(own[a] & own[b]) >= 3 * len(own[a] | own[b])}
    assert links == {(2 * k, 2 * k + 1) for k in range(100)}
    got = {r["doc_id"]: r["component_id"] for r in found}
    met = sum(got[b] == a for a, b in links)
    print(f"branched rows by level {levels}, recall {met / len(links)}")
    assert met >= 99 and all(got[a] == a for a, _ in links)
    assert min(levels, default=0) > 30 if alike > 1 else sum(levels) == 0


@pytest.mark.parametrize("n", [400, 800])
def test_unlinked_families_cost_one_comparison(spark, monkeypatch, n):
    """Documents 0.70 alike, none of them linked: rows of trees a member do not grow, and no more pairs are compared than the family has."""
    common = [f"c{j}" for j in range(296)]
    rows = [(k, " ".join(common + [f"{k}o{j}" for j in range(62)]), "s") for k in range(n)]
    rows += [(n + k, " ".join(f"o{k}w{j}" for j in range(60)), "s") for k in range(50)]
    tables, pairs, whole, asked = {}, [], neardup.saved, neardup.asked

    def counted(df, label):
        out = whole(df, label)
        tables[label] = tables.get(label, 0) + out.count()
        return out

    def seen(leaves, possible=None):
        pairs.append(leaves.dropDuplicates(["node"]).agg(F.sum(F.col("others") * F.col("members"))).first()[0])
        return asked(leaves, possible)

    monkeypatch.setattr(neardup, "saved", counted)
    monkeypatch.setattr(neardup, "asked", seen)
    got = neardup.near_duplicates(frame(spark, rows))
    assert got.where("kept").count() == n + 50
    print(f"{n}: {tables}, pairs {pairs}")
    assert sum(tables.get(t, 0) for t in ("nodes", "mixed", "large", "children")) <= 4 * neardup.TREES * (n + 50)
    assert pairs[0] <= n * n
