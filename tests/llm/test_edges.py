"""Nulls, empty texts, repeats, empty tables and clashing columns, with the result that each operator states."""

import hashlib
import json

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verdigris.llm import bpe, chat, fingerprints, lines, mixing, ppm, quality, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{k}" for k in range(60))
OTHER = " ".join(f"another{k}" for k in range(60))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = "word " * 30_000 + "z" * 50_000
    rows = [(1, None, "a"), (2, "", None), (3, long, "b"), (4, "one two", "a"), (4, "one two", "a"), (5, " \n\t", "b"), (None, "one two", "c"), (6, "A <|endoftext|> ½ 日本", "c")]
    return frame(spark, rows)


def clashing(docs, *names):
    return docs.withColumns({n: F.lit("own") for n in names})


def test_bpe_query_equals_the_library(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    ranks = bpe.read_ranks(P.path(bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(tuple(r) for r in bpe.op3_bpe(spark, str(tmp_path)).select(F.coalesce("doc_id", F.lit(0)), "n_tokens", "ids_sha256", "decoded_sha256").collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = []
    for r in odd.collect():
        ids = library.encode_ordinary(r["text"] or "")
        wanted.append((r["doc_id"] or 0, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode())))
    assert got == sorted(wanted)


def test_token_count_query_equals_the_library(spark, odd, tmp_path):
    clashing(odd, "n_tokens", "over_limit").write.parquet(str(tmp_path / "documents.parquet"))
    library = Tokenizer.from_file(P.path(token_counts.TOKENIZER))
    got = sorted(tuple(r) for r in token_counts.op8_token_counts(spark, str(tmp_path)).select(F.coalesce("doc_id", F.lit(0)), "n_bytes", "n_tokens", "over_limit").collect())
    wanted = []
    for r in odd.collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        wanted.append((r["doc_id"] or 0, len((r["text"] or "").encode()), n, n > 1024))
    assert got == sorted(wanted)
    assert token_counts.token_counts(odd.limit(0), P.path(token_counts.TOKENIZER)).count() == 0
    kept = token_counts.token_counts(clashing(odd, "n_bytes"), P.path(token_counts.TOKENIZER), keep=("doc_id", "n_bytes"))
    assert kept.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and kept.schema["n_bytes"].dataType.simpleString() == "bigint"


def test_encoding_replaces_clashing_columns(spark, odd):
    path = P.path(bpe.VOCABULARY)
    ids = bpe.encode(clashing(odd, "ids", "decodes", "decoded"), path, decodes="decodes")
    assert ids.schema["ids"].dataType.simpleString() == "array<int>" and all(r["decodes"] and r["lang"] == "en" for r in ids.collect())
    assert {r["decoded"].decode() for r in bpe.decode(ids, path).collect()} == {r["text"] or "" for r in odd.collect()}


def test_ledger_keeps_and_replaces_columns(spark, odd):
    docs = clashing(odd, "n_words", "failed_bits", "measured_text")
    rows = quality.ledger(docs, keep=("doc_id", "n_words", "measured_text")).collect()
    assert sorted(r["n_words"] for r in rows) == [0, 0, 0, 2, 2, 2, 4, 30_001] and all(r["measured_text"] == "own" for r in rows)
    assert quality.ledger(odd.limit(0)).count() == 0


def test_policies_pin_their_rules(monkeypatch):
    assert quality.mask("prose-1") == 127 and quality.mask("base-1") == 3
    monkeypatch.setattr(quality, "RULES", (("few_words", "n_words < 40"), *quality.RULES[1:]))
    with pytest.raises(ValueError):
        quality.mask("base-1")


def test_lines_of_odd_rows(spark, odd):
    shared = [(20 + k, f"shared line of words\nown line number {k}", f"s{k}") for k in range(6)]
    docs = odd.unionByName(frame(spark, shared + [(None, "shared line of words", None), (25, "shared line of words\nown line number 5", "s5")]))
    got = lines.without_spread_lines(clashing(docs, "n_lines", "n_removed", "gone", "k1", "first", "salt"))
    assert got.columns.count("n_lines") == 1 and got.schema["n_removed"].dataType.simpleString() == "bigint"
    rows = got.collect()
    assert len(rows) == 16 and all(r["gone"] == "own" for r in rows)
    texts = sorted(r["text"] for r in rows if r["text"] and "shared" in r["text"])
    assert texts == ["shared line of words"]  # the row without a doc_id is the first
    assert sum(r["n_removed"] for r in rows) == 7
    assert {r["text"] for r in rows if r["doc_id"] in (1, 2)} == {None, ""}


def test_hot_lines_by_salted_joins(spark, monkeypatch):
    rows = [(k, f"the hot line of all\nown line number {k}" + ("\nnear the threshold here" if k < 7 else ""), f"s{k % (3 + k // 40)}") for k in range(200)]
    whole = sorted((r["doc_id"], r["text"]) for r in lines.without_spread_lines(frame(spark, rows)).collect())
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    assert sorted((r["doc_id"], r["text"]) for r in lines.without_spread_lines(frame(spark, rows)).collect()) == whole
    assert [i for i, t in whole if "hot" in t] == [0]


def test_mix_of_clashing_columns_and_one_id_in_two_sources(spark):
    rows = [(k, "w " * 20, "big") for k in range(400)] + [(k, "v " * 20, "small") for k in range(4)] + [(7, None, None)]
    docs = clashing(frame(spark, rows), "size", "target", "times", "taken_id", "digest")
    times = {(r["source"], r["doc_id"]): r["times"] for r in mixing.mix(frame(spark, rows)).collect()}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    seen = {}
    for r in got.collect():
        seen[(r["source"], r["doc_id"])] = seen.get((r["source"], r["doc_id"]), 0) + 1
    assert seen == {k: n for k, n in times.items() if n}
    assert max(n for (s, _), n in seen.items() if s == "big") < 3 == max(n for (s, _), n in seen.items() if s == "small")


def test_fingerprints_of_other_ids(spark):
    texts = ["some words here", "and more of them", "", "the end of it all", "x"]
    plain = [(k, t) for k, t in enumerate(texts)]
    wanted = {r["doc_id"]: tuple(r)[1:] for r in fingerprints.compared_with_next(spark.createDataFrame(plain, "doc_id long, text string")).collect()}
    named = spark.createDataFrame([(f"doc-é{k:03}", t, "own") for k, t in plain], "doc_id string, text string, part string")
    got = {r["doc_id"]: tuple(r)[1:] for r in fingerprints.compared_with_next(named).collect()}
    assert got == {f"doc-é{k:03}": v for k, v in wanted.items()}
    large = spark.createDataFrame([(2**60 + k, t) for k, t in plain], "doc_id long, text string")
    assert {r["doc_id"] - 2**60: tuple(r)[1:] for r in fingerprints.compared_with_next(large).collect()} == wanted
    small = spark.createDataFrame(plain, "doc_id short, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in fingerprints.compared_with_next(small).collect()} == wanted


def plain_likeness(a, b):
    x, y = (set(s[k : k + 8] for k in range(0, len(s), 8)) for s in (a, b))
    if not x or not y:
        return float(len(x) == len(y))
    together = sorted(x | y)[: fingerprints.SKETCH]
    return sum(n in x and n in y for n in together) / len(together)


def test_likeness_is_the_jaccard_similarity_of_phrase_names(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(500)]
    rows = [(k, " ".join(rng.choice(words, 400))) for k in range(20)]
    rows = [r if k % 2 == 0 else (r[0], rows[k - 1][1][: 300 * (k % 7)] + r[1]) for k, r in enumerate(rows)]
    got = {r["doc_id"]: r for r in fingerprints.compared_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names = {}
    for k, t in rows:
        found = set()
        for level, (symbols, _) in enumerate(fingerprints.phrases([t.encode()])):
            if level in fingerprints.LEVELS:
                found |= {(level, int(s)) for s in symbols}
            if level == max(fingerprints.LEVELS):
                break
        names[k] = found
    for k in range(20):
        near = got[k]["near_next"]
        assert near == plain_likeness(got[k]["fingerprint"], got[(k + 1) % 20]["fingerprint"])
        assert got[k]["near_edited"] == plain_likeness(got[k]["fingerprint"], got[k]["edited_fingerprint"])
        a, b = names[k], names[(k + 1) % 20]
        assert abs(near - len(a & b) / len(a | b)) < 4 * 0.5 / fingerprints.SKETCH**0.5


def plain_ftrl(rows):
    """The published update rule, one coordinate after another."""
    z, n, w = {}, {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1.0 if z[k] > 0 else -1.0
        return (sign * toxicity.L1 - z[k]) / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for label, places in rows:
            own = [*places.tolist(), toxicity.BIAS]
            w = {k: weight(k) for k in own}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for k in own:
                rate = ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / toxicity.ALPHA
                z[k] = z.get(k, 0.0) + g - rate * w[k]
                n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z if weight(k)}


def test_fit_is_ftrl_proximal():
    rng = np.random.default_rng(8)
    rows = [(int(rng.random() < 0.4), np.unique(rng.integers(1, 60, 9))) for _ in range(80)]
    rows = [(y, np.append(p, 60 + y)) for y, p in rows]
    at, w = toxicity.fit(rows)
    wanted = plain_ftrl(rows)
    assert set(at.tolist()) == set(wanted) and all(abs(wanted[k] - v) < 1e-9 for k, v in zip(at.tolist(), w.tolist(), strict=True))


@pytest.mark.parametrize("kind", ["bigint", "boolean", "double", "int"])
def test_toxicity_query_on_labels_of_any_type(spark, tmp_path, kind):
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(200)]
    toxic = [k % 3 == 0 for k in range(300)]
    rows = [(k, " ".join(rng.choice(words, 40)) + (" vile scum" if y else ""), "s") for k, y in enumerate(toxic)] + [(400, None, "s"), (401, "", "s"), (401, "", "s")]
    out = tmp_path / kind
    clashing(frame(spark, rows), "score", "toxic", "label").write.parquet(str(out / "documents.parquet"))
    labels = spark.createDataFrame([(k, 1, int(y)) for k, y in enumerate(toxic)], "doc_id long, quality int, toxic int").withColumn("toxic", F.col("toxic").cast(kind))
    labels.write.parquet(str(out / "labels.parquet"))
    got = {r["doc_id"]: r for r in toxicity.op7_toxicity(spark, str(out)).collect()}
    assert len(got) == 302 and got[400]["score"] == got[401]["score"]
    held = [k for k in range(300) if got[k]["held_out"]]
    assert held and np.mean([got[k]["predicted"] == int(toxic[k]) for k in held]) > 0.95
    # What a held-out row is labelled must not reach any score.
    turned = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, (1 - F.col("toxic").cast("int")).cast(kind)).otherwise(F.col("toxic")))
    turned.write.parquet(str(out / "turned" / "labels.parquet"))
    frame(spark, rows).write.parquet(str(out / "turned" / "documents.parquet"))
    again = {r["doc_id"]: r["score"] for r in toxicity.op7_toxicity(spark, str(out / "turned")).collect()}
    assert again == {k: r["score"] for k, r in got.items()}


def test_conversations_with_more_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", 5), (1, 1, "assistant", None, 6)], "conv_id long, turn long, role string, text string, n_turns long")
    got = chat.digests(chat.formatted(rows)).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in got] == [(1, 2, 0)]


def test_stages_on_odd_rows(spark, odd):
    import corpus_pipeline as c

    names = ("n_words", "failed_bits", "measured_text", "n_removed", "n_lines", "row", "component_id", "near_id", "taken_id", "size", "ids", "decodes", "document")
    good = [(k, f"{PROSE} {k}", "a") for k in range(3)] + [(None, OTHER, "b"), (None, OTHER, "b"), (None, OTHER + " end", None), (9, f"{PROSE} {OTHER}", "c"), (9, f"{PROSE} {OTHER}", "c"), (9, "own " + " ".join(f"x{k}" for k in range(80)), "c")]
    docs = clashing(odd.unionByName(frame(spark, good)), *names)
    kept = c.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 9 and all(r["n_words"] == "own" for r in kept.collect())
    cut = c.line_dedup(spark, docs, "")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    first = c.near_duplicates(spark, docs, "")
    assert first.columns == docs.columns
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, (r["text"] or "")[:9]) for r in first.collect())
    assert got == sorted([(1, ""), (2, ""), (3, "word word"), (4, "one two"), (5, " \n\t"), (6, "A <|endof"), (0, "word0 wor"), (-1, "another0 "), (9, "word0 wor"), (9, "own x0 x1")])
    mixed = c.source_mix(spark, docs, "")
    assert mixed.columns == docs.columns
    out = c.tokenized(spark, docs, "")
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "decodes"] and out.count() == docs.count() and out.where("NOT decodes").count() == 0
    for _, stage in c.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_stages_equal_brute_force(spark):
    """Line dedup and the mix of a small corpus, by plain Python."""
    import corpus_pipeline as c

    rng = np.random.default_rng(2)
    rows = []
    for k in range(120):
        own = [" ".join(rng.choice([f"q{j}" for j in range(400)], 12)) for _ in range(4)]
        if k % 3 == 0:
            own.insert(int(rng.integers(5)), "read more on our site")
        if k % 10 == 0:
            own.append("seen on few sites")
        rows.append((k, "\n".join(own), f"s{k % 7}" if k % 10 else f"s{k % 2}"))
    docs = frame(spark, rows)
    sites, first = {}, {}
    for i, t, s in rows:
        for place, line in enumerate(t.split("\n")):
            sites.setdefault(line, set()).add(s)
            first.setdefault(line, (i, place))
    wanted = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if len(sites[x]) < lines.MIN_SITES or first[x] == (i, p)) for i, t, _ in rows}
    cut = c.line_dedup(spark, docs, "")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    assert got == {i: (t, len(t)) for i, t in wanted.items()} and any(t != dict((a, b) for a, b, _ in rows)[i] for i, t in wanted.items())

    size = {i: len(t.split()) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows})
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    target, free = {}, set(names)
    while True:
        left = sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * total[s] for s in over}
        free -= over
    copies = {}
    for s in names:
        whole, reach = int(target[s] // total[s]), 0
        rest = target[s] - whole * total[s]
        order = sorted((hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest(), i) for i, _, x in rows if x == s)
        for _, i in order:
            reach += size[i]
            copies[i] = whole + int(rest > 0 and reach - size[i] / 2 <= rest)
    counted = {}
    for r in c.source_mix(spark, docs, "").collect():
        counted[r["doc_id"]] = counted.get(r["doc_id"], 0) + 1
    assert counted == {i: n for i, n in copies.items() if n}


def plain_ppm(train, text, order):
    """log10 probability of a text by the definition: method D, exclusion, contexts inside a text only."""

    def stream(t):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\0", "\x0b")
        return b"\n" + b"".join(w.encode() + b" " for w in words.split(" ") if w) + b"\n"

    seen = {}
    for t in train:
        s = stream(t)
        for k in range(1, len(s)):
            for n in range(min(order, k) + 1):
                own = seen.setdefault(s[k - n : k], {})
                own[s[k]] = own.get(s[k], 0) + 1
    total, s = 0.0, stream(text)
    for k in range(1, len(s)):
        gone, p = set(), 1.0
        for n in range(min(order, k), -1, -1):
            own = {b: c for b, c in seen.get(s[k - n : k], {}).items() if b not in gone}
            if not own:
                gone |= set(seen.get(s[k - n : k], {}))
                continue
            whole = sum(own.values())
            if s[k] in own:
                p *= (own[s[k]] - 0.5) / whole
                break
            p *= len(own) / (2 * whole)
            gone |= set(own)
        else:
            p /= 256 - len(gone)
        total += np.log10(p)
    return total


@pytest.mark.parametrize("shard", [None, 40])
def test_ppm_scores_equal_the_definition(spark, monkeypatch, shard):
    if shard:
        monkeypatch.setattr(ppm, "SHARD", shard)
        monkeypatch.setattr(ppm, "BLOCK", 900)
    rng = np.random.default_rng(4)
    words = ["the", "then", "they", "cat", "cats", "sat", "mat", "Man", "ana", "banana"]
    rows = [(k, " ".join(rng.choice(words, 25)) if k % 9 else "".join(rng.choice(list("abn "), 60)), "s") for k in range(40)]
    rows += [(50, "", "s"), (51, None, "s"), (52, "zebra ünd ba\0nana THE", "s"), (53, "b", "s")]
    train = [t for i, t, _ in rows if i < 30]
    got = {r["doc_id"]: r["score"] for r in ppm.scores(frame(spark, rows), F.col("doc_id") < 30).collect()}
    for i, t, _ in rows:
        assert abs(got[i] - plain_ppm(train, t, ppm.ORDER)) < 1e-4 * max(1, abs(got[i])), (i, t)


def test_json_vocabulary_is_read_from_its_path():
    with open(P.path(token_counts.TOKENIZER), encoding="utf-8") as f:
        assert "model" in json.load(f)
