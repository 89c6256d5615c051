import hashlib
import json
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verdigris.llm import bpe, chat, fingerprints, neardup, ppm, quality, token_counts, toxicity
from verdigris.llm.ragged import U64, Words, span_hashes
from verdigris.llm.templates import Template, TemplateError

PIECES = st.sampled_from(
    ["a", "b", "'", "'s", "'ll", " ", "  ", "\n", "\t", " ", "　", "é", "ß", "1", "½", "!", "--", "日本", "𝒳", "́", "\x1c", "\x85", "I'VE", "<|endoftext|>", " the", "aaaa", "\x00"]
)
TEXTS = st.lists(st.lists(PIECES, max_size=30).map("".join), min_size=1, max_size=8)


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(bpe.read_ranks(P.path(bpe.VOCABULARY)))


@pytest.fixture(scope="module")
def counter():
    with open(P.path(token_counts.TOKENIZER), encoding="utf-8") as f:
        return token_counts.Counter(token_counts.Merges(json.load(f)))


@settings(max_examples=150, deadline=None)
@given(texts=TEXTS)
def test_words_and_hashes(texts):
    w = Words([t.encode() for t in texts], lower=True)
    wanted = [[x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", t)] for t in texts]
    wanted = [[re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in own] for own in wanted]
    got = [bytes(w.stream[a:b]) for a, b in zip(w.start, w.end, strict=True)]
    assert got == [x for own in wanted for x in own]
    assert w.counts.tolist() == [len(own) for own in wanted]
    by_hash = {}
    for h, x in zip(w.hashes().tolist(), got, strict=True):
        assert by_hash.setdefault(h, x) == x


def test_span_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"xabcyabc", np.uint8)
    h = span_hashes(data, np.array([1, 5, 0]), np.array([4, 8, 3]))
    assert h[0] == h[1] != h[2]


@settings(max_examples=150, deadline=None)
@given(texts=TEXTS)
def test_encoding_equals_the_library(vocab, texts):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    ids, bounds = vocab.encode([t.encode() for t in texts])
    for k, t in enumerate(texts):
        own = ids[bounds[k] : bounds[k + 1]].tolist()
        assert own == library.encode_ordinary(t)
        assert b"".join(vocab.tokens[i] for i in own) == t.encode()


def test_encoding_of_long_and_empty_texts(vocab):
    long = "ab" * 20_000
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    ids, bounds = vocab.encode([None, b"", long.encode()])
    assert bounds.tolist()[:3] == [0, 0, 0] and ids.tolist() == library.encode_ordinary(long)


def test_perfect_hash_has_no_empty_slot(vocab):
    assert sorted(vocab.hash.slots(vocab.slot_key).tolist()) == list(range(len(vocab.ranks)))


@settings(max_examples=150, deadline=None)
@given(texts=TEXTS)
def test_counts_equal_the_library(counter, texts):
    library = Tokenizer.from_file(P.path(token_counts.TOKENIZER))
    n_bytes, n_tokens = counter.count([t.encode() for t in texts])
    assert n_tokens.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert n_bytes.tolist() == [len(t.encode()) for t in texts]


@settings(max_examples=100, deadline=None)
@given(texts=TEXTS)
def test_measures_equal_a_plain_count(texts):
    got = quality.measure([t.encode() for t in texts])
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wanted = (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert tuple(int(got[m][k]) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == wanted


def test_ppm_probabilities_sum_to_one():
    texts = [b"the cat sat on the mat", b"the dog sat", b"", None, b"a\x00b"]
    w = Words(texts, lower=True)
    g = ppm.grams(w.stream, w.stops)
    gram, n = ppm._summed(g, np.ones(len(g), np.int64))
    contexts = np.unique(gram >> U64(8))
    every = (contexts[:, None] << U64(8) | np.arange(256).astype(U64)).ravel()
    gram, n = ppm._summed(np.concatenate((gram, every)), np.concatenate((n, np.zeros(len(every), np.int64))))
    pair, count = ppm._summed(gram & U64(0xFFFF), n)
    bits = ppm.code_lengths(gram, n, ppm.Level(pair[count > 0], count[count > 0]))
    for c in contexts:
        assert abs((10 ** bits[gram >> U64(8) == c]).sum() - 1) < 1e-9


def test_grams_stay_inside_their_text():
    w = Words([b"ab", b"c"], lower=True)
    g = ppm.grams(w.stream, w.stops)
    shown = [int(x).to_bytes(8, "big").lstrip(b"\0") for x in g]
    assert shown == [b"\na", b"\nab", b"\nab ", b"\nab \n", b"\nc", b"\nc ", b"\nc \n"]


def test_lookup():
    keys = np.unique(np.random.default_rng(1).integers(1, 1 << 40, 5000).astype(U64))
    known = ppm.Lookup(keys, np.arange(len(keys)).astype(np.float32))
    assert (known.get(keys) == np.arange(len(keys))).all()
    assert known.get(np.array([1 << 50], U64))[0] == 0


@settings(max_examples=60, deadline=None)
@given(texts=TEXTS)
def test_labels_of_neighbours_differ(texts):
    data = [t.encode() for t in texts]
    for level, (symbols, bounds) in enumerate(fingerprints.phrases(data)):
        assert len(bounds) == len(data) + 1 and bounds[-1] == len(symbols)
        if level == 3:
            break


def test_equal_substrings_share_phrases():
    rng = np.random.default_rng(2)
    middle = bytes(rng.integers(97, 123, 4000).astype(np.uint8))
    texts = [b"x" * 7 + middle, bytes(rng.integers(97, 123, 333).astype(np.uint8)) + middle]
    names = []
    for level, (symbols, bounds) in enumerate(fingerprints.phrases(texts)):
        if level == 3:
            names = [set(symbols[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            break
    assert len(names[0] & names[1]) > 0.9 * len(names[0])


def test_likeness():
    a, b, empty = (fingerprints.sketches([t])[0] for t in (b"some text that is long enough to have phrases " * 3, b"wholly other words stand here, numbered 1 2 3", b""))
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(empty, empty) == 1 and fingerprints.likeness(a, empty) == 0
    assert fingerprints.likeness(a, b) < 0.2 and fingerprints.to_string(empty) == ""


def test_shingle_sets():
    flat, bounds = neardup.sets([b"A b c d e f", b"a b c d e f", b"a b", b"a  B", b"b a", b"", None, b" "])
    own = [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert own[0] == own[1] and len(own[0]) == 2 and own[2] == own[3] != own[4] and own[5] == own[6] == own[7] == []


def test_toxicity_learns_a_word():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words, 60)) + (" vile" if k % 4 == 0 else "") for k in range(400)]
    doc, place = toxicity.present(*toxicity.features([t.encode() for t in texts]))
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    rows = [(int(k % 4 == 0), place[bounds[k] : bounds[k + 1]]) for k in range(len(texts))]
    at, w = toxicity.fit(rows[:300])
    dense = np.zeros(1 << toxicity.BITS)
    dense[at] = w
    guess = [dense[p].sum() + dense[toxicity.BIAS] > 0 for _, p in rows[300:]]
    assert np.mean([g == bool(y) for g, (y, _) in zip(guess, rows[300:], strict=True)]) > 0.97
    assert len(at) < 2000


def test_template():
    t = Template("{% set g = 'hi' + ' ' %}{% for m in ms %}{% if m.role == 'a' and not loop.last %}[{% generation %}{{ m.text }}{% endgeneration %}]{% elif loop.last %}end{{ loop.index }}{% else %}{{ g ~ m['text'] }}{% endif %}{% endfor %}{{ 1 + 2 if true else x }}")
    text, spans = t.render(ms=[{"role": "u", "text": "x"}, {"role": "a", "text": "yes"}, {"role": "a", "text": "z"}])
    assert text == "hi x[yes]end33" and [text[a:b] for a, b in spans] == ["yes"]
    assert Template("{% if 1 == 2 %}a{% else %}b{{ 'c' }}{% endif %}d").tree[0].value == "bcd"
    for bad in ("{{ a. }}", "{% if x %}", "{{ x | nope }}", "{{ f() }}", "{% odd %}", "{{ 1 + 'a' }}"):
        with pytest.raises(TemplateError):
            Template(bad)
    assert Template("{{ x.__class__ }}").render(x="s")[0] == ""


CHAT = st.lists(st.sampled_from([*chat.CONTROL, "\\", "\\.", "<", "[", "|", "x", "\n", "/INST]", "é"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(turns=st.lists(st.tuples(st.sampled_from(["user", "assistant", "sy\nstem", "</s>"]), CHAT), max_size=5))
def test_chat_round_trip(turns):
    text, spans = chat.compiled().render(messages=[{"role": r, "text": t} for r, t in turns])
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    for c in chat.CONTROL[2:]:
        assert c not in text
    assert text.count("<|im_end|>") == len(turns)


def test_digests_are_of_whole_texts():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
