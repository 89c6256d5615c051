"""Token counts by rank-synchronous merging.

The different pre-tokens of a chunk are held together as ragged numpy arrays of
symbols.  In each round every sequence merges its own lowest-ranked pair, wherever it
occurs, all sequences at once; sequences without a pair leave.  The symbols that are
left are counted and added up by document.

Edge cases: null and empty texts have 0 tokens and 0 bytes; a special token's string
inside a text is one token and parts the text on both sides, as the library does by
default; bytes that are not UTF-8 are read as U+FFFD; texts of any length are counted
whole; null and repeated doc_ids are carried through row by row; an empty table gives no
rows; other columns are not looked at, and kept columns that have the name of a result are
replaced.
"""

from __future__ import annotations

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, as_bytes, table, without
from .pretokens import PreTokens
from .ragged import expand, mix, sums_by

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Counted pre-tokens that a worker remembers; it forgets all when it has more.
REMEMBERED = 500_000
_NONE = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Merges:
    """Pair ranks of a byte-level BPE as an open-addressed table; its size is fixed, so it may be broadcast."""

    def __init__(self, spec: dict):
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE without a normalizer or prefix space is needed")
        vocab = model["vocab"]
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in byte_letters().items():
            self.byte_id[b] = vocab[letter]
        self.n = len(vocab) + len(spec["added_tokens"])
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bits = max(4, int(len(key) * 4 - 1).bit_length())
        size = 1 << self.bits
        self.keys, self.rank, self.made = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32), np.zeros(size, np.int64)
        left, at = np.arange(len(key)), self._home(key)
        while len(left):
            free = self.keys[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            who = left[free][first]
            self.keys[slot], self.rank[slot], self.made[slot] = key[who], who, made[who]
            rest = ~np.isin(left, who)
            left, at = left[rest], (at[rest] + 1) % size

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64), 3) >> np.uint64(64 - self.bits)).astype(np.int64)

    def slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, or an empty slot (of rank _NONE)."""
        key = left * self.n + right
        at = self._home(key)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            now = self.keys[at[open_]]
            open_ = open_[(now != key[open_]) & (now >= 0)]
        return at

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Symbols that are left of each span of bytes."""
        length = end - start
        out = np.zeros(len(length), np.int64)
        symbol = self.byte_id[data[expand(start, length)]]
        owner = np.arange(len(length))
        slot = self._pairs(symbol, np.cumsum(length))
        while len(owner):
            first = np.cumsum(length) - length
            lowest = np.minimum.reduceat(self.rank[slot], first)
            going = lowest < _NONE
            out[owner[~going]] = length[~going]
            keep = np.repeat(going, length)
            symbol, slot = symbol[keep], slot[keep]
            owner, length, lowest = owner[going], length[going], lowest[going]
            if not len(owner):
                break
            chosen = np.flatnonzero(self.rank[slot] == np.repeat(lowest, length))
            # Neighbouring places can only hold the same symbol's pair; every other one is merged, from the left.
            fresh = np.ones(len(chosen), bool)
            fresh[1:] = chosen[1:] != chosen[:-1] + 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
            symbol[chosen] = self.made[slot[chosen]]
            gone = np.zeros(len(symbol), bool)
            gone[chosen + 1] = True
            stay = ~gone
            place = np.cumsum(stay) - 1
            ends = np.cumsum(length)
            length = np.diff(np.concatenate(([0], place[ends - 1] + 1)))
            symbol, slot = symbol[stay], slot[stay]
            changed = place[chosen]
            changed = np.unique(np.concatenate((changed, changed[changed > 0] - 1)))
            last = np.zeros(len(symbol), bool)
            last[np.cumsum(length) - 1] = True
            inner = changed[~last[changed]]
            slot[inner] = self.slots(symbol[inner], symbol[inner + 1])
            slot[changed[last[changed]]] = self.empty
        return out

    @property
    def empty(self) -> int:
        return int(np.flatnonzero(self.keys < 0)[0])

    def _pairs(self, symbol: np.ndarray, ends: np.ndarray) -> np.ndarray:
        slot = np.full(len(symbol), self.empty)
        if len(symbol):
            slot[:-1] = self.slots(symbol[:-1], symbol[1:])
            slot[ends - 1] = self.empty
        return slot


class Counter:
    """Counts tokens of texts, and remembers the counts of pre-tokens by hash."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _of(self, pre: PreTokens) -> np.ndarray:
        keys, where, kind = np.unique(pre.hashes(), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.zeros(len(keys), np.int64)
        if known.any():
            out[known] = self.values[at[known]]
        new = where[~known]
        out[~known] = self.merges.counts(pre.data, pre.start[new], pre.end[new])
        if len(self.keys) > REMEMBERED:
            self.keys, self.values = keys, out
        elif len(new):
            both = np.concatenate((self.keys, keys[~known]))
            order = np.argsort(both, kind="stable")
            self.keys, self.values = both[order], np.concatenate((self.values, out[~known]))[order]
        return out[kind]

    def count(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        parts, owners, special = [], [], np.zeros(len(texts), np.int64)
        for k, x in enumerate(texts):
            pieces = [x or b""]
            for s in self.merges.special:
                pieces = [p for piece in pieces for p in piece.split(s)]
            special[k] = len(pieces) - 1
            parts += pieces
            owners += [k] * len(pieces)
        pre = PreTokens(parts)
        tokens = np.bincount(owners, sums_by(pre.bounds, self._of(pre)), len(texts)).astype(np.int64) + special
        n_bytes = [len(x) if x is not None else 0 for x in texts]
        return np.array(n_bytes, np.int64), tokens


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_bytes, n_tokens, over_limit of each row's text."""
    keep = tuple(without(docs.select(*keep), "n_bytes", "n_tokens", "over_limit"))
    with open(path, encoding="utf-8") as f:
        merges = docs.sparkSession.sparkContext.broadcast(Merges(json.load(f)))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]

    def make():
        counter = Counter(merges.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_bytes, n_tokens = counter.count(as_bytes(batch.column(0)))
            return pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                [*keep, "n_bytes", "n_tokens", "over_limit"],
            )

        return each

    schema = ", ".join([*fields, "n_bytes bigint", "n_tokens bigint", "over_limit boolean"])
    return arrow_map(docs.select(text, *keep), schema, make)


def op8_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), path or public_tokenizers.path(TOKENIZER))
