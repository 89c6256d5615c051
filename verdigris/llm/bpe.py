"""Byte-level BPE encoding and decoding in two tiers.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash:
one slot a token, no empty slot, checked against the slot's own hash and length.  A
miss is merged by a heap of pair ranks over a linked list of its bytes.

Each chunk of texts resolves every different pre-token once, and what a Python worker
has merged it remembers up to a bound.

Edge cases: null and empty texts give no ids and decode to nothing; bytes that are not
UTF-8 are read as U+FFFD; special tokens' strings are ordinary text; very long texts
and pre-tokens are encoded whole in n log n steps; null and repeated doc_ids are carried
through row by row; an empty table gives no rows; other columns are carried through, but
those that have the name of a result are replaced.
"""

from __future__ import annotations

import hashlib
import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, table, without
from .pretokens import PreTokens
from .ragged import expand, mix, span_hashes

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Merged pre-tokens that a worker remembers; it forgets all when it has more.
REMEMBERED = 150_000
_TRIES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, by displacing buckets, largest first.

    Buckets of one key are not displaced but point to a slot that is left.
    """

    def __init__(self, keys: np.ndarray):
        n = self.size = len(keys)
        self.n_buckets = max(1, n // 3)
        self.shift = np.zeros(self.n_buckets, np.int64)
        bucket = (keys % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.n_buckets)
        first = np.cumsum(sizes) - sizes
        taken = np.zeros(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own = keys[order[first[b] : first[b] + sizes[b]]]
            base = 0
            while True:
                slots = self._displaced(own[None, :], np.arange(base, base + _TRIES)[:, None])
                ordered = np.sort(slots, axis=1)
                good = np.flatnonzero(~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
                if len(good):
                    self.shift[b] = base + good[0]
                    taken[slots[good[0]]] = True
                    break
                base += _TRIES
        alone = np.flatnonzero(sizes == 1)
        self.shift[alone] = -1 - np.flatnonzero(~taken)[: len(alone)]

    def _displaced(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(keys + shift.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 9) % np.uint64(self.size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        shift = self.shift[(keys % np.uint64(self.n_buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._displaced(keys, np.maximum(shift, 0)))


class Vocabulary:
    """Ranks of a byte-level vocabulary and its perfect hash; its size is fixed, so it may be broadcast."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = list(ranks)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        length = np.array([len(t) for t in tokens])
        end = np.cumsum(length)
        keys = span_hashes(data, end - length, end, 11)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two tokens share a hash")
        self.hash = PerfectHash(keys)
        slot = self.hash.slots(keys)
        self.slot_key, self.slot_length, self.slot_id = (np.empty(len(keys), t) for t in (np.uint64, np.int64, np.int64))
        self.slot_key[slot], self.slot_length[slot], self.slot_id[slot] = keys, length, np.array(list(ranks.values()))
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.remembered: dict[int, array] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"remembered": {}}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: the lowest-ranked pair, leftmost first, is merged until none is left."""
        rank, n = self.ranks.get, len(piece)
        following = list(range(1, n + 1))
        previous = list(range(-1, n))
        best = [rank(piece[i : i + 2]) for i in range(n - 1)] + [None]
        heap = [(r, i) for i, r in enumerate(best) if r is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            if best[i] != r:
                continue
            gone = following[i]
            after = following[i] = following[gone]
            previous[after] = i
            best[gone] = None
            best[i] = r = rank(piece[i : following[after]]) if after < n else None
            if r is not None:
                heappush(heap, (r, i))
            i = previous[i]
            if i >= 0:
                best[i] = r = rank(piece[i:after])
                if r is not None:
                    heappush(heap, (r, i))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : following[i]]])
            i = following[i]
        return out

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and their bounds by text."""
        pre = PreTokens(texts)
        keys, where, kind = np.unique(pre.hashes(), return_index=True, return_inverse=True)
        start, end = pre.start[where], pre.end[where]
        slot = self.hash.slots(keys)
        known = (self.slot_key[slot] == keys) & (self.slot_length[slot] == end - start)
        missed = np.flatnonzero(~known)
        if len(self.remembered) > REMEMBERED:
            self.remembered.clear()
        memory, data = self.remembered, pre.data.tobytes()
        found = []
        for key, a, b in zip(keys[missed].tolist(), start[missed].tolist(), end[missed].tolist(), strict=True):
            ids = memory.get(key)
            if ids is None:
                ids = memory[key] = array("i", self.merged(data[a:b]))
            found.append(ids)
        length = np.ones(len(keys), np.int64)
        length[missed] = [len(x) for x in found]
        first = np.cumsum(length) - length
        flat = np.empty(int(length.sum()), np.int32)
        flat[first[known]] = self.slot_id[slot[known]]
        flat[expand(first[missed], length[missed])] = np.fromiter(chain.from_iterable(found), np.int32)
        taken = length[kind]
        bounds = np.concatenate(([0], np.cumsum(taken)))[pre.bounds]
        return flat[expand(first[kind], taken)], bounds

    def decode(self, flat: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
        """The bytes of one text after another, so that a caller need not hold them all."""
        tokens, a = self.tokens, 0
        for b in ends.tolist():
            yield b"".join([tokens[i] for i in flat[a:b].tolist()])
            a = b


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read by the driver and broadcast: its size does not depend on the texts."""
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(path)))


def _fields(df: DataFrame, *leave: str) -> tuple[list[str], str]:
    names = without(df, *leave)
    kept = [f for f in df.schema if f.name in names]
    return [f.name for f in kept], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)


def _gives(decoded: bytes, text: bytes | None) -> bool:
    """Whether decoded ids are the text, with U+FFFD for bytes that are not UTF-8."""
    text = text or b""
    return decoded == text or decoded == text.decode("utf-8", "replace").encode()


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decodes: str | None = None) -> DataFrame:
    """Replaces the text column by `ids` array<int>; columns that already have the name of a result are replaced.

    With a name for `decodes`, the ids of each text are decoded in the same step, one text
    after another, and that column tells whether they give the text back.
    """
    words = vocabulary(docs.sparkSession, path)
    more = [decodes] if decodes else []
    names, fields = _fields(docs, text, ids, *more)

    def make():
        vocab = words.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_bytes(batch.column(0))
            flat, bounds = vocab.encode(texts)
            out = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat, pa.int32()))]
            if decodes:
                same = [_gives(x, t) for x, t in zip(vocab.decode(flat, bounds[1:]), texts, strict=True)]
                out.append(pa.array(same, pa.bool_()))
            return pa.RecordBatch.from_arrays([*batch.columns[1:], *out], [*names, ids, *more])

        return each

    return arrow_map(docs.select(text, *names), ", ".join([fields, f"`{ids}` array<int>", *(f"`{c}` boolean" for c in more)]), make)


def decode(rows: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Replaces the ids column by the bytes that they stand for; a column that already has the name of the result is replaced."""
    words = vocabulary(rows.sparkSession, path)
    names, fields = _fields(rows, ids, decoded)

    def make():
        vocab = words.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(0)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            out = list(vocab.decode(lists.flatten().to_numpy(zero_copy_only=False), ends))
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.binary())], [*names, decoded])

        return each

    return arrow_map(rows.select(ids, *names), f"{fields}, `{decoded}` binary", make)


def digests(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_tokens, ids_sha256 and decoded_sha256 of each text: its ids are decoded where they are made, one text after another."""
    words = vocabulary(docs.sparkSession, path)
    more = ["n_tokens", "ids_sha256", "decoded_sha256"]
    names, fields = _fields(docs.select(*keep), *more)

    def make():
        vocab = words.value
        numbers = [b"%d" % k for k in range(len(vocab.tokens))]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, bounds = vocab.encode(as_bytes(batch.column(0)))
            written = (hashlib.sha256(b" ".join([numbers[i] for i in flat[a:b].tolist()])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            decoded = (hashlib.sha256(x) for x in vocab.decode(flat, bounds[1:]))
            own = [pa.array(np.diff(bounds).astype(np.int64)), *(pa.array([d.hexdigest() for d in x], pa.string()) for x in (written, decoded))]
            return pa.RecordBatch.from_arrays([*batch.columns[1:], *own], [*names, *more])

        return each

    return arrow_map(docs.select(text, *names), f"{fields}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)


def op3_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), path or public_tokenizers.path(VOCABULARY))
