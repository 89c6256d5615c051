"""Code lengths by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ORDER.  A byte that its longest context has
not seen is reached by escapes: each passes on part of the probability (method D: half
a count for each different byte) to the context without its first byte, where bytes
that the longer context offered are excluded.  Below order 0 all bytes not seen at all
are alike.  Texts are coded as their lower-cased words, each followed by a space, and
one end; contexts reach over words back to the start of the text.

The trie is learned from all training texts and grows with them:

1. Each task counts its (context, byte) grams and words; the counts are added up.
2. Grams are dealt by their context's last two bytes.  All suffixes of a context from
   order 2 on are with it, so each group is coded by itself; orders 0 and 1 are one
   table of at most 2**16 counts.  A group above SHARD grams is parted by one more byte, and
   again while a part is above it; of a parted context the counts of its own order (256 at
   most) are sent along.  Every gram of any text gets its code length.
3. The most frequent grams and words, at most BLOCK and HEAD of them, are broadcast for the one
   pass that scores the texts.  A text's other grams and words leave that pass as one row each with
   their number, meet their code lengths in a join by key, and are added up by text.  None of them is a hot
   key: what is not in the head is rare.  So texts are read twice, once to count and once to
   score, and what the driver and a worker hold is bounded, however large the trie becomes.

Edge cases: a null or empty text is its end alone; NUL bytes count as the byte 0x0B, which
texts do not have inside words; rows of a null doc_id are scored and not learned from;
repeated rows are learned from and scored each; without training texts all 256 bytes
are alike; an empty table gives no rows; other columns are not looked at; texts of any
length are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import as_bytes, collected, pieces, saved, table
from .ragged import U64, Words, mix, sums_by

ORDER = 5
#: Grams in the tables that a task codes, about.
SHARD = 500_000
#: Frequent grams (12 bytes each) and words (16 bytes each) that are broadcast, at most.
BLOCK = 4_000_000
HEAD = 1 << 19
#: Rows of a batch that a text's rare grams and words leave in, at most.
ROWS = 1_000_000
#: Different grams and words that a task adds up before it passes them on.
HELD = 1_000_000
GRAM, WORD, TEXT = 0, 1, 2
_BYTE = U64(8)
_NUL = np.arange(256, dtype=np.uint8)
_NUL[0] = 0x0B


def grams(stream: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """For each place after the first of `stream`: its byte and, above it, up to ORDER bytes before it in the same text."""
    s = _NUL[stream].astype(U64)
    opening = np.concatenate(([0], stops[:-1])) if len(stops) else np.zeros(0, np.int64)
    out = s.copy()
    for k in range(1, ORDER + 1):
        before = s[:-k] << U64(8 * k)
        for back in range(1, k):
            place = opening + back
            before[place[(place >= k) & (place < len(s))] - k] = 0
        out[k:] |= before
    return out[1:]


def _context_length(g: np.ndarray) -> np.ndarray:
    return sum(((g >> U64(8 * k)) & U64(255) != 0).astype(np.int64) for k in range(1, ORDER + 1))


class Level:
    """Counts of one order: of (context, byte), and by context their sum and number."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.key, self.count = key[first], np.add.reduceat(count, first) if len(first) else count
        context = self.key >> _BYTE
        edge = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(key) else first
        self.context, self.edge = context[edge], edge
        self.total = np.add.reduceat(self.count, edge) if len(edge) else self.count
        self.different = np.diff(np.append(edge, len(context)))

    def counts(self, key: np.ndarray) -> np.ndarray:
        return _found(self.key, self.count, key)

    def excluded(self, shorter: Level, mask: U64) -> np.ndarray:
        """By context: what the shorter context counted of the bytes that this one offers."""
        own = shorter.counts(self.key & mask)
        return np.add.reduceat(own, self.edge) if len(self.edge) else own


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values at the wanted keys; 0 where they are not."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def code_lengths(gram: np.ndarray, count: np.ndarray, pairs: Level, parted: dict[int, Level] | None = None) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context.

    gram, count: all grams that share their contexts' last two bytes (or more, of a parted
    context), and how often training texts have them (0: not at all); pairs: the order-1
    level of all texts; parted: by order, the whole counts of the contexts whose grams are parted.
    """
    length = _context_length(gram)
    levels: dict[int, Level] = {1: pairs, 0: Level(pairs.key & U64(255), pairs.count)}
    learned = count > 0
    for k in range(2, ORDER + 1):
        own = learned & (length >= k)
        key, n = gram[own] & U64((1 << 8 * (k + 1)) - 1), count[own]
        if parted and k in parted:
            whole = ~np.isin(key >> _BYTE, parted[k].context)
            key, n = np.concatenate((key[whole], parted[k].key)), np.concatenate((n[whole], parted[k].count))
        levels[k] = Level(key, n)
    out = np.zeros(len(gram))
    waiting = np.ones(len(gram), bool)
    gone_count, gone_different = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
    for k in range(ORDER, -1, -1):
        level = levels[k]
        at = np.flatnonzero(waiting & (length >= k))
        key = gram[at] & U64((1 << 8 * (k + 1)) - 1)
        context = key >> _BYTE
        total = _found(level.context, level.total, context)
        known = total > 0
        at, key, context, total = at[known], key[known], context[known], total[known]
        different = _found(level.context, level.different, context)
        left, kinds = total - gone_count[at], different - gone_different[at]
        seen = level.counts(key)
        hit = seen > 0
        out[at[hit]] += np.log10((seen[hit] - 0.5) / left[hit])
        escape = ~hit & (left > 0)
        out[at[escape]] += np.log10(kinds[escape] / (2.0 * left[escape]))
        waiting[at[hit]] = False
        if k:
            gone = level.excluded(levels[k - 1], U64((1 << 8 * k) - 1))
            gone_count[at] = _found(level.context, gone, context)
            gone_different[at] = different
    out[waiting] -= math.log10(max(1, 256 - len(levels[0].key)))
    return out


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def _gram_counts(g: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for grams, which leave room for their mark in one sorted number."""
    both = np.sort(g << U64(1) | learn.astype(U64))
    key = both >> U64(1)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    marks = np.concatenate(([0], np.cumsum(both & U64(1)))).astype(np.int64)
    ends = np.append(first[1:], len(key)).astype(np.int64)
    return key[first], marks[ends] - marks[first], ends - first


def counted(docs: DataFrame) -> DataFrame:
    """kind (GRAM, WORD, TEXT), key, n (in training texts), n_all of everything that the texts have."""

    def batch_of(kind: int, key: np.ndarray, n: np.ndarray, n_all: np.ndarray) -> pa.RecordBatch:
        cols = [pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n), pa.array(n_all)]
        return pa.RecordBatch.from_arrays(cols, ["kind", "key", "n", "n_all"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {GRAM: [], WORD: []}
        sizes = {GRAM: 0, WORD: 0}
        texts = np.zeros(2, np.int64)

        def merged(kind: int):
            return _summed(*(np.concatenate(x) for x in zip(*held[kind], strict=True)))

        for batch in batches:
            for piece in pieces(batch):
                w = Words(as_bytes(piece.column(0)), lower=True)
                learn = piece.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                texts += (learn.sum(), len(learn))
                g = grams(w.stream, w.stops)
                of = np.repeat(learn, np.diff(np.concatenate(([0], w.stops))))
                word = w.hashes()
                words = _summed(word, np.repeat(learn, w.counts), np.ones(len(word), np.int64))
                for kind, now in ((GRAM, _gram_counts(g, of)), (WORD, words)):
                    held[kind].append(now)
                    sizes[kind] += len(held[kind][-1][0])
                    if sizes[kind] > HELD:
                        now = merged(kind)
                        held[kind], sizes[kind] = [now], len(now[0])
                        if len(now[0]) > HELD // 2:
                            yield batch_of(kind, *now)
                            held[kind], sizes[kind] = [], 0
        for kind in held:
            if held[kind]:
                yield batch_of(kind, *merged(kind))
        yield batch_of(TEXT, np.zeros(1, U64), texts[:1], texts[1:])

    found = docs.select("text", "learn").mapInArrow(run, "kind int, key bigint, n bigint, n_all bigint")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def _packed(sizes: dict[int, int], limit: int) -> dict[int, int]:
    """A block number for each group, in order, so that blocks stay within the limit (a larger group stands alone)."""
    out, block, used = {}, 0, 0
    for group, n in sorted(sizes.items()):
        if used and used + n > limit:
            block, used = block + 1, 0
        out[group] = block
        used += n
    return out


def _suffix(order: int):
    """The last `order` bytes of a gram's context."""
    return F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * order) - 1))


def coded(counts: DataFrame) -> DataFrame:
    """gram, n_all and log10 of its probability (bits), written."""
    spark = counts.sparkSession
    own = counts.where(F.col("kind") == GRAM).select(F.col("key").alias("gram"), "n", "n_all")
    # Sizes: of at most 2**16 groups, and of at most 256 parts of each group above SHARD.
    sizes: dict[int, int] = {}
    large: dict[int, list[int]] = {}
    parted, place, left = {}, F.lit(None).cast("bigint"), own
    for order in range(2, ORDER + 1):
        found = collected(left.groupBy(_suffix(order).alias("s")).agg(F.count("*").alias("size")))
        above = found[1] > SHARD if order < ORDER else np.zeros(len(found[0]), bool)
        sizes |= {order << 48 | int(s): int(n) for s, n in zip(found[0][~above], found[1][~above], strict=True)}
        large[order] = [int(s) for s in found[0][above]]
        if not large[order]:
            break
        split = _suffix(order).isin(large[order])
        left = left.where(split)
        whole = left.where("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"))
        parted[order] = tuple(collected(whole))
    for k in sorted(large, reverse=True):
        mine = F.lit(k << 48).bitwiseOR(_suffix(k))
        place = F.when(_suffix(k).isin(large[k]), place).otherwise(mine) if large[k] else mine
    low = own.where("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("n").alias("n"))
    sent = spark.sparkContext.broadcast((tuple(collected(low)), parted))
    shards = _packed(sizes, SHARD)
    schema = "place bigint, shard int"
    where = spark.createDataFrame(list(shards.items()), schema) if shards else spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(3)) for b in batches if b.num_rows]
        if not parts:
            return
        gram, n, n_all = (np.concatenate(x) for x in zip(*parts, strict=True))
        (pair, count), tables = sent.value
        upper = {k: Level(key.view(U64), c) for k, (key, c) in tables.items()}
        found = code_lengths(gram.view(U64), n, Level(pair.view(U64), count), upper)
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n_all), pa.array(found.astype(np.float32))], ["gram", "n_all", "bits"])

    rows = own.withColumn("place", place).join(F.broadcast(where), "place")
    n_shards = max(shards.values(), default=0) + 1
    made = rows.repartition(n_shards, "shard").select("gram", "n", "n_all")
    return saved(made.mapInArrow(run, "gram bigint, n_all bigint, bits float"), "coded")


class Lookup:
    """An open-addressed table of 64-bit keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = U64(64 - max(4, int(2 * len(keys)).bit_length()))
        size = self.size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.zeros(size, U64), np.zeros(size, np.float32)
        at = self._home(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]  # of keys that meet in a slot, one stays
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (size - 1)
        self.values[at] = values

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys, 71) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys; 0 of those that are not there."""
        return self.find(keys)[0]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, and whether they are there. Keys are not 0."""
        at = self._home(keys)
        seen = self.keys[at]
        left = np.flatnonzero((seen != keys) & (seen != 0))
        while len(left):
            at[left] = (at[left] + 1) & (self.size - 1)
            seen = self.keys[at[left]]
            left = left[(seen != keys[left]) & (seen != 0)]
        hit = self.keys[at] == keys
        return np.where(hit, self.values[at], np.float32(0)), hit


_held: dict[str, tuple[Lookup, np.ndarray, np.ndarray]] = {}


def _heads(name: str, sent) -> tuple[Lookup, np.ndarray, np.ndarray]:
    """The broadcast grams as a table, and the words and their counts; a worker keeps the last ones."""
    if name not in _held:
        _held.clear()
        gram, bits, word, count = sent.value
        _held[name] = Lookup(gram.view(U64), bits), word, count
    return _held[name]


def _power() -> Column:
    return F.floor(F.log2("n_all")).cast("int")


def _least(rows: DataFrame, limit: int) -> int:
    """The lowest power of two (of n_all) that at most `limit` rows reach."""
    by_power = {r["p"]: r["size"] for r in rows.groupBy(_power().alias("p")).agg(F.count("*").alias("size")).collect()}
    least, used = 64, 0
    for p in sorted(by_power, reverse=True):
        used += by_power[p]
        if used > limit:
            break
        least = p
    return least


def _by_doc(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (doc, key) pairs and how often they occur."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))) if len(key) else np.zeros(0, np.int64)
    return doc[first], key[first], np.diff(np.append(first, len(key)))


def looked_up(rows: DataFrame, heads: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], name: str) -> DataFrame:
    """Two kinds of rows, written.

    For each row of `rows` (text, doc_id, learn) one of kind null: uid, doc_id, learn, n_tokens, and n_known, log_sum and
    score as far as the heads tell them; and for each of its grams and words outside of the heads uid, kind, key, n.
    """
    fields = [f"{n} {t}" for n, t in (
        ("uid", "bigint"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("log_sum", "double"), ("score", "double"), ("kind", "int"), ("key", "bigint"), ("n", "bigint"),
    )]
    own = [StructField(f.name, f.dataType) for f in rows.select("doc_id", "learn").schema]
    schema = StructType([*own, *StructType.fromDDL(", ".join(fields)).fields])
    sent = rows.sparkSession.sparkContext.broadcast(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words, n_of = _heads(name, sent)
        for batch in batches:
            for piece in pieces(batch):
                doc_id, learn, uid = (piece.column(k) for k in (1, 2, 3))
                w = Words(as_bytes(piece.column(0)), lower=True)
                g = grams(w.stream, w.stops)
                bits, hit = known.find(g)
                score = sums_by(np.concatenate(([0], w.stops)), bits.astype(np.float64))
                miss = np.flatnonzero(~hit)
                rare = {GRAM: _by_doc(np.searchsorted(w.stops, miss, "right"), g[miss].view(np.int64))}
                different, kind = np.unique(w.hashes().view(np.int64), return_inverse=True)
                at = np.minimum(np.searchsorted(words, different), max(len(words) - 1, 0))
                there = words[at] == different if len(words) else np.zeros(len(different), bool)
                count = np.where(there, n_of[at], 0) if len(words) else np.zeros(len(different), np.int64)
                logs = np.log10(count + 1.0)[kind]
                miss = np.flatnonzero(~there[kind])
                rare[WORD] = _by_doc(w.doc[miss], different[kind[miss]])
                n = piece.num_rows
                sums = [w.counts + 1, sums_by(w.bounds, (count > 0)[kind]), sums_by(w.bounds, logs), score]
                empty = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([doc_id, learn, uid, *map(pa.array, sums), *empty], schema.names)
                for mark, (doc, key, n_here) in rare.items():
                    for k in range(0, len(key), ROWS):
                        part = slice(k, k + ROWS)
                        n = len(key[part])
                        mine = uid.take(pa.array(doc[part]))
                        none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                        told = [pa.array(np.full(n, mark, np.int32)), pa.array(key[part]), pa.array(n_here[part])]
                        yield pa.RecordBatch.from_arrays([pa.nulls(n, doc_id.type), pa.nulls(n, learn.type), mine, *none, *told], schema.names)

    numbered = rows.select("text", "doc_id", "learn").withColumn("uid", F.monotonically_increasing_id())
    done = saved(numbered.mapInArrow(run, schema), "seen")
    sent.destroy()
    return done


def scores(docs: DataFrame, learn) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score and score of each row; `learn`: a condition on docs."""
    rows = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = saved(counted(rows), "counts")
    ends = F.col("kind") == TEXT
    words = F.col("kind") == WORD
    x = counts.agg(
        F.sum(F.when(words | ends, F.col("n"))).alias("n"), F.sum(F.when((words | ends) & (F.col("n") > 0), 1)).alias("v"),
        F.sum(F.when(ends, F.col("n"))).alias("end"),
    ).first()
    total, different, end = (int(k or 0) for k in x)
    model, known = coded(counts), counts.where(words)
    least_gram, least_word = _least(model, BLOCK), _least(known, HEAD)
    gram, bits = collected(model.where(_power() >= least_gram).select("gram", "bits"))
    word, count = collected(known.where(_power() >= least_word).select("key", "n"))
    order = np.argsort(word)
    seen = looked_up(rows, (gram, bits, word[order], count[order]), model._saved_at)
    # The rest: rare grams and words by key.
    values = model.where(_power() < least_gram).select(F.lit(GRAM).alias("kind"), F.col("gram").alias("key"), F.col("bits").cast("double").alias("value"))
    values = values.unionByName(
        known.where((F.col("n") > 0) & (_power() < least_word)).select("kind", "key", F.log10(F.col("n") + 1.0).alias("value"))
    )
    rest = seen.where("kind IS NOT NULL").select("uid", "kind", "key", "n").join(values, ["kind", "key"])
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    rest = rest.groupBy("uid").agg(
        of(WORD, F.col("n")).alias("more_known"), of(WORD, F.col("n") * F.col("value")).alias("more_log"),
        of(GRAM, F.col("n") * F.col("value")).alias("more_score"),
    )
    out = seen.where("kind IS NULL").drop("kind", "key", "n").join(rest, "uid", "left").fillna(0, ["more_known", "more_log", "more_score"])
    log_sum = F.col("log_sum") + F.col("more_log") + math.log10(end + 1)
    return out.select(
        "doc_id", F.col("learn").alias("learned"), "n_tokens", (F.col("n_known") + F.col("more_known") + int(end > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (log_sum - F.col("n_tokens") * math.log10(total + different + 1)).alias("base_score"),
        (F.col("score") + F.col("more_score")).alias("score"),
    )


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = scores(docs, ~held_out)
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
