"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps its measurements and
one failure bit a rule; a policy is a named set of rules, so that policies can be
applied, compared and ablated later from the ledger alone, without the texts.  A policy
names the version (a digest) of each rule's condition: if a threshold is changed under a
policy's feet, applying it is an error, and bits written before are never read anew.

Edge cases: a null text has no words (it fails `few_words`, all measures are 0); an
empty text likewise; null or repeated doc_ids are carried through row by row; other
columns of the input are not looked at; an empty table gives no rows.  Texts of any length are measured whole.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import arrow_map, as_bytes, fresh, saved, table, without
from .ragged import Words, mix, span_hashes, sums_by, window_hashes, window_mask

#: Rules in the order of their bits: name and failing condition over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("exclamations", "10 * n_exclamations > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
)
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that reject a document, each with the version of its condition that the policy was
#: made for. A policy never changes; a new one gets a new name, and so does a rule whose condition changes.
POLICIES: dict[str, tuple[tuple[str, str], ...]] = {
    "base-1": (("few_words", "5eb970db"), ("repeated_windows", "d1def77e")),
    "prose-1": (
        ("few_words", "5eb970db"),
        ("repeated_windows", "d1def77e"),
        ("symbols", "bf4a7cd8"),
        ("exclamations", "043a3e2c"),
        ("repeated_lines", "0ff57555"),
        ("short_words", "a7bebe00"),
        ("long_words", "eca65923"),
    ),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_exclamations", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(9, 14)]] = True


def _repeats(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True for entries whose (doc, key) occurs twice or more."""
    own = mix(keys ^ (doc.astype(np.uint64) << np.uint64(40)), 5)
    ordered = np.sort(own)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(own), bool)
    at = np.searchsorted(twice, own)
    at[at == len(twice)] = 0
    return twice[at] == own


def measure(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """The measurements of each text."""
    w = Words(texts, lower=False)
    s, stops = w.stream, np.concatenate(([0], w.stops))
    chars = (s & 0xC0) != 0x80
    chars &= (s != 0x20) & (s != 0x0A)
    window = window_hashes(w.hashes(), 3)
    usable = np.flatnonzero(window_mask(w.counts, w.bounds, 3))
    again = usable[_repeats(w.doc[usable], window[usable])]
    covered = np.zeros(len(window) + 2, bool)
    for k in range(3):
        covered[again + k] = True
    raw = np.frombuffer(b"".join([(x or b"") + b"\n" for x in texts]), np.uint8)
    end = np.flatnonzero(raw == 0x0A)
    start = np.concatenate(([0], end[:-1] + 1))
    filled = np.concatenate(([0], np.cumsum(~_WHITE[raw])))
    worded = filled[end] > filled[start]
    close = np.cumsum([len(x or b"") + 1 for x in texts])
    line_bounds = np.concatenate(([0], np.searchsorted(end, close - 1) + 1))
    line_doc = np.repeat(np.arange(len(texts)), np.diff(line_bounds))[worded]
    line = span_hashes(raw, start[worded], end[worded], 3)
    order = np.lexsort((line, line_doc))
    same = (line[order][1:] == line[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    return {
        "n_words": w.counts,
        "word_chars": sums_by(stops, chars),
        "n_symbols": sums_by(stops, _SYMBOL[s]),
        "n_exclamations": sums_by(stops, s == 0x21),
        "n_lines": np.bincount(line_doc, minlength=len(texts)),
        "n_dup_lines": np.bincount(line_doc[order][1:][same], minlength=len(texts)),
        "n_repeat_words": sums_by(w.bounds, covered[: len(window)]),
    }


def measurements(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and MEASURES (long) of each row's text; kept columns with the name of a measure are replaced."""
    keep = tuple(without(docs.select(*keep), *MEASURES, "failed_bits"))
    schema = StructType([*docs.select(*keep).schema, *(StructField(m, LongType()) for m in MEASURES)])

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = measure(as_bytes(batch.column(0)))
            own = [pa.array(found[m], pa.int64()) for m in MEASURES]
            return pa.RecordBatch.from_arrays([*batch.columns[1:], *own], [*keep, *MEASURES])

        return each

    return arrow_map(docs.select(F.col(text).alias(fresh(docs, "measured_text")), *keep), schema, make)


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, MEASURES and `failed_bits`: bit k is set if RULES[k] fails."""
    bits = F.lit(0)
    for name, failing in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(failing), F.lit(BITS[name])).otherwise(0))
    return measurements(docs, text, keep).withColumn("failed_bits", bits)


def version(rule: str) -> str:
    """A digest of the rule's condition."""
    return hashlib.sha256(dict(RULES)[rule].encode()).hexdigest()[:8]


def mask(policy: str) -> int:
    """The bits of the policy's rules, if their conditions are still those it was made for."""
    changed = [rule for rule, made_for in POLICIES[policy] if version(rule) != made_for]
    if changed:
        raise ValueError(f"policy {policy} was made for other conditions of {', '.join(changed)}")
    return sum(BITS[rule] for rule, _ in POLICIES[policy])


def passes(policy: str, bits: str = "failed_bits") -> Column:
    """True where no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents failing it, failing only it, and kept if it were left out.

    One aggregation by bit pattern (at most 2**rules groups); the texts are not read again.
    """
    own = mask(policy)
    patterns = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(own)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).alias("bit")) for r, _ in POLICIES[policy]]))
    seen = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    without = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    return seen.groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(without == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def stored(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ledger, written to the shared folder with the versions of its rules: policies and ablations read it, and no text again."""
    return saved(ledger(docs, text, keep).withColumn("rule_versions", F.lit(",".join(version(rule) for rule, _ in RULES))), "ledger")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base-1")).alias("base_failed"), passes("prose-1").alias("kept"), "failed_bits",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both policies on one stored ledger: for each rule, what fails it, fails it alone, and stays without it."""
    rows = stored(table(spark, sf_dir, "documents"))
    return reduce(DataFrame.unionByName, [ablations(rows, policy).withColumn("policy", F.lit(policy)) for policy in POLICIES])


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS t,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM words WHERE len(w) >= 3),
windows AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p : p + 2]) AS n FROM places),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id)),
f AS (
  SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
         + 8 * (10 * n_exclamations > 3 * n_words)::INT + 16 * (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)::INT
         + 32 * (word_chars < 2 * n_words)::INT + 64 * (word_chars > 14 * n_words)::INT AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed,
       failed_bits = 0 AS kept, failed_bits::INT AS failed_bits
FROM f
"""

#: The same measures and bits, counted by rule.
ABLATIONS = ORACLE.rsplit("SELECT doc_id, n_words", 1)[0].rstrip() + f""",
p AS (SELECT * FROM (VALUES {", ".join(f"('{policy}', '{rule}', {BITS[rule]}, {sum(BITS[r] for r, _ in own)})" for policy, own in POLICIES.items() for rule, _ in own)}) t(policy, rule, bit, mask))
SELECT policy, rule, bit::INT AS bit, count(*) FILTER (WHERE failed_bits & bit <> 0) AS n_failed, count(*) FILTER (WHERE failed_bits & mask = bit) AS n_failed_alone,
       count(*) FILTER (WHERE failed_bits & mask & ~bit = 0) AS n_kept_without
FROM f, p GROUP BY policy, rule, bit
"""
