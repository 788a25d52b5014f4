"""Quality rules as a bitmask ledger: measure once, judge by versioned policies."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Names, as_bytes, numbered, slices, window_names

SYMBOLS, UPPER = b"#*$%&|<>", bytes(range(65, 91))
#: Bytes that are white space or no first byte of a character.
NO_CHARACTER = bytes((0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)))
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_upper", "n_letters", "n_stutter")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)


def _line_counts(text: bytes) -> tuple[int, int]:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measurements of each text; words and their windows are compared by what they are, not by hash."""
    n = len(texts)
    numbers, first = numbered(texts, Names())
    counts = np.diff(first)

    def per_text(value) -> np.ndarray:
        return np.fromiter(map(value, texts), np.int64, n)

    out = {"n_words": counts}
    out["word_chars"] = per_text(lambda t: len(t.translate(None, NO_CHARACTER)))
    out["n_symbols"] = per_text(lambda t: len(t) - len(t.translate(None, SYMBOLS)))
    lines = np.array([_line_counts(t) for t in texts], dtype=np.int64).reshape(n, 2)
    out["n_lines"], out["n_dup_lines"] = lines[:, 0], lines[:, 1]
    out["n_shouts"] = per_text(lambda t: t.count(b"!"))
    out["n_upper"] = per_text(lambda t: len(t) - len(t.translate(None, UPPER)))
    out["n_letters"] = per_text(lambda t: len(t) - len(t.translate(None, UPPER + UPPER.lower())))
    text = np.repeat(np.arange(n), counts)
    again = (numbers[1:] == numbers[:-1]) & (text[1:] == text[:-1])
    out["n_stutter"] = np.bincount(text[1:][again], minlength=n)
    # words in windows that occur twice or more in their text
    names = window_names(numbers, WINDOW)
    place = np.flatnonzero(text[: len(names)] == text[WINDOW - 1 :])
    keys = text[place] << 32 | names[place]
    order = np.argsort(keys)
    equal = keys[order][1:] == keys[order][:-1]
    same = np.zeros(len(keys), bool)
    same[order[1:][equal]] = True
    same[order[:-1][equal]] = True
    edges = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edges, place[same], 1)
    np.add.at(edges, place[same] + WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edges[:-1]) > 0)))
    out["n_repeat_words"] = covered[first[1:]] - covered[first[:-1]]
    return out


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in slices(batch.column(1)):
            found = measure(as_bytes(batch.column(1)[start:stop]))
            yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], ["doc_id", *MEASURES])


#: Rules by name: a document fails where the condition holds. The place of a rule is its bit; rules are only ever appended.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "100 * n_upper > 40 * n_letters and n_letters > 0",
    "exclamation": "20 * n_shouts > n_words and n_words >= 20",
    "stutter": "100 * n_stutter > 30 * n_words",
}

#: Versions of the policy: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
}


def mask_of(policy: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed`` (bit i: rule i failed) of every row of ``docs`` (doc_id, text).

    One pass, no shuffle. Null and empty texts have no words; long texts are
    measured whole, and cut into words some at a time; the words, lines and
    windows of a text are compared by what they are; repeated rows are measured
    alike, and nothing depends on their order; no rows give no rows; extra
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure_batches, SCHEMA)
    bits = [F.when(F.expr(rule), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, rule in enumerate(RULES.values())]
    return rows.withColumn("failed", reduce(Column.bitwiseOR, bits))


def judge(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds base_failed and kept under a policy; needs the ledger only, not the texts."""
    return rows.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(mask_of("base"))) != 0).withColumn(
        "kept", F.col("failed").bitwiseAND(F.lit(mask_of("base") | mask_of(policy))) == 0
    )


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """rule, n_failed and n_only (documents that would be kept without this rule), from one aggregation of the ledger."""
    mask = mask_of(policy)
    used = F.col("failed").bitwiseAND(F.lit(mask))
    aggregates = []
    for k, rule in enumerate(RULES):
        if mask >> k & 1:
            aggregates.append(F.struct(F.lit(rule).alias("rule"), F.count_if(used.bitwiseAND(F.lit(1 << k)) != 0).alias("n_failed"), F.count_if(used == (1 << k)).alias("n_only")))
    return rows.agg(F.array(*aggregates).alias("all")).select(F.inline("all"))


def op10_quality_rules(spark, sf_dir):
    rows = judge(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d
), g AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS gram FROM p WHERE i + 7 <= len(w)
), t AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM t) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_shouts,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutter
  FROM d LEFT JOIN c USING (doc_id)
), f AS (
  SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
             + 8 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT
             + 64 * (100 * n_upper > 40 * n_letters AND n_letters > 0)::BIGINT + 128 * (20 * n_shouts > n_words AND n_words >= 20)::BIGINT
             + 256 * (100 * n_stutter > 30 * n_words)::BIGINT)::BIGINT AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""
