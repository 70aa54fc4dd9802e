"""Quality rules evaluated once into a ledger of failure bits, and policies applied to the bits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import BREAKS, bind, words

SYMBOLS = "#*$%&|<>"
MEASURED = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals"]

#: Rule by bit: name, and the test that a failing document meets, over the measurements.
RULES: list[tuple[str, Callable[[Column], Column]]] = [
    ("few_words", lambda m: m["n_words"] < 50),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    ("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    ("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    ("capitals", lambda m: 2 * m["n_capitals"] > m["word_chars"]),
]
BASE = ("few_words", "repeated_windows")
#: Policy by name and version: the rules it applies. A version, once used, is never changed.
POLICIES = {
    ("base", 1): BASE,
    ("standard", 1): tuple(name for name, _ in RULES),
}


def mask(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in rules)


def _repeat_words(w: Column) -> Column:
    """How many words lie in a window of three that occurs twice or more in the text.

    Each window becomes a long, the upper bits of its hash above its position, so that one sort of longs
    brings equal windows together. The bits are fewer the longer the text, so those found are compared
    word by word, and the count is exact at any length.
    """
    n = F.size(w)
    last = F.greatest(n - 3, F.lit(0))
    shift = F.length(F.bin(F.greatest(n, F.lit(1))))

    def count(bits: Column) -> Column:
        key = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        packed = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.call_function("shiftleft", F.call_function("shiftright", key(i), bits), bits).bitwiseOR(i.cast("long")),
        )

        def repeated(p: Column) -> Column:
            top = lambda i: F.call_function("shiftright", F.get(p, i), bits)
            twice = lambda i: ((i > 0) & (top(i) == top(i - 1))) | ((i < last) & (top(i) == top(i + 1)))
            found = F.filter(F.sequence(F.lit(0), last), twice)
            low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
            starts = F.transform(found, lambda i: F.get(p, i).bitwiseAND(low).cast("int"))
            window = lambda s: F.struct(*[F.get(w, s + k).alias(f"w{k}") for k in range(3)])
            return bind(F.sort_array(F.transform(starts, lambda s: F.struct(window(s).alias("w"), s.alias("s")))), same)

        def same(q: Column) -> Column:
            at = lambda i: F.get(q, i)["w"]
            equal = lambda i: ((i > 0) & (at(i) == at(i - 1))) | ((i < F.size(q) - 1) & (at(i) == at(i + 1)))
            starts = F.transform(F.filter(F.transform(q, lambda x, i: i), equal), lambda i: F.get(q, i)["s"])
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda s: F.array(s, s + 1, s + 2)))))

        return bind(F.sort_array(packed), repeated)

    return F.when(n < 4, F.lit(0)).otherwise(bind(shift, count)).cast("long")


def measurements(text: Column) -> Column:
    """A struct of what the rules look at; a null text measures as an empty one."""
    text = F.coalesce(text, F.lit(""))
    count_of = lambda t, chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, BREAKS, "") != "")
    line_counts = bind(lines, lambda ls: F.struct(
        F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")
    ))
    word_counts = bind(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")
    ))
    return bind(F.struct(line_counts.alias("l"), word_counts.alias("w")), lambda m: F.struct(
        m["w"]["n_words"].alias("n_words"),
        F.length(F.translate(text, BREAKS, "")).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"),
        m["l"]["n_lines"].alias("n_lines"),
        m["l"]["n_dup_lines"].alias("n_dup_lines"),
        m["w"]["n_repeat_words"].alias("n_repeat_words"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
    ))


def ledger(documents: DataFrame) -> DataFrame:
    """All columns and rows, with ``_quality``: the measurements, and in ``failed`` a bit for each failed rule.

    One row in, one row out, no shuffle. Null, empty and blank texts have no words and fail
    ``few_words``. A column ``_quality`` of the input is replaced; any other name may occur.
    """
    return documents.withColumn("_quality", judged(F.col("text")))


def judged(text: Column) -> Column:
    """The measurements and the bits of the failed rules, as one expression that measures once.

    A filter on the bits may be moved below the column; it then still holds one copy of it.
    """

    def with_bits(m: Column) -> Column:
        bits = [F.when(test(m), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, (_, test) in enumerate(RULES)]
        return F.struct(*[m[c].alias(c) for c in MEASURED], reduce(Column.bitwiseOR, bits).cast("long").alias("failed"))

    return bind(measurements(text), with_bits)


def passes(failed: Column, policy: tuple[str, int]) -> Column:
    return failed.bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(ledger_rows: DataFrame, policy: tuple[str, int]) -> DataFrame:
    """policy, version, rule, failing, only, kept_without: what each rule of the policy does, from the bits alone.

    ``failing`` counts documents that fail the rule, ``only`` those that fail no other rule of the
    policy, ``kept_without`` those the policy without the rule would keep. One row for each rule, with
    counts 0 on an empty ledger.
    """
    failed, all_bits = F.col("_quality.failed"), mask(POLICIES[policy])
    counts = []
    for rule in POLICIES[policy]:
        bit, rest = mask((rule,)), all_bits & ~mask((rule,))
        counts.append(F.struct(
            F.lit(rule).alias("rule"),
            F.count_if(failed.bitwiseAND(F.lit(bit)) != 0).alias("failing"),
            F.count_if(failed.bitwiseAND(F.lit(all_bits)) == bit).alias("only"),
            F.count_if(failed.bitwiseAND(F.lit(rest)) == 0).alias("kept_without"),
        ))
    rows = ledger_rows.agg(F.array(*counts).alias("rules")).select(F.inline("rules"))
    return rows.select(F.lit(policy[0]).alias("policy"), F.lit(policy[1]).alias("version"), "*")


def keep_good(documents: DataFrame, policy: tuple[str, int] = ("standard", 1)) -> DataFrame:
    """The documents that pass the policy, with the columns they came with."""
    return documents.where(passes(judged(F.col("text"))["failed"], policy))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under policy standard, version 1."""
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "_quality.n_words", "_quality.word_chars", "_quality.n_symbols", "_quality.n_dup_lines",
        "_quality.n_repeat_words", "_quality.n_lines", "_quality.n_capitals", "_quality.failed",
    )
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(F.col("failed"), ("base", 1))).alias("base_failed"),
        passes(F.col("failed"), ("standard", 1)).alias("kept"),
        "n_lines", "n_capitals", "failed",
    )


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
             len(l) AS n_lines, length(text) - length(regexp_replace(text, '\\p{Lu}', '', 'g')) AS n_capitals
      FROM w LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
             + 4 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
             + 8 * (10 * n_symbols > n_words)::BIGINT + 16 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
             + 32 * (2 * n_capitals > word_chars)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed,
       failed = 0 AS kept, n_lines, n_capitals, failed FROM b
"""
