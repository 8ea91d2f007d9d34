"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is measured and evaluated once per document; its failure is one bit of ``failures``. Policies are named masks
over those bits: applying another version of a policy, or asking what a rule alone removes, reads the ledger and never the
texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    sql: str                     # holds for documents that fail


RULES = (Rule(0, "few_words", "n_words < 20"),
         Rule(1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
         Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
         Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
         Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
         Rule(5, "many_symbols", "n_symbols > n_words"))

#: Versions of the policy: the rules that each one applies.
POLICIES = {"base": ("few_words", "repeated_words"),
            "v1": ("few_words", "repeated_words", "many_symbols"),
            "v2": ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length")}


def mask(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements of each whole text; null texts have no words and no lines.

    Windows of eight words are first compared by hash; only texts in which two hashes agree compare the words themselves,
    so equal hashes never decide.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.btrim(text, F.lit(SPACE_CHARS)).alias("trimmed"))
    rows = rows.select("doc_id", "text", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", SPACE)).alias("words"),
                       F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias("lines"))
    n = F.size("words")
    last = F.when(n >= WINDOW, n - WINDOW + 1).otherwise(0)
    rows = rows.select("doc_id", "words", n.cast("long").alias("n_words"), F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
                       F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("hashes", F.when(F.size("h") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("h", i, WINDOW)))))
    rows = rows.withColumn("again", F.coalesce(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.lit(False))).drop("h", "hashes")
    keyed = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.slice("words", i, WINDOW)).alias("k"), i.alias("i"))))
    rows = rows.withColumn("keyed", F.when(F.col("again") & (F.size("words") >= WINDOW), keyed)).drop("words")
    twin = F.transform("keyed", lambda x, j: F.when((x["k"] == F.get("keyed", j - 1)["k"]) | (x["k"] == F.get("keyed", j + 1)["k"]), x["i"]))
    found = F.array_sort(F.array_compact(twin))
    covered = F.aggregate(found, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                          lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"])).alias("n"), (i + WINDOW).alias("end")))
    return rows.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long")).drop("keyed", "again")


def ledger(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id``, the measurements and ``failures``, bit by bit as in ``RULES``.

    Null and empty texts have zero of everything and fail ``few_words``; repeated rows give repeated results; other columns
    are not read.
    """
    bits = [F.when(F.expr(r.sql), F.lit(1 << r.bit)).otherwise(0) for r in RULES]
    total: Column = F.lit(0)
    for b in bits:
        total = total.bitwiseOR(b)
    return measure(docs).withColumn("failures", total.cast("long"))


def failed(policy: str, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(mask(policy))) != 0


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` (by the named policy on top of the base rules) to a ledger."""
    return rows.withColumn("base_failed", failed("base")).withColumn("kept", ~failed("base") & ~failed(policy))


def ablations(rows: DataFrame) -> DataFrame:
    """Per policy and rule: documents that fail it, those that only it removes, and what stays without it. One pass over the ledger."""
    wanted = [(p, r.name, mask(p), 1 << r.bit) for p in POLICIES for r in RULES if r.name in POLICIES[p]]
    sums = []
    for k, (_, _, m, b) in enumerate(wanted):
        own = F.col("failures").bitwiseAND(F.lit(m))
        sums += [F.sum((own.bitwiseAND(F.lit(b)) != 0).cast("long")).alias(f"f{k}"), F.sum((own == b).cast("long")).alias(f"o{k}"),
                 F.sum((own.bitwiseAND(F.lit(~b)) == 0).cast("long")).alias(f"k{k}")]
    line = rows.agg(F.bit_or("failures").alias("seen"), *sums)
    parts = ", ".join(f"'{p}', '{r}', coalesce(f{k}, 0), coalesce(o{k}, 0), coalesce(k{k}, 0)" for k, (p, r, _, _) in enumerate(wanted))
    return line.selectExpr(f"stack({len(wanted)}, {parts}) as (policy, rule, n_failing, n_only, n_kept_without)")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT doc_id, k FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (doc_id, k)) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM m
"""
