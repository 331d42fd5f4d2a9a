"""Operator 8: quality rules.

A table of thresholds becomes one projection of built-in functions.  All ratios
are compared as integer products, so other engines give equal verdicts.

Defined results: a null or empty text has no words and fails the base rules;
repeated rows get equal rows; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm.runtime import only

#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = ("the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "der", "die", "das", "und", "ist", "ein", "zu", "den", "le", "la", "les", "de", "des", "et", "que", "un", "une", "el", "los", "las", "y", "en", "del", "se")


@dataclass(frozen=True)
class Rule:
    """Fails when times_left * left {<,>} times_right * right, for texts of at least min_words words."""

    name: str
    left: str
    sense: str
    right: str
    times_left: int = 1
    times_right: int = 1
    min_words: int = 0

    def column(self) -> Column:
        a, b = F.col(self.left) * self.times_left, F.col(self.right) * self.times_right
        return (F.col("n_words") >= self.min_words) & ((a < b) if self.sense == "<" else (a > b))

    def sql(self) -> str:
        return f"(n_words >= {self.min_words} AND {self.times_left} * {self.left} {self.sense} {self.times_right} * {self.right})"


BASE = (Rule("few_words", "n_words", "<", "one", 1, 10), Rule("repeated_words", "n_repeat_words", ">", "n_words", 100, 20))
RULES = (
    Rule("short_words", "word_chars", "<", "n_words", 1, 2),
    Rule("long_words", "word_chars", ">", "n_words", 1, 15),
    Rule("symbols", "n_symbols", ">", "n_words", 100, 10),
    Rule("no_stop_words", "n_stop_words", "<", "n_words", 100, 1, 50),
    Rule("copied_lines", "n_dup_lines", ">", "n_lines", 100, 30),
)
WHITE = " \t\n\x0b\f\r"
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines"]


def _repeated(words: Column, hashes: Column, window: int) -> Column:
    """Words in windows that the text has twice or more: equal windows are neighbours once sorted by hash, then place."""
    same = lambda s, x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
    twice = F.filter(hashes, lambda x, k: same(hashes, x, k - 1) | same(hashes, x, k + 1))
    return F.array_sort(F.transform(twice, lambda x: x["i"]))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, window: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the metrics, base_failed, kept, and the names of the failed rules."""
    text = F.col("text")
    rows = only(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = rows.select("doc_id", "text", F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0).alias("lines"))
    # each word is hashed once, each window from its words' numbers
    numbers = split.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("numbers"))
    hashed = numbers.select(
        "*",
        F.sort_array(
            F.when(F.size("words") >= window, F.transform(F.sequence(F.lit(0), F.size("words") - window), lambda i: F.struct(F.xxhash64(*[F.get(F.col("numbers"), i + k) for k in range(window)]).alias("h"), i.alias("i"))))
            .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        ).alias("windows"),
    )
    placed = hashed.select("*", _repeated(F.col("words"), F.col("windows"), window).alias("places"))
    at = F.col("places")
    measured = placed.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - x, F.lit(window)))), F.lit(0).cast("long"), lambda s, x: s + x).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS, *[s.capitalize() for s in STOP_WORDS]))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.lit(1).alias("one"),
    )
    failed = F.array_compact(F.array(*[F.when(r.column(), F.lit(r.name)) for r in (*base, *rules)]))
    judged = measured.select("*", failed.alias("failed_rules"))
    bad_base = F.exists("failed_rules", lambda x: x.isin(*[r.name for r in base]))
    return judged.select("doc_id", *METRICS, bad_base.alias("base_failed"), (F.size("failed_rules") == 0).alias("kept"))


def sql(rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, window: int = 5) -> str:
    """The same in DuckDB's SQL."""
    stops = ", ".join(f"'{w}'" for s in STOP_WORDS for w in (s, s.capitalize()))
    words = r"'[^\x20\x09-\x0D]+'"
    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, regexp_extract_all(text, {words}) AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {words})) AS lines FROM base),
win AS (SELECT doc_id, text, words, lines,
    CASE WHEN len(words) >= {window} THEN list_transform(range(1, len(words) - {window - 2}), lambda i: array_to_string(words[i:i+{window - 1}], ' ')) ELSE [] END AS windows FROM split),
flat AS (SELECT doc_id, unnest(windows) AS w, unnest(range(len(windows))) AS i FROM win),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM flat),
gaps AS (SELECT doc_id, least({window}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {window})) AS g FROM twice WHERE n > 1),
rep AS (SELECT doc_id, sum(g)::BIGINT AS n FROM gaps GROUP BY doc_id),
m AS (SELECT win.doc_id, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda x: x IN ({stops})))::BIGINT AS n_stop_words,
    len(lines)::BIGINT AS n_lines, 1 AS one
  FROM win LEFT JOIN rep ON win.doc_id = rep.doc_id)
SELECT doc_id, {', '.join(METRICS)},
  ({' OR '.join(r.sql() for r in base)}) AS base_failed,
  NOT ({' OR '.join(r.sql() for r in (*base, *rules))}) AS kept
FROM m"""
