"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` holds one row per rule: a name, the metric it bounds and its least
and greatest accepted value. ``verdict`` turns the whole table into columns of
one projection; no Python function runs on the executors.

Metrics are exact counts, so that ratios compare in integers:

* ``n_words``, ``word_chars``: words ``[^\\x20\\x09-\\x0D]+`` and the code points in them
* ``n_symbols``: characters of ``[#*$%&|<>]``
* ``n_stop_words``: words equal, after lower-casing, to a function word
* ``n_lines``, ``n_dup_lines``: lines with a word; those equal to an earlier one
* ``n_bullet_lines``, ``n_ellipsis_lines``: lines that open with a bullet, close with an ellipsis
* ``n_repeat_words``: words in 3-word windows found twice or more in the text

Defined cases: a null text counts as an empty one, with no words, and is
rejected as too short. Very long texts take n log n steps in their length.
Repeated rows give repeated results. Columns of the input other than the id
and the text are neither read nor returned by ``measure``; ``apply_rules``
returns the input's own columns unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS, let, words

#: Frequent function words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "it", "for", "on", "was", "are", "this",
    "der", "die", "das", "und", "ist", "von", "zu", "mit", "den", "nicht", "ein", "eine", "im", "auf",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "en", "par", "pour",
    "el", "los", "las", "y", "se", "con", "una", "por",
)

#: (rule, numerator, denominator, least percent, greatest percent); None leaves a side open.
RATIO_RULES = (
    ("mean_word_length", "word_chars", "n_words", 200, 2000),
    ("symbols_per_word", "n_symbols", "n_words", None, 10),
    ("stop_words", "n_stop_words", "n_words", 1, None),
    ("dup_lines", "n_dup_lines", "n_lines", None, 30),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
    ("repeated_windows", "n_repeat_words", "n_words", None, 50),
)
#: (rule, metric, least, greatest).
COUNT_RULES = (("length", "n_words", 50, 1_000_000),)

SYMBOLS = "#*$%&|<>"


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def _repeat_words(ws: Column) -> Column:
    """Words covered by a 3-word window that occurs at least twice. Windows are
    compared by their 64-bit hashes (within one text). The hashes found twice
    set bits of a 64-bit mask; only windows whose bit is set are sorted as
    (hash, position) pairs, where repeated ones become neighbours."""

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                           lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def mask(h: Column) -> Column:
        return let(F.sort_array(h), lambda s: F.aggregate(
            F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1) == x, F.lit(False))),
            F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(_bit(x))))

    def hits(s: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(s, i - 1)["h"] == x["h"])
            return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
            F.lit(0), lambda a, b: a + b)

    def count(h: Column) -> Column:
        pairs = let(mask(h), lambda m: F.sort_array(F.filter(
            F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))),
            lambda x: _bit(x["h"]).bitwiseAND(m) != 0)))
        return let(pairs, lambda s: let(hits(s), covered))

    return let(ws, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(
        let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(count(h)))))


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the metrics of every row's whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), text.alias("_t"), words(text).alias("_w"),
                       F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    lines, blanks = F.col("_l"), F.lit(BLANK_CHARS)
    closed = F.transform(lines, lambda x: F.rtrim(x, blanks))
    return base.select(
        id_col,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(closed, lambda x: x.endswith("...") | x.endswith("…"))).cast("long").alias("n_ellipsis_lines"))


def verdict(ratio_rules=RATIO_RULES, count_rules=COUNT_RULES) -> list[Column]:
    """The threshold table as columns: ``fails`` names the rules a row breaks."""
    broken = []
    for name, metric, least, greatest in count_rules:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (F.col(metric) < least)
        if greatest is not None:
            bad = bad | (F.col(metric) > greatest)
        broken.append(F.when(bad, F.lit(name)))
    for name, num, den, least, greatest in ratio_rules:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (F.col(num) * 100 < F.col(den) * least)
        if greatest is not None:
            bad = bad | (F.col(num) * 100 > F.col(den) * greatest)
        broken.append(F.when(bad, F.lit(name)))
    return [F.concat_ws(",", *broken).alias("fails")]


def apply_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that break no rule, with the columns of ``docs``."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    scored = measure(packed.select("_row", F.col("_row")[text_col].alias("_text")), "_row", "_text")
    return scored.select("_row", *verdict()).filter(F.col("fails") == "").select("_row.*")


def op7(docs: DataFrame) -> DataFrame:
    """Digest of the query contract: base counts, the base rule, the verdict."""
    base_failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return measure(docs).select("*", *verdict()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & (F.col("fails") == "")).alias("kept"),
        "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines", "fails")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    blank = r"[\x20\x09-\x0D]+"
    checks = []
    for name, metric, least, greatest in COUNT_RULES:
        parts = ([f"{metric} < {least}"] if least is not None else []) + ([f"{metric} > {greatest}"] if greatest is not None else [])
        checks.append(f"CASE WHEN {' OR '.join(parts)} THEN '{name}' END")
    for name, num, den, least, greatest in RATIO_RULES:
        parts = ([f"{num} * 100 < {den} * {least}"] if least is not None else []) + \
                ([f"{num} * 100 > {den} * {greatest}"] if greatest is not None else [])
        checks.append(f"CASE WHEN {' OR '.join(parts)} THEN '{name}' END")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS p
  FROM (SELECT rid, list_filter(regexp_split_to_array(t, '{blank}'), lambda x: x <> '') AS ws FROM d)),
wc AS (
  SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars,
         count(*) FILTER (lower(word) IN ({stop})) AS n_stop_words
  FROM w GROUP BY rid),
win AS (
  SELECT rid, p, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g
  FROM w WINDOW o AS (PARTITION BY rid ORDER BY p)),
hit AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM win WHERE g IS NOT NULL) WHERE n > 1),
rep AS (
  SELECT rid, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT rid, p + unnest([0, 1, 2]) AS q FROM hit) GROUP BY rid),
l AS (
  SELECT rid, line FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
lc AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (regexp_matches(line, '^[\\x20\\x09-\\x0D]*[-*•]')) AS n_bullet_lines,
         count(*) FILTER (regexp_matches(line, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')) AS n_ellipsis_lines
  FROM l GROUP BY rid),
m AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_stop_words, 0)::BIGINT AS n_stop_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_bullet_lines, 0)::BIGINT AS n_bullet_lines, coalesce(n_ellipsis_lines, 0)::BIGINT AS n_ellipsis_lines
  FROM d LEFT JOIN wc USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lc USING (rid)),
f AS (
  SELECT *, concat_ws(',', {', '.join(checks)}) AS fails,
         n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND fails = '' AS kept, n_stop_words, n_lines, n_bullet_lines, n_ellipsis_lines, fails
FROM f"""


OP7_SQL = _sql()
