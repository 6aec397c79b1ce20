"""Quality rules as a short-circuit cascade, in SQL functions only.

Each rule is a predicate that is true for a document to be rejected. `cascade` times every rule and counts its rejections on a
bounded sample, orders the rules by rejections per second and builds one CASE WHEN, so that a document is no longer looked at once
a rule has rejected it. The order changes the cost only: a document is kept when no rule rejects it.

Null text has no words. Repeated rows and null ids each give a row of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermaline.llm.common import hash_sample, let, staged, words

WINDOW = 8
#: Documents on which cost and selectivity of the rules are estimated.
SAMPLE_ROWS = 2_000
SYMBOLS = "#*$%&|<>"


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of `window` words found at least twice, the first one included. Windows compare by a 64-bit hash
    within one text."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def width(p: Column) -> Column:
            return F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
                               lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(window))).alias("n"), i.alias("last")),
                               lambda a: a["n"])

        return let(let(pairs, starts), width)

    def count(t: Column) -> Column:
        spans = F.transform(F.sequence(F.lit(1), F.size(t) - window + 1), lambda i: F.xxhash64(F.slice(t, i, window)))
        some = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))
        return F.when(F.size(t) <= window, F.lit(0).cast("long")).otherwise(let(spans, some))

    return let(tokens, count)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words as column `measures` of structs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of(t: Column) -> Column:
        return F.struct(
            F.size(t).cast("long").alias("n_words"),
            F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(t).alias("n_repeat_words"))

    return docs.withColumn("measures", let(words(text), of))


def base_failed() -> Column:
    """The rule of every cascade: under 20 words, or over 30 % of them in repeated windows."""
    m = F.col("measures")
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def rules(text_col: str = "text") -> dict[str, Column]:
    """Rejecting predicates over `measures` and the text; none is null."""
    m, text = F.col("measures"), F.coalesce(F.col(text_col), F.lit(""))
    letters = F.char_length(F.regexp_replace(text, "\\P{L}+", ""))
    capitals = F.char_length(F.regexp_replace(text, "\\P{Lu}+", ""))
    return {
        "symbols": 100 * m["n_symbols"] > 10 * m["word_chars"],
        "short_words": m["word_chars"] < 2 * m["n_words"],
        "long_words": m["word_chars"] > 20 * m["n_words"],
        "duplicate_lines": 100 * m["n_dup_lines"] > 30 * F.size(F.split(text, "\n")),
        "capitals": 100 * capitals > 60 * letters,
        "letters": 100 * letters < 60 * m["word_chars"],
        "table_bars": 100 * (F.char_length(text) - F.char_length(F.translate(text, "|", ""))) > 20 * m["n_words"],
        "stutter": let(words(text), lambda w: 100 * F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
                                                                                lambda a, b: a == b), lambda x: x)) > 30 * F.size(w)),
        "exclamations": 100 * (F.char_length(text) - F.char_length(F.translate(text, "!?", ""))) > 10 * m["word_chars"],
    }


def ordered(docs: DataFrame, preds: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, rejected share, seconds) by falling rejections per second on a sample of measured documents."""
    sample = docs.limit(sample_rows).cache()
    try:
        n, found = max(sample.count(), 1), []
        for name, pred in preds.items():
            began = time.perf_counter()
            hits = sample.agg(F.count_if(pred).alias("n")).first()["n"]
            found.append((name, hits / n, time.perf_counter() - began))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: (-x[1] / x[2], x[2], x[0]))


def cascade(measured: DataFrame, preds: dict[str, Column], order: list[str]) -> DataFrame:
    """Adds `failed_rule`: the first rule in `order` that rejects the document, else null."""
    verdict = F.when(base_failed(), F.lit("base"))
    for name in order:
        verdict = verdict.when(preds[name], F.lit(name))
    return measured.withColumn("failed_rule", verdict)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """id, text, measures and failed_rule of every document."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    preds = rules()
    sample = staged(hash_sample(read, sample_rows, "doc_id"))
    order = [name for name, _, _ in ordered(measures(sample), preds, sample_rows)]
    return cascade(measures(read), preds, order)


def op10(docs: DataFrame) -> DataFrame:
    out = judge(docs)
    return out.select("doc_id", "measures.n_words", "measures.word_chars", "measures.n_symbols", "measures.n_dup_lines",
                      "measures.n_repeat_words", base_failed().alias("base_failed"), F.col("failed_rule").isNull().alias("kept"))


OP10_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
spans AS (SELECT k, i, array_to_string(words[i:i + 7], chr(10)) AS s
          FROM (SELECT k, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS n FROM spans) WHERE n > 1),
rep AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY k),
m AS (SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             length(regexp_replace(text, '\P{L}+', '', 'g')) AS letters, length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS capitals,
             length(regexp_replace(text, '[^!?]+', '', 'g')) AS marks,
             length(regexp_replace(text, '[^|]+', '', 'g')) AS bars,
             len(list_filter(list_zip(words[:-2], words[2:]), lambda x: x[1] = x[2])) AS pairs, len(string_split(text, chr(10))) AS n_lines
      FROM w LEFT JOIN rep USING (k)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 100 * n_dup_lines > 30 * n_lines OR 100 * capitals > 60 * letters OR 100 * letters < 60 * word_chars
            OR 100 * bars > 20 * n_words OR 100 * pairs > 30 * n_words OR 100 * marks > 10 * word_chars) AS kept
FROM b
"""
