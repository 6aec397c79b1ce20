"""Divergence of the sources of each language, with strings joined back late.

Tasks count the terms of their documents and write, per (language, source, term), one narrow row: a 64-bit digest, the occurrences and the
documents, with the term, once a task, in a column of its own. Counting, thresholds, divergences and ranks read and shuffle the digests only. The least and
the greatest string of each digest show where two terms share one; such a digest is split by the rank of its terms (column `sub`). The
strings are joined again only to the terms that are within the wanted ranks.

Terms are runs of letters A-Z, a-z and of characters beyond ASCII, with A-Z lower-cased. Null text, language and source count as
''. Every row is a document, repeated rows too. A language keeps the terms of at least `min_docs` of its documents. Every occurring group of
language and source is listed in part `pair` against each other source of its language, with or without terms; a language of one source and
without kept terms gives no rows, neither does an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermaline.llm.common import staged

MIN_DOCS, TOP, UNIT = 3, 200, 1_000_000_000
#: Counts in a block of terms in which sources are compared, on average at most; sources of a part; cells of a matrix held at once.
BLOCK, PART, CELLS = 65_536, 256, 1 << 20
#: Distinct terms that a task counts before it writes them out.
FLUSH = 400_000

#: Bytes of terms: letters in lower case, and everything beyond ASCII; all else separates.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", every: bool = False) -> DataFrame:
    """lang, source, digest, n, docs, term: one row per group and term of a task, or more where it holds many.

    A term that several groups of a task hold is spelt out once and null in the other rows, unless `every` is set.
    """
    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pd.DataFrame]:
            spelt: set[bytes] = set()
            for (lang, source), (n, docs_) in found.items():
                known = list(n)
                if known:
                    digest = np.fromiter(map(xxh3_64_intdigest, known), np.uint64, len(known)).view(np.int64)
                    text = [None if t in spelt else t.decode("utf-8", "replace") for t in known]
                    if not every:
                        spelt.update(known)
                    size = len(known)
                    yield pd.DataFrame({"lang": lang, "source": source, "digest": digest, "n": np.fromiter(n.values(), np.int64, size),
                                        "docs": np.fromiter(map(docs_.__getitem__, known), np.int64, size), "term": text})
            found.clear()

        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
                n, docs_ = found.setdefault((lang, source), (Counter(), Counter()))
                words = terms(text)
                n.update(words)
                docs_.update(set(words))
            if sum(len(n) for n, _ in found.values()) > FLUSH:
                yield from out()
        yield from out()

    return docs.select(*read).mapInPandas(run, "lang string, source string, digest long, n long, docs long, term string")


def split_collisions(parts: DataFrame, spelt: Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(parts with column `sub`, the strings as digest, sub, term): terms that share a digest get different `sub`, all others zero.

    spelt() gives the parts with every term, counted once more; it is called only where a digest is shared.
    """
    ends = staged(parts.where("term IS NOT NULL").groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last")))
    clash = ends.where(F.col("term") != F.col("last")).select("digest")
    numbers = parts.select("lang", "source", "digest", "n", "docs")
    if clash.isEmpty():
        return numbers.withColumn("sub", F.lit(0)), ends.select("digest", F.lit(0).alias("sub"), "term")
    shared = staged(spelt().join(clash, "digest", "left_semi"))
    known = shared.select("digest", "term").distinct()
    ranked = staged(known.withColumn("sub", F.row_number().over(Window.partitionBy("digest").orderBy("term"))))
    strings = ends.where(F.col("term") == F.col("last")).select("digest", F.lit(0).alias("sub"), "term").union(ranked.select("digest", "sub", "term"))
    plain = numbers.join(clash, "digest", "left_anti").withColumn("sub", F.lit(0))
    return plain.unionByName(shared.join(ranked, ["digest", "term"]).drop("term")), strings


def share(count: Column, total: Column, kept: Column) -> Column:
    """p as a long: 1 + floor(UNIT * (count + 1) / (total + kept)), exact for any count."""
    whole = (F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(27,0)"))
    return F.lit(1).cast("long") + F.call_function("div", whole, (total + kept).cast("decimal(28,0)"))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of longs; p and q are at most UNIT + 1, so the square fits a long."""
    d = (p - q).cast("long")
    return F.call_function("div", d * d, q.cast("long"))


def floor_div(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def pair_sums(lists: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, item, value: the sums over all kept terms, by blocks of terms and parts of sources; absent terms have their least share.

    lists: lang, source, total, kept of every group; kept: lang, source, digest, sub, count with count > 0.
    """
    filled = kept.groupBy("lang").agg(F.count("*").alias("cells"))
    zero = F.lit(0).cast("long")
    plan = lists.groupBy("lang").agg(F.count("*").alias("sources")).join(filled, "lang", "left")
    plan = staged(plan.select("lang", F.greatest(F.lit(1), F.ceil(F.coalesce("cells", zero) / BLOCK)).cast("long").alias("blocks"),
                              F.ceil(F.col("sources") / PART).cast("long").alias("parts")))
    upto = lambda c: F.explode(F.sequence(zero, F.col(c) - 1))
    cells = kept.join(plan, "lang").withColumn("block", F.pmod(F.xxhash64("digest", "sub"), "blocks")).withColumn("part", upto("parts")).drop("blocks", "parts")
    groups = lists.join(plan, "lang").withColumn("mine", F.pmod(F.xxhash64("source"), "parts")).withColumn("block", upto("blocks")).withColumn("part", upto("parts")).drop("blocks", "parts")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("source", kind="stable")
        names, asks = right["source"].to_numpy(), np.flatnonzero(right["mine"] == right["part"])
        bottom = [int(t) + int(k) for t, k in zip(right["total"], right["kept"], strict=True)]
        least = np.array([1 + UNIT // max(b, 1) for b in bottom], np.int64)
        code = pd.factorize(pd.MultiIndex.from_frame(left[["digest", "sub"]]))[0] if len(left) else np.zeros(0, int)
        owner = left["source"].map({s: n for n, s in enumerate(names)}).to_numpy(dtype=int)
        p = np.array([1 + UNIT * (int(c) + 1) // bottom[o] for c, o in zip(left["count"], owner, strict=True)], np.int64)
        order = np.argsort(code, kind="stable")
        code, owner, p = code[order], owner[order], p[order]
        n_terms = int(code[-1]) + 1 if len(code) else 0
        total = np.zeros((len(asks), len(names)), np.int64)
        step = max(1, CELLS // max(1, len(names)))
        for lo in range(0, n_terms, step):
            a, b = np.searchsorted(code, [lo, lo + step])
            dense = np.repeat(least[:, None], min(step, n_terms - lo), axis=1)
            dense[owner[a:b], code[a:b] - lo] = p[a:b]
            for n, s in enumerate(asks):
                total[n] += floor_div(dense[s][None, :], dense).sum(axis=1)
        s, t = np.nonzero(asks[:, None] != np.arange(len(names))[None, :])
        return pd.DataFrame({"lang": right["lang"].iloc[0] if len(right) else "", "source": names[asks[s]], "item": names[t], "value": total[s, t]})

    key = ["lang", "block", "part"]
    sums = cells.groupBy(*key).cogroup(groups.groupBy(*key)).applyInPandas(compare, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank; see the module."""
    parts = staged(counted(docs, text_col, lang_col, source_col))
    spelt = lambda: counted(docs, text_col, lang_col, source_col, every=True)
    listed = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    split, strings = split_collisions(parts, spelt)
    by_group = staged(split.groupBy("lang", "source", "digest", "sub").agg(F.sum("n").alias("count"), F.sum("docs").alias("docs")))
    whole = by_group.groupBy("lang", "digest", "sub").agg(F.sum("count").alias("whole"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    kept = staged(by_group.drop("docs").join(whole, ["lang", "digest", "sub"]))
    sizes = whole.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("everything"))
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    zero = F.lit(0).cast("long")
    lists = listed.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    lists = staged(lists.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("kept", zero).alias("kept"), F.coalesce("everything", zero).alias("everything")))
    pair = pair_sums(lists.drop("everything"), kept.select("lang", "source", "digest", "sub", "count"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    p, q = share(F.col("count"), F.col("total"), F.col("kept")), share(F.col("whole"), F.col("everything"), F.col("kept"))
    scored = kept.join(lists, ["lang", "source"]).select("lang", "source", "digest", "sub", p.alias("p"), q.alias("q")).where(F.col("p") > F.col("q"))
    scored = scored.select("lang", "source", "digest", "sub", divergence(F.col("p"), F.col("q")).alias("value"))
    ranked = F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))  # ties at the end are all kept until their strings decide
    first = scored.withColumn("rank", ranked).where(F.col("rank") <= top).drop("rank")
    term = first.join(strings.withColumnRenamed("term", "item"), ["digest", "sub"])
    term = term.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank")).where(F.col("rank") <= top)
    return pair.union(term)


def op13(docs: DataFrame) -> DataFrame:
    return audit(docs)


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (
  SELECT k, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
w AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN w USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM w GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(l.v, 0) AS v, (SELECT coalesce(sum(c.n), 0) FROM c WHERE c.lang = g.lang AND c.source = g.source) AS total
      FROM g LEFT JOIN l USING (lang)),
p AS MATERIALIZED (
  SELECT w.lang, s.source, w.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000 * CAST(coalesce(c.n, 0) + 1 AS HUGEINT)) // (s.total + s.v) AS HUGEINT) AS p,
         CAST(1 + (1000000000 * CAST(w.n + 1 AS HUGEINT)) // (l.total + l.v) AS HUGEINT) AS q
  FROM w JOIN l USING (lang) JOIN s USING (lang) LEFT JOIN c ON c.lang = w.lang AND c.source = s.source AND c.term = w.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 200
"""
