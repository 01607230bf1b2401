"""Source divergence audit: joint count histograms of term counts.

How far apart two sources of a language are is a sum over all kept terms of a
function of the term's two counts. Terms with equal counts give equal values,
so each pair of sources tallies its distinct (count, count) combinations and
the function is evaluated once a combination, times its terms. Only cells of
two positive counts are tallied from the terms; cells with a zero are implied
by the sources' own histograms and the number of terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import cut, discard, small, table

MIN_DOCS, TOP = 10, 10
SCALE, PRIOR = 1_000_000_000, 2
#: Distinct (lang, source, term) that a task holds before it passes their counts on.
HELD_TERMS = 200_000
#: ASCII letters and all bytes of other characters make terms.
_TERM = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def term_counts(docs: DataFrame, held: int = HELD_TERMS) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term and documents with it, summed over all rows."""

    def run(batches):
        seen, within, size = defaultdict(Counter), defaultdict(Counter), 0

        def flush():
            for (lang, source), counts in seen.items():
                terms = list(counts)
                docs = within[lang, source]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(terms), pa.string()),
                    "source": pa.array([source] * len(terms), pa.string()),
                    "term": pa.array([t.decode("utf-8", "surrogatepass") for t in terms], pa.string()),
                    "n": pa.array(counts.values(), pa.int64()),
                    "docs": pa.array([docs[t] for t in terms], pa.int64()),
                })

        for b in batches:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                terms = text.lower().translate(_TERM).split()
                counts = seen[lang, source]
                size -= len(counts)
                counts.update(terms)
                within[lang, source].update(set(terms))
                size += len(counts)
                if size > held:
                    yield from flush()
                    seen.clear(), within.clear()
                    size = 0
        yield from flush()

    counted = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term, in whole parts of SCALE; decimals hold the product."""
    top = F.lit(SCALE).cast("decimal(18,0)") * (count + PRIOR).cast("decimal(19,0)")
    return F.call_function("div", top, (total + terms * 2).cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every group of ``docs(lang, source, text)``.

    Part ``pair`` ranks the language's other sources by their distance from the
    group, part ``term`` the group's ``top`` over-represented terms. Nulls of
    text, lang and source count as ''; a language without kept terms has
    distances 0 and no terms, one source alone has no pairs. Each row is a
    document, also repeated ones; an empty table gives none, further columns
    are ignored.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = cut(term_counts(docs))
    by_term = Window.partitionBy("lang", "term")  # as many rows as the language has sources
    kept = cut(
        counts.withColumns({"df": F.sum("docs").over(by_term), "total": F.sum("n").over(by_term)})
        .where(F.col("df") >= min_docs)
        .select("lang", "source", "term", "n", "total")
    )
    # one row a language, one a group: tables of names and totals
    langs = kept.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("lang_n"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = cut(groups.fillna(0, ["group_n", "v", "lang_n"]))
    n_groups = groups.count()
    known = small(groups, 256, n_groups)

    a, b = groups.select("lang", F.col("source").alias("a"), F.col("group_n").alias("an"), "v"), groups.select("lang", F.col("source").alias("b"), F.col("group_n").alias("bn"))
    pairs = cut(a.join(small(b, 256, n_groups), "lang").where("a < b"))  # asked for: every pair of a language's sources
    histogram = kept.groupBy("lang", "source", F.col("n").alias("x")).agg(F.count("*").alias("m"))

    def couples(own: str, other: str) -> DataFrame:
        """A source's own histogram beside each partner."""
        return pairs.select("lang", F.col(own).alias("source"), F.col(other).alias("other")).join(histogram, ["lang", "source"])

    cell = lambda x, y, m: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), m.cast("long").alias("m"))
    zero, x, y, m = F.lit(0), F.col("x"), F.col("y"), F.col("m")
    one, two = kept.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("x")), kept.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("y"))
    joint = one.join(two, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "x", "y").agg(F.count("*").alias("m"))
    cells = [
        joint.select("lang", "a", "b", F.inline(F.array(cell(x, y, m), cell(x, zero, -m), cell(zero, y, -m), cell(zero, zero, m)))),
        couples("a", "b").select("lang", F.col("source").alias("a"), F.col("other").alias("b"), F.inline(F.array(cell(x, zero, m), cell(zero, zero, -m)))),
        couples("b", "a").select("lang", F.col("other").alias("a"), F.col("source").alias("b"), F.inline(F.array(cell(zero, x, m), cell(zero, zero, -m)))),
        pairs.select("lang", "a", "b", zero.cast("long").alias("x"), zero.cast("long").alias("y"), F.col("v").alias("m")),
    ]
    tally = cells[0]
    for c in cells[1:]:
        tally = tally.unionByName(c)
    tally = tally.groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m")).where("m > 0")
    p, q = share(x, F.col("an"), F.col("v")), share(y, F.col("bn"), F.col("v"))
    far = tally.join(small(pairs, 256), ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(distance(p, q) * m).alias("value"))
    far = pairs.select("lang", "a", "b").join(far, ["lang", "a", "b"], "left").fillna(0, ["value"])
    both = far.select("lang", F.inline(F.array(*[F.struct(F.col(s).alias("source"), F.col(t).alias("item"), F.col("value").alias("value")) for s, t in (("a", "b"), ("b", "a"))])))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    p, q = share(F.col("n"), F.col("group_n"), F.col("v")), share(F.col("total"), F.col("lang_n"), F.col("v"))
    terms = kept.join(known, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value")).withColumn("rank", rank).where(F.col("rank") <= top)
    out = cut(
        both.withColumn("rank", rank).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
        .unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
    )
    discard(counts, kept, groups, pairs)
    return out


def op12(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: The same from every kept term of every group, zeros written out.
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
vocab AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM occ GROUP BY 1, 2 HAVING count(DISTINCT rid) >= {MIN_DOCS}),
ln AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS lang_n FROM vocab GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM occ JOIN vocab USING (lang, term) GROUP BY 1, 2, 3),
full_c AS (SELECT g.lang, g.source, vocab.term, total, CAST(coalesce(n, 0) AS HUGEINT) AS n, v, lang_n FROM g JOIN vocab USING (lang) JOIN ln USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT *, 1 + ({SCALE} * (n + {PRIOR})) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p, 1 + ({SCALE} * (total + {PRIOR})) // (lang_n + 2 * v) AS q FROM full_c),
pairs AS (SELECT x.lang, x.source, y.source AS item FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source),
far AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
a AS (SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM pairs LEFT JOIN far USING (lang, source, item)),
t AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM (SELECT * FROM a UNION ALL SELECT * FROM t) QUALIFY part = 'pair' OR rank <= {TOP}
"""
