"""Quality rules: a threshold table compiled into one projection.

DataFrame and SQL functions only, no shuffle. Each text is measured by array
functions within its row (counts of words, symbols, lines, repeated windows,
stop words); every threshold compares whole numbers, so that verdicts are
exact. Work is a sort of a text's windows: n log n in its words.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import table

SPACE = "[ \\t-\\r]+"
WINDOW = 3
#: Bits of a window's number that hold its place; the others hold its hash.
PLACE_BITS = 26
# Frequent function words by language, as they stand inside a sentence.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by are this at from "
    "de la le et les en des un du une que est pour par dans avec qui pas sur "
    "der die und den von zu das sich mit auf für ist im nicht dem ein eine "
    "el y los las se del por con no una su para es al lo"
)
_STOP = tuple(sorted(set(STOP_WORDS.split())))


class Rule(NamedTuple):
    """Fails a text where ``left * top`` is ``more`` (or ``less``) than ``right * of``, both counts by name."""

    name: str
    left: int
    top: str
    fails_if: str
    right: int
    of: str


#: The contract's base.
BASE = (
    Rule("few_words", 1, "n_words", "less", 50, "one"),
    Rule("repeated_windows", 100, "n_repeat_words", "more", 50, "n_words"),
)
#: The table of thresholds: length, symbol, stop-word and line ratios.
RULES = (
    Rule("short_words", 1, "word_chars", "less", 2, "n_words"),
    Rule("long_words", 1, "word_chars", "more", 12, "n_words"),
    Rule("symbols", 10, "n_symbols", "more", 1, "n_words"),
    Rule("stop_words", 50, "n_stop_words", "less", 1, "n_words"),
    Rule("repeated_lines", 100, "n_dup_lines", "more", 40, "n_lines"),
)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once a row however often the body names it.

    Plain columns would be inlined into array functions when a filter on the
    result is pushed down, and evaluated once an element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(marks: Column) -> Column:
    """Words that windows at the ascending places ``marks`` cover."""
    steps = F.zip_with(marks, F.slice(marks, 2, F.greatest(F.size(marks), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def _by_words(w: Column) -> Column:
    """Places of windows that occur twice or more: windows sorted, equal ones side by side."""
    words = [f"w{k}" for k in range(WINDOW)]

    def marks(s: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            return F.coalesce(reduce(lambda p, q: p & q, [F.get(s, k)[n] == x[n] for n in words]), F.lit(False))

        return F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

    window = lambda i: F.struct(*[F.get(w, i + k).alias(n) for k, n in enumerate(words)], i.alias("i"))
    return _let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), window)), marks)


def _repeat_words(w: Column) -> Column:
    """Words of ``w`` in windows that occur twice or more.

    A window is one number, bits of its hash above its place, so that sorting
    puts equal windows side by side. If any two neighbours of one hash hold
    different words, or places do not fit, the words themselves are sorted.
    """
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    at = lambda i: [F.get(w, i + k) for k in range(WINDOW)]
    number = lambda i: F.shiftleft(F.xxhash64(*at(i)), PLACE_BITS).bitwiseOR(i.cast("long"))

    def of_sorted(s: Column) -> Column:
        near = lambda x, k: F.coalesce(F.shiftright(x.bitwiseXOR(F.get(s, k)), PLACE_BITS) == 0, F.lit(False))
        return F.struct(F.filter(s, lambda x, k: near(x, k + 1)).alias("a"), F.filter(s, lambda x, k: near(x, k - 1)).alias("b"))

    def of_couples(p: Column) -> Column:
        differ = lambda x, y: reduce(lambda u, v: u | v, [m != n for m, n in zip(at(place(x)), at(place(y)))])
        clash = F.exists(F.zip_with(p["a"], p["b"], differ), lambda x: x)
        places = F.transform(F.array_union(p["a"], p["b"]), place)
        return _let(F.sort_array(F.when(clash | (F.size(w) >= 1 << PLACE_BITS), _by_words(w)).otherwise(places)), _covered)

    numbers = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), number))
    return F.when(F.size(w) > WINDOW, _let(_let(numbers, of_sorted), of_couples)).otherwise(F.lit(0).cast("long"))


def failures(m: Column, rules) -> Column:
    """Names of the rules that the measures ``m`` fail, in the table's order."""

    def fails(r: Rule) -> Column:
        a, b = m[r.top] * r.left, (F.lit(1) if r.of == "one" else m[r.of]) * r.right
        return a > b if r.fails_if == "more" else a < b

    return F.filter(F.array(*[F.when(fails(r), r.name) for r in rules]), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_stop_words of a text, all long."""
    words, lines = F.array_remove(F.split(text, SPACE), ""), F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))

    def of(w: Column, x: Column) -> Column:
        counts = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": symbols,
            "n_dup_lines": F.size(x) - F.size(F.array_distinct(x)),
            "n_repeat_words": _repeat_words(w),
            "n_lines": F.size(x),
            "n_stop_words": F.size(F.filter(w, lambda v: v.isin(*_STOP))),
        }
        return F.struct(*[c.cast("long").alias(n) for n, c in counts.items()])

    return _let(words, lambda w: _let(lines, lambda x: of(w, x)))


def judge(docs: DataFrame, rules=RULES, base=BASE) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and ``failed`` (names of failed rules, comma-joined) for each row of ``docs(doc_id, text)``.

    A row is kept if it fails no rule of ``base`` nor of ``rules``. A null text
    counts as empty and fails for its few words; each row is judged by its own
    text, so repeated rows and null ids keep their rows; an empty table gives
    none, further columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    verdict = _let(measures(text), lambda m: F.struct(m.alias("m"), failures(m, base).alias("base"), failures(m, rules).alias("rules")))
    v = F.col("v")
    first, last = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), ("n_lines", "n_stop_words")
    return docs.select("doc_id", verdict.alias("v")).select(
        "doc_id",
        *[v["m"][n].alias(n) for n in first],
        (F.size(v["base"]) > 0).alias("base_failed"),
        ((F.size(v["base"]) == 0) & (F.size(v["rules"]) == 0)).alias("kept"),
        F.concat_ws(",", v["base"], v["rules"]).alias("failed"),
        *[v["m"][n].alias(n) for n in last],
    )


def op11(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _failed_sql(r: Rule) -> str:
    of = "1" if r.of == "one" else r.of
    return f"CASE WHEN {r.left} * {r.top} {'>' if r.fails_if == 'more' else '<'} {r.right} * {of} THEN '{r.name}' END"


_STOP_SQL = ", ".join(f"'{w}'" for w in _STOP)
_FAILED_SQL = ["list_filter([" + ", ".join(map(_failed_sql, t)) + "], lambda x: x IS NOT NULL)" for t in (BASE, RULES)]
#: The same from windows as rows, grouped by document and window.
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
sp AS (SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k:k + 2])) AS g FROM sp),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  len(list_filter(w, lambda x: x IN ({_STOP_SQL}))) AS n_stop_words, coalesce(n_repeat_words, 0) AS n_repeat_words FROM sp LEFT JOIN rep USING (rid)),
v AS (SELECT *, {_FAILED_SQL[0]} AS b, {_FAILED_SQL[1]} AS r FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, len(b) > 0 AS base_failed, len(b) = 0 AND len(r) = 0 AS kept,
  array_to_string(list_concat(b, r), ',') AS failed, n_lines, n_stop_words FROM v
"""
