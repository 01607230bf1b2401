"""Benchmark decontamination with DataFrame and SQL functions only.

Documents and items become word shingles (five words; an item with fewer words
is one shingle of all its words). A shingle weighs the less the more items share
it, in whole millionths, so sums do not depend on their order. The similarity of
an item and a window of a document, as many shingles long, is the weight of the
item's shingles (with multiplicity) that the window holds, over the item's weight.

Every window counts, but only those that start at a shingle of an item of that
length, and the text's last one, need be laid: any other can slide to the right
until it starts at one, and loses none on the way. Steps:

1. What a whole text holds of an item bounds its windows from above; texts and
   item lengths beyond reach drop out.
2. The windows left get SimHash fingerprints, votes weighted like the shingles.
   Multi-index blocks look items up: fingerprints within RADIUS bits differ in
   at most RADIUS of BLOCKS > RADIUS blocks, so one block is equal.
3. Texts and items so found are verified by exact similarity over all windows.
4. No selective radius holds every pair of weighted similarity 0.8, so pairs
   that step 1 allows and step 2 did not find are verified in the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut, discard, small, table

WIDTH, SIMILARITY = 5, 0.8
#: Fingerprints: blocks of BITS // BLOCKS bits, and the radius within which none is missed.
BITS, BLOCKS, RADIUS = 64, 16, 15
#: Bound of a row of the tables that may be broadcast: all are of fixed width.
ROW_BYTES = 96
SCALE = 1_000_000
TEXT = ["k1", "k2"]


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def with_shingles(df: DataFrame, widths: list[int]) -> DataFrame:
    """``df(w)`` with an array of shingle hashes ``sh<width>`` for each width."""
    df = df.withColumn("hw", F.transform("w", lambda x: F.xxhash64(x)))
    # hw is read several times below, so the planner keeps it as a column of its own
    for n in widths:
        last = F.size("hw") - n
        at = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        sh = F.transform(at, _shingle_at(n))
        df = df.withColumn(f"sh{n}", F.when(last >= 0, sh).otherwise(F.array().cast("array<bigint>")))
    return df.drop("hw")


def _shingle_at(n: int):
    return lambda i: F.xxhash64(*[F.get("hw", i + k) for k in range(n)])


def text_key() -> list[Column]:
    """128 bits that stand for a text; null counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def votes(weight: str = "wt", h: str = "h") -> list[Column]:
    """Weighted votes of each bit of the hashes ``h``."""
    return [F.sum(F.expr(f"if(shiftright({h}, {b}) & 1L = 1L, {weight}, -{weight})")).alias(f"b{b}") for b in range(BITS)]


def fingerprint() -> Column:
    """The signs of ``votes`` as one long."""
    bits = [F.when(F.col(f"b{b}") > 0, F.expr(f"shiftleft(1L, {b})")).otherwise(F.lit(0).cast("long")) for b in range(BITS)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def blocks(fp: str) -> Column:
    """``(block, value)`` of every block of a fingerprint."""
    size = BITS // BLOCKS
    part = lambda b: F.shiftrightunsigned(F.col(fp), size * b).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
    return F.array(*[F.struct(F.lit(b).alias("block"), part(b).alias("value")) for b in range(BLOCKS)])


def items_of(benchmark: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Items ``(iid, item_id, width, n, total)`` and their shingles ``(iid, width, n, total, h, tf, wt)``."""
    base = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    base = cut(base.withColumn("iid", F.xxhash64("item_id", F.array_join("w", " "))).withColumn("width", F.least(F.size("w"), F.lit(width))))
    n_items = F.lit(float(max(1, base.count())))
    # an item of fewer words is one shingle of all of them
    parts = [
        with_shingles(base.where(F.col("width") == n), [n]).select("iid", "item_id", "width", F.explode(f"sh{n}").alias("h"))
        for n in range(1, width + 1)
    ]
    tf = cut(reduce(DataFrame.unionByName, parts).groupBy("iid", "item_id", "width", "h").agg(F.count("*").alias("tf")))
    weight = F.round(F.log1p(n_items / F.count("*")) * SCALE).cast("long")
    terms = tf.join(tf.groupBy("h").agg(weight.alias("wt")), "h")
    items = cut(terms.groupBy("iid", "item_id", "width").agg(F.sum("tf").cast("int").alias("n"), F.sum(F.col("tf") * F.col("wt")).alias("total")))
    terms = cut(items.drop("item_id").join(terms.select("iid", "h", "tf", "wt"), "iid"))
    discard(base, tf)
    return items, terms


def laid(places: DataFrame, key: list[str]) -> DataFrame:
    """The occurrences of every window: ``places(key, n, len, p, ..)`` with ``start``.

    ``p`` and ``start`` count shingles. Starts and places meet by cells of n
    shingles, so the work is proportional to the occurrences times n.
    """
    cell = lambda c: F.floor(F.col(c) / F.col("n"))
    last = F.greatest(F.col("len") - F.col("n"), F.lit(0))
    starts = places.select(*key, "n", F.least("p", last).alias("start")).distinct().withColumn("cell", cell("start")).drop("n")
    near = places.withColumn("cell", F.explode(F.array(cell("p"), cell("p") - 1)))
    return starts.join(near, [*key, "cell"]).where("p >= start and p < start + n")


def verified(pairs: DataFrame, places: DataFrame, terms: DataFrame, n_terms: int, similarity: float) -> DataFrame:
    """``(k1, k2, iid, similarity, start)``: the best window of each of ``pairs(k1, k2, iid)`` that has the similarity."""
    held = places.join(small(terms, ROW_BYTES, n_terms), ["h", "width"]).join(pairs, [*TEXT, "iid"], "left_semi")
    # an occurrence counts unless the tf-th one before it is in the window, too
    held = held.groupBy(*TEXT, "iid", "n", "len", "total", "h", "tf", "wt").agg(F.sort_array(F.collect_list("p")).alias("all"))
    one = F.transform("all", lambda p, i: F.struct(p.alias("p"), F.when(i >= F.col("tf"), F.get("all", i - F.col("tf").cast("int"))).otherwise(-1).alias("before")))
    held = cut(held.select(*TEXT, "iid", "n", "len", "total", "wt", F.explode(one).alias("o")).select("*", "o.p", "o.before").drop("o"))
    score = (
        laid(held, [*TEXT, "iid"]).groupBy(*TEXT, "iid", "total", "start")
        .agg(F.sum(F.when(F.col("before") < F.col("start"), F.col("wt")).otherwise(0)).alias("got"))
        # whole numbers on both sides but for the product
        .where(F.col("got") + 0.5 >= similarity * F.col("total"))
    )
    best = score.groupBy(*TEXT, "iid", "total").agg(F.max("got").alias("got"), F.max_by("start", F.struct("got", -F.col("start"))).alias("start"))
    return best.select(*TEXT, "iid", (F.col("got") / F.col("total")).alias("similarity"), F.col("start").cast("long").alias("start"))


def found_by_fingerprint(places: DataFrame, likely: DataFrame, items: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """``(k1, k2, iid)`` where a window's fingerprint is within RADIUS bits of an item's."""
    sizes = ["width", "n"]
    of_size = terms.select("h", *sizes, "wt").distinct()
    held = places.join(small(of_size, ROW_BYTES, n_terms), ["h", "width"]).join(likely.select(*TEXT, *sizes).distinct(), [*TEXT, *sizes], "left_semi")
    held = held.withColumn("size", F.col("n"))
    windows = laid(held, [*TEXT, "width", "size"]).groupBy(*TEXT, "width", F.col("size").alias("n"), "start").agg(*votes())
    windows = windows.select(*TEXT, *sizes, fingerprint().alias("fp")).distinct()
    prints = cut(terms.select("iid", *sizes, "h", (F.col("wt") * F.col("tf")).alias("wt")).groupBy("iid", *sizes).agg(*votes()).select("iid", *sizes, fingerprint().alias("ifp")))
    index = prints.select("*", F.explode(blocks("ifp")).alias("b")).select("iid", *sizes, "ifp", "b.*")
    asked = windows.select("*", F.explode(blocks("fp")).alias("b")).select(*TEXT, *sizes, "fp", "b.*")
    met = asked.join(small(index, ROW_BYTES, BLOCKS * items.count()), [*sizes, "block", "value"])
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select(*TEXT, "iid").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``(k1, k2, item_id, similarity, word_start, by_fingerprint)`` of each different text and item; see ``contaminated``."""
    items, terms = items_of(benchmark, width)
    widths = sorted(r[0] for r in items.select("width").distinct().collect()) or [width]
    n_terms = terms.count()
    arrays = [f"sh{n}" for n in widths]
    seeds = (
        with_shingles(docs.select(*text_key(), words(F.col("text")).alias("w")), widths)
        # explode() would filter on the array first and compute it within that filter again
        .select(*TEXT, F.explode_outer(F.concat(*arrays)).alias("h"))
        .join(small(terms, ROW_BYTES, n_terms), "h")
        .groupBy(*TEXT, "iid", "width", "n", "total", "h", "tf", "wt")
        .agg(F.count("*").alias("held"))
    )
    likely = cut(
        seeds.groupBy(*TEXT, "iid", "width", "n", "total")
        .agg(F.sum(F.col("wt") * F.least("held", "tf")).alias("most"))
        .where(F.col("most") + 0.5 >= similarity * F.col("total"))
        .select(*TEXT, "iid", "width", "n")
    )
    keys = cut(likely.select(*TEXT).distinct())
    picked = docs.select(*text_key(), F.col("text").cast("string").alias("text")).join(small(keys, ROW_BYTES), TEXT, "left_semi")
    picked = picked.groupBy(*TEXT).agg(F.first("text").alias("text")).select(*TEXT, words(F.col("text")).alias("w"))
    occurs = [
        with_shingles(picked, [n]).select(*TEXT, F.lit(n).alias("width"), F.size(f"sh{n}").alias("len"), F.posexplode_outer(f"sh{n}").alias("p", "h"))
        for n in widths
    ]
    places = cut(reduce(DataFrame.unionByName, occurs).join(small(terms.select("h", "width").distinct(), ROW_BYTES, n_terms), ["h", "width"]))
    near = cut(found_by_fingerprint(places, likely, items, terms, n_terms).join(likely.select(*TEXT, "iid"), [*TEXT, "iid"], "left_semi"))
    rest = cut(likely.select(*TEXT, "iid").join(near, [*TEXT, "iid"], "left_anti"))
    sure = verified(near, places, terms, n_terms, similarity).withColumn("by_fingerprint", F.lit(True))
    more = verified(rest, places, terms, n_terms, similarity).withColumn("by_fingerprint", F.lit(False))
    out = cut(sure.union(more).join(items.select("iid", "item_id"), "iid").select(*TEXT, "item_id", "similarity", F.col("start").alias("word_start"), "by_fingerprint"))
    discard(likely, keys, places, near, rest, items, terms)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, item_id, similarity, word_start, by_fingerprint)`` of each document that holds an item.

    One row per document id and item, with its best window, the earliest among
    equals. A null doc_id or item_id is a value like any other. Null, empty and
    word-free texts and items match nothing; repeated rows and ids give one row;
    empty tables give none; further columns are ignored. Whole texts are read,
    and no document, shingle or item is capped.
    """
    found = matches(docs, benchmark, width, similarity)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key()).join(found, TEXT)
    best = F.max_by(F.struct("word_start", "by_fingerprint"), F.struct("similarity", -F.col("word_start"))).alias("best")
    return rows.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), best).select("doc_id", "item_id", "similarity", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text holds no benchmark item, columns as given.

    The text alone decides: rows with null or repeated doc_ids are judged like
    any other, equal rows alike, and empty tables give or drop nothing.
    """
    bad = cut(matches(docs, benchmark).select(F.col("k1").alias("_bad1"), F.col("k2").alias("_bad2")).distinct())
    k1, k2 = text_key()
    return docs.join(small(bad, ROW_BYTES), (k1 == bad["_bad1"]) & (k2 == bad["_bad2"]), "left_anti")


def op8(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "word_start")


#: The same by brute force over the windows that hold a shingle of the item.
OP8_SQL = rf"""
WITH base AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
item AS (SELECT item_id, w, least(len(w), {WIDTH}) AS width, row_number() OVER () AS iid FROM base WHERE len(w) > 0),
ish AS (SELECT iid, item_id, width, len(w) - width + 1 AS n, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS h FROM item),
tf AS (SELECT iid, item_id, width, n, h, count(*) AS tf FROM ish GROUP BY ALL),
weight AS (SELECT h, CAST(round(ln(1 + (SELECT count(*) FROM item) / count(*)) * {SCALE}) AS BIGINT) AS wt FROM tf GROUP BY h),
term AS (SELECT tf.*, wt, sum(tf * wt) OVER (PARTITION BY iid) AS total FROM tf JOIN weight USING (h)),
txt AS (SELECT DISTINCT text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
dsh AS (SELECT text, width, len(w) - width + 1 AS len, unnest(range(0, len(w) - width + 1)) AS p, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS h
        FROM txt, (SELECT DISTINCT width FROM item) WHERE len(w) >= width),
occ AS (SELECT text, iid, item_id, n, len, total, tf, wt, p, h FROM dsh JOIN term USING (h, width)),
start AS (SELECT DISTINCT text, iid, least(p, greatest(len - n, 0)) AS s FROM occ),
held AS (SELECT text, iid, item_id, s, total, h, wt * least(tf, count(*)) AS got FROM start JOIN occ USING (text, iid) WHERE p >= s AND p < s + n GROUP BY text, iid, item_id, s, total, h, wt, tf),
win AS (SELECT text, item_id, s, sum(got) / total AS similarity FROM held GROUP BY text, iid, item_id, s, total HAVING sum(got) + 0.5 >= {SIMILARITY} * total),
hit AS (SELECT DISTINCT doc_id, item_id, s, similarity FROM win JOIN documents USING (text))
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_min(s, (-similarity, s)) AS BIGINT) AS word_start FROM hit GROUP BY doc_id, item_id
"""
