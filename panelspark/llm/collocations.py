"""Phrase collocation mining: count-min sketches, then exact counts of survivors.

Pass 1 adds the n-grams of every task into two rows of sketch cells; Spark
merges the cells by block. A cell's sum is at least the count of each n-gram in
it, so an n-gram with a cell under the least count is infrequent for certain.
Pass 2 counts exactly whatever both rows let through and keeps what is
frequent, so nothing frequent is lost and nothing infrequent stays. The
survivors of both passes are scored by their least likely cut, and phrases
that live mostly inside a longer one are dropped.

The sketch has a cell for every 16 bytes of text, up to MAX_CELLS a row; only
its bits (is the cell frequent?) are broadcast, 64 MB at most. Beyond some 4 GB
of text it lets more through and the exact pass shuffles more; results stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import BROADCAST_BYTES, cut, discard, table

MIN_COUNT, MAX_WORDS, TOP, SUBSUMED = 10, 3, 2_000, 50
MAX_CELLS, BLOCK = 1 << 28, 1 << 16
#: Text that a task holds as words at once; under 2 ** 21 different words fit into it.
CHUNK_BYTES = 4 << 20
SALTS = 8
#: A-Z lower-cased, tabs as spaces, and what ends a piece as a full stop.
_PLAIN = bytes(46 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class _Ids(dict):
    """Numbers words as they come; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _slices(text: bytes):
    """``(text, words)`` parts of a text, spaced, the first ``words`` of each repeated from the part before."""
    text = text.translate(_PLAIN).replace(b".", b" . ")
    at, carry = 0, []
    while len(text) - at > CHUNK_BYTES:
        end = text.rfind(b" ", at, at + CHUNK_BYTES)
        end = end if end >= at else text.find(b" ", at + CHUNK_BYTES)
        if end < 0:
            break
        part = b" ".join([*carry, text[at:end]])
        yield part, len(carry)
        carry, at = part.split()[-(MAX_WORDS - 1) :], end + 1
    yield b" ".join([*carry, text[at:]]), len(carry)


def _chunks(batches):
    """``(lang, text, words)``: texts of a language together, long texts in slices."""
    held, size = {}, {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for part, again in _slices(text):
                if again:
                    yield lang, part, again
                    continue
                if size.get(lang, 0) + len(part) > CHUNK_BYTES and size[lang]:
                    yield lang, b" . ".join(held[lang]), 0
                    held[lang], size[lang] = [], 0
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part) + 3
    for lang, parts in held.items():
        if parts:
            yield lang, b" . ".join(parts), 0


def _grams(text: bytes, again: int):
    """Words by number, and ``(ids, counts)`` of the distinct n-grams of each length that end after ``again`` words."""
    words = text.split()
    ids = _Ids({b".": 0})
    at = np.fromiter(map(ids.__getitem__, words), np.int64, count=len(words))
    v, found = len(ids), []
    for k in range(1, MAX_WORDS + 1):
        n = max(0, len(at) - k + 1)
        key, whole = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(k):
            key = key * v + at[j : j + n]
            whole &= at[j : j + n] > 0
        whole[: max(0, again - k + 1)] = False
        key, counts = np.unique(key[whole], return_counts=True)
        parts = []
        for _ in range(k):
            key, last = np.divmod(key, v)
            parts.append(last)
        found.append((parts[::-1], counts))
    return list(ids), found


def _hashes(lang: str, words: list[bytes], parts: list[np.ndarray], of_words: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), len(parts)), np.uint64)
    for odd, part in zip(_ODD, parts):
        h = (h ^ of_words[part]) * odd
        h ^= h >> np.uint64(32)
    return h


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, count=len(words))


def _cells(h: np.ndarray, cells: int):
    """The cell of each hash in both rows."""
    mask = np.uint64(cells - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _blobs(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    offsets = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def sketch(texts: DataFrame, cells: int, least: int = MIN_COUNT) -> DataFrame:
    """``(row, block, bits)``: which cells of a block of the merged sketch hold ``least`` or more."""

    def add(batches):
        for lang, text, again in _chunks(batches):
            words, found = _grams(text, again)
            of_words = _word_hashes(words)
            h = np.concatenate([_hashes(lang, words, parts, of_words) for parts, _ in found])
            n = np.concatenate([counts for _, counts in found])
            if not len(h):
                continue
            for row, at in enumerate(_cells(h, cells)):
                order = np.argsort(at)
                at = at[order]
                first = np.flatnonzero(np.diff(at, prepend=-1))
                total = np.minimum(np.add.reduceat(n[order], first), 255).astype(np.uint8)
                at = at[first]
                block = at // BLOCK
                starts = np.flatnonzero(np.diff(block, prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts), row, np.int32)), pa.array(block[starts].astype(np.int32)), _blobs((at % BLOCK).astype(np.uint16), starts), _blobs(total, starts)],
                    names=["row", "block", "at", "n"],
                )

    def merge(batches):
        now, sums = None, None
        bits = lambda: pa.RecordBatch.from_pydict({"row": pa.array([now[0]], pa.int32()), "block": pa.array([now[1]], pa.int32()), "bits": [np.packbits(sums >= least).tobytes()]})
        for b in batches:
            for row, block, at, n in zip(*(c.to_pylist() for c in b.columns)):
                if now != (row, block):
                    if now:
                        yield bits()
                    now, sums = (row, block), np.zeros(BLOCK, np.uint8)
                at = np.frombuffer(at, np.uint16)
                sums[at] = np.minimum(sums[at].astype(np.uint16) + np.frombuffer(n, np.uint8), 255)
        if now:
            yield bits()

    parts = texts.mapInArrow(add, "row int, block int, at binary, n binary")
    return parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(merge, "row int, block int, bits binary")


def frequent(docs: DataFrame, least: int = MIN_COUNT, max_cells: int = MAX_CELLS) -> DataFrame:
    """``(lang, k, phrase, f)`` of all n-grams of 1 to MAX_WORDS words with f >= ``least``; k = 0 counts a language's words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(max(BLOCK, 1 << (max(1, size // 16) - 1).bit_length()), max_cells)
    merged = cut(sketch(texts, cells, least))
    rows = np.zeros((2, cells // 8), np.uint8)
    for row, block, bits in merged.toLocalIterator():
        rows[row, block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(bits, np.uint8)
    discard(merged)
    kept = spark.sparkContext.broadcast(rows)

    def survivors(batches):
        rows = kept.value

        def passes(h):
            both = np.ones(len(h), bool)
            for row, at in enumerate(_cells(h, cells)):
                both &= (rows[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            return np.flatnonzero(both)

        for lang, text, again in _chunks(batches):
            words, found = _grams(text, again)
            of_words, spelled = _word_hashes(words), pa.array(words, pa.binary())
            for k, (parts, counts) in enumerate(found, 1):
                good = passes(_hashes(lang, words, parts, of_words))
                phrase = pc.binary_join_element_wise(*[spelled.take(pa.array(p[good])) for p in parts], b" ") if k > 1 else spelled.take(pa.array(parts[0][good]))
                yield _counts(lang, k, phrase.cast(pa.string()), counts[good])
            yield _counts(lang, 0, pa.array([""]), found[0][1].sum(keepdims=True))

    counted = texts.mapInArrow(survivors, "lang string, k int, phrase string, f long").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    return counted.where((F.col("f") >= least) | (F.col("k") == 0))


def _counts(lang: str, k: int, phrase: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array(np.full(len(f), k, np.int32)), phrase, pa.array(f.astype(np.int64))], names=["lang", "k", "phrase", "f"])


def _with_count(c: DataFrame, counts: DataFrame, n: int, key: Column, name: str) -> DataFrame:
    """``c`` with the count of ``key``, null if it has none; a hot key (the word that starts a third of all phrases) is salted."""
    counts = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_key"), F.col("f").alias(name))
    on = (F.col("lang") == F.col("_lang")) & (key == F.col("_key"))
    if n * 128 <= BROADCAST_BYTES:
        return c.join(F.broadcast(counts), on, "left").drop("_lang", "_key")
    counts = counts.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    c = c.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    return c.join(counts, on & (F.col("_salt") == F.col("_copy")), "left").drop("_lang", "_key", "_copy", "_salt")


def _score(left: str, right: str) -> Column:
    big = lambda c: F.col(c).cast("decimal(18,0)")
    return F.call_function("div", big("a") * big("a") * F.lit(1_000_000).cast("decimal(7,0)"), big(left) * big(right))


def mine(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, subsumed: int = SUBSUMED, max_cells: int = MAX_CELLS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language of ``docs(lang, text)``.

    A phrase of two or three words scores by its least cut; one of which
    ``subsumed`` percent or more lies in one longer candidate is dropped. Null
    texts count as empty, null lang as ``und``; every row counts, also repeated
    ones, texts of any length are read in slices, an empty table gives none and
    further columns are ignored.
    """
    found = cut(frequent(docs, least, max_cells))
    sizes = dict(found.groupBy("k").count().collect())  # four rows
    of = lambda k: found.where(F.col("k") == k).select("lang", "phrase", "f")
    word = lambda i: F.split("phrase", " ").getItem(i)
    pair = lambda i: F.concat_ws(" ", word(i), word(i + 1))
    longer = of(3).withColumnRenamed("f", "a")
    within = longer.select("lang", F.explode(F.array(pair(0), pair(1))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    two = of(2).withColumnRenamed("f", "a").join(within, ["lang", "phrase"], "left").where(f"longest IS NULL OR 100 * longest < {subsumed} * a").drop("longest")
    words, pairs, n1, n2 = of(1), of(2), sizes.get(1, 0), sizes.get(2, 0)
    two = _with_count(_with_count(two, words, n1, word(0), "l"), words, n1, word(1), "r").withColumn("score", _score("l", "r"))
    three = _with_count(_with_count(longer, words, n1, word(0), "l1"), pairs, n2, pair(1), "r1")
    three = _with_count(_with_count(three, pairs, n2, pair(0), "l2"), words, n1, word(2), "r2")
    three = three.withColumns({"s1": _score("l1", "r1"), "s2": _score("l2", "r2")})
    pick = lambda c: F.when(F.col("s1") <= F.col("s2"), F.col(c + "1")).otherwise(F.col(c + "2"))
    three = three.select("lang", "phrase", "a", pick("l").alias("l"), pick("r").alias("r"), pick("s").alias("score"))
    scored = two.unionByName(three)
    # first the best of each salted part of a language, then the best of those: no task sorts a whole language
    parts = max(1, int(((sizes.get(2, 0) + sizes.get(3, 0)) / top) ** 0.5))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase", "a"), F.lit(parts))).orderBy(*order)
    best = scored.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= top).drop("_r")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    totals = of(0).select("lang", F.col("f").alias("n"))  # one row a language
    out = cut(best.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    discard(found)
    return out


def op13(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


#: The same from every n-gram, with lists of words.
OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= {MIN_COUNT}),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.k, c.phrase, c.f AS a, i, l.f AS l, r.f AS r, (1000000 * c.f * c.f) // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:i], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[i + 1:], ' ')),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inside AS (SELECT lang, phrase, max(f) AS longest FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY 1, 2),
kept AS (SELECT least.* FROM least LEFT JOIN inside USING (lang, phrase) WHERE k = 3 OR longest IS NULL OR 100 * longest < {SUBSUMED} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= {TOP}
"""
