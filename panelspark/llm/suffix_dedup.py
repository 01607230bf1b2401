"""Repeated substrings by a distributed difference-cover suffix sort.

Every 100-byte string that also starts earlier is removed. Sorting all
suffixes of all texts is not needed for that, and two exact steps come first:

* Each 100-byte string elects an anchor, the least of its 32-byte hashes, so
  equal strings share an anchor. An anchor that occurs once holds no repeat.
* The bytes that strings with one anchor can reach are its context. Where
  whole contexts are equal, all but the first are repeats as a whole.

What is left, distinct contexts that share an anchor, is dealt by anchor; each
task sorts the suffixes of its contexts by the difference-cover algorithm
(sort the sampled triples, recurse on their names, merge the remaining
suffixes) and compares adjacent suffixes for a common prefix of 100 bytes.
Where more than BIG contexts share an anchor, as at the ends of a passage that
many rows hold, no task could sort them together: their 100-byte strings are
grouped by a 128-bit hash instead, and the least place of each is the first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import cut, table

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # how far before its anchor a string may start
#: Most contexts of one anchor that a task sorts together.
BIG = 1_000
#: Bytes that a task sorts at once.
CHUNK = 1 << 18
NO_ID = -(1 << 63)
_TABLE = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of every GRAM-byte string, from hashes of halves."""
    h, n = _TABLE[x], 1
    while n < GRAM:
        right = h[n:]
        h = (h[:-n] * _ODD) ^ (right + (right >> np.uint64(29)))
        h ^= h >> np.uint64(32)
        n *= 2
    return h * _ODD


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    s = 1
    while s * 2 <= width:
        x = pick(x[:-s], x[s:])
        s *= 2
    return pick(x[: len(x) - (width - s)], x[width - s :])


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text of LENGTH bytes or more.

    A place is an anchor if its hash is the least in some string that covers
    it; that depends on the string's bytes alone.
    """
    h = gram_hashes(np.frombuffer(raw, np.uint8))
    width = REACH + 1
    least = _slide(h, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero(h == most)
    return at, h[at]


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    p = np.concatenate([s, np.zeros(3, np.int64)])
    m = n + (n % 3 == 1)  # a stop triple ends the first part of the recursion's string
    one, two = np.arange(1, m, 3), np.arange(2, n, 3)
    p = np.concatenate([p, np.zeros(1, np.int64)])
    sample = np.concatenate([one, two])
    base = int(s.max()) + 1
    key = (p[sample] * base + p[sample + 1]) * base + p[sample + 2] if base < 2_000_000 else None
    if key is None:
        _, dense = np.unique(p, return_inverse=True)
        base = int(dense.max()) + 1
        key = (dense[sample] * base + dense[sample + 1]) * base + dense[sample + 2]
    names, inverse = np.unique(key, return_inverse=True)
    if len(names) < len(sample):
        order = suffix_order(inverse.astype(np.int64) + 1)
        rank_in = np.empty(len(sample), np.int64)
        rank_in[order] = np.arange(1, len(sample) + 1)
    else:
        rank_in = inverse.astype(np.int64) + 1
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = rank_in
    # sampled suffixes in order; the stop triple, if there is one, is the least
    by_rank = np.empty(len(sample), np.int64)
    by_rank[rank_in - 1] = sample
    by_rank = by_rank[by_rank < n]
    among = np.arange(len(by_rank))
    is_one = by_rank % 3 == 1
    one, two = by_rank[is_one], by_rank[~is_one]
    # the rest, in order: by first symbol, then by the rank of what follows it
    rest = one - 1
    if n % 3 == 1:
        rest = np.concatenate([[n - 1], rest])
    first = p[rest]
    rest = rest[np.argsort(first.astype(np.uint16) if base < 65536 else first, kind="stable")]
    wide, base = len(sample) + 2, int(p.max()) + 1
    if base * base * wide >= 1 << 62:
        _, p = np.unique(p, return_inverse=True)
        base = int(p.max()) + 1
    by_one = lambda i: p[i] * wide + rank[i + 1]
    by_two = lambda i: (p[i] * base + p[i + 1]) * wide + rank[i + 2]
    rest_one, rest_two, key_one, key_two = by_one(rest), by_two(rest), by_one(one), by_two(two)
    out = np.empty(n, np.int64)
    out[np.arange(len(rest)) + np.searchsorted(key_one, rest_one) + np.searchsorted(key_two, rest_two)] = rest
    out[among[is_one] + np.searchsorted(rest_one, key_one)] = one
    out[among[~is_one] + np.searchsorted(rest_two, key_two)] = two
    return out


def _text_key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")


def find_anchors(docs: DataFrame) -> DataFrame:
    """``(key, ctx, did, th, at, dup)``: an anchor's hash, its context's hash and place.

    Within a batch, contexts equal to an earlier one are marked at once and
    get a key of their own, so a passage that many rows share does not gather.
    """

    def run(batches):
        for b in batches:
            key, ctx, did, th, at = [], [], [], [], []
            for d, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = t.encode("utf-8", "surrogatepass")
                if len(raw) < LENGTH:
                    continue
                a, k = anchors(raw)
                key.append(k)
                at.append(a)
                did.append(np.full(len(a), d))
                th.append(np.full(len(a), h))
                digest = xxhash.xxh3_64_intdigest
                ctx.append(np.array([digest(raw[max(0, p - REACH) : p + LENGTH], min(p, REACH)) for p in a.tolist()], np.uint64))
            if not key:
                continue
            key, ctx, did, th, at = map(np.concatenate, (key, ctx, did, th, at))
            order = np.lexsort([at, th, did, ctx, key])
            alike = lambda x: x[order[1:]] == x[order[:-1]]
            # rows of one doc_id and text are one document: its places come once
            same = np.append(False, alike(at) & alike(th) & alike(did) & alike(ctx) & alike(key))
            order = order[~same]
            key, ctx, did, th, at = (x[order] for x in (key, ctx, did, th, at))
            dup = np.append(False, (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1]))
            key = np.where(dup, ctx ^ (did.astype(np.uint64) * _ODD) ^ (at.astype(np.uint64) * _TABLE[1]), key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(did), pa.array(th), pa.array(at.astype(np.int32)), pa.array(dup)],
                names=["key", "ctx", "did", "th", "at", "dup"],
            )

    did, text = _text_key()
    return docs.select(did, F.xxhash64(text).alias("th"), text).mapInArrow(run, "key long, ctx long, did long, th long, at int, dup boolean")


def suspects(docs: DataFrame) -> DataFrame:
    """Anchors whose context is a later copy (``dup``) or shares its anchor with others.

    A row of the same document, text and place is not a copy but the same place again.
    """
    a = find_anchors(docs)
    # marked rows keep out of their key's groups
    group = Window.partitionBy("key", "dup")
    inner = group.orderBy("ctx", "did", "th", "at")
    place = F.struct("did", "th", "at")
    return (
        a.withColumn("copy", (F.lag("ctx").over(inner) == F.col("ctx")) & (F.lag(place).over(inner) != place))
        .withColumn("copy", F.coalesce("copy", F.lit(False)))
        .withColumn("mixed", F.min("ctx").over(group) != F.max("ctx").over(group))
        .withColumn("n", F.count("*").over(group))
        .where(F.col("dup") | F.col("copy") | F.col("mixed"))
        .select("key", "did", "th", "at", (F.col("dup") | F.col("copy")).alias("dup"), (F.col("n") > BIG).alias("big"))
    )


def _contexts(pairs: DataFrame) -> DataFrame:
    """``(key, did, th, start, ctx binary)`` of each anchor of ``pairs(did, th, text, marks)``."""

    def run(batches):
        for b in batches:
            rows = []
            for d, h, t, marks in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw = t.encode("utf-8", "surrogatepass")
                for m in marks:
                    p, start = m["at"], max(0, m["at"] - REACH)
                    c = raw[start : p + LENGTH]
                    rows.append((m["key"], d, h, start, c))
            key, d, h, s, c = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(d, pa.int64()), pa.array(h, pa.int64()), pa.array(s, pa.int32()), pa.array(c, pa.binary())],
                names=["key", "did", "th", "start", "ctx"],
            )

    return pairs.mapInArrow(run, "key long, did long, th long, start int, ctx binary")


def repeats_of_common(pairs: DataFrame) -> DataFrame:
    """``(did, th, lo, hi)``: strings about the anchors of ``pairs(did, th, text, marks)`` that also start earlier.

    Grouped minima, joined back: a string of any number of rows is no group of
    rows, only a key that the join may split.
    """

    def run(batches):
        for b in batches:
            h1, h2, did, th, at = [], [], [], [], []
            for d, h, t, marks in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw = t.encode("utf-8", "surrogatepass")
                places = {s for m in marks for s in range(max(0, m["at"] - REACH), min(m["at"], len(raw) - LENGTH) + 1)}
                digests = b"".join(xxhash.xxh3_128_digest(raw[s : s + LENGTH]) for s in places)
                pair = np.frombuffer(digests, "<i8").reshape(-1, 2)
                h1.append(pair[:, 0])
                h2.append(pair[:, 1])
                did += [d] * len(places)
                th += [h] * len(places)
                at += places
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cat(h1)), pa.array(cat(h2)), pa.array(did, pa.int64()), pa.array(th, pa.int64()), pa.array(at, pa.int32())], names=["h1", "h2", "did", "th", "at"]
            )

    strings = cut(pairs.mapInArrow(run, "h1 long, h2 long, did long, th long, at int"))
    place = F.struct("did", "th", "at")
    first = strings.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = strings.join(first, ["h1", "h2"]).where(place != F.col("first"))
    return later.select("did", "th", F.col("at").alias("lo"), (F.col("at") + LENGTH).alias("hi"))


def sort_contexts(contexts: DataFrame) -> DataFrame:
    """``(did, th, from, to)``: starts of repeated strings found among contexts of one key."""

    def run(batches):
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if size >= CHUNK and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    def solve(rows):
        key, did, th, start, ctx = zip(*rows)
        keys, inverse, n = np.unique(np.array(key), return_inverse=True, return_counts=True)
        use = np.flatnonzero(n[inverse] > 1)
        out: tuple = ([], [], [], [])
        if len(use):
            did, th, start = np.array(did)[use], np.array(th)[use], np.array(start, np.int64)[use]
            texts = [ctx[i] for i in use]
            order = np.lexsort([start, th, did])
            doc = np.zeros(len(use), np.int64)
            doc[order[1:]] = np.cumsum((did[order[1:]] != did[order[:-1]]) | (th[order[1:]] != th[order[:-1]]))
            # precedence is by place in the document, so contexts are numbered by document and shifted to it
            size = np.array([len(t) for t in texts])
            begin = np.cumsum(size + 1) - size - 1
            hits = np.sort(repeats_at(texts, doc, start))
            text = np.searchsorted(begin, hits, side="right") - 1
            at = start[text] + hits - begin[text]
            edge = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(text) != 0)]) if len(hits) else np.zeros(0, bool)
            a = np.flatnonzero(edge)
            z = np.append(a[1:], len(hits)) - 1
            out = (did[text[a]], th[text[a]], at[a], at[z] + LENGTH) if len(a) else out
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["did", "th", "lo", "hi"]
        )

    dealt = contexts.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "did long, th long, lo int, hi int")


def repeats_at(texts: list[bytes], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places in ``b'\\0'.join(texts)`` that start a LENGTH-byte string found earlier.

    Text i lies at ``start[i]`` of document number ``doc[i]``; contexts of one document overlap: one string reached through two of them
    is no repeat of itself.
    """
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"\0".join(texts), np.uint8).astype(np.int64) + 1
    begin = np.cumsum(size + 1) - size - 1
    order = suffix_order(data)
    text = np.searchsorted(begin, order, side="right") - 1
    keep = order - begin[text] <= size[text] - LENGTH
    order, text = order[keep], text[keep]
    if len(order) < 2:
        return np.zeros(0, np.int64)
    a, b = order[:-1], order[1:]
    same = np.arange(len(a))
    words = (data - 1).astype(np.uint64)
    for n in (1, 2, 4):  # eight bytes from every place on
        words = words[:-n] << np.uint64(8 * n) | words[n:]
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        same = same[words[a[same] + k] == words[b[same] + k]]
    joined = np.zeros(len(order), bool)
    joined[same + 1] = True
    group = np.cumsum(~joined) - 1
    place = start[text] + order - begin[text]
    rank = doc[text] * (int(place.max()) + 1) + place
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, rank)
    return order[rank > least[group]]


def dedup(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for each row of ``docs(doc_id, text)``.

    Null texts are empty; texts under 100 bytes keep all. Rows that repeat a
    doc_id are ordered by a hash of their text, and if that is equal too they
    are one document and get the same result; a null doc_id comes before all
    others. An empty table gives none and further columns are ignored.
    """
    found = cut(suspects(docs))
    of_text = lambda df: df.groupBy("did", "th").agg(F.collect_set(F.struct("key", "at")).alias("marks"))
    marks, common = of_text(found.where("not dup and not big")), of_text(found.where("not dup and big"))
    did, text = _text_key()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), did, text).withColumn("th", F.xxhash64("text"))
    # the joins deal the texts alike, so that one shuffle serves them
    marked = lambda m: rows.join(m, ["did", "th"]).select("did", "th", "text", "marks", "doc_id")
    sorted_spans = sort_contexts(_contexts(marked(marks)))
    if not found.where("not dup and big").isEmpty():
        sorted_spans = sorted_spans.union(repeats_of_common(marked(common)))
    copies = found.where("dup").select("did", "th", F.greatest(F.col("at") - REACH, F.lit(0)).alias("lo"), (F.col("at") + LENGTH).alias("hi"))
    spans = copies.union(sorted_spans).groupBy("did", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    def run(batches):
        for b in batches:
            out = [strip(t, s) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            cols = list(zip(*out)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = rows.join(spans, ["did", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip(text: str, spans) -> tuple[int, int, int, str]:
    """Size, removed bytes, maximal runs and digest of what is left."""
    raw = text.encode("utf-8", "surrogatepass")
    runs: list[list[int]] = []
    for lo, hi in sorted((s["lo"], min(s["hi"], len(raw))) for s in spans or ()):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    kept, at = hashlib.sha256(), 0
    for lo, hi in runs:
        kept.update(raw[at:lo])
        at = hi
    kept.update(raw[at:])
    return len(raw), sum(hi - lo for lo, hi in runs), len(runs), kept.hexdigest()


def op3(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


#: The same from every 100-byte string of every text; doc_ids must differ.
OP3_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
place AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {LENGTH - 1})) AS p FROM d),
win AS (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, {2 * LENGTH})) AS s FROM place),
later AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
edge AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > {LENGTH}, true) AS new FROM later),
run AS (SELECT doc_id, p, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM edge),
span AS (SELECT doc_id, min(p) AS lo, max(p) + {LENGTH} AS hi FROM run GROUP BY doc_id, k),
kept AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS was FROM span),
cutout AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS stop, string_agg(substr(x, 2 * was + 1, 2 * (lo - was)), '' ORDER BY lo) AS head
           FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cutout USING (doc_id)
"""
