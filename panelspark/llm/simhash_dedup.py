"""Near-duplicate documents by SimHash fingerprints.

A fingerprint has eight bytes, so two fingerprints that differ in at most two
bits share at least six (position, byte) entries: that is the minimum match
count. The inverted index is keyed by combinations of positional bytes: the
eight positions form four couples, two differing bits touch at most two of
them, and so two fingerprints within the radius share at least one of the six
postings made of two whole couples (32 bits). Each candidate pair's shared
positional bytes are tallied, pairs under six shared bytes are dropped and the
rest are verified by their exact Hamming distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import components, cut, discard

RADIUS = 2
MIN_BYTES = 8 - RADIUS
COUPLES = 4
SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the ``width``-word shingles of ``text``; zero without words.

    A-Z is lower-cased and words are split at ASCII white space; a text with
    fewer words than ``width`` has its whole word sequence as one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    start = [0, *ends[: n - 1].tolist()]
    stop = (ends[len(words) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[i:j], SEED) for i, j in zip(start, stop)], dtype=">u8")
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 4096):
        votes += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp long)`` of every row; null and blank texts have fp 0."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _byte(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255))


def _couple(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(65535))


def links(fps: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ids in ``fps(id, fp)``, fp distinct, within the radius."""
    posting = F.array(*[
        F.struct(
            F.lit(k).alias("slot"),
            F.shiftleft(_couple(F.col("fp"), i), 16).bitwiseOR(_couple(F.col("fp"), j)).alias("part"),
        )
        for k, (i, j) in enumerate(combinations(range(COUPLES), 2))
    ])
    index = cut(fps.select("id", "fp", F.explode(posting).alias("p")).select("id", "fp", "p.slot", "p.part"))
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    shared = sum((_byte(x, i) == 0).cast("int") for i in range(8))
    found = (
        index.alias("l")
        .join(
            index.alias("r"),
            (F.col("l.slot") == F.col("r.slot"))
            & (F.col("l.part") == F.col("r.part"))
            & (F.col("l.id") < F.col("r.id"))
            & (shared >= MIN_BYTES)
            & (F.bit_count(x) <= RADIUS),
        )
        .select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    )
    out = cut(found.distinct())
    discard(index)
    return out


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs(doc_id, text)``.

    Equal fingerprints are one vertex, so copies add no pairs. Null, empty and
    blank texts all have fingerprint zero and link like any other; rows with a
    null or repeated doc_id each keep their row and link by their own text.
    component_id is the least doc_id that is not null, null if all are. An
    empty table gives an empty result; further columns of ``docs`` are ignored.
    """
    rows = cut(fingerprints(docs, width))
    reps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(reps.select(F.col("fp").alias("id"), "fp"))
    groups = components(edges).withColumnRenamed("id", "fp")
    joined = cut(reps.join(groups, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    first = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(joined.join(first, "component").select("fp", "component_id"))
    discard(edges, reps, joined)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: one row of each group of five-word Jaccard 0.8 or more.

    The contract's 64 bits and radius of 2 are op9's alone: texts of that
    similarity often differ in more, so the stage takes SimHash fingerprints of
    768 bits, counts shared positional bytes, checks the Hamming distance with
    a radius to match and verifies what is within it.
    """
    from panelspark.llm import jaccard_dedup

    return jaccard_dedup.keep_one(docs)


def op9(spark, sf_dir: str) -> DataFrame:
    from panelspark.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
