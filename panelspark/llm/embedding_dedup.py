"""Near-duplicate embeddings by product quantisation.

Vectors are scaled to unit length and equal ones are one representative. A
coarse quantiser deals representatives to inverted lists; the residual's
subspaces are coded with small codebooks and every row keeps the error of its
own code. Two bounds say where a link can hide:

* A vector of list c lies on c's side of the plane halfway between c and the
  query's own centroid, so a query needs list c only if that plane is no farther
  than the threshold times the cosine of the angle at which the link crosses it.
  Of two vectors the one with the lower list visits the other: a pair meets once.
* A table distance strays from the true one by the indexed row's coding error at
  most, and by less the more upright that error stands on the link.

``angle`` bounds both cosines. At 1 the search is exact for any vectors and any
codebooks, and visits many lists; the default is ANGLE standard deviations of
the cosine between directions drawn from the sample's covariance (so that few
strong components widen the search), which finds over 0.99 of pairs planted at
cosines of 0.9005 to 0.93 and more of closer ones. What both bounds leave is
ranked again by the exact cosine in double precision. Codebooks are fitted on a
bounded sample (MAX_TRAIN rows by hash), and lists grow with the square root of
the rows up to its size; every row is indexed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import components, cut, discard, table

COSINE = 0.9
MAX_TRAIN = 16_384
SUBSPACES, CODES = 8, 64
#: Rows on each side of a task's comparison; longer lists are cut into such tiles.
TILE = 2_048
ANGLE = 2.4
SEED = 7
#: Slack of the bounds, far above rounding and far below any step of a distance that matters.
SLACK = 1e-7


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])


def spread(sample: np.ndarray) -> float:
    """Standard deviation of the cosine between two directions drawn from the sample's covariance: 1 over the root of its effective dimension."""
    c = np.cov(sample, rowvar=False, bias=True).reshape(sample.shape[1], -1)
    total = float(np.trace(c))
    return float(np.sqrt((c * c).sum())) / total if total > 1e-12 else 1.0


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Codebooks:
    """Coarse centroids and residual codebooks: arrays whose size does not depend on the input's."""

    def __init__(self, sample: np.ndarray, n_lists: int):
        rng = np.random.default_rng(SEED)
        self.spread = spread(sample)
        self.coarse = np.unique(_kmeans(sample, n_lists, rng), axis=0)
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.books = [_kmeans(rest[:, p], CODES, rng) for p in self.parts]

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and the length of what each code leaves."""
        code = np.stack([_nearest(np.ascontiguousarray(rest[:, p]), b) for p, b in zip(self.parts, self.books)], axis=1).astype(np.uint8)
        left = rest - np.hstack([b[code[:, j]] for j, b in enumerate(self.books)])
        return code, np.sqrt((left * left).sum(1))

    def visits(self, x: np.ndarray, home: np.ndarray, limit: float) -> list[np.ndarray]:
        """The lists after its own that may hold a vector within ``limit`` of each row."""
        half = (self.coarse * self.coarse).sum(1) / 2
        out = []
        for i in range(0, len(x), 1024):
            own = home[i : i + 1024]
            far = half - x[i : i + 1024] @ self.coarse.T
            apart = 2 * (half[own][:, None] + half - self.coarse[own] @ self.coarse.T)
            gap = (far - far[np.arange(len(own)), own][:, None]) / np.sqrt(np.maximum(apart, 1e-300))
            near = (gap <= limit + SLACK) & (np.arange(len(half)) > own[:, None])
            out += [np.flatnonzero(row).astype(np.int32) for row in near]
        return out

    def table_distances(self, x: np.ndarray, which: int, code: np.ndarray) -> np.ndarray:
        """Distances, queries by indexed rows, from one lookup table per query."""
        rest = x - self.coarse[which]
        out = np.zeros((len(x), len(code)))
        for j, (p, b) in enumerate(zip(self.parts, self.books)):
            q = rest[:, p]
            out += ((q**2).sum(1)[:, None] - 2 * q @ b.T + (b**2).sum(1)[None])[:, code[:, j]]
        return np.sqrt(np.maximum(out, 0))


def keyed(vectors: DataFrame) -> DataFrame:
    """``(vec_id, e, k1, k2)``: 128 bits that stand for the unit vector, null where nothing can link.

    Null, empty and zero vectors and those with a null or non-finite component
    have no direction.
    """
    v = F.col("embedding").cast("array<double>")
    big = F.array_max(F.transform(v, F.abs))
    ok = F.coalesce(
        (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (big > 0), F.lit(False)
    )
    # scaling by the largest component first keeps squares in range
    scaled = F.when(ok, F.transform(v, lambda x: x / big))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"), scaled.alias("s"))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    out = out.withColumn("norm", norm).withColumn("u", F.transform("s", lambda x: x / F.col("norm")))
    key = lambda *c: F.when(F.col("u").isNotNull(), F.xxhash64(*c, "u"))
    return out.select("vec_id", "e", key().alias("k1"), key(F.lit(1)).alias("k2"))


def units(x: np.ndarray) -> np.ndarray:
    """Rows in double precision at unit length."""
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of as few of the pairs as connect the same ids."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    keep = []
    for n, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        i, j = root(i), root(j)
        if i != j:
            up[j] = i
            keep.append(n)
    return np.array(keep, dtype=int)


def fit(mine: DataFrame, n: int, lists: int | None = None) -> Codebooks:
    """Codebooks from at most about MAX_TRAIN of the ``n`` rows, by a hash of the vector."""
    share = min(1.0, MAX_TRAIN / n)
    taken = mine.where(F.pmod(F.xxhash64("v", F.lit(SEED)), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("v").orderBy("v")
    sample = _matrix(taken.toArrow().column("v").combine_chunks())
    if not len(sample):  # a share that no hash falls in
        sample = _matrix(mine.select(F.min("v").alias("v")).toArrow().column("v").combine_chunks())
    return Codebooks(units(sample), min(lists or int(np.ceil(np.sqrt(n) / 2)), len(sample)))


def links(reps: DataFrame, cosine: float = COSINE, lists: int | None = None, angle: float | None = None) -> DataFrame:
    """Links of representatives ``reps(id, n, v)``: ``(a, b, more)``.

    Rows with ``b`` are links that connect all that is linked; the others say
    that ``a`` has ``more`` links, each partner counted ``n`` times. Vectors of
    different lengths never meet. A list is cut into tiles by a hash, so a list
    of any size is many tasks, each holding two tiles; a task passes on no more
    rows than it holds, however dense its links are.
    """
    spark = reps.sparkSession
    kind = np.float32 if reps.schema["v"].dataType.elementType.typeName() == "float" else np.float64
    reps = reps if kind is np.float32 else reps.withColumn("v", F.col("v").cast("array<double>"))
    parts = []
    for row in reps.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect():
        mine, limit = reps.where(F.size("v") == row.d), float(np.sqrt(2 - 2 * cosine))
        book = fit(mine, row.n, lists)
        share = min(1.0, ANGLE * book.spread) if angle is None else angle

        def deal(batches):
            for b in batches:
                raw = _matrix(b.column("v"))
                if not len(raw):
                    continue
                x = units(raw)
                home = _nearest(x, book.coarse)
                code, error = book.encode(x - book.coarse[home])
                visits = book.visits(x, home, limit * share)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id"), b.column("n"), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(home, pa.int32()),
                        pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error), pa.array(visits, pa.list_(pa.int32())),
                    ],
                    names=["id", "n", "v", "list", "code", "error", "visits"],
                )

        kinds = "id long, n long, v binary, list int, code binary, error double, visits array<int>"
        dealt = cut(mine.select("id", "n", "v").mapInArrow(deal, kinds))
        asked = dealt.select(F.explode(F.concat(F.array("list"), "visits")).alias("list")).groupBy("list").agg(F.count("*").alias("q"))
        held = dealt.groupBy("list").agg(F.count("*").alias("i"))
        tiles = lambda c: F.ceil(F.col(c) / TILE).cast("int")
        # lists number at most MAX_TRAIN, so this is small whatever the input
        shape = F.broadcast(cut(held.join(asked, "list").select("list", tiles("i").alias("i_tiles"), tiles("q").alias("q_tiles"))))
        tile = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = dealt.join(shape, "list").withColumns({"t": tile("i_tiles", 1), "k": tile("q_tiles", 2)})
        # the same row both as one indexed and as a query where its two tiles meet
        index = own.withColumn("k2", upto("q_tiles")).select("list", F.col("t").alias("tile"), F.col("k2").alias("q_tile"), "id", "n", "v", "code", "error", (F.col("k") == F.col("k2")).alias("asks"))
        none = [F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error"), F.lit(True).alias("asks")]
        again = own.where("i_tiles > 1").withColumn("t2", upto("i_tiles")).where("t2 <> t").select("list", F.col("t2").alias("tile"), F.col("k").alias("q_tile"), "id", "n", "v", *none)
        guests = dealt.select("id", "n", "v", F.explode("visits").alias("list")).join(shape, "list").withColumn("k", tile("q_tiles", 2))
        guests = guests.withColumn("t2", upto("i_tiles")).select("list", F.col("t2").alias("tile"), F.col("k").alias("q_tile"), "id", "n", "v", *none, F.lit(1).alias("guest"))
        members = index.withColumn("guest", F.lit(0)).union(again.withColumn("guest", F.lit(0))).union(guests)

        def search(pdf):
            listed, asks = pdf[pdf.code.notna()], pdf[pdf.asks]
            nothing = pd.DataFrame({"a": [], "b": [], "more": []}).astype("Int64")
            if not len(listed) or not len(asks):
                return nothing
            y = units(np.frombuffer(b"".join(listed.v), kind).reshape(len(listed), -1))
            code = np.frombuffer(b"".join(listed.code), dtype=np.uint8).reshape(len(listed), -1)
            error, y_id, y_n = listed.error.to_numpy(), listed.id.to_numpy(), listed.n.to_numpy()
            reach = np.sqrt(limit**2 + error**2 + 2 * limit * error * share) + SLACK
            x_id, x_n, guest = asks.id.to_numpy(), asks.n.to_numpy(), asks.guest.to_numpy() == 1
            raw = asks.v.to_numpy()
            ids, place = np.unique(np.concatenate([y_id, x_id]), return_inverse=True)
            y_at, x_at, more, found = place[: len(y_id)], place[len(y_id) :], np.zeros(len(ids), np.int64), []
            for s in range(0, len(raw), 256):
                x = units(np.frombuffer(b"".join(raw[s : s + 256]), kind).reshape(-1, y.shape[1]))
                near = book.table_distances(x, int(pdf["list"].iloc[0]), code) <= reach
                # in its own list a row comes as indexed and as query: the lesser id is the indexed one
                near &= guest[s : s + 256, None] | (y_id[None] < x_id[s : s + 256, None])
                q, i = np.nonzero(near)
                sure = np.concatenate([(x[q[k : k + 65536]] * y[i[k : k + 65536]]).sum(1) for k in range(0, len(q), 65536)] or [np.zeros(0)]) >= cosine
                q, i = q[sure] + s, i[sure]
                np.add.at(more, x_at[q], y_n[i])
                np.add.at(more, y_at[i], x_n[q])
                keep = _forest(x_id[q], y_id[i])
                found.append((x_id[q[keep]], y_id[i[keep]]))
            a, b = (np.concatenate(c) for c in zip(*found))
            keep = _forest(a, b)
            has = np.flatnonzero(more)
            links, counts = len(keep), len(has)
            column = lambda x, gone: pd.arrays.IntegerArray(x.astype(np.int64), gone)
            blank = np.repeat([False, True], [links, counts])
            return pd.DataFrame({
                "a": np.concatenate([a[keep], ids[has]]),
                "b": column(np.concatenate([b[keep], np.zeros(counts)]), blank),
                "more": column(np.concatenate([np.zeros(links), more[has]]), ~blank),
            })

        parts.append(cut(members.groupBy("list", "tile", "q_tile").applyInPandas(search, "a long, b long, more long")))
        discard(dealt)
    out = spark.createDataFrame([], "a long, b long, more long")
    for part in parts:
        out = out.union(part)
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, lists: int | None = None, angle: float | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors(vec_id, embedding)``.

    Equal unit vectors link with each other but are one vertex of the search.
    Rows without a direction have no link and are their own component. Rows
    with a null or repeated vec_id are rows like any other: component_id is the
    least id that is not null, null if all are, and a row is kept if its id
    equals that, null or not. An empty table gives none and labels or other
    columns are ignored. ``lists`` sets the number of inverted lists and
    ``angle=1.0`` makes the search exact.
    """
    rows = cut(keyed(vectors))
    reps = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.min("e").alias("v"))
    # written before use, so that every later step sees the same numbers
    reps = cut(reps.withColumn("id", F.monotonically_increasing_id()))
    found = links(reps.select("id", "n", "v"), cosine, lists, angle)
    degree = found.where("more is not null").groupBy(F.col("a").alias("id")).agg(F.sum("more").alias("more"))
    groups = components(found.where("b is not null").select("a", "b"))
    joined = cut(reps.drop("v").join(degree, "id", "left").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id")))
    first = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(first, "component").select("k1", "k2", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = rows.drop("e").where("k1 is not null").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: The same by brute force over all pairs.
OP10_SQL = f"""
WITH RECURSIVE raw AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
vec AS (SELECT vec_id, e, len(e) AS d, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM raw
        WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM vec x JOIN vec y ON x.vec_id <> y.vec_id AND x.d = y.d
        WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= {COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM raw UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM raw JOIN least ON vec_id = least.a LEFT JOIN degree ON vec_id = degree.a
"""
