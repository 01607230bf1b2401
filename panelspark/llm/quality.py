"""Quality scores: random Fourier features, ridge regression, isotonic scale.

Each text becomes a short vector of statistics. Random cosines of the
standardised vector approximate a Gaussian kernel; every partition sums its
share of the normal equations, the driver adds a fixed number of such sums and
solves the ridge system. A calibration part of the labelled rows, binned by
raw score, gives the monotone map from raw scores to [0, 1].
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import arrow_rows, cut, discard, lean, small, table

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "letter", "digit", "space", "upper", "stop", "comma", "symbol", "bar",
    "same_next", "distinct", "top_word", "log_lines", "distinct_lines", "line_words", "wordless", "long_word", "entropy",
)
N_COSINES, SEED, RIDGE = 256, 7, 1e-3
#: Bound of the labelled rows that a fit uses; the sums are taken in TRAIN_PARTS tasks.
MAX_TRAIN, TRAIN_PARTS = 100_000, 8
#: Rows that the filter passes to Python at once.
BATCH = 1_000
THRESHOLD = 0.7


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_UPPER = _mask(bytes(range(65, 91)))
_LETTER = _UPPER + _mask(bytes(range(97, 123))) + _mask(bytes(range(128, 256)))
_DIGIT, _SPACE = _mask(b"0123456789"), _mask(b" \t\n\r\x0b\x0c")
_STOP, _COMMA, _BAR = _mask(b".!?"), _mask(b",;:"), _mask(b"|")
_SYMBOL = 1 - np.clip(_LETTER + _DIGIT + _SPACE + _STOP + _COMMA, 0, 1)
_CLASSES = np.stack([_LETTER, _DIGIT, _SPACE, _UPPER, _STOP, _COMMA, _SYMBOL, _BAR], axis=1)


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a whole text; null and blank texts give zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    letter, digit, space, upper, stop, comma, symbol, bar = hist @ _CLASSES / len(raw)
    share = hist[hist > 0] / len(raw)
    n, kinds = len(words), set(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    codes = dict(zip(kinds, range(len(kinds))))
    top = np.bincount(np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=n)).max()
    lines = raw.split(b"\n")
    per = n / len(raw)
    return [
        np.log1p(len(raw)), np.log1p(n), sizes.mean(), letter, digit, space, upper, stop / per, comma / per, symbol / per, bar / per,
        sum(map(eq, words, words[1:])) / n, len(kinds) / np.sqrt(n), top / n, np.log1p(len(lines)), len(set(lines)) / len(lines),
        np.log1p(n / len(lines)), float(len(raw.translate(None, _LETTERS).split()) / n), float((sizes > 24).mean()), float(-(share * np.log(share)).sum()),
    ]


_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))


def features(docs: DataFrame, keep=()) -> DataFrame:
    """``(doc_id, x array<double>)`` of every row of ``docs(doc_id, text)``; long columns ``keep`` pass."""

    def run(batches):
        for b in batches:
            x = pa.array([statistics(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x, *b.columns[2:]], names=["doc_id", "x", *keep])

    fields = "doc_id long, x array<double>" + "".join(f", {c} long" for c in keep)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep).mapInArrow(lean(run), fields)


def held_out():
    """The rows a fit never sees: crc32 of the id's digits leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Fitted cosines, ridge weights and isotonic knots: plain arrays of fixed size."""

    def __init__(self, mean, scale, beta, knots, values):
        rng = np.random.default_rng(SEED)
        k = len(FEATURES)
        self.mean, self.scale, self.beta, self.knots, self.values = mean, scale, beta, knots, values
        self.w = rng.standard_normal((k, N_COSINES)) / np.sqrt(k)
        self.b = rng.uniform(0, 2 * np.pi, N_COSINES)

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b
        return np.hstack([np.sqrt(2 / N_COSINES) * np.cos(z), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.knots is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted ``x``; centres and values of the blocks."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top)]
    return np.array([a / w for a, _, w in blocks]), np.array([b / w for _, b, w in blocks])


def fit(feats: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on the labelled rows of ``feats`` that are not held out.

    ``max_train`` bounds the rows used: beyond it a hash of the doc_id decides
    which stay. Null labels are dropped, a doc_id labelled twice takes the
    larger label. Without any label every score is 0.5.
    """
    label = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    rows = feats.where(~held_out()).join(label, "doc_id")
    total = label.where(~held_out()).count()
    share = min(1.0, max_train / max(total, 1))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    train = cut(rows.withColumn("part", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).repartition(TRAIN_PARTS))
    k = len(FEATURES)
    sums = train.where("part <> 1").agg(
        F.count("*"), *[f(F.col("x")[i]) for i in range(k) for f in (F.avg, F.stddev_pop)]
    ).first()
    zero = Model(np.zeros(k), np.ones(k), np.zeros(N_COSINES + 1), None, None)
    if not sums[0]:
        return zero
    mean, scale = np.array(sums[1::2], float), np.array(sums[2::2], float)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), zero.beta, None, None)

    def partial(batches):
        size = N_COSINES + 1
        gram, right = np.zeros((size, size)), np.zeros(size)
        for b in batches:
            z = model.cosines(_matrix(b.column(0)))
            gram += z.T @ z
            right += z.T @ b.column(1).to_numpy()
        yield pa.RecordBatch.from_pydict({"gram": [gram.tobytes()], "right": [right.tobytes()]})

    gram, right = np.zeros((N_COSINES + 1,) * 2), np.zeros(N_COSINES + 1)
    for g, r in train.where("part <> 1").select("x", "y").mapInArrow(lean(partial), "gram binary, right binary").collect():
        gram += np.frombuffer(g).reshape(gram.shape)
        right += np.frombuffer(r)
    beta = np.linalg.solve(gram + RIDGE * sums[0] / N_COSINES * np.eye(N_COSINES + 1), right)
    model = Model(model.mean, model.scale, beta, None, None)

    def raw(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(b.column(0)))), b.column(1)], names=["raw", "y"])

    # at most 3001 bins of raw scores, whatever the input
    bins = (
        train.where("part = 1").select("x", "y").mapInArrow(lean(raw), "raw double, y double")
        .groupBy(F.round(F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) * 1000).cast("int").alias("bin"))
        .agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n"))
        .collect()
    )
    discard(train)
    if not bins:
        return Model(model.mean, model.scale, beta, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    x, y, n = (np.array(v, float) for v in zip(*sorted((b.raw, b.y, b.n) for b in bins)))
    knots, values = isotonic(x, y, n)
    # ends keep a slope, so that no two raw scores beyond a block are forced to tie
    knots = np.concatenate([[knots[0] - 1.0], knots, [knots[-1] + 1.0]])
    values = np.concatenate([[0.0], np.clip(values, 0.001, 0.999), [1.0]])
    return Model(model.mean, model.scale, beta, knots, values)


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, keep=()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``; long columns ``keep`` pass.

    Null and empty texts are scored from zero statistics, repeated rows each
    keep their row, a null doc_id is never held out, empty tables give no rows
    and columns other than doc_id and text never enter a score.
    """
    feats = cut(features(docs, keep))
    model = fit(feats, labels, max_train)

    def run(batches):
        for b in batches:
            s = model.score(_matrix(b.column(1))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), *b.columns[2:]], names=["doc_id", "score", *keep])

    return feats.mapInArrow(lean(run), "doc_id long, score double" + "".join(f", {c} long" for c in keep)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *keep
    )


@arrow_rows(BATCH)
def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, columns as given.

    Each row is judged by its own text: repeated and null doc_ids change
    nothing, equal texts are judged alike and an empty table gives none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    scored = score(docs.select("doc_id", "text", keys[0].alias("k1"), keys[1].alias("k2")), labels, keep=["k1", "k2"])
    bad = cut(scored.where("predicted = 0").select(F.col("k1").alias("_bad1"), F.col("k2").alias("_bad2")).distinct())
    return docs.join(small(bad, 64), (keys[0] == bad["_bad1"]) & (keys[1] == bad["_bad2"]), "left_anti")


def op1(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
