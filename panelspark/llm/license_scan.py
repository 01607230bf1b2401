"""License scans: MinHash bands over overlapping text windows.

A text's five-word shingles are covered by windows of 2m shingles every m
shingles, m the power of two that holds the template, so every passage as long
as a template lies whole inside a window. A window that holds 0.8 of a
template's shingles has Jaccard similarity 0.19 or more with it; BANDS bands
of one minimum each then miss it with probability (1 - 0.19) ** BANDS < 5e-5.
Windows that share a band with a template are verified by exact containment.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import table

WIDTH, CONTAINMENT, BANDS = 5, 0.8, 48
#: Shingles of a text whose band minima are held at once (or those of the longest template, if more).
CHUNK = 1 << 14
# License notices, by name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: ASCII letters, digits and all bytes of other characters make words, lower-cased.
_WORD = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_ODD = np.random.default_rng(11).integers(0, 2**63, (2, 64), dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=1 << 18)
def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the ``width``-word shingles; the whole sequence if shorter, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(_WORD).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        out = (out ^ h[k : k + n]) * _ODD[0, k]
        out ^= out >> np.uint64(29)
    return out


def minima(sh: np.ndarray, bands: int) -> np.ndarray:
    return (sh[None, :] * _ODD[1, :bands, None]).min(axis=1)


class Index:
    """Template shingles by window class, with their band minima."""

    def __init__(self, templates, width: int = WIDTH, bands: int = BANDS):
        self.width, self.bands, self.classes = width, bands, {}
        for number, (_, text) in enumerate(templates):
            sh = np.unique(shingles(text, width))
            m = 1 << max(0, int(np.ceil(np.log2(max(1, len(sh))))))
            self.classes.setdefault(m, []).append((number, sh, minima(sh, bands)))

    def _look(self, sh: np.ndarray, start: int, step: int, widest: int, best: dict) -> None:
        """Keeps in ``best`` each template's fullest window, the first of equals, of those that begin in the ``step`` shingles from ``start``."""
        last = start + step >= len(sh)
        # a window that begins in the last block ends in the one after it
        level, at = sh[None, start : start + step + widest] * _ODD[1, : self.bands, None], 1
        for m in sorted(self.classes):
            while at < m:  # minima of twice as many shingles
                if level.shape[1] % 2:
                    level = np.hstack([level, level[:, -1:]])
                level, at = np.minimum(level[:, ::2], level[:, 1::2]), at * 2
            window = np.minimum(level, np.hstack([level[:, 1:], level[:, -1:]]))
            if not last:
                window = window[:, : step // m]
            for number, terms, least in self.classes[m]:
                for w in np.flatnonzero((window == least[:, None]).any(axis=0)).tolist():
                    first = start + w * m
                    held = terms[np.isin(terms, sh[first : first + 2 * m])]
                    fuller = (len(held) / len(terms), -first, set(held.tolist()))
                    best[number] = max(best.get(number, (0.0, 0, set())), fuller, key=lambda x: x[:2])

    def find(self, text: str | None, containment: float) -> list[tuple[int, float, int]]:
        """``(template, containment, first shingle of the window)``, the best window each.

        A long text is looked at chunk by chunk; chunks overlap by the longest window's second half.
        """
        sh = shingles(text, self.width)
        if not len(sh):
            return []
        widest = max(self.classes)
        step = -(-CHUNK // widest) * widest  # whole windows of every class
        best: dict[int, tuple[float, int, set[int]]] = {}
        for start in range(0, len(sh), step):
            self._look(sh, start, step, widest, best)
        found = [(number, c, -at, held) for number, (c, at, held) in best.items() if c >= containment]
        # a template whose shingles here all belong to a fuller match is another version of it
        return [(n, c, at) for n, c, at, held in found if not any(c < d and held <= more for _, d, _, more in found)]


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, license, template, containment, window_start)`` of each template found in a row.

    A template whose shingles here all belong to a template that the row holds
    more fully is another version of that one and gives no row. Null, empty and
    word-free texts give no row, repeated rows each give
    theirs, an empty table gives none and further columns are ignored.
    """
    index = Index(templates)

    def run(batches):
        for b in batches:
            rows = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for hit in index.find(t, containment)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([templates[r[1]][0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.float64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                ],
                names=["doc_id", "license", "template", "containment", "window_start"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, license string, template int, containment double, window_start long"
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same from the exact containment of every window.
OP7_SQL = rf"""
WITH given(template, license, text) AS (VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(TEMPLATES))}),
tw AS (SELECT *, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM given),
tl AS (SELECT template, license, list_distinct(list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) AS sh FROM tw),
term AS (SELECT template, license, len(sh) AS n, CAST(pow(2, ceil(log2(len(sh)))) AS BIGINT) AS m, unnest(sh) AS h FROM tl),
dw AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
dsh AS (SELECT rid, doc_id, unnest(range(0, len(w) - {WIDTH - 1})) AS p, unnest(list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) AS h FROM dw WHERE len(w) >= {WIDTH}),
occ AS (SELECT rid, doc_id, template, license, n, m, h, unnest([p // m, p // m - 1]) AS k FROM dsh JOIN term USING (h)),
win AS (SELECT rid, doc_id, template, license, k * m AS start, list(DISTINCT h) AS held, count(DISTINCT h) / n AS containment FROM occ WHERE k >= 0 GROUP BY rid, doc_id, template, license, n, m, k),
best AS (SELECT * FROM win WHERE containment >= {CONTAINMENT} QUALIFY row_number() OVER (PARTITION BY rid, template ORDER BY containment DESC, start) = 1)
SELECT doc_id, license, CAST(template AS INT) AS template, containment, CAST(start AS BIGINT) AS window_start FROM best x
WHERE NOT EXISTS (SELECT 1 FROM best y WHERE y.rid = x.rid AND x.containment < y.containment AND list_has_all(y.held, x.held))
"""
