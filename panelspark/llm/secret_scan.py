"""Secret scans: credential patterns and password guess-cost.

Base spans come from three fixed patterns. The method then looks at values in
a credential context that the base patterns leave out in whole or in part
(other context words, values under eight characters, or characters that end a
base value early) and estimates how many guesses an attacker
needs: dynamic programming picks the cheapest way to cut the value into
dictionary words, dates, repeats, keyboard walks and brute-force stretches.
Values that cost at least ``min_log10`` decimal digits of guesses are spans of
kind ``guess``.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import lean, table

# The base patterns of the contract.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "guess")
# Further words that announce a credential.
CONTEXT = (
    r"""(password|passwd|passphrase|pwd|secret|token|api_?key|access_?key|private_?key|auth|credentials?|bearer)"""
    r"""["']?\x20*[:=]\x20*["']?(?=[^\s"'<>,;])"""
)
VALUE = r"""[^\s"'<>,;]+"""
# Words that guessing starts with, most likely first.
WORDS = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login secret token "
    "football baseball shadow michael sunshine princess iloveyou trustno1 superman batman "
    "access hello charlie donald freedom whatever ninja mustang starwars summer winter spring "
    "autumn love test guest root user default changeme example demo public private server "
    "database api key the and this that with from your name pass word code auth none null true "
    "false undefined string value here insert replace placeholder dummy sample"
).split()
# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")

RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
#: A run that is cut short is cut where a word or a date that leaves it may start.
OVERLAP = max(LONGEST, 10)
NEXT = {(r[i], r[i + d]) for r in ROWS for d in (1, -1) for i in range(len(r)) if 0 <= i + d < len(r)}
# Forms of a date (year, with month, with day) and log10 of how many there are.
DATES = (
    (re.compile(r"(?:19|20)\d\d", re.A), 2.1),
    (re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])", re.A), 4.0),
    (re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])", re.A), 4.0),
)
LEET = str.maketrans("@40135$7", "aaoiesst")
RE_ASSIGN, RE_CONTEXT = re.compile(ASSIGN, re.I | re.A), re.compile(CONTEXT, re.I | re.A)
RE_VALUE = re.compile(VALUE, re.A)
RE_ACCESS = re.compile(ACCESS, re.A)
RE_HEX = re.compile(r"[0-9a-f]{32,}", re.A)  # runs of HEX are maximal, so its long matches are these


class Value:
    """A value's spans that are cheaper than brute force, found where they are asked for."""

    def __init__(self, value: str):
        self.value, self.low = value, value.lower()
        self.low = self.low if len(self.low) == len(value) else value
        self.plain = self.low.translate(LEET)
        spread = 10 * any(c.isdigit() for c in value) + 26 * any(c.islower() for c in value)
        spread += 26 * any(c.isupper() for c in value) + 33 * any(not c.isalnum() for c in value)
        self.brute = math.log10(max(spread, 10))
        self.spans: dict[int, list[tuple[int, float]]] = {}
        self.same = self.walk = (0, 0)  # the run last looked at

    def _run(self, i: int, known: tuple[int, int], joined) -> tuple[int, int]:
        if known[0] <= i < known[1]:
            return known
        end = i + 1
        while end < len(self.low) and joined(self.low[end - 1], self.low[end]):
            end += 1
        return i, end

    def at(self, i: int) -> list[tuple[int, float]]:
        """``(end, log10 of guesses)`` of the words, dates, repeats and walks that start at ``i``."""
        if i in self.spans:
            return self.spans[i]
        out, value, low = [], self.value, self.low
        for j in range(i + 1, min(len(low), i + LONGEST) + 1):
            for word, extra in ((low[i:j], 0.0), (self.plain[i:j], 0.7)):
                if word in RANK:
                    out.append((j, math.log10(RANK[word] + 1) + extra + (0.3 if value[i:j] != low[i:j] else 0.0)))
        if value[i].isdigit():
            out += [(m.end(), cost) for form, cost in DATES for m in [form.match(value, i)] if m]
        self.same = self._run(i, self.same, lambda x, y: x == y)
        self.walk = self._run(i, self.walk, lambda x, y: (x, y) in NEXT)
        for (_, end), least, cost in ((self.same, 3, self.brute), (self.walk, 4, 2.0)):
            out += [(j, cost + math.log10(j - i)) for j in range(max(i + least, end - OVERLAP), end + 1)]
        self.spans[i] = out
        return out


def guess_cost(value: str, enough: float = math.inf) -> float:
    """log10 of the guesses the cheapest segmentation needs; 0.0 for ''.

    A segmentation of n parts also pays log10(n!), as an attacker tries their
    orders, so the minimum is taken over place and number of parts: one layer a
    part, holding the cheapest way to each place. A layer ends the search when
    its orders alone cost as much as the best way found, and a way that costs
    ``enough`` or more is dropped; then ``enough`` is returned if none is left.
    A run of repeats or a walk may end before it must only where something that
    leaves the run can start: ending it elsewhere never pays.
    """
    n = len(value)
    if not n:
        return 0.0
    own = Value(value)
    best, layer, orders, parts = min(n * own.brute, enough), {0: 0.0}, 0.0, 0
    while layer:
        parts += 1
        orders += math.log10(parts)
        if orders >= best:
            break
        after: dict[int, float] = {}
        room = best - orders
        flat = math.inf  # a brute-force stretch grows one character at a time
        i = min(layer)
        last = max(layer)
        while i < n and (i <= last or flat < room):
            here = layer.get(i, math.inf)
            if here < room:
                for j, cost in own.at(i):
                    if here + cost < after.get(j, room):
                        after[j] = here + cost
            flat = min(flat, here) + own.brute
            if flat < after.get(i + 1, room):
                after[i + 1] = flat
            i += 1
        if n in after:
            best = min(best, after.pop(n) + orders)
        layer = after
    return best


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base patterns, sorted."""
    out = [(m.start(), 0, m.end()) for m in RE_ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in RE_ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in RE_HEX.finditer(text)]
    return sorted(out)


def joined(base: list[tuple[int, int, int]]) -> list[list[int]]:
    """Unions of overlapping or touching spans, ``[start, end]`` each, from spans sorted by start."""
    out: list[list[int]] = []
    for s, _, e in base:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def guess_spans(text: str, base: list[tuple[int, int, int]], min_log10: float) -> list[tuple[int, int, int]]:
    """Values in a credential context that reach beyond base spans and are costly to guess.

    A value may itself announce another; one inside a found value is part of it.
    Values come by start, so one walk over the joined base spans serves all of them.
    """
    out, covered = [], joined(base)
    stop = found = k = 0
    for m in RE_CONTEXT.finditer(text):
        a = m.end()
        if a >= stop:  # values that start within a run of such characters end with it
            stop = RE_VALUE.match(text, a).end()
        if a < found:
            continue
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        at = covered[k][1] if k < len(covered) and covered[k][0] <= a else a
        if at < stop and guess_cost(text[a:stop], min_log10) >= min_log10:
            out.append((a, 3, stop))
            found = stop
    return out


def spans(text: str | None, min_log10: float = 8.0) -> list[tuple[int, int, int]]:
    """All spans of a text, by start and then kind; none for null or empty."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + guess_spans(text, base, min_log10))


def show(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, min_log10: float = 8.0) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with counts and spans.

    Null and empty texts have no span, zero counts and the digest of the empty
    string. Offsets are code points, ends exclusive. Repeated rows each give a
    row, an empty table gives none and further columns are ignored.
    """

    def run(batches):
        for b in batches:
            rows = [spans(t, min_log10) for t in b.column(1).to_pylist()]
            base = [[s for s in r if s[1] < 3] for r in rows]
            count = lambda k: pa.array([sum(s[1] == k for s in r) for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    count(0),
                    count(1),
                    count(2),
                    count(3),
                    pa.array([hashlib.sha256(show(r).encode()).hexdigest() for r in base], pa.string()),
                    pa.array([show(r) for r in rows], pa.string()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lean(run), "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    )


def redact_text(text: str | None, min_log10: float = 8.0, mark: str = "[SECRET]") -> str | None:
    """``text`` with every union of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in spans(text, min_log10):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, min_log10: float = 8.0) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``n_chars`` brought up to date.

    Every row is masked by itself: null and empty texts stay, repeated rows and
    null doc_ids are rows like any other, other columns pass, and an empty
    table gives none.
    """
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for b in batches:
            text = pa.array([redact_text(t, min_log10) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([text if i == at else b.column(i) for i in range(len(names))], names=names)

    out = docs.mapInArrow(lean(run), docs.schema)
    if "n_chars" in names:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(size))
    return out


def op6(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
