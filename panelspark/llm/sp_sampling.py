"""SentencePiece segmentations sampled without replacement, and decoding.

The lattice of a text has its character positions as nodes and vocabulary
pieces as arcs; a backward pass gives every node its log mass. A segmentation
is a path; Gumbel noise on its log probability makes the k largest perturbed
values a sample of k distinct paths without replacement. A* search finds them
top-down: a set of paths that share a prefix is a region whose largest
perturbed value is drawn from its mass alone, truncated at the value of the
region it was split from. The best region is popped, a path is drawn in it,
and what lies off that path becomes new regions.

Perturbed values g are kept as arrival times exp(-g): the least comes first
and truncation is an addition. Random numbers are hashes of row key, round and
place, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

import math
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import lean, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SHARPNESS, SEED = 2, 1.0, 17
SPACE, ODD = "▁", "﷐"
#: Characters of text that a task samples at once; a longer text is sampled alone.
CHUNK_CHARS = 3_000_000
#: Units sampled in one round.
ROUND_UNITS = 100_000
M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.asarray(x).astype(np.uint64)  # a copy, changed in place
        x *= M3
        x += np.uint64(SEED)
        x ^= x >> np.uint64(30)
        x *= M1
        x ^= x >> np.uint64(27)
        x *= M2
        x ^= x >> np.uint64(31)
        return x


def uniform(base, place, what) -> np.ndarray:
    """Numbers in (0, 1) from a mixed row key, a place and a purpose: the same wherever drawn."""
    with np.errstate(over="ignore"):
        x = np.asarray(place).astype(np.uint64)
        x *= M1
        x = x + base
        x += np.uint64(what) * M2
    u = (mix(x) >> np.uint64(11)).astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


@lru_cache(maxsize=4)
def vocabulary(model: str, sharpness: float = SHARPNESS) -> "Vocabulary":
    return Vocabulary(model, sharpness)


class Vocabulary:
    """Pieces of a model with log weights; byte pieces stand in for other characters.

    The model ranks its pieces by merges and has no probabilities, so a
    piece's weight falls with its rank as words' do: -sharpness * log(rank).
    """

    def __init__(self, model: str, sharpness: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        kinds = [(sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i), sp.is_byte(i)) for i in range(n)]
        self.pieces, self.byte_id, self.bytes = {}, {}, [b""] * n
        for i, (special, byte) in enumerate(kinds):
            name = sp.id_to_piece(i)
            if byte:
                self.byte_id[int(name[3:5], 16)] = i
                self.bytes[i] = bytes([int(name[3:5], 16)])
            elif not special:
                self.pieces[name] = (i, -sharpness * math.log(len(self.pieces) + 2))
                self.bytes[i] = name.replace(SPACE, " ").encode()
        self.byte_weight = -sharpness * math.log(n + 2)
        self._trie()
        sizes = np.array([len(b) for b in self.bytes])
        self.flat, self.size, self.first = np.frombuffer(b"".join(self.bytes), np.uint8), sizes, np.cumsum(sizes) - sizes

    def _trie(self) -> None:
        """Sorted (state, character) keys of the prefix tree, and what each state spells."""
        chars = sorted({c for p in self.pieces for c in p})
        self.char = np.zeros(0x110000, np.int16)  # 0: in no piece
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        state, edges, spells = {"": 0}, [], [(-1, 0.0)]
        for p in sorted(self.pieces):
            for k in range(1, len(p) + 1):
                if p[:k] not in state:
                    state[p[:k]] = len(state)
                    edges.append((state[p[: k - 1]] << 13 | int(self.char[ord(p[k - 1])]), state[p[:k]]))
                    spells.append(self.pieces.get(p[:k], (-1, 0.0)))
        # pairs of characters that stand side by side in some piece
        self.pair = np.zeros((len(chars) + 1,) * 2, bool)
        for p in self.pieces:
            for a, b in zip(p, p[1:]):
                self.pair[self.char[ord(a)], self.char[ord(b)]] = True
        # a table with open addressing, four slots an edge
        self.bits = max(4, int(np.ceil(np.log2(len(edges) * 4 + 1))))
        self.edge, self.to = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int64)
        for e, t in edges:
            h = int(self._slot(np.array([e]))[0])
            while self.edge[h] >= 0:
                h = (h + 1) % len(self.edge)
            self.edge[h], self.to[h] = e, t
        self.piece, self.weight = np.array([i for i, _ in spells]), np.array([w for _, w in spells])

    def codes(self, text: str) -> np.ndarray:
        return np.frombuffer(text.replace(SPACE, ODD).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)

    def units(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """The texts, a space before each, cut wherever no piece can span.

        No piece holds the two characters at a cut side by side, so every
        segmentation has a boundary there and the parts are independent.
        Returns the joined text, where units start, and how many each text has.
        """
        whole = "".join([" " + t if t else "" for t in texts])
        c = self.char[self.codes(whole)]
        size = np.array([len(t) + 1 if t else 0 for t in texts])
        begin = np.cumsum(size) - size
        cut = np.ones(len(c), bool)
        cut[1:] = ~self.pair[c[:-1], c[1:]]
        cut[begin[size > 0]] = True
        at = np.flatnonzero(cut)
        return whole, at, np.searchsorted(at, begin + size) - np.searchsorted(at, begin)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * M3) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Next states of the prefix tree, -1 where there is none."""
        key = state << 13 | c
        h = self._slot(key)
        seen = self.edge[h]
        out = np.where(seen == key, self.to[h], -1)
        on = np.flatnonzero((seen != key) & (seen >= 0))
        while len(on):
            h[on] = (h[on] + 1) % len(self.edge)
            seen = self.edge[h[on]]
            hit = seen == key[on]
            out[on[hit]] = self.to[h[on[hit]]]
            on = on[~hit & (seen >= 0)]
        return out

    def arcs(self, text: str, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """Arcs ``(from, length, id, weight)`` over ``text``, by from, and each position's first.

        Id -1 is a byte arc. ``left`` says how many characters of its unit each position has left.
        """
        code = self.codes(text)
        c = self.char[code].astype(np.int64)
        at, state, size = np.arange(len(c)), np.zeros(len(c), np.int64), 1
        out: tuple[list, ...] = ([], [], [], [], [])
        held = np.zeros(len(c) + 1, np.int32)
        known = np.zeros(len(c), bool)
        while len(at):
            state = self.step(state, c[at + size - 1])
            ok = state >= 0
            at, state = at[ok], state[ok]
            hit = self.piece[state] >= 0
            here, what = at[hit], state[hit]
            for o, v in zip(out, (here, np.full(len(here), size, np.int32), self.piece[what], self.weight[what], held[here])):
                o.append(v)
            held[here] += 1
            if size == 1:
                known[here] = True
            ok = left[at] > size
            at, state, size = at[ok], state[ok], size + 1
        lone = np.flatnonzero(~known)
        n_bytes = 1 + (code[lone] > 0x7F) + (code[lone] > 0x7FF) + (code[lone] > 0xFFFF)
        for o, v in zip(out, (lone, np.ones(len(lone), np.int32), np.full(len(lone), -1), self.byte_weight * n_bytes, held[lone])):
            o.append(v)
        held[lone] += 1
        # an arc's place: where its position's arcs begin, plus those found before it
        first = np.cumsum(held) - held
        start, size, piece, weight, slot = map(np.concatenate, out)
        place = first[start] + slot
        sorted_out = []
        for v, kind in ((start, np.int32), (size, np.int32), (piece, np.int32), (weight, np.float64)):
            full = np.empty(len(place), kind)
            full[place] = v
            sorted_out.append(full)
        return *sorted_out, first

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of piece ids as UTF-8; the leading space that encoding adds is dropped."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.first[ids] - (ends - size), size)
        at += np.arange(len(at))
        return self.flat[at].tobytes()[1:]


def distinct(code: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrences of the distinct units, and each unit's number among them.

    Units are told apart by hash and compared with their first occurrence.
    """
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(code)) - np.repeat(at, size)
    with np.errstate(over="ignore"):
        key = mix(np.add.reduceat(mix(code) * mix(place.astype(np.uint64)), at) + size.astype(np.uint64))
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    like = first[number]
    same = (size == size[like]).all() and (code == code[np.repeat(at[like], size) + place]).all()
    if not same:  # two units share a hash
        text = [code[a : a + n].tobytes() for a, n in zip(at.tolist(), size.tolist())]
        seen: dict[bytes, int] = {}
        number = np.array([seen.setdefault(t, len(seen)) for t in text])
        first = np.unique(number, return_index=True)[1]
    return first, number


class Tables:
    """Lattices of distinct units, side by side in flat arrays."""

    def __init__(self, vocab: Vocabulary, whole: str, at: np.ndarray):
        self.vocab = vocab
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        spans = np.diff(np.append(at, len(code)))
        first, self.units = distinct(code, at, spans)
        size = spans[first]
        ends = np.cumsum(size)
        take = np.repeat(at[first] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        text = code[take].tobytes().decode("utf-32-le", "surrogatepass")
        left = np.repeat(ends, size) - np.arange(len(text))
        start, length, piece, weight, first = vocab.arcs(text, left)
        mass, value = np.zeros(len(text) + 1), np.zeros(len(start))
        # positions with the same number of characters left are independent: last ones first
        order = np.argsort(left, kind="stable")
        cuts = np.flatnonzero(np.diff(left[order])) + 1
        ending = length == left[start]
        for nodes in np.split(order, cuts) if len(order) else ():
            count = first[nodes + 1] - first[nodes]
            begin = np.cumsum(count) - count
            a = np.repeat(first[nodes] - begin, count) + np.arange(int(count.sum()))
            v = weight[a] + np.where(ending[a], 0.0, mass[start[a] + length[a]])
            top = np.maximum.reduceat(v, begin)
            mass[nodes] = total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, count)), begin))
            value[a] = np.minimum(v - np.repeat(total, count), 0.0)
        self.lp, self.node = value, start
        total = np.cumsum(np.exp(value))
        before = np.where(first[:-1] > 0, total[first[:-1] - 1], 0.0)
        self.key = start + np.minimum(total - before[start], 1.0)
        self.key[first[1:] - 1] = np.arange(len(text)) + 1.0
        self.next = np.where(ending, np.int32(-1), start + length)
        self.first, self.base = first, (ends - size)
        lone = np.flatnonzero(piece < 0)
        spelled = [[vocab.byte_id[b] for b in text[i].encode("utf-8", "surrogatepass")] for i in start[lone].tolist()]
        count = np.ones(len(piece), np.int64)
        count[lone] = [len(x) for x in spelled]
        self.id_size, self.id_end = count, np.cumsum(count)
        self.ids = np.repeat(piece, count)
        self.ids[self.ids < 0] = [i for x in spelled for i in x]

    def starts(self) -> np.ndarray:
        """First node of each unit given."""
        return self.base[self.units] if len(self.units) else np.zeros(0, np.int64)

    def walk(self, node: np.ndarray, base: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw arcs from each start node to its unit's end: ``(start number, arc)`` in order."""
        steps, row, at = [], np.arange(len(node), dtype=np.int32), node.astype(np.int32)
        length = np.zeros(len(node), np.int32)
        while len(row):
            u = uniform(base[row], place[row], len(steps))
            arc, end, u = self.first[at], self.first[at + 1] - 1, u + at
            on = np.flatnonzero((self.key[arc] <= u) & (arc < end))
            while len(on):
                arc[on] += 1
                on = on[(self.key[arc[on]] <= u[on]) & (arc[on] < end[on])]
            steps.append((row, arc))
            length[row] += 1
            at = self.next[arc]
            more = at >= 0
            row, at = row[more], at[more]
        offset = np.cumsum(length) - length
        arcs = np.empty(int(length.sum()), np.int64)
        for k, (row, arc) in enumerate(steps):
            arcs[offset[row] + k] = arc
        return np.repeat(np.arange(len(node)), length), arcs

    def arcs_at(self, node: int) -> np.ndarray:
        return np.arange(self.first[node], self.first[node + 1])

    def pieces(self, arcs: np.ndarray) -> np.ndarray:
        end, size = self.id_end[arcs], self.id_size[arcs]
        at = np.cumsum(size)
        return self.ids[np.repeat(end - at, size) + np.arange(at[-1] if len(at) else 0)]


def log_inclusion(lp: float, arrival: float) -> float:
    """Log probability that a path's perturbed value beats a threshold's arrival time."""
    if math.isinf(arrival):
        return 0.0
    x = lp + math.log(arrival)
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


#: Numbers are under 1 - 2**-54, so a wait is over 5e-17 and over 5e-17 * exp(60) > SURE beyond FAR.
FAR, SURE = -60.0, 1e9
#: Purposes of random numbers beside the steps of walks.
ROOT, SPLIT, PICK, AGAIN = (1 << 40) + np.arange(4)


def _regions(lp, before, arrival, base, skip, ends, k: int):
    """The k earliest regions off each of several paths laid end to end.

    ``lp`` holds the paths' log probabilities from their token ``skip`` on,
    ``ends`` where each path ends; ``before``, ``arrival`` and ``base`` are its
    prefix mass, time and mixed key. Per path: ``(time, token, prefix mass)``.
    """
    if not len(lp):
        return [[] for _ in ends]
    begin = np.concatenate([[0], ends[:-1]])
    total = np.cumsum(lp)
    length = ends - begin
    prefix = total - lp + np.repeat(before - np.where(begin > 0, total[begin - 1], 0.0), length)

    def times(i: np.ndarray, path: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", over="ignore"):
            mass = prefix[i] + np.log(-np.expm1(lp[i]))
            return arrival[path] - np.log(uniform(base[path], i - begin[path] + skip[path], SPLIT)) * np.exp(-mass)

    # a region of prefix mass under FAR comes later than SURE whatever its number; most tokens are such
    near = np.flatnonzero(prefix > FAR)
    path = np.searchsorted(ends, near, side="right")
    edge = np.searchsorted(near, np.concatenate([[0], ends])).tolist()
    near_times = times(near, path)
    out = []
    for p, (a, b) in enumerate(zip(edge, edge[1:])):
        i, t = near[a:b], near_times[a:b]
        if (t < SURE).sum() < min(k, length[p]):
            i = np.arange(begin[p], ends[p])
            t = times(i, np.full(len(i), p))
        best = np.argpartition(t, k - 1)[:k] if len(t) > k else np.arange(len(t))
        out.append([(float(t[x]), int(i[x] - begin[p] + skip[p]), float(prefix[i[x]])) for x in best if t[x] < math.inf])
    return out


def sample(texts: list[str], seeds: np.ndarray, vocab: Vocabulary, k: int):
    """For each text its samples ``(log prob, arrival, log inclusion, pieces)``, best first."""
    whole, at, sizes = vocab.units(texts)
    tables = Tables(vocab, whole, at)
    node, ends = tables.starts(), np.cumsum(sizes)
    result, a = [], 0
    while a < len(texts):  # one lattice table, several rounds of sampling
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ROUND_UNITS, side="right")))
        result += _sample(tables, node[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b], seeds[a:b], k)
        a = b
    return result


def _sample(tables: Tables, node: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, k: int):
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    first_unit = np.cumsum(sizes) - sizes
    base = mix(seeds)
    who, arcs = tables.walk(node, base[doc], np.arange(len(node)) - first_unit[doc])
    ends = np.searchsorted(who, first_unit + sizes)
    arrival = -np.log(uniform(base, 0, ROOT))
    found = _regions(tables.lp[arcs], np.zeros(n), arrival, base, np.zeros(n, np.int64), ends, k)
    done: list[list] = []
    heaps: list[list] = []
    for d, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
        path = arcs[a:b]
        done.append([(float(tables.lp[path].sum()), float(arrival[d]), path, who[a:b] - first_unit[d])])
        heaps.append(sorted((t, 0, at, prefix, (int(path[at]),)) for t, at, prefix in found[d]))
    for turn in range(1, k):
        turned = mix(seeds ^ np.uint64(turn << 56))
        starts, owner, places, plan = [], [], [], []
        for d, heap in enumerate(heaps):
            if not heap:
                continue
            time, source, at, prefix, out = heappop(heap)
            _, _, path, unit = done[d][source]
            options = [o for o in tables.arcs_at(int(tables.node[path[at]])).tolist() if o not in out]
            weight = np.cumsum(np.exp(tables.lp[options]))
            pick = options[min(int(np.searchsorted(weight, uniform(turned[d], at, PICK) * weight[-1], side="right")), len(options) - 1)]
            left = [o for o in options if o != pick]
            if left:
                mass = prefix + math.log(np.exp(tables.lp[left]).sum())
                again = time - float(np.log(uniform(turned[d], at, AGAIN))) * math.exp(-mass) if mass > -700 else math.inf
                if again < math.inf:
                    heappush(heap, (again, source, at, prefix, out + (pick,)))
            inner = [int(tables.next[pick])] if tables.next[pick] >= 0 else []
            u = int(unit[at])
            starts.append(np.concatenate([np.array(inner, np.int64), node[first_unit[d] + u + 1 : first_unit[d] + sizes[d]]]))
            places.append(np.arange(u + 1 - len(inner), sizes[d]))
            owner.append(d)
            plan.append((time, source, at, prefix + float(tables.lp[pick]), pick))
        if not plan:
            break
        owner, place = np.array(owner), np.concatenate(places)
        offset = np.cumsum([0, *map(len, starts)])
        of = np.repeat(np.arange(len(plan)), np.diff(offset))
        who, arcs = tables.walk(np.concatenate(starts), turned[owner[of]], place)
        ends = np.searchsorted(who, offset[1:])
        time, prefix, skip = np.array([p[0] for p in plan]), np.array([p[3] for p in plan]), np.array([p[2] + 1 for p in plan])
        found = _regions(tables.lp[arcs], prefix, time, turned[owner], skip, ends, k - turn)
        for p, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
            d, (t, source, at, _, pick) = int(owner[p]), plan[p]
            old = done[d][source]
            path = np.concatenate([old[2][:at], [pick], arcs[a:b]])
            unit = np.concatenate([old[3][: at + 1], place[who[a:b]]])
            for region in found[p]:
                heappush(heaps[d], (region[0], len(done[d]), region[1], region[2], (int(path[region[1]]),)))
            done[d].append((float(tables.lp[path].sum()), t, path, unit))
    paths = [x[2] for own in done for x in own]
    pieces, size = tables.pieces(np.concatenate(paths)) if paths else np.zeros(0, np.int64), np.array([len(x) for x in paths])
    per_arc = np.concatenate([[0], np.cumsum(tables.id_size[np.concatenate(paths)])]) if paths else np.zeros(1, np.int64)
    edge = per_arc[np.concatenate([[0], np.cumsum(size)])].tolist()
    result, at = [], 0
    for own, heap in zip(done, heaps):
        limit = heap[0][0] if heap else math.inf
        result.append([(lp, t, log_inclusion(lp, limit), pieces[edge[at + i] : edge[at + i + 1]]) for i, (lp, t, _, _) in enumerate(own)])
        at += len(own)
    return result


SCHEMA = "doc_id long, rank int, log_prob double, gumbel double, log_inclusion double, n_pieces long, round_trip boolean, pieces array<int>"


def encode(docs: DataFrame, k: int = SAMPLES, model: str = MODEL, sharpness: float = SHARPNESS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Up to ``k`` distinct segmentations of each row of ``docs(doc_id, text)``.

    Rows: rank from 1 by perturbed log probability, the piece ids, their log
    probability, the perturbed value, the log of the inclusion probability
    given the next perturbed value, and whether decoding gives the text back.
    Null and empty texts have one segmentation, the empty one (probability and
    inclusion 1). A text with fewer than ``k`` segmentations gives those it
    has. Rows that repeat a doc_id and text repeat their result; a null doc_id
    has key 0. An empty table gives none and further columns are ignored.
    ``chunk_chars`` bounds the text sampled at once, and so a task's memory; the
    result does not depend on it.
    """

    def run(batches):
        vocab = vocabulary(model, sharpness)
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = [t or "" for t in b.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= chunk_chars):
                    chars += len(texts[end])
                    end += 1
                yield chunk(vocab, ids[at:end], texts[at:end])
                at = end

    def chunk(vocab, ids, texts):
        seeds = np.array([(i or 0) & (2**64 - 1) for i in ids], dtype=np.uint64)
        cols: list[list] = [[] for _ in range(7)]
        values, size = [], [0]
        for i, t, found in zip(ids, texts, sample(texts, seeds, vocab, k)):
            raw = t.encode("utf-8", "surrogatepass")
            for rank, (lp, time, inc, p) in enumerate(found, 1):
                values.append(p)
                size.append(size[-1] + len(p))
                good = vocab.decode(p) == raw
                for c, v in zip(cols, (i, rank, lp, -math.log(time), inc, len(p), good)):
                    c.append(v)
        flat = np.concatenate(values) if values else np.zeros(0)
        lists = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(flat.astype(np.int32)))
        kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds)), lists], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), SCHEMA)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, rank, text)`` of ``rows(doc_id, rank, pieces)``; no pieces give ''.

    Ids that no encoding yields (half a character in bytes) decode with
    replacement characters; null pieces give null.
    """

    def run(batches):
        vocab = vocabulary(model)
        for b in batches:
            text = [None if p is None else vocab.decode(np.array(p, np.int64)).decode("utf-8", "replace") for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], names=["doc_id", "rank", "text"])

    return rows.select("doc_id", "rank", "pieces").mapInArrow(lean(run), "doc_id long, rank int, text string")


def op4(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
