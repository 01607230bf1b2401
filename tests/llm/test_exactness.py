"""Training-data operators against brute force: hard pairs, bounds met from both sides, odd rows."""

import math
import random
import time
import tracemalloc
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, embedding_dedup, jaccard_dedup, license_scan, quality, secret_scan, simhash_dedup, sp_sampling, suffix_dedup, url_filter
from panelspark.llm.common import table
from tests.llm.test_operators import brute_components, brute_repeats

SF = "/root/testdata/sf0.001"


# --- benchmark ---------------------------------------------------------------
def shingled(words, width):
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def brute_contaminated(docs, items):
    """The best similarity of all windows of every text and item."""
    items = [(i, w, min(5, len(w))) for i, w in items]
    terms = [(i, n, Counter(shingled(w, n))) for i, w, n in items]
    df = Counter(h for _, _, t in terms for h in t)
    wt = {h: round(math.log1p(len(items) / n) * 1e6) for h, n in df.items()}
    out = {}
    for d, text in docs:
        for i, width, t in terms:
            sh, n, total = shingled(text, width), sum(t.values()), sum(wt[h] * c for h, c in t.items())
            best = 0
            for s in range(max(len(sh) - n, 0) + 1):
                held = Counter(h for h in sh[s : s + n] if h in t)
                best = max(best, sum(wt[h] * min(c, t[h]) for h, c in held.items()))
            if best + 0.5 >= 0.8 * total:
                out[d, i] = best / total
    return out


def frames(spark, docs, items):
    text = lambda rows: [(k, " ".join(w)) for k, w in rows]
    return spark.createDataFrame(text(docs), "doc_id long, text string"), spark.createDataFrame(text(items), "item_id long, text string")


def test_decontamination_against_all_windows(spark):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(12)]
    items = []
    for k in range(30):
        w = [rng.choice(common) if rng.random() < 0.3 else f"w{k}x{rng.randint(0, 40)}" for _ in range(rng.randint(3, 40))]
        items.append((k, w + (w[:6] if k % 4 == 0 else [])))  # some shingles repeat
    docs = []
    for d in range(150):
        w = list(rng.choice(items)[1])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = "changed"
        if d % 5 == 0:
            w = w[len(w) // 2 :] + w[: len(w) // 2]
        if d % 7 == 0:
            w = w + rng.choice(items)[1] + w
        docs.append((d, [f"a{d}"] * rng.randint(0, 9) + w + [f"z{d}"] * rng.randint(0, 9)))
    want = brute_contaminated(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(*frames(spark, docs, items)).collect()}
    assert got == pytest.approx(want) and 60 < len(want)


def test_decontamination_of_swapped_halves_and_rare_words(spark):
    item = [f"w{i}" for i in range(60)]
    common = [f"c{i}" for i in range(110)]
    items = [(1_000, item)] + [(k, common + [f"r{k}x{i}" for i in range(80)]) for k in range(40)]
    docs = [(1_000, item[30:] + item[:30])] + [(k, [f"o{k}y{i}" for i in range(120)] + w[110:]) for k, w in items[1:]]
    want = brute_contaminated(docs, items)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(*frames(spark, docs, items)).collect()}
    assert {k: r.similarity for k, r in got.items()} == pytest.approx(want)
    assert got[1_000, 1_000].similarity == pytest.approx(52 / 56, abs=1e-6)


def test_decontamination_decides_by_text(spark):
    bench = table(spark, SF, "benchmark")
    item = bench.first().text
    rows = [(None, f"so {item} so"), (1, f"so {item} so"), (1, "clean under the same id"), (None, "clean"), (2, None), (3, ""), (4, "clean"), (4, "clean")]
    kept = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert Counter(map(tuple, kept)) == Counter(r for r in rows if not r[1] or item not in r[1])


def test_fingerprints_within_the_radius_share_a_block(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(300)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(x), signed(x ^ sum(1 << b for b in rng.sample(range(64), decontaminate.RADIUS)))) for x in base]
    df = spark.createDataFrame(rows, "x long, y long").select(F.size(F.array_intersect(decontaminate.blocks("x"), decontaminate.blocks("y"))).alias("n"))
    assert df.agg(F.min("n")).first()[0] >= 1


# --- embeddings --------------------------------------------------------------
def planted(n, d, low, high, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.standard_normal((n, d))
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    c = rng.uniform(low, high, n)[:, None]
    return np.vstack([x, c * x + np.sqrt(1 - c * c) * z])


def test_embeddings_exact_in_many_lists(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 60)
    rng = np.random.default_rng(1)
    v = np.vstack([planted(500, 12, 0.85, 0.95), rng.standard_normal(12) + 0.25 * rng.standard_normal((300, 12))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.9
    want = brute_components(list(enumerate(range(len(v)))), lambda a, b: near[a, b])
    got = embedding_dedup.near_duplicates(df, lists=55, angle=1.0).collect()
    assert {r.vec_id: (r.component_id, r.n_links) for r in got} == {i: (want[i], int(near[i].sum()) - 1) for i in want}


def spectrum(kind, d=64):
    k = np.arange(1, d + 1)
    return {"flat": np.ones(d), "power": k**-0.7, "rank": np.where(k <= 12, 1.0, 0.01)}[kind]


@pytest.mark.parametrize("kind", ["flat", "power", "rank"])
def test_embedding_recall_at_the_threshold(spark, kind):
    """Pairs whose difference follows the vectors' own spectrum."""
    n, rng, scale = 3_000, np.random.default_rng(5), spectrum(kind)
    x, z = rng.standard_normal((n, 64)) * scale, rng.standard_normal((n, 64)) * scale
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    c = rng.uniform(0.9005, 0.93, n)[:, None]
    v = np.vstack([x, c * x + np.sqrt(1 - c * c) * z]).astype(np.float32)
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, lists=40).collect()}
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) / want.sum() > 0.99


def test_embeddings_without_or_with_one_id(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(None, a), (None, a), (7, a), (7, b), (7, b), (None, [0.0, 0.0, 1.0]), (None, None)]
    got = Counter(map(tuple, embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == Counter([(None, 2, 7, False), (None, 2, 7, False), (7, 2, 7, True), (7, 1, 7, True), (7, 1, 7, True), (None, 0, None, True), (None, 0, None, True)])


# --- near copies -------------------------------------------------------------
def test_rows_without_or_with_one_id(spark):
    a, b = "a b c d e f g", "x y z w v u t"
    rows = [(1, a), (1, a), (2, a), (2, "unique one two three four five"), (None, b), (None, b), (None, None), (5, ""), (3, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit(1)).withColumn("grp", F.lit(1)).withColumn("times", F.lit(1))
    kept = simhash_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (2, "unique one two three four five"), (3, b), (5, "")])
    got = Counter((r.doc_id, r.component_id) for r in simhash_dedup.near_duplicates(df).collect())
    assert got == Counter([(1, 1), (1, 1), (2, 1), (2, 2), (None, 3), (None, 3), (3, 3), (None, 5), (5, 5)])
    lone = spark.createDataFrame([(None, a), (None, a)], "doc_id long, text string")
    assert [r.component_id for r in simhash_dedup.near_duplicates(lone).collect()] == [None, None] and simhash_dedup.keep_one(lone).count() == 1


# --- suffixes ----------------------------------------------------------------
def test_common_anchors_by_grouped_minima(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BIG", 3)
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    rows = [(i, f"{rng.getrandbits(900):x}{passage[rng.randint(0, 40) :]}{rng.getrandbits(900):x}") for i in range(60)]
    rows += [(100 + i, passage[: 100 + i]) for i in range(20)]
    want = brute_repeats(rows)
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


# --- secrets -----------------------------------------------------------------
def brute_cost(v):
    """The least cost over all segmentations, one part more at a time."""
    n, low = len(v), v.lower()
    plain = low.translate(secret_scan.LEET)
    spread = 10 * any(c.isdigit() for c in v) + 26 * any(c.islower() for c in v) + 26 * any(c.isupper() for c in v) + 33 * any(not c.isalnum() for c in v)
    one = math.log10(max(spread, 10))

    def cost(i, j):
        out = [(j - i) * one]
        for w, more in ((low[i:j], 0.0), (plain[i:j], 0.7)):
            if w in secret_scan.RANK:
                out.append(math.log10(secret_scan.RANK[w] + 1) + more + (0.3 if v[i:j] != low[i:j] else 0.0))
        out += [c for form, c in secret_scan.DATES if form.fullmatch(v, i, j)]
        if j - i >= 3 and len(set(low[i:j])) == 1:
            out.append(one + math.log10(j - i))
        if j - i >= 4 and all((low[k], low[k + 1]) in secret_scan.NEXT for k in range(i, j - 1)):
            out.append(2.0 + math.log10(j - i))
        return min(out)

    table_of = {(i, j): cost(i, j) for i, j in combinations(range(n + 1), 2)}
    layer, best, orders = {0: 0.0}, math.inf, 0.0
    for k in range(1, n + 1):
        orders += math.log10(k)
        after = defaultdict(lambda: math.inf)
        for i, x in layer.items():
            for j in range(i + 1, n + 1):
                after[j] = min(after[j], x + table_of[i, j])
        best, layer = min(best, after[n] + orders), after
    return best


def test_guess_cost_is_the_minimum():
    rng = random.Random(4)
    parts = [*secret_scan.WORDS[:60], "qwert", "1234567", "aaaa", "1111", "asdfg", "2019", "20240131", "2021-05", "$", "X", "9", "zz", "P@ssw0rd", "19999", "!"]
    for _ in range(1500):
        v = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))[: rng.randint(3, 20)]
        want = brute_cost(v)
        assert secret_scan.guess_cost(v) == pytest.approx(want, abs=1e-9), v
        assert (secret_scan.guess_cost(v, 8.0) >= 8.0) == (want >= 8.0), v
    assert secret_scan.guess_cost("1234567$qwertsecret") == pytest.approx(9.313, abs=1e-3)
    assert secret_scan.guess_cost("2019999999") == pytest.approx(4.179, abs=1e-3)
    assert secret_scan.guess_cost("aB3$" * 50_000, 8.0) == 8.0


# --- quality -----------------------------------------------------------------
def test_quality_scores_against_a_plain_refit(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    label = {r.doc_id: float(r.quality) for r in table(spark, sf, "labels").collect() if r.quality is not None}
    con = duckdb.connect()
    import zlib

    part = {d: zlib.crc32(str(d).encode()) % 4 for d in docs}
    x = {d: np.array(quality.statistics(t), float) for d, t in docs.items()}
    fit, cal = ([d for d in docs if d in label and part[d] in p] for p in ((0, 3), (1,)))
    a = np.array([x[d] for d in fit])
    model = quality.Model(a.mean(0), np.where(a.std(0) > 1e-9, a.std(0), 1.0), None, None, None)
    z, y = model.cosines(a), np.array([label[d] for d in fit])
    model.beta = np.linalg.solve(z.T @ z + quality.RIDGE * len(fit) / quality.N_COSINES * np.eye(z.shape[1]), z.T @ y)
    raw = dict(zip(docs, model.raw(np.array([x[d] for d in docs]))))
    bins = defaultdict(list)
    for d in cal:
        bins[int(np.floor(min(max(raw[d], -1), 2) * 1000 + 0.5))].append((raw[d], label[d]))
    rows = sorted((np.mean([r for r, _ in b]), np.mean([v for _, v in b]), len(b)) for b in bins.values())
    # isotonic values by the max-min formula
    bx, by, bn = (np.array(c, float) for c in zip(*rows))
    mean = lambda i, j: (by[i : j + 1] * bn[i : j + 1]).sum() / bn[i : j + 1].sum()
    iso = np.array([max(min(mean(i, j) for j in range(k, len(bx))) for i in range(k + 1)) for k in range(len(bx))])
    got = {r.doc_id: r for r in quality.op1(spark, sf).collect()}
    knots, values = quality.isotonic(bx, by, bn)
    assert np.interp(bx, knots, values)[[0, -1]] == pytest.approx(iso[[0, -1]])
    assert sorted(set(np.round(values, 9))) == sorted(set(np.round(iso, 9)))
    knots = np.concatenate([[knots[0] - 1.0], knots, [knots[-1] + 1.0]])
    values = np.concatenate([[0.0], np.clip(values, 0.001, 0.999), [1.0]])
    for d in docs:
        assert got[d].score == pytest.approx(float(np.clip(np.interp(raw[d], knots, values), 0, 1)), abs=1e-6)
        assert got[d].held_out == (part[d] == 2)
    con.close()


def test_quality_decides_by_text(spark):
    labels = table(spark, SF, "labels")
    docs = table(spark, SF, "documents").select("doc_id", "text")
    bad = {r.text for r in quality.keep_good(docs, labels).collect()} ^ {r.text for r in docs.collect()}
    assert bad
    text = sorted(bad)[0]
    good = next(r.text for r in docs.collect() if r.text not in bad)
    more = docs.union(spark.createDataFrame([(None, text), (5, text), (5, good), (None, good)], "doc_id long, text string"))
    kept = {r.text for r in quality.keep_good(more, labels).where("doc_id is null or doc_id = 5").collect()}
    assert text not in kept and good in kept


# --- urls --------------------------------------------------------------------
def test_urls_learn_what_labels_say(spark):
    rng = random.Random(3)

    def url(bad):
        name = "".join(rng.choice("0123456789abcdef" if bad else "etaoinshrdlu") for _ in range(rng.randint(8, 14)))
        return f"http://{name}.{rng.choice(['zz', 'yy', 'xx'])}/" + "/".join(f"p{rng.randint(0, 99)}" for _ in range(rng.randint(1, 3)))

    known = [(url(b), "block" if b else "allow") for b in (True, False) * 400]
    asked = [(k, url(b), b) for k, b in enumerate((True, False) * 200)]
    pages = spark.createDataFrame([(k, u) for k, u, _ in asked], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labelled=spark.createDataFrame(known, "url string, verdict string")).collect()}
    assert np.mean([(got[k] == "block") == b for k, _, b in asked]) > 0.95


def test_url_parts_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    rule = "CASE " + " ".join(
        f"WHEN ('.' || host) LIKE '%.{r.partition('/')[0]}' AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
        for _, r in sorted(url_filter.RULES, key=lambda x: -len(x[1]))
    ) + " END"
    sql = f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM '{sf}/pages.parquet'),
      p AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
      SELECT page_id, host, path, {rule} FROM p"""
    want = set(duckdb.connect().sql(sql).fetchall())
    assert {(r.page_id, r.host, r.path, r.rule) for r in url_filter.op2(spark, sf).collect()} == want


def test_repeated_urls_are_judged_alike(spark):
    data = [(1, "http://a.zz/x"), (1, "http://b.zz/y?q=1"), (2, "http://a.zz/x"), (None, "http://a.zz/x"), (None, None)] * 3
    got = defaultdict(set)
    rows = url_filter.judge(spark.createDataFrame(data, "page_id long, url string")).collect()
    for r in rows:
        got[r.host, r.path].add(r.verdict)
    assert len(rows) == 15 and all(len(v) == 1 for v in got.values())


# --- licenses ----------------------------------------------------------------
def test_license_containment_from_both_sides(spark):
    rng = random.Random(9)
    templates = [(f"L{k}", " ".join(f"t{k}w{i}" for i in range(n))) for k, n in enumerate((9, 24, 40, 104, 260))]
    rows, want = [], {}
    for d in range(300):
        k = rng.randrange(len(templates))
        words = templates[k][1].split()
        for i in rng.sample(range(len(words)), rng.choice([0, 1, 1, 2, 3, max(1, len(words) // 30)])):
            words[i] = "changed"
        words = [f"a{d}x{i}" for i in range(rng.randint(0, 300))] + words + [f"z{d}"] * rng.randint(0, 50)
        rows.append((d, " ".join(words)))
        for t, (_, text) in enumerate(templates):
            sh, have = np.unique(license_scan.shingles(text)), license_scan.shingles(rows[-1][1])
            m = 1 << math.ceil(math.log2(len(sh)))
            best = max((np.isin(sh, have[s : s + 2 * m]).mean() for s in range(0, max(len(have), 1), m)), default=0)
            if best >= 0.8:
                want[d, t] = best
    got = {(r.doc_id, r.template): r.containment for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    assert got == pytest.approx(want) and 0 < len(want) < 300
    again = spark.createDataFrame([(1, templates[0][1]), (1, templates[1][1]), (1, templates[1][1]), (None, templates[0][1])], "doc_id long, text string")
    assert Counter((r.doc_id, r.template) for r in license_scan.scan(again, templates).collect()) == Counter([(1, 0), (1, 1), (1, 1), (None, 0)])


# --- segmentations -----------------------------------------------------------
def test_lattice_by_enumeration():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sp_sampling.MODEL)
    pieces = {model.id_to_piece(i): i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    text, n = "▁then", 4000

    def paths(s):
        return [[]] if not s else [[s[:k], *rest] for k in range(1, len(s) + 1) if s[:k] in pieces for rest in paths(s[k:])]

    every = {tuple(pieces[p] for p in path) for path in paths(text)}
    vocab = sp_sampling.vocabulary(sp_sampling.MODEL)
    seen = Counter()
    for rows in sp_sampling.sample(["then"] * n, np.arange(n, dtype=np.uint64), vocab, 2):
        ids = [tuple(r[3]) for r in rows]
        assert len(set(ids)) == len(ids)
        seen.update(ids)
    as_ids = {k if isinstance(k[0], (int, np.integer)) else tuple(pieces[p] for p in k): c for k, c in seen.items()}
    assert set(as_ids) <= every and len(every) > 3


# --- pipeline ----------------------------------------------------------------
def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    item = table(spark, SF, "benchmark").first().text
    plain = [r.text for r in table(spark, SF, "documents").collect()]
    rows = [(i, t) for i, t in enumerate(plain[:60])] + [(None, plain[0]), (3, plain[4]), (900, None), (901, ""), (902, f"{plain[1]} {item}"), (903, " ".join(plain[:40]))]
    rows = [(d, t, "en", "web", None if t is None else len(t)) for d, t in rows]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, df in (("documents", made), ("labels", table(spark, SF, "labels")), ("benchmark", table(spark, SF, "benchmark"))):
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    assert all(r.round_trip for r in out) and 902 not in kept and len(out) <= 2 * len(rows)
    made.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for name in ("labels", "benchmark"):
        table(spark, str(tmp_path), name).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


# --- very long texts ---------------------------------------------------------
def test_a_log_of_tokens_is_walked_once():
    line = "token: abcdefgh{:07d} pwd=x9$Kq2!vLr7 auth: password\n"
    text = "".join(line.format(i) for i in range(100_000))
    began = time.process_time()
    found = secret_scan.spans(text)
    assert len(text) > 5_000_000 and time.process_time() - began < 30
    size, few = len(line.format(0)), secret_scan.spans("".join(line.format(i) for i in range(3)))
    assert [(a % size, k, b - a) for a, k, b in found] == [(a % size, k, b - a) for a, k, b in few[: len(few) // 3]] * 100_000


def test_context_values_reach_beyond_base_spans():
    rng = random.Random(4)
    parts = ["token=", "auth: ", "pwd=", "abcdefgh12", "x9$Kq2!v", "0123456789abcdef" * 2, "AKIA" + "Z" * 14, '"', " ", "\n", "password", "é"]
    for _ in range(3_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        base = secret_scan.base_spans(text)
        want, reach = [], 0
        for m in secret_scan.RE_CONTEXT.finditer(text):
            a, at = m.end(), m.end()
            stop = secret_scan.RE_VALUE.match(text, a).end()
            for s, _, e in base:  # every base span for every value
                at = e if s <= at < e else at
            if a >= reach and at < stop and secret_scan.guess_cost(text[a:stop]) >= 8.0:
                want.append((a, 3, stop))
                reach = stop
        assert secret_scan.guess_spans(text, base, 8.0) == want, text


def test_licences_of_a_long_text_need_no_more_memory_than_its_words(monkeypatch):
    rng = np.random.default_rng(3)
    long = " ".join(f"l{i}" for i in range(3_000))  # as long as a whole licence
    index = license_scan.Index([*license_scan.TEMPLATES, ("long", long)])
    words = np.array([f"w{i}" for i in range(5_000)])[rng.integers(0, 5_000, 900_000)].tolist()
    for at in (16_000, 32_750, 65_500, 700_001):  # across chunks too
        words[at : at + 29] = license_scan.TEMPLATES[1][1].split()
    words[300_000:303_000] = long.split()
    text = " ".join(words)
    tracemalloc.start()
    got = index.find(text, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 5_000_000 and peak < 200e6, peak
    monkeypatch.setattr(license_scan, "CHUNK", 1 << 22)  # all windows at once
    assert sorted(n for n, _, _ in got) == [1, len(license_scan.TEMPLATES)] and got == index.find(text, 0.8)
    for n in (0, 1, 4, 5, 16_383, 16_384, 16_389, 20_480):
        short = " ".join(words[15_000 : 15_000 + n])
        with monkeypatch.context() as small:
            small.setattr(license_scan, "CHUNK", 64)
            cut = license_scan.Index(license_scan.TEMPLATES).find(short, 0.5)
        assert cut == license_scan.Index(license_scan.TEMPLATES).find(short, 0.5)


# --- near copies in the pipeline ------------------------------------------------
def test_near_dedup_stage_decides_by_simhash():
    """Fingerprints against plain votes; similar sets are close, others are left out before any set is compared."""
    rng = np.random.default_rng(4)
    h = np.unique(rng.integers(0, 2**64, 301, dtype=np.uint64))
    one = np.array([np.unpackbits(np.frombuffer(jaccard_dedup.fingerprint(h[i : i + 1]), np.uint8)) for i in range(len(h))], int)
    want = np.packbits(one.sum(axis=0) * 2 > len(h)).tobytes()
    assert jaccard_dedup.fingerprint(h) == want and jaccard_dedup.fingerprint(h[:0]) == bytes(jaccard_dedup.BYTES)
    left, right = [], []
    for k, (both, own, other) in enumerate([(4, 0, 1), (12, 0, 3), (20, 2, 3), (80, 9, 11), (320, 40, 40)] * 20):
        z = rng.integers(0, 2**64, both + own + other, dtype=np.uint64)
        left.append((k, jaccard_dedup.fingerprint(z[: both + own])))
        right.append((1000 + k, jaccard_dedup.fingerprint(np.concatenate([z[:both], z[both + own :]]))))
    x, y = (np.array([np.frombuffer(f, np.uint8) for _, f in side]) for side in (left, right))
    bits = np.array([[np.unpackbits(a ^ b).sum() for b in y] for a in x])
    near = jaccard_dedup.close(x, y)
    assert (near == (((x[:, None] == y).sum(axis=2) >= jaccard_dedup.MIN_BYTES) & (bits <= jaccard_dedup.RADIUS))).all()
    assert (near == np.eye(len(x), dtype=bool)).all()
    got = jaccard_dedup.screen(7, 8, left[:50], right[25:]).to_pydict()
    assert set(got["v"]) == set(range(25, 50)) | set(range(1025, 1050))


def test_near_dedup_stage_links_what_fingerprints_hold_apart(spark):
    """Two texts of similarity 0.8 whose fingerprints differ in 218 of 768 bits, found by search."""
    one = " ".join(f"w105398x{i}" for i in range(8))
    two = one + " z71438"
    fps = [np.frombuffer(jaccard_dedup.fingerprint(jaccard_dedup.shingles(t)), np.uint8)[None] for t in (one, two)]
    assert np.unpackbits(fps[0] ^ fps[1]).sum() == 218 and not jaccard_dedup.close(*fps).any()
    rows = [(3, one), (2, two), (5, "w105398x0 other words that share none of the shingles")]
    kept = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5]


def test_parities_leave_every_similar_pair_possible():
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (4, 30, 400, 470, 500, 512, 513, 600, 1000, 1100, 5000)]
    near = [np.concatenate([h[k:], rng.integers(0, 2**64, j, dtype=np.uint64)]) for h in sets for k, j in [(0, len(h) // 4), (len(h) // 5, 0), (len(h) // 9, len(h) // 9)]]
    bits = [jaccard_dedup.parities(h) for h in (*sets, *near)]
    got = jaccard_dedup.possible(bits, bits, 0.8, np.zeros((len(bits), len(bits)), bool))
    both = [set(h.tolist()) for h in (*sets, *near)]
    like = np.array([[len(a & b) / len(a | b) for b in both] for a in both])
    assert got[like >= 0.8 - 1e-9].all() and not got[like < 0.6].any() and (like >= 0.8 - 1e-9).sum() > 3 * len(near)
    assert not jaccard_dedup.possible(bits, bits, 0.8, like < 2).any()


# --- segmentations --------------------------------------------------------------
def test_random_numbers_leave_their_keys_alone():
    """Numbers are drawn in place: keys keep their values, and one by one or in a row gives the same."""
    keys, places = np.arange(50, dtype=np.uint64), np.arange(50, dtype=np.int64)
    base = sp_sampling.mix(keys)
    u = sp_sampling.uniform(base, places, sp_sampling.SPLIT)
    assert (keys == np.arange(50)).all() and (places == np.arange(50)).all() and (base == sp_sampling.mix(keys)).all()
    assert [float(sp_sampling.uniform(base[i], i, sp_sampling.SPLIT)) for i in range(50)] == u.tolist()
    assert ((u > 0) & (u < 1)).all() and len(set(u.tolist())) == 50


def test_pieces_of_arcs_with_several_ids():
    vocab = sp_sampling.vocabulary(sp_sampling.MODEL)
    texts = ["a \u6f22\U0001f600 b", "", "then \u2603"]
    for text, found in zip(texts, sp_sampling.sample(texts, np.arange(3, dtype=np.uint64), vocab, 2)):
        assert all(vocab.decode(p) == text.encode() for *_, p in found)
