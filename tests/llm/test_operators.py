"""Training-data operators against brute force, held-out rows and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelspark.llm import (
    decontaminate,
    embedding_dedup,
    jaccard_dedup,
    license_scan,
    quality,
    queries,
    resharding,
    secret_scan,
    simhash_dedup,
    sp_sampling,
    suffix_dedup,
    url_filter,
)
from panelspark.llm.common import components, table

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} filler" for i in range(20_000))
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "Same text here twice, over and over again. " * 6),
       (6, "Same text here twice, over and over again. " * 6), (6, "Same text here twice, over and over again. " * 6), (7, LONG), (None, "no id at all"), (8, "é▁ 漢字 \x00 🙂  two  spaces")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    # further columns whose names clash with the operators' own
    for c in ("fp", "key", "h", "size", "score", "bad_id", "item_id", "n", "w", "lang", "part"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def labels(spark):
    return table(spark, SF, "labels")


# --- quality ---------------------------------------------------------------
def test_quality_ranks_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op1(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_quality_edges(spark, odd, empty):
    rows = quality.score(odd, labels(spark)).collect()
    assert len(rows) == len(ODD) and all(r.score is not None for r in rows)
    assert quality.score(empty, labels(spark)).count() == 0
    assert {r.score for r in quality.score(odd, labels(spark).limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, labels(spark)).columns == odd.columns


def test_isotonic_is_monotone():
    _, v = quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 0, 1.0]), np.ones(6))
    assert list(v) == sorted(v) and v[0] == 0 and v[-1] == 1


# --- urls --------------------------------------------------------------------
def test_url_rules(spark):
    got = url_filter.op2(spark, SF).collect()
    pages = {r.page_id: r.url for r in table(spark, SF, "pages").collect()}
    for r in got:
        rest = pages[r.page_id].split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(rule), rule, v) for v, rule in url_filter.RULES for h, _, p in [rule.partition("/")]
                if (("." + host.lower()).endswith("." + h)) and path.startswith("/" + p)]
        assert (r.host, r.path) == (host.lower(), path)
        assert r.rule == (max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")


def test_url_edges(spark):
    data = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.Com?x://y"), (5, "HTTP://A.Com?x://y"), (6, "http://com/en/" + "a" * 50_000)]
    df = spark.createDataFrame(data, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("suffix", F.lit(1)).withColumn("y", F.lit(1))
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert [(got[i].host, got[i].path) for i in (1, 2, 3, 4)] == [("", "")] * 4
    assert (got[5].host, got[5].path) == ("a.com", "") and got[6].verdict == "block"
    assert url_filter.judge(df.limit(0)).count() == 0


# --- suffixes ----------------------------------------------------------------
def test_suffix_order():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randint(1, rng.choice([2, 3, 9])) for _ in range(rng.randint(1, 60))]
        assert suffix_dedup.suffix_order(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                mark[i : i + 100] = True
            seen.add(b[i : i + 100])
        kept = bytes(np.frombuffer(b, np.uint8)[~mark])
        spans = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        out[d] = (len(b), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("big", [2_000, 1])
def test_suffix_dedup(spark, docs, monkeypatch, big):
    monkeypatch.setattr(suffix_dedup, "BIG", big)
    want = brute_repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert all(want[r.doc_id] == tuple(r)[1:] for r in suffix_dedup.dedup(docs).collect())


def test_suffix_edges(odd, empty):
    got = defaultdict(list)
    for r in suffix_dedup.dedup(odd).collect():
        got[r.doc_id].append(r)
    assert got[1][0].n_bytes == got[2][0].n_bytes == 0 and got[1][0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[5][0].n_removed > 0  # its own sentence repeats
    assert [r.n_removed for r in got[6]] == [len(ODD[4][1])] * 2
    assert suffix_dedup.dedup(empty).count() == 0


def test_repeated_rows_are_one_document(spark):
    rng = random.Random(3)
    t, u = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(2))
    rows = [(9, t), (9, t), (None, u), (None, u), (12, t[:250] + "#" * 30), (3, "x" * 300), (3, "x" * 300)]
    got = Counter((r.doc_id, r.n_removed) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == Counter({(9, 0): 2, (None, 0): 2, (12, 250): 1, (3, 299): 2})
    one = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert Counter((r.doc_id, r.n_removed) for r in one) == got


# --- segmentations -----------------------------------------------------------
def test_samples_round_trip(docs, odd, empty):
    for df in (docs.where("length(text) < 3000"), odd):
        rows = sp_sampling.encode(df).collect()
        assert all(r.round_trip for r in rows)
        by = defaultdict(list)
        for r in rows:
            by[r.doc_id].append(r)
        assert all(len({tuple(x.pieces) for x in v}) == len({x["rank"] for x in v}) for v in by.values())
    back = {(r.doc_id, r.text) for r in sp_sampling.decode(sp_sampling.encode(odd)).collect()}
    assert back == {(d, t or "") for d, t in ODD}
    assert sp_sampling.encode(empty).count() == 0


def test_samples_follow_the_lattice():
    vocab = sp_sampling.vocabulary(sp_sampling.MODEL)
    n = 6000
    res = sp_sampling.sample(["then a"] * n, np.arange(n, dtype=np.uint64), vocab, 2)
    lp = {tuple(x[3]): x[0] for r in res for x in r}
    first, second = (Counter(tuple(r[i][3]) for r in res) for i in (0, 1))
    for path, v in sorted(lp.items(), key=lambda x: -x[1])[:3]:
        p = math.exp(v)
        after = sum(math.exp(w) * p / (1 - math.exp(w)) for q, w in lp.items() if q != path)
        assert abs(first[path] / n - p) < 0.03 and abs(second[path] / n - after) < 0.03
    # inclusion scores make the count of all segmentations' mass unbiased
    assert abs(np.mean([sum(math.exp(x[0] - x[2]) for x in r) for r in res]) - 1) < 0.02


# --- shards ------------------------------------------------------------------
def test_sharding(docs, odd, empty):
    for df in (docs, odd):
        rows = resharding.reshard(df).collect()
        load, slots = Counter(), defaultdict(list)
        for r in rows:
            load[r.shard] += r.size
            slots[r.shard].append(r.slot)
        assert len(rows) == df.count() and all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert len({r.text_crc32 for r in rows}) == len({(r.text_crc32, r.shard) for r in rows})
    assert max(Counter(r.shard for r in resharding.reshard(docs).collect()).values()) < docs.count()
    assert resharding.reshard(empty).count() == 0


def test_flow_moves_the_least():
    flow = resharding.min_cost_flow([10, 0, 5], [5, 5, 5], lambda i, j: int(i != j))
    assert [sum(r) for r in flow] == [10, 0, 5] and flow[0][0] == 5 and flow[2][2] == 5
    with pytest.raises(ValueError):
        resharding.min_cost_flow([3], [1, 1], lambda i, j: 0)


def test_rewrite_touches_moved_shards(spark, docs, tmp_path):
    placed = resharding.reshard(docs, n_new=4, n_old=4).cache()
    touched = resharding.rewrite(docs.select("doc_id", "text"), placed, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).count()
    assert got == placed.where(F.col("shard").isin(touched)).count()


def test_rewrite_keeps_every_row(spark, tmp_path):
    data = [(1, f"text {i}") for i in range(40)] + [(2, "same")] * 5 + [(None, f"none {i}") for i in range(20)] + [(None, "same")] * 3 + [(3, None), (3, "")]
    made = spark.createDataFrame(data, "doc_id long, text string")
    placed = resharding.reshard(made, n_new=2, n_old=3, n_blocks=64).cache()
    out = str(tmp_path / "out")
    spark.createDataFrame([(9, "old", 0, 2)], "doc_id long, text string, slot long, shard int").write.partitionBy("shard").parquet(out)
    touched = resharding.rewrite(made, placed, out)
    assert touched == [0, 1, 2]
    got = spark.read.parquet(out).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(data)  # nor is the old row of the emptied shard there
    want = {(r.shard, r.slot): (r.doc_id, r.text_hash) for r in placed.collect()}
    th = {r.text: r.h for r in made.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    assert {(r.shard, r.slot): (r.doc_id, th[r.text]) for r in got} == want


# --- secrets -----------------------------------------------------------------
def brute_secrets(t):
    out = []
    for m in re.finditer(secret_scan.ASSIGN, t, re.I | re.A):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 8 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets(spark, docs, odd, empty):
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in secret_scan.scan(docs).collect():
        want = brute_secrets(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(secret_scan.show(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in want) for k in range(3))
        assert set(secret_scan.show(want).split(",")) <= set(r.spans.split(","))
    assert len(secret_scan.scan(odd).collect()) == len(ODD) and secret_scan.scan(empty).count() == 0
    assert secret_scan.redact(odd).columns == odd.columns
    assert secret_scan.redact_text("x token = abcdefgh12345 y") == "x [SECRET] y"
    assert secret_scan.redact_text(None) is None and secret_scan.redact_text("plain") == "plain"


def test_guess_cost():
    cost = secret_scan.guess_cost
    assert cost("") == 0 and cost("password") < 1 < cost("aaaaaaaaaaaa") < cost("x9$Kq2!vLr7&")
    assert cost("qwertyuiop") < 5 and cost("20240131") < 5 and cost("p@ssword") < 2
    assert secret_scan.show(secret_scan.spans('pwd: x9$Kq2!vLr7& end')) == "guess:5:17"
    assert secret_scan.spans("auth: password") == []


def test_guesses_reach_beyond_base_spans():
    text = "password = \"hunter22!Xk9$Qz#pW\""
    assert secret_scan.show(secret_scan.spans(text)) == "assign:0:20,guess:12:30"
    assert secret_scan.redact_text(text) == '[SECRET]"'
    assert secret_scan.show(secret_scan.spans("auth: token: zx9$Q!r7pL")) == "guess:13:23"
    assert secret_scan.show(secret_scan.spans("auth:token=zx9$Q!r7pL")) == "guess:5:21"
    assert secret_scan.show(secret_scan.spans("token = abcdefgh12345 y")) == "assign:0:21"
    assert len(secret_scan.spans("auth:" * 200_000)) == 1


# --- licenses ----------------------------------------------------------------
def test_licenses(spark, docs, odd, empty):
    got = {(r.doc_id, r.template) for r in license_scan.scan(docs).collect()}
    sh = [np.unique(license_scan.shingles(t)) for _, t in license_scan.TEMPLATES]
    for r in docs.collect():
        have = license_scan.shingles(r.text)
        whole = {i for i, s in enumerate(sh) if np.isin(s, have).all()}
        assert whole <= {t for d, t in got if d == r.doc_id}
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(empty).count() == 0
    mit = license_scan.TEMPLATES[1][1].upper().replace(",", " ;")
    assert [h[0] for h in license_scan.Index(license_scan.TEMPLATES).find("x " * 500 + mit + " y" * 300, 0.8)] == [1]


# --- benchmark ---------------------------------------------------------------
def test_decontamination(spark, docs, odd, empty):
    bench = table(spark, SF, "benchmark")
    items = bench.collect()
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in items if b.text in d.text}
    assert want and want <= set(got) and all(got[k].similarity == pytest.approx(1) for k in want)
    words = items[0].text.split()
    near = words[:-2] + ["changed", "ending"]
    extra = [(1, "lead in " + " ".join(near) + " and on"), (2, " ".join(words[: len(words) // 2])), (3, items[1].text.upper())]
    made = spark.createDataFrame(extra, "doc_id long, text string")
    hit = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(made, bench).collect()}
    assert (3, items[1].item_id) in hit and (1, items[0].item_id) in hit and not any(d == 2 for d, _ in hit)
    short = spark.createDataFrame([(1, "over and over again"), (2, None), (3, "")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(odd, short).collect()} == {5, 6}
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns


def test_decontamination_finds_items_of_a_template(spark):
    template = [f"t{i}" for i in range(19)]
    items = [(k, template + [f"i{k}x{i}" for i in range(15)]) for k in range(200)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    # each text holds the 15 shingles of its item that no other has
    made = spark.createDataFrame([(k, " ".join([f"a{k}y{i}" for i in range(30)] + w[15:] + [f"z{k}y{i}" for i in range(30)])) for k, w in items], "doc_id long, text string")
    got = decontaminate.contaminated(made, bench).collect()
    want = math.log1p(200) / (math.log1p(200) + math.log1p(1))
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(200)}
    assert all(r.similarity == pytest.approx(want, abs=1e-6) for r in got)


def test_decontamination_stays_native(docs, spark):
    plan = decontaminate.contaminated(docs, table(spark, SF, "benchmark"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- SimHash -----------------------------------------------------------------
def brute_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, linked):
    up = {i: i for i, _ in items}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(items):
        for j, b in items[:n]:
            if linked(a, b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i in up}


def test_simhash(spark, docs, odd, empty):
    text = {r.doc_id: r.text for r in docs.collect()}
    got = simhash_dedup.op9(spark, SF).collect()
    assert all(int(r.fingerprint, 16) == brute_fingerprint(text[r.doc_id]) and len(r.fingerprint) == 16 for r in got)
    want = brute_components([(r.doc_id, int(r.fingerprint, 16)) for r in got], lambda a, b: (a ^ b).bit_count() <= 2)
    assert {r.doc_id: r.component_id for r in got} == want
    rows = simhash_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert simhash_dedup.near_duplicates(empty).count() == 0
    kept = [r.doc_id for r in simhash_dedup.keep_one(odd).collect()]
    assert 5 in kept and 6 not in kept and None in kept


def test_simhash_links_are_whole(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {f ^ sum(1 << b for b in rng.sample(range(64), k)) for f in base for k in (0, 1, 2, 3, 4)}
    items = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in items], "id long, fp long")
    got = {(r.a, r.b) for r in simhash_dedup.links(df).collect()}
    assert got == {(i, j) for i, a in items for j, b in items if i < j and (a ^ b).bit_count() <= 2}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(3, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 7 for i in range(200, 260)) and 3 not in got


def brute_shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("block", [256, 2])
def test_near_dedup_stage_against_brute_force(spark, docs, monkeypatch, block):
    import corpus_pipeline

    monkeypatch.setattr(jaccard_dedup, "BLOCK", block)
    monkeypatch.setattr(jaccard_dedup, "BLOCK_SHINGLES", block * 1000)
    rng, data = random.Random(8), [(r.doc_id, r.text) for r in docs.collect()]
    for k in range(12):  # copies about the bound: each changed word changes up to five shingles
        base = [f"w{k}x{i}" for i in range(200)]
        for n in range(8):
            words = list(base)
            for i in rng.sample(range(200), n):
                words[i] = f"new{n}y{i}"
            data.append((100_000 + 10 * k + n, " ".join(words)))
    sets = [(d, brute_shingles(t)) for d, t in data]
    like = lambda a, b: not a and not b or len(a & b) >= 0.8 * len(a | b) - 1e-9
    want = {d for d, root in brute_components(sorted(sets, key=lambda x: x[0]), like).items() if d == root}
    made = spark.createDataFrame(data, "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, made, SF).collect()]
    assert sorted(got) == sorted(want) and len(want) < len(data) - 12


# --- embeddings --------------------------------------------------------------
def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    v = np.vstack([base, base[:30] + 0.12 * rng.standard_normal((30, 16)), base[:5], base[:5] * 3])
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    data += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None] + [1.0] * 15), (205, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("list", F.lit(1)).withColumn("v", F.lit(1))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T >= 0.9
    want = brute_components(list(enumerate(range(len(v)))), lambda a, b: s[a, b])
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(data)
    assert {i: got[i].component_id for i in want} == want
    assert {i: got[i].n_links for i in want} == {i: int(s[i].sum()) - 1 for i in want}
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(200, 206))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# --- pipeline ----------------------------------------------------------------
def test_pipeline(spark, docs):
    import corpus_pipeline

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == docs.columns, name
        assert after.count() <= now.count()
        now = after.cache()
    want = {r.doc_id for r in now.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_queries_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 11))
