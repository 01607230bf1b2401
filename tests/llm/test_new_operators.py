"""Quality rules, source divergence and collocations against brute force and on odd rows."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelspark.llm import collocations, quality_rules, queries, source_divergence
import oracle  # noqa: I001  (tests/oracle.py, beside conftest)

SF = "/root/testdata/sf0.001"
WORDS = "[^\x20\x09-\x0d]+"
NEW = ["op11_quality_rules", "op12_source_divergence", "op13_phrase_collocations"]
LONG = "the cat sat. " * 3_000 + " ".join(f"w{i}" for i in range(40_000))
ODD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, "  \n\t ", None, "b"), (4, "one", "en", "a"), (5, "x y z x y z\nx y z x y z\n\n", "en", "a"),
    (6, "Same line here.\n" * 40, "de", "a"), (6, "Same line here.\n" * 40, "de", "a"), (7, LONG, "en", "c"), (None, "no id at all", "", ""),
    (8, "é▁ 漢字 \x00 🙂  two  spaces a\tb; c|d #$ É", "fr", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    for c in ("w", "v", "m", "n", "a", "b", "x", "y", "term", "phrase", "rank", "df", "_lang", "item", "k", "f", "kept"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.mark.parametrize("name", NEW)
def test_sql_oracle(spark, name):
    q, o = queries.queries(), queries.oracle_sql()
    assert oracle.differences(q[name](spark, SF), oracle.connect(SF).sql(o[name])) == ""


# --- rules -----------------------------------------------------------------
def brute_rules(text):
    text = text or ""
    w = re.findall(WORDS, text)
    lines = [x for x in text.split("\n") if re.search(WORDS, x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_of_odd_rows(spark, odd):
    got = quality_rules.judge(odd).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(
        ((i, *brute_rules(t)) for i, t, _, _ in ODD), key=key
    )
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept) and r.kept == (r.failed == "")
    assert quality_rules.judge(odd.limit(0)).count() == 0


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    """Without hash bits all windows are neighbours and the words decide."""
    texts = [(i, t) for i, (_, t, _, _) in enumerate(ODD) if t and len(t) < 2_000] + [(99, "a b c d a b c e d a b f " * 3)]
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 62)
    got = quality_rules.judge(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: brute_rules(t)[4] for i, t in texts}


def test_rules_use_no_python_and_no_shuffle(spark):
    df = quality_rules.op11(spark, SF).where("kept")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas", plan) and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


# --- divergence ------------------------------------------------------------
def brute_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", [t.lower() if t.isascii() else re.sub("[A-Z]+", lambda m: m.group().lower(), t) for t in re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for _, text, lang, source in rows]
    df, n, out = Counter(), Counter(), []
    for lang, source, terms in docs:
        n.update((lang, source, t) for t in terms)
        df.update((lang, t) for t in set(terms))
    for lang in {d[0] for d in docs}:
        kept = [t for (x, t), k in df.items() if x == lang and k >= min_docs]
        sources = {d[1] for d in docs if d[0] == lang}
        v, total = len(kept), {t: sum(n[lang, s, t] for s in sources) for t in kept}
        size = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (n[lang, s, t] + 2) // (size[s] + 2 * v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (total[t] + 2) // (sum(total.values()) + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(-f(p[s][t], q[t]), t) for t in kept if n[lang, s, t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -value, i) for i, (value, item) in enumerate(items, 1)]
    return sorted(out)


@pytest.mark.parametrize("min_docs", [1, 2, 10])
def test_audit_of_odd_rows(odd, min_docs):
    got = source_divergence.audit(odd, min_docs, 10)
    assert sorted(map(tuple, got.collect())) == brute_audit(ODD, min_docs, 10)
    assert source_divergence.audit(odd.limit(0)).count() == 0


def test_terms_flushed_early_count_alike(odd):
    docs = odd.select("lang", "source", "text").na.fill("")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(source_divergence.term_counts(docs, held=1)) == key(source_divergence.term_counts(docs))


# --- collocations ----------------------------------------------------------
def brute_grams(rows):
    f = Counter()
    for _, text, lang, _ in rows:
        low = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            f.update(("und" if lang is None else lang, k, " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    return f


def brute_mine(f, least, top):
    f = Counter({x: n for x, n in f.items()})
    big = {x: n for x, n in f.items() if n >= least and x[1] > 1}
    gone, by_lang = set(), defaultdict(list)
    for (lang, k, phrase), n in big.items():
        w = phrase.split(" ")
        if k == 3:
            gone |= {(lang, 2, p) for p in (" ".join(w[:2]), " ".join(w[1:])) if 100 * n >= 50 * f[lang, 2, p]}
    for (lang, k, phrase), a in big.items():
        if (lang, k, phrase) in gone:
            continue
        w, cuts = phrase.split(" "), []
        for i in range(1, k):
            left, right = f[lang, i, " ".join(w[:i])], f[lang, k - i, " ".join(w[i:])]
            cuts.append((10**6 * a * a // (left * right), i, left, right))
        score, _, left, right = min(cuts)
        by_lang[lang].append((-score, -a, phrase.encode(), left, right))
    total = Counter()
    for (lang, k, _), n in f.items():
        total[lang] += n * (k == 1)
    return sorted((lang, i, p.decode(), -a, x, y, total[lang], -s) for lang, rows in by_lang.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1))


@pytest.mark.parametrize("least,top,cells", [(1, 60_000, 1 << 16), (2, 3, 1 << 16), (10, 2_000, 1 << 20)])
def test_phrases_of_odd_rows(odd, least, top, cells):
    got = collocations.mine(odd, least, top, max_cells=cells)
    assert sorted(map(tuple, got.collect())) == brute_mine(brute_grams(ODD), least, top)
    assert collocations.mine(odd.limit(0)).count() == 0


@pytest.mark.parametrize("size", [40, 300, 4 << 20])
def test_slices_count_every_phrase_once(monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "CHUNK_BYTES", size)
    rows = [r for r in ODD if not r[1] or len(r[1]) < 2_000] + [(9, "a b c. d, e  f\tg; " * 40 + "long" * 30 + " h i j " * 20, "en", "a")]
    batch = pa.RecordBatch.from_arrays([pa.array(["und" if r[2] is None else r[2] for r in rows]), pa.array([(r[1] or "").encode() for r in rows])], names=["lang", "text"])
    f = Counter()
    for lang, text, again in collocations._chunks([batch]):
        words, found = collocations._grams(text, again)
        for k, (parts, counts) in enumerate(found, 1):
            for *at, n in zip(*parts, counts):
                f[lang, k, b" ".join(words[i] for i in at).decode()] += int(n)
    assert f == brute_grams(rows)


def test_hot_words_are_salted(odd, monkeypatch):
    monkeypatch.setattr(collocations, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, collocations.mine(odd, 2, 50).collect())) == brute_mine(brute_grams(ODD), 2, 50)
