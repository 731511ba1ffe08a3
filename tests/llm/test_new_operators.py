"""Divergence audit, lexical search and the forest of embeddings, by SQL and by brute force."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftloom.llm import divergence, forest, lexical, registry
from shiftloom.llm.terms import LETTERS, LETTERS_AND_DIGITS, split_terms

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, term string, n long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_divergence", "op12_lexical"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    assert got.columns == want.columns
    assert rows(got) == sorted(want.fetchall())


def test_terms_by_characters():
    import pyarrow as pa

    texts = [None, "", "Ünï-Cafe 9a\x00b c", "\U0001f600x y", "A" * 5000, "½ ²x\x7fE\x80"]
    for table, pattern in ((LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), (LETTERS_AND_DIGITS, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        for column in (pa.array(texts), pa.array(["x", *texts]).slice(1)):
            words, lengths = split_terms(column, table)
            want = [re.findall(pattern, lower(t)) for t in texts]
            assert lengths.tolist() == [len(w) for w in want]
            assert words.to_pylist() == sum(want, [])


def audit(docs):
    """op11's rules, term by term."""
    docs = [(lower(t), lang or "", source or "") for t, lang, source in docs]
    held, of = {}, {}
    for t, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)
        held.setdefault(lang, Counter()).update(set(terms))
        of.setdefault((lang, source), Counter()).update(terms)
    out = []
    for (lang, source), own in of.items():
        kept = [w for w, d in held[lang].items() if d >= 10]

        def p(counts, w, kept=kept):
            return 1 + 10**9 * (counts[w] + 2) // (sum(counts[k] for k in kept) + 2 * len(kept))

        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [("pair", s, sum(f(p(own, w), p(c, w)) for w in kept)) for (la, s), c in of.items() if la == lang and s != source]
        every = sum((c for (la, _), c in of.items() if la == lang), Counter())
        terms = [("term", w, f(p(own, w), p(every, w))) for w in kept if own[w] and p(own, w) > p(every, w)]
        for part, most in ((pairs, None), (terms, 10)):
            part.sort(key=lambda x: (-x[2], x[1].encode()))
            out += [(lang, source, k, item, v, i + 1) for i, (k, item, v) in enumerate(part[:most])]
    return sorted(out)


def test_divergence_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 20)
    rng = np.random.default_rng(5)
    words = [f"w{'abcdefghij'[i % 10]}{'é' * (i // 10)}" for i in range(40)]
    docs = [(" ".join(words[min(39, int(rng.exponential(9)))] for _ in range(rng.integers(0, 30))), ["en", "de", None, ""][int(rng.choice(4, p=[0.7, 0.1, 0.1, 0.1]))], [None, "a", "b", "ç", "Z"][int(rng.choice(5, p=[0.1, 0.5, 0.2, 0.1, 0.1]))]) for _ in range(160)]
    docs += [(None, "en", "silent"), ("", "en", "silent"), ("xx yy", "few", "a"), ("xx", "few", "b"), ("1 2 3", "none", "q")]
    docs += [docs[3]] * 40  # copies
    df = spark.createDataFrame([(i, t, la, s, "clash", i) for i, (t, la, s) in enumerate(docs)], DOCS).repartition(7)
    want = audit(docs)
    assert rows(divergence.divergence(df)) == want
    assert {("few", "a", "pair", "b", 0, 1), ("few", "b", "pair", "a", 0, 1)} <= set(want)
    assert any(r[1] == "silent" for r in want)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_shares_are_exact(spark):
    big = 8 * 10**15
    cases = [(0, 7), (2, 3), (big - 1, big), (big, big), (12345678901234, 98765432109876), (3, big)]
    want = [1 + 10**9 * n // t for n, t in cases]
    df = spark.createDataFrame(cases, "n long, t long")
    assert [r[0] for r in df.select(divergence.share(F.col("n"), F.col("t"))).collect()] == want
    assert [int(divergence.shares(np.array([n]), t)[0]) for n, t in cases] == want


def test_columns_are_runs():
    kinds, repeats = [[(0, 2)], [(0, 2), (2, 1)], [(2, 5)], [(1, 1), (2, 1)]], [3, 1, 2, 4]
    columns = divergence.columns_of(kinds, repeats, 4)
    order = sorted(range(4), key=kinds.__getitem__)
    for s, (starts, values) in enumerate(columns):
        flat = [dict(kinds[i]).get(s, 0) for i in order for _ in range(repeats[i])]
        spread = np.repeat(values, np.diff(np.append(starts, sum(repeats))))
        assert spread.tolist() == flat
        assert (values[1:] != values[:-1]).all()


def best(docs, items, k=10):
    """op12's rules, document by document."""
    held = [(i, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for i, t in docs]
    n, total = sum(1 for _, w in held if w), sum(len(w) for _, w in held)
    df = Counter(w for _, ws in held for w in set(ws))
    tfs = [(i, len(ws), Counter(ws)) for i, ws in held if i is not None]
    out = []
    for item, text in items:
        asked = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text)))
        scores = []
        for i, size, tf in tfs:
            m = 10 + 90 * size * n // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in asked if tf[w])
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def corpus(seed, n, most=60):
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(0, n)) if rng.random() < 0.2 else i, " ".join(f"t{int(min(400, rng.pareto(0.7)))}" for _ in range(int(rng.integers(0, most))))) for i in range(n)]


def test_lexical_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "STRIP", 64)
    monkeypatch.setattr(lexical, "BLOCK", 8)
    monkeypatch.setattr(lexical, "SHARD_DOCS", 150)
    docs = [*corpus(1, 900), (None, "t1 t2 t399 lost"), (5000, None), (5001, ""), (5002, "!? .."), (5003, "t1 " * 40_000 + "É9"), *[(6000 + i, "same t3 words t9") for i in range(300)]]
    items = [(1, "T1 t2, t17; t3"), (2, "t399 t0 t200 nowhere"), (3, None), (4, ""), (5, "É9 t1 t1 t1"), (6, "nowhere at all"), (2, "same words"), (None, "t5 t7"), (7, " ".join(f"t{i}" for i in range(60)))]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, score long").repartition(3)
    q = spark.createDataFrame([(i, t, 2.0) for i, t in items], "item_id long, text string, rank double")
    got = lexical.ranked(d, q)
    assert sorted((tuple(r) for r in got.collect()), key=str) == best(docs, items)
    assert lexical.ranked(d.limit(0), q).count() == 0 and lexical.ranked(d, q.limit(0)).count() == 0
    monkeypatch.setattr(lexical, "ITEM_BYTES", 40)
    assert sorted((tuple(r) for r in lexical.ranked(d, q).collect()), key=str) == best(docs, items)


def test_block_maxima_save_decompression(monkeypatch):
    """Most blocks of a frequent term stay closed once rarer terms have filled the heap."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [("rare " * 3 if i % 97 == 0 else "") + "the " * int(1 + 8 * (i // 600 % 5 == 0)) + "word " * int(rng.integers(20, 60)) for i in range(20_000)]
    batch = pa.record_batch({"doc_id": pa.array(range(20_000)), "text": pa.array(texts)})
    terms = pa.array(["rare", "the"])
    [row] = [b for b in lexical.index_shards(iter([batch]), terms)]
    r = {c: row.column(c)[0].as_py() for c in row.schema.names}
    shard = lexical.Shard.read(r, r["filled"], r["words"])
    got, scores = lexical.search(shard, [(0, 4000), (1, 30)], 10)
    blocks = len(shard.columns["places"])
    assert len(shard.opened) < blocks / 2
    m = [10 + 90 * len(t.split()) * r["filled"] // r["words"] for t in texts]
    full = [(-sum(w * (10**9 * t.split().count(x) // (1000 * t.split().count(x) + 8 * m[i])) for x, w in (("rare", 4000), ("the", 30)) if x in t.split()), i) for i, t in enumerate(texts)]
    assert list(zip(got.tolist(), scores.tolist())) == [(i, -s) for s, i in sorted(full)[:10]]


def linked(x, ids, least=0.9):
    """Links and components of usable rows by all pairs."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    root = forest.roots(len(x), *np.nonzero(near))
    low = {r: min(ids[root == r]) for r in set(root.tolist())}
    return near.sum(1), np.array([low[r] for r in root.tolist()])


def vectors(seed, dim=32):
    """Pairs at 0.9 and a little more, chains, a crowd in a narrow ball with a fringe, and strangers."""
    rng = np.random.default_rng(seed)
    one = lambda n: forest.unit(rng.standard_normal((n, dim)))

    def at(x, cos):
        off = rng.standard_normal(x.shape)
        off -= (off * x).sum(1)[:, None] * x
        return cos * x + np.sqrt(1 - cos**2) * forest.unit(off)

    strangers, heart = one(600), one(1)
    pairs = at(strangers[:200], rng.uniform(0.9001, 0.93, (200, 1)))
    crowd, fringe = at(np.repeat(heart, 900, 0), rng.uniform(0.985, 0.999, (900, 1))), at(np.repeat(heart, 60, 0), rng.uniform(0.9, 0.96, (60, 1)))
    chain = [one(1)]
    for _ in range(8):
        chain.append(at(chain[-1], 0.93))
    return np.concatenate([strangers, pairs, crowd, fringe, *chain, at(strangers[200:300], 0.85)]) * rng.uniform(0.01, 50, (600 + 200 + 900 + 60 + 9 + 100, 1))


@pytest.mark.parametrize("bounds", [(20_000, 512, 1024), (500, 16, 64)])
def test_forest_brute_force(spark, monkeypatch, bounds):
    for name, value in zip(("SAMPLE", "LEAF", "BLOCK"), bounds):
        monkeypatch.setattr(forest, name, value)
    x = vectors(7)
    ids = np.random.default_rng(1).permutation(len(x)) * 3
    df = spark.createDataFrame([(int(i), v.tolist(), "a", 0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, row string, ball int").repartition(5)
    got = {r.vec_id: r for r in forest.near_duplicates(df).collect()}
    links, low = linked(x, ids)
    found = np.array([got[i].n_links for i in ids.tolist()])
    assert len(got) == len(x) and (found <= links).all()
    assert found.sum() >= 0.97 * links.sum()
    assert found[:800].sum() >= 0.93 * links[:800].sum()  # pairs just over the threshold
    assert (found[-100:] == 0).all()
    same = np.array([got[i].component_id for i in ids.tolist()]) == low
    assert same.mean() > 0.97 and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    crowd = slice(800, 1700)
    assert found[crowd].sum() >= 0.97 * links[crowd].sum()


def test_forest_edges(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [nan, 1.0, 0.0]), (6, [inf, 1.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    good = [(20, [1.0, 0.0, 0.0]), (10, [2.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.0]), (30, [1e200, 0.0, -0.0]), (31, [0.0, 5e-300, 0.0]), (32, [-1.0, 0.0, 0.0]), (40, [1.0, 0.0]), (41, [1.0, 0.1]), (50, [3.0]), (51, [-3.0]), (52, [4.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in odd + good], "vec_id long, embedding array<double>, component_id string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in forest.near_duplicates(df).collect()), key=str)
    want = [(i, 0, i, True) for i, _ in odd] + [(20, 3, 10, False), (10, 3, 10, True), (10, 3, 10, True), (30, 3, 10, False), (31, 0, 31, True), (32, 0, 32, True), (40, 1, 40, True), (41, 1, 40, False), (50, 1, 50, True), (51, 0, 51, True), (52, 1, 50, False)]
    assert got == sorted(want, key=str)
    assert forest.near_duplicates(df.limit(0)).count() == 0
    hot = spark.range(4000).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 3000, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.cos("id"), F.sin("id"))).alias("embedding"))
    r = forest.near_duplicates(hot).where("vec_id = 5").first()
    assert r.n_links >= 2999 and r.component_id == 0


def test_crowds_leave_no_pairs(spark):
    """What leaves the leaves is a row for each class, however many links a crowd has."""
    rng = np.random.default_rng(2)
    x = forest.unit(np.ones((1, 16))) + 0.02 * rng.standard_normal((3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = forest.near_duplicates(df)
    assert out.agg(F.min("n_links"), F.max("component_id")).first() == (2999, 0)
    trees, balls = forest.fit(forest.unit(x), 3000, 0.9, 1)
    assert len(balls) == 1
