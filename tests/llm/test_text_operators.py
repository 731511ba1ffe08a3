"""Decontamination, SimHash, substring dedup, language, scoring and neighbours against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from shiftloom.llm import attention, components, decontamination, language, neighbours, scoring, simhash, substring, words

SF = "/root/testdata/sf0.001"
ODD = [(None, None), (None, None), (1, ""), (1, ""), (2, " \t\n"), (3, "a"), (3, "a b"), (4, "x " * 30_000), (5, "ñ é \u00a0 \x1f ok"), (6, "!!! 123")]


def frame(spark, rows, more=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"row": F.lit(1), "text_hash": F.lit("x"), "u": F.lit(2.0)}) if more else df


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_seeds_meet_in_every_tolerated_overlap(spark):
    rows = []
    for n in range(8, decontamination.WINDOW + 1):
        for bad in itertools.combinations(range(n), n - -(-n * 8 // 10)):
            rows.append((n, str(bad), [f"w{i}" for i in range(n)], [f"{'x' if i in bad else 'w'}{i}" for i in range(n)]))
    df = spark.createDataFrame(rows, "n int, bad string, a array<string>, b array<string>")
    one, two = (decontamination.seeds(df.select("n", "bad", c), c, decontamination.MASKS) for c in "ab")
    met = one.join(two, ["n", "bad", "at", "seed"]).select("n", "bad").distinct()
    assert met.count() == len(rows)


def test_short_items_match_as_whole_runs(spark):
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "one two three four five six seven"), (3, "!!"), (4, "Solo"), (5, "a b c d e f g h i j")], "item_id long, text string")
    docs = [(1, "x alpha, BETA y"), (2, "alpha x beta"), (3, "so one two three four five six seven"), (4, "one two three four five six eight"), (5, "solo"), (6, ""), (7, "z a b c X e f Y h i j z")]
    got = {(r.doc_id, r.item_id, r.doc_start) for r in decontamination.find_leaks(frame(spark, docs), bench).collect()}
    assert got == {(1, 1, 1), (3, 2, 1), (5, 4, 0), (7, 5, 1)}


def test_leaks_against_brute_force(spark):
    rng = random.Random(1)
    items = [prose(rng, n) for n in (40, 15, 22, 9)]
    docs = []
    for i in range(60):
        d = prose(rng, 80)
        if i % 3 == 0:
            item = list(rng.choice(items))
            for k in rng.sample(range(len(item)), rng.randrange(0, 1 + len(item) // 6)):
                item[k] = "other"
            cut = item[rng.randrange(0, 6) :] if i % 2 else item
            at = rng.randrange(80)
            d[at:at] = cut
        docs.append(d)

    def leaks(d, item):
        w = min(decontamination.WINDOW, len(item))
        need = -(-w * 8 // 10)
        for shift in range(-len(item), len(d)):
            same = [0 <= j + shift < len(d) and d[j + shift] == x for j, x in enumerate(item)]
            inside = [0 <= j + shift < len(d) for j in range(len(item))]
            if any(all(inside[a : a + w]) and sum(same[a : a + w]) >= need for a in range(len(item) - w + 1)):
                return True
        return False

    want = {(i, j) for i, d in enumerate(docs) for j, item in enumerate(items) if leaks(d, item)}
    # Case and punctuation are no substitutions.
    df = frame(spark, [(i, ". ".join(d).upper()) for i, d in enumerate(docs)] + [(k and k + 1000, t) for k, t in ODD])
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)] + [(98, None), (99, "short one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, bench).collect()}
    assert got == want and len(want) > 10
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toArrow())
    con.register("benchmark", bench.toArrow())
    assert Counter(con.sql(decontamination.LEAKS_SQL).fetchall()) == Counter(map(tuple, decontamination.decontamination_query(df, bench).collect()))
    shuffled = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, bench, most=1).collect()}
    assert shuffled == want
    kept = {r.doc_id for r in decontamination.drop_leaks(df, bench).collect()}
    assert kept == {r.doc_id for r in df.collect()} - {i for i, _ in want}
    assert decontamination.find_leaks(df.limit(0), bench).count() == decontamination.find_leaks(df, bench.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    got = components.connected_components(spark.createDataFrame([*edges, (None, 1)], "u long, v long"))
    assert {r.node: r.root for r in got.collect()} == want
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if s and 2 * sum((x >> b) & 1 for x in h) > len(h))


def linked(prints, near):
    root = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= near:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return root


def near_texts(rng, n=60):
    out = []
    for i in range(n):
        base = prose(rng, rng.choice((3, 8, 60)))
        out.append(" ".join(base))
        for _ in range(i % 4):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "Changed"
            out.append(" ".join(copy))
    return out


def test_simhash_against_brute_force(spark):
    texts = near_texts(random.Random(3))
    rows = [(k, t) for k, t in ODD if k] + [(100 + i, t) for i, t in enumerate(texts)]
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = linked(prints, 4)
    low = {r: min(k for (k, _), q in zip(rows, roots) if q == r) for r in roots}
    want = Counter((k, f"{p:016x}", low[r]) for (k, _), p, r in zip(rows, prints, roots))
    got = Counter(map(tuple, simhash.simhash_query(frame(spark, rows)).collect()))
    assert got == want
    assert simhash.simhash_query(frame(spark, rows).limit(0)).count() == 0
    none = simhash.simhash_query(frame(spark, ODD)).where("doc_id IS NULL").first()
    assert none.component_id == 1  # empty texts of doc_id 1 share fingerprint zero


def test_crowded_buckets_are_searched_whole(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), 6)) for _ in range(150)}
    df = spark.createDataFrame([(bytearray(p.to_bytes(8, "big")),) for p in prints], "fingerprint binary")
    rule = simhash.Rule(words=4, bits=64, lanes=1, near=6, similarity=None)
    one = components.connected_components(simhash.fingerprint_links(df, rule))
    two = components.connected_components(simhash.fingerprint_links(df, rule, most=4))
    as_set = lambda x: {(bytes(r.node), bytes(r.root)) for r in x.collect()}
    assert as_set(one) == as_set(two)
    order = sorted(prints)
    want = linked(order, 6)
    assert len(as_set(one)) == sum(Counter(want)[r] > 1 for r in want)


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates_against_exact_similarity(spark):
    """Groups linked at a Jaccard similarity of 0.8 or more, repeated shingles and short texts included;
    texts whose repeated half is equal, or of similarity 0.5, are no copies."""
    rng = random.Random(12)
    texts = ["a b", "A  b", "a c", "", None, "x " * 400 + "one two three", "x " * 400 + "four five six seven eight nine"]
    for _ in range(30):
        base = prose(rng, rng.choice((40, 120, 400)))
        texts.append(" ".join(base))
        for n in (1, 1, 2, 12):
            copy = list(base)
            for _ in range(n):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(99)}"
            texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, list(enumerate(texts)))).collect()}
    assert kept == set(root) and len(kept) < len(texts) - 40


def test_a_crowd_around_one_text_is_found_whole(spark, monkeypatch):
    """Copies that are each like one text, and too far from each other: no copy's nearest need be that text."""
    monkeypatch.setattr(simhash, "CROWD", 100)
    rng = random.Random(17)
    base = prose(rng, 200)
    texts = [" ".join(base)]
    for i in range(400):
        copy = list(base)
        for k in rng.sample(range(200), 4 + i % 2):
            copy[k] = f"own{i}x{k}"
        texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root] if a != b else root
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, list(enumerate(texts)), more=False)).collect()}
    far = kept - set(root)
    assert set(root) <= kept and len(far) <= 0.05 * len(texts) < len(set(root))  # fingerprints too far apart


def test_a_crowd_of_near_copies_is_one_group(spark):
    rng = random.Random(13)
    base = prose(rng, 200)
    rows = []
    for i in range(1500):
        copy = list(base)
        copy[rng.randrange(200)] = f"own{i}"
        rows.append((i + 5, " ".join(copy)))
    df = frame(spark, rows, more=False)
    assert [r.doc_id for r in simhash.drop_near_duplicates(df).collect()] == [5]
    prints = [(bytearray(r.fp),) for r in simhash.with_fingerprints(df, simhash.STAGE, "fp").select("fp").distinct().collect()]
    nodes = spark.createDataFrame(prints, "fp binary")
    assert simhash.fingerprint_links(nodes, simhash.STAGE).count() < 120 * len(prints)  # all pairs: 750 a node
    own = simhash.with_fingerprints(df, simhash.CONTRACT, "fp").select("fp").distinct()
    links = simhash.fingerprint_links(own, simhash.CONTRACT)
    less = simhash.contracted(links)
    parts = lambda x: {(bytes(r.node), bytes(r.root)) for r in components.connected_components(x).collect()}
    assert parts(links) == parts(less) and less.count() <= 3 * own.count()


def test_one_of_each_group_stays(spark):
    rng = random.Random(5)
    base = prose(rng, 300)
    near = [*base]
    near[150] = "other"
    rows = [(5, " ".join(base)), (3, " ".join(near)), (3, " ".join(near)), (None, " ".join(base)), (9, " ".join(prose(rng, 300))), (8, "a b c"), (7, None), (6, "")]
    out = simhash.drop_near_duplicates(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "row", "text_hash", "u"]
    assert sorted(r.doc_id for r in out.collect()) == [3, 6, 8, 9]


def test_substring_against_brute_force(spark):
    rng = random.Random(6)
    passage, again = prose(rng, 60), ["the", "same"] * 40
    rows = list(ODD)
    for i in range(40):
        w = prose(rng, rng.randrange(0, 150))
        if i % 4 == 0:
            w[10:10] = passage[: rng.randrange(30, 60)]
        if i == 7:
            w += again
        rows.append((100 + i, "  ".join(w)))
    rows += [rows[-1], (900, rows[-2][1])]
    width = 35
    lists = [(k, (t or "").encode().split()) for k, t in rows]
    seen = Counter(tuple(w[i : i + width]) for _, w in lists for i in range(len(w) - width + 1))
    want = Counter()
    for k, w in lists:
        keep = [True] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                keep[i : i + width] = [False] * width
        kept = b" ".join(x for x, y in zip(w, keep) if y)
        want[k, len(w), keep.count(False), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(map(tuple, substring.remove_repeats(frame(spark, rows)).collect())) == want
    texts = substring.remove_repeats(frame(spark, rows), digest=False)
    assert Counter(hashlib.sha256(r.kept_text.encode()).hexdigest() for r in texts.collect()) == Counter({h: sum(n for (_, _, _, x), n in want.items() if x == h) for _, _, _, h in want})
    assert substring.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_words_are_cut_like_bytes():
    texts = pa.array(["", None, " a\x0b\x0cb\r\n", "\u00a0x \u2003 y\x1c z", "\x85 q"])
    flat, n = words.split_words(texts)
    assert [w.encode() for w in flat.to_pylist()] == [w for t in texts.to_pylist() for w in (t or "").encode().split()]
    assert n.tolist() == [len((t or "").encode().split()) for t in texts.to_pylist()]
    assert [w for w in words.split_words(scoring.lowered(texts.slice(2)))[0].to_pylist()] == [w.decode() for t in texts.to_pylist()[2:] for w in t.encode().lower().split()]


def cross_parse(text, sample):
    phrases, at = 0, 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and tuple(text[at : at + n]) in sample:
            n += 1
        at, phrases = at + max(1, n - 1), phrases + 1
    return phrases


def test_cross_parsing_against_brute_force():
    samples = (("a", "the cat sat on the mat"), ("b", "le chat est sur la table"))
    p = language.Parser(samples)
    rng = random.Random(14)
    long = "".join(rng.choices("thecaonml sur", k=5000))  # many segments, phrases over their ends
    whole = "the cat sat on the mat" * 40
    for text in ("the cat est sur", "zzz", "on the table le chat", "q", long, whole, "cat sat on q" + long[:300]):
        s = p.symbols(language.code_points(text))
        got = p.phrases([s])[0]
        for (_, sample), bits, scale in zip(samples, got, p.bits):
            own = p.symbols(language.code_points(sample)).tolist()
            parts = {tuple(own[i:j]) for i in range(len(own)) for j in range(i + 1, len(own) + 1)}
            assert bits == pytest.approx(cross_parse(s.tolist(), parts) * scale / len(s))


def test_phrases_go_on_over_segments():
    sample = "".join(chr(0x4E00 + i) for i in range(1056))
    p = language.Parser((("a", sample), ("b", sample[::-1])))
    x = p.symbols(language.code_points(sample))
    bits = p.phrases([x, x[:10], x])
    assert bits[0] == pytest.approx([p.bits[0] / 1056, p.bits[1]]) and (bits[0] == bits[2]).all()


def test_many_letters_take_little_memory():
    rng = np.random.default_rng(15)
    text = "".join(map(chr, 0x4E00 + rng.integers(0, 2500, 24_000)))
    assert language.Parser((("a", text), ("b", text[::-1]))).nbytes < 20_000_000


def test_every_label_is_learned(spark):
    rng = random.Random(16)
    rows = [(i, " ".join("".join(rng.choices(chr(0x4E00 + 20 * (i % 90)) + chr(0x4E01 + 20 * (i % 90)) + "abc", k=5)) for _ in range(40)), f"l{i % 90}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit(1), "score": F.lit("x")})
    out = language.language_query(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r.lang_pred for r in out} == {f"l{i}" for i in range(90)} and sum(r.lang == r.lang_pred for r in out) > 0.95 * len(out)


def test_language_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language.language_query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) > 0.95 * len(out) and all(0 <= r.score <= 1 for r in out)
    odd = frame(spark, ODD).withColumn("lang", F.lit(None).cast("string")).unionByName(docs.select("doc_id", "text", "lang").withColumns({"row": F.lit(1), "text_hash": F.lit("x"), "u": F.lit(2.0)}))
    got = [r for r in language.identify(odd.where("lang IS NULL"), language.labelled_sample(odd, F.lit(True))).collect()]
    assert {r.lang_pred for r in got if r.text is None or not any(c.isalpha() for c in r.text)} == {"und"}
    assert "und" not in {r.lang_pred for r in got if r.text and any(c.isalpha() for c in r.text)}
    nothing = language.language_query(odd.where("lang IS NULL"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"} and language.language_query(odd.limit(0)).count() == 0


def test_attention_is_a_causal_distribution():
    rng = np.random.default_rng(0)
    m = attention.Model.fresh(rng.integers(0, 50, 150).astype(float), rng)
    h = rng.standard_normal((3, attention.DIM)).astype(np.float32)
    total = sum(np.exp(m.unit_logs(h, np.full(3, u))) for u in range(150))
    assert total == pytest.approx(np.ones(3), abs=1e-4)
    a = rng.integers(0, 150, 90)
    b = a.copy()
    b[70:] = rng.integers(0, 150, 20)
    one, two = (m.log10_probability(np.concatenate((x, a[:5])), np.array([90, 5])) for x in (a, b))
    assert one[:70] == pytest.approx(two[:70], abs=1e-5) and one[90:] == pytest.approx(m.log10_probability(a[:5], np.array([5])), abs=1e-5)
    place, valid = attention.windows(np.array([90, 0, 5]))
    assert sorted(place[:, -attention.STRIDE :][valid[:, -attention.STRIDE :]].tolist()) == list(range(95))


def test_attention_gradients():
    rng = np.random.default_rng(1)
    m = attention.Model.fresh(rng.integers(1, 9, 70).astype(float), rng)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    ids = rng.integers(0, 70, (3, attention.LENGTH))
    valid = np.ones_like(ids, bool)
    valid[0, :12] = False
    target = rng.integers(0, 70, (3, attention.STRIDE))
    _, grads = attention.gradients(m, ids, valid, target, m.mask().astype(np.float64))
    for key in ("qx", "kv", "lag", "wg", "bg", "wu", "bu"):
        flat = np.abs(grads[key]).ravel()
        at = np.unravel_index(int(flat.argmax()), grads[key].shape)
        old = m.p[key][at]
        step = []
        for e in (1e-3, -1e-3):
            m.p[key][at] = old + e
            step.append(attention.gradients(m, ids, valid, target, m.mask().astype(np.float64))[0])
        m.p[key][at] = old
        assert (step[0] - step[1]) / 2e-3 == pytest.approx(grads[key][at], rel=0.03, abs=1e-4), key


def test_scores_against_counts(spark, monkeypatch):
    monkeypatch.setattr(scoring.fit_scorer, "__defaults__", (20240504, 60))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(k and k + 5000, t) for k, t in ODD], "doc_id long, text string"))
    rows = scoring.scoring_query(docs.withColumn("row", F.lit(1))).collect()
    import zlib

    own = [(k, (t or "").encode().lower().split()) for k, t in docs.collect()]
    out = {k: zlib.crc32(str(k).encode()) % 5 == 1 if k is not None else False for k, _ in own}
    c = Counter(x for k, w in own if not out[k] for x in (*w, None))
    total, kinds = sum(c.values()), len(c)
    base = lambda w: sum(np.log10((c[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in (*w, None))
    want = sorted((str(k), out[k], len(w) + 1, sum(c[x] > 0 for x in (*w, None)), total, round(base(w), 4)) for k, w in own)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert scoring.scoring_query(docs.limit(0)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit("x"))


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[700:900] = x[700]  # many copies of one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] + [1.0] * 15), (2300, [None] + [1.0] * 15), (2400, [float("inf")] * 16), (2500, [1.0] * 3), (None, [1.0] * 16)]
    got = neighbours.neighbours_query(vectors(spark, rows + bad)).toPandas()
    assert set(got.query_id) == set(range(0, 1500, 100))
    hits = 0
    for q in range(0, 1500, 100):
        far = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        far[q] = np.inf
        best = np.lexsort((np.arange(1500), far))[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, far[own.vec_id])
        assert list(zip(own.score, own.vec_id)) == sorted(zip(own.score, own.vec_id))
        hits += len(set(best) & set(own.vec_id))
    assert hits >= 0.9 * 150
    assert set(got[got.query_id == 700].vec_id) == set(range(701, 711))


def test_lists_grow_with_the_root_of_the_rows(spark, monkeypatch):
    """Beyond the coarse centroids' bound each list has a fine one too; the result is as near, probes are few."""
    monkeypatch.setattr(neighbours, "LISTS", 12)
    monkeypatch.setattr(neighbours, "BLOCK", 256)
    monkeypatch.setattr(neighbours, "HELD", 1000)
    made, keep = [], neighbours.fit
    monkeypatch.setattr(neighbours, "fit", lambda *a: made.append(keep(*a)) or made[-1])
    rng = np.random.default_rng(11)
    middle = rng.standard_normal((40, 16)) * 3
    x = (middle[rng.integers(0, 40, 6000)] + 0.5 * rng.standard_normal((6000, 16))).astype(np.float32)
    x[2000:4000] = x[2000]  # a third: copies
    got = neighbours.neighbours_query(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).toPandas()
    (index,) = made
    assert len(index.coarse) == 12 and len(index.fine) == 6 and index.lists == 72 and index.probes < 36
    own = index.own(x.astype(float))
    assert np.allclose(index.apart(x[:50].astype(float)), [[((v - index.centre(c)) ** 2).sum() for c in range(72)] for v in x[:50].astype(float)])
    assert len(np.unique(own)) > 2 * 12
    hits = 0
    for q in range(0, 6000, 100):
        far = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        far[q] = np.inf
        found = got[got.query_id == q].sort_values("rank")
        assert found["rank"].tolist() == list(range(1, 11)) and np.allclose(found.score, far[found.vec_id])
        hits += len(set(np.lexsort((np.arange(6000), far))[:10]) & set(found.vec_id))
    assert hits >= 0.95 * 600


def test_sample_counts_copies_once(spark, monkeypatch):
    """A vector with nine tenths of the rows is one of the sample, whatever partition it comes from."""
    monkeypatch.setattr(neighbours, "SAMPLE", 200)
    samples, keep = [], neighbours.fit
    monkeypatch.setattr(neighbours, "fit", lambda s, *a: samples.append(s) or keep(s, *a))
    x = np.random.default_rng(12).standard_normal((6000, 4)).astype(np.float32)
    x[:5400] = x[0]
    got = neighbours.neighbours_query(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]))
    assert got.count() == 600 and 150 <= len(samples[0]) <= 200 and len(np.unique(samples[0], axis=0)) == len(samples[0])


def test_release_leaves_tables_of_other_threads(spark):
    from threading import Thread

    from shiftloom.llm import common

    other, before = [], common.mark()
    mine = common.stored(spark.range(5))
    thread = Thread(target=lambda: other.append(common.stored(spark.range(7))))
    thread.start()
    thread.join()
    last = common.stored(spark.range(3))
    common.release(spark, since=before, but=last)
    assert other[0].count() == 7 and last.count() == 3
    with pytest.raises(Exception, match="FAILED_READ_FILE|does not exist|PATH_NOT_FOUND"):
        mine.count()


def test_rows_that_repeat_an_id_are_all_candidates(spark):
    got = neighbours.neighbours_query(vectors(spark, [(0, [1.0, 0.0]), (0, [1.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (7, [5.0, 5.0])])).collect()
    near = Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 3)) for r in got)
    assert near == Counter([(0, 1, 1, 0.0), (0, 2, 1, 0.0), (0, 3, 0, 1.0), (0, 4, 7, 6.403), (0, 1, 0, 1.0), (0, 2, 1, 1.0), (0, 3, 1, 1.0), (0, 4, 7, 5.657)])


def test_few_vectors(spark):
    got = neighbours.neighbours_query(vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (7, [1.0, 1.0])])).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, round(r.score, 6)) for r in got] == [(0, 7, 1.0), (0, 1, 2.236068)]
    assert neighbours.neighbours_query(vectors(spark, [(0, [1.0])])).count() == 0
    assert neighbours.neighbours_query(vectors(spark, [(0, None)])).count() == 0


def test_scores_learn_from_all_words_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SAMPLE_DOCS", 40)
    rng = random.Random(8)
    # A late word stands after the sample's words; it is common in the corpus, the other one unseen.
    rows = [(i, " ".join([*prose(rng, 700, 300), *["zyzzogeton"] * 20])) for i in range(120)]
    rows += [(1000, "zyzzogeton"), (1001, "zyzzogetan")]
    out = {r.doc_id: r for r in scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 1000).collect()}
    assert out[1000].score > out[1001].score + 1.5
    learned = []
    keep = scoring.learn_all
    monkeypatch.setattr(scoring, "learn_all", lambda s, d: learned.append(keep(s, d)))
    scoring.score_documents(spark.createDataFrame(rows[:5], "doc_id long, text string"), F.lit(False))
    ids = sum(len(scoring.word_ids(pa.array(t.split(), pa.large_string()), scoring.VOCABULARY)[0]) + 1 for _, t in rows[:5])
    assert learned == [ids]


def test_vectors_that_share_a_code_are_all_ranked(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "kmeans", lambda x, k, rng, rounds=12: x.mean(0, keepdims=True))
    rng = np.random.default_rng(9)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[300:600] = x[300] + 1e-3 * rng.standard_normal((300, 16)).astype(np.float32)  # a third: near copies
    got = neighbours.neighbours_query(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).toPandas()
    for q in range(0, 900, 100):
        far = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        far[q] = np.inf
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == np.argsort(far)[:10].tolist()


def test_texts_of_no_language_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(10)
    junk = [(10_000 + i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 10))) for _ in range(80)), None) for i in range(20)]
    odd = docs.unionByName(spark.createDataFrame([*junk, (20_000, "word", None), (20_001, "12 !!", "en")], docs.schema))
    kept = {r.doc_id for r in language.keep_identified(odd).collect()}
    assert not kept & set(range(10_000, 10_020)) and 20_000 in kept and 20_001 not in kept
    blank = odd.withColumn("lang", F.lit(None).cast("string"))
    assert language.keep_identified(blank).count() == blank.where(F.col("text").rlike(r"\p{L}")).count()
