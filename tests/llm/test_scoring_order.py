"""Scores don't depend on the order or the splits of the rows; texts of the mixture's fit are learned after it."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shiftloom.llm import attention, scoring
from shiftloom.llm.words import hash_words

SF = "/root/testdata/sf0.001"


def test_row_order_and_splits_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(scoring, "PART_BYTES", 50_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 8000").select("doc_id", "text")
    assert docs.agg(F.sum(F.octet_length("text"))).first()[0] > 2 * scoring.ROUNDS * 50_000
    orders = [docs.repartition(3, "doc_id"), docs.orderBy(F.desc("doc_id")).repartitionByRange(7, F.xxhash64("text"))]
    one, two = ({r.doc_id: (r.score, r.base_score, r.n_known) for r in scoring.scoring_query(d).collect()} for d in orders)
    assert set(one) == set(two)
    for k, (score, base, known) in one.items():
        assert abs(score - two[k][0]) < 1e-3 * abs(score) and abs(base - two[k][1]) < 1e-6 * abs(base) and known == two[k][2]


def test_texts_that_tune_are_learned_last(spark, monkeypatch):
    seen, tuned = [], []
    learn, mix = scoring.learn_all, scoring.fit_mix
    monkeypatch.setattr(scoring, "learn_all", lambda s, d: (seen.extend((r.text, r.draw) for r in d.collect()), learn(s, d))[1])
    monkeypatch.setattr(scoring, "fit_mix", lambda s, tuning, *more: (tuned.extend(tuning), mix(s, tuning, *more))[1])
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 90)))) for i in range(300)]
    scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False))
    first = {t for t, draw in seen if draw < 1 - 1 / scoring.ROUNDS}
    assert 10 < len(tuned) < 60 and len(seen) == 300 and len(first) > 100
    assert set(tuned) <= {t for t, _ in seen} and not set(tuned) & first


def test_texts_not_learned_score_above_their_base(spark):
    """With enough text to learn from; at a tenth of it the two are level (README)."""
    scored = scoring.scoring_query(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out")
    tokens, score, base = scored.agg(F.sum("n_tokens"), F.sum("score"), F.sum("base_score")).first()
    assert tokens > 500_000 and score / tokens > base / tokens + 0.1


def test_frequent_units_stand_in_small_groups():
    """A target costs a number for each group and for each unit of its own: 64 for groups of 32, under 54 where frequencies fall
    as 1, 1/2, 1/3."""
    counts = 1e6 / np.arange(1, scoring.UNITS + 1)
    model = attention.Model.fresh(counts, np.random.default_rng(0))
    assert counts @ [len(model.heads()[g]) for g in attention.groups(scoring.UNITS)] < 54 * counts.sum()
    assert sum(len(x) for x in model.heads()) == scoring.UNITS + len(model.heads()) ** 2
    h = np.random.default_rng(1).standard_normal((2, attention.DIM)).astype(np.float32)
    total = sum(np.exp(model.unit_logs(h, np.full(2, u)).astype(float)) for u in range(scoring.UNITS))
    assert np.allclose(total, 1, atol=1e-4)


def test_windows_attended_together_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    model = attention.Model.fresh(rng.integers(1, 99, 300).astype(float), rng)
    lengths = np.array([1, 900, 0, 17, 300])
    units = rng.integers(0, 300, int(lengths.sum()))
    place, valid = attention.windows(lengths)
    ids = np.where(valid, attention.preceding(model, units, lengths)[place], model.pad)
    run = lambda: (model.log10_probability(units, lengths), attention.gradients(model, ids, valid, units[place[:, -attention.STRIDE :]], model.mask()))
    logs, (loss, grads) = run()
    assert -logs.sum() * np.log(10) / len(units) - loss < 1e-4 * loss
    monkeypatch.setattr(attention, "TOGETHER", 7)
    again, (other, parts) = run()
    assert np.allclose(logs, again, atol=1e-5) and abs(loss - other) < 1e-5
    assert all(np.allclose(grads[k], parts[k], atol=1e-6) for k in grads)


def test_hashes_of_parts_of_a_column():
    from xxhash import xxh3_128_digest

    words = pa.array(["", "a", "žluť", "b" * 300, "日本"], pa.large_string())
    want = [np.frombuffer(xxh3_128_digest(w.encode()), "<u8").tolist() for w in words.to_pylist()]
    assert hash_words(words).tolist() == want and hash_words(words.slice(2, 2)).tolist() == want[2:4] and hash_words(words.slice(5)).shape == (0, 2)
