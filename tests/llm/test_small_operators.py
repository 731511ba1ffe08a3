"""Chat formatting, sharding, mixing and surrogates on small tables."""

import hashlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from shiftloom.llm import chat, mixing, sharding, surrogates

TURNS = "conv_id long, turn long, role string, text string, extra string"


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


CHATS = {
    1: [("system", ""), ("user", "a\\<|end|>\n<|more|>"), ("user", "\\"), ("assistant", "b\n"), ("assistant", "</s>[INST]"), ("user", "\\\\<|turn|>x")],
    2: [("assistant", "é [/INST] \\</s>")],
    3: [("", "x"), ("<|text|>", "y")],
    4: [("\\", "\\"), ("r\\", "\\\\"), ("r\\", "\\\n<|more|>\\"), ("\n<|text|>\\", "\n<|end|>"), ("\\<|turn|>", "")],
    5: [(r, f"t{i}\\") for i, r in enumerate(["user", "assistant", "assistant"] * 300)],
}


def chats(spark):
    rows = [(c, i, r, t, "z") for c, turns in CHATS.items() for i, (r, t) in enumerate(turns)]
    rows = [(c, i, r or None, t or None, z) for c, i, r, t, z in rows]
    return spark.createDataFrame(rows[::-1], TURNS)


def test_chat_reads_back_whole(spark):
    out = {r.conv_id: r for r in chat.chat_query(chats(spark)).collect()}
    assert set(out) == {-1, 1, 2, 3, 4, 5}
    for c, turns in CHATS.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256) == (len(turns), digest(turns))
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    says = "</s>[INST] ok [/INST]"
    assert out[-1].turns_sha256 == digest([("user", says), ("assistant", says)])


def test_chat_merges_and_marks(spark):
    r = chat.format_chat(chats(spark).where("conv_id = 1")).first()
    t = chat.Template()
    assert len(r.formatted.split("\n" + t.close)) - 1 == 4  # system, user, assistant, user
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["b\n", "\\</s>\\[INST]"]
    long = chat.format_chat(chats(spark).where("conv_id = 5")).first()
    assert [long.formatted[s.start : s.start + s.length] for s in long.loss_spans] == [f"t{i}\\" for i in range(900) if i % 3]


def test_chat_sql_and_empty(spark):
    df = chats(spark)
    con = duckdb.connect()
    con.register("conversations", df.drop("extra").toPandas().astype({"text": object, "role": object}))
    want = sorted(map(tuple, con.sql(chat.CHAT_SQL).df()[["conv_id", "n_turns", "turns_sha256", "loss_sha256", "formatted_chars"]].values.tolist()))
    got = sorted((r.conv_id, r.n_turns, r.turns_sha256, r.loss_sha256, r.formatted_chars) for r in chat.chat_query(df).collect())
    assert got == want
    assert chat.format_chat(df.limit(0)).count() == 0


def documents(spark, n=200, **columns):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"))
    return df.withColumns({k: F.lit(v) for k, v in columns.items()})


@pytest.mark.parametrize("n", [0, 1, 7, 8, 203])
def test_shards_are_exact(spark, n):
    df = documents(spark, n, shard="mine", place_=1).repartition(5)
    out = sharding.shard_rows(df, block_rows=5)
    assert out.columns == ["doc_id", "source", "text", "place_", "shard", "slot"]
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(n))
    sizes = Counter(r.shard for r in rows)
    assert all(n // 8 <= sizes[s] <= -(-n // 8) for s in range(8))
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_shards_follow_the_matrix(spark):
    """Rows of each input partition in each shard: the drawn matrix, and no order of the input is left."""
    df = documents(spark, 4000).repartition(5).withColumn("p", F.spark_partition_id())
    rows = sharding.shard_rows(df, shards=3, seed=9, block_rows=100).collect()
    own = Counter(r.p for r in rows)
    matrix = sharding.communication_matrix([own[p] for p in range(5)], 3, 9)
    assert Counter((r.p, r.shard) for r in rows) == Counter({(p, s): matrix[p][s] for p in range(5) for s in range(3)})
    again = sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_rows(df, shards=3, seed=10).collect())
    mine = sorted((r.doc_id, r.shard, r.slot) for r in rows)
    same = sum(a == b for a, b in zip(mine, again))
    assert same < 20  # about 1 in 4,000 by chance
    late = [r.slot for r in rows if r.doc_id >= 2000]
    assert abs(sum(late) / len(late) - 4000 / 3 / 2) < 40


def test_repeated_and_null_rows_are_sharded(spark):
    df = spark.createDataFrame([(1, None)] * 50 + [(None, "")] * 30, "doc_id long, text string")
    out = sharding.sharding_query(df).collect()
    assert len(out) == 80 and {r.size for r in out} == {1} and {r.text_crc32 for r in out} == {0}
    assert set(Counter(r.shard for r in out).values()) == {10}


def test_matrix_law():
    import random

    m = sharding.communication_matrix([10, 0, 25, 5], 3, 1)
    assert [sum(r) for r in m] == [10, 0, 25, 5] and [sum(c) for c in zip(*m)] == [14, 13, 13]
    rng = random.Random(5)
    draws = Counter(sharding.draw_hypergeometric(rng, 3, 5, 4) for _ in range(20_000))
    from math import comb

    for k in range(4):
        assert abs(draws[k] / 20_000 - comb(3, k) * comb(5, 4 - k) / comb(8, 4)) < 0.02
    assert 4 * 10**8 < sharding.draw_hypergeometric(rng, 10**12, 10**12, 10**9) < 6 * 10**8


def test_targets_by_resharing(spark):
    sizes = {"a": 10, "b": 200, "c": 50, "d": 5, None: 35}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    target, capped = {}, set()
    while True:  # share the rest by weight, again and again
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        level = rest / sum(w for s, w in weight.items() if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else level * weight[s] for s in sizes}
        above = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not above:
            break
        capped |= above
    assert got == pytest.approx(target)


def test_mix_meets_targets(spark):
    df = documents(spark, 2000, size="mine")
    rows = mixing.mix_documents(df).collect()
    assert len(rows) == 2000
    assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.01)
    again = {r.doc_id: r.taken for r in mixing.mix_documents(df.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_mix_against_sql(spark):
    """The whole sample, by DuckDB, on the smallest table and on ties, repeats, nulls and one long document."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text")
    odd = spark.createDataFrame([(1, None, "a b"), (1, None, "a b"), (None, "s", None), (2, "s", " \t "), (3, "t", "x " * 5000), (4, "s", "one two three")], docs.schema)
    for df in (docs, docs.unionByName(odd), odd):
        con = duckdb.connect()
        con.register("documents", df.toArrow())
        want = Counter(con.sql(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({mixing.MIXING_SQL})").fetchall())
        rows = mixing.mixing_query(df).collect()
        assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in rows) == want
    share = lambda size: mixing.share_of(F.lit(size), F.lit(0.05))
    a, b = spark.range(1).select(share(4), share(4000)).first()
    assert a == pytest.approx(0.15) and b == pytest.approx(0.6)


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, None, "a b"), (1, None, "a b"), (None, "s", None), (2, "s", " \t "), (3, "t", "x" * 50_000)], "doc_id long, source string, text string")
    rows = mixing.mixing_query(df).collect()
    assert sorted(r.size for r in rows) == [0, 0, 1, 2, 2]
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mixing_query(df.limit(0)).count() == 0
    taken = mixing.take_mix(df.withColumn("size", F.lit("mine")))
    assert taken.columns == ["doc_id", "source", "text", "size"] and taken.where("size <> 'mine'").count() == 0


def replaced(spark, *texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n_entities) for r in surrogates.replace_personal(df, **kw).orderBy("doc_id").collect()]


def test_surrogates_keep_format_and_identity(spark):
    (a, n), (b, _), (c, _), (d, k) = replaced(
        spark, "Mail JOE@X.COM, joe@x.com; +1 (706) 555-3138 or +1 706 555 3138.", "Mrs Anna Smith met Mr. John Smith; Mr Smith left. Госпожа Анна Иванова.",
        "4111 1111 1111 1111 4111111111111111 19.37.233.111 DE89 3704 0044 0532 0130 00", "plain 4.0 12 text\\s$1",
    )
    import re

    assert n == 4 and k == 0 and d == "plain 4.0 12 text\\s$1"
    mails = re.findall(r"\S+@[\w.]+\w", a)
    assert mails[0].lower() == mails[1] and mails[0].isupper() and "x.com" not in a.lower()
    phones = re.findall(r"\+1[ ()\d-]+\d", a)
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) != "17065553138" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0])
    names = re.match(r"Mrs (\w+a) (\w+) met Mr\. (\w+o) (\w+); Mr (\w+) left\. Госпожа (\w+а) (\w+)\.", b)
    assert names and names[2] == names[4] == names[5] != "Smith" and re.fullmatch("[А-я]+", names[6] + names[7])
    cards = re.match(r"(\d{4} \d{4} \d{4} \d{4}) (\d{16}) (\d+\.\d+\.\d+\.\d+) (DE\d{2}[ \d]+)$", c)
    assert cards[1].replace(" ", "") == cards[2] != "4" + "1" * 15
    digits = [int(x) for x in cards[2]]
    assert (sum(digits[1::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[0::2])) % 10 == 0
    iban = cards[4].replace(" ", "")
    assert int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1


def test_surrogates_stay_distinct(spark):
    """All numbers of three digits in a row of a crowded format: collisions must be resolved."""
    texts = [f"at 192.168.{i % 3 + 1}.{i % 250 + 1} ok" for i in range(750)]
    out = replaced(spark, *texts)
    assert len({t for t, _ in out}) == len(set(texts))
    assert not {t for t, _ in out} & set(texts)


def test_full_formats_stay_distinct(spark):
    """Every address of a private network, every mailbox of one letter, and phones written in two ways."""
    mails = [f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"]
    nets = [f"192.168.{i // 256}.{i % 256}" for i in range(0, 65536, 3)] + [f"192.168.1.{i}" for i in range(256)]
    phones = [f"+44 20 7183 {i:04d}" for i in range(300)] + [f"+4420 7183{i:04d}" for i in range(300)] + [f"+1 706 555 {i:04d}" for i in range(300)]
    out = [t for t, n in replaced(spark, *mails, *nets, *phones) if n == 1]
    a, b, c = out[: len(mails)], out[len(mails) : -len(phones)], out[-len(phones) :]
    assert len(set(a)) == 26 and not set(a) & set(mails)
    assert len(set(b)) == len(set(nets)) and all(x.startswith("192.168.") for x in b) and not any(x == y for x, y in zip(b, nets))
    digits = ["".join(filter(str.isdigit, x)) for x in c]
    assert digits[:300] == digits[300:600] and len(set(digits)) == 600 and all(x.startswith("44") for x in digits[:600])
    assert replaced(spark, "call +442071838750 or +44 2071838750")[0][0].split()[1][1:] == replaced(spark, "call +44 2071838750")[0][0][5:].replace("+", "").replace(" ", "")


def test_permutations_of_small_formats(spark):
    df = spark.createDataFrame([(f"{a}{b}",) for a in "0123456789" for b in "0123456789"], "x string")
    for key in ("k", "l"):
        got = [r[0] for r in df.select(surrogates.spelled(surrogates.scrambled(surrogates.symbols(F.col("x")), key, F.lit("t")))).collect()]
        assert sorted(got) == sorted(r.x for r in df.collect()) and not any(g == r.x for g, r in zip(got, df.collect()))


def test_persons_named_again(spark):
    (text, n), (other, k) = replaced(spark, "Mr. John Smith met us. Smith left, SMITH too. John Smith stayed; Smithson and john did not.", "Smith and John alone.")
    import re

    m = re.fullmatch(r"Mr\. (\w+) (\w+) met us\. (\w+) left, (\w+) too\. (\w+) (\w+) stayed; Smithson and john did not\.", text)
    assert m and m[2] == m[3] == m[6] == m[4].capitalize() != "Smith" and m[4].isupper() and m[1] == m[5] != "John"
    assert n == 5 and (other, k) == ("Smith and John alone.", 0)


def test_phones_but_no_dates(spark):
    plain = ["on 2024-10-01 and 01.10.2024", "sum 12 345 678 or 1 3 4.0", "v1.2 10:20:30"]
    numbers = ["+49 30 1234567", "+442071838750", "555-123-4567", "(030) 123 4567", "123-45-6789"]
    assert replaced(spark, *plain) == [(t, 0) for t in plain]
    for t, (new, n) in zip(numbers, replaced(spark, *numbers)):
        assert n == 1 and new != t and [c.isdigit() for c in new] == [c.isdigit() for c in t]


def test_surrogates_edges(spark):
    assert replaced(spark, None, "") == [(None, 0), ("", 0)]
    df = spark.createDataFrame([(1, "a@b.com", "row"), (1, "a@b.com", "row")], "doc_id long, text string, row_ string")
    out = surrogates.replace_personal(df)
    assert out.columns == ["doc_id", "text", "row_", "n_entities"]
    assert len({r.text for r in out.collect()}) == 1 and out.count() == 2
    assert surrogates.replace_personal(df.limit(0)).count() == 0
    other = replaced(spark, "a@b.com", key="k2")[0][0]
    assert other != replaced(spark, "a@b.com")[0][0]


def test_given_names_with_and_without_surname(spark):
    import re

    a, b, c, d, e = (t for t, _ in replaced(
        spark, "Ms. Anna called. Later Ms. Anna Jones wrote; Anna left.", "Dr. Anna came, Prof. Dr. Maria Rossi and MR. PAUL KING too.", "Frau Dr. Maria Stein met Frau Иванова and Herr Иванов.",
        "Mr. Jones knew Ms. Anna.", "Mr. Paul King",
    ))
    m = re.fullmatch(r"Ms\. (\w+) called\. Later Ms\. (\w+) (\w+) wrote; (\w+) left\.", a)
    assert m and m[1] == m[2] == m[4] != m[3] and m[1].endswith("a") and "Anna" not in a
    n = re.fullmatch(r"Dr\. (\w+) came, Prof\. Dr\. (\w+a) (\w+) and MR\. ([A-Z]+O) ([A-Z]+) too\.", b)
    assert n and n[1] == m[1] and not {"Maria", "Rossi", "PAUL", "KING"} & set(b.replace(".", "").split())
    o = re.fullmatch(r"Frau Dr\. (\w+) (\w+) met Frau ([а-яА-Я]+ова) and Herr ([а-яА-Я]+ов)\.", c)
    assert o and o[1] == n[2] and o[3] != "Иванова" and o[4] != "Иванов"
    assert d == f"Mr. {m[3]} knew Ms. {m[1]}."
    assert e.upper() == f"MR. {n[4]} {n[5]}"


def test_phones_with_and_without_calling_code(spark):
    a, b, c, d = (t for t, _ in replaced(spark, "+44 20 7183 8750 or 020 7183 8750", "020.7183.8750", "706-555-3138 is +1 (706) 555-3138; 01 23 45 67 89", "020 7183 8751"))
    digits = lambda t: "".join(filter(str.isdigit, t))
    whole, near = a.split(" or ")
    assert digits(near) == "0" + digits(whole)[2:] == digits(b) != "02071838750" and [len(x) for x in near.split(" ")] == [3, 4, 4]
    first, second = c.split(";")[0].split(" is +1 ")
    assert digits(first) == digits(second) != "7065553138"
    assert "01 23 45 67 89" not in c and c.split("; ")[1].startswith("0")
    assert digits(d) != digits(b) and d.startswith("0") and d != "020 7183 8751"


def test_long_addresses(spark):
    a, b, c, d, e = (t for t, _ in replaced(spark, "2001:db8::1 and 2001:0db8:0:0:0:0:0:1", "2001:DB8:AA:0:BB::77", "10:20:30 std::12 12:34", "fe80::1", "2001:db8:1:2:3:4:5:6 2001:db8::"))
    short, full = a.split(" and ")
    groups = full.split(":")
    assert short == f"2001:{groups[1].lstrip('0')}::{groups[7]}" != "2001:db8::1" and groups[2:7] == ["0"] * 5 and len(groups[1]) == 4
    assert b != "2001:DB8:AA:0:BB::77" and b == b.upper() and [len(x) for x in b.split(":")] == [4, 3, 2, 1, 2, 0, 2] and b.split(":")[3] == "0"
    assert c == "10:20:30 std::12 12:34" and d.startswith("fe80::") and d != "fe80::1"
    x, y = e.split(" ")
    assert y.startswith("2001:") and y.endswith("::") and y != "2001:db8::" and x.count(":") == 7
    crowd = [f"fe80::{i:x}" for i in range(1, 16)]
    assert len({t for t, _ in replaced(spark, *crowd)}) == 15


def test_names_that_stay_taken(spark):
    """Without any round left to move on, colliding names become long ones that are still distinct."""
    names = spark.createDataFrame([("surname", n) for n in ("smith", "jones", "иванова")], "kind string, norm string")
    made = surrogates.with_surrogate(names, F.lit(0), "k")
    taken = names.unionByName(made.selectExpr("kind", "new as norm"))
    out = surrogates.attempts(taken, "k", most=0)
    assert {r.norm for r in out.collect()} >= {"smith", "jones", "иванова"} and {r.attempt for r in out.collect()} == {surrogates.LONGEST}
    long_ones = [r.new for r in surrogates.with_surrogate(out, F.col("attempt"), "k").collect()]
    assert len(set(long_ones)) == len(long_ones) and all(len(n) > 60 for n in long_ones)
