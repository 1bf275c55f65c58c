"""The similarity join against every pair matched by the standard library."""

import random
from difflib import SequenceMatcher

import duckdb
import pytest

from lorespark.operators import similarity
from lorespark.plans import registry


def planted(seed):
    random.seed(seed)
    out = []
    for _ in range(60):
        size = random.choice([1, 2, 3, 4, 6, 9, 14, 20, 30, 60, 210])
        base = [random.choice("abcdefgh é漢🙂") for _ in range(size)]
        out.append("".join(base))
        for _ in range(2):
            w = list(base)
            for _ in range(random.randint(0, max(1, len(w) // 12))):
                j = random.randrange(len(w))
                if random.random() < 0.6:
                    w[j] = random.choice("abcdefgh")
                else:
                    w.insert(j, random.choice("xyz"))
            out.append("".join(w))
    rows = list(enumerate(out))
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("threshold", [0.72, 0.8, 0.92])
def test_no_pair_is_lost(spark, threshold):
    rows = [*planted(5), (900, ""), (901, None)]
    got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(spark.createDataFrame(rows, "id long, t string"), "id", "t", threshold).collect()}
    want = {}
    for i, s in rows:
        for j, t in rows:
            if i < j and s and t and s != t and (r := round(SequenceMatcher(None, s, t).ratio(), 6)) >= threshold:
                want[i, j] = r
    assert got == want and want


def test_two_tables(spark):
    left, right = [("supplier 17",), ("north",), ("x",)], [("supplier 18",), ("supplier 17",), ("south",), ("north",)]
    got = {(r.x, r.y) for r in similarity.similar_texts(spark.createDataFrame(left, "s string"), spark.createDataFrame(right, "s string"), 0.78).collect()}
    assert got == {("supplier 17", "supplier 18")}


def test_threshold_and_empty_table(spark):
    none = spark.createDataFrame([], "id long, t string")
    assert similarity.similar_pairs(none, "id", "t", 0.8).count() == 0
    with pytest.raises(ValueError):
        similarity.similar_pairs(none, "id", "t", 0.5)


@pytest.mark.parametrize("few", [0, similarity.FEW_PAIRS])
@pytest.mark.parametrize("threshold", [0.72, 0.92])
def test_blocks_and_tokens_lose_no_pair(spark, monkeypatch, threshold, few):
    monkeypatch.setattr(similarity, "FEW_PAIRS", few)
    monkeypatch.setattr(similarity, "BLOCK_TEXTS", 7)
    rows = planted(11)
    sides = spark.createDataFrame([(t, i % 3 > 0, i % 3 < 2) for t, i in {t: i for i, t in rows}.items()], "s string, left boolean, right boolean")
    got = [(r.x, r.y) for r in similarity.candidates(sides, threshold).collect()]
    left, right = ([r.s for r in sides.where(c).collect()] for c in ("left", "right"))
    want = {(s, t) for s in left for t in right if s != t and SequenceMatcher(None, s, t).ratio() >= threshold}
    assert len(got) == len(set(got)) and want <= set(got) and want


def test_texts_of_few_syllables_meet_in_blocks(spark):
    """Texts that all share most of their tokens: what they share makes no rows, and only what can reach the ratio leaves a block."""
    random.seed(3)
    syllables = ["the", "an", "er", "ing", "on", "re", "ed", "th", "ti", "st"]
    texts = [" ".join("".join(random.choices(syllables, k=random.randint(1, 3))) for _ in range(80)) for _ in range(120)]
    texts += [t[:200] + "#" + t[201:] for t in texts[::10]]
    sides = spark.createDataFrame([(t, True, True) for t in texts], "s string, left boolean, right boolean")
    found = similarity.candidates(sides, 0.92, once=True)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.x, r.y) for r in found.collect()} == {tuple(sorted((t, t[:200] + "#" + t[201:]))) for t in texts[:120:10]}


def edited(text, share, random):
    out = []
    for c in text:
        kind = random.random()
        out += [] if kind < share / 2 else [random.choice("abcdefgh xyz")] if kind < share else [c]
    return "".join(out)


@pytest.mark.parametrize("threshold", [0.8, 0.88, 0.92])
def test_groups_lose_no_pair_of_long_texts(spark, monkeypatch, threshold):
    """Texts of 190 to 900 characters, about the threshold, some with characters that difflib takes as popular; small groups and blocks."""
    monkeypatch.setattr(similarity, "GROUP_TEXTS", 5)
    monkeypatch.setattr(similarity, "BLOCK_TEXTS", 3)
    draw = random.Random(21)
    words = ["the", "an", "er", "ing", "on", "zq", "re", "ed", "x", "th", "ti", "st"]
    texts = []
    for size in (190, 198, 205, 215, 300, 340, 620, 900):
        base = " ".join("".join(draw.choices(words, k=draw.randint(1, 3))) for _ in range(size))[:size]
        texts += [base, *(edited(base, share, draw) for share in (0.01, 0.03, 0.05, 0.07, 0.1, 0.14))]
    texts = sorted(set(texts))
    got = {(r.x, r.y) for r in similarity.candidates(spark.createDataFrame([(t, True, True) for t in texts], "s string, left boolean, right boolean"), threshold, once=True).collect()}
    ratio = lambda s, t: SequenceMatcher(None, s, t).ratio()
    want = {(s, t) for s in texts for t in texts if s < t and max(ratio(s, t), ratio(t, s)) >= threshold}
    assert want <= got and len(want) > 20


def test_a_product_bounds_texts_of_few_syllables(monkeypatch):
    """Unlike texts that share most of their runs are told apart before their subsequence is looked at."""
    draw = random.Random(4)
    syllables = ["the", "an", "er", "ing", "on", "re", "ed", "th", "ti", "st", "ble", "of", "wh", "ha"]
    texts = sorted((" ".join("".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(120)) for _ in range(200)), key=len)
    looked = []
    monkeypatch.setattr(similarity, "reaches", lambda *of: looked.append(of))
    assert not list(similarity._meet([], [(t, True, True) for t in texts], True, 0.92)) and len(looked) < 100


def test_copies_of_one_rank(spark):
    rows = [(1, "a text with copies, one"), (2, "a text with copies, one"), (3, "a text with copies, one"), (11, "a text with copies. one"), (12, "a text with copies. one"), (20, "else")]
    got = similarity.similar_pairs(spark.createDataFrame(rows, "id long, t string"), "id", "t", 0.92, ranked=True).collect()
    assert sorted((r.a, r.b) for r in got) == [(1, 11), (2, 12), (3, 12)]


def test_copies_keep_a_link_that_holds_in_one_order(spark):
    s, t = "baabbbbabab", "baabbbbbaab"
    assert SequenceMatcher(None, s, t).ratio() < 0.9 < SequenceMatcher(None, t, s).ratio()
    got = similarity.similar_pairs(spark.createDataFrame([(1, s), (2, t), (4, s), (5, t)], "id long, t string"), "id", "t", 0.9, ranked=True).collect()
    assert [(r.a, r.b) for r in got] == [(2, 4)]  # equal ranks, (1, 2) and (4, 5), have the wrong text first


def test_turns_with_copies_equal_sql(spark, tmp_path, same):
    """Three turns with one text and their changed ones: as many pairs as turns, not their product."""
    turns = [(1, 0, "a common first turn of many conversations"), (2, 0, "a common first turn of many conversations"), (3, 0, "A common first turn  of many conversations"), (3, 1, "quite another text, which comes but once")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES["jn_15_ratio_pairs"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(registry.ORACLE["jn_15_ratio_pairs"])
    columns = [d[0] for d in want.description]
    assert same(got.columns, [tuple(r) for r in got.collect()]) == same(columns, want.fetchall())
