"""Alignment of tokenizers, the n-gram Jaccard join and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lorespark.llm import alignment, jaccard, minhash, periodic, toxicity, urls
from lorespark.llm.bpe import byte_characters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", " the", " of", "a", "B", "é", "'s", "1", "\n", "\t", ".", "<|endoftext|>", "<s>", "<0x41>", "\x1c", "\x00", "²", "　", " xylophone", "!?", "▁", "漢字", "🙂", " ", " ̈"]


def mixed(seed, n=400):
    random.seed(seed)
    rows = [(i, "".join(random.choice(PARTS) for _ in range(random.randint(0, 25)))) for i in range(n)]
    return [*rows, (2000, None), (2001, " "), (2002, "  "), (2003, " a"), (2004, "<|endoftext|>"), (2005, "a" * 9000)]


def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def aligned(rows):
    """By whole texts and byte offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    back = {c: bytes([i]) for i, c in enumerate(byte_characters())}
    a_bytes = lambda i: b"".join(back[c] for c in a_tok.id_to_token(i))
    b_bytes = lambda i: bytes([int(b_tok.IdToPiece(i)[3:-1], 16)]) if b_tok.IsByte(i) else b_tok.IdToPiece(i).replace("▁", " ").encode()
    out, count = [], Counter()
    for i, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = (a_tok.encode(whole.decode(), add_special_tokens=False).ids, b_tok.encode(text)) if text else ([], [])
        if b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            a, b = [], []
        at_a, at_b = (dict(zip(np.cumsum([len(f(x)) for x in ids]).tolist(), ids, strict=True)) for f, ids in ((a_bytes, a), (b_bytes, b)))
        groups, low = [], 0
        for e in sorted(at_a.keys() & at_b.keys()):
            groups.append("|".join(",".join(str(x[k]) for k in sorted(x) if low < k <= e) for x in (at_a, at_b)))
            low = e
        links = [(at_a[e], at_b[e]) for e in sorted(at_a.keys() & at_b.keys())]
        count.update(links)
        out.append((i, a, b, groups, links))
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return sorted((i, len(a), len(b), len(g), len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, ls in out)


def test_alignment_by_whole_texts(spark, sf):
    for rows in (mixed(3), documents(spark, sf)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        found = alignment.align(df, A, B)
        want = aligned(rows)
        assert sorted(tuple(r) for r in alignment.report(found).collect()) == want
    assert sorted(tuple(r) for r in alignment.report(found, most_pairs=0).collect()) == want  # pairs joined, not broadcast


def test_alignment_forgets_and_learns_again(monkeypatch):
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        aligner = alignment.Aligner(f.read(), g.read())
    texts = [alignment.pieces(" " + t) for _, t in mixed(4, 120) if t]
    once = [aligner.alone("".join(t)) for t in texts]
    monkeypatch.setattr(alignment, "MEMORY", 20_000)
    for k in range(0, len(texts), 7):
        aligner.learn(texts[k : k + 7])
        assert [aligner.text(t) for t in texts[k : k + 7]] == once[k : k + 7]


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_by_brute_force():
    random.seed(1)
    for _ in range(1500):
        n, v, w = random.randint(0, 90), random.choice([1, 2, 3, 8, 40]), []
        while len(w) < n:
            if random.random() < 0.4:
                block = [random.randrange(v) for _ in range(random.randint(1, 12))]
                w += block * random.randint(2, 6) + block[: random.randint(0, len(block))]
            else:
                w.append(random.randrange(v))
        ids = np.array(w[:n], np.int64)
        want = brute_runs(ids.tolist())
        assert periodic.runs(ids) == want
        assert n < 40 or periodic.runs(ids, sieve=0) == want


def test_runs_of_very_long_texts():
    import time

    rng, n, began = np.random.default_rng(1), 2_000_000, time.time()
    one, period = np.zeros(n, int), np.resize(rng.integers(0, 5000, n // 5), n)
    assert periodic.runs(one) == [(0, n, 1)] and periodic.runs(period) == [(0, n, n // 5)]
    mixed_ = rng.integers(0, 5000, n)
    mixed_[1000:9000] = np.resize(mixed_[1000:1900], 8000)
    assert (1000, 8000, 900) in periodic.runs(mixed_) and time.time() - began < 60


def test_periodic_report(spark, sf):
    rows = [*documents(spark, sf), (9000, None), (9001, ""), (9002, "A a A a  A\ta A a"), (9003, "x " * 40 + "é é é é é é é"), (None, "q q q q q q")]
    got = {r.doc_id: r for r in periodic.report(periodic.detect(periodic.with_repeats(spark.createDataFrame(rows, "doc_id long, text string")))).collect()}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        dropped = {k for a, size, q in runs for k in range(a + q, a + size)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{size},{q}\n" for a, size, q in runs)), sha(" ".join(w[k] for k in range(n) if k not in dropped)))
        assert tuple(got[i]) == want


def planted(seed):
    random.seed(seed)
    words, rows = [f"w{i}" for i in range(400)], []
    for _ in range(30):
        base = [random.choice(words) for _ in range(random.choice([5, 9, 10, 12, 20, 40, 80, 200, 600]))]
        now = base
        for _ in range(random.randint(1, 9)):
            now = list(base if random.random() < 0.5 else now)
            for _ in range(random.randint(0, max(1, len(now) // 60))):
                j, r = random.randrange(len(now)), random.random()
                now = now[:j] + ([random.choice(words)] if r < 0.4 else [] if r < 0.6 else [random.choice(words), now[j]]) + now[j + 1 :] or ["x"]
            rows.append((len(rows), " ".join(now)))
    random.shuffle(rows)
    return rows + [(len(rows) + i, t) for i, t in enumerate([None, "", " ", "a", "a", "A b", "a b"])]


def components(rows, k, percent):
    sets, root = {}, {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i], root[i] = ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())), i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in sets:
        for y in sets:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 90), (2, 3, 80), (3, 2, 90), (4, 1, 70)])
def test_join_loses_no_link(spark, seed, k, percent):
    rows = planted(seed)
    got = sorted(tuple(r) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect())
    assert got == components(rows, k, percent)


def test_join_where_buckets_are_large(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRED", 2)
    rows = planted(5)
    got = sorted(tuple(r) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == components(rows, 3, 90)


def test_overlaps_are_counted_by_fragment(spark):
    rows = planted(6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard.sketches(df, 3, 90).where("n_shingles > 0").select("doc_id", F.col("n_shingles").alias("n"), "d1", "cuts")
    ids = sorted(i for i, t in rows if t and t.strip())
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids if b < a][:6000], "a long, b long")
    text = df.where("text is not null")
    got = {(r.a, r.b) for r in jaccard.confirmed(pairs, sets, text, 3, 90).collect()}
    whole = {(r.a, r.b) for r in minhash.verified(pairs, text, 3, 90).collect()}
    equal = {(a, b) for a, b in whole if dict(rows)[a].lower().split() == dict(rows)[b].lower().split()}
    assert got - equal == whole - equal  # equal sets of fewer than nine shingles fold before


def test_toxicity_learns_from_every_label(spark):
    docs = spark.range(26_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    kept = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).count()
    assert toxicity.training_rows(docs, labels).count() == kept > 20_000


def test_logistic_by_aggregates(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 3))
    y = (x @ [1.5, -2, 0.3] + 0.4 + r.normal(size=400) > 0).astype(float)
    w = toxicity.logistic(spark.createDataFrame(np.column_stack([x, y]).tolist(), "a double, b double, c double, y double"), "y", ["a", "b", "c"])
    one = np.column_stack([np.ones(400), x])
    slope = one.T @ (y - 1 / (1 + np.exp(-one @ w))) - np.array([1e-6, 0.05, 0.05, 0.05]) * w
    assert np.abs(slope).max() < 1e-6


def test_all_of_a_url_but_what_rules_name_is_read(spark):
    urls_ = {"casino.com": ("/x", "casino/x"), "www.casino.shop.example.net": ("/en/a7", "www.casino.shop/a0"), "poker.biz": ("/casino/es/1", "poker.biz/casino/es/0"), "m.example.org": ("/es/b", "m/b"), "net": ("", "/"), "a.org.example.com": ("/de", "a.org/")}
    df = spark.createDataFrame([(h, p) for h, (p, _) in urls_.items()], "host string, path string")
    got = {r.host: r.stem for r in urls.with_rule(df).collect()}
    assert {h: got[h].replace("//", "/") for h in got} == {h: w for h, (_, w) in urls_.items()}


def test_toxicity_training_join_is_one_at_any_size(spark):
    """Few labels aren't broadcast, so what is shuffled grows with the input alone; held-out texts aren't shuffled."""
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    plan = toxicity.training_rows(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and plan.count("crc32") >= 2
