"""Mixing, whitening and alignment against brute force and the tokenizer libraries."""

import collections
import hashlib
import itertools
import json
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomseq.llm import alignment, bpe, mixing, whitening

SF = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, source string"
ODD = ["", None, " ", "\n\n", "a", "x" * 3000, "é" * 300, "<|endoftext|> a", "A  b\tc", "日本語 🙂", "ab " * 200, "</s> <unk> <s>", "▁under", "a\x00b", " x", "one " * 60_000]


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; while a share is above its cap, it is cut and the excess goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        per = left / sum(w[s] for s in open_)
        over = [s for s in open_ if per * w[s] > most * sizes[s]]
        if not over:
            return fixed | {s: per * w[s] for s in open_}
        for s in over:
            fixed[s] = most * sizes[s]
            left -= fixed[s]
            open_.remove(s)
    return fixed


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mixture(seed, n=400):
    rnd = random.Random(seed)
    names = ["b", "a", None, "é", "", "Z", "tiny", "\U0001f600"]
    rows = [(i, " ".join("w" for _ in range(int(rnd.paretovariate(0.7)) % 4000 + 1)), rnd.choice(names[:6])) for i in range(n)]
    return rows + [(n, "w", "tiny"), (n + 1, None, "a"), (n + 2, "", None), (n + 3, "\x0b\x0c \t", "empty"), (None, "w w", "b"), (5, "w w w", "a")] + [(7000, "w w w w", "a")] * 1500


def test_op11_targets_totals_and_reruns(spark):
    rows = mixture(1)
    df = spark.createDataFrame(rows, SHAPE).withColumn("size", F.lit("clash")).withColumn("a.b", F.lit(1))
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want, got, longest = targets(sizes), collections.Counter(), collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-9)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        got[r.source] += r.taken
    assert sorted(r.size for r in out) == sorted(words(t) for _, t, _ in rows)
    for s in sizes:
        assert abs(got[s] - want[s]) <= max(2, 0.01 * want[s]), (s, got[s], want[s])
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    other = mixing.mix(df, seed=7).collect()
    assert sorted(map(str, other)) != sorted(map(str, out))
    equal = collections.Counter(r.copies for r in out if r.doc_id == 7000)
    assert sum(equal.values()) == 1500 and (len(equal) == 2 or want["a"] == 3 * sizes["a"])
    assert mixing.mix(df.limit(0)).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(df.where("source = 'empty'")).collect())


def test_op11_takes_the_front_of_the_pareto_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELLS", 8)  # samples end inside cells
    seen, real = [], mixing.ranked
    monkeypatch.setattr(mixing, "ranked", lambda *a: seen.append(real(*a)) or seen[-1])
    df = spark.createDataFrame([(i, "w " * (1 + i % 90), f"s{i % 4}") for i in range(3000)], SHAPE)
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    front = collections.defaultdict(lambda: ([], []))
    for r in seen[0].where("_q is not null").collect():
        odds = r._u / (1 - r._u) / (r._p / (1 - r._p))
        assert math.isclose(odds, r._q) and math.isclose(r._p, r._c - math.floor(r._c))
        front[r._s, r._h][copies[r._id] == r._sure + 1].append(r._q)
    assert len(front) > 6
    assert all(max(taken) < min(rest) for rest, taken in front.values() if taken and rest)


def test_op11_includes_each_document_as_often_as_expected(spark):
    df = spark.createDataFrame([(i, "w " * (1 + (i * 7) % 64), "a" if i % 2 else "b") for i in range(400)], SHAPE)
    total = collections.Counter()
    for seed in range(12):
        for r in mixing.mix(df, weights=(1, 3), seed=seed).collect():
            total[r.source, r.size >= 32] += r.copies / (r.target / r.source_size) / 12
    number = collections.Counter((r.source, words(r.text) >= 32) for r in df.collect())
    assert all(abs(total[k] / number[k] - 1) < 0.1 for k in number), (total, number)


def test_op11_values_make_copies_unequal_and_capped(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 50), f"s{i % 2}", float(i % 10) if i % 97 else None) for i in range(4000)], f"{SHAPE}, q double")
    out = mixing.mix(df, weights=(3, 1), value="q").join(df.select("doc_id", "q"), "doc_id").toPandas()
    for _, g in out.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.01 * g["target"].iloc[0] and g["copies"].max() <= 3
        assert (g[g["q"].fillna(0) == 0]["copies"] == 0).all()
        per = g.groupby("q")["copies"].mean()
        assert (per.diff().dropna() > -0.25).all() and per.iloc[-1] > 2 * per[per.index > 0].iloc[0]


def test_op11_corpus_repeats_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 10)
    rows = mixture(2, 60)
    df = spark.createDataFrame([(*r, k % 3) for k, r in enumerate(rows)], f"{SHAPE}, `a.b` int")
    mixed = mixing.mix(df)
    got = collections.Counter((r.doc_id, r.text, r.source) for r in mixing.mixed_corpus(df, mixed).collect())
    want = collections.Counter()
    hashes = {r.h: r.text for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    for r in mixed.collect():
        want[r.doc_id, hashes[r.text_hash], r.source] += r.copies
    assert +want == +got and mixing.mixed_corpus(df, mixed).columns == df.columns


def brute_whitening(vectors):
    kept = [v for v in vectors if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in kept]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    far = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    whitened = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x]) @ u / np.sqrt(np.maximum(e, 1e-300))
    return n, far, whitened, e / e.sum()


@pytest.mark.parametrize("d, rows", [(5, 60), (24, 300), (3, 2)])
def test_op12_equals_brute_force(spark, d, rows):
    rng = np.random.default_rng(d)
    x = (rng.normal(size=(rows, d)) * np.linspace(3, 0.2, d)).astype(np.float32).tolist()
    x += x[:7] + [x[0]] * 40 + [None, [None] * d, [float("nan")] * d, [1.0] * (d + 1), [], [float("inf")] + [0.0] * (d - 1)]
    df = spark.createDataFrame([(i // 2, v) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumn("n", F.lit("clash")).repartition(3)
    out = whitening.whiten(df).toPandas()
    n, far, want, share = brute_whitening([v for v in x if v is None or len(v) != d + 1])
    k = min(16, d, n - 1)
    assert len(out) == len(far) * k and set(out["n"]) == {n} and sorted(set(out["component"])) == list(range(1, k + 1))
    assert sorted(map(int, out[out["component"] == 1]["deviation"])) == sorted(far)
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9
    for c in range(1, k + 1):
        o = out[out["component"] == c]
        assert np.allclose(o["explained"], share[c - 1], rtol=1e-9)
        a, b = np.sort(o["whitened"].to_numpy()), np.sort(want[:, c - 1])
        assert min(np.abs(a - b).max(), np.abs(a + b[::-1]).max()) < 1e-7


def test_op12_without_variance_and_far_values(spark):
    shape = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, None)], shape)
    assert whitening.whiten(df).count() == 0 and whitening.whiten(df.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)] + [(None, [4.0, 8.0, 7.0])], shape)
    out = whitening.whiten_digest(line).toPandas()
    assert set(out["component"]) == {1} and len(out) == 10 and math.isclose(out["explained"].iloc[0], 1.0)
    assert whitening.whiten_digest(line).schema["deviation"].dataType.simpleString() == "bigint"
    wide = spark.createDataFrame([(i, [1e300 * (i % 2), float(i)]) for i in range(6)], shape)
    r = whitening.whiten(wide).toPandas()
    top = min(64 * 10**300, whitening.FARTHEST)
    s = [3 * top, 64 * 15]
    assert sorted(map(int, r[r["component"] == 1]["deviation"])) == sorted((6 * top * (i % 2) - s[0]) ** 2 + (6 * 64 * i - s[1]) ** 2 for i in range(6))


def test_op12_factor_and_rotations():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 12)) @ np.diag(10.0 ** -np.arange(12))
    a = a @ a.T
    g = whitening.pivoted_cholesky(a)
    assert g.shape[1] <= 12 and np.allclose(g @ g.T, a, atol=1e-13 * a.max())
    e, u = whitening.jacobi(g)
    assert np.allclose(u.T @ u, np.eye(len(e)), atol=1e-12) and np.allclose(u @ np.diag(e) @ u.T, a, atol=1e-12 * a.max())
    assert all(np.count_nonzero(g[:, k]) <= 30 - k for k in range(g.shape[1]))


def test_op12_gram_is_exact():
    rng = np.random.default_rng(2)
    for top in (50, 2**24, 2**40):
        x = rng.integers(-top, top, (70, 4))
        wide = x.astype(object)
        assert (whitening.gram(x) == wide.T @ wide).all()


def brute_alignment(rows):
    path = public_tokenizers.path
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    with open(path("byte_bpe_50k.json"), encoding="utf-8") as f:
        entries = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    byte = {c: i for i, c in enumerate(bpe.byte_alphabet())}
    done, links = [], collections.Counter()
    for d, t in rows:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        in_a = [bytes(byte[c] for c in entries[i]) for i in a]
        in_b = [bytes([int(p[3:-1], 16)]) if re.fullmatch(r"<0x..>", p := sp.id_to_piece(i)) else p.replace("▁", " ").encode() for i in b]
        if not t or not b"".join(in_a) == b"".join(in_b) == (" " + t).encode():
            done.append((d, 0, 0, [], ""))
            continue
        end_a, end_b = (list(itertools.accumulate(map(len, x))) for x in (in_a, in_b))
        at_a, at_b = {e: i for i, e in enumerate(end_a)}, {e: i for i, e in enumerate(end_b)}
        ends = sorted(set(end_a) & set(end_b))
        own = [(a[at_a[e]], b[at_b[e]]) for e in ends]
        text, i, j = [], 0, 0
        for e in ends:
            text.append(",".join(map(str, a[i : at_a[e] + 1])) + "|" + ",".join(map(str, b[j : at_b[e] + 1])))
            i, j = at_a[e] + 1, at_b[e] + 1
        links.update(own)
        done.append((d, len(a), len(b), own, hashlib.sha256(";".join(text).encode()).hexdigest()))
    most = collections.Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    return [(d, na, nb, len(o), len(o), sum(links[p] == most[p[1]] for p in o), sum(links[p] for p in o), h) for d, na, nb, o, h in done], links, most


@pytest.mark.parametrize("block", [2_000_000, 500])
def test_op13_equals_brute_force(spark, block):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(9000 + i, t) for i, t in enumerate(ODD)] + [(1, "again"), (1, "again"), (None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash")).withColumn("n_a", F.lit(None).cast("string"))
    path = public_tokenizers.path
    out, pairs = alignment.align(df.repartition(3), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), block_tokens=block)
    want, links, most = brute_alignment(rows)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert {(r.id_a, r.id_b): (r["count"], r.best) for r in pairs.collect()} == {p: (n, n == most[p[1]]) for p, n in links.items()}
    assert sum(r[1] == 0 for r in want) >= 4


def test_op13_empty(spark):
    path = public_tokenizers.path
    for rows in ([], [(1, None), (2, "")]):
        out, pairs = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
        assert [tuple(r)[1:] for r in out.collect()] == [(0, 0, 0, 0, 0, 0, "")] * len(rows) and pairs.count() == 0
