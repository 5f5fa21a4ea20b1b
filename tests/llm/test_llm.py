"""The training-data operators against brute force, round trips and held-out truth."""

import random
import struct
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from loomseq.llm import bpe, common, hnsw, langid, line_dedup, ngram_join, packing, queries, sharding, suffix_dedup, topk, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = ["", None, " ", "\n\n", "a", "x" * 3000, "é" * 300, "<|endoftext|> a", "A  b\tc", "日本語 🙂", "ab " * 200]


def odd_docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(100 + i, t) for i, t in enumerate(ODD)], DOCS)


def words(rnd, n, of=400):
    return " ".join(f"w{rnd.randrange(of)}" for _ in range(n))


def near_copies(seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(40):
        base = words(rnd, rnd.choice([1, 2, 3, 5, 12, 25, 60, 150]), 3000).split()
        for _ in range(rnd.choice([1, 3, 8])):
            w = list(base)
            for _ in range(rnd.randrange(2 + len(w) // 25)):
                w[rnd.randrange(len(w))] = f"w{rnd.randrange(3000)}"
            rows.append((3 * len(rows) + 1, " ".join(w)))
    return rows + [(9001, None), (9002, ""), (9003, "A b"), (9004, "a B")]


def test_components_and_empty(spark):
    e = spark.createDataFrame([(5, 3), (3, 9), (7, 7), (None, 1), (9, 12), (20, 21), (3, 5)], "src long, dst long")
    assert sorted(map(tuple, common.connected_components(e).collect())) == [(3, 3), (5, 3), (9, 3), (12, 3), (20, 20), (21, 20)]
    assert common.connected_components(e.limit(0)).count() == 0


def test_op1_equals_sql_and_odd_vectors(spark):
    nan = float("nan")
    v = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (10, [1.0], 1), (11, [], 1)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(df).collect()}
    assert got[1] == got[2][:0] + (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in range(4, 12))
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_op1_recall_on_clusters():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(600, 32)), np.repeat(rng.normal(size=(5, 32)), 60, 0) + 0.04 * rng.normal(size=(300, 32))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    truth = x @ x.T >= 0.93
    found = hnsw.Hnsw(x).within(x.astype(np.float32), 0.93, 48)
    assert (found & truth).sum() >= 0.99 * truth.sum()


def test_op2_automaton_equals_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    terms, rnd = ["idiot", "loser", "trash", "ababa"], random.Random(1)
    auto = toxicity.LevenshteinTrie(terms)
    for _ in range(3000):
        w = "".join(rnd.choice("abdilorst") for _ in range(rnd.randrange(3, 8)))
        w = w if rnd.random() < 0.3 else rnd.choice(terms)[: rnd.randrange(3, 6)] + rnd.choice(["", "t", "ab"])
        assert bool(auto.find(w)) == any(distance(w, t) <= 1 for t in terms), w


def test_op2_quotation_and_held_out(spark):
    assert toxicity.quoted('she said "you idiot" to', 14, 19) and not toxicity.quoted("you idiot there", 4, 9)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out and predicted <> toxic").count()
    n = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").count()
    assert r <= 0.05 * n
    s = toxicity.score(odd_docs(spark), labels.limit(0)).collect()
    assert len(s) == 2 * len(ODD) and all(0 <= x.score <= 0.7 for x in s)


def test_op2_misspelled_stems_short_terms_and_mixed_words():
    m = toxicity.Matcher([("idio", True), ("moron", True), ("imbeci", True), ("idiot", False), ("shit", False), ("ass", False)])
    for w in ("idjot", "idot", "id1ot", "id1otically", "imbxcile", "imbeeciles", "sh1t", "shiit", "a$s", "mor0ns"):
        assert m.of(w) == "fuzzy", w
    assert m.of("idiots") == "stem" and m.of("shit") == "exact"
    for w in ("odio", "dios", "shot", "asp", "as", "his", "imbed", "morning", "mormon"):
        assert m.of(w) == "", w
    assert m.features("You id1ot, a well-known sh1t")[3:] == (2, 0, 2)


def test_op2_copies_count_once_and_no_term_is_cut(spark):
    letters = [chr(97 + i) for i in range(26)]
    terms = ["z" + a + b + c for a in letters[:7] for b in letters for c in letters]
    texts = [(" ".join(terms), 1, f" " + letters[i]) for i in range(20)] + [(f"clean text {i}", 0, "") for i in range(120)] + [("quite unlike", 1, "")] * 400
    rows = [(i, t + end, y) for i, (t, y, end) in enumerate(texts)] + [(900, "clean text 5", 1)]
    df = spark.createDataFrame([(3 * i + k, t, y) for i, t, y in rows for k in range(3)], "doc_id long, text string, toxic int").repartition(16)
    train = toxicity.labelled(df.drop("toxic"), df.select("doc_id", "toxic"))
    got = {r.text: r.toxic for r in train.collect()}
    assert train.count() == len(got) and got["quite unlike"] and got["clean text 5"] and not got["clean text 6"]
    found = toxicity.learn_terms(train.repartition(16))
    assert found == toxicity.learn_terms(train.coalesce(1)) and set(found) == {(t, False) for t in terms} and len(terms) > 4000
    with pytest.raises(ValueError):
        toxicity.learn_terms(train, most_terms=4000)


def test_op3_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    j = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert j.where("lang_pred = lang").count() >= 0.95 * j.count()
    out = {r.doc_id: r for r in langid.identify(odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()}
    assert all(r.lang_pred == "und" and r.score == 0 for r in out.values())
    assert {r.held_out for r in out.values() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1} <= {True}


def test_op4_equals_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    rnd = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(chr(rnd.choice([rnd.randrange(9, 127), rnd.randrange(0x300), rnd.randrange(0x370, 0x1000)])) for _ in range(20)) for _ in range(500)]
    for t in texts:
        packed = own.encode(t)
        ids = tok.encode(t, add_special_tokens=False).ids
        assert packed == struct.pack(f"<{len(ids)}I", *ids), t
        assert own.decode(packed) == tok.decode(ids, skip_special_tokens=False)
    docs = odd_docs(spark).withColumn("ids", F.lit("clash"))
    assert bpe.encode_digest(docs, path).count() == bpe.encode_documents(docs, path).count() == 2 * len(ODD)
    for r in bpe.encode_documents(docs.limit(5), path).collect():
        assert r.decoded == tok.decode(r.ids, skip_special_tokens=False)
    assert bpe.encode_digest(docs.limit(0), path).count() == 0


def test_op4_long_words_take_the_same_merges():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own, rnd = Tokenizer.from_file(path), bpe.WordBpe(path), random.Random(5)
    for k in range(40):
        w = "".join(rnd.choice("etaoinshrdlué") for _ in range(rnd.choice([90, 97, 150, 2000]))) if k % 4 else "ab" * rnd.randrange(60, 900)
        ids = tok.encode(w, add_special_tokens=False).ids
        assert own.encode(w) == struct.pack(f"<{len(ids)}I", *ids)
    assert len(own.encode("etaoin" * 30_000)) > 0


def test_op5_every_piece_once_and_near_bound(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), packing.encoder(path)
    assert all(list(enc(t or "")) == tok.encode(t or "", add_special_tokens=False).ids for t in ODD)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd_docs(spark).selectExpr("doc_id + 100000", "text"))
    out = packing.pack_pieces(packing.token_pieces(docs, path)).toPandas()
    assert out["length"].sum() == sum(len(enc(r.text or "")) + 1 for r in docs.collect())
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"] == s["length"].cumsum() - s["length"]).all() and s["length"].sum() <= 2048
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 2048) * 1.05 + 1
    assert packing.pack_pieces(packing.token_pieces(docs.limit(0), path)).count() == 0


def test_op5_plan_covers_and_beats_best_fit_on_hard_lengths():
    lengths = np.random.default_rng(0).integers(500, 1100, 20_000)
    hist = dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True))))
    plan, got = packing.plan_bins(hist), {}
    for config, count in plan:
        assert sum(n * m for n, m in config.items()) <= 2048
        for n, m in config.items():
            got[n] = got.get(n, 0) + m * count
    keys = np.array(sorted(hist))
    _, bound = packing.fractional(keys, np.array([hist[k] for k in keys], dtype=float), 2048, 100, 0.5)
    assert bound <= sum(c for _, c in plan) <= 1.05 * bound
    assert got == hist and sum(c for _, c in plan) < len(packing.best_fit(keys, np.array([hist[k] for k in keys]), 2048))


def test_op6_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    base = [words(rnd, rnd.choice([1, 3, 10, 30, 60])) for _ in range(40)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rnd.randrange(1, 7)):
            w = rnd.choice(base).split()
            if rnd.random() < 0.6:
                w[rnd.randrange(len(w))] = f"w{rnd.randrange(400)}"
            lines.append(rnd.choice(["", " "]) + " ".join(w))
        rows.append((d, "\n".join(lines)))
    rows += [(900 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, DOCS)
    want, real = brute.removed_lines(rows), line_dedup.bucket_links
    for crowded in (8, 0):  # 0: every bucket's open pairs go by rare shingles
        monkeypatch.setattr(line_dedup, "bucket_links", lambda b, t, least, c=crowded: real(b, t, least, c))
        got = {(r.doc_id, r.ln) for r in line_dedup.removed_lines(df).collect()}
        assert not got - want and len(want - got) <= 0.02 * len(want)
    assert line_dedup.lines_digest(df.limit(0)).count() == 0
    assert line_dedup.lines_digest(df).count() == len(rows)


def test_op6_crowded_lines_meet_only_where_they_can_link(spark):
    rnd = random.Random(8)
    slots, stock, lines = words(rnd, 60).split(), words(rnd, 9).split(), []
    for i in range(120):  # a template with some words out of a small stock: near each other, few by 0.8
        w = lines[-1].split() if i % 8 == 1 else list(slots)
        for k in rnd.sample(range(len(w)), 1 if i % 8 == 1 else 6):
            w[k] = rnd.choice(stock)
        lines.append(" ".join(w))
    lines = list(dict.fromkeys(lines))
    texts = spark.createDataFrame(list(enumerate(lines)), "h1 long, norm string")
    sets = [{x[j : j + 10] for j in range(len(x) - 9)} for x in lines]
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(len(sets)) for a in range(b)}
    links = {p for p, j in like.items() if j >= 0.8}
    rare = line_dedup.rare_pairs(texts.select("h1", F.col("h1").alias("c")), texts, 0.8).collect()
    assert len(rare) == len(set(rare)) and links <= {tuple(r) for r in rare}
    assert len(rare) <= 2 * len(links) and len(like) > 400 * len(links)
    x = texts.select(F.lit(0).alias("key"), "h1", F.col("h1").alias("c"))
    near = {tuple(r) for r in line_dedup.open_pairs(x, line_dedup.bitmaps(texts), 0.8).collect()}
    assert links <= near and len(near) <= 2 * len(links)
    got = {tuple(r) for r in line_dedup.linked(spark.createDataFrame(list(like), "a long, b long"), texts, 0.8).collect()}
    assert links and got == links


def test_op6_repeated_rows_null_ids_and_clashing_columns(spark):
    long = "a line that is long enough to be told apart from others"
    rows = [(1, long), (1, long), (2, f"x\n{long}"), (2, "x"), (None, long), (None, long), (3, None)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("gone", "rh", "row", "id", "lines_removed", "n_chars"):
        df = df.withColumn(c, F.lit("mine") if c != "n_chars" else F.lit(7).cast("long"))
    out = line_dedup.dedup_lines(df)
    assert out.columns == [c for c in df.columns if c != "lines_removed"] + ["lines_removed"]
    got = sorted((str(r.doc_id), r.text or "", r.lines_removed, r.gone, r.n_chars) for r in out.collect())
    # the two rows of id 2 hold "x" at the same line: the row with the smaller text hash is the earlier one
    assert [g for g in got if g[0] in "13None"] == sorted([("1", long, 0, "mine", 7)] * 2 + [("3", "", 0, "mine", 7)] + [("None", long, 0, "mine", 7)] * 2)
    assert sum(g[2] for g in got) == 2 and all(long not in g[1] for g in got if g[0] == "2")
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("group_bytes", [500, 2_000_000])
def test_op7_equals_brute_force(spark, group_bytes, monkeypatch):
    rnd = random.Random(4)
    shared = [words(rnd, 40) for _ in range(5)]
    rows = [(2 * i, " é ".join([words(rnd, rnd.randrange(3, 40)), rnd.choice(shared)[rnd.randrange(30) :], words(rnd, 9)])) for i in range(60)]
    rows += [(1001, rows[3][1]), (1003, rows[3][1]), (1005, "ab " * 90), (1009, rows[5][1][:150] + "!" + rows[5][1][150:])] + [(2001 + i, t) for i, t in enumerate(ODD)]
    rows += rows[:9] + [rows[61]] * 3
    own = suffix_dedup.repeated_ranges
    for hot in (10_000, 3):  # 3: common anchors go string by string
        monkeypatch.setattr(suffix_dedup, "repeated_ranges", lambda a, b: own(a, b, group_bytes, hot))
        out = suffix_dedup.repeats_digest(spark.createDataFrame(rows, DOCS).withColumn("tie", F.lit("clash"))).collect()
        assert len(out) == len(rows)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute.repeated_bytes(rows)


def test_op7_one_id_with_two_texts_null_ids_and_empty(spark):
    long = words(random.Random(8), 60)
    rows = [(1, long), (1, "other start " + long), (None, long), (None, long), (2, long)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.repeats_digest(df).collect())
    n = len(long.encode())
    assert got == sorted([("1", 0), ("1", n), ("2", n), ("None", 0), ("None", 0)])
    assert suffix_dedup.repeats_digest(df.limit(0)).count() == 0


def test_op7_sorts_suffixes():
    raw = np.frombuffer((b"ab" * 90 + b"abc" * 60 + b"ab" * 90), np.uint8)
    starts = np.arange(len(raw) - 100)
    order, number = suffix_dedup.sort_suffixes(raw, starts)
    cut = [raw.tobytes()[s : s + 100] for s in starts]
    assert [cut[i] for i in order] == sorted(cut)
    assert len(set(zip(cut, number.tolist()))) == len(set(cut)) == len(set(number.tolist()))


def test_op8_counts_gapless_and_empty(spark):
    docs = odd_docs(spark).unionByName(odd_docs(spark)).withColumn("shard", F.lit("clash"))
    out = sharding.shard_digest(docs, shards=7).toPandas()
    n = out.groupby("shard")["slot"]
    assert len(out) == docs.count() and n.count().max() - n.count().min() <= 1 and (n.max() + 1 == n.count()).all() and out["slot"].min() == 0
    assert sharding.shard_digest(docs.limit(0)).count() == 0


def test_op8_a_rerun_gives_the_same_and_files_hold_the_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i % 90, f"{i % 70} text") for i in range(500)], DOCS)
    one = sharding.shard_records(docs, shards=5, bucket_bytes=200_000)
    two = sharding.shard_records(docs.repartition(7), shards=5, bucket_bytes=200_000)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    sharding.write_shards(one, f"file://{tmp_path}/shards")
    back = sharding.read_shards(one, f"file://{tmp_path}/shards")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, one.collect()))
    for shard in range(5):
        assert sorted(r.slot for r in back.where(F.col("shard") == shard).collect()) == list(range(100))


def test_op8_spreads_equal_rows(spark, tmp_path):
    one = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    docs = one.unionByName(spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text")))
    b = sharding.scatter(docs, "doc_id", 80, 42).groupBy("_b").count().toPandas()["count"]
    assert b.sum() == 40_300 and len(b) == 80 and b.max() < 700
    out = sharding.shard_records(docs, shards=7)
    n = out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert sum(r.n for r in n) == 40_300 and max(r.n for r in n) - min(r.n for r in n) <= 1 and all(r.d == r.n == r.m + 1 for r in n)
    again = sharding.shard_records(docs.repartition(5), shards=7)
    assert out.exceptAll(again).count() == 0


def test_op8_shuffle_is_a_permutation(spark):
    rows = [r.o for r in spark.range(300).select(sharding.fisher_yates((F.col("id") % 40 + 1).cast("int"), 3, F.col("id")).alias("o")).collect()]
    assert all(sorted(o) == list(range(len(o))) for o in rows) and len({tuple(o) for o in rows if len(o) == 30}) > 1
    first = [o[0] for o in (r.o for r in spark.range(3000).select(sharding.fisher_yates(F.lit(4), 3, F.col("id")).alias("o")).collect())]
    assert all(600 < first.count(k) < 900 for k in range(4))


def test_op8_moves_texts_in_buckets_by_bytes(spark, monkeypatch):
    seen, real = [], sharding.shard_records
    monkeypatch.setattr(sharding, "shard_records", lambda records, *rest: seen.append(records.columns) or real(records, *rest, bucket_bytes=50_000))
    docs = spark.createDataFrame([(i, f"{i} " + "é" * 5000) for i in range(60)], DOCS)
    out = sharding.shard_digest(docs, shards=4)
    assert "text" in seen[0]
    got = {r.doc_id: (r.size, r.text_crc32) for r in out.collect()}
    assert got == {r.doc_id: (len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in docs.collect()}
    assert out.groupBy("shard").agg(F.max("slot").alias("m"), F.count("*").alias("n")).where("m = 14 and n = 15").count() == 4


@pytest.mark.parametrize("n, num, block", [(3, 90, 1000), (3, 90, 5), (5, 80, 1000)])
def test_op9_equals_brute_force(spark, n, num, block):
    rows = near_copies(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(spark.createDataFrame(rows, DOCS), n=n, num=num, block_rows=block, sample=1.0).collect()}
    assert got == brute.shingle_groups(rows, n, num)


def test_op10_ties_and_odd_vectors(spark):
    v = [(50, [1.0, 0.0], 1)] + [(i, [0.5, 0.25], 1) for i in (9, 3, 7, 5, 2, 4, 8)] + [(11, None, 1), (12, [None, 1.0], 1), (13, [float("inf"), 1.0], 1), (100, [0.5, 0.25], 1)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == [(50, i + 1, d, 256 * 128) for i, d in enumerate((2, 3, 4, 5, 7))] + [(100, 1, 50, 256 * 128)] + [(100, i + 2, d, 128 * 128 + 64 * 64) for i, d in enumerate((2, 3, 4, 5))]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, docs, SF), name)
        assert out.columns == cols and 0 < out.count() <= docs.count()
        if name == "ngram_join":
            gone = {d for d, (_, c) in brute.shingle_groups([(r.doc_id, r.text) for r in docs.collect()], 5, 80).items() if c != d}
            assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in out.collect()} == gone
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_stages_on_repeated_rows_clashing_names_and_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 30")
    odd = docs.unionByName(docs)
    for c in ("_gone", "_kept", "lang_pred", "lines_removed", "row", "tie", "kept", "id"):
        odd = odd.withColumn(c, F.lit(f"mine {c}"))
    for name, stage in (("line_dedup", corpus_pipeline.drop_repeated_lines), ("suffix_dedup", corpus_pipeline.drop_repeated_passages), ("language_id", corpus_pipeline.keep_known_language)):
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns
        got, once = sorted(map(str, out.collect())), sorted(map(str, stage(spark, odd.dropDuplicates(), SF).collect()))
        assert got == sorted(2 * once), name
        assert out.where("_gone <> 'mine _gone' or _kept <> 'mine _kept' or lang_pred <> 'mine lang_pred' or lines_removed <> 'mine lines_removed'").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_op1_and_op10_over_several_shards_and_blocks(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(250, 8)), np.repeat(rng.normal(size=(10, 8)), 15, 0) + 0.05 * rng.normal(size=(150, 8))]).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(int(i), v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int")
    u = x.astype(np.float64)
    u /= np.sqrt((u**2).sum(axis=1))[:, None]
    near = (u @ u.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    root = brute.union_find(len(x), zip(*np.nonzero(near)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(df, shard_rows=60, block_rows=50).collect()}
    assert got == {i: (int(near[i].sum()), root[i]) for i in range(len(x))}
    # rows that repeat are vectors of their own, linked with what they repeat
    again = sorted((r.vec_id, r.n_links, r.component_id) for r in hnsw.near_duplicates(df.union(df.where("vec_id in (1, 2, 300, 301)")), shard_rows=60, block_rows=50).collect())
    twice = {1, 2, 300, 301}
    links = lambda i: int(near[i].sum()) + sum(bool(near[i][j]) for j in twice) + (i in twice)
    assert again == sorted((i, links(i), root[i]) for i in range(len(x)) for _ in range(2 if i in twice else 1))
    z = np.floor(256 * x.astype(np.float64))
    want = set()
    for q in range(0, len(x), 50):
        score = z @ z[q]
        best = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert set(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=60, block_rows=3).collect())) == want


def test_empty_tables_give_empty_results(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(none).count() == toxicity.score(none, labels).count() == ngram_join.link_documents(none).count() == 0


def test_registered_names():
    have = set(queries.queries())
    assert {n.split("_")[0] for n in have} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert set(queries.oracle_sql()) <= have


def test_op1_rows_of_one_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (7, [1.0, 1.0], 2), (7, [1.0, 1.0], 2), (None, [1.0, 0.0], 1), (None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(str(tuple(r)) for r in hnsw.near_duplicates(df).collect())
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (7, 1, 7, True), (7, 1, 7, True), (None, 0, None, None), (None, 0, None, None)]
    assert got == sorted(map(str, want))


def test_op9_null_ids_have_no_component(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, None), (3, "")]
    got = sorted(str(tuple(r)) for r in ngram_join.link_documents(spark.createDataFrame(rows, DOCS), sample=1.0).collect())
    assert got == sorted(map(str, [(None, 4, None), (None, 4, None), (1, 4, 1), (2, 4, 1), (2, 4, 1), (None, 0, None), (3, 0, 3)]))


def test_pipeline_join_stage_keeps_dotted_columns_and_null_ids(spark):
    rows = [(1, "one two three four five six", "x"), (2, "one two three four five six", "y"), (None, "one two three four five six", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    out = corpus_pipeline.keep_one_of_each_group(spark, df, "")
    assert out.columns == df.columns and sorted(str(r["a.b"]) for r in out.collect()) == ["x", "z"]


def test_null_and_repeated_ids_keep_their_rows(spark):
    rows = [(None, "hello there, how are you today"), (None, None), (5, "bonjour tout le monde"), (5, "another text of the same id"), (5, "another text of the same id")]
    df = spark.createDataFrame(rows, DOCS).withColumn("lang", F.lit("en")).withColumn("score", F.lit("clash"))
    path = public_tokenizers.path
    ids = lambda out: sorted(str(r.doc_id) for r in out.select("doc_id").collect())
    want = sorted(["None", "None", "5", "5", "5"])
    assert ids(langid.identify(df)) == want
    assert ids(bpe.encode_digest(df, path("word_bpe_49k.json"))) == want
    assert ids(sharding.shard_digest(df, shards=2)) == want
    pieces = packing.pack_pieces(packing.token_pieces(df, path("byte_bpe_50k.json")))
    assert ids(pieces) == want and pieces.agg(F.sum("length")).head()[0] == sum(len(packing.encoder(path("byte_bpe_50k.json"))(t or "")) + 1 for _, t in rows)


def test_op10_descends_both_trees(spark):
    r = np.random.default_rng(3)
    middles = r.normal(0, 4_000, (40, 8))
    x = np.floor(np.concatenate([m + r.normal(0, 40, (60, 8)) for m in middles]))
    x = np.concatenate([x, x[:200], np.zeros((5, 8))])
    ids = np.arange(len(x))
    asked = ids[ids % 5 == 0]
    seen = {}
    got = sorted(topk.search_group(ids, x, asked, x[asked], 5, leaf=16, seen=seen))
    scores = x[asked] @ x.T
    want = []
    for i, a in enumerate(asked):
        order = [j for j in np.lexsort((ids, -scores[i])) if j != a][:5]
        want += [(int(a), int(j), int(scores[i, j])) for j in order]
    assert got == sorted(want)
    leaves = lambda n: sum(map(leaves, n.children)) if n.children else 1
    both = leaves(topk.cover_tree(x[asked], 16)) * leaves(topk.cover_tree(np.unique(x, axis=0), 16))
    # whole groups of queries lose whole groups of candidates: far fewer pairs are met than there are pairs of leaves
    assert seen["dropped"] > 0 and seen["scored"] < both / 4 and seen["met"] < both


def test_op10_trees_cover_their_points(spark):
    x = np.random.default_rng(4).normal(0, 100, (700, 12))
    todo, points = [topk.cover_tree(x, 20)], []
    while todo:
        n = todo.pop()
        assert topk.distances(x[n.points], n.center).max() <= n.radius + 1e-9
        assert len(n.points) <= 20 or n.children
        points += [] if n.children else n.points.tolist()
        todo += n.children
    assert sorted(points) == list(range(700))


def test_a_large_group_is_dealt_to_blocks_of_like_sizes(spark):
    bands = ngram_join.Bands(80, 100)
    rows = [(i, 7, 1 + i % 1000) for i in range(4000)] + [(5000 + i, 8, 1 + 300 * i) for i in range(50)]
    got = ngram_join.deal_blocks(spark.createDataFrame(rows, "node long, grp long, n_shingles long"), bands, 100).collect()
    tasks = {}
    for r in got:
        assert r["at"] in (r.x, r.y)
        tasks.setdefault(r.node, set()).add((r.grp, r.x, r.y))
    size = {n: s for n, _, s in rows}
    # sets that may link meet in one task
    for a in range(0, 4000, 97):
        for b in range(0, 4000, 13):
            if a != b and 100 * min(size[a], size[b]) >= 80 * max(size[a], size[b]):
                assert tasks[a] & tasks[b]
    assert all(len(tasks[5000 + i]) == 1 for i in range(50))
    # all 40 blocks of the group met each other before
    assert sum(len(tasks[i]) for i in range(4000)) / 4000 < 25


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80)])
def test_op9_thinned_equals_brute_force(spark, n, num):
    rows = near_copies(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(spark.createDataFrame(rows, DOCS), n=n, num=num, sample=1.0, thin=True).collect()}
    assert got == brute.shingle_groups(rows, n, num)


def test_op9_indexes_only_sets_that_can_link(spark):
    # 60 originals of their own words chain by empty segments; two near copies of one and two equal texts stay
    own = [" ".join(f"d{d}w{i}" for i in range(40)) for d in range(60)]
    near = own[0].split()
    near[0] = "other"
    rows = [*enumerate(own), (100, " ".join(near)), (101, own[1]), (102, ""), (103, None), (None, own[2])]
    grams = {d: {hash(tuple((t or "").split()[i : i + 3])) for i in range(38)} if t else set() for d, t in rows}
    sets = [(d, len(g), hash(frozenset(g)), 0, sorted(g)) for d, g in grams.items() if g and d is not None]
    sets = spark.createDataFrame(sets, "doc_id long, n_shingles long, s1 long, s2 long, grams array<long>")
    left = {r.node for r in ngram_join.may_link(sets, 90, 100).collect()}
    assert left == {0, 100}
    # a part of the n-grams leaves more in and none out
    for of in (2, 5, 9):
        assert {0, 100} <= {r.node for r in ngram_join.may_link(sets.withColumn("grams", F.expr(f"filter(grams, g -> pmod(g, {of}) = 0)")), 90, 100).collect()}
    got = {(r.doc_id, r.component_id) for r in ngram_join.link_documents(spark.createDataFrame(rows, DOCS), sample=1.0, thin=True).collect()}
    assert (100, 0) in got and (101, 1) in got and (5, 5) in got and (102, 102) in got and (None, None) in got
