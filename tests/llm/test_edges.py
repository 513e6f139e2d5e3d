"""Clashing names, repeated and missing ids, ties, hot groups and bounds of the training-data operators and the pipeline's stages."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline

R = random.Random(11)
VOCAB = [f"{a}{b}{c}" for a in ("be", "to", "ra", "mi") for b in ("lo", "ne", "ti", "su", "ka") for c in ("n", "r", "s", "ma", "do")]
CLASH = ["size", "source_size", "target", "quota_blocks", "shard", "taken", "count", "_id", "lang_pred", "score", "_told", "told", "_lang", "lang_told", "_own_id", "own_id", "times", "_times", "g", "sig", "n", "row", "cut", "part", "spread", "order", "at", "_text", "_hit", "_items", "_n_words", "k0", "_hits", "_row", "_met", "doc id", "a.b"]


def sentence(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def write(d, name, columns):
    pq.write_table(pa.table(columns), f"{d}/{name}.parquet")


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    d = tmp_path_factory.mktemp("edges")
    base, leak = sentence(80), sentence(14)
    near = base.split()
    near[40] = "changed"
    rows = [(5, base), (5, " ".join(near)), (5, sentence(30)), (6, base), (None, base), (None, sentence(25)), (None, sentence(25)), (7, None), (7, ""), (8, f"{sentence(20)} {leak} {sentence(20)}"), (9, leak), (10, "12 34"), (11, sentence(2000)), (12, sentence(40)), (12, sentence(40))]
    rows += [(20 + i, sentence(30)) for i in range(30)]
    write(d, "documents", {"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows], "lang": [["en", None][k % 2] for k in range(len(rows))], "source": [["a", None, "b"][k % 3] for k in range(len(rows))], "n_chars": pa.array([len(t or "") for _, t in rows], pa.int32())} | {c: [c] * len(rows) for c in CLASH})
    write(d, "benchmark", {"item_id": pa.array([3, 3, None], pa.int64()), "text": [leak, leak, "never seen words"], "_hit": ["x"] * 3, "name": ["y"] * 3})
    return str(d), rows, leak


def test_stages_with_any_names_and_ids(spark, world):
    from rasterweave.llm.common import materialize

    d, rows, leak = world
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, d), "edges")
        seen[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == names
            assert all(r[c] == c for r in seen[name] for c in CLASH)
    lettered = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
    assert sorted((str(r.doc_id), r.text) for r in seen["language"]) == sorted((str(i), t) for i, t in lettered)
    assert all(r.lang == "en" for r in seen["language"])
    kept = [(r.doc_id, r.text) for r in seen["near copies"]]
    family = [t for i, t in kept if t.split()[:30] == rows[0][1].split()[:30]]
    assert len(family) == 1 and len(kept) == len(lettered) - 3  # one of four linked rows; others of those ids stay
    assert (None, rows[0][1]) not in kept and sum(i is None for i, _ in kept) == 2 and sum(i == 12 for i, _ in kept) == 2
    cleaned = {(r.doc_id, r.text) for r in seen["leaks"]}
    assert all(i != 9 and leak not in t for i, t in cleaned) and len(cleaned) == len(kept) - 1
    assert {r.doc_id for r in seen["mixing"]} <= {i for i, _ in cleaned}
    assert len(seen["tokens"]) == len(seen["mixing"])


def test_empty_tables_through_the_stages(spark, world, tmp_path):
    for name in ("documents", "benchmark"):
        pq.write_table(pq.read_table(f"{world[0]}/{name}.parquet").slice(0, 0), f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_one_identical_row_of_many_stays(spark):
    from rasterweave.llm.jaccard import one_of_each

    text = sentence(50)
    docs = spark.createDataFrame([(1, text, "x")] * 200 + [(None, text, "x")] * 50 + [(2, text.upper(), "y"), (3, None, "z"), (3, None, "z")], "doc_id long, text string, times string")
    assert sorted((r.doc_id, r.text) for r in one_of_each(docs).collect() if r.text) == [(1, text)]
    assert one_of_each(docs).where("text IS NULL").count() == 2


def test_items_count_once_by_id(spark, world):
    from rasterweave.llm.decontaminate import clean, mark, op9_decontaminate

    d, rows, leak = world
    got = {(r.doc_id, r.n_words): r for r in op9_decontaminate(spark, d).collect()}
    hit = got[9, 14]
    assert (hit.n_hit, hit.n_items, hit.items_sha256, hit.contaminated) == (14, 1, hashlib.sha256(b"3").hexdigest(), True)
    bench = spark.createDataFrame([(None, "two words"), (1, "three plain words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "here two words stand"), (2, "three plain words two words")], "doc_id long, text string")
    marks = {r.doc_id: (bin(int.from_bytes(r._hit)).count("1"), r._items) for r in mark(docs, bench).collect()}
    assert marks == {1: (2, []), 2: (5, ["1"])}
    long, leaked = f"{sentence(30)} {leak} {sentence(30)}", spark.createDataFrame([(1, leak)], "item_id long, text string")
    some = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert [clean(some, leaked, min_span=k).first().text == long for k in (1, 10, 14, 15, 50)] == [False, False, False, True, True]
    assert clean(some, leaked, max_coverage=0.1).count() == 0


def test_benchmarks_of_many_shards(spark, monkeypatch):
    from rasterweave.llm import decontaminate as D

    monkeypatch.setattr(D, "ASKED", 2)
    items = [(k if k % 7 else None, sentence(R.choice([3, 9, 10, 25, 90]))) for k in range(40)] + [(3, sentence(12)), (4, None), (5, "...")]
    texts = [f"{sentence(15)} {R.choice(items[:40])[1]} {sentence(9)}" if k % 2 else sentence(60) for k in range(60)] + [None, "", items[1][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    told = [{r.doc_id: (r._n_words, bytes(r._hit), list(r._items)) for r in D.mark(docs, bench, shard_words=s).collect()} for s in (200_000, 150, 40)]
    assert told[0] == told[1] == told[2] and sum(bool(x[1]) for x in told[0].values()) > 20


def test_draws_are_bounded(spark):
    from rasterweave.llm import langid, toxicity

    rows = [("the same words again and again", "en")] * 30_000 + [(sentence(12), "en") for _ in range(300)] + [(sentence(12).upper(), "xx") for _ in range(40)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = [r.lang for r in langid.drawn(docs, "lang", {"en": 50, "xx": 50}, 1).collect()]
    assert got.count("en") == 50 and got.count("xx") == 40
    net = langid.fit(docs, train_docs=20, train_windows=2)
    assert net.labels == ["en", "xx"]
    many = spark.createDataFrame([(1, t) for t, _ in rows[:5000]] + [(2 + k, t) for k, (t, _) in enumerate(rows[30_000:])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 300)], "doc_id long, toxic int")
    machine = toxicity.fit(many, labels, train_docs=10, train_terms=5)
    assert 0 <= toxicity.score(many, machine).first().score <= 1


def test_network_tables_equal_a_direct_convolution():
    from rasterweave.llm import langid as L

    net = L.Network(["a", "b", "c"], seed=2)
    net.p["b"][:] = np.random.default_rng(0).normal(0, 0.1, len(net.p["b"]))
    texts = [bytes(R.randrange(256) for _ in range(n)) for n in (1, 5, 256, 700)]
    for raw in texts:
        want = []
        for w in L.windows(raw):
            peaks = [max(sum(float(net.p[f"k{k}"][j][w[i + j]][f]) for j in range(k)) for i in range(L.PLACES)) for k in L.WIDTHS for f in range(L.FILTERS)]
            z = np.maximum(np.array(peaks) + net.p["b"], 0) @ net.p["w"] + net.p["c"]
            want.append(z - np.log(np.exp(z).sum()))
        assert np.allclose(L.Scorer(net).log_probabilities(L.windows(raw)), want, atol=1e-4)


def test_machine_equals_explicit_pairs():
    from rasterweave.llm.toxicity import Machine

    rng = np.random.default_rng(1)
    words = np.sort(rng.choice(10_000, 30, replace=False).astype(np.uint32))
    m = Machine(words, 0.2, rng.normal(0, 1, 30), rng.normal(0, 0.5, (30, 4)))
    docs = [np.unique(rng.choice(np.concatenate([words, [10_001, 10_002]]), k)).astype(np.uint32) for k in (0, 1, 5, 20)]
    got = m.scores(np.concatenate(docs), np.cumsum([0, *map(len, docs)]))
    for s, found in zip(got, docs):
        at = [int(np.searchsorted(words, t)) for t in found if t in words]
        z = 0.2 + sum(m.w[i] for i in at) + sum(float(m.v[i] @ m.v[j]) for k, i in enumerate(at) for j in at[k + 1 :])
        assert s == pytest.approx(1 / (1 + np.exp(-z)))


def test_mix_lays_out_blocks_as_a_plain_walk_does(spark):
    """Every word of every line is laid out, blocks are numbered, and the words in the blocks taken are counted by document."""
    from pyspark.sql import functions as F

    from rasterweave.llm.mixing import mix

    block, shard_words, max_shards, seed = 8, 200, 10, 17
    docs = spark.createDataFrame([(k, sentence(R.randrange(0, 60)), "ab"[k % 7 == 0]) for k in range(400)], "doc_id long, text string, source string").repartition(5)
    a, b = ({r.doc_id: r.asDict() for r in mix(x, block=block, shard_words=shard_words, max_shards=max_shards).collect()} for x in (docs, docs.repartition(3)))
    assert a == b and len({(r["source"], r["shard"]) for r in a.values()}) > 5
    deal = lambda what: F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"), F.lit(what)).alias(what)
    dealt = {r.doc_id: r for r in docs.select("doc_id", deal("order"), deal("part"), F.xxhash64("text").alias("spread")).collect()}
    each = max(shard_words, -(-sum(r["size"] for r in a.values()) // max_shards))
    total, taken = dict.fromkeys("ab", 0), dict.fromkeys(a, 0)
    for r in a.values():
        total[r["source"]] += r["size"]
    for key in sorted({(r["source"], r["shard"]) for r in a.values()}):
        parts = max(1, -(-total[key[0]] // (max(1, -(-total[key[0]] // each)) * shard_words)))
        mine = [i for i, r in a.items() if (r["source"], r["shard"]) == key]
        mine.sort(key=lambda i: (dealt[i].part % parts, dealt[i].order, i, dealt[i].spread, a[i]["size"]))
        line = [i for i in mine for _ in range(a[i]["size"])]
        blocks = -(-len(line) // block)
        whole, rest = divmod(a[mine[0]]["quota_blocks"], blocks)
        first = spark.range(1).select(F.pmod(F.xxhash64(F.lit(seed), F.lit("ab".index(key[0])), F.lit(key[1]), F.lit("first")), F.lit(blocks))).first()[0]
        times = [whole] * blocks
        for k in range(rest):
            times[(first + k) % blocks] += 1
        for at, i in enumerate(line):
            taken[i] += times[at // block]
    assert taken == {i: r["taken"] for i, r in a.items()}


def test_topk_with_repeated_ids_and_lengths(spark):
    from rasterweave.llm.topk import top_k

    rows = [(0, [1.0, 2.0]), (0, [3.0, -1.0, 9.0]), (1, [1.0]), (2, []), (None, [1.0, 1.0]), (3, [0.5, 0.25])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect())
    v = [(i, [int(1024 * x) for x in x]) for i, x in rows if i is not None]
    want = []
    for k, (q, x) in enumerate(v):
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for j, (i, y) in enumerate(v) if j != k)[:3]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_encoder_cuts_nowhere_that_matters():
    import public_tokenizers
    from rasterweave.llm.common import utf8
    from rasterweave.llm.tokenfile import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    by_piece, whole = Encoder(path), Encoder(path)
    whole.cuts = False
    letters = [*"abcXYZ  \n\n\t\r.,'!?|<>-_09", "é", "×", "÷", "ñ", " ", "\u0085", "日", "🙂", "́", "ß", " ", "α", "ж", "ͅ", " 'll", "'s", "<|endoftext|>", "\x00", "ʰ"]
    letters += map(chr, range(0xA0, 0x280, 7))  # every kind of character of two bytes
    for _ in range(60):
        offsets, data = utf8(pa.array(["".join(R.choice(letters) for _ in range(R.randrange(0, 60))) for _ in range(50)] + [None, ""]))
        a, b = by_piece.encode(offsets, data, 2), whole.encode(offsets, data, 2)
        assert all(x.tolist() == y.tolist() for x, y in zip(a, b))


def test_every_character_of_two_bytes_in_a_word():
    import public_tokenizers
    from rasterweave.llm.common import utf8
    from rasterweave.llm.tokenfile import Encoder

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f(chr(c)) for c in range(0x80, 0x280) for f in (lambda c: c, lambda c: f" a{c}b", lambda c: f"{c}{c} {c}")]
    offsets, data = utf8(pa.array(texts))
    ids, each = e.encode(offsets, data, 2)
    ends = each.cumsum()
    for t, k, z in zip(texts, each, ends):
        assert ids[z - k : z].tolist() == [*e.tk.encode(t, add_special_tokens=False).ids, 2]
