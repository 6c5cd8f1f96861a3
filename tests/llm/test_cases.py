"""The odd cases of every operator and stage: nulls, empty and repeated rows, ties, empty tables, clashing names; and the queries' own columns."""

import glob
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shiftscope.llm import ann, chat, decontam, langid, mixing, neardup, quality, queries, secrets, sharding, toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that helper columns and other frames have.
CLASHES = ["shard", "slot", "label", "token", "set", "size", "k", "gram", "value", "id", "v", "code", "__tox_score", "__fm_spans", "__lang_pred", "__secret_spans", "__quality_score"]


def odd_rows(rng):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(24)]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    return rows + [(None, texts[0], None, None, None), (None, None, None, None, None), (3, texts[5], "en", "s0", 1), (30, "", "en", "s1", 0), (30, "", "en", "s1", 0), (31, "\n \t", None, "s2", 3), (7, texts[7], "de", "s1", len(texts[7]))]


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows(random.Random(3))
    frame = spark.createDataFrame(rows, KIND)
    return frame.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def others(spark):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(24)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "alpha beta"), (2, None), (None, "gamma delta epsilon"), (3, "")], "item_id long, text string")
    return labels, benchmark


def operators(labels, benchmark):
    return {
        "shard": lambda d: sharding.shard(d, 5, bucket_bytes=200),
        "identify": lambda d: langid.identify(d, langid.fit(d)),
        "scan": secrets.scan,
        "find_spans": lambda d: decontam.find_spans(d, benchmark),
        "quality": lambda d: quality.scored(d, quality.fit(d, labels)),
        "mix_plan": mixing.mix_plan,
        "near_duplicates": neardup.near_duplicates,
        "toxicity": lambda d: toxicity.tagged(d, toxicity.fit(d, labels)),
    }


@pytest.mark.parametrize("name", ["shard", "identify", "scan", "find_spans", "quality", "mix_plan", "near_duplicates", "toxicity"])
def test_odd_rows(spark, odd, others, name):
    run = operators(*others)[name]
    rows = run(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.select("doc_id").collect())
    if name != "near_duplicates":
        keep = [c for c in odd.columns if not c.startswith("__") and c not in ("shard", "slot")]
        assert set(keep) <= set(rows[0].asDict())
    # repeated rows have equal results, but for their places
    if name not in ("shard",):
        same = [r.asDict() for r in rows if r.doc_id == 30]
        assert len(same) == 2 and same[0] == same[1]
    assert run(odd.limit(0)).collect() == []


def test_odd_rows_in_order(spark, odd):
    out = sharding.shard(odd, 5, bucket_bytes=200)
    assert {"shard_before", "slot_before"} <= set(out.columns)
    rows = out.collect()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(n)) for k, n in sizes.items())


def test_equal_rows_are_split_and_maps_pass(spark, tmp_path):
    many = spark.range(900).select(F.lit(1).cast("long").alias("doc_id"), F.lit("y" * 40).alias("text"), F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1)).alias("m"))
    some = spark.range(200).select("id", F.concat(F.lit("t"), F.col("id")), F.create_map(F.lit("k"), F.col("id").cast("int")))
    out = sharding.shard(many.unionAll(some), 4, bucket_bytes=1500)
    rows = out.collect()
    assert Counter((r.doc_id, r.text, tuple(sorted(r.m.items()))) for r in rows) == Counter([(1, "y" * 40, (("a", 1), ("b", 2)))] * 900 + [(i, f"t{i}", (("k", i),)) for i in range(200)])
    sharding.write_shards(out.drop("m"), f"{tmp_path}/shards")
    for k in range(4):
        slots = [s for f in sorted(glob.glob(f"{tmp_path}/shards/shard={k}/*.parquet")) for s in pq.read_table(f).column("slot").to_pylist()]
        assert slots == list(range(275))


def test_stages_on_odd_rows(spark, others, tmp_path):
    import corpus_pipeline

    labels, benchmark = others
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(odd_rows(random.Random(3)), KIND).select("*", *[F.lit("x").alias(c) for c in ("label", "token", "__fm_spans", "__quality_score", "__mix_size", "__mix_copies", "__dup_gone", "__dup_set")])
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, str(tmp_path))
        left = Counter(tuple(r)[:5] for r in kept.collect())
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
        if name == "mixing":
            assert set(left) <= {tuple(r)[:5] for r in docs.collect()}
        else:
            assert not left - Counter(tuple(r)[:5] for r in docs.collect())
        if name != "sharding":
            assert kept.columns == docs.columns


def test_vectors_of_any_size(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 12))
    x[7], x[8] = x[5], x[5] * 3
    scale = np.ones(300)
    scale[[0, 20, 40]] = 1e-200, 1e200, 5e-324 * 2**60
    vectors = [(v * s).tolist() for v, s in zip(x, scale)] + [[1e-200] + [0.0] * 11, [1e200, -1e200] + [0.0] * 10]
    rows = [(i, v, "s") for i, v in enumerate(vectors)] + [(400, None, "s"), (401, [], "s"), (402, [float("inf")] * 12, "s"), (403, [0.0] * 12, "s"), (404, [1.0] * 5, "s"), (None, vectors[3], "s")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.search(frame, F.col("id") % 20 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    y = np.array(vectors)
    y = y / np.abs(y).max(axis=1, keepdims=True)
    unit = y / np.linalg.norm(y, axis=1)[:, None]
    for q in range(0, 302, 20):
        exact = unit @ unit[q]
        exact[q] = -2
        best = np.lexsort((np.arange(302), -exact.round(12)))[:5]
        own = sorted(got[q])
        assert [v for _, v, _ in own] == best.tolist()
        assert [s for _, _, s in own] == pytest.approx(exact[best], abs=1e-9)


def test_recall_beyond_the_training_sample(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 24))
    x = np.concatenate([centres[rng.integers(0, 12, 4000)] + 0.05 * rng.normal(size=(4000, 24)), rng.normal(size=(1000, 24))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    coded, books, dimension = ann.index(frame, training=500)
    assert coded.count() == 5000 and dimension == 24
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    found = {}
    for r in ann.search(frame, F.col("id") % 100 == 0, 5, shortlist=128).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 5000, 100):
        exact = unit @ unit[q]
        exact[q] = -2
        hits += len(found[q] & set(np.argsort(-exact)[:5].tolist()))
    assert hits >= 0.9 * 5 * 50


def test_controls_never_stand_bare():
    rng = random.Random(21)
    bits = [*chat.CONTROLS, "\\", " ", "a", "é", "\n", "<", ">", "</", "s>", "INST"]
    for _ in range(300):
        reader, turns = chat.Reader(0), []
        for _ in range(rng.randrange(6)):
            role = rng.choice(["user", "assistant", "system", "".join(rng.choices(bits, k=3)), ""])
            text = "".join(rng.choices(bits, k=rng.randrange(9)))
            segment, first, end = chat.render(role, text)
            # neither within the text nor across its ends, by plain search
            inside = segment[first - 1 : end + 1]
            assert not any(c in inside for c in chat.CONTROLS)
            if role not in ("user", "assistant"):
                assert not any(c in segment[2 : first - 3] for c in chat.CONTROLS)
            own = (first, end) if role == "assistant" else (0, 0)
            reader.add(segment, *own)
            turns.append((role, text))
        _, n, digest, loss, masked, _ = reader.row()
        import hashlib

        assert (n, digest) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        said = "".join(t for r, t in turns if r == "assistant")
        assert (loss, masked) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def brute_links(text, strong):
    """Weak parts that have a complement, by looking at all pairs."""
    weak = {"identifier": [m.span() for m in secrets._IDENTIFIER.finditer(text)], "endpoint": [m.span() for m in secrets._ENDPOINT.finditer(text)]}
    taken = [(a, b) for _, a, b in strong] + weak["identifier"] + weak["endpoint"]
    values = [m for m in secrets._OPAQUE.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
    weak["opaque"] = [m.span() for m in values if not any(m.start() < b and a < m.end() for a, b in taken)]
    scope = lambda at: sum(m.start() < at for m in secrets._BLANK.finditer(text))

    def near(x, others):
        return any(scope(x[0]) == scope(y[0]) and (0 <= y[0] - x[1] <= secrets.REACH or 0 <= x[0] - y[1] <= secrets.REACH) for y in others)

    names = weak["identifier"] + [(a, b) for k, a, b in strong if k == "access"]
    secret = [(a, b) for k, a, b in strong if k != "access"] + weak["opaque"]
    rule = {"identifier": lambda x: near(x, secret), "endpoint": lambda x: near(x, secret) and near(x, names), "opaque": lambda x: near(x, names) or near(x, weak["endpoint"])}
    return [(k, *x) for k in rule for x in weak[k] if rule[k](x)]


def test_links_against_all_pairs():
    rng = random.Random(33)
    linked = 0
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 90)):
            value = "".join(rng.choices("abcdefXYZ0123456789", k=rng.randrange(20, 40)))
            parts.append(rng.choice([f"token: {value}", "AKIA" + value.upper(), "0af3" * rng.randrange(6, 12), "login: jane", f"client_id={value}", "https://a.example.org/x?y=" + value, f"host: {value[:8]}", value, " " * rng.randrange(200), "\n\n", "some words here"]))
        text = rng.choice([" ", "\n"]).join(parts)
        strong = secrets.strong_spans(text)
        found = secrets.linked_spans(text, strong)
        assert found == brute_links(text, strong)
        linked += len(found)
    assert linked > 500
    for alone in ("see https://example.com/abcdefghij0123456789xyz", "client_id: a1b2c3d4e5f6g7h8i9j0k1l2", "login=Zx81Qm40Lp77Vb92Nc15Kd"):
        assert secrets.linked_spans(alone, secrets.strong_spans(alone)) == []


def test_query_columns(spark):
    sf = "/root/testdata/sf0.001"
    chats = {r.conv_id: r for r in queries.op7_chat(spark, sf).collect()}
    assert chats[-7].n_turns == 2 and chats[-7].loss_chars == len("</s>[INST] ok [/INST]")
    for name, modulus, fold in (("op2_langid", 4, 2), ("op5_quality", 3, 1), ("op10_toxicity", 4, 2)):
        rows = queries.queries()[name](spark, sf).withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus).collect()
        assert rows and all(r.held_out == (r.fold == fold) and 0 <= r.score <= 1 for r in rows)
    rows = queries.op1_sharding(spark, sf).collect()
    assert {r.law for r in rows} == {"rows"} and {r.shard for r in rows} == set(range(24)) and all(r.grown_shard is None for r in rows)


def test_nearest_in_one_tight_cluster(spark):
    """Where codes must tell apart what lies close together, among rows that do not; and rows that share an id."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(3000, 32)), rng.normal(size=32) + 0.001 * rng.normal(size=(3000, 32)), rng.normal(size=32) + 1e-5 * rng.normal(size=(600, 32))])
    x = x[rng.permutation(len(x))]
    frame = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found = {}
    for r in ann.search(frame, F.col("id") % 100 == 0, 5, shortlist=64).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q, got in found.items():
        score = unit @ unit[q]
        score[q] = -2
        hits += len(set(np.argsort(-score)[:5]) & set(got))
    assert len(found) == 66 and hits / (5 * len(found)) >= 0.9
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.search(twice, F.col("id") == 1, 5).collect()]
    # the least vector of the id is the query, and the other one is a candidate
    assert sorted(got) == [(1, 1, 2, 0.8), (1, 2, 1, 0.6)]
