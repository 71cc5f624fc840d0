"""Learned models: contracts and properties on planted data."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisade import constants as C
from palisade.functions import grams
from palisade.functions.grams import gram_counts, ngrams
from palisade.operators import explain, forest, ocsvm, scaling, synth, tfidf
from palisade.plans import pipeline

NAMES = C.FLOW_FEATURES


@pytest.fixture(scope="module")
def flows(spark):
    normal = spark.range(4000).select(
        F.col("id").alias("seq"), (F.lit(80) + F.col("id") % 3).alias("dst_pt"),
        (F.lit(1000) + F.xxhash64("id") % 300).alias("b_in"),
        (F.lit(500) + F.xxhash64("id", F.lit(1)) % 200).alias("b_out"))
    planted = spark.createDataFrame(
        [(4000 + i, 4444, 15000000, 0) for i in range(5)],
        "seq bigint, dst_pt bigint, b_in bigint, b_out bigint")
    return normal.unionByName(planted).cache()


@pytest.fixture(scope="module")
def flow_models(spark, flows, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("flow"))
    pipeline.train_flow(flows, root)
    return pipeline.load_models(spark, root)


@pytest.fixture(scope="module")
def text_layers(spark):
    own = spark.createDataFrame([("x",)], "payload string").limit(0)
    logins = spark.range(600).select(F.concat(
        F.lit("User logon success for account U"), F.col("id") % 40,
        F.lit(" on host C"), F.col("id") % 25).alias("payload"))
    return {"WEB_APP": synth.augmented(own, "WEB_APP"),
            "AUTH_LINUX": synth.augmented(own, "AUTH_LINUX"),
            "AUTH_WINDOWS": synth.augmented(logins, "AUTH_WINDOWS"),
            "HOST_LIN": synth.augmented(own, "HOST_LIN"),
            "HOST_WIN": synth.augmented(own, "HOST_WIN")}


@pytest.fixture(scope="module")
def text_models(spark, text_layers, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("text"))
    pipeline.train_text(text_layers, root)
    return pipeline.load_models(spark, root).text


def test_forest_flags_the_contamination_share_and_the_planted_rows(flows, flow_models):
    scored = pipeline.score_flows(flows, flow_models.flow)
    flagged = scored.where("prediction = -1")
    assert flagged.count() == int(C.FOREST_CONTAMINATION * 4004) + 1
    assert flagged.where("seq >= 4000").count() == 5
    top = [r["seq"] for r in scored.orderBy(F.desc("score")).limit(5).collect()]
    assert set(top) == {4000, 4001, 4002, 4003, 4004}


def test_forest_is_the_same_for_any_partitioning(flows):
    one = forest.fit(flows, NAMES, trees=5).orderBy("tree", "node").toPandas()
    two = forest.fit(flows.repartition(9), NAMES, trees=5).orderBy("tree", "node").toPandas()
    pd.testing.assert_frame_equal(one, two)


def test_trees_see_the_subsample_and_respect_the_depth_limit(flows):
    nodes = forest.fit(flows, NAMES, trees=10).toPandas()
    assert (nodes[nodes["node"] == 0]["size"] == 256).all()
    assert nodes["depth"].max() <= 8
    assert len(nodes) <= 10 * 511


def test_path_length_equals_a_walk_down_each_tree(flows):
    nodes = forest.fit(flows, NAMES, trees=4).toPandas()
    model = forest.Forest(nodes)
    x = np.array([[80.0, 1100.0, 520.0], [4444.0, 15e6, 0.0]])

    def walk(row):
        total = 0.0
        for _, tree in nodes.groupby("tree"):
            tree = tree.set_index("node")
            at = tree.loc[0]
            while at["feature"] >= 0:
                side = "left" if row[int(at["feature"])] <= at["threshold"] else "right"
                at = tree.loc[int(at[side])]
            total += at["depth"] + float(forest.average_path(at["size"]))
        return total / 4

    assert model.path_length(x) == pytest.approx([walk(r) for r in x])


def test_shapley_values_add_up_and_blame_the_planted_features(flows, flow_models):
    model = flow_models.flow.trees
    x = np.array([[0.0, 0.1, -0.2], [5000.0, 90000.0, -5.0], [1.0, 0.0, 0.0]])
    phi, expected = explain.shapley(model, x)
    assert phi.sum(axis=1) + expected == pytest.approx(model.path_length(x))
    assert phi[1].min() < C.SHAP_CUT

    shown = explain.with_shapley(
        pipeline.score_flows(flows.where("seq = 4000"), flow_models.flow), model, pipeline.SCALED)
    evidence = shown.select(explain.flow_evidence(F.col("shap"), NAMES).alias("e")).first()["e"]
    assert evidence and all(" (SHAP: -" in e for e in evidence)


def test_unscaled_scoring_differs(flows, flow_models):
    raw = pipeline.score_flows(flows, flow_models.flow, scaled=False)
    assert raw.where("prediction = -1").count() != pipeline.score_flows(
        flows, flow_models.flow).where("prediction = -1").count()


def test_zero_range_scales_by_one(spark):
    df = spark.range(50).select(F.lit(7).alias("dst_pt"), F.col("id").alias("b_in"),
                                F.col("id").alias("b_out"))
    by = scaling.scale_map(scaling.robust_stats(df))
    assert by["dst_pt"] == (7.0, 1.0)


@pytest.mark.parametrize("analyzer,sizes", [("char", (3, 6)), ("word", (1, 3))])
def test_packed_counts_equal_plain_counts(analyzer, sizes):
    texts = ["a  b\t\tc \U0001F600x", "", "ab", "Größe und Maß und Größe", "x\u3000\u3000y",
             "".join(chr(0x4E00 + i * 7) for i in range(1500))]
    weights = [1, 2, 3, 4, 5, 2]
    tf, df = Counter(), Counter()
    for text, weight in zip(texts, weights):
        for term, n in Counter(ngrams(text, analyzer, *sizes)).items():
            tf[term] += n * weight
            df[term] += weight
    got_tf, got_df = Counter(), Counter()
    for terms, t, d in gram_counts(texts, weights, analyzer, *sizes):
        for term, a, b in zip(terms, t.tolist(), d.tolist()):
            got_tf[term] += a
            got_df[term] += b
    assert (got_tf, got_df) == (tf, df)


def test_weighted_terms_equal_repeated_documents(spark):
    once = spark.createDataFrame([("abc abc", 3), ("abd", 1)], "payload string, weight bigint")
    often = spark.createDataFrame([("abc abc",)] * 3 + [("abd",)], "payload string")
    left = tfidf.term_stats(once, "char", 3, 4)
    right = tfidf.term_stats(often, "char", 3, 4)
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_training_outliers_stay_below_nu(spark, text_layers, text_models):
    lines = ocsvm.corpus(text_layers)
    frames = lines.select(F.col("tag").alias("model_tag"), "payload", "weight")
    shares = ocsvm.predicted(ocsvm.decided(frames, text_models)).groupBy("model_tag").agg(
        (F.sum(F.when(F.col("prediction") == -1, F.col("weight")).otherwise(0))
         / F.sum("weight")).alias("share")).collect()
    assert len(shares) == 5
    for row in shares:
        assert row["share"] <= C.TEXT_PROFILES[row["model_tag"]][3] + 0.005


def test_attacks_fall_below_the_margin_and_benign_lines_do_not(text_models):
    attacks = {act: payload for _, _, act, payload in C.INJECTED_ATTACKS}
    cases = [("WEB_APP", attacks["WEB_APP"], True),
             ("AUTH_LINUX", attacks["AUTH_LINUX"], True),
             ("AUTH_WINDOWS", attacks["AUTH_WINDOWS"], True),
             ("HOST_LIN", attacks["HOST_LINUX"], True),
             ("HOST_WIN", attacks["HOST_WINDOWS"], True),
             ("WEB_APP", "GET /index.html HTTP/1.1 200", False),
             ("HOST_LIN", "pam_unix(sudo:session): session opened for user root by "
                          "analyst(uid=1000)", False),
             ("HOST_WIN", "A new process has been created. Creator Process ID: 0x4a8. "
                          "Process Name: C:\\Windows\\System32\\svchost.exe", False)]
    for tag, text, attack in cases:
        decision = text_models[tag].decision([text])[0]
        assert (decision < -ocsvm.TIE) == attack, (tag, text, decision)


def test_stored_models_decide_like_fresh_ones(spark, text_models):
    assert all(len(m.landmarks) <= ocsvm.LANDMARKS for m in text_models.values())
    tables = ocsvm.to_tables(spark, text_models)
    again = ocsvm.from_tables(tables["vocab"], tables["svm"], tables["svm_settings"])
    texts = ["GET /index.html HTTP/1.1 200", "drop table users"]
    for tag, model in text_models.items():
        assert again[tag].decision(texts) == pytest.approx(model.decision(texts))


def test_word_weights_find_the_planted_word_and_repeat(text_models):
    model = text_models["WEB_APP"]
    line = "GET /index.html <script>alert(1)</script> HTTP/1.1 200"
    found = explain.word_weights(model, line)
    suspicious = [(w, v) for w, v in found if v > 0]  # what becomes evidence
    assert suspicious[0][0] == "<script>alert(1)</script>"
    assert found == explain.word_weights(model, line)
    assert len(found) <= C.LIME_FEATURES
    clean = dict(explain.word_weights(model, "GET /index.html HTTP/1.1 200"))
    assert "<script>alert(1)</script>" not in clean


def test_layers_without_a_model_are_dropped(spark, flow_models):
    frames = spark.createDataFrame(
        [(0, "1.1.1.1", "L3_L4", "BENIGN"), (1, "1.1.1.1", "WEB_APP", "GET /")],
        "seq bigint, src_ip string, act string, payload string").withColumn(
        "ts", F.lit("2026-01-01").cast("timestamp_ntz"))
    verdicts, _ = pipeline.reconstruct(frames, flow_models)
    assert [r["tag"] for r in verdicts.collect()] == ["L3_L4"]


def test_reconstruction_explains_flagged_frames(spark, flow_models, text_models):
    models = pipeline.Models(flow_models.flow, text_models)
    rows = [(i, "5.5.5.5", "HOST_LINUX", "user root command /bin/bash -i", 0, 0, 0)
            for i in range(3)]
    rows += [(3, "5.5.5.5", "L3_L4", "DDoS", 4444, 15000000, 0),
             (4, "6.6.6.6", "WEB_APP", "GET /index.html HTTP/1.1 200", 0, 0, 0)]
    frames = spark.createDataFrame(
        rows, "seq bigint, src_ip string, act string, payload string, dst_pt bigint, "
              "b_in bigint, b_out bigint").withColumn(
        "ts", F.lit("2026-01-01").cast("timestamp_ntz"))
    verdicts, alerts = pipeline.reconstruct(frames, models)
    got = {r["seq"]: r for r in verdicts.collect()}
    assert got[0]["score"] == 0.83 and got[0]["forensics"] != [C.EVIDENCE_DEFAULT]
    assert got[3]["score"] == 0.63 and got[3]["is_anomaly"]  # correlated with the host layer
    assert got[4]["score"] == 0.0 and got[4]["forensics"] == [C.EVIDENCE_DEFAULT]
    assert {r["seq"] for r in alerts.collect()} == {0, 1, 2, 3}


def test_margin_comes_with_a_certificate(spark):
    """The stored gap bounds the distance to the best vector, and too few rounds are an error."""
    lines = [(f"user{k % 7} opened port {k % 11} on host{k % 5}",) for k in range(400)]
    layers = {"HOST_LIN": spark.createDataFrame(lines, "payload string")}
    rows = ocsvm.corpus(layers)
    loose = ocsvm.fit(rows, ["HOST_LIN"], tolerance=0.2)["HOST_LIN"]
    tight = ocsvm.fit(rows, ["HOST_LIN"], tolerance=0.002)["HOST_LIN"]

    def squared(model):
        kernel = model.kernel(model.landmarks).astype(float)
        return model.weight @ kernel @ model.weight

    assert tight.gap <= 0.002 and loose.gap <= 0.2
    # Half the squared length lies above the least one by the gap at most.
    assert squared(tight) * (1 - 2 * tight.gap) <= squared(loose) * (1 + 1e-4)
    assert squared(loose) * (1 - 2 * loose.gap) <= squared(tight) * (1 + 1e-4)
    tables = ocsvm.to_tables(spark, {"HOST_LIN": tight})
    assert ocsvm.from_tables(*tables.values())["HOST_LIN"].gap == tight.gap
    with pytest.raises(RuntimeError, match="HOST_LIN"):
        ocsvm.fit(rows, ["HOST_LIN"], rounds=1, tolerance=1e-9)


def test_a_task_adds_up_the_counts_of_its_batches():
    """A term comes once whatever the number of batches, also when symbols differ."""
    texts = [f"GET /page{k % 7}?q={chr(200 + k)} the end of it" for k in range(60)] + ["a\x00b c\x00"]
    for analyzer, low, high in (("char", 3, 6), ("word", 1, 3)):
        parts = list(grams.batch_counts(
            [([t], [1 + k % 2]) for k, t in enumerate(texts)], analyzer, low, high))
        terms = [t for part in parts for t in part[0]]
        assert len(terms) == len(set(terms))
        tf, df = Counter(), Counter()
        for k, text in enumerate(texts):
            for term, often in Counter(ngrams(text, analyzer, low, high)).items():
                tf[term] += often * (1 + k % 2)
                df[term] += 1 + k % 2
        assert dict(zip(terms, np.concatenate([p[1] for p in parts]).tolist())) == dict(tf)
        assert dict(zip(terms, np.concatenate([p[2] for p in parts]).tolist())) == dict(df)


@pytest.mark.parametrize("size", [5, 40, 200, 100000])
def test_vocabulary_of_runs_loses_no_frequent_term(spark, size):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame(
        [(" ".join(rng.choice(words, 30, p=np.arange(40, 0, -1) / 820)) + (" one two three" * 9),)
         for _ in range(60)], "payload string")
    got = [tuple(r) for r in tfidf.vocabulary(docs, "word", 1, 3, size).collect()]
    plain = tfidf.term_stats(docs, "word", 1, 3).orderBy(F.desc("tf"), "term").limit(size)
    assert got == [tuple(r) for r in plain.collect()]


def test_longer_runs_are_counted_between_frequent_ones_only(spark):
    docs = spark.createDataFrame([("aa bb cc",), ("aa bb dd",)], "payload string")
    got = tfidf.term_stats(docs, "word", 2, 2, {"aa", "bb"}).collect()
    assert [tuple(r) for r in got] == [("aa bb", 2, 2)]


class CountedModel:
    """A stand-in whose calls leave a line each in a file."""

    def __init__(self, path):
        self.path = path

    def decision(self, texts):
        with open(self.path, "a") as out:
            out.write("call\n")
        return np.array([len(t) / 100 - 0.5 for t in texts])


def test_a_payload_is_explained_once_whatever_the_batches(spark, tmp_path):
    payloads = ["GET /a b c", "POST /login user", "GET /index d"]
    frames = spark.range(600).select("id", F.lit("WEB_APP").alias("model_tag"), F.get(
        F.array(*[F.lit(p) for p in payloads]), (F.col("id") % 3).cast("int")).alias("payload"))
    models = {"WEB_APP": CountedModel(str(tmp_path / "calls"))}
    shown = explain.with_word_weights(frames.repartition(12), models, 50, 2)
    assert shown.columns == ["id", "model_tag", "payload", "words"]
    rows = shown.collect()
    assert (tmp_path / "calls").read_text().count("call") == len(payloads)
    assert sorted(r["id"] for r in rows) == list(range(600))
    want = {p: explain.word_weights(models["WEB_APP"], p, 50, 2) for p in payloads}
    assert all([tuple(w) for w in r["words"]] == want[r["payload"]] for r in rows)


def test_memory_of_a_batch_does_not_grow_with_its_rows():
    """Features exist for a few hundred rows at a time, in scoring and in training."""
    import tracemalloc

    kept = [f"GET /page{k}.html HTTP/1.1 200" for k in range(512)]
    terms = sorted({g for line in kept for g in ngrams(line, "char", 3, 4)})
    model = ocsvm.TextModel("WEB_APP", terms, np.ones(len(terms)), 0.5, kept, np.ones(512) / 512)
    model.decision(["warm"])
    lines = [f"GET /item{k}.html?q={k * 7919} HTTP/1.1 200" for k in range(6000)]
    batch = pd.DataFrame({"tag": "WEB_APP", "payload": lines})
    assert [len(g) for _, g in ocsvm._groups(iter([batch[:600]]))] == [512, 88]
    tracemalloc.start()
    try:
        found = model.decision(lines)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 6000 * len(kept) * 8  # less than one matrix of all rows
    few = [model.decision([t])[0] for t in lines[:3] + lines[-3:]]
    assert np.allclose(found[[0, 1, 2, -3, -2, -1]], few, atol=1e-6)
