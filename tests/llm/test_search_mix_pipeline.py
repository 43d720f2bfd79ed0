"""Exact top-k, target mixing and the pipeline against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kestrel.llm import common
from kestrel.llm import mixing as M
from kestrel.llm import topk as K

SF = "/root/testdata/sf0.001"


def brute_top(queries, rows, k):
    out = []
    for qi, q in queries:
        scored = sorted(((-sum(int(a) * int(b) for a, b in zip(q, v)), i) for i, v in rows if i != qi))[:k]
        out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("n,width,k", [(1, 3, 5), (5, 2, 5), (6, 2, 5), (300, 8, 5), (300, 8, 3), (200, 1, 5), (2000, 16, 4)])
def test_shard_matches_brute_force(n, width, k):
    rng = np.random.default_rng(n + width)
    x = rng.integers(-6, 7, (n, width)).astype(float)
    ids = rng.permutation(n).astype(np.int64)
    q = np.concatenate([x[: min(n, 7)], np.zeros((1, width))])
    q_ids = np.concatenate([ids[: min(n, 7)], [10**6]])
    got = K.nra_shard(q, q_ids, x, ids, k)
    best = {}
    for qi, i, s in got:
        best.setdefault(qi, []).append((-s, i))
    have = sorted((qi, r + 1, i, -s) for qi, v in best.items() for r, (s, i) in enumerate(sorted(v)[:k]))
    assert have == brute_top(list(zip(q_ids.tolist(), q)), list(zip(ids.tolist(), x)), k)


def test_shard_is_exact_beyond_doubles():
    x = np.array([[2.0**40, 1.0], [2.0**40, 2.0], [2.0**40 + 1, 0.0]])
    got = K.nra_shard(np.array([[2.0**20 + 1, 1.0]]), np.array([9]), x, np.array([0, 1, 2]), 3)
    assert sorted((-s, i) for _, i, s in got) == sorted(
        (-(int(a) * (2**20 + 1) + int(b)), i) for i, (a, b) in enumerate(x.tolist()))


@pytest.mark.parametrize("n", [2000, 8000])
def test_bounds_end_the_reading_early_on_skewed_vectors(n):
    """One shard: the depth read and the rows scored exactly stay well below all, at either size."""
    rng = np.random.default_rng(5)
    width, k = 16, 5
    x = np.floor(rng.standard_t(1.5, (n, width)) * 64)
    ids, report = np.arange(n), []
    q = x[:40]
    got = K.nra_shard(q, ids[:40], x, ids, k, report)
    want = brute_top(list(zip(range(40), q)), list(enumerate(x)), k)
    best = {}
    for qi, i, s in got:
        best.setdefault(qi, []).append((-s, i))
    assert sorted((qi, r + 1, i, -s) for qi, v in best.items() for r, (s, i) in enumerate(sorted(v))) == want
    depth, scored = np.array(report).T
    assert len(report) == 40 and (depth + scored < n / 4).all()
    assert (depth + scored).mean() < n / 10 and scored.mean() < n / 100


def test_vectors_without_components():
    assert K.nra_shard(np.zeros((2, 0)), np.array([0, 1]), np.zeros((3, 0)), np.arange(3), 5) == [
        (0, 1, 0), (0, 2, 0), (1, 0, 0), (1, 2, 0)]


@pytest.mark.parametrize("kind", ["ties", "clusters", "zeros", "huge", "tiny weights"])
def test_shard_on_odd_vectors(kind):
    rng = np.random.default_rng(8)
    x = {"ties": rng.integers(0, 2, (500, 6)), "clusters": np.repeat(rng.integers(-99, 99, (25, 6)), 20, axis=0),
         "zeros": np.zeros((500, 6)), "huge": rng.integers(-9, 9, (500, 6)) * 2.0 ** 26 + rng.integers(-3, 4, (500, 6)),
         "tiny weights": rng.integers(-99, 99, (500, 6)) * np.array([1000, 1, 1, 0, 1, 1])}[kind].astype(float)
    ids = rng.permutation(500)
    got = K.nra_shard(x[:9], ids[:9], x, ids, 5)
    best = {}
    for qi, i, s in got:
        best.setdefault(qi, []).append((-s, i))
    assert sorted((int(qi), r + 1, i, -s) for qi, v in best.items() for r, (s, i) in enumerate(sorted(v))) \
        == brute_top(list(zip(ids[:9].tolist(), x[:9])), list(zip(ids.tolist(), x)), 5)


def test_scores_beyond_long_are_its_ends():
    x = np.full((2, 2), 9.2e18)
    assert K.nra_shard(x[:1], np.array([7]), np.array([[9.2e18, 9.2e18], [-9.2e18, 0]]), np.array([0, 1]), 2) == [
        (7, 0, 2 ** 63 - 1), (7, 1, -2 ** 63)]


def test_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD_ROWS", 30)
    monkeypatch.setattr(K, "QUERY_ROWS", 6)
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.integers(-20, 21, 6).astype(float).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = K.top_k(df, df.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), 4).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows[::10], rows, 4)


def test_vectors_that_take_no_part(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5], 1), (50, [1.0, -1.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [nan, 1.0], 1), (4, [inf, 0.0], 1),
            (5, [0.25], 1), (6, [], 1), (7, [0.25, 0.25], 1), (7, [0.25, 0.25], 1), (None, [9.0, 9.0], 1), (8, [0.001, -0.001], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = K.op3_top_k(spark, str(tmp_path)).collect()
    # 256 x: 0 (128, 128), 50 (256, -256), 5 (64), 6 (), 7 (64, 64) twice, 8 (0, -1)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [
        (0, 1, 7, 16384), (0, 2, 7, 16384), (0, 3, 5, 8192), (0, 4, 6, 0), (0, 5, 50, 0),
        (50, 1, 5, 16384), (50, 2, 8, 256), (50, 3, 0, 0), (50, 4, 6, 0), (50, 5, 7, 0)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert K.top_k(K.quantised(empty), K.quantised(empty).withColumnRenamed("vec_id", "query_id")).collect() == []


# --- mixing -------------------------------------------------------------------------

def brute_rates(p, t, target, rounds):
    """The same projected-gradient least squares with one rate per document held in memory."""
    w = np.array([target[d] for d in M.DOMAINS])
    w = w / w.sum()
    natural = t @ p
    total = natural.sum()
    goal = w * (M.HEADROOM * natural[0] / w[0])
    scale = total / np.maximum(natural, 1e-9 * total)
    moment = (p * t[:, None]).T @ p / total
    step = 1 / np.linalg.eigvalsh(np.sqrt(scale)[:, None] * moment * np.sqrt(scale)[None, :]).max()
    r = np.ones(len(t))
    objective = []
    for _ in range(rounds):
        residual = ((r * t) @ p - goal) / total
        objective.append(float((scale * residual ** 2).sum()))
        r = np.maximum(0, r - step * (p @ (scale * residual)))
    return r, goal, objective


def test_rates_match_brute_force_and_meet_the_targets(spark):
    rng = np.random.default_rng(2)
    p, t = rng.dirichlet([0.15, 0.1, 0.1], 400), rng.integers(1, 500, 400)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "n_tokens long, p array<double>")
    target = {"good": 0.8, "plain": 0.15, "toxic": 0.05}
    got = M.fit_rates(df, target)
    want, goal, objective = brute_rates(p, t.astype(float), target, len(got.steps))
    assert np.allclose(M.rates(p, got.steps), want) and (want >= 0).all()
    assert all(b <= a + 1e-12 for a, b in zip(objective, objective[1:]))
    assert np.allclose(got.target, goal) and np.abs(got.reached - goal).max() <= 0.02 * goal.sum()
    assert np.allclose(got.reached, (want * t) @ p)


@pytest.mark.parametrize("sharpness", [1, 3, 8])
def test_every_domain_meets_its_own_production_target(spark, sharpness):
    """Soft to nearly hard posteriors; toxic's target is small beside the others."""
    rng = np.random.default_rng(7)
    z = np.eye(3)[rng.choice(3, 20_000, p=[0.6, 0.29, 0.11])] * sharpness + rng.normal(0, 1, (20_000, 3))
    p, t = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True), rng.integers(1, 3000, 20_000)
    df = spark.createDataFrame(list(zip(t.tolist(), p.tolist())), "n_tokens long, p array<double>")
    got = M.fit_rates(df)
    rates = M.rates(p, got.steps)
    assert (rates >= 0).all() and np.allclose((rates * t) @ p, got.reached)
    assert np.abs(got.reached / got.target - 1).max() <= 0.01 and got.met


def test_targets_out_of_reach_are_reported(spark):
    df = spark.createDataFrame([(10, [0.5, 0.3, 0.2])] * 50, "n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="toxic"):
        got = M.fit_rates(df)
    assert not got.met and np.allclose(got.reached, 500 * M.rates(np.array([[0.5, 0.3, 0.2]]), got.steps) * [0.5, 0.3, 0.2])


def test_mixing_learns_the_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rated, fit, _ = M.mix(docs, labels)
    rows = {r.doc_id: r for r in rated.collect()}
    assert len(rows) == docs.count()
    truth = {r.doc_id: 2 if r.toxic else 0 if r.quality else 1 for r in labels.collect() if r.doc_id in rows}
    right = [int(np.argmax(rows[i].p)) == d for i, d in truth.items()]
    assert np.mean(right) > 0.9
    mean = [np.mean([rows[i].rate for i, d in truth.items() if d == k]) for k in range(3)]
    assert mean[0] > 0.95 and mean[2] < 0.3
    kept = {r.doc_id for r in M.select_mixed(docs, labels).collect()}
    assert kept == {i for i, r in rows.items() if r.rate >= 1 or i in kept} and len(kept) < len(rows)


def test_mixing_cases(spark, make_docs):
    docs = make_docs(["fine words here", "idiot idiot", None, "", (None, "fine"), "x " * 5000, (1, "fine words here")])
    schema = "doc_id long, quality int, toxic int, text string"
    labels = spark.createDataFrame([(1, 1, 0, "clash"), (1, 0, 0, "clash"), (2, 0, 1, None), (3, None, 0, None), (None, 1, 1, None),
                                    (99, 1, 0, None)], schema)
    rated, _, _ = M.mix(docs, labels)
    assert rated.count() == 7 and rated.filter("rate IS NULL OR rate < 0").count() == 0
    none, fit, _ = M.mix(docs, spark.createDataFrame([], schema))
    assert none.filter(F.col("p")[0] < 0.99).count() == 0
    assert M.select_mixed(docs, spark.createDataFrame([], schema)).columns == docs.columns
    assert M.mix(make_docs([]), labels)[0].collect() == []
    assert M.select_mixed(make_docs([]), labels).collect() == []


# --- pipeline -----------------------------------------------------------------------

def test_pipeline_stages(spark):
    """Every stage against its own operator's definition on its own input."""
    from kestrel.llm import common, language_id, sentencepiece_codec, simhash
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        outs[name] = (docs, docs := common.store(stage(spark, docs, SF), f"test-{name}"))
        if name != "sentencepiece":
            assert docs.columns == columns and docs.count() > 0
    before, after = outs["language_id"]
    model = language_id.identify(before).collect()
    assert {r.doc_id for r in after.collect()} == {
        r.doc_id for r in model if r.language.lang_pred != "und" and r.language.score >= language_id.MIN_SCORE}
    before, after = outs["line_dedup"]
    from test_dedup_ops import brute_components, brute_fingerprint, brute_lines
    want = brute_lines([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == {i: (t, len(t)) for i, (_, _, t) in want.items()}
    before, after = outs["simhash_near_dedup"]
    rows = before.collect()
    low = brute_components([r.doc_id for r in rows], [brute_fingerprint(r.text) for r in rows])
    assert {r.doc_id for r in after.collect()} == set(low.values())
    before, after = outs["target_mix"]
    assert {r.doc_id for r in after.collect()} < {r.doc_id for r in before.collect()}
    before, after = outs["sentencepiece"]
    vocabulary = sentencepiece_codec.production_vocabulary()
    texts = {r.doc_id: r.text for r in before.collect()}
    got = after.collect()
    assert len(got) == len(texts) and all(vocabulary.decode(r.ids) == texts[r.doc_id] for r in got)
    assert simhash.MAX_BITS == 3


def test_pipeline_on_odd_rows_and_empty(spark, write_docs, make_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(i, f"the of and {i} is not a the line\nwas in that " + f"w{i} q{i * 7} " * 30, "en" if i % 3 else None) for i in range(1, 40)]
    rows += [(50, None, None), (51, "", "en"), (52, "123", "en"), (None, "the of and is with no id", "en"), (1, rows[0][1], "en")]
    folder = write_docs(rows, labels=labels)
    got = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert got >= set(range(1, 40)) - {50, 51, 52} and not got & {50, 51, 52}


def test_pipeline_on_an_empty_table(spark, write_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, write_docs([], labels=labels)).collect() == []


def test_bounded_rates_meet_the_targets(spark):
    """The rates of a draw are at most 1; their totals are those of the same descent in memory."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.8, 0.1, 0.05], 4000)
    t = rng.integers(1, 200, 4000)
    df = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p)], "n_tokens long, p array<double>")
    target = {"good": 0.9, "plain": 0.08, "toxic": 0.02}
    got = M.fit_rates(df, target, upper=1.0, headroom=0.9)
    r = np.ones(len(p))
    for s in got.steps:
        r = np.clip(r - p @ np.array(s), 0, 1)
    assert np.allclose(M.rates(p, got.steps, 1.0), r) and r.max() <= 1 and r.min() >= 0
    assert got.met and np.allclose(got.reached, (r * t) @ p)
    assert (np.abs((r * t) @ p / got.target - 1) <= M.TOLERANCE).all()


def test_drawn_totals_meet_the_targets(spark):
    docs = common.documents(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    kept = M.select_mixed(docs.withColumn("__mix", F.lit(1)), labels)
    assert kept.columns == [*docs.columns, "__mix"]
    model = M.fit(docs, labels)
    f = M.posterior_of(spark, model)(F.col("text"))
    totals = lambda df: np.array(df.select(f.alias("f")).agg(*(F.sum(F.col("f.n_tokens") * F.col("f.p")[i]) for i in range(3))).first())
    drawn, natural = totals(kept), totals(docs)
    share = np.array([M.TARGET[d] for d in M.DOMAINS])
    assert abs(drawn[0] / natural[0] - M.DRAWN) < 0.01
    assert (np.abs(drawn / drawn.sum() / share - 1) < [0.01, 0.05, 0.1]).all()      # a draw: plain and toxic are few
