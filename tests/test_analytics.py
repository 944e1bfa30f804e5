"""Telemetry, monitors, reports, probes and intervals on small known inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import math as MX
from weftline.operators import generators as G
from weftline.operators import monitors as M
from weftline.operators import results as R
from weftline.operators import stats as S
from weftline.operators import telemetry as T
from weftline.sources import results as J


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_perplexity_is_capped(spark):
    assert one(spark, MX.perplexity(F.lit(25.0))) == math.exp(20)
    assert abs(one(spark, MX.perplexity(F.lit(2.0))) - math.exp(2)) < 1e-12


@pytest.mark.parametrize("step, factor", [(0, 0), (250, 0.5), (500, 1), (5018, 0.5), (9536, 0), (20000, 0)])
def test_rate_factor(spark, step, factor):
    assert abs(one(spark, MX.rate_factor(F.lit(step), 500, 9536)) - factor) < 1e-9


def test_half_life(spark):
    assert abs(one(spark, MX.half_life(F.lit(-0.00693147))) - 100.0) < 1e-3
    assert one(spark, MX.half_life(F.lit(0.0))) == math.inf


def test_run_sizes():
    batch = MX.tokens_per_step(4, 2048, 64)
    assert batch == 524_288 and MX.tokens_per_step(12, 2048, 22) == 540_672
    assert MX.planned_steps(5_000_000_000, batch) == 9536
    assert MX.steps_until_budget(5_000_000_000, batch) == 9537


def test_steps_are_complete_groups(spark):
    rows = [("r", i, i * 1_000_000, float(i)) for i in range(7)] + [("s", 50, 5, 1.0)]
    losses = spark.createDataFrame(rows, "run string, seq long, at long, loss double")
    got = T.step_metrics(losses, 3, 10, 1, 4).orderBy("step").collect()
    assert [(r.run, r.step, r.loss, r.tokens, r.tokens_per_second) for r in got] == [("r", 1, 1.0, 30, 15.0), ("r", 2, 4.0, 60, 12.0)]


def test_throughput_starts_anew_after_a_restart(spark):
    rows = [("r", 0, 0, 0, 10), ("r", 0, 1, 2_000_000, 10), ("r", 1, 2, 9_000_000, 10), ("r", 1, 3, 10_000_000, 10)]
    frame = spark.createDataFrame(rows, "run string, restart int, seq long, at long, tokens long")
    got = [(r.tokens_since_start, r.tokens_per_second) for r in T.throughput(frame).orderBy("seq").collect()]
    assert got == [(10, 1e7), (20, 10.0), (10, 1e7), (20, 20.0)]


def test_stop_points_and_validation(spark):
    rows = [("r", i, 10, 2.0) for i in range(5)]
    frame = spark.createDataFrame(rows, "run string, seq long, tokens long, loss double")
    assert tuple(T.stop_points(frame, 25).first()) == ("r", 2, 30, 50)
    assert tuple(T.stop_points(frame, 99).first()) == ("r", None, None, 50)
    assert T.validation_loss(frame, 3).first().n_batches == 3
    assert T.validation_loss(frame, 0).first().val_loss == 0.0
    assert math.isnan(T.validation_loss(frame, 3, has_data=False).first().val_loss)


def test_micros_ignore_the_session_zone(spark):
    kept = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        stamp = F.lit("2024-03-10 02:30:00.25").cast("timestamp_ntz")
        assert one(spark, T.micros(stamp)) == 1_710_037_800_250_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)


def test_constant_layers_are_flagged(spark):
    frame = spark.createDataFrame([(0, [-1.0] * 12), (1, [0.0, 1.0])], "layer int, values array<double>")
    rows = {r.layer: r for r in M.layer_scale_summary(frame).collect()}
    assert rows[0].is_constant and rows[0]["std"] == 0.0 and abs(rows[0]["mean"] - 0.31326168775) < 1e-9
    want = np.log1p(np.exp([0.0, 1.0]))
    assert not rows[1].is_constant and abs(rows[1]["std"] - want.std()) < 1e-12


def test_entropy_and_softmax(spark):
    frame = spark.createDataFrame([(0, [0.5, 0.5]), (0, [1.0, 0.0])], "layer int, probs array<double>")
    assert abs(M.attention_entropy(frame).first().entropy - math.log(2) / 2) < 1e-12
    got = spark.createDataFrame([([1000.0, 1000.0],)], "v array<double>").select(M.softmax(F.col("v"))).first()[0]
    assert got == [0.5, 0.5]


def test_monitor_keys_and_ranges(spark):
    rows = [(0, 1.0, 2.5, -0.01), (0, 30.0, 1.0, -0.01), (1, 0.0, 0.0, 0.0)]
    monitors = M.layer_monitors(spark.createDataFrame(rows, "layer int, g double, c double, log_decay double"))
    status = {r.layer: (r.max_gap, r.gap_status, r.half_life_status) for r in M.range_status(monitors).collect()}
    assert status == {0: (29.0, "WARNING", "OK"), 1: (0.0, "OK", "WARNING")}
    metrics = spark.createDataFrame([("lambda/L3_H2", 0.5), ("monitor/half_life_L3", 7.0), ("train/loss", 1.0)], "metric string, value double")
    assert {tuple(r) for r in M.parse_monitor_keys(metrics).collect()} == {("lambda", 3, 2, 0.5), ("monitor/half_life", 3, None, 7.0)}


def test_finiteness(spark):
    frame = spark.createDataFrame([(float("nan"),), (float("inf"),), (0.0,), (2.0,)], "value double")
    row = M.finite_check(frame).first()
    assert (row.n, row.n_nan, row.n_inf, row.n_not_positive, row.all_finite) == (4, 1, 1, 1, False)
    counts = spark.createDataFrame([(151_878_144, 151_878_432), (100, 102)], "a long, b long")
    assert [r.parameter_status for r in M.parameter_status(counts, "a", "b").orderBy("gap").collect()] == ["OK", "WARNING"]


def test_parity(spark):
    bits = spark.createDataFrame([(0, i, b) for i, b in enumerate([1, 0, 1, 1])], "sample_id long, pos int, bit int")
    made = G.fresh_parity_samples(spark, 50, 16, 3)
    rows = made.orderBy("sample_id", "pos").collect()
    assert len(rows) == 800 and 300 < sum(r.bit for r in rows) < 500
    running = 0
    for r in rows:
        running = r.bit if r.pos == 0 else running ^ r.bit
        assert r.parity == running
    perfect = made.select("sample_id", "pos", F.col("parity").alias("predicted"))
    assert tuple(G.parity_accuracy(made, perfect, 16).first()) == (1.0, 1.0)
    assert tuple(G.parity_accuracy(made, perfect.where("pos < 15"), 16).first()) == (0.9375, 0.0)
    only = spark.createDataFrame([("a", 0, 5, 9.0), ("a", 0, 1, 1.0), ("a", 0, 0, 1.0)], "request_id string, pos int, token int, logprob double")
    assert G.binary_predictions(only).first().predicted == 0
    assert bits.count() == 4


def test_needle_geometry(spark):
    cases = spark.range(40).withColumnRenamed("id", "case_id")
    coded = G.code_word_cases(G.constant_filler(cases, G.CODE_FILLER, 50), [512], 42).collect()
    answers = dict(G.CODE_WORDS)
    for r in coded:
        phrase = next(k for k, v in answers.items() if v == r.answer)
        needle, question = phrase.split() + [r.answer, "."], phrase.split()
        assert len(r.prompt) == 512 - 10
        assert 5 <= r.pos <= (512 - len(needle) - len(question) - 10) // 2
        assert r.prompt[r.pos : r.pos + len(needle)] == needle and r.prompt[-len(question) :] == question
        assert r.prompt[r.pos + len(needle)] == "The"  # the filler starts over
    assert len({r.answer for r in coded}) == 5
    keyed = G.passkey_cases(G.constant_filler(cases, G.PASSKEY_FILLER, 20), [100, 4096], 42).collect()
    assert len(keyed) == 80
    for r in keyed:
        filler = r.context_len - 9 - 4 - 5
        assert filler // 4 <= r.pos <= 3 * filler // 4
        assert len(r.prompt) == r.context_len - 5 and 10_000 <= int(r.answer) <= 99_999
        assert r.prompt[r.pos : r.pos + 5] == ["The", "special", "passkey", "is", r.answer]
    assert G.code_word_cases(G.constant_filler(cases, G.CODE_FILLER, 50), [25], 42).count() == 0
    cases = G.code_word_cases(G.constant_filler(cases, G.CODE_FILLER, 50), [512], 42)
    assert G.first_word_accuracy(cases, G.recalled_words(cases)).first().accuracy == 1.0


def test_bootstrap_follows_the_binomial(spark):
    counts = spark.createDataFrame([("a", 2000, 1100), ("b", 5, 5), ("c", 4, 0), ("d", 400_000_000, 100_000_000)], "g string, n long, k long")
    rows = {r.g: r for r in S.bootstrap_interval(counts, ["g"], 4000, 1).collect()}
    rng = np.random.default_rng(0)
    want = np.percentile(rng.binomial(2000, 0.55, 200_000) / 2000, [2.5, 97.5])
    assert abs(rows["a"].low - want[0]) < 0.002 and abs(rows["a"].high - want[1]) < 0.002
    assert (rows["b"].low, rows["b"].high, rows["c"].low, rows["c"].high) == (1.0, 1.0, 0.0, 0.0)
    spread = 1.96 * math.sqrt(0.25 * 0.75 / 4e8)
    assert abs(rows["d"].high - 0.25 - spread) < spread / 10
    tiny = spark.createDataFrame([("a", 3, 1)], "g string, n long, k long")
    steps = [r.upto for r in S.binomial_steps(tiny, ["g"]).orderBy("j").collect()]
    np.testing.assert_allclose(steps, np.cumsum([8, 12, 6, 1]) / 27)


def test_overlap(spark):
    rows = [("t", "base", 0.1, 0.3), ("t", "near", 0.3, 0.4), ("t", "far", 0.31, 0.4)]
    frame = spark.createDataFrame(rows, "task string, model string, low double, high double")
    got = {r.model: r.verdict for r in S.overlap_verdict(frame, "model", "base", ["task"]).collect()}
    assert got == {"near": "not significant", "far": "significant"}


def test_leaderboard_operators(spark):
    rows = [(1, "a", 1, "lambada", 0.1), (1, "a", 2, "lambada", 0.2), (1, "b", 2, "lambada", 0.2), (1, "b", 1, "lambada", 0.3), (1, "c", 2, "lambada", 0.1)]
    long = spark.createDataFrame(rows, "phase int, model string, step long, task string, score double")
    wide = R.to_wide(long)
    assert wide.columns == ["phase", "model", "step", *R.TASKS]
    assert R.to_long(wide).count() == 5
    finals = R.final_rows(wide)
    assert {(r.model, r.step, r.lambada) for r in finals.collect()} == {("a", 2, 0.2), ("b", 2, 0.2), ("c", 2, 0.1)}
    assert {(r.model, r.mark) for r in R.task_places(R.to_long(finals)).collect()} == {("a", "best"), ("b", "best"), ("c", "second")}
    limits = spark.createDataFrame([(1, "lambada", 0.2)], "phase int, task string, threshold double")
    assert {(r.model, r.first_step) for r in R.first_step_reaching(long, limits).collect()} == {("a", 2), ("b", 1), ("c", None)}
    sized = spark.createDataFrame([(1, 64, 0.5), (1, 16, 0.5), (1, 32, 0.4)], "phase int, width int, score double")
    assert R.best_config(sized, "width").first().width == 16
    gaps = {(r.model, r.step): r.points for r in R.versus_baseline(long, "a").collect()}
    assert abs(gaps["b", 1] - 20.0) < 1e-9 and abs(gaps["c", 2] + 10.0) < 1e-9


def test_efficiency(spark):
    finals = spark.createDataFrame([("a", 5_000_000_000, 0.139), ("b", 5_000_000_000, 0.174)], "model string, tokens long, lambada double")
    facts = spark.createDataFrame([("a", 27_714.0, 152_000_000), ("b", 16_783.0, 152_000_000)], "model string, tokens_per_second double, parameters long")
    got = {r.model: (round(r.per_1k_tokens_per_second, 2), round(r.tokens_per_parameter)) for r in R.efficiency(finals, facts, "lambada").collect()}
    assert got == {"a": (0.5, 33), "b": (1.04, 33)}
    costs = spark.createDataFrame([(1, "a", 1082.331758592), (1, "b", 1159.64116992)], "phase int, model string, flops double")
    assert abs(R.cost_ratio(costs, "a").where("model = 'b'").first().ratio - 1.0714285714285714) < 1e-9


def test_union_keeps_absent_columns_null(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    assert {tuple(r) for r in R.union_results({"a": a, "b": b}).select("source", "x", "y").collect()} == {("a", 1, 2), ("b", 3, None)}
    assert J.RECORD.startswith("struct<model")


def test_seed_spread_is_the_population_value(spark):
    rows = [("a", [0.825, 0.865, 0.9, 0.87, 0.805]), ("b", [0.99, 0.98, 0.98, 0.98, 0.995])]
    got = {r.model: (r["mean"], r["std"]) for r in R.seed_summary(spark.createDataFrame(rows, "model string, scores array<double>")).collect()}
    np.testing.assert_allclose(got["a"], (0.853, 0.03385262175962151))
    np.testing.assert_allclose(got["b"], (0.985, 0.006324555320336764))
