"""Result tables, files and logs, all made from ``events``.

An event counts as one answer of a model (its type) on a task (its ``k`` modulo 5) at a checkpoint
(from the user id); it is right when its value passes a threshold. Accuracies per checkpoint then
take the place of published result files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import pending as N
from weftline.operators import results as R
from weftline.operators import scoring as X
from weftline.operators import stats as S
from weftline.plans.tables import SEED, table
from weftline.plans.telemetry import _STEPS_SQL, run_steps
from weftline.session import fresh_path
from weftline.sources import checkpoints as CK
from weftline.sources import logs as L
from weftline.sources import results as J

RIGHT_ABOVE = 30
BASELINE = "view"
CONFIGS = (16, 32, 64, 128)
RESAMPLES = 10_000


def answers(spark, sf_dir) -> DataFrame:
    return as_answers(table(spark, sf_dir, "events"))


def as_answers(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    tasks = F.array(*[F.lit(t) for t in R.TASKS])
    configs = F.array(*[F.lit(c) for c in CONFIGS])
    return events.select(
        "user_id",
        (F.col("user_id") % 3 + 1).alias("phase"),
        F.col("event_type").alias("model"),
        ((F.col("user_id") % 10 + 1) * 1000).alias("step"),
        F.get(tasks, (k % 5).cast("int")).alias("task"),
        F.get(configs, F.expr("int(bigint(get_json_object(props, '$.k')) div 5 % 4)")).cast("bigint").alias("width"),
        (F.col("event_id") % 5).alias("seed"),
        k.alias("k"),
        (F.col("value") > RIGHT_ABOVE).alias("correct"),
    )


def scores(spark, sf_dir) -> DataFrame:
    return X.accuracy(answers(spark, sf_dir), [*R.RUN, "task"]).withColumnRenamed("accuracy", "score")


def _round(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def _wide(spark, sf_dir) -> DataFrame:
    return R.to_wide(scores(spark, sf_dir))


def _with_tokens(spark, sf_dir) -> DataFrame:
    """Wide rows with token counts: some off by a batch, some not recorded."""
    totals = answers(spark, sf_dir).groupBy(*R.RUN).agg(F.count(F.lit(1)).alias("n"))
    off = F.when(F.col("n") % 7 == 0, F.col("n") * 8192).otherwise(0)
    tokens = F.when(F.col("n") % 5 != 0, F.col("step") * R.STEP_TOKENS + off)
    return _wide(spark, sf_dir).join(totals.select(*R.RUN, tokens.alias("tokens")), list(R.RUN))


def results_long(spark, sf_dir):
    return scores(spark, sf_dir).select(*R.RUN, "task", "total", "n_correct", *_round("score"))


def results_wide(spark, sf_dir):
    return _wide(spark, sf_dir).select(*R.RUN, *_round(*R.TASKS))


def results_unpivot(spark, sf_dir):
    return R.to_long(_wide(spark, sf_dir)).select(*R.RUN, "task", *_round("score"))


def results_union(spark, sf_dir):
    """Three files with different optional fields under one schema."""
    rows = _with_tokens(spark, sf_dir)
    parts = {
        "p1": rows.where("phase = 1").drop("phase"),
        "p2": rows.where("phase = 2").drop("tokens"),
        "p3": rows.where("phase = 3"),
    }
    whole = R.fill_tokens(R.union_results(parts))
    return whole.select("source", F.coalesce("phase", F.lit(0)).alias("phase"), "model", "step", "tokens", *_round(*R.TASKS))


def final_per_model(spark, sf_dir):
    return R.final_rows(_wide(spark, sf_dir)).select(*R.RUN, *_round(*R.TASKS))


def _rounded_long(spark, sf_dir):
    return scores(spark, sf_dir).withColumn("score", F.round("score", 9)).drop("total", "n_correct")


def _final_long(spark, sf_dir):
    return R.to_long(R.final_rows(R.to_wide(_rounded_long(spark, sf_dir))))


def best_second(spark, sf_dir):
    places = R.task_places(_final_long(spark, sf_dir))
    return places.select("phase", "model", "task", *_round("score"), F.col("place").cast("bigint").alias("place"), "mark")


def delta_vs_baseline(spark, sf_dir):
    rows = R.versus_baseline(scores(spark, sf_dir).drop("total", "n_correct"), BASELINE)
    return rows.select(*R.RUN, "task", *_round("score", "base_score", "points", "relative"))


def convergence_step(spark, sf_dir):
    """First step at which a model passes the baseline's final score."""
    thresholds = _final_long(spark, sf_dir).where(F.col("model") == BASELINE).select("phase", "task", F.col("score").alias("threshold"))
    reached = R.first_step_reaching(_rounded_long(spark, sf_dir), thresholds)
    return reached.select("phase", "task", "model", *_round("threshold"), F.coalesce("first_step", F.lit(-1)).alias("first_step"))


def best_ds(spark, sf_dir):
    by = ["phase", "model", "width"]
    rows = X.accuracy(answers(spark, sf_dir), by).withColumn("score", F.round("accuracy", 9))
    return R.best_config(rows, "width", ["phase", "model"]).select("phase", "model", "width", *_round("score"))


def token_consistency(spark, sf_dir):
    return R.token_mismatches(_with_tokens(spark, sf_dir)).select(*R.RUN, "tokens", "expected", "excess")


def _facts(spark, sf_dir):
    return answers(spark, sf_dir).groupBy("model").agg(
        (F.sum("k") * 1000).alias("parameters"), (F.avg("k") * 300).alias("tokens_per_second")
    )


def efficiency(spark, sf_dir):
    finals = R.fill_tokens(R.final_rows(_with_tokens(spark, sf_dir)))
    rows = R.efficiency(finals, _facts(spark, sf_dir), "lambada").where("lambada IS NOT NULL")
    return rows.select("phase", "model", "step", *_round("per_1k_tokens_per_second", "tokens_per_parameter"))


def cost_ratio(spark, sf_dir):
    costs = answers(spark, sf_dir).groupBy("phase", "model").agg(F.sum("k").alias("flops"))
    return R.cost_ratio(costs, BASELINE).select("phase", "model", "flops", *_round("ratio"))


def seed_summary(spark, sf_dir):
    per_seed = X.accuracy(answers(spark, sf_dir), ["model", "seed"])
    listed = per_seed.groupBy("model").agg(F.collect_list("accuracy").alias("scores"))
    return R.seed_summary(listed).select("model", "n_seeds", *_round("mean", "std"))


def _outcomes(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    sources = table(spark, sf_dir, "documents").select("doc_id", "lang")
    both = labels.join(sources, "doc_id").select(
        "lang", F.inline(F.array(
            F.struct(F.lit("quality").alias("task"), F.col("quality").alias("correct")),
            F.struct(F.lit("toxic").alias("task"), F.col("toxic").alias("correct")),
        ))
    )
    return S.outcome_counts(both, ["task", "lang"])


def bootstrap_ci(spark, sf_dir):
    ends = S.bootstrap_interval(_outcomes(spark, sf_dir), ["task", "lang"], RESAMPLES, SEED)
    return ends.select("task", "lang", "n", *_round("accuracy", "low", "high"))


def ci_overlap(spark, sf_dir):
    ends = S.bootstrap_interval(_outcomes(spark, sf_dir), ["task", "lang"], RESAMPLES, SEED)
    return S.overlap_verdict(ends, "lang", "en", ["task"]).select("task", "lang", "overlaps", "verdict")


def results_json(spark, sf_dir):
    """Wide rows written as JSON objects keyed by run, read back and parsed from their keys."""
    path = fresh_path(spark, "results")
    rows = _with_tokens(spark, sf_dir)
    key = F.concat(F.lit("p"), F.col("phase").cast("string"), F.lit("_"), "model", F.lit("_step"), F.col("step").cast("string"))
    J.write_results(rows.withColumn("key", key), path, fields=["model", "step", "phase", "tokens", *R.TASKS])
    back = R.parse_run_keys(J.read_results(spark, path).drop("model", "step", "phase"))
    return R.fill_tokens(back).select(
        "key", F.col("phase").cast("bigint").alias("phase"), "model", "step", "tokens", *_round(*R.TASKS)
    )


def niah_unified(spark, sf_dir):
    """The three score encodings, written, read back and put under one schema."""
    path = fresh_path(spark, "niah")
    by_length = X.accuracy(answers(spark, sf_dir).withColumn("context_len", F.lit(256) * F.expr("int(pow(2, k % 4))")), ["phase", "context_len", "model"])
    rows = by_length.select("phase", F.col("context_len").cast("string").alias("len"), "model", F.col("accuracy").alias("score"), F.lit("OK").alias("status"))
    flat = rows.where("phase = 1").select(F.to_json(F.create_map(F.concat(F.lit("niah_L"), "len", F.lit("_"), "model"), "score")).alias("value"))
    record = F.struct("score", "status")
    status = rows.where("phase = 2").select(F.to_json(F.create_map(F.concat(F.lit("L"), "len", F.lit("_"), "model"), record)).alias("value"))
    nested = rows.where("phase = 3").select(F.to_json(F.create_map(F.concat(F.lit("L"), "len"), F.create_map("model", record))).alias("value"))
    for name, part in (("flat", flat), ("status", status), ("nested", nested)):
        part.write.text(f"{path}/{name}")
    whole = R.union_results(
        {
            "flat": J.read_flat_scores(spark, f"{path}/flat"),
            "status": J.read_status_scores(spark, f"{path}/status"),
            "nested": J.read_nested_scores(spark, f"{path}/nested"),
        }
    )
    return whole.select("source", F.col("context_len").cast("bigint").alias("context_len"), "model", *_round("score"), "status")


def log_metrics(spark, sf_dir):
    """One benchmark log per phase, rendered, written and parsed back."""
    path = fresh_path(spark, "benchlogs")
    tag = F.concat_ws("_", "model", F.col("step").cast("string"))
    lines = F.sort_array(F.collect_list(F.struct("task", "score", F.col("total").alias("seconds"))))
    logs = scores(spark, sf_dir).groupBy(*R.RUN).agg(lines.alias("tasks"))
    logs.select("phase", L.render_bench_log(tag, F.col("tasks")).alias("value")).write.partitionBy("phase").text(path)
    parsed = L.read_bench_logs(spark, f"{path}/*")
    phase = F.regexp_extract("file", r"phase=(\d+)", 1).cast("bigint").alias("phase")
    return parsed.select(phase, "tag", "task", "score", "seconds")


def train_log_metrics(spark, sf_dir):
    """Training log lines of the step metrics, rendered into eight log folders and parsed back."""
    path = fresh_path(spark, "trainlogs")
    steps = run_steps(spark, sf_dir)
    loss = F.round(F.col("loss") * 800) / 1000  # three decimals at most, so that rendering is exact
    line = L.render_step_line(F.col("step"), F.lit(9536), loss, F.least(F.col("ppl"), F.lit(1e6)), loss / 10, F.col("lr_factor"), F.col("step") * 1.0)
    checked = F.concat(line, F.when(F.col("step") % 2 == 0, F.format_string("\n  >>> val_loss=%.4f  val_ppl=%.1f", loss, loss)).otherwise(""))
    steps.select((F.col("run") % 8).alias("lane"), checked.alias("value")).write.partitionBy("lane").text(path)
    parsed = L.read_training_logs(spark, f"{path}/*")
    lane = F.regexp_extract("file", r"lane=(\d+)", 1).cast("bigint").alias("lane")
    return parsed.select(lane, "step", "total_steps", "loss", "lr", "val_loss")


def checkpoint_manifest(spark, sf_dir):
    """Checkpoint paths of every evaluated step, parsed back from the path alone."""
    runs = answers(spark, sf_dir).select(*R.RUN).distinct()
    paths = runs.select(CK.checkpoint_path(F.col("phase"), F.col("model"), F.col("step")).alias("path"))
    return CK.parse_checkpoints(paths).select(F.col("phase").cast("bigint").alias("phase"), "model", "step", "is_final", "path")


def bench_metric_keys(spark, sf_dir):
    """Preferred metric of each task, where some tasks report only the second kind."""
    per_task = X.accuracy(answers(spark, sf_dir), ["task"])
    plain = F.create_map(F.lit("acc,none"), "accuracy", F.lit("acc_norm,none"), F.lit(0.5))
    other = F.create_map(F.lit("acc_norm,none"), F.col("accuracy"))
    rows = per_task.select("task", F.when(F.length("task") % 2 == 0, plain).otherwise(other).alias("metrics"))
    return J.bench_metrics(rows).select("metric", *_round("value"))


def pending_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return N.remaining(docs, table(spark, sf_dir, "labels"), ["doc_id"])


def pending_benchmarks(spark, sf_dir):
    """Model-and-user pairs for which not all five tasks have been reported."""
    rows = answers(spark, sf_dir)
    tag = F.concat_ws("_", "model", F.col("user_id").cast("string")).alias("tag")
    plan = rows.select(tag).distinct()
    done = N.finished(rows.select(tag, "task"), "tag", R.TASKS)
    return N.remaining(plan, done, ["tag"])


def missing_inputs(spark, sf_dir):
    """Labels of longer documents count as available; the rest have no usable input."""
    docs = table(spark, sf_dir, "documents").where("n_chars >= 500").select("doc_id")
    plan = table(spark, sf_dir, "labels").select("doc_id")
    ready = N.runnable(plan, docs, ["doc_id"]).withColumn("state", F.lit("runnable"))
    return ready.unionByName(N.missing(plan, docs, ["doc_id"]).withColumn("state", F.lit("missing")))


QUERIES = {
    "results_long": results_long,
    "results_wide": results_wide,
    "results_unpivot": results_unpivot,
    "results_union": results_union,
    "final_per_model": final_per_model,
    "best_second": best_second,
    "delta_vs_baseline": delta_vs_baseline,
    "convergence_step": convergence_step,
    "best_ds": best_ds,
    "token_consistency": token_consistency,
    "efficiency": efficiency,
    "cost_ratio": cost_ratio,
    "seed_summary": seed_summary,
    "bootstrap_ci": bootstrap_ci,
    "ci_overlap": ci_overlap,
    "results_json": results_json,
    "niah_unified": niah_unified,
    "log_metrics": log_metrics,
    "train_log_metrics": train_log_metrics,
    "checkpoint_manifest": checkpoint_manifest,
    "bench_metric_keys": bench_metric_keys,
    "pending_documents": pending_documents,
    "pending_benchmarks": pending_benchmarks,
    "missing_inputs": missing_inputs,
}

# --- the same answers in SQL -------------------------------------------------------------------

_TASK_LIST = "[" + ", ".join(f"'{t}'" for t in R.TASKS) + "]"

_ANSWERS_SQL = f"""
answers AS (
    SELECT user_id % 3 + 1 AS phase, event_type AS model, (user_id % 10 + 1) * 1000 AS step, {_TASK_LIST}[(k % 5)::INT + 1] AS task,
           {list(CONFIGS)}[(k // 5 % 4)::INT + 1]::BIGINT AS width, event_id % 5 AS seed, k, value > {RIGHT_ABOVE} AS correct
    FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
),
scores AS (
    SELECT phase, model, step, task, count(*) AS total, sum(correct::INT)::BIGINT AS n_correct, sum(correct::INT) / count(*)::DOUBLE AS score
    FROM answers GROUP BY ALL
)"""

_TASK_COLUMNS = ", ".join(f"max(score) FILTER (WHERE task = '{t}') AS {t}" for t in R.TASKS)
_ROUND_TASKS = ", ".join(f"round({t}, 6) AS {t}" for t in R.TASKS)
_WIDE_SQL = f"{_ANSWERS_SQL}, wide AS (SELECT phase, model, step, {_TASK_COLUMNS} FROM scores GROUP BY ALL)"
_TOKENS_SQL = f"""{_WIDE_SQL},
counted AS (
    SELECT phase, model, step, CASE WHEN count(*) % 5 <> 0 THEN step * {R.STEP_TOKENS} + CASE WHEN count(*) % 7 = 0 THEN count(*) * 8192 ELSE 0 END END AS tokens
    FROM answers GROUP BY phase, model, step
),
tokened AS (SELECT * FROM wide JOIN counted USING (phase, model, step))"""
_FINAL_SQL = f"{_WIDE_SQL}, finals AS (SELECT * FROM wide QUALIFY row_number() OVER (PARTITION BY phase, model ORDER BY step DESC) = 1)"
_FINAL_LONG_SQL = f"""{_FINAL_SQL},
final_long AS (
    SELECT s.phase, s.model, s.step, s.task, round(s.score, 9) AS score FROM scores s JOIN finals f USING (phase, model, step)
)"""

_BOOT_SQL = f"""
outcomes AS (
    SELECT lang, unnest(['quality', 'toxic']) AS task, unnest([quality, toxic]) AS correct FROM labels JOIN documents USING (doc_id)
),
counts AS (SELECT task, lang, count(*) AS n, sum(correct)::BIGINT AS k FROM outcomes GROUP BY ALL),
js AS (
    SELECT *, unnest(range(greatest(k - reach, 0), least(k + reach, n) + 1)) AS j, greatest(k - reach, 0) AS low
    FROM (SELECT *, ceil({S.SPREAD} * sqrt(k * (n - k) / n::DOUBLE) + 1)::BIGINT AS reach FROM counts WHERE k > 0 AND k < n)
),
lw AS (
    SELECT *, sum(CASE WHEN j = low THEN 0.0::DOUBLE ELSE ln((n - j + 1) * k / (j * (n - k))::DOUBLE) END) OVER (PARTITION BY task, lang ORDER BY j) AS log_w FROM js
),
ws AS (SELECT *, exp(log_w - max(log_w) OVER (PARTITION BY task, lang)) AS w FROM lw),
steps AS (
    SELECT task, lang, j, sum(w) OVER (PARTITION BY task, lang ORDER BY j) / sum(w) OVER (PARTITION BY task, lang) AS upto FROM ws
),
draws AS (
    SELECT *, ((('0x' || substr(md5('{SEED}:' || task || ':' || lang || ':' || r), 1, 8))::BIGINT) + 0.5::DOUBLE) / 4294967296 AS u
    FROM (SELECT *, unnest(range(1, {RESAMPLES + 1})) AS r FROM counts)
),
stars AS (
    SELECT d.task, d.lang, d.r, d.n, coalesce(s.j, d.k) AS k_star
    FROM draws d ASOF LEFT JOIN steps s ON d.task = s.task AND d.lang = s.lang AND d.u <= s.upto
),
ends AS (
    SELECT task, lang, quantile_cont(k_star / n::DOUBLE, 0.025) AS low, quantile_cont(k_star / n::DOUBLE, 0.975) AS high FROM stars GROUP BY ALL
),
intervals AS (SELECT task, lang, n, k / n::DOUBLE AS accuracy, low, high FROM counts JOIN ends USING (task, lang))"""

SQL = {
    "results_long": f"WITH {_ANSWERS_SQL} SELECT phase, model, step, task, total, n_correct, round(score, 6) AS score FROM scores",
    "results_wide": f"WITH {_WIDE_SQL} SELECT phase, model, step, {_ROUND_TASKS} FROM wide",
    "results_unpivot": f"WITH {_ANSWERS_SQL} SELECT phase, model, step, task, round(score, 6) AS score FROM scores",
    "results_union": f"""WITH {_TOKENS_SQL}
SELECT 'p' || phase AS source, CASE WHEN phase = 1 THEN 0 ELSE phase END AS phase, model, step,
       CASE WHEN phase = 2 THEN step * {R.STEP_TOKENS} ELSE coalesce(tokens, step * {R.STEP_TOKENS}) END AS tokens, {_ROUND_TASKS}
FROM tokened""",
    "final_per_model": f"WITH {_FINAL_SQL} SELECT phase, model, step, {_ROUND_TASKS} FROM finals",
    "best_second": f"""WITH {_FINAL_LONG_SQL},
placed AS (SELECT *, dense_rank() OVER (PARTITION BY phase, task ORDER BY score DESC) AS place FROM final_long)
SELECT phase, model, task, round(score, 6) AS score, place, CASE place WHEN 1 THEN 'best' WHEN 2 THEN 'second' ELSE '' END AS mark FROM placed""",
    "delta_vs_baseline": f"""WITH {_ANSWERS_SQL}
SELECT s.phase, s.model, s.step, s.task, round(s.score, 6) AS score, round(b.score, 6) AS base_score,
       round((s.score - b.score) * 100, 6) AS points, CASE WHEN b.score <> 0 THEN round((s.score - b.score) / b.score, 6) END AS relative
FROM scores s JOIN scores b USING (phase, step, task) WHERE b.model = '{BASELINE}' AND s.model <> '{BASELINE}'""",
    "convergence_step": f"""WITH {_FINAL_LONG_SQL},
thresholds AS (SELECT phase, task, score AS threshold FROM final_long WHERE model = '{BASELINE}')
SELECT phase, task, model, round(any_value(threshold), 6) AS threshold,
       coalesce(min(step) FILTER (WHERE round(score, 9) >= threshold), -1) AS first_step
FROM scores JOIN thresholds USING (phase, task) GROUP BY phase, task, model""",
    "best_ds": f"""WITH {_ANSWERS_SQL},
widths AS (SELECT phase, model, width, round(sum(correct::INT) / count(*)::DOUBLE, 9) AS score FROM answers GROUP BY ALL)
SELECT phase, model, width, round(score, 6) AS score FROM widths
QUALIFY row_number() OVER (PARTITION BY phase, model ORDER BY score DESC, width) = 1""",
    "token_consistency": f"""WITH {_TOKENS_SQL}
SELECT phase, model, step, tokens, step * {R.STEP_TOKENS} AS expected, tokens - step * {R.STEP_TOKENS} AS excess
FROM tokened WHERE tokens <> step * {R.STEP_TOKENS}""",
    "efficiency": f"""WITH {_TOKENS_SQL},
facts AS (SELECT model, (sum(k) * 1000)::BIGINT AS parameters, avg(k) * 300 AS tps FROM answers GROUP BY model),
last_ AS (SELECT * FROM tokened QUALIFY row_number() OVER (PARTITION BY phase, model ORDER BY step DESC) = 1)
SELECT phase, model, step, round(lambada * 100 / (tps / 1000), 6) AS per_1k_tokens_per_second,
       round(coalesce(tokens, step * {R.STEP_TOKENS}) / parameters, 6) AS tokens_per_parameter
FROM last_ JOIN facts USING (model) WHERE lambada IS NOT NULL""",
    "cost_ratio": f"""WITH {_ANSWERS_SQL}, costs AS (SELECT phase, model, sum(k)::BIGINT AS flops FROM answers GROUP BY ALL)
SELECT c.phase, c.model, c.flops, round(c.flops / b.flops::DOUBLE, 6) AS ratio
FROM costs c LEFT JOIN costs b ON b.phase = c.phase AND b.model = '{BASELINE}'""",
    "seed_summary": f"""WITH {_ANSWERS_SQL},
seeds AS (SELECT model, seed, sum(correct::INT) / count(*)::DOUBLE AS a FROM answers GROUP BY ALL)
SELECT model, count(*) AS n_seeds, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std FROM seeds GROUP BY model""",
    "bootstrap_ci": f"""WITH {_BOOT_SQL}
SELECT task, lang, n, round(accuracy, 6) AS accuracy, round(low, 6) AS low, round(high, 6) AS high FROM intervals""",
    "ci_overlap": f"""WITH {_BOOT_SQL}
SELECT i.task, i.lang, greatest(i.low, b.low) <= least(i.high, b.high) AS overlaps,
       CASE WHEN greatest(i.low, b.low) <= least(i.high, b.high) THEN 'not significant' ELSE 'significant' END AS verdict
FROM intervals i JOIN intervals b ON b.task = i.task AND b.lang = 'en' WHERE i.lang <> 'en'""",
    "results_json": f"""WITH {_TOKENS_SQL}
SELECT 'p' || phase || '_' || model || '_step' || step AS key, phase, model, step, coalesce(tokens, step * {R.STEP_TOKENS}) AS tokens, {_ROUND_TASKS}
FROM tokened""",
    "niah_unified": f"""WITH {_ANSWERS_SQL}
SELECT {["flat", "status", "nested"]}[phase::INT] AS source, (256 * pow(2, k % 4))::BIGINT AS context_len, model,
       round(sum(correct::INT) / count(*)::DOUBLE, 6) AS score, CASE WHEN phase = 1 THEN NULL ELSE 'OK' END AS status
FROM answers GROUP BY phase, 2, model""",
    "log_metrics": f"""WITH {_ANSWERS_SQL}
SELECT phase, model || '_' || step AS tag, task, round(score::DECIMAL(38, 15), 4)::DOUBLE AS score, total AS seconds FROM scores""",
    "train_log_metrics": f"""WITH {_STEPS_SQL}
SELECT run % 8 AS lane, step, 9536::BIGINT AS total_steps, round(loss * 800) / 1000 AS loss,
       format('{{:.2e}}', lr_factor)::DOUBLE AS lr, CASE WHEN step % 2 = 0 THEN round(loss * 800) / 1000 END AS val_loss
FROM metrics""",
    "checkpoint_manifest": f"""WITH {_ANSWERS_SQL}
SELECT DISTINCT phase, model, step, false AS is_final, format('phase{{}}_{{}}/step_{{:06d}}.pt', phase, model, step) AS path FROM answers""",
    "bench_metric_keys": f"""WITH {_ANSWERS_SQL}
SELECT 'bench/' || task || '_acc' AS metric, round(sum(correct::INT) / count(*)::DOUBLE, 6) AS value FROM answers GROUP BY task""",
    "pending_documents": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "pending_benchmarks": """
WITH tags AS (SELECT event_type || '_' || user_id AS tag, json_extract_string(props, '$.k')::BIGINT % 5 AS task FROM events)
SELECT tag FROM tags GROUP BY tag HAVING count(DISTINCT task) < 5""",
    "missing_inputs": """SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'runnable' END AS state
FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE n_chars >= 500) d USING (doc_id)""",
}
