"""Run telemetry over ``events`` (one run per user) and monitors over ``embeddings`` (one layer per label)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.math import rate_factor
from weftline.operators import monitors as M
from weftline.operators import telemetry as T
from weftline.operators.prefix import running_total
from weftline.plans.tables import ACCUMULATE, MICRO_BATCH, SEQ_LEN, table
from weftline.session import spread

WARMUP, TOTAL_STEPS = 500, 9536
RUN_BUDGET = 150_000


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


def losses(spark, sf_dir):
    events = spread(table(spark, sf_dir, "events"), "event_id")
    return events.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("seq"), T.micros(F.col("ts")).alias("at"), F.col("value").alias("loss")
    )


def token_rows(spark, sf_dir):
    return as_token_rows(spread(table(spark, sf_dir, "events"), "event_id"))


def as_token_rows(events):
    return events.select(
        F.col("user_id").alias("run"),
        F.when(F.dayofmonth("ts") > 15, 1).otherwise(0).cast("bigint").alias("restart"),
        F.col("event_id").alias("seq"),
        T.micros(F.col("ts")).alias("at"),
        (_k() * 64).alias("tokens"),
    )


def run_steps(spark, sf_dir):
    """Step metrics of every run."""
    return T.step_metrics(losses(spark, sf_dir), ACCUMULATE, MICRO_BATCH * SEQ_LEN, 3, 40)


def step_metrics(spark, sf_dir):
    numbers = ("ppl", "lr_factor", "tokens_per_second")
    return run_steps(spark, sf_dir).select("run", "step", "tokens", F.round("loss", 6).alias("loss"), *[F.round(c, 4).alias(c) for c in numbers])


def logged_steps(spark, sf_dir):
    """Long form of every second step."""
    long = T.metrics_long(T.every(run_steps(spark, sf_dir), 2), ["loss", "lr_factor", "tokens"])
    return long.select("run", "step", "metric", F.round("value", 6).alias("value"))


def lr_schedule(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"))
    return steps.select("step", F.round(rate_factor(F.col("step"), WARMUP, TOTAL_STEPS), 9).alias("lr_factor"))


def throughput(spark, sf_dir):
    return T.throughput(token_rows(spark, sf_dir)).select(
        "run", "restart", "seq", "tokens_since_start", F.round("seconds", 6).alias("seconds"),
        F.round("tokens_per_second", 4).alias("tokens_per_second"),
    )


def stop_step(spark, sf_dir):
    """Runs that never reach the budget show -1."""
    return T.stop_points(token_rows(spark, sf_dir), RUN_BUDGET).fillna(-1, ["stop_seq", "stop_tokens"])


def validation_loss(spark, sf_dir):
    return T.validation_loss(losses(spark, sf_dir), 50).select("run", F.round("val_loss", 6).alias("val_loss"), "n_batches")


def event_parity(spark, sf_dir):
    """Running parity of a bit per event, along each run."""
    bits = token_rows(spark, sf_dir).select("run", "seq", ((F.col("tokens") / 64).cast("bigint") % 2).alias("bit"))
    counted = running_total(bits, "seq", "bit", "before", ["run"])
    return counted.select("run", "seq", "bit", ((F.col("before") + F.col("bit")) % 2).alias("parity"))


def _layers(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("layer"), F.col("embedding").cast("array<double>").alias("values")
    )


def lambda_summary(spark, sf_dir):
    return M.layer_scale_summary(_layers(spark, sf_dir)).select(
        "layer", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "is_constant", "n_heads"
    )


def attention_entropy(spark, sf_dir):
    probs = _layers(spark, sf_dir).select("layer", M.softmax(F.col("values")).alias("probs"))
    return M.attention_entropy(probs).select("layer", F.round("entropy", 6).alias("entropy"), "n_rows")


def _monitors(spark, sf_dir):
    values = F.col("values")
    pairs = F.transform(
        F.sequence(F.lit(0), F.expr("size(values) div 2 - 1")),
        lambda i: F.struct(F.get(values, i * 2).alias("g"), F.get(values, i * 2 + 1).alias("c")),
    )
    rows = _layers(spark, sf_dir).select("layer", F.inline(pairs))
    return M.layer_monitors(rows.withColumn("log_decay", F.col("g") / 10))


def monitor_metrics(spark, sf_dir):
    """Monitor rows of layers and of heads (a place of the vectors each), written under their logged keys and parsed back."""
    heads = _layers(spark, sf_dir).select("layer", F.posexplode("values").alias("head", "raw"))
    keyed = M.monitor_keys(_monitors(spark, sf_dir)).unionByName(M.head_keys(M.head_scales(heads)))
    return M.parse_monitor_keys(keyed).select(
        "name", *[F.col(c).cast("bigint").alias(c) for c in ("layer", "head")], F.round("value", 6).alias("value")
    )


def parameter_status(spark, sf_dir):
    """Two counts of the characters of each source: the recorded one and the texts' own."""
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.sum("n_chars").cast("bigint").alias("recorded"), F.sum(F.length("text")).cast("bigint").alias("counted")
    )
    return M.parameter_status(counts, "recorded", "counted").withColumn("gap", F.round("gap", 9))


def range_status(spark, sf_dir):
    return M.range_status(_monitors(spark, sf_dir)).select("layer", "gap_status", "half_life_status")


def finite_check(spark, sf_dir):
    """Logarithms of the values: negative ones give NaN, zeros -Infinity."""
    rows = _layers(spark, sf_dir).select("layer", F.explode("values").alias("x"))
    logs = F.when(F.col("x") < 0, F.lit(float("nan"))).when(F.col("x") == 0, F.lit(float("-inf"))).otherwise(F.log("x"))
    return M.finite_check(rows.select("layer", logs.alias("value")), ["layer"])


QUERIES = {
    "step_metrics": step_metrics,
    "logged_steps": logged_steps,
    "lr_schedule": lr_schedule,
    "throughput": throughput,
    "stop_step": stop_step,
    "validation_loss": validation_loss,
    "event_parity": event_parity,
    "lambda_summary": lambda_summary,
    "attention_entropy": attention_entropy,
    "monitor_metrics": monitor_metrics,
    "range_status": range_status,
    "parameter_status": parameter_status,
    "finite_check": finite_check,
}

# --- the same answers in SQL -------------------------------------------------------------------


def _rate(step: str, warmup: int, total: int) -> str:
    return f"""CASE WHEN {step} < {warmup} THEN {step} / {max(warmup, 1)}.0
        ELSE 0.5 * (1 + cos(pi() * least(({step} - {warmup}) / {max(total - warmup, 1)}.0::DOUBLE, 1))) END"""


_STEPS_SQL = f"""
micro AS (
    SELECT user_id AS run, event_id, epoch_us(ts) AS at_us, value AS loss,
           row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS m,
           first_value(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS started
    FROM events
),
steps AS (
    SELECT run, m // {ACCUMULATE} + 1 AS step, avg(loss) AS loss, max(at_us) AS at_us, min(started) AS started
    FROM micro GROUP BY 1, 2 HAVING count(*) = {ACCUMULATE}
),
metrics AS (
    SELECT run, step, loss, exp(least(loss, 20)) AS ppl, {_rate("step", 3, 40)} AS lr_factor,
           step * {ACCUMULATE * MICRO_BATCH * SEQ_LEN} AS tokens,
           step * {ACCUMULATE * MICRO_BATCH * SEQ_LEN} / greatest((at_us - started) / 1e6, 1e-6) AS tps
    FROM steps
)"""

_TOKENS_SQL = """
t AS (
    SELECT user_id AS run, (day(ts) > 15)::INT::BIGINT AS restart, event_id AS seq, epoch_us(ts) AS at_us,
           json_extract_string(props, '$.k')::BIGINT * 64 AS tokens
    FROM events
)"""

_VALUES_SQL = "v AS (SELECT label::BIGINT AS layer, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"
_MONITORS_SQL = f"""{_VALUES_SQL},
gc AS (SELECT a.layer, a.x AS g, b.x AS c FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.i = a.i + 1 WHERE a.i % 2 = 1),
mon AS (
    SELECT layer, max(abs(g - c)) AS gap,
           CASE WHEN avg(g / 10) < 0 THEN ln(0.5) / avg(g / 10) ELSE 'Infinity'::DOUBLE END AS half FROM gc GROUP BY layer
)"""

SQL = {
    "step_metrics": f"""WITH {_STEPS_SQL}
SELECT run, step, tokens, round(loss, 6) AS loss, round(ppl, 4) AS ppl, round(lr_factor, 4)::DOUBLE AS lr_factor, round(tps, 4) AS tokens_per_second FROM metrics""",
    "logged_steps": f"""WITH {_STEPS_SQL}
SELECT run, step, metric, round(value, 6)::DOUBLE AS value FROM (
    SELECT run, step, unnest(['loss', 'lr_factor', 'tokens']) AS metric, unnest([loss, lr_factor, tokens::DOUBLE]) AS value
    FROM metrics WHERE step % 2 = 0
)""",
    "lr_schedule": f"SELECT event_id AS step, round({_rate('event_id', WARMUP, TOTAL_STEPS)}, 9)::DOUBLE AS lr_factor FROM events",
    "throughput": f"""WITH {_TOKENS_SQL}
SELECT run, restart, seq, tokens_since_start, round(s, 6) AS seconds, round(tokens_since_start / greatest(s, 1e-6), 4) AS tokens_per_second
FROM (
    SELECT run, restart, seq, (sum(tokens) OVER w)::BIGINT AS tokens_since_start, (at_us - first_value(at_us) OVER w) / 1e6 AS s
    FROM t WINDOW w AS (PARTITION BY run, restart ORDER BY seq)
)""",
    "stop_step": f"""WITH {_TOKENS_SQL}, seen AS (SELECT run, seq, (sum(tokens) OVER (PARTITION BY run ORDER BY seq))::BIGINT AS s FROM t)
SELECT run, coalesce(min(seq) FILTER (WHERE s >= {RUN_BUDGET}), -1) AS stop_seq,
       coalesce(min(s) FILTER (WHERE s >= {RUN_BUDGET}), -1) AS stop_tokens, max(s) AS tokens
FROM seen GROUP BY run""",
    "validation_loss": """WITH m AS (SELECT user_id AS run, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT run, round(coalesce(avg(value) FILTER (WHERE i < 50), 0), 6) AS val_loss, count(*) FILTER (WHERE i < 50) AS n_batches FROM m GROUP BY run""",
    "event_parity": f"""WITH {_TOKENS_SQL}
SELECT run, seq, bit, (sum(bit) OVER (PARTITION BY run ORDER BY seq))::BIGINT % 2 AS parity
FROM (SELECT run, seq, (tokens // 64) % 2 AS bit FROM t)""",
    "lambda_summary": f"""WITH {_VALUES_SQL}
SELECT layer, round(avg(ln(1 + exp(x))), 6) AS mean, round(stddev_pop(ln(1 + exp(x))), 6) AS std, min(x) = max(x) AS is_constant, count(*) AS n_heads
FROM v GROUP BY layer""",
    "attention_entropy": f"""WITH {_VALUES_SQL},
p AS (SELECT layer, vec_id, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM v),
h AS (SELECT layer, vec_id, sum(-p * ln(p)) AS h FROM p GROUP BY ALL)
SELECT layer, round(avg(h), 6) AS entropy, count(*) AS n_rows FROM h GROUP BY layer""",
    "monitor_metrics": f"""WITH {_MONITORS_SQL}
SELECT 'monitor/max_g_c' AS name, layer, NULL::BIGINT AS head, round(gap, 6) AS value FROM mon
UNION ALL SELECT 'monitor/half_life', layer, NULL, round(half, 6) FROM mon
UNION ALL SELECT 'lambda', layer, head, round(ln(1 + exp(avg(raw))), 6) FROM (
    SELECT label::BIGINT AS layer, unnest(embedding)::DOUBLE AS raw, generate_subscripts(embedding, 1) - 1 AS head FROM embeddings
) GROUP BY ALL""",
    "parameter_status": """WITH counts AS (
    SELECT source, sum(n_chars)::BIGINT AS recorded, sum(length(text))::BIGINT AS counted FROM documents GROUP BY source
), gaps AS (SELECT *, abs(counted - recorded)::DOUBLE / nullif(recorded, 0)::DOUBLE AS gap FROM counts)
SELECT source, recorded, counted, round(gap, 9) AS gap, CASE WHEN gap < 0.01 THEN 'OK' ELSE 'WARNING' END AS parameter_status FROM gaps""",
    "range_status": f"""WITH {_MONITORS_SQL}
SELECT layer, CASE WHEN gap < 20 THEN 'OK' ELSE 'WARNING' END AS gap_status,
       CASE WHEN half > 10 AND half < 200 THEN 'OK' ELSE 'WARNING' END AS half_life_status FROM mon""",
    "finite_check": f"""WITH {_VALUES_SQL}
SELECT layer, count(*) AS n, count(*) FILTER (WHERE x < 0) AS n_nan, count(*) FILTER (WHERE x = 0) AS n_inf,
       count(*) FILTER (WHERE x > 0 AND ln(x) <= 0) AS n_not_positive, count(*) FILTER (WHERE x <= 0) = 0 AS all_finite
FROM v GROUP BY layer""",
}
