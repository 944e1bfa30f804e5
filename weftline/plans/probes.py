"""Parity and needle-in-a-haystack probes, one case per document."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.draws import draw
from weftline.operators import corpus as C
from weftline.operators import generators as G
from weftline.operators import requests as R
from weftline.operators.bigrams import bigram_scores
from weftline.operators.tasks import RUNNERS, evaluate
from weftline.plans import scoring as S
from weftline.plans.corpus import documents
from weftline.plans.scoring import _hash
from weftline.plans.tables import IDS_SQL, SEED

PARITY_LEN = 128
LENGTHS = (512, 1024, 2048)
PASSKEY_ROUNDS, CODE_ROUNDS = 20, 50  # of the constant texts; longer contexts start them over


def _samples(spark, sf_dir):
    cases = documents(spark, sf_dir).select(F.col("doc_id").alias("sample_id"))
    return G.parity_samples(cases, PARITY_LEN, SEED)


def parity_labels(spark, sf_dir):
    return _samples(spark, sf_dir).select("sample_id", *[F.col(c).cast("bigint").alias(c) for c in ("pos", "bit", "parity")])


def parity_accuracy(spark, sf_dir):
    """Predictions by drawn scores over three tokens, of which only 0 and 1 may be chosen."""
    samples = _samples(spark, sf_dir)
    tokens = F.explode(F.array(*[F.lit(t) for t in (0, 1, 2)])).alias("token")
    candidates = samples.select(F.col("sample_id").alias("request_id"), "pos", tokens)
    scored = candidates.withColumn("logprob", draw("p", F.col("request_id"), F.col("pos"), F.col("token")).cast("double"))
    predicted = G.binary_predictions(scored).withColumnRenamed("request_id", "sample_id")
    return G.parity_accuracy(samples, predicted, PARITY_LEN).select(
        F.round("token_acc", 6).alias("token_acc"), F.round("last_pos_acc", 6).alias("last_pos_acc")
    )


def _described(cases):
    return cases.select(
        "case_id",
        F.col("context_len").cast("bigint").alias("context_len"),
        "pos",
        "answer",
        F.size("prompt").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("prompt", " ")).alias("prompt_md5"),
    )


def _passkeys(spark, sf_dir):
    return G.passkey_cases(G.document_filler(C.present_documents(documents(spark, sf_dir))), LENGTHS, SEED)


def _code_words(spark, sf_dir):
    return G.code_word_cases(G.document_filler(C.present_documents(documents(spark, sf_dir))), LENGTHS, SEED)


def niah_cases_a(spark, sf_dir):
    return _described(_passkeys(spark, sf_dir))


def niah_cases_b(spark, sf_dir):
    return _described(_code_words(spark, sf_dir))


def niah_constant_filler(spark, sf_dir):
    """Both kinds of needle in their own constant text, at every length."""
    cases = documents(spark, sf_dir).select(F.col("doc_id").alias("case_id"))
    passkeys = G.passkey_cases(G.constant_filler(cases, G.PASSKEY_FILLER, PASSKEY_ROUNDS), LENGTHS, SEED)
    code_words = G.code_word_cases(G.constant_filler(cases, G.CODE_FILLER, CODE_ROUNDS), LENGTHS, SEED)
    return _described(passkeys).withColumn("variant", F.lit("a")).unionByName(_described(code_words).withColumn("variant", F.lit("b")))


def niah_accuracy(spark, sf_dir):
    cases = _code_words(spark, sf_dir)
    judged = G.first_word_accuracy(cases, G.recalled_words(cases))
    return judged.select(
        F.col("context_len").cast("bigint").alias("context_len"), "total", "n_correct", F.round("accuracy", 6).alias("accuracy")
    )


def task_accuracy(spark, sf_dir):
    """All five tasks in one go: last words, needles, endings, questions and blanks of the given tables."""
    encode, model = S.scorer(documents(spark, sf_dir))
    items = S.items(spark, sf_dir)
    inputs = {
        "lambada": items,
        "niah": _code_words(spark, sf_dir),
        "hellaswag": R.with_other_endings(items, S.DISTRACTORS, SEED),
        "arc_easy": S._keyed_choices(spark, sf_dir),
        "winogrande": S._blanks(spark, sf_dir),
    }
    rows = evaluate(inputs, encode, lambda targets: bigram_scores(targets, model), RUNNERS)
    return rows.select("task", "total", "n_correct", *S._rounded("accuracy"))


def niah_generated(spark, sf_dir):
    """The passkey must occur in six words copied from the prompt."""
    cases = _passkeys(spark, sf_dir)
    found = G.answer_found(cases, G.copied_words(cases, 6))
    return found.select(
        F.col("context_len").cast("bigint").alias("context_len"), "total", "n_correct", F.round("accuracy", 6).alias("accuracy")
    )


QUERIES = {
    "parity_labels": parity_labels,
    "parity_accuracy": parity_accuracy,
    "niah_cases_a": niah_cases_a,
    "niah_cases_b": niah_cases_b,
    "niah_constant_filler": niah_constant_filler,
    "niah_accuracy": niah_accuracy,
    "niah_generated": niah_generated,
    "task_accuracy": task_accuracy,
}

# --- the same answers in SQL -------------------------------------------------------------------

_W = r"'[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'"

_PARITY_SQL = f"""
bits AS (
    SELECT doc_id AS sample_id, pos, {_hash(f"'{SEED}:' || doc_id || ':' || pos")} % 2 AS bit
    FROM documents, (SELECT unnest(range({PARITY_LEN})) AS pos)
),
labels_ AS (
    SELECT sample_id, pos, bit, (sum(bit) OVER (PARTITION BY sample_id ORDER BY pos))::BIGINT % 2 AS parity FROM bits
)"""


def _repeat(count: str) -> str:
    rounds = f"CAST(ceil({count} / greatest(len(filler), 1)) AS INTEGER)"
    return f"flatten(list_transform(range({rounds}), lambda r: filler))[1:{count}]"


_FILLER_SQL = f"""
filler_rows AS (
    SELECT doc_id AS case_id, regexp_extract_all(text, {_W}) AS filler FROM documents WHERE text IS NOT NULL AND text <> ''
)"""


def _constant(text: str, rounds: int) -> str:
    return f"""filler_rows AS (
    SELECT doc_id AS case_id, regexp_extract_all(repeat('{text}', {rounds}), {_W}) AS filler FROM documents
)"""


_GRID_SQL = "grid AS (SELECT *, unnest([%s]) AS context_len FROM filler_rows WHERE len(filler) > 0)"


def _grid(lengths) -> str:
    return _GRID_SQL % ", ".join(str(n) for n in lengths)


def _salted(salt: str) -> str:
    return _hash(f"'{SEED}:' || case_id || ':' || context_len || ':{salt}'")


_PASSKEY_SQL = f"""
keyed AS (SELECT *, (10000 + {_salted("passkey")} % 90000)::VARCHAR AS answer FROM grid),
needled AS (
    SELECT *, regexp_extract_all(chr(10) || 'The special passkey is ' || answer || '. Remember it.' || chr(10), {_W}) AS needle,
           regexp_extract_all('The special passkey is', {_W}) AS question
    FROM keyed
),
hays AS (SELECT *, context_len - len(needle) - len(question) - 5 AS budget, {_repeat("(context_len - len(needle) - len(question) - 5)")} AS hay FROM needled),
placed AS (
    SELECT *, len(hay) // 4 + {_salted("pos")} % (3 * len(hay) // 4 - len(hay) // 4 + 1) AS pos FROM hays WHERE budget > 0
),
cases AS (
    SELECT case_id, context_len::BIGINT AS context_len, pos::BIGINT AS pos, answer,
           (hay[1:pos] || needle || hay[pos + 1:] || question)[1:context_len] AS prompt FROM placed
)"""

_PAIR_VALUES = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(G.CODE_WORDS))
_CODE_SQL = f"""
code_words(id, phrase, answer) AS (VALUES {_PAIR_VALUES}),
keyed AS (SELECT grid.*, phrase, answer FROM grid JOIN code_words ON id = {_salted("pair")} % {len(G.CODE_WORDS)}),
needled AS (
    SELECT *, regexp_extract_all(phrase || ' ' || answer || '.', {_W}) AS needle, regexp_extract_all(phrase, {_W}) AS question FROM keyed
),
sized_ AS (SELECT *, context_len - len(needle) - len(question) - 10 AS avail FROM needled),
hays AS (SELECT *, {_repeat("avail")} AS hay FROM sized_ WHERE avail >= 10),
placed AS (SELECT *, 5 + {_salted("pos")} % (avail // 2 - 5 + 1) AS pos FROM hays),
cases AS (
    SELECT case_id, context_len::BIGINT AS context_len, pos::BIGINT AS pos, answer,
           (hay[1:pos] || needle || hay[1:avail - pos] || question)[1:context_len] AS prompt FROM placed
)"""

_DESCRIBE = """
SELECT case_id, context_len, pos, answer, len(prompt)::BIGINT AS n_tokens, md5(array_to_string(prompt, ' ')) AS prompt_md5 FROM cases"""

SQL = {
    "parity_labels": f"WITH {_PARITY_SQL} SELECT * FROM labels_",
    "parity_accuracy": f"""WITH {_PARITY_SQL},
predicted AS (
    SELECT *, CASE WHEN {_hash("'p:' || sample_id || ':' || pos || ':1'")} > {_hash("'p:' || sample_id || ':' || pos || ':0'")} THEN 1 ELSE 0 END AS p
    FROM labels_
)
SELECT round(avg((p = parity)::INT), 6) AS token_acc, round(avg((p = parity)::INT) FILTER (WHERE pos = {PARITY_LEN - 1}), 6) AS last_pos_acc
FROM predicted""",
    "niah_cases_a": f"WITH {_FILLER_SQL}, {_grid(LENGTHS)}, {_PASSKEY_SQL} {_DESCRIBE}",
    "niah_cases_b": f"WITH {_FILLER_SQL}, {_grid(LENGTHS)}, {_CODE_SQL} {_DESCRIBE}",
    "niah_constant_filler": f"""
SELECT 'a' AS variant, * FROM (WITH {_constant(G.PASSKEY_FILLER, PASSKEY_ROUNDS)}, {_grid(LENGTHS)}, {_PASSKEY_SQL} {_DESCRIBE})
UNION ALL SELECT 'b', * FROM (WITH {_constant(G.CODE_FILLER, CODE_ROUNDS)}, {_grid(LENGTHS)}, {_CODE_SQL} {_DESCRIBE})""",
    "task_accuracy": f"""WITH {IDS_SQL}, {S._PAIRS_SQL}, {S._RANKED},
{S._reqs_last("_l")}, {S._scored(R.MAX_LENGTH, "_l")}, {S._fold("_l")},
{S._reqs_choice("_c")}, {S._scored(R.MAX_LENGTH, "_c")}, {S._fold("_c")}, {S._picked(S._PER_TOKEN, "_c")},
{S._reqs_blank("_b")}, {S._scored(R.MAX_LENGTH, "_b")}, {S._rolled("_b")}, {S._picked(S._PER_ID, "_b")},
{S._reqs_ending("_h")}, {S._scored(R.MAX_LENGTH, "_h")}, {S._fold("_h")}, {S._picked(S._PER_TOKEN, "_h")},
reqs_n AS (
    -- the scorer looks at the last token before the answer only
    SELECT case_id || ':' || context_len AS request_id, prompt[-1] AS ctx, ' ' || answer AS cont
    FROM (WITH {_FILLER_SQL}, {_grid(LENGTHS)}, {_CODE_SQL} SELECT * FROM cases)
), {S._scored(None, "_n")},
outcomes AS (
    SELECT 'lambada' AS task, is_greedy AS ok FROM folded_l
    UNION ALL SELECT 'niah', best = token FROM scored_n WHERE part = 1 AND pos = 0
    UNION ALL SELECT 'hellaswag', picked = label FROM picked_h
    UNION ALL SELECT 'arc_easy', picked = label FROM picked_c
    UNION ALL SELECT 'winogrande', picked = label FROM picked_b
)
SELECT task, count(*) AS total, sum(ok::INT)::BIGINT AS n_correct, round(sum(ok::INT) / count(*), 6)::DOUBLE AS accuracy
FROM outcomes GROUP BY task""",
    "niah_accuracy": f"""WITH {_FILLER_SQL}, {_grid(LENGTHS)}, {_CODE_SQL},
rows_ AS (
    SELECT case_id, context_len, unnest(prompt) AS word, generate_subscripts(prompt, 1) AS i, len(prompt) AS n, prompt[-1] AS ending FROM cases
),
next_ AS (SELECT *, lead(word) OVER (PARTITION BY case_id, context_len ORDER BY i) AS said FROM rows_),
counts AS (SELECT case_id, context_len, said, count(*) AS c FROM next_ WHERE word = ending AND i < n GROUP BY ALL),
heard AS (
    SELECT case_id, context_len, said FROM counts
    QUALIFY row_number() OVER (PARTITION BY case_id, context_len ORDER BY c DESC, said) = 1
)
SELECT context_len, count(*) AS total, coalesce(sum((said = answer)::INT), 0)::BIGINT AS n_correct,
       round(coalesce(sum((said = answer)::INT), 0) / count(*), 6)::DOUBLE AS accuracy
FROM cases LEFT JOIN heard USING (case_id, context_len) GROUP BY context_len""",
    "niah_generated": f"""WITH {_FILLER_SQL}, {_grid(LENGTHS)}, {_PASSKEY_SQL},
copied AS (
    SELECT *, coalesce(list_max(list_filter(range(1, len(prompt)), lambda i: prompt[i] = prompt[-1])), len(prompt)) AS at_ FROM cases
)
SELECT context_len, count(*) AS total, sum(contains(array_to_string(prompt[at_ + 1:at_ + 6], ' '), answer)::INT)::BIGINT AS n_correct,
       round(avg(contains(array_to_string(prompt[at_ + 1:at_ + 6], ' '), answer)::INT), 6) AS accuracy
FROM copied GROUP BY context_len""",
}
