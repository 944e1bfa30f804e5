"""Synthetic probes with known answers: running parity and needle-in-a-haystack prompts.

Every draw hashes the case id, so a case is the same on any partitioning. Cases come in as rows:
their number follows the input, not a constant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.draws import draw, draw_between
from weftline.functions.text import words
from weftline.operators.scoring import accuracy, top_tokens

# The published probe texts.
PASSKEY_NEEDLE = ("\nThe special passkey is ", ". Remember it.\n")
PASSKEY_QUESTION = "\nThe special passkey is"
PASSKEY_FILLER = (
    "The grass is green. The sky is blue. The sun is bright. The sea is deep. "
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit. "
    "Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. "
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris. "
    "Nisi ut aliquip ex ea commodo consequat. "
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum. "
)
CODE_FILLER = "The quick brown fox jumps over the lazy dog. "
CODE_WORDS = (
    ("The secret code is", "ALPHA"),
    ("The password is", "BRAVO"),
    ("The answer is", "CHARLIE"),
    ("The key number is", "DELTA"),
    ("The magic word is", "ECHO"),
)
PASSKEY_MARGIN = 5
CODE_MARGIN = 10
LEAST_FILLER = 10


def parity_samples(cases: DataFrame, seq_len: int, seed: int) -> DataFrame:
    """``(sample_id, pos, bit, parity)``; ``cases`` holds ``sample_id``. Parity is the running XOR."""
    rows = cases.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(seq_len - 1))).alias("pos"))
    bits = rows.withColumn("bit", (draw(seed, F.col("sample_id"), F.col("pos")) % 2).cast("int"))
    so_far = W.partitionBy("sample_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return bits.withColumn("parity", (F.sum("bit").over(so_far) % 2).cast("int"))


def fresh_parity_samples(spark: SparkSession, num_samples: int, seq_len: int = 128, seed: int = 42) -> DataFrame:
    return parity_samples(spark.range(num_samples).withColumnRenamed("id", "sample_id"), seq_len, seed)


def binary_predictions(candidates: DataFrame) -> DataFrame:
    """Best of the tokens 0 and 1 at each ``(request_id, pos)``; the rest of the vocabulary is ignored."""
    return top_tokens(candidates.where(F.col("token").isin(0, 1))).withColumnRenamed("argmax_token", "predicted")


def parity_accuracy(samples: DataFrame, predictions: DataFrame, seq_len: int) -> DataFrame:
    """Share of right positions, and of right last positions (the hardest ones)."""
    judged = samples.join(predictions, ["sample_id", "pos"], "left")
    right = F.coalesce(F.col("predicted") == F.col("parity"), F.lit(False))
    at_end = F.col("pos") == seq_len - 1
    whole = F.greatest(F.count(F.lit(1)), F.lit(1))
    ends = F.greatest(F.count_if(at_end), F.lit(1))
    return judged.agg(
        (F.count_if(right) / whole).alias("token_acc"), (F.count_if(right & at_end) / ends).alias("last_pos_acc")
    )


def _repeated(filler: Column, count: Column) -> Column:
    """The first ``count`` words of ``filler``, said over and over where it is shorter."""
    rounds = F.ceil(count / F.greatest(F.size(filler), F.lit(1))).cast("int")
    whole = F.when(F.size(filler) >= count, filler).otherwise(F.flatten(F.array_repeat(filler, rounds)))
    return F.slice(whole, F.lit(1), count.cast("int"))


def _grid(cases: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Every case at every length, with at most as many filler words as the context holds.

    The words are cut inside the generator: it reads the filler once per case, not once per row.
    """
    each = F.transform(
        F.array(*[F.lit(n) for n in lengths]),
        lambda n: F.struct(n.alias("context_len"), F.slice("filler", F.lit(1), n).alias("filler")),
    )
    return cases.select(*[c for c in cases.columns if c != "filler"], F.inline(each))


def _seeded(seed: int, salt: str) -> list:
    return [seed, F.col("case_id"), F.col("context_len"), salt]


def passkey_cases(cases: DataFrame, lengths: Sequence[int], seed: int) -> DataFrame:
    """A five-digit passkey hidden in the middle half of the filler.

    ``cases`` holds ``(case_id, filler)``, the filler as a non-empty array of words; any length is served.
    """
    passkey = draw_between(F.lit(10_000), F.lit(99_999), *_seeded(seed, "passkey")).cast("string")
    before, after = PASSKEY_NEEDLE
    shaped = (
        _grid(cases, lengths)
        .withColumn("answer", passkey)
        .withColumn("needle", words(F.concat(F.lit(before), F.col("answer"), F.lit(after))))
        .withColumn("question", words(F.lit(PASSKEY_QUESTION)))
        .withColumn("budget", F.col("context_len") - F.size("needle") - F.size("question") - PASSKEY_MARGIN)
        .where("budget > 0")
        .withColumn("hay", _repeated(F.col("filler"), F.col("budget")))
        .withColumn("pos", draw_between(F.expr("size(hay) div 4"), F.expr("3 * size(hay) div 4"), *_seeded(seed, "pos")))
    )
    head = F.slice("hay", F.lit(1), F.col("pos").cast("int"))
    tail = F.slice("hay", (F.col("pos") + 1).cast("int"), F.size("hay"))
    prompt = F.slice(F.concat(head, "needle", tail, "question"), F.lit(1), F.col("context_len"))
    return shaped.select("case_id", "context_len", "pos", "answer", prompt.alias("prompt"))


def code_word_cases(cases: DataFrame, lengths: Sequence[int], seed: int) -> DataFrame:
    """A code word hidden in the first half; the filler starts over after it. Short contexts are skipped."""
    pairs = F.array(*[F.struct(F.lit(k).alias("phrase"), F.lit(v).alias("value")) for k, v in CODE_WORDS])
    pick = (draw(*_seeded(seed, "pair")) % len(CODE_WORDS)).cast("int")
    shaped = (
        _grid(cases, lengths)
        .withColumn("pair", F.get(pairs, pick))
        .withColumn("needle", words(F.concat("pair.phrase", F.lit(" "), "pair.value", F.lit("."))))
        .withColumn("question", words(F.concat(F.lit(" "), "pair.phrase")))
        .withColumn("avail", F.col("context_len") - F.size("needle") - F.size("question") - CODE_MARGIN)
        .where(F.col("avail") >= LEAST_FILLER)
        .withColumn("hay", _repeated(F.col("filler"), F.col("avail")))
        .withColumn("pos", draw_between(F.lit(5), F.expr("avail div 2"), *_seeded(seed, "pos")))
    )
    head = F.slice("hay", F.lit(1), F.col("pos").cast("int"))
    restart = F.slice("hay", F.lit(1), (F.col("avail") - F.col("pos")).cast("int"))
    prompt = F.slice(F.concat(head, "needle", restart, "question"), F.lit(1), F.col("context_len"))
    return shaped.select("case_id", "context_len", "pos", F.col("pair.value").alias("answer"), prompt.alias("prompt"))


def constant_filler(cases: DataFrame, text: str, repeats: int) -> DataFrame:
    """The same filler text for every case."""
    return cases.withColumn("filler", words(F.lit(text * repeats)))


def document_filler(documents: DataFrame) -> DataFrame:
    """One case per document, hidden in its own words; a document of white space alone has none."""
    return documents.where(F.col("text").rlike(r"\S")).select(F.col("doc_id").alias("case_id"), words(F.col("text")).alias("filler"))


def recalled_words(cases: DataFrame) -> DataFrame:
    """What a reader of the prompt alone would say next: the word that most often followed its last word.

    Stands in for a model's top-1 in checks; gives ``(case_id, context_len, said)``.
    """
    n = F.size("prompt")
    places = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    after = F.transform(
        F.filter(places, lambda i: F.get("prompt", i) == F.element_at("prompt", -1)), lambda i: F.get("prompt", i + 1)
    )
    heard = cases.select("case_id", "context_len", F.explode(after).alias("said"))
    counts = heard.groupBy("case_id", "context_len", "said").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("said", F.struct(-F.col("n"), F.col("said")))
    return counts.groupBy("case_id", "context_len").agg(best.alias("said"))


def first_word_accuracy(cases: DataFrame, said: DataFrame) -> DataFrame:
    """By context length: the predicted word must equal the first word of the answer."""
    judged = cases.select("case_id", "context_len", "answer").join(said, ["case_id", "context_len"], "left")
    right = F.coalesce(F.col("said") == F.get(words(F.col("answer")), F.lit(0)), F.lit(False))
    return accuracy(judged.withColumn("correct", right), ["context_len"])


def copied_words(cases: DataFrame, count: int) -> DataFrame:
    """The ``count`` words that followed the latest earlier use of the prompt's last word.

    Stands in for greedy generation in checks; gives ``(case_id, context_len, text)``.
    """
    n = F.size("prompt")
    places = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    latest = F.array_max(F.filter(places, lambda i: F.get("prompt", i) == F.element_at("prompt", -1)))
    said = F.slice("prompt", F.coalesce(latest, n - 1) + 2, F.lit(count))
    return cases.select("case_id", "context_len", F.array_join(said, " ").alias("text"))


def answer_found(cases: DataFrame, generated: DataFrame) -> DataFrame:
    """By context length: the answer must occur somewhere in the generated text."""
    judged = cases.select("case_id", "context_len", "answer").join(generated, ["case_id", "context_len"], "left")
    found = F.contains(F.coalesce("text", F.lit("")), F.col("answer"))
    return accuracy(judged.withColumn("correct", found), ["context_len"])
