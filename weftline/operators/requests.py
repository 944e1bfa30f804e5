"""Benchmark items to scoring requests.

A request is ``(request_id, context, continuation)``; a choice request also carries ``item_id``,
``choice_idx`` and ``label``. Each task shape differs in how the continuation text is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.draws import draw
from weftline.operators.corpus import Encoder
from weftline.operators.prefix import running_rank

# Fixed value: longest request the published scorers take; the tail is kept.
MAX_LENGTH = 2048


def last_word_requests(items: DataFrame) -> DataFrame:
    """``(item_id, text)``: predict the last word; items without a space are skipped."""
    text = F.col("text")
    return items.where(T.has_last_word(text)).select(
        F.col("item_id").alias("request_id"),
        T.before_last_word(text).alias("context"),
        F.concat(F.lit(" "), T.last_word(text)).alias("continuation"),
    )


def _per_choice(items: DataFrame, context: str, continuation) -> DataFrame:
    return items.select(
        "item_id", "label", F.col(context).alias("context"), F.posexplode("choices").alias("choice_idx", "choice")
    ).select(
        F.concat_ws(":", F.col("item_id").cast("string"), F.col("choice_idx").cast("string")).alias("request_id"),
        "item_id",
        "choice_idx",
        "label",
        "context",
        continuation(F.col("choice")).alias("continuation"),
    )


def ending_requests(items: DataFrame) -> DataFrame:
    """``(item_id, ctx, endings, label)``: the ending follows as it is."""
    shaped = items.select("item_id", "ctx", F.col("endings").alias("choices"), F.try_to_number("label", F.lit("999")).cast("int").alias("label"))
    return _per_choice(shaped, "ctx", lambda choice: choice)


def with_valid_label(keyed: DataFrame, n_choices: Column) -> DataFrame:
    """Add ``label`` from ``answerKey``; rows whose key is unknown or names no choice are left out."""
    return keyed.withColumn("label", T.answer_index(F.col("answerKey"))).where(
        F.col("label").between(F.lit(0), n_choices - 1)
    )


def labelled_questions(items: DataFrame) -> DataFrame:
    """``(item_id, question, choices, label)``: items whose answer key names an existing choice."""
    return with_valid_label(items, F.size("choices.text")).select(
        "item_id", "question", F.col("choices.text").alias("choices"), "label"
    )


def question_requests(items: DataFrame) -> DataFrame:
    """``(item_id, question, choices.text, answerKey)``: a space, then the choice."""
    return _per_choice(labelled_questions(items), "question", lambda choice: F.concat(F.lit(" "), choice))


def blank_requests(items: DataFrame) -> DataFrame:
    """``(item_id, sentence, option1, option2, answer)``: whole sentences with every blank filled."""
    shaped = items.select(
        "item_id",
        "sentence",
        F.array("option1", "option2").alias("choices"),
        (F.col("answer").cast("int") - 1).alias("label"),
    )
    each = shaped.select("item_id", "label", "sentence", F.posexplode("choices").alias("choice_idx", "option"))
    return each.select(
        F.concat_ws(":", F.col("item_id").cast("string"), F.col("choice_idx").cast("string")).alias("request_id"),
        "item_id",
        "choice_idx",
        "label",
        T.fill_blank(F.col("sentence"), F.col("option")).alias("text"),
    )


def turn_requests(conversations: DataFrame) -> DataFrame:
    """Each user turn as context, the assistant turn right after it as continuation."""
    asked = conversations.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context")
    )
    answered = conversations.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("continuation"))
    pairs = asked.join(answered, ["conv_id", "turn"])
    return pairs.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        "context",
        "continuation",
    )


def with_distractors(items: DataFrame, count: int, seed: int) -> DataFrame:
    """Last-word items as multiple choice: the true last word among ``count`` from other items.

    Each other word is fetched by a drawn position, an equi-join; gives
    ``(item_id, ctx, choices, label)``.
    """
    base = items.where(T.has_last_word(F.col("text"))).select(
        "item_id", T.before_last_word(F.col("text")).alias("ctx"), T.last_word(F.col("text")).alias("word")
    )
    return _among_others(base, count, seed)


def with_other_endings(items: DataFrame, count: int, seed: int) -> DataFrame:
    """Items as a choice of endings: the second half of their words among ``count`` second halves of other items.

    Gives ``(item_id, ctx, endings, label)``, the label as text; an ending begins with its blank.
    """
    split = items.select("item_id", F.split("text", " ").alias("w")).where(F.size("w") > 1)
    half = F.expr("size(w) div 2")
    base = split.select(
        "item_id",
        F.array_join(F.slice("w", F.lit(1), half.cast("int")), " ").alias("ctx"),
        F.concat(F.lit(" "), F.array_join(F.slice("w", (half + 1).cast("int"), F.size("w")), " ")).alias("word"),
    )
    listed = _among_others(base, count, seed)
    return listed.select("item_id", "ctx", F.col("choices").alias("endings"), F.col("label").cast("string").alias("label"))


def _among_others(base: DataFrame, count: int, seed: int) -> DataFrame:
    n = base.count()
    ranked = running_rank(base, "item_id", "place")
    slots = ranked.select(
        "item_id",
        "place",
        (draw(seed, F.col("item_id"), "label") % (count + 1)).cast("int").alias("label"),
        F.explode(F.sequence(F.lit(0), F.lit(count))).alias("slot"),
    )
    away = F.lit(1) + draw(seed, F.col("item_id"), F.col("slot")) % max(n - 1, 1)
    wanted = F.when(F.col("slot") == F.col("label"), F.col("place")).otherwise((F.col("place") + away) % max(n, 1))
    words = ranked.select(F.col("place").alias("wanted"), "word")
    chosen = slots.withColumn("wanted", wanted).join(words, "wanted").groupBy("item_id", "label").agg(
        F.sort_array(F.collect_list(F.struct("slot", "word"))).alias("pairs")
    )
    listed = chosen.select("item_id", "label", F.transform("pairs", lambda p: p["word"]).alias("choices"))
    return listed.join(base.select("item_id", "ctx"), "item_id")


def encode_requests(requests: DataFrame, encode: Encoder) -> DataFrame:
    """Add ``ctx_ids`` and ``cont_ids``; the two texts are encoded separately."""
    return requests.withColumn("ctx_ids", encode.ids(F.col("context"))).withColumn(
        "cont_ids", encode.ids(F.col("continuation"))
    ).drop("context", "continuation")
