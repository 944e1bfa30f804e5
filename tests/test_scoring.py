"""Request building and score folding on tiny inputs with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.operators import bigrams as G
from weftline.operators import generators as A
from weftline.operators import corpus as C
from weftline.operators import requests as R
from weftline.operators import scoring as X
from weftline.operators import tasks as K


def test_last_word_split(spark):
    items = spark.createDataFrame([(1, "a b c"), (2, "abc"), (3, "a ")], "item_id long, text string")
    got = {r.request_id: (r.context, r.continuation) for r in R.last_word_requests(items).collect()}
    assert got == {1: ("a b", " c"), 3: ("a", " ")}


def test_endings_questions_and_blanks(spark):
    items = spark.createDataFrame([(1, "c", ["x", " y"], "1")], "item_id long, ctx string, endings array<string>, label string")
    rows = R.ending_requests(items).orderBy("choice_idx").collect()
    assert [(r.continuation, r.label) for r in rows] == [("x", 1), (" y", 1)]

    keyed = [(1, "q", (["a", "b", "c"],), k) for k in ("A", "4", "E", "D")]
    keyed = [(i, q, (["a", "b", "c", "d"],) if k == "4" else c, k) for i, (_, q, c, k) in enumerate(keyed)]
    items = spark.createDataFrame(keyed, "item_id long, question string, choices struct<text: array<string>>, answerKey string")
    assert {r.item_id: r.label for r in R.labelled_questions(items).collect()} == {0: 0, 1: 3}
    assert R.question_requests(items).where("item_id = 0 AND choice_idx = 2").first().continuation == " c"

    blanks = spark.createDataFrame([(1, "_ saw _", "X", "Y", "2")], "item_id long, sentence string, option1 string, option2 string, answer string")
    rows = R.blank_requests(blanks).orderBy("choice_idx").collect()
    assert [(r.text, r.label) for r in rows] == [("X saw X", 1), ("Y saw Y", 1)]


def test_turns(spark):
    rows = [(1, 0, "user", "u"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (2, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in R.turn_requests(turns).collect()] == [("1:1", "u", "a")]


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id string, ctx_ids array<int>, cont_ids array<int>")


def positions(spark, rows, limit):
    got = {}
    for r in X.continuation_targets(requests(spark, rows), limit).collect():
        got.setdefault(r.request_id, []).append((r.pos, r.prev, r.token))
    return {k: sorted(v, key=str) for k, v in got.items()}


def test_truncation_keeps_the_tail_and_negative_positions_are_dropped(spark):
    long = list(range(3000))
    got = positions(spark, [("a", long[:2999], long[2999:])], 2048)
    assert got == {"a": [(0, 2998, 2999)]}
    # no context: the first continuation token has nothing before it
    assert positions(spark, [("b", [], [5, 6, 7])], 2048) == {"b": [(1, 5, 6), (2, 6, 7)]}
    # a continuation longer than the window keeps its last positions
    assert positions(spark, [("c", [1, 2], [3, 4, 5, 6])], 3) == {"c": [(2, 4, 5), (3, 5, 6)]}
    # no continuation: one empty row
    assert positions(spark, [("d", [1, 2], [])], 3) == {"d": [(None, None, None)]}


def test_folding_with_a_callers_scorer(spark):
    frame = requests(spark, [("a", [1], [2, 3]), ("b", [1, 2], []), ("c", [1], [9])])

    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        rows = [
            (r.request_id, i, int(t), -1.0 * (i + 1), int(t) if t != 9 else 4)
            for r in batch.itertuples()
            for i, t in enumerate(r.cont_ids)
        ]
        extra = [("a", 0, 77, -9.0, 77)]
        return pd.DataFrame(rows + extra, columns=["request_id", "pos", "token", "logprob", "argmax_token"])

    scores = X.score_with(frame.coalesce(1), scorer)
    got = X.request_scores(X.gather_scores(X.continuation_targets(frame), scores))
    rows = {r.request_id: (r.ll, r.is_greedy, r.n_expected, r.n_scored) for r in got.collect()}
    assert rows == {"a": (-3.0, True, 2, 2), "b": (0.0, True, 0, 0), "c": (-1.0, False, 1, 1)}


def test_padded_batches_have_a_bound_and_lose_no_row():
    lengths = np.array([1, 2, 2, 3, 9, 9, 40])
    parts = list(X.padded_batches(lengths, 18))
    assert [(p.start, p.stop) for p in parts] == [(0, 4), (4, 6), (6, 7)]
    assert list(X.padded_batches(np.array([], int), 18)) == []


@pytest.mark.parametrize("batch_ids", [1, 12, 65_536])
def test_a_callers_model_on_padded_batches(spark, batch_ids):
    rows = [("a", [1], [2, 3]), ("b", [1, 2], []), ("c", [], [9, 8]), ("d", [], [7]), ("e", [4] * 9, [5, 6, 7]), ("f", None, [1]), ("g", [], [])]
    frame = requests(spark, rows)

    def load():
        def model(ids, lengths):
            before = np.cumsum(ids, axis=1) - ids  # a score that needs all ids before
            assert all((row[n:] == 99).all() for row, n in zip(ids, lengths, strict=True))
            return -before.astype(float), ids * 2

        return model

    for cap in (None, 4):
        scores = X.score_padded(frame.coalesce(1), load, cap, batch_ids, 99)
        got = {(r.request_id, r.pos): (r.token, r.logprob, r.argmax_token) for r in scores.collect()}
        want = {}
        for name, ctx, cont in rows:
            ids = (ctx or []) + cont if ctx is not None else []
            ids = ids[-cap:] if cap else ids
            begin = len(ids) - len(cont)
            want |= {(name, i - begin): (ids[i], -float(sum(ids[:i])), 2 * ids[i]) for i in range(max(begin, 1), len(ids))}
        assert got == want
        found = X.request_scores(X.gather_scores(X.continuation_targets(frame, cap), scores)).collect()
        assert {r.request_id for r in found} == {r[0] for r in rows}


def test_normalisation_and_ties(spark):
    scores = spark.createDataFrame(
        [(1, 0, 1, -1.0), (1, 1, 1, -0.5), (1, 2, 1, -0.5)], "item_id long, choice_idx int, label int, score double"
    )
    row = X.chosen(scores).first()
    assert (row.picked, row.correct) == (1, True)
    blank = spark.createDataFrame([(-3.0, 3)], "ll double, n_expected long")
    assert X.per_token(blank, extra=1).first().score == -0.75
    assert X.per_token(spark.createDataFrame([(0.0, 0)], "ll double, n_expected long")).first().score == 0.0


def test_short_texts_score_zero(spark):
    texts = spark.createDataFrame([("a", [5]), ("b", [5, 6])], "request_id string, ids array<int>")
    model = G.Bigrams(spark.createDataFrame([(5, 6, 3)], "prev int, token int, n long"))
    got = X.perplexity_of(X.request_scores(G.bigram_scores(X.rolling_targets(texts), model)))
    rows = {r.request_id: r for r in got.collect()}
    assert (rows["a"].ll, rows["a"].n_scored, rows["a"].perplexity) == (0.0, 0, None)
    assert rows["b"].n_scored == 1 and abs(rows["b"].perplexity - (3 + model.size) / 4) < 1e-6


def test_hot_pairs_score_like_all_others(spark):
    """One pair makes up most of the corpus; the salted path must give the plain counts."""
    rows = [(i, 3, [2, 3, 0]) for i in range(3000)] + [(5000 + i, 4, [2, 4 + i % 50, 5, 0]) for i in range(300)]
    encoded = spark.createDataFrame(rows, "doc_id long, n_tokens long, ids array<int>")
    model = G.fit_bigrams(encoded)
    targets = X.rolling_targets(G.open_ids(encoded).withColumnRenamed("doc_id", "request_id"))
    got = G.bigram_scores(targets, model).groupBy("prev", "token").agg(
        F.first("logprob").alias("lp"), F.first("argmax_token").alias("best"), F.count("*").alias("n"), F.count_distinct("logprob").alias("kinds")
    )
    pairs = {}
    for _, _, ids in rows:
        for p, t in zip(ids[:-2], ids[1:-1]):
            pairs[p, t] = pairs.get((p, t), 0) + 1
    import math

    for r in got.collect():
        total = sum(n for (p, _), n in pairs.items() if p == r.prev)
        best = min((-n, t) for (p, t), n in pairs.items() if p == r.prev)[1]
        assert r.n == pairs[r.prev, r.token] and r.kinds == 1 and r.best == best
        assert abs(r.lp - math.log((r.n + 1) / (total + model.size))) < 1e-12


def test_accuracy_of_absent_tasks_is_zero(spark):
    rows = spark.createDataFrame([("x", True), ("x", False)], "task string, correct boolean")
    got = {r.task: (r.total, r.accuracy) for r in X.accuracy_of_tasks(rows, ["x", "y"]).collect()}
    assert got == {"x": (2, 0.5), "y": (0, 0.0)}
    assert X.accuracy(rows.limit(0)).first().accuracy == 0.0


def test_generated_text_is_searched(spark):
    cases = spark.createDataFrame([(1, 9, "42"), (2, 9, "42"), (3, 9, "42")], "case_id long, context_len int, answer string")
    texts = spark.createDataFrame([(1, 9, "it is 42 ."), (2, 9, "4 2")], "case_id long, context_len int, text string")
    assert A.answer_found(cases, texts).first().asDict() == {"context_len": 9, "total": 3, "n_correct": 1, "accuracy": 1 / 3}


def test_all_five_tasks(spark):
    """A scorer that knows one sentence solves the items made from it."""
    docs = spark.createDataFrame([(0, "the cat saw a dog . the code is ALPHA .")], "doc_id long, text string")
    encode = C.native_encoder(C.vocabulary(docs))
    model = G.fit_bigrams(C.encoded_corpus(docs, encode))
    case = "case_id long, context_len int, prompt array<string>, answer string"
    inputs = {
        "lambada": spark.createDataFrame([(1, "saw a dog"), (2, "saw a cat"), (3, "dog")], "item_id long, text string"),
        "niah": spark.createDataFrame([(1, 9, ["code", "is"], "ALPHA beta")], case),
        "hellaswag": spark.createDataFrame([(1, "the cat", [" saw", " dog"], "0")], "item_id long, ctx string, endings array<string>, label string"),
        "arc_easy": spark.createDataFrame([(1, "saw a", (["cat", "dog"],), "B"), (2, "saw", (["a"],), "E")], "item_id long, question string, choices struct<text: array<string>>, answerKey string"),
        "winogrande": spark.createDataFrame([(1, "the cat saw a _", "dog", "cat", "1")], "item_id long, sentence string, option1 string, option2 string, answer string"),
    }
    rows = K.evaluate(inputs, encode, lambda targets: G.bigram_scores(targets, model)).collect()
    assert {r.task: (r.total, r.accuracy) for r in rows} == {
        "lambada": (2, 0.5), "niah": (1, 1.0), "hellaswag": (1, 1.0), "arc_easy": (1, 1.0), "winogrande": (1, 1.0),
    }
    few = K.evaluate(inputs, encode, lambda targets: G.bigram_scores(targets, model), ["niah"]).collect()
    assert {r.task: r.total for r in few} == {"niah": 1}
    one = {"niah": inputs["niah"]}
    few = K.evaluate(one, encode, lambda targets: G.bigram_scores(targets, model), ["niah", "lambada"]).collect()
    assert {r.task: r.total for r in few} == {"niah": 1, "lambada": 0}
    with pytest.raises(ValueError, match="piqa"):
        K.evaluate(inputs, encode, lambda targets: G.bigram_scores(targets, model), ["niah", "piqa"])


def test_top_token_ties(spark):
    rows = [("a", 0, 7, -1.0), ("a", 0, 3, -1.0), ("a", 0, 9, -2.0)]
    frame = spark.createDataFrame(rows, "request_id string, pos int, token int, logprob double")
    assert X.top_tokens(frame).first().argmax_token == 3


def test_distractors_come_from_other_items(spark):
    items = spark.createDataFrame([(i, f"c w{i}") for i in range(9)], "item_id long, text string")
    for r in R.with_distractors(items, 3, 5).collect():
        own = f"w{r.item_id}"
        assert len(r.choices) == 4 and r.choices[r.label] == own and r.choices.count(own) == 1
    assert C.VOCABULARY_SIZE - 1 <= C.LARGEST_ID


@pytest.mark.parametrize("sent", [0, 3, 500_000])
def test_rolling_scores_equal_the_rows_of_the_scorer(spark, monkeypatch, sent):
    monkeypatch.setattr(G, "PAIRS_SENT", sent)
    monkeypatch.setattr(C, "TOKENS_AT_ONCE", 5)
    docs = [[(i * j) % 7 for j in range(i % 11)] + [0] for i in range(40)]
    model = G.fit_bigrams(spark.createDataFrame([(i, len(d), d) for i, d in enumerate(docs)], "doc_id long, n_tokens long, ids array<int>"))
    counted = {}
    for d in docs:
        for pair in zip(d[:-1], d[1:-1], strict=False):
            counted[pair] = counted.get(pair, 0) + 1
    assert {(r.prev, r.token): r.n for r in model.pairs.collect()} == counted
    texts = spark.createDataFrame([(0, []), (1, [3]), (2, [1, 2, 99, 1]), (2, [5, 5]), (3, [2, 4, 6, 1, 3, 5, 0, 0] * 3)], "request_id long, ids array<int>")
    for longest in (None, 4):
        plain = X.request_scores(G.bigram_scores(X.rolling_targets(texts, longest), model))
        want = {r.request_id: (round(r.ll, 9), r.n_scored) for r in plain.collect()}
        assert {r.request_id: (round(r.ll, 9), r.n_scored) for r in G.rolling_scores(texts, model, longest).collect()} == want
