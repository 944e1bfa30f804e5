"""Secrets: base findings by a plain scan, and secrets without a pattern that only the network can find."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import secrets as S

LETTERS = string.ascii_letters + string.digits
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]+"), 0, 24),
}


def plain_base(text):
    found = [(m.start(), list(PATTERNS).index(k), m.end(), k) for k, (p, g, least) in PATTERNS.items() for m in p.finditer(text or "") if len(m[g]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def drawn(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


PLANTED = {
    "forge": lambda r: "ghp_" + drawn(r, LETTERS, 36),
    "payment": lambda r: "sk_live_" + drawn(r, LETTERS, 24),
    "jwt": lambda r: "eyJhbGciOiJIUzI1NiJ9." + drawn(r, LETTERS + "-_", 60) + "." + drawn(r, LETTERS + "-_", 43),
    "key line": lambda r: drawn(r, LETTERS + "+/", 64),
    "random": lambda r: drawn(r, LETTERS, 40),
}


def prose(rng, n):
    def one():
        word = drawn(rng, "abcdefghilmnoprstuéü", rng.randrange(2, 12))
        kind = rng.randrange(60)
        if kind == 0:
            return drawn(rng, string.digits, 16)
        if kind == 1:
            return f"{word}.{rng.randrange(99)}@mail.example.com"
        if kind == 2:
            return ".".join(str(rng.randrange(256)) for _ in range(4))
        if kind == 3:
            return f"+1 ({rng.randrange(999):03}) 555-{rng.randrange(9999):04}"
        return word + "$$$" if kind == 4 else word.upper() + "!!" if kind == 5 else word.capitalize() + "," if kind == 6 else word

    return " ".join(one() for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    """(doc_id, text) and, of the planted documents, the span of the secret that no pattern explains."""
    rng = random.Random(11)
    rows, spans = [], {}
    for i in range(900):
        before, behind = prose(rng, rng.randrange(5, 60)), prose(rng, 20)
        if i % 6 == 0:
            rows.append((i, f'{before} token = "{drawn(rng, "0123456789abcdef", 40)}" {behind}'))
        elif i % 6 == 1:
            value = list(PLANTED.values())[i // 6 % len(PLANTED)](rng)
            while plain_base(value):
                value = list(PLANTED.values())[i // 6 % len(PLANTED)](rng)
            rows.append((i, f"{before} {value} {behind}"))
            spans[i] = (len(before) + 1, len(before) + 1 + len(value))
        else:
            rows.append((i, f"{before} {behind}"))
    return rows, spans


def test_secrets_without_a_pattern_are_found(spark, planted):
    rows, spans = planted
    extra = [(None, rows[0][1]), (0, rows[0][1]), (-1, None), (-2, ""), (-3, prose(random.Random(2), 200_000))]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows + extra], "doc_id bigint, text string, window string, spans string")
    got = S.find_secrets(docs.repartition(7)).collect()
    assert len(got) == len(rows) + len(extra)
    texts, found, wrong = dict(rows + extra), 0, 0
    for r in got:
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in base.split(",")) for k in PATTERNS)
        every = r.spans.split(",") if r.spans else []
        assert [x for x in every if not x.startswith("model")] == (base.split(",") if base else [])
        assert [int(x.split(":")[1]) for x in every] == sorted(int(x.split(":")[1]) for x in every)
        model = [tuple(map(int, x.split(":")[1:])) for x in every if x.startswith("model")]
        found += spans.get(r.doc_id) in model
        wrong += sum(m != spans.get(r.doc_id) for m in model)
    assert found >= 0.9 * len(spans)
    assert wrong <= 0.02 * len(rows)


def test_the_threshold_is_that_of_recall_alone(planted):
    rows, _ = planted
    labelled = {True: [], False: []}
    for _, text in rows:
        findings = S._findings(text)
        labelled[True] += [S.window(text, v, b) for _, _, b, v in findings]
        labelled[False] += [S.window(text, a, b) for a, b in S.candidates(text, findings) if S._HARMLESS.fullmatch(text, a, b)]
    net = S.train(labelled[True], labelled[False])
    held = S._forms(labelled[True][::4], labelled[False][::4])
    scores = net.scores(held)
    assert (scores >= net.threshold).mean() >= S.RECALL and net.threshold in scores
    # a middling calibrated score means about even odds among held-out windows
    every = np.concatenate([scores, net.scores(labelled[False][::4])])
    assert abs(every.mean() - len(scores) / len(every)) < 0.05


def test_without_labels_only_base_findings(spark):
    for texts in (["a b c", None], ['password = "' + "zx81" * 3 + '"'], ["9" * 20, "8" * 30]):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
        assert {r.doc_id: r.spans for r in S.find_secrets(docs).collect()} == {i: plain_base(t) for i, t in enumerate(texts)}
    assert S.find_secrets(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_scores_do_not_depend_on_stretches_or_neighbours(monkeypatch):
    rng = random.Random(3)
    long = "".join(rng.choice(LETTERS + "é日") for _ in range(5000))
    windows = [S.window(t, 3, len(t) - 2) for t in (long, "ab12cd34ef56", long[:300], "über-größe", "x" * 40)]
    net = S.CharNet()
    together = net.scores(windows)
    monkeypatch.setattr(S, "_STRETCH", 97)
    np.testing.assert_allclose(net.scores(windows), together, rtol=1e-4)


def test_gradients():
    rng = random.Random(4)
    windows = [S.window(t, 2, len(t) - 3) for t in (drawn(rng, LETTERS + "é_", n) for n in (12, 30, 50))]
    y, share, net = np.array([1.0, 0.0, 1.0]), np.array([0.7, 1.0, 0.4]), S.CharNet()
    grads = net._gradients(windows, y, share)

    def loss():
        z = net._logits(windows, net._table())
        return float((share * (np.logaddexp(0, z) - y * z)).mean())

    for k, w in enumerate(net.w):
        steepest = np.argsort(-np.abs(grads[k]).ravel())[:5]
        for at in steepest:
            place = np.unravel_index(at, w.shape)
            kept, sides = w[place], []
            for step in (1e-6, -1e-6):
                w[place] = kept + step
                sides.append(loss())
            w[place] = kept
            assert abs((sides[0] - sides[1]) / 2e-6 - grads[k][place]) < 1e-4 * max(1.0, abs(grads[k][place]))


def test_candidates_are_not_plain_words():
    text = "Überraschung! GESCHICHTE erzählung... Tr0ub4dor&3 correcthorse_battery aB3dE6gH9 kurz1 ÉCOLES!! " + "q" * 40
    assert [text[a:b] for a, b in S.candidates(text, [])] == ["Tr0ub4dor&3", "correcthorse_battery", "aB3dE6gH9", "q" * 40]
    at = text.index("aB3")
    assert (at, at + 9) not in list(S.candidates(text, [(at + 8, 2, at + 20, at + 8)]))


def test_all_labelled_windows_are_learnt_from_or_held_out(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(S, "PART", 700)
    made = [(True, f"{i}", S.window(f"token = {drawn(rng, LETTERS, 24)} and", 8, 32)) for i in range(300)]
    made += [(False, f"{i}", S.window(f"see the {drawn(rng, 'abcdefgh', 9)}-{drawn(rng, 'abcdefgh', 9)} here", 8, 27)) for i in range(2500)]
    labelled = spark.createDataFrame([(k, zlib.crc32(w.encode()), w) for k, _, w in made], "known boolean, mark bigint, window string")
    parts = labelled.withColumn("held", F.col("mark") % 4 == 0).withColumn("part", F.col("mark") % 5).groupBy("part")
    sent = spark.sparkContext.broadcast(S.CharNet().flat())
    passed = parts.applyInArrow(S._pass(sent, 0.5, 2), "w array<double>, n bigint").agg(F.sum("n")).first()[0]
    learnt = labelled.where("mark % 4 != 0")
    assert passed == learnt.where("NOT known").count() + (S.WIDENED + 2) * learnt.where("known").count()
    net = S.train_all(labelled)
    secret = [w for k, _, w in made if k]
    other = [w for k, _, w in made if not k]
    assert (net.scores(secret) >= net.threshold).mean() >= 0.97
    assert (net.scores(other) >= net.threshold).mean() < 0.05
