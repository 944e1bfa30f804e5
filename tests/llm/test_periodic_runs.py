"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from weftline.llm import periodic_runs as R


def plain(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        s = 0
        while s < n - q:
            e = s
            while e < n - q and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(12, 2 * q):
                found.setdefault((s, e + q - s), q)
            s = max(e, s) + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def kept(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    some = lambda n, of: [rng.choice(of) for _ in range(n)]
    fibonacci = ["a", "a b"]
    while len(fibonacci[-1]) < 1200:
        fibonacci.append(fibonacci[-1] + " " + fibonacci[-2])
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(3000))
    period = some(230, "abcdefghij")
    long = some(300, "xyz") + period * 9 + some(77, "xyz") + ["é"] * 900 + period[:100] * 2
    return [
        None, "", " \n\t ", "a", "a " * 11, "a\n" * 12, "a b " * 6, "a b " * 5, "a b c " * 4 + "a b",
        *[" ".join(some(rng.randrange(20, 400), of)) for of in ("ab", "abc", "ab", "abcd")],
        fibonacci[-1], " ".join(morse), " ".join(long), " ".join(some(200, "ab") * 3), " ".join(long), "ü  ü" + " ü" * 40,
    ]


def check(spark, texts, **of):
    rows = [(i, t, "r", "q") for i, t in enumerate(texts)] + [(None, texts[8], "r", "q"), (8, texts[8], "r", "q")]
    got = R.collapse_runs(spark.createDataFrame(rows, "doc_id bigint, text string, runs string, k1 string"), **of)
    result = sorted(((r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.text) for r in got.collect()), key=str)
    want = []
    for i, t, *_ in rows:
        words = (t or "").split()
        runs = plain(words)
        want.append((i, len(words), sorted(runs, key=lambda x: (x[0], x[2])), kept(words, runs)))
    assert result == sorted(want, key=str)
    return got


def test_runs_equal_a_plain_search(spark, texts):
    got = check(spark, texts)
    rows = {r.doc_id: r for r in R.digest(got.where("doc_id IS NOT NULL")).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        runs = sorted(plain(words), key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (rows[i].n_runs, rows[i].start, rows[i].length, rows[i].period) == (len(runs), *best)
        assert rows[i].exponent_milli == (best[1] and 1000 * best[1] // best[2])
        assert rows[i].runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert rows[i].collapsed_sha256 == hashlib.sha256(kept(words, runs).encode()).hexdigest()


def test_small_tiles_dealt_tiles_and_shuffled_runs_give_the_same(spark, texts, monkeypatch):
    monkeypatch.setattr(R, "TILE", 16)
    check(spark, texts)
    check(spark, texts, long=50)
    monkeypatch.setattr(R, "PAIRS", 100)
    monkeypatch.setattr(R, "SENT_BYTES", 0)
    check(spark, texts[:14], long=0)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert R.digest(R.collapse_runs(empty)).count() == 0
    assert R.with_periods(empty).count() == 0


def test_contract_texts(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 50))) for i in range(300)] + [(None, "a b"), (7, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text.split()) for r in R.with_periods(docs).collect())
    want = []
    for r in docs.collect():
        w = (r.text or "").split()
        h = zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        want.append((r.doc_id if r.doc_id is not None else -1, w))
    assert got == sorted(want)


def test_tiles_cover_texts_with_enough_overlap():
    n = np.array([0, 5, 12, 5000, 100_000])
    for octave in (1, 64, 1024, 4096):
        text, first, end = R.tiles(n, octave)
        for t in np.unique(text):
            a, b = first[text == t], end[text == t]
            assert a[0] == 0 and b[-1] == n[t] and (b[:-1] - a[1:] == 4 * octave).all()
