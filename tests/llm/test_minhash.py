"""Families of texts that share a template: split without losing a link."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import common, minhash


def words(rng, n):
    return [f"{rng.randrange(10**6)}" for _ in range(n)]


def template_texts(rng, n):
    """``n`` texts with one template of 100 words and 120 of their own, every tenth followed by a near copy."""
    template, texts = words(rng, 100), []
    for i in range(n):
        own = words(rng, 120)
        texts.append(" ".join(own[:60] + template + own[60:]))
        if i % 10 == 0:
            own[30] = "edited"
            texts.append(" ".join(own[:60] + template + own[60:]))
    return texts


def bag(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def test_prefixes_share_a_key_of_similar_sets():
    rng = np.random.default_rng(3)
    frequent = np.sort(rng.choice(2**40, 30, replace=False)).astype(np.uint64)
    often = rng.integers(1, 99, 30)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = np.unique(np.concatenate([rng.choice(frequent, n // 2, replace=False) if n // 2 <= 30 else frequent, rng.integers(0, 2**40, n).astype(np.uint64)]))
        swapped = rng.permutation(x)[int(rng.integers(0, len(x) // 9 + 1)) :]
        y = np.unique(np.append(swapped, rng.integers(0, 2**40, len(x) - len(swapped)).astype(np.uint64)))
        both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        if 5 * both >= 4 * union:
            assert len(np.intersect1d(minhash.prefix(x, frequent, often), minhash.prefix(y, frequent, often)))


def test_texts_of_one_template_are_not_all_compared(spark, monkeypatch):
    texts = template_texts(random.Random(8), 600)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    sizes = []
    whole = minhash.split_families

    def watched(members, families):
        out = common.stage(whole(members, families), "watched")
        for rows in (families, out):
            sizes.append(rows.groupBy("family").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0)
        return out

    monkeypatch.setattr(minhash, "split_families", watched)
    monkeypatch.setattr(minhash, "BLOCK", 100)
    got = dict(minhash.near_duplicates(docs).collect())
    assert sizes[0] > 100_000  # one family of most of them, were it compared as it is
    assert sizes[1] <= 4 * len(texts)
    bags = [bag(t) for t in texts]
    for i in range(len(texts)):
        j = got[i]
        if i != j:
            both = (bags[i] & bags[j]).total()
            assert 5 * both >= 4 * (bags[i].total() + bags[j].total() - both)
    assert [i for i in got if got[i] != i] == [i for i in got if i and "edited" in texts[i]]


def test_large_groups_of_copies_stay_whole(spark, monkeypatch):
    rng = random.Random(9)
    base, rows = words(rng, 200), []
    for i in range(150):
        own = list(base)
        own[i] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(words(rng, 30))) for i in range(20)]
    monkeypatch.setattr(minhash, "BLOCK", 40)
    got = dict(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == {i: 0 if i < 1000 else i for i, _ in rows}
