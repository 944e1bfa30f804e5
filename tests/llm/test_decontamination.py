"""Positional index against a plain search for windows."""

import random

import pytest

from weftline.llm import decontamination as D


def plain(texts, items, size=13):
    cut = lambda t: "".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() or c.isdigit() else " " for c in t or "").split(" ")
    split = lambda t: [w for w in cut(t) if w]
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((len(w), sorted(hit), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    some = lambda n: " ".join(rng.choice(["a", "b", "c", "d", "é1", "x9"]) for _ in range(n))
    template = some(30)
    many = [f"{some(5)}, {template.upper()}! {some(rng.randrange(0, 40))}" for _ in range(60)]
    return template, [None, "", " .. ", *many, many[0], some(20_000), "a b", template, "a " * 50]


def check(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, items string, block int").repartition(3)
    rows = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, set string")
    got = D.contamination(docs, rows).collect()
    assert [(r.n_words, r.hit, r["items"]) for r in sorted(got, key=lambda r: r.doc_id)] == plain(texts, items)


def test_many_items_of_one_template(spark, texts, monkeypatch):
    template, texts = texts
    items = [*[(k, f"{template} q{k}") for k in range(150)], *[(500 + k, template) for k in range(50)], (7, template), (None, "a a a"), (900, "A b"), (901, None), (902, "")]
    check(spark, texts, items)
    windows, sets = D.window_sets(D.test_windows(spark.createDataFrame([(k, template) for k in range(200)], "item_id bigint, text string")))
    assert windows.count() == 18 and sets.count() == 1
    monkeypatch.setattr(D, "PLACES", 50)
    monkeypatch.setattr(D, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(D, "SLICE_BYTES", 500)
    check(spark, texts, items)


def test_empty_tables(spark, texts):
    check(spark, [], [(1, "a b")])
    check(spark, texts[1][:6], [])
