"""Measures against a plain count, limits against numpy's order statistics."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import quality_rules as Q

WORD = re.compile(r"[^ \t-\r]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_capitals": sum("A" <= c <= "Z" for c in text),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def rounded(x):
    e = max(x.bit_length() - Q.BITS, 0)
    return x >> e << e


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    lexicon = ["".join(rng.choice("abcdefgéß😀") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(lexicon, k=n))
    part = text(9)
    odd = [None, "", " \n\x0b ", "a", "\n\n", "x y\nx y\n\nz\nx y ", f"{part} q {part} {part}", "a " * 500, "b\n" * 9, text(20_000), "# $ %" * 30, text(8), part]
    out = [(i, t, "en", "s0") for i, t in enumerate(odd)]
    out += [(100 + i, text(rng.randrange(30, 200)) + (" ### $$$" if i % 9 == 0 else ""), ("en", "fr", None)[i % 3], (f"s{i % 4}", None)[i % 7 == 0]) for i in range(400)]
    return [*out, out[20], out[20], (None, text(50), None, None), (999, " ".join([part.upper()] * 1 + [text(60).upper()]), "en", "s1")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id bigint, text string, lang string, source string, n_words int, m string, g1 string").cache()


def verdicts(rows):
    measures = [plain(r[1]) for r in rows]
    ratio = lambda m, k: m[k.part] * Q.MILLION // m[k.whole] if m[k.whole] else 0

    def quartiles(rule, chosen):
        v = sorted(rounded(ratio(measures[i], rule)) for i in chosen)
        return len(v), v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]

    everything, out = range(len(rows)), []
    for r, m in zip(rows, measures, strict=True):
        failed = []
        for rule in Q.RULES:
            sets = [[i for i in everything if rows[i][2:] == r[2:]], [i for i in everything if rows[i][2] == r[2]], everything]
            found = [quartiles(rule, s) for s in sets]
            n = found[0][0]
            q1, q3 = [(n * found[0][k] + Q.OF_LANGUAGE * found[1][k] + Q.OF_CORPUS * found[2][k]) // (n + Q.OF_LANGUAGE + Q.OF_CORPUS) for k in (1, 2)]
            reach = Q.REACH * max(q3 - q1, rule.least_spread)
            if ratio(m, rule) > q3 + reach or (rule.low and ratio(m, rule) < q1 - reach):
                failed.append(rule.name)
        base = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
        out.append((r[0], m, base, failed, not base and not failed))
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_measures_and_verdicts(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(Q, "HOT", hot)  # with 2, most groups are joined by a shuffle
    got = [(r.doc_id, {k: r[k] for k in Q.MEASURES}, r.base_failed, r.failed_rules, r.kept) for r in Q.judge(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, verdicts(rows)))


def test_kept_rows_come_back_unchanged(docs, rows):
    want = [r[0] for r, v in zip(rows, verdicts(rows), strict=True) if v[4]]
    got = Q.keep_passing(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in got.collect())
    assert got.exceptAll(docs).count() == 0


def test_empty_table(docs):
    assert Q.judge(docs.limit(0)).count() == 0 and Q.keep_passing(docs.limit(0)).count() == 0


def test_sketches_add_up(docs):
    keep = [F.col("lang").alias("g1"), F.col("source").alias("g2")]
    whole = Q.sketches(Q.measured(docs, keep, F.col("text")))
    halves = [Q.sketches(Q.measured(docs.where(F.coalesce("doc_id", F.lit(0)) % 2 == k), keep, F.col("text"))) for k in (0, 1)]
    by = ["g1", "g2", "rule", "v"]
    merged = halves[0].unionByName(halves[1]).groupBy(*by).agg(F.sum("n").alias("n"))
    assert sorted(map(str, whole.select(*by, "n").collect())) == sorted(map(str, merged.select(*by, "n").collect()))


def test_plan_has_no_python(docs):
    plan = Q.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
