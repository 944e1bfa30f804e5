"""Quality rules whose limits follow each language and source. DataFrame functions only.

* Every document is measured in its own row: words, symbols, repeated lines and repeated eight-word windows.
* A rule is a ratio in millionths. Its values are rounded down to eight significant bits and counted by language, source
  and value: such a count table is a quantile sketch with a relative error below 1/128 and at most 128 rows for each
  power of two. Sketches are added by adding counts, in any order and with the same result, so tasks combine them
  before the shuffle, and those of a language and of the whole corpus are sums of the sources' own.
* Quartiles come from the sketches. A source's quartile is moved towards its language's with the weight of ``OF_LANGUAGE``
  documents and towards the corpus's with that of ``OF_CORPUS``: one rule for sources of every size.
* A rule's limits lie ``REACH`` spreads outside the quartiles; the spread is the distance between the quartiles, or the
  rule's least spread if that is more. A document that is outside any limit is not kept.
* Limits are joined to the documents by language and source. Groups of a thousandth of all rows or more (a thousand at
  most) are sent to all tasks, so that none of them is one task's; the others are joined as Catalyst sees fit.

A null or empty text has no words and fails the base rule. Null languages and sources are groups of their own. Repeated rows
are measured and returned each on its own. Extra columns are not read by `judge`, and come back unchanged from `keep_passing`.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm import common

_WORDS = r"[^ \t-\r]+"
_SPACE = r"[ \t-\r]"
_SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MILLION = 1_000_000
#: Documents that a language's and the corpus's quartiles count for in a source's.
OF_LANGUAGE, OF_CORPUS = 200, 20
REACH = 3
#: Bits that a sketch keeps of a value.
BITS = 8
#: Groups with one in so many rows are joined by broadcast; there can be no more of them than this number.
HOT = 1000


@dataclass(frozen=True)
class Rule:
    """A ratio of two measures in millionths, the least spread that its limits assume, and whether low values fail too."""

    name: str
    part: str
    whole: str
    least_spread: int
    low: bool = False


RULES = (
    Rule("symbols", "n_symbols", "word_chars", 20_000),
    Rule("capitals", "n_capitals", "word_chars", 30_000),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 120_000),
    Rule("repeated_words", "n_repeat_words", "n_words", 100_000),
    Rule("word_length", "word_chars", "n_words", 500_000, low=True),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once although ``body`` looks into it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _doubled(hashes: Column, width: int) -> Column:
    """Hashes of runs twice as long: each of ``width`` words with the one that follows it."""
    return _let(hashes, lambda h: F.zip_with(h, F.slice(h, width + 1, F.size(h)), lambda a, b: F.xxhash64(a, b)))


def _windows(hashes: Column) -> Column:
    """A hash of each run of `WINDOW` words, a power of two, in text order."""
    width, out = 1, hashes
    while width < WINDOW:
        width, out = 2 * width, _doubled(out, width)
    return F.slice(out, F.lit(1), F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))  # what follows is cut off by the end


def _repeat_words(windows: Column) -> Column:
    """Words in windows that occur twice or more."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(ordered, _covered))


def _covered(ordered: Column) -> Column:
    same = lambda k, x: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
    again = F.filter(ordered, lambda x, k: same(k - 1, x) | same(k + 1, x))
    # a window covers its words up to the next repeated window's first
    steps = lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(_let(F.array_sort(F.transform(again, lambda x: x["i"])), steps), F.lit(0), lambda total, n: total + n)


def measured(docs: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """``keep`` and, for each row, the struct ``m`` of `MEASURES`."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^ \t-\r]")))
    hashes = F.transform(F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0)), lambda w: F.xxhash64(w))
    value = lambda h: {
        "n_words": F.size(h),
        "word_chars": F.length(text) - F.regexp_count(text, F.lit(_SPACE)),
        "n_symbols": F.regexp_count(text, F.lit(_SYMBOLS)),
        "n_capitals": F.regexp_count(text, F.lit("[A-Z]")),
        "n_lines": F.size(lines),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _let(_windows(h), _repeat_words),
    }
    return docs.select(*keep, _let(hashes, lambda h: F.struct(*[v.cast("long").alias(k) for k, v in value(h).items()])).alias("m"))


def ratio(rule: Rule, m: str = "m") -> Column:
    return F.expr(f"CASE WHEN {m}.{rule.whole} > 0 THEN {m}.{rule.part} * {MILLION} div {m}.{rule.whole} ELSE 0 END")


def sketches(rows: DataFrame) -> DataFrame:
    """(g1, g2, rule, v, n): how many rows of a group have a rule's value between v and the next value of `BITS` bits."""
    values = F.array(*[F.struct(F.lit(k).alias("rule"), ratio(rule).alias("v")) for k, rule in enumerate(RULES)])
    each = rows.select("g1", "g2", F.inline(values))
    shift = F.expr(f"greatest(length(bin(v)) - {BITS}, 0)")
    rounded = each.select("g1", "g2", "rule", F.call_function("shiftleft", F.call_function("shiftright", "v", shift), shift).alias("v"))
    return rounded.groupBy("g1", "g2", "rule", "v").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, groups: list[str], name: str) -> DataFrame:
    """(groups, rule, n, low, high) named by ``name``: the quartiles of each sketch."""
    by = Window.partitionBy(*groups, "rule")
    upto = F.sum("n").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rows = sketch.groupBy(*groups, "rule", "v").agg(F.sum("n").alias("n")).select(*groups, "rule", "v", upto.alias("upto"), F.sum("n").over(by).alias("all"))
    return rows.groupBy(*groups, "rule").agg(
        F.max("all").alias(f"{name}_n"),
        F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("v"))).alias(f"{name}_low"),
        F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, F.col("v"))).alias(f"{name}_high"),
    )


def limits(sketch: DataFrame) -> DataFrame:
    """(g1, g2, group_n, low, high): each group's limits as arrays in the order of `RULES`."""
    sketch = common.stage(sketch, "quality-sketches")
    own, language, corpus = _quartiles(sketch, ["g1", "g2"], "own"), _quartiles(sketch, ["g1"], "language"), _quartiles(sketch, [], "corpus")
    language = language.withColumnRenamed("g1", "of")
    rows = own.join(language.withColumnRenamed("rule", "r"), F.col("g1").eqNullSafe(F.col("of")) & (F.col("rule") == F.col("r")))
    rows = rows.drop("of", "r").join(F.broadcast(corpus), "rule")  # one row a rule

    def mixed(at: str) -> Column:
        total = f"own_n * own_{at} + {OF_LANGUAGE} * language_{at} + {OF_CORPUS} * corpus_{at}"
        return F.expr(f"({total}) div (own_n + {OF_LANGUAGE + OF_CORPUS})")

    rows = rows.select("g1", "g2", "rule", "own_n", mixed("low").alias("q1"), mixed("high").alias("q3"))
    spread = F.array(*[F.lit(rule.least_spread) for rule in RULES])[F.col("rule")]
    spread = F.greatest(F.col("q3") - F.col("q1"), spread) * REACH
    below = F.when(F.array(*[F.lit(rule.low) for rule in RULES])[F.col("rule")], F.col("q1") - spread)
    rows = rows.select("g1", "g2", "own_n", F.struct("rule", below.alias("low"), (F.col("q3") + spread).alias("high")).alias("of"))
    ordered = F.sort_array(F.collect_list("of"))
    return rows.groupBy("g1", "g2").agg(F.max("own_n").alias("group_n"), ordered["low"].alias("low"), ordered["high"].alias("high"))


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with their group's limits."""
    found = common.stage(found, "quality-limits")
    total = found.agg(F.coalesce(F.sum("group_n"), F.lit(0))).first()[0]
    large = F.col("group_n") * HOT >= total
    found = found.withColumnsRenamed({"g1": "h1", "g2": "h2"})
    same = F.col("g1").eqNullSafe(F.col("h1")) & F.col("g2").eqNullSafe(F.col("h2"))
    hot = F.broadcast(found.where(large))
    often = rows.join(hot, same)
    return often.unionByName(rows.join(hot, same, "left_anti").join(found.where(~large), same)).drop("h1", "h2", "group_n")


def _failed() -> Column:
    """Names of the rules whose limits a row is outside of."""
    outside = [F.when((ratio(r) > F.col("high")[k]) | F.coalesce(ratio(r) < F.col("low")[k], F.lit(False)), F.lit(r.name)) for k, r in enumerate(RULES)]
    return F.array_compact(F.array(*outside))


def _base_failed() -> Column:
    return (F.col("m.n_words") < 20) | (100 * F.col("m.n_repeat_words") > 30 * F.col("m.n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(id, measures, base_failed, failed_rules, kept) of each row; texts are read once."""
    keep = [F.col(id_col).alias("id"), F.col(groups[0]).alias("g1"), F.col(groups[1]).alias("g2")]
    rows = common.stage(measured(docs, keep, F.col(text_col)), "quality-measures")
    rows = _joined(rows, limits(sketches(rows))).withColumn("failed", _failed())
    return rows.select(
        F.col("id").alias(id_col),
        *[F.col(f"m.{name}") for name in MEASURES],
        _base_failed().alias("base_failed"),
        F.col("failed").alias("failed_rules"),
        (~_base_failed() & (F.size("failed") == 0)).alias("kept"),
    )


def keep_passing(docs: DataFrame, text_col: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keep = [row, F.col(groups[0]).alias("g1"), F.col(groups[1]).alias("g2")]
    found = limits(sketches(measured(docs, keep[1:], F.col(text_col))))
    rows = _joined(measured(docs, keep, F.col(text_col)), found)
    return rows.where(~_base_failed() & (F.size(_failed()) == 0)).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(common.table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_VALUES = ",\n    ".join(
    f"SELECT lang, source, {k} AS rule, {r.least_spread} AS spread, {str(r.low).lower()} AS lower, CASE WHEN {r.whole} > 0 THEN {r.part} * {MILLION} // {r.whole} ELSE 0 END AS x, r FROM m"
    for k, r in enumerate(RULES)
).replace(",\n    SELECT", "\n    UNION ALL SELECT")

OP13_SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (SELECT r, i, w[i : i + 7] AS g FROM d, unnest(range(1, len(w) - 6)) AS u(i) WHERE len(w) >= 8),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM again, unnest(range(0, 8)) AS u(k) GROUP BY r),
line AS (
    SELECT r, count(*) AS n, count(DISTINCT l) AS k FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
    SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
           coalesce(line.n, 0)::BIGINT AS n_lines, coalesce(line.n - line.k, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN rep USING (r) LEFT JOIN line USING (r)
), val AS (
    {_VALUES}
), rounded AS (SELECT *, (x >> greatest(length(bin(x)) - {BITS}, 0)) << greatest(length(bin(x)) - {BITS}, 0) AS v FROM val),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, rule ORDER BY v) AS i1, count(*) OVER (PARTITION BY lang, source, rule) AS n1,
           row_number() OVER (PARTITION BY lang, rule ORDER BY v) AS i2, count(*) OVER (PARTITION BY lang, rule) AS n2,
           row_number() OVER (PARTITION BY rule ORDER BY v) AS i3, count(*) OVER (PARTITION BY rule) AS n3
    FROM rounded
), q1 AS (SELECT lang, source, rule, any_value(spread) AS spread, any_value(lower) AS lower, max(n1) AS n, min(v) FILTER (4 * i1 >= n1) AS a, min(v) FILTER (4 * i1 >= 3 * n1) AS b FROM ranked GROUP BY ALL),
q2 AS (SELECT lang, rule, min(v) FILTER (4 * i2 >= n2) AS a, min(v) FILTER (4 * i2 >= 3 * n2) AS b FROM ranked GROUP BY ALL),
q3 AS (SELECT rule, min(v) FILTER (4 * i3 >= n3) AS a, min(v) FILTER (4 * i3 >= 3 * n3) AS b FROM ranked GROUP BY ALL),
q AS (
    SELECT q1.lang, q1.source, q1.rule, spread, lower, (n * q1.a + {OF_LANGUAGE} * q2.a + {OF_CORPUS} * q3.a) // (n + {OF_LANGUAGE + OF_CORPUS}) AS a,
           (n * q1.b + {OF_LANGUAGE} * q2.b + {OF_CORPUS} * q3.b) // (n + {OF_LANGUAGE + OF_CORPUS}) AS b
    FROM q1 JOIN q2 ON q1.lang IS NOT DISTINCT FROM q2.lang AND q1.rule = q2.rule JOIN q3 ON q1.rule = q3.rule
), bad AS (
    SELECT DISTINCT r FROM rounded v JOIN q ON v.lang IS NOT DISTINCT FROM q.lang AND v.source IS NOT DISTINCT FROM q.source AND v.rule = q.rule
    WHERE x > b + {REACH} * greatest(b - a, q.spread) OR (q.lower AND x < a - {REACH} * greatest(b - a, q.spread))
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND r NOT IN (SELECT r FROM bad) AS kept
FROM m
"""
