"""Secret scans: fixed patterns, and a character convolutional network over every other candidate with its context.

Patterns give the base findings, which always stay. Every other token of ``LEAST_CHARS`` characters that is no plain word
is a candidate: ``AROUND`` characters before it, the whole of it and ``AROUND`` behind it are convolved in numpy, pooled
each on its own and scored. The network learns from labelled findings of the corpus: what a pattern explains is a secret,
what is plainly a word with marks, a number or an address is not, and all else has no label and decides nothing. A
finding is shown in its own context, in one of a harmless token, and there once more in letters of a wider alphabet, so
that the string itself has to be judged and not the name before it (``WIDENED`` such forms). Every fourth finding and harmless token is held out:
they calibrate the scores (a logistic curve), and the threshold is the highest at which ``RECALL`` of held-out findings,
in all forms, stay found, whatever else passes it. All distinct findings and harmless tokens are learnt from or held out: they are dealt by
hash to parts of about ``PART``, each pass goes on from the same weights in every part, and the weights of the parts
are averaged, by Spark, into those of the next pass. Judged is every candidate of every text.

Without two findings and two harmless tokens nothing can be both learnt and held out: base findings only. Places are code
points, ends exclusive; null is empty; repeated rows give repeated results, an empty table none; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.operators.prefix import running_rank

#: The base kinds and the least length of what each one names, in order. Fixed values.
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20, "hex": 24}
_NAMES = "password|passwd|secret|token|api_?key"
_EITHER = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", _NAMES)
_ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"""[^\s"'`<>()\[\]{},;:|]{8,}""")
_WORD = r"(?:[^\W\d_a-z]?[^\W\d_A-Z]{1,30}|[^\W\d_a-z]{1,31})"
#: What is certainly no secret: words joined or followed by marks, numbers and dates, mail addresses.
_HARMLESS = re.compile(
    rf"[^\w\s]*{_WORD}(?:[^\w\s]+{_WORD})*[^\w\s]*|[^\w\s]*[0-9]+(?:[^\w\s]+[0-9]+)*[^\w\s]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+[.!?]*"
)

LEAST_CHARS, AROUND, WIDTH = 8, 24, 5
EDGE = AROUND + WIDTH // 2  # what stands beside a candidate, and nothing, so that no filter sees two windows
PART, STEPS, WIDENED = 20_000, 600, 6
RECALL = 0.99
_WIDER = ("0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-")


def _findings(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the base findings, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings, by start and then by kind."""
    return [(a, b, KINDS[kind]) for a, kind, b, _ in _findings(text)]


def _plain(token: str) -> bool:
    """Whether this is a word: up to 31 letters of one case, the first one aside."""
    word = token.rstrip(".!?")
    return word.isalpha() and len(word) <= 31 and (word.islower() or word.isupper() or word[1:].lower() == word[1:] or word.upper() == word)


def candidates(text: str, findings: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the tokens that are no plain words and that no finding overlaps."""
    at, behind = 0, 0
    for m in _TOKEN.finditer(text):
        if _plain(m[0]):
            continue
        a, b = m.span()
        while at < len(findings) and findings[at][0] < b:
            behind = max(behind, findings[at][2])
            at += 1
        if behind <= a:
            yield a, b


def joined(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def window(text: str, a: int, b: int) -> str:
    """The characters from ``a`` to ``b`` with ``AROUND`` on either side, filled up to ``EDGE``."""
    before, behind = text[max(0, a - AROUND) : a].rjust(AROUND, "\0"), text[b : b + AROUND].ljust(AROUND, "\0")
    return before.rjust(EDGE, "\0") + text[a:b] + behind.ljust(EDGE, "\0")


def _shape(code: int) -> int:
    c = chr(code)
    return 0 if code == 0 else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isspace() else 5


_TABLED = 0x250  # Latin letters with marks end here
CODES = 131  # ASCII; letters with marks, small and large; all else
_CODES = np.array([k if k < 128 else 128 if chr(k).islower() else 129 if chr(k).isupper() else 130 for k in range(_TABLED)] + [130])
_SHAPES = np.array([*map(_shape, range(128)), 1, 2, 6])
_STRETCH = 1 << 16


def _flat(windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows in a row, and where each one's three parts start."""
    codes = _CODES[np.minimum(np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32), _TABLED)]
    first = np.concatenate([[0], np.cumsum([len(w) for w in windows])])
    return codes, np.stack([first[:-1], first[:-1] + EDGE, first[1:] - EDGE], axis=1).ravel()


def _batches(order: np.ndarray, sizes: np.ndarray, batch: int) -> Iterator[np.ndarray]:
    """Stretches of ``order`` of up to ``batch`` windows and ``_STRETCH`` characters; a longer window is alone."""
    for i in range(0, len(order), batch):
        at = order[i : i + batch]
        while len(at):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at]), _STRETCH, "right")))
            yield at[:n]
            at = at[n:]


class CharNet:
    """One convolution over characters and their shapes, maxima and means of three parts, one output; trained with Adam."""

    def __init__(self, seed: int = 1, filters: int = 16):
        r = np.random.Generator(np.random.PCG64(seed))
        self.filters = filters
        self.w = [
            r.normal(0, 0.05, (WIDTH, CODES, filters)),
            r.normal(0, 0.3, (WIDTH, 7, filters)),
            np.zeros(filters),
            r.normal(0, 0.2, 6 * filters),
            np.zeros(1),
        ]
        self.curve = (1.0, 0.0)
        self.threshold = 2.0

    def _table(self) -> np.ndarray:
        return self.w[0] + self.w[1][:, _SHAPES]

    def _convolved(self, table: np.ndarray, codes: np.ndarray, s: int, e: int) -> np.ndarray:
        """The filters' outputs at the places from ``s`` to ``e``; beyond the ends there is nothing, code 0."""
        half = WIDTH // 2
        there = codes[max(s - half, 0) : e + half]
        there = np.pad(there, (max(half - s, 0), max(e + half - len(codes), 0)))
        h = np.broadcast_to(self.w[2].astype(table.dtype), (e - s, self.filters)).copy()
        for j in range(WIDTH):
            h += table[j][there[j : j + e - s]]
        return np.maximum(h, 0, out=h)

    def _logits(self, windows: list[str], table: np.ndarray) -> np.ndarray:
        codes, starts = _flat(windows)
        most, total = np.zeros((len(starts), self.filters)), np.zeros((len(starts), self.filters))
        for s in range(0, len(codes), _STRETCH):
            e = min(s + _STRETCH, len(codes))
            h = self._convolved(table, codes, s, e)
            lo, hi = np.searchsorted(starts, s, "right") - 1, np.searchsorted(starts, e, "left")
            here = np.maximum(starts[lo:hi], s) - s
            most[lo:hi] = np.maximum(most[lo:hi], np.maximum.reduceat(h, here, axis=0))
            total[lo:hi] += np.add.reduceat(h, here, axis=0)
        sizes = np.diff(np.append(starts, len(codes)))
        pooled = np.stack([most, total / sizes[:, None]], axis=1).reshape(len(windows), -1)
        return pooled @ self.w[3] + self.w[4]

    def scores(self, windows: list[str]) -> np.ndarray:
        """Calibrated scores, group after group of about ``_STRETCH`` characters."""
        table, out, group, size = self._table().astype(np.float32), [np.zeros(0)], [], 0
        for i, one in enumerate(windows):
            group.append(one)
            size += len(one)
            if size >= _STRETCH or i == len(windows) - 1:
                out.append(self._logits(group, table))
                group, size = [], 0
        slope, shift = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * np.concatenate(out) + shift, -500, 500)))

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.w])

    def load(self, flat: np.ndarray) -> CharNet:
        ends = np.cumsum([w.size for w in self.w])[:-1]
        self.w = [part.reshape(w.shape).copy() for part, w in zip(np.split(flat, ends), self.w, strict=True)]
        return self

    def fit(self, windows: list[str], y: np.ndarray, rounds: int = 6, batch: int = 64, secrets: float | None = None, seed: int = 2) -> CharNet:
        """``secrets``: their share among all windows, where these are a part of them only."""
        r = np.random.Generator(np.random.PCG64(seed))
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        part = y.mean() if secrets is None else secrets
        share, sizes = np.where(y == 1, 0.5 / max(part, 1e-9), 0.5 / max(1 - part, 1e-9)), np.array([len(w) for w in windows])
        for _ in range(rounds):
            for at in _batches(r.permutation(len(windows)), sizes, batch):
                t += 1
                for k, g in enumerate(self._gradients([windows[n] for n in at], y[at], share[at])):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def _gradients(self, windows: list[str], y: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
        codes, starts = _flat(windows)
        h = self._convolved(self._table(), codes, 0, len(codes))
        sizes = np.diff(np.append(starts, len(codes)))
        part = np.repeat(np.arange(len(starts)), sizes)
        most = np.maximum.reduceat(h, starts, axis=0)
        pooled = np.stack([most, np.add.reduceat(h, starts, axis=0) / sizes[:, None]], axis=1).reshape(len(windows), -1)
        d = (1 / (1 + np.exp(-np.clip(pooled @ self.w[3] + self.w[4], -30, 30))) - y) * share / len(y)
        dp = (d[:, None] * self.w[3]).reshape(len(starts), 2, self.filters)
        top = h == most[part]
        ties = np.add.reduceat(top.astype(float), starts, axis=0)
        dh = ((dp[:, 1] / sizes[:, None])[part] + top * (dp[:, 0] / ties)[part]) * (h > 0)
        padded = np.pad(codes, WIDTH // 2)
        order = np.argsort(padded, kind="stable")
        there, first = np.unique(padded[order], return_index=True)
        reach = WIDTH + WIDTH // 2
        wide = np.pad(dh, ((reach, reach), (0, 0)))
        by_code, by_shape = np.zeros_like(self.w[0]), np.zeros_like(self.w[1])
        for j in range(WIDTH):
            by_code[j][there] = np.add.reduceat(wide[order + reach - j], first, axis=0)
            np.add.at(by_shape[j], _SHAPES, by_code[j])
        return [by_code, by_shape, dh.sum(axis=0), pooled.T @ d, np.array([d.sum()])]

    def calibrate(self, secret: list[str], other: list[str]) -> None:
        """The logistic curve over held-out scores, by Newton's steps on counts shrunk by one of each label."""
        x = np.concatenate([self.scores(secret), self.scores(other)])
        x = np.log(np.clip(x, 1e-12, 1 - 1e-12) / (1 - np.clip(x, 1e-12, 1 - 1e-12)))
        self.bend(x, np.repeat([True, False], [len(secret), len(other)]), np.ones(len(x)))

    def bend(self, x: np.ndarray, known: np.ndarray, count: np.ndarray) -> None:
        """The curve from uncalibrated logits ``x``, each met ``count`` times."""
        n = [count[known].sum(), count[~known].sum()]
        aim = np.where(known, (n[0] + 1) / (n[0] + 2), 1 / (n[1] + 2))
        z, w = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (count * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (count * (p - aim)))
            w -= step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        self.curve = (max(float(w[0]), 1e-3), float(w[1]))


def _lettered(r: np.random.Generator, size: int) -> str:
    letters = _WIDER[int(r.integers(len(_WIDER)))]
    return "".join(letters[k] for k in r.integers(0, len(letters), size))


def _forms(findings: list[str], others: list[str]) -> list[str]:
    """Each finding in its own context and in a harmless token's; there also ``WIDENED`` times in letters of a wider
    alphabet: as long or shorter, behind a short name, or in two pieces."""
    out = []
    for i, one in enumerate(findings):
        value = one[EDGE:-EDGE]
        out.append(one)
        if not others or _plain(value) or _HARMLESS.fullmatch(value) or len(value) < LEAST_CHARS:
            continue  # a word or a number is a secret by its name only
        r = np.random.Generator(np.random.PCG64(zlib.crc32(value.encode("utf-8", "surrogatepass"))))
        there, made = others[i % len(others)], [value]
        for k in range(WIDENED):
            again = _lettered(r, int(r.integers(min(16, len(value)), len(value) + 1)))
            mark = "_-."[int(r.integers(3))]
            if k % 3 == 1:
                again = "".join(c for c in others[int(r.integers(len(others)))] if c.isalpha())[: int(r.integers(2, 6))].lower() + mark + again
            elif k % 3 == 2:
                again = again + mark + _lettered(r, int(r.integers(8, len(value) + 1)))
            made.append(again)
        out += [there[:EDGE] + v + there[-EDGE:] for v in made]
    return out


def train(findings: list[str], others: list[str]) -> CharNet:
    """A network from windows of either label in a fixed order; every fourth of each is held out for the threshold."""
    net = CharNet()
    if len(findings) < 2 or len(others) < 2:
        return net
    held_other, rest_other = others[::4], [w for i, w in enumerate(others) if i % 4]
    held, rest = _forms(findings[::4], held_other), _forms([w for i, w in enumerate(findings) if i % 4], rest_other)
    net.fit(rest + rest_other, np.array([1.0] * len(rest) + [0.0] * len(rest_other)))
    net.calibrate(held, held_other)
    found = np.sort(net.scores(held))
    net.threshold = float(found[int((1 - RECALL) * len(found))])
    return net


def _labelled(batches):
    """(label, mark, window) of all findings and harmless tokens, those of a batch once."""
    for batch in batches:
        seen = {True: set(), False: set()}
        for item in batch.column(0):
            text = item.as_py() or ""
            findings = _findings(text)
            seen[True].update(window(text, value, b) for _, _, b, value in findings)
            seen[False].update(window(text, a, b) for a, b in candidates(text, findings) if _HARMLESS.fullmatch(text, a, b))
        rows = [(known, zlib.crc32(w.encode("utf-8", "surrogatepass")), w) for known in seen for w in sorted(seen[known])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())],
            ["known", "mark", "window"],
        )


def _of(part: pa.Table, known: bool, held: bool) -> list[str]:
    """Windows of a part in the order of their marks."""
    rows = zip(*[part.column(name).to_pylist() for name in ("known", "held", "mark", "window")], strict=True)
    return [w for _, w in sorted((mark, w) for k, h, mark, w in rows if k == known and h == held)]


def _pass(sent, secrets: float, seed: int):
    """One pass over a part: (weights, windows)."""

    def run(part: pa.Table) -> pa.Table:
        others = _of(part, False, False)
        forms = _forms(_of(part, True, False), others)
        net = CharNet().load(sent.value)
        if forms or others:
            net.fit(forms + others, np.array([1.0] * len(forms) + [0.0] * len(others)), 1, secrets=secrets, seed=seed)
        return pa.table({"w": pa.array([net.flat()], pa.list_(pa.float64())), "n": pa.array([len(forms) + len(others)], pa.int64())})

    return run


def _held_scores(sent):
    """(known, score) of a part's held-out windows, findings in all forms."""

    def run(part: pa.Table) -> pa.Table:
        others = _of(part, False, True)
        forms = _forms(_of(part, True, True), others)
        return pa.table({"known": pa.array([True] * len(forms) + [False] * len(others), pa.bool_()), "score": sent.value.scores(forms + others)})

    return run


def train_all(labelled: DataFrame) -> CharNet:
    """The network from all of (known, mark, window), distinct rows: learnt, calibrated and held to ``RECALL`` part by part."""
    spark, net = labelled.sparkSession, CharNet()
    held = F.row_number().over(W.partitionBy("part", "known").orderBy("mark", "window")) % 4 == 1
    count = {r["known"]: r["n"] for r in labelled.groupBy("known").agg(F.count(F.lit(1)).alias("n")).collect()}
    if count.get(True, 0) < 2 or count.get(False, 0) < 2:
        return net
    findings, others = count[True] * (WIDENED + 2), count[False]
    n = -(-(findings + others) // PART)
    dealt = labelled.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(n))).withColumn("held", held)
    parts = common.stage(dealt, "labelled-parts").groupBy("part")
    steps = 0.75 * (findings + others) / n / 64
    for k in range(min(6, max(2, -(-STEPS // max(1, int(steps)))))):
        sent = spark.sparkContext.broadcast(net.flat())
        passed = parts.applyInArrow(_pass(sent, findings / (findings + others), 2 + k), "w array<double>, n bigint")
        each = passed.select("n", F.posexplode("w").alias("at", "w")).groupBy("at").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w"))
        net.load(np.array([r["w"] for r in each.orderBy("at").collect()]))
    scored = parts.applyInArrow(_held_scores(spark.sparkContext.broadcast(net)), "known boolean, score double")
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("score")))
    x = F.log(p / (1 - p))
    # steps of 1/64 of a logit, each at its mean: at most 3,540 rows a label, whatever the corpus
    bins = scored.select("known", x.alias("x")).groupBy("known", F.floor(F.col("x") * 64)).agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n")).toPandas()
    net.bend(bins["x"].to_numpy(float), bins["known"].to_numpy(bool), bins["n"].to_numpy(float))
    again = parts.applyInArrow(_held_scores(spark.sparkContext.broadcast(net)), "known boolean, score double").where("known")
    found = common.stage(again, "held-scores")
    place = int((1 - RECALL) * found.count())
    cut = running_rank(found, "score", "place").where(F.col("place") == place).first()
    net.threshold = cut["score"] if cut else 2.0
    return net


def _judge(sent):
    def run(batches):
        for batch in batches:
            rows, places, windows, size = [], [], [], 0

            def judged():
                for (row, a, b), score in zip(places, sent.value.scores(windows).tolist(), strict=True):
                    if score >= sent.value.threshold:
                        rows[row].append((a, b, "model"))

            for item in batch.column(1):
                text = item.as_py() or ""
                findings = _findings(text)
                rows.append([(a, b, KINDS[kind]) for a, kind, b, _ in findings])
                for a, b in candidates(text, findings):
                    places.append((len(rows) - 1, a, b))
                    windows.append(window(text, a, b))
                    size += len(windows[-1])
                    if size > 16 * _STRETCH:
                        judged()
                        places, windows, size = [], [], 0
            judged()
            bases = [[x for x in row if x[2] != "model"] for row in rows]
            every = [sorted(row, key=lambda x: (x[0], [*KINDS, "model"].index(x[2]))) for row in rows]
            counts = [[sum(k == kind for _, _, k in s) for s in bases] for kind in KINDS]
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts]]
            columns += [pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in bases], pa.string())]
            columns += [pa.array([joined(s) for s in every], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    spark = common.ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(text_col).mapInArrow(_labelled, "known boolean, mark bigint, window string").distinct()
    with common.small_batches(spark):
        staged = common.stage(found, "labelled")
    sent = spark.sparkContext.broadcast(train_all(staged))
    schema = f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return docs.select(id_col, text_col).mapInArrow(_judge(sent), schema)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(common.table(spark, sf_dir, "documents"))
