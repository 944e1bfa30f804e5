"""Near-duplicate embeddings by product quantisation with inverted lists and exact cosine checks.

A coarse quantiser and residual subspace codes are fitted on at most ``SAMPLE`` vectors; every vector is indexed.
Vectors are scaled to length 1, where cosine >= c means a distance of at most d = sqrt(2 - 2 c). A list is probed whenever a
vector closer than d could lie in it: the distance to the plane between the two centres is at most d. So probes
are sufficient. In a list, table-lookup distances between queries and codes, less each code's own error, bound the true
distance from below; what stays within d is checked by cosine in double precision. Nothing within reach is lost.

Each unordered pair of lists is searched once. Lists and their queries are dealt in blocks, so a group holds a bounded
number of vectors; it returns, for each vector, how many it is linked to and one vector of its part of the links, not pairs.
Equal vectors of a label are one entry with its number of copies.

Only vectors with equal labels (and lengths) are compared. Null labels or vectors, null or non-finite components and zero
vectors link with nothing and are components of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.llm.components import components
from weftline.llm.ragged import list_parts

SAMPLE = 20_000
SUBSPACES, CODES = 8, 256
#: Vectors of a list in one group, and queries to them.
LIST_BLOCK, QUERY_BLOCK = 1000, 4000
#: Vectors a coarse list has in the mean.
LIST_SIZE = 1000
_SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """``k`` centres at most."""
    r = np.random.Generator(np.random.PCG64(seed))
    centres = x[r.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between rows."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], centres).argmin(axis=1) for i in range(0, max(len(x), 1), 4096)])


class Quantiser:
    """Coarse centres and residual codebooks of one vector length."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = kmeans(sample, lists)
        residual = sample - self.centres[nearest(sample, self.centres)]
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(p)]
        self.books = [kmeans(residual[:, p], CODES) for p in self.parts]
        self.apart = np.sqrt(distances(self.centres, self.centres))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, error of the code, squared distances to the centres)."""
        far = distances(x, self.centres)
        own = far.argmin(axis=1)
        residual = x - self.centres[own]
        codes = np.stack([nearest(residual[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        missed = sum(((residual[:, p] - b[c]) ** 2).sum(axis=1) for p, b, c in zip(self.parts, self.books, codes.T, strict=True))
        return own, codes, np.sqrt(missed), far

    def probes(self, own: np.ndarray, far: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists after a row's own that may hold a vector within ``reach`` of it."""
        rows = np.arange(len(own))
        ahead = far - far[rows, own][:, None] <= 2 * (reach + _SLACK) * self.apart[own] + _SLACK
        ahead &= np.arange(len(self.centres))[None, :] > own[:, None]
        return np.nonzero(ahead)

    def estimates(self, cell: int, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to decoded vectors of one list, from lookup tables."""
        residual = queries - self.centres[cell]
        total = np.zeros((len(queries), len(codes)))
        for p, book, code in zip(self.parts, self.books, codes.T, strict=True):
            total += distances(residual[:, p], book)[:, code]
        return np.sqrt(total)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _matrices(keys: list, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by their length: (rows, matrix in double precision)."""
    flat, n = list_parts(column)
    flat, edge = np.asarray(flat, np.float64), np.append(0, np.cumsum(n))
    return [(rows := np.flatnonzero(n == size), flat[edge[rows][:, None] + np.arange(size)]) for size in np.unique(n)]


def _assign(sent, reach: float):
    """(key, label, dim, cell, own, codes, error, vector): every vector to its list, and as a query to the lists it probes."""

    def run(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            for rows, x in _matrices(key, batch.column(2)):
                q = sent.value[x.shape[1]]
                own, codes, error, far = q.encode(_unit(x))
                row, cell = q.probes(own, far, reach)
                row, cell = np.concatenate([np.arange(len(rows)), row]), np.concatenate([own, cell])
                at = pa.array(rows[row])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(np.full(len(row), x.shape[1], np.int32)),
                        pa.array(cell.astype(np.int32)),
                        pa.array(np.arange(len(row)) < len(rows)),
                        pa.array([c.tobytes() for c in codes[row]], pa.binary()),
                        pa.array(error[row]),
                        batch.column(2).take(at),
                        batch.column(3).take(at),
                    ],
                    ["key", "label", "dim", "cell", "own", "codes", "error", "vector", "copies"],
                )

    return run


def _search(sent, least: float, reach: float):
    """Links within one group: members of a list's block (side 0), and queries to them (side 1)."""

    def run(part):
        if not part.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        part = part.combine_chunks()
        side, key, copies = (part[c].to_numpy() for c in ("side", "key", "copies"))
        within = bool((part["part"].to_numpy() == 0).all())  # the members are compared with each other in one group only
        x = _matrices(key, part["vector"].combine_chunks())[0][1]
        q = sent.value[x.shape[1]]
        members = np.flatnonzero(side == 0)
        seekers = np.arange(len(side)) if within else np.flatnonzero(side == 1)
        codes = np.frombuffer(b"".join(part["codes"].take(pa.array(members)).to_pylist()), np.uint8).reshape(len(members), -1)
        error = part["error"].to_numpy()[members]
        unit, size = _unit(x), np.sqrt((x * x).sum(axis=1))
        a, b = [], []
        for i in range(0, len(seekers), 256):
            at = seekers[i : i + 256]
            near = q.estimates(int(part["cell"][0].as_py()), unit[at], codes) - error[None, :] <= reach + _SLACK
            s, m = np.nonzero(near)
            s, m = at[s], members[m]
            cos = np.einsum("ij,ij->i", x[s], x[m]) / (size[s] * size[m])
            ok = (cos >= least) & ((side[s] == 1) | (s < m))
            a.append(s[ok])
            b.append(m[ok])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        n = np.bincount(a, copies[b], len(side)) + np.bincount(b, copies[a], len(side))
        label = np.arange(len(side))
        while True:
            before = label.copy()
            np.minimum.at(label, a, before[b])
            np.minimum.at(label, b, before[a])
            label = label[label]
            if (label == before).all():
                break
        linked = np.flatnonzero(n > 0)
        return pa.table({"key": pa.array(key[linked]), "other": pa.array(key[label[linked]]), "n": pa.array(n[linked].astype(np.int64))})

    return run


def link_embeddings(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    spark = common.ready(vectors.sparkSession)
    reach = math.sqrt(2 - 2 * least)
    wide = F.transform("embedding", lambda v: v.cast("double"))
    key = F.xxhash64("label", F.transform("embedding", lambda v: v + 0.0))  # -0.0 equals 0.0
    finite = F.coalesce(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", wide.alias("vector"), key.alias("key"))
    rows = common.stage(rows.withColumn("valid", F.col("label").isNotNull() & finite), "vectors")
    once = rows.where("valid").groupBy("key").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"))
    once = common.stage(once, "distinct-vectors")
    sizes = {r["d"]: r["n"] for r in once.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}
    index = {}
    for dim, n in sizes.items():
        chosen = once.where(F.size("vector") == dim).orderBy("key").limit(SAMPLE).select("vector").toArrow()  # keys are hashes
        index[dim] = Quantiser(_unit(_matrices([], chosen["vector"].combine_chunks())[0][1]), max(1, min(-(-n // LIST_SIZE), SAMPLE // 16)))
    if not index:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sent = spark.sparkContext.broadcast(index)
    kind = rows.schema["label"].dataType.simpleString()
    schema = f"key bigint, label {kind}, dim int, cell int, own boolean, codes binary, error double, vector array<double>, copies bigint"
    placed = common.stage(once.select("key", "label", "vector", "copies").mapInArrow(_assign(sent, reach), schema), "inverted-lists")
    cell = ["label", "dim", "cell"]
    n = placed.groupBy(*cell).agg(F.sum(F.col("own").cast("long")).alias("n"), F.count("*").alias("all"))
    n = n.where("n > 0").select(*cell, F.ceil(F.col("n") / LIST_BLOCK).alias("blocks"), F.ceil(F.col("all") / QUERY_BLOCK).alias("parts"))
    placed = placed.join(n, cell)
    mine = F.pmod(F.xxhash64("key"), F.col("blocks"))
    part = F.pmod(F.xxhash64("key", F.lit("part")), F.col("parts"))
    zero = F.lit(0).cast("long")
    members = placed.where("own").withColumn("block", mine).withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1))).withColumn("side", zero)
    seekers = placed.withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1))).where(~F.col("own") | (F.col("block") > mine))
    seekers = seekers.withColumn("part", part).withColumn("side", F.lit(1).cast("long"))
    group = [*cell, "block", "part"]
    found = members.unionByName(seekers).select(*group, "side", "key", "codes", "error", "vector", "copies")
    found = common.stage(found.groupBy(*group).applyInArrow(_search(sent, least, reach), "key bigint, other bigint, n bigint"), "links")
    label = components(found.select(F.col("key").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    whole = once.select("key", "copies").join(counts, "key", "left").join(label.withColumnRenamed("node", "key"), "key", "left")
    whole = whole.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("component"))
    valid = rows.where("valid").select("vec_id", "key").join(whole, "key")
    lowest = valid.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = valid.join(lowest, "component").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = out.unionByName(rows.where("NOT valid").select("vec_id", zero.alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(common.table(spark, sf_dir, "embeddings"))


OP5_SQL = r"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), g AS (
    SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x != 0)) > 0
), link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id != b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a), deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, m AS component_id, vec_id = m AS kept
FROM v JOIN low ON low.a = vec_id LEFT JOIN deg ON deg.a = vec_id
"""
