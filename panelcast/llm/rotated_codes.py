"""Nearest neighbours over randomly rotated one-bit codes.

Every vector is centred, rotated by a random orthogonal matrix and kept as the
signs of its coordinates plus two scalars: its length and the inner product of
the unit vector with its code. For a rotated unit query q the inner product with a
stored unit vector o is estimated by <code, q> / <code, o>, and its error is below
EPSILON * sqrt((1 - <code,o>**2) / <code,o>**2 / (D - 1)) with high probability. The
bounds on the distance choose the vectors whose exact distance is computed;
answers are exact unless a bound fails.

The index is a table of blocks in the shared folder. Equal vectors are stored
once with their smallest ids, so a vector that a third of all rows hold is one code.
Queries go in blocks of bounded size, each scanned once over the index.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.scratch import stored
from panelcast.session import scratch_path

EPSILON = 3.0
BLOCK_ROWS = 2048
#: Queries are held by every task of a pass, so they are taken in blocks of so many bytes.
QUERY_BYTES = 8 << 20


def rotation(d: int) -> np.ndarray:
    """A fixed random orthogonal matrix for dimension ``d``."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(4096 + d)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def usable(vector: str) -> Column:
    """Not null, no null or non-finite component, not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _centre(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector per dimension, from a partial sum per task."""

    def partial(frames):
        sums: dict[int, list] = {}
        for f in frames:
            for d, rows in f.groupby("dim"):
                s = sums.setdefault(d, [0, np.zeros(d)])
                s[0] += len(rows)
                s[1] += np.stack(rows["vector"].to_numpy()).astype(np.float64).sum(axis=0)
        for d, (n, s) in sums.items():
            yield pd.DataFrame({"dim": [d] * d, "k": np.arange(d), "n": [n] * d, "s": s})

    got = (vectors.select("dim", "vector").mapInPandas(partial, "dim int, k int, n long, s double")
           .groupBy("dim", "k").agg((F.sum("s") / F.sum("n")).alias("mean")).collect())
    out = {d: np.zeros(d) for d in {r["dim"] for r in got}}
    for r in got:
        out[r["dim"]][r["k"]] = r["mean"]
    return out


def _encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, length, inner product with the code) of the centred vectors."""
    x = vectors - centre
    length = np.sqrt((x * x).sum(axis=1))
    unit = (x / np.where(length > 0, length, 1)[:, None]) @ turn
    return np.packbits(unit >= 0, axis=1), length, np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])


def build_index(classes: DataFrame, centres: dict[int, np.ndarray], name: str = "rotated-index") -> DataFrame:
    """Blocks of codes (dim, n, codes, lengths, dots, vectors, ids) of classes (dim, vector, ids)."""

    def blocks(frames):
        for f in frames:
            for d, rows in f.groupby("dim"):
                for at in range(0, len(rows), BLOCK_ROWS):
                    part = rows.iloc[at:at + BLOCK_ROWS]
                    v = np.stack(part["vector"].to_numpy()).astype(np.float64)
                    codes, length, dot = _encode(v, centres[d], rotation(d))
                    yield pd.DataFrame({"dim": [d], "n": [len(part)], "codes": [codes.tobytes()], "lengths": [length.tobytes()],
                                        "dots": [dot.tobytes()], "vectors": [v.tobytes()],
                                        "ids": [[list(map(int, x)) for x in part["ids"]]]})

    return stored(classes.select("dim", "vector", "ids").mapInPandas(
        blocks, "dim int, n int, codes binary, lengths binary, dots binary, vectors binary, ids array<array<long>>"), name)


class _Nearest:
    """The ``k`` nearest rows found so far of each query, by distance, then id."""

    def __init__(self, queries: int, k: int):
        self.k, self.far = k, np.full(queries, np.inf)
        self.kept: list[list[tuple[float, int]]] = [[] for _ in range(queries)]

    def add(self, q: int, found: list[tuple[float, int]]) -> None:
        self.kept[q] = sorted(self.kept[q] + found)[:self.k]
        if len(self.kept[q]) == self.k:
            self.far[q] = self.kept[q][-1][0]


def _scan_block(row, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, best: _Nearest) -> None:
    """Bounds for all queries against one block; exact distances where they may matter."""
    n, d = row.n, queries.shape[1]
    signs = np.unpackbits(np.frombuffer(row.codes, np.uint8).reshape(n, -1), axis=1, count=d).astype(np.float64) * 2 - 1
    length, dot = np.frombuffer(row.lengths), np.frombuffer(row.dots)
    v = np.frombuffer(row.vectors).reshape(n, d)
    x = queries - centre
    q_length = np.sqrt((x * x).sum(axis=1))
    unit = (x / np.where(q_length > 0, q_length, 1)[:, None]) @ turn
    safe = np.where(dot > 0, dot, 1)
    est = (unit @ signs.T) / np.sqrt(d) / safe
    error = np.where(dot > 0, EPSILON * np.sqrt(np.maximum(0, 1 - safe**2) / safe**2 / max(d - 1, 1)), 2.0)
    both = length[None, :] ** 2 + q_length[:, None] ** 2
    cross = 2 * length[None, :] * q_length[:, None]
    low = both - cross * np.minimum(est + error, 1)
    high = both - cross * np.maximum(est - error, -1)
    k = min(best.k, n)
    limit = np.partition(high, k - 1, axis=1)[:, k - 1] if n >= best.k else np.full(len(queries), np.inf)
    limit = np.minimum(limit, best.far**2) * (1 + 1e-9) + 1e-12
    for q in range(len(queries)):
        near = np.flatnonzero(low[q] <= limit[q])
        if len(near):
            diff = v[near] - queries[q]
            dist = np.sqrt((diff * diff).sum(axis=1))
            best.add(q, [(float(s), i) for s, j in zip(dist, near) if s <= best.far[q] for i in row.ids[j]])


def _search_pass(index: DataFrame, ids: list[int], queries: np.ndarray, centre: np.ndarray, k: int) -> DataFrame:
    """Each task keeps the nearest of its blocks for every query of this pass."""
    d = queries.shape[1]

    def scan(frames):
        best, turn = _Nearest(len(queries), k), rotation(d)
        for f in frames:
            for row in f.itertuples():
                _scan_block(row, queries, centre, turn, best)
        rows = [(ids[q], i, s) for q, kept in enumerate(best.kept) for s, i in kept]
        yield pd.DataFrame(rows, columns=["query_class", "vec_id", "score"]).astype({"query_class": "int64", "vec_id": "int64", "score": "float64"})

    return index.filter(F.col("dim") == d).mapInPandas(scan, "query_class long, vec_id long, score double")


def nearest(rows: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest other rows of every row for which ``queries`` holds.

    ``score`` is the Euclidean distance of the original vectors in double precision,
    ties go to the smaller id. Null, zero and non-finite vectors and null ids take no part;
    vectors of another length than the query's are no candidates. Repeated rows of one
    id count once (a repeated id with different vectors: each is a candidate; the
    query's own id is none). Fewer candidates give fewer rows, an empty table none; other columns are not read.
    """
    spark = rows.sparkSession
    live = (rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), queries.alias("_query"))
            .filter(F.col("vec_id").isNotNull() & usable("vector")).withColumn("dim", F.size("vector")))
    # only the k + 1 smallest ids of equal vectors can be among the answers
    order = Window.partitionBy("dim", "vector").orderBy("vec_id")
    unique = live.select("dim", "vector", "vec_id").distinct()
    few = unique.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    classes = few.groupBy("dim", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = stored(classes, "vector-classes")
    centres = _centre(classes)
    index = build_index(classes, centres)

    asked = live.filter("_query").select("dim", "vector", "vec_id").distinct()
    vectors = asked.select("dim", "vector").distinct()
    # one search per distinct query vector, numbered by blocks of bounded size
    vectors = stored(vectors.withColumn("c", F.monotonically_increasing_id()), "query-classes")
    out = scratch_path(spark, "neighbours")
    empty = spark.createDataFrame([], "query_class long, vec_id long, score double")
    empty.write.parquet(out)
    for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():
        d = r["dim"]
        most = max(1, QUERY_BYTES // (8 * d))
        n_blocks = -(-r["n"] // most)
        for b in range(n_blocks):
            block = vectors.filter((F.col("dim") == d) & (F.pmod(F.xxhash64("c"), F.lit(n_blocks)) == b)).select("c", "vector").collect()
            if block:
                q = np.array([x["vector"] for x in block], np.float64)
                _search_pass(index, [x["c"] for x in block], q, centres[d], k + 1).write.mode("append").parquet(out)
    found = spark.read.schema(empty.schema).parquet(out)
    asked = asked.join(vectors, ["dim", "vector"]).select(F.col("vec_id").alias("query_id"), F.col("c").alias("query_class"))
    pairs = asked.join(found, "query_class").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
