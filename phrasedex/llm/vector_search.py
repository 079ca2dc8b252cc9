"""Nearest neighbours by inner product: inverted lists scanned with adaptive dimension sampling.

Largest inner product is turned into smallest distance: with M the largest norm,
a vector x gets the extra component sqrt(M^2 - |x|^2), a query 0. All vectors are
rotated by one random orthogonal matrix, so a prefix of the components is a
random sample of them, and kept as column blocks. A list is scanned block by
block: after d of D components a candidate is given up if its partial squared
distance exceeds ``r^2 * d/D * (1 + EPSILON/sqrt(d))^2``, the test of the
hypothesis that its distance is within the query's radius r. Survivors are
scored exactly, in double precision, on the original vectors.

Fitted on a bounded sample of at most ``MAX_SAMPLE`` vectors: the list centres (k-means),
each query's first radius, and the number of lists to probe (the smallest that
holds ``COVERAGE`` of the sample's true neighbours). Every vector is indexed.

Equal vectors form a class that is searched once and answers for all its
members; only its k + 1 smallest ids can be among any k nearest. A list larger
than ``TILE`` is split into parts, and so are its queries, so a task holds one
tile of each however many rows share a list.

Defined cases: vectors that are null, empty, all zero, or hold a null or
non-finite component take no part; inner products are between vectors of one
length, so each length is searched by itself, one after another (tables have few);
rows that repeat an id count as separate
candidates; with fewer than k candidates all are returned; no queries or an
empty table give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phrasedex.session import shared_dir

from .common import table

MAX_SAMPLE = 32_768
MAX_LISTS = 1024
COVERAGE = 0.97
EPSILON = 2.1
BLOCK = 16
TILE = 8192


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, embedding double array, h1, h2) of the vectors that take part; h1, h2 name the vector's class."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    plus_zero = F.transform("embedding", lambda x: x + F.lit(0.0))
    return v.withColumns({"h1": F.xxhash64(plus_zero), "h2": F.xxhash64(F.lit(1), plus_zero)})


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()).astype(np.float64)


class Index:
    """The fitted part: rotation, list centres, probes, and the sample that gives first radii."""

    def __init__(self, sample: np.ndarray, sample_ids: np.ndarray, top_norm2: float, n_all: int, k: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = sample.shape[1] + 1
        self.top2 = top_norm2
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.float32)
        self.sample = self.lift(sample)
        self.original, self.sample_ids = sample, sample_ids
        n_lists = max(1, min(MAX_LISTS, len(sample) // 8, round(np.sqrt(n_all) / 2)))
        self.centres = self._kmeans(self.sample, n_lists, rng)
        self.k = k
        self.probes = self._probes(sample)

    def lift(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.top2 - (x * x).sum(axis=1), 0))
        return (np.hstack([x, extra[:, None]]).astype(np.float32) @ self.rotation).astype(np.float32)

    def lift_queries(self, q: np.ndarray) -> np.ndarray:
        return (np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32) @ self.rotation).astype(np.float32)

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)

    def _kmeans(self, x: np.ndarray, n: int, rng) -> np.ndarray:
        centres = x[rng.choice(len(x), n, replace=False)].copy()
        for _ in range(8):
            at = self._nearest(x, centres)
            counts = np.bincount(at, minlength=n)
            sums = np.zeros_like(centres)
            np.add.at(sums, at, x)
            centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        return centres

    def lists(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(self.lift(x), self.centres)

    def ranked_lists(self, q: np.ndarray) -> np.ndarray:
        lifted = self.lift_queries(q)
        return np.argsort((self.centres * self.centres).sum(axis=1)[None, :] - 2 * (lifted @ self.centres.T), axis=1)

    def _probes(self, sample: np.ndarray) -> int:
        """Smallest number of lists that holds COVERAGE of the true neighbours of a few hundred sample vectors."""
        q = sample[:: max(1, len(sample) // 256)]
        scores = q @ sample.T
        near = np.argsort(-scores, axis=1)[:, 1 : self.k + 1]
        home = self._nearest(self.sample, self.centres)[near]
        order = self.ranked_lists(q)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
        found = np.take_along_axis(rank, home, axis=1)
        return int(np.quantile(found, COVERAGE, method="higher")) + 1 if found.size else 1

    def first_answers(self, q: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, float]]]]:
        """Per query its k + 1 nearest of the sample, scored exactly, and the squared distance that holds them.

        The distance is infinite if the sample has fewer than k + 1 vectors.
        """
        lifted, radius, near = self.lift_queries(q), np.full(len(q), np.inf), []
        take = min(self.k + 1, len(self.sample))
        for a in range(0, len(q), 512):
            part = lifted[a : a + 512]
            dist = (part * part).sum(axis=1)[:, None] + (self.sample * self.sample).sum(axis=1)[None, :] - 2 * (part @ self.sample.T)
            at = np.argpartition(dist, take - 1, axis=1)[:, :take]
            if take > self.k:
                radius[a : a + 512] = np.take_along_axis(dist, at, axis=1).max(axis=1)
            scores = (q[a : a + 512, None, :] * self.original[at]).sum(axis=2)
            near += [list(zip(self.sample_ids[i].tolist(), sc.tolist())) for i, sc in zip(at, scores)]
        return radius, near

    def scan(self, q: np.ndarray, radius2: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query row, candidate row) pairs of a tile that survive every test."""
        ql, xl = self.lift_queries(q), self.lift(x)
        dims = ql.shape[1]
        slack = 1e-5 * (self.top2 + (q * q).sum(axis=1)) + 1e-12
        dense = np.zeros((len(q), len(x)), np.float32)
        qi = ci = part = None
        for a in range(0, dims, BLOCK):
            b = min(a + BLOCK, dims)
            if qi is None:
                qb, xb = ql[:, a:b], xl[:, a:b]
                dense += (qb * qb).sum(axis=1)[:, None] + (xb * xb).sum(axis=1)[None, :] - 2 * (qb @ xb.T)
            else:
                diff = ql[qi, a:b] - xl[ci, a:b]
                part = part + np.einsum("ij,ij->i", diff, diff)
            grow = 1.0 if b == dims else b / dims * (1 + EPSILON / np.sqrt(b)) ** 2
            limit = radius2 * grow + slack
            if qi is None:
                # While most pairs survive, whole blocks are cheaper than single pairs.
                alive = dense <= limit[:, None].astype(np.float32)
                if b == dims or np.count_nonzero(alive) * 16 < alive.size:
                    qi, ci = np.nonzero(alive)
                    part = dense[qi, ci].astype(np.float64)
            else:
                keep = part <= limit[qi]
                qi, ci, part = qi[keep], ci[keep], part[keep]
        return qi, ci


def _top(qi: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best per query, best first, ties to the smaller id."""
    order = np.lexsort((ids, -scores, qi))
    q = qi[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[rank < k]


def search(vectors: DataFrame, query_condition: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of every row that meets ``query_condition`` (on ``vec_id``)."""
    spark = vectors.sparkSession
    path = shared_dir(spark, "vectors")
    usable(vectors, id_col, vec_col).write.parquet(path)
    v = spark.read.parquet(path)
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = F.size("embedding")
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    lengths = v.groupBy(size.alias("d")).agg(F.count("*").alias("n"), F.max(norm2).alias("m")).where("n > 1").orderBy("d").collect()
    for r in lengths:
        near = _search_length(v.where(size == r["d"]), query_condition, k, float(r["m"]))
        found = near if r is lengths[0] else found.unionByName(near)
    return found


def _search_length(v: DataFrame, query_condition: Column, k: int, top_norm2: float) -> DataFrame:
    """``search`` over stored usable vectors of one length."""
    spark = v.sparkSession
    by_class = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = v.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k + 1)
    classes = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min_by("embedding", "vec_id").alias("embedding"))
    classes = classes.withColumn("cid", F.col("ids")[0])
    asked = v.where(query_condition).select("h1", "h2").distinct().withColumn("asked", F.lit(True))
    path = shared_dir(spark, "vector-classes")
    classes.join(asked, ["h1", "h2"], "left").write.parquet(path)
    classes = spark.read.parquet(path)
    n = classes.count()
    picked = classes.orderBy("h1", "h2").limit(min(MAX_SAMPLE, max(512, 16 * int(np.sqrt(n))))).select("embedding", "cid").toPandas()
    index = Index(_matrix(picked["embedding"]), picked["cid"].to_numpy(), top_norm2, n, k)
    shared = spark.sparkContext.broadcast(index)
    n_lists, probes = len(index.centres), index.probes

    @F.pandas_udf("int")
    def list_of(vs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in vs:
            yield pd.Series(shared.value.lists(_matrix(s)).astype(np.int32)) if len(s) else pd.Series([], dtype="int32")

    @F.pandas_udf("struct<lists array<int>, radius2 double, near array<struct<cid: long, score: double>>>")
    def probe(vs: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in vs:
            q = _matrix(s) if len(s) else np.empty((0, shared.value.sample.shape[1] - 1))
            order = shared.value.ranked_lists(q)[:, :probes].astype(np.int32)
            radius, near = shared.value.first_answers(q)
            yield pd.DataFrame({"lists": list(order), "radius2": radius, "near": near})

    path = shared_dir(spark, "vector-lists")
    classes.withColumn("list", list_of("embedding")).write.parquet(path)
    placed = spark.read.parquet(path)
    path = shared_dir(spark, "vector-probes")
    placed.where("asked").select("cid", "embedding", probe("embedding").alias("p")).write.parquet(path)
    probed = spark.read.parquet(path)
    asked = probed.select("cid", "embedding", F.explode("p.lists").alias("list"), F.col("p.radius2").alias("radius2"))
    # Parts per list: at most MAX_LISTS rows.
    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}
    loads = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
    vparts = F.array(*[F.lit(max(1, -(-sizes.get(i, 0) // TILE))) for i in range(n_lists)])
    qparts = F.array(*[F.lit(max(1, -(-loads.get(i, 0) // TILE))) for i in range(n_lists)])
    part = lambda parts: F.pmod(F.xxhash64("cid"), parts[F.col("list")]).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts[F.col("list")] - 1))
    left = placed.withColumn("vpart", part(vparts)).withColumn("qpart", every(qparts)).select("list", "vpart", "qpart", "cid", "embedding")
    right = asked.withColumn("qpart", part(qparts)).withColumn("vpart", every(vparts)).select("list", "vpart", "qpart", "cid", "embedding", "radius2")

    def tile(cands: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(cands) or not len(queries):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "cid": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x, ids = _matrix(cands["embedding"]), cands["cid"].to_numpy()
        found = []
        for a in range(0, len(queries), 256):
            qs = queries.iloc[a : a + 256]
            q = _matrix(qs["embedding"])
            qi, ci = shared.value.scan(q, qs["radius2"].to_numpy(), x)
            scores = np.empty(len(qi))
            for b in range(0, len(qi), 65_536):
                scores[b : b + 65_536] = (q[qi[b : b + 65_536]] * x[ci[b : b + 65_536]]).sum(axis=1)
            best = _top(qi, ids[ci], scores, k + 1)
            found.append(pd.DataFrame({"q": qs["cid"].to_numpy()[qi[best]], "cid": ids[ci[best]], "score": scores[best]}))
        return pd.concat(found)

    key = ["list", "vpart", "qpart"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(tile, "q long, cid long, score double")
    first = probed.select(F.col("cid").alias("q"), F.inline("p.near"))
    hits = hits.unionByName(first).dropDuplicates(["q", "cid"])
    best = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    hits = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    hits = hits.join(placed.select("cid", "ids"), "cid")
    near = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id")))))
    answers = hits.groupBy("q").agg(F.sort_array(near).alias("near")).withColumn("near", F.slice("near", 1, k + 1))
    asked_rows = v.where(query_condition).select(F.col("vec_id").alias("query_id"), "h1", "h2")
    class_of = placed.where("asked").select("h1", "h2", F.col("cid").alias("q"))
    out = asked_rows.join(class_of, ["h1", "h2"]).join(answers, "q")
    own = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    out = out.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op9_vector_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
