"""Exact top-k inner products by best-first search over M-trees.

Inner products become distances: with R the largest norm, every vector x gets one more coordinate
sqrt(R^2 - |x|^2), a query a 0 there, and then |q - x|^2 = |q|^2 + R^2 - 2 q.x, so the nearest
neighbours are the highest products. Vectors go to the block of their nearest pivot; each block is
an M-tree of pages, a page's entries having a pivot, a covering radius and the distance to the
parent pivot. Queries visit pages together, each the nearest child first, and leave out, by the
triangle inequality on stored distances, pages and entries that cannot be among their nearest. A
query searches its nearest block first; its k-th distance there rules out blocks that lie farther.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Vectors of a block, entries of a page, queries that visit a block together.
BLOCK, PAGE, TOGETHER = 20_000, 64, 20_000
#: Queries that search a tree side by side, distances kept before those beyond the bounds are dropped.
AT_ONCE, HELD = 2_000, 1_000_000
#: Blocks are no smaller than this for the sake of more tasks, and their pivots no more than that.
SMALL_BLOCK, MOST_PIVOTS = 2_000, 4_096
#: Bounds on distances are loosened by this share of the lengths involved.
SLACK = 1e-9


class Tree:
    """An M-tree: page p holds the entries from ``start[p]`` to ``start[p + 1]``, page 0 is the root.

    An entry of a leaf is a vector and ``ids`` its id; an entry of an inner page is the pivot of a
    child page, whose number is in ``ids`` and whose covering radius is in ``radii``.
    """

    FIELDS = ("points", "to_parent", "ids", "radii", "start", "leaf")

    def __init__(self, **arrays: np.ndarray):
        self.points, self.to_parent, self.ids, self.radii, self.start, self.leaf = (arrays[k] for k in self.FIELDS)
        #: Distances from a query that searches have computed.
        self.computed = 0

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.FIELDS})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as got:
            return cls(**{k: got[k] for k in got.files})

    @classmethod
    def bulk_load(cls, ids: np.ndarray, points: np.ndarray, seed: int = 1) -> Tree:
        """Points go to the nearest of sampled pivots, level by level."""
        rng, pages = np.random.default_rng(seed), []

        def build(at: np.ndarray, pivot: np.ndarray) -> tuple[int, float]:
            number = len(pages)
            pages.append(None)
            to_pivot = distances(points[at], pivot)
            if len(at) <= PAGE:
                pages[number] = points[at], to_pivot, ids[at], np.zeros(len(at)), True
                return number, float(to_pivot.max(initial=0.0))
            pivots = points[rng.choice(at, min(PAGE, -(-len(at) // (PAGE // 2))), replace=False)]
            near = nearest(points[at], pivots)[0]
            if (near == near[0]).all():  # copies of one vector: any split keeps them together at radius 0
                near = np.arange(len(at)) % len(pivots)
            children = [(p, at[near == k]) for k, p in enumerate(pivots) if (near == k).any()]
            made = [build(members, p) for p, members in children]
            stand = np.array([p for p, _ in children])
            pages[number] = stand, distances(stand, pivot), np.array([n for n, _ in made]), np.array([r for _, r in made]), False
            return number, float(to_pivot.max())

        build(np.arange(len(ids)), points[0])
        start = np.cumsum([0, *(len(p[1]) for p in pages)])
        entries = dict(zip(cls.FIELDS, (np.concatenate([p[k] for p in pages]) for k in range(4))))
        return cls(**entries, start=start, leaf=np.array([p[4] for p in pages]))

    def search(self, query: np.ndarray, norm: float, k: int, without: int | None = None, bound: float = np.inf) -> list[tuple[float, int]]:
        """The ``k`` nearest ``(distance, id)`` within ``bound`` of other ids than ``without``, and all that may tie with them."""
        _, d, ids = self.search_all(query[None], norm, k, None if without is None else np.array([without]), np.array([bound]))
        return list(zip(d.tolist(), ids.tolist()))

    def search_all(self, queries: np.ndarray, norm: float, k: int, without: np.ndarray | None, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, distance, id)``: as ``search`` for each query, those that visit a page together.

        All points have the squared length ``norm``, so one product of matrices gives the distances of a
        page. Of a page's children each query first visits the nearest, then the others that its bound leaves.
        """
        own = (queries**2).sum(1) + norm
        loose = SLACK * np.sqrt(own)
        bound = bounds + loose
        best = np.full((len(queries), k), np.inf)
        found, held = [], 0

        def kept() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            got = tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, t) for i, t in enumerate((np.int64, np.float64, np.int64)))
            good = got[1] <= bound[got[0]]
            return got[0][good], got[1][good], got[2][good]

        def visit(number: int, at: np.ndarray, to_pivot: np.ndarray | None) -> None:
            nonlocal found, held
            page = slice(self.start[number], self.start[number + 1])
            points, ids, radii = self.points[page], self.ids[page], self.radii[page]
            if to_pivot is not None:
                near = (np.abs(to_pivot[:, None] - self.to_parent[page]) - radii <= bound[at, None]).any(0)
                points, ids, radii = points[near], ids[near], radii[near]
            self.computed += len(ids) * len(at)
            d = np.sqrt(np.maximum(0.0, own[at, None] - 2 * (queries[at] @ points.T)))
            if not len(ids):
                return
            if self.leaf[number]:
                far = d > bound[at, None]
                if without is not None:
                    far |= ids == without[at, None]
                d[far] = np.inf
                best[at] = np.partition(np.concatenate([best[at], d], 1), k - 1, axis=1)[:, :k]
                bound[at] = np.minimum(bound[at], best[at].max(1) + loose[at])
                query, row = np.nonzero((d <= bound[at, None]) & (d < np.inf))
                found.append((at[query], d[query, row], ids[row]))
                held += len(query)
                if held > HELD:
                    found = [kept()]
                    held = 0
                return
            low = d - radii - loose[at, None]
            first = np.argmin(low, axis=1)
            for nearest_now in (True, False):
                for j in np.argsort(low.min(0)).tolist():
                    go = ((first == j) == nearest_now) & (low[:, j] <= bound[at])
                    if go.any():
                        visit(int(ids[j]), at[go], d[go, j])

        if len(queries):
            visit(0, np.arange(len(queries)), None)
        return kept()


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    d = points - to
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the nearest pivot of each point, and all squared distances but for each point's own length."""
    away = (pivots**2).sum(1)[None] - 2 * points @ pivots.T
    return np.argmin(away, axis=1), away


def lifted(v: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the coordinate that gives them all the squared length ``norm``."""
    return np.concatenate([v, np.sqrt(np.maximum(0.0, norm - (v**2).sum(1)))[:, None]], 1)


class Directory:
    """The blocks' pivots: for each length of vectors its largest squared norm, pivots and their block numbers."""

    def __init__(self, norms: dict[int, int], pivots: list[list[int]]):
        self.norms, self.pivots, self.numbers = norms, {}, {}
        #: Filled once vectors are placed: each block's covering radius and parts.
        self.radii, self.parts = np.zeros(0), np.zeros(0, np.int64)
        done = 0
        for d, norm in sorted(norms.items()):
            own = [p for p in pivots if len(p) == d]
            own = np.array(own, np.float64).reshape(len(own), d)
            self.pivots[d], self.numbers[d] = lifted(own, norm), np.arange(done, done + len(own))
            done += len(own)

    def __len__(self) -> int:
        return sum(map(len, self.numbers.values()))

    def placed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From batches of (vec_id, v): each with its block and the distance to the block's pivot."""
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            block, away = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
            for d, rows in self.by_length(vectors):
                points = lifted(np.array([vectors[i] for i in rows], np.float64), self.norms[d])
                at = nearest(points, self.pivots[d])[0]
                block[rows], away[rows] = self.numbers[d][at], distances(points, self.pivots[d][at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block), pa.array(away)], ["vec_id", "v", "block", "away"])

    def visits(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From batches of (query, vec_id, v, home, part, bound): the blocks, part by part, that the bound leaves to visit."""
        for batch in batches:
            vectors, home, part, bound = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            out: list[list] = [[] for _ in vectors]
            for d, rows in self.by_length(vectors):
                q = np.array([vectors[i] for i in rows], np.float64)
                own = (q**2).sum(1) + self.norms[d]
                away = np.sqrt(np.maximum(0.0, own[:, None] - 2 * q @ self.pivots[d][:, :-1].T))
                low = away - self.radii[self.numbers[d]][None] - 2 * SLACK * np.sqrt(own)[:, None]
                for i, least in zip(rows, low):
                    near = self.numbers[d][np.flatnonzero(least <= bound[i])] if bound[i] is not None else self.numbers[d]
                    out[i] = [{"block": int(b), "part": p} for b in near for p in range(self.parts[b]) if (b, p) != (home[i], part[i])]
            kind = pa.list_(pa.struct([("block", pa.int32()), ("part", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(5), pa.array(out, kind)], ["query", "vec_id", "v", "bound", "near"])

    @staticmethod
    def by_length(vectors: list[list[int]]) -> list[tuple[int, np.ndarray]]:
        sizes = np.array([len(v) for v in vectors])
        return [(int(d), np.flatnonzero(sizes == d)) for d in np.unique(sizes)]


def directory(vectors: DataFrame) -> Directory:
    """Pivots drawn by hash, about one a block and at most about MOST_PIVOTS, and one of each length at least."""
    place = F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1 << 32)) / float(1 << 32)
    rows = vectors.select("v", F.size("v").alias("d"), place.alias("place"))
    stats = rows.groupBy("d").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)).alias("norm"), F.min("place").alias("least")).collect()
    if not stats:
        return Directory({}, [])
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = lambda n: min(max(-(-n // BLOCK), min(2 * tasks, -(-n // SMALL_BLOCK))), MOST_PIVOTS)
    share = F.lit(0.0)
    for r in stats:  # as many rows as there are lengths
        share = F.when(F.col("d") == r["d"], F.lit(max(r["least"], blocks(r["n"]) / r["n"]))).otherwise(share)
    pivots = rows.where(F.col("place") <= share).select("v").distinct().collect()
    return Directory({r["d"]: r["norm"] for r in stats}, [list(p["v"]) for p in pivots])


def trees(placed: DataFrame, norms: dict[int, int]) -> DataFrame:
    """``(block, part, data)``: the M-tree of each part of a block of ``placed(block, part, vec_id, v)``."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        points = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        tree = Tree.bulk_load(pdf["vec_id"].to_numpy(np.int64), lifted(points, norms[points.shape[1]]))
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": pdf["part"].iloc[:1], "data": [tree.packed()]})

    return placed.select("block", "part", "vec_id", "v").groupBy("block", "part").applyInPandas(build, "block int, part int, data binary")


def _visited(pages: DataFrame, asked: DataFrame, norms: dict[int, int], k: int) -> DataFrame:
    """``(query, query_id, vec_id, score, away)``: what queries find in the blocks that they visit.

    At most about TOGETHER queries visit a part of a block at a time, each such group with a copy of the tree.
    """
    asked = cut(asked.select("block", "part", "query", "vec_id", "v", "bound"))
    groups = asked.groupBy("block", "part").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("groups"))
    left = pages.join(groups, ["block", "part"]).select("block", "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "data")
    right = asked.join(F.broadcast(groups), ["block", "part"]).withColumn("group", F.pmod(F.xxhash64("query"), F.col("groups")).cast("int")).drop("groups")

    def visit(tree: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        got = Tree.unpacked(tree["data"].iloc[0])
        out = []
        for at in range(0, len(rows), AT_ONCE):
            some = rows.iloc[at : at + AT_ONCE]
            q = np.stack(some["v"].to_numpy()).astype(np.float64)
            q, norm = np.concatenate([q, np.zeros((len(q), 1))], 1), norms[q.shape[1]]
            query_id, bound = some["vec_id"].to_numpy(np.int64), some["bound"].to_numpy(np.float64)
            i, d, ids = got.search_all(q, norm, k, query_id, np.where(np.isnan(bound), np.inf, bound))
            # From distance back to the whole number: |q|^2 + R^2 - 2 q.x.
            score = np.rint(((q**2).sum(1)[i] + norm - d * d) / 2).astype(np.int64)
            out.append(pd.DataFrame({"query": some["query"].to_numpy(np.int64)[i], "query_id": query_id[i], "vec_id": ids, "score": score, "away": d}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["query", "query_id", "vec_id", "score", "away"]).astype({"query": "int64", "query_id": "int64", "vec_id": "int64", "score": "int64", "away": "float64"})

    keys = ["block", "part", "group"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(visit, "query long, query_id long, vec_id long, score long, away double")


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest integer inner products over all other rows.

    ``vectors`` and ``queries`` have ``vec_id`` and ``v``, an array of whole numbers. A row's
    candidates are the vectors of its own length but for those of its own id; equal scores rank by
    the smaller id; with fewer than k candidates all are returned. Rows that repeat an id are
    candidates each, and as queries each has its own k rows. Null vectors and ids take no part, a
    vector without components scores 0 with others like it. A task holds one part of a block and
    one group of queries; the driver holds a pivot, a radius and a few counts for each block.
    """
    vectors, queries = (x.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v")).where("v is not null and vec_id is not null") for x in (vectors, queries))
    known = directory(vectors)
    if not len(known):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Copies of one vector may fill a block, so large blocks are dealt into parts.
    located = "vec_id long, v array<long>, block int, away double"
    placed = cut(vectors.mapInArrow(known.placed, located).withColumn("row", F.monotonically_increasing_id()))
    known.radii, known.parts = np.zeros(len(known)), np.ones(len(known), np.int64)
    for r in placed.groupBy("block").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect():
        known.radii[r["block"]], known.parts[r["block"]] = r["radius"], -(-r["n"] // BLOCK)
    parts = F.element_at(F.array(*map(F.lit, known.parts.tolist())), F.col("block") + 1)
    pages = cut(trees(placed.withColumn("part", F.pmod("row", parts).cast("int")), known.norms))

    # A query whose length no vector has finds nothing.
    asked = queries.where(F.size("v").isin(list(known.norms))).mapInArrow(known.placed, located).withColumn("query", F.monotonically_increasing_id())
    asked = cut(asked.withColumn("part", F.pmod("query", parts).cast("int")))
    first = cut(_visited(pages, asked.withColumn("bound", F.lit(None).cast("double")), known.norms, k))
    reach = first.groupBy("query").agg(F.sort_array(F.collect_list("away")).alias("away")).select("query", F.get("away", F.lit(k - 1)).alias("bound"))
    further = asked.join(reach, "query", "left").select("query", "vec_id", "v", "block", "part", "bound")
    further = further.mapInArrow(known.visits, "query long, vec_id long, v array<long>, bound double, near array<struct<block:int,part:int>>")
    further = further.select("query", "vec_id", "v", "bound", F.explode("near").alias("at")).select("*", "at.block", "at.part")
    found = first.union(_visited(pages, further, known.norms, k))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(rows: DataFrame, column: str = "embedding", scale: int = 64) -> DataFrame:
    """``(vec_id, v)`` with v = floor(scale * x) of each component; rows with a null or non-finite one are left out."""
    x = F.col(column).cast("array<double>")
    good = F.col(column).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(good).select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def op8_metric_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_numbers(table(spark, sf_dir, "embeddings"))
    return top_products(vectors, vectors.where("vec_id % 20 = 0"))


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT row_number() OVER () AS query, vec_id AS query_id, v FROM e WHERE vec_id % 20 = 0),
p AS (SELECT query, query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])), 0)::BIGINT AS score
      FROM q JOIN e c ON query_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p) WHERE rank <= 20
"""
