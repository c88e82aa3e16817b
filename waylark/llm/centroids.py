"""Centroid clustering by filtering through kd-trees.

Vectors become integers once. Each task builds kd-trees over blocks of its own
vectors: a node has the box, the count and the componentwise sum of what lies below
it. The trees are written as a table, a row of bounded size for each, and read again
in every round. There all centroids start at the root and go down: of a node's
centroids the one nearest to the middle of its box is taken, and each other one that
is strictly farther from the corner of the box that favours it most can be nearest
nowhere in the box and is pruned. A node with one centroid left is assigned whole, by
its count and sum; in leaves with several the vectors are met one by one. Only a
strictly dominated centroid is pruned, so that ties still go to the smaller number.

A round sends the sums of a task, and the driver gets one row for each centroid. All
arithmetic is in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 64
#: What a component is multiplied by, the number of centroids, the rounds, and what is hashed before an id.
SCALE, CENTROIDS, ROUNDS, SEED = 1024, 8, 10, "3:"
#: Vectors of a tree at most: 2 MB of components.
BLOCK = 8192
LEAF = 32
#: Components beyond it are refused, as a squared distance of 64 of them may not fit a long.
MOST = 1 << 26
#: Trees of an Arrow batch.
TREES = 2


def vectors(rows: DataFrame, id_col: str, vector_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, q): vectors with exactly ``dimensions`` components, none null or non-finite, as integers floor(SCALE * x)."""
    v = F.col("_v")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_v")).where((F.size(v) == dimensions) & F.forall(v, lambda x: F.coalesce(finite(x), F.lit(False))))
    number = lambda x: F.when(F.abs(x * SCALE) < MOST, F.floor(x * SCALE).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))
    return kept.select("vec_id", F.transform(v, number).alias("q"))


def first_centroids(quantised: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The ``k`` vectors whose ids hash lowest, in that order; fewer where there are fewer. Of rows of one id the lesser vector comes first."""
    digest = F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = quantised.select(digest.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in rows], dtype=np.int64).reshape(len(rows), len(rows[0].q) if rows else 0)


class Tree:
    """A kd-tree in arrays: ``order`` of the vectors, and for each node its range in it, children (0: a leaf), box and sum."""

    __slots__ = ("order", "start", "end", "left", "right", "low", "high", "total")

    def __init__(self, q: np.ndarray):
        self.order = np.arange(len(q))
        start, end, left, right, low, high, total = [0], [len(q)], [0], [0], [], [], []
        at = 0
        while at < len(start):  # nodes are made level by level, each split where it stands
            a, b = start[at], end[at]
            own = q[self.order[a:b]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            low.append(lo)
            high.append(hi)
            total.append(own.sum(axis=0, dtype=np.int64))
            d = int(np.argmax(hi - lo))
            if b - a > LEAF and hi[d] > lo[d]:
                values = own[:, d]
                middle = np.partition(values, len(values) // 2)[len(values) // 2]
                below = values < middle if middle == hi[d] else values <= middle
                self.order[a:b] = np.concatenate([self.order[a:b][below], self.order[a:b][~below]])
                cut = a + int(below.sum())
                left[at], right[at] = len(start), len(start) + 1
                start += [a, cut]
                end += [cut, b]
                left += [0, 0]
                right += [0, 0]
            at += 1
        self.start, self.end, self.left, self.right = (np.array(x, dtype=np.int32) for x in (start, end, left, right))
        self.low, self.high = np.array(low, dtype=np.int64), np.array(high, dtype=np.int64)
        self.total = np.array(total, dtype=np.int64)


TREE_COLUMNS = "n int, ids binary, q binary, start binary, end binary, left binary, right binary, low binary, high binary, total binary"


def _blocks(it: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, whether there is one, components) of BLOCK vectors at most."""
    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in it:
        while len(pdf):
            taken = pdf.iloc[: BLOCK - rows]
            held.append(taken)
            rows += len(taken)
            pdf = pdf.iloc[len(taken) :]
            if rows == BLOCK:
                yield _block(held)
                held, rows = [], 0
    if held:
        yield _block(held)


def _block(held: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pdf = pd.concat(held, ignore_index=True)
    ids = [common.NULL_ID if x is None else int(x) for x in pdf["vec_id"].astype(object).where(pdf["vec_id"].notna(), None)]
    return np.array(ids, dtype=np.int64), pdf["vec_id"].notna().to_numpy(), np.stack(pdf["q"].to_numpy()).astype(np.int64)


def trees(quantised: DataFrame) -> DataFrame:
    """A row for each tree, of vectors of one task; nothing is shuffled."""

    def build(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, there, q in _blocks(it):
            t = Tree(q)
            packed = np.stack([ids[t.order], there[t.order].astype(np.int64)], axis=1)
            arrays = (packed, q[t.order].astype(np.int32), t.start, t.end, t.left, t.right, t.low.astype(np.int32), t.high.astype(np.int32), t.total)
            yield pd.DataFrame([[len(ids), *(a.tobytes() for a in arrays)]], columns=[c.split()[0] for c in TREE_COLUMNS.split(", ")])

    # ids travel as decimals, for pandas would make doubles of longs beside nulls
    return quantised.select(F.col("vec_id").cast("string").alias("vec_id"), "q").mapInPandas(build, TREE_COLUMNS)


def _read(row: pd.Series, dimensions: int) -> dict[str, np.ndarray]:
    wide = lambda name, kind: np.frombuffer(row[name], dtype=kind).reshape(-1, dimensions).astype(np.int64)
    flat = lambda name: np.frombuffer(row[name], dtype=np.int32)
    return {"q": wide("q", np.int32), "low": wide("low", np.int32), "high": wide("high", np.int32), "total": wide("total", np.int64)} | {n: flat(n) for n in ("start", "end", "left", "right")}


#: Nodes that are looked at together: bounds what numpy holds.
FRONTIER = 1024


def filtered(t: dict[str, np.ndarray], c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nodes, centroid of each) for what is assigned whole, and (-1 - vectors, centroid of each) for vectors of leaves. Each vector is in one of them."""
    waiting = [(np.zeros(1, dtype=np.int64), np.ones((1, len(c)), dtype=bool))] if len(t["q"]) else []
    while waiting:
        nodes, alive = waiting.pop()
        if len(nodes) > FRONTIER:
            waiting += [(nodes[FRONTIER:], alive[FRONTIER:])]
            nodes, alive = nodes[:FRONTIER], alive[:FRONTIER]
        low, high = t["low"][nodes], t["high"][nodes]
        off = 2 * c[None] - (low + high)[:, None]  # twice the way from the middle of the box
        far = np.where(alive, np.einsum("nkd,nkd->nk", off, off), np.iinfo(np.int64).max)
        best = c[far.argmin(axis=1)]
        # the corner that favours another centroid most lies on its side in each dimension
        way = c[None] - best[:, None]
        corner = np.where(way > 0, high[:, None], low[:, None])
        a, b = c[None] - corner, best[:, None] - corner
        alive = alive & (np.einsum("nkd,nkd->nk", a, a) <= np.einsum("nkd,nkd->nk", b, b))
        one = alive.sum(axis=1) == 1
        if one.any():
            yield nodes[one], alive[one].argmax(axis=1)
        leaf = ~one & (t["left"][nodes] == 0)
        for node, mask in zip(nodes[leaf], alive[leaf], strict=True):
            numbers = np.flatnonzero(mask)
            for a0 in range(int(t["start"][node]), int(t["end"][node]), FRONTIER):  # equal vectors may make a leaf large
                own = np.arange(a0, min(a0 + FRONTIER, int(t["end"][node])))
                d = t["q"][own][:, None] - c[numbers][None]
                yield -1 - own, numbers[np.einsum("nkd,nkd->nk", d, d).argmin(axis=1)]
        inner = ~one & ~leaf
        if inner.any():
            waiting.append((np.concatenate([t["left"][nodes[inner]], t["right"][nodes[inner]]]).astype(np.int64), np.concatenate([alive[inner]] * 2)))


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors; one without vectors stays."""
    k, dimensions = centroids.shape

    def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=object)
        for pdf in it:
            for _, row in pdf.iterrows():
                t = _read(row, dimensions)
                size = (t["end"] - t["start"]).astype(np.int64)
                own = np.zeros((k, dimensions), dtype=np.int64)
                for found, cluster in filtered(t, centroids):
                    whole = found[0] >= 0
                    at = found if whole else -1 - found
                    np.add.at(own, cluster, t["total"][at] if whole else t["q"][at])
                    np.add.at(n, cluster, size[at] if whole else 1)
                total = total + own
        used = np.flatnonzero(n)
        if not len(used):
            return
        yield pd.DataFrame({"cluster": used, "n": n[used], "total": [[str(x) for x in total[j]] for j in used]})

    wide = forest.mapInPandas(sums, "cluster int, n long, total array<string>").select("cluster", "n", F.posexplode("total").alias("at", "x"))
    rows = wide.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = centroids.copy()
    for r in rows:  # one for each component of each centroid
        out[r.cluster, r["at"]] = int(r.x) // r.n
    return out


def assigned(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector, the distance squared."""
    k, dimensions = centroids.shape

    def places(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for _, row in pdf.iterrows():
                t = _read(row, dimensions)
                cluster = np.empty(len(t["q"]), dtype=np.int64)
                for found, which in filtered(t, centroids):
                    if found[0] < 0:
                        cluster[-1 - found] = which
                    else:
                        for node, j in zip(found, which, strict=True):
                            cluster[t["start"][node] : t["end"][node]] = j
                d = t["q"] - centroids[cluster]
                ids = np.frombuffer(row["ids"], dtype=np.int64).reshape(-1, 2)
                yield pd.DataFrame({"vec_id": ids[:, 0], "there": ids[:, 1] == 1, "cluster": cluster, "distance": np.einsum("nd,nd->n", d, d)})

    rows = forest.mapInPandas(places, "vec_id long, there boolean, cluster int, distance long")
    return rows.select(F.when(F.col("there"), F.col("vec_id")).alias("vec_id"), "cluster", "distance")


def _by_cluster(values: dict[int, int | str], kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for j, v in values.items():
        out = F.when(F.col("cluster") == j, F.lit(v).cast(kind)).otherwise(out)
    return out


def cluster_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept.

    Vectors of another length, or with a null, a NaN or an infinity, give no row. A null
    id stays null, and is hashed as no digits. Rows that repeat an id or a vector each
    count. Ties go to the centroid of the smaller number. With fewer vectors than ``k``
    there are as many centroids as vectors; an empty table gives no rows. Components
    whose integers are beyond MOST are an error. Other columns are ignored.
    """
    spark = rows.sparkSession
    quantised = vectors(rows, id_col, vector_col, dimensions)
    centroids = first_centroids(quantised, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    with common.arrow_rows(spark, BLOCK):
        forest = common.written(trees(quantised), "trees")
    with common.arrow_rows(spark, TREES):
        for _ in range(rounds):
            after = moved(forest, centroids)
            if (after == centroids).all():
                break  # further rounds change nothing
            centroids = after
        found = common.written(assigned(forest, centroids), "assigned")
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = F.sha2(_by_cluster({j: ",".join(map(str, centroids[j].tolist())) for j in inertia}, "string"), 256)
    return found.select("vec_id", "cluster", "distance", _by_cluster(inertia, "long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), digest.alias("centroid_sha256"))
