"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is the multiset of its runs of five lower-cased words. Each element
owns the region [0, weight) x [0, inf) of weight and rank; a Poisson process
with one dart a unit of area, drawn from hashes of the element alone, fills the
regions of all elements once and for all. A document sees the darts below its
weights. Every dart belongs to one of K coordinates, and a document's signature
keeps the dart of least rank in each, so that two signatures agree in a
coordinate with the probability of the weighted Jaccard similarity. As only
darts of rank up to (K ln K + 2K) / total weight are thrown, a signature costs a
few hashes for each element instead of K; documents that miss a coordinate
throw again up to twice that rank.

Signatures meet in BANDS bands of ROWS coordinates. What follows keeps groups
of any size whole without making their pairs:

1. A map task keeps a union-find of its texts: equal texts, and texts with an
   equal band, become one component, and only a spanning star of each leaves the
   task. A band's key travels once, with its component's least id, so a bucket
   holds a row for each map task at most, whatever its size.
2. Components of tasks that share a key are contracted to the least of them, and
   what is left is joined by rounds of contraction.
3. A component of more than ``BLOCK`` texts is thinned out first. Cells that more
   than ``RARE`` of its texts have are common. Two texts have no more cells in
   common than the lesser of their numbers of common cells, and the rarer cells
   that they share. Pairs that share rarer cells are listed, at most ``RARE`` - 1
   for a cell, and meet where this bound allows a link. Texts that no size and
   number of common cells in their component allow a link without shared rarer
   cells go no further: so those around a passage, a line or a base text that many
   have, whose own words make up too much of them.
4. What stays of a component meets in blocks of ``BLOCK``, each with some heads of
   the component. Within a block, exact weighted Jaccard joins texts to clusters: a
   text is held against the pivot of each cluster, and against a cluster's other
   members unless the triangle inequality of the Jaccard distance rules them out.
   So a block's clusters are the connected components of all its links, and what is
   linked to a head is linked across blocks.
5. Texts that aren't in the component's largest class by then meet every other block,
   ``BLOCK`` of them at a time, in the same way. Of groups around a common part
   these are few. Where they are many, of common cells all but an eighth and yet
   unlike each other, the work is that of all pairs of blocks, but no task grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import Words, mix

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 18, 4
K = BANDS * ROWS
BLOCK = 128
#: Cells of a large component that more of its texts have are common ones; pairs of texts are listed for the others.
RARE = 4
#: Cells that a map task gathers before it sends them on, and texts whose cells a bucket of cells has a share of.
GATHERED, BUCKET_TEXTS = 1_000_000, 4000
#: Rows of one component are dealt over so many partitions where they meet its totals.
SALTS = 64
#: Keys that a map task remembers before it starts afresh.
REMEMBERED = 400_000
#: Rounds after which contraction is taken to be broken; two of them leave three quarters of the nodes or less, as expected.
MOST_ROUNDS = 200

#: Layers of rank: [0, 1/64), doubling up to 1, then of height 1. ``_POISSON[i]`` has the cumulated probabilities of 0, 1, ... darts in layer i of a unit of weight.
_LOW = 64


def _layer(i: int) -> tuple[float, float]:
    """Where layer ``i`` begins, and its height."""
    if i == 0:
        return 0.0, 1.0 / _LOW
    if i <= 6:
        return 2.0 ** (i - 1) / _LOW, 2.0 ** (i - 1) / _LOW
    return float(i - 6), 1.0


def _cumulated(mean: float) -> np.ndarray:
    p, out, total = np.exp(-mean), [], 0.0
    for n in range(1, 40):
        total += p
        out.append(total)
        p *= mean / n
        if 1 - total < 1e-17:
            break
    return np.array(out)


_POISSON = [_cumulated(_layer(i)[1]) for i in range(8)]
_UNIT = 2.0**-53


def shingle_cells(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of each unit of weight: the j-th occurrence of a shingle in a text has a hash of its own.

    A text of fewer than ``n`` words, but one at least, is a single shingle. Sets of
    these hashes have the Jaccard similarity that the multisets of shingles have.
    """
    h = words.hashes()
    count = words.count
    runs = common.sliding_sum_hash(h, n, 21)
    at = np.flatnonzero(words.doc[: len(runs)] == words.doc[n - 1 :]) if len(runs) else np.empty(0, dtype=np.int64)
    doc, value = words.doc[at], runs[at] if len(runs) else h[:0]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = (np.cumsum(count) - count)[short]
        value = np.concatenate([value, mix(words.hashes(words.start[first], words.end[first + count[short] - 1]) + np.uint64(77))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if len(doc):
        new = np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])]
        first = np.flatnonzero(new)
        rank = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
        value = mix(value + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return doc, value


def _darts(cells: np.ndarray, layer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the cell, identity and rank of each dart of a layer."""
    low, height = _layer(layer)
    h = mix(cells ^ np.uint64((layer + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
    n = np.searchsorted(_POISSON[min(layer, 7)], (h >> np.uint64(11)).astype(np.float64) * _UNIT, side="right")
    some = np.flatnonzero(n)
    n = n[some]
    cell = np.repeat(some, n)
    nth = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
    dart = mix(h[cell] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
    rank = low + height * ((mix(dart) >> np.uint64(11)).astype(np.float64) * _UNIT)
    return cell, dart, rank


def signatures(doc: np.ndarray, cells: np.ndarray, texts: int, k: int = K) -> np.ndarray:
    """A row of ``k`` dart identities for each text that has a cell (zeros for others)."""
    out = np.zeros((texts, k), dtype=np.uint64)
    weight = np.bincount(doc, minlength=texts)
    limit = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        mine = np.flatnonzero(todo[doc])
        d, c = doc[mine], cells[mine]
        reach = limit[d]
        found = []
        layer = 0
        while True:
            low = _layer(layer)[0]
            idx = np.flatnonzero(reach > low)
            if not len(idx):
                break
            cell, dart, rank = _darts(c[idx], layer)
            cell = idx[cell]
            ok = rank <= reach[cell]
            found.append((d[cell[ok]], dart[ok], rank[ok]))
            layer += 1
        who = np.concatenate([x[0] for x in found])
        dart = np.concatenate([x[1] for x in found])
        rank = np.concatenate([x[2] for x in found])
        slot = who * k + (mix(dart ^ np.uint64(0x5DEECE66D)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((dart, rank, slot))
        slot = slot[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else order
        filled = np.bincount(slot[first] // k, minlength=texts) == k
        good = filled[slot[first] // k]
        out.reshape(-1)[slot[first][good]] = dart[order[first]][good]
        todo &= ~filled
        limit = limit * 2
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """The key of each band of each signature."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    out = np.zeros((len(sig), BANDS), dtype=np.uint64)
    for j, f in enumerate(common.seeds(ROWS, 31)):
        out += mix(parts[:, :, j] + np.uint64(j)) * f
    return mix(out + common.seeds(BANDS, 32)[None, :])


class _Task:
    """What a map task knows of its texts until it sends it on: equal texts, components of texts that share bands, and whose each band key is."""

    def __init__(self) -> None:
        self.texts: dict[tuple[int, int], int] = {}
        self.keys: dict[int, int] = {}
        self.parent: dict[int, int] = {}
        self.least: dict[int, int] = {}
        self.equal: list[tuple[int, int]] = []

    def first(self, text: tuple[int, int], me: int) -> bool:
        """Whether a text hasn't been there before."""
        old = self.texts.get(text)
        if old is None:
            self.texts[text] = me
            return True
        if old != me:
            self.equal.append((me, old))
            self.least[old] = min(me, self.least.get(old, old))
        return False

    def root(self, x: int) -> int:
        up = self.parent
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def band(self, key: int, me: int) -> None:
        old = self.keys.setdefault(key, me)
        if old != me and (a := self.root(old)) != (b := self.root(me)):
            self.parent[max(a, b)] = min(a, b)
            self.parent.setdefault(min(a, b), min(a, b))

    def full(self) -> bool:
        return len(self.keys) > REMEMBERED or len(self.equal) > REMEMBERED

    def rows(self) -> Iterator[pd.DataFrame]:
        """Links to the least id, of itself too (kind 0: equal texts; 1: members of a component), and a row (kind 2) for each key."""
        name = self.least.get
        reps: dict[int, int] = {}
        for x in self.parent:
            r, n = self.root(x), name(x, x)
            reps[r] = min(n, reps.get(r, n))
        equal = [(i, name(first, first)) for i, first in [*self.equal, *((f, f) for f in self.least)]]
        for kind, found in ((0, equal), (1, [(name(x, x), reps[self.root(x)]) for x in self.parent]), (2, [(k, reps[self.root(i)] if i in self.parent else name(i, i)) for k, i in self.keys.items()])):
            if found:
                e = np.array(found, dtype=np.int64)
                yield pd.DataFrame({"kind": np.full(len(e), kind, dtype=np.int32), "key": e[:, 0], "id": e[:, 1]})


def _sketch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From (id, text): what ``_Task.rows`` says of the task's texts."""
    common.release()
    task = _Task()
    for pdf in it:
        raw = [t.lower().encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in pdf["text"]]
        ids = pdf["id"].to_numpy()
        for a, b in common.passes(raw):
            if task.full():
                yield from task.rows()
                task = _Task()
            w = Words(raw[a:b])
            doc, cells = shingle_cells(w)
            n = b - a
            lead = np.zeros(n, dtype=bool)
            # the same cells, so the same words up to their order: similarity 1
            total = [np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)]
            for t, seed in zip(total, (1, 2), strict=True):
                np.add.at(t, doc, mix(cells + np.uint64(seed)))
            for i, (x, y, c) in enumerate(zip(total[0].tolist(), total[1].tolist(), w.count.tolist(), strict=True)):
                lead[i] = bool(c) and task.first((x, y), int(ids[a + i]))
            stay = lead[doc]
            number = np.cumsum(lead) - 1
            sig = signatures(number[doc[stay]], cells[stay], int(lead.sum()))
            for me, row in zip(ids[a:b][lead].tolist(), band_keys(sig).view(np.int64).tolist(), strict=True):
                for key in row:
                    task.band(key, me)
    yield from task.rows()


def contracted(rows: DataFrame, rounds: int = 2) -> DataFrame:
    """Links (a, b), b < a, that join the ids of ``rows`` (key, id) that share a key, about one for each id: in each round an id goes to the least id under any of its keys."""
    links = None
    while True:
        own = Window.partitionBy("key")
        met = rows.select("key", "id", F.min("id").over(own).alias("least"), F.max("id").over(own).alias("most")).where("least < most")
        met = common.written(met.select("key", "id", "least"), "met")
        if not rounds or not met.limit(1).count():
            rest = met.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
            return rest if links is None else links.union(rest)
        rounds -= 1
        labels = common.written(met.groupBy("id").agg(F.min("least").alias("to")), "met")
        new = labels.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b"))
        links = new if links is None else links.union(new)
        rows = met.select("key", "id").join(labels, "id").select("key", F.col("to").alias("id")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each end of the links (a, b): the least id of its component.

    Rounds of contraction: each node goes to the first of its closed neighbourhood,
    and links between the nodes that are left go on. The order is that of ids in even
    rounds, which takes stars around their least id at once, and that of a new hash
    in odd ones, which leaves three quarters of any graph's nodes or less, as expected.
    Work is linear in the links, as no neighbour lists are built. Each round is written,
    so that lineage stays short. Joins to hubs are left to adaptive execution's
    splitting of skewed partitions: one side of each has a node once.
    """
    links = edges.where("a <> b").select("a", "b")
    links = common.written(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ends")
    steps: list[DataFrame] = []
    while links.limit(1).count():
        if len(steps) > MOST_ROUNDS:
            raise RuntimeError("contraction did not settle")
        order = (lambda c: F.col(c)) if len(steps) % 2 == 0 else (lambda c, seed=len(steps): F.xxhash64(c, F.lit(seed)))
        own = lambda c: F.struct(order(c).alias("o"), F.col(c).alias("id"))
        to = common.written(links.groupBy("a").agg(F.min(own("b")).alias("b")).select(F.col("a").alias("id"), F.least(own("a"), F.col("b"))["id"].alias("rep")), "steps")
        steps.append(to)
        for end in ("a", "b"):
            links = links.join(to.withColumnRenamed("id", end), end).withColumn(end, F.col("rep")).drop("rep")
        links = common.written(links.where("a <> b").select("a", "b").distinct(), "ends")
    if not steps:
        return links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    roots = steps[-1].withColumnRenamed("rep", "root")
    for to in reversed(steps[:-1]):
        roots = to.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    roots = common.written(roots, "roots")
    # hashes may have led to another member than the least
    least = roots.groupBy("root").agg(F.min("id").alias("least")).where("least <> root")
    return roots.join(least, "root", "left").select("id", F.coalesce("least", "root").alias("root"))


class _Sets:
    """Sorted hash sets with exact Jaccard similarity."""

    __slots__ = ("sets",)

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets

    def similarity(self, i: int, j: int) -> float:
        a, b = self.sets[i], self.sets[j]
        if len(a) > len(b):
            a, b = b, a
        if not len(a):
            return 0.0
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        both = int((b[at] == a).sum())
        return both / (len(a) + len(b) - both)


def cluster(sets: list[np.ndarray], level: float = SIMILARITY) -> tuple[list[int], list[int]]:
    """Of each set the pivot of its cluster, and that of the first cluster in the connected component of all pairs of ``level`` or more."""
    s = _Sets(sets)
    pivots: list[int] = []
    members: list[list[tuple[int, float]]] = []
    parent: list[int] = []

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    own, far = [0] * len(sets), [0.0] * len(sets)
    for i in range(len(sets)):
        home, near = -1, []
        for c, p in enumerate(pivots):
            x = s.similarity(p, i)
            if x >= level:
                if home < 0:
                    home, far[i] = c, 1 - x
                else:
                    parent[max(root(c), root(home))] = min(root(c), root(home))
            else:
                near.append((c, 1 - x))
        if home < 0:
            home = len(pivots)
            pivots.append(i)
            members.append([])
            parent.append(home)
        for c, d in near:
            if root(c) == root(home):
                continue
            for j, r in members[c]:
                if d - r <= 1 - level + 1e-12 and s.similarity(j, i) >= level:
                    parent[max(root(c), root(home))] = min(root(c), root(home))
                    break
        own[i] = home
        if pivots[home] != i:
            members[home].append((i, far[i]))
    return [pivots[c] for c in own], [pivots[root(c)] for c in own]


def _text_sets(texts) -> list[np.ndarray]:
    raw = [t.lower().encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    out: list[np.ndarray] = []
    for a, b in common.passes(raw):
        doc, cells = shingle_cells(Words(raw[a:b]))
        order = np.lexsort((cells, doc))
        cells = cells[order]
        cut = np.searchsorted(doc[order], np.arange(b - a + 1))
        out += [cells[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
    return out


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
    return list(zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True))


def _in_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a block's texts to the least id of their group, of itself too, heads left out (kind 1), and of the group to the heads in it (kind 3)."""
    out = []
    pdf = pdf.sort_values(["block", "head", "id"], ascending=[True, False, True], kind="stable").reset_index(drop=True)
    sets = _text_sets(pdf["text"])
    ids, heads = pdf["id"].to_numpy(), pdf["head"].to_numpy()
    for a, b in _runs(pdf["block"].to_numpy()):
        _, group = cluster(sets[a:b])
        found: dict[int, list[int]] = {}
        for i, g in enumerate(group):
            found.setdefault(g, []).append(a + i)
        for rows in found.values():
            led = sorted({int(ids[i]) for i in rows if heads[i]})
            others = [int(ids[i]) for i in rows if not heads[i]]
            least = min(others or led)
            out += [(1, i, least) for i in others]
            out += [(3, least, h) for h in led if h != least]
    return pd.DataFrame(out, columns=["kind", "a", "b"])


def _gathered(buckets: int):
    """From (id, comp, text): (kind 0) text, id, component and number of cells of each text; (kind 1) by bucket of cells, which text has which cell, as bytes. A text is named by a hash of its id and cells."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.release()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> pd.DataFrame:
            cells, texts = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (mix(cells) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            pairs = np.stack([cells[order], texts[order]], axis=1)
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = [(k, pairs[x:y].tobytes()) for k, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if x < y]
            held.clear()
            return pd.DataFrame([(1, k, 0, 0, 0, raw) for k, raw in some], columns=["kind", "key", "id", "comp", "n", "cells"])

        for pdf in it:
            sets = _text_sets(pdf["text"])
            n = np.array([len(x) for x in sets], dtype=np.int64)
            ids, comps = pdf["id"].to_numpy(dtype=np.int64), pdf["comp"].to_numpy(dtype=np.int64)
            sums = np.array([int(mix(x).sum(dtype=np.uint64)) for x in sets], dtype=np.uint64)
            names = mix(mix(ids.view(np.uint64) + np.uint64(5)) + sums)
            yield pd.DataFrame({"kind": 0, "key": names.view(np.int64), "id": ids, "comp": comps, "n": n, "cells": None})
            for x, name, comp in zip(sets, names, comps.view(np.uint64), strict=True):
                # cells are counted in each component by itself
                held.append((mix(x ^ mix(np.array([comp]))), np.full(len(x), name)))
                size += len(x)
                if size >= GATHERED:
                    yield sent()
                    size = 0
        if held:
            yield sent()

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of buckets of cells: how many common cells a text has there (kind 0), and how many rarer ones two texts share there (kind 1)."""
    out = []
    pdf = pdf.sort_values("key", kind="stable").reset_index(drop=True)
    for a, b in _runs(pdf["key"].to_numpy()):
        pairs = np.frombuffer(b"".join(pdf["cells"].iloc[a:b]), dtype=np.uint64).reshape(-1, 2)
        cells, texts = pairs[:, 0], pairs[:, 1].astype(np.int64)
        order = np.lexsort((texts, cells))
        cells, texts = cells[order], texts[order]
        new = np.r_[True, (cells[1:] != cells[:-1]) | (texts[1:] != texts[:-1])]  # a row that repeats counts once
        cells, texts = cells[new], texts[new]
        first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        count = np.diff(np.append(first, len(cells)))
        name, n = np.unique(texts[np.repeat(count, count) > RARE], return_counts=True)
        out.append(pd.DataFrame({"kind": 0, "a": name, "b": 0, "n": n}))
        met = []
        for k in range(2, RARE + 1):
            at = first[count == k]
            met += [np.stack([texts[at + i], texts[at + j]], axis=1) for i in range(k) for j in range(i + 1, k)]
        if met:
            both, n = np.unique(np.concatenate(met), axis=0, return_counts=True)
            out.append(pd.DataFrame({"kind": 1, "a": both[:, 0], "b": both[:, 1], "n": n}))
    return pd.concat(out, ignore_index=True)


def _thinned(texts: DataFrame, wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the texts of large components ``wide`` (id, comp): those that may have links without sharing rarer cells (id, comp, n, common), and the pairs (a, b) of ids that share such cells and may be linked."""
    sized = common.written(texts.join(wide.hint("merge"), "id").select("id", "comp", "text").mapInPandas(_gathered(max(16, -(-wide.count() // BUCKET_TEXTS))), "kind int, key long, id long, comp long, n long, cells binary"), "cells")
    shared = common.written(common.map_groups(sized.where("kind = 1").select("key", "cells"), "key", _shared, "kind int, a long, b long, n long", least_rows=1, heavy=True), "shared")
    counts = shared.where("kind = 0").groupBy("a").agg(F.sum("n").alias("common")).withColumnRenamed("a", "key")
    # the sizes that a partner without shared rarer cells can have end at reach, as 0.8 of both sizes less their common cells is asked for
    most = (1 + SIMILARITY) / SIMILARITY
    sized = sized.where("kind = 0").select("key", "id", "comp", "n").distinct().join(counts, "key", "left").withColumn("common", F.coalesce("common", F.lit(0)))
    sized = common.written(sized.withColumn("reach", most * F.col("common") - F.col("n") + 1e-6), "sized")
    # sizes by steps of a twentieth: the least size and the farthest reach of each are bounds
    steps = sized.groupBy("comp", F.floor(F.log(F.col("n") + 1.0) * 20).alias("step")).agg(F.min("n").alias("n"), F.max("reach").alias("reach"))
    steps = steps.groupBy("comp").agg(F.collect_list(F.struct("n", "reach")).alias("steps"))
    met = _dealt(sized, steps).where(F.exists("steps", lambda y: (y["n"] <= F.col("reach")) & (y["reach"] >= F.col("n"))))
    stay = common.written(met.select("id", "comp", "n", "common"), "stay")
    ends = [sized.select(F.col("key").alias(end), F.col("id").alias(f"id_{end}"), F.col("n").alias(f"n_{end}"), F.col("common").alias(f"common_{end}")) for end in ("a", "b")]
    pairs = shared.where("kind = 1").groupBy("a", "b").agg(F.sum("n").alias("n")).join(ends[0], "a").join(ends[1], "b")
    pairs = pairs.where((F.least("common_a", "common_b") + F.col("n")) * most + 1e-6 >= F.col("n_a") + F.col("n_b"))
    return stay, pairs.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _dealt(rows: DataFrame, totals: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` (with id and comp) joined to ``totals`` by comp. Rows of one component are dealt over SALTS partitions, so ``totals`` should hold large components only."""
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["comp", "salt"], how).drop("salt")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) for each row of ``docs``: the least id of its class of near duplicates, its own id where it has none.

    A class is a connected component of documents whose multisets of five-word
    shingles have a weighted Jaccard similarity of 0.8 or more; words are split at
    white space and lower-cased. A text of one to four words is one shingle. Null
    and empty texts have no shingles and are in no class but their own. Rows that
    repeat an id are one document with several texts, and share its class. A null
    id is a document without links: its class is null. An empty table gives no rows.
    Other columns are ignored.
    """
    common.text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    sketch = common.written(known.mapInPandas(_sketch, "kind int, key long, id long"), "bands")
    equal = sketch.where("kind = 0").select(F.col("key").alias("id"), F.col("id").alias("lead"))
    inside = sketch.where("kind = 1").select(F.col("key").alias("id"), F.col("id").alias("rep"))
    across = components(contracted(sketch.where("kind = 2").select("key", "id")))

    # a task's component goes where its least id goes
    parts = inside.join(across.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("comp"))
    parts = common.written(parts.union(across).distinct(), "parts")
    # a filter of bounded size keeps texts without a partner from travelling
    texts = common.likely(known, "id", parts.select("id"))
    schema = "kind int, a long, b long"
    met = lambda rows: common.written(common.map_groups(texts.join(rows.hint("merge"), "id"), "block", _in_blocks, schema, weigh="text", heavy=True), "links")
    alone = F.lit(False).alias("head")

    large = common.written(parts.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK), "large")
    if not large.limit(1).count():
        links = met(parts.select("id", alone, F.xxhash64("comp").alias("block")))
        labels = links.select(F.col("a").alias("id"), F.col("b").alias("label"))
        more = None
    else:
        sides = common.written(_dealt(parts, large, "left"), "sides")
        stay, pairs = _thinned(texts, sides.where("size is not null").select("id", "comp"))
        ids = stay.select("id", "comp").distinct()
        # of several heads one is likely to be near most: the first, the shortest, that with the least of its own
        by = lambda *c: F.min(F.struct(*c, F.col("id").alias("head")))["head"]
        blocks = stay.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.array_distinct(F.array(F.min("id"), by(F.col("n").alias("n")), by((-F.col("common") / F.col("n")).alias("own")))).alias("heads"))
        blocks = common.written(blocks, "blocks")
        placed = _dealt(ids, blocks)
        led = F.array_contains("heads", F.col("id")) & (F.col("blocks") > 1)
        here = F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        placed = placed.select("id", "comp", led.alias("head"), "blocks", F.explode(F.when(led, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(here)).alias("nth"))
        placed = common.written(placed, "placed")
        small = sides.where("size is null").select("id", alone, F.xxhash64("comp").alias("block"))
        links = met(small.union(placed.select("id", "head", F.xxhash64("comp", "nth").alias("block"))))
        labels = links.where("kind = 1").select(F.col("a").alias("id"), F.col("b").alias("label"))
        labels = labels.union(placed.where("head").select("id", F.col("id").alias("label"))).distinct()
        led_by = components(links.where("kind = 3").select("a", "b")).withColumnRenamed("id", "label")
        labels = common.written(labels.join(led_by, "label", "left").select("id", F.coalesce("root", "label").alias("label")), "labels")

        # those outside the largest class meet every block of their component, BLOCK of them at a time
        wide = common.written(placed.where("blocks > 1").select("id", "comp", "blocks", "nth").join(labels, "id"), "wide")
        classes = wide.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("comp").agg(F.max(F.struct("n", "label"))["label"].alias("main"))
        apart = common.written(_dealt(wide, classes).where("label <> main").select("id", "comp", "blocks").distinct(), "apart")
        chunks = apart.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
        every = _dealt(wide, chunks).select("id", "comp", "nth", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        rest = _dealt(apart, chunks).select("id", "comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("nth"), F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"))
        meet = every.union(rest).distinct().select("id", alone, F.xxhash64("comp", "nth", "chunk").alias("block"))
        # of listed pairs the partners of one text are a block
        told = F.xxhash64("a", F.lit("pair")).alias("block")
        meet = meet.union(pairs.select(F.col("b").alias("id"), alone, told)).union(pairs.select(F.col("a").alias("id"), alone, told).distinct())
        more = met(meet).where("a <> b").select("a", "b")
        for end in ("a", "b"):  # between the classes that the ids are in
            more = more.join(labels.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")

    homes = parts.select("id").distinct().join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    if more is not None:
        homes = homes.join(components(more).withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("root", "label").alias("label"))
    homes = common.written(homes, "homes")
    copies = equal.join(homes.withColumnRenamed("id", "lead"), "lead", "left").select("id", F.coalesce("label", "lead").alias("label"))
    told = common.written(homes.union(copies).distinct(), "told")
    # an id that repeats with several texts may have several labels: these are one class
    several = told.groupBy("id").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("id", "least")
    same = told.join(several, "id").where("label <> least").select(F.col("label").alias("a"), F.col("least").alias("b")).distinct()
    if same.limit(1).count():
        told = told.join(components(same).withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("root", "label").alias("label"))
    classes = told.groupBy("id").agg(F.min("label").alias("label"))
    return rows.select("id").join(classes, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce(F.least("label", "id"), "id").alias("class_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their class, with all their columns."""
    gone = near_groups(docs, id_col, text_col).where("doc_id <> class_id").select("doc_id").distinct()
    # qualified, as docs may have a column of any name
    return docs.alias("_docs").join(gone.alias("_gone"), F.col(f"_docs.`{id_col}`").cast("long") == F.col("_gone.doc_id"), "left_anti")
