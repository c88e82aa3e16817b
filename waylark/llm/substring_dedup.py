"""Substring dedup by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. Its minimiser is the least hash among
its runs of ``MINIMISER`` words. Consecutive windows that share a minimiser
travel as one packed string (a super-k-mer) to the bucket of that minimiser, so
equal windows always meet. There, words get exact ids, windows get exact ids by
ranking pairs of ids of doubling length, and one sort by (window, document,
start) finds every window that also starts earlier.

What keeps the shuffle small and even:

* a first pass counts the places of minimisers into a bitmap of bounded size;
  windows whose minimiser has one place in the corpus cannot repeat and do not
  travel,
* equal super-k-mers of one map task are combined: only the earliest travels,
  the others are known to be repeats at once,
* a minimiser that starts more than 1/2000 of all super-k-mers (at most 2000
  can) is dealt by single windows instead, again combined in the map task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import Words

WINDOW = 20
MINIMISER = 5
#: Above this many bytes of packed strings, a map task sends on what it has combined.
COMBINE_BYTES = 16 << 20
HOT_SHARE = 2000
HOT_LEAST = 1000


def _slide(x: np.ndarray, n: int, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) of each run of ``n`` values, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = least(x[: len(x) - step], x[step:])
        have += step
    return x


def _minima(words: Words, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of ``m`` words, minimiser of each window, and the starts of windows inside one text."""
    n = len(words.start)
    if n < window:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    runs = common.sliding_sum_hash(words.hashes(), m, 5)
    return runs, _slide(runs, window - m + 1, np.minimum), np.flatnonzero(words.doc[: n - window + 1] == words.doc[window - 1 :])


def _chosen(words: Words, window: int, m: int) -> np.ndarray:
    """The hash at each place that is the minimiser of a window. Equal windows at two starts have theirs at two places."""
    runs, least, at = _minima(words, window, m)
    if not len(at):
        return runs[:0]
    span = window - m + 1
    cover = np.zeros(len(runs) + span - 1, dtype=np.uint64)  # of a run's windows, which begin up to ``span`` - 1 before it
    cover[at + span - 1] = least[at]
    return runs[runs == _slide(cover, span, np.maximum)]


def _super_kmers(words: Words, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer."""
    _, least, at = _minima(words, window, m)
    if not len(at):
        return at, at, least[:0]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), least[at[first]]


def _positions(mins: np.ndarray, bits: int) -> np.ndarray:
    return (mins >> np.uint64(8)).astype(np.int64) & np.int64(bits - 1)


def _merged(doc: np.ndarray, text: np.ndarray, start: np.ndarray, count: np.ndarray) -> pd.DataFrame:
    """A row for each document: its ranges of windows as int32 pairs (start, count), adjoining ones merged."""
    order = np.lexsort((start, text, doc))
    doc, text, start, count = doc[order], text[order], start[order], count[order]
    same = np.zeros(len(doc), dtype=bool)
    same[1:] = (doc[1:] == doc[:-1]) & (text[1:] == text[:-1])
    reach = start + count
    new = ~same
    new[1:] |= start[1:] > reach[:-1]  # equal starts may hold ranges of several lengths; that only leaves ranges unmerged
    first = np.flatnonzero(new)
    ends = np.maximum.reduceat(reach, first) if len(first) else reach
    doc, text, start = doc[first], text[first], start[first]
    pairs = np.empty((len(first), 2), dtype="<i4")
    pairs[:, 0], pairs[:, 1] = start, ends - start
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])]) if len(doc) else first
    to = np.append(cut[1:], len(doc))
    return pd.DataFrame({"doc": doc[cut], "th": text[cut], "ranges": [pairs[a:b].tobytes() for a, b in zip(cut, to, strict=True)]})


def _send(held: dict[bytes, tuple], ties: list[tuple[bytes, tuple]], gone: list[tuple], window: int) -> Iterator[pd.DataFrame]:
    if held:
        values = [*held.values(), *(v for _, v in ties)]
        yield pd.DataFrame({"bucket": np.array([v[4] for v in values], dtype=np.int64), "pack": [*held, *(p for p, _ in ties)], "doc": np.array([v[0] for v in values], dtype=np.int64), "th": np.array([v[2] for v in values], dtype=np.int64), "start": np.array([v[1] for v in values], dtype=np.int32), "ranges": None})
    if gone:
        a = np.array(gone, dtype=np.int64)
        out = _merged(a[:, 0], a[:, 1], a[:, 2], a[:, 3])
        out["bucket"] = out["doc"]
        out["pack"], out["start"] = None, 0
        yield out[["bucket", "pack", "doc", "th", "start", "ranges"]]


def _pack(it: Iterator[pd.DataFrame], bits: int, twice: np.ndarray, hot: np.ndarray, window: int, m: int) -> Iterator[pd.DataFrame]:
    held: dict[bytes, tuple] = {}
    ties: list[tuple[bytes, tuple]] = []  # of rows that share an id and a start, in other texts
    gone: list[tuple] = []
    size = 0
    common.release()
    for pdf in it:
        texts = common.encoded(pdf["text"])
        ids, hashes = pdf["doc"].to_numpy(), pdf["th"].to_numpy()
        for a, b in common.passes(texts):
            w = Words(texts[a:b])
            first, count, mins = _super_kmers(w, window, m)
            pos = _positions(mins, bits)
            keep = (twice[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1
            first, count, mins, pos = first[keep], count[keep], mins[keep], pos[keep]
            if not len(first):
                continue
            single = np.isin(pos, hot) if len(hot) else np.zeros(len(first), dtype=bool)
            if single.any():
                n = count[single]
                each = np.repeat(first[single], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                own = common.mix(w.hashes(w.start[each], w.end[each + window - 1]))
                first = np.concatenate([first[~single], each])
                count = np.concatenate([count[~single], np.ones(len(each), dtype=count.dtype)])
                mins = np.concatenate([mins[~single], own])
            base = np.cumsum(w.count) - w.count
            doc = w.doc[first]
            begin, end = w.start[first].tolist(), w.end[first + count + window - 2].tolist()
            start, d, t = (first - base[doc]).tolist(), ids[a:b][doc].tolist(), hashes[a:b][doc].tolist()
            raw = w.raw
            for s, e, at, i, h, n, key in zip(begin, end, start, d, t, count.tolist(), mins.view(np.int64).tolist(), strict=True):
                pack = raw[s:e]
                old = held.get(pack)
                if old is None:
                    held[pack] = (i, at, h, n, key)
                    size += len(pack)
                elif (i, at) < old[:2]:
                    gone.append((old[0], old[2], old[1], n))
                    held[pack] = (i, at, h, n, key)
                elif (i, at) != old[:2]:
                    gone.append((i, h, at, n))
                elif h != old[2]:
                    ties.append((pack, (i, at, h, n, key)))
                    size += len(pack)
            if size > COMBINE_BYTES or len(gone) > 400_000:
                yield from _send(held, ties, gone, window)
                held, ties, gone, size = {}, [], [], 0
    yield from _send(held, ties, gone, window)


def _ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact ids of pairs of ids."""
    return pd.factorize((left.astype(np.int64) << 32) | right.astype(np.int64))[0]


def window_ids(words: np.ndarray, window: int) -> np.ndarray:
    """For each start, an id that is equal for equal runs of ``window`` word ids, and only for these."""
    power, ranks = 1, {1: words}
    while power * 2 <= window:
        r = ranks[power]
        ranks[power * 2] = _ranked(r[: len(r) - power], r[power:])
        power *= 2
    out, have = ranks[power], power
    while have < window:
        step = max(p for p in ranks if p <= window - have)
        r = ranks[step][have:]
        n = min(len(out), len(r))
        out = _ranked(out[:n], r[:n])
        have += step
    return out


def _judge(pdf: pd.DataFrame, window: int) -> pd.DataFrame | None:
    """Ranges of windows that also start earlier, of whole buckets."""
    passed = pdf["pack"].isna().to_numpy()
    done = pdf.loc[passed, ["doc", "th", "ranges"]]
    pdf = pdf[~passed]
    if not len(pdf):
        return done
    packs = pdf["pack"].tolist()
    words = [p.split(b" ") for p in packs]
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.empty(int(n.sum()), dtype=object)
    flat[:] = [x for w in words for x in w]
    del words, packs
    wid = window_ids(pd.factorize(flat)[0], window)
    del flat
    count = n - (window - 1)
    row = np.repeat(np.arange(len(n)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(n) - n, count) + offset
    wid = wid[at]
    doc, th = pdf["doc"].to_numpy()[row], pdf["th"].to_numpy()[row]
    start = pdf["start"].to_numpy().astype(np.int64)[row] + offset
    order = np.lexsort((start, doc, wid))
    wid, doc, th, start = wid[order], doc[order], th[order], start[order]
    new = np.r_[True, wid[1:] != wid[:-1]]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (doc != doc[lead]) | (start != start[lead])
    if not later.any():
        return done
    doc, th, start = doc[later], th[later], start[later]
    out = _merged(doc, th, start, np.ones(len(doc), dtype=np.int64))
    return pd.concat([done, out], ignore_index=True) if len(done) else out


def _kept(text: bytes, ranges, window: int) -> tuple[int, int, bytes]:
    words = text.split()
    if ranges is None or not len(ranges):
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for r in ranges:
        pairs = np.frombuffer(r, dtype="<i4").reshape(-1, 2).astype(np.int64)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 0] + pairs[:, 1] + window - 1, -1)
    stay = np.cumsum(edge)[:-1] == 0
    return len(words), int((~stay).sum()), b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """``docs`` with ``text`` replaced by its kept words, and n_words and n_removed added.

    Words are runs of anything but the six ASCII white-space characters. Each
    word that lies in a window whose words also start earlier (smaller id, or
    the same id and an earlier start) goes; kept words are joined by one space.
    A null text counts as having no words and gives an empty text; so does an
    empty one. Texts with fewer than ``window`` words stay as they are. Rows
    with one id count as one document: of windows that several of its rows have at
    one start none is earlier. A null id comes first. An empty table gives no rows. Other
    columns are kept, and columns named n_words or n_removed are replaced.
    """
    spark = docs.sparkSession
    common.text_batches(spark)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(common.NULL_ID))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(key.alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = common.filter_bits(int(chars) // 45)

    def starts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = common.encoded(pdf["text"])
            for a, b in common.passes(texts):
                mins = _chosen(Words(texts[a:b]), window, minimiser)
                if len(mins):
                    pos, n = np.unique(_positions(mins, bits), return_counts=True)
                    yield pd.DataFrame({"pos": pos.astype(np.int32), "n": n.astype(np.int32)})

    counted = rows.select("text").mapInPandas(starts, "pos int, n int").groupBy("pos").agg(F.sum("n").alias("n")).where("n >= 2")
    counted = common.written(counted, "minimisers")
    total = counted.agg(F.sum("n")).first()[0] or 0
    most = max(HOT_LEAST, total // HOT_SHARE)
    hot = np.array(sorted(r[0] for r in counted.where(F.col("n") > F.lit(most)).select("pos").collect()), dtype=np.int64)  # HOT_SHARE at most
    twice = np.zeros(bits // 8, dtype=np.uint8)
    for bucket, packed in common.position_bitmap(counted).collect():  # bits / 8 bytes at most
        at = (bucket - 1) * 4096
        part = np.frombuffer(packed, dtype=np.uint8)[: len(twice) - at]
        twice[at : at + len(part)] = part
    shared = spark.sparkContext.broadcast((twice, hot))

    packs = rows.mapInPandas(lambda it: _pack(it, bits, *shared.value, window, minimiser), "bucket long, pack binary, doc long, th long, start int, ranges binary")
    found = common.map_groups(packs, "bucket", lambda pdf: _judge(pdf, window), "doc long, th long, ranges binary", weigh="pack", least_rows=20_000, least_bytes=6 << 20)
    ranges = found.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_list("ranges").alias("_ranges"))

    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    own = {c: f"c{i}" for i, c in enumerate(names)}  # as docs may have a column of any name
    whole = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], key.alias("_doc"), F.xxhash64(text).alias("_th")).join(ranges, ["_doc", "_th"], "left").drop("_doc", "_th")
    schema = T.StructType([T.StructField(c, whole.schema[n].dataType) for c, n in own.items()] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:  # Arrow, so that other columns pass unchanged
            out = [_kept(t, r, window) for t, r in zip(common.encoded(batch[own[text_col]].to_pylist()), batch["_ranges"].to_pylist(), strict=True)]
            texts = pa.array([x[2].decode("utf-8", "surrogatepass") for x in out], pa.string())
            columns = {c: texts if c == text_col else batch[n] for c, n in own.items()}
            yield pa.RecordBatch.from_pydict(columns | {"n_words": pa.array([x[0] for x in out], pa.int64()), "n_removed": pa.array([x[1] for x in out], pa.int64())})

    return whole.mapInArrow(cut, schema)
