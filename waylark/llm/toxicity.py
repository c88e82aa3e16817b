"""Toxicity by a small convolutional text classifier, trained in numpy.

A word is embedded as the sum of three hashed vectors: of the whole word and of
its first four and first five bytes, so that inflected forms share what they
begin with. Filters one, two and three words wide slide over the whole text; the
maximum of each over the text goes through a rectifier into a logistic layer.
Training follows the gradient through the places of the maxima, by Adagrad for
the vectors and Adam for the rest. On rows kept from training, a threshold is
chosen for each language, as told from the text's own function words; a score is
the logistic of the distance to it, so 0.5 is the threshold everywhere.

A score depends on the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import Words

WORD_BUCKETS, PREFIX_BUCKETS = 1 << 15, 1 << 14
PREFIXES = (4, 5)
SIZE = 16
FILTERS = 8
WIDTHS = (1, 2, 3)
EPOCHS = 8
BATCH = 32
#: Fewer rows are gone through more often, until there are so many steps.
LEAST_STEPS = 1200
#: A toxic text that is missed counts as so many clean ones that are rejected.
MISS_COST = 2
#: At most so many labelled rows of each class, and bytes of text, are learnt from; one row in CALIBRATION of them sets the thresholds.
MOST_ROWS = 3000
#: Bytes of all texts that one learns from, and of each; longer ones are passed over.
MOST_BYTES = 32 << 20
MOST_TEXT_BYTES = 1 << 20
CALIBRATION = 5
FOLDS = 5

#: Common function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in that is for with was it are this be from",
    "fr": "le la les de des et un une du que est pour dans qui au par sur pas",
    "de": "der die und das den von zu ist mit ein eine nicht des dem sich auf",
    "es": "el la los las de que y en un una por con para del se su es al",
}
LANGUAGES = (*FUNCTION_WORDS, "other")

_TO_SPACE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def prepared(text) -> bytes:
    """Lower case, with a space for each ASCII character that is no letter or digit; null as empty."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE) if isinstance(text, str) else b""


def _table_of_function_words() -> tuple[np.ndarray, np.ndarray]:
    votes: dict[int, np.ndarray] = {}
    for n, text in enumerate(FUNCTION_WORDS.values()):
        words = Words([text.encode()])
        for h in words.hashes().tolist():
            votes.setdefault(h, np.zeros(len(FUNCTION_WORDS)))[n] += 1
    keys = np.array(sorted(votes), dtype=np.uint64)
    return keys, np.array([votes[k] / votes[k].sum() for k in keys.tolist()])


_FUNCTION_KEYS, _FUNCTION_VOTES = _table_of_function_words()


def languages(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES of each text: that of the most function words, "other" without any."""
    at = np.searchsorted(_FUNCTION_KEYS, hashes)
    at[at == len(_FUNCTION_KEYS)] = 0
    hit = np.flatnonzero(_FUNCTION_KEYS[at] == hashes)
    total = np.zeros((len(words.count), len(FUNCTION_WORDS)))
    np.add.at(total, words.doc[hit], _FUNCTION_VOTES[at[hit]])
    return np.where(total.max(axis=1) > 0, total.argmax(axis=1), len(FUNCTION_WORDS)).astype(np.int64)


def features(words: Words, hashes: np.ndarray) -> np.ndarray:
    """The three rows of the embedding table of each word."""
    out = np.empty((len(hashes), 1 + len(PREFIXES)), dtype=np.int32)
    out[:, 0] = hashes % np.uint64(WORD_BUCKETS)
    for k, n in enumerate(PREFIXES):
        h = words.hashes(words.start, np.minimum(words.end, words.start + n))
        out[:, k + 1] = (h % np.uint64(PREFIX_BUCKETS)).astype(np.int32) + WORD_BUCKETS + k * PREFIX_BUCKETS
    return out


class Classifier:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        rows = WORD_BUCKETS + len(PREFIXES) * PREFIX_BUCKETS
        self.table = rng.normal(0, 0.1, (rows, SIZE)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = np.zeros(1, dtype=np.float32)
        self.shift = np.zeros(len(LANGUAGES))
        self.wordless = -2.0

    def _responses(self, x: np.ndarray, w: int) -> np.ndarray:
        """The filters of one width at each word; past the end of ``x`` there are zeros."""
        z = x @ self.filters[w][0]
        for j in range(1, WIDTHS[w]):
            z[:-j] += x[j:] @ self.filters[w][j]
        return z

    @staticmethod
    def _padded(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words if each text is followed by zeros, and where texts begin among the words."""
        gap = max(WIDTHS) - 1
        first = np.cumsum(count) - count
        return np.arange(int(count.sum())) + gap * np.repeat(np.arange(len(count)), count), first

    def _embedded(self, rows: np.ndarray, place: np.ndarray, texts: int) -> np.ndarray:
        x = np.zeros((len(rows) + (max(WIDTHS) - 1) * (texts + 1), SIZE), dtype=np.float32)
        x[place] = self.table[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            x[place] += self.table[rows[:, k]]
        return x

    def logits(self, rows: np.ndarray, count: np.ndarray) -> np.ndarray:
        pooled = np.zeros((len(count), FILTERS * len(WIDTHS)), dtype=np.float32)
        some = np.flatnonzero(count)
        if len(some):
            place, first = self._padded(count)
            x = self._embedded(rows, place, len(count))
            for w in range(len(WIDTHS)):
                top = np.maximum.reduceat(self._responses(x, w)[place], first[some], axis=0)
                pooled[some, w * FILTERS : (w + 1) * FILTERS] = np.maximum(top + self.bias[w], 0)
        return pooled @ self.out + self.base[0]

    def train(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        dense = [*self.filters, *self.bias, self.out, self.base]
        first = [np.zeros_like(p) for p in dense]
        second = [np.zeros_like(p) for p in dense]
        seen = np.full(len(self.table), 1e-3, dtype=np.float32)
        step = 0
        lengths = np.array([len(t) for t in texts])
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(texts))))):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                pick = order[a : a + BATCH]
                pick = pick[lengths[pick] > 0]
                if not len(pick):
                    continue
                step += 1
                self._step(np.concatenate([texts[i] for i in pick]), lengths[pick], labels[pick].astype(np.float32), dense, first, second, seen, step)

    def _step(self, rows, count, y, dense, first, second, seen, step) -> None:
        place, begin = self._padded(count)
        x = self._embedded(rows, place, len(count))
        pooled, where = [], []
        for w in range(len(WIDTHS)):
            z = self._responses(x, w)[place]
            top = np.stack([b + z[b : b + n].argmax(axis=0) for b, n in zip(begin, count, strict=True)])
            pooled.append(np.take_along_axis(z, top, axis=0) + self.bias[w])
            where.append(place[top])
        raw = np.concatenate(pooled, axis=1)
        act = np.maximum(raw, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.base[0], -30, 30)))
        d = (p - y) / len(y)
        grads: list[np.ndarray] = [None] * len(dense)
        k = len(WIDTHS)
        grads[2 * k], grads[2 * k + 1] = act.T @ d, np.array([d.sum()], dtype=np.float32)
        back = np.outer(d, self.out) * (raw > -0.1)  # a little beyond the rectifier's edge, so that filters don't die
        at = np.full(len(x), -1, dtype=np.int64)
        at[place] = np.arange(len(rows))
        ids, steps = [], []
        for w in range(k):
            g = back[:, w * FILTERS : (w + 1) * FILTERS]
            gw = np.zeros_like(self.filters[w])
            for j in range(WIDTHS[w]):
                pos = where[w] + j
                gw[j] = np.einsum("bfe,bf->ef", x[pos], g)
                word = at[pos]
                ok = word >= 0
                delta = g[..., None] * self.filters[w][j].T[None]
                ids.append(rows[word[ok]])
                steps.append(delta[ok])
            grads[w], grads[k + w] = gw, g.sum(axis=0)
        for i, (param, g) in enumerate(zip(dense, grads, strict=True)):
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.001 * (g * g - second[i])
            param -= 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        ids_all, step_all = np.concatenate(ids), np.concatenate(steps)
        for c in range(ids_all.shape[1]):
            u, inverse = np.unique(ids_all[:, c], return_inverse=True)
            g = np.zeros((len(u), SIZE), dtype=np.float32)
            np.add.at(g, inverse, step_all)
            seen[u] += (g * g).mean(axis=1)
            self.table[u] -= 0.1 * g / np.sqrt(seen[u])[:, None]

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, language: np.ndarray, share: float) -> None:
        """A threshold for each language of 20 rows or more of either class, else that of all rows.

        It lies where errors are fewest if ``share`` of all texts are toxic, in the
        middle of such a stretch.
        """

        def best(z: np.ndarray, y: np.ndarray) -> float:
            order = np.argsort(z, kind="stable")
            z, y = z[order], y[order]
            below = np.cumsum(np.r_[0, y]) / max(1, y.sum())
            above = 1 - np.cumsum(np.r_[0, 1 - y]) / max(1, (1 - y).sum())
            cuts = np.r_[z[0] - 1, (z[1:] + z[:-1]) / 2, z[-1] + 1]
            error = MISS_COST * share * below + (1 - share) * above
            at = np.flatnonzero(error <= error.min() + 1e-9)
            return float((cuts[at[0]] + cuts[at[-1]]) / 2)

        # a text without words tells nothing, so its score is the share itself
        self.wordless = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        if not len(logits) or not 0 < labels.sum() < len(labels):
            return
        self.shift[:] = best(logits, labels)
        for n in range(len(LANGUAGES)):
            mine = language == n
            if min(labels[mine].sum(), (1 - labels[mine]).sum()) >= 20:
                self.shift[n] = best(logits[mine], labels[mine])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """0 to 1 for each whole text."""
        out = np.empty(len(texts))
        for a, b in common.passes(texts, 512 << 10):
            words = Words(texts[a:b])
            h = words.hashes()
            z = self.logits(features(words, h), words.count) - self.shift[languages(words, h)]
            z = np.where(words.count > 0, z, self.wordless)
            out[a:b] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """A classifier learnt from labelled rows outside the held-out fold.

    Learns from MOST_ROWS rows of each class at most, those with the least hash of
    their id, and of these from whole texts of MOST_TEXT_BYTES at most, in the order of
    that hash while they come to MOST_BYTES together; only those reach the driver. Of
    rows that repeat an id the least text counts. Rows with a null id or label
    are left out. Without labelled rows of both classes every score is about 0.5.
    """
    common.text_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(MOST_ROWS)
        picked = part if picked is None else picked.union(part)
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).where(F.octet_length("text") <= MOST_TEXT_BYTES).join(F.broadcast(picked), "id")
    found = common.written(found.groupBy("id", "y").agg(F.min("text").alias("text")), "labelled")
    # ids and lengths of 2 * MOST_ROWS rows at most, so that one task can add them up
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("id"), "id"))
    few = found.select("id", upto.alias("upto")).where(F.col("upto") <= MOST_BYTES).select("id")
    rows = sorted(((r["id"], r["y"], prepared(r["text"])) for r in found.join(F.broadcast(few), "id").collect()), key=lambda r: common.mix(np.array([r[0]], dtype=np.int64).view(np.uint64))[0])
    texts, y, cal = [t for _, _, t in rows], [label for _, label, _ in rows], [i % CALIBRATION == 0 for i in range(len(rows))]
    model = Classifier()
    labelled, held = np.array(y, dtype=np.int64), np.array(cal, dtype=bool)
    if not len(labelled) or not 0 < labelled.sum() < len(labelled):
        return model
    learnt, spoken = [], np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        words = Words([t])
        h = words.hashes()
        learnt.append(features(words, h))
        spoken[i] = languages(words, h)[0]
    train = np.flatnonzero(~held)
    model.train([learnt[i] for i in train], labelled[train])
    z = np.array([model.logits(learnt[i], np.array([len(learnt[i])]))[0] for i in range(len(texts))])
    model.calibrate(z[held], labelled[held], spoken[held], share)
    return model


def held_out(doc_id):
    """Whether the CRC-32 of the id's decimal text is divisible by FOLDS; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Whole texts are scored. A null text counts as empty; a text without words gets
    the share of toxic rows as its score. Each row is scored by itself, so repeated rows get equal
    scores. A null id is not held out. An empty table gives no rows. Other columns are
    ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.release()
        for pdf in it:
            yield pd.DataFrame({"d": pdf["d"], "score": model.value.scores([prepared(t) for t in pdf["t"]])})

    scored = docs.select(F.col(id_col).cast("string").alias("d"), F.col(text_col).alias("t")).mapInPandas(run, "d string, score double")
    return scored.select(F.col("d").cast("long").alias("doc_id"), held_out(F.col("d")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text isn't predicted to be toxic, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    def run(it):
        import pyarrow as pa

        common.release()
        for batch in it:
            score = model.value.scores([prepared(t) for t in batch[text_col].to_pylist()])
            yield batch.filter(pa.array(score < 0.5))

    return docs.mapInArrow(run, docs.schema)
