"""Packing of tokenised documents into sequences: first-fit decreasing with a
tournament tree of bin capacities, in randomised groups of documents.

Documents are dealt into groups of about ``GROUP_TOKENS`` tokens by a hash of their id, and
each group is packed by itself. In a group, the whole multiples of the sequence
length that a document holds become full sequences; the rests are placed in
order of decreasing length, each in the first sequence with room. A tree whose
leaves are the room of the sequences and whose inner nodes are the maximum of
their children finds that sequence in logarithmic time. As documents may be cut,
the last sequences are then cut up to fill the room that is left in the others;
at most one sequence of a group stays partly filled. That one is cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEQUENCE = 4096
#: Tokens of a group, about; a group is packed in the memory of one task.
GROUP_TOKENS = 2_000_000
#: Characters a token takes, at least about, to tell from text lengths how many groups there will be. It only sets the number of groups.
CHARS_PER_TOKEN = 3
REMEMBERED = 400_000
#: Words for one call of the library.
TOGETHER = 2000
#: Text bytes whose words are looked up together, about.
PASS_BYTES = 3 << 20
#: Characters that the normaliser leaves alone but for simple lower case, as a class for RE2: Latin letters but the dotted capital I, and common punctuation. Four control characters are no white space to the vocabulary, but are to Arrow.
PLAIN = r"\x{0}-\x{1b}\x{20}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20bf}"



class Tournament:
    """Rooms of up to ``n`` bins; ``first(size)`` is the first bin with so much room."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.tree = [room] * (2 * self.leaves)

    def first(self, size: int) -> int:
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        return at - self.leaves

    def take(self, leaf: int, size: int) -> None:
        tree = self.tree
        at = leaf + self.leaves
        tree[at] -= size
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best


def pack(lengths: list[int], capacity: int = SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold each token of each document once."""
    full: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        whole = n - n % capacity
        full += [[(doc, s, capacity)] for s in range(0, whole, capacity)]
        if n > whole:
            rest.append((doc, whole, n - whole))
    rest.sort(key=lambda p: (-p[2], p[0]))
    tree = Tournament(len(rest), capacity)
    bins: list[list[tuple[int, int, int]]] = []
    for piece in rest:
        leaf = tree.first(piece[2])
        if leaf == len(bins):
            bins.append([])
        bins[leaf].append(piece)
        tree.take(leaf, piece[2])
    # fill what room is left from the emptiest sequences on
    bins.sort(key=lambda b: -sum(p[2] for p in b))
    room = [capacity - sum(p[2] for p in b) for b in bins]
    lo, hi = 0, len(bins) - 1
    while lo < hi:
        if not room[lo]:
            lo += 1
        elif not bins[hi]:
            hi -= 1
        else:
            doc, start, n = bins[hi].pop()
            take = min(n, room[lo])
            bins[lo].append((doc, start, take))
            room[lo] -= take
            if take < n:
                bins[hi].append((doc, start + take, n - take))
            room[hi] += take
    bins = [b for b in bins if b]
    out = full + [b for b in bins if sum(p[2] for p in b) == capacity]
    for b in (b for b in bins if sum(p[2] for p in b) < capacity):
        left = sum(p[2] for p in b)
        pieces = b[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            part: list[tuple[int, int, int]] = []
            while size:
                doc, start, n = pieces.pop()
                take = min(n, size)
                part.append((doc, start, take))
                size -= take
                if take < n:
                    pieces.append((doc, start + take, n - take))
            out.append(part)
    return out


def _classes() -> np.ndarray:
    """0 for white space, 1 for letters, 2 for digits, 3 for the rest, by code point; those beyond the table are 3."""
    chars = [chr(i) for i in range(0x2100)]
    return np.array([0 if c.isspace() else 1 if (k := unicodedata.category(c)[0]) == "L" else 2 if k == "N" else 3 for c in chars] + [3], dtype=np.uint8)


_CLASS = _classes()
_SHORT = [ord(c) for c in "stmd"]
_LONG = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]


def cut_words(texts: list[str]) -> tuple[str, np.ndarray]:
    """All texts as one, with white space between words, and how many words each has.

    Words are those of the vocabulary's pattern: runs of letters, single digits, runs
    of other characters, and before these the contractions (an apostrophe and one of
    s, t, re, ve, m, ll, d, at the beginning of a word).
    """
    code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _CLASS[np.minimum(code, len(_CLASS) - 1)]
    before = np.zeros_like(kind)
    before[1:] = kind[:-1]
    start = (kind != 0) & ((kind != before) | (kind == 2))
    at = np.flatnonzero((code == 39) & start)
    if len(at):
        ahead = np.concatenate([code, np.zeros(3, dtype=np.uint32)])
        one, two = ahead[at + 1], ahead[at + 2]
        size = np.where(np.isin(one, _SHORT), 1, 0)
        for a, b in _LONG:
            size = np.where((one == a) & (two == b), 2, size)
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        end = at + 1 + size
        end = end[end < len(code)]
        start[end] |= kind[end] != 0
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    total = np.zeros(len(code) + 1, dtype=np.int32)
    np.cumsum(start, out=total[1:])
    counts = np.diff(total[np.minimum(ends, len(code))], prepend=0)
    spaced = np.insert(code, np.flatnonzero(start & (before != 0)), 32)
    return spaced.tobytes().decode("utf-32-le", "surrogatepass"), counts


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class WordTokens:
    """Token ids of texts, from the library's ids of distinct words.

    The ids of a text are those of its words, one after another, as the vocabulary's
    pattern cuts them. A batch of texts is cut at once and Arrow codes the words as a
    dictionary; only words not met before go to the library, many
    at a time. As just the last token of a word carries the word-end mark, their ids
    are told apart again. Texts with characters beyond PLAIN, or with what may be a
    special token, go to the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {"": b""}

    def encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Ids of each text as 16-bit integers; null as empty."""
        if len(self.words) > REMEMBERED:
            self.words = {"": b""}
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, f"[^{PLAIN}]|<\\|").to_numpy(zero_copy_only=False))
        spaced, counts = cut_words([t.lower() for t in texts.to_pylist()])
        split = pc.utf8_split_whitespace(pa.array([spaced]))
        coded = split.flatten().dictionary_encode()
        del spaced
        distinct = coded.dictionary.to_pylist()
        known = list(map(self.words.get, distinct))
        new = [i for i, ids in enumerate(known) if ids is None]
        self._learn([distinct[i] for i in new])
        for i in new:
            known[i] = self.words[distinct[i]]
        flat = np.frombuffer(b"".join(known), dtype="<u2")
        size = np.fromiter(map(len, known), dtype=np.int32, count=len(known)) // 2
        first = np.cumsum(size, dtype=np.int32) - size
        index = coded.indices.to_numpy()
        index = index[size[index] > 0]  # white space at the ends gives empty words
        if len(index) != counts.sum():
            raise ValueError("words were cut in two ways")
        n = size[index]
        ends = np.zeros(len(n) + 1, dtype=np.int32)
        np.cumsum(n, out=ends[1:])
        at = np.repeat(first[index] - ends[:-1], n)
        at += np.arange(len(at), dtype=np.int32)
        ids = flat[at]
        del at, n
        cut = ends[np.r_[0, np.cumsum(counts)]]
        out = [ids[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for i in odd:
            out[i] = np.frombuffer(self.whole(texts[i].as_py()), dtype="<u2")
        return out

    def _learn(self, new: list[str]) -> None:
        for a in range(0, len(new), TOGETHER):
            some = new[a : a + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u2")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):  # words of texts that go there whole needn't be cut as the vocabulary cuts them
                self.words.update((w, self.whole(w)) for w in some)
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(some, (2 * ends).tolist(), strict=True):
                self.words[w] = raw[at:end]
                at = end

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()


@lru_cache(maxsize=4)
def word_tokens(path: str) -> WordTokens:
    """One for each Python worker, so that its next tasks know the words of those before."""
    return WordTokens(path)


common.CACHES.append(word_tokens.cache_clear)


def _pack_groups(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pieces of whole groups."""
    pdf = pdf.sort_values(["grp", "doc_id", "ids"], kind="stable", na_position="first").reset_index(drop=True)
    grp = pdf["grp"].to_numpy()
    cut = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
    out = []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(pdf)], strict=True):
        ids = [np.frombuffer(x, dtype="<u2").astype("<u4") for x in pdf["ids"].iloc[a:b]]
        lengths = [len(x) for x in ids]
        doc_ids = pdf["doc_id"].iloc[a:b].tolist()
        for n, sequence in enumerate(pack(lengths, capacity)):
            at = 0
            for doc, start, length in sequence:
                piece = ids[doc][start : start + length]
                out.append((doc_ids[doc], start, length, zlib.crc32(piece.tobytes()), lengths[doc], (int(grp[a]) << 24) | n, at))
                at += length
    return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its text's ids and then ``end_id``, so a null or empty
    text has one token. Ids must fit 16 bits. Each row is a document of its own:
    rows that repeat an id are packed each, with starts from 0. Null ids are packed
    too. An empty table gives no rows. Other columns are ignored. ``vocabulary`` is
    the path of a JSON file on the executors.
    """
    common.text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    groups = max(1, round(((size["chars"] or 0) / CHARS_PER_TOKEN + size["n"]) / GROUP_TOKENS))
    tail = np.array([end_id], dtype="<u2").tobytes()

    def tokens(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokens(vocabulary)
        for batch in it:
            common.trim()
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy()
            ends = np.flatnonzero(np.diff(np.cumsum(sizes) // PASS_BYTES, append=-1)) + 1
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                ids = [x.tobytes() + tail for x in coder.encode(batch["text"].slice(a, b - a))]
                yield pa.RecordBatch.from_arrays([batch["grp"].slice(a, b - a), batch["doc_id"].slice(a, b - a), pa.array(ids, pa.binary())], names=["grp", "doc_id", "ids"])

    # the text takes part in the hash, so that rows of one id spread too
    keyed = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.coalesce(F.length("text"), F.lit(0)), F.lit(7)), F.lit(groups)))
    coded = keyed.select("grp", "doc_id", "text").mapInArrow(tokens, "grp long, doc_id long, ids binary")
    return common.map_groups(coded, "grp", lambda pdf: _pack_groups(pdf, capacity), PIECE, least_rows=1)
