"""BPE encoding and decoding with a trie of distinct words.

Byte-level BPE has a property that lets a word be encoded left to right: two
tokens may stand side by side just if encoding their joined bytes gives these
two tokens, and the encoding of a prefix ends with the longest token whose
predecessor (the last token of the remaining, shorter prefix) may stand before
it. So the state of a prefix is its last token, and a longer word continues from
the states of any prefix it shares. Distinct words of a batch go into a trie,
which sorted order walks depth-first: each word keeps the states of the prefix
that it shares with its forerunner and adds its own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The published split of byte-level BPE: contractions, runs of letters, of digits, of other characters, of white space.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words that a task remembers before it starts afresh.
REMEMBERED = 400_000
#: Text bytes whose new words share a trie.
TRIE_BYTES = 6 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 itself, then code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A vocabulary in the tokenizers library's JSON format, byte-level, without a normaliser."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): n for n, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.by_id = {i: s for s, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._may: dict[int, bool] = {}
        self._ends = ahocorasick.Automaton()  # the tokens that end at each byte of a word
        for token, i in self.ids.items():
            self._ends.add_word(token.decode("latin-1"), (i, len(token)))
        self._ends.make_automaton()
        size = max(self.by_id) + 1
        self._len = np.zeros(size, dtype=np.int64)
        for i, s in self.by_id.items():
            self._len[i] = len(s)
        self._sizes = self._len.tolist()
        self._at = np.cumsum(self._len) - self._len
        self._flat = np.frombuffer(b"".join(self.by_id.get(i, b"") for i in range(size)), dtype=np.uint8)

    def merged(self, word: bytes) -> list[bytes]:
        """Plain BPE: the pair of least rank is merged, leftmost first, as long as there is one."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get((parts[i], parts[i + 1]), 1 << 60), i))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_adjoin(self, left: int, right: int) -> bool:
        if len(self._may) > 2_000_000:
            self._may.clear()
        x, y = self.by_id[left], self.by_id[right]
        known = self._may[left << 32 | right] = self.merged(x + y) == [x, y]
        return known

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words, by the depth-first walk of their trie."""
        out: dict[bytes, list[int]] = {}
        may, ends, longest, length = self._may.get, self._ends.iter, self.longest, self._sizes
        last = [-1]  # last[i]: last token of the prefix of i bytes
        before = ""
        for word in sorted(words):
            text = word.decode("latin-1")
            shared = 0
            most = min(len(text), len(before))
            if text[:most] == before[:most]:
                shared = most
            else:
                while text[shared] == before[shared]:
                    shared += 1
            del last[shared + 1 :]
            done = shared
            if shared < len(text):
                for at, (token, n) in ends(text, max(0, shared + 1 - longest)):  # at each byte the longest first
                    if at < done:
                        continue
                    left = last[at + 1 - n]
                    if left >= 0:
                        ok = may(left << 32 | token)
                        if ok is None:
                            ok = self.may_adjoin(left, token)
                        if not ok:
                            continue
                    last.append(token)
                    done = at + 1
            if done != len(text):
                raise ValueError(f"no token ends a prefix of {word!r}")
            end, found = len(text), []
            while end:
                token = last[end]
                found.append(token)
                end -= length[token]
            found.reverse()
            out[word] = found
            before = text
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens, special ones too."""
        n = self._len[ids]
        at = np.repeat(self._at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self._flat[at].tobytes()

    def pieces(self, text: str) -> list:
        """Words of a text as strings, and the ids of special tokens as ints."""
        if self.parts is None or not any(s in text for s in self.special):
            return SPLIT.findall(text)
        out: list = []
        for part in self.parts.split(text):
            out += [self.special[part]] if part in self.special else SPLIT.findall(part)
        return out


class Encoder:
    """Encodes texts with the words it has met; forgets them at a bound."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.known: dict[object, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        split = [self.bpe.pieces(t) for t in texts]
        new = {w for words in split for w in words if w not in known}
        raw = {w: w.encode("utf-8", "surrogatepass") for w in new if isinstance(w, str)}
        found = self.bpe.encode_words(list(raw.values()))
        for w, b in raw.items():
            ids = found[b]
            known[w] = pack(f"<{len(ids)}I", *ids)
        for w in new:
            if isinstance(w, int):
                known[w] = pack("<I", w)
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u4") for words in split]


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that its next tasks know the words of those before."""
    return Encoder(load(path))


common.CACHES.append(encoder.cache_clear)


def encode_and_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ids and decoded text where ``keep_ids`` is set.

    Whole texts are encoded, whatever their length. A null or empty text has no
    tokens and decodes to the empty text. Special tokens that a text spells out get
    their id, and decoding gives them back. Each row stands for itself, so repeated
    rows and null ids give a row each; an empty table gives none. ``vocabulary`` is
    the path of a JSON file on the executors.
    """
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in it:
            texts = [t or "" for t in batch["t"].to_pylist()]
            out: list[tuple] = []
            for a, b in common.passes(texts, TRIE_BYTES):
                for ids in coder.encode(texts[a:b]):
                    text = coder.bpe.decode(ids).decode("utf-8", "replace")
                    row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                    out.append((*row, ids.astype(np.int32).tolist(), text) if keep_ids else row)
            columns = [batch["d"], pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())]
            if keep_ids:
                columns += [pa.array([x[3] for x in out], pa.list_(pa.int32())), pa.array([x[4] for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    common.text_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).mapInArrow(run, T.StructType(fields))
