"""BPE encoding and decoding by dynamic programming over prefixes.

An encoding of a word is fixed by the last token of each of its prefixes. A matching automaton lists, by
its suffix links, every vocabulary token that ends at a position. Of those exactly one can follow the last
token of the prefix before it: the one that byte pair merging would leave beside it, which a walk down the
two tokens' merge trees tells. That token is stored; back-pointers from the word's end give the ids.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import re
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.llm.common import slices

#: Split patterns of the word_bpe vocabulary, for any text and for ASCII.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
INF = 1 << 60
#: Words and token pairs that a Python worker remembers, of words twice as many for a while: some 50 MB.
REMEMBERED = 60_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in out)
    return out | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class _Words(dict):
    """word -> value, computed when missing. Of two generations the older goes when the newer is full, so memory is bounded and frequent words stay."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        out = self.older.get(word) or self.make(word)
        self[word] = out
        return out


class Bpe:
    """A byte-level BPE vocabulary with an end-of-word mark, read from a tokenizer.json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, end = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.split_special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        # a character with the end mark is one symbol: the character moved by 0x10000
        self.bytes = {b: c for b, c in byte_alphabet().items()}
        self.final = {c: chr(ord(c) + 0x10000) for c in self.bytes.values()}
        one = lambda t: t[: -len(end) - 1] + self.final[t[-len(end) - 1]] if end and t.endswith(end) and len(t) > len(end) else t
        self.pairs: dict[tuple[int, int], int] = {}
        left, right, self.rank = {}, {}, {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pairs[x, y] = rank
            if z not in left:  # the earliest merge that makes a token is the one that happens
                left[z], right[z], self.rank[z] = x, y, rank
        self.left, self.right = left, right
        auto = ahocorasick.Automaton()
        for t, i in vocab.items():
            s = one(t)
            if len(s) == 1 or i in left:
                auto.add_word(s, (i, len(s)))
        auto.make_automaton()
        self.auto = auto
        self.fits: dict[int, bool] = {}
        self.word = _Words(self._ids_and_text)

    def _ids_and_text(self, word: str) -> tuple[str, str]:
        ids = self.encode_word(word)
        return " ".join([str(i) for i in ids]), self.decode(ids)

    def _spine(self, token: int, down: dict[int, int]) -> list[tuple[int, int]]:
        """The nodes on one side of the token's merge tree from leaf to root, each with the rank of the merge that uses it up."""
        out, used = [], INF
        while True:
            out.append((token, used))
            if token not in down:
                return out[::-1]
            used, token = self.rank[token], down[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b leaves a and b: no merge over their border comes before what uses up its parts."""
        ls, rs = self._spine(a, self.right), self._spine(b, self.left)
        i = j = 0
        while True:
            (x, x_used), (y, y_used) = ls[i], rs[j]
            m = self.pairs.get((x, y))
            # of equal ranks the merge further left comes first
            if m is not None and m < x_used and m <= y_used:
                return False
            if x_used == y_used == INF:
                return True
            if x_used <= y_used:
                i += 1
            else:
                j += 1

    def encode_word(self, word: str) -> list[int]:
        s = "".join([self.bytes[b] for b in word.encode("utf-8")])
        s = s[:-1] + self.final[s[-1]]
        last, start_of = [-1] * len(s), [0] * len(s)
        fits = self.fits
        for end, (token, size) in self.auto.iter(s):
            if last[end] < 0:
                start = end - size
                if start >= 0:
                    before = last[start]
                    pair = before << 20 | token
                    if pair not in fits:
                        if len(fits) > 2 * REMEMBERED:
                            fits.clear()
                        fits[pair] = self.compatible(before, token)
                    if not fits[pair]:
                        continue
                last[end], start_of[end] = token, start
        out, at = [], len(s) - 1
        while at >= 0:
            out.append(last[at])
            at = start_of[at]
        return out[::-1]

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return WORD_ASCII.findall(text.lower())
        # lower-casing is per character, so sigma has no special form at a word's end
        return WORD.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is special, text) in order; control strings count as such in the raw text only."""
        if self.split_special is None or "<|" not in text:
            yield False, text
            return
        for k, part in enumerate(self.split_special.split(text)):
            if part:
                yield k % 2 == 1, part

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for special, part in self.parts(text):
            if special:
                out.append(self.special[part])
            else:
                for w in self.words(part):
                    out += self.encode_word(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a space, as for a vocabulary without a decoder."""
        return " ".join([self.tokens[i] for i in ids])

    def encode_and_decode(self, text: str) -> tuple[str, str]:
        """Ids joined by a space, and their decoded text, by remembered words."""
        ids, back = [], []
        for special, part in self.parts(text):
            if special:
                ids.append(str(self.special[part]))
                back.append(part)
            else:
                both = [*map(self.word.__getitem__, self.words(part))]
                ids += [x[0] for x in both]
                back += [x[1] for x in both]
        return " ".join(ids), " ".join(back)


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, *, ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ids=True token_ids and decoded.

    path: tokenizer.json, at the same place on every machine; by default the public vocabulary's. Null text
    is empty: no tokens. Rows are independent of each other, so repeated rows, null ids and extra columns don't matter,
    and an empty table gives no rows.
    """
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"token_ids": pa.list_(pa.int32()), "decoded": pa.string()} if ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path or vocabulary_path())
        for b in slices(batches, 256):
            rows = []
            for text in b.column("text").to_pylist():
                i, d = bpe.encode_and_decode(text or "")
                row = (i.count(" ") + 1 if i else 0, hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest())
                rows.append((*row, [int(x) for x in i.split()], d) if ids else row)
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *kinds])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>, decoded string" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op1_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
