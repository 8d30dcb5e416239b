"""Byte-level BPE in which a segment tree over the ranks of adjacent pairs gives every next merge.

Leaf ``i`` of the tree holds ``rank * size + i`` for the pair that begins at symbol ``i``, or a value above all ranks; an inner node holds
the least of its two children. The root is then the leftmost pair of lowest rank, and a merge changes three leaves, each in logarithmic
time, until the root says that no pair can merge.

Each Python worker keeps the ids of words it has met (see ``units``). Null texts count as empty; an empty text has no ids and decodes to an
empty text; strings of special tokens in a text become those tokens, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.shared import map_batches, table
from rankweave.llm.units import LONG, UnitMemo

# Fixed value: the published pattern of byte-level BPE that splits a text into words before any merge.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

WORDS_KEPT = 250_000
NEVER = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 for itself, the others from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class SegmentTreeBpe:
    """Encodes and decodes with the vocabulary of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        contents = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.special_at = re.compile(f"({'|'.join(contents)})") if contents else None
        every = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.bytes_of = [bytes(map(byte_of.__getitem__, t)) if all(c in byte_of for c in t) else t.encode() for t in (every.get(i, "") for i in range(max(every) + 1))]
        self.decimal_of = [str(i) for i in range(max(every) + 1)]
        self.words: dict[str, bytes] = {}
        self.memo = UnitMemo(self._units, joined=True)

    def merge(self, ids: list[int]) -> list[int]:
        """Apply all merges to a word's symbols."""
        n = len(ids)
        if n < 2:
            return ids
        pairs = self.pairs.get
        size = 1 << (n - 1).bit_length()
        tree = [NEVER] * (2 * size)
        new_id = [0] * n
        for i in range(n - 1):
            if (hit := pairs((ids[i], ids[i + 1]))) is not None:
                tree[size + i] = hit[0] * size + i
                new_id[i] = hit[1]
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                k >>= 1
                value = value if value < other else other
                if tree[k] == value:
                    break
                tree[k] = value

        def pair(i: int, j: int) -> None:
            hit = pairs((ids[i], ids[j])) if j < n else None
            if hit is None:
                put(i, NEVER)
            else:
                new_id[i] = hit[1]
                put(i, hit[0] * size + i)

        while (root := tree[1]) != NEVER:
            i = root % size
            j = after[i]
            ids[i] = new_id[i]
            put(j, NEVER)
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            pair(i, after[i])
            if before[i] >= 0:
                pair(before[i], i)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = np.array(self.merge([self.byte_ids[b] for b in word.encode()]), "<u4").tobytes()
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            if len(word) <= LONG:
                self.words[word] = got
        return got

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [self._text(u) for u in units]
        return np.frombuffer(b"".join(each), "<u4"), np.array([len(x) // 4 for x in each], np.int64)

    def _text(self, text: str) -> bytes:
        out = []
        for k, part in enumerate(self.special_at.split(text) if self.special_at else [text]):
            out += [np.array([self.special[part]], "<u4").tobytes()] if k % 2 else map(self._word, WORDS.findall(part))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.memo.ids(texts)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_CODERS: dict[str, SegmentTreeBpe] = {}


def coder(path: str) -> SegmentTreeBpe:
    """One for each Python worker and vocabulary file."""
    if path not in _CODERS:
        _CODERS[path] = SegmentTreeBpe(path)
    return _CODERS[path]


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, ids, decoded."""

    def work(batch: pa.RecordBatch) -> dict:
        bpe = coder(tokenizer)
        ids = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
        return {"doc_id": batch.column(0), "ids": ids, "decoded": [bpe.decode(x) for x in ids]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, work, "doc_id long, ids array<int>, decoded string", "text")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens and the digests of the decimal ids and of the decoded text."""

    def work(batch: pa.RecordBatch) -> dict:
        bpe = coder(tokenizer)
        ids = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
        return {
            "doc_id": batch.column(0),
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(",".join(map(bpe.decimal_of.__getitem__, x.tolist())).encode()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "text")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
