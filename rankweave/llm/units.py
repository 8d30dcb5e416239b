"""Texts as sequences of units that a tokenizer encodes independently of each other, and memos of the units' ids.

A byte-level tokenizer never joins a space to what stands before it, so a text may be cut before each single space that follows a
character other than white space. A tokenizer that drops white space may be cut at every space. Words repeat, so each Python worker
keeps the ids of the units it has met; when the memo is full (by number or by characters, as texts without spaces are long units) it forgets rare
ones, which costs time and never changes a result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

CUT = re.compile(r"(?<=\S)(?= )")
FULL = 700_000
ODD_FULL = 30_000
CHARS = 16 << 20
ODD_CHARS = 4 << 20
LONG = 64
STOPS = ".,"
LATIN_END = "\u0250"

Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class _Places(dict):
    """Places of words; a new word gets the next place and waits to be encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.chars += len(word)
        self.new.append(word)
        return place


def ragged(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``table[start : start + size]`` one after another, and where each ends."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
    at += np.arange(total, dtype=np.int32)
    return table[at], ends


class UnitMemo:
    """Ids of texts as arrays of unsigned 32-bit integers.

    ``encode``: from a list of units to all their ids and the number of ids of each. ``joined``: whether a unit keeps the space before it
    (byte-level) or all spaces are dropped.
    """

    def __init__(self, encode: Encoder, joined: bool, full: int = FULL):
        self.encode, self.joined, self.full = encode, joined, full
        self.places = _Places()
        self.odd: dict[str, np.ndarray] = {}
        self.odd_chars = 0
        self._empty()

    def _empty(self) -> None:
        self.table, self.filled = np.zeros(1 << 16, "<u4"), 0
        self.starts, self.sizes, self.used = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.unsafe = np.zeros(0, bool)

    def _safe(self, word: str) -> bool:
        """Whether a text may be cut after the word, where a space follows."""
        return not self.joined or bool(word) and not word[-1].isspace()

    def _forget(self) -> None:
        """Keep words that were met again, and half of their counts; no long ones."""
        words = list(self.places)
        kept = np.flatnonzero((self.used > 2) & (np.fromiter(map(len, words), np.int64, len(words)) <= LONG))
        if len(kept) > self.full // 2:
            kept = kept[self.used[kept] > np.median(self.used[kept])]
        table, ends = ragged(self.table, self.starts[kept], self.sizes[kept])
        self.places = _Places()
        self.places.update((words[i], k) for k, i in enumerate(kept.tolist()))
        self.places.chars = sum(map(len, self.places))
        self.sizes, self.used, self.unsafe = self.sizes[kept], self.used[kept] // 2, self.unsafe[kept]
        self.starts = (ends - self.sizes).astype(np.int32)
        self.table, self.filled = table, len(table)

    def rest(self) -> None:
        """At the end of a task: keep only words that were met again, so that an idle worker is small."""
        self._forget()
        self.odd.clear()
        self.odd_chars = 0

    def _learn(self) -> None:
        """Encode the words that wait. Letters and a stop after them are never merged, so a word with a stop is its parts."""
        new, self.places.new = self.places.new, []
        if not new:
            return
        first = len(self.starts)
        whole, built, bases, stops = [], [], [], []
        places = self.places
        for k, w in enumerate(new):
            if w[-1:] in STOPS and w and (base := w[:-1]) and base[-1] < LATIN_END and base[-1].lower().isalpha() and base in places:
                built.append(k)
                bases.append(places[base])
                stops.append(w[-1])
            else:
                whole.append(k)
        ids, sizes = self.encode([f" {new[k]}" if self.joined else new[k] for k in whole])
        starts, lengths = np.zeros(len(new), np.int32), np.zeros(len(new), np.int32)
        starts[whole], lengths[whole] = self.filled + np.cumsum(sizes) - sizes, sizes
        self.starts, self.sizes = np.append(self.starts, starts), np.append(self.sizes, lengths)
        self._append(ids)
        if built:  # bases end in letters, so none of them is built itself
            stop_ids = {c: self._others([c])[0] for c in STOPS}
            n_stop = np.array([len(stop_ids[c]) for c in stops])
            own, ends = ragged(self.table, self.starts[bases], self.sizes[bases])
            after = np.concatenate([stop_ids[c] for c in stops])
            self.starts[first + np.array(built)] = self.filled + np.concatenate([[0], (ends + np.cumsum(n_stop))[:-1]])
            self.sizes[first + np.array(built)] = self.sizes[bases] + n_stop
            self._append(np.insert(own, np.repeat(ends, n_stop), after))
        self.used = np.append(self.used, np.zeros(len(new), np.int32))
        odd = [not w or w[-1].isspace() for w in new] if self.joined else np.zeros(len(new), bool)
        self.unsafe = np.append(self.unsafe, np.array(odd, bool))

    def _append(self, ids: np.ndarray) -> None:
        if self.filled + len(ids) > len(self.table):
            more = np.zeros(max(2 * len(self.table), self.filled + len(ids)), "<u4")
            more[: self.filled] = self.table[: self.filled]
            self.table = more
        self.table[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)

    def _others(self, units: list[str]) -> list[np.ndarray]:
        """Ids of units that aren't words after a space."""
        new = [u for u in dict.fromkeys(units) if u not in self.odd]
        if len(self.odd) + len(new) > ODD_FULL or self.odd_chars > ODD_CHARS:
            self.odd.clear()
            self.odd_chars = 0
            new = list(dict.fromkeys(units))
        self.odd_chars += sum(map(len, new))
        if new:
            ids, sizes = self.encode(new)
            self.odd.update(zip(new, np.split(ids, np.cumsum(sizes)[:-1]), strict=True))
        return [self.odd[u] for u in units]

    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Of each text, its ids."""
        if len(self.places) > self.full or self.places.chars > CHARS:
            self._forget()
        cut = [t.split(" ") for t in texts]
        heads = [c.pop(0) for c in cut] if self.joined else []  # a text's first word has no space before it
        bounds = np.cumsum([0, *map(len, cut)])
        places = np.fromiter(map(self.places.__getitem__, chain.from_iterable(cut)), np.int32, bounds[-1])
        del cut
        self._learn()
        self.used += np.bincount(places, minlength=len(self.used)).astype(np.int32)
        flat, ends = ragged(self.table, self.starts[places], self.sizes[places])
        of = np.concatenate([[0], ends])[bounds].tolist()
        out = [flat[a:b] for a, b in zip(of[:-1], of[1:], strict=True)]
        if self.joined:
            bad = np.concatenate([[0], np.cumsum(self.unsafe[places])])[bounds]
            slow = bad[1:] > bad[:-1]
            first = self._others([h if self._safe(h) else "" for h in heads])
            for i, (head, head_ids) in enumerate(zip(heads, first, strict=True)):
                if slow[i] or not self._safe(head) and len(head) < len(texts[i]):
                    out[i] = np.concatenate(self._others(CUT.split(texts[i])))
                elif head:
                    out[i] = np.concatenate([head_ids if self._safe(head) else self._others([head])[0], out[i]])
        return out


_MEMOS: dict[tuple, UnitMemo] = {}


def library_memo(path: str, joined: bool, full: int = FULL) -> UnitMemo:
    """Of the tokenizers library with the vocabulary in ``path``; one in each Python worker."""
    if (path, joined) not in _MEMOS:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _MEMOS[path, joined] = UnitMemo(_library_encoder(tokenizer), joined, full)
    return _MEMOS[path, joined]


def _library_encoder(tokenizer) -> Encoder:
    """Many units in one text, with a special token between them: the library splits at special tokens before all else."""
    special = next(((i, t.content) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)), None)

    def flat(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not units:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if special is None or any(special[1] in u for u in units):
            each = flat(units)
            return np.concatenate(each), np.array(list(map(len, each)))
        end, mark = special
        ids = np.concatenate([np.append(x, np.uint32(end)) for x in flat([mark.join(units[k : k + 256]) for k in range(0, len(units), 256)])])
        ends = np.flatnonzero(ids == end)
        return ids[ids != end], np.diff(ends, prepend=-1) - 1

    return encode
