"""Token ids of whole texts, batch by batch, with a public byte-level tokenizer."""

from __future__ import annotations

from itertools import chain

import numpy as np

from pollweave.llm import kernels

VOCABULARY = "byte_bpe_50k.json"
# Known pieces of text are kept, this many at most; then the memory starts anew.
MEMORY = 1_500_000

# Classes of bytes for the tokenizer's split pattern
#   's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
_OTHER, _LETTER, _DIGIT, _SPACE = 0, 1, 2, 3
_CLASS = np.zeros(256, np.int8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_CLASS[[*range(0x30, 0x3A)]] = _DIGIT
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE

# Texts that hold other bytes than these go to the tokenizer whole. Lead bytes C3 to C9
# are the letters U+00C0 to U+024F (two of them, U+00D7 and U+00F7, are no letters).
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x20, 0x7F), *range(0x09, 0x0E), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = True
_PLAIN[0x27] = False  # the apostrophe opens contractions


def path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes batches; pieces of text seen before are looked up by a 64-bit hash.

    The tokenizer splits a text to pieces and encodes each by itself. Pieces of plain
    texts are found for the whole batch at once, and each distinct one is encoded once;
    all other texts go through the tokenizer as they are.
    """

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self._forget()

    def _forget(self):
        # Sorted hashes of known pieces and each piece's number: a large table and one of
        # recent pieces, which is merged into it now and then.
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        self.place, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _numbers(self, distinct) -> np.ndarray:
        """The number of every known piece, -1 of a new one."""
        out = np.full(len(distinct), -1, np.int64)
        for known, number in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
                same = known[at] == distinct
                out[same] = number[at[same]]
        return out

    def _learn(self, distinct, numbers, texts: list) -> None:
        found = self._encode(texts)
        counts = np.fromiter((len(x) for x in found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        self.place = np.concatenate([self.place, len(self.ids) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.ids = np.concatenate([self.ids, flat])
        (old, old_numbers), (recent, recent_numbers) = self.tables
        both = _merged(recent, recent_numbers, distinct, numbers)
        if len(both[0]) * 8 > len(old):
            self.tables = [_merged(old, old_numbers, *both), (distinct[:0], numbers[:0])]
        else:
            self.tables[1] = both

    def _encode(self, texts: list) -> list:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def batch(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column's texts, and each row's first; null is empty."""
        data, offsets = kernels.utf8(column)
        rows = len(offsets) - 1
        odd = ~_PLAIN[data]
        # "<|" may open a special token, which the tokenizer finds before it splits
        opens = np.flatnonzero(data[:-1] == 0x3C) if len(data) else np.zeros(0, np.int64)
        odd[opens[data[opens + 1] == 0x7C]] = True
        signs = np.flatnonzero(data == 0xC3)
        signs = signs[signs + 1 < len(data)]
        after = data[signs + 1]
        odd[signs[(after == 0x97) | (after == 0xB7)]] = True
        special = np.zeros(rows, bool)
        special[np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1] = True
        starts, ends = self._pieces(data, offsets)
        first = np.searchsorted(starts, offsets)
        plain = np.repeat(~special, np.diff(first))
        starts, ends = starts[plain], ends[plain]
        place, count, ids = self._look_up(data, starts, ends)
        per_row = np.zeros(rows, np.int64)
        own = np.flatnonzero(~special)
        own = own[np.diff(first)[own] > 0]
        if len(own):
            begin = np.cumsum(np.where(special, 0, np.diff(first)))[own] - np.diff(first)[own]
            per_row[own] = np.add.reduceat(count, begin)
        found = []
        if special.any():
            body = data.tobytes()
            rows_of = np.flatnonzero(special)
            found = self._encode([body[offsets[r] : offsets[r + 1]].decode() for r in rows_of])
            per_row[rows_of] = [len(x) for x in found]
        bounds = np.concatenate([[0], np.cumsum(per_row)])
        flat = ids[kernels.ragged(place, count)]
        if not found:
            return flat, bounds
        out = np.empty(bounds[-1], np.uint32)
        out[kernels.ragged(bounds[:-1][~special], per_row[~special])] = flat
        out[kernels.ragged(bounds[:-1][special], per_row[special])] = np.concatenate(
            [np.array(x, np.uint32) for x in found])
        return out, bounds

    @staticmethod
    def _pieces(data, offsets):
        """Where the split pattern cuts, for texts without apostrophes.

        A piece opens where the class changes. A space goes to the piece behind it, if
        that is no space; of other white space before text the last character is alone.
        """
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none
        kind = _CLASS[data]
        opens = np.ones(n, bool)
        opens[1:] = kind[1:] != kind[:-1]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        opens[edges] = True
        space = kind == _SPACE
        last = np.zeros(n, bool)  # white space with text behind it in the same row
        last[:-1] = space[:-1] & ~space[1:]
        last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
        single = np.flatnonzero(last)
        opens[single] = True
        glued = single[data[single] == 0x20] + 1
        opens[glued] = False
        starts = np.flatnonzero(opens)
        return starts, np.append(starts[1:], n)

    def _look_up(self, data, starts, ends):
        """Place and count in the known ids of every piece; new pieces are encoded."""
        if not len(starts):
            none = np.zeros(0, np.int64)
            return none, none, self.ids
        hashes = kernels.span_hashes(data, starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.place) > MEMORY:
            self._forget()
        numbers = self._numbers(distinct)
        new = numbers < 0
        if new.any():
            body = data.tobytes()
            own = first[new]
            numbers[new] = len(self.place) + np.arange(len(own))
            self._learn(distinct[new], numbers[new], [
                body[s:e].decode() for s, e in zip(starts[own], ends[own], strict=True)])
        return self.place[numbers][which], self.count[numbers][which], self.ids


def _merged(keys, values, more_keys, more_values) -> tuple[np.ndarray, np.ndarray]:
    keys, values = np.concatenate([keys, more_keys]), np.concatenate([values, more_values])
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str | None = None) -> Encoder:
    """The encoder of this Python process, which keeps its known pieces between tasks."""
    vocabulary = vocabulary or path()
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
