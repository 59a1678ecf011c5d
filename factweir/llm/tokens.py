"""Token ids of whole texts by a public tokenizer, with a bounded cache of word parts.

The vocabulary file's path is a parameter. Only for tokenizers that lower-case, drop white space, split at it
and at changes between letters, single digits and other characters, and end each such part with a marked
token. A text's ids are then the ids of its parts one after the other: new parts go to the tokenizer, known
ones are read from arrays. Words that are not plainly split so (apostrophes, `<|`, characters beyond Latin
letters) are kept whole. Parts are known by their 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from factweir.llm import bytehash

_SLOTS = 1 << 21
_ENTRIES = 1 << 19
_JOINED = 1 << 17
#: Parts that are encoded in one string.
_TOGETHER = 2000

#: 0 white space, 1 letters (Latin ones beyond ASCII are checked apart), 2 digits, 3 others.
_KIND = np.full(256, 3, dtype=np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_WHOLE = np.uint64(0xA5A5F00D12345678)


def parts(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes and whether plain of the parts of a block's words.

    U+00C0 to U+024F are letters but for the signs of multiplication and division; they are two bytes each,
    with lead bytes C3 to C9. U+0130 is no letter here either, as its lower case ends with a combining mark.
    """
    kind = _KIND[b]
    after = np.concatenate((b[1:], [0]))
    lead = (b >= 0xC3) & (b <= 0xC9) & ~((b == 0xC3) & ((after == 0x97) | (after == 0xB7))) & ~((b == 0xC4) & (after == 0xB0)) & ~((b == 0xC9) & (after > 0x8F))
    follows = (b >= 0x80) & (b < 0xC0) & np.concatenate(([False], lead[:-1]))
    odd = ((b >= 0x80) & ~lead & ~follows) | (b == 39) | ((b == 60) & (after == 124)) | (b < 9) | ((b > 13) & (b < 32)) | (b == 127)
    space = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, start.astype(np.uint64), start.astype(bool)
    strange = np.add.reduceat(np.concatenate((odd, [False])).astype(np.int32), np.stack((start, end), axis=1).ravel())[::2] > 0
    inner = 1 + np.flatnonzero(((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~space[1:] & ~space[:-1])
    inner = inner[~strange[np.searchsorted(start, inner, "right") - 1]]
    start, end = np.sort(np.concatenate((start, inner))), np.sort(np.concatenate((end, inner)))
    plain = ~(np.add.reduceat(np.concatenate((odd, [False])).astype(np.int32), np.stack((start, end), axis=1).ravel())[::2] > 0)
    h = np.where(plain, bytehash.run_hashes(b, start, end, True), bytehash.run_hashes(b, start, end, False) ^ _WHOLE)
    return start, end, h, plain


class WordTokenizer:
    """Encodes texts; memory is bounded by the number of entries, after which the cache starts anew."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(_SLOTS, dtype=np.uint64)
        self.entry = np.full(_SLOTS, -1, dtype=np.int32)
        self.start = np.zeros(1024, dtype=np.int64)
        self.length = np.zeros(1024, dtype=np.int64)
        self.ids = np.zeros(1 << 14, dtype=np.uint32)
        self.entries = self.used = 0

    def _encode_new(self, texts: list[str], n_plain: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end and the number of each. The first n_plain are one part each: many are
        encoded in one string and told apart by their end tokens."""
        flat, sizes = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, n_plain, _TOGETHER):
            group = texts[at : min(at + _TOGETHER, n_plain)]
            ids = np.array(self.tokenizer.encode(" ".join(group), add_special_tokens=False).ids, dtype=np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(group):
                flat.append(ids)
                sizes.append(np.diff(stop, prepend=0))
            else:
                self._one_by_one(group, flat, sizes)
        self._one_by_one(texts[n_plain:], flat, sizes)
        return np.concatenate(flat), np.concatenate(sizes)

    def _one_by_one(self, texts: list[str], flat: list, sizes: list) -> None:
        for text in texts:
            flat.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32))
            sizes.append(np.array([len(flat[-1])]))

    def _add(self, texts: list[str], n_plain: int, hashes: np.ndarray) -> int:
        """New entries for these parts, plain ones first; returns the first one's number."""
        flat, size = self._encode_new(texts, n_plain)
        n = len(texts)
        while self.entries + n > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        first = self.entries
        self.start[first : first + n] = self.used + np.cumsum(size) - size
        self.length[first : first + n] = size
        self.ids[self.used : self.used + len(flat)] = flat
        self.entries, self.used = first + n, self.used + len(flat)
        slot = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        self.keys[slot] = hashes
        self.entry[slot] = np.arange(first, first + n, dtype=np.int32)
        return first

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text, and each part's byte start and number of ids."""
        found = [self._block(data, at, b) for at, b in bytehash.blocks(data)]
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none.astype(np.uint32), none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]

    def _block(self, data: bytes, offset: int, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.entries > _ENTRIES:
            self._clear()
        start, end, h, plain = parts(b)
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        at = np.where(self.keys[slot] == h, self.entry[slot], -1).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            _, one, back = np.unique(h[new], return_index=True, return_inverse=True)
            one = new[one]
            order = np.argsort(~plain[one], kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            one = one[order]
            texts = [data[i:j].decode("utf-8", "replace") for i, j in zip((start[one] + offset).tolist(), (end[one] + offset).tolist(), strict=True)]
            at[new] = self._add(texts, int(plain[one].sum()), h[one]) + place[back]
        size = self.length[at] if len(at) else at
        ends = np.cumsum(size)
        place = np.repeat(self.start[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.ids[place], start + offset, size

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text (null: none), short texts joined for speed."""
        some: list[bytes] = []
        size = 0
        for text in texts:
            some.append((text or "").encode("utf-8", "replace"))
            size += len(some[-1]) + 1
            if size > _JOINED:
                yield from self._split(some)
                some, size = [], 0
        yield from self._split(some)

    def _split(self, some: list[bytes]) -> Iterator[np.ndarray]:
        if not some:
            return
        ids, start, size = self.encode(b"\n".join(some))
        offsets = np.cumsum([0] + [len(x) + 1 for x in some[:-1]])
        first = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, offsets)]
        yield from np.split(ids, first[1:])


_known: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker."""
    if path not in _known:
        _known[path] = WordTokenizer(path)
    return _known[path]
