"""Ids of whole texts by a tokenizer that works unit by unit.

A text is cut where no token can cross and where what follows cannot change how
the part before is split: such units are encoded once and looked up afterwards.
Cutting, comparing and gathering are array operations over a block of texts;
only units that are new to the task reach the tokenizer. A hash finds a unit's
entry and its bytes confirm it, so the ids are exactly the tokenizer's own.
"""
from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

from .common import LOWER, blocks, joined, span_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
KNOWN_UNITS = 300_000  # units that a task remembers; beyond, the more used half stays
LONG_UNIT = 64  # bytes; longer units are not remembered
CALL_UNITS = 2_000  # units of a call of the tokenizer
UNIT_BYTES = 2 << 20  # text bytes looked up together

_UNSURE, _LETTER, _DIGIT, _SIGN, _APOSTROPHE, _BLANK, _SPACE, _LEAD = range(8)


def _classes() -> np.ndarray:
    """Class of each byte. _LEAD: begins a character that is no white space; other bytes from 128 on are unsure."""
    out = np.full(256, _UNSURE, np.uint8)
    for b in range(128):
        c = chr(b)
        if c.isalpha():
            out[b] = _LETTER
        elif c.isdigit():
            out[b] = _DIGIT
        elif 0x21 <= b <= 0x7E:
            out[b] = _APOSTROPHE if c == "'" else _SIGN
        elif c in "\t\n\v\f\r":
            out[b] = _SPACE
    out[0x20] = _BLANK
    out[0xC3:0xF5] = _LEAD
    out[[0xE1, 0xE2, 0xE3]] = _UNSURE  # these begin the white space beyond ASCII, with 0xC2
    return out


def _pairs() -> np.ndarray:
    """Whether a cut is sure between a byte of one class and a byte of another."""
    out = np.zeros((8, 8), bool)
    for a in (_LETTER, _DIGIT, _SIGN):
        out[a, [_LETTER, _DIGIT, _SIGN, _SPACE]] = True
        out[a, a] = False
    out[[_LETTER, _DIGIT], _APOSTROPHE] = True
    out[_APOSTROPHE, _SPACE] = True
    out[_SPACE, [_LETTER, _DIGIT, _SIGN, _APOSTROPHE]] = True
    return out.reshape(-1)


CLASS = _classes()
_PAIR = _pairs()
_VISIBLE = np.isin(np.arange(8), (_LETTER, _DIGIT, _SIGN, _APOSTROPHE, _LEAD))
_ASCII_VISIBLE = np.isin(np.arange(8), (_LETTER, _DIGIT, _SIGN, _APOSTROPHE))


def sure_cuts(data: np.ndarray) -> np.ndarray:
    """A flag per byte: a unit begins here.

    Holds for patterns that match contractions at an apostrophe, runs of letters,
    of digits and of other signs, each with a blank before it, and white space of
    which the last character before a visible one is matched apart: so a cut
    after white space is sure only after a single character of it.
    """
    c = CLASS[data]
    out = np.zeros(len(c), bool)
    if not len(c):
        return out
    out[0] = True
    out[1:] = _PAIR[c[:-1] * np.uint8(8) + c[1:]]
    out[:-1] |= (c[:-1] == _BLANK) & _VISIBLE[c[1:]]
    after = np.flatnonzero(out[1:] & (c[:-1] == _SPACE)) + 1
    out[after[(after < 2) | ~_ASCII_VISIBLE[c[after - 2]]]] = False
    out[0] = True
    return out


def _same(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[a_at:][:size] equals b[b_at:][:size], for each entry."""
    out = np.ones(len(size), bool)
    if not len(size):
        return out
    ends = np.cumsum(size)
    inside = np.arange(ends[-1]) - np.repeat(ends - size, size)
    differ = np.flatnonzero(a[np.repeat(a_at, size) + inside] != b[np.repeat(b_at, size) + inside])
    out[np.searchsorted(ends, differ, "right")] = False
    return out


class Known:
    """Units, found by hash and confirmed by their bytes, with their ids."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.key, self.uses = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self.id_at, self.id_n, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, key: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Index of each unit, -1: not known."""
        if not len(self.key):
            return np.full(len(key), -1)
        got = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = np.flatnonzero((self.key[got] == key) & (self.size[got] == size))
        hit = hit[_same(data, at[hit], self.pool, self.at[got[hit]], size[hit])]
        out = np.full(len(key), -1)
        out[hit] = got[hit]
        return out

    def add(self, key: np.ndarray, units: list[bytes], id_n: np.ndarray, ids: np.ndarray) -> None:
        """Adds units whose hashes are new; past the limit the more used half stays."""
        size = np.array([len(u) for u in units], np.int64)
        id_at = np.cumsum(id_n) - id_n + len(self.ids)
        at = np.cumsum(size) - size + len(self.pool)
        pool = np.concatenate((self.pool, np.frombuffer(b"".join(units), np.uint8)))
        ids = np.concatenate((self.ids, ids))
        cols = [np.concatenate(x) for x in ((self.key, key), (self.uses, np.ones(len(key), np.int64)), (self.at, at), (self.size, size), (self.id_at, id_at), (self.id_n, id_n))]
        order = np.argsort(cols[0], kind="stable")
        order = order[np.append(True, cols[0][order][1:] != cols[0][order][:-1])] if len(order) else order
        if len(order) > self.most:
            keep = np.sort(np.argsort(-cols[1][order], kind="stable")[: self.most // 2])
            order = order[keep]
            cols[1] = cols[1] // 2
        self.key, self.uses, at, size, id_at, id_n = (c[order] for c in cols)
        if len(order) == len(cols[0]):
            self.at, self.size, self.id_at, self.id_n, self.pool, self.ids = at, size, id_at, id_n, pool, ids
            return
        self.pool, self.at, self.size = gather(pool, at, size), np.cumsum(size) - size, size
        self.ids, self.id_at, self.id_n = gather(ids, id_at, id_n), np.cumsum(id_n) - id_n, id_n


def gather(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[at:][:n] of each entry, one after the other."""
    ends = np.cumsum(n)
    return values[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class UnitIds:
    """Ids of texts. `encode` gives the number of ids of each of some units, and all their ids."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], lower: bool = False, most: int = KNOWN_UNITS, block: int = UNIT_BYTES) -> None:
        self.encode, self.lower, self.block = encode, lower, block
        self.known = Known(most)

    def ids_of(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each unit data[s:e], all ids)."""
        h, size = span_hashes(data, s, e), e - s
        key, first, back = np.unique(h, return_index=True, return_inverse=True)
        odd = np.flatnonzero(size != size[first][back])
        if not len(odd):
            odd = np.flatnonzero(~_same(data, s, data, s[first][back], size))
        if len(odd):  # two units of one hash: these are told apart by their bytes
            extra: dict[bytes, int] = {}
            raw = data.tobytes()
            for k in odd.tolist():
                back[k] = len(key) + extra.setdefault(raw[s[k] : e[k]], len(extra))
            _, at = np.unique(back[odd], return_index=True)
            first = np.append(first, odd[at])
        at, n = s[first], size[first]
        got = np.append(self.known.find(key, data, at[: len(key)], n[: len(key)]), np.full(len(first) - len(key), -1))
        new = np.flatnonzero(got < 0)
        units = [data[a : a + k].tobytes() for a, k in zip(at[new].tolist(), n[new].tolist(), strict=True)]
        new_n, new_ids = self.encode(units) if units else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        id_at, id_n = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        old = np.flatnonzero(got >= 0)
        id_at[old], id_n[old] = self.known.id_at[got[old]], self.known.id_n[got[old]]
        id_at[new], id_n[new] = np.cumsum(new_n) - new_n + len(self.known.ids), new_n
        out = gather(np.concatenate((self.known.ids, new_ids)), id_at[back], id_n[back])
        self.known.uses[got[old]] += np.bincount(back, minlength=len(first))[old]
        keep = (new < len(key)) & (n[new] <= LONG_UNIT)
        if keep.any():
            at_ids = np.repeat(keep, new_n)
            self.known.add(key[new[keep]], [u for u, k in zip(units, keep.tolist(), strict=True) if k], new_n[keep], new_ids[at_ids])
        return id_n[back], out

    def encode_all(self, rows: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not rows:
            return []
        data, at = joined(rows, b"\n")
        begins = np.append(sure_cuts(data), True)
        if self.lower:  # not before a character beyond ASCII, with which the letter might be composed
            plain = np.append(data[1:] < 128, True)
            data = np.where(plain, LOWER[data], data)
        begins[at] = True
        begins[at[1:] - 1] = True
        s = np.flatnonzero(begins)
        s, e = s[:-1], s[1:]
        unit = np.ones(len(data), bool)
        unit[at[1:] - 1] = False
        own = unit[s]
        s, e = s[own], e[own]
        if self.lower:  # a tokenizer that drops white space: the blank before a word makes no difference
            s = s + ((data[s] == 0x20) & (e - s > 1))
        counts, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for i, j in blocks(e - s, self.block):
            lo, hi = int(s[i]), int(e[j - 1])
            n, ids = self.ids_of(data[lo:hi], s[i:j] - lo, e[i:j] - lo)
            counts.append(n)
            parts.append(ids)
        ends = np.append(0, np.cumsum(np.concatenate(counts)))
        cut = (4 * ends[np.searchsorted(s, at)]).tolist()
        packed = np.concatenate(parts).astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip(cut, cut[1:], strict=False)]


class TokenizerIds(UnitIds):
    """Ids as the tokenizers library gives them without special tokens of its own.

    Texts that hold the name of an added token go to the library whole.
    """

    def __init__(self, path: str, lower: bool = False, most: int = KNOWN_UNITS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.names = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        super().__init__(self._library, lower, most)

    def _library(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n, parts = [], []
        for i in range(0, len(texts), CALL_UNITS):
            got = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts[i : i + CALL_UNITS]], add_special_tokens=False)
            ids: list[int] = []
            for x in got:
                own = x.ids
                n.append(len(own))
                ids += own
            parts.append(np.array(ids, np.uint32))
        return np.array(n, np.int64), np.concatenate(parts)

    def encode_all(self, rows: list[bytes]) -> list[bytes]:
        named = [k for k, r in enumerate(rows) if any(name in r for name in self.names)]
        if not named:
            return super().encode_all(rows)
        out = super().encode_all([b"" if k in set(named) else r for k, r in enumerate(rows)])
        for k in named:
            out[k] = self._library([rows[k]])[1].astype("<u4").tobytes()
        return out
