"""Token ids of whole texts, with a public tokenizer file.

A tokenizer that drops white space and never merges over it gives a text the ids of its words in
turn. So each worker encodes a distinct word or piece once and looks up repeats, by its bytes: the
ids are those of encoding the whole text (tests compare them, with version 0.23 of the library).
"""

from __future__ import annotations

import json
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ctxloom.llm import _base as B

#: Distinct words a worker remembers; beyond it, it starts anew.
WORDS_KEPT = 600_000
#: Text bytes that are cut into units together.
TOGETHER = 1 << 16
_CODERS: dict[str, object] = {}
#: Of each ASCII byte: 0 white space, 1 letter, 2 digit, 3 other. And its lower case.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def coder(path: str):
    """f(string array, end_id) -> (ids of all texts, ids of each text)."""
    if path not in _CODERS:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _CODERS[path] = (_WordCoder if _drops_space(spec) else _TextCoder)(Tokenizer.from_str(json.dumps(spec)), spec)
    return _CODERS[path]


def _drops_space(spec: dict) -> bool:
    """Whether the file splits by a pattern of its own, removes white space, and maps the pieces' bytes to letters."""
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [])
    norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    return (len(steps) == 2 and steps[0]["type"] == "Split" and steps[0].get("invert") and steps[0]["behavior"] == "Removed" and "[^\\s" in steps[0]["pattern"].get("Regex", "")
            and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"] and norm == ["NFC", "Replace", "Lowercase"])


class _TextCoder:
    """Any tokenizer: whole texts."""

    def __init__(self, tok, spec):
        self.tok = tok

    def __call__(self, col: pa.Array, end_id: int | None):
        out = [x.ids for x in self.tok.encode_batch(col.fill_null("").to_pylist(), add_special_tokens=False)]
        tail = [] if end_id is None else [end_id]
        n = np.array([len(x) + len(tail) for x in out], np.int64)
        return np.fromiter((i for x in out for i in (*x, *tail)), np.uint32, int(n.sum())), n


def _alike(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(kind of each unit, bytes of each kind): units, from each start to the next, are of one kind if all their bytes are equal."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    offsets = np.append(starts, len(data)).astype(np.int32)
    kinds = pc.dictionary_encode(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
    names = kinds.dictionary
    bounds = np.frombuffer(names.buffers()[1], np.int32)[: len(names) + 1].tolist()
    text = names.buffers()[2].to_pybytes()
    return kinds.indices.to_numpy(zero_copy_only=False), [text[a:b] for a, b in zip(bounds, bounds[1:])]


class _WordCoder:
    """Splits text of ASCII and the letters À to ÿ into the pieces of the file's pattern with byte classes; other words go through the pattern itself.

    Those letters are composed already, and what could join them (a mark) makes its word one of the others.
    """

    def __init__(self, tok, spec):
        import regex

        self.tok = tok
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.added = [x["content"] for x in spec["added_tokens"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: printable bytes stand for themselves
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        # words with such bytes are split by the pattern: beyond ASCII (but for those letters), apostrophes, control bytes, starts of added tokens
        self.odd = np.ones(256, bool)
        self.odd[33:127] = False
        self.odd[[39, *(x.encode()[0] for x in self.added)]] = True
        self.odd[[0x20, *range(0x09, 0x0E)]] = False
        self.clear()

    def clear(self):
        self.at: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 16, np.int64)  # of each slot's ids in flat

    def piece(self, data: bytes) -> list[int]:
        return [t.id for t in self.tok.model.tokenize(data.decode("latin-1").translate(self.letters))]

    def word(self, word: str) -> list[int]:
        if any(x in word for x in self.added):
            return self.tok.encode(word, add_special_tokens=False).ids
        return [i for piece in self.pieces(word.lower() if word.isascii() else self.tok.normalizer.normalize_str(word)) for i in self.piece(piece.encode())]

    def units(self, raw: np.ndarray, off: np.ndarray):
        """(bytes without white space, start of each unit in them, whether it is odd, first unit of each text): odd words whole, the rest cut into runs of letters, digits and other signs."""
        n = len(raw)
        kind, data, odd = _KIND[raw], _SMALL[raw], self.odd[raw]
        lead = np.flatnonzero(raw == 0xC3)  # of À to ÿ, but for the signs × and ÷
        second = raw[lead + 1]
        letter = (second != 0x97) & (second != 0xB7)
        lead, second = lead[letter], second[letter]
        kind[lead], kind[lead + 1], odd[lead], odd[lead + 1] = 1, 1, False, False
        data[lead + 1] = second + np.where(second <= 0x9E, 32, 0).astype(np.uint8)
        ink = kind > 0
        edges = off[:-1][off[:-1] < n]
        cut = np.ones(n, bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut |= kind == 2
        cut[edges] = True
        cut &= ink
        odd = np.flatnonzero(odd)
        inside = np.zeros(n + 1, np.int8)  # of an odd word
        if len(odd):
            stop = ~ink  # the place after a word, or the first one of a text
            stop[edges] = True
            stops = np.append(np.flatnonzero(stop), n)
            after = np.unique(np.searchsorted(stops, odd, side="right"))
            before = stops[after - 1]
            before += ~ink[before]
            inside[before] += 1
            inside[stops[after]] -= 1
            inside = np.cumsum(inside, dtype=np.int8)
            inner = inside[:n].view(bool)
            cut &= ~inner
            cut[before] = True
            np.copyto(data, raw, where=inner)
        at = np.flatnonzero(cut)
        return data[ink], np.flatnonzero(cut[ink]), inside[at].view(bool), np.searchsorted(at, off)

    def __call__(self, col: pa.Array, end_id: int | None):
        raw, off = B.text_bytes(col)
        tail = 0 if end_id is None else 1
        if not len(raw):
            return np.full(tail * len(col), end_id or 0, np.uint32), np.full(len(col), tail, np.int64)
        found, lo, bytes_before, units_before = [], 0, 0, 0
        while lo < len(col):  # some texts at a time, so that they stay in the processor's cache
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + TOGETHER, side="right")) - 1)
            data, begin, odd, first = self.units(raw[off[lo]: off[hi]], off[lo: hi + 1] - off[lo])
            found.append((data, begin + bytes_before, odd, first[1:] + units_before))
            lo, bytes_before, units_before = hi, bytes_before + len(data), units_before + len(begin)
        data, starts, odd, first = map(np.concatenate, zip(*found))
        first = np.append(0, first)
        of, names = _alike(data, starts)
        uncut = np.zeros(len(names), bool)
        uncut[of] = odd  # words with odd bytes are whole, and nothing else has such bytes
        if len(self.at) + len(names) > WORDS_KEPT:
            self.clear()
        at = self.at
        slots = np.fromiter(map(at.get, names, repeat(-1)), np.int64, len(names))
        for k in np.flatnonzero(slots < 0).tolist():
            name = names[k]
            ids = self.word(name.decode()) if uncut[k] else self.piece(name)
            slot = len(at)
            begin = int(self.bounds[slot])
            if begin + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
            if slot + 1 >= len(self.bounds):
                self.bounds = np.concatenate([self.bounds, np.zeros(len(self.bounds), np.int64)])
            self.flat[begin: begin + len(ids)] = ids
            self.bounds[slot + 1] = begin + len(ids)
            slots[k] = at[name] = slot
        bounds = self.bounds
        slots = slots[of]
        size = bounds[slots + 1] - bounds[slots]
        total = np.concatenate([[0], np.cumsum(size)])
        # ids of a unit are in turn: the place of each in flat is its own place and a number of its unit
        small = np.int32 if max(int(total[-1]), len(self.flat)) < 1 << 31 else np.int64
        place = np.repeat((bounds[slots] - total[:-1]).astype(small), size)
        place += np.arange(len(place), dtype=small)
        ids = self.flat[place]
        ends = total[first[1:]]
        n = np.diff(ends, prepend=0)
        if not tail:
            return ids, n
        out = np.empty(len(ids) + len(n), np.uint32)
        inner = np.ones(len(out), bool)
        inner[ends + np.arange(len(n))] = False
        out[inner] = ids
        out[~inner] = end_id
        return out, n + 1
