"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence per connected group.

A line is normalised: lower case, digits to 0, everything but letters, marks and numbers to a space, white space to one
space. Equal normalised lines, of any number of words but none, are one kind of line. Kinds of MIN_WORDS words and more
get a SimHash of many 64-bit blocks. A block is the bitwise majority vote of a few of the line's words, and every block
votes on words of its own choice, so lines whose differences miss the words of any one block agree on that block:

* five to eight words: a block for the whole line, for each word left out, and (from six words) for each two left out;
* nine words and more: BLOCKS blocks of the three least words under an order of the block's own that favours long words
  (lines of over FEW words have FEWER, of the four least words, the first with two votes). Lines of FEW words have blocks
  of both kinds, and lines of nine words a block for each word left out, to meet lines with a word less.

One SimHash with a radius of 3 of 64 bits, the usual form, finds only a small part of the lines at edit similarity 0.8
(an edited word of twelve flips about ten bits); these blocks find most (recall by length is in the README and tests).
Pairs of a block's bucket whose plain 64-bit SimHashes (of the words of LETTERS letters and more) differ in over MAX_BITS
bits are left out; lines at 0.8 hardly ever do. All others are judged by Levenshtein distance: similar if 1 - distance /
longer length is at least 0.8. Of each connected group the first occurrence (by doc_id, row key, line number) stays.

Buckets go through link(), so a hot one costs a comparison a member. Texts of candidate lines only are looked at again.

Null and empty texts have no lines to remove, and empty lines stay. Null ids come last. Ties: rows of equal id and text
have one key; they are one document here, so that copies of such a row lose the same lines. Different texts under one id
are ordered by their keys. Very long texts and lines are handled whole; a comparison of two lines of n letters takes n steps over n bits. An empty table gives an empty one. Further columns pass through stage() whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.llm import _base as B
from ctxloom.llm._links import link

MIN_WORDS = 5
SIMILARITY = 0.8
#: Lines of up to SHORT words have a block for each word or two left out.
SHORT = 8
#: Blocks of longer lines; of lines of over FEW words.
BLOCKS, FEW, FEWER = 16, 15, 10
#: Pairs that differ in more bits of their plain SimHashes are not compared; words of fewer letters (bytes) have no vote in those.
MAX_BITS, LETTERS = 21, 4
#: Lines with so many words of LETTERS letters and more draw their blocks from those alone.
ENOUGH = 10
#: Blocks are dealt by value, in so many times more parts than a shuffle has partitions; so many are packed at once.
FINER, PACKED = 2, 1 << 20
#: Blocks that a task holds before lines of crowded ones are passed on.
HELD = 1 << 22
#: Words whose blocks are drawn together.
WORDS = 32_000
#: Pairs that are compared together; texts of more letters are compared one pair at a time.
PAIRS, LONG = 1024, 4000
#: Antidiagonals of a comparison after which it is seen which pairs are over.
STEPS = 32
#: Words left out on either side, few first.
_AHEAD = sorted(((p, q) for p in range(5) for q in range(5) if p or q), key=lambda x: (max(x), sum(x)))
#: A line of a batch's distinct ones: its hash, first place (d stands for doc_id), plain SimHash, and how often it is there.
LINE = np.dtype([("hash", "i8"), ("d", "i8"), ("key", "i8"), ("sim", "i8"), ("line", "i4"), ("n", "i4")])
_ODD = np.random.default_rng(10).integers(0, 1 << 63, BLOCKS, dtype=np.int64).astype(np.uint64) << np.uint64(1) | np.uint64(1)
_ODD32 = (_ODD >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[48:58] = 48
_MAP[[b for b in range(128) if not chr(b).isalnum()]] = 32
_MAP[10] = 10
#: Each byte's bits as eight counters of eight bits.
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def _lowered(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts in lower case, with spaces for what is no letter, mark, number or line break."""
    if col.null_count:
        col = col.fill_null("")
    if (B.text_bytes(col)[0] > 127).any():
        col = pc.replace_substring_regex(pc.utf8_lower(col), r"[^\x00-\x7F\pL\pM\pN]", " ")
    raw, off = B.text_bytes(col)
    return _MAP[raw], off


def normalised(text: str) -> str:
    """What two lines must share to be the same line."""
    return b" ".join(_lowered(pa.array([text], pa.string()))[0].tobytes().split()).decode()


def _votes(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many hashes of each stretch (from start to the next) have each of 64 bits set; stretches are not empty."""
    size = np.diff(np.append(start, len(h)))
    part = np.arange(len(h)) - np.repeat(start, size)
    cut = np.flatnonzero(part % 255 == 0)  # counters hold 255
    owner = np.repeat(np.arange(len(start)), size)[cut]
    out = np.zeros((len(start), 64), np.int64)
    data = h.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        lanes = np.add.reduceat(_LANES[data[:, byte]], cut).view(np.uint8).reshape(-1, 8).astype(np.int64)
        if len(cut) == len(start):
            out[:, 8 * byte: 8 * byte + 8] = lanes
        else:
            np.add.at(out[:, 8 * byte: 8 * byte + 8], owner, lanes)
    return out


def _columns(start: np.ndarray, n: int):
    """Stretches (from start to the next, the last to n) of about one size together: (stretches, places of their items, whether there is one); a column is a stretch.

    They hold about WORDS items, so that what is computed of them stays in the processor's cache.
    """
    size = np.diff(np.append(start, n))
    order, at = np.argsort(size, kind="stable"), 0
    sizes = size[order]
    while at < len(order):
        end = at + max(1, WORDS // max(1, int(sizes[at])))
        end = max(at + 1, min(end, int(np.searchsorted(sizes, sizes[at] * 9 // 8, side="right"))))
        some = order[at:end]
        row = np.arange(int(sizes[min(end, len(order)) - 1]))[:, None]
        there = row < size[some]
        yield some, np.where(there, start[some] + row, 0), there
        at = end


def simhash(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each stretch of feature hashes."""
    out = np.empty(len(start), np.uint64)
    for some, at, there in _columns(start, len(h)):
        x = h[at]
        if len(x) > 255:  # counters hold 255
            size = there.sum(axis=0)
            votes = _votes(x.T[there.T], np.cumsum(size) - size)
        else:
            x[~there] = 0
            votes, size = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8).reshape(-1, 64), there.sum(axis=0)
        bits = votes > (size // 2)[:, None].astype(votes.dtype)
        out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _left_out(h: np.ndarray, w0: np.ndarray, n: int, most: int) -> np.ndarray:
    """lines x subsets: SimHashes of lines of n words, from w0, with up to `most` words left out."""
    chosen = [[i for i in range(n) if i not in gone] for k in range(most + 1) for gone in combinations(range(n), k)]
    at = np.concatenate(chosen)
    size = np.tile([len(c) for c in chosen], len(w0))
    return simhash(h[(w0[:, None] + at[None, :]).ravel()], np.cumsum(size) - size).reshape(len(w0), len(chosen))


def _sampled(h: np.ndarray, length: np.ndarray, start: np.ndarray, blocks: range, words: int) -> np.ndarray:
    """lines x blocks: the majority vote of the three or four least words of each line (its words from start to the next), by each block's order."""
    out, low = np.empty((len(start), len(blocks)), np.uint64), h.astype(np.uint32)  # orders need no more bits, and half as many are drawn twice as fast
    for some, at, there in _columns(start, len(h)):
        words_of, inverse = low[at], np.where(there, np.float32(1 << 23) / length[at].astype(np.float32), np.float32(np.inf))
        x, y, same, least = np.empty_like(words_of), np.empty_like(words_of), np.empty(at.shape, bool), np.empty((words, len(blocks), len(some)), np.float32)
        for column, k in enumerate(blocks):
            np.multiply(words_of, _ODD32[k], out=x)
            np.right_shift(x, np.uint32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x846CA68B), out=x)
            np.right_shift(x, np.uint32(9), out=x)
            np.bitwise_or(x, np.uint32(0x7F << 23), out=x)  # a number from 1 to 2
            rank = x.view(np.float32)
            rank -= np.float32(1 - 2.0**-24)
            rank *= inverse
            for n in range(words):
                rank.min(axis=0, out=least[n, column])
                if n < words - 1:
                    np.equal(rank, least[n, column], out=same)
                    np.copyto(rank, np.inf, where=same)
        vote = B.mix(least.view(np.uint32) + (_ODD[blocks.start: blocks.stop] << np.uint64(32))[:, None])
        for n in range(1, words):  # lines of fewer different words repeat one
            np.copyto(vote[n], vote[n - 1], where=np.isinf(least[n]))
        a, b, c, *d = vote
        out[some] = (a & (b | c | d[0]) | b & c & d[0] if d else a & b | b & c | a & c).T
    return out


def distance(a: str, b: str, most: int) -> int:
    """Some number from the Levenshtein distance of two texts to `most` if the distance is at most that, else a larger number.

    Common ends are cut off; the rest is one bit-parallel pass with a number of as many bits as the shorter rest has letters.
    """
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in sorted((a, b), key=len))
    if len(y) - len(x) > most:
        return most + 1
    if (v := a.split(" ")) and len(v) == len(w := b.split(" ")):  # replaced words alone give a bound that is often enough
        bound = sum(max(len(s), len(t)) for s, t in zip(v, w) if s != t)
        if bound <= most:
            return bound
    for _ in range(2):  # the common head, then the common tail
        other = np.flatnonzero(x != y[: len(x)])
        head = int(other[0]) if len(other) else len(x)
        x, y = x[head:][::-1], y[head:][::-1]
    n = len(x)
    if not n:
        return len(y)
    letters = {c: int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in np.unique(x).tolist()}
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, left = full, 0, n, len(y)
    for c in y.tolist():
        eq = letters.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(h | up)), up & h
        left -= 1
        if more & top:
            score += 1
            if score - left > most:
                return most + 1
        elif less & top:
            score -= 1
        more = (more << 1 | 1) & full
        up, down = (less << 1 & full) | (full & ~(v | more)), more & v
    return score


def _banded(x: list[str], y: list[str], most: np.ndarray) -> np.ndarray:
    """Levenshtein distances of pairs, x the shorter texts, where they are at most `most`, else larger numbers.

    All pairs advance together by antidiagonals of the table, over the diagonals that a distance of `most` can reach. A way through
    the table meets one of two antidiagonals in turn, so a pair whose numbers on both exceed `most` is over; pairs that are over go once they are half of all.
    """
    n, m = (np.fromiter(map(len, t), np.int64, len(t)) for t in (x, y))
    half = (most - (m - n)) // 2
    low, high = -int(half.max()), int((m - n + half).max())
    high += (high - low) % 2
    width, pairs = high - low + 1, len(x)
    raw = np.frombuffer("".join((*x, *y)).encode("utf-32-le"), np.uint32)
    letters = raw if int(raw.max(initial=0)) < 0xFFFE else np.unique(raw, return_inverse=True)[1]
    if int(letters.max(initial=0)) >= 0xFFFE:
        return np.array([distance(s, t, k) for s, t, k in zip(x, y, most.tolist())])
    edge = width + 1

    def table(part: np.ndarray, size: np.ndarray, pad: int) -> np.ndarray:
        out = np.full((int(size.max()) + 2 * edge, pairs), pad, np.uint16)
        at = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size)
        out[edge + at, np.repeat(np.arange(pairs), size)] = part
        return out

    back = np.ascontiguousarray(table(letters[: int(n.sum())], n, 0xFFFE)[::-1])
    on = table(letters[int(n.sum()):], m, 0xFFFF)
    # diagonals of either parity, counted from the lowest; a cell outside the table keeps a large number
    rows = (width + 1) // 2
    even, odd = np.full((rows, pairs), 1 << 14, np.uint16), np.full((rows + 1, pairs), 1 << 14, np.uint16)
    inner = odd[1:-1]
    (inner if low % 2 else even)[-low // 2] = 0
    other, least, ones = np.empty_like(even), np.empty_like(even), np.ones_like(even)  # an array of ones is faster than a number
    last, column = n + m, m - n - low
    out = np.where(last == 0, 0, 1 << 14)
    ends = np.argsort(last, kind="stable")
    steps = np.arange(int(last.max()) + 2)
    ended = np.searchsorted(last[ends], steps)
    left = np.arange(pairs)  # the pairs that are still there
    for s in steps[1:-1].tolist():
        p = (s - low) % 2
        here, count = (inner, rows - 1) if p else (even, rows)
        i, j = (s - low - p) // 2, (s + low + p) // 2
        a, b = other[:count], least[:count]
        x0 = len(back) - edge - i
        np.bitwise_xor(back[x0: x0 + count], on[edge + j - 1: edge + j - 1 + count], out=a)
        np.minimum(a, ones[:count], out=a)
        np.add(a, here, out=a)
        np.minimum(*((even[:-1], even[1:]) if p else (odd[:-1], odd[1:])), out=b)
        np.add(b, ones[:count], out=b)
        np.minimum(a, b, out=here)
        if ended[s + 1] > ended[s]:
            done = ends[ended[s]: ended[s + 1]]
            out[left[done]] = here[column[done] // 2, done]
        if s % STEPS == 0:
            stay = (last > s) & (np.minimum(even.min(axis=0), odd.min(axis=0)) <= most)
            if 2 * np.count_nonzero(stay) <= len(stay):
                stay = np.flatnonzero(stay)
                if not len(stay):
                    break
                left, last, column, most = left[stay], last[stay], column[stay], most[stay]
                back, on, even, odd = (np.ascontiguousarray(t[:, stay]) for t in (back, on, even, odd))
                inner, other, least, ones = odd[1:-1], np.empty_like(even), np.empty_like(even), np.ones_like(even)
                ends = np.argsort(last, kind="stable")
                ended = np.searchsorted(last[ends], steps)
    return out


def _words_apart(a: str, b: str, most: int) -> int:
    """At least the Levenshtein distance of two texts, or more than `most`: what lies between the words that both have in the same order counts whole."""
    v, w = a.split(" "), b.split(" ")
    i, j, n, m, cost = 0, 0, len(v), len(w), 0
    while i < n or j < m:
        if i < n and j < m and v[i] == w[j]:
            i, j = i + 1, j + 1
            continue
        for p, q in _AHEAD:  # the nearest place where two words in turn, or the last ones, agree again
            if i + p < n and j + q < m and v[i + p] == w[j + q] and v[i + p + 1: i + p + 2] == w[j + q + 1: j + q + 2]:
                break
        else:
            p, q = n - i, m - j
        cost += max(sum(map(len, v[i: i + p])) + p, sum(map(len, w[j: j + q])) + q)
        if cost > most:
            break
        i, j = i + p, j + q
    return cost


def similar(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the Levenshtein distance of each pair of texts is at most `most`."""
    n = np.array([(len(x), len(y)) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    long = n.max(axis=1)
    ok, may = np.zeros(len(a), bool), long - n.min(axis=1) <= most
    for i in np.flatnonzero(may & (long > LONG)):
        ok[i] = distance(a[i], b[i], int(most[i])) <= most[i]
    some = np.flatnonzero(may & (long <= LONG))
    ok[some] = [_words_apart(a[i], b[i], most[i]) <= most[i] for i in some]
    some = some[~ok[some]]
    some = some[np.argsort(long[some], kind="stable")]
    for at in range(0, len(some), PAIRS):
        these = some[at: at + PAIRS]
        x, y = zip(*(sorted((a[i], b[i]), key=len) for i in these))
        ok[these] = _banded(x, y, most[these]) <= most[these]
    return ok


def line_table(col: pa.Array):
    """(text, line number, hash, words) of each line with a word."""
    return _lines(col)[:4]


def _lines(col: pa.Array):
    """line_table(), and the first word of each line, and hashes and lengths of all words."""
    raw, off = _lowered(col)
    n = len(raw)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none.astype(np.uint64), none, none, none.astype(np.uint64), none
    breaks = np.flatnonzero(raw == 10)
    start = np.union1d(off[:-1][off[:-1] < n], breaks + 1)
    start = start[start < n]
    ws, we, _ = B.word_spans(raw, np.append(start, n))
    h = B.word_hashes(raw, ws, we)
    w0 = np.searchsorted(ws, start)
    size = np.diff(np.append(w0, len(ws)))
    keep = np.flatnonzero(size)
    doc = np.searchsorted(off, start, side="right") - 1  # empty texts before it may share its offset; the last such text owns the line
    number = np.arange(len(start)) - np.searchsorted(start, off[doc])
    w0, size = w0[keep], size[keep]
    return doc[keep], number[keep], B.span_hashes(h, w0, w0 + size), size, w0, h, we - ws


def _blocks(size: np.ndarray, w0: np.ndarray, h: np.ndarray, length: np.ndarray):
    """The blocks of lines (of so many words, from w0) one line after the other, how many each line has, and plain SimHashes."""
    none = np.zeros(0, np.int64)
    owner, value = [none], [none.astype(np.uint64)]

    def put(lines: np.ndarray, x: np.ndarray) -> None:
        owner.append(np.repeat(lines, x.shape[1]))
        value.append(x.ravel())

    long = np.flatnonzero(size > SHORT)
    for these, many, words in ((long[size[long] <= FEW], BLOCKS, 3), (long[size[long] >= FEW], FEWER, 4)):
        if len(these):
            word = np.arange(int(size[these].sum())) + np.repeat(w0[these] - (np.cumsum(size[these]) - size[these]), size[these])
            line = np.repeat(np.arange(len(these)), size[these])
            # where there are enough longer words the others are hardly ever among the least
            longer = length[word] >= LETTERS
            enough = np.bincount(line[longer], minlength=len(these)) >= ENOUGH
            word, line = word[longer | ~enough[line]], line[longer | ~enough[line]]
            put(these, _sampled(h[word], length[word], np.searchsorted(line, np.arange(len(these))), range(many), words))
    for words in range(MIN_WORDS, SHORT + 2):
        these = np.flatnonzero(size == words)
        if len(these):
            put(these, _left_out(h, w0[these], words, 2 if MIN_WORDS < words <= SHORT else 1))
    owner, value = np.concatenate(owner), np.concatenate(value)
    return value[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(size)), _plain(h, length, w0, size)


def _plain(h: np.ndarray, length: np.ndarray, w0: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SimHash of the words of LETTERS letters and more of each line of more than SHORT words; 0 for lines without any."""
    out = np.zeros(len(size), np.uint64)
    long = np.flatnonzero(size > SHORT)
    w0, size = w0[long], size[long]
    word = np.arange(int(size.sum())) + np.repeat(w0 - (np.cumsum(size) - size), size)
    line = np.repeat(np.arange(len(long)), size)[length[word] >= LETTERS]
    if len(line):
        start = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        out[long[line[start]]] = simhash(h[word[length[word] >= LETTERS]], start)
    return out


def alike_once(near: DataFrame) -> DataFrame:
    """(bucket, id, times): one of all buckets with the same ids stands for them, and how many they are. near: distinct (bucket, id).

    For buckets that meet() did not name by their ids. Buckets are told apart by their number of ids, the least and largest of them and two checksums.
    """
    of = near.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor("id").alias("x"), F.sum(F.shiftright(F.xxhash64("id"), 32)).alias("y"))
    some = of.groupBy("n", "low", "high", "x", "y").agg(F.min("bucket").alias("bucket"), F.count("*").alias("times")).select("bucket", "times")
    return B.keep(near.join(some, "bucket"), "members")


def _dealt(ids: np.ndarray, blocks: np.ndarray, parts: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(part, ids, blocks) of blocks dealt by their values: a row a part, with the numbers as bytes."""
    part = ((blocks * _ODD[0] >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=parts))
    some = np.flatnonzero(np.diff(ends, prepend=0))
    offsets = pa.py_buffer(np.append(0, 8 * ends[some]).astype(np.int32))
    return pa.array(some.astype(np.int32)), *(pa.Array.from_buffers(pa.binary(), len(some), [None, offsets, pa.py_buffer(x[order])]) for x in (ids, blocks))


def meet(batches, held: int = HELD):
    """(bucket, id) of the blocks that two different lines have, from batches with _dealt()'s ids and blocks; all of a block come to one task.

    Buckets of the same ids have one name, made from the ids; should two names agree by chance, the ids of both are one bucket. Where more than
    `held` blocks come, lines of crowded ones are passed on, under the block itself, and one line of each block stays to meet those to come.
    Rows are distinct otherwise.
    """
    none = np.zeros(0, np.int64)
    old, new, size = (none.view(np.uint64), none, none.astype(bool)), [], 0

    def settle(last: bool):
        block, line = (np.concatenate([old[k], *(x[k] for x in new)]) for k in range(2))
        told = np.append(old[2], np.zeros(len(block) - len(old[2]), bool))
        order = np.argsort(block)
        same = np.diff(block[order], prepend=0, append=0) == 0  # one place more than there are blocks
        same[[0, -1]] = False
        often = same[1:] | same[:-1]
        few, many = order[~often], order[often]
        many = many[np.lexsort((~told[many], line[many], block[many]))]
        many = many[np.append(True, (np.diff(block[many]) != 0) | (np.diff(line[many]) != 0))[: len(many)]]
        b, i, t = block[many], line[many], told[many]
        start = np.flatnonzero(np.append(True, np.diff(b) != 0)[: len(b)])
        n = np.diff(np.append(start, len(b)))
        if last and len(start):
            own = B.mix(np.add.reduceat(B.mix(i.view(np.uint64)), start) + n.astype(np.uint64))
            b = np.repeat(np.where(np.logical_or.reduceat(t, start), b[start], own), n)
        out = np.repeat(n > 1, n) & ~t
        t[start] |= n > 1
        kept = tuple(np.concatenate([x[few], y[start]]) for x, y in ((block, b), (line, i), (told, t)))
        return kept, pa.RecordBatch.from_arrays([pa.array(B.signed(b[out])), pa.array(i[out])], ["bucket", "id"])

    for batch in batches:
        for ids, blocks in zip(batch.column("ids"), batch.column("blocks")):
            new.append((np.frombuffer(blocks.as_buffer(), np.uint64), np.frombuffer(ids.as_buffer(), np.int64)))
            size += len(new[-1][0])
            if size > max(held, len(old[0])):
                old, out = settle(False)
                new, size = [], 0
                yield out
    if new or len(old[0]):
        yield settle(True)[1]


def _dealt_lines(lines: np.ndarray, parts: int) -> tuple[pa.Array, pa.Array]:
    """(part, lines) of LINEs dealt by their hashes, as pmod(hash, parts) does: a row a part, with the lines as bytes."""
    part = lines["hash"] % parts
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=parts))
    some = np.flatnonzero(np.diff(ends, prepend=0))
    offsets = pa.py_buffer(np.append(0, LINE.itemsize * ends[some]).astype(np.int32))
    return pa.array(some.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(some), [None, offsets, pa.py_buffer(lines[order])])


def places(batches):
    """Places of the lines that are there more than once or have an id (are asked for), from batches with _dealt_lines()'s lines and ids; all of a line come to one task.

    A line has a row for each batch that it was found in, the first of them marked; n is how often it is there in all.
    """
    lines, ids = [np.zeros(0, LINE)], [np.zeros(0, np.int64)]
    for batch in batches:
        lines += [np.frombuffer(x.as_buffer(), LINE) for x in batch.column("lines").drop_null()]
        ids.append(batch.column("id").drop_null().to_numpy())
    x = np.concatenate(lines)
    if not len(x):
        return
    x = x[np.lexsort((x["line"], x["key"], x["d"], x["hash"]))]
    first = np.append(True, np.diff(x["hash"]) != 0)
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(x)))
    n = np.add.reduceat(x["n"].astype(np.int64), start)
    asked = np.isin(x["hash"][start], np.concatenate(ids))
    some = np.repeat((n > 1) | asked, size)
    columns = [x[c] for c in ("hash", "d", "key", "line", "sim")] + [np.repeat(n, size), np.repeat(asked, size), first]
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[some])) for c in columns], ["hash", "d", "key", "line", "sim", "n", "asked", "first"])


def _duplicates(docs: DataFrame, similarity: float, counted: bool) -> tuple[DataFrame, DataFrame | None]:
    """duplicate_lines(), and if asked for (doc_id, key, n_lines) of each row of docs."""

    spark = docs.sparkSession
    parts = min(FINER * int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 16)
    what = "doc_id long, key long, n_lines long, hash long, more_keys array<long>, more_lines array<int>, part int, lines binary, ids binary, blocks binary"
    names = [x.split()[0] for x in what.split(", ")]
    kinds_of = dict(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary(), pa.binary())))

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[c].cast(ty) if c in columns else pa.nulls(n, ty) for c, ty in kinds_of.items()], names)

    def distinct(part: pa.RecordBatch):
        """Other places of the lines that are there more than once; the different lines; the lines and values of their blocks."""
        doc, number, h, size, w0, words, length = _lines(part.column("text"))
        key = part.column("key").to_numpy()[doc]
        d = part.column("doc_id").fill_null((1 << 63) - 1).to_numpy()[doc]
        order = np.lexsort((number, key, d, h))
        new = np.append(True, h[order][1:] != h[order][:-1])[: len(order)]
        first, again = order[new], order[~new]
        n = np.diff(np.append(np.flatnonzero(new), len(order)))
        value, many, sim = _blocks(size[first], w0[first], words, length)
        lines = np.empty(len(first), LINE)
        for c, x in (("hash", B.signed(h)[first]), ("d", d[first]), ("key", key[first]), ("sim", B.signed(sim)), ("line", number[first]), ("n", n)):
            lines[c] = x
        ends = np.append(0, np.cumsum(n[n > 1] - 1)).astype(np.int32)
        more = rows(hash=pa.array(np.ascontiguousarray(lines["hash"][n > 1])), **{c: pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for c, x in (("more_keys", key[again]), ("more_lines", number[again].astype(np.int32)))})
        return more, lines, np.repeat(lines["hash"], many), value

    def run(batches):
        held = []

        def dealt():
            lines, ids, value = map(np.concatenate, zip(*held))
            held.clear()
            yield rows(**dict(zip(("part", "lines"), _dealt_lines(lines, parts))))
            yield rows(**dict(zip(("part", "ids", "blocks"), _dealt(ids, value, parts))))

        for batch in batches:
            for part in B.slices(batch):
                if counted:
                    raw, off = B.text_bytes(part.column("text"))
                    n = np.diff(np.searchsorted(np.flatnonzero(raw == 10), off)) + (np.diff(off) > 0)
                    yield rows(doc_id=part.column("doc_id"), key=part.column("key"), n_lines=pa.array(n))
                more, *found = distinct(part)
                if more.num_rows:
                    yield more
                held.append(found)
                if sum(len(x[1]) for x in held) >= PACKED:
                    yield from dealt()
        if held:
            yield from dealt()

    # of each batch of texts: rows of packed lines, its different ones with their first places, and of packed blocks with the lines that have them; a row with the other places of a line that is there again
    both = B.keep(docs.select("key", "doc_id", "text").mapInArrow(run, what), "lines")
    # a bucket needs two different lines
    met = both.where("ids is not null").select("part", "ids", "blocks").repartition("part").mapInArrow(lambda batches: meet(batches), "bucket long, id long")
    near = B.keep(met.groupBy("bucket", "id").agg(F.count("*").alias("times")), "members")
    # most lines are there once and in no bucket: they are left out before anything is joined
    asked = near.select("id").distinct().select(F.pmod("id", F.lit(parts)).cast("int").alias("part"), F.lit(None).cast("binary").alias("lines"), "id")
    packed = both.where("lines is not null").select("part", "lines", F.lit(None).cast("long").alias("id"))
    at = B.keep(packed.unionByName(asked).repartition("part").mapInArrow(lambda batches: places(batches), "hash long, d long, key long, line int, sim long, n long, asked boolean, first boolean"), "places")
    kind = at.where("first")
    per_doc = kind.where("asked").groupBy("key").agg(F.collect_list(F.struct("line", "hash", F.col("d").alias("ord"), "sim")).alias("asked"))

    def fetch(part: pa.RecordBatch):
        found = {}
        for text, asked in zip(part.column("text"), part.column("asked").to_pylist()):
            rows = text.as_buffer().to_pybytes().split(b"\n")
            for x in asked:
                found[x["hash"]] = rows[x["line"]], x["ord"], x["sim"]
        raw, off = _lowered(pa.array([x[0] for x in found.values()], pa.binary()).cast(pa.string()))  # of those lines alone
        raw = raw.tobytes()
        texts = [b" ".join(raw[a:b].split()) for a, b in zip(off.tolist(), off[1:].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), *(pa.array([x[k] for x in found.values()], pa.int64()) for k in (1, 2))], ["id", "said", "ord", "sim"])

    said = B.arrow_map(docs.select("key", "text").join(per_doc.hint("shuffle_hash"), "key"), fetch, "id long, said string, ord long, sim long")
    said = B.keep(said.dropDuplicates(["id"]), "candidate-lines")  # equal rows of docs give a line each

    def verify(pairs: DataFrame) -> DataFrame:
        def run(part: pa.RecordBatch):
            x, y = part.column("text").to_pylist(), part.column("other").to_pylist()
            far = np.array([int(max(len(s), len(t)) * (1 - similarity) + 1e-9) for s, t in zip(x, y)], np.int64)
            return pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.nulls(len(x), pa.float64()), pa.array(similar(x, y, far))], ["a", "b", "dist", "ok"])

        p = pairs.join(said.select(F.col("id").alias("a"), F.col("said").alias("text")), "a").join(said.select(F.col("id").alias("b"), F.col("said").alias("other")), "b")
        return B.arrow_map(p, run, "a long, b long, dist double, ok boolean")

    members = near.join(said.select("id", "ord", "sim", F.length("said").alias("len"), F.floor(F.length("said") * (1 - similarity) + 1e-9).cast("double").alias("tol")), "id")

    def fits() -> Column:
        alike = (F.col("p_sim") == 0) | (F.col("q_sim") == 0) | (F.bit_count(F.col("p_sim").bitwiseXOR(F.col("q_sim"))) <= MAX_BITS)
        return (F.abs(F.col("p_len") - F.col("q_len")) <= F.greatest("p_tol", "q_tol")) & alike

    labels = link(members.select("bucket", "id", "ord", "tol", "times", "len", "sim"), verify, near=fits)
    group = kind.select("hash", F.struct("d", "key", "line").alias("first"), "n").join(labels.select(F.col("id").alias("hash"), "label"), "hash", "left").withColumn("label", F.coalesce("label", "hash"))
    whole = group.groupBy("label").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).where("n > 1").select("label", "keep")
    # a row per kind of line that occurs twice or is in a group; lines of a hot kind split over tasks
    keep = B.keep(group.join(whole, "label").select("hash", F.col("keep.key").alias("first_key"), F.col("keep.line").alias("first_line")), "repeated")
    for x in (near, said, labels):
        B.forget(x)
    others = both.where("hash is not null").select("hash", F.explode(F.arrays_zip(F.col("more_keys").alias("key"), F.col("more_lines").alias("line"))).alias("at"))
    every = at.select("hash", "key", "line").unionByName(others.select("hash", "at.key", "at.line"))
    gone = B.keep(every.join(keep, "hash").where("key <> first_key OR line <> first_line").select("key", "line").distinct(), "removed")
    counts = B.keep(both.where("n_lines is not null").select("doc_id", "key", "n_lines"), "counts") if counted else None
    for x in (both, at, keep):
        B.forget(x)
    return gone, counts


def duplicate_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, line): the lines, by number from 0, that an earlier line of their group stands for. docs: key, doc_id, text."""
    return _duplicates(docs, similarity, False)[0]


def _per_key(gone: DataFrame) -> DataFrame:
    return gone.groupBy("key").agg(F.array_sort(F.collect_list("line")).alias("gone"))


def remove_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, gone): numbers of removed lines, ascending, for each key of docs (key, doc_id, text) that loses any."""
    return _per_key(duplicate_lines(docs, similarity))


def kept_text(text, gone):
    """The text without the lines in gone."""
    rows = F.split(text, "\n", -1)
    kept = F.filter(rows, lambda x, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("key", B.row_key(F.col("doc_id"), F.col("text")))
    gone, counted = _duplicates(docs, SIMILARITY, True)
    none = F.array().cast("array<int>")
    return counted.join(_per_key(gone), "key", "left").select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("gone", none).alias("removed_lines"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go; a document all of whose lines were repeats goes with them."""
    key, gone = B.private(docs, "key", "gone")
    keyed = docs.withColumn(key, B.row_key(F.col("doc_id"), F.col("text")))
    lost = remove_lines(keyed.select(F.col(key).alias("key"), "doc_id", "text")).toDF(key, gone)
    out = keyed.join(lost, key, "left").withColumn("text", kept_text(F.col("text"), F.col(gone)))
    out = out.where(F.col(gone).isNull() | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
