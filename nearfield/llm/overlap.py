"""The same or almost the same records across splits, by content-defined chunks.

Two texts overlap if the fewest single-character edits between them are at most a tenth of the longer
one's length.  Pairs are searched in cells (a block of training texts of like length, a block of evaluation
texts that may be as long).  With a tenth of edits, unchanged chunks are so short that two texts share some by
chance, so a training text is cut into longer pieces, of which one has one edit at most, and each piece is
looked up without one of its quarters, at the few places where it may stand (see :class:`PieceIndex`).  What
is met must also have counts of characters and of neighbouring pairs that so few edits allow, and then goes to
the exact check (edit distance with a bound, in the JVM).

The overlap fraction of a pair comes from content-defined chunks: a chunk ends where the rolling hash of its
last three characters says so, within a least and a greatest length, and so depends on nothing before its
start.  Chunks of the training text that stand in the evaluation text, moved by at most the allowed edits, are
summed up.  Very long training texts are looked up by their chunks as well: an edit spoils at most one, hence
of ``c`` chunks at least ``c - k`` stand unchanged in any text within ``k`` edits, moved by at most ``k``; every
position of an evaluation text is tried as the start of a chunk, so an unchanged chunk is always met.

As a shuffle the digests would be many times the texts.  Texts too short for one edit are joined by equality.
Only distinct texts take part; ids come back at the end.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.skew import meet_two
from nearfield.storage import Workspace

#: Training / evaluation texts of one cell.
TRAIN_BLOCK = 80_000
EVAL_BLOCK = 500_000
#: Training texts from this length on are looked up by chunks, shorter ones by pieces (whose places grow with the square of the length).
LONG = 400
#: Ids of one text that a block holds when pairs of ids are written out.
MEMBERS = 5_000
#: Texts that are chunked, evaluation texts that are looked up at once.
TEXT_BATCH = 4_000
PROBE_BATCH = 8_000
#: (shortest text, least chunk, greatest chunk, one in how many hashes cuts): texts of each class of length.
CLASSES = ((72, 5, 7, 3), (9, 2, 4, 2))
#: Chunks of a training text that are common in its block and need not be looked up, as far as others suffice.
DROPPED = 4
LEAST_SHARED = 3
_BATCH_HITS = 200_000
_BATCH_CELLS = 400_000
#: Texts of one band differ in length by less than this factor; a text meets the bands from 0.9 to 1 / 0.9 of its length.
BAND = 1.03
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HIGH, _ONES, _SEVEN = np.uint64(0x8080808080808080), np.uint64(0x0101010101010101), np.uint64(0x7F)


def allowed(length: np.ndarray) -> np.ndarray:
    """Edits allowed when the longer text has this length."""
    return length // 10


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the offsets of the texts."""
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="uint32").astype("uint64")
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("int64")


class Stretches:
    """Digests of any stretches of many texts, from prefix sums of a polynomial hash modulo 2^64."""

    def __init__(self, texts: list[str]):
        self.codes, self.offsets = _codes(texts)
        n = len(self.codes)
        power = np.ones(n + 1, dtype="uint64")
        power[1:] = np.multiply.accumulate(np.full(n, _BASE))
        self._prefix = np.zeros(n + 1, dtype="uint64")
        self._prefix[1:] = np.cumsum((self.codes + np.uint64(7)) * power[:n])
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self._back = np.ones(n + 1, dtype="uint64")
        self._back[1:] = np.multiply.accumulate(np.full(n, inverse))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal stretches, wherever they stand; positions count through all texts."""
        return (self._prefix[end] - self._prefix[start]) * self._back[start]

    def windows(self, length: int) -> np.ndarray:
        """Digests of the stretches of this length from every position on, as far as there are so many characters."""
        n = max(0, len(self.codes) - length + 1)
        return (self._prefix[length:] - self._prefix[:n]) * self._back[:n] if n else np.zeros(0, dtype="uint64")


class Chunker(Stretches):
    """Chunks of many texts at once: for every position the length and digest of the chunk that starts there."""

    def __init__(self, texts: list[str], least: int, greatest: int, one_in: int):
        super().__init__(texts)
        codes, n = self.codes, len(self.codes)
        owner_end = np.repeat(self.offsets[1:], np.diff(self.offsets))
        width = min(3, least)
        cut = np.zeros(n + greatest + 1, dtype=bool)  # cut[q]: a chunk may end before position q
        rolling = np.zeros(n, dtype="uint64")
        for k in range(width):
            rolling[width - 1 :] = rolling[width - 1 :] * np.uint64(1_000_003) + codes[k : n - width + 1 + k]
        mixed = (rolling * _MIX) >> np.uint64(40)
        cut[1 : n + 1] = mixed % np.uint64(one_in) == 0
        position = np.arange(n)
        length = np.full(n, greatest)
        for size in range(greatest - 1, least - 1, -1):
            length[cut[position + size]] = size
        self.whole = position + length <= owner_end  # the others run into the end of their text
        self.length = length
        digest = self.hash(position, np.minimum(position + length, n))
        self.digest = (digest ^ (digest >> np.uint64(29))) * _MIX + length.astype("uint64")

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, position) of the chunks of each text from its start on, without the one cut off by its end."""
        texts = np.arange(len(self.offsets) - 1)
        at, out_t, out_p = self.offsets[:-1].copy(), [], []
        alive = at < self.offsets[1:]
        while alive.any():
            texts, at = texts[alive], at[alive]
            ok = self.whole[at]
            texts, at = texts[ok], at[ok]
            out_t.append(texts)
            out_p.append(at)
            at = at + self.length[at]
            alive = at < self.offsets[texts + 1]
        if not out_t:
            return np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64")
        return np.concatenate(out_t), np.concatenate(out_p)


def _profiles(chunker: Stretches) -> tuple[np.ndarray, np.ndarray]:
    """Counts of characters and of neighbouring pairs of characters of each text, in bins."""
    n = len(chunker.offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(chunker.offsets))
    codes = chunker.codes
    one = np.bincount(owner * 32 + ((codes * _MIX) >> np.uint64(59)).astype("int64"), minlength=n * 32)
    inside = owner[1:] == owner[:-1]
    two = ((codes[:-1] * np.uint64(1_000_003) + codes[1:]) * _MIX) >> np.uint64(57)
    pair = np.bincount(owner[1:][inside] * 128 + two[inside].astype("int64"), minlength=n * 128)
    return np.minimum(one, 32767).astype("int16").reshape(n, 32), np.minimum(pair, 32767).astype("int16").reshape(n, 128)


def _possible(pe: np.ndarray, pt: np.ndarray, fe: np.ndarray, ft: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the counts of the pairs (fe, ft) differ by no more than ``most`` either way, which that many edits need."""
    out = np.empty(len(fe), dtype=bool)
    for at in range(0, len(fe), 50_000):
        part = slice(at, at + 50_000)
        d = pe[fe[part]] - pt[ft[part]]
        out[part] = (np.maximum(d, 0).sum(axis=1) <= most[part]) & (np.maximum(-d, 0).sum(axis=1) <= most[part])
    return out


def _key(digest: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Digest and position in one sortable number; positions beyond 16 bits count as the last."""
    return (digest & ~np.uint64(0xFFFF)) | np.clip(position, 0, 0xFFFF).astype("uint64")


class TrainIndex:
    """Looked-up chunks of a block of training texts, sorted by digest and position.

    The texts are chunked a batch at a time, so that only their chunks stay in memory.
    """

    def __init__(self, train: list[str], least: int, greatest: int, one_in: int):
        self.params = (least, greatest, one_in)
        self.length = np.array([len(t) for t in train], dtype="int64")
        texts, places, digests, sizes, ones, twos = [], [], [], [], [], []
        for at in range(0, len(train), TEXT_BATCH):
            c = Chunker(train[at : at + TEXT_BATCH], *self.params)
            text, place = c.chains()
            texts.append(text + at)
            places.append(place - c.offsets[text])
            digests.append(c.digest[place])
            sizes.append(c.length[place])
            one, two = _profiles(c)
            ones.append(one)
            twos.append(two)
        text, place, digest, chunk = map(np.concatenate, (texts, places, digests, sizes))
        self.one, self.two = np.concatenate(ones), np.concatenate(twos)
        n = len(train)
        most = allowed((self.length / 0.9).astype("int64") + 1)  # edits allowed with the longest partner
        # drop the chunks that are common here, as far as enough others are left
        order = np.argsort(digest, kind="stable")
        text, place, digest, chunk = text[order], place[order], digest[order], chunk[order]
        _, size = np.unique(digest, return_counts=True)
        common = np.repeat(size, size)
        by = np.lexsort((-common, text))  # per text, the most common first
        start = np.searchsorted(text[by], np.arange(n))
        count = np.bincount(text, minlength=n)
        drop = np.clip(count - most - LEAST_SHARED, 0, DROPPED)
        keep = np.zeros(len(by), dtype=bool)
        keep[by] = np.arange(len(by)) - start[text[by]] >= drop[text[by]]
        text, place, digest, chunk = text[keep], place[keep], digest[keep], chunk[keep]
        # what k edits must leave: all kept chunks but the k longest
        by = np.lexsort((-chunk, text))
        start = np.searchsorted(text[by], np.arange(n + 1))
        running = np.concatenate([[0], np.cumsum(chunk[by])])
        self.need = running[start[1:]] - running[np.minimum(start[:-1] + most, start[1:])]
        key = _key(digest, place)
        order = np.argsort(key, kind="stable")
        self.key, self.text, self.chunk = key[order], text[order].astype("int32"), chunk[order].astype("float32")

    def candidates(self, evals: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(evaluation text, training text, overlap fraction) of all pairs that may be within the allowed edits."""
        for at in range(0, len(evals), TEXT_BATCH):
            for fe, ft, fraction in self._batch(evals[at : at + TEXT_BATCH]):
                yield fe + at, ft, fraction

    def _batch(self, evals: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ec = Chunker(evals, *self.params)
        e_len, t_len, nt = np.diff(ec.offsets), self.length, len(self.length)
        probe = np.flatnonzero(ec.whole)
        owner = np.repeat(np.arange(len(evals)), e_len)[probe]
        # a chunk moved by s leaves |s| edits before it and |d - s| behind it, d being the difference of the
        # lengths: so s lies between (d - k) / 2 and (d + k) / 2, for the d and k of this block
        position, mine = probe - ec.offsets[owner], e_len[owner]
        k = allowed(np.maximum(mine, t_len.max()))
        lo = np.searchsorted(self.key, _key(ec.digest[probe], position + (t_len.min() - mine - k) // 2), "left")
        hi = np.searchsorted(self.key, _key(ec.digest[probe], position + (t_len.max() - mine + k + 1) // 2), "right")
        hi = np.maximum(hi, lo)
        met = np.flatnonzero(hi > lo)
        owner, lo, n = owner[met], lo[met], (hi - lo)[met]
        load = np.concatenate([[0], np.cumsum(n)])
        bounds = np.searchsorted(owner, np.arange(len(evals) + 1))
        e_one, e_two = _profiles(ec)
        # texts that chunks cannot exclude need nothing, all others at least one shared chunk
        need = np.where(self.need <= 0, 0, self.need).astype("float64")
        group = max(1, _BATCH_CELLS // nt)
        at = 0
        while at < len(evals):
            end = at + 1
            while end < len(evals) and end - at < group and load[bounds[end + 1]] - load[bounds[at]] <= _BATCH_HITS:
                end += 1
            a, b = bounds[at], bounds[end]
            m = n[a:b]
            posting = np.arange(load[b] - load[a]) + np.repeat(lo[a:b] - (load[a:b] - load[a]), m)
            pair = np.repeat((owner[a:b] - at) * nt, m)
            pair += self.text[posting]
            shared = np.bincount(pair, weights=self.chunk[posting], minlength=(end - at) * nt).reshape(end - at, nt)
            found = np.flatnonzero((shared >= need).ravel())
            fe, ft, total = found // nt + at, found % nt, shared.ravel()[found]
            for profile_e, profile_t, factor in ((None, None, 0), (e_one, self.one, 1), (e_two, self.two, 2)):
                bound = allowed(np.maximum(e_len[fe], t_len[ft]))
                ok = np.abs(e_len[fe] - t_len[ft]) <= bound if profile_e is None else _possible(profile_e, profile_t, fe, ft, bound * factor)
                fe, ft, total = fe[ok], ft[ok], total[ok]
            yield fe, ft, np.minimum(1.0, total / t_len[ft])
            at = end


class PieceIndex:
    """Training texts of like length, found by pieces that at most one edit has touched.

    With at most ``k`` edits and ``m`` pieces, ``k < 2 m``, take the first piece ``i`` at whose end there were no more
    than ``2 i + 1`` edits: at least ``2 i`` lie before it, so it has none or one, it is moved by at most ``2 i + 1``, and at
    most ``k - 2 i`` are left from its start on.  Its edit lies in one of its four quarters (an insertion belongs to the
    character that follows), so the other three stand unchanged, those behind the edit moved by one at most.  Hence
    each piece is looked up four times, without one quarter each, and only at the places that these bounds leave.
    """

    def __init__(self, train: list[str]):
        self.train = train
        self.length = np.array([len(t) for t in train], dtype="int64")
        one, two = zip(*(_profiles(Stretches(train[at : at + TEXT_BATCH])) for at in range(0, len(train), TEXT_BATCH)))
        self.one, self.two = np.concatenate(one), np.concatenate(two)
        self.widest = np.argsort(-self.one.var(axis=0), kind="stable")
        self.lanes, self.other_lanes = self._lanes(self.one, 0), self._lanes(self.one, 7)

    def _lanes(self, one: np.ndarray, first: int) -> np.ndarray:
        """Counts of seven bins, from the one that varies most or a later one on, and of all others, in the bytes of one number."""
        own = one[:, self.widest[first : first + 7]]
        eight = np.minimum(np.column_stack([own, one.sum(axis=1, dtype="int64") - own.sum(axis=1, dtype="int64")]), 127).astype("uint8")
        return np.ascontiguousarray(eight).view("uint64").ravel()

    def _tables(self, pieces: int) -> tuple[np.ndarray, list[list[tuple[np.ndarray, ...]]]]:
        """Bounds of the quarters; per piece and left-out quarter a table of what is there, and digests with their text in the low bits, sorted, the ends of equal ones, and the texts' counts."""
        n = len(self.train)
        width = int(self.length.min()) // pieces
        cuts = width * np.arange(5) // 4
        digests = np.empty((pieces, 4, n), dtype="uint64")
        for at in range(0, n, TEXT_BATCH):
            texts = Stretches(self.train[at : at + TEXT_BATCH])
            for i in range(pieces):
                for left_out in range(4):
                    digests[i, left_out, at : at + TEXT_BATCH] = _without(lambda start, length: texts.hash(start, start + length), texts.offsets[:-1] + i * width, cuts, left_out, 0)
        bits, shift = np.uint64((1 << n.bit_length()) - 1), np.uint64(64 - n.bit_length() - 3)
        out = []
        for i in range(pieces):
            out.append([])
            for left_out in range(4):
                keys = np.sort((digests[i, left_out] & ~bits) | np.arange(n, dtype="uint64"))
                there = np.zeros(8 << n.bit_length(), dtype=bool)
                there[keys >> shift] = True
                ends = np.append(np.flatnonzero((keys[1:] ^ keys[:-1]) > bits) + 1, n).astype("int32")
                ends = np.repeat(ends, np.diff(ends, prepend=0))
                out[i].append((there, keys, ends, self.lanes[(keys & bits).astype("int64")], bits, shift))
        return cuts, out

    def candidates(self, evals: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(evaluation text, training text) of all pairs that may be within the allowed edits; a pair may come again."""
        size = np.array([len(t) for t in evals], dtype="int64")
        fits = np.abs(size - np.clip(size, self.length.min(), self.length.max())) <= allowed(np.maximum(size, self.length.min()))
        pieces = allowed(np.maximum(size, self.length.max())) // 2 + 1
        for m in np.unique(pieces[fits]):
            cuts, tables = self._tables(int(m))
            mine = np.flatnonzero(fits & (pieces == m))
            for at in range(0, len(mine), PROBE_BATCH):
                part = mine[at : at + PROBE_BATCH]
                for fe, ft in self._batch([evals[i] for i in part], cuts, tables):
                    yield part[fe], ft
            del tables  # before the next ones are built

    def _batch(self, evals: list[str], cuts: np.ndarray, tables: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        texts = Stretches(evals)
        one, two = _profiles(texts)
        size = np.diff(texts.offsets)
        limit, lanes = allowed(np.maximum(size, self.length.max())).astype("uint64"), self._lanes(one, 0)
        windows = {length: texts.windows(length) for length in {*(cuts[4] - cuts[1:4]).tolist(), *cuts[1:4].tolist()}}
        found, rows = [], 0
        for left_out, i, at, move, after in self._places(size, cuts, len(tables)):
            digest = _without(lambda start, length: windows[int(length)][start], texts.offsets[at] + i * cuts[4] + move, cuts, left_out, after)
            for pair in self._met(digest, at, tables[i][left_out], limit, lanes):
                found.append(pair)
                rows += len(pair)
                if rows >= _BATCH_CELLS:
                    yield self._checked(found, size, one, two)
                    found, rows = [], 0
        if found:
            yield self._checked(found, size, one, two)

    def _places(self, size: np.ndarray, cuts: np.ndarray, pieces: int) -> Iterator[tuple[int, int, np.ndarray, int, int]]:
        """(quarter left out, piece, evaluation texts, move of the piece, further move behind that quarter)."""
        k = allowed(np.maximum(size, self.length.max()))
        least, most, width = size - self.length.max(), size - self.length.min(), int(cuts[4])
        for i in range(pieces):
            rest = k - 2 * i
            for move in range(-2 * i - 1, 2 * i + 2):
                start = i * width + move
                # no edit in the piece or one in its last quarter; one in its first quarter
                whole = (rest >= 0) & (least - rest <= move) & (move <= most + rest) & (start + cuts[3] <= size)
                behind = (rest >= 1) & (least - rest < move) & (move < most + rest) & (start + width <= size)
                if start >= 0:
                    yield 3, i, np.flatnonzero(whole), move, 0
                if start + cuts[1] >= 0:
                    yield 0, i, np.flatnonzero(behind), move, 0
                if start < 0 or abs(move) > 2 * i:
                    continue
                for after in (-1, 0, 1):
                    moved = move + after
                    at = np.flatnonzero((rest >= 1) & (least - rest < moved) & (moved < most + rest) & (start + width + after <= size))
                    yield 1, i, at, move, after
                    yield 2, i, at, move, after

    def _met(self, digest: np.ndarray, at: np.ndarray, table: tuple, limit: np.ndarray, lanes: np.ndarray) -> Iterator[np.ndarray]:
        """Pairs, as one number each, that share the digest and whose coarse counts allow so few edits."""
        there, keys, ends, theirs, bits, shift = table
        hit = np.flatnonzero(there[digest >> shift])
        digest, at = digest[hit], at[hit]
        lo = np.searchsorted(keys, digest & ~bits, "left")
        same = np.flatnonzero((keys[np.minimum(lo, len(keys) - 1)] | bits) == (digest | bits))
        at, lo = at[same], lo[same]
        n = ends[lo] - lo
        load = np.concatenate([[0], np.cumsum(n)])
        first = 0
        while first < len(n):  # a digest has no more texts than the block
            last = max(first + 1, int(np.searchsorted(load, load[first] + _BATCH_HITS, "right")) - 1)
            part, m = slice(first, last), n[first:last]
            posting = np.arange(load[last] - load[first]) + np.repeat(lo[part] - (load[part] - load[first]), m)
            mine, other, most = np.repeat(lanes[at[part]], m), theirs[posting], np.repeat(limit[at[part]], m)
            ok = np.flatnonzero(_excess(mine, other) <= most)
            ok = ok[_excess(other[ok], mine[ok]) <= most[ok]]
            yield np.repeat(at[part], m)[ok] * len(self.train) + (keys[posting[ok]] & bits).astype("int64")
            first = last

    def _checked(self, found: list[np.ndarray], size: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = np.sort(np.concatenate(found))
        fe, ft = np.divmod(pair[np.diff(pair, prepend=-1) > 0], len(self.train))
        bound = allowed(np.maximum(size[fe], self.length[ft]))
        mine, theirs = self._lanes(one, 7)[fe], self.other_lanes[ft]
        ok = (np.abs(size[fe] - self.length[ft]) <= bound) & (_excess(mine, theirs) <= bound.astype("uint64")) & (_excess(theirs, mine) <= bound.astype("uint64"))
        fe, ft = fe[ok], ft[ok]
        for mine, theirs, factor in ((one, self.one, 1), (two, self.two, 2)):
            ok = _possible(mine, theirs, fe, ft, allowed(np.maximum(size[fe], self.length[ft])) * factor)
            fe, ft = fe[ok], ft[ok]
        return fe, ft


def _excess(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By how much the bytes of ``a`` that are greater than those of ``b`` exceed them in all, modulo 256, which can only be less."""
    more = (a | _HIGH) - b
    more &= ((more & _HIGH) >> np.uint64(7)) * _SEVEN
    return (more * _ONES) >> np.uint64(56)


def _without(digest: Callable[[np.ndarray, int], np.ndarray], start: np.ndarray, cuts: np.ndarray, left_out: int, after: int) -> np.ndarray:
    """Mixed digests of the pieces from ``start`` on without one quarter, what follows it being moved by ``after``.

    ``digest`` gives those of the stretches of one length from some positions on.
    """
    if left_out == 3:
        return digest(start, cuts[3]) * _MIX
    behind = digest(start + cuts[left_out + 1] + after, cuts[4] - cuts[left_out + 1])
    if left_out == 0:
        return behind * _MIX
    before = digest(start, cuts[left_out])
    return ((before ^ (before >> np.uint64(29))) * _BASE + behind) * _MIX


def shared_lengths(a: list[str], b: list[str], least: int, greatest: int, one_in: int) -> np.ndarray:
    """Per pair the summed length of the chunks of ``b`` that stand in ``a``, moved by no more than the allowed edits, as a fraction of ``b``."""
    out = []
    for at in range(0, len(a), TEXT_BATCH):
        ca, cb = (Chunker(x[at : at + TEXT_BATCH], least, greatest, one_in) for x in (a, b))
        n = len(ca.offsets) - 1
        pair, place = cb.chains()
        within = place - cb.offsets[pair]
        owner = np.repeat(np.arange(n), np.diff(ca.offsets))
        salt = np.arange(n).astype("uint64") * _BASE
        keys = np.sort(_key((ca.digest + salt[owner]) * _MIX, np.arange(len(owner)) - ca.offsets[owner])[ca.whole])
        k = allowed(np.maximum(np.diff(ca.offsets), np.diff(cb.offsets)))[pair]
        mine = (cb.digest[place] + salt[pair]) * _MIX
        met = np.searchsorted(keys, _key(mine, within + k), "right") > np.searchsorted(keys, _key(mine, within - k), "left")
        out.append(np.bincount(pair, weights=cb.length[place] * met, minlength=n) / np.maximum(1, np.diff(cb.offsets)))
    return np.minimum(1.0, np.concatenate(out)) if out else np.zeros(0)


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b, shared = [], [], []
    evals, train = (pdf.loc[pdf["role"] == role, "text"].tolist() for role in (1, 0))
    short, long = [t for t in train if len(t) < LONG], [t for t in train if len(t) >= LONG]
    found = [(evals[i], short[j]) for fe, ft in PieceIndex(short).candidates(evals) for i, j in zip(fe, ft)] if short and evals else []
    upper = math.inf
    for shortest, *params in CLASSES:
        mine = [pair for pair in found if shortest <= len(pair[1]) < upper]
        a.extend(pair[0] for pair in mine)
        b.extend(pair[1] for pair in mine)
        shared.append(shared_lengths([pair[0] for pair in mine], [pair[1] for pair in mine], *params))
        upper = shortest
    for fe, ft, fraction in TrainIndex(long, *CLASSES[0][1:]).candidates(evals) if long and evals else ():
        a.extend(evals[i] for i in fe)
        b.extend(long[i] for i in ft)
        shared.append(fraction)
    return pd.DataFrame({"a": a, "b": b, "overlap": np.concatenate(shared)}).astype({"a": "object", "b": "object", "overlap": "float64"})


def trimmed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text``: distinct ids with their trimmed, non-blank texts."""
    text = F.regexp_replace(text_col, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text.alias("text")).where("text <> ''").distinct()


def similar_texts(evals: DataFrame, train: DataFrame, workspace: Workspace) -> DataFrame:
    """``a, b, overlap, edits`` of all pairs of different texts within the allowed edits; ``text`` on both sides.

    Each text is to come once.  Both sides are read twice, so write them down before.
    ``overlap`` is the summed length of shared chunks as a fraction of the training text.
    """
    e, t = (df.where(F.length("text") >= CLASSES[-1][0]) for df in (evals, train))
    band = F.floor(F.log(F.length("text")) / math.log(BAND))
    t = t.withColumn("band", band.cast("int"))
    # blocks of a band: counted, at most a few hundred rows as bands are logarithmic
    load = t.groupBy("band").agg(F.ceil(F.count("*") / TRAIN_BLOCK).cast("int").alias("blocks"))
    left = t.join(F.broadcast(load), "band").withColumn("i", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int"))
    lowest, highest = F.floor(F.log(F.length("text") * 0.9 - 1) / math.log(BAND)), F.floor(F.log(F.length("text") / 0.9 + 1) / math.log(BAND))
    met = e.withColumn("band", F.explode(F.sequence(lowest.cast("int"), highest.cast("int")))).join(F.broadcast(load), "band")
    parts = max(1, -(-e.count() // EVAL_BLOCK))
    part = F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")
    left = left.select("text", F.lit(0).alias("role"), "band", "i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("j"))
    right = met.select("text", F.lit(1).alias("role"), "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), part.alias("j"))
    pairs = left.unionByName(right).groupBy("band", "i", "j").applyInPandas(_cell, "a string, b string, overlap double")
    checked = pairs.where("a <> b").withColumn("edits", F.expr("levenshtein(a, b, cast(floor(greatest(length(a), length(b)) / 10) as int))")).where("edits >= 0")
    return workspace.save(checked.distinct(), "similar")


def cross_split_overlaps(evals: DataFrame, train: DataFrame, workspace: Workspace, eval_id: str = "sample_id", train_id: str = "train_id", text: str = "smiles") -> DataFrame:
    """``sample_id, train_id, overlap, edits``: every evaluation row with each training row of the same or almost the same text.

    Null and blank texts match nothing; rows delivered twice count once; texts of one id that differ all
    count.  Empty tables give an empty result.
    """
    e, t = workspace.save(trimmed(evals, eval_id, text), "evals"), workspace.save(trimmed(train, train_id, text), "train")
    e_texts, t_texts = (workspace.save(df.select("text").distinct(), name) for df, name in ((e, "eval-texts"), (t, "train-texts")))
    near = similar_texts(e_texts, t_texts, workspace)
    same = e_texts.join(t_texts, "text", "left_semi").select(
        F.col("text").alias("a"), F.col("text").alias("b"), F.lit(1.0).alias("overlap"), F.lit(0).alias("edits")
    )
    links = workspace.save(near.unionByName(same), "links")
    # back to the ids: a text may be delivered under very many of them, so blocks of ids meet blocks of links
    e = e.select(F.col("id").alias("sample_id"), F.col("text").alias("__e"), F.xxhash64("text").alias("__h"))
    t = t.select(F.col("id").alias("train_id"), F.col("text").alias("__t"), F.xxhash64("text").alias("__h"))
    named = meet_two(links.withColumn("__h", F.xxhash64("a")), e, "__h", "b", "sample_id", MEMBERS, workspace).where(F.col("a") == F.col("__e"))
    named = named.select("sample_id", "b", "overlap", "edits").withColumn("__h", F.xxhash64("b"))
    both = meet_two(workspace.save(named, "named"), t, "__h", "sample_id", "train_id", MEMBERS, workspace).where(F.col("b") == F.col("__t"))
    return both.select("sample_id", "train_id", "overlap", "edits").distinct()
