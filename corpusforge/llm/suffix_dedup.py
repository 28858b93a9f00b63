"""Removal of repeated passages with distributed suffix arrays and their common-prefix intervals.

A byte goes if it lies in a LENGTH-byte string that also starts in a document with a smaller doc_id.

1. Documents are dealt into blocks by a hash of doc_id. In every window of LENGTH bytes the start of the
   GRAM-byte string with the least hash is the anchor (of equal ones the last), so equal windows have equal
   anchors at equal places. Blocks send the distinct hashes of their anchors' grams, and which of them they
   have in several documents, bucket by bucket; a bucket answers which grams occur in several documents, the
   few per cent that go on.
2. For each such anchor a block sends the fragment that spans the windows it is the anchor of, once for
   equal fragments, with the least doc_id. A bucket builds the suffix array of its fragments' right
   contexts and that of their reversed left contexts, each with the lengths of common prefixes. A stack scan
   lists the common-prefix intervals with all their occurrences, not just neighbours in the array, their
   least doc_id, and whether their left extensions are diverse. Occurrences that agree in LENGTH - a bytes to
   the right of the anchor and in a bytes to the left have the same LENGTH-byte string: an interval that is
   not diverse is settled at once, and a maximal repeat is split by the intervals of the left contexts.
   A gram with more than HOT anchors (a short line between other texts each time) has too many fragments for
   one bucket. Only equal windows need to meet, so its fragments are cut into their windows, each once a
   block, and those go to sub-buckets by a hash of the window.
3. The blocks mark the windows whose least doc_id is smaller than their document's and join overlaps.

Copies are merged before each shuffle, so a passage in a third of all documents costs one entry a block.
Blocks, buckets and sub-buckets have bounded expected size, and their number grows with the input; no gram
has more than HOT fragments in a bucket. Comparison is by bytes; a hash only proposes.

Defined cases: null text counts as empty; texts under LENGTH bytes lose nothing; a null doc_id counts as
larger than any number and is nobody's source; rows that repeat a doc_id do not remove from each other; an
empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import documents

LENGTH, GRAM = 50, 20
#: Start positions of grams in a window, and the bytes to the left of an anchor that its windows reach.
PLACES = LENGTH - GRAM + 1
BLOCK_BYTES = 8 << 20
#: Bytes of documents that are hashed at once.
CHUNK_BYTES = 1 << 18
ANCHORS_PER_BUCKET = 1 << 19
#: Anchors of one gram that may meet in a bucket (about 1 KB of arrays each), and sub-buckets to a bucket for the windows of the others.
HOT, SPREAD = 1 << 14, 16
NO_ID = np.iinfo(np.int64).max


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every string of ``size`` bytes, by doubling."""
    with np.errstate(over="ignore"):
        factor = 0x9E3779B97F4A7C15
        part, width = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
        part ^= part >> np.uint64(32)
        out, done = None, 0
        left = size
        while left:
            if left & 1:
                if out is None:
                    out, done = part[: len(data) - width + 1], width
                else:
                    n = len(data) - done - width + 1
                    out = out[:n] * np.uint64(pow(factor, width, 2**64)) + part[done : done + n]
                    done += width
            left >>= 1
            if left:
                n = len(data) - 2 * width + 1
                part = part[:n] * np.uint64(pow(factor, width, 2**64)) + part[width : width + n]
                width *= 2
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def anchors(texts: list[bytes]) -> list[np.ndarray]:
    """(gram hash, text number, position, first window, last window) of each anchor: the windows first..last have it."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return [np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))]
    hashes = gram_hashes(data, GRAM)
    # half of a hash over the place counted from the end: the least of a window is its anchor, of equal ones the last
    best, width = (hashes & HIGH) | (LOW - np.arange(len(hashes), dtype=np.uint64)), 1
    while width < PLACES:
        step = min(width, PLACES - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    number = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    windows = np.flatnonzero(number[: len(best)] == number[LENGTH - 1 :])  # those within one text
    best, row = (LOW - (best[windows] & LOW)).astype(np.int64), number[windows].astype(np.int64)
    new = np.flatnonzero((best[1:] != best[:-1]) | (row[1:] != row[:-1])) + 1
    new = np.concatenate([[0], new]) if len(windows) else new
    last = windows[np.append(new[1:], len(windows)) - 1] if len(windows) else windows
    at, row = best[new], row[new]
    return [hashes[at], row, at - begin[row], windows[new] - begin[row], last - begin[row]]


def block_anchors(texts: list[bytes], buckets: int) -> list[np.ndarray]:
    """(key, text number, position, first window, last window) of a block's anchors; a key is bucket << 32 | 32 bits of the gram's hash."""
    parts, begin = [], 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= CHUNK_BYTES):
            size += len(texts[end])
            end += 1
        part = anchors(texts[begin:end])
        part[1] = part[1] + begin
        parts.append(part)
        begin = end
    hashes, *others = (np.concatenate([p[k] for p in parts]) for k in range(5))
    with np.errstate(over="ignore"):  # anchors have small hashes; these are spread again
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return [((hashes % np.uint64(buckets)) << np.uint64(32)) | (hashes >> np.uint64(32)), *others]


def by_bucket(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the keys of each bucket, in their order."""
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, starts_of(bucket[order])[1:]):
        if len(part):
            yield int(bucket[part[0]]), part


def short(keys: np.ndarray) -> bytes:
    """The lower half of keys, all that a bucket needs."""
    return (keys & LOW).astype(np.uint32).tobytes()


def keys_of(bucket: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32).astype(np.uint64) | np.uint64(bucket << 32)


def squeeze(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys start."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def ask(buckets: int):
    """A block's distinct gram keys, for each bucket, a bit for those in several of its documents, and how many anchors each has."""

    def of_block(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keys, row, *_ = block_anchors(list(frame["data"]), buckets)
        ids = frame["id"].to_numpy()[row]
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        at = starts_of(keys)
        if not len(at):
            return pd.DataFrame({"bucket": [], "block": [], "keys": [], "several": [], "counts": []})
        counts = np.diff(np.append(at, len(keys))).astype(np.uint32)
        several = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
        keys = keys[at]
        rows = [(b, key[0], short(keys[p]), np.packbits(several[p]).tobytes(), squeeze(counts[p].tobytes())) for b, p in by_bucket(keys)]
        return pd.DataFrame(rows, columns=["bucket", "block", "keys", "several", "counts"])

    return of_block


def answer(hot: int):
    """For each block, those of its keys that occur in several documents (in several blocks, or in several documents of one): keys, and apart those with more than ``hot`` anchors."""

    def of_bucket(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(k, np.uint32) for k in frame["keys"]]
        several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(p)) for p, b in zip(parts, frame["several"])])
        counts = np.concatenate([np.frombuffer(zstandard.decompress(c), np.uint32) for c in frame["counts"]])
        keys = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(keys, kind="stable")
        at = starts_of(keys[order])
        size = np.diff(np.append(at, len(order)))
        many = np.zeros(len(keys), bool)
        many[order] = np.repeat(np.add.reduceat(counts[order].astype(np.int64), at) > hot, size)
        chosen = order[np.repeat((size > 1) | (np.maximum.reduceat(several[order], at) > 0), size)]
        chosen = chosen[np.argsort(owner[chosen], kind="stable")]
        rows = [(frame["block"].iat[owner[p[0]]], key[0], keys[p[~many[p]]].tobytes(), keys[p[many[p]]].tobytes()) for p in np.split(chosen, starts_of(owner[chosen])[1:]) if len(p)]
        return pd.DataFrame(rows, columns=["block", "bucket", "keys", "hot"])

    return of_bucket


class Fragments:
    """The wanted anchors of a block with their fragments; equal fragments have one number, in an order fixed by the block's documents.

    parts has the numbers by bucket, without those of hot grams, which are cut into windows.
    """

    def __init__(self, docs: pd.DataFrame, wanted: pd.DataFrame, hot: np.ndarray, buckets: int):
        docs = docs.sort_values(["id", "mark"], kind="stable")
        self.docs, self.ids, self.data = docs, docs["id"].to_numpy(), list(docs["data"])
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), hot, *(keys_of(b, k) for b, k in zip(wanted["bucket"], wanted["keys"]))]))
        if not len(known) or not len(docs):
            self.row = self.at = self.number = np.zeros(0, np.int64)
            self.names, self.parts, self.hot = [], {}, np.zeros(0, np.int64)
            return
        keys, row, at, first, last = block_anchors(self.data, buckets)
        keep = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
        self.row, self.at = row[keep], at[keep]
        numbers: dict[tuple[int, bytes], int] = {}
        names = ((a - s, self.data[r][s : e + LENGTH]) for r, a, s, e in zip(self.row.tolist(), self.at.tolist(), first[keep].tolist(), last[keep].tolist()))
        self.number = np.fromiter((numbers.setdefault(n, len(numbers)) for n in names), np.int64, len(self.row))
        self.names = list(numbers)
        self.keys = np.zeros(len(self.names), np.uint64)
        self.keys[self.number] = keys[keep]
        is_hot = np.isin(self.keys, hot)
        self.hot, cold = np.flatnonzero(is_hot), np.flatnonzero(~is_hot)
        self.parts = {b: cold[p] for b, p in by_bucket(self.keys[cold])}

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fragment's number, start in it, LENGTH bytes) of each window of the hot grams' fragments."""
        texts = [self.names[i][1] for i in self.hot]
        size = np.array([len(t) for t in texts], np.int64)
        count = size - LENGTH + 1
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        if not len(start):
            return start, start, np.zeros(0, WINDOW)
        data = np.frombuffer(b"".join(texts), np.uint8)
        rows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[np.repeat(np.cumsum(size) - size, count) + start]
        return np.repeat(self.hot, count), start, rows.view(WINDOW).ravel()


WINDOW = f"V{LENGTH}"


def sub_bucket(windows: np.ndarray, buckets: int) -> np.ndarray:
    """The sub-bucket of each window; they are numbered after the buckets."""
    out = np.zeros(len(windows), np.uint64)
    with np.errstate(over="ignore"):
        for column in windows.view(np.uint8).reshape(len(windows), LENGTH).T:
            out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out % np.uint64(buckets * SPREAD) + np.uint64(buckets)


def least_of(windows: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows, the number of each window among them, and the least ``low`` of each."""
    distinct, number = np.unique(windows, return_inverse=True)
    least = np.full(len(distinct), NO_ID)
    np.minimum.at(least, number, low)
    return distinct, number, least


SENT = ["bucket", "block", "keys", "left", "size", "low", "high", "texts"]


def send(buckets: int):
    """A block's distinct fragments with their least and greatest doc_id, for each bucket, and the distinct windows of its hot grams, for each sub-bucket."""

    def of_block(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        hot = np.concatenate([np.zeros(0, np.uint64), *(keys_of(b, k) for b, k in zip(answers["bucket"], answers["hot"]))])
        mine = Fragments(docs, answers, hot, buckets)
        low, high = np.full(len(mine.names), NO_ID), np.full(len(mine.names), np.iinfo(np.int64).min)
        np.minimum.at(low, mine.number, mine.ids[mine.row])
        np.maximum.at(high, mine.number, mine.ids[mine.row])
        rows = []
        for b, p in mine.parts.items():
            names = [mine.names[i] for i in p]
            rows.append((b, key[0], short(mine.keys[p]), bytes(n[0] for n in names), bytes(len(n[1]) for n in names), squeeze(low[p].tobytes()), squeeze((high[p] - low[p]).tobytes()), squeeze(b"".join(n[1] for n in names))))
        number, _, windows = mine.windows()
        distinct, of, least = least_of(windows, low[number])
        most = np.full(len(distinct), np.iinfo(np.int64).min)
        np.maximum.at(most, of, high[number])
        for b, p in by_bucket(sub_bucket(distinct, buckets) << np.uint64(32)):
            rows.append((b, key[0], b"", b"", b"", squeeze(least[p].tobytes()), squeeze((most[p] - least[p]).tobytes()), squeeze(distinct[p].tobytes())))
        return pd.DataFrame(rows, columns=SENT)

    return of_block


def unpacked(frame: pd.DataFrame) -> pd.DataFrame:
    """What blocks sent, with plain low, high and texts."""
    plain = {c: [zstandard.decompress(x) for x in frame[c]] for c in ("low", "high", "texts")}
    plain["high"] = [(np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes() for a, b in zip(plain["low"], plain["high"])]
    return frame.assign(**plain)


def suffix_array(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and the common prefix of each with the one before it (0 for the first)."""
    n, width = texts.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = texts
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    common = np.zeros(n, np.int64)
    for at in range(1, n, 1 << 16):  # bounded memory
        a, b = texts[order[at - 1 : at - 1 + (1 << 16)]], texts[order[at : at + (1 << 16)]]
        differ = a[: len(b)] != b
        common[at : at + len(b)] = np.where(differ.any(1), differ.argmax(1), width)
    return order, common


def intervals(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """The common-prefix interval of this depth in which each row lies."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def common_prefix_intervals(order: np.ndarray, common: np.ndarray, kind: np.ndarray, low: np.ndarray) -> Iterator[tuple[int, int, int, int, bool, int]]:
    """(length, parent's length, begin, end, diverse, least) of the common-prefix intervals of two suffixes or more.

    A stack holds the intervals that are open at each suffix; one closes where the common prefix falls under
    its length. order[begin:end] are all its occurrences. It is a maximal repeat if its left extensions are
    diverse: if ``kind`` differs among them. least is the least ``low`` of its occurrences. Prefixes shorter
    than LENGTH - PLACES + 1 do not count.
    """
    heights = np.where(common > LENGTH - PLACES, np.minimum(common, LENGTH), 0).tolist()
    kinds, lows = kind[order].tolist(), low[order].tolist()
    stack: list[tuple[int, int, int, int, int]] = []  # length, begin, least and greatest kind, least low
    for i in range(1, len(kinds) + 1):
        height = heights[i] if i < len(kinds) else 0
        if not stack and not height:
            continue
        begin, small, large, least = i - 1, kinds[i - 1], kinds[i - 1], lows[i - 1]
        while stack and stack[-1][0] > height:
            length, begin, a, b, m = stack.pop()
            small, large, least = min(small, a), max(large, b), min(least, m)
            yield length, max(height, stack[-1][0] if stack else LENGTH - PLACES), begin, i, small != large, least
        if stack and stack[-1][0] == height:
            _, begin, a, b, m = stack.pop()
            small, large, least = min(small, a), max(large, b), min(least, m)
        if height:
            stack.append((height, begin, small, large, least))


def contexts(parts: list[tuple[bytes, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Right contexts, reversed left contexts, and the first and last bytes to the left of the anchor that a fragment's windows take."""
    left = np.concatenate([p[1] for p in parts]).astype(np.int64)
    size = np.concatenate([p[2] for p in parts]).astype(np.int64)
    data = np.frombuffer(b"".join(p[0] for p in parts), np.uint8)
    begin = np.cumsum(size) - size
    anchor = begin + left

    def take(at: np.ndarray, length: np.ndarray, width: int, step: int) -> np.ndarray:
        k = np.arange(width)
        return np.where(k < length[:, None], data[np.clip(at[:, None] + step * k, 0, len(data) - 1)], 0)

    right = take(anchor, size - left, LENGTH, 1)
    return right, take(anchor - 1, left, PLACES - 1, -1), left - (size - LENGTH), left


class Arrays:
    """The fragments of a bucket with the suffix arrays of their right and reversed left contexts."""

    def __init__(self, frame: pd.DataFrame):
        parts = [(t, np.frombuffer(left, np.uint8), np.frombuffer(size, np.uint8)) for t, left, size in zip(frame["texts"], frame["left"], frame["size"])]
        self.low, self.high = (np.concatenate([np.frombuffer(x, np.int64) for x in frame[c]]) for c in ("low", "high"))
        self.owner = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
        self.within = np.concatenate([np.arange(len(p[1])) for p in parts])
        right, left, self.near, self.far = contexts(parts)
        self.right, self.left = suffix_array(right), suffix_array(left)

    def least(self) -> np.ndarray:
        """For each fragment and each place of a window, the least doc_id with that window's string; NO_ID outside the fragment's windows."""
        places = np.arange(PLACES)
        within = (self.near[:, None] <= places) & (places <= self.far[:, None])
        least = np.where(within, self.low[:, None], NO_ID)
        order, common = self.right
        # left contexts and windows: what is equal here has the same text on the left
        kind = (intervals(*self.left, PLACES - 1) * PLACES + self.near) * PLACES + self.far
        differ = np.zeros((len(least), PLACES), bool)
        for length, parent, begin, end, diverse, low in common_prefix_intervals(order, common, kind, self.low):
            rows, a, b = order[begin:end], LENGTH - length, LENGTH - parent
            if diverse:
                differ[rows, a:b] = True
            else:
                a, b = max(a, int(self.near[rows[0]])), min(b, int(self.far[rows[0]]) + 1)
                least[rows, a:b] = low
        for a in range(PLACES):  # maximal repeats are split by the intervals of the left contexts
            rows = np.flatnonzero(differ[:, a] & within[:, a])
            if len(rows):
                group = intervals(order, common, LENGTH - a)[rows] * (len(self.low) + 1) + intervals(*self.left, a)[rows]
                by = np.argsort(group, kind="stable")
                at = starts_of(group[by])
                least[rows[by], a] = np.repeat(np.minimum.reduceat(self.low[rows][by], at), np.diff(np.append(at, len(by))))
        return least


RESOLVED_COLUMNS = ["block", "bucket", "keys", "row", "begin", "end", "low"]


def resolve_windows(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """For each block, its windows (as keys) in a sub-bucket with a smaller least doc_id than the block's greatest."""
    plain, out = unpacked(frame), []
    parts = [np.frombuffer(t, WINDOW) for t in plain["texts"]]
    low, high = (np.concatenate([np.frombuffer(x, np.int64) for x in plain[c]]) for c in ("low", "high"))
    _, number, least = least_of(np.concatenate(parts), low)
    begin = 0
    for block, windows in zip(frame["block"], parts):
        end = begin + len(windows)
        found = least[number[begin:end]]
        good = found < high[begin:end]
        if good.any():
            out.append((block, key[0], squeeze(windows[good].tobytes()), b"", b"", b"", squeeze(found[good].tobytes())))
        begin = end
    return pd.DataFrame(out, columns=RESOLVED_COLUMNS)


def resolve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """For each block's fragments, the ranges of window places whose string has a smaller least doc_id than the block's greatest."""
    if not frame["left"].iat[0]:  # a fragment has a left context, a window has none
        return resolve_windows(key, frame)
    arrays = Arrays(unpacked(frame))
    least = arrays.least()
    row, begin = np.nonzero(np.concatenate([np.ones((len(least), 1), bool), least[:, 1:] != least[:, :-1]], axis=1))
    end = np.where(np.append(row[1:], -1) == row, np.append(begin[1:], 0), PLACES) - 1
    low = least[row, begin]
    good = low < arrays.high[row]
    row, begin, end, low = row[good], begin[good], end[good], low[good]
    order = np.argsort(arrays.owner[row], kind="stable")
    out = []
    for p in np.split(order, starts_of(arrays.owner[row[order]])[1:]):
        if len(p):
            k = arrays.owner[row[p[0]]]
            out.append((frame["block"].iat[k], key[0], frame["keys"].iat[k], *(squeeze(x.tobytes()) for x in (arrays.within[row[p]].astype(np.int32), begin[p].astype(np.uint8), end[p].astype(np.uint8), low[p]))))
    return pd.DataFrame(out, columns=RESOLVED_COLUMNS)


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def covered(docs: pd.DataFrame, found: pd.DataFrame, buckets: int) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """The documents of a block, and which bytes of each go."""
    windows = np.concatenate([np.zeros(0, WINDOW), *(np.frombuffer(zstandard.decompress(k), WINDOW) for k in found["keys"][found["bucket"] >= buckets])])
    least = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(zstandard.decompress(x), np.int64) for x in found["low"][found["bucket"] >= buckets])])
    found = found[found["bucket"] < buckets]
    # a window's own anchor is that of its gram wherever it stands
    hot = np.unique(block_anchors(windows.tolist(), buckets)[0]) if len(windows) else np.zeros(0, np.uint64)
    mine = Fragments(docs, found, hot, buckets)
    covers = [np.zeros(len(t) + 1, np.int32) for t in mine.data]
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    for x in found.itertuples(index=False):
        row, begin, end, low = (zstandard.decompress(c) for c in (x.row, x.begin, x.end, x.low))
        numbers = mine.parts[x.bucket][np.frombuffer(row, np.int32)].tolist()
        for n, a, b, low in zip(numbers, begin, end, np.frombuffer(low, np.int64).tolist()):
            ranges.setdefault(n, []).append((a, b, low))
    smaller = dict(zip(windows.tolist(), least.tolist()))
    for n, start, window in zip(*(x.tolist() for x in mine.windows())):
        if window in smaller:
            place = mine.names[n][0] - start
            ranges.setdefault(n, []).append((place, place, smaller[window]))
    for n, r, p in zip(mine.number.tolist(), mine.row.tolist(), mine.at.tolist()):
        for a, b, low in ranges.get(n, ()):
            if low < mine.ids[r]:  # windows that start b to a bytes before the anchor
                covers[r][p - b] += 1
                covers[r][p - a + LENGTH] -= 1
    return mine.docs, [np.cumsum(c[:-1]) > 0 for c in covers]


def digest(buckets: int):
    def of_block(key: tuple, docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        docs, gone = covered(docs, found, buckets)
        for text, flags in zip(docs["data"], gone):
            kept = np.frombuffer(text, np.uint8)[~flags].tobytes()
            rows.append((len(text), len(text) - len(kept), len(spans_of(flags)[0]), hashlib.sha256(kept).hexdigest()))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
        out.insert(0, "id", docs["id"].to_numpy())
        return out

    return of_block


def span_rows(buckets: int):
    def of_block(key: tuple, docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        docs, gone = covered(docs, found, buckets)
        rows = [(i, m, int(s), int(e)) for i, m, flags in zip(docs["id"], docs["mark"], gone) for s, e in zip(*spans_of(flags))]
        return pd.DataFrame(rows, columns=["id", "mark", "start", "end"])

    return of_block


def _blocks(docs: DataFrame, text: str, doc_id: str):
    """Documents by block, their distinct fragments by bucket, and the number of buckets."""
    whole = F.coalesce(F.col(text), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(whole))).first()[0] or 0
    blocks, buckets = -(-size // BLOCK_BYTES) or 1, -(-size * 2 // (PLACES + 1) // ANCHORS_PER_BUCKET) or 1
    number = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))

    def dealt():
        # always the same plan, so that Spark shuffles the documents once and reads that exchange three times
        block = F.pmod(F.xxhash64(number, F.when(number == NO_ID, F.xxhash64(whole))), F.lit(blocks))
        return docs.select(block.alias("block"), number.alias("id"), F.xxhash64(whole).alias("mark"), F.encode(whole, "UTF-8").alias("data")).groupBy("block")

    asked = dealt().applyInPandas(ask(buckets), "bucket long, block long, keys binary, several binary, counts binary")
    answers = asked.groupBy("bucket").applyInPandas(answer(HOT), "block long, bucket long, keys binary, hot binary")
    sent = dealt().cogroup(answers.groupBy("block")).applyInPandas(send(buckets), "bucket long, block long, keys binary, left binary, size binary, low binary, high binary, texts binary")
    return dealt(), sent.groupBy("bucket"), buckets


RESOLVED = "block long, bucket long, keys binary, row binary, begin binary, end binary, low binary"


def repeated_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    blocks, sent, buckets = _blocks(docs, text, doc_id)
    out = blocks.cogroup(sent.applyInPandas(resolve, RESOLVED).groupBy("block")).applyInPandas(digest(buckets), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, mark, start, end) of each removed run of bytes; mark is xxhash64 of the text."""
    blocks, sent, buckets = _blocks(docs, text, doc_id)
    out = blocks.cogroup(sent.applyInPandas(resolve, RESOLVED).groupBy("block")).applyInPandas(span_rows(buckets), "id long, mark long, start long, end long")
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "mark", "start", "end")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(documents(spark, sf_dir))
