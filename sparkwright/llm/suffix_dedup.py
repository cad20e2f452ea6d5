"""Operator 1: exact substring dedup with suffix arrays.

A byte goes if it lies in a string of ``min_len`` bytes (50) that also starts
in a document with a smaller id.  Strings are judged on the input texts.

Which strings can repeat is found first.  Every ``min_len``-byte string picks
an anchor: the ``GRAM``-byte gram inside it with the smallest hash.  Equal
strings pick equal grams at equal places, so only strings whose anchor occurs in
two documents can repeat.  Neighbouring strings with one anchor form a segment
(some 65 bytes for 17 strings).

Segments with a shared anchor are dealt by anchor, so that equal strings meet,
and cut into shards.  A shard's suffixes are sorted by Larsson-Sadakane
refinement (ranks of h bytes give ranks of 2h bytes, in groups not yet split),
its common prefixes follow from Kasai's inequality, and neighbours that share
``min_len`` bytes form a class with its smallest document.  Each shard's strings
are then searched in the other shards of the group by bisection over their
64-bit codes, and a hit counts when the bytes agree.

Scale: texts are dealt once, by hash, into parts of about ``PART_BYTES``; all
three passes over them read that one exchange.  A part names each anchor and
each distinct segment once, whatever the number of its copies, so a string that
a third of all documents hold costs one entry per part.  Only anchors travel for
unique text (8 bytes for some 17 bytes of text).  With each anchor a part tells
about how many different segments it has there (a power of two, in the byte that
also says whether several documents hold it).  An anchor with more than
``HOT_SEGMENTS`` of them over all parts, a frequent line between ever new
neighbours, say, is too large for one group: its strings are dealt one by one,
by their own hash, instead of by anchor, whatever the size of the input.  That
count decides where strings meet, never whether they do.  A string's hash
is 64 bits beside its 64-bit anchor; classes are made of compared bytes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import prepared

MIN_LEN = 50
GRAM = 16
PART_BYTES = 4 << 20
GROUP_ANCHORS = 1 << 17       # anchors per group of the exchange, about
HOT_SEGMENTS = 1 << 13       # segments of one anchor that one group takes, some 0.5 MB
SHARD = 1 << 18               # bytes per suffix array
CHUNK = 1 << 19               # starts per step of the anchor search
_NO_ID = np.iinfo(np.int64).max  # a null id counts as the largest
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

_ANCHORS = "grp long, part long, anchors binary, several binary"
_SHARED = "part long, anchors binary, hot binary"
_SEGMENTS = "grp long, part long, anchors binary, lens binary, firsts binary, several binary, bytes binary"
_REPLIES = "part long, anchors binary, codes binary, masks binary, firsts binary"
_RESULT = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, "
           "ends array<long>, kept binary")


# -- suffix arrays ---------------------------------------------------------
def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes of at most 2**21 bytes in order."""
    n = len(text)
    if n > 1 << 21:
        raise ValueError("a shard holds at most 2**21 bytes")
    place = np.arange(n, dtype=np.int64)
    wide = np.concatenate([text.astype(np.int64) + 1, np.zeros(5, dtype=np.int64)])  # the end sorts first
    key = np.zeros(n, dtype=np.int64)
    for k in range(5):
        key = key * 257 + wide[k:k + n]
    order = np.sort(key << 21 | place)  # the first five bytes, then the place
    sa = order & (1 << 21) - 1
    rank = np.empty(n, dtype=np.int64)

    def starts_of(keys: np.ndarray) -> np.ndarray:
        return np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=bool)

    first = np.flatnonzero(starts_of(order >> 21))
    sizes = np.diff(np.append(first, n))
    rank[sa] = np.repeat(first, sizes)
    h = 5
    slots = np.flatnonzero(np.repeat(sizes, sizes) > 1)  # slots of groups that are not split yet
    while len(slots):
        own = sa[slots]
        after = np.where(own + h < n, rank[np.minimum(own + h, n - 1)] + 1, 0)
        # rank (21 bits), next rank (22) and place (21) in one number
        order = np.sort(((rank[own] << 22 | after).astype(np.uint64) << np.uint64(21)) | own.astype(np.uint64))
        own = (order & np.uint64((1 << 21) - 1)).astype(np.int64)
        sa[slots] = own
        new = starts_of(order >> np.uint64(21))
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(own)))
        rank[own] = np.repeat(slots[first], sizes)
        slots = slots[np.repeat(sizes, sizes) > 1]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Bytes (up to ``most``) that each suffix shares with the one before it in ``sa``.

    Kasai's inequality, a suffix shares at least one byte less than the suffix
    one place before it in the text, is used for whole strides at once: every
    16th place is compared from the start, then places halfway between begin
    at what their left neighbour leaves.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([text.astype(np.int16), np.full(most + 1, -1, dtype=np.int16)])
    step = 16
    todo = [np.arange(0, n, step)]
    while step > 1:
        todo.append(np.arange(step // 2, n, step))
        step //= 2
    for k, places in enumerate(todo):
        if k:
            back = 16 >> k
            shared[places] = np.maximum(shared[places - back] - back, 0)
        live = places[before[places] >= 0]
        shared[places[before[places] < 0]] = 0
        while len(live):
            at = shared[live]
            left, right = padded[live + at], padded[np.minimum(before[live] + at, n + most)]
            live, at = (x[(left == right) & (left >= 0)] for x in (live, at))
            shared[live] = at + 1
            live = live[at + 1 < most]
    return shared[sa]


class Shard:
    """Sorted strings of ``length`` bytes in some segments, with the smallest document of each."""

    def __init__(self, segments: list[bytes], docs: list[int], length: int):
        text = np.frombuffer(b"".join(segments), dtype=np.uint8)
        sizes = np.array([len(s) for s in segments])
        ends = np.cumsum(sizes)
        which = np.repeat(np.arange(len(segments)), sizes)
        sa = suffix_array(text)
        shared = common_prefixes(text, sa, length)
        whole = sa + length <= ends[which[sa]]   # a suffix that holds a string of its segment
        # a class goes on while all neighbours in between share the string
        breaks = np.cumsum(shared < length)[whole]
        self.places = sa[whole]
        new = np.concatenate([[True], breaks[1:] != breaks[:-1]]) if len(breaks) else np.zeros(0, dtype=bool)
        heads = np.flatnonzero(new)
        self.cls = np.cumsum(new) - 1
        owner = np.array(docs, dtype=np.int64)[which[self.places]]
        self.low = np.minimum.reduceat(owner, heads) if len(heads) else owner
        self.text, self.length = text, length
        self.heads = self.places[heads]          # one place per class
        code = np.zeros(len(heads), dtype=np.uint64)
        for k in range(0, length, 8):
            word = np.zeros(len(heads), dtype=np.uint64)
            for b in range(k, min(k + 8, length)):
                word = word << np.uint64(8) | text[self.heads + b].astype(np.uint64)
            code = (code ^ word) * _C[0]
            code ^= code >> np.uint64(29)
        self.by_code = np.argsort(code, kind="stable")
        self.codes = code[self.by_code]
        self.sizes = sizes

    def lows(self) -> np.ndarray:
        """Per byte place, the smallest document with the string that starts there."""
        out = np.full(int(self.sizes.sum()), _NO_ID, dtype=np.int64)
        out[self.places] = self.low[self.cls]
        return out


def merge_shards(shards: list[Shard], length: int) -> None:
    """Give each class of every shard the smallest document that all shards know for its string.

    Two sorted lists of codes become one at a time, the lists doubling: the codes of one are found in the other by
    bisection, a hit counts when the bytes agree, and only strings that the other list lacks join it.
    """
    text = np.concatenate([s.text for s in shards])
    before = np.cumsum([0, *[len(s.text) for s in shards]])
    heads = np.concatenate([s.heads + b for s, b in zip(shards, before)])
    low = np.concatenate([s.low for s in shards])
    first = np.cumsum([0, *[len(s.low) for s in shards]])
    same_as = np.arange(len(low))
    lists = [(s.codes, s.by_code + f) for s, f in zip(shards, first)]
    byte = np.arange(length)
    while len(lists) > 1:
        merged = [lists[-1]] if len(lists) % 2 else []
        for (codes, classes), (others, own) in zip(lists[0::2], lists[1::2]):
            at = np.searchsorted(codes, others)
            hit = np.flatnonzero(at < len(codes))
            hit = hit[codes[at[hit]] == others[hit]]
            mine, theirs = own[hit], classes[at[hit]]
            agree = (text[heads[mine][:, None] + byte] == text[heads[theirs][:, None] + byte]).all(axis=1)
            hit, mine, theirs = hit[agree], mine[agree], theirs[agree]
            low[theirs] = np.minimum(low[theirs], low[mine])
            same_as[mine] = theirs
            new = np.ones(len(others), dtype=bool)
            new[hit] = False
            put = at[new] + np.arange(np.count_nonzero(new))
            stays = np.ones(len(codes) + len(put), dtype=bool)
            stays[put] = False
            both, all_classes = np.empty(len(stays), dtype=np.uint64), np.empty(len(stays), dtype=np.int64)
            both[put], both[stays], all_classes[put], all_classes[stays] = others[new], codes, own[new], classes
            merged.append((both, all_classes))
        lists = merged
    while True:  # a string may have met another one in each of the rounds
        further = same_as[same_as]
        if (further == same_as).all():
            break
        same_as = further
    low = low[same_as]
    for s, a, b in zip(shards, first, first[1:]):
        s.low = low[a:b]


# -- anchors ----------------------------------------------------------------
def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each gram of 16 bytes."""
    b = raw.astype(np.uint64)
    two = b[:-1] << np.uint64(8) | b[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    n = len(raw) - GRAM + 1
    h = eight[:n] * _C[0]
    h ^= h >> np.uint64(31)
    h += eight[8:8 + n]
    h *= _C[1]
    h ^= h >> np.uint64(29)
    h *= _C[2]
    h ^= h >> np.uint64(32)
    return h


def _segment_hashes(h: np.ndarray, heads: np.ndarray, tails: np.ndarray, length: int) -> np.ndarray:
    """A hash of the bytes of each segment, from the hashes of grams that cover it."""
    last = tails - 1 + length - GRAM
    out = (tails - heads).astype(np.uint64)
    for at in range(0, 2 * (length - GRAM) + 1 + GRAM, GRAM):
        out = (out ^ h[np.minimum(heads + at, last)]) * _C[1]
        out ^= out >> np.uint64(29)
    return out


def _window_min(key: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, key
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


class Part:
    """Some documents' bytes behind one another, and their segments."""

    def __init__(self, ids: list[int | None], texts: list[bytes], length: int, contexts: bool = False):
        self.ids = np.array([_NO_ID if i is None else i for i in ids], dtype=np.int64)
        self.texts, self.length = texts, length
        self.raw = b"".join(texts)
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        buf = np.frombuffer(self.raw, dtype=np.uint8)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        total = len(buf) - length + 1
        found = []
        for c in range(0, max(total, 0), CHUNK):
            m = min(CHUNK, total - c)
            h = _gram_hashes(buf[c:c + m + length - 1])
            key = h & np.uint64(0xFFFFFFFFFFF00000) | np.arange(len(h), dtype=np.uint64)
            at = (_window_min(key, length - GRAM + 1) & np.uint64(0xFFFFF)).astype(np.int64)
            valid = doc[c:c + m] == doc[c + length - 1:c + length - 1 + m]
            change = np.empty(m, dtype=bool)
            change[0] = True
            change[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1]) | (doc[c + 1:c + m] != doc[c:c + m - 1])
            heads = np.flatnonzero(change)
            tails = np.append(heads[1:], m)
            good = valid[heads]
            heads, tails = heads[good], tails[good]
            context = _segment_hashes(h, heads, tails, length) if contexts else np.zeros(0, dtype=np.uint64)
            found.append((h[at[heads]], heads + c, tails + c, doc[heads + c], context))
        if found:
            self.anchor, self.head, self.tail, self.doc, self.context = (np.concatenate(x) for x in zip(*found))
        else:
            self.anchor, self.head, self.tail, self.doc, self.context = (
                np.zeros(0, t) for t in ("u8", "i8", "i8", "i4", "u8"))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors in order, and a byte for each: whether several ids of this part hold it (lowest bit)
        and the binary logarithm, rounded down, of its number of different segments."""
        order = np.argsort(self.anchor, kind="stable")
        a, ids = self.anchor[order], self.ids[self.doc[order]]
        if not len(a):
            return a, np.zeros(0, dtype=np.uint8)
        heads = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        sizes = np.diff(np.append(heads, len(a)))
        several = np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads)
        often = np.flatnonzero(np.repeat(sizes > 1, sizes))  # only repeated anchors can have several segments
        which, context = np.repeat(np.arange(len(heads)), sizes)[often], self.context[order[often]]
        by = np.lexsort((context, which))
        which, context = which[by], context[by]
        new = np.concatenate([[True], (which[1:] != which[:-1]) | (context[1:] != context[:-1])])[:len(which)]
        segments = np.maximum(np.bincount(which[new], minlength=len(heads)), 1)
        level = np.frexp(segments.astype(np.float64))[1] - 1
        return a[heads], (level << 1 | several).astype(np.uint8)

    def among(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments whose anchor is among these sorted ones, and which one it is."""
        if not len(anchors) or not len(self.anchor):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(anchors, self.anchor), len(anchors) - 1)
        own = np.flatnonzero(anchors[at] == self.anchor)
        return own, at[own]

    def strings(self, k: int, hot: bool) -> list[tuple[int, int]]:
        """Starts (from, to) of a segment, or of each of its strings."""
        a, b = int(self.head[k]), int(self.tail[k])
        return [(x, x + 1) for x in range(a, b)] if hot else [(a, b)]

    def results(self, starts: np.ndarray, keep: bool) -> pa.Table:
        """Result rows when strings at these places (each named once) go."""
        cover = np.zeros(len(self.raw) + 1, dtype=np.int32)
        cover[starts] += 1
        cover[starts + self.length] -= 1
        gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
        first = np.cumsum(self.sizes) - self.sizes
        rows = defaultdict(list)
        touched = set(np.unique(np.searchsorted(first + self.sizes, starts, side="right")).tolist())
        for k, text in enumerate(self.texts):
            a, left, spans = int(first[k]), text, np.zeros((0, 2), dtype=np.int64)
            if k in touched:
                mine = gone[a:a + len(text)]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                spans = edge.reshape(-1, 2)
                left = np.frombuffer(text, dtype=np.uint8)[~mine].tobytes()
            rows["doc_id"].append(None if self.ids[k] == _NO_ID else int(self.ids[k]))
            rows["n_bytes"].append(len(text))
            rows["n_removed"].append(len(text) - len(left))
            rows["n_spans"].append(len(spans))
            rows["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            rows["starts"].append(spans[:, 0].tolist())
            rows["ends"].append(spans[:, 1].tolist())
            rows["kept"].append(left if keep else None)
        long, longs = pa.int64(), pa.list_(pa.int64())
        kinds = [long, long, long, long, pa.string(), longs, longs, pa.binary()]
        return pa.table([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))


# -- Spark jobs -------------------------------------------------------------
def _part(table: pa.Table, length: int, contexts: bool = False) -> Part:
    return Part(table["doc_id"].to_pylist(), [x or b"" for x in table["raw"].to_pylist()], length, contexts)


def _numbers(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), dtype=kind)


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    names, kinds = zip(*(c.strip().split(" ") for c in schema.split(",")))
    types = [pa.int64() if k == "long" else pa.binary() for k in kinds]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))


def _group_of(codes: np.ndarray, groups: int) -> np.ndarray:
    """Group of a 64-bit code.  Anchors are the smallest hashes around, so they are mixed again first."""
    return (((codes * _C[1]) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _shared_anchors(table: pa.Table, hot_segments: int) -> pa.Table:
    """Of one group's anchors, those of several documents; told to each part that holds them."""
    parts = table["part"].to_pylist()
    lists = [np.frombuffer(b, "<u8") for b in table["anchors"].to_pylist()]
    flags = np.concatenate([np.frombuffer(b, np.uint8) for b in table["several"].to_pylist()])
    every, at = np.unique(np.concatenate(lists), return_inverse=True)
    holders = np.bincount(at, minlength=len(every))
    several = np.bincount(at, weights=flags & 1, minlength=len(every)) > 0
    segments = np.bincount(at, weights=np.ldexp(1.0, flags >> 1), minlength=len(every))
    good, hot, out, done = (holders > 1) | several, segments > hot_segments, [], 0
    for part, own in zip(parts, lists):
        mine = at[done:done + len(own)]
        done += len(own)
        told = own[good[mine]]
        if len(told):
            out.append((part, told.astype("<u8").tobytes(), hot[mine][good[mine]].tobytes()))
    return _rows(_SHARED, out)


def _told(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    anchors, hot = _numbers(table, "anchors", "<u8"), _numbers(table, "hot", "?")
    order = np.argsort(anchors)
    return anchors[order], hot[order]


def _segments(part_id: int, part: Part, anchors: np.ndarray, hot: np.ndarray, groups: int) -> pa.Table:
    """Each distinct segment with a shared anchor once, with the smallest id of this part that holds it."""
    first: dict[tuple[int, bytes], int] = {}
    several: set[tuple[int, bytes]] = set()
    singles: set[tuple[int, bytes]] = set()
    own, at = part.among(anchors)
    ids = part.ids[part.doc[own]].tolist()
    for k, name, is_hot, doc in zip(own.tolist(), anchors[at].tolist(), hot[at].tolist(), ids):
        for a, b in part.strings(k, is_hot):
            key = name, part.raw[a:b - 1 + part.length]
            seen = first.setdefault(key, doc)
            if is_hot:
                singles.add(key)
            if seen != doc:
                several.add(key)
                first[key] = min(seen, doc)
    dealt = defaultdict(list)
    codes = np.array([xxhash.xxh64_intdigest(k[1]) if k in singles else k[0] for k in first], dtype=np.uint64)
    for key, grp in zip(first, _group_of(codes, groups).tolist()):
        dealt[grp].append(key)
    pack = zstandard.ZstdCompressor(level=3).compress
    return _rows(_SEGMENTS, [(
        g, part_id, np.array([k[0] for k in keys], "<u8").tobytes(), bytes(len(k[1]) for k in keys),
        np.array([first[k] for k in keys], "<i8").tobytes(), bytes(k in several for k in keys),
        pack(b"".join([k[1] for k in keys]))) for g, keys in dealt.items()])


def _resolve(table: pa.Table, length: int, shard_bytes: int) -> pa.Table:
    """Which strings of a group's segments start in a document with a smaller id."""
    rows = []                     # per part: its segments as numbers of distinct ones
    number: dict[tuple[int, bytes], int] = {}
    low: list[int] = []
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in table.to_batches(max_chunksize=64):
        for r in batch.to_pylist():
            anchors, firsts = np.frombuffer(r["anchors"], "<u8"), np.frombuffer(r["firsts"], "<i8")
            ends = np.cumsum(np.frombuffer(r["lens"], "u1"), dtype=np.int64).tolist()
            raw, mine = unpack(r["bytes"]), []
            for name, a, b, doc in zip(anchors.tolist(), [0, *ends], ends, firsts.tolist()):
                k = number.setdefault((name, raw[a:b]), len(number))
                if k == len(low):
                    low.append(doc)
                elif doc < low[k]:
                    low[k] = doc
                mine.append(k)
            rows.append((r["part"], anchors, firsts, np.frombuffer(r["several"], "?"), np.array(mine, dtype=np.int64)))
    segments = [s for _, s in number]
    shards, begin, held = [], 0, 0
    for k in range(len(segments) + 1):
        if k == len(segments) or (held and held + len(segments[k]) > shard_bytes):
            shards.append(Shard(segments[begin:k], low[begin:k], length))
            begin, held = k, 0
        if k < len(segments):
            held += len(segments[k])
    merge_shards(shards, length)
    lows = np.concatenate([s.lows() for s in shards])
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    places = np.cumsum(sizes) - sizes
    strings = sizes - length + 1
    out = []
    for part, anchors, firsts, several, mine in rows:
        masks = np.zeros(len(mine), dtype=np.uint64)
        for j in range(int(strings.max(initial=0))):
            has = strings[mine] > j
            less = lows[places[mine[has]] + j] < firsts[has]
            masks[np.flatnonzero(has)[less]] |= np.uint64(1 << j)
        tell = np.flatnonzero((masks != 0) | several)
        if len(tell):
            codes = np.array([xxhash.xxh64_intdigest(segments[k]) for k in mine[tell].tolist()], dtype=np.uint64)
            out.append((part, anchors[tell].astype("<u8").tobytes(), codes.astype("<u8").tobytes(),
                        masks[tell].astype("<u8").tobytes(), firsts[tell].astype("<i8").tobytes()))
    return _rows(_REPLIES, out)


def _apply(part: Part, reply: pa.Table, keep: bool) -> pa.Table:
    """Mark the strings that go, and build the result rows."""
    anchors, codes = _numbers(reply, "anchors", "<u8"), _numbers(reply, "codes", "<u8")
    masks, firsts = _numbers(reply, "masks", "<u8"), _numbers(reply, "firsts", "<i8")
    told = dict(zip(zip(anchors.tolist(), codes.tolist()), zip(masks.tolist(), firsts.tolist())))
    names = np.unique(anchors)
    own, at = part.among(names)
    places, gone = [], []         # begins of segments, and which of their strings go
    raw, last, digest = part.raw, part.length - 1, xxhash.xxh64_intdigest
    for name, doc, a, b in zip(names[at].tolist(), part.ids[part.doc[own]].tolist(), part.head[own].tolist(),
                               part.tail[own].tolist()):
        said = told.get((name, digest(raw[a:b + last])))
        found = [(a, b, said)]
        if said is None and b - a > 1:  # the anchor may be one whose strings were dealt one by one
            found = [(x, x + 1, told.get((name, digest(raw[x:x + 1 + last])))) for x in range(a, b)]
        for x, y, said in found:
            if said is not None and (doc > said[1] or doc == said[1] and said[0]):
                places.append(x)
                gone.append((1 << y - x) - 1 if doc > said[1] else said[0])
    begins, bits = np.array(places, dtype=np.int64), np.array(gone, dtype=np.uint64)
    starts = [begins[bits >> np.uint64(j) & np.uint64(1) == 1] + j for j in range(max(gone, default=0).bit_length())]
    return part.results(np.concatenate([np.zeros(0, dtype=np.int64), *starts]), keep)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN,
                   keep: bool = False, part_bytes: int = PART_BYTES, hot_segments: int = HOT_SEGMENTS,
                   shard_bytes: int = SHARD) -> DataFrame:
    """Repeated substrings of whole texts, one row per document row.

    Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 (hex, of the bytes that are left), starts and ends of the runs
    (bytes) and, with ``keep``, the bytes that are left.

    A null text is empty; texts under ``min_len`` bytes lose nothing.  A null id
    counts as larger than all others, so such rows lose what any named document
    holds but nothing to each other; rows with equal ids (repeated rows) lose
    nothing to each other.  An empty table gives no rows; other columns are ignored.
    """
    if not GRAM < min_len <= 64 + GRAM - 1:
        raise ValueError("min_len has to lie between 17 and 79")
    text = docs[text_col].cast("string")
    rows = prepared(docs).select(docs[id_col].cast("long").alias("doc_id"),
                                 F.coalesce(text, F.lit("")).cast("binary").alias("raw"))
    total = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    groups = max(1, -(-total // (GROUP_ANCHORS * (min_len - GRAM + 2) // 2)))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "raw"), F.lit(parts)).alias("part"), "doc_id", "raw")

    def name_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        anchors, several = _part(table, min_len, contexts=True).anchors()
        grp = _group_of(anchors, groups)
        order = np.argsort(grp, kind="stable")
        anchors, several, grp = anchors[order], several[order], grp[order]
        heads = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]])) if len(grp) else []
        ends = [*heads[1:], len(grp)]
        return _rows(_ANCHORS, [(int(grp[a]), key[0].as_py(), anchors[a:b].astype("<u8").tobytes(), several[a:b].tobytes())
                                for a, b in zip(heads, ends)])

    def find_shared(table: pa.Table) -> pa.Table:
        return _shared_anchors(table, hot_segments)

    def cut_segments(key: tuple[pa.Scalar, ...], texts: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows or not texts.num_rows:
            return _rows(_SEGMENTS, [])
        return _segments(key[0].as_py(), _part(texts, min_len), *_told(told), groups)

    def resolve(table: pa.Table) -> pa.Table:
        return _resolve(table, min_len, shard_bytes)

    def apply(texts: pa.Table, reply: pa.Table) -> pa.Table:
        return _apply(_part(texts, min_len), reply, keep)

    by_part = dealt.groupBy("part")
    shared = by_part.applyInArrow(name_anchors, _ANCHORS).groupBy("grp").applyInArrow(find_shared, _SHARED)
    segments = by_part.cogroup(shared.groupBy("part")).applyInArrow(cut_segments, _SEGMENTS)
    replies = segments.groupBy("grp").applyInArrow(resolve, _REPLIES)
    return by_part.cogroup(replies.groupBy("part")).applyInArrow(apply, _RESULT)
