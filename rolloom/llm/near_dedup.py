"""Operator 6: near-duplicate documents, by an exact containment join of their shingle sets.

A document is the set of its word shingles. Two documents are linked if at least `containment` of the smaller set
is in the larger, whatever their sizes.

Who is linked with a larger set shares `containment` of its shingles with it, so most documents drop out once it is
known which shingles stand in several: each shingle goes to its bucket once, packed, and comes back with the number
of sets that have it if it is more than one. Of its shared shingles a set then asks for the rarest, so many that any
set it is linked with has one of them, of large sets several. Who meets so is compared by the shingles that it shares with any other, as what
two sets have in common is among these. Nothing is estimated or left out. What links say of a class is summed where
sets are compared, so that links are never written one by one.

Links of sets of similar size are near copies and make components; a document in a larger one is a part of it.
Parts don't join components, as a common phrase would make all documents with it one.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.llm.common import BATCH_BYTES, collected, components, dropped, flat, grams, hash_spans, keyed, slices, small, stored, unpacked, word_bounds

WORDS, CONTAINMENT = 3, 0.7
#: Sets of which the smaller has at least this share of the larger's size are near copies if they are linked, others parts.
RATIO = 0.5
#: Shingles are grouped in so many buckets at least, of about KEYS of them. Pairs that a bucket's task makes at a time.
BUCKETS, KEYS, PAIRS = 32, 4 << 20, 1 << 20
#: Bytes of the smaller sets that one task holds at once while larger ones pass by.
SET_BYTES = 32 << 20
#: Shingles that a part of a larger document has at least to be dropped for it.
PART = 8
#: About how many larger sets are compared in one place.
BLOCK = 256
#: Of an index by bands and samples, which the links aren't taken from: size partitions to an octave; hash values of a
#: signature, of a band, and the probability of a miss; sizes up to which sets are looked up whole, samples and hits of others.
STEPS, HASHES, ROWS, MISS, LOW, SAMPLE, FOUND = 4, 128, 2, 0.002, 64, 32, 13
_NO_ID = -1 << 63

_BREAK = np.ones(256, bool)
_BREAK[128:] = False
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of 52 bits, offsets of the texts in them). A text of fewer words has one shingle."""
    body, off = flat(texts)
    starts, ends = word_bounds(body, off, _BREAK)
    h, goff = grams(hash_spans(_LOWER[body], starts, ends), np.searchsorted(starts, off), words)
    out, sizes = [], []
    for i in range(0, len(texts), 4096):  # 12 bits for the text
        some = goff[i : min(i + 4096, len(texts)) + 1]
        doc = np.repeat(np.arange(len(some) - 1, dtype=np.uint64), np.diff(some))
        code = np.sort(doc << np.uint64(52) | h[some[0] : some[-1]] >> np.uint64(12))
        code = code[np.append(True, code[1:] != code[:-1])] if len(code) else code
        out.append(code & np.uint64((1 << 52) - 1))
        sizes.append(np.bincount((code >> np.uint64(52)).astype(np.int64), minlength=len(some) - 1))
    return np.concatenate(out or [np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int64)]))])


def partition(size: np.ndarray) -> np.ndarray:
    """Numbers of the size partitions: the p-th begins at bound(p)."""
    return np.floor(np.log2(np.maximum(size, 1)) * STEPS + 1e-9).astype(np.int64)


def bound(p: int) -> int:
    return math.ceil(2 ** (p / STEPS) - 1e-6)


def jaccard(most: float, containment: float) -> float:
    """The least similarity of linked sets of which the larger has up to `most` times the smaller one's size."""
    return containment / (1 + most - containment)


def tuned(apart: int, containment: float = CONTAINMENT, ratio: float = RATIO, hashes: int = HASHES, miss: float = MISS) -> int:
    """Bands for pairs of partitions that are `apart` steps apart: as few as the miss rate allows."""
    s = jaccard(min(1 / ratio, 2 ** ((apart + 1) / STEPS)), containment)
    return min(hashes // ROWS, math.ceil(math.log(miss) / math.log(1 - s**ROWS)))


def least_bands(s: float, bands: int, rows: int, miss: float) -> int:
    """In how many bands two sets of similarity s meet at least, but for a probability of at most `miss`; 1 or more."""
    p, below = s**rows, 0.0
    for c in range(bands + 1):
        below += math.comb(bands, c) * p**c * (1 - p) ** (bands - c)
        if below > miss:
            return max(1, c)
    return bands


def looked_up(size: int | Column, containment: float = CONTAINMENT):
    """How many of a set's least hash values, at least, must be looked up for one of them to be in each linked set."""
    if isinstance(size, Column):
        return F.when(size <= LOW, size - F.ceil(size * containment - 1e-9) + 1).otherwise(SAMPLE - FOUND + 1)
    return size - math.ceil(size * containment - 1e-9) + 1 if size <= LOW else SAMPLE - FOUND + 1


def _class(h: np.ndarray, text: str) -> int:
    """The number of a set, or, if it is empty, of its text."""
    raw = b"s" + h.tobytes() if len(h) else b"t" + text.encode()
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _sign(words: int):
    """(doc_id, th, cls, size): the class of each text and its number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = b.column(2)
            h, off = shingles(texts, words)
            size = np.diff(off)
            cls = [_class(h[off[i] : off[i + 1]], "" if size[i] else texts[i].as_py()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cls, pa.int64()), pa.array(size.astype(np.int32))], names=["doc_id", "th", "cls", "size"])

    return run


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each shingle: ranges of equal width."""
    return ((key >> np.uint64(20)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _split(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper parts of numbers of 40 bits; of small numbers the upper ones take little room when compressed."""
    return key & np.uint64(0xFFFF), key >> np.uint64(16) & np.uint64(0xFFFF), key >> np.uint64(32) & np.uint64(0xFF)


def _join(low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low | middle.astype(np.uint64) << np.uint64(16) | high.astype(np.uint64) << np.uint64(32)


def _pack(cls: np.ndarray, size: np.ndarray, doc: np.ndarray, key: np.ndarray) -> bytes:
    """The shingles of some classes, 40 bits of each; doc: the place in cls, ascending. Two shingles of a bucket that differ
    in other bits only count as one, like any whose hashes collide."""
    runs = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    own, many = doc[runs], np.diff(np.append(runs, len(doc)))
    width = 1 if many.max(initial=0) < 256 else 4
    body = [np.array([len(own), len(key), width], "<i8"), cls[own].astype("<i8"), size[own].astype("<i4"), many.astype(f"<u{width}")]
    body += [x.astype(kind) for x, kind in zip(_split(key), ("<u2", "<u2", "u1"))]
    return b"".join(x.tobytes() for x in body)


def _arrays(x: bytes, at: int, *what: tuple[str, int]) -> list[np.ndarray]:
    """Arrays of the kinds and lengths given, which stand one after the other."""
    out = []
    for kind, many in what:
        out.append(np.frombuffer(x, kind, many, at))
        at += many * out[-1].itemsize
    return out


def _unpack(bodies: list[bytes], counted: bool = False) -> tuple[np.ndarray, ...]:
    """(cls, size, doc, key, df) of several; a class may stand there several times. df: from the counts that follow if `counted`."""
    parts, base = [], 0
    for x in bodies:
        n, m, width = np.frombuffer(x, "<i8", 3).tolist()
        cls, size, many, *key, df = _arrays(x, 24, ("<i8", n), ("<i4", n), (f"<u{width}", n), ("<u2", m), ("<u2", m), ("u1", m), ("<u2", m * counted))
        doc = np.repeat(np.arange(base, base + n, dtype=np.int32), many)
        parts.append((cls, size, doc, _join(*key), df))
        base += n
    return tuple(np.concatenate(x) for x in zip(*parts))


def _by(which: np.ndarray, many: int) -> Iterator[tuple[int, slice]]:
    """(number, where it stands) in an ascending array of numbers below `many`."""
    ends = np.searchsorted(which, np.arange(many + 1))
    for k in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
        yield k, slice(int(ends[k]), int(ends[k + 1]))


def _spread(words: int, buckets: int):
    """(part, body): the shingles of the texts, by bucket. A task does not repeat what it has said of a set, so that
    copies don't add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches, "text", BATCH_BYTES):
            h, off = shingles(b.column(0), words)
            size = np.diff(off)
            cls = np.array([_class(h[off[i] : off[i + 1]], "") if size[i] else 0 for i in range(len(size))], np.int64)
            if len(seen) > 1 << 20:
                seen.clear()
            new = np.zeros(len(size), bool)
            for i in np.flatnonzero(size).tolist():
                if int(cls[i]) not in seen:
                    seen.add(int(cls[i]))
                    new[i] = True
            doc = np.repeat(np.arange(len(size)), size)
            some = new[doc]
            doc, key = doc[some], h[some]
            where = bucket_of(key, buckets)
            by = np.argsort(where, kind="stable")
            doc, key, where = doc[by], key[by], where[by]
            out = [(k, _pack(cls, size, doc[i], key[i])) for k, i in _by(where, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["part", "body"])

    return run


def _grouped(solve):
    """Calls solve(part, [(kind, body)]) for the rows of each part, which come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for b in batches:
            for p, kind, body in zip(*(c.to_pylist() for c in b.columns)):
                if p != part:
                    if rows:
                        yield from solve(part, rows)
                    part, rows = p, []
                rows.append((kind, body))
        if rows:
            yield from solve(part, rows)

    return run


def _rows(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about BATCH_BYTES."""
    at, n = 0, 0
    for k, (_, _, body) in enumerate(rows):
        n += len(body)
        if n >= BATCH_BYTES or k == len(rows) - 1:
            part, kind, body = zip(*rows[at : k + 1])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())], names=["part", "kind", "body"])
            at, n = k + 1, 0


#: Kinds of rows of a bucket: who holds a shingle; what a class asks.
_HELD, _ASKED = 0, 1
#: A class's place among the buckets.
_home = lambda cls, buckets: (cls.astype(np.uint64) % np.uint64(buckets)).astype(np.int64)


def _shared(buckets: int):
    """(bucket, home, body, df): of a bucket the shingles that several classes have, numbered, and how many have them, by the
    classes' places. Bodies are read twice: by those who ask for them and, with df, by the classes."""

    def solve(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        cls, size, doc, key, _ = _unpack([x for _, x in rows])
        rows.clear()
        _, first = np.unique(cls, return_index=True)
        once = np.zeros(len(cls), bool)
        once[first] = True
        own = once[doc]
        doc, key = doc[own], key[own]
        by = np.argsort(key)
        s = key[by]
        start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        many = np.diff(np.append(start, len(s)))
        df = np.zeros(len(key), np.int64)
        df[by] = np.repeat(many, many)
        key[by] = np.repeat(np.cumsum(many > 1) - 1, many).astype(np.uint64)
        del by, s
        several = df > 1
        doc, key, df = doc[several], key[several], df[several]
        home = _home(cls, buckets)
        order = np.lexsort((doc, home[doc]))
        doc, key, df = doc[order], key[order], df[order]
        out, n = [], 0
        for k, i in _by(home[doc], buckets):
            out.append((k, _pack(cls, size, doc[i], key[i]), np.minimum(df[i], 65535).astype("<u2").tobytes()))
            n += len(out[-1][1])
            if n >= BATCH_BYTES:
                yield batch(bucket, out)
                out, n = [], 0
        if out:
            yield batch(bucket, out)

    def batch(bucket: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        home, body, df = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([bucket] * len(rows), pa.int32()), pa.array(home, pa.int32()), pa.array(body, pa.binary()), pa.array(df, pa.binary())], names=["bucket", "home", "body", "df"])

    return _grouped(solve)


def _pack_set(where: np.ndarray, key: np.ndarray) -> bytes:
    """Buckets and numbers of shingles, as one body."""
    return where.astype("<u4").tobytes() + b"".join(x.astype("<u2").tobytes() for x in _split(key)[:2])


def _set_of(x: bytes) -> np.ndarray:
    """The shingles of _pack_set, as one number each, in the same order."""
    n = len(x) // 8
    where, low, high = _arrays(x, 0, ("<u4", n), ("<u2", n), ("<u2", n))
    return where.astype(np.uint64) << np.uint64(32) | high.astype(np.uint64) << np.uint64(16) | low


def needed(size: np.ndarray, containment: float) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles a set of this size shares with each larger one that it is linked with; how many of those that it asks."""
    need = np.ceil(size * containment - 1e-9).astype(np.int64)
    return need, 1 + need // 16


def _ask(buckets: int, containment: float):
    """What each class asks: a set that is linked with a larger one shares `need` shingles with it, so that of all those
    that it shares with any, `least` at least of the rarest (all but need - least) are in the larger one.

    Besides, rows (cls, body) of all its shared shingles: what two classes have in common is among these."""

    def sets(cls: np.ndarray, doc: np.ndarray, key: np.ndarray, where: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, bodies, n = [], [], 0
        for k, i in _by(doc, len(cls)):
            ids.append(int(cls[k]))
            bodies.append(_pack_set(where[i], key[i]))
            n += len(bodies[-1])
            if n >= BATCH_BYTES:
                yield _set_rows(ids, bodies)
                ids, bodies, n = [], [], 0
        if ids:
            yield _set_rows(ids, bodies)

    def solve(_: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        cls, size, doc, key, df = _unpack([x for _, x in rows], True)
        where = np.repeat([k for k, _ in rows], [int.from_bytes(x[8:16], "little") for _, x in rows])
        rows.clear()
        cls, first, inverse = np.unique(cls, return_index=True, return_inverse=True)
        size, doc = size[first], inverse[doc]
        order = np.lexsort((key, where, doc))
        doc, key, df, where = doc[order], key[order], df[order], where[order]
        yield from sets(cls, doc, key, where)
        need, least = needed(size, containment)
        take = np.bincount(doc, minlength=len(cls)) - need
        take = np.where(take >= 0, take + least, 0)
        some = take[doc] > 0
        doc, key, df, where = doc[some], key[some], df[some], where[some]
        # among about equally rare ones those of few buckets, so that a pair is found in few; which, differs by class
        turned = (where.astype(np.uint64) + cls.astype(np.uint64)[doc] % np.uint64(buckets)) % np.uint64(buckets)
        order = np.lexsort((key, turned, np.floor(np.log2(df)), doc))
        doc, key, where = doc[order], key[order], where[order]
        some = np.arange(len(doc)) - np.searchsorted(doc, doc) < take[doc]
        doc, key, where = doc[some], key[some], where[some]
        order = np.lexsort((doc, where))
        doc, key, where = doc[order], key[order], where[order]
        for b in _rows([(k, _ASKED, _pack(cls, size, doc[i], key[i])) for k, i in _by(where, buckets)]):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.int64())], names=["part", "kind", "body", "cls"])

    return _grouped(solve)


def _set_rows(ids: list[int], bodies: list[bytes]) -> pa.RecordBatch:
    none = pa.nulls(len(ids), pa.int32())
    return pa.RecordBatch.from_arrays([none, none, pa.array(bodies, pa.binary()), pa.array(ids, pa.int64())], names=["part", "kind", "body", "cls"])


def _pack_pairs(u: np.ndarray, cls: np.ndarray, v: np.ndarray, p: np.ndarray, hits: np.ndarray) -> bytes:
    own, at = np.unique(v, return_inverse=True)
    width = 2 if len(own) < 65536 else 4
    body = (np.array([len(own), len(v), width], "<i8"), cls[own].astype("<i8"), at.astype(f"<u{width}"), u.astype("<i8"), p.astype("<i4"), hits.astype("<i4"))
    return b"".join(x.tobytes() for x in body)


def _unpack_pairs(x: bytes) -> tuple[np.ndarray, ...]:
    n, m, width = np.frombuffer(x, "<i8", 3).tolist()
    cls, at, u, p, hits = _arrays(x, 24, ("<i8", n), (f"<u{width}", m), ("<i8", m), ("<i4", m), ("<i4", m))
    return u, cls[at], p, hits


def _meet(least: float, ratio: float, buckets: int):
    """Pairs of classes u that ask for shingles of v, of sizes p <= q, p >= least * q, packed by v's place: u, v, p, which is
    negative if v is of similar size, and how many shingles were asked for and found."""

    def solve(_: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        asked = [x for k, x in rows if k == _ASKED]
        if not asked:
            return
        cls, size, doc, key, _ = _unpack([x for k, x in rows if k == _HELD])
        rows.clear()
        by = np.argsort(key)
        key, doc = key[by], doc[by]
        who, its, ask, want, _ = _unpack(asked)
        at, end = np.searchsorted(key, want), np.searchsorted(key, want, "right")
        done = np.cumsum(end - at)
        home = _home(cls, buckets)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            code, hits = (np.concatenate(x) for x in zip(*found))
            found.clear()
            u, v = code >> 32, code & 0xFFFFFFFF
            by = np.argsort(home[v], kind="stable")
            u, v, hits = u[by], v[by], hits[by].astype("<i4")
            p = np.where(its[u] >= ratio * size[v], -its[u], its[u]).astype("<i4")
            yield from _rows([(k, 0, _pack_pairs(who[u[i]], cls, v[i], p[i], hits[i])) for k, i in _by(home[v], buckets)])

        i = 0
        while i < len(want):
            # whole classes, of about PAIRS pairs
            j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + PAIRS, "right")))
            j = int(np.searchsorted(ask, ask[j - 1], "right"))
            many = end[i:j] - at[i:j]
            u = np.repeat(ask[i:j], many)
            v = doc[np.repeat(at[i:j] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
            p, q = its[u], size[v]
            ok = ((q > p) | (q == p) & (cls[v] > who[u])) & (p >= least * q)
            found.append(np.unique(u[ok].astype(np.int64) << 32 | v[ok], return_counts=True))
            if sum(len(x) for x, _ in found) >= PAIRS:
                yield from packed()
            i = j
        if found:
            yield from packed()

    return _grouped(solve)


def _gather(containment: float):
    """(v, label, us, ps): each class with those that it may have in it, as it has enough of what they asked for, and their
    sizes. label: what's compared with the same sets has the same."""

    def solve(_: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack_pairs(x) for _, x in rows]
        rows.clear()
        u, v, p, hits = (np.concatenate(x) for x in zip(*parts))
        del parts
        if not len(u):
            return
        order = np.lexsort((u, v))
        u, v, p, hits = u[order], v[order], p[order], hits[order]
        once = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (u[1:] != u[:-1])))
        once = once[np.add.reduceat(hits, once, dtype=np.int64) >= needed(np.abs(p[once]), containment)[1]]
        u, v, p = u[once], v[once], p[once]
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
        if not len(first):
            return
        near = np.minimum.reduceat(np.where(p < 0, u, np.iinfo(np.int64).max), first)
        some = np.logical_or.reduceat(p < 0, first)
        label = np.where(some, np.minimum(near, v[first]), u[first])
        ends = np.append(first, len(v))
        i = 0
        while i < len(first):
            # lists of about BATCH_BYTES
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + BATCH_BYTES // 12, "right")) - 1)
            off, of = pa.array((ends[i : j + 1] - ends[i]).astype(np.int32)), slice(ends[i], ends[j])
            yield pa.RecordBatch.from_arrays([pa.array(v[first[i:j]]), pa.array(label[i:j]), pa.ListArray.from_arrays(off, pa.array(u[of])), pa.ListArray.from_arrays(off, pa.array(np.abs(p[of])))], names=["v", "label", "us", "ps"])
            i = j

    return _grouped(solve)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, block, cls, us): where sets meet. Of each part first the classes u, without us, in blocks of about SET_BYTES, then
    each v with those of its us that are in the block. Input (part, v, us, ps), the rows of a part one after the other."""

    def placed(part: int, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        us, first = np.unique(np.concatenate([u for _, u, _ in rows]), return_index=True)
        size = np.concatenate([p for _, _, p in rows])[first].astype(np.int64)
        block = (np.cumsum(size) - size) * 8 // SET_BYTES
        yield batch(part, block, us, None)
        blocks, ids, lists, n = [], [], [], 0
        for v, u, _ in rows:
            of = block[np.searchsorted(us, u)]
            for k, i in _by(of, int(of[-1]) + 1):  # us of a row ascend, and with them their blocks
                blocks.append(k)
                ids.append(v)
                lists.append(u[i])
                n += len(u[i])
            if n >= BATCH_BYTES // 8:
                yield batch(part, np.array(blocks), np.array(ids, np.int64), lists)
                blocks, ids, lists, n = [], [], [], 0
        if ids:
            yield batch(part, np.array(blocks), np.array(ids, np.int64), lists)

    def batch(part: int, block: np.ndarray, cls: np.ndarray, lists: list[np.ndarray] | None) -> pa.RecordBatch:
        us = pa.nulls(len(cls), pa.list_(pa.int64())) if lists is None else pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32)), pa.array(np.concatenate(lists)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cls), part, np.int32)), pa.array(block.astype(np.int32)), pa.array(cls), us], names=["part", "block", "cls", "us"])

    now, rows = None, []
    for b in batches:
        part, v, us, ps = (b.column(k) for k in range(4))
        for k, (p, c) in enumerate(zip(part.to_pylist(), v.to_pylist())):
            if p != now:
                if rows:
                    yield from placed(now, rows)
                now, rows = p, []
            rows.append((c, us[k].values.to_numpy(), ps[k].values.to_numpy()))
    if rows:
        yield from placed(now, rows)


def contained(a: np.ndarray, b: np.ndarray, containment: float) -> bool:
    """Are these sorted sets linked?"""
    q = min(len(a), len(b))
    return q > 0 and len(np.intersect1d(a, b, assume_unique=True)) >= containment * q - 1e-9


_FACTS = "cls long, links long, psize int, pless long, rep long"


class _Block:
    """The classes u of a block, and what is known of them and of the classes v compared with them so far."""

    def __init__(self, rows: list[tuple[int, int, int, np.ndarray]], containment: float, ratio: float):
        rows.sort(key=lambda r: r[0])
        self.cls, self.n, self.size = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        many = np.array([len(r[3]) for r in rows])
        self.ends = np.append(0, np.cumsum(many))
        self.keys, at = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
        self.at, self.has = at.astype(np.int32), np.zeros(len(self.keys), np.uint8)
        self.ratio, self.least = ratio, containment * self.size - 1e-9
        self.links = np.zeros(len(rows), np.int64)
        self.psize, self.pless = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        self.group = np.arange(len(rows))
        self.near = np.zeros(len(rows), bool)
        self.vs: list[tuple[int, int, int]] = []

    def shared(self, have: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """How many of the shingles `have`, sorted, each of the classes u asked for has."""
        at = np.minimum(np.searchsorted(self.keys, have), len(self.keys) - 1)
        at = at[self.keys[at] == have]
        self.has[at] = 1
        out = []
        for i in range(0, len(asked), 1024):
            first, end = self.ends[asked[i : i + 1024]], self.ends[asked[i : i + 1024] + 1]
            hit = self.has[np.concatenate([self.at[a:b] for a, b in zip(first.tolist(), end.tolist())])]
            out.append(np.add.reduceat(hit, np.cumsum(end - first) - (end - first), dtype=np.int64))
        self.has[at] = 0
        return np.concatenate(out)

    def compare(self, cls: int, n: int, size: int, less: int, have: np.ndarray, us: np.ndarray) -> None:
        asked = np.searchsorted(self.cls, us)
        found = asked[self.shared(have, asked) >= self.least[asked]]
        if not len(found):
            return
        self.links[found] += n
        near = self.size[found] >= self.ratio * size
        within, found_near = found[~near], found[near]
        better = within[(size > self.psize[within]) | (size == self.psize[within]) & (less > self.pless[within])]
        self.psize[better], self.pless[better] = size, less
        if len(found_near):
            self.near[found_near] = True
            groups = np.unique(self.group[found_near])
            if len(groups) > 1:
                self.group[np.isin(self.group, groups)] = groups[0]
        self.vs.append((cls, int(self.n[found].sum()), int(found_near[0]) if len(found_near) else -1))

    def facts(self) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(self.links)
        part = self.psize[some] == 0
        cols = [self.cls[some], self.links[some], (self.psize[some].astype(np.int32), part), (self.pless[some], part), (self.cls[self.group[some]], ~self.near[some])]
        yield self._batch(cols)
        if self.vs:
            cls, links, first = (np.array(x, np.int64) for x in zip(*self.vs))
            none = np.ones(len(cls), bool)
            yield self._batch([cls, links, (np.zeros(len(cls), np.int32), none), (links, none), (self.cls[self.group[first]], first < 0)])

    @staticmethod
    def _batch(cols: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(*c[:1], mask=c[1]) if isinstance(c, tuple) else pa.array(c) for c in cols], names=["cls", "links", "psize", "pless", "rep"])


def _inside(containment: float, ratio: float):
    """What the links of a block say, a row for each class that has any: (cls, documents linked with it, size and rank of the
    largest class that it is a part of, a class of its near copies). Input by (part, block): (cls, us, n, size, less, set),
    first the classes u, without us, then v, us being candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, rows, block = None, [], None
        for b in batches:
            us = b.column(3)
            known = us.is_valid().to_pylist()
            for k, (part, number, cls, n, size, less, body) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 4, 5, 6, 7)))):
                if (part, number) != where:
                    if block:
                        yield from block.facts()
                    where, rows, block = (part, number), [], None
                if not known[k]:
                    rows.append((cls, n, size, _set_of(body)))
                    continue
                if not block:
                    block = _Block(rows, containment, ratio)
                block.compare(cls, n, size, less, _set_of(body), us[k].values.to_numpy())
        if block:
            yield from block.facts()

    return run


def settled(spark: SparkSession) -> None:
    """collected(), and time for shuffle files to go, which they do in the background, before the next ones are written."""
    for _ in range(2):
        collected(spark)
        time.sleep(0.5)


class _Index:
    """The classes of a table, one for each set of shingles, and what links them."""

    def __init__(self, docs: DataFrame, containment: float, ratio: float, words: int):
        self.containment, self.ratio, self.words = containment, ratio, words
        self.slim = keyed(docs).select("doc_id", "th", "text")
        self.rows = stored(self.slim.mapInArrow(_sign(words), "doc_id long, th long, cls long, size int"))
        first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "th"))
        classes = self.rows.groupBy("cls").agg(first.alias("f"), F.count("*").alias("n"), F.first("size").alias("size"))
        self.classes = stored(classes.select("cls", F.nullif("f.id", F.lit((1 << 63) - 1)).alias("id"), "f.th", "n", "size"))

    def candidates(self, least: float) -> tuple[DataFrame, DataFrame]:
        """(v, label, us, ps): for each class those that may be linked with it, as large or smaller, at least `least` times its
        size, and their sizes; (cls, body): the shingles that a class shares with others."""
        spark = self.slim.sparkSession
        buckets = max(BUCKETS, (self.classes.agg(F.sum("size")).first()[0] or 0) // KEYS)
        kind = "part int, kind int, body binary"
        tasks = min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
        by = lambda df: df.repartitionById(tasks, F.pmod("part", F.lit(tasks))).sortWithinPartitions("part", "kind")
        spread = self.slim.select("text").mapInArrow(_spread(self.words, buckets), "part int, body binary").select("part", F.lit(_HELD).alias("kind"), "body")
        shared = stored(by(spread).mapInArrow(_shared(buckets), "bucket int, home int, body binary, df binary"))
        del spread
        settled(spark)
        counted = shared.select(F.col("home").alias("part"), F.col("bucket").alias("kind"), F.concat("body", "df").alias("body"))
        asked = stored(by(counted).mapInArrow(_ask(buckets, self.containment), f"{kind}, cls long"))
        del counted
        settled(spark)
        held = shared.select(F.col("bucket").alias("part"), F.lit(_HELD).alias("kind"), "body")
        pairs = by(held.union(asked.filter("cls is null").drop("cls"))).mapInArrow(_meet(least, self.ratio, buckets), kind)
        pairs = stored(by(pairs).mapInArrow(_gather(self.containment), "v long, label long, us array<long>, ps array<int>"))
        dropped(shared)
        collected(spark)
        return pairs, asked.filter("cls is not null").select("cls", "body")

    def links(self, least: float, block: int) -> DataFrame:
        """_FACTS of classes u and classes v that are as large or larger, up to 1 / least times, several rows for each class;
        pless: the larger, the smaller the id."""
        pairs, sets = self.candidates(least)
        # what is compared with the same sets should meet in one place, at most about `block` sets: those go there once
        many = pairs.groupBy("label").agg(F.ceil(F.count("*") / block).alias("many"))
        tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        part = F.pmod(F.xxhash64("label", F.pmod(F.xxhash64("v"), "many")), F.lit(tasks)).cast("int").alias("part")
        pairs = pairs.join(many, "label").select(part, "v", "us", "ps")
        who = pairs.repartitionById(tasks, "part").sortWithinPartitions("part").mapInArrow(_placed, "part int, block int, cls long, us array<long>")
        who = stored(who)
        there = stored(who.select("cls").distinct())
        if small(there) is not there:
            sets = sets.join(F.broadcast(there), "cls", "left_semi")
        known = self.classes.select("cls", "n", "size", (-F.coalesce("id", F.lit(1 << 62))).alias("less"))
        both = who.join(sets.join(known, "cls"), "cls").select("part", "block", "cls", "us", "n", "size", "less", "body")
        both = both.repartitionById(tasks, "part").sortWithinPartitions("part", "block", F.col("us").isNotNull())
        return stored(both.mapInArrow(_inside(self.containment, self.ratio), _FACTS))


def link(docs: DataFrame, containment: float = CONTAINMENT, ratio: float = RATIO, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, th, component_id, n_links, part_of, kept), a row for each row of docs; th: a hash of its text.

    Documents with equal sets of shingles are one class. component_id: the smallest doc_id that can be reached by
    links of similar size (`ratio`). n_links: all documents that are linked with this one, of any size. part_of: the
    smallest doc_id of the largest class, more than 1 / ratio times as large, that has this one in it, or null. kept:
    of each component the document with most shingles, of these with the smallest id; documents of PART shingles or
    more that are parts don't count, so that a component of parts has none: its text stands in the larger ones.

    Null text: as empty. Texts without words: linked to equal texts only. Null doc_id: in classes and links like
    others, but no component's number if it has an id. One id with different texts: each has its own class. Repeated
    rows: equal results. Empty table: no rows. Other columns are ignored.

    All links are found: candidates are all pairs that can be linked, and each is compared by all shared shingles, those
    with up to about `block` larger sets in one place.
    """
    return _link(docs, containment, ratio, words, block, True)


def _link(docs: DataFrame, containment: float = CONTAINMENT, ratio: float = RATIO, words: int = WORDS, block: int = BLOCK, parts: bool = False) -> DataFrame:
    """link(); without parts there are none and n_links only counts links of similar size: what is kept of copies doesn't depend on it."""
    index = _Index(docs, containment, ratio, words)
    links = index.links(0.0 if parts else ratio, block)
    comp = components(links.filter("rep is not null").select(F.col("cls").alias("u"), F.col("rep").alias("v"))).withColumnRenamed("node", "cls")
    known = index.classes.select("cls", "id", "th", "n", "size")
    largest = F.max(F.when(F.col("psize").isNotNull(), F.struct("psize", "pless"))).alias("b")
    counts = links.groupBy("cls").agg(F.sum("links").alias("links"), largest)
    counts = counts.select("cls", "links", F.nullif(-F.col("b.pless"), F.lit(1 << 62)).alias("part_of"), F.col("b").isNotNull().alias("part"))
    known = known.join(comp, "cls", "left").join(counts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    order = F.struct("size", (-F.coalesce("id", F.lit(1 << 62))).alias("less"), "cls")
    stays = F.coalesce("part", F.lit(False)) & (F.col("size") >= PART)
    best = known.groupBy("component").agg(F.min("id").alias("component_id"), F.max(F.when(~stays, order)).alias("b")).select("component", "component_id", F.col("b.cls").alias("best"))
    known = known.join(best, "component").select("cls", "id", F.col("th").alias("first"), "component_id", "best", "part_of", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = index.rows.join(known, "cls")
    kept = F.coalesce(F.col("cls") == F.col("best"), F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("first"))
    return out.select("doc_id", "th", "component_id", "n_links", "part_of", kept.alias("kept"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without all but the kept document of each component, with the columns of docs; cases as in link().

    Parts of larger documents stay (unless parts=True): only near copies are dropped. Equal rows of a kept document are one.
    """
    named = F.coalesce("doc_id", F.lit(_NO_ID)).alias("id")
    kept = _link(docs, **how).filter("kept").select(named, "th").distinct()
    # join and grouping have the same keys, so that texts are shuffled once
    both = keyed(docs).select("row", named, "th").join(kept, ["id", "th"], "left_semi")
    return unpacked(both.groupBy("id", "th").agg(F.first("row").alias("row")), docs)
