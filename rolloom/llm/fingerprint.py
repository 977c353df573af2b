"""Operator 5: fingerprints of documents by consistent weighted sampling.

Terms are words, weighted by how often they stand in the text. For sample k, each term has r, c ~ Gamma(2, 1) and
b ~ U(0, 1), drawn from its hash. With t = floor(ln w / r + b) the term's value is ln c - r (t - b + 1), and the
sample is the term and t of the least value: two texts agree in it with a probability of their generalised
Jaccard similarity, sum of least weights over sum of greatest. A value tells term and t, so samples are compared
by their values' hashes of 16 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm.common import mix, slices, words_of

SAMPLES = 128
SEED = 5
_LAST = (1 << 63) - 1


@lru_cache(maxsize=2)
def _steps(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, samples + 1, dtype=np.uint64) + np.uint64(seed << 16)
    return mix(at) | np.uint64(1), mix(at + np.uint64(1 << 40)) | np.uint64(1)


def _log(bits: np.ndarray) -> np.ndarray:
    """Minus the logarithm of the uniform number that 32 bits make: an exponential one."""
    return -np.log((bits.astype(np.float32) + np.float32(0.5)) * np.float32(2**-32))


def _draw(h: np.ndarray, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, ln c, b) for each term and sample, from the term's hash and the sample's number alone. r and c are sums of two
    exponentials each, Gamma(2, 1); 128 bits make the four and the last 20 of them, scrambled, b."""
    one, two = _steps(samples, seed)
    x, y = mix(h[:, None] * one), mix((h[:, None] ^ np.uint64(0x5851F42D4C957F2D)) * two)
    x, y = x.view(np.uint32).reshape(*x.shape, 2), y.view(np.uint32).reshape(*y.shape, 2)
    b = ((x[..., 0] * np.uint32(2654435761) ^ y[..., 1] * np.uint32(2246822519)) * np.uint32(3266489917) >> np.uint32(8)).astype(np.float32) * np.float32(2**-24)
    return _log(x[..., 0]) + _log(x[..., 1]), np.log(_log(y[..., 0]) + _log(y[..., 1])), b


class _Draws:
    """The values of terms at weight 1, where t is 0; those of the terms seen last are kept, a bounded number of them."""

    MOST = 1 << 15

    def __init__(self, samples: int, seed: int):
        self.samples, self.seed = samples, seed
        self.terms, self.values = np.zeros(0, np.uint64), np.zeros((0, samples), np.float32)

    def __call__(self, terms: np.ndarray) -> np.ndarray:
        """terms: sorted."""
        out = np.empty((len(terms), self.samples), np.float32)
        at = np.searchsorted(self.terms, terms)
        have = np.zeros(len(terms), bool)
        if len(self.terms):
            have = self.terms[np.minimum(at, len(self.terms) - 1)] == terms
            out[have] = self.values[at[have]]
        new = np.flatnonzero(~have)
        for i in range(0, len(new), 256):
            r, c, b = _draw(terms[new[i : i + 256]], self.samples, self.seed)
            out[new[i : i + 256]] = c - r * (1 - b)
        if len(new):
            left = max(0, self.MOST - len(terms))
            old = np.setdiff1d(np.arange(len(self.terms)), at[have], assume_unique=True)[:left]
            most = min(len(terms), self.MOST)
            merged = np.concatenate([self.terms[old], terms[:most]])
            order = np.argsort(merged)
            self.terms, self.values = merged[order], np.concatenate([self.values[old], out[:most]])[order]
        return out


@lru_cache(maxsize=2)
def _draws(samples: int, seed: int) -> _Draws:
    return _Draws(samples, seed)


def fingerprints(texts: pa.Array, samples: int = SAMPLES, seed: int = SEED) -> np.ndarray:
    """A row of 16-bit samples for each text; a text without words has 65535 throughout, which no other has."""
    h, off = words_of(texts)
    n = len(texts)
    out = np.full((n, samples), 65535, np.uint16)
    if not len(h):
        return out
    # for the terms of each text: their number, side by side
    vocabulary, term = np.unique(h, return_inverse=True)
    doc = np.repeat(np.arange(n), np.diff(off))
    code = np.sort(doc * len(vocabulary) + term)
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    weight = np.diff(np.append(at, len(code)))
    doc, term = np.divmod(code[at], len(vocabulary))
    once = _draws(samples, seed)(vocabulary)
    many = weight > 1
    heavy, place = np.unique(term[many], return_inverse=True)
    r, c, b = _draw(vocabulary[heavy], samples, seed)
    slot = np.full(len(term), -1)
    slot[many] = place
    log = np.log(weight).astype(np.float32)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])).tolist()
    for lo, hi in zip(starts, [*starts[1:], len(doc)]):
        least = np.full(samples, np.inf, np.float32)
        for i in range(lo, hi, 4096):
            j = min(hi, i + 4096)
            value = once[term[i:j]]
            more = np.flatnonzero(many[i:j])
            if len(more):
                x = slot[i:j][more]
                t = np.floor(log[i:j][more][:, None] / r[x] + b[x])
                value[more] = c[x] - r[x] * (t + (1 - b[x]))
            np.minimum(least, value.min(axis=0), out=least)
        out[doc[lo]] = (mix(least.view(np.uint32).astype(np.uint64)) % np.uint64(65535)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _text(rows: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in rows.astype(">u2")]


def _walk(samples: int, seed: int, texts: bool):
    """Each document with the one after it in the stream; the first of the next range ends each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in slices(batches, "text", 1 << 19):
            ids, text, marks = (b.column(i).to_pylist() for i in (0, 1, 2))
            new = len(text)
            if held:
                ids, text, marks = [held[0], *ids], [held[1], *text], [held[2], *marks]
            own = [i for i in range(len(text) - 1) if not marks[i]]
            halves = [len(text[i]) // 2 for i in own]
            edited = [text[i][: len(text[i]) - half] + text[i + 1][:half] for i, half in zip(own, halves)]
            # the texts and the edited ones have most of their words in common
            both = fingerprints(pa.array([*text[len(text) - new :], *edited], pa.string()), samples, seed)
            prints, e, at = both[:new] if not held else np.concatenate([held[3], both[:new]]), both[new:], np.array(own, np.int64)
            held = ids[-1], text[-1], marks[-1], prints[-1:]
            if own:
                cols = {
                    "doc_id": pa.array([ids[i] for i in own], pa.int64()),
                    "n_chars": pa.array([len(text[i]) for i in own], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                    "fingerprint": pa.array(_text(prints[at])),
                    "edited_fingerprint": pa.array(_text(e)),
                    "near_edited": pa.array(likeness(prints[at], e)),
                    "near_next": pa.array(likeness(prints[at], prints[at + 1])),
                } | ({"edited": pa.array(edited, pa.string())} if texts else {})
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def fingerprint(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED, texts: bool = False) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row
    of docs; with texts also edited.

    The edited text has the first code points of the next document, by ascending doc_id, in place of its last
    floor(n_chars / 2). Null text: as empty. Null doc_id: after all others. Equal doc_ids: in the order of a hash
    of their texts. One document: its own next. Empty table: no rows. Other columns are ignored.

    Documents go to ranges of doc_id; each range also gets the first document of the next one, so that a range is
    read in order by one task without looking elsewhere.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(_LAST))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = slim.select(key.alias("k"))
    splits = ids.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    splits = sorted(set(splits))
    outer = splits[:: max(1, int(len(splits) ** 0.5))]
    inner = [[s for s in splits if a <= s and (i + 1 == len(outer) or s < outer[i + 1])] for i, a in enumerate(outer)]

    def bucket(k):  # how many splits are at most k
        if not splits:
            return F.lit(0)
        count = lambda xs: F.size(F.filter(xs, lambda s: s <= k))
        block = count(F.array(*map(F.lit, outer)))
        before = F.array(F.lit(0), *(F.lit(sum(map(len, inner[:i]))) for i in range(len(inner))))
        lists = F.array(F.array().cast("array<bigint>"), *(F.array(*map(F.lit, x)).cast("array<bigint>") for x in inner))
        return F.element_at(before, block + 1) + count(F.element_at(lists, block + 1))

    firsts = sorted((r[0], r[1]) for r in ids.groupBy(bucket(F.col("k")).alias("bucket")).agg(F.min("k")).collect())  # one row a range
    if not firsts:
        firsts = [(0, 0)]
    to = spark.createDataFrame([(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)], "k long, bucket int")
    own = slim.select("doc_id", "text", F.lit(False).alias("halo"), key.alias("k"), bucket(key).cast("int").alias("bucket"))
    halo = slim.withColumn("k", key).filter(F.col("k").isin([k for _, k in firsts])).join(F.broadcast(to), "k").select("doc_id", "text", F.lit(True).alias("halo"), "k", "bucket")
    order = ["bucket", "halo", "k", F.xxhash64("text"), "text"]
    ranges = own.unionByName(halo).repartitionById(parts, F.col("bucket")).sortWithinPartitions(*order)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double" + ", edited string" * texts
    return ranges.select("doc_id", "text", "halo").mapInArrow(_walk(samples, seed, texts), schema)
