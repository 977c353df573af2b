"""Operator 2: near-duplicate vectors, by random-hyperplane sign hashing, exact cosines and connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm.common import components, mix, small, stored

THRESHOLD = 0.93
#: A pair at the threshold is missed with at most this probability.
MISS = 1e-4
#: Vectors that a bucket is meant to have, and the most that are compared at once; larger buckets are compared block by block.
BUCKET, BLOCK = 1024, 2048
SEED = 2


def plan(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for n vectors of one label: two vectors at the threshold agree in a bit with 1 - angle / pi."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / BUCKET)) if n > BUCKET else 4)
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - p))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, dim, digest, vector): 8-byte floats; digest null for what links with nothing."""
    for b in batches:
        dims, digests, vectors = [], [], []
        for i, label, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64) if x.is_valid else np.zeros(0)  # a null component is NaN
            top = np.abs(v).max() if len(v) else 0.0
            if i is None or label is None or not top or not np.isfinite(top):
                dims.append(None), digests.append(None), vectors.append(None)
                continue
            raw = (v + 0.0).tobytes()
            dims.append(len(v)), digests.append(xxhash.xxh3_128_hexdigest(raw)), vectors.append(raw)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(digests, pa.string()), pa.array(vectors, pa.binary())], names=["vec_id", "label", "dim", "digest", "vector"])


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rounded(x: np.ndarray) -> list[bytes]:
    """Unit vectors as a byte a component, with the step and an upper bound of what rounding moves the vector by."""
    step = np.abs(x).max(axis=1, keepdims=True) / 127
    q = np.rint(x / step).astype(np.int8)
    off = np.nextafter(np.linalg.norm(x - q * step, axis=1) + 1e-12, 1)
    return [a.tobytes() + np.array([b, c]).tobytes() for a, b, c in zip(q, step[:, 0], off)]


def unrounded(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, bounds) of what rounded() made."""
    body = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    step, off = np.ascontiguousarray(body[:, -16:]).view(np.float64).T
    return body[:, :-16].view(np.int8) * step[:, None], off


def _sign(bits: int, tables: int, seed: int, slim: bool):
    """For each table (key, t, cls, n, codes, vector); codes: the buckets in the tables before; vector: rounded. The key is
    that of label, dim, table and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dim = b.column(3).to_numpy()
            for d in np.unique(dim).tolist():
                if d not in planes:
                    planes[d] = np.random.Generator(np.random.PCG64([seed, d])).standard_normal((d, bits * tables))
                part = b.filter(pa.array(dim == d))
                x = unit(part.column(4).to_pylist())
                code = ((x @ planes[d] > 0).reshape(len(x), tables, bits) << np.arange(bits)).sum(axis=2).astype("<u4")
                label = mix(part.column(2).cast(pa.int64()).to_numpy().view(np.uint64) * np.uint64(2) + np.uint64(1)) + np.uint64(d)
                near = None if slim else pa.array(rounded(x), pa.binary())
                for t in range(tables):
                    key = pa.array(mix(mix(label + np.uint64(t << 32)) ^ code[:, t].astype(np.uint64)).view(np.int64))
                    if slim:
                        yield pa.RecordBatch.from_arrays([key], names=["key"])
                    else:
                        codes = pa.array([c.tobytes() for c in code[:, :t]], pa.binary())
                        yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(x), t, np.int32)), part.column(0), part.column(1), codes, near], names=["key", "t", "cls", "n", "codes", "vector"])

    return run


def _compare(threshold: float):
    """(u, v, n, open): an edge of the bucket's components if v is not null, else n vectors more that u links with; or, if
    open, a pair whose rounded vectors don't tell.

    A pair counts in the first table in which it meets. Input: buckets one after the other, at most two blocks each.
    """

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        table = t.column(1)[0].as_py()
        ids, n, chunk = t.column(2).to_numpy(), t.column(3).to_numpy(), t.column(6).to_numpy()
        lo, hi = t.column(7)[0].as_py(), t.column(8)[0].as_py()
        x, off = unrounded(t.column(5).to_pylist())
        codes = np.frombuffer(b"".join(t.column(4).to_pylist()), "<u4").reshape(len(ids), table)
        a = np.flatnonzero(chunk == lo)
        b = np.flatnonzero(chunk == hi)
        links = np.zeros(len(ids), np.int64)
        parent = np.arange(len(ids))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for s in range(0, len(a), 512):
            rows = a[s : s + 512]
            cos = x[rows] @ x[b].T
            p, q = off[rows][:, None], off[b]
            slack = p + q + p * q
            i, j = np.nonzero(cos + slack >= threshold)
            sure = cos[i, j] - slack[i, j] >= threshold
            i, j = rows[i], b[j]
            ok = i < j if lo == hi else np.ones(len(i), bool)
            ok[ok] = ~(codes[i[ok]] == codes[j[ok]]).any(axis=1)
            doubt = ok & ~sure
            if doubt.any():
                k = int(doubt.sum())
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[doubt]]), pa.array(ids[j[doubt]]), pa.array(np.zeros(k, np.int64)), pa.array(np.ones(k, bool))], names=["u", "v", "n", "open"])
            i, j = i[ok & sure], j[ok & sure]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            for p, q in zip(i.tolist(), j.tolist()):
                p, q = root(p), root(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        some = np.flatnonzero(links)
        if len(some):
            tops = np.array([root(i) for i in some.tolist()])
            own = some != tops
            u = np.concatenate([ids[some], ids[some[own]]])
            v = pa.array(np.concatenate([np.zeros(len(some), np.int64), ids[tops[own]]]), mask=np.arange(len(u)) < len(some))
            yield pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(np.concatenate([links[some], np.zeros(own.sum(), np.int64)])), pa.array(np.zeros(len(u), bool))], names=["u", "v", "n", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def tag(t):
            return t.column(0).to_numpy(), t.column(7).to_numpy(), t.column(8).to_numpy()

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*rest, b])
            k, lo, hi = tag(t)
            cut = np.flatnonzero((k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            for i, j in zip([0, *cut[:-1].tolist()], cut.tolist()):
                if j - i > 1:
                    yield from solve(t.slice(i, j - i))
            rest = t.slice(int(cut[-1]) if len(cut) else 0).to_batches()
        if rest:
            t = pa.Table.from_batches(rest)
            if t.num_rows > 1:
                yield from solve(t)

    return run


def _exact(threshold: float):
    """(u, v) of the pairs (u, v, vector of u, vector of v) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            size = pc.binary_length(b.column(2)).to_numpy()
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                some = b.take(pa.array(at))
                keep[at] = (unit(some.column(2).to_pylist()) * unit(some.column(3).to_pylist())).sum(axis=1) >= threshold
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], names=["u", "v"])

    return run


def link(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of `vectors` (vec_id, embedding, label).

    Vectors of one label and length link if their cosine, in double precision, is at least the threshold; all
    links found are true, and one is missed with a probability of at most `miss`. Buckets hold vectors rounded to a
    byte a component, with a bound of the error; only pairs that these leave open are compared in full. Equal vectors
    are compared once and counted as often as they stand there. Null vec_id or label, null, empty or zero vectors and
    null or non-finite components: no links, a component of its own. One vec_id with different vectors: each has its
    own links. Repeated rows: linked with each other. Empty table: no rows. Other columns are ignored.
    """
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stored(slim.mapInArrow(_read, "vec_id long, label long, dim int, digest string, vector binary"))
    rows = rows.withColumn("cls", F.xxhash64("label", "dim", "digest"))
    classes = stored(rows.filter("digest is not null").groupBy("cls", "label", "dim").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector")))
    most = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(most, threshold, miss)
    source = classes.select("cls", "n", "label", "dim", "vector")
    keys = source.mapInArrow(_sign(bits, tables, seed, True), "key long")
    # buckets with one vector have no pairs; those beyond a block are cut into chunks, which meet two by two
    sizes = keys.groupBy("key").count().filter("count > 1")
    hot = small(stored(sizes.filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("chunks"))))
    signed = source.mapInArrow(_sign(bits, tables, seed, False), "key long, t int, cls long, n long, codes binary, vector binary").join(hot, "key", "left")
    chunks = F.coalesce("chunks", F.lit(1))
    signed = signed.withColumn("chunk", F.pmod(F.xxhash64("cls"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    signed = signed.select("key", "t", "cls", "n", "codes", "vector", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    group = ["key", "lo", "hi"]
    found = stored(signed.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare(threshold), "u long, v long, n long, open boolean"))
    one, two = (classes.select(F.col("cls").alias(k), F.col("vector").alias(f"vector_{k}")) for k in "uv")
    doubt = found.filter("open").join(two, "v").join(one, "u").select("u", "v", "vector_u", "vector_v")
    more = stored(doubt.mapInArrow(_exact(threshold), "u long, v long"))
    times = classes.select("cls", "n")
    pairs = more.union(more.select("v", "u")).join(times.withColumnRenamed("cls", "v"), "v").select("u", "n")
    links = found.filter("not open and v is null").select("u", "n").union(pairs).groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("links"))
    comp = components(found.filter("not open and v is not null").select("u", "v").union(more)).withColumnRenamed("node", "cls")
    known = classes.select("cls", "id", "n").join(links, "cls", "left").join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    known = known.join(known.groupBy("component").agg(F.min("id").alias("least")), "component").select("cls", "n", "links", "least")
    both = rows.select("vec_id", F.when(F.col("digest").isNotNull(), F.col("cls")).alias("cls")).join(known, "cls", "left")
    component = F.coalesce("least", "vec_id")
    return both.select("vec_id", F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
