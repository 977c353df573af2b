"""Operator 9: passages that recur across documents, by prefix-partitioned suffix trees.

Suffixes are cut at DEPTH words, as only windows of so many words matter, and only those that can recur are built:
the gram of GRAM words with the least hash in a window is its anchor, equal windows have equal anchors, and a first
pass finds the anchors that stand in different texts. A group holds the suffixes whose windows have one anchor, sent
as runs of words; an anchor with more than GROUP of them is prolonged to the whole prefix of DEPTH words, where equal
suffixes need no more than a hash. A group's suffixes are sorted, and the lengths of the common prefixes of
neighbours (`tree`) give the internal nodes of its suffix tree; those of depth DEPTH are the repeats. Repeats at
consecutive words make the maximal repeated passages of a document (`passages`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolloom.llm.common import flat, grams, mix, slices, small, stored, words_of

DEPTH, GRAM = 13, 5
#: Most suffixes in a group that one task sorts, about 200 bytes each, and bytes of runs that it takes up at once.
GROUP, TAKE = 100_000, 2 << 20
_FLUSH = 1 << 20


def _keys(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix key of each window, offsets of the texts in them)."""
    count = np.maximum(np.diff(off) - DEPTH + 1, 0)
    woff = np.concatenate([[0], np.cumsum(count)])
    g, goff = grams(h, off, GRAM)
    at = np.arange(woff[-1]) - np.repeat(woff[:-1], count) + np.repeat(goff[:-1], count)
    least = np.full(len(at), np.iinfo(np.uint64).max, np.uint64)
    for k in range(DEPTH - GRAM + 1):
        np.minimum(least, g[at + k], out=least)
    return least, woff


def _runs(keys: np.ndarray, woff: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys within a text."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    new[woff[:-1][woff[:-1] < len(keys)]] = True
    return np.flatnonzero(new)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n, proven): key, text and number of windows; or text, key and n if two texts of this task have the key, of
    which the first then goes out once."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        if not held:
            return
        key, text, n = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((text, key))
        key, text, n = key[order], text[order], n[order]
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])))
        key, text, n = key[new], text[new], np.add.reduceat(n, new)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        each = np.diff(np.append(starts, len(key)))
        many = np.repeat(each > 1, each)
        for a, b, c, proven in ((key[starts].view(np.int64), text[starts], n[starts], False), (text[many], key[many].view(np.int64), n[many], True)):
            for i in range(0, len(a), 1 << 15):
                x, y, z = (v[i : i + (1 << 15)] for v in (a, b, c))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(z.astype(np.int32)), pa.array(np.full(len(x), proven))], names=["a", "b", "n", "proven"])
        held, size = [], 0

    for b in slices(batches, "text"):
        h, off = words_of(b.column(1))
        keys, woff = _keys(h, off)
        at = _runs(keys, woff)
        if not len(at):
            continue
        texts = b.column(0).to_numpy(zero_copy_only=False)[np.searchsorted(woff, at, "right") - 1]
        held.append((keys[at], texts, np.diff(np.append(at, len(keys))).astype(np.int32)))
        size += len(at)
        if size > _FLUSH:
            yield from flush()
    yield from flush()


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, sha = [], []
        for t in b.column(2).cast(pa.binary()).to_pylist():
            words = t.split() if t else []
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "th", "n_words", "sha"])


_ROWS = ["key", "key2", "doc_id", "th", "at", "n", "path"]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, key2, doc_id, th, at, n, path): the words (64 bits each) of a run of n windows from word `at`; or, if their key
    is hot, the hashes of the windows' words in place of key and path, n being how often it stands there in a row."""
    for b in slices(batches, "text", 1 << 18):
        h, off = words_of(b.column(2))
        word = h.astype("<u8")
        keys, woff = _keys(h, off)
        at = _runs(keys, woff)
        ends = np.append(at[1:], len(keys))
        text = np.searchsorted(woff, at, "right") - 1
        for i in range(b.num_rows):
            lo, hi = np.searchsorted(text, (i, i + 1))
            wanted = np.array(b.column(3)[i].as_py(), np.int64).view(np.uint64)
            hot = np.array(b.column(4)[i].as_py() or [], np.int64).view(np.uint64)
            doc, th, base = b.column(0)[i].as_py(), b.column(1)[i].as_py(), off[i]
            mine = keys[at[lo:hi]]
            is_hot = np.isin(mine, hot)
            some = np.flatnonzero(np.isin(mine, wanted) & ~is_hot) + lo
            if len(some):
                start, n = at[some] - woff[i], ends[some] - at[some]
                path = [word[base + x : base + x + y + DEPTH - 1].tobytes() for x, y in zip(start.tolist(), n.tolist())]
                k = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(mine[some - lo].view(np.int64)), pa.nulls(k, pa.int64()), pa.array([doc] * k, pa.int64()), pa.array([th] * k, pa.int64()), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(path, pa.binary())], names=_ROWS)
            if is_hot.any():
                each = (ends - at)[lo:hi]
                w = np.flatnonzero(np.repeat(is_hot, each))
                one, two = np.zeros(len(w), np.uint64), np.zeros(len(w), np.uint64)
                for j in range(DEPTH):
                    x = h[base + w + j]
                    one, two = mix(one * np.uint64(3) + x), two * np.uint64(0x9E3779B97F4A7C15) + x
                new = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (w[1:] != w[:-1] + 1)))
                n = np.diff(np.append(new, len(w)))
                for j in range(0, len(new), 1 << 14):
                    x = new[j : j + (1 << 14)]
                    k = len(x)
                    yield pa.RecordBatch.from_arrays([pa.array(one[x].view(np.int64)), pa.array(two[x].view(np.int64)), pa.array([doc] * k, pa.int64()), pa.array([th] * k, pa.int64()), pa.array(w[x].astype(np.int32)), pa.array(n[j : j + k].astype(np.int32)), pa.nulls(k, pa.binary())], names=_ROWS)


def tree(suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes (n by DEPTH words) in the order of a suffix tree's leaves, and how many words each has in
    common with the one before it. Leaves i..j are below one internal node of depth d if all common[i + 1 .. j] >= d."""
    n, width = suffix.shape
    order = np.lexsort(suffix.T[::-1])
    leaves = suffix[order]
    common = np.zeros(n, np.int64)
    same = np.ones(max(n - 1, 0), bool)
    for k in range(width):
        same &= leaves[1:, k] == leaves[:-1, k]
        common[1:] += same
    return order, common


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, at, n): n windows from word `at` each stand in a document with a smaller id. Input sorted by key."""

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, th, at = (t.column(i).to_numpy() for i in (1, 2, 3))
        body, off = flat(t.column(4).combine_chunks())
        word, woff = body.view("<u8"), off // 8
        count = np.diff(woff) - DEPTH + 1
        total = int(count.sum())
        if not total:
            return
        rec = np.repeat(np.arange(len(count)), count)
        pos = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        order, common = tree(word[(woff[:-1][rec] + pos)[:, None] + np.arange(DEPTH)])
        starts = np.flatnonzero(common < DEPTH)
        node = np.cumsum(common < DEPTH) - 1
        d = doc[rec][order]
        gone = np.zeros(total, bool)
        gone[order] = d > np.minimum.reduceat(d, starts)[node]
        hit = np.flatnonzero(gone)
        if not len(hit):
            return
        new = np.append(True, (hit[1:] != hit[:-1] + 1) | (rec[hit[1:]] != rec[hit[:-1]]))
        first = hit[new]
        n = np.diff(np.append(np.flatnonzero(new), len(hit)))
        yield pa.RecordBatch.from_arrays([pa.array(doc[rec[first]]), pa.array(th[rec[first]]), pa.array((at[rec[first]] + pos[first]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "th", "at", "n"])

    rest: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        rest.append(b)
        size += int(pc.sum(pc.binary_length(b.column(4))).as_py())
        if size < TAKE:
            continue
        t = pa.Table.from_batches(rest)
        last = int(np.searchsorted(t.column(0).to_numpy(), t.column(0)[-1].as_py()))
        if last:
            yield from solve(t.slice(0, last))
            t = t.slice(last)
            rest, size = t.to_batches(), int(pc.sum(pc.binary_length(t.column(4))).as_py())
    if rest:
        yield from solve(pa.Table.from_batches(rest))


def _cut(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, kept = [], [], []
            for t, spans in zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()):
                words = t.split()
                edge = np.zeros(len(words) + 1, np.int32)
                for s in spans:
                    edge[s["at"]] += 1
                    edge[s["at"] + s["n"] + DEPTH - 1] -= 1
                stay = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                left = b" ".join([words[i] for i in stay.tolist()])
                n.append(len(words) - len(stay))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode())
            cols = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), *([pa.array(kept, pa.string())] if texts else [])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "gone", "left_sha", *(["left"] if texts else [])])

    return run


def _spans(docs: DataFrame, group: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(facts of each row, first row of each class of equal words, texts that may have repeats, repeats)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    facts = stored(slim.mapInArrow(_facts, "doc_id long, th long, n_words long, sha string"))
    firsts = facts.filter("n_words >= %d and doc_id is not null" % DEPTH).groupBy("sha").agg(F.min(F.struct("doc_id", "th")).alias("f")).select("sha", "f.*")

    by = Window.partitionBy("a", "proven")
    seen = slim.filter("doc_id is not null").select("th", "text").mapInArrow(_prefixes, "a long, b long, n int, proven boolean")
    seen = seen.select("a", "b", "n", "proven", F.min("b").over(by).alias("lo"), F.max("b").over(by).alias("hi")).filter("proven or lo < hi")
    keys = stored(seen.select(F.when(F.col("proven"), F.col("b")).otherwise(F.col("a")).alias("key"), F.when(F.col("proven"), F.col("a")).otherwise(F.col("b")).alias("th"), "n"))
    hot = stored(keys.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > group).select("key", F.lit(True).alias("hot")))
    keys = keys.join(small(hot), "key", "left")
    by_text = keys.groupBy("th").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot"))
    chosen = stored(slim.join(firsts.select("doc_id", "th").join(by_text, "th"), ["doc_id", "th"]).select("doc_id", "th", "text", "keys", "hot"))

    suffixes = chosen.mapInArrow(_suffixes, "key long, key2 long, doc_id long, th long, at int, n int, path binary")
    if any_hot := not hot.isEmpty():
        suffixes = stored(suffixes)
    found = suffixes.filter("key2 is null").select("key", "doc_id", "th", "at", "path").repartition("key").sortWithinPartitions("key").mapInArrow(_repeats, "doc_id long, th long, at int, n int")
    if any_hot:
        deep = suffixes.filter("key2 is not null").select("key", "key2", "doc_id", "th", "at", "n")
        least = deep.groupBy("key", "key2").agg(F.min("doc_id").alias("least"))
        found = found.union(deep.join(least, ["key", "key2"]).filter("doc_id > least").select("doc_id", "th", "at", "n"))
    return facts, firsts, chosen, found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "n")).alias("spans"))


def remove_repeats(docs: DataFrame, texts: bool = False, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row for each row of docs; with texts also kept, the words left.

    A word goes if a window of DEPTH words covers it whose words also start in a document with a smaller doc_id.
    Documents of equal words are one: beyond the smallest doc_id all goes if there are DEPTH words. Null text:
    no words. Null doc_id: neither smaller nor larger than any, so nothing goes on either side. Repeated rows
    have equal results. One id with different texts: each is judged by itself, and neither is smaller. Fewer than
    DEPTH words: nothing goes. Very long texts: a run of one window is one row. Other columns are ignored.
    """
    facts, firsts, chosen, spans = _spans(docs, group)
    gone = chosen.select("doc_id", "th", "text").join(spans, ["doc_id", "th"]).select("doc_id", "th", "text", "spans")
    gone = gone.mapInArrow(_cut(texts), "doc_id long, th long, gone long, left_sha string" + ", left string" * texts)
    gone = gone.groupBy("doc_id", "th").agg(*(F.first(c).alias(c) for c in ["gone", "left_sha", *(["left"] if texts else [])]))
    gone = gone.join(firsts, ["doc_id", "th"]).drop("th").withColumnRenamed("doc_id", "d")
    first = firsts.select("sha", F.col("doc_id").alias("first"))
    out = facts.join(first, "sha", "left").join(gone, ["sha"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    mine = F.coalesce(F.col("doc_id") == F.col("d"), F.lit(False))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(mine, F.col("gone")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, nothing).when(mine, F.col("left_sha")).otherwise(F.col("sha")).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).when(mine, F.col("left")).alias("kept")] if texts else []),
    )


def passages(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, th, start, end): the maximal repeated passages, in words: each of their windows of DEPTH words also starts in
    a document with a smaller doc_id, and neither neighbour does so. th: a hash of the text. Of documents of equal words
    only the first is looked at; cases as in remove_repeats()."""
    _, _, _, spans = _spans(docs, group)
    one = spans.select("doc_id", "th", F.explode("spans").alias("s")).select("doc_id", "th", F.col("s.at").alias("at"), (F.col("s.at") + F.col("s.n")).alias("to"))
    by = Window.partitionBy("doc_id", "th").orderBy("at")
    one = one.withColumn("before", F.max("to").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    one = one.withColumn("k", F.count_if(F.col("before").isNull() | (F.col("before") < F.col("at"))).over(by))
    return one.groupBy("doc_id", "th", "k").agg(F.min("at").alias("start"), (F.max("to") + DEPTH - 1).alias("end")).drop("k")
