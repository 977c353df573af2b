"""Operator 1: personal data, and the terms that give it away.

Patterns find the protected entities. How much a term says about an entity is estimated over the whole corpus
from the documents they stand in: pmi(term; entity) / ic(entity), where ic = ln(N / df(entity)) is what knowing the
entity is worth and pmi = ln(N df(term, entity) / (df(term) df(entity))) is what the term tells of it. At 1 the
term discloses the entity outright. Terms at or over `remove_at` are removed, over `generalise_at` generalised,
wherever in a document that names the entity they stand; other documents have nothing that they give away, and stay
as they are. Terms are words, and numbers too. A single text is no evidence: each of its rare
words would tell all about an entity that is named nowhere else. So a pair counts from `support` different texts on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm.common import flat, hash_spans, slices, small, stored, word_bounds

KINDS = ("email", "ip", "card", "phone", "general", "removed")
GENERALISE_AT, REMOVE_AT, SUPPORT = 0.75, 0.9, 2
#: 2 ** TABLE_BITS bits tell a scan which terms may be flagged, whatever their number.
TABLE_BITS = 23

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

_BREAK = np.ones(256, bool)
_BREAK[128:] = False
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def luhn(digits: str) -> bool:
    n = len(digits)
    return sum(_DOUBLED[int(c)] if (n - i) % 2 == 0 else int(c) for i, c in enumerate(digits)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches, by start, then kind. Linear in the text."""
    out = []
    last = 0
    for m in _DOMAIN.finditer(text):
        s = m.start()
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        if s < m.start():
            out.append((s, 0, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SPAN = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("x", pa.int32())]))
_SCHEMA = "doc_id long, th long, base array<struct<s:int,k:int,x:int>>, base_sha256 string, ents array<long>, term long, n long"
_NAMES = ["doc_id", "th", "base", "base_sha256", "ents", "term", "n"]
_NOTHING = hashlib.sha256(b"").hexdigest()


class _Counts:
    """Documents by term hash, merged now and then."""

    def __init__(self) -> None:
        self.terms, self.n, self.new, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, terms: np.ndarray) -> None:
        self.new.append(terms)
        self.size += len(terms)
        if self.size > 1 << 20:
            self.merge()

    def merge(self) -> None:
        if self.new:
            self.terms, at = np.unique(np.concatenate([self.terms, *self.new]), return_inverse=True)
            n = np.zeros(len(self.terms), np.int64)
            n[at[: len(self.n)]] = self.n
            self.n = n + np.bincount(at[len(self.n) :], minlength=len(n))
            self.new, self.size = [], 0


def _terms(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(bytes, offsets of the texts in them, starts and ends of the terms, their hashes, offsets of the texts in these)."""
    body, off = flat(texts)
    starts, ends = word_bounds(body, off, _BREAK)
    return body, off, starts, ends, hash_spans(_LOWER[body], starts, ends), np.searchsorted(starts, off)


def _distinct(terms: np.ndarray, toff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term), each once."""
    doc = np.repeat(np.arange(len(toff) - 1), np.diff(toff))
    order = np.lexsort((terms, doc))
    t, d = terms[order], doc[order]
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
    return d[first], t[first]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for b in slices(batches, "text"):
        texts = b.column(1)
        body, off, _, _, terms, toff = _terms(texts)
        counts.add(_distinct(terms, toff)[1])
        hit = _hits(body, off)
        ths, bases, shas, ents = [], [], [], []
        for i in range(b.num_rows):
            ths.append(xxhash.xxh64_intdigest(body[off[i] : off[i + 1]].tobytes()) - (1 << 63))
            text = texts[i].as_py() if hit[i] else None
            spans = base_spans(text) if text else []
            bases.append([{"s": s, "k": k, "x": e} for s, k, e in spans])
            shas.append(hashlib.sha256(joined(spans).encode()).hexdigest() if spans else _NOTHING)
            ents.append(sorted({_hash(text[s:e].lower()) for s, _, e in spans}))
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ths, pa.int64()), pa.array(bases, _SPAN), pa.array(shas), pa.array(ents, pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=_NAMES)
    counts.merge()
    for i in range(0, len(counts.terms), 1 << 16):
        t, n = counts.terms[i : i + (1 << 16)].view(np.int64), counts.n[i : i + (1 << 16)]
        none = [pa.nulls(len(t), k) for k in (pa.int64(), pa.int64(), _SPAN, pa.string(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*none, pa.array(t), pa.array(n)], names=_NAMES)


def _table(df: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of a column, by its last bits; of one size whatever the number of values."""
    bit = F.col(column).bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for r in df.select(F.shiftright(bit, 3).alias("w"), F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(F.lit(7)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect():  # at most a byte of the table each
        table[r["w"]] = r["b"]
    return table


def _in(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    bit = (values & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
    return table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1


def _hits(body: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts have a digit or an @, as all entities do?"""
    hit = np.concatenate([[0], np.cumsum((body == 64) | ((body >= 48) & (body <= 57)))])
    return hit[off[1:]] > hit[off[:-1]]


def _beside(shared):
    """(th, term, ents): of each text with entities in the table its distinct terms outside of entities, and those entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in slices(batches, "text", 1 << 18):
            texts = b.column(1)
            at, spans, ents = [], [], []
            for i in np.flatnonzero(_hits(*flat(texts))).tolist():
                text = texts[i].as_py()
                own = base_spans(text)
                names = np.array(sorted({_hash(text[s:e].lower()) for s, _, e in own}), np.int64)
                names = names[_in(table, names.view(np.uint64))] if len(names) else names
                if len(names):
                    at.append(i), spans.append([{"s": s, "x": x} for s, _, x in own]), ents.append(names.tolist())
            some = texts.take(pa.array(at, pa.int64()))
            body, off, starts, ends, terms, toff = _terms(some)
            free = np.ones(len(terms), bool)
            for i, own in enumerate(spans):
                _free(body[off[i] : off[i + 1]], starts[toff[i] : toff[i + 1]] - off[i], ends[toff[i] : toff[i + 1]] - off[i], own, free[toff[i] : toff[i + 1]])
            d, t = _distinct(terms[free], np.concatenate([[0], np.cumsum(free)])[toff])
            ths = np.array([_hash(x) for x in some.to_pylist()], np.int64)
            for i in range(0, len(d), 1 << 14):
                doc = d[i : i + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array(ths[doc]), pa.array(t[i : i + (1 << 14)].view(np.int64)), pa.array([ents[k] for k in doc.tolist()], pa.list_(pa.int64()))], names=["th", "term", "ents"])

    return run


def _free(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, spans: list[dict], out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks in `out` the terms inside entities; starts and ends of all terms in code points."""
    point = np.cumsum((body & 0xC0) != 0x80)  # code points up to and with each byte
    ts, te = (point[starts] - 1, point[ends - 1]) if len(starts) else (starts, ends)
    for x in spans:
        out[np.searchsorted(te, x["s"], "right") : np.searchsorted(ts, x["x"])] = False
    return ts, te


def _occurrences(shared):
    """(doc_id, th, term, s, x, ents) of the terms outside entities that may be flagged, in texts with entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flagged, entities = shared.value
        for whole in slices(batches, "text"):
            own = {}
            for i in np.flatnonzero(_hits(*flat(whole.column(1)))).tolist():
                text = whole.column(1)[i].as_py()
                spans = base_spans(text)
                names = np.array(sorted({_hash(text[s:e].lower()) for s, _, e in spans}), np.int64)
                if len(names) and _in(entities, names.view(np.uint64)).any():
                    own[i] = spans, names.tolist()
            b = whole.take(pa.array(list(own), pa.int64()))
            body, off, starts, ends, terms, toff = _terms(b.column(1))
            may = _in(flagged, terms)
            out = []
            for i, (spans, names) in enumerate(own.values()):
                lo, hi = toff[i], toff[i + 1]
                free = np.ones(hi - lo, bool)
                ts, te = _free(body[off[i] : off[i + 1]], starts[lo:hi] - off[i], ends[lo:hi] - off[i], [{"s": s, "x": x} for s, _, x in spans], free)
                at = np.flatnonzero(free & may[lo:hi])
                doc, th = b.column(0)[i].as_py(), _hash(b.column(1)[i].as_py())
                out += [(doc, th, int(t), int(s), int(x), names) for t, s, x in zip(terms[lo:hi][at].view(np.int64), ts[at], te[at])]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.int32()) for c in cols[3:5]), pa.array(cols[5], pa.list_(pa.int64()))], names=["doc_id", "th", "term", "s", "x", "ents"])

    return run


def disclosing(docs: DataFrame, found: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, support: int = SUPPORT) -> DataFrame:
    """(e, term, k): hashes of entities and of the terms that disclose them, and whether they are generalised (4) or removed (5);
    found: what _scan() found in docs."""
    rows = found.filter("term is null")
    total = float(max(rows.count(), 1))
    ents = rows.filter(F.size("ents") > 0).select("doc_id", "th", F.explode("ents").alias("e"))
    entities = ents.groupBy("e").agg(F.count("*").alias("df_e"), F.count_distinct("th").alias("texts")).filter(F.col("texts") >= support)
    entities = stored(entities.select("e", "df_e"))
    most = entities.agg(F.max("df_e")).first()[0]
    if most is None:
        return docs.sparkSession.createDataFrame([], "e long, term long, k int")
    # as df(term, entity) <= df(entity), only terms with df <= N ** (1 - g) * df(entity) ** g can reach the threshold g
    bound = total ** (1 - generalise_at) * most**generalise_at * (1 + 1e-9)
    df = found.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df_t")).filter((F.col("df_t") <= bound) & (F.col("df_t") >= support))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    beside = slim.mapInArrow(_beside(docs.sparkSession.sparkContext.broadcast(_table(entities, "e"))), "th long, term long, ents array<long>")
    pairs = beside.join(df, "term").select("th", "term", "df_t", F.explode("ents").alias("e"))
    pairs = pairs.groupBy("e", "term", "df_t").agg(F.count("*").alias("n"), F.count_distinct("th").alias("texts")).filter(F.col("texts") >= support).join(entities, "e")
    worth = F.log(F.lit(total) / F.col("df_e"))
    told = F.log(F.lit(total) * F.col("n") / (F.col("df_t") * F.col("df_e")))
    told = pairs.select("e", "term", F.when(worth > 0, told / worth).otherwise(0.0).alias("disclosure"))
    return told.filter(F.col("disclosure") >= generalise_at).select("e", "term", F.when(F.col("disclosure") >= remove_at, 5).otherwise(4).alias("k"))


def find(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, support: int = SUPPORT) -> DataFrame:
    """(doc_id, th, base, base_sha256, spans: array of (s, k, x)), a row for each row of docs; th: a hash of the text.

    base: matches of the patterns; spans: these and, outside them, the terms that disclose one of the document's own
    entities, by start, then kind. A pair of
    term and entity counts only if it stands in `support` different texts at least. Null text: as empty, no spans.
    Null doc_id: kept. Repeated rows: each has its row and counts as a document, with equal results. Empty table: no
    rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stored(slim.mapInArrow(_scan, _SCHEMA))
    rows = found.filter("term is null").select("doc_id", "th", "base", "base_sha256")
    flagged = stored(disclosing(docs, found, generalise_at, remove_at, support))
    if flagged.isEmpty():
        return rows.withColumn("spans", F.col("base"))
    tables = spark.sparkContext.broadcast((_table(flagged, "term"), _table(flagged, "e")))
    more = slim.mapInArrow(_occurrences(tables), "doc_id long, th long, term long, s int, x int, ents array<long>").join(small(flagged), "term").filter(F.array_contains("ents", F.col("e")))
    more = more.groupBy("doc_id", "th", "s", "x").agg(F.max("k").alias("k")).groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "k", "x")).alias("more")).select(F.col("doc_id").alias("d2"), F.col("th").alias("h2"), "more")
    out = rows.join(more, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("h2")), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<s:int,k:int,x:int>>"))))
    return out.select("doc_id", "th", "base", "base_sha256", spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what find() returns."""
    count = lambda k: F.size(F.filter("base", lambda s: s.k == k)).cast("long")
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.element_at(names, s.k + 1), s.s.cast("string"), s.x.cast("string"))), ",")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])), "base_sha256", text.alias("spans"))


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            at, parts = 0, []
            for x in spans if text else []:
                if x["x"] > at:
                    parts += [text[at : max(at, x["s"])], "" if x["k"] == 5 else "<TERM>" if x["k"] == 4 else f"<{KINDS[x['k']].upper()}>"]
                    at = x["x"]
            out.append(None if text is None else "".join(parts) + text[at:])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(2)], names=["doc_id", "text", "spans"])


def sanitise(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """(doc_id, text, spans): texts in which entities and generalised terms stand as their kind and removed terms are gone.

    Of overlapping spans the first stands for both. Null text stays null. Repeated rows are kept, as are null ids.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = find(docs, generalise_at, remove_at).groupBy("doc_id", "th").agg(F.first("spans").alias("spans"))
    found = found.select(F.col("doc_id").alias("d2"), F.col("th").alias("h2"), "spans")
    hashed = slim.mapInArrow(_hashed, "doc_id long, text string, th long")
    both = hashed.join(found, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("h2")))
    return both.select("doc_id", "text", "spans").mapInArrow(_rewrite, "doc_id long, text string, spans array<struct<s:int,k:int,x:int>>")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        th = [xxhash.xxh64_intdigest(t or "") - (1 << 63) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(th, pa.int64())], names=["doc_id", "text", "th"])
