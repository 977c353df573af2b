"""Operator 4: language ID by Bayesian fusion of evidence.

The posterior of a language is the product of four pieces: the likelihood of the text under byte-trigram models,
tempered as overlapping trigrams aren't independent; that of the declared markup language, which is right as often as
the texts of the corpus say; and the prior of the host, smoothed towards that of its address suffix, which is smoothed
towards the whole corpus. The priors are grouped counts of what the texts alone say, a document's own vote left out.

There are two models, each fitted on one half of the texts (by their hash) and applied to the other, so that no text
is judged by a model that its own declared language went into.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloom.llm.common import flat, keyed, slices, small, stored, unpacked

#: The models are fitted on at most so many labelled texts of each language, of at most so many characters each.
TRAIN_TEXTS, TRAIN_CHARS = 400, 20_000
#: Each trigram shares its bytes with so many, itself included.
OVERLAP = 3
SMOOTHING, MIN_POSTERIOR = 20.0, 0.5
#: Slots for trigrams: as many as keep a model within MODEL_CELLS numbers, whatever the number of languages.
SLOTS, MODEL_CELLS = 1 << 15, 1 << 23


@dataclass
class Model:
    languages: list[str]
    tables: list[np.ndarray]  # log likelihoods, slots by languages, for texts with an even and with an odd hash

    def scores(self, texts: pa.Array, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trigrams of each text, mean log likelihood of them by language)."""
        body, off = flat(texts)
        n = np.maximum(np.diff(off) - 2, 0)
        sums = np.zeros((len(n), len(self.languages)))
        for i in np.flatnonzero(n):
            table = self.tables[fold[i] & 1]
            for lo in range(off[i], off[i + 1] - 2, 1 << 20):  # a long text bit by bit
                sums[i] += table[trigrams(body[lo : min(lo + (1 << 20) + 2, off[i + 1])]) & (len(table) - 1)].sum(axis=0)
        return n, sums / np.maximum(n, 1)[:, None]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[: ord("A")] = 32  # digits, punctuation and white space are one
_LOWER[91:97] = _LOWER[123:128] = 32


def trigrams(body: np.ndarray) -> np.ndarray:
    x = _LOWER[body].astype(np.uint32)
    return ((x[:-2] * 40503 + x[1:-1] * 9973 + x[2:] * 271) * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)


def language_of(label: Column) -> Column:
    """The primary subtag in lower case: 'pt-BR', 'PT_pt' and ' pt' are one language; null if there is none."""
    return F.nullif(F.lower(F.substring_index(F.substring_index(F.trim(label.cast("string")), "-", 1), "_", 1)), F.lit(""))


def _counted(slots: int):
    """(lang, fold, counts) of a task's rows (lang, fold, text): a number for each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for lang, fold, text in zip(*(c.to_pylist() for c in b.columns)):
                body = np.frombuffer(text.encode(), np.uint8)
                if len(body) > 2:
                    own = np.bincount(trigrams(body) & (slots - 1), minlength=slots)
                    sums[lang, fold] = sums[lang, fold] + own if (lang, fold) in sums else own
        yield from _as_rows(sums)

    return run


def _as_rows(sums: dict[tuple[str, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (lang, fold), x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([fold], pa.int32()), pa.array([x.astype(np.int64).tobytes()], pa.binary())], names=["lang", "fold", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, total = None, None
    for b in batches:
        for lang, fold, raw in zip(*(c.to_pylist() for c in b.columns)):
            x = np.frombuffer(raw, np.int64)
            if (lang, fold) != now:
                if now:
                    yield from _as_rows({now: total})
                now, total = (lang, fold), np.zeros(len(x), np.int64)
            total = total + x
    if now:
        yield from _as_rows({now: total})


def train(docs: DataFrame, label: str | Column | None = "lang") -> Model | None:
    """Models of all labelled languages, from texts chosen by a hash; None if there are no labels.

    At most TRAIN_TEXTS texts of TRAIN_CHARS characters for each language and half; they are counted by the executors.
    What is collected, and the model, is bounded by MODEL_CELLS.
    """
    if label is None:
        return None
    text = F.col("text").cast("string")
    rows = docs.select(language_of(F.col(label) if isinstance(label, str) else label).alias("lang"), F.xxhash64(text).alias("h"), text.alias("text")).filter("lang is not null and text is not null").filter(F.char_length("text").between(3, TRAIN_CHARS))
    rows = rows.withColumn("fold", F.col("h").bitwiseAND(F.lit(1)).cast("int"))
    first = Window.partitionBy("lang", "fold").orderBy("h")
    chosen = stored(rows.select("lang", "fold", "h").distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= TRAIN_TEXTS).select("lang", "fold", "h"))
    languages = sorted(r[0] for r in chosen.select("lang").distinct().collect())
    if not languages:
        return None
    slots = min(SLOTS, 1 << max(0, (MODEL_CELLS // len(languages)).bit_length() - 1))
    sample = rows.join(small(chosen), ["lang", "fold", "h"]).groupBy("lang", "fold", "h").agg(F.first("text").alias("text")).select("lang", "fold", "text")
    sums = sample.mapInArrow(_counted(slots), "lang string, fold int, counts binary").repartition("lang", "fold").sortWithinPartitions("lang", "fold").mapInArrow(_added, "lang string, fold int, counts binary")
    counts = np.full((2, slots, len(languages)), 0.05)
    at = {x: i for i, x in enumerate(languages)}
    for r in sums.collect():  # two rows for each language
        counts[1 - r["fold"], :, at[r["lang"]]] += np.frombuffer(r["counts"], np.int64)  # for the other half
    return Model(languages, [np.log(c / c.sum(axis=0)).astype(np.float32) for c in counts])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        place = {name: i for i, name in enumerate(model.languages)}
        for b in slices(batches, "text"):
            n, mean = model.scores(b.column(2), b.column(1).to_numpy())
            body, off = flat(b.column(2))
            letters = np.concatenate([[0], np.cumsum(_LOWER[body] != 32)])
            some = letters[off[1:]] > letters[off[:-1]]
            guess = np.where(some & (n > 0), mean.argmax(axis=1), -1).astype(np.int32)
            weight = n / OVERLAP * some
            declared = [place.get(d, -1) for d in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(4), b.column(5), pa.array(declared, pa.int32()), pa.array(guess), pa.array((mean * weight[:, None]).astype(np.float32).tolist(), pa.list_(pa.float32()))],
                names=["doc_id", "th", "host", "suffix", "declared", "guess", "evidence"],
            )

    return run


def _fuse(shared, whole: list[int], reliable: float, smoothing: float, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = shared.value.languages
        k = len(languages)
        everywhere = np.array(whole, float)
        names = np.array([*languages, "und"], object)
        for b in batches:
            if not b.num_rows:
                continue
            declared, guess = b.column(2).to_numpy(), b.column(3).to_numpy()
            evidence, host, suffix = (np.array(b.column(i).to_pylist(), float).reshape(-1, k) for i in (4, 5, 6))
            own = np.zeros_like(evidence)
            voted = guess >= 0
            own[np.flatnonzero(voted), guess[voted]] = 1
            prior = (everywhere - own + 1) / (everywhere.sum() - own.sum(axis=1, keepdims=True) + k)
            for level in (suffix, host):
                level = np.maximum(level - own, 0)
                prior = (level + smoothing * prior) / (level.sum(axis=1, keepdims=True) + smoothing)
            said = np.where(np.arange(k) == declared[:, None], reliable, (1 - reliable) / max(k - 1, 1))
            said[declared < 0] = 1
            log = evidence + np.log(prior) + np.log(said)
            p = np.exp(log - log.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            top = p[np.arange(len(p)), best]
            known = voted & (top >= least)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(names[np.where(known, best, k)], pa.string()), pa.array(np.where(voted, top, 0.0)), pa.array(names[np.where(voted, guess, k)], pa.string()), pa.array(known)],
                names=["doc_id", "th", "language", "posterior", "text_language", "kept"],
            )

    return run


def identify(docs: DataFrame, declared: str | Column = "lang", host: str | Column = "source", suffix: str | Column | None = None, model: Model | None = None, reliable: float | None = None, smoothing: float = SMOOTHING, least: float = MIN_POSTERIOR) -> DataFrame:
    """(doc_id, th, language, posterior, text_language, kept), a row for each row of docs (doc_id, text and the
    columns of the evidence); th: a hash of the text.

    reliable: how often a declared language is right; by default the share of known ones that their texts agree with.
    Rejected, with language "und" and kept false: texts without a letter and three bytes, and those whose best
    language has a posterior below `least`. A null or unknown declared language says nothing. Null hosts are one
    host, null suffixes one suffix. Null text: as empty. Null or repeated doc_id: rows stay apart. No labelled
    text and no model given: all rejected. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    as_col = lambda c: F.lit(None).cast("string") if c is None else (F.col(c) if isinstance(c, str) else c).cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"), language_of(as_col(declared)).alias("declared"), F.coalesce(F.concat(F.lit("h:"), as_col(host)), F.lit("")).alias("host"), F.coalesce(F.concat(F.lit("s:"), as_col(suffix)), F.lit("")).alias("suffix"))
    model = model or train(slim.withColumnRenamed("declared", "lang"))
    if model is None:
        return slim.select("doc_id", "th", F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), F.lit("und").alias("text_language"), F.lit(False).alias("kept"))
    shared = spark.sparkContext.broadcast(model)  # bounded: two tables of MODEL_CELLS
    k = len(model.languages)
    scored = stored(slim.mapInArrow(_score(shared), "doc_id long, th long, host string, suffix string, declared int, guess int, evidence array<float>"))
    if reliable is None:  # how often a known declaration is what the text says
        told, right = scored.filter("declared >= 0 and guess >= 0").agg(F.count("*"), F.count_if(F.col("declared") == F.col("guess"))).first()
        reliable = min(0.999, max(1 / k, (right + 1) / (told + 2)))
    votes = [F.count_if(F.col("guess") == i).alias(f"v{i}") for i in range(k)]
    hosts = stored(scored.groupBy("suffix", "host").agg(*votes))
    sums = [F.sum(f"v{i}").alias(f"v{i}") for i in range(k)]
    whole = [int(x or 0) for x in hosts.agg(*sums).first()]
    as_array = F.array(*(F.col(f"v{i}") for i in range(k)))
    by_suffix = small(stored(hosts.groupBy("suffix").agg(*sums).select("suffix", as_array.alias("by_suffix"))))
    hosts = hosts.select("suffix", "host", as_array.alias("by_host"))
    by_host = small(stored(hosts))
    both = scored.join(by_host, ["suffix", "host"]).join(by_suffix, "suffix").select("doc_id", "th", "declared", "guess", "evidence", "by_host", "by_suffix")
    return both.mapInArrow(_fuse(shared, whole, reliable, smoothing, least), "doc_id long, th long, language string, posterior double, text_language string, kept boolean")


def in_language(docs: DataFrame, **how) -> DataFrame:
    """docs without those that identify() rejects, with the columns of docs; cases as there. If no text is labelled and no
    model is given, nothing can be told and all rows stay."""
    if "model" not in how:
        how["model"] = train(docs, how.get("declared", "lang"))
        if how["model"] is None:
            return docs
    bad = small(stored(identify(docs, **how).filter("not kept").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()))
    own = keyed(docs)
    return unpacked(own.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_anti"), docs)


def page_text(html: Column) -> Column:
    """The visible text of a page, roughly: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^<>]*>", " "), r"\s+", " "))


def of_pages(pages: DataFrame, **how) -> DataFrame:
    """identify() for raw pages (page_id, url, html): declared by the html element, with the url's host and suffix.

    Null html: as empty, rejected. Null or malformed url: no host, no suffix. Null or repeated page_id: rows stay
    apart. Empty table: no rows. Other columns are ignored.
    """
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1))
    docs = pages.select(F.col("page_id").alias("doc_id"), page_text(F.col("html")).alias("text"), F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
    docs = docs.withColumn("suffix", F.nullif(F.regexp_extract("host", r"\.([a-z0-9-]+)$", 1), F.lit("")))
    return identify(docs, declared="declared", host="host", suffix="suffix", **how).withColumnRenamed("doc_id", "page_id")
