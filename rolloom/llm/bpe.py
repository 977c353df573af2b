"""Operator 7: byte-level BPE of whole texts, long ones by tree concatenation, and back."""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm.common import flat, slices

#: Texts of more bytes are cut into leaves of about LEAF bytes that are encoded in parallel.
LONG, LEAF = 1 << 16, 1 << 15
#: A piece of more bytes, which the pattern leaves whole, is encoded by halves and joined.
PIECE = 1 << 10
SPECIAL = "<|endoftext|>"
_PATTERN = regex.compile(public_tokenizers.PATTERN)
#: No piece spans a visible character and white space after it, so the text may be cut there.
_CUT = regex.compile(r"(?<=\S)(?=\s)")


class Bpe:
    """The vocabulary of a rank file. `encode` equals the encoder of the tokenizers library with the same vocabulary."""

    def __init__(self, ranks_path: str, special_id: int = 50256):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.special = special_id
        self.core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: special_id})
        size = max(max(ranks.values()), special_id) + 1
        self.token: list[bytes] = [b""] * size
        for t, r in ranks.items():
            self.token[r] = t
        self.token[special_id] = SPECIAL.encode()

    def whole(self, text: str) -> list[int]:
        """A text whose pieces are short."""
        if SPECIAL in text:
            return self.core.encode(text, allowed_special="all")
        return self.core.encode_ordinary(text)

    def base(self, piece: bytes) -> list[int]:
        return self.core._encode_single_piece(piece)  # noqa: SLF001

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring parts of one piece, given theirs.

        The window of k tokens on either side is encoded anew, k doubling, until its first and last tokens are
        those that stood there. Then every neighbouring pair is one that the merges leave alone, those outside
        the window as before, and only the true encoding has that property.
        """
        k = 4
        while left and right:
            a, b = left[-k:], right[:k]
            now = self.base(b"".join(map(self.token.__getitem__, a + b)))
            if (k >= len(left) or now[0] == a[0]) and (k >= len(right) or now[-1] == b[-1]):
                return left[:-k] + now + right[k:] if k < len(left) else now + right[k:]
            k *= 2
        return left or right

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Joins encodings of neighbouring parts of one piece, pair by pair, level by level."""
        while len(parts) > 1:
            parts = [self.joined(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def piece(self, piece: bytes, leaf: int = PIECE) -> list[int]:
        return self.base(piece) if len(piece) <= leaf else self.tree([self.base(piece[i : i + leaf]) for i in range(0, len(piece), leaf)])

    def encode(self, text: str) -> list[int]:
        """Any text; `whole` if no piece is long."""
        out: list[int] = []
        for kind, part in cut(text, LEAF, PIECE):
            out += self.leaf(kind, part)
        return out

    def leaf(self, kind: str, part: bytes) -> list[int]:
        """What cut() yields, encoded."""
        if kind == "text":
            return self.whole(part.decode())
        if kind == "short":
            return [i for p in part.split(b"\xff") for i in self.base(p)]
        return [self.special] if kind == "special" else self.piece(part)

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text; what isn't UTF-8, as ids that cut a character, is replaced as the library does."""
        raw = b"".join(map(self.token.__getitem__, ids))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


def cut(text: str, leaf: int, piece: int) -> Iterator[tuple[str, bytes]]:
    """Cuts a text into ("text", UTF-8) of about `leaf` characters at places that no piece spans, ("piece", bytes) for long
    pieces, ("short", pieces joined by the byte 255, which UTF-8 lacks) between those, and ("special", b"") for the special
    token. Encodings of these, in order, make that of the text."""
    for i, segment in enumerate(text.split(SPECIAL)):
        if i:
            yield "special", b""
        at, n = 0, len(segment)
        while at < n:
            end = n
            if n - at > leaf:
                m = _CUT.search(segment, at + leaf)
                end = m.start() if m else n
            part = segment[at:end]
            at = end
            longest = max(map(len, part.split()), default=0)
            if longest <= piece // 4 and (len(part) <= piece // 4 or longest and not regex.search(r"\s{%d}" % (piece // 4), part)):
                yield "text", part.encode()
                continue
            short: list[bytes] = []
            for m in _PATTERN.finditer(part):
                if len(m[0]) <= piece // 4:
                    short.append(m[0].encode())
                    continue
                if short:
                    yield "short", b"\xff".join(short)
                    short = []
                yield "piece", m[0].encode()
            if short:
                yield "short", b"\xff".join(short)


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _digest(ids: list[int], decoded: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


_RUN = np.zeros(256, bool)
_RUN[[9, 10, 11, 12, 13, 32]] = True


def _runs_long(body: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """For each text: may it have a run of more than `most` bytes without, or of, white space?"""
    if not len(body):
        return np.zeros(len(off) - 1, bool)
    space = _RUN[body]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    edges = np.unique(np.concatenate([change, off]))
    gap = np.diff(edges)
    bad = edges[:-1][gap > most]
    out = np.zeros(len(off) - 1, bool)
    out[np.searchsorted(off, bad, "right") - 1] = True
    return out


def _short(path: str, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in slices(batches, "text"):
            text = b.column(b.schema.get_field_index("text"))
            hard = _runs_long(*flat(text), PIECE // 4)
            rows = []
            for t, h in zip(text.to_pylist(), hard):
                ids = bpe.encode(t) if h else bpe.whole(t) if t else []
                rows.append((*_digest(ids, d := bpe.decode(ids)), *((ids, d.decode()) if texts else ())))
            yield _out(b, rows, texts)

    return run


def _out(b: pa.RecordBatch, rows: list[tuple], texts: bool) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * (5 if texts else 3)
    types = [pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32()), pa.string()] if texts else [])]
    return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if texts else [])])


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, at, kind, part): leaves of long texts; the leaves of a piece after the first are "more"."""
    for b in batches:
        for doc, row, text in zip(b.column(0), b.column(1), b.column(2)):
            out = []
            for kind, part in cut(text.as_py(), LEAF, LEAF):
                for i in range(0, max(1, len(part)), LEAF):
                    out.append(("more" if i and kind == "piece" else kind, part[i : i + LEAF]) if kind == "piece" else (kind, part))
                    if kind != "piece":
                        break
            for i in range(0, len(out), 64):
                some = out[i : i + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()] * len(some), pa.int64()), pa.array([row.as_py()] * len(some), pa.string()), pa.array(range(i, i + len(some)), pa.int64()), pa.array([k for k, _ in some]), pa.array([p for _, p in some], pa.binary())],
                    names=["doc_id", "row", "at", "kind", "part"],
                )


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            ids = []
            for kind, part in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                got = bpe.leaf("piece" if kind == "more" else kind, part)
                ids.append(np.array(got, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.binary())], names=["doc_id", "row", "at", "kind", "ids"])

    return run


def _merged(path: str, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        rows = ((d, r, k, i) for b in batches for d, r, k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()))
        for (doc, row), group in itertools.groupby(rows, key=lambda x: x[:2]):
            ids: list[int] = []
            open_: list[list[int]] = []
            for _, _, kind, raw in group:
                part = np.frombuffer(raw, "<u4").tolist()
                if kind == "more":
                    open_.append(part)
                    continue
                ids += bpe.tree(open_)
                open_ = [part] if kind == "piece" else []
                if kind != "piece":
                    ids += part
            ids += bpe.tree(open_)
            head = pa.RecordBatch.from_arrays([pa.array([doc], pa.int64())], names=["doc_id"])
            d = bpe.decode(ids)
            out = _out(head, [(*_digest(ids, d), *((ids, d.decode()) if texts else ()))], texts)
            for _ in range(int(row.rpartition("-")[2])):
                yield out

    return run


def encode(docs: DataFrame, ranks_path: str | None = None, texts: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each row of docs; with texts also ids and decoded.

    Null text: as empty, no tokens. The special token's string is that token. Texts of more than LONG bytes are
    cut where no piece of the pattern can span, unsplit runs into leaves of LEAF bytes; leaves are encoded in
    parallel over the cluster, then the leaves of one run are joined pair by pair (`Bpe.joined`). A task of the
    last step holds the tokens of one text at a time. Null or repeated doc_id: a result for each row. Other columns
    are ignored.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else "")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    near = slim.filter(size <= LONG).mapInArrow(_short(path, texts), schema)
    far = (
        slim.filter(size > LONG)
        .groupBy("doc_id", "text")
        .count()
        .select("doc_id", F.concat_ws("-", "doc_id", F.md5("text"), "count").alias("row"), "text")
        .mapInArrow(_leaves, "doc_id long, row string, at long, kind string, part binary")
        .repartition("row", "at")
        .mapInArrow(_encoded(path), "doc_id long, row string, at long, kind string, ids binary")
        .repartition("row")
        .sortWithinPartitions("row", "at")
        .mapInArrow(_merged(path, texts), schema)
    )
    return near.unionByName(far)
