from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rolloom.llm import bpe
from rolloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_trees_equal_the_library(library):
    own = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(1)
    parts = ["a", "b", "e", "th", " ", "é", "1", "!", "ing", " the", "\n", "  ", "'s", "日本", " ", "<|endoftext|>"]
    for n in range(120):
        text = "".join(rng.choice(parts if n % 3 else parts[:3]) for _ in range(rng.randint(0, 3000)))
        for leaf, piece in ((50, 40), (bpe.LEAF, bpe.PIECE)):
            ids = [i for k, p in bpe.cut(text, leaf, piece) for i in (own.piece(p, 17) if k == "piece" else own.leaf(k, p))]
            assert ids == library.encode(text, add_special_tokens=False).ids
            assert own.decode(ids).decode() == text


def test_joins_of_halves(library):
    own = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choice(b"aabcdething") for _ in range(rng.randint(2, 200)))
        at = rng.randint(1, len(piece) - 1)
        assert own.joined(own.base(piece[:at]), own.base(piece[at:])) == own.base(piece)


def test_cases(docs, library):
    long = ["ab1" * 60_000, " " * 100_000 + "x", "word " * 40_000, "a" * 90_000 + "<|endoftext|>" + "é" * 50_000]
    rows = [(1, "Hello <|endoftext|> world's"), (1, "Hello <|endoftext|> world's"), (2, None), (3, ""), (None, "naïve\n\n\nx"), *((10 + i, t) for i, t in enumerate(long)), (10, long[0])]
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs(rows)).collect())
    assert got == sorted((i or 0, *want(library, t)) for i, t in rows)
    assert bpe.encode(docs([])).count() == 0
    full = bpe.encode(docs(rows[:1]), texts=True).first()
    assert full.decoded == rows[0][1] and len(full.ids) == full.n_tokens


def test_query_equals_the_library(spark, library):
    d = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = QUERIES["op7_bpe"](spark, d).collect()
    assert len(got) == len(text)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(library, text[r.doc_id])
