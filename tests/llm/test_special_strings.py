"""Texts that hold the strings of special tokens, against the tokenizers library as it comes."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from odd_rows import got
from tokenizers import Tokenizer

from copresence.llm import queries, token_store

VOCABULARY = public_tokenizers.path(queries.WORD_VOCABULARY)
BITS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", " ", "  ", "\n", "don", "'t", "Hello", "É", "12", "é", "日本", ".", "\x00"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def texts():
    rnd = random.Random(4)
    made = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 12))) for _ in range(1500)]
    return ["hi <|endoftext|> you <|startoftext|>x", "<|endoftext|>", "a\n<|startoftext|><|endoftext|>'T", "plain", "", None, *made]


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_encoder(library, dtype):
    for some in (texts(), ["plain", None], ["<|endoftext|>"], []):
        ids, lengths = token_store.encoder(VOCABULARY, dtype).encode_whole(pa.array(some, pa.string()))
        parts = np.split(np.frombuffer(ids, dtype), np.cumsum(lengths)[:-1]) if some else []
        assert [p.tolist() for p in parts] == [library(t) for t in some]


def test_store(table, library):
    rows = list(enumerate(texts()[:300]))
    folder, keys = token_store.store(table(rows).repartition(3), VOCABULARY, queries.WORD_IDS)
    out = got(token_store.read(keys, folder, queries.WORD_IDS))
    assert sorted((r[0], r[5]) for r in out) == [(i, library(t)) for i, t in rows]
    assert all(r[3] == len(r[5]) and r[4] == zlib.crc32(np.array(r[5], "<u4").tobytes()) for r in out)
