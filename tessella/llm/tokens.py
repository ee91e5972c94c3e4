"""Sizes and places of tokens of a public byte-pair tokenizer, read from its vocabulary file."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = os.environ.get("TESSELLA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level vocabularies of this kind divide a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Longer stretches are encoded piecewise; the pieces end before a blank that a letter follows, where
#: the pattern divides in any case.
STRETCH = 100_000


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > STRETCH:
        end = at + STRETCH
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def encode(text: str, path: str) -> list[int]:
    enc = encoding(path)
    clean = text.encode("utf-8", "replace").decode("utf-8")
    return [t for s in stretches(clean) for t in enc.encode_ordinary(s)]


def offsets(text: str, path: str) -> list[int]:
    """The character at which each token begins."""
    enc, out, at = encoding(path), [], 0
    for token in encode(text, path):
        data = enc.decode_single_token_bytes(token)
        # a token may begin inside a character: it counts to the next one
        out.append(at)
        at += sum((b & 0xC0) != 0x80 for b in data)
    return out


def vocabulary(path: str | None) -> str:
    return path or os.path.join(TOKENIZERS, VOCABULARY)


def count(text: Column, path: str | None = None) -> Column:
    """Tokens of a text; null and empty texts have none."""
    file = vocabulary(path)

    @F.pandas_udf(T.LongType())
    def size(s: pd.Series) -> pd.Series:
        return s.map(lambda x: len(encode(x, file)) if isinstance(x, str) and x else 0)

    return size(text)


def paged(text: str, page: int, path: str) -> tuple[list[int], list[str], int]:
    """The character (from 0) at which each token of a text begins, the text in pages of so many
    tokens, and its length in characters."""
    text = text.encode("utf-8", "replace").decode("utf-8")
    at = offsets(text, path)
    first = at[::page]
    return at, [text[a:b] for a, b in zip(first, [*first[1:], len(text)])], len(text)


def parts_within(text: str, limit: int, overlap: int, path: str, start: int = 0) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the parts of a text that encoded by themselves have at most limit
    tokens: the whole text if it has, else two halves that share overlap tokens, and so on."""
    at = offsets(text, path)
    if len(at) <= limit:
        return [(start, start + len(text), len(at))]
    half = len(at) // 2
    again = at[half - overlap]
    return [*parts_within(text[: at[half]], limit, overlap, path, start), *parts_within(text[again:], limit, overlap, path, start + again)]
