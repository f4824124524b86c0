"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK = 1 << 16  #: longer texts are encoded in blocks of about so many characters
#: One blank or line end between other characters: the tokenizer always begins a word there, so cutting there changes no count.
BORDER = re.compile(r"(?<=\S)[ \n](?=\S)")


@cache
def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """Encoder of a rank file; one per Python worker."""
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    #: Fixed value: how this vocabulary's texts are cut into words.
    words = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=words, mergeable_ranks=ranks, special_tokens={})


def _blocks(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > BLOCK and (border := BORDER.search(text, at + BLOCK)):
        yield text[at : border.start()]
        at = border.start()
    yield text[at:]


def count(text: str | None, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> int:
    """Tokens of a text, exactly; 0 for null."""
    encode = encoder(folder, vocabulary).encode_ordinary
    return sum(len(encode(b)) for b in _blocks(text)) if text else 0


def token_counts(df: DataFrame, key: list[str], text: str, head: bool = False, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """Key columns and ``tokens``; with ``head`` also ``head_tokens``, those of the first
    line with letters or digits, which tells what the text is about. Null texts have 0."""
    chosen = df.select(*key, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    names = [*key, "tokens", *["head_tokens"] * head]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            sizes = [[count(t, folder, vocabulary) for t in texts]]
            if head:
                sizes.append([min(n, count((t or "").lstrip().partition("\n")[0], folder, vocabulary)) for t, n in zip(texts, sizes[0])])
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], *[pa.array(s, pa.int64()) for s in sizes]], names)

    return chosen.mapInArrow(measure, fields + ", tokens long" + ", head_tokens long" * head)
