"""Token counts of whole texts, huge ones too, by overlap resynchronisation.

A text of up to ``chunk_chars`` characters is encoded at once. A longer one is encoded in chunks that overlap, with
offsets. Two neighbouring chunks are spliced at a boundary in their overlap which both encodings have and which is proven
stable: a character that is not white space stands before it, and a single space and then a character that is not white
space stand after it. The byte-level pattern has no piece that goes on from another character into a space, and what it
finds from such a space on depends on nothing before it; so what stands left and right of it has the tokens that the whole
text has there. Where an overlap has no such boundary, it is doubled, at last up to the end of the text.

Special strings in a text are treated as the library does by default. They have no white space in them, so a stable
boundary never lies within one.

Cases: null or empty text has 0 bytes and 0 tokens; repeated rows get equal counts; null ids pass; other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import slices

#: The proven stable boundaries: the position of the space.
STABLE = re.compile(r"(?<=\S) (?=\S)")


@cache
def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _starts(encoding) -> np.ndarray:
    """The offsets at which tokens begin; a character cut into several tokens gives its offset to each of them."""
    return np.fromiter((a for a, _ in encoding.offsets), np.int64, len(encoding.offsets))


def count_long(tok: Tokenizer, text: str, chunk_chars: int, overlap_chars: int) -> tuple[int, int]:
    """The tokens of the whole text and how often an overlap was widened."""
    total = widened = 0
    begin = 0  # the tokens before it are counted, and it is a stable boundary
    overlap = overlap_chars
    ahead = None  # the encoding of text[begin:begin + chunk_chars] where it is known
    while True:
        end = begin + chunk_chars
        starts = _starts(tok.encode(text[begin:end], add_special_tokens=False)) if ahead is None else ahead
        if end >= len(text):
            return total + len(starts), widened
        cut = None
        while cut is None:
            at = max(begin + 1, end - overlap)
            # The right chunk starts at the overlap's first stable place, so that its own first token is a true one.
            first = STABLE.search(text, at, min(len(text), end))
            if first is not None:
                right = first.start()
                other = _starts(tok.encode(text[right : right + chunk_chars], add_special_tokens=False))
                both = np.intersect1d(starts[starts >= right - begin] + begin, other[other <= end - right] + right)
                cut = next((int(p) for p in both if begin < p < end - 1 and STABLE.match(text, int(p))), None)
            if cut is None:
                widened += 1
                if overlap >= chunk_chars:  # no stable place in the whole chunk: a larger chunk
                    end = min(len(text), begin + 2 * (end - begin))
                    starts = _starts(tok.encode(text[begin:end], add_special_tokens=False))
                    if end == len(text):
                        return total + len(starts), widened
                overlap *= 2
        total += int(np.searchsorted(starts, cut - begin, "left"))
        ahead = other if cut == right else None
        begin, overlap = cut, overlap_chars


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512, chunk_chars: int = 1 << 15, overlap_chars: int = 512) -> DataFrame:
    """The key, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), n_widened; one pass without a shuffle. ``path``: the tokenizer's .json."""
    schema = T.StructType([df.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("n_widened", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tok = tokenizer(path)
        for part in slices(batches, text, 2 << 20):
            texts = [x or "" for x in part.column(text).to_pylist()]
            counts, widened = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            short = [i for i, x in enumerate(texts) if 0 < len(x) <= chunk_chars]
            for i, found in zip(short, tok.encode_batch_fast([texts[i] for i in short], add_special_tokens=False)):
                counts[i] = len(found)
            for i, x in enumerate(texts):
                if len(x) > chunk_chars:
                    counts[i], widened[i] = count_long(tok, x, chunk_chars, overlap_chars)
            sizes = pc.binary_length(part.column(text)).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(key), sizes, pa.array(counts), pa.array(counts > limit), pa.array(widened)], schema.names)

    return df.select(key, text).mapInArrow(run, schema)
