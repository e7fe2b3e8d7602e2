"""Byte-level BPE encoding in Python workers, decoding inside the JVM.

A word is split into its bytes, and a fold merges the adjacent pair of lowest
rank (the leftmost of equals) until no pair has a rank.  Each worker folds the
words it meets, those of one length together, and holds the ids of a bounded
number of them (``MAX_WORDS``) across its tasks (see ``bpe_fold``).  So no text
is shuffled, the driver holds nothing but the vocabulary's file, and the result
doesn't depend on what a worker holds.

Decoding concatenates the byte strings of the ids.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandline.llm.bpe_fold import Encoder, parse_ranks
from strandline.llm.common import in_parts, reach_package, tidy

#: Where the vocabulary lies; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Chunks of text whose ids a worker holds.
MAX_WORDS = 1 << 19


@lru_cache(maxsize=4)
def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def _murmur(data: bytes, seed: int = 42) -> int:
    """The engine's ``hash`` of a string with these UTF-8 bytes, without sign; encoding no longer needs it."""
    mask = 0xFFFFFFFF

    def turn(x: int, r: int) -> int:
        return (x << r | x >> (32 - r)) & mask

    h, whole = seed, len(data) & ~3
    parts = [int.from_bytes(data[i : i + 4], "little") for i in range(0, whole, 4)]
    for k in [*parts, *((b - 256 if b > 127 else b) & mask for b in data[whole:])]:
        h = turn(h ^ (turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask), 13) * 5 + 0xE6546B64 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a fold over nothing that ends in ``body``."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


@lru_cache(maxsize=1)
def _encoder(vocabulary: bytes, max_words: int) -> Encoder:
    """A worker's own; it lives on from task to task."""
    return Encoder(vocabulary, max_words)


def _encode_array(texts: pa.Array, encoder: Encoder) -> pa.Array:
    """Ids of an array of UTF-8 bytes; bytes that aren't UTF-8 are kept as they are."""
    found = encoder.encode(["" if t is None else t.decode("utf-8", "surrogateescape") for t in texts.to_pylist()])
    ends = [0]
    for ids in found:
        ends.append(ends[-1] + len(ids) // 4)
    values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(found))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=texts.is_null())


def _encoded(batches: Iterator[pa.Array], encoder: Callable[[], Encoder]) -> Iterator[pa.Array]:
    """Ids of all batches, in parts; memory that earlier queries of this worker and this task have freed is given back."""
    tidy()
    for texts in in_parts(batches):
        yield _encode_array(texts, encoder())
    tidy()


def ids_of(spark: SparkSession, text: Column, path: str = VOCABULARY, max_words: int = MAX_WORDS) -> Column:
    """Token ids (array<int>) of a column of strings."""
    reach_package(spark)
    with open(path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _encoded(batches, lambda: _encoder(vocabulary.value, max_words))

    return F.arrow_udf(ids, returnType="array<int>")(text.cast("binary"))


def encode(docs: DataFrame, path: str = VOCABULARY, max_words: int = MAX_WORDS, text_col: str = "text", tokens_col: str = "tokens") -> DataFrame:
    """``docs`` with a column of token ids (array<int>), in place of any so named.

    A null text has null tokens, an empty one none.  Texts and words of any
    length are encoded whole.  Repeated rows are encoded alike; other columns
    stay as they are; an empty table gives an empty result.  Strings of special
    tokens are ordinary text.
    """
    return docs.withColumn(tokens_col, ids_of(docs.sparkSession, F.col(text_col), path, max_words))


@lru_cache(maxsize=4)
def _piece_json(path: str) -> str:
    ranks = read_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    return json.dumps(pieces)


def decode(tokens: Column, path: str = VOCABULARY) -> Column:
    """The bytes (binary) of an array of ids; null gives null, no ids no bytes.

    An id that the vocabulary doesn't have, or a null id, adds nothing.
    """
    table = F.from_json(F.lit(_piece_json(path)), "array<string>")
    # joined as one character a byte: concatenating binary values one by one would copy each prefix again
    return _let(table, lambda t: F.encode(F.array_join(F.transform(tokens, lambda i: F.get(t, i)), ""), "ISO-8859-1"))


def round_trip(docs: DataFrame, path: str = VOCABULARY, max_words: int = MAX_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, tokens, n_bytes, same): ids, and whether they decode to the text."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    done = encode(own, path, max_words).withColumn("__bytes", decode(F.col("tokens"), path))
    return done.select("doc_id", F.size("tokens").alias("n_tokens"), "tokens", F.length("__bytes").alias("n_bytes"), (F.col("__bytes") == F.col("text").cast("binary")).alias("same"))
