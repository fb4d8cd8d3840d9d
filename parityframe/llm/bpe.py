"""Byte-level BPE encoding and decoding (operator 5) with tiktoken.

The rank file is read once on the driver and broadcast (it is refused beyond
``MAX_RANK_BYTES``); executors need no tokenizer files. Long texts are split
before the merges at safe boundaries: between a non-space and a space of the
split pattern a match always ends, and nothing in the pattern looks back, so
parts encode on their own as they do within the text. (A memo of ids by word
was tried; it took half as long again as tiktoken takes for whole texts.)

Ids travel as little-endian unsigned 32-bit integers in a binary column;
decoding gives raw bytes.

Defined results: a null text encodes to no ids; null ids decode to no bytes;
ids beyond the vocabulary raise; other columns pass through, and a column of
the input named like the added one is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityframe.llm.common import read_table, ship

MAX_RANK_BYTES = 64 << 20
#: Texts longer than this are encoded in parts of about this many code points.
PART_CHARS = 1 << 16

# The code points of the split pattern's \s (Unicode White_Space).
WHITE_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SAFE = re.compile(f"[^{WHITE_SPACE}](?=[{WHITE_SPACE}])")


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in blob.splitlines() if line)}


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, blob: bytes, pattern: str):
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=parse_ranks(blob), special_tokens={})

    def encode(self, text: str) -> bytes:
        """Packed ids of the text, part by part."""
        at, packed = 0, []
        while len(text) - at > PART_CHARS:
            cut = _SAFE.search(text, at + PART_CHARS)
            if not cut:
                break
            packed.append(self._pack(text[at:cut.end()]))
            at = cut.end()
        packed.append(self._pack(text[at:] if at else text))
        return b"".join(packed)

    def _pack(self, text: str) -> bytes:
        ids = array("I", self.encoding.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def decode(self, packed: bytes) -> bytes:
        return self.encoding.decode_bytes(np.frombuffer(packed, dtype="<u4").tolist())


_CODECS: dict[str, Codec] = {}


def codec(blob: bytes, pattern: str) -> Codec:
    """The worker's codec; building one takes a good part of a second."""
    key = hashlib.sha256(blob + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(blob, pattern)
    return _CODECS[key]


def read_ranks(spark: SparkSession, path: str):
    """Broadcast of a rank file's bytes, size checked."""
    if os.path.getsize(path) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is over {MAX_RANK_BYTES} bytes; not a rank file")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _mapped(docs: DataFrame, source: str, ranks, pattern: str, targets: list[str], work, missing) -> DataFrame:
    """``docs`` plus binary columns: work(codec, value) gives one value for each
    of ``targets``."""
    docs = docs.drop(*targets)
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]
                          + [T.StructField(t, T.BinaryType()) for t in targets])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for batch in batches:
            # A few hundred rows at a time: what is made is a few times the input.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [work(own, missing if x.as_py() is None else x.as_py()) for x in part.column(source)]
                yield pa.record_batch([*part.columns, *(pa.array([m[i] for m in made], pa.binary()) for i in range(len(targets)))],
                                      names=schema.names)
    return docs.mapInArrow(run, schema)


def encode_text(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` plus the packed token ids of each text."""
    return _mapped(docs, text_col, read_ranks(docs.sparkSession, rank_path), pattern, [ids_col],
                   lambda c, text: (c.encode(text),), "")


def decode_ids(docs: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` plus the bytes that each row's ids stand for."""
    return _mapped(docs, ids_col, read_ranks(docs.sparkSession, rank_path), pattern, [bytes_col],
                   lambda c, ids: (c.decode(ids),), b"")


def encode_and_decode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids",
                      bytes_col: str = "decoded") -> DataFrame:
    """Both in one pass, so that a task needs one Python worker, not two."""
    def both(c: Codec, text: str) -> tuple[bytes, bytes]:
        ids = c.encode(text)
        return ids, c.decode(ids)
    return _mapped(docs, text_col, read_ranks(docs.sparkSession, rank_path), pattern, [ids_col, bytes_col], both, "")


def coded(docs: DataFrame) -> DataFrame:
    """Digest columns of a table with doc_id and text: encoded, then decoded."""
    import public_tokenizers

    both = encode_and_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                             public_tokenizers.PATTERN)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(read_table(spark, sf_dir, "documents"))
