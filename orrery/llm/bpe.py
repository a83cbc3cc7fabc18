"""Byte-level BPE encoding and decoding with a public vocabulary.

The vocabulary is a rank file (base64 token, space, rank in each line).  A text is
split by a pattern, each match is mapped from bytes to the printable characters of the
byte table and merged by the `tokenizers` library.  Matches repeat, so a worker keeps
the ids of those it has seen (a memo of bounded bytes; what it returns doesn't depend on
it).  Codec and memo are dropped when their task ends.
Token offsets are given in bytes and in characters; a token that holds part of a
character gets the whole of it as its character range.  Decoding reverses the byte
table; a character split over tokens is put together from its bytes.

A null text encodes as an empty one: no ids.  Special tokens are never recognised;
their strings are ordinary text.  Texts are encoded whole however long.  Repeated rows
are encoded each; an empty table gives an empty result.  Columns of the input that
have the name of an output are left out.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from tokenizers import models

from .textkit import annotate, bound_batches, documents, free_name, give_back

#: Bytes of matches and of their ids that a codec remembers, with what Python adds to each.
MEMO_BYTES = 24 << 20
MAX_VOCABULARY_BYTES = 64 << 20


def byte_table() -> dict[int, str]:
    """Byte to character: printable bytes stay, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        table.setdefault(b, chr(0x100 + len(table) - len(plain)))
    return table


def read_ranks(path: str) -> bytes:
    """The content of a rank file, whose size is checked before it is shared."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return data


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: bytes, pattern: str = public_tokenizers.PATTERN):
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.ids = {base64.b64decode(a): int(b) for a, b in pairs}
        # white space as Unicode defines it, whichever way the regex library reads \s
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.to_char = byte_table()
        self.to_byte = {c: b for b, c in self.to_char.items()}
        chars = lambda b: "".join(map(self.to_char.__getitem__, b))
        # any two neighbours that make a token may merge, the token of least rank first
        merges = [(chars(b[:k]), chars(b[k:])) for b in sorted(self.ids, key=self.ids.__getitem__) for k in range(1, len(b)) if b[:k] in self.ids and b[k:] in self.ids]
        self.model = models.BPE(vocab={chars(b): i for b, i in self.ids.items()}, merges=merges, ignore_merges=True)
        # the model's token strings through the reversed byte table
        self.tokens = {i: bytes(map(self.to_byte.__getitem__, self.model.id_to_token(i))) for i in self.ids.values()}
        self.size = max(self.tokens, default=-1) + 1
        self.lengths = np.zeros(self.size, np.int64)
        for i, b in self.tokens.items():
            self.lengths[i] = len(b)
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def _merge(self, pieces: list[str]) -> None:
        """Puts the ids of unknown pieces, as int32 bytes, into the memo."""
        to_char, tokenize = self.to_char.__getitem__, self.model.tokenize
        for p in pieces:
            ids = [t.id for t in tokenize("".join(map(to_char, p.encode())))]
            self.memo[p] = got = np.array(ids, np.int32).tobytes()
            self.held += len(p) + len(got) + 200

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text."""
        pieces = self.split(text or "")
        memo = self.memo
        try:
            return np.frombuffer(b"".join(map(memo.__getitem__, pieces)), np.int32)
        except KeyError:
            pass
        if self.held > MEMO_BYTES:
            memo.clear()
            self.held = 0
        self._merge([p for p in dict.fromkeys(pieces) if p not in memo])
        return np.frombuffer(b"".join(map(memo.__getitem__, pieces)), np.int32)

    def offsets(self, text: str | None, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges and character ranges of the tokens of a text, one row each."""
        raw = np.frombuffer((text or "").encode(), np.uint8)
        ends = np.cumsum(self.lengths[ids])
        spans = np.stack([ends - self.lengths[ids], ends], axis=1)
        of_char = np.cumsum((raw & 0xC0) != 0x80)
        if not len(ids):
            return spans, spans
        return spans, np.stack([of_char[spans[:, 0]] - 1, of_char[spans[:, 1] - 1]], axis=1)

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids; an id that the vocabulary lacks is an error."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_parts(self, parts: Iterable[Sequence[int]]) -> Iterator[str]:
        """Text of consecutive runs of ids.  A character that is split between runs
        comes with the run that ends it; bytes that are no UTF-8 become U+FFFD."""
        held = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield held.decode(self.decode(ids))
        if rest := held.decode(b"", True):
            yield rest


def _encode(shared: Broadcast, pattern: str, spans: bool):
    codec = Codec(shared.value, pattern)

    def fn(texts: pa.Array) -> list:
        texts = texts.to_pylist()
        ids = [codec.encode(t) for t in texts]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        lists = lambda flat: pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))
        out = [lists(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32))]
        if spans:
            ranges = [np.concatenate(codec.offsets(t, i), axis=1) for t, i in zip(texts, ids, strict=True)]
            flat = np.concatenate([*ranges, np.zeros((0, 4), np.int64)]).astype(np.int32)
            out += [lists(np.ascontiguousarray(flat[:, k])) for k in range(4)]
        return out

    return fn


def _digest(shared: Broadcast, pattern: str):
    codec = Codec(shared.value, pattern)
    names = {i: str(i) for i in codec.tokens}

    def fn(texts: pa.Array) -> list:
        count, ids_sha, text_sha = [], [], []
        for t in texts:
            ids = codec.encode(t.as_py()).tolist()
            count.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return [pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    return fn


def _decode(shared: Broadcast, pattern: str, column: str, names: list[str]):
    def run(batches):
        codec = Codec(shared.value, pattern)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1).to_pylist()
            made = pa.array([None if x is None else codec.decode(x).decode("utf-8", "replace") for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names)
        del codec
        give_back()

    return run


def _share(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(read_ranks(path))


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep: Sequence[str] | None = None, offsets: bool = True) -> DataFrame:
    """df's columns (or those in `keep`) with ids and, for each id, byte_start, byte_end,
    char_start and char_end (arrays)."""
    out = "ids array<int>" + ", byte_start array<int>, byte_end array<int>, char_start array<int>, char_end array<int>" * offsets
    return annotate(df, text_col, out, partial(_encode, _share(df.sparkSession, path or default_path()), pattern, offsets), keep)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None, out_col: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """df with the text of a column of id arrays in place of it; null stays null."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    bound_batches(df.sparkSession)
    kept = [f for f in df.schema if f.name.lower() not in (ids_col.lower(), out_col.lower())]
    schema = T.StructType([*kept, T.StructField(out_col, T.StringType())])
    src = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{ids_col}`").cast("array<int>").alias(free_name(df, "__ids")))
    return src.mapInArrow(_decode(_share(df.sparkSession, path or default_path()), pattern, ids_col, schema.names), schema)


def digest(df: DataFrame, text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep: Sequence[str] | None = None) -> DataFrame:
    """df's columns (or those in `keep`) with n_tokens, ids_sha256 (of the decimal ids
    joined by a space) and decoded_sha256 (of the bytes that the ids decode to)."""
    shared = _share(df.sparkSession, path or default_path())
    return annotate(df, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", partial(_digest, shared, pattern), keep)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir), keep=["doc_id"])
