"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary (operator 10).

The rank file's tokens become the pieces of a sentencepiece BPE model: every byte is mapped to a printable
character, a piece's score is its negative rank, and the normaliser is the identity.  sentencepiece merges the
adjacent pair of best score, leftmost first, which is the merge order of the ranks.  A text is cut by the
pre-token pattern; a pre-token that is itself a token becomes it at once, any other goes through the model.
Decoding maps ids to pieces and pieces to bytes.

Edge cases: a null text counts as the empty one (no ids; digests of the empty string).  Texts are never cut,
so long ones take long but are whole.  An empty table gives an empty result.  Rows that repeat are encoded each.  Extra columns are not looked at.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import once, table, text_or_empty

#: Pre-tokens whose ids a worker remembers, and the longest one (characters) that it does.
CACHE, LONGEST = 300_000, 64
#: Bytes of vocabulary that may be broadcast; a larger rank file is refused.
MAX_VOCABULARY_BYTES = 64 << 20

ENCODED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it prints and isn't a space, else one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, raw.splitlines()))}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _data(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model: piece n is the token of rank n; the unknown piece comes last."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing[:5]}")
    chars, out = byte_characters(), []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chars[b] for b in token).encode()
        out.append(_data(1, _data(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))))
    out.append(_data(1, _data(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2)))
    none = (1 << 64) - 1  # -1
    trainer = _number(3, 2) + _number(4, len(ranks) + 1) + _number(40, len(ranks)) + b"".join(_number(k, none) for k in (41, 42, 43))
    normaliser = _data(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join([*out, _data(2, trainer), _data(3, normaliser)])


class Codec:
    """Encodes and decodes with a model from ``model_proto``."""

    def __init__(self, proto: bytes, pattern: str, cache: int = CACHE):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.find = regex.compile(pattern).findall
        self.chars = byte_characters()
        back = {c: b for b, c in enumerate(self.chars)}
        n = self.model.get_piece_size() - 1
        self.pieces = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(n)]
        self.tokens = {t: i for i, t in enumerate(self.pieces)}
        self.cache: dict[str, tuple[str, int, bytes, list[int]]] = {}
        self.most = cache

    def encode_pretokens(self, pretokens: Iterable[str]) -> list[list[int]]:
        raw = [p.encode() for p in pretokens]
        whole = [self.tokens.get(x) for x in raw]
        rest = self.model.encode(["".join([self.chars[b] for b in x]) for x, i in zip(raw, whole) if i is None], out_type=int, num_threads=1)
        it = iter(rest)
        return [next(it) if i is None else [i] for i in whole]

    def known(self, pretokens: list[str]) -> list[tuple[str, int, bytes, list[int]]]:
        """For each pre-token its ids as text, their number, the bytes that the ids decode to, and the ids."""
        cache = self.cache
        if len(cache) > self.most:
            cache.clear()
        found = list(map(cache.get, pretokens))
        if None in found:
            new = list({p for p, x in zip(pretokens, found) if x is None})
            fresh = {p: (",".join(map(str, ids)), len(ids), self.decode(ids), ids) for p, ids in zip(new, self.encode_pretokens(new))}
            cache.update((p, x) for p, x in fresh.items() if len(p) <= LONGEST)
            found = [x or fresh[p] for p, x in zip(pretokens, found)]
        return found

    def encode(self, text: str) -> list[int]:
        return ids_of(self.known(self.find(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of the decoded bytes (decoding goes piece by piece)."""
        return digests_of(self.known(self.find(text)))


def ids_of(found: list[tuple]) -> list[int]:
    return [i for x in found for i in x[3]]


def digests_of(found: list[tuple]) -> tuple[int, str, str]:
    said, raw = ",".join([x[0] for x in found]), b"".join([x[2] for x in found])
    return sum([x[1] for x in found]), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


def _codec_of(shared, pattern: str) -> Codec:
    def make(proto: bytes) -> Codec:
        codec = Codec(proto, pattern)
        gc.freeze()  # nothing here is cyclic; don't walk the cache again and again
        return codec

    return once(shared, make)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, n_tokens, and the two digests, for every row of ``docs``."""
    return _mapped(docs, vocabulary, pattern, with_ids=True)


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """As ``encode``, without the ids themselves."""
    return _mapped(docs, vocabulary, pattern, with_ids=False)


def _mapped(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model_proto(read_ranks(vocabulary)))
    schema = T.StructType([*ENCODED.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec_of(shared, pattern)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, len(batch), 512)):
                # Each text is cut and looked up once, for digests and ids.
                both = [(digests_of(x), ids_of(x) if with_ids else None) for x in (codec.known(codec.find(t)) for t in part.column("text").to_pylist())]
                found = [x for x, _ in both]
                columns = [part.column("doc_id"), *(pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string())))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([x for _, x in both], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the text of each row's ``ids`` (null ids: empty; bytes that aren't UTF-8 are replaced)."""
    shared = encoded.sparkSession.sparkContext.broadcast(model_proto(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec_of(shared, ".")
        for batch in batches:
            texts = [codec.decode(ids or []).decode(errors="replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
