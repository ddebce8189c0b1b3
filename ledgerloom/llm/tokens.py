"""Encoding of texts with a public byte-level BPE vocabulary (problem 7).

Prefix dynamic programming: for each prefix of a piece's bytes the last token of
its encoding is stored. It is unique: of the tokens that end there, only one can
follow the encoding of what is before it, and it can follow if the pair of both
tokens, encoded alone, stays that pair. So appending needs only the new prefixes,
and after an edit the stored prefixes before it hold.

Texts are first cut into pieces by the vocabulary's own pattern; pieces repeat, so
each worker keeps the encodings of the last `CACHE` different ones.

Defined results: null and empty texts give an empty list; special tokens' strings
are ordinary text; blanks and any odd characters are encoded like other text,
lone surrogates as the replacement character. Repeated rows are kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerloom.tables import spread, table

#: Different pieces whose encoding a worker keeps; longer ones are encoded anew each time.
CACHE = 1 << 18
CACHED_BYTES = 64
#: Pairs of tokens whose check a worker keeps.
PAIRS = 1 << 20


def vocabulary_file() -> str:
    """The place of byte_bpe_50k on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def vocabulary_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PrefixEncoder:
    """Byte-level BPE by prefix dynamic programming."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, self.ids))
        self.by_id = {i: t for t, i in self.ids.items()}
        #: Beginnings of tokens read backwards, to stop the search for tokens that end at a place.
        self.tails = {t[k:] for t in self.ids for k in range(len(t))}
        self.follows: dict[tuple[int, int], bool] = {}
        self.wholes: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}

    def pair_stays(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens, encoded together, give just these two."""
        known = self.follows.get((left, right))
        if known is None:
            if len(self.follows) >= PAIRS:
                self.follows.clear()
            known = self.follows[left, right] = self.merge(self.by_id[left] + self.by_id[right]) == [left, right]
        return known

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: merge the pair of the lowest id until none is left. Only for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ids.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def extend(self, last: list[int], data: bytes, start: int) -> list[int]:
        """Stores the last token of each prefix of `data` longer than `start`; last[k] belongs to the prefix of k bytes."""
        del last[start + 1 :]
        ids, tails = self.ids, self.tails
        for end in range(start + 1, len(data) + 1):
            found = -1
            for begin in range(end - 1, max(-1, end - self.longest - 1), -1):
                part = data[begin:end]
                if part not in tails:
                    break
                token = ids.get(part)
                if token is not None and (begin == 0 and self.whole(token) or begin and self.pair_stays(last[begin], token)):
                    found = token
                    break
            last.append(found)
        return last

    def whole(self, token: int) -> bool:
        """Whether the bytes of a token, encoded alone, give just this token."""
        known = self.wholes.get(token)
        if known is None:
            known = self.wholes[token] = self.merge(self.by_id[token]) == [token]
        return known

    def read(self, last: list[int]) -> list[int]:
        """The encoding, from the last token back to the first."""
        out, at = [], len(last) - 1
        while at > 0:
            out.append(last[at])
            at -= len(self.by_id[last[at]])
        return out[::-1]

    def encode_piece(self, piece: str) -> list[int]:
        out = self.pieces.get(piece)
        if out is None:
            data = piece.encode("utf-8", "replace")
            token = self.ids.get(data)
            out = [token] if token is not None else self.read(self.extend([-1], data, 0))
            if len(data) <= CACHED_BYTES:
                if len(self.pieces) >= CACHE:
                    self.pieces.clear()
                self.pieces[piece] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.pieces
        for piece in self.pattern.findall(text):
            out += known.get(piece) or self.encode_piece(piece)
        return out

    def reencode(self, old: bytes, last: list[int], new: bytes) -> list[int]:
        """The prefix table of an edited piece: only the prefixes behind the first change are worked out again."""
        same = next((i for i, (a, b) in enumerate(zip(old, new, strict=False)) if a != b), min(len(old), len(new)))
        return self.extend(last[: same + 1], new, same)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> PrefixEncoder:
    with open(path, "rb") as file:
        return PrefixEncoder(file.read(), pattern)


#: A worker's encoder, by the name of the broadcast vocabulary.
_OWN: dict[str, PrefixEncoder] = {}


def encode_texts(frame: DataFrame, key: str, column: str, path: str, pattern: str) -> DataFrame:
    """`key` and the ids of each text. The vocabulary of fixed size is read once on the driver and broadcast."""
    with open(path, "rb") as file:
        shared = frame.sparkSession.sparkContext.broadcast(file.read())
    name = f"{path}|{pattern}"
    schema = T.StructType([frame.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _OWN.get(name)
        if own is None:
            own = _OWN[name] = PrefixEncoder(shared.value, pattern)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=schema.names)

    return spread(frame.select(key, column)).mapInArrow(run, schema)


def p7_ids(spark: SparkSession, folder: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and token ids of every document."""
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text", path or vocabulary_file(), pattern or vocabulary_pattern())
