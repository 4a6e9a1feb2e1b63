"""Byte-level BPE by longest matches, with backtracking, and its decoding.

Bytes are mapped to Latin-1 characters, one to one, so that pyahocorasick finds
all vocabulary tokens of a piece in one pass. A token sequence is what BPE makes
of a piece exactly if BPE leaves each two neighbours as they are. So the encoder
takes the longest token at each position, steps to shorter ones where it does
not fit its left neighbour, and steps back where none does; a position that was
given up is not entered again, which keeps the work linear. Whether two tokens
fit is found once, by merging their bytes, and remembered.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import only, released, ship, table, text_of, type_of
from weft.llm.pretokenize import cutter

#: What a worker remembers: small enough to stay beside the JVM when later stages run in it.
CACHED_PIECES = 200_000
CACHED_PAIRS = 200_000
LONGEST_CACHED = 64
VOCABULARY = "byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


def merged(text: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[int]:
    """What BPE makes of a few bytes: join the neighbours of least rank, leftmost first, as far as ranks are below a limit."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Encoder(dict):
    """Ids of texts; the ids of a piece are remembered, pieces met since the last renewal longer."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick

        super().__init__()
        self.ranks = read_ranks(path)
        self.cut = cutter(pattern)
        size = max(self.ranks.values()) + 1
        self.token = [b""] * size
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.decimal = [str(i).encode() for i in range(size)]
        self.find = ahocorasick.Automaton()
        self.halves: dict[int, list[int]] = {}  # what a token's last merge joined; none for bytes
        for token, rank in self.ranks.items():
            parts = merged(token, self.ranks, rank)
            if len(parts) == 2:
                self.halves[rank] = parts
            if len(parts) == 2 or len(token) == 1:  # others are no result of merges
                self.find.add_word(token.decode("latin-1"), rank)
        self.find.make_automaton()
        self.fits: dict[int, bool] = {}
        self.older: dict[str, bytes] = {}

    def fit(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        if (found := self.fits.get(pair)) is None:
            if len(self.fits) >= CACHED_PAIRS:
                self.fits.clear()
            found = self.fits[pair] = self.stay_apart(left, right)
        return found

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether BPE of two tokens' bytes never merges across their border.

        Goes back through the merges that made the two: at each moment the border has a last
        part of the left and a first part of the right token, which would have been
        joined if that has a lesser rank than the merge that took either away. Of equal
        ranks the merge farther left comes first.
        """
        left_until = right_until = 1 << 60
        while True:
            across = self.ranks.get(self.token[left] + self.token[right])
            if across is not None and across < left_until and across <= right_until:
                return False
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:  # the left token was made later
                left_until, left = left, a[1]
            else:
                right_until, right = right, b[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        letters = piece.decode("latin-1")
        ids = [rank for _, rank in self.find.iter_long(letters)]  # the longest token at each step
        if all(map(self.fit, ids, ids[1:])):
            return ids
        starts: list[list[int]] = [[] for _ in piece]
        for end, rank in self.find.iter(letters):
            starts[end + 1 - len(self.token[rank])].append(rank)  # shorter ones come first
        given_up = bytearray(len(piece) + 1)
        ids = []
        tried = [len(starts[0])]  # how many of the matches at each open position are left
        at = 0
        while at < len(piece):
            left = tried[-1]
            while left:
                left -= 1
                token = starts[at][left]
                end = at + len(self.token[token])
                if not given_up[end] and (not ids or self.fit(ids[-1], token)):
                    tried[-1] = left
                    ids.append(token)
                    at = end
                    tried.append(len(starts[at]) if at < len(piece) else 0)
                    break
            else:
                given_up[at] = 1
                tried.pop()
                at -= len(self.token[ids.pop()])
        return ids

    def __missing__(self, piece: str) -> bytes:
        code = self.older.get(piece)
        if code is None:
            ids = self.encode_piece(piece.encode())
            code = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_CACHED:
            self[piece] = code
        return code

    def encode(self, text: str) -> np.ndarray:
        if len(self) > CACHED_PIECES // 2:
            self.older = dict(self)
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, self.cut(text))), "<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def encoder_for(path: str, pattern: str) -> Encoder:
    return only(("bpe", path, pattern), lambda: Encoder(path, pattern))


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, token_ids (array<int>) and decoded (binary) of each row of docs.

    Null and empty texts have no ids and decode to nothing; ids, null ones and
    repeated ones too, pass through; only the two named columns are read. There is no
    shuffle, and a task holds one text's ids at a time besides its bounded memories.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                ids = [encoder.encode(text) for text in part.column(1).to_pylist()]
                back = [encoder.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.binary())], ["id", "token_ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(released(run), f"id {type_of(docs, id_col)}, token_ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256: digests of encode_documents(), made in the same pass."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(ranks, pattern)
        for batch in batches:
            sizes, digests, back = [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py()).tolist()
                sizes.append(len(ids))
                digests.append(hashlib.sha256(b" ".join(map(encoder.decimal.__getitem__, ids))).hexdigest())
                back.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(released(run), f"id {type_of(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def tokenised(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, ids_sha256, decoded_sha256 of each row of docs."""
    ids = encode_documents(docs, ranks, pattern)
    said = F.array_join(F.transform("token_ids", lambda i: i.cast("string")), " ")
    return ids.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2(said, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
