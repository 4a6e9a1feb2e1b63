"""Token files: ids packed at a fixed number of bits, in blocks with offsets.

A token file set is a folder that Spark's committer writes, so a task that is run
again replaces its own output and any store that Spark reaches will do:

- ``blocks``: one row for each block: ``part``, ``block``, ``first`` (ids before it in
  its part), ``n_ids``, ``bits``, ``doc_ids``, ``offsets`` (where each document begins in
  the block, with the end) and ``payload`` (the packed ids). Documents are whole
  within a block and ascend by id through blocks and parts.
- ``parts``: ``part``, ``start`` (ids before the part) and ``n_ids``.

All ids take the least bits that hold the vocabulary, so id i of a block begins
at bit i * bits: a reader needs no earlier id to unpack a range.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import new_path, only, released, ship, table, text_of
from weft.llm.pretokenize import cutter

BLOCK_IDS = 1 << 16
CACHED_PIECES = 400_000
#: Longer pieces aren't remembered, so that the memory is bounded in bytes.
LONGEST_CACHED = 64
#: Parts at most; the driver keeps one number for each.
MOST_PARTS = 1 << 20
#: Bytes of input, as stored, that one part encodes.
PART_BYTES = 32 << 20
BLOCKS = "part int, block long, first long, n_ids long, bits int, doc_ids array<long>, offsets array<long>, payload binary"
VOCABULARY = "byte_bpe_50k.json"


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids, each in so many bits, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for at in range(0, len(ids), BLOCK_IDS):  # whole bytes: BLOCK_IDS is a multiple of 8
        part = ids[at : at + BLOCK_IDS].astype(np.uint32)
        flags = (part[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
        out.append(np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a packed block; only their bytes are looked at."""
    if bits in (8, 16, 32):
        width = bits // 8
        return np.frombuffer(payload, f"<u{width}", stop - start, start * width).astype(np.uint32)
    first = start * bits // 8
    raw = np.frombuffer(payload, np.uint8)[first : (stop * bits + 7) // 8]
    flags = np.unpackbits(raw, bitorder="little")[start * bits - first * 8 :][: (stop - start) * bits]
    weights = (np.uint32(1) << np.arange(bits, dtype=np.uint32)).astype(np.uint32)
    return flags.reshape(-1, bits).astype(np.uint32) @ weights


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the letters from
    256 on, in order.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class Pieces(dict):
    """Ids of a text by the tokenizers library; the ids of a piece are remembered.

    The vocabulary merges within the pieces that the pre-tokeniser's pattern cuts,
    so the ids of a text are those of its pieces, and the library's model is asked
    for each piece that isn't known. Half of the memory is renewed when it is full:
    pieces met since the last renewal stay.

    Added tokens ('<|endoftext|>') come first, as in the library: a text is split at
    them, and the pattern cuts the stretches between. Where a token also takes
    spaces or whole words alone, texts that may hold one are left to the library.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.cut = cutter(pattern)
        self.letters = byte_letters()
        self.tokenize = self.tokenizer.model.tokenize
        self.older: dict[str, bytes] = {}
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: struct.pack("<I", i) for i, t in added.items() if t.content}
        self.simple = self.tokenizer.normalizer is None and len({t.normalized for t in added.values()}) < 2 and not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        #: The leftmost token and of those the longest.
        self.split = re.compile("(%s)" % "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))).split

    def __missing__(self, piece: str) -> bytes:
        code = self.older.get(piece)
        if code is None:
            ids = [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
            code = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_CACHED:
            self[piece] = code
        return code

    def encode(self, text: str) -> np.ndarray:
        if len(self) > CACHED_PIECES // 2:
            self.older = dict(self)
            self.clear()
        if any(t in text for t in self.added):
            if not self.simple:
                return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
            parts = self.split(text)  # stretches at even places, tokens between
            return np.frombuffer(b"".join(self.added[x] if i % 2 else b"".join(map(self.__getitem__, self.cut(x))) for i, x in enumerate(parts)), "<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, self.cut(text))), "<u4")


def pieces_for(path: str, pattern: str) -> Pieces:
    return only(("pieces", path, pattern), lambda: Pieces(path, pattern))


def _blocks(path: str, pattern: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), pieces_for(path, pattern)
        bits, end = bits_for(max(encoder.vocabulary, end_id + 1)), np.array([end_id], "<u4")
        block = first = held = 0
        ids: list[np.ndarray] = []
        docs: list = []

        def flush() -> pa.RecordBatch:
            nonlocal block, first, held, ids, docs
            offsets = np.cumsum([0, *(len(x) for x in ids)])
            made = pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "block": pa.array([block], pa.int64()),
                    "first": pa.array([first], pa.int64()),
                    "n_ids": pa.array([int(offsets[-1])], pa.int64()),
                    "bits": pa.array([bits], pa.int32()),
                    "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                    "offsets": pa.array([offsets.tolist()], pa.list_(pa.int64())),
                    "payload": pa.array([pack(np.concatenate(ids), bits)], pa.binary()),
                }
            )
            block, first, held, ids, docs = block + 1, first + int(offsets[-1]), 0, [], []
            return made

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                ids.append(np.concatenate([encoder.encode(text.as_py()), end]))
                docs.append(key.as_py())
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def stored_bytes(df: DataFrame) -> int:
    """The size that Spark's statistics give a table: of files their bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int = 0, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs and write them as a token file set, in ascending order of id.

    Text is dealt out by ranges of the id before it is encoded, so that each text is
    encoded once. What the driver keeps is one count for each part.

    Null text is empty and gives the end id alone; rows without id come first; rows
    with one id follow each other in the order of their texts' hashes; an empty table
    gives no blocks.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, stored_bytes(docs) // PART_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(released(_blocks(tokenizer, pattern, end_id)), BLOCKS).write.parquet(f"{path}/blocks")
    counts = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    table_of_parts, start = [], 0
    for row in sorted(counts.collect()):
        table_of_parts.append((row.part, start, row.n))
        start += row.n
    spark.createDataFrame(table_of_parts, "part int, start long, n_ids long").coalesce(1).write.parquet(f"{path}/parts")


def _with_starts(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with their start in the whole; the parts are as few as files were written."""
    parts = spark.read.schema("part int, start long, n_ids long").parquet(f"{path}/parts").select("part", "start")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("first"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
            ends = np.array(row["offsets"], np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(ends[:-1] + row["start"], pa.int64()),
                    "n_tokens": pa.array(np.diff(ends), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])], pa.int64()),
                }
            )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    ship(spark)
    rows = _with_starts(spark, path).select("start", "n_ids", "bits", "doc_ids", "offsets", "payload")
    return rows.mapInArrow(released(_documents), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of the whole; only the blocks that hold them are read."""
    rows = _with_starts(spark, path).filter((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    found = []
    for row in rows.select("start", "n_ids", "bits", "payload").orderBy("start").toLocalIterator():
        a, b = max(start - row.start, 0), min(stop - row.start, row.n_ids)
        found.append(unpack(bytes(row.payload), row.bits, a, b))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return read_digests(spark, path)
