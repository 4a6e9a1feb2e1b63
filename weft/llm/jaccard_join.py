"""N-gram Jaccard join by parity sketches.

A document's set is its distinct five-word shingles. Two documents link when
100 * |intersection| >= 80 * |union|; then the symmetric difference D is at most
(|A| + |B|) / 9 and the smaller set has at least 0.8 of the larger one's size.

Sketches. Each shingle is put into one of N parts by its hash and XORed into that
part. A shingle that is in one set alone changes one part at most, so the number
of differing parts is a lower bound of D. With N = D_max + 1 parts for a band of
sizes (bands are such that linked sets are in one or in two neighbours),
linked sets agree in one part at least, and documents are joined on their
parts' values. Parts with fewer than two shingles say too little and aren't
joined on. So that no link depends on them, small sets are split several times with
other hashes, and of a large set's parts 48 are used, of which more than a third
are expected to agree: at the threshold itself a pair misses all of its 48 or
more keys with a probability below 1e-8, above it by far less.

A second parity sketch of 1024 bits, each shingle flipping one of them, has a
Hamming distance that is a lower bound of D as well: pairs that it puts beyond
the limit are dropped. The others are verified on their full sets.

Components. Equal sets are one node. Within each key, nodes in order of hash are first
linked to their neighbour only, so a group of any size costs as many pairs as it has
members. What these links join is contracted. Then all pairs of a key whose nodes are in
different components are tried. A key with more than BLOCK nodes in several components is
split by a second key before that, so there a pair with no other common key isn't tried: at the threshold,
with a third of 48 keys agreeing, that has a probability below 1e-7. No other key holds an untried pair
that could change a component.

Links. Both ends of a link are in one component, so all links are counted within components:
each is dealt out in pairs of blocks of bounded size, and the intersections of a pair of
blocks are one product of 0/1 matrices over the shingles that both hold. What leaves a task
is one count for each node, never a pair, and no link of a component is missed.

`exact` joins on all parts of one split, also on those with one shingle or none, and never by a second key:
then pigeonhole holds without exception, at the price of keys that whole size bands share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import gathered, keyed, released, remove, ship, stored, table, text_of, type_of, without
from weft.llm.components import components
from weft.llm.hashing import WordHasher, byte_table, constants, mix, run_hashes

SHINGLE = 5
PARTS = 48
SKETCH_WORDS = 16
#: Nodes of a key that one task compares with each other, and how often larger keys are split by another key.
BLOCK, SPLITS = 4096, 2
#: Names of nodes that may be broadcast: 40 bytes each in a hash table, 40 MB at most.
BROADCAST_NODES = 1_000_000
#: Documents whose keys one task takes.
DOCS_A_TASK = 50_000
#: A component's nodes are counted in blocks of a 64th of them, within these limits and so many bytes of sets;
#: and shingles in one product.
LINK_BLOCKS, LINK_BYTES, COLUMNS = (256, 2048), 1 << 23, 2048
#: Sets that a task remembers to have sent.
SENT = 100_000
#: Most bits of the table that tells which rows' sets are needed: 64 MB.
NEEDED_BITS = 1 << 29
_SALT = constants(11, 256)
_HASHER: list[WordHasher] = []


def hasher() -> WordHasher:
    if not _HASHER:
        _HASHER.append(WordHasher(~byte_table((0x20, 0x20), (0x09, 0x0D))))
    return _HASHER[0]


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles, one text after another and in order, and how many each has."""
    sizes, parts = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint64)]
    for row, words in enumerate(hasher().words(texts)):
        if len(words):
            found = np.sort(run_hashes(words, min(SHINGLE, len(words))))
            first = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=first[1:])
            parts.append(found[first])
            sizes[row] = len(parts[-1])
    return np.concatenate(parts), sizes


def size_bounds(most: int) -> list[int]:
    """Where size bands begin; each ends at 1.25 times its beginning or later."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 5 // 4)))
    return bounds


BOUNDS = np.array(size_bounds(1 << 40), np.int64)


def part_keys(shingles: np.ndarray, sizes: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(key, text's row): the sketch parts that texts are joined on, in both pairs of size bands."""
    band = np.searchsorted(BOUNDS, sizes, "right") - 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for up in (0, 1):
        group = band + up
        high = BOUNDS[group + 1] - 1
        parts = 2 * high // 9 + 1  # one part: only equal sets link, and these are one node
        some = (sizes > 0) & (parts > 1)
        turns = np.where(some, 1 if exact else -(-PARTS // parts), 0)
        most = int(parts[some].max(initial=0)) if exact else PARTS
        for turn in range(int(turns.max(initial=0))):
            own = (turns > turn)[row]
            r = row[own]
            h = mix(shingles[own] ^ _SALT[turn])
            p = (h % parts[r].astype(np.uint64)).astype(np.int64)
            used = p < most
            r, p, h = r[used], p[used], mix(h[used])
            slot = r * most + p
            value = np.zeros(len(sizes) * most, np.uint64)
            np.bitwise_xor.at(value, slot, h)
            if exact:
                full = np.flatnonzero(some[:, None] & (np.arange(most) < parts[:, None]))
            else:
                full = np.flatnonzero(np.bincount(slot, minlength=len(value)) >= 2)
            tag = ((group[full // most] * 64 + turn) << 40) + full % most
            keys.append(mix(value[full] ^ mix(tag.astype(np.uint64))))
            rows.append(full // most)
    return np.concatenate(keys), np.concatenate(rows)


def parity_sketches(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text 1024 bits, as 16 numbers: each shingle flips one."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    bit = mix(shingles ^ _SALT[255])
    out = np.zeros(len(sizes) * SKETCH_WORDS, np.uint64)
    np.bitwise_xor.at(out, row * SKETCH_WORDS + ((bit >> np.uint64(6)) % np.uint64(SKETCH_WORDS)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(len(sizes), SKETCH_WORDS)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))


def marks_of(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 for empty ones."""
    some, at = sizes > 0, np.cumsum(sizes) - sizes
    mark, check = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
    if some.any():
        mark[some] = mix(np.add.reduceat(mix(shingles), at[some]) ^ sizes[some].astype(np.uint64))
        check[some] = np.bitwise_xor.reduceat(mix(shingles ^ _SALT[254]), at[some])
    return mark.view(np.int64), check.view(np.int64)


def _profiles(exact: bool):
    """Rows (id, text, h) to what is known of each: a number of its own, its set's size and marks, sketch and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        step = 16 if exact else 512
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                shingles, sizes = shingle_sets([t.encode() for t in batch.column(1).to_pylist()])
                mark, check = marks_of(shingles, sizes)
                keys, rows = part_keys(shingles, sizes, exact)
                first = np.zeros(len(sizes), bool)
                first[np.unique(np.stack([mark, check], 1), axis=0, return_index=True)[1]] = True  # a copy in the same batch brings no keys
                keys, rows = keys[first[rows]], rows[first[rows]]
                order = np.argsort(rows, kind="stable")
                sketch = parity_sketches(shingles, sizes)
                columns = [pa.array(np.arange(number, number + len(sizes))), pa.array(sizes, pa.int64()), pa.array(mark), pa.array(check), batch.column(2)]
                lists = [_lists(sketch.ravel(), np.full(len(sizes), SKETCH_WORDS)), _lists(keys[order], np.bincount(rows, minlength=len(sizes)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *lists], ["id", "row", "n", "mark", "check", "h", "sketch", "keys"])
                number += len(sizes)

    return run


def _key_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) in order: those of keys with two nodes or more, with the node before in the key.

    A stream: what is held is one batch and the row before it.
    """
    last: tuple[int, int, int | None, bool] | None = None  # key, node, node before, whether it was given out

    def given(rows: list[tuple]) -> pa.RecordBatch:
        key, node, before = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(node, pa.int64()), pa.array(before, pa.int64())], ["key", "node", "before"])

    for batch in batches:
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if last is not None:
            key, node = np.concatenate([[last[0]], key]), np.concatenate([[last[1]], node])
        same = np.flatnonzero((key[1:] == key[:-1]) & (node[1:] != node[:-1])) + 1  # rows with another node before them
        rows = []
        start = 0 if last is None else 1
        for i in same.tolist():
            j = i - 1
            while j > 0 and key[j - 1] == key[i] and node[j - 1] == node[j]:  # repeated rows
                j -= 1
            if j == 0 or key[j - 1] != key[i]:  # the first of its key
                if not (start and j == 0 and last[3]):
                    rows.append((key[j], node[j], None))
            rows.append((key[i], node[i], node[i - 1]))
        if len(key):
            end = len(key) - 1
            while end > 0 and key[end - 1] == key[end] and node[end - 1] == node[end]:
                end -= 1
            out = bool(len(same)) and same[-1] == end
            if start and end == 0:
                out = last[3]
            last = int(key[-1]), int(node[-1]), None, out
        if rows:
            yield given(rows)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
            both = len(np.intersect1d(a, b, assume_unique=True))
            good.append(100 * both >= 80 * (len(a) + len(b) - both))
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, label, n, sketch) in order of key: the pairs within a key that labels divide and a link allows."""
    held: list[pa.RecordBatch] = []

    def pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, label, n = (rows.column(k).to_numpy() for k in (1, 2, 3))
        sketch = np.stack(rows.column(4).to_numpy()).view(np.uint64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(node) - 1):
            j = np.flatnonzero((label[i + 1 :] != label[i]) & (5 * np.minimum(n[i], n[i + 1 :]) >= 4 * np.maximum(n[i], n[i + 1 :]))) + i + 1
            if len(j):
                distance = np.bitwise_count(sketch[j] ^ sketch[i]).sum(1)
                j = j[distance * 9 <= n[j] + n[i]]
                a.append(np.minimum(node[i], node[j]))
                b.append(np.maximum(node[i], node[j]))
        return np.concatenate(a), np.concatenate(b)

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        rows = pa.Table.from_batches(held)
        key = rows.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        for start, end in zip(cuts, cuts[1:]):
            a, b = pairs(rows.slice(start, end - start))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        held.clear()

    for batch in batches:  # a key's rows are held together; whole keys before the last are done
        key = batch.column(0).to_numpy()
        if held and len(key) and held[-1].column(0)[held[-1].num_rows - 1].as_py() != key[0]:
            yield from flush()
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last:
            held.append(batch.slice(0, last))
            yield from flush()
        held.append(batch.slice(last))
    yield from flush()


def _sets(table_of: bytes, bits: int):
    """Rows (text, h) to (n, mark, check, shingles) for the rows that the bit table says are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(table_of, np.uint8)
        sent: set[bytes] = set()  # copies of a text are sent once, as far as a bounded memory tells
        for whole in batches:
            h = whole.column(1).to_numpy()
            whole = whole.filter(pa.array((flags[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1))
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                shingles, sizes = shingle_sets([t.encode() for t in batch.column(0).to_pylist()])
                mark, check = marks_of(shingles, sizes)
                ends = np.cumsum(sizes)
                new = np.zeros(len(sizes), bool)
                for i, name in enumerate(map(bytes, np.stack([mark, check], 1))):
                    new[i] = name not in sent
                    sent.add(name)
                if len(sent) > SENT:
                    sent.clear()
                sets = pa.array([shingles[e - n : e].tobytes() for e, n in zip(ends[new], sizes[new])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(sizes[new], pa.int64()), pa.array(mark[new]), pa.array(check[new]), sets], ["n", "mark", "check", "shingles"])

    return run


def intersections(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """How many shingles each set of a shares with each of b; the sets stand one after another."""
    shape = len(a_sizes), len(b_sizes)
    out = np.zeros(shape, np.int64)
    shared = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    if not len(shared):
        return out

    def placed(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingle's number, set), by number."""
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        good = shared[at] == flat
        number, row = at[good], np.repeat(np.arange(len(sizes)), sizes)[good]
        order = np.argsort(number, kind="stable")
        return number[order], row[order]

    (x, x_row), (y, y_row) = placed(a, a_sizes), placed(b, b_sizes)
    nx, ny = np.bincount(x, minlength=len(shared)), np.bincount(y, minlength=len(shared))
    dense = nx * ny > out.size // 256  # a column of the product is cheaper than its pairs
    for columns, used in ((np.flatnonzero(dense), True), (np.flatnonzero(~dense), False)):
        if used:
            place = np.full(len(shared), -1)
            place[columns] = np.arange(len(columns))
            px, py = place[x], place[y]
            for low in range(0, len(columns), COLUMNS):
                width = min(COLUMNS, len(columns) - low)
                left, right = np.zeros((shape[0], width), np.float32), np.zeros((shape[1], width), np.float32)
                for p, rows, matrix in ((px, x_row, left), (py, y_row, right)):
                    here = (p >= low) & (p < low + width)
                    matrix[rows[here], p[here] - low] = 1
                out += (left @ right.T).astype(np.int64)
        elif len(columns):
            sx, sy = np.cumsum(nx) - nx, np.cumsum(ny) - ny
            pairs = np.cumsum(nx[columns] * ny[columns])
            for low in range(0, int(pairs[-1]), 1 << 20):
                k = np.arange(low, min(low + (1 << 20), int(pairs[-1])))
                c = np.searchsorted(pairs, k, "right")
                inner = k - (pairs[c] - nx[columns[c]] * ny[columns[c]])
                i = x_row[sx[columns[c]] + inner // ny[columns[c]]]
                j = y_row[sy[columns[c]] + inner % ny[columns[c]]]
                out += np.bincount(i * shape[1] + j, minlength=out.size).reshape(shape)
    return out


def _link_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, x, y, side, node, copies, shingles) in order: for each node the copies of its links in the pair of blocks."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        side, node, copies = (rows.column(k).to_numpy() for k in (3, 4, 5))
        sizes = pc.binary_length(rows.column(6)).to_numpy() // 8
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column(6)]
        one = int((side == 0).sum())
        same = rows.column(1)[0].as_py() == rows.column(2)[0].as_py()
        held.clear()
        cuts = (slice(0, one), slice(0, one)) if same else (slice(0, one), slice(one, len(side)))
        a, b = cuts
        if not sizes[b].size or not sizes[a].size:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], ["node", "links"])
        both = intersections(np.concatenate(sets[a]), sizes[a], np.concatenate(sets[b]), sizes[b])
        linked = 100 * both >= 80 * (sizes[a][:, None] + sizes[b][None, :] - both)
        if same:
            np.fill_diagonal(linked, False)
        found = [(node[a], linked @ copies[b])]
        if not same:
            found.append((node[b], copies[a] @ linked))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in (0, 1)], ["node", "links"])

    for batch in batches:
        key = np.stack([batch.column(k).to_numpy() for k in (0, 1, 2)])
        if held and batch.num_rows and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != key[k, 0] for k in (0, 1, 2)):
            yield flush()
        cuts = [0, *(np.flatnonzero((np.diff(key, axis=1) != 0).any(0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if start:
                yield flush()
            if end > start:
                held.append(batch.slice(start, end - start))
    if held:
        yield flush()


def _within(a: str, b: str) -> Column:
    """Whether sizes and sketches of two nodes allow a link."""
    n = F.col(f"{a}_n") + F.col(f"{b}_n")
    distance = F.aggregate(F.zip_with(f"{a}_sketch", f"{b}_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    least, most = F.least(f"{a}_n", f"{b}_n"), F.greatest(f"{a}_n", f"{b}_n")
    return (least * 5 >= most * 4) & (distance * 9 <= n)


class _Join:
    """One run of the join: the documents, their nodes and the pairs that were tried.

    A node is a distinct set; its name is the number of one of its rows, so no two have the same.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, exact: bool):
        self.spark = docs.sparkSession
        ship(self.spark)
        self.exact, self.passing = exact, []
        self.rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
        schema = f"id {type_of(docs, id_col)}, row long, n long, mark long, check long, h long, sketch array<long>, keys array<long>"
        self.profiles = stored(self.rows.mapInArrow(released(_profiles(exact)), schema), "profiles")
        classes = self.profiles.filter("n > 0").groupBy("mark", "n", "check").agg(F.min("id").alias("class_id"), F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"))
        self.classes = stored(classes, "classes")
        few = self.classes.count() <= BROADCAST_NODES
        names = self.classes.select(F.col("node").alias("row")).hint("broadcast" if few else "merge")
        #: One row for each node, whatever copies it has, before anything is made of its keys.
        self.nodes = self.profiles.join(names, "row", "left_semi").withColumnRenamed("row", "node")
        self.parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.profiles.count() // DOCS_A_TASK)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name, self.passing)

    def keyed(self, rows: DataFrame) -> DataFrame:
        rows = rows.repartition(self.parts, "key").sortWithinPartitions("key", "node")
        return self.stored(gathered(rows.mapInArrow(released(_key_groups), "key long, node long, before long")), "keys")

    def described(self, keys: DataFrame) -> DataFrame:
        """node, n, h and sketch of the nodes of some keys."""
        return self.stored(self.nodes.select("node", "n", "h", "sketch").join(keys.select("node").distinct(), "node", "left_semi"), "nodes")

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """node, shingles: the full sets of some nodes.

        A bit table of bounded size, built by Spark's bitmap aggregates, tells the scan which texts
        may be needed, so that texts aren't shuffled and only these rows' sets are.
        """
        needed = self.stored(self.classes.select("mark", "n", "check", "node").join(nodes.select("node", "h"), "node"), "needed")
        bits = min(NEEDED_BITS, max(1 << 15, 1 << (16 * needed.count()).bit_length()))
        place = F.pmod("h", F.lit(bits))
        marked = needed.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("flags"))
        flags = bytearray(bits // 8)
        for row in marked.collect():  # bits / 8 bytes at most
            flags[(row.bucket - 1) * 4096 : row.bucket * 4096] = row.flags
        found = self.rows.select("text", place.alias("h")).mapInArrow(released(_sets(bytes(flags), bits)), "n long, mark long, check long, shingles binary")
        # copies bring one set more than once
        return self.stored(found.join(needed, ["mark", "n", "check"]).select("node", "shingles").dropDuplicates(["node"]), "sets")

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets link."""
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        return self.stored(gathered(both.select("a", "b", "x", "y").mapInArrow(released(_verified), "a long, b long")), "links")

    def neighbours(self, keys: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs of nodes that follow each other in a key, as far as size and sketch allow."""
        pairs = keys.filter("before is not null").select(F.least("before", "node").alias("a"), F.greatest("before", "node").alias("b")).distinct()
        a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch")) for x in "ab")
        return self.stored(pairs.join(a, "a").join(b, "b").filter(_within("a", "b")).select("a", "b"), "pairs")

    def across(self, keys: DataFrame, nodes: DataFrame, labels: DataFrame, tried: DataFrame) -> DataFrame:
        """Pairs of one key in different components, as far as size and sketch allow, that weren't tried."""
        found, level, splits = None, keys.select("key", "node"), 0 if self.exact else SPLITS
        for split in range(splits + 1):
            rows = level.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
            sizes = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("size")).filter("x <> y").select("key", "size")
            rows = self.stored(rows.join(sizes, "key"), "mixed")
            large = rows.filter(F.col("size") > BLOCK)
            last = split == splits or large.isEmpty()
            if split == splits:  # what is still large is compared by all pairs of its blocks
                n = F.ceil(F.col("size") / (BLOCK // 2)).cast("int")
                own = F.pmod(F.xxhash64("node"), n).cast("int")
                other = F.explode(F.sequence(F.lit(0), n - 1)).alias("_o")
                blocks = large.select("key", "node", "label", own.alias("_b"), other)
                blocks = blocks.select(F.xxhash64("key", F.least("_b", "_o"), F.greatest("_b", "_o")).alias("key"), "node", "label")
                rows = rows.filter(F.col("size") <= BLOCK).select("key", "node", "label").unionByName(blocks)
            else:
                rows = rows.filter(F.col("size") <= BLOCK).select("key", "node", "label")
            pairs = rows.join(nodes, "node").select("key", "node", "label", "n", "sketch").repartition(self.parts, "key").sortWithinPartitions("key").mapInArrow(released(_crossed), "a long, b long")
            found = pairs if found is None else found.unionByName(pairs)
            if last:
                break
            other = keys.select(F.col("key").alias("_key"), "node")
            level = large.select("key", "node").join(other, "node").filter("key <> _key").select(F.xxhash64("key", "_key").alias("key"), "node")
            level = self.keyed(level).select("key", "node")
        return self.stored(found.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")

    def degrees(self, labels: DataFrame, sets: DataFrame) -> DataFrame:
        """node, links: to how many rows of other nodes each node links, by blocks of its component."""
        members = labels.join(self.classes.select("node", "n", "copies"), "node")
        least, most = LINK_BLOCKS
        size = F.least(F.lit(most), F.greatest(F.lit(least), F.col("m") / 64), F.greatest(F.lit(1), F.lit(LINK_BYTES // 8) / F.col("most")))
        groups = members.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("most"), F.sum("copies").alias("rows"))
        groups = groups.select("label", "m", "rows", F.ceil(F.col("m") / F.floor(size)).cast("int").alias("blocks"))
        members = members.join(groups, "label")
        two = members.filter("m = 2").select("node", (F.col("rows") - F.col("copies")).alias("links"))
        own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
        dealt = members.filter("m > 2").join(sets, "node").select("label", "node", "copies", "shingles", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        x, y = F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
        dealt = dealt.select("label", x, y, (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "copies", "shingles")
        dealt = dealt.repartition(self.parts, "label", "x", "y").sortWithinPartitions("label", "x", "y", "side")
        counted = dealt.mapInArrow(released(_link_counts), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
        return stored(two.unionByName(counted), "degrees")

    def run(self, count: bool = True) -> tuple[DataFrame, DataFrame | None]:
        """node, label and, if they are to be counted, node, links of the nodes that some link touches."""
        keys = self.keyed(self.nodes.select(F.explode("keys").alias("key"), "node"))
        nodes = self.described(keys)
        sets = self.sets_of(nodes)
        tried = self.neighbours(keys, nodes)
        links = self.linked(tried, sets)
        labels = components(links)
        more = self.linked(self.across(keys, nodes, labels, tried), sets)
        labels = labels if more.isEmpty() else components(links.unionByName(more))
        degrees = self.degrees(labels, sets) if count else None
        remove(self.passing)
        return labels, degrees

    def named(self, labels: DataFrame) -> DataFrame:
        """The classes with label and component_id: the smallest id of each component."""
        found = self.classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        return found.join(found.groupBy("label").agg(F.min("class_id").alias("component_id")), "label")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """id, n_shingles, component_id, class_id, n_links; one row out for each row in.

    class_id is the smallest id with an equal set, component_id the smallest that links
    reach, n_links the number of other rows that link with the row, copies among them. A text
    without words, also a null or empty one, has no shingles and is a
    component by itself; one of fewer than five words has one shingle. Ids are of any type
    that has an order. Rows without id take part in classes, links and components, but give them
    no name; repeated rows are copies; an empty table gives no rows; only the two named
    columns are read.
    """
    join = _Join(docs, id_col, text_col, exact)
    labels, degrees = join.run()
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    named = join.named(labels).join(degrees, "node", "left").select("mark", "n", "check", "class_id", "component_id", links.alias("n_links"))
    out = join.profiles.select("id", "n", "mark", "check").join(named, ["mark", "n", "check"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of docs for each component, with all its columns: that with the smallest id.

    Rows without id come last; of equal ids the first by file and place stays. Rows are told
    apart by their place, so null and repeated ids are no matter.
    """
    docs, key = keyed(docs)
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(f"{key}.file").alias("file"), F.col(f"{key}.place").alias("place"))
    join = _Join(docs.select(order.alias("id"), F.col(text_col).alias("text")), "id", "text", False)
    labels, _ = join.run(count=False)  # no row stays or goes by its number of links
    named = join.named(labels).select("mark", "n", "check", "component_id")
    return without(docs, key, join.profiles.join(named, ["mark", "n", "check"]).filter("id <> component_id").select("id"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT *, least(5, len(w)) AS n FROM w WHERE len(w) > 0))
), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM i JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)
), reach AS (
  SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
), m AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
eq AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY l) AS class_id FROM (SELECT doc_id, list(s ORDER BY s) AS l FROM s GROUP BY doc_id))
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id, coalesce(eq.class_id, w.doc_id) AS class_id, coalesce(g.n, 0) AS n_links
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN m ON m.x = w.doc_id LEFT JOIN eq ON eq.doc_id = w.doc_id
  LEFT JOIN (SELECT x, count(*) AS n FROM link GROUP BY x) g ON g.x = w.doc_id
"""
