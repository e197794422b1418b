"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints of 64 bits link when at most ``distance`` bits differ. The anchors are the words of a covering code: the binary
Golay code on bits 0-22 and again on bits 23-45, each of covering radius 3, and the code of a single word on the other 18
bits, of covering radius 18. Each fingerprint has one home: in each block the code word within the radius, of which there is
exactly one as the Golay code is perfect. If x and y differ in e1, e2 and e3 bits of the blocks, then y is within 3 + e1 and
3 + e2 of the home of x. So a fingerprint is copied to its home and to all anchors whose distances exceed the radius by
``distance`` bits in total at most (61 on average for 2 bits), and at each anchor those at home are compared with all others.

Equal fingerprints are one before all that. At an anchor only links between different fingerprints are found; a task passes
on a tree for each set of them that hangs together, not all pairs. An anchor with very many copies is split into pairs of
parts, which changes where rows are compared, not which.

``near_duplicates`` is this, on shingles of three words; ``near_copies`` finds texts of a similarity of 0.8 or more;
``near_groups`` has the groups that the links of both make.

Null, empty and wordless texts have fingerprint zero, and are linked like any other. Repeated rows all stay. Rows without id
count where a component has no other. Of further columns nothing is read. No document: no rows.
"""

from __future__ import annotations

import itertools
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radquery.llm.components import components
from radquery.llm.shared import AtomicFile, new_dir, open_mapped, tasks_for, write_table
from radquery.llm.words import gather, mix, slices, split_flat, texts_of

#: Generator polynomial of the Golay code of length 23.
GOLAY, LENGTH, CHECK_BITS, RADIUS = 0xC75, 23, 11, 3
#: Anchors of a fingerprint on average, at two bits.
COPIES = 61
#: Rows at an anchor beyond which they are split.
HOT_ROWS = 50_000
PAIRS_AT_ONCE = 1 << 20
SLICE_BYTES = 2 << 20
#: Of ``near_copies``: bands of smallest hashes and hashes in each, bits that compare shingles, and how many of them may differ
#: in pairs that are compared exactly.
BANDS, BAND_HASHES, SKETCH_BITS, SKETCH_DIFFERENCE = 24, 3, 192, 40
#: Nodes whose links a task remembers, to compare none exactly that hang together already.
KNOWN_NODES = 1 << 20
#: Rows at an anchor beyond which leaders come first, and how many.
LEADER_ROWS, LEADERS = 64, 8


def hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 with seed 42 of all shingles of lower-case words, and their offsets by text."""
    flat, offsets = split_flat(pc.ascii_lower(texts_of(texts)))
    words = np.diff(offsets)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat), " ")
    data = b"".join(joined.cast(pa.binary()).to_pylist())
    length = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(words)), words)
    blanks = np.arange(len(flat)) - np.cumsum(words > 0)[text] + 1  # a blank after each word before, but none at a text's end
    starts = np.cumsum(length) - length + blanks
    counts = np.where(words > 0, np.maximum(1, words - shingle + 1), 0)
    first = gather(np.arange(len(flat)), offsets[:-1], counts)
    last = np.minimum(first + shingle - 1, np.repeat(offsets[1:] - 1, counts))
    digest = xxhash.xxh64_intdigest
    out = np.fromiter((digest(data[a:b], 42) for a, b in zip(starts[first].tolist(), (starts + length)[last].tolist(), strict=True)), np.uint64, len(first))
    return out, np.concatenate(([0], np.cumsum(counts)))


def fingerprint(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, the bits that over half of its values have."""
    n, block = np.diff(offsets), 1 << 16
    text = np.repeat(np.arange(len(n)), n)
    ones = np.zeros((len(n), 64), dtype=np.int64)
    for at in range(0, len(values), block):
        bits = np.unpackbits(values[at : at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = text[at : at + block]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ones[own[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for part in (p for b in batches for p in slices(b, most=SLICE_BYTES)):
            yield pa.record_batch([part.column(0), fingerprint(*hashes(part.column(1), shingle)).view(np.int64)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _remainder(words: np.ndarray) -> np.ndarray:
    """Modulo the generator: zero for code words, and the same for all words of a coset."""
    words = words.copy()
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        words ^= np.where((words >> bit) & 1, GOLAY << (bit - CHECK_BITS), 0)
    return words


@lru_cache
def _cosets(distance: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The pattern of weight 3 at most in each coset, and for each weight above it (starts by coset, patterns)."""
    size, leader, further = 1 << CHECK_BITS, np.zeros(1 << CHECK_BITS, dtype=np.int64), []
    for weight in range(RADIUS + distance + 1):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(LENGTH), weight)], dtype=np.int64)
        coset = _remainder(patterns)
        if weight <= RADIUS:
            leader[coset] = patterns
        else:
            order = np.argsort(coset, kind="stable")
            further.append((np.searchsorted(coset[order], np.arange(size + 1)), patterns[order]))
    return leader, further


def _block_anchors(block: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By excess over the radius: (row, code word's 12 bits) of all code words at that distance."""
    leader, further = _cosets(distance)
    coset = _remainder(block)
    out = [(np.arange(len(block)), (block ^ leader[coset]) >> CHECK_BITS)]
    for starts, patterns in further:
        n = starts[coset + 1] - starts[coset]
        row = np.repeat(np.arange(len(block)), n)
        out.append((row, (block[row] ^ gather(patterns, starts[coset], n)) >> CHECK_BITS))
    return out


def _blocks(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << LENGTH) - 1)
    return (fp & mask).astype(np.int64), ((fp >> np.uint64(LENGTH)) & mask).astype(np.int64)


def home(fp: np.ndarray) -> np.ndarray:
    a, b = (_block_anchors(x, 0)[0][1] for x in _blocks(fp))
    return (a << 12) | b


def anchors(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all anchors that each fingerprint is copied to."""
    left, right = (_block_anchors(x, distance) for x in _blocks(fp))
    rows, found = [], []
    for i, (row, word) in enumerate(left):
        for row2, word2 in right[: distance - i + 1]:
            n = np.bincount(row2, minlength=len(fp))
            starts = np.cumsum(n) - n
            rows.append(np.repeat(row, n[row]))
            found.append((np.repeat(word, n[row]) << 12) | gather(word2, starts[row], n[row]))
    return np.concatenate(rows), np.concatenate(found)


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it hangs together with) for the nodes of these edges that aren't smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for x in (root[a], root[b], a, b):
            np.minimum.at(root, x, low)
        while not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(before, root):
            other = root != np.arange(len(nodes))
            return nodes[other], nodes[root[other]]


def _compare(batches, at_home, near, find=None, center=None):
    """Trees of the links at each anchor, from rows (anchor, part, node, ...) sorted by anchor and part; ``at_home`` and
    ``near`` see lists of columns from the node on.

    With ``find``, which names what a node hangs together with by the links so far, rows are at home everywhere, and an anchor
    with more than LEADER_ROWS rows begins with leaders: the row that ``center`` chooses is compared with all others, then one of
    those that it hasn't reached, and so on. After that only rows that don't hang together are compared, so a group of copies
    costs a few times its rows and not their square."""
    held: list[np.ndarray] = []
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def found(x: list[np.ndarray], y: list[np.ndarray]) -> None:
        linked = near(x, y)
        edges.append((x[0][linked], y[0][linked]))
        if sum(len(e[0]) for e in edges) > PAIRS_AT_ONCE:
            edges[:] = [local_roots(*map(np.concatenate, zip(*edges, strict=True)))]

    def lead(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """An order in which rows that hang together stand together, and where in it those after each row's own begin."""
        left = np.arange(len(columns[0]))
        for _ in range(LEADERS):
            if len(left) < 2:
                break
            own = center([c[left] for c in columns])
            others = np.delete(left, own)
            found([np.repeat(c[left[own]], len(others)) for c in columns], [c[others] for c in columns])
            root = np.array([find(v) for v in columns[0][left].tolist()])
            left = left[root != root[own]]
        root = np.array([find(v) for v in columns[0].tolist()])
        order = np.argsort(root, kind="stable")
        return order, np.searchsorted(root[order], root[order], "right")

    def link(key: np.ndarray, anchor: np.ndarray, columns: list[np.ndarray]) -> None:
        ends = np.searchsorted(key, key, "right") if len(key) else key
        after = np.arange(1, len(key) + 1)  # where those that a row is compared with begin
        if find:
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
            for start in starts[ends[starts] - starts > LEADER_ROWS].tolist():
                end = int(ends[start])
                order, others = lead([c[start:end] for c in columns])
                for c in columns:
                    c[start:end] = c[start:end][order]
                after[start:end] = start + others
        homes = np.flatnonzero(at_home(anchor, columns))
        others = ends[homes] - after[homes]
        homes, others = homes[others > 0], others[others > 0]
        sums = np.cumsum(others)
        at = 0
        while at < len(homes):
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            x = np.repeat(homes[at:to], others[at:to])
            y = gather(np.arange(len(key)), after[homes[at:to]], others[at:to])
            found([c[x] for c in columns], [c[y] for c in columns])
            at = to

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held:
            columns = [np.concatenate([x, y]) for x, y in zip(held, columns, strict=True)]
        key = (columns[0].astype(np.int64) << 32) | columns[1]
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        link(key[:cut], columns[0][:cut], [c[:cut].copy() for c in columns[2:]])
        held = [c[cut:] for c in columns]
    if held:
        link((held[0].astype(np.int64) << 32) | held[1], held[0], [c.copy() for c in held[2:]])
    if edges:
        node, root = local_roots(*map(np.concatenate, zip(*edges, strict=True)))
        yield pa.record_batch([node, root], names=["a", "b"])


def _links_at_anchors(table: DataFrame, spread, copies: int, schema: str, order: list, at_home, near, hot_rows: int, find=None, center=None) -> DataFrame:
    """Edges (a, b) between nodes. ``spread`` makes rows (anchor, node, ...) from batches of a stored table, ``copies`` of each
    row, about."""
    copied = table.mapInArrow(spread, schema)
    node, *more = copied.columns[1:]
    # Sizes from a sixteenth of the rows; they only decide which anchors are split.
    sampled = table.where(F.pmod(F.xxhash64(table.columns[0]), F.lit(16)) == 0).mapInArrow(spread, schema)
    hot = sampled.groupBy("anchor").agg((16 * F.count("*")).alias("n")).where(F.col("n") > hot_rows)
    hot = write_table(hot.select("anchor", F.ceil(F.col("n") / hot_rows).cast("int").alias("parts")), "hot-anchors")
    rows = copied.select("anchor", F.lit(0).alias("part"), node, *more)
    if not hot.isEmpty():
        rows = copied.join(hot, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64(node), F.col("parts")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.least(k, own) * F.col("parts") + F.greatest(k, own))
        rows = rows.select("anchor", F.explode(pair).alias("part"), node, *more)
    tasks = tasks_for(table.sparkSession, table.count() * copies)
    dealt = rows.repartition(tasks, "anchor", "part").sortWithinPartitions("anchor", "part", *order)
    return dealt.mapInArrow(lambda batches: _compare(batches, at_home, near, find, center), "a long, b long")


def links(distinct: DataFrame, distance: int = 2, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges (a, b) between fingerprints of a table with the column fp, without repeats; all linked ones hang together."""

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                fp = batch.column(0).slice(at, 1 << 14).to_numpy()
                row, anchor = anchors(fp.view(np.uint64), distance)
                yield pa.record_batch([anchor.astype(np.int32), fp[row]], names=["anchor", "fp"])

    def at_home(anchor, columns):
        return home(columns[0].view(np.uint64)) == anchor

    def near(x, y):
        return np.bitwise_count((x[0] ^ y[0]).view(np.uint64)) <= distance

    # Each home has the greater ones at its anchor to compare with; for the smaller ones, their homes see to it.
    return _links_at_anchors(distinct.select("fp"), spread, COPIES, "anchor int, fp long", ["fp"], at_home, near, hot_rows)


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that is reachable over links."""
    table = write_table(fingerprints(docs, shingle), "fingerprints")
    distinct = write_table(table.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct, distance, hot_rows))
    rooted = write_table(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = write_table(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    named = write_table(rooted.join(smallest, "root").select("fp", "component_id"), "components")
    return table.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_sketch(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, a hash for each band, and SKETCH_BITS bits (as 64-bit numbers). They are made from its shingles' smallest
    hashes under SKETCH_BITS functions: of two texts of similarity s, a share of (1 - s) / 2 of the bits differs, and a band is
    the same with probability s ** BAND_HASHES."""
    full = np.diff(offsets) > 0
    bits, bands = np.zeros((len(full), SKETCH_BITS), dtype=bool), np.zeros((len(full), BANDS), dtype=np.uint64)
    if len(values):
        for k, factor in enumerate(np.random.default_rng(42).integers(0, 1 << 63, SKETCH_BITS, dtype=np.uint64)):
            least = np.minimum.reduceat(values * (2 * factor + np.uint64(1)), offsets[:-1][full])
            bits[full, k] = (least >> np.uint64(32)) & np.uint64(1)
            if k < BANDS * BAND_HASHES:
                bands[full, k // BAND_HASHES] = mix(bands[full, k // BAND_HASHES] + least)
    return bands, np.packbits(bits, axis=1).view(np.int64)


@lru_cache(256)
def _opened(path: str) -> pa.NativeFile:
    return open_mapped(path)


class _Exact:
    """Whether pairs of nodes are alike by their sets of shingles, or hang together already by pairs that were."""

    def __init__(self, folder: str):
        self.folder, self.root, self.task = folder, {}, None

    def find(self, node: int) -> int:
        root = self.root
        while (up := root.get(node, node)) != node:
            root[node] = root.get(up, up)
            node = up
        return node

    def shingles(self, file: int, at: int, n: int) -> np.ndarray:
        return np.frombuffer(_opened(f"{self.folder}/{file}").read_at(8 * n, 8 * at), dtype=np.uint64)

    def begin(self) -> None:
        """Another task's links aren't in this one's result, so a task begins with none."""
        task = TaskContext.get().taskAttemptId()
        if task != self.task or len(self.root) > KNOWN_NODES:
            self.root, self.task = {}, task

    def linked(self, x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        """``x`` and ``y`` have columns node, file, at and n; equal ``x`` stand together. True for pairs that are alike and
        didn't hang together before; those that do are passed over."""
        self.begin()
        out = np.zeros(len(x[0]), dtype=bool)
        if not len(out):
            return out
        nodes, at = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)
        group = np.array([self.find(v) for v in nodes.tolist()])[at]
        last, mine = None, None
        for i in np.flatnonzero(group[: len(out)] != group[len(out) :]).tolist():
            a, b = self.find(int(x[0][i])), self.find(int(y[0][i]))
            if a == b:
                continue
            if x[0][i] != last:
                last, mine = x[0][i], self.shingles(*(int(c[i]) for c in x[1:]))
            other = self.shingles(*(int(c[i]) for c in y[1:]))
            both = int((other[np.minimum(np.searchsorted(other, mine), len(other) - 1)] == mine).sum())
            if 5 * both >= 4 * (len(mine) + len(other) - both):
                self.root[max(a, b)] = min(a, b)
                out[i] = True
        return out


def near_copies(docs: DataFrame, shingle: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, text_hash, component_id and component_hash of documents that hang together by a similarity (Jaccard, of sets of
    ``shingle`` words) of 0.8 or more. A component is named by its smallest (doc_id, text_hash), so different texts under one
    doc_id are told apart.

    An edit changes all shingles around it, so a fingerprint of shingles differs in far more than a few bits at that
    similarity. Here texts meet that share one of 24 bands of three smallest hashes of their shingles; wherever the edits are,
    of pairs of similarity 0.8 one in 30 million shares none. Those that differ in 40 of 192 further bits at most (at 0.8 all
    but two or three in a million) are compared exactly, by their sets of shingles in files that workers map; only these are linked.

    Documents with equal sets are one before all that. Ids are handled as by ``near_duplicates``; where a component has no id,
    its component_id is a hash.
    """
    folder = new_dir(docs.sparkSession, "shingles")

    def sketch(batches):
        file, at = TaskContext.get().taskAttemptId(), 0  # another one for each attempt, so none changes another's rows
        with AtomicFile(f"{folder}/{file}") as f:
            for part in (p for b in batches for p in slices(b, most=SLICE_BYTES)):
                values, offsets = hashes(part.column(1), shingle)
                bands, bits = shingle_sketch(values, offsets)
                sets = [np.unique(values[a:b]) for a, b in itertools.pairwise(offsets.tolist())]
                n = np.array([len(x) for x in sets], dtype=np.int64)
                node = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64)
                f.write(np.concatenate([*sets, values[:0]]).tobytes())
                raw = np.concatenate([bands.view(np.int64), bits], axis=1).astype(np.int64)
                ends = np.arange(len(raw) + 1, dtype=np.int32) * 8 * raw.shape[1]
                packed = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])
                yield pa.record_batch([part.column(0), part.column(2), node, np.full(len(n), file), at + np.cumsum(n) - n, n, packed], names=["doc_id", "text_hash", "node", "file", "at", "n", "bits"])
                at += int(n.sum())

    checks, exact = [f"c{i}" for i in range(SKETCH_BITS // 64)], _Exact(folder)

    def spread(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(start, 1 << 12)
                words = np.frombuffer(b"".join(part.column(4).to_pylist()), dtype=np.int64).reshape(part.num_rows, -1)
                place = [part.column(i).to_numpy() for i in range(4)]
                for k in range(BANDS):
                    anchor = (k << 26) | (words[:, k].view(np.uint64) >> np.uint64(38)).astype(np.int64)
                    yield pa.record_batch([anchor.astype(np.int32), *place, *words[:, BANDS:].T.copy()], names=["anchor", "node", "file", "at", "n", *checks])

    def near(x, y):
        out = sum(np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64) for a, b in zip(x[4:], y[4:], strict=True)) <= SKETCH_DIFFERENCE
        out &= 5 * np.minimum(x[3], y[3]) >= 4 * np.maximum(x[3], y[3])
        some = np.flatnonzero(out & (x[0] != y[0]))
        out[:] = False
        out[some] = exact.linked([c[some] for c in x[:4]], [c[some] for c in y[:4]])
        return out

    def center(columns):
        """The row whose bits are nearest to what most rows have: of copies of one text, that text."""
        bits = np.unpackbits(np.ascontiguousarray(np.stack(columns[4:], 1)).view(np.uint8), axis=1)
        return int(np.count_nonzero(bits != (2 * bits.sum(0, dtype=np.int64) > len(bits)), axis=1).argmin())

    def find(node):
        exact.begin()
        return exact.find(node)

    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    table = write_table(hashed.mapInArrow(sketch, "doc_id long, text_hash long, node long, file long, at long, n long, bits binary"), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash"))
    distinct = write_table(table.groupBy("node").agg(first.alias("first"), F.min(F.struct("file", "at", "n", "bits")).alias("set")), "distinct-sketches")
    schema = "anchor int, node long, file long, at long, n long, " + ", ".join(f"{c} long" for c in checks)
    compared = distinct.where("set.n > 0").select("node", "set.file", "set.at", "set.n", "set.bits")
    roots = components(_links_at_anchors(compared, spread, BANDS, schema, ["node"], lambda anchor, columns: np.ones(len(anchor), dtype=bool), near, hot_rows, find, center))
    rooted = write_table(distinct.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "rooted-sketches")
    smallest = write_table(rooted.groupBy("root").agg(F.min("first").alias("smallest")), "smallest-sketches")
    component = [F.coalesce("smallest.doc_id", "root").alias("component_id"), F.col("smallest.text_hash").alias("component_hash")]
    named = write_table(rooted.join(smallest, "root").select("node", *component), "components")
    return table.join(named, "node").select("doc_id", "text_hash", "component_id", "component_hash")


def near_groups(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The columns of ``near_copies``, of documents that hang together by links of ``near_duplicates``, of ``near_copies``, or of
    both in turn. No doc_id is null."""
    key = F.xxhash64("doc_id", "text_hash")
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    rows = write_table(near_copies(docs, hot_rows=hot_rows).withColumn("key", key), "copies-of-rows")
    alike = near_duplicates(hashed.select(key.alias("doc_id"), "text"), hot_rows=hot_rows).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    # Both name a group by one of its rows, so each row is linked with at most two others.
    copied = rows.select(F.col("key").alias("a"), F.xxhash64("component_id", "component_hash").alias("b"))
    roots = components(alike.union(copied))
    rooted = write_table(rows.join(roots, F.col("key") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("root", "key").alias("root")), "rooted-rows")
    first = write_table(rooted.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")), "first-rows")
    component = [F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("component_hash")]
    return rooted.join(first, "root").select("doc_id", "text_hash", *component)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
