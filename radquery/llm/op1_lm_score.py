"""Scores of an interpolated modified Kneser-Ney n-gram model.

Tokens are words in lower case (A-Z) and an end at each text's end. Spark counts the n-grams of each order; none is dropped.
A level of the model is a set of sorted arrays of 64-bit hashes, in shards by their first bits, with further arrays beside
them. Workers map them into memory and find n-grams by binary search, so a model on a mounted folder may be larger than any
memory; from another store a worker holds MAPPED_BYTES of them at a time, or one.

Level 1 has the XXH64 of each word; a word's number is its rank there. The key of a longer n-gram is a bijective mix of its
context's rank (in the level below) and its last word's number, of as many bits as both need, so above level 1 two n-grams
never share a key; where more than 64 bits are needed, that is an error. Tasks count the n-grams of slices of text, and send each
shard packed blocks of sorted keys and counts, which its reducer merges. Beyond FAN_OUT shards, blocks are of ranges of shards
first; tasks gather those of a range, add up what is equal and cut them by shard, so blocks stay large however many shards there
are. Counts are of 64 bits.

Probabilities: P(w | h) = max(0, a - D(a)) / sum + gamma(h) P(w | h'), where h' lacks the first word of h, a is the count in
the highest order, and in lower ones the number of different words before (n-grams that begin a text: their count). D are the
three discounts of the order, from its counts of counts. The lowest order is mixed with an even share for each known token
and one for all unknown ones.

Null texts are empty, which is one end. Rows with equal ids are scored one by one. Of further columns nothing is read. Without
training text each token is the only unknown one, and both scores are 0.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radquery.llm.shared import AtomicFile, filesystem, is_local, local_path, new_dir, share, write_table
from radquery.llm.words import give_back, slices, split_words, texts_of

#: Of the registered query.
ORDER = 3
#: No word is a blank, so its hash stands for the end.
END = xxhash.xxh64_intdigest(b" ")
#: Text for each shard, about; there are 64 shards at least.
SHARD_BYTES = 64 << 20
#: Text that a task counts, and scores, at once; and n-grams that it gathers over slices before it sends them.
COUNT_BYTES, SCORE_BYTES, HELD = 6 << 20, 4 << 20, 3 << 20
#: Shards, or ranges of shards, that a task sends blocks to; and partitions of an exchange, each of which may have several shards.
FAN_OUT, PARTITIONS = 1024, 20_000
#: Bytes of arrays that a worker holds where they can't be mapped.
MAPPED_BYTES = 256 << 20
#: Counts are bytes; those of OVER and more are in a file beside, as places and values.
TYPES = {"keys": np.uint64, "suffix": np.uint64, **dict.fromkeys(("counts", "adjusted", "total", "n1", "n2", "n3"), np.uint8), "more": np.uint64}
OVER = 255
_U = np.uint64


#: Odd factors of the mix.
FACTORS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def scramble(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of numbers of so many bits that spreads them over all shards."""
    half, mask = _U((bits + 1) // 2), _U((1 << bits) - 1)
    for f in FACTORS:
        x = ((x ^ (x >> half)) * _U(f)) & mask
    return x ^ (x >> half)


def unscramble(x: np.ndarray, bits: int) -> np.ndarray:
    half, mask = _U((bits + 1) // 2), _U((1 << bits) - 1)
    for f in reversed(FACTORS):
        x = ((x ^ (x >> half)) * _U(pow(f, -1, 1 << bits))) & mask
    return x ^ (x >> half)


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Compressed bytes of numbers from 0 on, or of their differences. As many bytes as the greatest needs, like ones together."""
    values = values.astype(np.uint64)
    values = np.diff(values, prepend=_U(0)) if ascending else values
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8).T[:width]
    return bytes([width | ascending << 7]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width, ascending = data[0] & 127, data[0] >> 7
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(width, -1)
    values = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    values[:, :width] = raw.T
    values = values.view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if ascending else values


def order_of(values: np.ndarray) -> np.ndarray:
    """The places of numbers from 0 on in ascending order, of equal ones in any. Where a number and its place fit into 64 bits,
    both are sorted as one, which is faster than an argsort."""
    places = max(1, (len(values) - 1).bit_length())
    if not len(values) or int(values.max()).bit_length() + places > 64:
        return np.argsort(values)
    both = values.astype(np.uint64) << _U(places)
    both |= np.arange(len(values), dtype=np.uint64)
    both.sort()
    both &= _U((1 << places) - 1)
    return both.view(np.int64)


def distinct_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers, and where in them each one is."""
    order = order_of(values)
    ascending = values[order]
    new = np.empty(len(values), dtype=bool)
    new[:1] = True
    np.not_equal(ascending[1:], ascending[:-1], out=new[1:])
    back = np.empty(len(values), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return ascending[new], back


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the sum of the counts, or the number, of each."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = order_of(keys)
        keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first)


_arrays: dict[tuple[str, str], np.ndarray] = {}


def _mapped(path: str, kind: str) -> np.ndarray:
    found = _arrays.get((path, kind))
    if found is None:
        if is_local(path):
            found = np.memmap(local_path(path), dtype=TYPES[kind], mode="r")
            if len(_arrays) >= 4096:
                _arrays.clear()
        else:
            fs, inner = filesystem(path)
            with fs.open_input_file(inner) as f:
                found = np.frombuffer(f.read(), dtype=TYPES[kind])
            while _arrays and sum(x.nbytes for x in _arrays.values()) + found.nbytes > MAPPED_BYTES:
                _arrays.pop(next(iter(_arrays)))  # the one that has been there longest
        _arrays[path, kind] = found
    return found


def _save(path: str, values: np.ndarray) -> None:
    with AtomicFile(path) as f:
        f.write(np.ascontiguousarray(values).data if len(values) else b"")


def _save_counts(path: str, values: np.ndarray) -> None:
    over = np.flatnonzero(values >= OVER)
    if len(over):
        _save(f"{path}-more", np.concatenate([over, values[over]]).astype(np.uint64))
    _save(path, np.minimum(values, OVER).astype(np.uint8))


class Level(NamedTuple):
    """Shards of one order's n-grams; rank r is in shard s if starts[s] <= r < starts[s + 1]. Keys have so many bits."""

    folder: str
    starts: np.ndarray
    bits: int

    @property
    def shards(self) -> int:
        return len(self.starts) - 1

    @property
    def size(self) -> int:
        return int(self.starts[-1])

    def shard_of(self, ranks: np.ndarray) -> np.ndarray:
        """The number of shards for the rank after the last."""
        return np.searchsorted(self.starts, ranks.astype(np.int64), "right") - 1

    def path(self, shard: int, kind: str) -> str:
        return f"{self.folder}/{shard:06d}.{kind}"

    def array(self, shard: int, kind: str) -> np.ndarray:
        return _mapped(self.path(shard, kind), kind) if self.starts[shard + 1] > self.starts[shard] else np.empty(0, TYPES[kind])

    def values(self, shard: int, kind: str, at: np.ndarray) -> np.ndarray:
        out = self.array(shard, kind)[at]
        if TYPES[kind] == np.uint8:
            out = out.astype(np.int64)
            over = np.flatnonzero(out == OVER)
            if len(over):
                where, more = _mapped(f"{self.path(shard, kind)}-more", "more").reshape(2, -1)
                out[over] = more[np.searchsorted(where, at[over].astype(np.uint64))]
        return out

    def find_distinct(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of sorted keys; -1 for those that aren't there."""
        bounds = np.searchsorted(keys, np.arange(self.shards, dtype=np.uint64) << _U(self.bits - self.shards.bit_length() + 1))
        bounds = np.append(bounds, len(keys))
        out = np.full(len(keys), -1, dtype=np.int64)
        for s in np.flatnonzero(np.diff(bounds)):
            have, part = self.array(s, "keys"), keys[bounds[s] : bounds[s + 1]]
            if len(have):
                at = np.minimum(np.searchsorted(have, part), len(have) - 1)
                out[bounds[s] : bounds[s + 1]] = np.where(have[at] == part, self.starts[s] + at, -1)
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        distinct, back = distinct_of(keys)
        return self.find_distinct(distinct)[back]

    def take_distinct(self, kind: str, ranks: np.ndarray) -> np.ndarray:
        """Of sorted ranks."""
        bounds = np.searchsorted(ranks, self.starts)
        out = np.empty(len(ranks), dtype=np.uint64 if TYPES[kind] == np.uint64 else np.int64)
        for s in np.flatnonzero(np.diff(bounds)):
            out[bounds[s] : bounds[s + 1]] = self.values(s, kind, ranks[bounds[s] : bounds[s + 1]] - self.starts[s])
        return out

    def take(self, kinds: tuple[str, ...], ranks: np.ndarray) -> list[np.ndarray]:
        distinct, back = distinct_of(ranks)
        return [self.take_distinct(k, distinct)[back] for k in kinds]


def _word_bits(levels: list[Level]) -> int:
    return max(1, (levels[0].size - 1).bit_length())


def _key_bits(levels: list[Level], k: int) -> int:
    """Of n-grams of order k: for a rank in the level below, or the begin of a text, and a word."""
    bits = levels[k - 2].size.bit_length() + _word_bits(levels)
    if bits > 64:
        raise ValueError(f"{levels[k - 2].size} contexts and {levels[0].size} words don't fit into a key of 64 bits")
    return max(bits, levels[0].shards.bit_length() + 8)


def _keys(levels: list[Level], k: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return scramble((context.astype(np.uint64) << _U(_word_bits(levels))) | word.astype(np.uint64), _key_bits(levels, k))


def _parts(levels: list[Level], k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranks of the contexts, and the words."""
    pair, bits = unscramble(keys, _key_bits(levels, k)), _U(_word_bits(levels))
    return (pair >> bits).astype(np.int64), (pair & ((_U(1) << bits) - _U(1))).astype(np.int64)


def _suffixes(levels: list[Level], k: int, keys: np.ndarray) -> np.ndarray:
    """The rank, in the level below, of each n-gram of order k without its first word."""
    context, word = _parts(levels, k, keys)
    if k == 2:
        return word
    below = levels[k - 2]
    distinct, back = distinct_of(context)
    if k == 3:
        inner = _parts(levels, 2, below.take_distinct("keys", distinct))[1]
    else:
        inner = below.take_distinct("suffix", distinct)
    return below.find(_keys(levels, k - 1, inner[back], word))


class Model(NamedTuple):
    levels: list[Level]
    tokens: int
    discounts: list[np.ndarray]  # of each order, for counts 0 to 3
    total: int  # of the lowest order's adjusted counts
    even: float  # what the lowest order's discounts leave, over the known tokens and one


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An index of each token into the hashes, the offsets by text, and the hashes; the end is the last of them."""
    codes, offsets, distinct = split_words(pc.ascii_lower(texts_of(texts)))
    digest = xxhash.xxh64_intdigest
    hashes = np.append(np.fromiter(map(digest, distinct.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(distinct)), _U(END))
    offsets = offsets + np.arange(len(offsets))
    out, word = np.full(offsets[-1], len(distinct), dtype=np.int32), np.ones(offsets[-1], dtype=bool)
    word[offsets[1:] - 1] = False
    out[word] = codes
    return out, offsets, hashes


def _contexts(levels: list[Level], rank: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """For each token, the rank of the k - 1 tokens before it; -1 where they are unknown, or too few."""
    context = np.concatenate(([-1], rank[:-1]))
    context[place == 0] = levels[0].size if k == 2 else -1  # the number of a text's begin
    return context


def _gram_keys(levels: list[Level], order: int, codes: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The keys of all n-grams of an order in the texts."""
    words = levels[0].find(hashes)[codes]
    place, rank = _places(offsets), words
    for k in range(2, order + 1):
        context = _contexts(levels, rank, place, k)
        at = np.flatnonzero((context >= 0) & (words >= 0))
        keys = _keys(levels, k, context[at], words[at])
        if k < order:
            rank = np.full(len(codes), -1, dtype=np.int64)
            rank[at] = levels[k - 1].find(keys)
    return keys


def _places(offsets: np.ndarray) -> np.ndarray:
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))


def _blocks(shard: np.ndarray, columns: list[np.ndarray], kind: str = "") -> pa.RecordBatch:
    """A row of packed columns for each shard; rows are sorted by shard, and the first column ascends in each."""
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.empty(0, np.int64)
    ends = np.append(first, len(shard))[1:]
    data = [pa.array([pack(c[a:b], i == 0) for a, b in zip(first, ends, strict=True)], pa.binary()) for i, c in enumerate(columns)]
    return pa.record_batch([pa.array(shard[first].astype(np.int32)), pa.array([kind] * len(first), pa.string()), *data], names=["shard", "kind", *(f"c{i}" for i in range(len(columns)))])


MANIFEST = [("shard", "int"), ("kind", "string"), *((f"c{i}", "binary") for i in range(5)), ("n", "long"), ("sum", "long"), *((f"n{i}", "long") for i in range(1, 5))]


def _padded(batch: pa.RecordBatch, told: list[int] | None = None) -> pa.RecordBatch:
    columns = dict(zip(batch.schema.names, batch.columns, strict=True))
    for i in range(5):
        columns.setdefault(f"c{i}", pa.nulls(batch.num_rows, pa.binary()))
    for name, value in zip(("n", "sum", "n1", "n2", "n3", "n4"), told or [None] * 6, strict=True):
        columns[name] = pa.array([value] * batch.num_rows, pa.int64())
    return pa.record_batch([columns[n] for n, _ in MANIFEST], names=[n for n, _ in MANIFEST])


def _width(shards: int) -> int:
    """Shards in a range that blocks are sent to."""
    return -(-shards // FAN_OUT)


def _merged(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns of blocks as one block: keys sorted and distinct, the others added up."""
    keys, *others = map(np.concatenate, zip(*held, strict=True))
    order = order_of(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return [keys[first], *(np.add.reduceat(c[order], first) for c in others)]


def _dealt(blocks: DataFrame, shards: int, shard_of) -> DataFrame:
    """Blocks sorted by shard, those of a shard in one partition. Blocks of ranges meet by range first, where a range may be dealt
    to several tasks by its blocks' contents, and are cut by ``shard_of`` their keys."""
    partitions = max(min(shards, PARTITIONS), int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names, most, width = blocks.columns[2:], HELD, _width(shards)

    def cut(batches):
        held, size, now = [], 0, None

        def out():
            columns = _merged(held)
            found = _blocks(shard_of(columns[0]), columns, now[1])
            missing = [pa.nulls(found.num_rows, pa.binary())] * (len(names) - len(columns))
            return pa.record_batch([*found.columns, *missing], names=["shard", "kind", *names])

        for batch in batches:
            for row in batch.to_pylist():
                if held and (now != (row["shard"], row["kind"]) or size > most):
                    yield out()
                    held, size = [], 0
                    give_back()
                now = row["shard"], row["kind"]
                held.append([unpack(row[c]) for c in names if row[c] is not None])
                size += len(held[-1][0])
        if held:
            yield out()

    if width > 1:
        part = F.pmod(F.xxhash64("c0"), F.lit(-(-partitions // FAN_OUT)))
        ranges = blocks.repartition(partitions, "shard", part).sortWithinPartitions("shard", "kind")
        blocks = ranges.mapInArrow(cut, blocks.schema)
    return blocks.repartition(partitions, "shard").sortWithinPartitions("shard")


def _by_shard(batches):
    """(shard, [rows of that shard]) of blocks that are sorted by shard."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if now is not None and row["shard"] != now:
                yield now, rows
                rows = []
                give_back()
            now = row["shard"]
            rows.append(row)
    if rows:
        yield now, rows


def _told(rows: DataFrame) -> dict[str, int]:
    """What shards tell, added up."""
    return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "sum", "n1", "n2", "n3", "n4"))).first().asDict()


def _counts_of_counts(values: np.ndarray) -> list[int]:
    return [int((values == i).sum()) for i in range(1, 5)]


def _downward(levels: list[Level], k: int, keys: np.ndarray, adjusted: np.ndarray, width: int):
    """Blocks for the level below: of each context, its sum and how many followers have 1, 2, or more; of each suffix, how
    many n-grams end in it. Sorted by range of so many shards."""
    below = levels[k - 2]
    context = _parts(levels, k, keys)[0]
    order = order_of(context)
    context, a = context[order], adjusted[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    sums = [np.add.reduceat(x, first) for x in (a, a == 1, a == 2, a > 2)] if len(a) else [a] * 4
    known = context[first] < below.size if len(a) else first.astype(bool)  # the begin of a text has no place there
    whole = [context[first][known], *(x[known] for x in sums)] if len(a) else [a] * 5
    yield _blocks(below.shard_of(whole[0]) // width, whole, "context")
    if len(a) and not known.all():
        yield _blocks(np.array([below.shards // width]), [context[first][~known], *(x[~known] for x in sums)], "context")
    ends, times = counted(_suffixes(levels, k, keys))
    yield _blocks(below.shard_of(ends) // width, [ends, times], "suffix")


def _count_level(docs: DataFrame, k: int, order: int, levels: list[Level], folder: str, shards: int) -> tuple[Level, DataFrame, dict[str, int]]:
    """Counts the n-grams of order k; for the highest order also the blocks for the level below."""
    bits = 64 if k == 1 else _key_bits(levels, k)
    shift, width = _U(bits - (shards.bit_length() - 1)), _width(shards)

    def shard_of(keys):
        return (keys >> shift).astype(np.int64)

    def count(batches):
        held, size = [], 0

        def sent(merged):
            return _padded(_blocks(shard_of(merged[0]) // width, [*merged]))

        for part in (p for b in batches for p in slices(b, most=COUNT_BYTES)):
            codes, offsets, hashes = _tokens(part.column(0))
            held.append(counted(hashes, np.bincount(codes, minlength=len(hashes))) if k == 1 else counted(_gram_keys(levels, k, codes, offsets, hashes)))
            size += len(held[-1][0])
            if size > HELD:
                merged = counted(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [merged], len(merged[0])
                if 2 * size > HELD:
                    yield sent(merged)
                    held, size = [], 0
        if held:
            yield sent(counted(*map(np.concatenate, zip(*held, strict=True))))
        _arrays.clear()

    def merge(batches):
        for shard, rows in _by_shard(batches):
            keys, n = counted(*(np.concatenate([unpack(r[c]) for r in rows]) for c in ("c0", "c1")))
            _save(f"{folder}/{k}/{shard:06d}.keys", keys)
            _save_counts(f"{folder}/{k}/{shard:06d}.counts", n)
            if 2 < k < order:
                _save(f"{folder}/{k}/{shard:06d}.suffix", _suffixes(levels, k, keys).astype(np.uint64))
            told = pa.record_batch([pa.array([shard], pa.int32()), pa.array(["shard"])], names=["shard", "kind"])
            yield _padded(told, [len(keys), int(n.sum()), *_counts_of_counts(n)])
            if k == order > 1:
                for blocks in _downward(levels, k, keys, n, width):
                    yield _padded(blocks)
        _arrays.clear()

    schema = ", ".join(f"{n} {t}" for n, t in MANIFEST)
    blocks = docs.select("text").mapInArrow(count, schema).select("shard", "kind", "c0", "c1")
    merged = write_table(_dealt(blocks, shards, shard_of).mapInArrow(merge, schema), f"level-{k}")
    told = merged.where("kind = 'shard'")
    found, sizes = told.select("shard", "n").toArrow(), np.zeros(shards, dtype=np.int64)  # two numbers a shard
    sizes[found["shard"].to_numpy()] = found["n"].to_numpy()
    return Level(f"{folder}/{k}", np.concatenate(([0], np.cumsum(sizes))), bits), merged.where("kind != 'shard'"), _told(told)


def _finish_level(blocks: DataFrame, k: int, levels: list[Level]) -> tuple[DataFrame, dict[str, int], list[int]]:
    """Writes a level's adjusted counts and what followers its n-grams have, and passes blocks to the level below."""
    level = levels[k - 1]
    width = _width(level.shards)

    def finish(batches):
        for shard, rows in _by_shard(batches):
            if shard >= len(level.starts) - 1:  # begin of a text
                n = [sum(int(unpack(r[f"c{i}"]).sum()) for r in rows) for i in range(1, 5)]
                told = pa.record_batch([pa.array([shard], pa.int32()), pa.array(["begin"])], names=["shard", "kind"])
                yield _padded(told, [0, 0, *n])
                continue
            size = int(level.starts[shard + 1] - level.starts[shard])
            arrays = {t: np.zeros(size, dtype=np.int64) for t in ("adjusted", "total", "n1", "n2", "n3")}
            for r in rows:
                at = unpack(r["c0"]).astype(np.int64) - int(level.starts[shard])
                for i, t in enumerate(("total", "n1", "n2", "n3") if r["kind"] == "context" else ("adjusted",), 1):
                    arrays[t][at] += unpack(r[f"c{i}"]).astype(np.int64)
            adjusted = arrays["adjusted"]
            alone = adjusted == 0
            adjusted[alone] = level.values(shard, "counts", np.flatnonzero(alone))
            for t, values in arrays.items():
                _save_counts(level.path(shard, t), values)
            told = pa.record_batch([pa.array([shard], pa.int32()), pa.array(["shard"])], names=["shard", "kind"])
            yield _padded(told, [size, int(adjusted.sum()), *_counts_of_counts(adjusted)])
            if k > 1:
                for found in _downward(levels, k, np.array(level.array(shard, "keys")), adjusted, width):
                    yield _padded(found)
        _arrays.clear()

    schema = ", ".join(f"{n} {t}" for n, t in MANIFEST)
    dealt = _dealt(blocks.select("shard", "kind", *(f"c{i}" for i in range(5))), level.shards, level.shard_of)
    done = write_table(dealt.mapInArrow(finish, schema), f"finished-{k}")
    begin = _told(done.where("kind = 'begin'"))
    return done.where("kind in ('context', 'suffix')"), _told(done.where("kind = 'shard'")), [begin[f"n{i}"] for i in range(1, 5)]


def _discounts(told: dict[str, int]) -> np.ndarray:
    n = [0, *(told[f"n{i}"] for i in range(1, 5))]
    if min(n[1:]) == 0:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n[1] / (n[1] + 2 * n[2])
    return np.clip([0, *(i - (i + 1) * y * n[i + 1] / n[i] for i in range(1, 4))], [0, 0, 0, 0], [0, 1, 2, 3])


class Trained(NamedTuple):
    model: Model
    begin: tuple[int, int, int, int]  # of texts' begins as a context: sum, followers with 1, 2, more


def train(docs: DataFrame, order: int = 2, folder: str | None = None) -> Trained | None:
    """From the column text. What comes to the driver is two numbers for each shard."""
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "language-model")
    size = docs.agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size"), F.count("*").alias("n")).first()
    if not size["n"]:
        return None
    shards = 1 << max(6, math.ceil(math.log2(max(1, size["size"] / SHARD_BYTES))))
    levels, tokens, told_of, blocks = [], 0, {}, None
    for k in range(1, order + 1):
        level, blocks, told = _count_level(docs, k, order, levels, folder, shards)
        levels.append(level)
        told_of[k], tokens = told, tokens or told["sum"]
    begin = (0, 0, 0, 0)
    for k in range(order - 1, 0, -1):
        blocks, told_of[k], found = _finish_level(blocks, k, levels)
        begin = tuple(found) if k == 1 else begin
    discounts = [_discounts(told_of[k]) for k in range(1, order + 1)]
    n = [told_of[1][f"n{i}"] for i in (1, 2)]
    known, total = int(levels[0].starts[-1]), told_of[1]["sum"]
    left = discounts[0][1] * n[0] + discounts[0][2] * n[1] + discounts[0][3] * (known - sum(n))
    return Trained(Model(levels, tokens, discounts, total, left / total / (known + 1)), begin)


def log_probabilities(trained: Trained, codes: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's probability, and its training count."""
    (levels, _, discounts, total, even), begin = trained
    order = len(levels)
    words = levels[0].find(hashes)
    known = np.flatnonzero(words >= 0)
    count, low = np.zeros(len(hashes), dtype=np.int64), np.full(len(hashes), even)
    (count[known],) = levels[0].take(("counts",), words[known])
    a = levels[0].take(("adjusted",), words[known])[0] if order > 1 else count[known]
    low[known] += np.maximum(0, a - discounts[0][np.minimum(a, 3)]) / total
    p, word, first = low[codes], words[codes], offsets[:-1][np.diff(offsets) > 0]
    # The n-grams of order k - 1 that are in the model, each once: their ranks, and which of them ends at each token.
    ranks, gram = words[known], np.full(len(hashes), -1, dtype=np.int32)
    gram[known] = np.arange(len(known))
    gram = gram[codes]
    for k in range(2, order + 1):
        level, d = levels[k - 1], discounts[k - 1]
        total, *n = levels[k - 2].take(("total", "n1", "n2", "n3"), ranks)
        ranks = np.append(ranks, levels[k - 2].size)  # the last place is that of a text's begin
        total, n = np.append(total, begin[0]), [np.append(x, y) for x, y in zip(n, begin[1:], strict=True)]
        some = np.maximum(total, 1)
        gamma = (d[1] * n[0] + d[2] * n[1] + d[3] * n[2]) / some
        context = np.empty_like(gram)
        context[1:] = gram[:-1]
        context[first] = len(ranks) - 1 if k == 2 else -1
        after = np.flatnonzero((context >= 0) & (word >= 0))
        distinct, back = distinct_of(_keys(levels, k, ranks[context[after]], word[after]))
        found = level.find_distinct(distinct)
        there = np.flatnonzero(found >= 0)
        values = np.zeros(len(distinct), dtype=np.int64)
        values[there] = level.take_distinct("adjusted" if k < order else "counts", found[there])
        more = np.zeros(len(codes))
        more[after] = np.maximum(0, values - d[np.minimum(values, 3)])[back]
        at = np.flatnonzero((context >= 0) & (total > 0)[context])
        context = context[at]
        p[at] = more[at] / some[context] + gamma[context] * p[at]
        if k < order:
            place = np.full(len(distinct), -1, dtype=np.int32)
            place[there] = np.arange(len(there))
            ranks, gram = found[there], np.full(len(codes), -1, dtype=np.int32)
            gram[after] = place[back]
    return np.log10(p), count[codes]


def score(docs: DataFrame, trained: Trained | None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    shared = share(docs.sparkSession, trained)

    def run(batches):
        trained = shared.value
        for part in (p for b in batches for p in slices(b, most=SCORE_BYTES)):
            codes, offsets, hashes = _tokens(part.column(1))
            if trained:
                tokens, known = trained.model.tokens, int(trained.model.levels[0].starts[-1])
                logs, count = log_probabilities(trained, codes, offsets, hashes)
            else:
                tokens, known, count = 0, 0, np.zeros(len(codes), dtype=np.int64)
                logs = np.zeros(len(codes))
            base = np.log10((count + 1) / (tokens + known + 1))
            total = lambda x: np.add.reduceat(x, offsets[:-1]) if len(offsets) > 1 else x[:0]
            n, scores = np.diff(offsets), total(logs)
            yield pa.record_batch([part.column(0), n, total((count > 0).astype(np.int64)), np.full(len(n), tokens), total(base), scores, 10 ** np.minimum(300, -scores / n)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def held_out(remainder: int = 2, of: int = 7):
    """True for rows that nothing is learned from; a row without id is one of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder, F.lit(True))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs.where(~held_out()), ORDER))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
