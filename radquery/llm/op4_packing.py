"""Best-fit packing of tokenized documents into sequences of fixed capacity by large-item matching.

A packing depends on the lengths alone, and there are ``capacity`` different lengths at most. So Spark counts the pieces of
each length, the plan is made for these counts (it has a size bound that does not grow with the documents), and each piece
finds its place by its rank among the pieces of its length.

The plan: pieces above a third of the capacity go at most two into a sequence. From the longest on, each takes the longest
other one that still fits, which makes the greatest possible number of pairs. The smaller pieces, again from the longest
on, go where the least room remains that holds them, and open new sequences when none does.

Null texts are empty; each document has its end id, so a piece is never empty. Rows with equal ids are packed one by one.
Null ids stay null. Of further columns nothing is read. No document: no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radquery.llm.shared import share, tasks_for, write_table
from radquery.llm.token_ids import encoding
from radquery.llm.words import slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = [c.split()[0] for c in PIECES.split(", ")]
SLICE_BYTES = 4 << 20
#: Pieces of a part within which ranks are counted, about.
BUCKET_PIECES = 1_000_000


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """A row for each document, or for each ``capacity`` ids of a longer one; the last may be shorter. As the table is stored,
    a piece's ``piece_key`` stays the same however often it is read, also where ids and texts are equal."""

    def cut(batches):
        with encoding(tokenizer) as encoder:
            for part in (p for b in batches for p in slices(b, most=SLICE_BYTES)):
                ids, offsets = encoder.encode(part.column(1), end_id)
                n = np.diff(offsets)
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                lengths = np.minimum(capacity, n[row] - number * capacity)
                bounds = np.concatenate(([0], np.cumsum(lengths))).tolist()
                crc = np.fromiter((zlib.crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)), np.int64, len(row))
                columns = [part.column(0).take(pa.array(row)), number.astype(np.int32), number * capacity, lengths, crc]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.array(bounds, dtype=np.int32)), pa.array(ids.view(np.int32))))
                yield pa.record_batch(columns, names=[*NAMES, "ids"][: len(columns)])

    schema = PIECES + ", ids array<int>" * with_ids
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)
    return write_table(made.withColumn("piece_key", F.monotonically_increasing_id()), "pieces")


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(first sequence, number of sequences, [(length, copies in each)]) for each pattern."""
    left = {k: n for k, n in counts.items() if n}
    rooms: dict[int, list[tuple[tuple, int]]] = defaultdict(list)  # by room: (parts, sequences)
    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if left[b] - (b == a) > 0 and a + b <= capacity and b <= a), None)
            if b is None:
                rooms[capacity - a].append((((a, 1),), left[a]))
                left[a] = 0
            else:
                m = left[a] // 2 if a == b else min(left[a], left[b])
                left[a] -= m
                left[b] -= m
                rooms[capacity - a - b].append((((a, 1), (b, 1)) if a != b else ((a, 2),), m))
    for a in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while n := left[a]:
            room = next((r for r in range(a, capacity) if rooms.get(r)), capacity)
            fit = room // a
            parts, m = rooms[room].pop() if room < capacity else ((), -(-n // fit))
            full = min(m, n // fit)
            rest = n - full * fit if full < m else 0
            if full:
                rooms[room - fit * a].append(((*parts, (a, fit)), full))
            if rest:
                rooms[room - rest * a].append(((*parts, (a, rest)), 1))
            if (same := m - full - (rest > 0)) and room < capacity:
                rooms[room].append((parts, same))
            left[a] = n - full * fit - rest
    plan, first = [], 0
    for room in sorted(rooms):
        for parts, m in rooms[room]:
            plan.append((first, m, list(parts)))
            first += m
    return plan


def _slots(plan: list, counts: dict[int, int]) -> dict[str, np.ndarray]:
    """Where pieces go. By length and then by rank, each row has a range of ranks that starts at ``rank`` (counted over all
    lengths, after ``base`` of the length), ``copies`` in each sequence from ``first`` on, and their ``offset`` there."""
    lengths = sorted(counts)
    base = dict(zip(lengths, np.cumsum([0, *(counts[k] for k in lengths)])[:-1].tolist(), strict=True))
    taken, rows = dict(base), []
    for first, m, parts in plan:
        offset = 0
        for length, copies in parts:
            rows.append((taken[length], first, offset, copies))
            taken[length] += m * copies
            offset += length * copies
    rows.sort()
    slots = dict(zip(("rank", "first", "offset", "copies"), np.array(rows, dtype=np.int64).reshape(-1, 4).T, strict=True))
    return slots | {"base": np.array([base.get(k, 0) for k in range(max(lengths, default=0) + 1)])}


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to the columns of a stored table of pieces, which is read three times."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    slots = share(spark, _slots(plan_packing(counts, capacity), counts))

    # Ranks within a length: within small parts of it, and after all pieces of the parts before. Parts go by the key, which no
    # two pieces share, so equal pieces are spread as well.
    buckets = tasks_for(spark, sum(counts.values()), BUCKET_PIECES)
    bucket = F.pmod(F.xxhash64("piece_key"), F.lit(buckets)).cast("int")
    keyed = pieces.select(*NAMES, "piece_key", bucket.alias("_bucket"))
    sizes = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("piece_key")
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1).join(sizes, ["length", "_bucket"])
    ranked = ranked.select(*NAMES, (F.col("_rank") + F.col("_before")).cast("long").alias("_rank"), "piece_key")

    def place(batches):
        s = slots.value
        for batch in batches:
            rank = batch.column(5).to_numpy() + s["base"][batch.column(3).to_numpy()]
            at = np.searchsorted(s["rank"], rank, "right") - 1
            sequence, copy = np.divmod(rank - s["rank"][at], s["copies"][at])
            offset = s["offset"][at] + copy * batch.column(3).to_numpy()
            yield pa.record_batch([*batch.columns[:5], s["first"][at] + sequence, offset, batch.column(6)], names=[*NAMES, "sequence_id", "offset", "piece_key"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long, piece_key long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """A row for each piece, with its place."""
    return pack(cut_pieces(docs, tokenizer, end_id, capacity), capacity).drop("piece_key")


def packed_sequences(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and the document and length of each part in order."""
    pieces = cut_pieces(docs, tokenizer, end_id, capacity, with_ids=True)
    placed = write_table(pack(pieces, capacity).select("piece_key", "sequence_id", "offset"), "placed")
    parts = pieces.join(placed, "piece_key").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
