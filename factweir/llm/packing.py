"""Best-fit packing with large-item matching, planned on the histogram of lengths.

Pieces above a third of the capacity are matched greedily, at most two to a bin, each with the longest that
still fits beside it. Shorter pieces, longest first, go where they leave the least room, and open new bins
when nothing fits. Equal lengths are interchangeable, so the plan works on counts by length: its size depends
on the capacity alone, never on the data. Each piece then finds its bin and offset from its number among the
pieces of its length, which is counted in salted groups, so that no length is numbered in one task.

Defined results: null texts are empty; an empty text is its end id alone; texts longer than the capacity are
cut into full pieces and a rest; repeated rows are packed as pieces of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweir.llm.common import pick, prepare, work_dir, written
from factweir.llm.tokens import tokenizer

_RANK_BITS = 42


@dataclass(frozen=True)
class Slot:
    """`bins` bins from `first_bin` on take `copies` pieces of `length` each at `offset`; ranks from `rank`."""

    length: int
    rank: int
    first_bin: int
    bins: int
    copies: int
    offset: int


def plan_packing(counts: dict[int, int], capacity: int) -> list[Slot]:
    """Slots for all pieces, by length and rank."""
    left = {n: c for n, c in counts.items() if c}
    ranks = dict.fromkeys(left, 0)
    slots: list[Slot] = []
    gaps: list[tuple[int, int, int]] = []  # (room, first bin, bins), sorted
    total = 0

    def place(n: int, first: int, bins: int, copies: int, room: int) -> None:
        slots.append(Slot(n, ranks[n], first, bins, copies, capacity - room))
        ranks[n] += bins * copies
        left[n] -= bins * copies

    def keep(room: int, first: int, bins: int) -> None:
        if bins and room:
            insort(gaps, (room, first, bins))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        i = bisect_left(large, capacity - n + 1) - 1
        while i >= 0 and left[large[i]] < (2 if large[i] == n else 1):
            i -= 1
        mate = large[i] if i >= 0 else None
        bins = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
        place(n, total, bins, 1, capacity)
        if mate is not None:
            place(mate, total, bins, 1, capacity - n)
        keep(capacity - n - (mate or 0), total, bins)
        total += bins

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect_left(gaps, (n, -1, -1))
            if i < len(gaps):
                room, first, bins = gaps.pop(i)
            else:
                room, first, bins = capacity, total, -(-left[n] // (capacity // n))
                total += bins
            copies = room // n
            full, rest = min(bins, left[n] // copies), 0
            if full:
                place(n, first, full, copies, room)
                keep(room - copies * n, first, full)
            if full < bins and left[n]:
                rest = left[n]
                place(n, first + full, 1, rest, room)
                keep(room - rest * n, first + full, 1)
            used = full + (1 if rest else 0)
            keep(room, first + used, bins - used)
    return sorted(slots, key=lambda s: (s.length, s.rank))


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Per piece of docs(doc_id, text): doc_id, piece, start, length and ids (little-endian uint32)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(tokenizer_path), np.array([end_id], dtype=np.uint32)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), tok.encode_all(b.column("text").to_pylist()), strict=True):
                ids = np.concatenate((ids, end)).astype("<u4")
                rows += [(doc_id, k, at, len(part := ids[at : at + capacity]), part.tobytes()) for k, at in enumerate(range(0, len(ids), capacity))]
            names, kinds = ("doc_id", "piece", "start", "length", "ids"), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=list(names))

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int = 4096, keys: tuple[str, ...] = ("doc_id", "piece"), rows_per_salt: int = 200_000) -> DataFrame:
    """pieces with `length` (1 to capacity) and `sequence_id`, `offset`: gapless from 0 in each sequence.

    keys order the pieces of one length, so the result doesn't depend on partitions.
    """
    spark = pieces.sparkSession
    prepare(spark)
    folder = work_dir(spark, "packing")
    pieces = written(pieces, f"{folder}/pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots = plan_packing(counts, capacity)
    salts = max(16, min(4096, sum(counts.values()) // rows_per_salt))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*pieces.columns), F.lit(salts)).cast("int"))
    sums = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")
    rest = [c for c in pieces.columns if c not in keys and c != "length"]
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys, *rest)) - 1
    ranked = salted.withColumn("_n", number).join(sums.select("length", "_salt", before.alias("_before")), ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_n")).alias("_rank"))

    columns = pieces.columns
    key = np.array([(s.length << _RANK_BITS) + s.rank for s in slots], dtype=np.int64)
    first, copies, offset = (np.array([getattr(s, a) for s in slots], dtype=np.int64) for a in ("first_bin", "copies", "offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(key, (n << _RANK_BITS) + rank, "right") - 1
            j = (n << _RANK_BITS) + rank - key[at]
            arrays = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(first[at] + j // copies[at]), pa.array(offset[at] + j % copies[at] * n)], names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """sequence_id and ids (binary) of each packed sequence; docs must hold a doc_id once."""
    ids = tokenised_pieces(docs, tokenizer_path, capacity, end_id).select("doc_id", "piece", "ids")
    parts = packed.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    whole = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # at most `capacity` pieces
    return whole.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
