"""Best-fit packing of documents into training sequences by the linear grouping scheme.

1. Texts become ids plus an end id; documents over ``capacity`` are cut into pieces of ``capacity``
   (the first may be shorter). Full pieces are sequences by themselves.
2. The driver gets the histogram of piece lengths, at most ``capacity`` rows whatever the corpus.
   Lengths over ``capacity / small`` are large: in falling order they form ``groups`` groups of
   equally many pieces, each rounded up to its longest.
   The bound is the one of a few that ends in the fewest sequences.
3. For these few sizes, column generation finds the configurations (how many of each size share a
   sequence) and their multiples of the cutting-stock programme; multiples are rounded down.
4. Actual pieces replace the rounded ones, group by group in order of length; what is left over and
   then the small pieces go where they leave the least room (best fit), new sequences last.

All of this works on runs of equal sequences, so the plan has some thousand rows: for the k-th piece
of a length, its sequence and offset. Pieces get their k from counts by stored part and length, and
join the plan. No row of a piece passes through the driver.

Null and empty texts are documents of the end id alone. Equal and repeated rows are separate pieces
(rows that repeat a doc_id are placed separately too). Rows with a null doc_id are packed like others.
All ids of one very long document are held by one task before it is cut. Only doc_id and text are read;
other columns, whatever their names, are not. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """``PIECES`` of ``doc_id, text``: ids are little-endian unsigned 32-bit integers."""
    end, step = int(end_id).to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(tokenizer_path) as own:
            for batch in batches:
                out: list[list] = [[], [], [], [], []]
                held = 0
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = own.encode(text) + end
                    begin, stop = 0, len(ids) % step or step
                    k = 0
                    while begin < len(ids):
                        for column, value in zip(out, (doc_id, k, begin // 4, (stop - begin) // 4, ids[begin:stop]), strict=True):
                            column.append(value)
                        begin, stop, k = stop, stop + step, k + 1
                    held += len(ids)
                    if held > 1 << 23:
                        yield record(out)
                        out, held = [[], [], [], [], []], 0
                if held:
                    yield record(out)

    def record(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


@dataclass
class Plan:
    """``rows``: (length, first rank, count, first sequence, offset); piece ``first rank + i`` of that
    length lies in sequence ``first sequence + i`` at ``offset``."""

    capacity: int
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def groups_of(counts: dict[int, int], groups: int) -> list[dict[int, int]]:
    """Lengths in falling order dealt into groups of equally many pieces; a length may span groups."""
    total = sum(counts.values())
    out: list[dict[int, int]] = []
    if not total:
        return out
    size = -(-total // groups)
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append({})
                room = size
            take = min(left, room)
            out[-1][length] = take
            left, room = left - take, room - take
    return out


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over few sizes: the configuration of the largest value."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    by_size, by_value = sizes[order], values[order]
    fits = np.searchsorted(by_size, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fits[room]:
            gains = best[room - by_size[:n]] + by_value[:n]
            k = int(gains.argmax())
            if gains[k] > best[room] + 1e-12:
                best[room], choice[room] = gains[k], order[k]
    held, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            held[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(best[capacity]), held


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Column generation for the cutting-stock programme; (configuration, multiple rounded down)."""
    basis = np.diag(np.floor(capacity / sizes))
    amounts = np.linalg.solve(basis, demand)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = best_configuration(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, column)
        up = change > 1e-9
        if not up.any():
            break
        ratios = np.where(up, amounts / np.where(up, change, 1), np.inf)
        k = int(ratios.argmin())
        step = max(0.0, ratios[k])
        amounts = np.maximum(amounts - step * change, 0)
        basis[:, k], amounts[k] = column, step
    return [(basis[:, k].astype(np.int64), int(amounts[k] + 1e-6)) for k in range(len(sizes)) if amounts[k] >= 1 - 1e-6]


def plan_sequences(counts: dict[int, int], capacity: int, groups: int = 96, smalls: tuple[float, ...] = (8, 3, 2)) -> Plan:
    """The plan with the fewest sequences among those for each bound ``capacity / small`` of large lengths.

    ``counts``: length -> pieces, lengths from 1 to ``capacity``. Grouping loses up to the width of a
    group for each large piece, which small pieces must fill; how many there are decides the bound.
    """
    return min((plan_with(counts, capacity, groups, x) for x in smalls), key=lambda p: p.sequences)


def plan_with(counts: dict[int, int], capacity: int, groups: int, small: float) -> Plan:
    plan, used = Plan(capacity), dict.fromkeys(counts, 0)
    runs: dict[int, list[tuple[int, int]]] = {}  # free room -> runs of (first sequence, count)

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        plan.rows.append((length, used[length], n, sequence, offset))
        used[length] += n

    if full := counts.get(capacity, 0):
        put(capacity, full, 0, 0)
        plan.sequences = full
    large = {x: n for x, n in counts.items() if capacity / small < x < capacity and n > 0}
    dealt = groups_of(large, groups)
    left = [sorted(g.items(), reverse=True) for g in dealt]  # still to be placed, longest first
    merged: dict[int, list[int]] = {}
    for k, g in enumerate(dealt):
        merged.setdefault(max(g), []).append(k)
    sizes = np.array(sorted(merged, reverse=True), np.int64)
    if len(sizes):
        demand = np.array([sum(sum(dealt[k].values()) for k in merged[s]) for s in sizes.tolist()], float)
        pools = [[x for k in merged[s] for x in left[k]] for s in sizes.tolist()]
        for configuration, multiple in configurations(sizes, demand, capacity):
            first, plan.sequences = plan.sequences, plan.sequences + multiple
            open_runs = [(first, multiple, 0)]  # first sequence, count, filled
            for k in np.repeat(np.arange(len(sizes)), configuration).tolist():
                after = []
                for sequence, n, filled in open_runs:
                    while n and pools[k]:
                        length, there = pools[k][0]
                        take = min(n, there)
                        put(length, take, sequence, filled)
                        after.append((sequence, take, filled + length))
                        pools[k][0] = (length, there - take)
                        if take == there:
                            pools[k].pop(0)
                        sequence, n = sequence + take, n - take
                    if n:
                        after.append((sequence, n, filled))
                open_runs = after
            for sequence, n, filled in open_runs:
                runs.setdefault(capacity - filled, []).append((sequence, n))
    for length in sorted(counts, reverse=True):
        n = counts[length] - used[length]
        while n:
            room = next((r for r in range(length, capacity + 1) if runs.get(r)), None)
            if room is None:
                each = capacity // length
                opened = -(-n // each)
                runs.setdefault(capacity, []).append((plan.sequences, opened))
                plan.sequences += opened
                continue
            sequence, there = runs[room].pop()
            take = min(n, there)
            put(length, take, sequence, capacity - room)
            if take < there:
                runs[room].append((sequence + take, there - take))
            runs.setdefault(room - length, []).append((sequence, take))
            n -= take
    return plan


def pack_sequences(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, groups: int = 96, columns: dict[str, Column] | None = None
) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, sequence_id, offset, and ``columns``.

    ``columns`` are computed from ``ids``, the piece's ids as binary; by default the ids themselves
    are returned.
    """
    columns = {"ids": F.col("ids")} if columns is None else columns
    pieces = cut_pieces(docs, tokenizer_path, end_id, capacity)
    pieces = pieces.select("doc_id", "piece", "start", "length", *[c.alias(k) for k, c in columns.items()])
    pieces = saved(pieces.withColumn("_part", F.spark_partition_id()), "pieces")

    by_part = pieces.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("_part", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}

    plan = plan_sequences(histogram, capacity, groups)
    schema = "_length long, _first long, _count long, _sequence long, offset long"
    plan_rows = docs.sparkSession.createDataFrame(plan.rows, schema)
    within = Window.partitionBy("_part", "length").orderBy("doc_id", "piece")
    placed = pieces.withColumn("_k", F.row_number().over(within) - 1).join(starts, ["_part", "length"])
    placed = placed.withColumn("_k", F.col("_k") + F.col("_before"))
    at = (F.col("length") == F.col("_length")) & (F.col("_k") >= F.col("_first")) & (F.col("_k") < F.col("_first") + F.col("_count"))
    # the plan's rows depend on capacity and groups, not on the corpus
    placed = placed.join(F.broadcast(plan_rows), at)
    sequence = (F.col("_sequence") + F.col("_k") - F.col("_first")).cast("long")
    return placed.select("doc_id", "piece", "start", "length", *columns, sequence.alias("sequence_id"), "offset")
