"""Best-fit packing with certified bounds.

Documents become pieces of at most `capacity` ids. Pieces are dealt by hash into partitions of about
`group` pieces; each partition is packed by best-fit decreasing and its bin count is compared with
lower bounds from dual feasible functions. A partition that meets its bound keeps its bins. One with
a gap keeps its fullest bins and hands the pieces of the others on; these meet pieces of other such
partitions in fewer, new partitions, and are packed again, `rounds` times at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import lean, written
from tessella.llm.tokenbin import encode_column

#: Pieces in a partition, on average, and the most rounds of exchange.
GROUP, ROUNDS = 20_000, 4
#: Orders that the only partition of a round tries while its bound isn't met.
ORDERS = 4
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(lengths: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """A certified least number of bins: the best of several dual feasible functions.

    The functions are the identity, the threshold function (pieces above capacity - e count whole,
    those below e not at all) for every e up to half the capacity, and the rounding functions of
    order k (k + 1 times the size, rounded down, over k; exact multiples keep their size).
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, counts, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    many, mass = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(1, capacity // 2 + 1)
    whole = many[-1] - many[capacity - e]
    middle = mass[capacity - e] - mass[e - 1]
    best = max(best, int((-(-(whole * capacity + middle) // capacity)).max(initial=0)))
    for k in range(1, 33):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        value = np.where(exact, k * size, (scaled // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int, by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing (or in decreasing order of `by`): the bin and the offset of each piece, and the room left in each bin."""
    order = np.argsort(-(lengths if by is None else by), kind="stable")
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    mask = 0  # bit r is set if a bin has exactly room r
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fit = mask >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(rooms)
            rooms.append(capacity)
        bin_of[i], offset[i] = b, capacity - room
        rooms[b] = room = room - n
        if room:
            by_room.setdefault(room, []).append(b)
            mask |= 1 << room
    return bin_of, offset, np.asarray(rooms, np.int64)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: its ids and the end id, cut into runs of `capacity`; the first may be shorter.

    A null text has the end id only. Rows that repeat give pieces of their own. Other columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_of = batch.column(0)
            for a, b, ids, at in encode_column(batch.column(1), vocabulary, end_id):
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                n = np.diff(at)
                many = -(-n // capacity)
                doc = np.repeat(np.arange(b - a), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                head = n - (many - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip((at[doc] + start).tolist(), (at[doc] + start + length).tolist())]
                yield pa.RecordBatch.from_arrays([ids_of.slice(a, b - a).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(cut), PIECE)


def _placer(capacity: int, turn: int, last: bool, only: bool):
    """Packs one partition's pieces; marks those that are handed on. The only partition tries other orders instead."""

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy(np.int64)
        bin_of, offset, room = best_fit(lengths, capacity)
        least = lower_bound(lengths, capacity)
        rng = np.random.default_rng(turn)
        for _ in range(ORDERS if only else 0):
            if len(room) == least:
                break
            other = best_fit(lengths, capacity, lengths * rng.uniform(0.9, 1.1, len(lengths)))
            if len(other[2]) < len(room):
                bin_of, offset, room = other
        gap = len(room) - least
        again = np.zeros(len(room), bool)
        if gap > 0 and not last:
            emptiest = np.argsort(-room, kind="stable")
            waste = np.cumsum(room[emptiest])
            again[emptiest[: np.searchsorted(waste, 8 * (gap + 1) * capacity) + 1]] = True
            again &= room > 0
        number = (turn << 57) + (pdf["dealt"].to_numpy(np.int64) << 24) + bin_of
        return pdf.assign(sequence_id=number, offset=offset, again=again[bin_of], gap=np.int64(gap)).drop(columns="dealt")

    return place


def pack(rows: DataFrame, capacity: int = 1024, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns of PIECE, lengths 1 to capacity).

    Every row gets a place; sequences are filled gapless from offset 0. Rows are dealt by a hash of
    what they hold and of their place in the table, so that repeated rows and null ids spread evenly;
    rows must be a written table, in which places stay. An empty table gives no rows.
    """
    todo, done = rows, []
    for turn in range(rounds):
        last = turn == rounds - 1
        n = todo.count()
        if n == 0:
            break
        groups = max(1, -(-n // group))

        dealt = todo.select("doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups)).alias("dealt"))
        placed = written(dealt.groupBy("dealt").applyInPandas(_placer(capacity, turn, last, groups == 1), f"{PIECE}, sequence_id long, offset long, again boolean, gap long"), "packed")
        done.append(placed.filter(~F.col("again")).drop("again", "gap"))
        todo = placed.filter("again").drop("again", "gap", "sequence_id", "offset")
        if groups == 1:
            done[-1] = placed.drop("again", "gap")
            break
    if not done:
        return rows.limit(0).selectExpr("*", "0L AS sequence_id", "0L AS offset")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def certificate(packed: DataFrame, capacity: int = 1024) -> tuple[int, int]:
    """(sequences used, certified least number) of a packing; gathers one count for each length."""
    used = packed.filter("offset = 0").count()
    hist = packed.groupBy("length").count().collect()  # at most capacity rows
    lengths = np.array([r["length"] for r in hist], np.int64)
    counts = np.array([r["count"] for r in hist], np.int64)
    return used, lower_bound(lengths, capacity, counts)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, group: int = GROUP, rounds: int = ROUNDS, **columns: str) -> DataFrame:
    """Pieces of every document with their places. An empty table gives no rows."""
    cut = written(pieces(docs, vocabulary, capacity, end_id, **columns), "pieces")
    return pack(cut, capacity, group, rounds)
