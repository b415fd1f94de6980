"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are whole numbers from 1 to the capacity, so the instance is its histogram: the
driver plans on at most ``capacity`` numbers, whatever the number of documents.

1. Reduction.  Each open length w with room r = capacity - w, longest first and again until none
   changes, is fixed for good with
   * nothing, if no open piece fits the room;
   * one piece of the longest fitting length v, if v fills the room, or if no three open pieces
     fit it and no two together with more than v (a set with w then never gains by holding
     other pieces);
   applied to as many pieces at once as the counts allow.
2. What is left goes best-fit, longest first: each piece into the fullest sequence that holds
   it.  Sequences of equal filling are one entry with a count, so a step places many pieces.

The plan is a list of segments (length, first rank, places a sequence, first sequence,
offset).  Pieces get their rank within their length by counting over hashed buckets, never in
one task, and meet their segment in a join on the length and the range of ranks.

Edge cases: null and empty texts are one end id; repeated ids are separate documents; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stored
from .tokens import crc32_of, default_vocabulary, encoder, slices

CAPACITY = 4096
PIECES = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long"
Segment = tuple[int, int, int, int, int, int]


def _dominating(w: int, open_: list[int], left: dict[int, int], capacity: int) -> int | None:
    """The length that joins w for good, 0 for none, or None where no rule holds. open_ ascends."""
    room = capacity - w
    count = lambda v: left[v] - (v == w)
    i = bisect.bisect_right(open_, room) - 1
    while i >= 0 and count(open_[i]) < 1:
        i -= 1
    if i < 0:
        return 0
    best = open_[i]
    if best == room:
        return best
    least: list[int] = []
    for v in open_:  # do the three smallest pieces fit?
        least += [v] * min(3 - len(least), count(v))
        if len(least) == 3:
            if sum(least) <= room:
                return None
            break
    lo, hi = 0, i
    while lo <= hi:  # is there a pair that fits and holds more than the best single piece?
        a, b = open_[lo], open_[hi]
        if a + b > room or count(b) < 1:
            hi -= 1
        elif a + b > best and count(a) > (a == b):
            return None
        else:
            lo += 1
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Segment], int, int]:
    """(segments, sequences, sequences fixed by dominance). A segment: length, first rank, last
    rank + 1, places a sequence, first sequence, offset of the first place."""
    left = {w: c for w, c in histogram.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    open_ = sorted(left)
    segments: list[Segment] = []
    bins = 0

    def place(w: int, n: int, each: int, first: int, offset: int) -> None:
        segments.append((w, rank[w], rank[w] + n, each, first, offset))
        rank[w] += n
        left[w] -= n
        if not left[w]:
            open_.pop(bisect.bisect_left(open_, w))

    def fix(w: int) -> bool:
        """Places pieces of length w for good where a rule holds."""
        nonlocal bins
        mate = _dominating(w, open_, left, capacity)
        if mate is None:
            return False
        if mate == 0:
            n = left[w]
            place(w, n, 1, bins, 0)
        elif mate == w:
            n = left[w] // 2
            place(w, 2 * n, 2, bins, 0)
        else:
            n = min(left[w], left[mate])
            place(w, n, 1, bins, 0)
            place(mate, n, 1, bins, w)
        bins += n
        return True

    changed = True
    while changed:
        changed = False
        for w in open_[::-1]:
            while left[w] and fix(w):
                changed = True
    fixed = bins

    rooms: list[int] = []  # ascending; partly filled sequences by the room left
    runs: dict[int, list[tuple[int, int]]] = {}  # (first sequence, how many)

    def put_back(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((first, n))

    while open_:
        w = open_[-1]
        while left.get(w):
            i = bisect.bisect_left(rooms, w)
            if i == len(rooms):
                each = capacity // w
                n = -(-left[w] // each)
                room, first = capacity, bins
                bins += n
            else:
                room = rooms[i]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(i)
            each = room // w
            full = min(n, left[w] // each)
            if full:
                place(w, full * each, each, first, capacity - room)
                put_back(room - each * w, first, full)
            rest = min(left[w], each) if full < n else 0
            if rest:
                place(w, rest, rest, first + full, capacity - room)
                put_back(room - rest * w, first + full, 1)
            put_back(room, first + full + bool(rest), n - full - bool(rest))
    return segments, bins, fixed


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of a document's ids: PIECES. row_key tells repeated ids apart."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = encoder(path).encode_documents(part.column("text"))
                sizes = np.diff(bounds)
                many = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc)),
                        part.column("row_key").take(pa.array(doc)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc32_of(ids, np.append(bounds[:-1][doc] + start, bounds[-1])), pa.int64()),
                    ],
                    ["doc_id", "row_key", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, PIECES)


def pack(found: DataFrame, capacity: int = CAPACITY, a_bucket: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to rows of PIECES."""
    spark = found.sparkSession
    # a row's place in the table tells equal rows apart: however often one occurs, its pieces fill many buckets
    found = stored(found.withColumn("place", F.monotonically_increasing_id()), "pack-pieces")
    by_length = found.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_length.collect()}  # at most `capacity` rows
    segments, _, _ = plan(histogram, capacity)
    buckets = max(16, sum(histogram.values()) // a_bucket)
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = stored(counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before")), "pack-starts")
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("place")) - 1
    ranked = dealt.withColumn("within", within).join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    return map_arrow(ranked.select(*found.drop("place").columns, "rank"), _placer(segments), f"{PIECES}, sequence_id long, offset long")


def _placer(segments: list[Segment]):
    """The plan travels with the task. Each segment uses up a length, an entry of sequences or what is left of one, so
    there are a few for each length and filling: 3,000 for the lengths of sf0.1, six numbers each."""
    known = np.array(sorted(segments), np.int64).reshape(-1, 6)
    keys = (known[:, 0] << 48) + known[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            _, first, last, places, base, offset = known[at].T
            if not (rank < last).all():
                raise ValueError("a piece has no place in the plan")
            row, column = np.divmod(rank - first, places)
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(base + row), pa.array(offset + column * length)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run
