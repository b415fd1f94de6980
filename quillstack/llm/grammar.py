"""Token-id shards as Re-Pair grammars.

A block holds the ids of some documents, one after the other, each ended by the end id.  In
rounds, the most frequent neighbouring pairs are replaced by new nonterminals until a round
no longer pays.  No pair may hold the end id, so no nonterminal crosses a document and each
document can be decoded alone.  A round takes many pairs at once: pairs are counted in a hash
table of slots, each frequent slot stands for one pair of its own, and where candidates
overlap the more frequent one wins.

File format: Parquet rows (part, block, documents, ids, payload) in the shared folder, in
ascending document order by (part, block).  A payload is a header of nine little-endian
64-bit numbers, then the document ids (int64), numbers of ids and of symbols per document
(uint32), a bit for each id that isn't null, and, each number in as many bits as the largest needs, left and right sides of the
rules, their expansion lengths, and the symbols.  Nothing else is compressed, so a document's
symbols can be read where they stand.

The rounds stop when a pair occurs fewer than ``least`` times (four: a rule costs two sides and a
length) or a round saves less than ``gain`` of the symbols.

Edge cases: null and empty texts are one end id; repeated ids follow each other, ordered by a
hash of the text; null ids come first; an empty table gives an empty file and result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, shared_path
from .tokens import END_ID, crc32_of, default_vocabulary, encoder, gather, slices

BASE = 1 << 16  # nonterminals are numbered from here on at least, and from beyond the largest id
MAGIC = 0x32525051
SLOTS = 1 << 18
BLOCK_BYTES = 4 << 20  # of text
SCHEMA = "part int, block int, documents long, ids long, payload binary"


@dataclass
class Grammar:
    left: np.ndarray
    right: np.ndarray
    symbols: np.ndarray
    base: int = BASE

    def lengths(self) -> np.ndarray:
        """Expansion lengths of the rules; a rule's sides come before it."""
        out = np.ones(len(self.left), np.int64)
        for lo, hi in self._levels():
            out[lo:hi] = self._of(out, self.left[lo:hi]) + self._of(out, self.right[lo:hi])
        return out

    def _of(self, lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        rule = symbols.astype(np.int64) - self.base
        return np.where(rule < 0, 1, lengths[np.maximum(rule, 0)] if len(lengths) else 1)

    def _levels(self) -> Iterator[tuple[int, int]]:
        """Runs of rules whose sides all come before the run."""
        newest = np.maximum.accumulate(np.maximum(self.left, self.right).astype(np.int64)) - self.base if len(self.left) else np.zeros(0, np.int64)
        lo = 0
        while lo < len(newest):
            hi = int(np.searchsorted(newest, lo))
            hi = max(hi, lo + 1)
            yield lo, hi
            lo = hi


def compress(ids: np.ndarray, least: int = 4, gain: float = 0.002) -> Grammar:
    """``least``: occurrences that make a pair worth a rule. ``gain``: share of symbols a round must save."""
    seq = ids.astype(np.uint32)
    base = max(BASE, 1 << int(ids.max(initial=0)).bit_length())
    if base + len(ids) > 1 << 32:
        raise ValueError("ids leave no room for rules in 32 bits")
    left, right = [], []
    rules = 0
    table = np.zeros(SLOTS, np.uint64)
    rule = np.zeros(SLOTS, np.uint32)
    # places of pairs that may be frequent: a pair that occurs too rarely never comes to occur more often
    at = np.arange(max(len(seq) - 1, 0))
    while len(at):
        a, b = (seq[:-1], seq[1:]) if len(at) == len(seq) - 1 else (seq[at], seq[at + 1])
        slot = (((a * np.uint32(2654435761)) ^ (b * np.uint32(2246822519) + np.uint32(374761393))) >> np.uint32(14)).astype(np.int64)
        open_ = (np.bincount(slot, minlength=SLOTS) >= least)[slot]
        open_ &= a != END_ID
        open_ &= b != END_ID
        open_ = np.flatnonzero(open_)
        at, slot = at[open_], slot[open_]
        pair = a[open_].astype(np.uint64)
        pair <<= np.uint64(32)
        pair |= b[open_]
        # each slot stands for one of its pairs
        table[slot] = pair
        fits = np.flatnonzero(table[slot] == pair)
        own = slot[fits]
        value = np.bincount(own, minlength=SLOTS).astype(np.int32)[own]
        frequent = value >= least
        open_ = np.ones(len(at), bool)
        open_[fits[~frequent]] = False
        frequent = np.flatnonzero(frequent)
        place, own, value = at[fits[frequent]], own[frequent], value[frequent]
        # of neighbours with one value every other one wins, from the first that no higher one blocks
        beside = place[1:] - place[:-1] == 1
        blocked = np.zeros(len(place), bool)
        blocked[1:] = beside & (value[:-1] > value[1:])
        wins = ~blocked
        inner = np.flatnonzero(beside & (value[1:] == value[:-1])) + 1
        first = np.arange(len(place))
        first[inner] = 0
        first = np.maximum.accumulate(first)[inner]
        wins[inner] = ((place[inner] - place[first] - blocked[first]) & 1) == 0
        wins[:-1] &= ~beside | (value[:-1] >= value[1:])
        used = np.bincount(own[wins], minlength=SLOTS)
        wins &= (used >= least)[own]
        where = place[wins]
        if len(where) < max(gain * len(seq), least):
            break
        chosen = np.flatnonzero(used >= least)
        rule[chosen] = base + rules + np.arange(len(chosen))
        left.append((table[chosen] >> np.uint64(32)).astype(np.uint32))
        right.append(table[chosen].astype(np.uint32))
        rules += len(chosen)
        seq[where] = rule[own[wins]]
        live = np.zeros(len(seq), bool)
        live[at[open_]] = True
        live[where] = True
        live[where[where > 0] - 1] = True
        stay = np.ones(len(seq), bool)
        stay[where + 1] = False
        seq = seq[stay]
        at = np.flatnonzero(live[stay][:-1])
    empty = np.zeros(0, np.uint32)
    return Grammar(np.concatenate(left or [empty]), np.concatenate(right or [empty]), seq, base)


def expand(grammar: Grammar, symbols: np.ndarray | None = None) -> np.ndarray:
    """The ids of the symbols given, or of all."""
    base = grammar.base
    store = np.arange(base, dtype=np.uint32)
    starts = np.concatenate((np.arange(base), np.zeros(len(grammar.left), np.int64)))
    sizes = np.concatenate((np.ones(base, np.int64), np.zeros(len(grammar.left), np.int64)))
    for lo, hi in grammar._levels():
        sides = np.column_stack((grammar.left[lo:hi], grammar.right[lo:hi])).ravel()
        each = sizes[sides]
        own = each[0::2] + each[1::2]
        starts[base + lo : base + hi] = len(store) + np.cumsum(own) - own
        sizes[base + lo : base + hi] = own
        store = np.concatenate((store, gather(store, starts[sides], each)))
    of = grammar.symbols if symbols is None else symbols
    return gather(store, starts[of], sizes[of])


def unfolded(grammar: Grammar, symbols: np.ndarray) -> np.ndarray:
    """The ids of a few symbols: all rules among them give way to their sides, again and again; no other
    rule is looked at."""
    seq = symbols.astype(np.int64)
    left, right = grammar.left.astype(np.int64), grammar.right.astype(np.int64)
    while (rule := seq >= grammar.base).any():
        wide = np.repeat(seq, 1 + rule)
        second = np.flatnonzero(np.repeat(rule, 1 + rule))[1::2]
        own = seq[rule] - grammar.base
        wide[second - 1], wide[second] = left[own], right[own]
        seq = wide
    return seq.astype(np.uint32)


def packed(values: np.ndarray, width: int) -> bytes:
    """Whole numbers in ``width`` bits each."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8)[:, : -(-width // 8)], axis=1, count=width, bitorder="little")
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpacked(raw: bytes, at: int, width: int, first: int, n: int) -> np.ndarray:
    """Numbers first .. first + n of those that ``packed`` has put at a place in ``raw``: only their bytes are read."""
    low = first * width
    start, stop = at + low // 8, at + -(-(low + n * width) // 8)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, stop - start, start), bitorder="little")[low % 8 : low % 8 + n * width]
    out = np.zeros((n, 8), np.uint8)
    out[:, : -(-width // 8)] = np.packbits(bits.reshape(n, width), axis=1, bitorder="little")
    return out.view("<i8").ravel()


def _bytes(n: int, width: int) -> int:
    return -(-n * width // 8)


@dataclass
class Block:
    """Documents of a block. Symbols stay packed until they are asked for."""

    doc_ids: pa.Array
    sizes: np.ndarray
    symbols_each: np.ndarray
    grammar: Grammar  # without symbols where ``raw`` holds them
    rule_lengths: np.ndarray
    raw: tuple[bytes, int, int, int] | None = None  # payload, where symbols start, their width, how many

    @classmethod
    def of(cls, doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> Block:
        grammar = compress(ids)
        lengths = grammar.lengths()
        ends = np.cumsum(grammar._of(lengths, grammar.symbols))
        stops = np.searchsorted(ends, bounds[1:]) + 1
        return cls(doc_ids, np.diff(bounds), np.diff(stops, prepend=0), grammar, lengths)

    def to_bytes(self) -> bytes:
        g = self.grammar
        width = max(1, int(g.base + len(g.left)).bit_length())
        length_width = max(1, int(self.rule_lengths.max(initial=1)).bit_length())
        head = np.array([MAGIC, len(self.doc_ids), int(self.sizes.sum()), len(g.symbols), len(g.left), g.base, END_ID, width, length_width], "<i8")
        known = self.doc_ids.is_valid().to_numpy(zero_copy_only=False)
        tables = [head, self.doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), self.sizes.astype("<u4"), self.symbols_each.astype("<u4")]
        return b"".join([*(x.tobytes() for x in tables), packed(known, 1), packed(g.left, width), packed(g.right, width), packed(self.rule_lengths, length_width), packed(g.symbols, width)])

    @classmethod
    def from_bytes(cls, payload: bytes) -> Block:
        magic, docs, _, symbols, rules, base, end, width, length_width = np.frombuffer(payload, "<i8", 9).tolist()
        if magic != MAGIC or base < BASE or end != END_ID:
            raise ValueError("not a block of this format")
        at = 72 + 8 * docs
        sizes, each = np.frombuffer(payload, "<u4", docs, at), np.frombuffer(payload, "<u4", docs, at + 4 * docs)
        at += 8 * docs
        known = unpacked(payload, at, 1, 0, docs) == 1
        at += _bytes(docs, 1)
        sides = []
        for w in (width, width, length_width):
            sides.append(unpacked(payload, at, w, 0, rules))
            at += _bytes(rules, w)
        left, right, lengths = sides
        grammar = Grammar(left.astype(np.uint32), right.astype(np.uint32), np.zeros(0, np.uint32), base)
        return cls(pa.array(np.frombuffer(payload, "<i8", docs, 72), mask=~known), sizes.astype(np.int64), each.astype(np.int64), grammar, lengths, (payload, at, width, symbols))

    def _symbols(self, first: int, n: int) -> np.ndarray:
        if self.raw is None:
            return self.grammar.symbols[first : first + n]
        payload, at, width, _ = self.raw
        return unpacked(payload, at, width, first, n).astype(np.uint32)

    def ids(self) -> np.ndarray:
        """The ids of all documents."""
        return expand(self.grammar, self._symbols(0, int(self.symbols_each.sum())))

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start .. stop of the k-th document: its symbols are read, and by the rules' lengths only those
        that cover the place are unfolded."""
        stop = int(self.sizes[k]) if stop is None else min(stop, int(self.sizes[k]))
        own = self._symbols(int(self.symbols_each[:k].sum()), int(self.symbols_each[k]))
        ends = np.cumsum(self.grammar._of(self.rule_lengths, own))
        lo, hi = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop)) + 1
        before = int(ends[lo - 1]) if lo else 0
        return unfolded(self.grammar, own[lo:hi])[start - before : stop - before]


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> None:
    """Writes the documents' ids in ascending id order."""
    words = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text", BLOCK_BYTES):
                ids, bounds = encoder(words).encode_documents(piece.column("text"))
                own = piece.column("doc_id")
                payload = Block.of(own, ids, bounds).to_bytes()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], ["part", "block", "documents", "ids", "payload"])
                block += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    map_arrow(ordered, run, SCHEMA).write.parquet(path)


def read_ids(blocks: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, payload in zip(*(batch.column(k).to_pylist() for k in ("part", "block", "payload")), strict=True):
                got = Block.from_bytes(payload)
                bounds = np.concatenate(([0], np.cumsum(got.sizes)))
                n = len(got.sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(np.full(n, block, np.int32)),
                        got.doc_ids,
                        pa.array(bounds[:-1]),
                        pa.array(got.sizes),
                        pa.array(crc32_of(got.ids(), bounds)),
                    ],
                    ["part", "block", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    rows = map_arrow(blocks.select("part", "block", "payload"), run, "part int, block int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    totals = blocks.select("part", "block", "ids")
    of_parts = totals.groupBy("part").agg(F.sum("ids").alias("ids"))
    earlier = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_parts = of_parts.select("part", earlier.alias("before_part"))
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.withColumn("before_block", inside).join(of_parts, "part").select("part", "block", (F.col("before_block") + F.col("before_part")).alias("before"))
    return rows.join(starts, ["part", "block"]).select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = shared_path(spark, "token-ids")
    write_ids(docs, path)
    return read_ids(spark.read.schema(SCHEMA).parquet(path))
