"""SentencePiece encoding and decoding by a single Viterbi pass of an Aho-Corasick automaton.

The automaton holds all pieces.  At each position of a text its output links give the pieces
that end there, longest first, and the best way to that position is kept.  The scores of a
unigram model add up: ties keep the longer last piece, and a character that is no piece
costs the unknown score (10 below the lowest).  The scores of a BPE model are merge ranks: the
library merges neighbours whose joint text is a piece, the best score first and the leftmost of
equals, and adding those scores up gives other ids.  There a way is worth something only if
merging would end in it, which two neighbouring pieces tell by themselves (``MergeCodec``), so
at each position one way is left and the ids are the library's.  With both, a character
that is no piece comes out as its UTF-8 byte pieces.  Decoding gathers the bytes of the pieces and
undoes the space mark.

In this vocabulary a space mark only stands at the front of a piece, so a text falls apart
into chunks, each a run of marks with what follows, and neither merges nor the best
segmentation reach over their bounds; each distinct chunk of a batch is segmented once.

Edge cases: null and empty texts have no ids and decode to an empty text; runs of spaces,
leading and trailing spaces and control characters survive the round trip; a model whose
normaliser isn't the identity or whose pieces hold inner space marks is refused, and so is a
BPE model with unused or user-defined pieces; a space mark in a text itself is encoded as the
library does and decodes to a space; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .tokens import crc32_of, gather, slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED = 300_000
SLICE = 8 << 20  # bytes of text whose distinct words are looked up together
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")
_BY_PATH: dict[str, PieceCodec] = {}
_OF_TYPE: dict[str, PieceCodec] = {}
UNIGRAM, BPE = 1, 2
_START, _ODD = (1 << 20) - 1, 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
        else:
            size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield number, raw[at : at + size]
            at += size


def model_type(path: str) -> int:
    """model_type (field 3) of the trainer's spec (field 2), by default unigram."""
    with open(path, "rb") as file:
        spec = b"".join(v for k, v in _fields(file.read()) if k == 2)
    return ([v for k, v in _fields(spec) if k == 3] or [UNIGRAM])[-1]


def piece_types(path: str) -> set[int]:
    """The types of a model's pieces: field 3 of each field 1, by default normal (1)."""
    with open(path, "rb") as file:
        pieces = [v for k, v in _fields(file.read()) if k == 1]
    return {([v for k, v in _fields(piece) if k == 3] or [1])[-1] for piece in pieces}


class PieceCodec:
    """A model's scores taken as those of a unigram model."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.normalize(" a  ①\n") != f"{MARK}{MARK}a{MARK}{MARK}①\n":
            raise ValueError("only models that keep texts as they are")
        n = model.get_piece_size()
        self.byte = {}
        self.pieces: dict[str, tuple[int, float]] = {}
        stored = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                stored.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                stored.append(b"")
            else:
                self.pieces[piece] = (i, float(model.get_score(i)))
                stored.append(piece.replace(MARK, " ").encode())
        if len(self.byte) != 256 or any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("only models with byte pieces and space marks in front")
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.bytes = np.frombuffer(b"".join(stored), np.uint8)
        self.sizes = np.fromiter(map(len, stored), np.int64, n)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.seen: dict[str, list[int]] = {}

    def segment(self, chunk: str) -> list[int]:
        """Ids of the best segmentation of marked text."""
        n = len(chunk)
        lowest = float("-inf")
        best = [0.0] + [lowest] * n
        last: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        end = 0

        def reach(upto: int) -> None:
            """Characters before `upto` that no piece of their own covers cost the unknown score."""
            nonlocal end
            while end < upto:
                end += 1
                if chunk[end - 1] not in self.pieces and best[end - 1] + self.unknown > best[end]:
                    best[end], last[end] = best[end - 1] + self.unknown, (1, -1)

        for at, (size, piece, score) in self.automaton.iter(chunk):
            reach(at)
            total = best[at + 1 - size] + score
            if total > best[at + 1]:
                best[at + 1], last[at + 1] = total, (size, piece)
        reach(n)
        out: list[int] = []
        while n:
            size, piece = last[n]
            out += [piece] if piece >= 0 else [self.byte[b] for b in reversed(chunk[n - 1].encode())]
            n -= size
        return out[::-1]

    def _ids_of(self, word: str) -> list[int]:
        """A word is what lies between two spaces, with the mark of the first."""
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > CACHED:
                self.seen.clear()
            found = self.seen[word] = self.segment(MARK + word)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        words = pc.split_pattern(texts, " ")
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        found = [self._ids_of(w) for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        store = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(sizes[which])))
        ids, offsets = gather(store, starts[which], sizes[which]), ends[bounds]
        # texts with an empty word or marks of their own have runs of marks that belong to one chunk
        odd = pc.or_(pc.match_substring_regex(texts, f"^ |  | $|{MARK}"), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        if not odd.any():
            return ids, offsets
        parts, each = [], np.diff(offsets)
        for k in range(len(texts)):
            if odd[k]:
                text = texts[k].as_py()
                own = [i for chunk in _CHUNKS.findall(MARK + text.replace(" ", MARK)) for i in self.segment(chunk)] if text else []
                parts.append(np.array(own, np.uint32))
                each[k] = len(own)
            else:
                parts.append(ids[offsets[k] : offsets[k + 1]])
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(each)))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all texts, offsets of each); the mark in front goes."""
        sizes = self.sizes[ids]
        raw = gather(self.bytes, self.starts[ids], sizes)
        ends = np.concatenate(([0], np.cumsum(sizes)))[offsets]
        filled = np.diff(ends) > 0
        stay = np.ones(len(raw), bool)
        stay[ends[:-1][filled]] = False
        return raw[stay], ends - np.concatenate(([0], np.cumsum(filled)))


class MergeCodec(PieceCodec):
    """A model's scores taken as merge ranks, the highest first.

    A row of pieces is what merging makes of a text if and only if each two neighbours are what merging
    makes of the two alone: until a merge reaches over a bound between pieces, both sides go on as they would
    without the rest, and whether one does is between the two pieces at that bound.  So the merged form of
    a text's first p characters ends with the one piece that stands behind the merged form of what is before
    it.  The single pass of the automaton finds, at each position, that piece among its outputs; all other
    paths are worth nothing there."""

    def __init__(self, path: str):
        super().__init__(path)
        if piece_types(path) & {4, 5}:
            raise ValueError("only merge models without user-defined and unused pieces")
        self.ranks = {piece: -score for piece, (_, score) in self.pieces.items()}
        self.single = {p for p in self.pieces if len(p) == 1}
        self.stand: dict[int, bool] = {}

    def merged(self, chunk: str) -> list[str]:
        """The symbols of a text after all merges, one by one."""
        n, ranks = len(chunk), self.ranks
        # the symbol from i ends before after[i]; before[i] is where the one ahead of it starts
        after, before = list(range(1, n + 1)), list(range(-1, n))
        pairs = [(ranks[pair], i, i + 2) for i in range(n - 1) if (pair := chunk[i : i + 2]) in ranks]
        heapify(pairs)
        while pairs:
            _, i, end = heappop(pairs)
            middle = after[i]
            if middle >= end or middle < 0 or after[middle] != end:
                continue  # one of the two has been merged since
            after[i], after[middle] = end, -1
            before[end] = i
            if end < n and (rank := ranks.get(chunk[i : after[end]])) is not None:
                heappush(pairs, (rank, i, after[end]))
            if i and (rank := ranks.get(chunk[before[i] : end])) is not None:
                heappush(pairs, (rank, before[i], end))
        out, i = [], 0
        while i < n:
            out.append(chunk[i : after[i]])
            i = after[i]
        return out

    def _stands(self, chunk: str, start: int, middle: int, end: int) -> bool:
        """Whether chunk[middle:end] stays as it is behind chunk[start:middle], or alone where that is empty."""
        behind, piece = chunk[start:middle], chunk[middle:end]
        return self.merged(behind + piece) == ([behind, piece] if behind else [piece])

    def segment(self, chunk: str) -> list[int]:
        """Ids of marked text after all merges. A character that is no piece has a number of its own here."""
        n, stand = len(chunk), self.stand
        if len(stand) > 8 * CACHED:
            stand.clear()
        last, sizes = [-1] * (n + 1), [0] * (n + 1)  # the piece that ends at each position, and its length
        last[0] = _START
        odd = {} if self.single.issuperset(chunk) else {i: _ODD + ord(c) for i, c in enumerate(chunk) if c not in self.single}
        done = 0

        def relax(end: int, size: int, piece: int) -> None:
            middle = end - size
            if last[end] < 0 <= last[middle]:
                key = last[middle] << 22 | piece
                holds = stand.get(key)
                if holds is None:
                    holds = stand[key] = self._stands(chunk, middle - sizes[middle], middle, end)
                if holds:
                    last[end], sizes[end] = piece, size

        if odd:
            for at, (size, piece, _) in self.automaton.iter(chunk):
                for i in range(done, at):
                    if i in odd:
                        relax(i + 1, 1, odd[i])
                done = max(done, at)
                relax(at + 1, size, piece)
            for i in range(done, n):
                if i in odd:
                    relax(i + 1, 1, odd[i])
        else:
            for at, (size, piece, _) in self.automaton.iter(chunk):
                end = at + 1
                if last[end] < 0 <= (behind := last[end - size]):
                    key = behind << 22 | piece
                    holds = stand.get(key)
                    if holds is None:
                        holds = stand[key] = self._stands(chunk, end - size - sizes[end - size], end - size, end)
                    if holds:
                        last[end], sizes[end] = piece, size
        out: list[int] = []
        while n:
            piece = last[n]
            out += [piece] if piece < _ODD else [self.byte[b] for b in reversed(chunk[n - 1].encode())]
            n -= sizes[n]
        return out[::-1]


def codec(path: str) -> PieceCodec:
    if path not in _BY_PATH:
        _BY_PATH[path] = PieceCodec(path)
    return _BY_PATH[path]


def library_codec(path: str) -> PieceCodec:
    """The codec that reads the scores as the model's type asks."""
    if path not in _OF_TYPE:
        kind = model_type(path)
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")
        _OF_TYPE[path] = MergeCodec(path) if kind == BPE else codec(path)
    return _OF_TYPE[path]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of each text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, offsets = library_codec(path).encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows of ``encoded``."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            raw, offsets = library_codec(path).decode(ids, lists.offsets.to_numpy() - lists.offsets[0].as_py())
            text = pa.Array.from_buffers(pa.large_string(), len(lists), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text.cast(pa.string())], ["doc_id", "text"])

    return map_arrow(rows.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document: doc_id, n_pieces, ids_crc32, and whether decoding gives the text back; one pass."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                own = library_codec(path)
                ids, offsets = own.encode(part.column("text"))
                raw, at = own.decode(ids, offsets)
                text = pc.fill_null(part.column("text").cast(pa.large_string()), "")
                size = pc.binary_length(text).to_numpy(zero_copy_only=False)
                view = memoryview(np.ascontiguousarray(raw))
                same = [b - a == n and bytes(view[a:b]) == t.as_buffer().to_pybytes() for a, b, n, t in zip(at[:-1].tolist(), at[1:].tolist(), size.tolist(), text, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(crc32_of(ids, offsets)), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "restored"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_pieces long, ids_crc32 long, restored boolean")
