"""Token ids of whole texts, by the ``tokenizers`` library over distinct words.

White space always ends a pre-token in the word-level vocabulary, so the ids of a text are
the ids of its ASCII-space separated chunks, one after the other.  Arrow cuts a batch of
texts into chunks and finds the distinct ones.  Plain chunks (ASCII and Latin letters, which
NFC leaves alone) are lower-cased and cut into pre-tokens by Arrow with the vocabulary's own
pattern; the library then encodes the distinct pre-tokens, many to a call, with its model
and byte map and nothing else to do.  All other chunks go through the library's whole
pipeline one by one.  Either way the ids equal ``Tokenizer.encode`` on each text.
Pre-tokens met before are looked up in a cache of bounded size.

Nulls and empty texts have no ids.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
CACHED_PARTS = 400_000
_WORD_END = "</w>"
#: chunks with anything else take the whole pipeline
_ODD = r"[^\x21-\x7E\x{A1}-\x{12F}\x{131}-\x{148}\x{14A}-\x{17E}]|<\|"
_PARTS = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\t-\r \p{L}\p{N}]+)"
_BY_PATH: dict[str, DistinctWordEncoder] = {}


def default_vocabulary() -> str:
    """Path of the public word-level vocabulary; a parameter everywhere it is used."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _offsets(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs values[start : start + size], one after the other."""
    at = _offsets(sizes)
    take = np.repeat(starts - at[:-1], sizes)
    take += np.arange(at[-1])
    return values[take]


class DistinctWordEncoder:
    """Encodes Arrow string arrays."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        split, byte_map = spec["pre_tokenizer"]["pretokenizers"]
        if spec["model"].get("end_of_word_suffix") != _WORD_END or split["type"] != "Split":
            raise ValueError("a word-level BPE vocabulary with </w> is needed")
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_map]}
        self.model = Tokenizer.from_str(json.dumps(spec))
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(_WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.slot = {"": 0}
        self.starts, self.sizes, self.store = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, parts: list[str]) -> None:
        runs = [" ".join(parts[i : i + 1000]) for i in range(0, len(parts), 1000)]
        found = self.model.encode_batch_fast(runs, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        stops = np.flatnonzero(self.ends[ids]) + 1
        base = len(self.starts)
        self.slot.update(zip(parts, range(base, base + len(parts)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.store) + np.concatenate(([0], stops[:-1]))))
        self.sizes = np.concatenate((self.sizes, np.diff(stops, prepend=0)))
        self.store = np.concatenate((self.store, ids))

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words), _PARTS, r" \1 "))
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        distinct, which = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        if len(distinct) == 0:
            return np.zeros(0, np.uint32), np.diff(bounds)
        whole = pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct.cast(pa.string()))
        parts = pc.binary_join(whole, " ")[0].as_py().split(" ")
        if len(self.slot) > CACHED_PARTS:
            self._forget()
        slot = np.fromiter(map(self.slot.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        if len(fresh := np.flatnonzero(slot < 0)):
            slot[fresh] = np.arange(len(self.starts), len(self.starts) + len(fresh))
            self._learn([parts[i] for i in fresh.tolist()])
        slot = slot[which]
        sizes = self.sizes[slot]
        return gather(self.store, self.starts[slot], sizes), np.diff(_offsets(sizes)[bounds])

    def _odd(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter((len(x) for x in found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of each text); no end ids yet."""
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        bounds = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        coded = chunks.flatten().dictionary_encode()
        words, which = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(words, _ODD)
        (ids, few), (more, many) = self._plain(words.filter(pc.invert(odd))), self._odd(words.filter(odd))
        odd = odd.to_numpy(zero_copy_only=False)
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[~odd], sizes[~odd] = _offsets(few)[:-1], few
        starts[odd], sizes[odd] = len(ids) + _offsets(many)[:-1], many
        store = np.concatenate((ids, more))
        return gather(store, starts[which], sizes[which]), _offsets(sizes[which])[bounds]

    def encode_documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the end id after each text."""
        ids, bounds = self.encode(texts)
        bounds = bounds + np.arange(len(bounds))
        inner = np.ones(int(bounds[-1]), bool)
        inner[bounds[1:] - 1] = False
        out = np.full(len(inner), END_ID, "<u4")
        out[inner] = ids
        return out, bounds


def encoder(path: str) -> DistinctWordEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _BY_PATH:
        _BY_PATH[path] = DistinctWordEncoder(path)
    return _BY_PATH[path]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2 << 20):
    """Cuts a batch so that each part holds about ``most_bytes`` of text, one row at least.

    Parts are copies: Arrow's cast of a slice can leave offsets that string kernels misread."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most_bytes
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if hi > lo:
            yield batch if hi - lo == batch.num_rows else batch.take(pa.array(np.arange(lo, hi)))


def crc32_of(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return np.fromiter(
        (zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)),
        np.int64,
        len(bounds) - 1,
    )
