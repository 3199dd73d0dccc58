"""Subword ids of whole texts from a public tokenizer file, a batch at a time."""

from __future__ import annotations

import base64
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 23  # larger chunks hold fewer distinct pieces for their size
_SPECIAL = b"<|endoftext|>"
_loaded: dict[str, Subwords] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Subwords:
    """``tokenizers`` ids of a byte-level BPE file.

    Where the ``.tiktoken`` ranks of the same vocabulary lie beside the file, texts are cut at single spaces, as no token
    reaches across the place before one, and every distinct piece of a batch is encoded once. Texts with two spaces in a
    row or the special token, and files without ranks, go through ``tokenizers`` whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._pieces = None
        ranks_file = Path(path).with_suffix(".tiktoken")
        if ranks_file.exists():
            import public_tokenizers
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.read_bytes().splitlines())}
            self._pieces = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )
            self._lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            self._lengths[list(ranks.values())] = list(map(len, ranks))

    @classmethod
    def at(cls, path: str) -> Subwords:
        """One per Python worker."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row and the number of ids before each text (one entry more than texts)."""
        plain = [self._pieces is not None and b"  " not in t and _SPECIAL not in t for t in texts]
        ids, counts = self._by_pieces([t for t, p in zip(texts, plain) if p]) if any(plain) else (None, None)
        if all(plain) and texts:
            return ids, np.concatenate(([0], np.cumsum(counts)))
        parts, lengths, at, place = [], [], 0, 0
        for text, p in zip(texts, plain):
            if p:
                n = counts[place]
                parts.append(ids[at : at + n])
                at, place = at + n, place + 1
            else:
                whole = self._whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
                parts.append(np.array(whole, dtype=np.uint32))
            lengths.append(len(parts[-1]))
        joined = np.concatenate(parts).astype(np.uint32) if parts else np.empty(0, dtype=np.uint32)
        return joined, np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype(np.int64)

    def _by_pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[:-1] = data == 0x20
        cut[bounds] = True
        cuts = np.flatnonzero(cut).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))
        coded = pc.dictionary_encode(pieces)
        codes = coded.indices.to_numpy()
        flat, sizes, starts = self._ids_of(coded.dictionary)
        piece_sizes = sizes[codes]
        before = np.concatenate(([0], np.cumsum(piece_sizes)))
        take = np.repeat((starts[codes] - before[:-1]).astype(np.int32), piece_sizes)
        take += np.arange(before[-1], dtype=np.int32)
        return flat[take], np.diff(before[np.searchsorted(cuts, bounds)])

    def _ids_of(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces in any order, and for each piece how many they are and where they begin.

        Pieces that begin with a space are encoded in one call, as one text, and parted by the lengths of their tokens;
        the others (first ones of a text, single spaces) are encoded one by one.
        """
        offsets, body = (np.frombuffer(b, dtype=t) if b else np.empty(0, t) for b, t in zip(pieces.buffers()[1:], (np.int32, np.uint8)))
        offsets = offsets[pieces.offset : pieces.offset + len(pieces) + 1]
        joins = (body[offsets[:-1]] == 0x20) & (np.diff(offsets) > 1)
        joined = pieces.filter(pa.array(joins))
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(joined)], joined), "")[0].as_py()
        ids = np.array(self._pieces.encode_ordinary(text), dtype=np.uint32)
        ends = np.cumsum(self._lengths[ids])
        wanted = np.cumsum(np.diff(offsets)[joins])
        upto = np.searchsorted(ends, wanted) + 1
        if len(ids) and not np.array_equal(ends[np.minimum(upto, len(ends)) - 1], wanted):
            joins[:], ids, upto = False, ids[:0], upto[:0]  # some token reaches over a border
        single = list(map(self._pieces.encode_ordinary, pieces.filter(pa.array(~joins)).to_pylist()))
        sizes = np.empty(len(pieces), dtype=np.int64)
        sizes[joins] = np.diff(upto, prepend=0)
        sizes[~joins] = np.fromiter(map(len, single), dtype=np.int64, count=len(single))
        order = np.argsort(~joins, kind="stable")
        starts = np.empty_like(sizes)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate((ids, np.fromiter(chain.from_iterable(single), dtype=np.uint32))), sizes, starts
