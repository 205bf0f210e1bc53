"""Token ids of whole texts by the public ``tokenizers`` library, per white-space chunk.

The word-end BPE's splitter never joins characters across white space, so a text's ids
are its chunks' ids in order. Chunks of plain Latin letters and marks skip the
normaliser: their pieces go to the BPE model itself. All else is encoded whole.
Two bounded caches per worker hold what the most frequent chunks and pieces encode to.
"""

from __future__ import annotations

import functools
import re

import numpy as np

DEFAULT = "word_bpe_49k.json"
#: Entries each cache may hold; full caches keep what they have.
CACHE = 400_000
_LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ɏ"
_MARKS = ".,;:!?#*$%&|"
_SIMPLE = re.compile(rf"(?:[{_LETTERS}]+|[{_MARKS}]+)+").fullmatch
_PIECES = re.compile(rf"[{_LETTERS}]+|[{_MARKS}]+").findall


class ChunkEncoder(dict):
    """chunk bytes -> its ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = np.array([t.id for t in self.model.tokenize(self.as_bytes(piece)[0][0])], "<u4").tobytes()
            if len(self.pieces) < CACHE:
                self.pieces[piece] = ids
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if _SIMPLE(text):
            ids = b"".join(map(self.piece, _PIECES(text.lower())))
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < CACHE:
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


@functools.lru_cache(2)
def encoder(path: str) -> ChunkEncoder:
    """One per Python worker and file; the file must lie at path on every machine."""
    return ChunkEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)
