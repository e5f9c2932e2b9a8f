"""Byte-level BPE: linear-time encoding by backtracking over longest matches, and decoding.

Bytes are mapped to Latin-1 characters so that a pyahocorasick automaton finds every vocabulary
entry in a piece of text. From the longest match at each place the encoder goes on, takes the next
shorter prefix where two neighbours would have been merged otherwise, and goes back a token where
no prefix fits; places found dead are never tried again, so the work is linear in the text.
Whether two tokens may stand side by side is memoised.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import session, texts

_CODECS: dict = {}
#: Distinct pieces of text whose ids a worker remembers, and the longest piece remembered.
CACHE_PIECES, CACHE_CHARS = 300_000, 64
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


class Codec:
    """Encoder and decoder for one file of ranks (base64 token and rank on each line)."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.token = {int(rank): base64.b64decode(token) for token, rank in pairs}
        self.id = {token: rank for rank, token in self.token.items()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.id.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for rank in sorted(self.token):
            self._learn(rank)
        self.fits.clear()  # answers given while merges were missing
        self.cache: dict[str, bytes] = {}

    def _learn(self, rank: int) -> None:
        """The longest proper prefix in the vocabulary, and the two tokens that were merged into this one."""
        token = self.token[rank]
        self.shorter[rank] = next((self.id[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.id), None)
        self.halves[rank] = (rank, rank)
        for n in range(len(token) - 1, 0, -1):
            left, right = self.id.get(token[:n], rank), self.id.get(token[n:], rank)
            if left < rank and right < rank and self._adjacent(left, right):
                self.halves[rank], self.merged[left, right] = (left, right), rank
                return

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens side by side: undo their merges, latest first, and see
        whether an earlier merge across the border would have come before."""
        limit = 1 << 62
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            for side in ((0, 1) if left > right else (1, 0)):
                if side == 0 and self.halves[left][1] != left:
                    limit, left = left, self.halves[left][1]
                    break
                if side == 1 and self.halves[right][0] != right:
                    limit, right = right + 1, self.halves[right][0]
                    break
            else:
                return True

    def adjacent(self, left: int, right: int) -> bool:
        got = self.fits.get((left, right))
        if got is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            got = self.fits[left, right] = self._adjacent(left, right)
        return got

    def encode_bytes(self, piece: bytes) -> list[int]:
        longest = [-1] * (len(piece) + 1)
        size = [0] * (len(piece) + 1)
        for end, (length, rank) in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - length
            if length > size[start]:
                size[start], longest[start] = length, rank
        alive = bytearray(b"\1") * (len(piece) + 1)
        out: list[int] = []
        at, rank = 0, longest[0]
        while at < len(piece):
            end = at + len(self.token[rank])
            if alive[end] and (not out or self.adjacent(out[-1], rank)):
                out.append(rank)
                at, rank = end, longest[end]
            elif self.shorter[rank] is not None:
                rank = self.shorter[rank]
            else:
                alive[at] = 0
                rank = out.pop()
                at -= len(self.token[rank])
        return out

    def piece(self, piece: str) -> bytes:
        ids = np.asarray(self.encode_bytes(piece.encode()), "<u4").tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        known, piece = self.cache.get, self.piece
        return b"".join([known(x) or piece(x) for x in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    if (ranks_path, pattern) not in _CODECS:
        _CODECS[ranks_path, pattern] = Codec(ranks_path, pattern)
    return _CODECS[ranks_path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, digests_only: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and decoded bytes of each row; with digests_only, ids and decoded are SHA-256 digests.

    A null text is an empty text (no tokens). Null, repeated ids and repeated rows give one row each;
    other columns are ignored. Texts of any length are encoded whole.
    """

    def run(batches):
        own = codec(ranks_path, pattern)
        digest = (lambda x: hashlib.sha256(x).digest()) if digests_only else bytes
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in texts(batch):
                got = own.encode(text)
                counts.append(len(got) // 4)
                ids.append(digest(got))
                decoded.append(digest(own.decode(got)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    session(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
