"""Order-preserving packing of token streams into windows by dynamic programming.

Every scan partition is one stream, in its own order; no shuffle is needed. Windows may end at
document ends (free), at ends of sentences and lines or, in a sentence that is longer than a window and only there, at every STEP tokens (each with
a penalty). The cost of a cut is the best earlier cost within one window, plus padding, plus the
penalty; the best earlier cut comes from a monotone queue, so the work is linear in the cuts.
What is left at the end of a stream goes into windows of powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import session, texts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
WINDOW, SENTENCE_COST, INSIDE_COST, STEP, BLOCK_TOKENS = 4096, 2, 16, 32, 1_000_000
#: Words that end a sentence.
STOPS = (".", "!", "?", "...", "!!", "。")
#: Distinct words in a generation of those a worker remembers, and the longest word that passes to the next.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
#: A word of Latin letters and the ASCII punctuation after it (no apostrophe).
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
_TOKENIZERS: dict = {}


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


class Words(dict):
    """Ids of texts, word by word: a dictionary from words to their ids that fills itself. The tokenizer drops white
    space and never joins words across it, so blanks and line feeds cut a text without changing its ids; nor does it
    join a word of Latin letters to the ASCII punctuation after it. Such words go straight to the tokenizer's BPE
    model. Two generations of words are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.old: dict[str, bytes] = {}
        self.stops = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.stops[[i for x in STOPS if (i := self.tokenizer.token_to_id(x + "</w>")) is not None]] = True

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            if (plain := PLAIN(word)) is None:
                got = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            elif plain[2] or not word.islower():
                got = self[plain[1].lower()] + (self[plain[2]] if plain[2] else b"")
            else:
                form = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                got = array("I", [t.id for t in self.model.tokenize(form)]).tobytes()
        self[word] = got
        return got

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [ids for ids, _ in self.encode_lines(texts)]

    def encode_lines(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text, and the number of ids up to the end of each of its lines."""
        if len(self) > CACHE_WORDS:
            self.old = {k: v for k, v in self.items() if len(k) <= CACHE_CHARS}
            self.clear()
        ids = self.__getitem__
        lines = [[b"".join(map(ids, line.split(" "))) for line in text.split("\n")] for text in texts]
        return [(np.frombuffer(b"".join(x), "<u4"), np.cumsum([len(y) for y in x]) // 4) for x in lines]


def words(path: str) -> Words:
    """One tokenizer for each worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Words(path)
    return _TOKENIZERS[path]


def candidates(lengths: list[int], inner: np.ndarray, window: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, ascending and from 0, and the penalty of each. inner: ends of sentences and lines. Only a sentence longer
    than the window may be cut inside, every `step` tokens."""
    at = np.concatenate([[0], np.cumsum(lengths)])
    cost = np.full(at[-1] + 1, INSIDE_COST, np.int64)
    cost[inner] = SENTENCE_COST
    cost[at] = 0
    places = np.flatnonzero(cost < INSIDE_COST)
    for i in np.flatnonzero(np.diff(places) > window):
        cost[places[i] + step : places[i + 1] : step] = -1
    places = np.flatnonzero(cost < INSIDE_COST)
    cost = cost[places]
    cost[cost < 0] = INSIDE_COST
    return places, cost


def best_cuts(places: np.ndarray, cost: np.ndarray, window: int, last: bool) -> list[int]:
    """Ends of the windows of the cheapest division. Unless it is the last block, what lies beyond the
    last window is left for the next block; a last block's rest is cut into powers of two, largest first."""
    where, penalty = places.tolist(), cost.tolist()
    total = [0] * len(where)
    back = [0] * len(where)
    queue: deque[int] = deque([0])
    for k in range(1, len(where)):
        p = where[k]
        while where[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        back[k], total[k] = i, penalty[k] + window - p + total[i] + where[i]
        value = total[k] + p
        while queue and total[queue[-1]] + where[queue[-1]] >= value:
            queue.pop()
        queue.append(k)
    end = where[-1]
    tail = (lambda p: SENTENCE_COST * max(0, (end - p).bit_count() - 1)) if last else (lambda p: 0)
    k = min((k for k in range(len(where) - 1, -1, -1) if end - where[k] <= window), key=lambda k: total[k] + tail(where[k]))
    out = []
    p = where[k]
    while k:
        out.append(where[k])
        k = back[k]
    out.reverse()
    while last and p < end:
        p += 1 << ((end - p).bit_length() - 1)
        out.append(p)
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """Pieces of documents in windows of at most `window` tokens; each document's ids end in end_id.

    Documents keep the order of their partition. A null or empty text is end_id alone. Repeated rows
    and null ids are packed as documents of their own; an empty table gives no rows; other columns
    are ignored. No document is cut short: a long one goes on in the next window. The rest of a partition's stream, less than a window,
    goes to windows of powers of two, which may end anywhere.
    """

    def run(batches):
        own = words(tokenizer_path)
        base, made = TaskContext.get().partitionId() << 32, 0
        block: list[tuple] = []  # (doc_id, ids, first: ids of the document before these, tokens of the document, ends of its lines in these)
        held = 0

        def flush(last: bool):
            nonlocal block, held, made
            if not block:
                return None
            at = np.concatenate([[0], np.cumsum([len(x[1]) for x in block])])
            ends = np.concatenate([np.flatnonzero(own.stops[np.concatenate([x[1] for x in block])]) + 1, *(n + x[4] for n, x in zip(at.tolist(), block, strict=False))])
            places, cost = candidates([len(x[1]) for x in block], ends, window, min(STEP, window))
            cuts = best_cuts(places, cost, window, last)
            rows: list[tuple] = []
            at, w, begin, rest = 0, 0, 0, []
            for doc, ids, first, whole, lines in block:
                done = 0
                while done < len(ids):
                    if w == len(cuts):
                        rest.append((doc, ids[done:], first + done, whole, lines[lines > done] - done))
                        break
                    take = min(len(ids) - done, cuts[w] - at)
                    rows.append((doc, first + done, take, zlib.crc32(ids[done : done + take].tobytes()), whole, base + made, at - begin))
                    done, at = done + take, at + take
                    if at == cuts[w]:
                        w, begin, made = w + 1, at, made + 1
            block, held = rest, sum(len(x[1]) for x in rest)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")]) if rows else None

        for batch in batches:
            for doc, (got, lines) in zip(batch.column("doc_id").to_pylist(), own.encode_lines(texts(batch)), strict=True):
                ids = np.append(got, np.array([end_id], "<u4")).astype("<u4")
                block.append((doc, ids, 0, len(ids), lines))
                held += len(ids)
                if held >= BLOCK_TOKENS and (made_now := flush(False)) is not None:
                    yield made_now
        if (made_now := flush(True)) is not None:
            yield made_now

    session(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
