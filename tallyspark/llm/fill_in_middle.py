"""Fill-in-the-middle: texts cut at two ranks among their tokens and put in another order between three marks.

A text becomes an array of its code points (UTF-32). A token is a run of A-Z and a-z, or any other character alone, so a token
starts wherever a code point and the one before it are not both letters: one comparison of neighbours, and `flatnonzero` gives
the starts. The two ranks come from a hash of the document's id; the pieces are slices of the array, encoded again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import session, texts

PLAIN, PSM, SPM = "plain", "psm", "spm"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Rule:
    """seed: what the hash starts with. plain, spm: percent of the texts that stay as they are, and, of the others, that have the suffix first."""

    seed: int = 1
    plain: int = 10
    spm: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = self.prefix, self.suffix, self.middle
        if not all(marks) or len(set(marks)) < 3 or any(a in b for a in marks for b in marks if a != b) or any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)))):
            raise ValueError("marks must not be empty, nor overlap or hold one another")


def token_starts(codes: np.ndarray) -> np.ndarray:
    """Where the tokens of an array of code points start, and its length."""
    if not len(codes):
        return np.zeros(1, np.int64)
    letter = (codes | np.uint32(32)) - np.uint32(97) < 26
    return np.concatenate([[0], np.flatnonzero(~(letter[1:] & letter[:-1])) + 1, [len(codes)]])


def transformed(doc_id: int | None, text: str, rule: Rule) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, characters of the prefix and of the middle, output) of a text."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = token_starts(codes)
    n = len(starts) - 1
    digest = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))
    if n == 0 or h3 % 100 >= 100 - rule.plain or any(m in text for m in (rule.prefix, rule.suffix, rule.middle)):
        return n, PLAIN, None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = (x.tobytes().decode("utf-32-le") for x in np.split(codes, starts[[first, last]]))
    if h4 % 100 < rule.spm:
        return n, SPM, len(prefix), len(middle), "".join((rule.suffix, suffix, rule.prefix, prefix, rule.middle, middle))
    return n, PSM, len(prefix), len(middle), "".join((rule.prefix, prefix, rule.suffix, suffix, rule.middle, middle))


def fill_in_middle(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and output of each row, without a shuffle.

    A null text counts as an empty one; empty texts, texts that hold a mark and the rule's share of all texts stay plain (prefix_chars and
    middle_chars are null then). Rows with a null id are cut as if the id were written as nothing; repeated rows give equal rows; texts of any
    length are cut whole; other columns, also those named like a result, are ignored; an empty table gives no rows."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            rows = [transformed(i, text, rule) for i, text in zip(ids.to_pylist(), texts(batch), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    session(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column, rule: Rule = Rule()) -> Column:
    """The text that an output was made of. A mark stands once in an output that isn't plain, as no text with a mark is cut and marks don't overlap."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands behind the mark `first` up to `second`, then up to the middle's mark, then behind it."""
        body = F.substr(output, F.lit(len(first) + 1))
        rest = F.split_part(body, F.lit(second), F.lit(2))
        return F.split_part(body, F.lit(second), F.lit(1)), F.split_part(rest, F.lit(rule.middle), F.lit(1)), F.split_part(rest, F.lit(rule.middle), F.lit(2))

    prefix, suffix, middle = parts(rule.prefix, rule.suffix)
    late_suffix, late_prefix, late_middle = parts(rule.suffix, rule.prefix)
    return F.when(form == PSM, F.concat(prefix, middle, suffix)).when(form == SPM, F.concat(late_prefix, late_middle, late_suffix)).otherwise(output)
