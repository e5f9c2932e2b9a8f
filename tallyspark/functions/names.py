"""Keys of names that need Unicode normal forms, which Spark has no function for; one Arrow batch at a time."""

from __future__ import annotations

import html
import re
import unicodedata
import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_key(x: str) -> str:
    """NFKC, case folded, white space collapsed."""
    return " ".join(unicodedata.normalize("NFKC", x).casefold().split())


def letters(x: str) -> str:
    """`Surname, Given` turned round, accents and all but a-z and 0-9 dropped."""
    if x.count(",") == 1:
        x = " ".join(reversed(x.split(",")))
    ascii_ = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().casefold()
    return re.sub(r"[^a-z0-9]", "", ascii_)


def bare(x: str) -> str:
    """Accents and all but a-z and 0-9 dropped; empty where nothing is left."""
    return re.sub(r"[^a-z0-9]", "", unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().casefold())


def unaccented(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c))


def of(rule):
    """A column function that applies a rule to text and keeps nulls."""

    def column(x: Column) -> Column:
        @F.pandas_udf("string")
        def run(values: pd.Series) -> pd.Series:
            return values.map(rule, na_action="ignore")

        return run(x)

    return column


name_key, letters_key, accent_key, bare_key = of(plain_key), of(letters), of(unaccented), of(bare)


def plain_name_key(x: Column) -> Column:
    """`name_key`, where text of printable ASCII alone stays in the JVM: its normal form is itself, and folding is lower-casing."""
    ascii_ = x.rlike(r"^[ -~]*$")
    return F.when(ascii_, F.regexp_replace(F.trim(F.lower(x)), " +", " ")).otherwise(name_key(F.when(~ascii_, x)))


def section(x: str) -> str:
    """A heading as it may stand in an address: decoded, NFKC, white space collapsed, case folded."""
    return plain_key(html.unescape(urllib.parse.unquote(x).replace("_", " ")))


def title(x: str) -> str:
    return unicodedata.normalize("NFC", x.replace("_", " ")).strip()


def base36(digest: str) -> str:
    """A SHA-1 in hexadecimal as 31 characters to the base of 36."""
    number, out = int(digest, 16), ""
    for _ in range(31):
        number, rest = divmod(number, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[rest] + out
    return out


section_key, title_key, base36_key = of(section), of(title), of(base36)
