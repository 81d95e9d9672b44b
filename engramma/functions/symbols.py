"""Normalisation of symbol text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from engramma.params import MAX_SYMBOL_BYTES

# Unicode white space; control characters that are none of it.
SPACE = "\t-\r \x85\xa0  -     　"
CONTROL = "\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f"
# Reasons for a rejection.
EMPTY = "symbol value is empty after normalization"
HAS_CONTROL = "symbol value contains a control character"
TOO_LONG = "symbol value exceeds 4096 normalized UTF-8 bytes"

# What Unicode 16.0 adds to version 15.1 in lower case pairs, and in outlined capitals and digits.
LOWER_16 = {0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B, 0x1C89: 0x1C8A} | {0x10D50 + i: 0x10D70 + i for i in range(22)}
COMPATIBLE_16 = {0x1CCD6 + i: 0x41 + i for i in range(26)} | {0x1CCF0 + i: 0x30 + i for i in range(10)}

_words = re.compile(f"[^{SPACE}]+")
_control = re.compile(f"[{CONTROL}]")


def normalise(text: str) -> tuple[str | None, str | None]:
    """(normalised text, None), or (None, reason).

    NFKC, lower case scalar by scalar (so a final sigma is no special case),
    NFKC, white space runs to one space. What comes first in the text decides
    between a control character and excess length.
    """
    plain = unicodedata.normalize("NFKC", text.translate(COMPATIBLE_16))
    folded = unicodedata.normalize("NFKC", "".join(c.lower() for c in plain.translate(LOWER_16)))
    out = " ".join(_words.findall(folded))
    bad = _control.search(out)
    if bad and len(out[: bad.start()].encode()) <= MAX_SYMBOL_BYTES:
        return None, HAS_CONTROL
    if len(out.encode()) > MAX_SYMBOL_BYTES:
        return None, TOO_LONG
    return (out, None) if out else (None, EMPTY)


def normalised(text: Column) -> Column:
    """struct(value, detail); apply it to distinct texts. Null stays null."""

    @F.pandas_udf("value string, detail string")
    def apply(texts: pd.Series) -> pd.DataFrame:
        pairs = [normalise(t) if t is not None else (None, None) for t in texts]
        return pd.DataFrame(pairs, columns=["value", "detail"])

    return apply(text)
