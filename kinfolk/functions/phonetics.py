"""NYSIIS codes, from the published rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the method.
_STARTS = (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS"))
_ENDS = (("EE", "Y"), ("IE", "Y"), ("DT", "D"), ("RT", "D"), ("RD", "D"), ("NT", "D"), ("ND", "D"))
_VOWELS = set("AEIOU")


def nysiis(token: str) -> str:
    """The code of a token; digits, empty tokens and tokens without a letter pass as they are."""
    word = token.upper()
    if not word or word.isdigit() or not any("A" <= c <= "Z" for c in word):
        return token
    word = next((new + word[len(old) :] for old, new in _STARTS if word.startswith(old)), word)
    word = next((word[: -len(old)] + new for old, new in _ENDS if word.endswith(old)), word)
    code, i = [word[0]], 1
    while i < len(word):
        c, ahead = word[i], word[i + 1 : i + 2]
        step = 1
        if word[i : i + 2] == "EV":
            new, step = "AF", 2
        elif c in _VOWELS:
            new = "A"
        elif c in "QZM":
            new = {"Q": "G", "Z": "S", "M": "N"}[c]
        elif c == "K":
            new = "N" if ahead == "N" else "C"
        elif word[i : i + 3] == "SCH":
            new, step = "SSS", 3
        elif word[i : i + 2] == "PH":
            new, step = "FF", 2
        elif c == "H" and (code[-1] not in _VOWELS or (ahead and ahead not in _VOWELS) or not ahead):
            new = code[-1]
        elif c == "W" and code[-1] in _VOWELS:
            new = code[-1]
        else:
            new = c
        for x in new:
            if x != code[-1]:
                code.append(x)
        i += step
    text = "".join(code)
    if text.endswith("S") and len(text) > 1:
        text = text[:-1]
    if text.endswith("AY"):
        text = text[:-2] + "Y"
    if text.endswith("A") and len(text) > 1:
        text = text[:-1]
    return text


@F.pandas_udf(T.ArrayType(T.StringType()))
def nysiis_all(tokens: pd.Series) -> pd.Series:
    kept: dict[str, str] = {}
    return tokens.map(lambda row: None if row is None else [kept[t] if t in kept else kept.setdefault(t, nysiis(t)) for t in row])
