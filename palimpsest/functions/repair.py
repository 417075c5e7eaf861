"""JSON that a model broke off: the longest front part that reads, with what is open closed."""

from __future__ import annotations

import contextlib
import json
import re
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import ship_active

_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")
_BLANK = re.compile(r"[ \t\n\r]*")
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{0,3})?$")


def longest(t: str) -> str | None:
    """The longest front part of a text (which begins with a bracket) that can be closed, closed; in one pass.

    A string that the text's end breaks off is kept as a value, but not as a key.
    """
    open_, i, safe, want = [], 0, 0, "value"
    while True:
        i = _BLANK.match(t, i).end()
        c = t[i : i + 1]
        done = False  # is a value complete at i?
        if not c:
            break
        if c in "}]" and open_ and open_[-1] == c and want in (",", f"first {c}"):
            open_.pop()
            i, done = i + 1, True
        elif want == "," and c == ",":
            i, want = i + 1, "key" if open_[-1] == "}" else "value"
        elif want == ":" and c == ":":
            i, want = i + 1, "value"
        elif c == '"' and want in ("key", "first }"):
            try:
                i, want = scanstring(t, i + 1, False)[1], ":"
            except ValueError:
                break
        elif want in ("value", "first ]"):
            if c in "{[":
                open_.append("}" if c == "{" else "]")
                i = safe = i + 1
                want = f"first {open_[-1]}"
            elif c == '"':
                try:
                    i = scanstring(t, i + 1, False)[1]
                except ValueError:
                    ended = _ESCAPE.sub("", t) + '"'
                    with contextlib.suppress(ValueError):  # else a bad escape, which ends the text before it
                        t, safe = ended, scanstring(ended, i + 1, False)[1]
                    break
                done = True
            elif m := _SCALAR.match(t, i):
                i, done = m.end(), True
            else:
                break
        else:
            break
        if done:
            safe, want = i, ","
            if not open_:
                break
    return t[:safe] + "".join(reversed(open_)) if safe else None


def readable(t: str | None) -> str | None:
    """The text as JSON from its first bracket on: as it stands, or its longest closed front part; None if nothing reads."""
    if t is None or (start := min((i for i in (t.find("{"), t.find("[")) if i >= 0), default=-1)) < 0:
        return None
    found = longest(t[start:])
    try:
        return json.dumps(json.loads(found, strict=False)) if found else None
    except ValueError:
        return None


def repaired(c: Column) -> Column:
    """``readable`` over a column."""
    ship_active()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: readable(t if isinstance(t, str) else None))

    return run(c)
