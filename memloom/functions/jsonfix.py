"""Lenient reading of JSON that a language model wrote."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```[ \t]*(javascript|json)?[^\S\n]*\n?(.*)```", re.DOTALL)


def strip_fence(s: str) -> str:
    m = _FENCE.search(s)
    return m.group(2) if m else s


def parse(s: str) -> Any:
    """The value of a text that is JSON up to fences, prose around it, comments, ellipses, and missing or surplus marks.

    Raises ValueError when the repairs, as many as a fiftieth of the text's length but at least 20, do not help.
    """
    try:
        return json.loads(s)
    except ValueError:
        s = strip_fence(s).strip()
    for _ in range(max(20, len(s) // 50)):
        try:
            return json.loads(s)
        except json.JSONDecodeError as e:
            fixed = _repair(s, e.msg, e.pos)
            if fixed is None or fixed == s:
                break
            s = fixed.strip()
    raise ValueError(f"no JSON could be made of: {s[:200]}")


def _repair(s: str, msg: str, at: int) -> str | None:
    rest = s[at:].lstrip()
    gap = at + len(s[at:]) - len(rest)
    if rest.startswith("//"):
        return s[:gap] + s[gap:].partition("\n")[2]
    if rest.startswith("..."):
        return s[:gap] + s[gap + 3 :].lstrip().removeprefix(",")
    if msg.startswith("Extra data"):
        return s[:at]
    if at == 0:
        m = re.search(r"[{\[]", s[1:])
        return s[m.start() + 1 :] if m else None
    if msg.startswith(("Expecting value", "Expecting property name", "Illegal trailing comma")):
        if rest[:1] in ("]", "}") or msg.startswith("Illegal"):
            head = s[:gap].rstrip()
            comma = gap if s[gap : gap + 1] == "," else len(head) - 1
            if s[comma : comma + 1] == ",":
                return s[:comma] + s[comma + 1 :]
            return s[:gap] + "null" + s[gap:]
        if rest.startswith(","):
            return s[:gap] + ("null" if s[:gap].rstrip().endswith(":") else "") + s[gap + (not s[:gap].rstrip().endswith(":")) :]
        return s[:gap] + '"' + s[gap:]
    if msg.startswith("Expecting ',' delimiter"):
        return s[:at] + "," + s[at:] if rest else None
    if msg.startswith("Expecting ':' delimiter"):
        return s[:at] + ": null" + s[at:] if rest[:1] in (",", "}") else s[:at] + ":" + s[at:]
    if msg.startswith("Invalid control character"):
        return s[:at] + s[at + 1 :]
    return None


def _text(s: str | None) -> str | None:
    if s is None:
        return None
    try:
        return json.dumps(parse(s), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return None


def repaired(s: Column) -> Column:
    """JSON text of a lenient reading, or null. Texts that are JSON never leave the JVM's parser for Python's."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(_text)

    strict = F.to_json(F.try_parse_json(s))
    return F.coalesce(strict, F.pandas_udf(run, "string")(F.when(F.try_parse_json(s).isNull(), s)))
