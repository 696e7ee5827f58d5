"""Tokens and JSON leaves for search."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with")
MIN_TOKEN, MAX_TOKEN, MAX_VALUE, MAX_LEAVES = 2, 64, 4096, 256
LEAF = ArrayType(StructType().add("path", StringType()).add("value", StringType()))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, cut at 64, without stop words and single characters."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), 1), lambda t: F.lower(F.substring(t, 1, MAX_TOKEN)))
    return F.filter(runs, lambda t: (F.length(t) >= MIN_TOKEN) & ~t.isin(*STOP_WORDS))


def tokenise(text: str) -> list[str]:
    """The same in Python, for query texts."""
    out, word = [], []
    for c in text + " ":
        if c.isascii() and c.isalnum():
            word.append(c.lower())
        elif word:
            token = "".join(word)[:MAX_TOKEN]
            if len(token) >= MIN_TOKEN and token not in STOP_WORDS:
                out.append(token)
            word = []
    return out


def _walk(value, path: str) -> Iterator[tuple[str, str | None]]:
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from _walk(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list) and value:
        for v in value:
            yield from _walk(v, path)
    elif value is None or isinstance(value, dict | list):
        yield path, None
    elif isinstance(value, str):
        yield path, value
    else:
        yield path, json.dumps(value)


def leaves_of(attributes: str | None) -> list[tuple[str, str | None]]:
    """Leaves in document order, arrays collapsed into their path, 256 at most; none if the JSON is malformed."""
    try:
        root = json.loads(attributes or "")
    except ValueError:
        return []
    out = []
    for leaf in _walk(root, ""):
        if len(out) == MAX_LEAVES:
            break
        out.append(leaf)
    return out


# Not by Arrow: its batches hold 10,000 payloads, of which Python has several copies. Pickled ones hold 100.
@F.udf(LEAF, useArrow=False)
def leaves(attributes: str | None) -> list[tuple[str, str | None]]:
    return leaves_of(attributes)


def wildcard(path: str, pattern: str) -> bool:
    """``*`` or ``%`` stand for anything; parts are found greedily from the left, so the last one has to end at its first place."""
    if "*" not in pattern and "%" not in pattern:
        return path == pattern
    parts = pattern.replace("%", "*").split("*")
    if not path.startswith(parts[0]):
        return False
    at = len(parts[0])
    for i, part in enumerate(parts[1:], 1):
        if not part:
            continue
        k = path.find(part, at)
        if k < 0:
            return False
        at = k + len(part)
        if i == len(parts) - 1:
            return at == len(path)
    return parts[-1] == "" or at == len(path)
