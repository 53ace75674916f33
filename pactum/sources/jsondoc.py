"""A lexical JSON reader: every value keeps its lexeme, so 1 is an integer and 1.0 a float, and members keep their order.

`read_text` turns one document into nodes (path, parent, ord, key, kind, lexeme) with
a stack, not recursion; `nodes` does so for a column of documents. A malformed
document gives one node of kind `error`. A repeated key is reported where it stands.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")

NODE = "path string, parent string, ord int, key string, kind string, lexeme string"


class Malformed(ValueError):
    pass


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            if text[at:].strip(" \t\n\r"):
                raise Malformed(f"unexpected text at {at}")
            return
        at = m.end()
        yield ("punct", "string", "number", "word")[m.lastindex - 1], m[m.lastindex]


def step(parent: str, key: str) -> str:
    return f"{parent}.{key}" if _NAME.match(key) else f"{parent}[{json.dumps(key, ensure_ascii=False)}]"


def read_text(text: str | None, root: str) -> list[tuple]:
    """The nodes of a document, parents before children; [(root, None, 0, None, 'error', message)] if it is malformed."""
    if text is None:
        return [(root, None, 0, None, "error", "no document")]
    out: list[tuple] = []
    stack: list[list] = []  # [node path, kind, members so far, keys, pending key, state]
    done = False
    try:
        for kind, lexeme in _tokens(text):
            if done:
                raise Malformed("text after the value")
            top = stack[-1] if stack else None
            state = top[5] if top else "value"
            if kind == "punct" and lexeme in "}]":
                if top is None or (top[1] == "object") != (lexeme == "}") or state not in ("first", "next"):
                    raise Malformed(f"unexpected {lexeme}")
                stack.pop()
                done = not stack
                continue
            if kind == "punct" and lexeme == ",":
                if state != "next":
                    raise Malformed("unexpected ,")
                top[5] = "key" if top[1] == "object" else "value"
                continue
            if kind == "punct" and lexeme == ":":
                if state != "colon":
                    raise Malformed("unexpected :")
                top[5] = "value"
                continue
            if state in ("first", "key") and top and top[1] == "object":
                if kind != "string":
                    raise Malformed("a key must be a string")
                top[4], top[5] = json.loads(lexeme), "colon"
                continue
            if state not in ("value", "first"):
                raise Malformed(f"unexpected {lexeme}")
            if top is None:
                path, parent, ord_, key = root, None, 0, None
            else:
                parent, ord_, key = top[0], top[2], top[4]
                if top[1] == "object":
                    path = step(parent, key)
                    if key in top[3]:
                        out.append((path, parent, ord_, key, "duplicate", None))
                    top[3].add(key)
                else:
                    path, key = f"{parent}[{ord_}]", None
                top[2], top[5] = ord_ + 1, "next"
            if kind == "punct":
                out.append((path, parent, ord_, key, "object" if lexeme == "{" else "array", None))
                stack.append([path, out[-1][4], 0, set(), None, "first"])
            else:
                name = "string" if kind == "string" else ("int" if re.fullmatch("-?[0-9]+", lexeme) else "float") if kind == "number" else "null" if lexeme == "null" else "bool"
                out.append((path, parent, ord_, key, name, json.loads(lexeme) if kind == "string" else lexeme))
                done = not stack
        if not done:
            raise Malformed("the document ends early")
    except Malformed as e:
        return [(root, None, 0, None, "error", str(e))]
    return out


def _read(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
    names = ["path", "parent", "ord", "key", "kind", "lexeme"]
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            piece = batch.slice(first, 256)
            rows, owner = [], []
            for i, text in enumerate(piece.column("_text").to_pylist()):
                found = read_text(text, root)
                rows += found
                owner += [i] * len(found)
            kept = [n for n in piece.schema.names if n != "_text"]
            carried = [piece.column(n).take(pa.array(owner, pa.int64())) for n in kept]
            yield pa.RecordBatch.from_arrays([*carried, *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=[*kept, *names])


def nodes(df: DataFrame, text: str, keep: list[str], root: str = "doc") -> DataFrame:
    """A row for each node of each document, with the columns to keep."""
    rows = df.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*[f"`{n}` {t}" for n, t in df.select(*keep).dtypes], NODE])
    return rows.mapInArrow(partial(_read, root), schema)


def member(nodes_: DataFrame, parent: str, name: str) -> Column:
    """For an aggregate by document: the lexeme of a member, or null."""
    return F.max(F.when((F.col("parent") == parent) & (F.col("key") == name), F.col("lexeme")))


def typed(kind: str) -> Column:
    """A node's value of a kind: an integer lexeme is a float only where it is exact."""
    if kind == "int":
        return F.when(F.col("kind") == "int", F.col("lexeme").try_cast("bigint"))
    if kind == "float":
        d = F.col("lexeme").try_cast("double")
        exact = F.col("lexeme").try_cast("decimal(38,0)") == d.try_cast("decimal(38,0)")
        return F.when((F.col("kind") == "float") | ((F.col("kind") == "int") & exact), d)
    if kind == "bool":
        return F.when(F.col("kind") == "bool", F.col("lexeme") == "true")
    return F.when(F.col("kind") == kind, F.col("lexeme"))
