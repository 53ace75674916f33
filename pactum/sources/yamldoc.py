"""A reader of YAML 1.2 documents with the core schema, for driver-side configuration.

Block and flow collections, plain and quoted scalars, and block scalars. Tags, merge
keys, several documents, and repeated or non-string keys are refused; anchors are
copied where an alias stands.
"""

from __future__ import annotations

import json
import re


class Refused(ValueError):
    pass


_INT, _FLOAT = re.compile(r"[-+]?[0-9]+\Z"), re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?\Z")
_KEY = re.compile(r"""((?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#&*!|>%@`"'\[\]{},:?-][^#]*?|[-?:](?=\S)[^#]*?))\s*:(?:\s+|$)""")


def scalar(text: str):
    """A plain scalar by the core schema."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text.lower() == "true"
    if _INT.match(text):
        return int(text)
    if re.match(r"0x[0-9a-fA-F]+\Z", text):
        return int(text, 16)
    if re.match(r"0o[0-7]+\Z", text):
        return int(text[2:], 8)
    return float(text) if _FLOAT.match(text) else text


class _Flow:
    def __init__(self, text: str, anchors: dict):
        self.text, self.at, self.anchors = text, 0, anchors

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in " \n":
            self.at += 1

    def value(self):
        self.space()
        c = self.text[self.at : self.at + 1]
        if c in "[{" and c:
            self.at += 1
            close = "]" if c == "[" else "}"
            items: list | dict = [] if c == "[" else {}
            while True:
                self.space()
                if self.text[self.at : self.at + 1] == close:
                    self.at += 1
                    return items
                if not self.text[self.at :]:
                    raise Refused("a flow collection does not end")
                item = self.value()
                if c == "{":
                    self.space()
                    if self.text[self.at : self.at + 1] != ":":
                        raise Refused("a flow mapping needs a colon")
                    self.at += 1
                    _put(items, item, self.value())
                else:
                    items.append(item)
                self.space()
                if self.text[self.at : self.at + 1] == ",":
                    self.at += 1
        if c in "\"'" and c:
            m = re.compile(r'"(?:[^"\\]|\\.)*"' if c == '"' else r"'(?:[^']|'')*'").match(self.text, self.at)
            if not m:
                raise Refused("a quoted scalar does not end")
            self.at = m.end()
            return _quoted(m[0])
        m = re.compile(r"[^,\[\]{}\n]*?(?=\s*(?:[,\]}]|:\s|\Z))").match(self.text, self.at)
        self.at = m.end()
        return _plain(m[0].strip(), self.anchors)


def _quoted(s: str) -> str:
    return json.loads(s, strict=False) if s[0] == '"' else s[1:-1].replace("''", "'")


def _plain(s: str, anchors: dict):
    if s.startswith("*"):
        if s[1:] not in anchors:
            raise Refused(f"unknown alias {s}")
        return json.loads(json.dumps(anchors[s[1:]]))
    if s.startswith("!"):
        raise Refused("tags are refused")
    if s[:1] in ("%", "@", "`"):
        raise Refused(f"a plain scalar cannot start with {s[0]}")
    return scalar(s)


def _put(into: dict, key, value) -> None:
    if not isinstance(key, str):
        raise Refused(f"a key must be a string, not {key!r}")
    if key == "<<":
        raise Refused("merge keys are refused")
    if key in into:
        raise Refused(f"repeated key {key}")
    into[key] = value


def read(text: str):
    """The value of a document, with dicts in document order."""
    lines = []
    for raw in text.split("\n"):
        if "\t" in raw[: len(raw) - len(raw.lstrip())]:
            raise Refused("tabs do not indent")
        lines.append(raw.rstrip("\r"))
    if lines and lines[0].strip() == "---":
        lines[0] = ""
    if any(x.rstrip() in ("---", "...") or x.startswith("%") for x in lines):
        raise Refused("one document without directives")
    anchors: dict = {}
    at = 0

    def skip() -> None:
        nonlocal at
        while at < len(lines) and (not lines[at].strip() or lines[at].lstrip().startswith("#")):
            at += 1

    def indent(i: int) -> int:
        return len(lines[i]) - len(lines[i].lstrip(" "))

    def rest(s: str, depth: int):
        """The value that begins behind a key or dash."""
        nonlocal at
        s = re.sub(r"(?:^|\s)#.*$", "", s).strip() if not s.lstrip().startswith(("'", '"')) else s.strip()
        anchor = None
        if s.startswith("&"):
            anchor, _, s = s[1:].partition(" ")
            s = s.strip()
        if s.startswith("!"):
            raise Refused("tags are refused")
        if not s:
            skip()
            deeper = at < len(lines) and (indent(at) > depth or indent(at) == depth and lines[at].lstrip().startswith("- ") and not dash[-1])
            value = node(indent(at)) if deeper else None
        elif s[0] in "|>":
            value = literal(s, depth)
        elif s[0] in "[{\"'":
            while True:
                flow = _Flow(s, anchors)
                try:
                    value = flow.value()
                    break
                except Refused:
                    if at >= len(lines) or indent(at) <= depth:
                        raise
                    s += "\n" + lines[at].strip()
                    at += 1
            if re.sub(r"(?:^|\s)#.*", "", flow.text[flow.at :]).strip():
                raise Refused("text after a value")
        else:
            value = _plain(s, anchors)
        if anchor:
            anchors[anchor] = value
        return value

    def literal(s: str, depth: int) -> str:
        nonlocal at
        body: list[str] = []
        while at < len(lines) and (not lines[at].strip() or indent(at) > depth):
            body.append(lines[at])
            at += 1
        width = min((len(x) - len(x.lstrip()) for x in body if x.strip()), default=0)
        body = [x[width:] for x in body]
        tail = 0
        while body and not body[-1].strip():
            body.pop()
            tail += 1
        joined = "\n".join(body) if s[0] == "|" else re.sub(r"(?<=\S)\n(?=\S)", " ", "\n".join(body))
        return joined + ("" if "-" in s else "\n" * (1 + tail * ("+" in s)) if body else "")

    dash = [False]

    def node(depth: int):
        nonlocal at
        head = lines[at][depth:]
        if head == "-" or head.startswith("- "):
            items = []
            dash.append(True)
            while True:
                skip()
                if at >= len(lines) or indent(at) != depth or not (lines[at][depth:] == "-" or lines[at][depth:].startswith("- ")):
                    break
                inner = lines[at][depth + 1 :]
                offset = depth + 1 + len(inner) - len(inner.lstrip(" "))
                if inner.strip() and (_KEY.match(inner.strip()) or inner.strip().startswith("- ")) and inner.strip()[0] not in "[{":
                    lines[at] = " " * offset + inner.strip()
                    dash.append(False)
                    items.append(node(offset))
                    dash.pop()
                else:
                    at += 1
                    items.append(rest(inner, depth))
            dash.pop()
            return items
        if m := _KEY.match(head):
            out: dict = {}
            dash.append(False)
            while True:
                skip()
                if at >= len(lines) or indent(at) != depth or not (m := _KEY.match(lines[at][depth:])):
                    break
                key = _quoted(m[1]) if m[1][0] in "\"'" else scalar(m[1])
                at += 1
                _put(out, key, rest(lines[at - 1][depth + m.end() :], depth))
            dash.pop()
            if at < len(lines) and indent(at) > depth:
                raise Refused(f"bad indentation at line {at + 1}")
            return out
        at += 1
        return rest(head, depth - 1)

    skip()
    if at >= len(lines):
        return None
    value = node(indent(at))
    skip()
    if at < len(lines):
        raise Refused(f"unexpected text at line {at + 1}")
    return value
