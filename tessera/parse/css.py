"""A small CSS parser: declarations with their rule, media query and place."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_IMPORTANT = re.compile(r"\s*!\s*important\s*$", re.I)
_STOP = re.compile(r"""[;{}"'()\\]|/\*""")


class CssError(ValueError):
    pass


@dataclass
class Declaration:
    prop: str
    value: str
    selector: str | None
    media: str | None
    start: int
    end: int  # past the semicolon, if there is one


class Lines:
    """Places in a text: line from 1, column from 0 in UTF-16 units."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer(r"\r\n|[\n\r\u2028\u2029]", text))]

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        piece = self.text[self.starts[line - 1] : at]
        return line, len(piece) + (0 if piece.isascii() else sum(ord(c) > 0xFFFF for c in piece))

    def span(self, start: int, end: int) -> dict:
        (line, col), (end_line, end_col) = self.place(start), self.place(end)
        return {"line": line, "col": col, "endLine": end_line, "endCol": end_col}


def parse(code: str) -> list[Declaration]:
    """All declarations in order; CssError where the text is malformed."""
    out: list[Declaration] = []
    stack: list[tuple[str, str]] = []  # (kind, selector or parameters)
    at, n = 0, len(code)
    while True:
        at = _skip_blank(code, at)
        if at >= n:
            break
        if code[at] == "}":
            if not stack:
                raise CssError("Unexpected }")
            stack.pop()
            at += 1
            continue
        if code[at] == ";":
            at += 1
            continue
        stop, custom = _scan(code, at), code.startswith("--", at)
        ended = stop < n
        if ended and code[stop] == "{" and not custom:
            prelude = _clean(code[at:stop])
            if prelude.startswith("@"):
                name, _, params = prelude[1:].partition(" ") if re.match(r"@[\w-]+\s", prelude) else _at_rule(prelude)
                stack.append(("media" if name.lower() == "media" else "at", params.strip()))
            else:
                stack.append(("rule", prelude))
            at = stop + 1
            continue
        if code[at] != "@":
            out.append(_declaration(code, at, stop, stack))
        at = stop + 1 if ended and code[stop] == ";" else stop
    if stack:
        raise CssError("Unclosed block")
    return out


def _at_rule(prelude: str):
    m = re.match(r"@([\w-]*)", prelude)
    return m.group(1), "", prelude[m.end() :]


def _skip_blank(code: str, at: int) -> int:
    while at < len(code):
        if code[at] in " \t\n\r\f\ufeff":
            at += 1
        elif code.startswith("/*", at):
            end = code.find("*/", at + 2)
            if end < 0:
                raise CssError("Unclosed comment")
            at = end + 2
        else:
            break
    return at


def _scan(code: str, at: int) -> int:
    """The next ; { or } outside of strings, comments and parentheses."""
    depth = braces = 0
    custom = code.startswith("--", at)
    while m := _STOP.search(code, at):
        c, at = m.group(), m.end()
        if c == "\\":
            at += 1
        elif c == "/*":
            at = code.find("*/", at) + 2
            if at < 2:
                raise CssError("Unclosed comment")
        elif c in "\"'":
            while True:
                q = code.find(c, at)
                if q < 0:
                    raise CssError("Unclosed string")
                back = len(code[at:q]) - len(code[at:q].rstrip("\\"))
                at = q + 1
                if back % 2 == 0:
                    break
        elif c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif custom and c == "{":
            braces += 1
        elif custom and c == "}" and braces:
            braces -= 1
        elif not braces and (depth == 0 or c in "{}"):
            return at - 1
    if depth:
        raise CssError("Unclosed bracket")
    return len(code)


def _clean(text: str) -> str:
    return _COMMENT.sub("", text).strip()


def _declaration(code: str, start: int, stop: int, stack: list[tuple[str, str]]) -> Declaration:
    raw = code[start:stop]
    m = re.match(r"((?:/\*.*?\*/|[^:\s/])+)(?:\s|/\*.*?\*/)*:", raw, re.S)
    if not m:
        raise CssError(f"Unknown word {raw.strip()[:40]}")
    prop = _COMMENT.sub("", m.group(1))
    if prop[:1] in "_*$" and len(prop) > 1:
        prop = prop[1:]
    value = _clean(raw[m.end() :])
    if not prop.startswith("--"):
        value = _IMPORTANT.sub("", value)
    end = stop + 1 if stop < len(code) and code[stop] == ";" else start + len(raw.rstrip())
    selector = stack[-1][1] if stack and stack[-1][0] == "rule" else None
    media = next((params for kind, params in reversed(stack) if kind == "media"), None)
    return Declaration(prop, value, selector, media, start, end)
