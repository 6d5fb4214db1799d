"""Strict JSON (RFC 8259) in Python workers: C-speed parsing with the standard library's leniencies closed, and an iterative
parser for nesting that is too deep for it."""

from __future__ import annotations

import json
import re
import sys
from typing import Any

sys.set_int_max_str_digits(0)

_TOKEN = re.compile(
    r'[ \t\n\r]*(?:(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<n>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<l>true|false|null)|(?P<p>[{}\[\],:])|(?P<e>\Z))'
)


def _no_constant(name: str) -> Any:
    raise ValueError(f"{name} is no JSON value")


_decoder = json.JSONDecoder(parse_constant=_no_constant)


def loads(text: str) -> Any:
    """Value of a JSON text; ValueError where it is not one. NaN and infinities are errors, as are control characters in strings
    and a byte order mark. Of repeated keys the last counts."""
    if text.startswith("﻿"):
        raise ValueError("byte order mark")
    try:
        return _decoder.decode(text)
    except RecursionError:
        return _deep(text)


def _deep(text: str) -> Any:
    stack: list[list] = []  # [container, pending key]
    value, have, pos = None, False, 0
    expect = "value"
    while True:
        m = _TOKEN.match(text, pos)
        if m is None:
            raise ValueError(f"unexpected character at {pos}")
        pos, g, w = m.end(), m.lastgroup, m[m.lastgroup]
        if expect in ("value", "value or ]"):
            if g == "p" and w in "{[":
                stack.append([{} if w == "{" else [], None])
                expect = "key or }" if w == "{" else "value or ]"
                continue
            if g == "p" and w == "]" and expect == "value or ]":
                value, have = stack.pop()[0], True
            elif g in ("s", "n", "l"):
                value, have = _decoder.decode(w), True
            else:
                raise ValueError(f"value expected at {pos}")
        elif expect in ("key", "key or }"):
            if g == "s":
                stack[-1][1] = _decoder.decode(w)
                m = _TOKEN.match(text, pos)
                if m is None or m["p"] != ":":
                    raise ValueError(f"colon expected at {pos}")
                pos, expect = m.end(), "value"
                continue
            if g == "p" and w == "}" and expect == "key or }":
                value, have = stack.pop()[0], True
            else:
                raise ValueError(f"key expected at {pos}")
        elif expect == "next":
            top = stack[-1][0] if stack else None
            if not stack:
                if g == "e":
                    return value
                raise ValueError(f"extra data at {pos}")
            if g == "p" and w == ",":
                expect = "key" if isinstance(top, dict) else "value"
                continue
            if g == "p" and w == ("}" if isinstance(top, dict) else "]"):
                value, have = stack.pop()[0], True
            else:
                raise ValueError(f"comma or end expected at {pos}")
        if have:
            have = False
            if stack:
                top, key = stack[-1]
                if isinstance(top, dict):
                    top[key] = value
                else:
                    top.append(value)
            expect = "next"
