"""Tokens of a script."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import Refused

UNITS = {"ns": 0.001, "us": 1, "ms": 1000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
_PARTS = (
    ("skip", r"\s+|#[^\n]*|--[^\n]*"),
    ("string", r"'(?:[^'\\]|\\.)*'"),
    ("bytes", r"0x(?:[0-9a-fA-F]{2})*"),
    ("duration", r"(?:\d+(?:ns|us|ms|s|m|h|d|w))+(?![A-Za-z0-9_])"),
    ("number", r"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"),
    ("param", r"\$[A-Za-z_]\w*"),
    ("word", r"[A-Za-z_]\w*(?:::[A-Za-z_]\w*)?"),
    ("op", r"->|<-|\.\.=|\.\.|\?\?|!=|<=|>=|[=<>+\-*/%()\[\]{},;:.~|]"),
)
_TOKEN = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _PARTS), re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text

    @property
    def value(self):
        if self.kind == "string":
            return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), self.text[1:-1], flags=re.S)
        if self.kind == "bytes":
            return bytes.fromhex(self.text[2:])
        if self.kind == "duration":
            return sum(int(n) * UNITS[u] for n, u in re.findall(r"(\d+)([a-z]+)", self.text))
        return float(self.text) if re.search(r"[.eE]", self.text) else int(self.text)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise Refused("UnexpectedCharacter", f"{text[at]!r} at {at}")
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("end", "", len(text))]
