"""A JSON reader that keeps positions, and allows comments and trailing commas."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

_SPACE = re.compile(r"(?:[ \t\r\n]+|//[^\n]*|/\*.*?\*/)*", re.S)
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_STRING = re.compile(r'"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*)"')
_ESCAPE = re.compile(r"(?:\\u[0-9a-fA-F]{4})+|\\.")
_SHORT = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


class BadJson(ValueError):
    def __init__(self, message: str, line: int, column: int):
        super().__init__(message)
        self.line, self.column = line, column


@dataclass(frozen=True)
class Node:
    """A value with its kind, its text as written, and where it stands; columns count bytes from 1."""

    kind: str  # object, array, string, number, boolean, null
    value: Any  # dict of nodes, list of nodes, str, str of a number, bool, None
    raw: str
    line: int
    column: int
    names: tuple[tuple[str, int, int], ...] = ()  # of an object: every property as written, with its place


class Reader:
    def __init__(self, text: str):
        self.text, self.at = text.removeprefix("﻿"), 0

    def place(self, at: int) -> tuple[int, int]:
        start = self.text.rfind("\n", 0, at) + 1
        return self.text.count("\n", 0, at) + 1, len(self.text[start:at].encode("utf-8", "surrogatepass")) + 1

    def fail(self, message: str) -> BadJson:
        return BadJson(message, *self.place(self.at))

    def space(self) -> str:
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def document(self) -> Node:
        node = self.value()
        if self.space():
            raise self.fail("there is more after the end of the document")
        return node

    def value(self) -> Node:
        c = self.space()
        start, (line, column) = self.at, self.place(self.at)
        names: list[tuple[str, int, int]] = []
        if c == "{":
            kind, value = "object", {}
            for _ in self.items("}"):
                if self.space() != '"':
                    raise self.fail("a property name in quotes is expected")
                where = self.place(self.at)
                name = self.string()
                names.append((name, *where))
                if self.space() != ":":
                    raise self.fail("':' is expected")
                self.at += 1
                value.setdefault(name, self.value())  # the first of equal names counts
        elif c == "[":
            kind, value = "array", [self.value() for _ in self.items("]")]
        elif c == '"':
            kind, value = "string", self.string()
        elif m := _NUMBER.match(self.text, self.at):
            kind, value, self.at = "number", m[0], m.end()
        else:
            for word, kind, value in (("true", "boolean", True), ("false", "boolean", False), ("null", "null", None)):
                if self.text.startswith(word, self.at):
                    self.at += len(word)
                    break
            else:
                raise self.fail("a value is expected")
        return Node(kind, value, self.text[start : self.at], line, column, tuple(names))

    def items(self, close: str):
        self.at += 1
        while self.space() != close:
            yield
            c = self.space()
            if c == ",":
                self.at += 1
            elif c != close:
                raise self.fail(f"',' or '{close}' is expected")
        self.at += 1

    def string(self) -> str:
        m = _STRING.match(self.text, self.at)
        if not m:
            raise self.fail("a string isn't closed or holds a character that must be escaped")
        self.at = m.end()

        def plain(e: re.Match) -> str:
            if e[0][1] == "u":
                units = b"".join(int(x, 16).to_bytes(2, "big") for x in re.findall(r"\\u(....)", e[0]))
                return units.decode("utf-16-be", "surrogatepass")
            return _SHORT.get(e[0][1], e[0][1])

        return _ESCAPE.sub(plain, m[1])


def read(text: str) -> Node:
    return Reader(text).document()
