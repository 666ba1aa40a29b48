"""Secret scans: an Aho-Corasick pass over the text names places, anchored patterns look only there, and tokens that
carry a checksum are kept only if it holds.
"""

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, numbered, pieces

#: Kinds in the order that breaks ties; those after BASE are what the method adds.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm")
CHUNK = 1 << 18
_HEX_LEAST = 24

#: Lower-case keywords and the kind whose pattern is tried where one begins.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
}
PATTERNS = {
    "assign": rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": rb"AKIA[A-Z0-9]+",
    "github": rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])",
    "npm": rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])",
}
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: bytes) -> bytes:
    """CRC-32 in six digits of base 62, as such tokens end in."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit : digit + 1] + out
    return out


def _valid(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[1]) >= 6
    if kind == "access":
        return len(match[0]) >= 20
    return checksum62(match[1]) == match[2]


def machine() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


_HEX = np.zeros(256, bool)
_HEX[np.r_[0x30:0x3A, 0x61:0x67]] = True


def find(texts: list[str | None], automaton, patterns: dict[str, re.Pattern]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of each text's secrets, in code points, by start and then by kind."""
    out = []
    for i, j in chunks([len(t or "") for t in texts], CHUNK):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[i:j]]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], _HEX[data]]).astype(np.int8)))
        runs = edges.reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] >= _HEX_LEAST]
        offsets = np.cumsum([0] + [len(b) + 1 for b in raw])
        owner = np.searchsorted(offsets, runs[:, 0], "right") - 1
        for d, b in enumerate(raw):
            found = [(int(s), int(e), "hex") for s, e in runs[owner == d] - offsets[d]] if len(runs) else []
            ends = dict.fromkeys(patterns, 0)
            for last, (kind, n) in automaton.iter(b.lower().decode("latin-1")):  # a character a byte; A-Z alone lower-cased
                start = last - n + 1
                if start >= ends[kind] and (match := patterns[kind].match(b, start)):
                    ends[kind] = match.end()
                    if _valid(kind, match):
                        found.append((start, match.end(), kind))
            if found and len(b) != len(texts[i + d]):  # bytes to code points
                point = np.concatenate([[0], np.cumsum((np.frombuffer(b, np.uint8) & 0xC0) != 0x80)])
                found = [(int(point[s]), int(point[e]), kind) for s, e, kind in found]
            out.append(sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))
    return out


def secrets(documents: DataFrame, text_col: str = "text", redact: str | None = None, found_col: str = "found") -> DataFrame:
    """All columns of `documents`, and `found_col`: an array of (kind, start, end) by start and kind; end is exclusive.

    With `redact` the text's secrets, overlapping ones as one, are replaced by it.  Null and empty texts have none, and
    a null text stays null.  Every row is a row of the result; a column that is called like found_col is replaced.
    """
    names = [c for c in documents.columns if c != found_col]
    given = numbered(documents.select(*[F.col(f"`{c}`") for c in names]))
    schema = given.withColumn("found", F.lit(None).cast("array<struct<kind:string,start:int,end:int>>")).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    at = names.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, patterns = machine(), {k: re.compile(p) for k, p in PATTERNS.items()}
        for b in pieces(batches):
            texts = b.column(at).to_pylist()
            found = find(texts, automaton, patterns)
            columns = list(b.columns)
            if redact is not None:
                columns[at] = pa.array([_without(t, f, redact) if f else t for t, f in zip(texts, found, strict=True)], pa.string())
            spans = pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in f] for f in found], kind)
            yield pa.record_batch([*columns, spans], [*b.schema.names, "found"])

    return given.mapInArrow(scan, schema).toDF(*names, found_col)


def _without(text: str, found: list[tuple[int, int, str]], mark: str) -> str:
    out, at = [], 0
    for start, end, _ in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
