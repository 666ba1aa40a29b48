"""Licence scans by conditional compression.

Sentences that share words with licence notices form candidate blocks.  In a block, every part as long as a template
that starts with three words of it is laid beside that template and confirmed by the words that differ.  Confirmed parts
are compressed alone and with the template as a raw zstandard dictionary, and ranked by the bytes that this saves.
"""

import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .license_texts import TEMPLATES

#: A text without any of these has no block; and a block must hold one.
KEYWORD = re.compile(r"licen[sc]e|copyright|redistribut|permission|public domain|warrant|waived", re.I)
_SENTENCE = re.compile(r"(?:[^\n.!?]|[.!?](?!\s|\Z))+[.!?]*")
_WORD = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*[A-Za-z0-9]|[A-Za-z0-9]")
#: Share of a sentence's words that templates know; least size reduction; differing words in a hundred.
KNOWN, REDUCTION, DIFFERENT = 0.6, 0.2, 15
#: Shortest run of common words that a part starts and ends with; words that a part cut off at its block's edge has.
RUN, CUT_OFF = 3, 10


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    def __init__(self, templates: dict[str, list[str]]):
        self.plain = zstandard.ZstdCompressor(level=19, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.known, self.by = set(), []
        for name, texts in sorted(templates.items()):
            for text in texts:
                given = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                squeeze = zstandard.ZstdCompressor(level=19, dict_data=given, write_content_size=False, write_checksum=False, write_dict_id=False)
                self.by.append((name, Template(words(text)), squeeze))
                self.known.update(words(text))

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """Runs of neighbouring sentences whose words templates know, with a keyword in the run."""
        start = end = None
        for m in _SENTENCE.finditer(text):
            own = words(m[0])
            if own and sum(w in self.known for w in own) >= KNOWN * len(own):
                start, end = m.start() if start is None else start, m.end()
            elif own and start is not None:
                if KEYWORD.search(text, start, end):
                    yield start, end
                start = None
        if start is not None and KEYWORD.search(text, start, end):
            yield start, end

    def scan(self, text: str | None) -> list[dict]:
        if not text or not KEYWORD.search(text):
            return []
        found = []
        for start, end in self.blocks(text):
            lead = len(text[start:end]) - len(text[start:end].lstrip())
            start, block = start + lead, text[start:end].strip()
            at = [m.span() for m in _WORD.finditer(block)]
            own = [block[i:j].lower() for i, j in at]
            for _, _, n, first, last, name, reduction in self.notices(block, at, own):
                begin = at[first][0] if first else 0
                finish = at[last - 1][1] if last < len(at) else len(block)
                found.append({"start": start + begin, "end": start + finish, "license": name, "reduction": round(reduction, 4), "n_words": last - first, "n_different": n})
        return found

    def notices(self, block: str, at: list[tuple[int, int]], own: list[str]) -> list[tuple]:
        """Confirmed parts of a block that don't overlap, in order.

        The part that saves most bytes wins, or of those nearly as good that overlap it the one that differs least.  Its
        words are cut out, and what is left is judged again until nothing is confirmed.
        """
        own, won, judged = list(own), [], {}
        whole = len(self.plain.compress(block.lower().encode("utf-8", "surrogatepass")))
        while True:
            parts = set()
            for k, (name, template, squeeze) in enumerate(self.by):
                for i in template.starts(own):
                    if (k, i) not in judged:
                        judged[k, i] = self.judged(block, at, template.part(own, i), name, squeeze, whole)
                    if judged[k, i]:
                        parts.add(judged[k, i])
            # parts that overlap none better are independent of one another: all of them win at once
            cut, left = [], sorted(parts, key=lambda p: (-p[0], p[2], p[3], p[5]))
            taken = bytearray(len(own))
            by_word = self.by_word(left, len(own))
            for top in left:
                if any(taken[top[3] : top[4]]):
                    continue
                rivals = {p for w in range(top[3], top[4]) for p in by_word[w] if p[0] >= top[0] - 0.05 * top[1] and not any(taken[p[3] : p[4]])}
                best = min(rivals, key=lambda p: (p[2], -p[0], p[3], p[5]))
                cut.append(best)
                taken[best[3] : best[4]] = b"\1" * (best[4] - best[3])
            if not cut:
                return sorted(won, key=lambda p: p[3])
            won += cut
            for _, _, _, first, last, *_ in cut:
                own[first:last] = [None] * (last - first)
            # what was judged stays so unless its words were among those cut out
            judged = {(k, i): p for (k, i), p in judged.items() if not any(taken[i : i + self.by[k][1].longest])}

    @staticmethod
    def by_word(parts: list[tuple], n: int) -> list[list[tuple]]:
        """The parts over each of n words."""
        out = [[] for _ in range(n)]
        for p in parts:
            for w in range(p[3], p[4]):
                out[w].append(p)
        return out

    def judged(self, block: str, at: list[tuple[int, int]], part: tuple | None, name: str, squeeze, whole: int) -> tuple | None:
        """(bytes saved, bytes alone, differing words, first word, one past the last, name, reduction) of a part that is small enough."""
        if part is None:
            return None
        n, first, last, complete = part
        raw = block[at[first][0] : at[last - 1][1]].lower().encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        saved = alone - len(squeeze.compress(raw))
        return (saved, alone, n, first, last, name, saved / alone) if saved >= REDUCTION * (alone if complete else whole) else None


class Template:
    """The words of a wording, and the parts of a block that differ from it by few words."""

    def __init__(self, own: list[str]):
        self.words, self.at = own, {}
        for j in range(len(own) - RUN + 1):
            self.at.setdefault(tuple(own[j : j + RUN]), []).append(j)
        self.match = difflib.SequenceMatcher(None, [], own, autojunk=False)
        #: A longer part has too many words that the template lacks.
        self.longest = len(own) * 100 // (100 - DIFFERENT)

    def starts(self, block: list[str]) -> list[int]:
        """Where runs of common words start; a confirmed part starts at one."""
        return [
            i
            for i in range(len(block) - RUN + 1)
            if any(not (i and j and block[i - 1] == self.words[j - 1]) for j in self.at.get(tuple(block[i : i + RUN]), ()))
        ]

    def part(self, block: list[str], start: int) -> tuple[int, int, int, bool] | None:
        """The longest confirmed part in the words from start as (differing words, first, one past the last, complete).

        A part starts and ends with RUN common words.  Within, words that the template lacks in order differ, and so do
        words of the template left out between matched ones; beyond, words differ as far as block and template both go
        on.  A part that the block's edge cuts off is complete with CUT_OFF words, or all of a shorter template.
        """
        self.match.set_seq1(block[start : start + self.longest])
        runs = [(start + m.a, m.b, m.size) for m in self.match.get_matching_blocks()[:-1]]
        best = None
        for p, (first, b, size) in enumerate(runs):
            if size < RUN:
                continue
            before, same = min(first, b), 0
            for a, c, size in runs[p:]:
                same += size
                last, end = a + size, c + size
                n = before + (last - first - same) + (end - b - same) + min(len(block) - last, len(self.words) - end)
                if size >= RUN and 100 * n <= DIFFERENT * (last - first):
                    left_out = b + len(self.words) - end
                    complete = 100 * (n + left_out) <= DIFFERENT * (last - first) or same >= min(CUT_OFF, len(self.words))
                    best = max(best or (), (same - n, (n, first, last, complete)))
        return best and best[1]


def license_blocks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each confirmed notice: (id, start, end, license, reduction, n_words, n_different, exact).

    Bounds are code points, end exclusive.  Null and empty texts and texts without a notice give no row; every row of
    the input is scanned by itself, so repeated rows give repeated rows.
    """
    kind = dict(documents.dtypes)[id_col]
    names = {"start": pa.int32(), "end": pa.int32(), "license": pa.string(), "reduction": pa.float64(), "n_words": pa.int64(), "n_different": pa.int64()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(TEMPLATES)
        for b in pieces(batches):
            rows = [(k, x) for k, t in enumerate(b.column("text").to_pylist()) for x in scanner.scan(t)]
            ids = b.column("id").take(pa.array([k for k, _ in rows], pa.int64()))
            yield pa.record_batch([ids, *(pa.array([x[n] for _, x in rows], t) for n, t in names.items())], ["id", *names])

    given = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = given.mapInArrow(scan, f"id {kind}, start int, end int, license string, reduction double, n_words long, n_different long")
    return out.withColumn("exact", F.col("n_different") == 0).withColumnRenamed("id", id_col)
