"""Random inputs against plain versions, without Spark."""

import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkmask.llm import decontam, html, labelled_pages, neardup, secrets, vectors
from sparkmask.llm.textops import ALNUM, SPACED, Words

TEXT = st.text(alphabet=st.sampled_from("aAbZ09 \t\n\x0b.,-_éÉ\x85 漢𝒜"), max_size=40)
PAGES_MODEL = html.learn(labelled_pages.pages(60))
LOWER = {c: c + 32 for c in range(65, 91)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 4))
def test_words_and_shingles(texts, size):
    for table, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Words(texts, table)
        plain = [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
        assert w.count.tolist() == [len(p) for p in plain]
        h, doc, _ = w.shingles(size)
        sets = [{tuple(p[i : i + size]) for i in range(max(1, len(p) - size + 1))} if p else set() for p in plain]
        assert [len(set(h[doc == d].tolist())) for d in range(len(texts))] == [len(s) for s in sets]
        for a in range(len(texts)):
            for b in range(a):
                assert len(set(h[doc == a].tolist()) & set(h[doc == b].tolist())) == len(sets[a] & sets[b])


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_pages_never_break(page):
    out = html.extract(page, PAGES_MODEL)
    assert out == out.strip() and "\n\n\n" not in out
    assert html.extract(f"<p>{'word ' * 5}</p><nav>{page}", PAGES_MODEL).startswith("word")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="token=:'\" AKIabcdef0123456789é", max_size=120))
def test_secrets(text):
    patterns = {k: re.compile(p) for k, p in secrets.PATTERNS.items()}
    found = secrets.find([text], secrets.machine(), patterns)[0]
    for kind, pattern, ok in (
        ("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Tt][Oo][Kk][Ee][Nn])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        assert [(s, e) for s, e, k in found if k == kind] == [m.span() for m in re.finditer(pattern, text) if ok(m)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 6)), max_size=12))
def test_merged_runs(runs):
    start, end = np.array([s for s, _ in runs], np.int64), np.array([s + n for s, n in runs], np.int64)
    flat = decontam._merged(start, end, 30)
    covered = {p for a, b in zip(flat[::2], flat[1::2], strict=True) for p in range(a, b)}
    assert covered == {p for s, n in runs for p in range(s, s + n)}


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 70), st.floats(0.5, 0.999))
def test_linked_pairs(seed, dim, least):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(20, dim))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.2])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    i, j = vectors.linked(x, x, least)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(40) for b in range(40) if np.einsum("i,i", x[a], x[b]) >= least}


def test_sketch_bits_bound_the_similarity():
    """At the threshold a sketch filter loses nothing in many tries; far below it lets little pass."""
    rng, most = np.random.default_rng(3), neardup.most_odd_bits(0.85)
    passed = 0
    for _ in range(60):
        pool = rng.integers(0, 2**63, 900, dtype=np.uint64)
        near = [np.unique(pool[:400]), np.unique(np.concatenate([pool[32:400], pool[400:432]]))]  # 368 / 432
        far = [np.unique(pool[:400]), np.unique(np.concatenate([pool[200:400], pool[400:600]]))]  # 200 / 600
        odd = lambda pair: int(np.bitwise_count(neardup.odd_sketch(neardup.minhash(pair[0])) ^ neardup.odd_sketch(neardup.minhash(pair[1]))).sum())
        assert odd(near) <= most
        passed += odd(far) <= most
    assert passed <= 1


def test_checksums():
    assert secrets.checksum62(b"") == b"000000"
    n = zlib.crc32(b"abc")
    digits = secrets.checksum62(b"abc")
    assert sum("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz".index(chr(c)) * 62**k for k, c in enumerate(reversed(digits))) == n
