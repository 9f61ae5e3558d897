"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns near hits,
embedded checksum validation.

One automaton over the lower-cased (A-Z) text finds every keyword; a pattern
is tried only where a keyword starts. The hexadecimal kind has no keyword: its
prefilter is a byte-class run of the least length, found for many texts at
once. Kinds, in order:

* ``assign``, ``access``, ``hex``: the base kinds;
* ``github``: ``gh[pousr]_`` and 36 base-62 characters, ``npm``: ``npm_`` and
  36, both kept only if the last six are the base-62 CRC-32 of the first 30.

Nulls and ties: a null text counts as empty and has no spans. Spans of one
kind never overlap (leftmost first); spans of different kinds may. Spans are
ordered by start, then kind. Repeated rows give repeated results; an empty
table gives no rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillscope.llm.common import slices
from tillscope.llm.textnum import spans, text_bytes

# Keywords, patterns and least lengths of the kinds.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = 3
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEYWORDS = {
    "password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0,
    "akia": 1,
    "ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3,
    "npm_": 4,
}
LEAST = {"assign": 8, "access": 16, "hex": 32}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

IS_HEX = np.zeros(256, bool)
IS_HEX[list(b"0123456789abcdef")] = True

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long"


def checksum62(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def keyword_spans(text: str, auto) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the kinds that have keywords."""
    low = text.encode().lower().decode()  # A-Z only: the same code points
    hits: dict[int, list[int]] = {}
    for end, (kind, n) in auto.iter(low):
        hits.setdefault(kind, []).append(end - n + 1)
    out = []
    for kind, starts in hits.items():
        free = 0
        for at in sorted(starts):
            if at < free:
                continue
            if kind == 0:
                if m := ASSIGN.match(text, at):
                    free = m.end()
                    if len(m[2]) >= LEAST["assign"]:
                        out.append((at, kind, free))
            elif kind == 1:
                if m := ACCESS.match(text, at):
                    free = m.end()
                    if free - at >= LEAST["access"]:
                        out.append((at, kind, free))
            elif (m := CHECKED.match(text, at)) and checksum62(m[1]) == m[2]:
                free = m.end()
                out.append((at, kind, free))
    return out


def scan_texts(texts: pa.Array, auto) -> list[list[tuple[int, int, int]]]:
    """Per text its sorted (start, kind, end)."""
    buf, off = text_bytes(texts)
    starts, ends, _ = spans(~IS_HEX[buf], off)
    long = np.flatnonzero(ends - starts >= LEAST["hex"])
    hexes: dict[int, list[tuple[int, int]]] = {}
    owner = np.searchsorted(off, starts[long], side="right") - 1
    for i, s, e in zip(owner.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        hexes.setdefault(i, []).append((s, e))
    out = []
    for i in range(len(off) - 1):
        raw = buf[off[i] : off[i + 1]].tobytes()
        found = keyword_spans(raw.decode(), auto) if raw else []
        chars, done = 0, int(off[i])
        for s, e in hexes.get(i, ()):
            chars += len(buf[done:s].tobytes().decode())
            found.append((chars, 2, chars + e - s))
            chars, done = chars + e - s, e
        out.append(sorted(found))
    return out


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds, a digest of their spans and
    all spans as text. Narrow: every text is read where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for found in scan_texts(part.column("text"), auto):
                    said = [f"{KINDS[k]}:{s}:{e}" for s, k, e in found]
                    base = ",".join(x for x, (_, k, _) in zip(said, found, strict=True) if k < BASE)
                    count = [sum(k == kind for _, k, _ in found) for kind in range(BASE)]
                    rows.append((*count, hashlib.sha256(base.encode()).hexdigest(), ",".join(said), len(found) - sum(count)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()),
                     pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int64())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
