"""Hierarchical multi-length packing of tokenised documents.

Documents become token ids followed by one end id. A document of a long
window or more gives whole long windows; what is left of it, like every
shorter document, is routed to the smallest context tier that holds it. Each
tier is packed, longest pieces first; gaps of long windows are filled with the
largest piece of the shorter tiers that fits, and the last few tokens by
cutting a piece. Long windows may keep a gap of ``SLACK`` tokens (padding);
shorter tiers are filled exactly, since only a power-of-two length needs no
padding. Windows of one context size form step groups of ``STEP`` tokens, so
every full step group holds the same number of tokens.

Packing runs inside the scan's tasks: no shuffle, and a task holds at most
``POOL`` pieces shorter than a long window. A task ends with at most one padded
window. Sequence ids are (partition << 33) + window number.

Ids are those of the ``tokenizers`` library for the given file. Texts without
a special token are encoded by ``tiktoken`` with the byte-pair ranks of the
same file, which gives the same ids in a third of the time; texts with a
white-space run of ``RUN`` characters, whose matching would overflow the stack
there, go to ``tokenizers`` too.

Nulls and ties: a null text counts as empty and packs as its end id alone; a
null doc_id stays null. Pieces of equal length go in input order. Repeated
rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tillscope.llm.common import released, slices

TIERS = (1024, 512, 256, 128)
SLACK = 8
STEP = 16 * 1024
POOL = 2048
END = b"\0\0\0\0"
RUN = 10_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "context int, step_id long"
)
# GPT-2's fixed pre-tokenisation pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(path: str) -> tuple[dict[bytes, int], list[str]]:
    """Byte strings and ids of a byte-level vocabulary file, and its special tokens.
    Byte-level files show printable bytes as themselves and the others, in
    order, as the characters from 256 on."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = [t["content"] for t in spec["added_tokens"]]
    ranks = {bytes(back[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
    return ranks, special


class Encoder:
    """Text to little-endian 32-bit ids."""

    def __init__(self, path: str):
        import tiktoken

        ranks, self.special = byte_ranks(path)
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.blank = path, re.compile(r"\s{%d}" % RUN)

    @cached_property
    def whole(self):
        """The file's own tokenizer, loaded where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special) or len(text) >= RUN and self.blank.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.plain.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


class Packer:
    """Streaming packer of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, task: int, with_ids: bool = False):
        self.base, self.with_ids = task << 33, with_ids
        self.sequences, self.steps = 0, 0
        self.open_step: dict[int, tuple[int, int]] = {}
        self.length: list[int] = []  # the pool, by length
        self.piece: list[tuple] = []
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n, long = len(ids) // 4, TIERS[0]
        for at in range(0, n - n % long, long):
            self._emit([(doc_id, at, ids[4 * at : 4 * (at + long)], n)])
        if n % long:
            at = n - n % long
            self._put((doc_id, at, ids[4 * at :], n))
        if len(self.length) >= POOL:
            self._pack(POOL // 4)

    def finish(self) -> None:
        self._pack(0)

    def _put(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        at = bisect_left(self.length, n)  # popped from the right: input order among equals
        self.length.insert(at, n)
        self.piece.insert(at, piece)

    def _take(self, at: int) -> tuple:
        self.length.pop(at)
        return self.piece.pop(at)

    def _pack(self, leave: int) -> None:
        """Pack the pool, tier by tier, until ``leave`` pieces are left."""
        for k, size in enumerate(TIERS):
            below = TIERS[k + 1] if k + 1 < len(TIERS) else 0
            while len(self.length) > leave and self.length[-1] > below:
                window, gap = [self._take(-1)], size
                gap -= len(window[0][2]) // 4
                slack = SLACK if k == 0 else 0
                while gap and (at := bisect_right(self.length, gap)):
                    window.append(self._take(at - 1))
                    gap -= len(window[-1][2]) // 4
                if gap > slack and self.length:  # every piece left is longer
                    doc_id, start, ids, n = self._take(0)
                    window.append((doc_id, start, ids[: 4 * gap], n))
                    self._put((doc_id, start + gap, ids[4 * gap :], n))
                    gap = 0
                if gap <= slack:
                    self._emit(window)
                else:  # the task's last pieces
                    self._rest(window)

    def _rest(self, window: list[tuple]) -> None:
        """Exact windows of the shorter tiers, then one that is padded."""
        for size in (*TIERS[1:], TIERS[0]):
            total = sum(len(p[2]) for p in window) // 4
            if not total or (total < size and size != TIERS[0]):
                continue
            out, need = [], min(size, total)
            while need:
                doc_id, start, ids, n = window.pop(0)
                if len(ids) // 4 > need:
                    window.insert(0, (doc_id, start + need, ids[4 * need :], n))
                    ids = ids[: 4 * need]
                out.append((doc_id, start, ids, n))
                need -= len(ids) // 4
            self._emit(out)

    def _emit(self, window: list[tuple]) -> None:
        total = sum(len(p[2]) for p in window) // 4
        context = total if total in TIERS else TIERS[0]
        step, left = self.open_step.get(context, (0, 0))
        if not left:
            step, left = self.steps, STEP // context
            self.steps += 1
        self.open_step[context] = (step, left - 1)
        at = 0
        for doc_id, start, ids, n in window:
            row = (doc_id, start, len(ids) // 4, zlib.crc32(ids), n, self.base + self.sequences, at, context, self.base + step)
            self.rows.append((*row, ids) if self.with_ids else row)
            at += len(ids) // 4
        self.sequences += 1

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True))
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.binary()] * self.with_ids
        names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * self.with_ids
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def pack_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, context, step_id; ``with_ids`` adds the piece's ids
    (little-endian 32-bit integers). ``tokenizer``: path of a byte-level BPE
    file that every executor can read."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(tokenizer), Packer(TaskContext.get().partitionId(), with_ids)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    packer.add(doc_id, encode(text or "") + END)
                if packer.rows:
                    yield packer.batch()
        packer.finish()
        if packer.rows:
            yield packer.batch()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(run, SCHEMA + ", ids binary" * with_ids)
