"""Sequence packing: best-fit decreasing over windows of fixed capacity.

Documents become token ids; what is longer than a window is first cut into
full windows. The rests are packed by best-fit decreasing: a segment tree
indexed by remaining capacity finds the tightest open window that still takes
a piece. Windows that stay poorly filled keep their pieces too: the emptiest
among them are taken apart, and their pieces, cut to measure, fill up the
others. What is left of the last is split at powers of two, which need no padding.

Each task packs the rows it reads, some thousands at a time, so nothing is
shuffled and a task holds a bounded number of pieces.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
#: Pieces that best-fit decreasing sees at once, in each task.
POOL = 16_384
#: Windows with at least this share filled are not filled up.
FULL_ENOUGH = 0.97
#: The pre-tokens of byte-level BPE (fixed by the vocabulary file's pre-tokenizer).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[tuple[str, bool], "Encoder"] = {}
_proved: dict[str, bool] = {}


def _bytes_of_tokens() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ranks_tell_merges(path: str) -> bool:
    """Whether merging whatever adjacent tokens make the lowest id gives the same ids as the file's merges in their order.

    It does if the merges are in the order of their results' ids and every result,
    cut by the merges before its own, falls into just the two parts of its own: then
    no other two tokens that make it can stand side by side when its turn comes.
    Nothing else in the file may change texts or tokens, and its pre-tokens must be ``PRE_TOKENS``.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type", "BPE") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
             and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "fuse_unk")))
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    turn = {m: k for k, m in enumerate(merges)}
    ids = [model["vocab"].get(a + b, -1) for a, b in merges]
    if not plain or len(turn) < len(merges) or min(ids, default=0) < 0 or any(x >= y for x, y in zip(ids, ids[1:])) or len(model["vocab"]) - len(merges) - len(spec.get("added_tokens", [])) > 256:
        return False
    for k, (left, right) in enumerate(merges):
        parts = list(left + right)
        while len(parts) > 1:
            first, at = min((turn.get(pair, k), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if first >= k:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if parts != [left, right]:
            return False
    return True


class Encoder:
    """Token ids as little-endian 32-bit bytes, by a byte-level BPE file.

    The ids are those of ``tokenizers`` with special tokens taken as text. Where
    ``ranks_tell_merges`` holds, ``tiktoken`` applies the same vocabulary several times faster.
    Both cut a text into the same pre-tokens as far as their regular expressions put every character in the same class; a test compares them on all characters.
    """

    def __init__(self, path: str, by_rank: bool):
        self.encode = self._ranked(path) if by_rank else self._merged(path)

    @staticmethod
    def _merged(path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda text: array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def _ranked(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added, to_byte = {t["content"] for t in spec.get("added_tokens", [])}, _bytes_of_tokens()
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        plain = tiktoken.Encoding("bpe", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        return lambda text: array("I", plain.encode_ordinary(text)).tobytes()


def encoder(path: str, by_rank: bool) -> Encoder:
    if (path, by_rank) not in _encoders:
        _encoders[path, by_rank] = Encoder(path, by_rank)
    return _encoders[path, by_rank]


class CapacityTree:
    """Segment tree over remaining capacities 0..size; leaf c lists the open windows with c left."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.some = [False] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _mark(self, c: int, value: bool) -> None:
        k = c + self.base
        self.some[k] = value
        while k > 1:
            k //= 2
            both = self.some[2 * k] or self.some[2 * k + 1]
            if self.some[k] == both:
                break
            self.some[k] = both

    def put(self, c: int, window: int) -> None:
        self.open[c].append(window)
        if len(self.open[c]) == 1:
            self._mark(c, True)

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest open window with at least ``need`` left, as (capacity, window)."""
        k = need + self.base
        if not self.some[k]:
            while k > 1 and not (k % 2 == 0 and self.some[k + 1]):
                k //= 2
            if k <= 1:
                return None
            k += 1
            while k < self.base:
                k = 2 * k if self.some[2 * k] else 2 * k + 1
        c = k - self.base
        window = self.open[c].pop()
        if not self.open[c]:
            self._mark(c, False)
        return c, window


class Piece(NamedTuple):
    doc: object
    start: int
    ids: bytes
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Indices of pieces, window by window."""
    tree, windows = CapacityTree(window), []
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = tree.take(lengths[k])
        left, w = got if got else (window, len(windows))
        if not got:
            windows.append([])
        windows[w].append(k)
        if left > lengths[k]:
            tree.put(left - lengths[k], w)
    return windows


def fill_up(windows: list[list[Piece]], window: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Windows filled to the end, and the pieces left, of less than two windows.

    The fullest are filled first, with pieces of the emptiest, shortest first; only those are cut.
    """
    waiting = sorted(windows, key=lambda w: sum(p.length for p in w))
    full: list[list[Piece]] = []
    spare: list[Piece] = []
    first, last = 0, len(waiting) - 1
    while first <= last:
        row = list(waiting[last])
        room = window - sum(p.length for p in row)
        while room:
            if not spare:
                if first == last:
                    return full, row
                spare = sorted(waiting[first], key=lambda p: -p.length)
                first += 1
            p = spare.pop()
            row.append(p._replace(ids=p.ids[:4 * room]))
            if p.length > room:
                spare.append(p._replace(start=p.start + room, ids=p.ids[4 * room:]))
            room -= row[-1].length
        full.append(row)
        last -= 1
    return full, spare


def pack_pool(pieces: list[Piece], window: int) -> Iterator[list[Piece]]:
    """Sequences for one pool of pieces, each shorter than a window."""
    pieces = sorted(pieces, key=lambda p: (-len(p.ids), str(p.doc), p.start, p.ids))
    poor: list[list[Piece]] = []
    for group in best_fit_decreasing([p.length for p in pieces], window):
        used = sum(pieces[k].length for k in group)
        if used >= FULL_ENOUGH * window or used & (used - 1) == 0:
            yield [pieces[k] for k in group]
        else:
            poor.append([pieces[k] for k in group])
    full, loose = fill_up(poor, window)
    yield from full
    left = sum(p.length for p in loose)
    row: list[Piece] = []
    room = size = min(window, 1 << max(0, left.bit_length() - 1))
    for p in loose:
        while p.ids:
            part, rest = p.ids[:4 * room], p.ids[4 * room:]
            row.append(p._replace(ids=part))
            p = p._replace(start=p.start + len(part) // 4, ids=rest)
            room -= len(part) // 4
            if not room:
                yield row
                left -= size
                row = []
                room = size = min(window, 1 << max(0, left.bit_length() - 1))


TAIL = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   end_id: int = 1, with_ids: bool = False, pool: int = POOL) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    ``window`` must be a power of two. Null and empty texts are the end id
    alone. Repeated rows and null ids are packed like any other row; other
    columns are not carried. An empty table gives no pieces. ``sequence_id``
    is the task's partition number times 2**32 plus a count. The id may be of any
    type that text can be cast to; a column of the result that has its name
    gets a leading underscore.
    """
    if tokenizer_path not in _proved:
        _proved[tokenizer_path] = ranks_tell_merges(tokenizer_path)
    by_rank, tail = _proved[tokenizer_path], [*TAIL, *["ids"] * with_ids]
    schema = "doc string, " + ", ".join(f"{c} {'array<int>' if c == 'ids' else 'long'}" for c in tail)
    end = int(end_id).to_bytes(4, "little")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, serial = encoder(tokenizer_path, by_rank).encode, TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        waiting: list[Piece] = []

        def emit(sequence: list[Piece]) -> None:
            nonlocal serial
            at = 0
            for p in sequence:
                row = (p.doc, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, serial, at)
                if with_ids:
                    row += (memoryview(p.ids).cast("i").tolist(),)
                rows.append(row)
                at += p.length
            serial += 1

        def out() -> pd.DataFrame:
            frame = pd.DataFrame(rows, columns=["doc", *tail])
            rows.clear()
            return frame

        for batch in batches:
            ids, texts = batch.iloc[:, 0].tolist(), [t if isinstance(t, str) else "" for t in batch.iloc[:, 1]]
            for doc, text in zip(ids, texts):
                data = encode(text) + end
                doc = None if doc is None or doc != doc else doc
                total, cut = len(data) // 4, len(data) - len(data) % (4 * window)
                for at in range(0, cut, 4 * window):
                    emit([Piece(doc, at // 4, data[at:at + 4 * window], total)])
                if cut < len(data):
                    waiting.append(Piece(doc, cut // 4, data[cut:], total))
                if len(waiting) >= pool:
                    for sequence in pack_pool(waiting, window):
                        emit(sequence)
                    waiting.clear()
            yield out()
        for sequence in pack_pool(waiting, window):
            emit(sequence)
        yield out()

    kind = docs.schema[id_col].dataType
    binary = kind.simpleString() == "binary"
    ident = F.hex(id_col) if binary else F.col(id_col).cast("string")
    packed = docs.select(ident.alias("i"), F.col(text_col).alias("t")).mapInPandas(pack, schema)
    back = F.unhex("doc") if binary else F.col("doc").cast(kind)
    return packed.select(back.alias(id_col), *[F.col(c).alias(f"_{c}" if c.lower() == id_col.lower() else c) for c in tail])
