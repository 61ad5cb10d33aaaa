"""Repeated windows of a corpus by anchors, the common part of the two substring operators.

A window is `length` consecutive units (words or bytes) of one document. Its anchor is the k-gram in it with the
smallest hash, so equal windows have equal anchors at equal places. Consecutive windows with one anchor form a run;
a document has about 2 / (length - k + 2) runs for each unit. Only runs whose anchor occurs again go further."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, slices, text_bytes

_PLACE = np.uint64((1 << 24) - 1)
_PIECE = 1 << 22

def _id() -> Column:
    """A null doc_id ranks after all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id")


def tag(text: bytes) -> int:
    """24 bits that tell apart texts that come with one doc_id."""
    return zlib.crc32(text) & 0xFFFFFF


def pack(start: int, more: int, mark: int) -> int:
    """A run in one number that orders by its start: first window, windows after it, tag."""
    return start << 32 | more << 24 | mark


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Words:
    """Windows of words; a span's text has the words joined by one space."""

    def __init__(self, length: int, k: int):
        self.length, self.k = length, k

    def units(self, text: bytes) -> list[bytes]:
        return text.split()

    def hashes(self, pieces: list[list[bytes]]) -> tuple[np.ndarray, Callable[[int, int], bytes]]:
        words = list(chain.from_iterable(pieces))
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        h = np.zeros(len(words), np.uint64)
        for j in range(self.k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + np.concatenate([own[j:], np.zeros(min(j, len(own)), np.uint64)])
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts, ends = np.concatenate(([0], ends + 1)).tolist(), ends.tolist()
        return _mixed(h), lambda a, b: joined[starts[a] : ends[b - 1]]

    def kept(self, units: list[bytes], gone: np.ndarray) -> bytes:
        return b" ".join([u for u, g in zip(units, gone.tolist()) if not g])

    def join(self, units: list[bytes]) -> bytes:
        return b" ".join(units)


class Bytes:
    """Windows of bytes; k is a multiple of 8."""

    def __init__(self, length: int, k: int):
        self.length, self.k = length, k

    def units(self, text: bytes) -> bytes:
        return text

    def hashes(self, pieces: list[bytes]) -> tuple[np.ndarray, Callable[[int, int], bytes]]:
        text = b"".join(pieces)
        padded = np.frombuffer(text + b"\0" * (self.k + 8), np.uint8)
        eight = np.lib.stride_tricks.as_strided(padded, (len(padded) - 8, 8), (1, 1))
        eight = np.ascontiguousarray(eight).view("<u8").ravel()
        h = np.zeros(len(text), np.uint64)
        for j in range(0, self.k, 8):
            h = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + eight[j : j + len(text)])
        return h, lambda a, b: text[a:b]

    def kept(self, units: bytes, gone: np.ndarray) -> bytes:
        return np.frombuffer(units, np.uint8)[~gone].tobytes()

    def join(self, units: bytes) -> bytes:
        return units


def _lowest(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive values."""
    p, n = 1, len(v) - w + 1
    while 2 * p <= w:
        v = np.minimum(v[:-p], v[p:])
        p *= 2
    return np.minimum(v[:n], v[w - p : w - p + n])


def _runs(h: np.ndarray, lengths: list[int], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, piece, first and last window of each run, over pieces that lie end to end."""
    n = len(h) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return h[:0], none, none, none
    v = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    at = (_lowest(v, length - k + 1)[:n] & _PLACE).astype(np.int64)
    piece = np.repeat(np.arange(len(lengths)), lengths)
    whole, piece = piece[:n] == piece[length - 1 :], piece[:n]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1]) | (whole[1:] != whole[:-1]))))
    last = np.concatenate((new[1:], [n])) - 1
    new, last = new[whole[new]], last[whole[new]]
    return h[at[new]], piece[new], new, last


def anchors(docs: DataFrame, unit: Words | Bytes) -> DataFrame:
    """docs (doc_id, text) -> anchor long, around long, id long, at long: a row for each run.

    `around` hashes all units of the run's windows. Texts over 4M units are cut into overlapping pieces."""
    length = unit.length

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pieces, own = [], []
            for i, text in zip(batch.column("id").to_pylist(), text_bytes(batch.column("text"))):
                units, mark = unit.units(text), tag(text)
                for start in range(0, max(1, len(units) - length + 1), _PIECE):
                    pieces.append(units[start : start + _PIECE + length - 1])
                    own.append((i, start, mark))
            group: list[int] = []
            size = 0
            for p in range(len(pieces) + 1):
                if group and (p == len(pieces) or size + len(pieces[p]) > 3 * _PIECE):
                    yield from emit([pieces[g] for g in group], [own[g] for g in group])
                    group, size = [], 0
                if p < len(pieces):
                    group.append(p)
                    size += len(pieces[p])

    def emit(pieces: list, own: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        h, span = unit.hashes(pieces)
        lengths = [len(p) for p in pieces]
        anchor, piece, first, last = _runs(h, lengths, length, unit.k)
        ids, starts, marks = (np.array(x, np.int64) for x in zip(*own))
        begins = np.cumsum([0, *lengths[:-1]])
        around = [xxhash.xxh3_64_intdigest(span(a, b + length)) for a, b in zip(first.tolist(), last.tolist())]
        at = (first - begins[piece] + starts[piece]) << 32 | (last - first) << 24 | marks[piece]
        columns = [anchor.view(np.int64), np.array(around, np.uint64).view(np.int64), ids[piece], at]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "around", "id", "at"])

    return docs.select(_id(), F.col("text").cast("string").alias("text")).mapInArrow(of, "anchor long, around long, id long, at long")


def anchor_places(texts: list[bytes], more: Iterable[int], unit: Bytes) -> list[int]:
    """Where in a run's text its anchor lies: of the k-grams that all its windows hold, the first with the smallest hash."""
    if not texts:
        return []
    h = unit.hashes(texts)[0] & ~_PLACE
    out, begin = [], 0
    for text, m in zip(texts, more):
        out.append(m + int(h[begin + m : begin + unit.length - unit.k + 1].argmin()))
        begin += len(text)
    return out


def repeated_runs(docs: DataFrame, unit: Words | Bytes) -> DataFrame:
    """Of anchors(), the rows whose anchor occurs more than once, as a table."""
    spark = docs.sparkSession
    again = materialise(anchors(docs, unit).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeated-anchors")
    release(spark)
    runs = materialise(anchors(docs, unit).join(again, "anchor"), "runs")
    release(spark)
    return runs


def run_keys(runs: DataFrame) -> DataFrame:
    """A row for each distinct (anchor, around) as a table: its first run in (id, at) order and how many keys share
    the anchor. Runs with equal keys have equal windows: a path without branches."""
    keys = materialise(runs.groupBy("anchor", "around").agg(F.min(F.struct("id", "at")).alias("first")), "run-keys")
    branches = keys.groupBy("anchor").agg(F.count("*").alias("keys"))
    return materialise(keys.join(branches, "anchor"), "branches")


def with_text(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """docs with an array column of `listed` (id, items) where there is one; all other rows too, with null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _id()).join(listed, "id", "left")


def removed_spans(items: list[dict] | None, mark: int, n: int, length: int) -> np.ndarray | None:
    """Which of n units lie in a window of the listed runs (packed numbers) of this text."""
    edge = None
    for at in items or ():
        if at & 0xFFFFFF == mark:
            if edge is None:
                edge = np.zeros(n + 1, np.int32)
            start = at >> 32
            edge[start] += 1
            edge[start + (at >> 24 & 0xFF) + length] -= 1
    return None if edge is None else np.cumsum(edge[:-1]) > 0


def apply_removals(docs: DataFrame, ranges: DataFrame, unit: Words | Bytes) -> DataFrame:
    """ranges (id, at) -> doc_id, n (units), n_removed, n_spans, kept_sha256, a row for each row of docs."""
    listed = ranges.groupBy("id").agg(F.collect_list("at").alias("items"))  # as many as the document's own runs

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for i, text, items in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), batch.column("items").to_pylist()):
                units = unit.units(text)
                gone = removed_spans(items, tag(text), len(units), unit.length) if items else None
                if gone is None:
                    rows.append((i, len(units), 0, 0, hashlib.sha256(unit.join(units)).hexdigest()))
                else:
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    rows.append((i, len(units), int(gone.sum()), spans, hashlib.sha256(unit.kept(units, gone)).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "n", "n_removed", "n_spans", "kept_sha256"])

    return with_text(docs, listed).select("doc_id", "text", "items").mapInArrow(of, "doc_id long, n long, n_removed long, n_spans long, kept_sha256 string")
