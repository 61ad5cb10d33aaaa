"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

The plan is made over the histogram of piece lengths, which has at most `capacity` rows whatever the corpus holds:
best-fit decreasing over counts. Documents then take the planned slots by a join on their rank within their length."""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, text_bytes

#: Words that are encoded together.
_AT_ONCE = 2048

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SMALL = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
RUNS = "length long, first_rank long, n long, per_sequence long, first_sequence long, at long"


def word_ids(tokenizer_path: str, most: int = 400_000) -> Callable[[list[bytes]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space, writes ASCII letters small, and none of its pre-tokens crosses white space, so
    a text's ids are its words' ids in order. Up to `most` distinct words are kept in memory; the rest are encoded
    for each batch that has them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    known: dict[bytes, bytes] = {}
    tokens = tokenizer.get_vocab()
    last = np.zeros(max(tokens.values()) + 1, bool)  # by id: whether it ends a pre-token
    last[[i for t, i in tokens.items() if t.endswith("</w>")]] = True

    def one_by_one(words: list[bytes], texts: list[str]) -> None:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        known.update(zip(words, [array("I", e.ids).tobytes() for e in found]))

    def together(words: list[bytes], texts: list[str]) -> None:
        """Words of letters alone, as one text: each is a pre-token, and its ids end with the first that ends one. A
        word gives one such id at least, so if there are as many as words, each has its own."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(last[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return one_by_one(words, texts)
        joined = ids.tobytes()
        known.update(zip(words, [joined[a:b] for a, b in zip([0, *ends], ends)]))

    def learn(words: Iterable[bytes]) -> list[bytes]:
        new = list(words)
        for at in range(0, len(new), _AT_ONCE):  # an encoding holds far more than its ids
            kinds: tuple[list, list] = [], []
            for w in new[at : at + _AT_ONCE]:
                text = w.decode("utf-8", "replace")
                kinds[text.isalpha()].append((w, text))
            for kind, encoded in zip(kinds, (one_by_one, together)):
                if kind:
                    encoded(*map(list, zip(*kind)))
        return new

    def encode(texts: list[bytes]) -> list[bytes]:
        # Special strings are matched before letters are made small.
        split = [(t if b"<|" in t else t.translate(_SMALL)).split() for t in texts]
        new = set(chain.from_iterable(split)).difference(known)
        # One mark after an ASCII letter is a pre-token of its own.
        marked = [w for w in new if w[-1] in b".,;:!?" and w[-2:-1].islower()]
        new.difference_update(marked)
        new.update([w[:-1] for w in marked], [w[-1:] for w in marked])
        added = learn(new.difference(known))
        known.update([(w, known[w[:-1]] + known[w[-1:]]) for w in marked])
        ids = [b"".join(map(known.__getitem__, words)) for words in split]
        if len(known) > most:
            for w in chain(added, marked):
                known.pop(w, None)
        return ids

    return encode


_encoders: dict[str, Callable[[list[bytes]], list[bytes]]] = {}


def encoder(path: str) -> Callable[[list[bytes]], list[bytes]]:
    if path not in _encoders:
        _encoders[path] = word_ids(path)
    return _encoders[path]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """docs (doc_id, text, ...) -> PIECES: each document's ids and `end_id`, cut only where it is longer than capacity."""
    end, width = array("I", [end_id]).tobytes(), 4 * capacity

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in slices(batches):
            rows = []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), encode(text_bytes(batch.column("text")))):
                ids = own + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows of RUNS.

    The pieces of a length, ranked from 0, that fall into [first_rank, first_rank + n) go per_sequence to a
    sequence, from first_sequence on, at offset `at`. Sequences with the same free space are kept as one group,
    so the work follows the number of distinct lengths. A group is split at most twice by a length, so there are
    at most 3 * capacity groups, and a sequence holds under sqrt(2 * capacity) distinct lengths: the plan has at
    most 3 * capacity * (sqrt(2 * capacity) + 1) rows."""
    free: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    runs, sequences = [], 0

    def keep(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in groups:
                groups[space] = []
                insort(free, space)
            groups[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(space: int, first: int, n: int) -> int:
            """Puts pieces of this length into a group; how many of its sequences it used."""
            nonlocal left, rank
            per = space // length
            whole = min(n, left // per)
            if whole:
                runs.append((length, rank, whole * per, per, first, capacity - space))
                keep(space - whole_length(per), first, whole)
                left, rank = left - whole * per, rank + whole * per
            if left and whole < n:
                runs.append((length, rank, left, left, first + whole, capacity - space))
                keep(space - whole_length(left), first + whole, 1)
                left, rank, whole = 0, rank + left, whole + 1
            return whole

        def whole_length(n: int) -> int:
            return n * length

        while left and (i := bisect_left(free, length)) < len(free):
            space = free[i]
            first, n = groups[space].pop()
            if not groups[space]:
                del groups[space], free[i]
            used = fill(space, first, n)
            keep(space, first + used, n - used)
        if left:
            n = -(-left // (capacity // length))
            fill(capacity, sequences, n)
            sequences += n
    return runs


def ranked_within(rows: DataFrame, key: str, ties: list[str], counts: dict[int, int], per_task: int = 1_000_000) -> DataFrame:
    """Adds `rank`, from 0 and gapless within each value of `key`, without one task ever holding a whole value.

    Rows are dealt to salts by a hash, numbered within (key, salt), and shifted by the rows of lower salts."""
    salts = max(64, -(-max(counts.values(), default=1) // per_task))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*ties), F.lit(salts)))
    sums = rows.groupBy(key, "salt").agg(F.count("*").alias("of_salt"))
    lower = Window.partitionBy(key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "salt", F.coalesce(F.sum("of_salt").over(lower), F.lit(0)).alias("lower"))
    if len(counts) * salts <= 300_000:  # 32 bytes a row
        sums = F.broadcast(sums)
    own = F.row_number().over(Window.partitionBy(key, "salt").orderBy(*ties)) - 1
    return rows.withColumn("own", own).join(sums, [key, "salt"]).withColumn("rank", F.col("own") + F.col("lower")).drop("salt", "own", "lower")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """docs (doc_id, text, ...) -> PIECES, sequence_id long, offset long: one row for each piece.

    A null or empty text is the single id `end_id`. Repeated rows are packed as often as they occur. A null doc_id
    stays null. An empty table gives no rows. Columns other than doc_id and text are ignored. A sequence's pieces
    lie gapless from offset 0."""
    spark = docs.sparkSession
    pieces = materialise(tokenized_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(best_fit_plan(counts, capacity), RUNS)
    ranked = ranked_within(pieces, "length", ["doc_id", "piece", "ids_crc32"], counts)
    step = F.col("rank") - F.col("first_rank")
    return (
        ranked.join(F.broadcast(plan), "length")  # its rows are bounded: see best_fit_plan
        .where((step >= 0) & (step < F.col("n")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("first_sequence") + F.floor(step / F.col("per_sequence"))).cast("long").alias("sequence_id"),
            (F.col("at") + step % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
        )
    )
