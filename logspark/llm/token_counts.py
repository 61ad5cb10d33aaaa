"""Token counts of documents without materialising ids.

A text is cut into pre-tokens at places that no piece of the vocabulary can span. The pieces of each distinct
pre-token are counted once, the counts are joined to the documents' pre-token frequencies, and summed."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

FREQUENCIES = "doc_id long, n_bytes long, known long, rest array<string>, times array<int>"

#: The model writes a space as U+2581, and both are the same to it.
_SPACE = "▁"
_PRE_TOKEN = re.compile(r"\n| *[^ \n]+| +")

_models: dict[str, object] = {}


def _model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (_models[path].id_to_piece(i) for i in range(_models[path].get_piece_size()))
        if any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces):
            raise ValueError("pieces of this vocabulary span spaces or line ends: its texts can't be cut there")
    return _models[path]


def pre_tokens(text: str) -> Counter:
    """Frequencies of the pre-tokens of a text: a line end, or spaces and what follows them up to the next of either.

    The model puts a space before a text, and so does this."""
    if not text:
        return Counter()
    text = " " + text.replace(_SPACE, " ")
    if "\n" not in text and "  " not in text and text[-1] != " ":
        return Counter([" " + w for w in text[1:].split(" ")])
    return Counter(_PRE_TOKEN.findall(text))


def piece_counts(pre: list[str], path: str) -> list[int]:
    """How many pieces each pre-token has. One that starts with a space gets that from the model; before others
    a line end keeps the model's own space apart, and the two pieces of those are taken off."""
    starts = [p[0] == " " for p in pre]
    found = _model(path).encode([p[1:] if s else "\n" + p for p, s in zip(pre, starts)], num_threads=1)
    alone = [int(p == " ") for p in pre]  # nothing is left to encode, but a space is a piece
    return [a or len(f) - 2 * (not s) for f, s, a in zip(found, starts, alone)]


def common_pre_tokens(docs: DataFrame, path: str, most: int, sample: int) -> dict[str, int]:
    """Piece counts of up to `most` pre-tokens that are frequent in about `sample` documents.

    Only where a pre-token's count is looked up depends on this, never a result."""
    rows = docs.count()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                total.update(pre_tokens(text or ""))
        best = total.most_common(most)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["pre", "n"])

    part = docs.select("text").sample(min(1.0, sample / max(rows, 1)), seed=7)
    found = part.mapInArrow(count, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    best = [r["pre"] for r in found.orderBy(F.desc("n"), "pre").limit(most).collect()]
    return dict(zip(best, piece_counts(best, path)))


def token_counts(
    docs: DataFrame, model_path: str, limit: int = 4096, common: int = 200_000, sample: int = 20_000
) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id long, n_bytes long, n_tokens long, over_limit boolean, a row for each row.

    A null text counts as empty and has no tokens; repeated rows each give a row; a null doc_id stays null; other
    columns are ignored; an empty table gives no rows. At most `common` pre-tokens (some 30 bytes each) are
    broadcast: those that many documents share, so that no pre-token gathers a large part of the rows in the join."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(common_pre_tokens(docs, model_path, common, sample))

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in slices(batches):
            size, known, rest, times = [], [], [], []
            for text in batch.column("text").to_pylist():
                total, own, n = 0, [], []
                for pre, k in pre_tokens(text or "").items():
                    if (p := pieces.get(pre)) is None:
                        own.append(pre)
                        n.append(k)
                    else:
                        total += p * k
                size.append(len((text or "").encode()))
                known.append(total)
                rest.append(own)
                times.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(rest, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
                ["doc_id", "n_bytes", "known", "rest", "times"],
            )

    # Once written, a row keeps its number, whichever task reads it.
    rows = materialise(docs.mapInArrow(frequencies, FREQUENCIES).withColumn("row", F.monotonically_increasing_id()), "frequencies")

    @F.pandas_udf("long")
    def n_pieces(pre: pd.Series) -> pd.Series:
        return pd.Series(piece_counts(pre.tolist(), model_path), dtype="int64")

    rest = rows.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("pre"), F.col("x.times").alias("times"))
    counted = rest.select("pre").distinct().withColumn("pieces", n_pieces("pre"))
    sums = rest.join(counted, "pre").groupBy("row").agg(F.sum(F.col("pieces") * F.col("times")).alias("joined"))
    n = F.col("known") + F.coalesce(F.col("joined"), F.lit(0))
    return rows.select("doc_id", "n_bytes", "known", "row").join(sums, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
