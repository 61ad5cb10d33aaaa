"""Substring dedup over words by compacting a sparse de Bruijn graph.

Token k-mers chosen by the smallest hash in each window are the nodes; a run of windows around one is an edge, named
by its words. A repeated node with one edge is a path without branches: all its windows repeat together, and one
comparison of documents by Spark joins decides them. Where a node has several edges, those edges' windows are read
back from the first document of each edge, all times it has it, and compared by 128 bits of the words themselves."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, slices, text_bytes
from .repeats import Words, apply_removals, pack, repeated_runs, run_keys, tag, with_text


def _branch_windows(docs: DataFrame, runs: DataFrame, keys: DataFrame, unit: Words) -> DataFrame:
    """The windows of all edges at branching nodes: w1 long, w2 long (128 bits of their words), id long, at long.

    An edge is read in its first document alone, but there each time that it occurs: what another edge of the node
    removes of it goes from all of them."""
    branching = keys.where("keys > 1").select("anchor", "around", F.col("first.id").alias("id"))
    listed = runs.join(branching, ["anchor", "around", "id"]).groupBy("id").agg(F.collect_list("at").alias("items"))
    length = unit.length

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w, ids, ats = [], [], []
            for i, text, items in zip(batch.column("id").to_pylist(), text_bytes(batch.column("text")), batch.column("items").to_pylist()):
                words, mark = text.split(), tag(text)
                for at in items:
                    if at & 0xFFFFFF == mark:
                        for s in range(at >> 32, (at >> 32) + (at >> 24 & 0xFF) + 1):
                            w.append(xxhash.xxh3_128_digest(b" ".join(words[s : s + length])))
                            ids.append(i)
                            ats.append(pack(s, 0, mark))
            halves = [[int.from_bytes(x[a : a + 8], "little", signed=True) for x in w] for a in (0, 8)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*halves, ids, ats)], ["w1", "w2", "id", "at"])

    rows = with_text(docs, listed).where("items IS NOT NULL").select("id", "text", "items")
    return rows.mapInArrow(of, "w1 long, w2 long, id long, at long")


def repeated_word_spans(docs: DataFrame, length: int = 50, k: int = 8) -> DataFrame:
    """docs (doc_id, text, ...) -> id long, at long: runs of windows (see repeats.pack) whose words also start a
    window in a document with a smaller doc_id."""
    spark, unit = docs.sparkSession, Words(length, k)
    runs = repeated_runs(docs, unit)
    keys = run_keys(runs)
    release(spark)
    compacted = runs.join(keys.select("anchor", "around", F.col("first.id").alias("first")), ["anchor", "around"]).where("id > first").select("id", "at")
    windows = materialise(_branch_windows(docs, runs, keys, unit), "branch-windows")
    release(spark)
    shared = materialise(windows.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last"), "shared-windows")
    single = windows.join(shared, ["w1", "w2"]).where("id > first").select("id", "at")
    spans = materialise(compacted.unionByName(single), "word-spans")
    release(spark)
    return spans


def remove_repeated_words(docs: DataFrame, length: int = 50, k: int = 8) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_removed, kept_sha256, n_spans, a row for each row.

    Removes each word covered by a window of `length` words whose sequence also starts in a document with a smaller
    doc_id; windows are judged on the input. Null and empty texts have no words; shorter texts keep all. Repeats
    within one doc_id, repeated rows among them, don't count. A null doc_id ranks after all others. Other columns
    are ignored; an empty table gives no rows."""
    spans = repeated_word_spans(docs, length, k)
    removed = apply_removals(docs, spans, Words(length, k))
    return removed.select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256", "n_spans")
