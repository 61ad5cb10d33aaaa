"""Quality rules whose thresholds adapt to each language and source.

Every document is measured. Mergeable quantile sketches of the measures (counts in buckets of 1/32 relative width)
are built for each language and source. Each is merged with what its language's sketch, which is merged with that of
all, would have for `prior` documents: a source's own documents count the more, the more there are. The merged sketches
give the fences that documents are held against by a join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, text_bytes

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\x0b\x0c\r"

def _sure(count: str, together: int = 1) -> str:
    """What of a count is beyond its own chance: three times the standard deviation of the count of a rare event that
    comes `together` at a time. A few symbols, a repeated line or a phrase that comes twice say nothing about a text,
    however short it is."""
    return f"greatest({count} - CAST(floor(3 * sqrt({together} * {count})) AS BIGINT), 0)"


#: Measures as whole numbers: what is sketched, and what of a document is held against the fences.
MEASURES: dict[str, tuple[str, str]] = {
    "mean_length": ("100 * word_chars DIV n_words", "100 * word_chars DIV n_words"),
    "symbols": ("1000 * n_symbols DIV n_words", f"1000 * {_sure('n_symbols')} DIV n_words"),
    "dup_lines": ("1000 * n_dup_lines DIV n_lines", f"1000 * {_sure('n_dup_lines')} DIV n_lines"),
    "repeats": ("1000 * n_repeat_words DIV n_words", f"1000 * {_sure('n_repeat_words', 6)} DIV n_words"),  # two windows of three words
}
#: How many spreads a fence lies beyond the quartiles.
RANGES = 3
#: Quantiles in percent: the quartiles, and a pair further out with what part of it a normal distribution's
#: interquartile range is, in percent. The larger of the two is the spread: where most values are the same, the outer
#: ones still tell how far values go.
QUANTILES = (10, 25, 75, 90)
OUTER = ((10, 90, 53),)
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """How many words lie in a window that occurs more than once."""
    if len(words) <= window:
        return 0
    ids: dict[bytes, int] = {}
    own = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    key = own[: len(own) - window + 1]
    for k in range(1, window):
        key = np.unique(key * len(ids) + own[k : k + len(key)], return_inverse=True)[1]
    found = np.bincount(key)[key] > 1
    cover = np.zeros(len(own), bool)
    for k in range(window):
        cover[k : k + len(found)] |= found
    return int(cover.sum())


def _measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(_WHITE)]
    solid = b"".join(words)
    return len(words), len(solid.decode("utf-8", "replace")), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


_COUNTS = (*BASE, "n_lines")


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in _COUNTS]))
def _base(text: pa.Array) -> pa.Array:
    rows = np.array([_measure(t) for t in text_bytes(text)], np.int64).reshape(-1, len(_COUNTS))
    return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], list(_COUNTS))


def base_measures(text: Column) -> Column:
    """Struct of the base counts and n_lines, the lines with a word; a null text has none. Marked so that it runs once
    for each row."""
    return _base.asNondeterministic()(text.cast("string"))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source and the base counts -> lang, source, measure, low, high, n: bucket counts, which merge by adding."""
    value = [F.struct(F.lit(k).alias("measure"), F.expr(e).alias("x")) for k, (e, _) in MEASURES.items()]
    rows = measured.where(f"NOT ({BASE_FAILED})").select("lang", "source", F.explode(F.array(*value)).alias("v")).select("lang", "source", "v.*")
    width = F.expr("shiftleft(1L, greatest(0, length(bin(x)) - 6))")
    return rows.withColumn("low", F.col("x") - F.col("x") % width).withColumn("high", F.col("low") + width - 1).groupBy("lang", "source", "measure", "low", "high").agg(F.count("*").alias("n"))


def merged_sketches(sketch: DataFrame, prior: int) -> DataFrame:
    """sketches -> lang, source, measure, low, high, weight (ten-thousandths of a document): each group's sketch with
    the prior of its language's, whose own prior is that of all. Rows are groups times buckets."""
    of_all = sketch.groupBy("measure", "low", "high").agg(F.sum("n").alias("n"))
    of_all = of_all.withColumn("all", F.expr("sum(n) OVER (PARTITION BY measure)")).selectExpr("measure", "low", "high", f"10000 * {prior} * n DIV all AS weight")
    of_lang = sketch.groupBy("lang", "measure", "low", "high").agg((F.sum("n") * 10000).alias("weight"))
    totals = sketch.groupBy("lang", "measure").agg(F.sum("n").alias("of_lang"))
    of_lang = of_lang.unionByName(totals.join(of_all, "measure").select("lang", "measure", "low", "high", "weight"))
    of_lang = of_lang.groupBy("lang", "measure", "low", "high").agg(F.sum("weight").alias("weight"))
    same = lambda a, b, c: a[c].eqNullSafe(b[c])
    of_lang = of_lang.join(totals, same(of_lang, totals, "lang") & (of_lang["measure"] == totals["measure"])).select(
        of_lang["lang"].alias("of"), of_lang["measure"].alias("what"), "low", "high", F.expr(f"{prior} * weight DIV (of_lang + {prior})").alias("weight")
    )
    groups = sketch.select("lang", "source", "measure").distinct()
    priors = groups.join(of_lang, groups["lang"].eqNullSafe(F.col("of")) & (F.col("measure") == F.col("what"))).select("lang", "source", "measure", "low", "high", "weight")
    own = sketch.select("lang", "source", "measure", "low", "high", (F.col("n") * 10000).alias("weight"))
    return own.unionByName(priors).groupBy("lang", "source", "measure", "low", "high").agg(F.sum("weight").alias("weight"))


def fences(sketch: DataFrame, prior: int = 30) -> DataFrame:
    """sketches -> lang, source, <measure>_least, <measure>_most: a row for each language and source."""
    by = "PARTITION BY lang, source, measure"
    ranked = merged_sketches(sketch, prior).withColumns({"upto": F.expr(f"sum(weight) OVER ({by} ORDER BY low)"), "all": F.expr(f"sum(weight) OVER ({by})")})
    end = {q: "high" if q > 50 else "low" for q in QUANTILES}
    q = ranked.groupBy("lang", "source", "measure").agg(*[F.min(F.when(F.col("upto") * 100 >= F.col("all") * k, F.col(end[k]))).alias(f"q{k}") for k in QUANTILES])
    spread = f"greatest(q75 - q25, {', '.join(f'(q{b} - q{a}) * {part} DIV 100' for a, b, part in OUTER)})"
    bounds = []
    for name in MEASURES:
        here = F.col("measure") == name
        bounds += [F.max(F.when(here, F.expr(f"q25 - {RANGES} * {spread}"))).alias(f"{name}_least"), F.max(F.when(here, F.expr(f"q75 + {RANGES} * {spread}"))).alias(f"{name}_most")]
    return q.groupBy("lang", "source").agg(*bounds)


def _kept(limits: DataFrame) -> tuple[DataFrame, Column]:
    """The fences as a table of of_lang, of_source and columns that no measure has, and the verdict. It has a row for
    each language and source and is broadcast up to 10,000 rows."""
    limits = materialise(limits.withColumnsRenamed({"lang": "of_lang", "source": "of_source"}), "fences")
    inside = " AND ".join(f"{e} BETWEEN {k}_least AND {k}_most" for k, (_, e) in MEASURES.items())
    kept = F.expr(f"NOT ({BASE_FAILED}) AND coalesce(CASE WHEN NOT ({BASE_FAILED}) THEN {inside} END, false)")
    return (F.broadcast(limits) if limits.count() <= 10_000 else limits), kept


def _of_group() -> Column:
    return F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))


def quality_verdicts(docs: DataFrame, prior: int = 30) -> DataFrame:
    """docs (doc_id, text, lang, source, ...) -> doc_id, the base counts, base_failed, kept, n_lines; a row for each row.

    A null or empty text has no words and fails. Null languages and sources are groups of their own. Repeated rows
    count each. Other columns are ignored. An empty table gives no rows."""
    measured = docs.select("doc_id", "lang", "source", base_measures(F.col("text")).alias("m")).select("doc_id", "lang", "source", "m.*")
    measured = materialise(measured, "measures")
    limits, kept = _kept(fences(sketches(measured), prior))
    return measured.join(limits, _of_group(), "left").select("doc_id", *BASE, F.expr(BASE_FAILED).alias("base_failed"), kept.alias("kept"), "n_lines")


def keep_good_rows(docs: DataFrame, prior: int = 30) -> DataFrame:
    """The rows of docs that quality_verdicts keeps, with all their columns, which are carried as one so that no name
    clashes. Texts are measured again and not shuffled. An empty table gives no rows."""
    m = base_measures(F.col("text")).alias("m")
    limits, kept = _kept(fences(sketches(materialise(docs.select("lang", "source", m).select("lang", "source", "m.*"), "measures")), prior))
    whole = docs.select(F.struct(*docs.columns).alias("row"), "lang", "source", m).select("row", "lang", "source", "m.*")
    return whole.join(limits, _of_group(), "left").where(kept).select("row.*")
