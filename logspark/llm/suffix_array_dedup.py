"""Substring dedup over bytes with suffix arrays.

Runs of windows around anchors (see repeats) are compared whole first: copies of one run are the same string. The
different runs at an anchor are dealt to shards by their anchor, and each shard's suffix array is made by induced
sorting: suffixes are classified, leftmost-smaller (LMS) substrings sorted by induction and named, the string of names
sorted in the same way, level by level, and the rest induced. Permuted common prefixes then show which windows are
equal. An anchor with very many different runs is split by the bytes around it, so that equal windows stay together."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, release, slices, text_bytes
from .repeats import Bytes, anchor_places, apply_removals, repeated_runs, run_keys, tag, with_text

#: Different runs in a group beyond which it is split by more of the bytes that its windows share.
GROUP = 2000
SHARD_BYTES = 1 << 20


def _by_symbol(c: np.ndarray) -> np.ndarray:
    """The stable order of symbols by counting: numpy's stable sort of 16-bit numbers is a radix sort."""
    if len(c) < 64 or c.dtype.itemsize <= 2:
        return np.argsort(c, kind="stable")
    order = np.argsort((c & 0xFFFF).astype(np.uint16), kind="stable")
    return order if c.max() < 1 << 16 else order[np.argsort((c[order] >> 16).astype(np.uint16), kind="stable")]


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix order that sorted LMS positions induce. Within a symbol's bucket whole arrays are moved at once;
    what falls into the bucket in hand is appended to it and handled next, as a scan would."""
    larger: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(sigma)]

    def deal(j: np.ndarray, to: list[list[np.ndarray]]) -> None:
        n = len(j)
        if n == 1:
            to[s[j[0]]].append(j)
        elif n:
            c = s[j]
            order = _by_symbol(c)
            j, c = j[order], c[order]
            cut = np.flatnonzero(c[1:] != c[:-1]) + 1
            a = 0
            for b in [*cut.tolist(), n]:
                to[c[a]].append(j[a:b])
                a = b

    def scan(own: list[np.ndarray], of_kind: np.ndarray, to: list[list[np.ndarray]]) -> None:
        """Hands on all arrays of a bucket, and then what that has added to it, until nothing is added."""
        done = 0
        while done < len(own):
            now = own[done] if done + 1 == len(own) else np.concatenate(own[done:])
            done = len(own)
            j = now - 1  # before the first position comes the last, the end mark, which is of neither kind here
            deal(j[of_kind[j]], to)

    large, before = ~small, small.copy()
    large[-1] = before[-1] = False
    by_symbol: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    deal(lms, by_symbol)
    for c in range(sigma):
        if larger[c]:
            scan(larger[c], large, larger)
        if by_symbol[c]:
            scan(by_symbol[c], large, larger)
    smaller[s[-1]].append(np.array([len(s) - 1], np.int32))
    for c in range(sigma - 1, -1, -1):
        if smaller[c]:
            scan(smaller[c], before, smaller)
        if larger[c]:
            scan([x[::-1] for x in reversed(larger[c])], before, smaller)
    parts = []
    for c in range(sigma):
        parts += larger[c]
        parts += [x[::-1] for x in reversed(smaller[c])]
    return np.concatenate(parts)


def _induced_ranks(s: np.ndarray, small: np.ndarray, lms: np.ndarray, of_lms: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes (how many are smaller) that ranks of the LMS suffixes induce, for alphabets too large for
    a bucket each: all larger suffixes are ranked by symbol and what follows, from the LMS positions backwards, and then
    all smaller ones. Rounds go one position further from there, and have only what is still the same as another."""
    n = len(s)
    kind = s.astype(np.int64) * 2 + small
    given = np.full(n, -1)
    given[lms] = of_lms

    def settle(own: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        rank, follows = np.zeros(n, np.int64), np.zeros(n, bool)
        follows[own] = fixed[own] < 0
        away = np.minimum.accumulate(np.where(follows, n, np.arange(n))[::-1])[::-1] - np.arange(n)
        base, minor, k = kind[own], np.maximum(fixed[own], 0), 0
        start = None
        while len(own):
            order = _by_symbol(minor)
            order = order[_by_symbol(base[order])]
            own, base, minor = own[order], base[order], minor[order]
            other = base[1:] != base[:-1]
            new = np.concatenate(([True], other | (minor[1:] != minor[:-1])))
            at = np.arange(len(own))
            first = np.maximum.accumulate(np.where(new, at, 0))
            if k:
                first += start[order] - np.maximum.accumulate(np.where(np.concatenate(([True], other)), at, 0))
            rank[own] = first
            k += 1
            heads = np.flatnonzero(new)
            sizes = np.diff(np.append(heads, len(own)))
            stay = np.repeat((sizes > 1) & (np.maximum.reduceat(away[own], heads) >= k), sizes)
            own, base = own[stay], first[stay]
            start, minor = base, rank[np.minimum(own + 1, n - 1)]
        return rank

    larger = settle(np.flatnonzero(~small | (given >= 0)), given)
    fixed = np.where(small, -1, larger)
    fixed[-1] = 0
    return settle(np.arange(n), fixed)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of s in the order of their suffixes. s ends in its only 0."""
    sigma = int(s.max()) + 1
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int32)))
    following = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    small = np.append(step[np.minimum(following, n - 2)] > 0, True) if n > 1 else np.array([True])
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    wide = sigma > 1 << 10
    if wide:
        name = _induced_ranks(s, small, lms, np.zeros(len(lms), np.int64))[lms]
        name = np.unique(name, return_inverse=True)[1]
    else:
        order = _induce(s, small, lms, sigma)
        if not len(lms):
            return order
        name = _names(s, lms, order)
    order = np.argsort(name, kind="stable") if len(name) == name.max() + 1 else suffix_array(name.astype(np.int32))
    if not wide:
        return _induce(s, small, lms[order], sigma)
    of_lms = np.empty(len(lms), np.int64)
    of_lms[order] = np.arange(len(lms))
    ranks = _induced_ranks(s, small, lms, of_lms)
    out = np.empty(n, np.int64)
    out[ranks] = np.arange(n)
    return out


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers of the LMS substrings in their order, equal ones the same, from an order of all suffixes by them."""
    n = len(s)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    after = np.zeros(n, np.int64)
    after[lms] = np.append(lms[1:], n - 1)
    x, y = order[:-1], order[1:]
    size = after[x] - x
    same = size == after[y] - y
    at, j = np.flatnonzero(same), 0
    while len(at):
        equal = s[x[at] + j] == s[y[at] + j]
        same[at[~equal]] = False
        at = at[equal & (size[at] > j)]
        j += 1
    name = np.zeros(n, np.int64)
    name[order] = np.concatenate(([0], np.cumsum(~same)))
    return name[lms]


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, begins: np.ndarray, most: int) -> np.ndarray:
    """For each position, how far (up to `most` or a little over) its suffix agrees with the one before it in order.

    Only the first position of each string, and those whose neighbour isn't that of the position before, moved by
    one, are compared; from there on the value falls by one a position. `most` is the longest string or over."""
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    moved = np.zeros(n, bool)
    moved[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (text[: n - 1] == text[before[:-1]])
    moved[begins] = False
    first = np.flatnonzero(~moved)
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)])
    eight = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(padded) - 8, 8), (1, 1))).view("<u8").ravel()
    found = np.zeros(n, np.int64)
    at, j = first[before[first] >= 0], 0
    while len(at) and j <= most:
        differ = eight[at + j] ^ eight[before[at] + j] if j + max(at.max(), before[at].max()) < len(eight) else None
        if differ is None:
            inside = np.maximum(at, before[at]) + j < len(eight)
            at = at[inside]
            continue
        stop = differ != 0
        low = differ[stop] & (~differ[stop] + np.uint64(1))
        found[at[stop]] = j + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        at = at[~stop]
        found[at] = j + 8
        j += 8
    source = np.maximum.accumulate(np.where(moved, 0, np.arange(n)))
    return np.maximum(found[source] - (np.arange(n) - source), 0)


def shard_windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows that equal another of the shard: class, text and offset of each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    begins = np.cumsum(np.concatenate(([0], sizes[:-1] + 1)))
    s = raw.astype(np.int16) + 2
    s[begins[1:] - 1] = 1
    s[-1] = 0
    used = np.zeros(258, bool)
    used[s] = True
    s = (np.cumsum(used) - 1).astype(np.int16)[s]
    order = suffix_array(s)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    left = begins[owner] + sizes[owner] - np.arange(len(raw))
    common = permuted_common_prefixes(raw, order, begins, int(sizes.max()))
    before = np.full(len(order), -1, np.int64)
    before[order[1:]] = order[:-1]
    common = np.where(before < 0, 0, np.minimum(common, np.minimum(left, left[before])))
    equal = (common >= length)[order]
    cls = np.cumsum(~equal)
    member = equal | np.append(equal[1:], False)
    at = order[member]
    return cls[member], owner[at], at - begins[owner[at]]


RUNS = "group long, least int, most int, lead int, id long, at long, bytes binary"


def _run_texts(docs: DataFrame, keys: DataFrame, unit: Bytes) -> DataFrame:
    """RUNS: the bytes of the first run of each key at an anchor that has several. `lead` is how many bytes the run's
    first window begins before the anchor; from `least` to `most` bytes are those that the group's windows may have."""
    listed = keys.where("keys > 1").select("first.id", F.struct("first.at", "anchor").alias("item"))
    listed = listed.groupBy("id").agg(F.collect_list("item").alias("items"))  # as many as the document's own runs
    most = unit.length - unit.k

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            rows = []
            for i, text, items in zip(batch.column("id").to_pylist(), text_bytes(batch.column("text")), batch.column("items").to_pylist()):
                mark = tag(text)
                for x in items:
                    if x["at"] & 0xFFFFFF == mark:
                        start, more = x["at"] >> 32, x["at"] >> 24 & 0xFF
                        rows.append((x["anchor"], more, i, x["at"], text[start : start + more + unit.length]))
            anchor, more, ids, ats, own = list(zip(*rows)) or [[]] * 5
            lead = anchor_places(list(own), more, unit)
            n = len(rows)
            columns = [pa.array(anchor, pa.int64()), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, most, np.int32)), pa.array(lead, pa.int32()), pa.array(ids, pa.int64()), pa.array(ats, pa.int64()), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["group", "least", "most", "lead", "id", "at", "bytes"])

    return with_text(docs, listed).where("items IS NOT NULL").select("id", "text", "items").mapInArrow(of, RUNS)


def _halves(runs: DataFrame, length: int) -> DataFrame:
    """RUNS in two: windows that begin far before the anchor, and near. Those of one half all hold more of the bytes
    around the anchor, and those bytes name the new group: equal windows come into the same one."""
    middle = F.floor((F.col("least") + F.col("most")) / 2).cast("int")
    half = F.explode(F.array(F.struct(F.col("least").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("most").alias("b"))))
    rows = runs.where("least < most").withColumn("half", half).selectExpr("half.a", "half.b", "lead", "id", "at", "bytes", "shiftright(at, 24) & 255 AS more")
    rows = rows.withColumns({"low": F.greatest("a", F.col("lead") - F.col("more")), "high": F.least("b", "lead")}).where("low <= high")
    return rows.selectExpr(
        f"xxhash64(a, b, substring(bytes, CAST(lead - a + 1 AS INT), {length} + a - b)) AS group", "a AS least", "b AS most", "CAST(high AS INT) AS lead", "id",
        "shiftleft(shiftright(at, 32) + lead - high, 32) + shiftleft(CAST(high - low AS BIGINT), 24) + (at & 16777215) AS at",
        f"substring(bytes, CAST(lead - high + 1 AS INT), CAST({length} + high - low AS INT)) AS bytes",
    )


def _split(runs: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """RUNS of groups of any size -> RUNS of groups of up to GROUP different ones, and id, at of runs that equal an
    earlier one. Windows are halved up to single ones, of which a group has but one; each step has only the runs of
    groups that are too large."""
    whole, equal = [], []
    while not runs.isEmpty():
        parts = materialise(_halves(runs, length).selectExpr("*", "xxhash64(bytes) AS t1", "xxhash64(1, bytes) AS t2"), "halved-runs")
        first = parts.groupBy("group", "t1", "t2").agg(F.min(F.struct("id", "at")).alias("first"))
        rows = parts.join(first, ["group", "t1", "t2"]).withColumn("copy", F.expr("struct(id, at) > first"))
        kept = rows.where("NOT copy").select(*runs.columns)
        sizes = materialise(first.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "group-sizes")
        equal.append(rows.where("copy").select("id", "at"))
        whole.append(kept.join(sizes.where(F.col("n") <= GROUP), "group").select(*runs.columns))
        runs = materialise(kept.join(sizes.where(F.col("n") > GROUP), "group").select(*runs.columns), "large-groups")
    return whole, equal


def _shard_results(texts: DataFrame, length: int) -> DataFrame:
    """RUNS sorted by group -> id long, at long: windows that equal an earlier one of their group."""

    def solve(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        ids, ats, own = (list(c) for c in zip(*rows))
        ids, ats = np.array(ids, np.int64), np.array(ats, np.int64)
        cls, text, offset = shard_windows(own, length)
        start = (ats[text] >> 32) + offset
        order = np.lexsort((start, ids[text], cls))
        cls, text, offset, start = cls[order], text[order], offset[order], start[order]
        opens = np.ones(len(cls), bool)
        opens[1:] = cls[1:] != cls[:-1]
        head = np.maximum.accumulate(np.where(opens, np.arange(len(cls)), 0))
        later = (ids[text] != ids[text[head]]) | (start != start[head])  # a repeated row's windows are the same ones
        gone = np.lexsort((offset[later], text[later]))
        text, offset, start = text[later][gone], offset[later][gone], start[later][gone]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (offset[1:] != offset[:-1] + 1)
        first = np.flatnonzero(new)
        more = np.diff(np.append(first, len(text))) - 1
        at = start[first] << 32 | more << 24 | ats[text[first]] & 0xFFFFFF
        return pa.RecordBatch.from_arrays([pa.array(ids[text[first]]), pa.array(at)], ["id", "at"])

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, group = [], 0, None
        for batch in batches:
            for own, i, at, text in zip(*[batch.column(c).to_pylist() for c in ("group", "id", "at", "bytes")]):
                if own != group:
                    if size > SHARD_BYTES:
                        yield solve(rows)
                        rows, size = [], 0
                    group = own
                rows.append((i, at, text))
                size += len(text) + 1
        if rows:
            yield solve(rows)

    return texts.select("group", "id", "at", "bytes").mapInArrow(of, "id long, at long")


def repeated_byte_spans(docs: DataFrame, length: int = 100, k: int = 24) -> DataFrame:
    """docs (doc_id, text, ...) -> id long, at long: runs of windows (see repeats.pack) whose bytes also start earlier."""
    spark, unit = docs.sparkSession, Bytes(length, k)
    runs = repeated_runs(docs, unit)
    keys = run_keys(runs)
    release(spark)
    whole = runs.join(keys.select("anchor", "around", "first"), ["anchor", "around"]).where("struct(id, at) > first").select("id", "at")
    texts = materialise(_run_texts(docs, keys, unit), "run-texts")
    release(spark)
    large = keys.select(F.col("anchor").alias("group"), "keys").where(F.col("keys") > GROUP).distinct()
    split, equal = _split(texts.join(large, "group", "left_semi"), length)
    shards = texts.join(large, "group", "left_anti")
    for part in split:
        shards = shards.unionByName(part)
    spans = whole.unionByName(_shard_results(shards.repartition("group").sortWithinPartitions("group"), length))
    for part in equal:
        spans = spans.unionByName(part)
    spans = materialise(spans, "byte-spans")
    discard(runs, keys, texts)
    release(spark)
    return spans


def remove_repeated_bytes(docs: DataFrame, length: int = 100, k: int = 24) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row for each row.

    Removes each byte covered by a string of `length` bytes that also starts earlier: in a document with a smaller
    doc_id, or in the same before. Strings are judged on the input and never cross documents. A null text is empty;
    shorter texts keep all. A null doc_id ranks after all others. Rows that repeat a doc_id with the same text are
    one document and each lose what it loses. Other columns are ignored; an empty table gives no rows."""
    spans = repeated_byte_spans(docs, length, k)
    return apply_removals(docs, spans, Bytes(length, k)).select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
