from collections import Counter
from datetime import date

import pytest
import public_tokenizers
import sentencepiece

from pyspark.sql import functions as F

from logspark.llm import queries
from logspark.llm.mixing import mix_sources, mixed_rows, shard_quotas
from logspark.llm.quality_rules import BASE, keep_good_rows, quality_verdicts
from logspark.llm.token_counts import token_counts
from logspark.llm.url_filters import filter_urls

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("common", [100_000, 5])
def test_token_counts(odd_docs, odd_rows, no_docs, common):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts(odd_docs, MODEL, common=common).collect()
    n = [(r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in odd_rows]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((*x, x[2] > 4096) for x in n)
    assert token_counts(no_docs, MODEL).collect() == []


def base(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    found = Counter(zip(words, words[1:], words[2:]))
    hit = {k + d for k, w in enumerate(zip(words, words[1:], words[2:])) if found[w] > 1 for d in range(3)}
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_quality(odd_docs, odd_rows, no_docs):
    got = quality_verdicts(odd_docs).collect()
    want = [(r[0], *base(r[1]), base(r[1])[0] < 50 or 100 * base(r[1])[4] > 50 * base(r[1])[0]) for r in odd_rows]
    assert Counter((r.doc_id, *[r[b] for b in BASE], r.base_failed) for r in got) == Counter(want)
    assert all(not (r.kept and r.base_failed) for r in got) and any(r.kept for r in got)
    kept = keep_good_rows(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality_verdicts(no_docs).collect() == keep_good_rows(no_docs).collect() == []


def test_quality_follows_language_and_source(spark):
    clean = [(i, " ".join(f"w{i}n{k}" for k in range(60)), "en", "a") for i in range(300)]
    long = [(1000 + i, " ".join(f"{'v' * 30}{i}n{k}" for k in range(60)), "en", "b") for i in range(300)]
    odd = [(5000, long[0][1] + " z", "en", "a"), (5001, clean[0][1] + " z", "en", "b"), (5002, long[1][1], "xx", None), (5003, " ".join(f"w{k} | #" for k in range(60)), "en", "a")]
    got = {r.doc_id: r.kept for r in quality_verdicts(spark.createDataFrame(clean + long + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[r[0]] for r in clean + long) and not any(got[k] for k in (5000, 5001, 5003)) and got[5002]


def test_quality_of_groups_of_any_size(spark):
    """A source's own documents weigh the more the more there are; nothing jumps from 199 to 200 of them."""
    from logspark.llm.quality_rules import fences, sketches

    def rows(source, n, length):
        return [("en", source, 300, 300 * length, 0, 0, 0, 10)] * n

    schema = "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    most = []
    for n in (1, 199, 200, 201, 5000):
        measured = spark.createDataFrame(rows("big", 1000, 5) + rows("big", 1000, 6) + rows("own", n, 9), schema)
        most.append(next(r.mean_length_most for r in fences(sketches(measured)).collect() if r.source == "own"))
    assert most[0] < 1000 and most[-1] < 1000 and abs(most[1] - most[2]) < 100 and abs(most[2] - most[3]) < 100
    lone = spark.createDataFrame(rows(None, 1, 5), schema)
    assert [r.mean_length_least <= 500 <= r.mean_length_most for r in fences(sketches(lone)).collect()] == [True]


def targets(sizes):
    """The resharing, step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, capped, left = dict.fromkeys(names, 0.0), set(), 1.5 * sum(sizes.values())
    while left > 1e-9 and len(capped) < len(names):
        open_ = [s for s in names if s not in capped]
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += left * w[s] / total
        left = 0.0
        for s in open_:
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                capped.add(s)
    return target


def test_mixing(odd_docs, odd_rows, no_docs):
    rows = mix_sources(odd_docs).collect()
    again = mix_sources(odd_docs.repartition(5)).collect()
    key = lambda r: (r.doc_id, r.size, r.taken, tuple(r.shards))
    assert Counter(map(key, rows)) == Counter(map(key, again)) and len(rows) == len(odd_rows)
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    want = targets(sizes)
    got = {r.source_size: r.target for r in rows}
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size] += r.taken
    for s in sizes:
        assert abs(got[sizes[s]] - want[s]) < 1e-6 and abs(taken[sizes[s]] - want[s]) <= 1
    assert mix_sources(no_docs).collect() == []


def test_shard_quotas(spark):
    """Each shard's share of all blocks is the same, and of each source as a draw without replacement gives it."""
    counts = {"a": 600, "b": 90, "c": 1}
    table = spark.createDataFrame(list(counts.items()), "key string, n long")
    seen = []
    for seed in "xyz":
        quotas = {(r.shard, r.key): r.n for r in shard_quotas(table, 8, seed).collect()}
        for k, n in counts.items():
            assert sum(v for (_, key), v in quotas.items() if key == k) == n
        assert {sum(quotas.get((s, k), 0) for k in counts) for s in range(8)} <= {86, 87}
        assert all(2 <= quotas[s, "b"] <= 24 for s in range(8))  # 11 on average, with a spread of about 3
        seen.append(tuple(quotas.get((s, "b"), 0) for s in range(8)))
    assert len(set(seen)) == 3 and shard_quotas(table.limit(0), 8, "x").collect() == []


def test_mix_takes_what_the_shards_draw(spark):
    """Rows of one block go to the same shards; the shards' blocks are their quotas."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "s" if i % 3 else None) for i in range(3000)], "doc_id long, text string, source string")
    rows = mix_sources(docs, blocks=64, shards=4).withColumn("block", F.expr("conv(substring(md5(concat('mix|', doc_id)), 1, 15), 16, 10) DIV shiftleft(1L, 54)")).collect()
    whole = {}
    for r in rows:
        if r.taken % r.size == 0:
            whole.setdefault((r.source_size, r.block), set()).add(tuple(r.shards))
    assert sum(len(v) > 1 for v in whole.values()) <= 2  # the block of each source that the quota cuts
    drawn = Counter(s for v in whole.values() for s in max(v, key=len))
    assert set(drawn) == {0, 1, 2, 3} and max(drawn.values()) - min(drawn.values()) <= 3
    assert all(len(r.shards) == -(-r.taken // r.size) for r in rows)


def test_mixed_rows(odd_docs, no_docs, spark):
    out = mixed_rows(odd_docs)
    assert out.columns == odd_docs.columns
    n = Counter(r.doc_id for r in out.collect())
    for r in mix_sources(odd_docs.where("doc_id <> 7")).collect():
        assert abs(n[r.doc_id] * r.size - r.taken) <= max(r.size, 1) or r.doc_id == 7 or r.size == 0
    assert mixed_rows(no_docs).collect() == []
    docs = spark.createDataFrame([(i, "w w", "s") for i in range(400)], "doc_id long, text string, source string")
    shard = {r.doc_id: list(r.shards) for r in mix_sources(docs, shards=4).collect()}
    parts = mixed_rows(docs, shards=4).withColumn("part", F.spark_partition_id()).collect()
    for part in {r.part for r in parts}:
        own = [r.doc_id for r in parts if r.part == part]
        assert own != sorted(own) and len(own) >= 50
    assert Counter(r.doc_id for r in parts) == Counter({i: len(s) for i, s in shard.items() if s})


def test_url_filters(spark):
    entries = [("A.org.", date(2024, 1, 5), True), ("a.org", date(2024, 1, 9), False), ("a.org", date(2024, 1, 9), True), ("b.com", date(2024, 1, 1), True), ("x.b.com/p", date(2024, 1, 3), True), (None, date(2024, 1, 1), True), ("", date(2024, 1, 1), True), ("c.net", None, True)]
    entries += [("m.co.uk", date(2024, 1, 1), True), ("3.4", date(2024, 1, 1), True), ("1.2.3.4", date(2024, 1, 6), True), ("uk", date(2024, 1, 1), True)]
    list_ = spark.createDataFrame(entries, "pattern string, day date, active boolean")
    rows = [("http://A.org/x", 4), ("https://u@a.org:80", 5), ("http://a.org?q", 8), ("http://a.org", 9), ("http://x.b.com/p/q", 2), ("http://x.b.com/p?z", 3), ("ftp://b.com/p", 2), (None, 5), ("nonsense", 5), ("http://", 5), ("http://c.net", 5), ("http://a.org", None), ("http://a.org", None)]
    rows += [("http://w.x.M.co.uk./", 5), ("http://other.co.uk", 5), ("http://1.2.3.4/", 5), ("http://1.2.3.4:8/", 6), ("http://[::1]:80/x", 6), ("http://uk/", 6), ("http://y.z.b.com", 2)]
    df = spark.createDataFrame([(u, d and date(2024, 1, d), "h", "i") for u, d in rows], "url string, fetched date, __x string, host string")
    for small in (100_000, 0):
        out = filter_urls(df, list_, small)
        got = Counter((r.url, r.fetched and r.fetched.day, r.by_host, r.by_domain, r.by_place) for r in out.collect())
        on = {("https://u@a.org:80", 5): (1, 1, 0), ("http://a.org?q", 8): (1, 1, 0), ("http://x.b.com/p/q", 2): (0, 1, 0), ("http://x.b.com/p?z", 3): (0, 1, 1), ("ftp://b.com/p", 2): (1, 1, 0)}
        on |= {("http://w.x.M.co.uk./", 5): (0, 1, 0), ("http://1.2.3.4:8/", 6): (1, 0, 0), ("http://uk/", 6): (1, 0, 0), ("http://y.z.b.com", 2): (0, 1, 0)}
        assert got == Counter((u, d, *map(bool, on.get((u, d), (0, 0, 0)))) for u, d in rows)
        assert {r.host for r in out.collect()} >= {"a.org", "w.x.m.co.uk", "[::1]", "1.2.3.4", ""}
    assert filter_urls(df.limit(0), list_.limit(0)).collect() == []


def test_queries_and_sql():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)
