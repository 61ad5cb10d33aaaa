import random

import numpy as np
import pytest

from logspark.llm.substring_dedup import remove_repeated_words
from logspark.llm.suffix_array_dedup import GROUP, remove_repeated_bytes, shard_windows, suffix_array

from . import brute


def check(docs, rows, by_bytes, **how):
    f, name = (remove_repeated_bytes, "n_bytes") if by_bytes else (remove_repeated_words, "n_words")
    got = f(docs, **how).collect()
    want = brute.without_windows([r[:2] for r in rows], how.get("length", 100 if by_bytes else 50), by_bytes)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1] or "")
    assert len(got) == len(rows)
    assert sum(r.n_removed for r in got) > 0
    for r in got:
        assert (r[name], r.n_removed, r.n_spans, r.kept_sha256) in [want[brute.order(r.doc_id), t] for t in texts[r.doc_id]]


@pytest.mark.parametrize("by_bytes", [False, True])
def test_same_as_brute_force(odd_docs, odd_rows, by_bytes):
    rows = [r for r in odd_rows if len(r[1] or "") < 100_000]
    check(odd_docs.where("text is null or length(text) < 100000"), rows, by_bytes)


@pytest.mark.parametrize("by_bytes", [False, True])
def test_very_long_text(spark, by_bytes):
    rng = random.Random(2)
    long = " ".join(f"q{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, long), (2, "head " + long[10_000:20_000] + " tail")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, by_bytes)


@pytest.mark.parametrize("words", [60, 130])
def test_block_that_a_document_repeats(spark, words):
    """The second P A Q of a document is the same edge as its first; A is in an earlier document."""
    rng = random.Random(7)
    p, a, q = (" ".join(f"r{rng.randrange(10**6)}" for _ in range(n)) for n in (55, words, 55))
    rows = [(1, a), (2, " ".join([p, a, q, p, a, q])), (3, f"{q} {p}")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, False)


@pytest.mark.parametrize("by_bytes", [False, True])
def test_no_documents(no_docs, by_bytes):
    assert (remove_repeated_bytes if by_bytes else remove_repeated_words)(no_docs).collect() == []


def test_groups_that_are_split(spark, monkeypatch):
    """Many texts around one passage, some of them repeated rows or copies of one another's ends: one anchor with more
    different surroundings than a group takes."""
    monkeypatch.setattr("logspark.llm.suffix_array_dedup.GROUP", 3)
    assert GROUP > 3
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    passage, heads = " ".join(word() for _ in range(20)), [" ".join(word() for _ in range(8)) for _ in range(6)]
    for around in (lambda: " ".join(word() for _ in range(8)), lambda: rng.choice(heads)[: rng.randrange(20, 60)]):
        rows = [(i, f"{around()} {passage[: rng.randrange(90, len(passage))]} {around()}") for i in range(60)]
        rows += [rows[7], rows[7], (3, rows[9][1]), (None, rows[11][1]), (60, f"{passage} {passage}")]
        check(spark.createDataFrame(rows, "doc_id long, text string"), rows, True)


def test_suffix_array_of_large_alphabets():
    rng = random.Random(5)
    for sigma, n in ((3000, 5000), (2000, 6000), (1500, 1501)):
        s = np.array([*rng.choices(range(1, sigma), k=n), *[sigma] * 40, *rng.choices(range(1, sigma), k=30), *[7] * 50, 0], np.int32)
        s = np.concatenate([s[:-1], s])
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_suffix_array_of_deep_repeats():
    rng = random.Random(2)
    for n in (1000, 5000):
        part = [rng.randrange(1, 4) for _ in range(n // 10)]
        s = np.array((part + [rng.randrange(1, 5)]) * 9 + [0], np.int16)
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_suffix_array():
    rng = random.Random(1)
    for n in range(1, 120):
        s = np.array([rng.randrange(1, 2 + n % 5) for _ in range(n)] + [0])
        assert suffix_array(s).tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())


def test_shard_windows():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(5, 40))) for _ in range(30)]
    cls, text, offset = shard_windows(texts, 6)
    found, want = {}, {}
    for c, t, o in zip(cls, text, offset):
        if o + 6 <= len(texts[t]):
            found.setdefault(c, set()).add((t, o))
    for t, b in enumerate(texts):
        for o in range(len(b) - 5):
            want.setdefault(b[o : o + 6], set()).add((t, o))
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
