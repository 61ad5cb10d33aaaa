import random
import re
import tracemalloc
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.llm import line_dedup as dedup
from logspark.llm.common import materialise
from logspark.llm.components import connected_components
from logspark.llm.embedding_dedup import cover_tree, dual_traversal, embedding_components, embedding_links, unit_vectors
from logspark.llm.hamming import hamming_links
from logspark.llm.line_dedup import drop_repeated_lines, fingerprinted_lines, letters_bridged, line_dedup, outlines, possible, removed_lines, short_codes, words_bridged
from logspark.llm.simhash_dedup import covering_families, covering_masks, keep_one_per_group, simhash_components

from . import brute
from .conftest import prose


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(-5, 7), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == brute.roots({n for link in real for n in link}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_masks_cover_every_pair():
    for bits in (range(64), range(5, 33), range(7)):
        own = covering_masks(list(bits), 2)
        assert all(any(not m & sum(1 << b for b in apart) for m in own) for apart in combinations(bits, 2))
    rng = random.Random(3)
    apart = [sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(300)]
    assert all(any(not m & a for m in masks) for masks in covering_families(2) for a in apart)


def test_hamming_links_in_large_buckets(spark):
    """Clusters that the second and the third family split."""
    rng = random.Random(2)
    center = rng.getrandbits(63)
    fps = {center} | {center ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(1, 4))) for _ in range(200)} | {rng.getrandbits(63) for _ in range(50)}
    rows = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = [(r.a, r.b) for r in hamming_links(rows, 2, covering_families(2), most=8).collect()]
    assert Counter(got) == Counter((a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2)


def test_simhash(odd_docs, odd_rows):
    got = simhash_components(odd_docs).collect()
    fps = {brute.fingerprint(r[1]) for r in odd_rows}
    root = brute.roots(fps, [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 2])
    low = defaultdict(list)
    for r in odd_rows:
        low[root[brute.fingerprint(r[1])]].append(r[0])
    want = Counter()
    for r in odd_rows:
        ids = [i for i in low[root[brute.fingerprint(r[1])]] if i is not None]
        want[r[0], f"{brute.fingerprint(r[1]):016x}", min(ids) if ids else None] += 1
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_simhash_keeps_one(odd_docs, odd_rows, no_docs):
    kept = keep_one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    parts = {(r.doc_id, r.component_id) for r in simhash_components(odd_docs).collect() if r.doc_id is not None}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for _, c in parts})
    assert kept.where("doc_id is null").count() == 2
    assert keep_one_per_group(no_docs).collect() == simhash_components(no_docs).collect() == []


def norm(line):
    """A line as it is held against others: its words and digits, or for short lines itself; None without a word."""
    low = line.lower()
    if 2 * len(re.sub("[0-9]", "", low)) > len(low):
        low = re.sub("[0-9]", "0", low)
    words = [w for w in re.split(r"[\x00-/:-`{-\x7f]+", low) if w]
    return " ".join(words) if len(words) >= 5 else ("short", line.lower().strip(" \t\r\x0b\x0c")) if words else None


def plain_lines(rows):
    """Lines that are no first occurrences, by edit similarity of all that share three words in a row, or two in lines
    of up to six: without fingerprints."""
    places = defaultdict(list)
    for i, text in {(brute.order(r[0]), r[1] or "") for r in rows}:
        for at, line in enumerate(text.split("\n")):
            if norm(line):
                places[norm(line)].append((i, at, text))
    long = {n: n.split(" ") for n in places if isinstance(n, str)}
    grams = {n: {tuple(w[k : k + g]) for g in ((2, 3) if len(w) <= 6 else (3,)) for k in range(len(w) - g + 1)} for n, w in long.items()}
    near = lambda a, b: 5 * brute.distance(a, b) <= max(len(a), len(b))
    links = [(a, b) for a, b in combinations(long, 2) if grams[a] & grams[b] and (near(long[a], long[b]) or near(a, b))]
    root = brute.roots([str(p) for p in places], [(str(a), str(b)) for a, b in links])
    first = {}
    for n, at in places.items():
        first[root[str(n)]] = min([*([first[root[str(n)]]] if root[str(n)] in first else []), *[p[:2] for p in at]])
    return {at for n, own in places.items() for at in own if at[:2] != first[root[str(n)]]}, len(links)


def test_lines(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(6)
    line = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300))
    letters = " ".join(w[:4] + "z" if k % 3 == 0 else w for k, w in enumerate(line.split(" ")))
    texts = [
        line, line.replace("a", "A", 3).replace(" b", " - b", 2), line + " x", line + " y z", f"a short line\n{line}", "a short line", line[6:],
        "\n".join([line] * 3), "2024-01-02 seen at the gate", "1999-12-31 seen, at the GATE", " ".join(reversed(line.split(" "))), letters,
        " Read More \n\n---\n}", "read more\n\n---\n}", "Chapter 1", "Chapter 2", "1,2,3,4,5,6", "9,8,7,6,5,4", "9;8;7;6;5;4",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, line)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, at string, row string")
    want, links = plain_lines(rows)
    got = {(min(r.id, brute.LAST - 1), r.at) for r in removed_lines(docs).collect()}
    assert links and got == {(min(i, brute.LAST - 1), at) for i, at, _ in want}
    assert {(9, 0), (13, 0), (18, 0)} <= got and not {(13, 2), (13, 3), (15, 0), (17, 0)} & got
    out = line_dedup(docs).collect()
    assert len(out) == len(rows)
    assert all(r.n_removed == sum(1 for i, *_ in want if i == brute.order(r.doc_id)) for r in out)
    left = drop_repeated_lines(docs)
    assert left.columns == docs.columns
    assert [r.text for r in left.where("doc_id = 4").collect()] == ["a short line"] * 2
    assert [r.text for r in left.where("doc_id = 13").collect()] == ["\n---\n}"]
    assert line_dedup(no_docs).collect() == []
    odd = drop_repeated_lines(odd_docs).collect()
    assert len(odd) == len(odd_rows) and sum(r.text is None for r in odd) == sum(r[1] is None for r in odd_rows)


def test_lines_of_texts_with_one_doc_id(spark):
    """Only the rows that hold the copied line lose a line; others with no doc_id, or the same, keep theirs."""
    copied, own, other = ("the gate was seen open again", "nobody else wrote this sentence here", "quite different words stand in it")
    rows = [(1, copied), (2, f"x\n{copied}"), (2, f"x\n{own}"), (None, copied), (None, other)]
    got = Counter((r.doc_id, r.text) for r in drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, copied), (2, "x"), (2, own), (None, ""), (None, other)])


def test_lines_linked_by_one_that_a_pivot_holds(spark):
    """One fingerprint: the middle line is like both ends, which aren't alike, and whichever is the pivot."""
    rows = []
    for k in range(6):
        first = [f"{'abcdef'[k]}{c}{c}" for c in "qrstuvwxyz"]
        middle = [*first[1:5], first[0], *first[5:]]
        rows += [(len(rows) + d, " ".join(w)) for d, w in enumerate((first, middle, [*middle[:5], *middle[6:], middle[5]]))]
    got = {r.id for r in removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i, _ in rows if i % 3}


def edited(rng, words, edits):
    """words with as many words put in, taken out or replaced."""
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k : k + rng.randrange(2)] = [] if len(words) > 5 and rng.random() < 0.3 else [f"n{rng.randrange(10**6)}"]
    return words


def test_lines_of_all_lengths_and_in_large_buckets(spark):
    """Near copies at up to the last edit allowed, a phrase that many lines hold, and one line in many variants, against
    edit similarity alone; with large buckets dealt anew, too."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    lines = []
    for n in (5, 6, 7, 9, 10, 14, 20, 33, 60):
        for _ in range(4):
            base = [word() for _ in range(n)]
            lines += [base, edited(rng, base, n // 5), edited(rng, base, max(1, n // 10)), edited(rng, base, n // 5 + 2)]
    phrase, model = [word() for _ in range(8)], [word() for _ in range(30)]
    lines += [[*[word() for _ in range(6)], *phrase, *[word() for _ in range(6)]] for _ in range(40)]
    lines += [edited(rng, model, rng.randrange(1, 5)) for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, _, _ in plain_lines(rows)[0]}
    assert len(want) > 100
    for most in (64, 8):
        assert {r.id for r in removed_lines(docs, most=most).collect()} == want


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    vectors = [b + rng.normal(size=8) * 0.05 for b in base for _ in range(4)] + [base[0], base[0] * 2, base[0]]
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)]
    rows += [(900, None, 0), (901, [0.0] * 8, 0), (902, [None, *[1.0] * 7], 0), (903, [float("nan"), *[1.0] * 7], 0), (904, [float("inf")] * 8, 0), (905, [], 0), (906, [1e300] * 8, 0), (907, [1e-300] * 8, 0), (3, rows[3][1], 0), (None, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int")
    x = {}
    for k, (_, v, _) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and any(v):
            u = np.array(v) / np.abs(v).max()
            x[k] = u / np.sqrt(u @ u)
    links = [(a, b) for a, b in combinations(x, 2) if x[a] @ x[b] >= 0.95]
    n = Counter(k for link in links for k in link)
    root = brute.roots([r[0] for r in rows if r[0] is not None], [(rows[a][0], rows[b][0]) for a, b in links])
    want = Counter((r[0], n[k], root.get(r[0]), None if r[0] is None else root[r[0]] == r[0]) for k, r in enumerate(rows))
    for per_cell in (2000, 20):
        got = embedding_components(df, per_cell=per_cell).collect()
        assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want
    assert embedding_components(df.limit(0)).collect() == []


def test_blocks_of_vectors_meet_by_groups(spark):
    """What a vector goes to doesn't grow with the number of blocks that it meets."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 8)) + 1
    x[60:] = x[:60] + rng.normal(size=(60, 8)) * 0.1
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.sqrt((x * x).sum(1))[:, None]
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.4, 1)))]
    units = unit_vectors(df, 8).select(F.col("id").alias("rep"), "unit", F.lit(1).cast("long").alias("copies"))
    parts = [tuple(r) for r in embedding_links(materialise(units, "units"), 0.4, per_cell=3).collect()]
    n = Counter()
    for rep, linked, _ in parts:
        n[rep] += linked
    assert n == Counter(k for link in links for k in link)
    assert brute.roots(range(120), [(a, b) for a, _, b in parts]) == brute.roots(range(120), links)
    # A vector comes back once at the most from each tile of its group.
    assert max(Counter(rep for rep, _, _ in parts).values()) <= 10


def test_pairs_of_many_near_vectors_are_not_all_held(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 64)) * 0.07
    x[:, 0] += 1
    x[1::50] = x[::50] + rng.normal(size=(14, 64)) * 0.025
    x /= np.sqrt((x * x).sum(1))[:, None]
    tree = cover_tree(x)
    tracemalloc.start()
    got = sum(len(a) for a, _ in dual_traversal(x, tree, x, tree, 0.95, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    c = x @ x.T
    assert got == (c >= 0.95).sum() - 700
    assert peak < 120 << 20  # one side of all 490,000 pairs is 250 MB


def test_cover_tree():
    x = np.random.default_rng(1).normal(size=(300, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    before = set()
    for radius, own in zip((1.0, 0.5, 0.25), cover_tree(x)):
        centers = set(own.tolist())
        assert before <= centers
        assert (np.linalg.norm(x - x[own], axis=1) <= radius + 1e-9).all()
        assert all(np.linalg.norm(x[a] - x[b]) > radius - 1e-9 for a, b in combinations(centers, 2))
        before = centers


@pytest.mark.parametrize("most, tile", [(64, 1024), (2, 8)])
def test_no_bucket_of_lines_loses_pairs(spark, most, tile):
    """Forty pairs with two edits in ten words, of which only phrases of all lines are left in common."""
    rng, rows = random.Random(7), []
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    for k in range(40):
        end = f"{word()} {word()}"
        rows += [(2 * k + i, f"the terms of {word()} use and sale {word()} {end}") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id for r in removed_lines(docs, radius=64, blocks=8, most=most, tile=tile).collect()} == {2 * k + 1 for k in range(40)}


def test_possible_pairs_of_lines(spark):
    """Outlines refuse most pairs that are unlike, and none that is similar in words or in characters."""
    rng = random.Random(12)
    letters = "etaoinshrdlucmf thenthen éß你\U0001f600"
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(20, 120))).split() or ["a"]
        b, left = list(" ".join(a)), rng.randrange(len(a) * 2)
        for _ in range(left):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice(["", rng.choice(letters), b[at] + rng.choice(letters)])
        words = [w if rng.random() < 0.85 else "other" + w for w in a]
        pairs += [(" ".join(a), " ".join("".join(b).split()) or "b"), (" ".join(a), " ".join(words)), (" ".join(a), " ".join(rng.sample(a, len(a))))]
    rows = spark.createDataFrame(pairs, "a string, b string")
    sides = [c.alias(f"{n}_{k}") for n in "ab" for k, c in zip(("codes", "n", "thin"), (short_codes(F.split(n, " ")), *outlines(F.col(n))))]
    got = rows.select("a", "b", *sides).select("a", "b", possible(0.8).alias("maybe")).collect()
    refused = 0
    for r in got:
        alike = any(brute.distance(x, y) <= int(max(len(x), len(y)) * 0.2 + 1e-9) for x, y in ((r.a, r.b), (r.a.split(" "), r.b.split(" "))))
        assert r.maybe or not alike
        refused += not r.maybe
    assert refused > 100


def test_pairs_of_lines_are_compared_in_slices(spark, monkeypatch):
    """However many pairs there are, few of them meet their lines at once, and all do."""
    rng = random.Random(9)
    lines = [f"{prose(rng, 6, 3000)} one phrase of all {prose(rng, 6, 3000)}" for _ in range(14)]
    lines += [line.replace("x1", "x2", 2) for line in lines]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    made = []
    monkeypatch.setattr(dedup, "materialise", lambda df, name: made.append(name) or materialise(df, name))
    whole = {r.id for r in removed_lines(docs, radius=64).collect()}
    assert made.count("possible-lines") == 2
    monkeypatch.setattr(dedup, "_AT_ONCE", 0)
    made.clear()
    assert {r.id for r in removed_lines(docs, radius=64).collect()} == whole and whole
    assert made.count("possible-lines") > 4


def test_marks_refuse_no_similar_lines(spark):
    """Counts of letters and bits of words refuse most pairs that are unlike, and none that is similar: also long lines,
    with more of a letter than a count holds."""
    rng, lines = random.Random(15), []
    for n in (5, 8, 20, 60, 130):
        words = ["".join(rng.choice("etaoinshrdlucmk0éñ") for _ in range(rng.randrange(1, 8))) for _ in range(n)]
        lines += [" ".join(words), " ".join(edited(rng, words, n // 5)), " ".join(edited(rng, words, n // 5 + 3)), " ".join(rng.sample(words, n))]
        lines.append("".join(rng.choice("etaoin") if rng.random() < 0.15 and c != " " else c for c in lines[-4]))
    lines += [" ".join(["e" * 700] * k + ["ta"] * 300) for k in (5, 6, 9)]
    _, nodes = fingerprinted_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), 5, 6)
    nodes = nodes.where("fp IS NOT NULL").withColumn("at", F.col("first.id"))
    a, b = (nodes.select(*[F.col(c).alias(f"{n}_{c}") for c in ("at", *dedup._MARKS)]) for n in "ab")
    got = a.join(b, F.col("a_at") < F.col("b_at")).select("a_at", "b_at", letters_bridged(0.8).alias("letters"), words_bridged(0.8).alias("words")).collect()
    assert len(got) == len(lines) * (len(lines) - 1) // 2
    for r in got:
        a, b = lines[r.a_at], lines[r.b_at]
        alike = lambda x, y: 5 * abs(len(x) - len(y)) <= max(len(x), len(y)) and 5 * brute.distance(x, y) <= max(len(x), len(y))
        assert r.words or not alike(a.split(" "), b.split(" "))
        assert r.letters or max(len(a), len(b)) > 2500 or not alike(a, b)
    by = {(r.a_at, r.b_at): r for r in got}
    n = len(lines)
    assert by[n - 3, n - 2].letters and by[n - 2, n - 1].letters is False  # 700 edits of 5,105 characters; 2,100 of 7,208
    assert sum(not r.letters for r in got) > len(got) // 2 < sum(not r.words for r in got)
