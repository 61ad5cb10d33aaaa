import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size string, target string, length string, row string, "
    "rank string, id string, at string, n string, salt string, kept string, n_words string, component_id string, taken string"
)
EXTRA = ["x"] * 13


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}x{rng.randrange(3)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, very long, repeated and nearly repeated texts, shared passages, marks and other scripts."""
    rng = random.Random(5)
    passage, long_line = prose(rng, 70), prose(rng, 30)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(12)]
    texts = [
        None, "", " \t\n ", "one", "a b", *base, base[0], base[0], base[1] + " end", base[2].replace("w1", "w2", 1),
        "Start here. " + passage + " and on", passage, "x " + passage, passage + "\n" + passage, prose(rng, 40_000),
        f"{long_line}\nshort\n{long_line.upper()}\n{long_line} more", f"{long_line}\nshort\n\n{prose(rng, 20)}",
        "<|endoftext|> don't STOP ,.;! \x1c  é ça 你好 \U0001f600 <s>▁ x  y   z ▁▁", "ab" * 300, "ab" * 300 + "c", "#*$ % & | < >" * 30,
        "same words again " * 40, "  double  spaces \n\n and ends \n", base[3].upper(),
    ]
    rows = [(i, t, ("en", "fr", None)[i % 3], (f"s{i % 4}", None)[i % 5 == 0], len(t or "")) for i, t in enumerate(texts)]
    rows += [(7, texts[7], "en", "s1", 0), (7, texts[7], "en", "s1", 0), (None, texts[8], None, None, None), (None, None, None, None, None)]
    return [(*r, *EXTRA) for r in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
