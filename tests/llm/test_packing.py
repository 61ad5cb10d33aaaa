from array import array
from collections import Counter

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logspark.llm import best_fit_packing
from logspark.llm.best_fit_packing import best_fit_plan, pack_documents

from . import brute

PATH = public_tokenizers.path("word_bpe_49k.json")


def held(rows, capacity):
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert not ends or max(ends.values()) <= capacity
    return len(ends)


def test_every_piece_once_and_gapless(odd_docs, odd_rows):
    for capacity in (4096, 64):
        rows = pack_documents(odd_docs, PATH, capacity).collect()
        want = brute.pieces([r[:2] for r in odd_rows], Tokenizer.from_file(PATH), capacity)
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        held(rows, capacity)


def test_no_documents(no_docs):
    assert pack_documents(no_docs, PATH).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=20))
def test_plan_is_best_fit_decreasing(histogram):
    capacity = 32
    seats, used = Counter(), {}
    for length, rank, n, per, first, at in best_fit_plan(histogram, capacity):
        for r in range(n):
            seats[length, rank + r] += 1
            place = used.setdefault(first + r // per, {})
            for k in range(at + r % per * length, at + (r % per + 1) * length):
                assert k < capacity and k not in place
                place[k] = length
    assert seats == Counter({(length, r): 1 for length, n in histogram.items() for r in range(n)})
    free = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [f for f in free if f >= length]
            if fits:
                free.remove(min(fits))
            free.append((min(fits) if fits else capacity) - length)
    assert len(used) == len(free)
    assert all(sorted(p) == list(range(len(p))) for p in used.values())


def test_words_are_encoded_in_parts(monkeypatch):
    """The encodings of a batch's new words are never all held at once, and ids don't depend on that."""
    path, texts = public_tokenizers.path("word_bpe_49k.json"), [f"Word{i}, and some{i} more of_{i}! <|x|>".encode() for i in range(50)]
    want = best_fit_packing.word_ids(path)(texts)
    monkeypatch.setattr(best_fit_packing, "_AT_ONCE", 7)
    assert best_fit_packing.word_ids(path)(texts) == want


def test_words_of_letters_are_encoded_together(monkeypatch):
    """Few encodings are made for many words, and ids are those of the whole text, also where letters fall apart."""
    texts = [" ".join(f"{a}{b}word" for b in "abcdefgh") for a in "stuvwxyz"]
    texts += ["İstanbul café café straße ǅx ﬁn 你好 مرحبا ʰa Ⅷ ª don't it's x1 ẞ � \U0001d400b", "İ a İb"]
    tokenizer, asked = Tokenizer.from_file(PATH), []

    class Counted:
        get_vocab = tokenizer.get_vocab

        @staticmethod
        def encode_batch(batch, **more):
            asked.extend(batch)
            return tokenizer.encode_batch(batch, **more)

        encode_batch_fast = encode_batch

    monkeypatch.setattr(Tokenizer, "from_file", lambda path: Counted)
    for some in (texts[:8], texts):
        want = [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in some]
        assert best_fit_packing.word_ids(PATH)([t.encode() for t in some]) == want
        if some is not texts:
            assert len(asked) == 1
