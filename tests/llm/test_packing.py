import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from offerloom.llm import encoding, packing
from offerloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_pieces_are_those_of_the_tokenizer_and_fill_sequences(odd_docs, odd_rows, tokenizer):
    want = Counter()
    for k, t, _ in odd_rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 500)):
            part = ids[start : start + 500]
            want[k, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.pack_documents(odd_docs, tokenizer_path(), capacity=500).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= 500


def test_ids_can_be_carried(spark, tokenizer):
    docs = spark.createDataFrame([(1, "Hello brave new world")], "doc_id long, text string")
    assert packing.pack_documents(docs, tokenizer_path(), ids=True).first().ids == [*tokenizer.encode("Hello brave new world", add_special_tokens=False).ids, 1]


def test_no_rows(no_docs):
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


ODD = ["", " ", "A.b, C.", "don't DON'T 'tis it's", "ÀÉ straße ÑANDÚ. ß. İstanbul ǅ", "tab\tnew\nline\x1cunit\x1f x", "<|endoftext|> a <|startoftext|>", "é ́x a b c​d", "١٢3 日本語。漢字 🙂🙂", "x" * 3000, "a.b.c... ,,, .", "The the THE. the, the"]


def test_piecewise_encoding_is_that_of_whole_texts(tokenizer, monkeypatch):
    draw = random.Random(1)
    signs = "aAbÉß .,'!\t\n\x1c1é🙂 ́ -"
    texts = ODD + ["".join(draw.choice(signs) for _ in range(draw.randrange(80))) for _ in range(400)]
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [list(x) for x in encoding.PieceEncoder(tokenizer_path(), 1).encode(texts)] == want
    monkeypatch.setattr(encoding, "MAX_PIECES", 50)
    small = encoding.PieceEncoder(tokenizer_path(), 1)
    assert [list(small.encode([t])[0]) for t in texts] == want


def test_latin_words_with_signs_are_those_of_the_tokenizer(tokenizer):
    draw = random.Random(2)
    letters = [chr(c) for c in range(0xC0, 0x100)] + list("abcdefghijklmnopqrstuvwxyzABCXYZ")
    signs = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    texts = ["".join(draw.choices(letters, k=draw.randrange(1, 9))) + "".join(draw.choices(signs, k=draw.randrange(4))) for _ in range(3000)]
    texts = [" ".join(texts[i : i + 5]) for i in range(0, len(texts), 5)] + [f"a{x} {x}a a{x}s" for x in signs]
    assert [list(x) for x in encoding.PieceEncoder(tokenizer_path(), 1).encode(texts)] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_a_tokenizer_of_other_rules_sees_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path().replace("word_bpe_49k", "byte_bpe_50k")
    texts = ["Hello brave  New world.", "", " a"]
    assert [list(x) for x in encoding.PieceEncoder(path, 1).encode(texts)] == [[*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_two_documents_replace_a_loose_one():
    # Greedy takes 60 and 30 and leaves 10; 25 and 15 in place of 30 leave nothing.
    assert packing.plan_bins({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0] == ([60, 25, 15], 1)


def test_plans_use_every_document_and_few_bins():
    draw = random.Random(5)
    for capacity in (10, 97, 4096):
        counts = Counter(draw.randrange(1, capacity + 1) for _ in range(3000)) if capacity < 4096 else Counter(min(4096, int(draw.lognormvariate(6, 1)) + 1) for _ in range(20_000))
        bins = packing.plan_bins(dict(counts), capacity)
        used = Counter()
        for shape, times in bins:
            assert sum(shape) <= capacity
            for n in shape:
                used[n] += times
        assert used == counts
        made, least = sum(t for _, t in bins), -(-sum(n * c for n, c in counts.items()) // capacity)
        halves = sum(c for n, c in counts.items() if n > capacity / 2)
        assert made <= max(least, halves) * 1.05 + 1
