import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vecloom.llm.packing import TightestFit, best_fit, best_fit_packing
from vecloom.llm.tokens import PieceEncoder, tokenizer_path

WORD_BPE = tokenizer_path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """Best-fit decreasing as it is usually written: the number of bins, and what stands in each."""
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= length]
        if fits:
            best = min(fits, key=lambda b: b[0])
            best[0] -= length
            best[1].append(length)
        else:
            bins.append([capacity - length, [length]])
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_as_one_by_one(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 5, 17, 64])
    lengths = [min(capacity, 1 + int(r.expovariate(3 / capacity))) for _ in range(r.choice([1, 10, 200]))]
    bins, seen = defaultdict(list), Counter()
    for length, rank, n, each, first, place in best_fit(dict(Counter(lengths)), capacity):
        assert rank == seen[length]
        seen[length] += n
        for k in range(n):
            bins[first + k // each].append((place + k % each * length, length))
    assert seen == Counter(lengths)
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= capacity
    want = one_by_one(lengths, capacity)
    # Which of several equally full bins takes a piece is free; how full all are is not.
    assert sorted(sum(n for _, n in own) for own in bins.values()) == sorted(capacity - b[0] for b in want)


def test_tree():
    tree = TightestFit(10)
    assert tree.find(1) == -1
    tree.set(3, True), tree.set(9, True)
    assert [tree.find(n) for n in (1, 3, 4, 9, 10)] == [3, 3, 9, 9, -1]
    tree.set(9, False)
    assert tree.find(4) == -1


def test_whole_corpus(spark, docs):
    words = "alpha beta gamma delta <|endoftext|> don't 12 é ß 中文 é".split()
    r = random.Random(5)
    texts = [" ".join(r.choices(words, k=r.choice([0, 1, 3, 40, 900]))) for _ in range(60)] + [None, "", "  \n", "x" * 5000, "word " * 9000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "null id")]
    out = best_fit_packing(docs(*rows).withColumnRenamed("n_chars", "length"), WORD_BPE, 64, 0).collect()
    tokenizer = PieceEncoder(WORD_BPE).tokenizer
    want = Counter()
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((doc, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64)))
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in out) == want
    bins = defaultdict(list)
    for x in out:
        bins[x.sequence_id].append((x.offset, x.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 64
    assert len(bins) == len(one_by_one([x.length for x in out], 64))


def test_empty(spark, docs):
    assert best_fit_packing(docs((1, "x")).limit(0), WORD_BPE).collect() == []
