import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vecloom.llm import tokens
from vecloom.llm.common import fresh_path, local_path
from vecloom.llm.tokencounts import document_counts, token_counts
from vecloom.llm.tokenfiles import SequenceFile, sequence_output, write_sequences

BYTE_BPE = tokens.tokenizer_path("byte_bpe_50k.json")
ODD = [
    "", None, " ", "\n\n", "  a  b\n\n c d　e <|endoftext|> x's don't 12 3.4\t\tÀB́C é ", "́ x", "a  b", "Σ ΑΣ σ.x", "x" * 3000, "it's, we'll 'S  'ſ K", "a<|endoftext|>b",
    "<|startoftext|>|x|", "tab\tand\x1cmore\x85 next", "emoji 👩‍👩‍👧 flag🇩🇪.", "word " * 3000, "日本語、テスト。", "…dots...!?", "a.b,c;d:e", "\r\n\r\nx", "x　 y",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_like_whole_texts(name):
    e = tokens.PieceEncoder(tokens.tokenizer_path(name))
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "'s", ".", ",", "$$", "Ab", "é", "ß", "12", "中", "\xa0", " ", "<|endoftext|>", "'", "x", "́", "e", "|"]
    texts = ODD + ["".join(r.choices(parts, k=r.randrange(1, 12))) for _ in range(3000)]
    for first in range(0, len(texts), 500):
        part = texts[first : first + 500]
        ids, bounds = e.encode(pa.array(part, pa.string()))
        for t, a, b in zip(part, bounds, bounds[1:]):
            assert ids[a:b].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_cache_is_bounded(monkeypatch):
    e = tokens.PieceEncoder(BYTE_BPE)
    monkeypatch.setattr(tokens, "KEPT_PIECES", 20)
    for i in range(10):
        text = " ".join(f"word{i}x{j}" for j in range(15))
        assert e.encode(pa.array([text]))[0].tolist() == e.tokenizer.encode(text).ids and len(e.known) <= 20


def want(rows, end):
    e = tokens.PieceEncoder(BYTE_BPE).tokenizer
    return [(d, [*e.encode(t or "", add_special_tokens=False).ids, end]) for d, t in rows]


def test_sequences(spark, docs):
    rows = [(i * 3, t) for i, t in enumerate(ODD)]
    r = random.Random(2)
    out = sequence_output(docs(*r.sample(rows, len(rows))).withColumnRenamed("n_chars", "start"), BYTE_BPE, 2, 64).collect()
    start, lines = 0, []
    for d, ids in want(rows, 2):
        lines.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(x) for x in out) == lines


def test_rows_of_a_file(spark, docs):
    path = fresh_path(spark, "test")
    places = write_sequences(docs(*enumerate(ODD)).coalesce(1), path, BYTE_BPE, 2, 16).collect()
    per_file = {}
    for d, ids in want(list(enumerate(ODD)), 2):
        place = next(p for p in places if p.doc_id == d)
        per_file.setdefault(place.file, []).extend(ids)
        assert len(ids) == place.n_tokens and len(per_file[place.file]) == place.local_start + len(ids)
    for number, ids in per_file.items():
        file = SequenceFile(f"{path}/part-{number:06d}.arrows")
        got = [file[i] for i in range(len(file))]
        assert all(len(a) == len(m) == 16 for a, m in got)
        assert np.concatenate([a[m] for a, m in got]).tolist() == ids and not got[0][0].flags.owndata


def test_empty_tables(spark, docs):
    none = docs((1, "x")).limit(0)
    assert sequence_output(none, BYTE_BPE).collect() == [] and document_counts(none, BYTE_BPE, 50256).collect() == []


def test_same_and_null_ids(spark, docs):
    out = sequence_output(docs((5, "b"), (None, "a b c"), (5, "b"), (5, "a c")), BYTE_BPE, 2).collect()
    assert [(r.doc_id, r.start) for r in sorted(out, key=lambda r: r.start)][0] == (None, 0) and sorted(r.n_tokens for r in out) == [2, 2, 3, 4]


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_separators_across_blocks(spark, block):
    r = random.Random(block)
    path, files, lines = fresh_path(spark, "flat"), [], []
    system, at = local_path(path)
    system.create_dir(at, recursive=True)
    for i, end in enumerate([True, False, True, False]):
        counts = [r.choice([1, 1, 2, 5, 90]) for _ in range(40)] if i < 3 else [7]
        ids = np.concatenate([np.append(np.arange(n - 1) % 9, 99) for n in counts]).astype("<u2")
        ids = ids if end else np.append(ids, [3, 4]).astype("<u2") if i == 1 else ids[:-1]
        name = f"{path}/{i}.bin"
        with system.open_output_stream(f"{at}/{i}.bin") as f:
            f.write(ids.tobytes())
        files.append((name, ids.nbytes))
        place = 0
        for k, own in enumerate(np.split(ids, np.flatnonzero(ids == 99) + 1)):
            if len(own):
                lines.append((name, k, place, len(own), own[-1] == 99))
            place += len(own)
    files.append((f"{path}/none.bin", 0))
    got = token_counts(spark.createDataFrame(files, "file string, bytes long"), 99, 2, block).collect()
    assert sorted((x.file, x.ordinal, x.start, x.n_tokens, x.ended) for x in got) == sorted(lines)


def test_document_counts(spark, docs):
    rows = list(enumerate(t for t in ODD if "<|" not in (t or "")))
    got = document_counts(docs(*rows), BYTE_BPE, 50256, 128).collect()
    assert {x.doc_id: x.n_tokens for x in got} == {d: len(ids) for d, ids in want(rows, 50256)}


def plain(rows, end):
    e = tokens.PieceEncoder(BYTE_BPE).tokenizer
    e.encode_special_tokens = True
    return {d: [*e.encode(t or "", add_special_tokens=False).ids, end] for d, t in rows}


def test_document_counts_with_separator_text(spark, docs):
    texts = [*ODD, "<|endoftext|>", "<|endoftext|><|endoftext|>", "x <|endoftext|> y\n<|endoftext|>"]
    rows = list(enumerate(texts + texts))
    lists = plain(rows, 50256)
    got = document_counts(docs(*rows).coalesce(1), BYTE_BPE, 50256, 128).collect()
    start, lines = 0, []
    for d, _ in rows:
        lines.append((d, d, start, len(lists[d])))
        start += len(lists[d])
    assert sorted((x.doc_id, x.ordinal, x.start, x.n_tokens) for x in got) == lines


def test_plain_pieces_encode_like_whole_texts():
    e, r = tokens.PieceEncoder(BYTE_BPE, plain=True), random.Random(3)
    texts = ODD + ["".join(r.choices([" ", "\n", "'s", ".", "Ab", "é", "12", "<|endoftext|>", "<|", "x", "|"], k=r.randrange(1, 12))) for _ in range(2000)]
    ids, bounds = e.encode(pa.array(texts, pa.string()))
    want_ids = plain(enumerate(texts), 50256)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        assert ids[a:b].tolist() == want_ids[i][:-1], repr(texts[i])
    assert not (ids == 50256).any()


def test_end_id_of_plain_text_is_refused(spark, docs):
    end = tokens.PieceEncoder(BYTE_BPE).tokenizer.encode("a").ids[0]
    with pytest.raises(Exception, match="cannot part them"):
        document_counts(docs((1, "a")), BYTE_BPE, end).collect()
