import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import ODD_TEXTS, documents

from corpusloom.llm import packing, tokens


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_path(name))


def expected_counts(texts):
    t = library("byte_bpe_50k.json")
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


LONG_TEXTS = [
    "word " * 900 + "<|endoftext|>" * 20 + " tail  of   spaces " * 50,
    "x" * 4000,  # one pre-token longer than any chunk
    " " * 3000 + "end",
    "".join(chr(97 + k % 26) * (k % 9) + " \n"[k % 2] * (k % 4) for k in range(1500)),
    "né́ 😀 ÄÖ it's 12,345.67 \xa0\xa0 " * 150,
    "<|endoftext|>" * 300,
]


def test_counts_of_odd_and_long_texts(spark):
    texts = ODD_TEXTS + LONG_TEXTS
    rows = tokens.count_tokens(documents(spark, texts)).collect()
    want = expected_counts(texts)
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == dict(enumerate(want))
    assert {r["doc_id"]: r["n_bytes"] for r in rows} == {k: len((t or "").encode()) for k, t in enumerate(texts)}
    assert {r["doc_id"]: r["over_limit"] for r in rows} == {k: n > 512 for k, n in enumerate(want)}


@pytest.mark.parametrize(("chunk", "overlap"), [(100, 20), (257, 64), (1000, 1)])
def test_chunks_are_spliced_exactly(spark, chunk, overlap):
    texts = ODD_TEXTS + LONG_TEXTS
    rows = tokens.count_tokens(documents(spark, texts), huge=10, chunk=chunk, overlap=overlap).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == dict(enumerate(expected_counts(texts)))


def test_repeated_and_null_ids_and_no_rows(spark):
    docs = documents(spark, ["a b", "a b", None, "c" * 50], ids=[1, 1, None, None])
    rows = tokens.count_tokens(docs, huge=20).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in rows) == sorted(
        zip([1, 1, -1, -1], expected_counts(["a b", "a b", None, "c" * 50]))
    )
    empty = tokens.count_tokens(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_counts_equal_the_library():
    texts = [x or "" for x in ODD_TEXTS + LONG_TEXTS]
    assert tokens.Pieces("byte_bpe_50k.json").counts(pa.array(texts)).tolist() == expected_counts(texts)
    assert tokens.Pieces("byte_bpe_50k.json").counts(pa.array(texts, pa.large_string())).tolist() == expected_counts(texts)
    assert tokens.Pieces("byte_bpe_50k.json").counts(pa.array(texts).slice(3, 9)).tolist() == expected_counts(texts[3:12])


def test_binary_pieces():
    for n in (1, 2, 7, 2047, 2048, 2049, 6000):
        pieces = packing.binary_pieces(n)
        assert [s for s, _ in pieces] == [sum(length for _, length in pieces[:k]) for k in range(len(pieces))]
        assert sum(length for _, length in pieces) == n
        assert all(length & (length - 1) == 0 and length <= 2048 for _, length in pieces)
        assert len(pieces) == n // 2048 + (n % 2048).bit_count()


def test_packing_round_trip(spark):
    texts = ODD_TEXTS + LONG_TEXTS + ["many different words %d" % k for k in range(300)]
    docs = documents(spark, texts)
    rows = packing.packing_digest(docs).collect()
    packed = packing.pack(docs).collect()
    t = library("word_bpe_49k.json")
    want = [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    by_sequence = sorted(rows, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in by_sequence] == sorted((r["length"] for r in rows), reverse=True)
    back = {k: {} for k in range(len(texts))}
    for r in packed:
        back[r["doc_id"]][r["start"]] = np.frombuffer(r["ids"], "<u4").tolist()
    for k, ids in enumerate(want):
        assert sum((back[k][s] for s in sorted(back[k])), []) == ids
    for r in rows:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(want[r["doc_id"]]) and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_without_rows(spark):
    assert packing.packing_digest(documents(spark, ["a"]).limit(0)).count() == 0
    rows = packing.packing_digest(documents(spark, [None, "a", "a"], ids=[None, 4, 4])).collect()
    assert sorted((r["doc_id"] or -1, r["length"]) for r in rows) == [(-1, 1), (4, 2), (4, 2)]


def test_words_equal_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    letters = "".join(chr(c) for c in range(0xC0, 0x250)) + "Ab"
    texts = ODD_TEXTS + [c + letters[k - 1] + "x." for k, c in enumerate(letters)] + [f"Wörd{k % 7}, WORD!? Été;" for k in range(50)]
    t = library("word_bpe_49k.json")
    flat, begins = tokens.pieces_of("word_bpe_49k.json").ids(pa.array([x or "" for x in texts]))
    for text, i, j in zip(texts, begins, begins[1:]):
        assert flat[i:j].tolist() == t.encode(text or "", add_special_tokens=False).ids, text


def test_pieces_leave_in_several_batches(monkeypatch):
    monkeypatch.setattr(packing, "BATCH_BYTES", 64)
    texts = ["one two three four five six seven eight"] * 5 + ["x " * 5000]
    batch = pa.record_batch([pa.array(range(6)), pa.array(texts)], ["doc_id", "_text"])
    out = list(packing._decompose("word_bpe_49k.json", 2048, 1)(iter([batch])))
    assert len(out) > 5
    rows = pa.Table.from_batches(out).to_pylist()
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    for k, text in enumerate(texts):
        ids = b"".join(r["ids"] for r in rows if r["doc_id"] == k)
        assert np.frombuffer(ids, "<u4").tolist() == library("word_bpe_49k.json").encode(text, add_special_tokens=False).ids + [1]
