import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import ODD_TEXTS, documents

from corpusloom.llm import align
from corpusloom.llm.tokens import public_path


def library():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))


def brute_force(texts):
    """``n_a, n_b, groups, links`` by sets of ends of whole texts; offsets of the first by its own characters' bytes."""
    first, second = library()
    spelling = {i: s for s, i in first.get_vocab().items()}
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    hidden = [c for c in range(256) if c not in shown]
    byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(hidden)}
    out = []
    for text in texts:
        none = (0, 0, "", [])
        if not text:
            out.append(none)
            continue
        whole = (" " + text).encode()
        a = [(i, bytes(byte[c] for c in spelling[i])) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in second.encode(text):
            piece = second.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            out.append(none)
            continue
        ends = [[sum(len(x) for _, x in t[: k + 1]) for k in range(len(t))] for t in (a, b)] if len(a) < 400 else [_ends(a), _ends(b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links, before = [], [], 0
        for e in common:
            left = [i for (i, _), x in zip(a, ends[0]) if before < x <= e]
            right = [i for (i, _), x in zip(b, ends[1]) if before < x <= e]
            groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            links.append((left[-1], right[-1]))
            before = e
        out.append((len(a), len(b), ";".join(groups), links))
    return out


def _ends(tokens):
    out, n = [], 0
    for _, x in tokens:
        n += len(x)
        out.append(n)
    return out


def expected(texts):
    found = brute_force(texts)
    count = Counter(l for *_, links in found for l in links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [
        (
            n_a, n_b, len(links), len(links), sum(count[l] == most[l[1]] for l in links), sum(count[l] for l in links),
            hashlib.sha256(groups.encode()).hexdigest() if n_a else "",
        )
        for n_a, n_b, groups, links in found
    ]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

TEXTS = ODD_TEXTS + [
    "▁already marked ▁", "a▁b", "x\r\n y\r z \r  w", "\n\nNext\n line", "\t tab \t\t x", "trailing   ", "   leading",
    "<s> hi</s> <unk> <0x0A>", "if (x) {\r\n\treturn;\r\n}", "vertical\x0b \x0cform", "日本語 テキスト 한국어", "naïve café déjà-vu",
    "1234567 8 90, 3.14159", "word " * 300, "a  b   c    d     e", " ", "  ", "ﬁ ½ ①", "🙂🙂 🙂", "x\x00y \x01",
]


def test_common_ends():
    r = random.Random(1)
    for _ in range(300):
        a = np.array(sorted(r.sample(range(200), r.randrange(60))), np.int64)
        b = np.array(sorted(r.sample(range(200), r.randrange(200))), np.int64)
        for x, y in ((a, b), (b, a)):
            for start in (np.zeros(len(x), np.int64), np.searchsorted(y, x) // 2):
                in_x, in_y = align.common_ends(x, y, start)
                common = sorted(set(x.tolist()) & set(y.tolist()))
                assert x[in_x].tolist() == common and y[in_y].tolist() == common


@pytest.mark.parametrize("sent", [0, align.SENT_PAIRS])
def test_digest_equals_brute_force(spark, sent):
    rows = align.scored_alignment(documents(spark, TEXTS), sent, digest=True).withColumnRenamed("groups", "groups_sha256").collect()
    assert {r["doc_id"]: tuple(r[c] for c in NAMES) for r in rows} == dict(enumerate(expected(TEXTS)))


def test_query_columns_and_groups(spark):
    docs = documents(spark, TEXTS)
    assert align.alignment_digest(docs).columns == ["doc_id", *NAMES]
    groups = {r["doc_id"]: r["groups"] for r in align.align_tokens(docs).collect()}
    assert groups == {k: g for k, (_, _, g, _) in enumerate(brute_force(TEXTS))}


def test_texts_aligned_whole(monkeypatch):
    """Pieces and whole texts give the same."""
    aligned = align.Aligned("byte_bpe_50k.json", "piece_bpe_32k.model")
    texts = pa.array([" " + t if t else "" for t in TEXTS])
    cut = align._align_rows(aligned, texts)
    monkeypatch.setattr(aligned, "cuttable", False)
    whole = align._align_rows(aligned, texts)
    assert (cut[0] == whole[0]).all() and [bytes(g) for g in cut[3]] == [bytes(g) for g in whole[3]]
    assert cut[2].tolist() == whole[2].tolist() and cut[1].tolist() == whole[1].tolist()


def test_counted_pairs_either_way():
    r = np.random.default_rng(1)
    pairs, owner = r.integers(0, 9, 500) << align.PAIR_BITS | r.integers(0, 3, 500), np.sort(r.integers(0, 40, 500))
    few, many = align._counted(pairs, owner, 50), align._counted(pairs, owner, 1 << 23)
    assert all((x == y).all() for x, y in zip(few[:2], many[:2])) and (few[2] == many[2][:51]).all()


def test_repeated_and_null_ids_and_no_rows(spark):
    docs = documents(spark, ["a b", "a b", None, "c"], ids=[1, 1, None, None])
    rows = align.alignment_digest(docs).collect()
    want = sorted(zip((1, 1, -1, -1), expected(["a b", "a b", None, "c"])))
    assert sorted((r["doc_id"] or -1, tuple(r[c] for c in NAMES)) for r in rows) == want
    assert align.alignment_digest(docs.limit(0)).count() == 0


def test_long_text(spark):
    text = " ".join(f"word{k * k % 977}," for k in range(60_000)) + "\n"
    row = align.align_tokens(documents(spark, [text])).first()
    a, b = library()
    assert row["n_a"] == len(a.encode(" " + text, add_special_tokens=False).ids) and row["n_b"] == len(b.encode(text))
    assert sum(row["times"]) == row["n_links"] == row["groups"].count(";") + 1
