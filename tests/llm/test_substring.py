import hashlib
import random
import re
from collections import Counter

import pytest
from fixtures import ODD_TEXTS, documents

from corpusloom.llm import substring

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(texts, window):
    """n_words, n_removed and checksum of each text, with all windows in one table."""
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def texts_with_repeats(rng):
    def prose(n, of=400):
        return [f"w{rng.randrange(of)}" for _ in range(n)]

    shared = [prose(n) for n in (34, 35, 36, 50, 90, 300)]
    texts = list(ODD_TEXTS)
    for _ in range(120):
        parts = [prose(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), prose(rng.randrange(40))]
        texts.append(" ".join(sum(parts, [])))
    texts += [" ".join(prose(n)) for n in (34, 35, 200)] * 3  # copies
    texts += ["\n".join(prose(80, 3)) for _ in range(12)]  # few words, so much overlaps
    texts += ["la " * n for n in (34, 35, 36, 500)]
    base = prose(260)
    for k in range(40):  # one place is changed, so contexts differ
        changed = list(base)
        changed[k * 6] = f"x{k}"
        texts.append(" ".join(changed))
    return texts


@pytest.mark.parametrize(("shard_words", "many"), [(40_000, 2000), (300, 10), (40_000, 0)])
def test_against_all_windows(spark, shard_words, many):
    texts = texts_with_repeats(random.Random(4))
    docs = documents(spark, texts)
    rows = substring.remove_repeats(docs, shard_words=shard_words, many_texts=many).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows}
    want = brute(texts, 35)
    assert len(rows) == len(texts) and sum(w[1] > 0 for w in want) > 100
    wrong = [k for k, w in enumerate(want) if got[k] != w]
    assert not wrong, [(k, texts[k][:60], got[k], want[k]) for k in wrong[:3]]


def test_words_and_passages_that_sums_confuse(spark):
    """Thue-Morse words of letters, and passages of two words in that order, have equal polynomial hashes."""
    signs = [k.bit_count() & 1 for k in range(2048)]
    common = [f"w{k}" for k in range(34)]
    texts = []
    for n in (1024, 2048):
        for flip in (0, 1):
            letters = "".join("ab"[s ^ flip] for s in signs[:n])
            texts.append(" ".join([*common, letters]))
            texts.append(" ".join([letters, *common]))
            texts.append(" ".join([f"x{n}{flip}"] + [("yes", "no")[s ^ flip] for s in signs[:n]]))
    for many in (2000, 0):
        rows = substring.remove_repeats(documents(spark, texts), many_texts=many).collect()
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows}
        assert got == dict(enumerate(brute(texts, 35)))


def test_short_windows_and_repeated_ids(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(60)]
    ids = [None if k % 3 else k % 7 for k in range(60)]
    rows = substring.remove_repeats(documents(spark, texts, ids), window=12).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows)
    assert got == Counter((i, *w) for i, w in zip(ids, brute(texts, 12)))
    assert substring.remove_repeats(documents(spark, texts).limit(0)).count() == 0


def test_automaton_statistics():
    rng = random.Random(1)
    for _ in range(60):
        texts = [[rng.choice("abc") for _ in range(rng.randrange(1, 25))] for _ in range(rng.randrange(1, 6))]
        weights = [rng.randrange(1, 3) for _ in texts]
        automaton = substring.SuffixAutomaton()
        for t, w in zip(texts, weights):
            automaton.add(t, w)
        automaton.finish()
        runs = Counter()
        for t, w in zip(texts, weights):
            for i in range(len(t)):
                for j in range(i):
                    runs[tuple(t[j : i + 1])] += w
                runs[t[i],] += w
        for t in texts:
            want = [max([n for n in range(1, i + 2) if runs[tuple(t[i + 1 - n : i + 1])] > 1], default=0) for i in range(len(t))]
            assert automaton.statistics(t) == want
