"""Small tables with everything that may go wrong in a row."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, copies int, length long"


def documents(spark, texts, ids=None, sources=None):
    """A documents table with columns whose names clash with those of results."""
    ids = range(len(texts)) if ids is None else ids
    sources = [f"s{k % 3}" for k in range(len(texts))] if sources is None else sources
    rows = [(i, t, "en", s, len(t or ""), "x", 5, 7) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ODD_TEXTS = [
    None, "", " ", "\n\n", "word", "two words", "  lead and trail  ", "tab\tand\x0bvertical\r\nline", "same", "same", "same ",
    "a b c d a b c d a b c d", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>", "<|startoftext|> <|endoftext|>",
    "no\xa0break \xa0  and em 　 wide", "\x1c!\x1c! \x1f", "é é ÄÖ ß Σας ΣΑΣ", "emoji 😀😀 👩‍👩‍👧 end",
    "it's don't WE'LL 'tis ' s", "12345 3.14 1,000", "a" * 3000, "ab " * 2000, " " * 500 + "x" + " " * 500, "!?!? ... ---",
    "́ combining first", "​zero​ width", "x y\u0085z",
]
