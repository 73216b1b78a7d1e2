"""Whole Arrow batches of texts cut into words or pieces by numpy, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import SPACES

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[ord(c) for c in SPACES]] = True

# Texts are handled together up to so many bytes; a longer text is handled alone.
PART_BYTES = 12 << 20


def parts(texts: pa.Array, most: int = PART_BYTES) -> Iterator[slice]:
    """Ranges of rows whose texts have about ``most`` bytes together."""
    ends = _offsets(texts)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield slice(start, stop)
        start = stop


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text begins (one more at the end). ``texts`` has no nulls."""
    offsets = _offsets(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))


# Kinds of bytes that say where words may be cut further: letters, digits and marks of ASCII. The
# apostrophe, control characters and parts of other characters are of no kind and not cut off.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[ord("'")] = 0


def kind_changes(data: np.ndarray, lone_digits: bool) -> np.ndarray:
    """Whether the byte before is of another kind, for each byte; with ``lone_digits`` digits also differ from digits."""
    kind = _KIND[data]
    out = np.zeros(len(data), bool)
    out[1:] = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | ((kind[1:] == 2) if lone_digits else False))
    return out


def split_words(texts: pa.Array, lower: bool = False, kinds: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of each word, where each text's words begin (one more at the end), and the different words.

    The numbers are places in the array of different words, which may also
    hold white space. ``lower`` turns A-Z into a-z; with ``kinds`` words are
    cut where letters, digits and marks meet, and digits stand alone.
    """
    data, begins = _bytes(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    data = np.ascontiguousarray(data)
    word = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    if kinds:
        edge[:-1] = kind_changes(data, True)
    edge[begins] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]]))) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(begins), np.int64), pa.array([], pa.large_string())
    offsets = np.empty(2 * len(starts), np.int64)  # words and the gaps between them in turn
    offsets[0::2], offsets[1::2] = starts, ends
    coded = _strings(offsets, data).dictionary_encode()
    return coded.indices.to_numpy()[0::2].astype(np.int64), np.searchsorted(starts, begins), coded.dictionary


def split_pieces(
    texts: pa.Array, space: np.ndarray = IS_SPACE, kinds: bool = False
) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The same for pieces: white space and what follows it up to the next white space.

    A text is cut before each white space that follows something else, so its
    pieces in order are the text. ``space`` says which bytes are white space;
    with ``kinds`` pieces are also cut where letters, digits and marks meet.
    """
    data, begins = _bytes(texts)
    data = np.ascontiguousarray(data)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(begins), np.int64), pa.array([], pa.large_string())
    blank = space[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = blank[1:] & ~blank[:-1]
    if kinds:
        cut[:-1] |= kind_changes(data, False)
    cut[begins] = True
    cut[-1] = True
    offsets = np.flatnonzero(cut)
    coded = _strings(offsets, data).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), np.searchsorted(offsets, begins), coded.dictionary


def texts_with(texts: pa.Array, pattern: str, first_bytes: np.ndarray) -> np.ndarray:
    """Which texts match ``pattern``; only those are searched that hold one of ``first_bytes``."""
    data, begins = _bytes(texts)
    hits = np.concatenate([[0], np.cumsum(first_bytes[data], dtype=np.int64)])
    out = hits[begins[1:]] > hits[begins[:-1]]
    maybe = np.flatnonzero(out)
    out[maybe] = pc.match_substring_regex(texts.take(pa.array(maybe)), pattern).to_numpy(zero_copy_only=False)
    return out


def gather(picked: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a flat array of the items of the ``picked`` rows, and where each picked row's items begin.

    ``begins`` says where each row's items begin in the flat array (one more at the end).
    """
    sizes = np.diff(begins)[picked]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(begins[picked] - ends[:-1], sizes) + np.arange(ends[-1]), ends


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, by a hash function that is no polynomial of the bytes."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    digests = b"".join(map(xxhash.xxh3_64_digest, strings.cast(pa.large_binary()).to_pylist()))
    return np.frombuffer(digests, ">u8").astype(np.uint64)


def string_hash_pairs(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two such hashes of each string, which together have 128 bits."""
    if not len(strings):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    digests = b"".join(map(xxhash.xxh3_128_digest, strings.cast(pa.large_binary()).to_pylist()))
    both = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbouring words, mixed after each word so that they are no polynomial either."""
    count = max(len(words) - n + 1, 0)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix((out ^ words[k : k + count]) + np.uint64(0x9E3779B97F4A7C15))
    return out
