"""Texts as codes of their chunks: a text repeats its words, so what is done per word is done per distinct chunk of a slice.

A chunk is what stands between white space. A word is a chunk in lower case without anything but letters and digits; chunks
without any are no words. Splitting and numbering run in Arrow, over slices of a column that bound what is held at once.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE = 4 << 20  # bytes of text


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes; a longer text is on its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(texts):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, "right")))
        yield begin, end
        pa.default_memory_pool().release_unused()  # workers live on; what a slice took shouldn't stay with them
        begin = end


def coded(texts: pa.Array, blank: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks, the chunks of all texts as numbers of these, and where each text begins. Null is empty.

    Chunks stand between white space, or with `blank` between single spaces. Some may be empty.
    """
    texts = pc.fill_null(texts, "")
    parts = pc.split_pattern(texts, " ") if blank else pc.utf8_split_whitespace(texts)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    found = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy(), offsets - offsets[0]


def _hash(chunk: str) -> int:
    low = chunk.lower()
    word = low if low.isalnum() else "".join(filter(str.isalnum, low))
    return xxhash.xxh64_intdigest(word) | 1 if word else 0


def text_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """64-bit hashes of each text's words in order."""
    for begin, end in slices(texts):
        chunks, codes, offsets = coded(texts.slice(begin, end - begin))
        known = np.fromiter(map(_hash, chunks), np.uint64, len(chunks))
        flat = known[codes]
        for a, b in zip(offsets, offsets[1:], strict=False):
            found = flat[a:b]
            yield found[found != 0]


def word_hashes(text: str) -> np.ndarray:
    return next(text_hashes(pa.array([text], pa.string())))
