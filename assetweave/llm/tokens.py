"""Token ids of the public byte-level BPE, encoded once per distinct space-separated chunk.

Texts repeat their words, so a chunk's ids are kept in a bounded table per worker and texts are put together from arrays. The
merges run in the rank engine of tiktoken over the vocabulary of the tokenizer file; the ids are those that `tokenizers`
gives for the same file, which the tests compare.
"""

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from assetweave.llm.held import held
from assetweave.llm.words import coded, slices

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 200_000  # chunks kept per worker; the cache then starts anew


def _byte_of() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as arrays of 16 bits, for vocabularies of up to 65,536 ids."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        special, byte_of = {t["content"] for t in told["added_tokens"]}, _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
        self._whole = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._spaced = np.zeros(1 << 16, bool)
        self._spaced[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
        self._clear()

    def _clear(self) -> None:
        self._code: dict[str, int] = {}  # number of a chunk, -1 where its text has to go whole
        self._size, self._rows, self._used = np.zeros(1024, np.int32), 0, 0
        self._begin, self._flat = np.zeros(1024, np.int64), np.zeros(4096, np.uint16)

    def _add(self, chunks: list[str]) -> None:
        """New chunks, each behind a space. They are encoded in one text: a chunk holds no space, so only its first id has one."""
        self._code.update(dict.fromkeys(chunks, -1))
        chunks = [c for c in chunks if c and not c[0].isspace()]
        if not chunks:
            return
        ids = self._whole(" " + " ".join(chunks))
        flat = np.fromiter(ids, np.uint16, len(ids))
        begins = np.flatnonzero(self._spaced[flat])
        sizes = np.diff(begins, append=len(flat)).astype(np.int32)
        first, last = self._rows, self._rows + len(chunks)
        while last > len(self._size):
            self._size, self._begin = (np.concatenate([a, np.zeros_like(a)]) for a in (self._size, self._begin))
        while self._used + len(flat) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        self._size[first:last], self._begin[first:last] = sizes, self._used + begins
        self._flat[self._used:self._used + len(flat)] = flat
        self._rows, self._used = last, self._used + len(flat)
        self._code.update(zip(chunks, range(first, last), strict=True))

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text. Between two chunks the pattern always cuts, unless white space follows the space; such texts go whole."""
        for begin, end in slices(texts):
            part = texts.slice(begin, end - begin)
            chunks, codes, offsets = coded(part, blank=True)
            if len(self._code) > CACHE:
                self._clear()
            new = [c for c in chunks if c not in self._code]
            if new:
                self._add(new)
            known = np.fromiter(map(self._code.__getitem__, chunks), np.int32, len(chunks))[codes]
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                rest = known[a + 1:b]
                if len(rest) and rest.min() < 0:
                    yield np.array(self._whole(part[i].as_py()), np.uint16)
                    continue
                head = np.array(self._whole(chunks[codes[a]]), np.uint16)
                if not len(rest):
                    yield head
                    continue
                sizes = self._size[rest]
                ends = np.cumsum(sizes, dtype=np.int64)
                at = np.repeat(self._begin[rest] - (ends - sizes), sizes)
                at += np.arange(ends[-1])
                yield np.concatenate([head, self._flat[at]])

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all(pa.array([text], pa.string())))


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return held(("encoder", path), lambda: Encoder(path))
