"""Token ids of whole texts with a public byte-level BPE file, and the fixed-width id files.

``TokenCodec`` is the small helper that runs inside tasks. A text is cut only where the tokenizer's own pre-splitting
always cuts (between words, marks and white space), so encoding the pieces and
joining their ids gives exactly the ids of the whole text. Pieces repeat, so their ids are kept in a bounded table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

# Unicode White_Space, which the tokenizer's patterns mean by \s.
SPACE = "\t-\r \x85\xa0  -     　"
# A word that ends before a mark or white space; marks up to a word; anything else up to white space; white space.
UNIT = re.compile(f" ?[^\\W\\d_]++(?![\\w'])| ?[^\\w{SPACE}']++(?!['_])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
KEPT_UNITS = 400_000  # pieces in each of the two tables of a worker
AT_ONCE = 1 << 21  # characters cut into pieces at a time


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TokenCodec:
    """Ids of texts as little-endian uint32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocab_size = self.tokenizer.get_vocab_size()
        # The same model for pieces that are known to be one word: they go in as one list, without splitting them again.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.letters = byte_letters() | {10: "\n"}
        self.lengths = np.zeros(self.vocab_size, dtype=np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.lengths[k] = len(token)
        # Two generations: what is still in use moves from the old table to the young one, the rest goes when that is full.
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, units: set[str]) -> None:
        if len(self.known) > KEPT_UNITS:
            self.old, self.known = self.known, {}
        units = units.difference(self.known)
        stems = []
        for u in units:
            if u in self.old:
                self.known[u] = self.old[u]
            else:
                stems.append(u)
        plain = [u for u in stems if (u[1:] if u[0] == " " else u).isalpha()]
        self._learn_words(plain)
        rest = [u for u in stems if u not in self.known]
        for unit, got in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.known[unit] = np.array(got.ids, dtype="<u4").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        """Ids of pieces that are letters only, with or without one blank before them."""
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            text = "\n".join(some).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            # A token is as long as the bytes it stands for, so lengths tell which tokens are whose.
            ends = np.cumsum([len(w) for w in text.split("\n")])
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends, side="left") + 1
            data, start = ids.tobytes(), 0
            for w, cut in zip(some, (cuts * 4).tolist()):
                self.known[w] = data[start:cut]
                start = cut

    def _some(self, texts: list[str]) -> list[bytes]:
        cut = [UNIT.findall(t) for t in texts]
        units: set[str] = set()
        for c in cut:
            units.update(c)
        self._learn(units)
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of the texts in order, a bounded number of characters at a time."""
        some, size = [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size >= AT_ONCE:
                yield from self._some(some)
                some, size = [], 0
        yield from self._some(some)


@lru_cache(maxsize=4)
def codec(path: str) -> TokenCodec:
    """One codec per worker process and vocabulary file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TokenCodec(path)


def bits_for(vocab_size: int) -> int:
    """Least number of bits that holds every id."""
    return max(1, int(vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, ``bits`` bits each, lowest bit first; the last byte is filled with zeros."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    lanes = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(lanes.reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, count: int, skip: int = 0) -> np.ndarray:
    """``count`` ids after the first ``skip`` of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count, offset=skip * bits // 8).astype(np.uint32)
    first, last = skip * bits // 8, ((skip + count) * bits + 7) // 8
    flat = np.unpackbits(np.frombuffer(data[first:last], dtype=np.uint8), bitorder="little")
    lanes = flat[skip * bits - first * 8 :][: count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), dtype=np.uint8)
    wide[:, :bits] = lanes
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)
