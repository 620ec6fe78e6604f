"""Words and word windows of many texts at once, as numpy arrays.

A batch of texts is laid into one byte buffer; words are found by byte class and hashed from a running polynomial sum,
so the cost is a few array passes over the bytes and no Python step per word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Bytes that separate words in the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Texts are taken together up to this many bytes; a longer one stands alone.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _plain_words() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[list(BLANKS)] = 0
    table[0] = 1  # a zero byte is part of a word
    return table


def _folded_words() -> np.ndarray:
    """Letters and digits, ASCII ones in lower case, and all bytes of other scripts; the rest separates."""
    table = np.zeros(256, dtype=np.uint8)
    for byte in range(256):
        if byte >= 128 or chr(byte).isalnum():
            table[byte] = ord(chr(byte).lower()) if byte < 128 else byte
    return table


def _lowered_words() -> np.ndarray:
    table = _plain_words()
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


#: Byte to byte as hashed; 0 separates words.
PLAIN = _plain_words()
LOWERED = _lowered_words()
FOLDED = _folded_words()


#: Scripts written without blanks: Thai to Myanmar, Khmer, kana, ideographs.
_UNSPACED = re.compile(
    "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
    "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]"
)
_BEYOND_ASCII = re.compile("[^\x00-\x7f]+")


class _Folds(dict):
    """Each character as it is compared: small, blank if it is no letter, mark or digit, apart in scripts without blanks."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Cf":  # soft hyphens and joiners are not seen
            folded = ""
        elif kind[0] not in "LMN":
            folded = " "
        elif _UNSPACED.match(char):
            # Marks stay with the character before them.
            folded = char if kind[0] == "M" else " " + char
        else:
            folded = char.casefold()
        self[code] = folded
        return folded


_FOLDS = _Folds()


def folded(texts: Sequence[bytes]) -> list[bytes]:
    """Texts for ``FOLDED``, with case and punctuation beyond ASCII treated as within it; composed and split accents are one."""

    def fold(found: re.Match) -> str:
        # The last character of a script without blanks is parted from ASCII letters after it too.
        return found[0].translate(_FOLDS) + (" " if _UNSPACED.match(found[0][-1]) else "")

    out = []
    for text in texts:
        if not text.isascii():
            known = unicodedata.normalize("NFC", text.decode("utf-8", "replace"))
            text = _BEYOND_ASCII.sub(fold, known).encode()
        out.append(text)
    return out


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _INVERSE)]), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


@dataclass
class Words:
    """Words of some texts: text i has the words ``first[i]`` to ``first[i + 1]``, each with a 64-bit hash."""

    hashes: np.ndarray
    first: np.ndarray
    #: The bytes searched, one line feed before, between and after the texts, and where each word starts and ends there.
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``n`` words from each word on, and whether they lie in one text."""
        total = len(self.hashes)
        out = np.zeros(total, dtype=np.uint64)
        if total >= n:
            body = out[: total - n + 1]
            scale = np.uint64(1)
            for k in range(n):
                body += self.hashes[k : total - n + 1 + k] * scale
                scale = np.uint64((int(scale) * int(_STEP)) & (2**64 - 1))
        end = np.repeat(self.first[1:], np.diff(self.first))
        return mix(out), np.arange(total) + n <= end


def find_words(texts: Sequence[bytes], classes: np.ndarray = PLAIN) -> Words:
    """The words of UTF-8 texts."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    coded = classes[data]
    edges = np.flatnonzero((coded[1:] != 0) != (coded[:-1] != 0)) + 1
    starts, ends = edges[0::2], edges[1::2]
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((coded.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)]) + 1
    return Words(hashes, np.searchsorted(starts, begins), data, starts, ends)


def chunks(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK_BYTES`` together."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def utf8(column) -> list[bytes]:
    """The texts of an Arrow string column as bytes, null as empty."""
    return [text or b"" for text in column.cast("binary").to_pylist()]
