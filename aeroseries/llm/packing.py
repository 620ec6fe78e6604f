"""Packing token sequences into windows by the sum-of-squares rule.

Every task packs the documents of its partition online. It keeps an array of levels, the number of open windows filled to
each height, and puts the next piece where the sum of squares of that array becomes smallest. A document longer than a
window fills whole windows first; only its rest is placed. Windows that are still open when the partition ends, or that
exceed ``MAX_OPEN``, are closed by cutting their pieces into full windows; the last part is cut at powers of two, which
need no padding.

No shuffle takes place, and the state of a task is bounded by ``MAX_OPEN`` windows. A window's number holds the
partition's number, and a scan deals the same rows to the same partition when a task runs again.

Defined cases: a null or empty text is the end id alone; a null id stays null; repeated rows are packed each for itself;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroseries.llm.words import Words, find_words, mix, utf8

WINDOW = 1024
#: Open windows a task keeps before it closes them.
MAX_OPEN = 1024
#: Words whose ids a Python worker remembers, in some 50 bytes each.
KNOWN_WORDS = 1_000_000
_ROWS_PER_BATCH = 8_192
_BYTES_AT_ONCE = 2 << 20
_OTHER_BLANKS = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31])

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


#: Fixed value: the splitting pattern of the byte-level vocabularies.
SPLITTER = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """Character to byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {chr(byte): byte for byte in shown} | {chr(256 + i): byte for i, byte in enumerate(hidden)}


def _uneven(data: np.ndarray) -> np.ndarray:
    """Bytes of white space other than blanks and line feeds; characters of several bytes are marked at the first."""
    ahead = np.append(data[1:], 0)
    marked = _OTHER_BLANKS[data]
    marked |= (data == 0xC2) & ((ahead == 0x85) | (ahead == 0xA0))
    marked |= ((data == 0xE2) & ((ahead == 0x80) | (ahead == 0x81))) | ((data == 0xE1) & (ahead == 0x9A))
    return marked | ((data == 0xE3) & (ahead == 0x80))


def _equal(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether stretches of two byte buffers, both with eight bytes to spare, are equal one by one; eight bytes at a time."""
    sizes = a_ends - a_starts
    equal = sizes == b_ends - b_starts
    left = np.flatnonzero(equal & (sizes > 0))
    a_words, b_words = (np.lib.stride_tricks.sliding_window_view(x, 8) for x in (a, b))
    done = 0
    while len(left):
        x = a_words[a_starts[left] + done].view(np.uint64).ravel()
        y = b_words[b_starts[left] + done].view(np.uint64).ravel()
        # Of the last eight bytes only those that belong to the stretch count.
        spare = np.maximum(0, 8 - (sizes[left] - done)).astype(np.uint64) * np.uint64(8)
        differ = (x ^ y) << spare != 0
        equal[left[differ]] = False
        done += 8
        left = left[~differ & (sizes[left] > done)]
    return equal


class TextEncoder:
    """Ids of whole texts, equal to those of ``tokenizers``.

    Where single blanks and line feeds divide a text, the splitter never joins what they divide. Such texts are encoded
    word by word: the distinct words of a batch are looked up in a table of known ones, and new words go in one call
    through the same merges in ``tiktoken``, which is several times as fast. Other texts are encoded as a whole, those
    with a special token by ``tokenizers``.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._special = [token.content.encode() for token in tokenizer.get_added_tokens_decoder().values()]
        self._tokenizer = tokenizer
        alphabet = _byte_alphabet()
        ranks = {
            bytes(alphabet[char] for char in token): number
            for token, number in tokenizer.get_vocab(with_added_tokens=False).items()
            if all(char in alphabet for char in token) and token.encode() not in self._special
        }
        self._merges = tiktoken.Encoding("ranks", pat_str=SPLITTER, mergeable_ranks=ranks, special_tokens={})
        (self._line_feed,) = self._merges.encode_ordinary("\n")
        self._forget()

    def _forget(self) -> None:
        """The table of known words: hashes in order, and where the ids and the bytes of each lie in the pools."""
        self._hashes = np.zeros(0, dtype=np.uint64)
        self._starts, self._counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self._pool = np.zeros(0, dtype="<u4")
        self._text_starts, self._text_ends = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self._feeds, self._text = np.zeros(0, dtype=bool), np.zeros(8, dtype=np.uint8)

    def __call__(self, text: str) -> np.ndarray:
        return self.encode([text.encode()])[0]

    def encode(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """The ids of each text; the texts together should be of moderate size."""
        words = find_words(texts)
        plain = self._plain(texts, words)
        # A word that follows a line feed, or is the first of a text, is encoded together with the line feed.
        after_feed = words.data[words.starts - 1] == ord("\n")
        keys = mix(words.hashes + np.uint64(2) * after_feed.astype(np.uint64))
        data, text_of = np.append(words.data, np.zeros(8, np.uint8)), words.text_of()
        while True:
            chosen = np.flatnonzero(plain[text_of])
            distinct, at, which = np.unique(keys[chosen], return_index=True, return_inverse=True)
            spots, known = self._look_up(distinct, words, data, chosen[at], after_feed)
            # Of words with one hash, those that are not the known one send their texts the other way.
            first = chosen[at][which]
            same = known[which] & (after_feed[chosen] == after_feed[first])
            same &= _equal(data, words.starts[chosen], words.ends[chosen], data, words.starts[first], words.ends[first])
            if same.all():
                break
            plain[text_of[chosen[~same]]] = False
        starts, counts = self._starts[spots][which], self._counts[spots][which]
        total = int(counts.sum())
        ends = np.cumsum(counts)
        flat = self._pool[np.repeat(starts - (ends - counts), counts) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(np.where(plain, np.diff(words.first), 0))])]
        return [
            flat[bounds[i] + 1 : bounds[i + 1]] if plain[i] else self._whole(text) for i, text in enumerate(texts)
        ]

    def _plain(self, texts: Sequence[bytes], words: Words) -> np.ndarray:
        """Texts in which exactly one blank or line feed stands between words, and nothing around them."""
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths + 1)]) + 1
        word_bytes = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
        inside = np.diff(word_bytes[words.first])
        n_words = np.diff(words.first)
        odd = np.concatenate([[0], np.cumsum(_uneven(words.data))])
        even = odd[np.minimum(begins[1:], len(words.data))] == odd[begins[:-1]]
        first_byte = np.append(words.starts, -1)[np.minimum(words.first[:-1], len(words.starts))]
        last_byte = np.append(words.ends, -1)[words.first[1:] - 1]
        plain = (n_words > 0) & (lengths - inside == n_words - 1) & even
        plain &= (first_byte == begins[:-1]) & (last_byte == begins[1:] - 1)
        if any(token in b"\n".join(texts) for token in self._special):
            plain &= np.array([not any(token in text for token in self._special) for text in texts])
        return plain

    def _look_up(
        self, distinct: np.ndarray, words: Words, data: np.ndarray, at: np.ndarray, after_feed: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words in the table, after the new ones have been added, and whether the same word stands there."""
        if len(self._hashes) > KNOWN_WORDS:
            self._forget()
        spots = np.searchsorted(self._hashes, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = spots < len(self._hashes)
        new[inside] = self._hashes[spots[inside]] != distinct[inside]
        if new.any():
            raw = data.tobytes()
            feeds = after_feed[at[new]].tolist()
            spans = list(zip(words.starts[at[new]].tolist(), words.ends[at[new]].tolist(), feeds))
            marked = b"".join([b"\n" + raw[s:e] if feed else b"\n " + raw[s:e] for s, e, feed in spans])
            ids = np.array(self._merges.encode_ordinary(marked.decode()), "<u4")
            cuts = np.append(np.flatnonzero(ids == self._line_feed), len(ids))
            starts = cuts[:-1] + np.where(feeds, 0, 1)
            places = spots[new]
            self._hashes = np.insert(self._hashes, places, distinct[new])
            self._starts = np.insert(self._starts, places, starts + len(self._pool))
            self._counts = np.insert(self._counts, places, cuts[1:] - starts)
            self._pool = np.concatenate([self._pool, ids])
            ends = len(self._text) - 8 + np.cumsum([e - s for s, e, _ in spans])
            self._text_starts = np.insert(self._text_starts, places, ends - (words.ends - words.starts)[at[new]])
            self._text_ends = np.insert(self._text_ends, places, ends)
            self._feeds = np.insert(self._feeds, places, feeds)
            added = np.frombuffer(b"".join([raw[s:e] for s, e, _ in spans]) + bytes(8), np.uint8)
            self._text = np.concatenate([self._text[:-8], added])
            spots = np.searchsorted(self._hashes, distinct)
        known = self._feeds[spots] == after_feed[at]
        known &= _equal(data, words.starts[at], words.ends[at], self._text, self._text_starts[spots], self._text_ends[spots])
        return spots, known

    def _whole(self, text: bytes) -> np.ndarray:
        if any(token in text for token in self._special):
            return np.array(self._tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4")
        return np.array(self._merges.encode_ordinary(text.decode()), "<u4")


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


class WindowPacker:
    """Online sum-of-squares packing of byte-coded ids; finished pieces are rows of ``SCHEMA``."""

    def __init__(self, window: int = WINDOW, first_id: int = 0) -> None:
        self.window = window
        self.next_id = first_id
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            self._close([(doc_id, start, ids[4 * start : 4 * (start + self.window)], total)])
        if whole < total:
            self._place((doc_id, whole, ids[4 * whole :], total))
        if self.n_open > MAX_OPEN:
            self.finish(last=False)

    def _place(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        levels, top = self.levels, self.window - size
        below, above = levels[: top + 1], levels[size:]
        # Change of the sum of squares when a window of level h becomes one of level h + size.
        change = np.where(below > 0, 2 * (above - below) + 2, np.iinfo(np.int64).max)
        change[0] = 2 * above[0] + 1
        if levels[top]:
            change[top] = 1 - 2 * levels[top]
        level = top - int(np.argmin(change[::-1]))
        if level:
            pieces = self.open[level].pop()
            levels[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        self._keep(pieces, level + size)

    def _keep(self, pieces: list[tuple], level: int) -> None:
        if level == self.window:
            self._close(pieces)
            return
        self.open.setdefault(level, []).append(pieces)
        self.levels[level] += 1
        self.n_open += 1

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            length = len(ids) // 4
            self.rows.append((doc_id, start, length, zlib.crc32(ids), total, self.next_id, offset))
            offset += length
        self.next_id += 1

    def finish(self, last: bool = True) -> None:
        """Cut the pieces of the open windows into full ones, and the rest at powers of two."""
        pieces = [piece for level in sorted(self.open, reverse=True) for pieces in self.open[level] for piece in pieces]
        left = sum(len(piece[2]) for piece in pieces) // 4
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        pieces.reverse()
        while left and (last or left >= self.window):
            room = min(self.window, 1 << (left.bit_length() - 1))
            left -= room
            taken = []
            while room:
                doc_id, start, ids, total = pieces.pop()
                if len(ids) > 4 * room:
                    pieces.append((doc_id, start + room, ids[4 * room :], total))
                    ids = ids[: 4 * room]
                room -= len(ids) // 4
                taken.append((doc_id, start, ids, total))
            self._close(taken)
        if left:
            self._keep(pieces[::-1], left)


def pack(
    docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, window: int = WINDOW
) -> DataFrame:
    """Pieces of all documents with their place in a window; ``tokenizer`` is the path of the vocabulary file."""
    end = np.array([end_id], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = WindowPacker(window, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for keys, texts in in_parts(batch):
                for key, ids in zip(keys, encode.encode(texts)):
                    packer.add(key, ids.tobytes() + end)
                while len(packer.rows) >= _ROWS_PER_BATCH:
                    yield rows(packer)
        packer.finish()
        while packer.rows:
            yield rows(packer)

    def in_parts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            keys.append(key)
            texts.append(text)
            size += len(texts[-1])
            if size > _BYTES_AT_ONCE:
                yield keys, texts
                keys, texts, size = [], [], 0
        yield keys, texts

    def rows(packer: WindowPacker) -> pa.RecordBatch:
        taken, packer.rows = packer.rows[:_ROWS_PER_BATCH], packer.rows[_ROWS_PER_BATCH:]
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        arrays = [pa.array(column, pa.int64()) for column in zip(*taken)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        packed, SCHEMA
    )
