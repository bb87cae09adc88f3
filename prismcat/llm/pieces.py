"""Encoding of many texts by way of a bounded table of the words that a worker has seen.

A tokenizer that drops white space and never looks across it gives a text the ids of its pieces (runs without ASCII
white space) in order. Where a letter meets an ASCII mark or digit is a boundary for it too, unless the mark is an
apostrophe; pieces with "<" stay whole, since special tokens may be in them, and so do those with the one letter whose
lower case ends in a mark (U+0130). Arrow cuts a batch of texts into pieces,
the distinct pieces into words, and numbers the distinct words; only these reach Python, those that the table lacks go
to the tokenizer, and the ids of all texts are gathered in one go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most entries of the table (about 200 bytes each); longer words than LONGEST leave with their batch.
WORDS, LONGEST = 600_000, 64
#: Texts are handled in slices of about so many bytes.
SLICE = 6_000_000
#: ASCII marks and digits but "'" and "<".
_MARK = r"([!-&(-;=-@\[-`{-~])"


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `limit` bytes of text, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit)))
        yield batch.slice(at, to - at)
        at = to


def gather(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs number order[0], order[1], ... of flat, which holds runs of these sizes; and where each ends."""
    starts = np.cumsum(sizes) - sizes
    lengths = sizes[order]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[order] - (ends - lengths), lengths) + np.arange(total)], ends


def _lists(lists: pa.ListArray) -> np.ndarray:
    return lists.offsets.to_numpy() - lists.offsets[0].as_py()


class PieceCache:
    """encode_words: ids (little-endian uint32) of each of some strings, as the tokenizer gives them for each alone."""

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], limit: int = WORDS):
        self.encode_words, self.limit = encode_words, limit
        self.words: dict[str, bytes] = {"": b""}

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, from the table or the tokenizer."""
        table = self.words
        new = [w for w in words if w not in table]
        if new:
            if len(table) + len(new) > self.limit:
                self.words = table = {"": b""}
                new = [w for w in words if w]
            table.update((w, ids) for w, ids in zip(new, self.encode_words(new), strict=True))
        found = [table[w] for w in words]
        for w in new:
            if len(w) > LONGEST:
                del table[w]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) of the texts in a row, and where each text's begin, with the end; nulls have none."""
        texts = pc.fill_null(texts, "")
        for space in "\n\t\r":
            texts = pc.replace_substring(texts, space, " ")
        split = pc.split_pattern(texts, " ")
        pieces = split.flatten().dictionary_encode()
        whole = pieces.dictionary
        cut = pc.ascii_lower(whole)
        for first, second in ((r"(\pL)", _MARK), (_MARK, r"(\pL)")):
            cut = pc.replace_substring_regex(cut, first + second, r"\1 \2")
        parts = pc.split_pattern(pc.if_else(pc.match_substring_regex(whole, "[<İ]"), whole, cut), " ")
        words = parts.flatten().dictionary_encode()
        found = self._ids_of(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        by_piece, ends = gather(np.frombuffer(b"".join(found), "<u4"), sizes, words.indices.to_numpy())
        sizes = np.diff(np.concatenate([[0], ends])[_lists(parts)])
        ids, ends = gather(by_piece, sizes, pieces.indices.to_numpy())
        return ids, np.concatenate([[0], ends])[_lists(split)]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, at = self.encode(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
