"""BPE encoding by a segment tree over adjacent pair ranks, and decoding.

A word is a row of leaves, one per adjacent pair, each holding the pair's merge rank (or NONE); every inner node holds
the smaller of its children. The root is the lowest rank, and walking down to the left child on ties finds its leftmost
pair. A merge changes at most three leaves, each updated along one path to the root, until the root is NONE: a word of n
symbols takes O(n log n), however long it is. Words repeat, so each worker keeps the ids of the words it has seen, in a
table of bounded size.

Everything around the merges follows the tokenizer file: special tokens are cut out of the raw text first, then the
text is normalised, lower-cased, cut into words by the file's pattern and written in the byte alphabet (for anything
but ASCII with the library's normaliser and cutter, so that both know the same Unicode); the word-end mark belongs to a
word's last symbol.

Defined results: a null or empty text has no ids and decodes to the empty string; repeated rows get the same ids; an
empty table gives an empty result; further columns pass through, those with the operator's own names (ids, n_tokens,
decoded) are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T
from tokenizers import Tokenizer

from prismcat.llm.common import give_back, read, worker_cache
from prismcat.llm.pieces import LONGEST, PieceCache, slices

NONE = 1 << 30
#: Words in the byte alphabet whose ids a worker keeps, and entries of its PieceCache.
WORDS_KEPT, TABLE = 100_000, 600_000
#: Texts are handled in slices of about so many bytes.
SLICE = 2_000_000

def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: itself where printable, else the next of U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class SegmentTree:
    """Minimum over leaves with point updates; `first_lowest` is the leftmost leaf that holds the minimum."""

    __slots__ = ("leaves", "tree")

    def __init__(self, values: list[int]):
        n = 1
        while n < len(values):
            n *= 2
        self.leaves = n
        tree = [NONE] * n + values + [NONE] * (n - len(values))
        for i in range(n - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b
        self.tree = tree

    @property
    def lowest(self) -> int:
        return self.tree[1]

    def first_lowest(self) -> int:
        tree, i = self.tree, 1
        low = tree[1]
        while i < self.leaves:
            i *= 2
            if tree[i] != low:
                i += 1
        return i - self.leaves

    def update(self, k: int, value: int) -> None:
        tree, i = self.tree, k + self.leaves
        tree[i] = value
        i //= 2
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a <= b else b
            if tree[i] == low:
                return
            tree[i] = low
            i //= 2


class Bpe:
    """A tokenizer file of the word-end kind, read as data; encodes and decodes like the library that owns the format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.unknown = self.vocab.get(model.get("unk_token") or "")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        alphabet = byte_alphabet()
        self.alphabet = [alphabet[b] for b in range(256)]
        library = Tokenizer.from_file(path)
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        self.words: dict[str, list[int]] = {}
        if any(re.search(r"\s", t) for t in self.added):
            raise ValueError("special tokens with white space are not supported")
        self.pieces = PieceCache(lambda words: [np.asarray(self.encode(w), "<u4").tobytes() for w in words], TABLE)

    def merge(self, ids: list[int]) -> list[int]:
        """Applies the lowest-ranked merge, leftmost first, until no adjacent pair is mergeable."""
        n = len(ids)
        if n < 2:
            return ids
        merges, ranks = self.merges, []
        none = (NONE, -1)
        for k in range(n - 1):
            ranks.append(merges.get((ids[k], ids[k + 1]), none)[0])
        tree = SegmentTree(ranks)
        ids = list(ids)
        after = list(range(1, n + 1))  # the next living symbol; n: none
        before = list(range(-1, n - 1))
        while tree.lowest != NONE:
            k = tree.first_lowest()
            right = after[k]
            ids[k] = merges[ids[k], ids[right]][1]
            ids[right] = -1
            far = after[right]
            after[k] = far
            if far < n:
                before[far] = k
                tree.update(k, merges.get((ids[k], ids[far]), none)[0])
            else:
                tree.update(k, NONE)
            tree.update(right, NONE) if right < n - 1 else None
            left = before[k]
            if left >= 0:
                tree.update(left, merges.get((ids[left], ids[k]), none)[0])
        return [i for i in ids if i >= 0]

    def word(self, word: str) -> list[int]:
        """Ids of a word in the byte alphabet."""
        found = self.words.get(word)
        if found is None:
            symbols = list(word)
            symbols[-1] += self.suffix
            ids = [self.vocab.get(s, self.unknown) for s in symbols]
            found = self.merge([i for i in ids if i is not None])
            if len(word) <= LONGEST:
                if len(self.words) >= WORDS_KEPT:
                    self.words.clear()
                self.words[word] = found
        return found

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        if text.isascii():
            alphabet = self.alphabet
            words = ["".join([alphabet[b] for b in w.encode("ascii")]) for w in self.pattern.findall(text.lower())]
        else:  # the library's own Unicode tables decide what is a letter and its lower case
            words = [w for w, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        out: list[int] = []
        for word in words:
            out += self.word(word)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text: those of its special tokens and of what stands between them."""
        if not text:
            return []
        out: list[int] = []
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += self.plain(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self.plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by one space, as where the file names no decoder; unknown ids are left out."""
        get = self.tokens.get
        return " ".join([t for t in map(get, ids) if t is not None])


def tokenizer(path: str, table: int = TABLE) -> Bpe:
    """One per worker and file, with a table of at most so many words."""
    kept = worker_cache("bpe")
    if path not in kept:
        kept[path] = Bpe(path)
        give_back()  # what reading the file took
    kept[path].pieces.limit = table
    return kept[path]


def _columns(batch: pa.RecordBatch, own: tuple[str, ...]) -> dict[str, pa.Array]:
    return {n: batch.column(k) for k, n in enumerate(batch.schema.names) if n not in own}


def bpe_round_trip(docs: DataFrame, path: str, *, digests_only: bool = False, table: int = TABLE) -> DataFrame:
    """docs with ids array<int>, n_tokens and decoded; or, with digests_only, n_tokens, ids_sha256 and decoded_sha256.

    One pass without a shuffle; a batch's rows are handled in slices, so memory is bounded by the longest texts.
    """
    own = ("n_tokens", "ids_sha256", "decoded_sha256") if digests_only else ("ids", "n_tokens", "decoded")
    kept = [f for f in docs.schema.fields if f.name not in own and not (digests_only and f.name == "text")]
    new = [T.StructField("n_tokens", T.LongType())]
    new += [T.StructField(n, T.StringType()) for n in own[1:]] if digests_only else [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, table)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                flat, at = bpe.pieces.encode(batch.column("text"))
                ids = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                columns = [batch.column(n) for n in names] + [pa.array([len(x) for x in ids], pa.int64())]
                decoded = [bpe.decode(x.tolist()) for x in ids]
                if digests_only:
                    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
                    columns += [pa.array([sha(" ".join(map(str, x.tolist()))) for x in ids], pa.string()), pa.array([sha(s) for s in decoded], pa.string())]
                else:
                    columns += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32))), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *[f.name for f in new]])

    return docs.select(*[f"`{n}`" for n in dict.fromkeys([*names, "text"])]).mapInArrow(run, T.StructType([*kept, *new]))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_round_trip(docs, default_path(), digests_only=True)
