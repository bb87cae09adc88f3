"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence matrix, pruned by sizes.

Sets x and y have a Jaccard similarity of at least t only if their overlap is at least t times the size of either. So

1. Shingles are hashed and dealt out by hash, in blocks; a block tells which of its n-grams two documents share at all,
   and each document's shared n-grams are summed over the blocks. A document of size n with fewer than t * n shared
   n-grams has no partner and leaves: most do. Only 32-bit hashes and row numbers move, compressed, once.
2. Of documents with equal sets one stays (the smallest id).
3. The sets of the rest are built in a second pass. Their n-grams are counted exactly, and each document puts forward
   its rarest ones, n - ceil(t * n) + 1 of them, less those that nobody shares: linked documents meet in one of these.
   Meetings are kept as stars, never as pairs, and connect documents to candidate groups.
4. Each candidate group is a sparse product in one task: overlap counts of a row with all others are accumulated from
   the postings of its n-grams, pairs out of the size bounds are left out, and rows already connected are not compared
   again. A group of more than a few rows is cut into bands of size, so that partners are in the same or the next band,
   and those into chunks, spread over tasks. A first round on the single chunks with common pivots connects most of a
   group of near copies; each row that is not with the group's main part then visits the chunks that hold a row with one
   of its rarest n-grams, and no others.
5. The stars of linked documents make the components.
6. Where links are to be counted (jaccard_links), step 4 is done once more over all pairs of a candidate group, connected
   or not; each set there stands for all rows that have it, and only sums of links leave a task.

Hashes only decide which documents meet; in step 4 the sets hold 64-bit hashes of whole shingles (built on 64-bit word
hashes), so two different shingles would have to collide within one candidate pair to change a result.

Defined results: null and wordless texts have an empty set, link with nothing and are their own component; a text with
fewer words than a shingle is one shingle; rows with the same doc_id are in one component; a null doc_id links with
nothing and has a null component; an empty table gives an empty result; only doc_id and text are read, other columns
are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from prismcat.llm.common import freed, read, worker_cache, written
from prismcat.llm.components import connected_components, union_find
from prismcat.llm.pieces import slices

#: Texts are shingled in slices of about so many bytes.
SLICE = 3_000_000
#: A block of step 1 is meant to hold so many n-grams.
BLOCK = 6_000_000
#: So many bytes of text are taken for an n-gram when the number of blocks is chosen.
WORD_BYTES = 6
#: More blocks than this there are not; beyond, they grow.
BLOCKS = 100_000
#: A task of step 4 holds at most about so many n-grams and so many documents.
TASK, TASK_ROWS = 1_000_000, 64
#: A task of step 6, which meets all pairs of chunks, holds so many n-grams.
PAIRS_TASK = 4_000_000
#: Documents of a band of an oversized group that every chunk of it is compared with first.
PIVOTS = 16
#: Bits of the filter that spares the second pass the sets of documents that have left.
FILTER_BITS = 1 << 25

_U = np.uint64
_SPACES = "\t\n\x0b\x0c\r"
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _M2
    h = (h ^ (h >> _U(27))) * _M3
    return h ^ (h >> _U(31))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, number of its text), without repeats in a text and in order of both."""
    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    for space in _SPACES:
        texts = pc.replace_substring(texts, space, " ")
    split = pc.split_pattern(texts, " ")
    numbered = split.flatten().dictionary_encode()
    distinct = numbered.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    full = np.fromiter((w != "" for w in distinct), bool, len(distinct))
    index = numbered.indices.to_numpy()
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    keep = full[index] if len(index) else np.zeros(0, bool)
    h, owner = hashes[index[keep]], owner[keep]
    sizes = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(sizes) - sizes
    n = len(h)
    mixed = np.zeros(max(0, n), np.uint64)
    for j in range(words):  # a shingle of the last words of a text runs into the next one and is dropped below
        part = np.zeros(n, np.uint64)
        part[: max(0, n - j)] = h[j:]
        mixed = (mixed * _M1) ^ _mix(part + _U(j + 1))
    mixed = _mix(mixed)
    whole = np.arange(n) - starts[owner] <= sizes[owner] - words
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    extra = np.fromiter((xxhash.xxh3_64_intdigest(h[starts[k] : starts[k] + sizes[k]].tobytes(), seed=int(sizes[k])) for k in short), np.uint64, len(short))
    mixed, owner = np.concatenate([mixed[whole], extra]), np.concatenate([owner[whole], short])
    order = np.lexsort((mixed, owner))
    mixed, owner = mixed[order], owner[order]
    new = np.ones(len(mixed), bool)
    new[1:] = (mixed[1:] != mixed[:-1]) | (owner[1:] != owner[:-1])
    return mixed[new], owner[new]


def least_overlap(n: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """ceil(t * n) for t = share[0] / share[1]."""
    return -(-n * share[0] // share[1])


_ROWS = "block int, slice long, kind int, ids array<bigint>, data binary"
DOCS, GRAMS, COUNTS = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    block, number, kind, ids, data = zip(*rows, strict=True) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int32()), pa.array(number, pa.int64()), pa.array(kind, pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(data, pa.binary())],
        names=["block", "slice", "kind", "ids", "data"],
    )


def _deal(words: int, blocks: int):
    """Step 1, by slice of texts: a row for its documents and a row of n-grams for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("n-grams")
        packer = zstandard.ZstdCompressor(level=1)
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                grams, owner = shingle_sets(batch.column("text"), words)
                n_docs = batch.num_rows
                sizes = np.bincount(owner, minlength=n_docs)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                none = np.zeros(1, np.uint64)
                sums = np.concatenate([none, np.cumsum(_mix(grams), dtype=np.uint64)])
                more = np.concatenate([none, np.cumsum(_mix(grams ^ _M1), dtype=np.uint64)])
                h1, h2 = sums[ends[1:]] - sums[ends[:-1]], more[ends[1:]] - more[ends[:-1]]
                # An n-gram that two documents of the slice share is sent once, marked as shared.
                order = np.argsort(grams, kind="stable")
                g, o = grams[order], owner[order]
                first = np.ones(len(g), bool)
                first[1:] = g[1:] != g[:-1]
                group = np.cumsum(first) - 1
                shared = np.bincount(group, minlength=1)[group] > 1 if len(g) else np.zeros(0, bool)
                known = np.bincount(o[shared], minlength=n_docs)
                docs = np.concatenate([a.astype("<i8").view(np.uint8) for a in (sizes, h1.view(np.int64), h2.view(np.int64), known)]) if n_docs else np.zeros(0, np.uint8)
                out = [(int((number ^ (number >> 32)) % blocks), number, DOCS, batch.column("doc_id").to_pylist(), packer.compress(docs.tobytes()))]
                sent = first  # of a shared one its first row, in place of all
                g, o, shared = g[sent], np.where(shared[sent], n_docs, o[sent]), shared[sent]
                place = (g >> _U(32)) % _U(blocks)
                by = np.argsort(place, kind="stable")  # hashes stay in order within a block
                g, o, place = (g[by] & _U(0xFFFFFFFF)).astype("<u4"), o[by].astype("<u4"), place[by].astype(np.int64)
                cuts = np.searchsorted(place, np.arange(blocks + 1))
                for b in range(blocks):
                    a, z = cuts[b], cuts[b + 1]
                    if z > a:
                        out.append((b, number, GRAMS, [n_docs], packer.compress(g[a:z].tobytes() + (o[a:z].astype("<u2") if n_docs < 65535 else o[a:z]).tobytes())))
                yield _rows(out)
                number += 1

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, by block: for each slice, how many of each document's n-grams another slice has too.

    An n-gram and its place in the block are one number of 64 bits, sorted where it lies: some 25 bytes an n-gram at most.
    """
    opener, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    found: dict[int, list[tuple[int, int, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        out = []
        for block, number, kind, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == DOCS:
                out.append((block, number, DOCS, ids, data))
                continue
            n_docs, data = ids[0], opener.decompress(data)
            width = 2 if n_docs < 65535 else 4
            n = len(data) // (4 + width)
            found.setdefault(block, []).append((number, n_docs, np.frombuffer(data, "<u4", n), np.frombuffer(data, f"<u{width}", n, 4 * n)))
        del batch
        if out:
            yield _rows(out)
    for block in list(found):
        slices_of = found.pop(block)
        starts = np.cumsum([0, *(len(g) for *_, g, _ in slices_of)])
        key = np.empty(starts[-1], np.uint64)
        for at, (*_, g, _) in zip(starts[:-1], slices_of, strict=True):
            part = key[at : at + len(g)]
            part[:] = g
            part <<= _U(32)
            part |= np.arange(at, at + len(g), dtype=np.uint64)
        key.sort()
        same = key[1:] ^ key[:-1] < _U(1 << 32)
        shared = np.zeros(len(key), bool)
        shared[1:] = same
        shared[:-1] |= same
        place = key[shared]
        del key, same, shared
        place &= _U(0xFFFFFFFF)
        place.sort()
        cuts = np.searchsorted(place, starts.astype(np.uint64))
        for k, (number, n_docs, _, owner) in enumerate(slices_of):
            own = owner[(place[cuts[k] : cuts[k + 1]] - _U(starts[k])).astype(np.int64)]
            counts = np.bincount(own, minlength=n_docs + 1)[:n_docs]
            if counts.any():
                yield _rows([(block, number, COUNTS, None, packer.compress(counts.astype("<u4").tobytes()))])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, by slice: one row per document with its size, the hashes of its set and its shared n-grams."""
    opener = zstandard.ZstdDecompressor()
    docs: dict[int, tuple[list, np.ndarray]] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, kind, ids, data in zip(*(batch.column(n).to_pylist() for n in ("slice", "kind", "ids", "data")), strict=True):
            data = opener.decompress(data)
            if kind == DOCS:
                docs[number] = ids, np.frombuffer(data, "<i8").reshape(4, -1)
            else:
                counts = np.frombuffer(data, "<u4").astype(np.int64)
                sums[number] = sums[number] + counts if number in sums else counts
    for number, (ids, (n, h1, h2, known)) in docs.items():
        shared = known + sums.get(number, np.int64(0))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(h1), pa.array(h2), pa.array(shared)], names=["doc_id", "n", "h1", "h2", "shared"])


def _sets(words: int, bits: np.ndarray):
    """Step 3: the sets of documents whose slot of the filter is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            slot = whole.column("slot").to_numpy()
            whole = whole.take(pa.array(np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)))
            for batch in slices(whole, "text", SLICE):
                grams, owner = shingle_sets(batch.column("text"), words)
                at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))])
                sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), sets], names=["id", "n", "grams"])

    return run


def _postings(sets: list[np.ndarray], sizes: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """Shared n-grams by row, rarest first, with each row's place and prefix; rows by n-gram, of all and of prefixes."""
    m = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    _, gram, count = np.unique(flat, return_inverse=True, return_counts=True)
    use = count[gram] > 1
    own, own_gram = owner[use], gram[use]
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    order = np.lexsort((rank[own_gram], own))
    own, own_gram = own[order], own_gram[order]
    in_row = np.searchsorted(own, np.arange(m + 1))
    by_gram = np.argsort(own_gram, kind="stable")
    postings, at = own[by_gram], np.searchsorted(own_gram[by_gram], np.arange(len(count) + 1))
    shared = np.diff(in_row)
    prefix = np.maximum(0, sizes - least_overlap(sizes, share) + 1 - (sizes - shared))
    head = np.arange(len(own)) - in_row[own] < prefix[own]
    heads = np.flatnonzero(head)
    by_head = heads[np.argsort(own_gram[heads], kind="stable")]
    head_rows, head_at = own[by_head], np.searchsorted(own_gram[by_head], np.arange(len(count) + 1))
    return own_gram, in_row, prefix, postings, at, head_rows, head_at


def local_links(sets: list[np.ndarray], share: tuple[int, int], side: np.ndarray | None = None, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (row numbers) that connect what is connected among some sets; rows of equal `known` are connected already.

    With side, only rows of different sides are compared. Rows are taken by size; each row's overlaps with all others
    are accumulated over postings, restricted by prefix and size, and only rows not yet connected to it are looked at.
    """
    num, den = share
    m = len(sets)
    sizes = np.asarray([len(s) for s in sets])
    if m < 2 or not sizes.sum():
        return []
    own_gram, in_row, prefix, postings, at, head_rows, head_at = _postings(sets, sizes, share)
    parent = np.arange(m)
    if known is not None:
        first: dict[int, int] = {}
        parent = np.asarray([first.setdefault(k, i) for i, k in enumerate(known)])
    links: list[tuple[int, int]] = []
    left = len(np.unique(parent))
    for i in np.argsort(sizes, kind="stable"):
        if left == 1:
            break
        front = own_gram[in_row[i] : in_row[i] + prefix[i]]
        if not len(front):
            continue
        met = np.unique(np.concatenate([head_rows[head_at[g] : head_at[g + 1]] for g in front]))
        met = met[(parent[met] != parent[i]) & (num * np.maximum(sizes[met], sizes[i]) <= den * np.minimum(sizes[met], sizes[i]))]
        if side is not None:
            met = met[side[met] != side[i]]
        if not len(met):
            continue
        if len(met) <= 4:
            overlap = np.asarray([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in met])
        else:
            all_rows = np.concatenate([postings[at[g] : at[g + 1]] for g in own_gram[in_row[i] : in_row[i + 1]]])
            overlap = np.bincount(all_rows, minlength=m)[met]
        for j in met[den * overlap >= num * (sizes[i] + sizes[met] - overlap)]:
            if parent[i] != parent[j]:
                links.append((int(i), int(j)))
                a, b = sorted((parent[i], parent[j]))
                parent[parent == b] = a
                left -= 1
    return links


def link_counts(sets: list[np.ndarray], share: tuple[int, int], copies: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """For each of some different sets the sum of copies over all others that it is linked with (of the other side)."""
    num, den = share
    m = len(sets)
    sizes = np.asarray([len(s) for s in sets])
    found = np.zeros(m, np.int64)
    if m < 2 or not sizes.sum():
        return found
    own_gram, in_row, prefix, postings, at, head_rows, head_at = _postings(sets, sizes, share)
    for i in range(m):
        front = own_gram[in_row[i] : in_row[i] + prefix[i]]
        if not len(front):
            continue
        met = np.unique(np.concatenate([head_rows[head_at[g] : head_at[g + 1]] for g in front]))
        met = met[(met != i) & (num * np.maximum(sizes[met], sizes[i]) <= den * np.minimum(sizes[met], sizes[i]))]
        if side is not None:
            met = met[side[met] != side[i]]
        if not len(met):
            continue
        if len(met) <= 4:
            overlap = np.asarray([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in met])
        else:
            all_rows = np.concatenate([postings[at[g] : at[g + 1]] for g in own_gram[in_row[i] : in_row[i + 1]]])
            overlap = np.bincount(all_rows, minlength=m)[met]
        found[i] = copies[met[den * overlap >= num * (sizes[i] + sizes[met] - overlap)]].sum()
    return found


def _set_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets with the two hashes that step 1 gives them."""
    for b in batches:
        sets = b.column("grams")
        values, bounds = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy()
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(v), dtype=np.uint64)]) for v in (values, values ^ _M1)]
        h1, h2 = ((x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), pa.array(h1), pa.array(h2), sets], names=["id", "n", "h1", "h2", "grams"])


def _count_links(share: tuple[int, int]):
    """Step 6, by task: rows come sorted by task; the links of each set that has any."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        sides = np.asarray([r[4] for r in rows])
        found = link_counts([r[5] for r in rows], share, np.asarray([r[3] for r in rows]), None if (sides == 0).all() else sides)
        has = np.flatnonzero(found)
        keys = [pa.array([rows[k][c] for k in has], pa.int64()) for c in range(3)]
        return pa.RecordBatch.from_arrays([*keys, pa.array(found[has])], names=["n", "h1", "h2", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            sets = b.column("grams")
            values, bounds = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy()
            columns = [b.column(c).to_pylist() for c in ("comp", "a", "b", "n", "h1", "h2", "copies", "side")]
            for k, (comp, x, y, *row) in enumerate(zip(*columns, strict=True)):
                if (comp, x, y) != now:
                    if len(rows) > 1:
                        yield solve(rows)
                    now, rows = (comp, x, y), []
                rows.append((*row, values[bounds[k] : bounds[k + 1]].copy()))
        if len(rows) > 1:
            yield solve(rows)

    return run


def _links_of(sets: DataFrame, alike: DataFrame, groups: DataFrame, share: tuple[int, int], task: int) -> DataFrame:
    """n, h1, h2 of a set and its links with rows of other sets. All pairs of chunks of a group are tasks."""
    keyed = sets.mapInArrow(freed(_set_hashes), "id long, n long, h1 long, h2 long, grams array<bigint>")
    keyed = keyed.join(alike.select(F.col("rep").alias("id"), "n", "h1", "h2", "copies"), ["id", "n", "h1", "h2"]).dropDuplicates(["id", "n", "h1", "h2"])
    placed = written(sets.sparkSession, keyed.join(groups, "id"), "placed")
    weights = placed.groupBy("comp").agg(F.sum("n").alias("weight"), F.count("*").alias("many")).where("many > 1")
    chunks = F.when(F.col("weight") <= task, 1).otherwise(F.ceil(F.col("weight") * 2 / task)).cast("int")
    rows = placed.join(weights, "comp").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "h1", "h2"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"a": F.least("chunk", "other"), "b": F.greatest("chunk", "other")})
    rows = rows.withColumn("side", F.when(F.col("a") == F.col("b"), 0).when(F.col("chunk") == F.col("a"), 1).otherwise(2))
    key = ["comp", "a", "b"]
    tasks = rows.select(*key, "n", "h1", "h2", "copies", "side", "grams").repartition(*key).sortWithinPartitions(*key)
    found = tasks.mapInArrow(freed(_count_links(share)), "n long, h1 long, h2 long, links long")
    return written(sets.sparkSession, found.groupBy("n", "h1", "h2").agg(F.sum("links").alias("links")), "counted")


def _join(share: tuple[int, int]):
    """Step 4, by task: rows come sorted by task; a task's links leave as stars."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        ids = [r[0] for r in rows]
        sets = [np.asarray(r[1]).view(np.uint64) for r in rows]
        sides = np.asarray([r[2] for r in rows])
        known = [r[3] for r in rows]
        links = local_links(sets, share, None if (sides == 0).all() else sides, known if known[0] is not None else None)
        # one doc_id may stand for several texts, so stars are made of ids
        found = union_find((ids[i], ids[j]) for i, j in links)
        return [(u, v) for u, v in found.items() if u != v]

    def batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            sets = b.column("grams")
            values, bounds = sets.values.to_numpy(), sets.offsets.to_numpy()
            columns = [b.column(n).to_pylist() for n in ("comp", "a", "b", "id", "side", "known")]
            for k, (comp, x, y, id_, side, known) in enumerate(zip(*columns, strict=True)):
                if (comp, x, y) != now:
                    if len(rows) > 1:
                        yield batch(solve(rows))
                    now, rows = (comp, x, y), []
                rows.append((id_, values[bounds[k] : bounds[k + 1]].copy(), side, known))
        if len(rows) > 1:
            yield batch(solve(rows))

    return run


def _solve(tasks: DataFrame, share: tuple[int, int]) -> DataFrame:
    """tasks: comp, a, b (the task), id, grams, side, known."""
    key = ["comp", "a", "b"]
    order = tasks.select(*key, "id", "grams", "side", "known").repartition(*key).sortWithinPartitions(*key, "id")
    return order.mapInArrow(freed(_join(share)), "u long, v long")


def jaccard_links(docs: DataFrame, **parameters) -> DataFrame:
    """What jaccard_components returns, and n_links: the number of other rows with an id that each row is linked with."""
    return jaccard_components(docs, count=True, **parameters)


def jaccard_components(
    docs: DataFrame, *, words: int = 3, share: tuple[int, int] = (9, 10), task: int = TASK, rows: int = TASK_ROWS, block: int = BLOCK, pairs: int = PAIRS_TASK, count: bool = False
) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text); linked at Jaccard >= share[0] / share[1].

    With count, n_links too.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(BLOCKS, size // (WORD_BYTES * block)))
    info = written(
        spark,
        texts.mapInArrow(freed(_deal(words, blocks)), _ROWS)
        .repartitionById(blocks, F.col("block"))
        .mapInArrow(freed(_count), _ROWS)
        .repartition("slice")
        .mapInArrow(freed(_sum), "doc_id long, n long, h1 long, h2 long, shared long"),
        "sizes",
    )
    equal = info.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("shared").alias("shared"), *[F.count("*").alias("copies")] * count)
    alike = written(spark, equal, "alike")  # apart from the join below, whose hot keys can then be split
    stay = written(spark, alike.where(f"shared * {share[1]} >= n * {share[0]}").select("rep", "n", "h1", "h2"), "stay")

    # The sets of the documents that stay. The filter's size is fixed; what it lets through in error the join drops.
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("int")
    words_set = stay.select(slot("rep").alias("s")).groupBy(F.expr("s div 8").alias("byte")).agg(F.expr("bit_or(shiftleft(1, s % 8))").alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    bits[words_set["byte"].to_numpy(np.int64)] = words_set["bits"].to_numpy(np.int64).astype(np.uint8)
    passed = texts.where("doc_id is not null").withColumn("slot", slot("doc_id")).mapInArrow(freed(_sets(words, bits)), "id long, n long, grams array<bigint>")
    sets = written(spark, passed.join(stay.select(F.col("rep").alias("id"), "n").distinct(), ["id", "n"], "left_semi"), "sets")

    # The rarest n-grams of each document that stays, as far as others have them; documents meet in them.
    grams = sets.select("id", "n", F.explode("grams").alias("gram"))
    counts = written(spark, grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    known = grams.join(counts, "gram")
    by_rarity = W.partitionBy("id", "n").orderBy("df", "gram")
    whole = W.partitionBy("id", "n")
    ranked = known.withColumn("place", F.row_number().over(by_rarity)).withColumn("common", F.count("*").over(whole))
    ahead = ranked.where(f"place <= n - ceil(n * {share[0]} / {share[1]}) + 1 - (n - common)").select("gram", "id")
    ahead = written(spark, ahead, "prefixes")
    centres = written(spark, ahead.groupBy("gram").agg(F.min("id").alias("centre"), F.count("*").alias("many")).where("many > 1"), "centres")
    meetings = ahead.join(centres, "gram").where("id <> centre").select("id", "centre").distinct()
    groups = connected_components(meetings).withColumnRenamed("component", "comp")

    # Linked sets are in the same band or in neighbouring ones: a band is as wide as the size bound, and a little more.
    width = math.log(share[1] / share[0]) * (1 + 1e-9) if share[0] < share[1] else 1.0
    placed = sets.join(groups, "id").withColumn("band", F.floor(F.log("n") / width).cast("long"))
    bands = placed.groupBy("comp", "band").agg(F.sum("n").alias("weight"), F.count("*").alias("many"))
    bands = bands.withColumn("chunks", F.greatest(F.ceil(F.col("weight") * 2 / task), F.ceil(F.col("many") / rows)).cast("int"))
    whole = bands.groupBy("comp").agg(F.sum("weight").alias("weight"), F.sum("many").alias("many")).where("many > 1")
    bands = written(spark, bands.join(whole.select("comp", ((F.col("weight") <= task) & (F.col("many") <= rows)).alias("fits")), "comp"), "bands")
    zero, nothing = F.lit(0).cast("long"), F.lit(None).cast("long")
    small = placed.join(bands.where("fits").select("comp").distinct(), "comp").select("comp", zero.alias("a"), zero.alias("b"), "id", "grams", zero.alias("side"), nothing.alias("known"))
    links = written(spark, _solve(small, share), "links")
    large = bands.where("not fits").select("comp", "band", "chunks")
    if large.head(1):
        links = links.unionByName(_large_groups(placed, large, ahead, share, rows))
    same = info.where("n > 0 and doc_id is not null").join(alike.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"]).select("doc_id", "rep")
    # Different texts under one doc_id are one document: their representatives are linked through the id.
    several = same.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    through = same.join(several.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    comps = connected_components(links.unionByName(through)).withColumnRenamed("id", "rep").withColumnRenamed("component", "linked")
    linked = same.join(comps, "rep", "left").select("doc_id", F.coalesce("linked", "rep").alias("component_id"))
    by_doc = linked.distinct()
    rest = info.select("doc_id", F.col("n").alias("n_shingles"))
    if count:
        counted = alike.select("n", "h1", "h2", "copies").join(_links_of(sets, alike, groups, share, pairs), ["n", "h1", "h2"], "left")
        n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
        rest = info.join(counted, ["n", "h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(n_links, F.lit(0)).alias("n_links"))
    columns = ["doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *["n_links"] * count]
    return rest.join(by_doc, "doc_id", "left").select(*columns)


def _large_groups(placed: DataFrame, bands: DataFrame, ahead: DataFrame, share: tuple[int, int], limit: int) -> DataFrame:
    """Links of groups too large for one task, as stars.

    placed: comp, band, id, n, grams; bands: comp, band, chunks of the large groups; ahead: gram, id of each document's
    rarest n-grams. No step has a task, a window or an aggregate that a whole group must pass through.
    """
    spark = placed.sparkSession
    chunk = F.pmod(F.xxhash64(F.lit(3), "id", "n"), F.col("chunks")).cast("long")
    rows = written(spark, placed.join(bands, ["comp", "band"]).withColumn("chunk", chunk).select("comp", "band", "chunk", "chunks", "id", "n", "grams"), "chunks")
    zero, nothing = F.lit(0).cast("long"), F.lit(None).cast("long")
    place = F.col("band") * (1 << 40) + F.col("chunk")
    columns = ["comp", "a", "b", "id", "grams", "side", "known"]
    # Pivots: some candidates of each chunk, then the first of them by hash.
    light = rows.select("comp", "band", "chunk", "chunks", "id", "n")
    candidate = F.min(F.struct(F.xxhash64(F.lit(4), "id", "n").alias("h"), "id", "n")).alias("p")
    candidates = light.groupBy("comp", "band", "chunk", F.pmod(F.xxhash64(F.lit(5), "id", "n"), F.lit(4)).alias("quarter")).agg(candidate)
    ranked = candidates.withColumn("r", F.row_number().over(W.partitionBy("comp", "band").orderBy("p")))
    pivots = ranked.where(F.col("r") <= PIVOTS).select("comp", F.col("band").alias("home"), F.col("chunk").alias("own"), "p.id", "p.n")
    # at most PIVOTS rows a band, so this is small beside the rows themselves
    near = pivots.withColumn("band", F.explode(F.array(F.col("home") - 1, F.col("home"), F.col("home") + 1))).join(bands, ["comp", "band"])
    near = near.withColumn("chunk", F.explode(F.sequence(zero, F.col("chunks").cast("long") - 1))).where("band <> home or chunk <> own")
    visiting = near.select("comp", "band", "chunk", "id", "n").join(rows.select("id", "n", "grams"), ["id", "n"])
    both = rows.select("comp", "band", "chunk", "id", "grams").unionByName(visiting.select("comp", "band", "chunk", "id", "grams"))
    first = both.select("comp", place.alias("a"), zero.alias("b"), "id", "grams", zero.alias("side"), nothing.alias("known"))
    links = written(spark, _solve(first, share), "links")
    now = written(spark, light.join(connected_components(links), "id", "left").withColumn("known", F.coalesce("component", "id")).drop("component"), "known")
    main = now.groupBy("comp", "known").agg(F.count("*").alias("size")).groupBy("comp").agg(F.max_by("known", F.struct("size", -F.col("known"))).alias("main"))
    left = written(spark, now.join(main, "comp").where("known <> main").select("comp", "band", "id", "n", "known"), "left")
    if not left.head(1):
        return links
    # Linked documents share one of their rarest n-grams, so a row need only visit the chunks where one of its own is.
    open_groups = left.select("comp").distinct()
    holders = now.join(open_groups, "comp").join(ahead, "id").select("gram", F.col("band").alias("at"), "chunk").distinct()
    met = left.join(ahead, "id").join(holders, "gram").where("at between band - 1 and band + 1")
    visits = written(spark, met.select("comp", F.col("at").alias("band"), "chunk", "id", "n", "known").distinct(), "visits")
    tables = visits.groupBy("comp", "band", "chunk").agg(F.ceil(F.count("*") / limit).cast("long").alias("parts"))
    one, two = F.lit(1).cast("long"), F.lit(2).cast("long")
    guests = visits.join(tables, ["comp", "band", "chunk"]).withColumn("b", F.pmod(F.xxhash64(F.lit(6), "id", "n"), F.col("parts"))).drop("parts")
    guests = guests.join(rows.select("id", "n", "grams"), ["id", "n"]).withColumns({"a": place, "side": one}).select(*columns)
    hosts = rows.join(tables, ["comp", "band", "chunk"]).withColumn("b", F.explode(F.sequence(zero, F.col("parts") - 1)))
    hosts = hosts.join(now.select("id", "n", "known").distinct(), ["id", "n"]).withColumns({"a": place, "side": two}).select(*columns)
    return links.unionByName(written(spark, _solve(guests.unionByName(hosts), share), "links"))


def keep_one(docs: DataFrame, *, words: int = 5, share: tuple[int, int] = (8, 10)) -> DataFrame:
    """docs without near copies: of each group of linked documents the one with the smallest doc_id stays.

    Rows that repeat both doc_id and text are one document. Documents without words and rows without an id link with
    nothing, so all of them stay.
    """
    groups = jaccard_components(docs, words=words, share=share)
    gone = groups.where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    stay = docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    again = written(docs.sparkSession, docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if not again.head(1):
        return stay
    once = stay.join(again, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    return once.unionByName(stay.join(again, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]).dropDuplicates(["doc_id", "text"]))


def op5(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def op5_links(spark, sf_dir: str) -> DataFrame:
    return jaccard_links(read(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [list_aggregate(ws, 'string_agg', ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) END AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n, CASE WHEN len(grams) > 0 THEN md5(list_aggregate(list_sort(grams), 'string_agg', chr(1))) END AS h FROM s),
reps AS (SELECT h, n, min(doc_id) AS rep FROM n WHERE n > 0 GROUP BY h, n),
g AS (SELECT rep, n.n, unnest(grams) AS gram FROM reps JOIN n ON n.doc_id = reps.rep JOIN s ON s.doc_id = reps.rep),
l AS (
  SELECT a.rep AS u, b.rep AS v FROM g a JOIN g b ON a.gram = b.gram AND a.rep <> b.rep AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT rep AS u, rep AS c FROM reps UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.u),
comp AS (SELECT u, min(c) AS c FROM r GROUP BY u)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(comp.c, n.doc_id) AS component_id
FROM n LEFT JOIN reps ON reps.h = n.h AND reps.n = n.n LEFT JOIN comp ON comp.u = reps.rep
"""
