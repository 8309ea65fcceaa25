"""Benchmark decontamination with suffix arrays over the training texts.

Each run of documents that a task holds is a shard. Its word sequence gets a suffix
array, every suffix of every test item is binary-searched in it, and what is found
is extended to the longest verbatim match. Words outside the items' vocabulary end
any match, so only suffixes that begin with enough vocabulary words to fill the
shortest window are sorted; leaving out the others loses nothing. The array is
sorted as deep as a window, which is all that the searches compare.

Words are compared by 64-bit hashes. Test items come to the workers in blocks of at
most `block_bytes` bytes of text, so what is broadcast has a bound; more items mean
more passes, and an item that is larger alone is a block of its own, which the driver
must hold. There is no shuffle.

Defined results: a null or empty text has no words and is clean; an item without
words matches nothing; items without an id count as hits but are in no list of ids;
items that share an id count once; ids are whole numbers; equal rows give equal
results; an empty benchmark leaves all clean. Other columns stay; `annotate` replaces
columns named like added ones, `decontaminate` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm._io import free_name
from webstrata.llm._text import ALNUM, LOWER, column, flat, list_array, slices, word_hashes, words

WINDOW = 13
SHARD_BYTES = 8 << 20
#: Occurrences of item suffixes that are listed at a time.
AT_ONCE = 1 << 20
#: Stands for an item without an id while items are searched.
NO_ID = -(1 << 63)
MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("item_word", T.LongType()), T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.LongType())])
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.LongType(), True)),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("matches", T.ArrayType(MATCH, True)),
    ]
)


@dataclass
class Tests:
    """A block of items: vocabulary, the words of all items in a row, and the suffixes to search."""

    vocab: np.ndarray
    ids: np.ndarray
    item: list[int]
    item_of: np.ndarray
    left: np.ndarray
    at: np.ndarray
    width: np.ndarray
    first: np.ndarray
    window: int


def tests_of(items: list[tuple[int, str | None]], window: int = WINDOW) -> Tests:
    texts = pa.array([t or "" for _, t in items], pa.large_string())
    data, offs = flat(texts)
    data = LOWER[data]
    s, e, by = words(data, offs, ALNUM)
    h = word_hashes(data, s, e)
    vocab = np.unique(h)
    ids = (np.searchsorted(vocab, h) + 1).astype(np.int64)
    counts = np.diff(by)
    item_of = np.repeat(np.arange(len(items)), counts)
    left = np.repeat(by[1:], counts) - np.arange(len(ids))
    size = np.repeat(counts, counts)
    begins = (left >= window) | ((size < window) & (left == size))
    at = np.flatnonzero(begins)
    width = np.minimum(window, size[at])
    short = np.unique(ids[at[width < window]])
    first = np.zeros(len(vocab) + 1, bool)
    first[short] = True
    return Tests(vocab, ids, [i for i, _ in items], item_of, left, at, width, first, window)


def _search(col: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """For each i the place of want[i] in the sorted run col[lo[i]:hi[i]]."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        v = col[np.minimum(mid, len(col) - 1)]
        up = open_ & ((v <= want) if right else (v < want))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)


def search_shard(hashes: np.ndarray, by: np.ndarray, t: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the shard, place in the items, words matched) of all longest matches.

    hashes: of the shard's words; by: how many words come before each document.
    """
    none = np.zeros(0, np.int64)
    n = len(hashes)
    if not n or not len(t.at):
        return none, none, none
    place = np.minimum(np.searchsorted(t.vocab, hashes), len(t.vocab) - 1)
    ids = np.where(t.vocab[place] == hashes, place + 1, 0)
    # run: vocabulary words from here on, within the document
    stop = np.full(n, n, np.int64)
    zero = np.flatnonzero(ids == 0)
    stop[zero] = zero
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    ends = np.repeat(by[1:], np.diff(by))
    run = np.minimum(stop, ends) - np.arange(n)
    keep = np.flatnonzero((run >= t.window) | (t.first[ids] & (run > 0)))
    if not len(keep):
        return none, none, none
    # the suffix array: kept suffixes in the order of their first `window` words
    padded = np.concatenate([ids, np.zeros(t.window, ids.dtype)])
    cols = [np.where(run[keep] > k, padded[keep + k], 0) for k in range(t.window)]
    order = np.lexsort(cols[::-1])
    sa, cols = keep[order], [c[order] for c in cols]
    lo, hi = np.zeros(len(t.at), np.int64), np.full(len(t.at), len(sa), np.int64)
    for k in range(t.window):
        on = np.flatnonzero((t.width > k) & (lo < hi))
        if not len(on):
            break
        want = t.ids[t.at[on] + k]
        a = _search(cols[k], lo[on], hi[on], want, False)
        b = _search(cols[k], lo[on], hi[on], want, True)
        lo[on], hi[on] = a, b
    found = np.maximum(hi - lo, 0)
    starts = np.repeat(by[:-1], np.diff(by))
    new_item = np.ones(len(t.ids), bool)
    new_item[1:] = t.item_of[1:] != t.item_of[:-1]
    # occurrences are listed some at a time; what can be extended to the left is part of a longer match
    kept: list[tuple[np.ndarray, ...]] = []
    sums = np.concatenate([[0], np.cumsum(found)])
    first = 0
    while first < len(found):
        last = max(first + 1, int(np.searchsorted(sums, sums[first] + AT_ONCE, "right")) - 1)
        n_each = found[first:last]
        q = np.repeat(np.arange(first, last), n_each)
        if len(q):
            p = sa[np.repeat(lo[first:last], n_each) + np.arange(len(q)) - np.repeat(np.cumsum(n_each) - n_each, n_each)]
            i = t.at[q]
            outer = ~((p > starts[p]) & ~new_item[i] & (ids[p - 1] == t.ids[i - 1]))
            kept.append((p[outer], i[outer], t.width[q[outer]].astype(np.int64)))
        first = last
    if not kept:
        return none, none, none
    p, i, length = (np.concatenate([k[j] for k in kept]) for j in range(3))
    room = np.minimum(run[p], t.left[i])
    grow = np.flatnonzero(length < room)
    while len(grow):
        same = ids[p[grow] + length[grow]] == t.ids[i[grow] + length[grow]]
        grow = grow[same]
        length[grow] += 1
        grow = grow[length[grow] < room[grow]]
    return p, i, length


def _shard(part: pa.RecordBatch, text: str, t: Tests, before: str | None) -> list[pa.Array]:
    data, offs = flat(column(part, text))
    data = LOWER[data]
    s, e, by = words(data, offs, ALNUM)
    p, i, length = search_shard(word_hashes(data, s, e), by, t)
    doc = np.searchsorted(by, p, "right") - 1
    item = np.array(t.item, np.int64)[t.item_of[i]] if len(i) else np.zeros(0, np.int64)
    first_word = np.zeros(len(t.ids) + 1, np.int64)
    if len(i):
        first_word = np.searchsorted(t.item_of, t.item_of[i])
        item_word = i - first_word
    else:
        item_word = np.zeros(0, np.int64)
    n = np.diff(by)
    if before:
        old = column(part, before)
        flat_old = old.flatten()
        doc = np.concatenate([doc, np.repeat(np.arange(len(n)), np.asarray(old.value_lengths().fill_null(0)))])
        get = lambda k, x: np.concatenate([x, np.asarray(flat_old.field(k).fill_null(NO_ID), np.int64)])
        item, item_word, length = get(0, item), get(1, item_word), get(3, length)
        p = np.concatenate([p, np.asarray(flat_old.field(2), np.int64) + by[doc[len(p) :]]])
    cover = np.zeros(len(s) + 1, np.int64)
    np.add.at(cover, p, 1)
    np.add.at(cover, p + length, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    n_hit = hit[by[1:]] - hit[by[:-1]]
    order = np.lexsort((item_word, item, p))
    doc, item, item_word, p, length = doc[order], item[order], item_word[order], p[order], length[order]
    pairs = sorted({(d, str(x), x) for d, x in zip(doc.tolist(), item.tolist(), strict=True) if x != NO_ID})
    ids = list_array(pa.array([x for _, _, x in pairs], pa.int64()), np.bincount([d for d, _, _ in pairs], minlength=len(n)) if pairs else np.zeros(len(n), int))
    order = np.argsort(doc, kind="stable")
    rows = pa.StructArray.from_arrays([pa.array(item[order], pa.int64(), mask=item[order] == NO_ID), *(pa.array(x[order], pa.int64()) for x in (item_word, p - by[doc], length))], [f.name for f in MATCH])
    matches = list_array(rows, np.bincount(doc, minlength=len(n)) if len(doc) else np.zeros(len(n), int))
    return [pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), ids, pa.array((n_hit > 0) & (20 * n_hit >= n), pa.bool_()), matches]


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int, window: int) -> Iterator[Tests]:
    rows = benchmark.select(F.col(f"`{item}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = 1 + int(total // block_bytes)
    for k in range(n):
        # hashes spread items evenly; half as much again is the most that a block is meant to hold
        got = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).distinct().collect()
        yield tests_of(sorted((NO_ID if r["i"] is None else r["i"], r["t"]) for r in got), window)


def annotate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = 8 << 20, keep_text: bool = True) -> DataFrame:
    """The rows with `n_words`, `n_hit`, `items`, `contaminated` and all longest `matches`."""
    added = [f.name for f in ADDED]
    keep = [c for c in docs.columns if c.lower() not in added]
    if text not in keep:
        raise ValueError("the text column clashes with an output column")
    out = docs.select(*[F.col(f"`{c}`") for c in keep])
    blocks = list(_blocks(benchmark, item, item_text, block_bytes, window))
    for k, block in enumerate(blocks):
        last, before = k == len(blocks) - 1, "matches" if k else None
        cols = [c for c in keep if keep_text or not last or c != text]
        schema = T.StructType([docs.schema[c] for c in cols] + ADDED.fields)
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, cols=cols, before=before) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text, SHARD_BYTES):
                    yield pa.RecordBatch.from_arrays([*(column(part, c) for c in cols), *_shard(part, text, shared.value, before)], [*cols, *added])

        out = out.mapInArrow(scan, schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows that are not contaminated, with their own columns, those named like added ones too."""
    names = list(docs.columns)
    added = {f.name for f in ADDED}
    aside = {c: free_name(names, f"own_{c}") if c.lower() in added else c for c in names}
    out = annotate(docs.withColumnsRenamed(aside), benchmark, text=aside[text], **options).where("not contaminated")
    return out.select(*[F.col(f"`{aside[c]}`").alias(c) for c in names])


def items_sha256(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
