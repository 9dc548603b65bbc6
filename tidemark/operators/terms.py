"""Words of texts and pairs of neighbours, counted and weighed a batch of texts at a time.

Words are numbers from the batch's dictionary, so strings are met once a batch. These functions run in tasks; Spark
deals the texts and adds up what batches give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Batches = Iterator[pa.RecordBatch]
#: What parts words: all but letters, marks, digits, connectors, joiners, and the letters in circles and squares.
BETWEEN = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}\x{24b6}-\x{24e9}\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}\x{1f170}-\x{1f189}]+"
#: Signs of one byte: letters in lower case, digits and the underscore stay, others become spaces.
PLAIN = bytes(ord(chr(i).lower()) if chr(i).isalnum() or chr(i) == "_" else 32 for i in range(128)) + bytes(range(128, 256))
#: The storage of ml's vectors.
VECTOR = pa.struct([pa.field("type", pa.int8(), False), pa.field("size", pa.int32()), pa.field("indices", pa.list_(pa.field("element", pa.int32(), False))), pa.field("values", pa.list_(pa.field("element", pa.float64(), False)))])


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], np.diff(np.append(at, len(keys)))


def _lower(texts: pa.Array) -> pa.Array:
    """A letter's lower case depends on its neighbours in texts with a capital sigma or a dotted I alone."""
    return pa.array([t.lower() for t in texts.to_pylist()], pa.string())


def places(texts: pa.Array, stop: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words; for each place of a word that has two letters and isn't in `stop`, its word and its text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    odd = pc.match_substring_regex(texts, "[\u03a3\u0130]")
    if pc.any(odd).as_py():
        texts = pc.replace_with_mask(texts, odd, _lower(texts.filter(odd)))
    # signs of one byte are replaced by bytes; the others are dealt with once a distinct word
    _, ends, data = texts.buffers()
    plain = pa.StringArray.from_buffers(len(texts), ends, pa.py_buffer((data.to_pybytes() if data else b"").translate(PLAIN)), None, 0, texts.offset)
    lists = pc.split_pattern(plain, " ")
    coded = lists.flatten().dictionary_encode()
    pieces = pc.split_pattern_regex(pc.utf8_lower(coded.dictionary), BETWEEN)
    found = pieces.flatten().dictionary_encode()
    words, of_piece = found.dictionary, found.indices.to_numpy()
    good = pc.and_(pc.greater(pc.utf8_length(words), 1), pc.invert(pc.is_in(words, value_set=stop))).to_numpy(zero_copy_only=False)
    keep = good[of_piece] if len(of_piece) else np.zeros(0, bool)
    of_piece, size = of_piece[keep], np.bincount(pc.list_parent_indices(pieces).to_numpy()[keep], minlength=len(coded.dictionary))
    codes, docs = coded.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy()
    start, n = np.cumsum(size) - size, size[codes] if len(codes) else np.zeros(0, np.int64)
    if len(n) and n.max() > 1:
        codes, docs, more = np.repeat(codes, n), np.repeat(docs, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = start[codes] + more
    else:
        some = n > 0
        at, docs = start[codes[some]], docs[some]
    return words, of_piece[at].astype(np.int64), docs.astype(np.int64)


def _counted(ids: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, in how many of n texts each is, and its count."""
    cells, times = runs(ids * n + docs)
    ids, df = runs(cells // n)
    return ids, df, np.add.reduceat(times, np.cumsum(df) - df) if len(ids) else df


def words_counted(stop: Sequence[str]) -> Callable[[Batches], Batches]:
    """From (text), rows (term, df, c) of a batch: texts that have the word, and its count."""

    def of_batches(batches: Batches) -> Batches:
        for b in batches:
            words, codes, docs = places(b.column(0), pa.array(stop, pa.string()))
            ids, df, c = _counted(codes, docs, b.num_rows)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(ids)), pa.array(df), pa.array(c)], ["term", "df", "c"])

    return of_batches


def pairs_counted(stop: Sequence[str], often: Sequence[str] | None = None) -> Callable[[Batches], Batches]:
    """From (text), rows (term, df, c) of a batch for pairs of neighbours.

    With `often`, only of its words, and a pair is a number: the first word's place in `often` times its length, and
    the second's.
    """

    def of_batches(batches: Batches) -> Batches:
        known = None if often is None else pa.array(often, pa.string())
        for b in batches:
            words, ids, docs = places(b.column(0), pa.array(stop, pa.string()))
            first, size = docs[1:] == docs[:-1], len(words)
            if known is not None:
                ids, size = (pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)[ids] if len(ids) else ids), len(often)
                first &= (ids[1:] >= 0) & (ids[:-1] >= 0)
            at = np.flatnonzero(first)
            ids, df, c = _counted(ids[at] * size + ids[at + 1], docs[at], b.num_rows)
            # the greatest size is that of a batch's dictionary, so no number is too large
            term = pa.array(ids, pa.int64()) if known is not None else pc.binary_join_element_wise(words.take(pa.array(ids // max(size, 1))), words.take(pa.array(ids % max(size, 1))), " ")
            yield pa.RecordBatch.from_arrays([term, pa.array(df), pa.array(c)], ["term", "df", "c"])

    return of_batches


def weights(vocabulary: Sequence[str], idf: Sequence[float], stop: Sequence[str]) -> Callable[[Batches], Batches]:
    """The last column, a text, becomes `features`: a sparse unit vector of tf * idf over the vocabulary."""
    words_of = [t.split(" ") for t in vocabulary]
    parts = sorted({w for ws in words_of for w in ws})
    number = {w: i for i, w in enumerate(parts)}
    # -1: a word that is no feature of its own
    single = np.full(len(parts), -1)
    single[[number[ws[0]] for ws in words_of if len(ws) == 1]] = [i for i, ws in enumerate(words_of) if len(ws) == 1]
    both = sorted((number[ws[0]] * len(parts) + number[ws[1]], i) for i, ws in enumerate(words_of) if len(ws) == 2)
    keys, feature = np.array([k for k, _ in both], np.int64), np.array([i for _, i in both], np.int64)
    scale, size = np.array(idf, float), len(vocabulary)

    def of_batches(batches: Batches) -> Batches:
        stops, known = pa.array(stop, pa.string()), pa.array(parts, pa.string())
        for b in batches:
            n = b.num_rows
            words, codes, docs = places(b.column(b.num_columns - 1), stops)
            which = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)
            ids = which[codes] if len(codes) else codes
            own = np.flatnonzero(ids >= 0)
            own = own[single[ids[own]] >= 0]
            f, d = single[ids[own]], docs[own]
            if len(keys):
                at = np.flatnonzero((docs[1:] == docs[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0))
                pair = ids[at] * len(parts) + ids[at + 1]
                spot = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                hit = keys[spot] == pair
                f, d = np.concatenate([f, feature[spot[hit]]]), np.concatenate([d, docs[at[hit]]])
            cells, tf = runs(d * size + f)
            d, f = cells // size, cells % size
            x = tf * scale[f]
            x = x / np.sqrt(np.bincount(d, x * x, minlength=n))[d]
            ends = np.append(0, np.cumsum(np.bincount(d, minlength=n))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v), type=t.type) for v, t in ((f.astype(np.int32), VECTOR.field("indices")), (x, VECTOR.field("values")))]
            vectors = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists], fields=list(VECTOR))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], vectors], [*b.schema.names[:-1], "features"])

    return of_batches
