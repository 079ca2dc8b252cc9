"""Words of whole batches of texts, cut with array operations on their UTF-8 bytes.

The rules are those of ``phrasedex.functions.text``: raw tokens are runs of bytes other than
ASCII white space, offsets count code points of the tokens joined by single spaces, words are
the lower-cased [a-zA-Z0-9] runs of a token and share its offset. Spark deals the documents to
tasks; a call sees the texts of one Arrow batch and takes them in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from phrasedex.functions.porter_batch import stem

# Bytes of text in a piece; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20

WORDS_TYPE = "array<struct<word: string, positions: array<int>>>"
NUMBERED_TYPE = "array<struct<word: string, positions: array<int>, tokens: array<int>>>"
_FIELDS = [pa.field("word", pa.string()), pa.field("positions", pa.list_(pa.int32())), pa.field("tokens", pa.list_(pa.int32()))]

PAIRS_TYPE = "array<struct<first: string, gap: int, second: string, positions: array<int>>>"
_PAIR_FIELDS = [pa.field("first", pa.string()), pa.field("gap", pa.int32()), pa.field("second", pa.string()), _FIELDS[1]]

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _pieces(texts: pa.Array, owners: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets of the texts in them and their end, first text of each owner and their end) of consecutive texts.

    An owner's texts stay together; without ``owners`` (offsets into the texts) each text is its own. A null is an empty text.
    """
    a = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.empty(0, np.uint8)
    owners = np.arange(len(a) + 1) if owners is None else owners
    ends = at[owners]
    first = 0
    while first < len(owners) - 1:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + PIECE_BYTES, "right")) - 1)
        own = owners[first : last + 1]
        yield data[ends[first] : ends[last]], at[own[0] : own[-1] + 1] - ends[first], own - own[0]
        first = last


def _words(data: np.ndarray, alnum: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(byte each word starts at, the words); ``first`` marks the bytes that begin a text."""
    before = np.zeros(len(data), bool)
    before[1:] = alnum[:-1]
    begins = alnum & (~before | first)
    starts = np.flatnonzero(begins)
    letters = _LOWER[data[alnum]]
    at = np.append(np.flatnonzero(begins[alnum]), len(letters)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(letters))
    return starts, words.dictionary_encode()


def _text_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    first = np.zeros(len(data), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return first


def _located(data: np.ndarray, offsets: np.ndarray, owners: np.ndarray, stems: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the different words, or stems; of each occurrence, as they stand: its word's number, its owner, its offset, the number of its token in its text)."""
    first = _text_starts(data, offsets)
    starts, words = _words(data, _ALNUM[data], first)
    solid = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    begins = solid & (~before | first)
    tokens = np.flatnonzero(begins)
    # Code points, white space left out, before each byte.
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid & ((data & 0xC0) != 0x80), out=points[1:])
    doc = np.searchsorted(offsets, tokens, "right") - 1
    earlier = np.searchsorted(tokens, offsets[:-1])
    # One space for each earlier token of the text.
    pos = points[tokens] - points[offsets[doc]] + np.arange(len(tokens)) - earlier[doc]
    token = np.searchsorted(tokens, starts, "right") - 1
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = words.dictionary
    if stems:
        found = pa.array([stem(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
        names, code = found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code]
    owner = (np.searchsorted(owners, doc, "right") - 1)[token]
    return names, code, owner, pos[token], (np.arange(len(tokens)) - earlier[doc])[token]


def _grouped(data: np.ndarray, offsets: np.ndarray, owners: np.ndarray, numbers: bool, stems: bool) -> pa.Array:
    n = len(owners) - 1
    names, code, owner, pos, number = _located(data, offsets, owners, stems)
    key = owner * max(1, len(names)) + code
    # Offsets ascend in a text, so a stable sort keeps them so; those of several texts are sorted too.
    order = np.argsort(key, kind="stable") if np.diff(owners).max(initial=0) <= 1 else np.lexsort((pos, key))
    key = key[order]
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    at = pa.array(np.append(cut, len(key)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(v[order].astype(np.int32))) for v in ([pos, number] if numbers else [pos])]
    groups = pa.StructArray.from_arrays([names.take(pa.array(code[order][cut])), *lists], fields=_FIELDS[: 1 + len(lists)])
    ends = np.searchsorted(owner[order][cut], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), groups)


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _paired(data: np.ndarray, offsets: np.ndarray, owners: np.ndarray, lengths: dict[str, list[int]]) -> pa.Array:
    names, code, owner, pos, _ = _located(data, offsets, owners, stems=True)
    order = np.lexsort((pos, owner))
    code, owner, pos = code[order], owner[order], pos[order]
    known = [lengths.get(name, []) for name in names.to_pylist()]
    many = np.array([len(x) for x in known], np.int64)
    gaps = np.array([x + 1 for own in known for x in own], np.int64)
    # Each occurrence of a frequent term with each of its gaps, then with each word that stands there.
    first = np.repeat(np.arange(len(code)), many[code])
    gap = gaps[np.repeat((np.cumsum(many) - many)[code], many[code]) + _ramp(many[code])]
    span = pos.max(initial=0) + 1
    inside = pos[first] + gap < span
    first, gap = first[inside], gap[inside]
    key = owner * span + pos
    low = np.searchsorted(key, key[first] + gap, "left")
    there = np.searchsorted(key, key[first] + gap, "right") - low
    second = np.repeat(low, there) + _ramp(there)
    first, gap = np.repeat(first, there), np.repeat(gap, there)
    gap_names, gap = np.unique(gap, return_inverse=True)
    n_names, n_gaps = max(1, len(names)), max(1, len(gap_names))
    pair = ((owner[first] * n_names + code[first]) * n_gaps + gap) * n_names + code[second]
    order = np.lexsort((pos[first], pair))
    first, gap, second, pair = first[order], gap[order], second[order], pair[order]
    new_pair = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
    # An offset counts once, however many words stand there.
    kept = new_pair | np.append(True, pos[first][1:] != pos[first][:-1])[: len(pair)]
    first, gap, second, new_pair = first[kept], gap[kept], second[kept], new_pair[kept]
    cut = np.flatnonzero(new_pair)
    positions = pa.ListArray.from_arrays(pa.array(np.append(cut, len(first)).astype(np.int32)), pa.array(pos[first].astype(np.int32)))
    columns = [names.take(pa.array(code[first[cut]])), pa.array(gap_names[gap[cut]].astype(np.int32)), names.take(pa.array(code[second[cut]])), positions]
    ends = np.searchsorted(owner[first[cut]], np.arange(len(owners)))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(columns, fields=_PAIR_FIELDS))


def _all_grouped(pieces, numbers: bool = False, stems: bool = False) -> pa.Array:
    out = [_grouped(*piece, numbers, stems) for piece in pieces]
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct(_FIELDS[: 2 + numbers])))


def grouped_words(texts: pa.Array) -> pa.Array:
    """Per text, its different words with all their offsets, ascending."""
    return _all_grouped(_pieces(texts))


def _owned(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return _pieces(texts.values, texts.offsets.to_numpy())


def grouped_terms(texts: pa.Array) -> pa.Array:
    """Per list of texts, the different stems of their words with all their offsets, ascending."""
    return _all_grouped(_owned(texts), stems=True)


def numbered_terms(texts: pa.Array) -> pa.Array:
    """``grouped_terms`` with the number, from 0, of the raw token of each offset in its text."""
    return _all_grouped(_owned(texts), numbers=True, stems=True)


def paired_terms(texts: pa.Array, lengths: dict[str, list[int]]) -> pa.Array:
    """Per list of texts, the pairs (first, gap, second) of stems with all offsets of ``first``, each once, ascending.

    ``second`` stands ``gap`` after ``first``; ``lengths`` has the word lengths of the stems that are a ``first``, each one less than a gap.
    """
    out = [_paired(*piece, lengths) for piece in _owned(texts)]
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct(_PAIR_FIELDS)))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each piece of the batches' only column: n occurrences."""
    for batch in batches:
        for data, offsets, _ in _pieces(batch.column(0)):
            _, words = _words(data, _ALNUM[data], _text_starts(data, offsets))
            n = np.bincount(words.indices.to_numpy(zero_copy_only=False), minlength=len(words.dictionary))
            yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(n.astype(np.int64))], ["word", "n"])
