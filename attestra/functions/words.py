"""Terms of a batch of texts in Arrow: the same as the Column expressions of ``text``, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from attestra.functions.text import IRREGULAR, STOP_WORDS, SUFFIXES

#: Bytes of a token in a text as ``text.spelled`` writes it: ASCII letters and digits, and whatever is not ASCII.
TOKEN_BYTE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def stemmed(term: str) -> str:
    """As ``text.stemmed``."""
    if term in IRREGULAR:
        return IRREGULAR[term]
    for suffix, least in SUFFIXES:
        if len(term) > least and term.endswith(suffix):
            return term[: -len(suffix)]
    return term


def significant(token: str) -> str | None:
    """A token's significant term, or None."""
    term = stemmed(token)
    return term if len(term) > 1 and term not in STOP_WORDS else None


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: empty) and where each starts, with the end."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def tokens(spelled: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The tokens of texts as ``text.spelled`` writes them, and the number of each one's text, ascending."""
    data, offsets = bytes_of(spelled)
    inside = TOKEN_BYTE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[:-1][offsets[:-1] < len(data)]
    first[bounds] = inside[bounds]  # a token does not go on in the next text
    start = np.flatnonzero(first)
    ends = np.concatenate([np.cumsum(inside)[start] - 1, [inside.sum()]]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data[inside].tobytes()))
    return np.searchsorted(offsets, start, "right") - 1, found


def distinct_terms(spelled: pa.Array, known: dict[str, int], stem: Callable[[str], str | None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and number in ``known`` of each distinct known term of a text, ascending, and how many distinct terms, known or not, each text has."""
    text, found = tokens(spelled)
    coded = found.dictionary_encode()
    numbers, others = [], {}
    for token in coded.dictionary.to_pylist():
        term = stem(token) if stem else token
        if term is None:
            numbers.append(-1)
        elif (number := known.get(term)) is not None:
            numbers.append(number)
        else:
            numbers.append(others.setdefault(term, len(known) + len(others)))
    each = np.array(numbers, np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(found) else np.zeros(0, np.int64)
    width = len(known) + len(others)
    keys = np.unique((text * width + each)[each >= 0])
    text, term = (keys // width, keys % width) if width else (keys, keys)
    sizes = np.bincount(text, minlength=len(spelled))
    return text[term < len(known)], term[term < len(known)], sizes
