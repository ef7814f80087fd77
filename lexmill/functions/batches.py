"""Tokens, tags and fields of whole Arrow batches at once, by numpy over the texts' bytes: no Python runs a token."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from string import Formatter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

_WORD = np.array([chr(b).isascii() and (chr(b).isalnum() or b == 39) for b in range(256)])
_LOW = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Rows of a batch that goes back to Spark.
ROWS = 1 << 16


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The strings' bytes one after another, and where each string begins and the last ends. A null has none."""
    strings = pc.fill_null(strings.cast(pa.string()), "")
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = strings.buffers()
    ends = np.frombuffer(ends, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return np.frombuffer(data if data is not None else b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.StringArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


def _runs(data: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[pa.StringArray, np.ndarray]:
    word = _WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    own = ends[1:] > ends[:-1]
    at = ends[:-1][own]
    first[at] = word[at]
    at = ends[1:][own] - 1
    last[at] = word[at]
    begin = np.flatnonzero(first)
    kept = data[word]
    return _strings(_LOW[kept] if lower else kept, np.flatnonzero(last) + 1 - begin), begin


def tokens(texts: pa.Array, lower: bool = False) -> tuple[pa.StringArray, np.ndarray]:
    """Runs of ASCII letters, digits and apostrophes of all texts, and the number of the first of each text and of the end:
    text.raw_ascii_tokens, or text.ascii_tokens if lower."""
    data, ends = _bytes(texts)
    found, begin = _runs(data, ends, lower)
    return found, np.searchsorted(begin, ends)


def tags(toks: pa.StringArray) -> pa.DictionaryArray:
    """What text.rule_tag gives, of ASCII tokens; equal tokens are looked at once."""
    toks = toks.dictionary_encode()
    own = toks.dictionary
    low = pc.ascii_lower(own)
    tests = [(pc.match_substring_regex(own, "^[0-9]+$"), "CD")]
    tests += [(pc.is_in(low, pa.array(words.split())), name) for name, words in T._CLASSES]
    tests += [(pc.ends_with(low, end), name) for end, name in T._ENDS]
    tests.append((pc.and_(pc.match_substring_regex(own, "^[A-Z]"), pc.greater(pc.binary_length(own), 1)), "NNP"))
    names = [*T.TAG_IDS]
    ids = pc.case_when(pc.make_struct(*(t for t, _ in tests)), *(pa.scalar(names.index(n), pa.int8()) for _, n in tests), pa.scalar(names.index("NN"), pa.int8()))
    return pa.DictionaryArray.from_arrays(ids.take(toks.indices), pa.array(names))


def numbered(first: np.ndarray) -> np.ndarray:
    """0, 1, ... within each group, of groups that begin at these places and end at the last."""
    return np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))


def tagged_text(text: Column | str, item: str, token: str, sentence: str) -> Column:
    """The words of each line with their tags, written as item says ({0} a word, {1} its tag), token between words and
    sentence between lines."""
    pieces = list(Formatter().parse(item))

    def run(texts: pa.Array) -> pa.Array:
        data, ends = _bytes(texts)
        toks, begin = _runs(data, ends)
        fields = [toks, tags(toks).cast(pa.string())]
        parts = [x for literal, name, _, _ in pieces for x in ([pa.scalar(literal)] if literal else []) + ([fields[int(name)]] if name else [])]
        items = pc.binary_join_element_wise(*parts, "")
        # a line ends at each line end and at the end of its text
        cuts = np.flatnonzero(data == 10)
        of = np.searchsorted(cuts, ends) + np.arange(len(ends))
        stops = np.zeros(of[-1] + 1, np.int64)
        inner = np.ones(len(stops), bool)
        inner[of] = False
        stops[inner], stops[of] = cuts, ends
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, stops), pa.int32()), items), token)
        out = pc.binary_join(pa.ListArray.from_arrays(pa.array(of, pa.int32()), lines), sentence)
        return pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), out)

    def tagged(a: pa.Array) -> pa.Array:
        return run(a)

    return F.arrow_udf(tagged, "string")(F.col(text) if isinstance(text, str) else text)


def mapped(rows: DataFrame, key: str, text: str, columns: str, f: Callable[[pa.Array], tuple[np.ndarray, Sequence[pa.Array]]]) -> DataFrame:
    """(key, columns) of the rows that f makes of texts: for each the number of its text, and its columns."""
    own = rows.select(key, text)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            of, cols = f(part.column(1))
            for i in range(0, len(of), ROWS):
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of[i : i + ROWS])), *(c.slice(i, ROWS) for c in cols)], names=[key, *names])

    return own.mapInArrow(run, f"`{key}` {own.schema[key].dataType.simpleString()}, {columns}")


def _parted(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All values, and where each list's begin and the last's end."""
    return lists.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def split(strings: pa.Array, pattern: str, plain: str, other: bytes) -> tuple[pa.Array, np.ndarray]:
    """Pieces between matches of a pattern; where no bytes match other, these are the plain separators."""
    data, _ = _bytes(strings)
    return _parted(pc.split_pattern_regex(strings, pattern) if re.search(other, data) else pc.split_pattern(strings, plain))


def lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts' lines, where each text's begin and the last's end, and which have more than blanks."""
    found, first = split(texts.cast(pa.string()), r"\r?\n", "\n", rb"\r")
    return found, first, pc.not_equal(pc.utf8_trim(found, " "), "").to_numpy(zero_copy_only=False)


def fields(found: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What white space parts in lines without blanks at their ends."""
    return split(pc.utf8_trim(found, " "), r"[ \t\n\x0B\f\r]+", " ", rb"[\t\n\x0b\f\r]|  ")


def running(keep: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place how many before it in its group are kept; groups begin at these places and end at the last."""
    before = np.concatenate([[0], np.cumsum(keep)])
    return before[:-1] - np.repeat(before[first[:-1]], np.diff(first))
