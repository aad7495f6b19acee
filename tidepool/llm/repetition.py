"""Operator 3: quality rules on repetition, from suffix arrays.

The words of a slice of documents are sorted as suffixes by prefix doubling (a suffix ends with its document, so no two documents are
mixed). Longest common prefixes of neighbours give the longest repeat that starts at each word; runs of neighbours with prefixes of at
least a length are the intervals of maximal repeated substrings. Their spans are joined, and rules limit the covered share of the words
and the longest repeat.

Cases: a null text is one without words, and fails as too short; texts of any length are sorted whole; repeated rows get equal results;
an empty table gives an empty one; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidepool.llm.common import as_bytes, map_texts, row_bytes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"


@dataclass(frozen=True)
class Rules:
    """min_words, max_repeat_percent: the base. Then the method's: repeats of at least span_words words may cover up to max_covered of a
    document's words, and no repeat may have over max_longest words."""

    min_words: int = 50
    max_repeat_percent: int = 50
    window: int = 3
    span_words: int = 6
    max_covered: float = 0.4
    max_longest: int = 100


def repeats(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(longest repeat that starts at each word, suffix array, common prefix of each suffix in it with the next).

    words: ids of the words of all documents end to end, starts: where each document starts, and the end.
    """
    n = len(words)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    sizes = np.diff(starts)
    end = np.repeat(starts[1:], sizes)
    key = np.repeat(np.arange(len(sizes)), sizes) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    first = np.concatenate([[True], np.diff(key[order]) != 0])
    at = np.flatnonzero(first)
    rank[order] = np.repeat(at, np.diff(np.append(at, n))) + 1
    levels = [rank.astype(np.int32)]
    active = order[_tied(first)]
    step = 1
    while len(active):
        then = active + step
        inside = then < end[active]
        follow = np.zeros(len(active), np.int64)
        follow[inside] = rank[then[inside]]
        before = rank[active]
        by = before * (n + 1) + follow
        o = np.argsort(by, kind="stable")
        active, by, before = active[o], by[o], before[o]
        first = np.concatenate([[True], np.diff(by) != 0])
        outer = np.concatenate([[True], np.diff(before) != 0])
        i = np.arange(len(active))
        rank[active] = before + np.maximum.accumulate(np.where(first, i, 0)) - np.maximum.accumulate(np.where(outer, i, 0))
        levels.append(rank.astype(np.int32))
        active = active[_tied(first)]
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank - 1] = np.arange(n)
    common = np.zeros(n, np.int64)
    one, two = suffixes[:-1], suffixes[1:]
    pairs = np.flatnonzero(levels[0][one] == levels[0][two])
    a, b = one[pairs].copy(), two[pairs].copy()
    size = np.zeros(len(pairs), np.int64)
    stop = end[a]
    for k in range(len(levels) - 1, -1, -1):
        live = (a < stop) & (b < stop)
        same = np.flatnonzero(live)
        same = same[levels[k][a[same]] == levels[k][b[same]]]
        a[same] += 1 << k
        b[same] += 1 << k
        size[same] += 1 << k
    common[pairs] = size
    longest = np.zeros(n, np.int64)
    longest[suffixes] = common
    longest[suffixes[1:]] = np.maximum(longest[suffixes[1:]], common[:-1])
    return longest, suffixes, common


def _tied(first: np.ndarray) -> np.ndarray:
    """Whether each sorted row shares its group with another; first: whether a row begins a group."""
    return ~(first & np.append(first[1:], True))


def intervals(words: np.ndarray, starts: np.ndarray, suffixes: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """A word at which a repeat begins, for each interval of neighbours with at least so many words in common whose repeat is maximal: what stands
    before it is not everywhere the same."""
    linked = np.flatnonzero(common >= least)
    if not len(linked):
        return linked
    before = np.concatenate([[-1], words[:-1]])
    before[starts[:-1][starts[:-1] < len(words)]] = -1
    differ = (before[suffixes[linked]] != before[suffixes[linked + 1]]) | (before[suffixes[linked]] < 0)
    first = np.flatnonzero(np.concatenate([[True], np.diff(linked) > 1]))
    return suffixes[linked[first[np.add.reduceat(differ.astype(np.int64), first) > 0]]]


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Whether each word is within some repeat of at least so many words."""
    at = np.flatnonzero(longest >= least)
    edge = np.zeros(len(longest) + 1, np.int64)
    edge[at] += 1
    np.subtract.at(edge, at + longest[at], 1)
    return np.cumsum(edge[:-1]) > 0


def per_document(what: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(what, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


_leads = np.ones(256, np.int64)  # one for each byte that begins a code point of a word
_leads[0x80:0xC0] = 0
_leads[list(SPACES)] = 0
_symbols = np.zeros(256, np.int64)
_symbols[list(SYMBOLS)] = 1


def measure(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """All figures of a slice of texts, each with one value per text."""
    data, edges = row_bytes(texts)
    whole = as_bytes(texts)
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids: list[int] = []
    n_words, n_dup = [], []
    for text in whole:
        words = text.split()  # on the six ASCII spaces, as bytes do
        n_words.append(len(words))
        ids.extend([number[w] for w in words])
        lines = [x for x in text.split(b"\n") if x and x.strip()]
        n_dup.append(len(lines) - len(set(lines)))
    starts = np.concatenate([[0], np.cumsum(n_words, dtype=np.int64)]).astype(np.int64)
    longest, suffixes, common = repeats(np.array(ids, np.int64), starts)
    doc = np.repeat(np.arange(len(whole)), np.diff(starts))
    most = np.zeros(len(whole), np.int64)
    np.maximum.at(most, doc, longest)
    maximal = intervals(np.array(ids, np.int64), starts, suffixes, common, rules.span_words)
    n = np.array(n_words, np.int64)
    repeat_words = per_document(covered(longest, rules.window), starts)
    span_words = per_document(covered(longest, rules.span_words), starts)
    failed = (n < rules.min_words) | (100 * repeat_words > rules.max_repeat_percent * n)
    return {
        "n_words": n,
        "word_chars": per_document(_leads[data], edges),
        "n_symbols": per_document(_symbols[data], edges),
        "n_dup_lines": np.array(n_dup, np.int64),
        "n_repeat_words": repeat_words,
        "base_failed": failed,
        "n_intervals": np.bincount(doc[maximal], minlength=len(whole)).astype(np.int64),
        "covered_words": span_words,
        "longest_repeat": most,
        "kept": ~failed & (span_words <= rules.max_covered * n) & (most <= rules.max_longest),
    }


FIELDS = [T.StructField(c, T.BooleanType() if c in ("base_failed", "kept") else T.LongType(), False) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_intervals", "covered_words", "longest_repeat", "kept")]


def quality(df: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", rules: Rules = Rules(), prefix: str = "") -> DataFrame:
    """`keep` columns of each row, and its figures (names begin with prefix): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_intervals (intervals of repeats of span_words words or more), covered_words, longest_repeat, kept."""
    fields = [T.StructField(prefix + f.name, f.dataType, False) for f in FIELDS]

    def make():
        def work(texts: pa.Array, _rows: pa.RecordBatch) -> list[pa.Array]:
            found = measure(texts, rules)
            return [pa.array(found[f.name]) for f in FIELDS]

        return work

    return map_texts(df, text_col, keep or ["doc_id"], fields, make)
