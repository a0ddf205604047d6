"""Quality rules over whole texts: word counts, repeated lines, and repetition by suffix arrays.

Words are ``[^\\x20\\x09-\\x0D]+``, compared as they stand.  The texts of a block are sorted as
one suffix array of words in which suffixes of different texts never meet (prefix doubling; only
suffixes that are still tied are sorted again).  Longest common prefixes of neighbours follow in
text order.  Then, per text:

* intervals of common prefixes of at least ``least`` words whose occurrences have different
  words before them are the maximal repeats; their number and the longest are kept;
* the union of the maximal repeats' occurrences gives the covered words and the spans;
* words in ``window``-word windows that occur twice are those within ``window`` words of a
  position whose common prefix with a neighbour has that length.

``verdict`` limits the covered share and the longest repeat, ``base_failed`` the plain rules.

Memory: about 150 bytes a word of one block (``BLOCK_WORDS``, or one longer text).

Defined cases: null, empty and blank texts have no words, counts of 0 and no spans, and fail the
base rules; a text is judged alone, so copies of texts get equal answers; repeated rows and null
ids are judged row by row; other columns pass through, and a column named like ``out`` is
replaced; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 1 << 17
HEAD = 4  # common prefixes are measured where at least so many words agree
_BLANKS, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"

FIELDS = ("struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, "
          "n_covered: long, longest: long, n_repeats: long, spans: array<struct<first: long, last: long>>>")


@dataclass(frozen=True)
class Limits:
    """What a text may have; shares are in percent of its words."""

    least_words: int = 20
    repeat_percent: int = 30   # words in repeated windows (base rule)
    covered_percent: int = 50  # words under maximal repeats (one line said twice in a short text is no fault)
    longest: int = 100         # words of the longest repeat


class _Numbers(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def suffix_array(ids: np.ndarray, row: np.ndarray, ends: np.ndarray):
    """(suffixes in order, their places, positions that share ``HEAD`` words with another, group heads).

    ``row`` is each word's text and ``ends`` the end of that text; texts are sorted apart.  A
    suffix that is a prefix of another comes first.
    """
    n = len(ids)
    place = np.empty(n, np.int64)
    order = np.argsort(row * (int(ids.max(initial=0)) + 1) + ids, kind="stable")
    key = row[order] * (int(ids.max(initial=0)) + 1) + ids[order]
    slots, length = np.arange(n), 1
    shared = heads = np.zeros(0, np.int64)
    sa = order.copy()
    while True:
        # ``order`` lists the open suffixes by key in their ``slots``; equal keys form a group
        new = np.ones(len(order), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        head = slots[np.repeat(first, np.diff(np.append(first, len(order))))]
        sa[slots], place[order] = order, head
        tied = ~(new & np.append(new[1:], True))
        order, slots, head = order[tied], slots[tied], head[tied]
        if length == HEAD:
            shared, heads = order, head
        if not len(order):
            break
        after = order + length
        inside = after < ends[order]
        follow = np.zeros(len(order), np.int64)
        follow[inside] = place[after[inside]] + 1
        key = head * (n + 1) + follow
        by = np.argsort(key, kind="stable")
        order, key = order[by], key[by]
        length *= 2
    return sa, place, shared, heads


def common_prefixes(ids: np.ndarray, ends: np.ndarray, sa: np.ndarray, place: np.ndarray, shared: np.ndarray, heads: np.ndarray):
    """Words that each shared suffix has in common with the one before it in order (0 for a group's first).

    In text order the length falls by one word at most from a suffix to the next (Kasai et al. 2001).
    """
    lcp = np.zeros(len(ids), np.int64)
    by = np.argsort(shared)
    position, head = shared[by], heads[by]
    before = np.where(place[position] > head, sa[place[position] - 1], -1)
    word, last, size, done = memoryview(ids), 0, 0, -2
    found = np.zeros(len(position), np.int64)
    for k, (i, j, end) in enumerate(zip(position.tolist(), before.tolist(), ends[position].tolist())):
        size = max(last - 1, HEAD) if i == done + 1 else HEAD
        if j < 0:
            size = 0
        else:
            room = end - max(i, j)
            while size < room and word[i + size] == word[j + size]:
                size += 1
        found[k] = last = size
        done = i
    lcp[position] = found
    return lcp


def maximal_repeats(lcp: np.ndarray, previous: np.ndarray, least: int):
    """(length, first slot, last slot) of the intervals of at least ``least`` words that no word on the left extends.

    ``lcp`` and ``previous`` (a number that differs unless the same word stands before) are in suffix order.
    """
    changes = np.concatenate([[0], np.cumsum(previous[1:] != previous[:-1])]) if len(previous) else previous
    turns, out, stack = memoryview(np.ascontiguousarray(changes)), [], []
    for k, size in enumerate(lcp.tolist() + [0]):
        left = k - 1
        while stack and stack[-1][0] > size:
            length, left = stack.pop()
            if turns[k - 1] > turns[left]:
                out.append((length, left, k - 1))
        if size >= least and (not stack or stack[-1][0] < size):
            stack.append((size, left))
    return out


def _spans(covered: np.ndarray, offsets: np.ndarray):
    """Runs of covered words as (first, last, row), cut at the edges of texts."""
    edge = np.zeros(len(covered) + 1, bool)
    edge[offsets] = True
    start = covered & (edge[:-1] | ~np.concatenate([[False], covered[:-1]]))
    stop = covered & (edge[1:] | ~np.concatenate([covered[1:], [False]]))
    first, last = np.flatnonzero(start), np.flatnonzero(stop) + 1
    row = np.searchsorted(offsets, first, "right") - 1
    return first - offsets[row], last - offsets[row], row


def _marked(n: int, starts: np.ndarray, lengths) -> np.ndarray:
    """True for positions inside any [start, start + length)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step)[:n] > 0


def repetition(words: list, offsets: np.ndarray, least: int, window: int) -> dict:
    """Per text: n_repeat_words, n_covered, longest, n_repeats, and the spans of all texts."""
    n, rows = len(words), len(offsets) - 1
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int32, n)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    ends = offsets[1:][row]
    sa, place, shared, heads = suffix_array(ids, row, ends)
    out = {"longest": np.zeros(rows, np.int64), "n_repeats": np.zeros(rows, np.int64)}
    lcp = common_prefixes(ids, ends, sa, place, shared, heads) if len(shared) else np.zeros(n, np.int64)
    slots = np.sort(place[shared])
    ordered = lcp[sa[slots]]
    reach = np.zeros(n, np.int64)  # the longest repeat that begins at each position
    reach[sa[slots]] = np.maximum(ordered, np.append(ordered[1:], 0))  # a group's first has 0 before it
    at = sa[slots]
    previous = np.where(at > offsets[row[at]], ids[np.maximum(at, 1) - 1].astype(np.int64), -1 - at)
    for size, left, _ in maximal_repeats(ordered, previous, least):
        k = row[at[left]]
        out["n_repeats"][k] += 1
        out["longest"][k] = max(out["longest"][k], size)
    far = np.flatnonzero(reach >= least)
    covered = _marked(n, far, reach[far])
    seen = _marked(n, np.flatnonzero(reach >= window), window)
    for name, mark in (("n_covered", covered), ("n_repeat_words", seen)):
        sums = np.concatenate([[0], np.cumsum(mark)])
        out[name] = sums[offsets[1:]] - sums[offsets[:-1]]
    out["spans"] = _spans(covered, offsets)
    return out


def _plain_counts(text: str, raw: bytes, n_words: int) -> tuple[int, int, int, int]:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (n_words, len(text) - (len(raw) - len(raw.translate(None, _BLANKS))), len(raw) - len(raw.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)))


def _block(texts: list, least: int, window: int, spans: bool) -> pa.StructArray:
    words, plain = [], []
    for text in texts:
        raw = (text or "").encode()
        own = raw.split()
        plain.append(_plain_counts(text or "", raw, len(own)))
        words += own
    counts = np.array(plain, np.int64).reshape(-1, 4)
    offsets = np.concatenate([[0], np.cumsum(counts[:, 0])])
    got = repetition(words, offsets, least, window)
    first, last, row = got["spans"] if spans else (np.zeros(0, np.int64),) * 3
    edges = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(first), pa.array(last)], names=["first", "last"]))
    names = ["n_repeat_words", "n_covered", "longest", "n_repeats"]
    return pa.StructArray.from_arrays([*(pa.array(counts[:, k]) for k in range(4)), *(pa.array(got[x]) for x in names), lists],
                                      names=["n_words", "word_chars", "n_symbols", "n_dup_lines", *names, "spans"])


def with_rules(docs: DataFrame, text_col: str, *, out: str = "rules", least: int = 5, window: int = 8, spans: bool = True) -> DataFrame:
    """Adds the struct ``out`` (see ``FIELDS``); repeats have at least ``least`` words, windows ``window``.

    Without ``spans`` the spans are left empty.
    """
    if least <= HEAD or window <= HEAD:
        raise ValueError(f"repeats and windows need more than {HEAD} words")
    base = docs.drop(out)
    at = base.columns.index(text_col)
    rows = base.withColumn(text_col, F.col(text_col).cast("string"))

    def run(batches):
        for batch in batches:
            texts, begin, held, parts = batch.column(at), 0, 0, []
            for k in range(len(texts)):
                held += (len(texts[k].as_buffer() or b"") if texts[k].is_valid else 0) // 6
                if held >= BLOCK_WORDS or k == len(texts) - 1:
                    parts.append(_block(texts[begin:k + 1].to_pylist(), least, window, spans))
                    begin, held = k + 1, 0
            if parts:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(parts)], names=[*batch.schema.names, out])

    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, `{out}` {FIELDS}")


def base_failed(rules: Column, limits: Limits = Limits()) -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (rules["n_words"] < limits.least_words) | (100 * rules["n_repeat_words"] > limits.repeat_percent * rules["n_words"])


def verdict(rules: Column, limits: Limits = Limits()) -> Column:
    """False when maximal repeats cover too much of a text, or one of them is too long."""
    return (100 * rules["n_covered"] <= limits.covered_percent * rules["n_words"]) & (rules["longest"] <= limits.longest)
