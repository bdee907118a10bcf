"""Suffix arrays by induced sorting, also of the reduced strings, with numpy working on whole waves at a time."""

from __future__ import annotations

import numpy as np


WAVE = 256  # places looked at together at least
BYTE_STEPS = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)


def _types(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last character has to be the only smallest one."""
    step = np.sign(np.diff(text.astype(np.int32)))  # 1: smaller than the next character
    decided = np.where(step != 0, np.arange(len(step)), len(step))
    decided = np.minimum.accumulate(decided[::-1])[::-1]  # the next place where characters differ
    smaller = np.ones(len(text), bool)
    smaller[:-1] = np.concatenate([step, [1]])[decided] > 0
    return smaller


def _scan(order: np.ndarray, text: np.ndarray, wanted: np.ndarray, free: np.ndarray) -> None:
    """Go through ``order`` (-1: empty) and put the wanted suffix before each one at the next free place of its bucket.

    That place is always further on. So all suffixes that stand before the first place that they fill themselves
    are dealt with at once: a wave within a bucket, or as many small buckets as do not reach into one another.
    """
    at, width, numbers = 0, WAVE, np.arange(len(order))
    while at < len(order):
        window = order[at : at + width]
        before = window - 1
        kept = (wanted[before] & (window > 0)).nonzero()[0]
        before = before[kept]
        done, count = at + len(window), len(before)
        if count:
            first = text[before]
            to = free[first]
            reach = np.minimum.accumulate(to)
            late = (kept[1:] >= reach[:-1] - at).nonzero()[0]
            if len(late):
                count = late[0] + 1
                before, first, to = before[:count], first[:count], to[:count]
            done = min(done, int(reach[count - 1]))
            by_first = first.argsort(kind="stable")
            first, to = first[by_first], to[by_first]
            new = (first[1:] != first[:-1]).nonzero()[0] + 1
            if len(new) == count - 1:
                to += 1
                order[to - 1] = before[by_first]
                free[first] = to
            else:
                starts = np.zeros(len(new) + 1, np.int64)
                starts[1:] = new
                counts = np.empty_like(starts)
                counts[:-1] = new
                counts[-1] = count
                counts -= starts
                order[to + numbers[:count] - starts.repeat(counts)] = before[by_first]
                free[first[starts]] += counts
        width = max(WAVE, 2 * (done - at))
        at = done


def _induce(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Sort all suffixes, given the leftmost-smaller ones, sorted within each bucket of their first character.

    Larger suffixes are put behind the heads of their buckets from left to right, then smaller ones before the
    tails from right to left.
    """
    size = np.bincount(text)
    tails = np.cumsum(size)
    first = text[leftmost]
    ends = np.cumsum(np.bincount(first, minlength=len(size)))
    order = np.full(len(text), -1, np.int32)
    order[tails[first] - ends[first] + np.arange(len(leftmost))] = leftmost
    _scan(order, text, ~smaller, tails - size)
    order[smaller[order]] = -1
    _scan(order[::-1], text, smaller, len(text) - tails)
    order[0] = len(text) - 1  # the closing character
    return order


def packed(text: np.ndarray) -> np.ndarray:
    """At each place the next eight characters as one number, the first the highest."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(text)]
    return np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)


def _names(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rising numbers for sorted substrings, equal ones for equal neighbours."""
    a, b, n = starts[:-1], starts[1:], lengths[:-1]
    same = lengths[:-1] == lengths[1:]
    alive = np.flatnonzero(same)
    wide = 8 if text.dtype == np.uint8 else 1  # characters compared at a time
    words = packed(text) if wide == 8 else text
    at = 0
    while len(alive):
        left = n[alive] - at
        apart = words[a[alive] + at] ^ words[b[alive] + at]
        if wide == 8:
            apart >>= np.clip(8 - left, 0, 7).astype(np.uint64) * np.uint64(8)
        equal = apart == 0
        same[alive[~equal]] = False
        at += wide
        alive = alive[equal & (left > wide)]
    return np.concatenate([[0], np.cumsum(~same)])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a string of whole numbers, 0 and up; its last one has to be 0, and the only 0.

    Leftmost-smaller substrings are sorted by induction and named in that order. Where names repeat, the string of
    names, at most half as long, is sorted in the same way; the order of its suffixes induces that of all.
    """
    if len(text) < 3:
        return np.arange(len(text), dtype=np.int32)[::-1].copy()
    smaller = _types(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    by_first = leftmost[np.argsort(text[leftmost], kind="stable")]
    order = _induce(text, smaller, by_first)
    number = np.full(len(text), -1, np.int32)
    number[leftmost] = np.arange(len(leftmost), dtype=np.int32)
    substrings = order[number[order] >= 0]  # sorted up to the next leftmost-smaller place
    ends = np.append(leftmost[1:], len(text) - 1)
    lengths = (ends - leftmost + 1)[number[substrings]]
    names = _names(text, substrings, lengths)
    if names[-1] < len(names) - 1:
        in_text = np.empty(len(names), np.int32)
        in_text[number[substrings]] = names
        del order, substrings, lengths, names, number
        substrings = leftmost[_by_names(in_text)]
    return _induce(text, smaller, substrings)


def _by_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names.

    No comparison goes beyond a name that occurs once, so that of neighbouring ones only the first is sorted with the
    others; where the rest stand is clear from their names.
    """
    counts = np.bincount(names)
    once = counts[names] == 1
    gone = np.zeros(len(names), bool)
    gone[1:-1] = once[1:-1] & once[:-2]
    kept = np.flatnonzero(~gone)
    used = np.zeros(len(counts), np.int32)
    used[names[kept]] = 1
    shorter = (np.cumsum(used) - 1)[names[kept]]
    # 16 bits where they do, since numpy sorts them by radix
    sorted_kept = kept[suffix_array(shorter.astype(np.uint16 if shorter.max() < 1 << 16 else np.int32))]
    order = np.full(len(names), -1, np.int64)
    order[(np.cumsum(counts) - 1)[names[gone]]] = np.flatnonzero(gone)
    order[order < 0] = sorted_kept
    return order


def permuted_prefixes(text: np.ndarray, order: np.ndarray, breaks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the suffix before it in the order (-1 for the first), and the length of their common prefix.

    The length is one less than at the place before wherever both suffixes are preceded by the same character, so
    only other places, and the ``breaks``, are compared; no more than ``most`` characters are.
    """
    before = np.empty(len(text), np.int32)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    places = np.arange(len(text), dtype=np.int32)
    follows = np.zeros(len(text), bool)
    follows[1:] = (before[1:] > 0) & (text[:-1] == text[np.maximum(before[1:], 1) - 1])
    follows[breaks] = False
    words = packed(text)
    compared = places[~follows & (before >= 0)]
    length = np.zeros(len(text), np.int32)
    at, alive = 0, compared
    while len(alive) and at < most:
        mine, other = alive + at, before[alive] + at
        inside = np.maximum(mine, other) < len(text)
        alive, mine, other = alive[inside], mine[inside], other[inside]
        apart = words[mine] ^ words[other]
        equal = apart == 0
        # leading zero bytes of the difference are equal characters
        length[alive[~equal]] = at + 7 - np.searchsorted(BYTE_STEPS, apart[~equal], side="right")
        alive = alive[equal]
        at += 8
        length[alive] = at
    # carry on from the last place that was compared
    base = np.where(follows, np.iinfo(np.int32).min, length.astype(np.int64) + places)
    return before, np.maximum(np.maximum.accumulate(base) - places, 0).astype(np.int32)
