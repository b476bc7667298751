"""Word-level suffix arrays and counts of whole texts, for many texts at once.

``measure`` handles a list of texts in one go: all words of the list are put in
one array of symbols that differ between documents, so that a repeat never
crosses a document's end.
"""

from __future__ import annotations

import numpy as np

#: The symbols that count as such.
SYMBOLS = "#*$%&|<>"
#: What separates words.
SPACES = " \t\n\x0b\x0c\r"
#: Doublings whose ranks are kept; longer common prefixes are measured in the order of the text.
KEPT = 8


def repeat_lengths(symbols: np.ndarray) -> np.ndarray:
    """For each position, the longest run of symbols from there that also starts at another position.

    A suffix array by prefix doubling in which only unsettled groups are sorted
    again. The ranks of the first doublings are kept, so memory is in proportion to
    the text; the longest common prefix of neighbours is then added up from the
    largest power of two down, or measured where it is longer. The longest
    interval of equal prefixes that holds a suffix ends at one of its neighbours,
    so the larger of the two prefix lengths is the longest repeat from there.
    """
    n = len(symbols)
    if n < 2:
        return np.zeros(n, np.int64)
    order = np.argsort(symbols)
    s = symbols[order]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    group = np.repeat(starts, np.diff(np.r_[starts, n]))
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = group
    levels, step, doublings = [rank.astype(np.int32 if n < 1 << 31 else np.int64)], 1, 1
    open_ = np.flatnonzero(np.r_[s[1:] == s[:-1], False] | np.r_[False, s[1:] == s[:-1]])
    while len(open_):
        at = order[open_]
        key = group[open_] * (n + 2) + rank[np.minimum(at + step, n)] + 1
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[open_] = at
        new = np.r_[True, key[1:] != key[:-1]]
        group[open_] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
        rank[at] = group[open_]
        if doublings <= KEPT:
            levels.append(rank.astype(levels[0].dtype))
        doublings += 1
        step *= 2
        same = ~new[1:]
        open_ = open_[np.r_[same, False] | np.r_[False, same]]
    shared = np.zeros(n - 1, np.int64)
    left, right = order[:-1], order[1:]
    live = np.flatnonzero(levels[0][left] == levels[0][right])
    a, b, length = left[live].copy(), right[live].copy(), np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        equal = levels[k][a] == levels[k][b]
        length += equal << k
        a += equal << k
        b += equal << k
    shared[live] = length
    if doublings > len(levels):
        far = np.flatnonzero(levels[-1][left] == levels[-1][right])
        shared[far] = _long_prefixes(symbols, left[far], right[far], 1 << len(levels) - 1)
    out = np.zeros(n, np.int64)
    out[left] = shared
    out[right] = np.maximum(out[right], shared)
    return out


def _long_prefixes(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each suffix in ``left`` and its successor in ``right``, both known to share ``least`` symbols.

    In the order of the text a prefix is at most one shorter than the one before it, so all steps together are
    in proportion to the text.
    """
    n, out, length, before = len(symbols), np.zeros(len(left), np.int64), 0, 0
    for i in np.argsort(left):
        a, b = int(left[i]), int(right[i])
        length = max(least, length - (a - before))
        step = 16
        while b + length < n and a + length < n:
            size = min(step, n - max(a, b) - length)
            differ = symbols[a + length : a + length + size] != symbols[b + length : b + length + size]
            if differ.any():
                length += int(differ.argmax())
                break
            length += size
            step *= 2
        out[i], before = length, a
    return out


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n positions lie in the union of the spans."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def measure(texts: list[str | None], min_words: int) -> dict[str, np.ndarray]:
    """Counts of each text (null: an empty one).

    repeated and longest are of maximal repeats of at least ``min_words`` words:
    the words in the union of their spans, and the words of the longest (0: none).
    """
    texts = [t or "" for t in texts]
    docs = len(texts)
    ids: dict[bytes, int] = {}
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, docs)
    ends = np.cumsum(np.r_[0, sizes])
    n = int(ends[-1])
    flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in words for w in ws), np.int64, n)
    of = np.repeat(np.arange(docs), sizes)
    rep = repeat_lengths(of * max(1, len(ids)) + flat)

    def total(mask: np.ndarray) -> np.ndarray:
        run = np.r_[0, np.cumsum(mask)]
        return run[ends[1:]] - run[ends[:-1]]

    three, long = np.flatnonzero(rep >= 3), np.flatnonzero(rep >= min_words)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, of[long], rep[long])
    dup = np.zeros(docs, np.int64)
    for i, t in enumerate(texts):
        if "\n" in t:
            lines = [x for x in t.split("\n") if x.strip(SPACES)]
            dup[i] = len(lines) - len(set(lines))
    count = lambda chars: np.array([sum(map(t.count, chars)) for t in texts], np.int64)
    chars = np.fromiter(map(len, texts), np.int64, docs)
    return {
        "n_words": sizes,
        "n_chars": chars,
        "word_chars": chars - count(SPACES),
        "n_symbols": count(SYMBOLS),
        "n_dup_lines": dup,
        "n_repeat_words": total(covered(n, three, np.full(len(three), 3))),
        "repeated": total(covered(n, long, rep[long])),
        "longest": longest,
    }
