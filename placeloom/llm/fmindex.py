"""Bidirectional FM-index over a delimited list of words, searched for words at exactly one edit.

The text is `$w1$w2$...$wn$` with the words in order; a second text holds the reversed words, in their own order. Both
count the same patterns inside `$word$`, so a pattern's two suffix-rank intervals have one width, and extending it on one
side moves the interval of the other side by the number of smaller symbols. Ranks come from bit vectors "symbol
smaller than c", one a symbol, with counts at every 64th place.
"""

from __future__ import annotations

import numpy as np

QUERIES = 2048  # queries searched at a time
LETTERS = 1 << 16  # letters of these queries, unless one query alone has more


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and the length of each."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    return flat, np.array([len(w) for w in words], dtype=np.int64)


class Ranks:
    """Occurrences before a place in the last column of the sorted suffixes of `$w1$...$wn$`; the words are in order."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, symbols: int):
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))  # of the delimiters; words[i] is text[starts[i] + 1 : starts[i + 1]]
        n = int(starts[-1]) + 1
        text = np.zeros(n, dtype=np.int64)
        letter = np.ones(n, dtype=bool)
        letter[starts] = False
        text[letter] = flat
        rank = text + len(starts)
        rank[starts[:-1]] = np.arange(1, len(starts))  # delimiters rank as the words after them; the last one stands before all
        rank[starts[-1]] = 0
        step, longest = 1, int(lengths.max(initial=0)) + 1
        while True:  # prefix doubling; no comparison passes a delimiter
            key = rank * (int(rank.max()) + 2)
            key[:-step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
            rank[order] = new
            step *= 2
            if new[-1] == n - 1 or step > 2 * longest:
                break
        last = text[order - 1]  # the symbol before each suffix; that of the first is the last
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        blocks = n // 64 + 1
        less = np.zeros((symbols + 1, blocks * 64), dtype=bool)
        less[:, :n] = last[None, :] < np.arange(symbols + 1)[:, None]
        self.bits = np.packbits(less, axis=1, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.bits).cumsum(axis=1, dtype=np.int64)
        self.before = np.concatenate((np.zeros((symbols + 1, 1), dtype=np.int64), counts[:, :-1]), axis=1)

    def less(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Symbols smaller than c among the first i of the last column."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[c, block] + np.bitwise_count(self.bits[c, block] & mask)


class Index:
    """words: distinct, in code-point order, without the delimiter."""

    def __init__(self, words: list[str]):
        flat, lengths = codes(words)
        self.alphabet = np.unique(flat)  # symbol 0 is the delimiter
        self.n, self.words, self.symbols = len(words), words, len(self.alphabet) + 1
        back = sorted(w[::-1] for w in words)
        self.left = Ranks(np.searchsorted(self.alphabet, flat) + 1, lengths, self.symbols)
        flat, lengths = codes(back)
        self.right = Ranks(np.searchsorted(self.alphabet, flat) + 1, lengths, self.symbols)

    def symbol(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; -1 for letters that no word has."""
        if not len(self.alphabet):
            return np.full(points.shape, -1)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, -1)

    def extend(self, left: bool, c: np.ndarray, lo: np.ndarray, other: np.ndarray, width: np.ndarray):
        """(lo, other, width) of the patterns with c before (left) or after; lo is the interval on the side that grows."""
        side = self.left if left else self.right
        below, above = side.less(c, lo), side.less(c, lo + width)
        own = side.less(c + 1, lo) - below
        return side.first[c] + own, other + (above - below), side.less(c + 1, lo + width) - above - own + (below - side.less(c, lo))


def _exact(index: Index, left: bool, sym: np.ndarray, lo, other, width):
    """Patterns extended by their own symbols, column by column; rows that have died keep a width of 0."""
    for c in sym.T:
        c = np.where(width > 0, c, -1)
        live = c >= 0
        width = np.where(live, width, 0)
        a, b, w = index.extend(left, np.maximum(c, 0), lo, other, width)
        lo, other, width = np.where(live, a, lo), np.where(live, b, other), np.where(live, w, 0)
    return lo, other, width


def search(index: Index, sym: np.ndarray, half: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word number) of all pairs at exactly one edit that the search finds; sym is (queries, length).

    first: the left half (`half` symbols) is matched leftwards from its end to the delimiter, then the pattern grows to
    the right over the other half with one error. Otherwise the right half is matched first and the pattern grows to
    the left. A pair may be found by several places of its error; it is given once.
    """
    q, m = sym.shape
    zero, every = np.zeros(q, dtype=np.int64), np.full(q, int(index.left.first[-1]), dtype=np.int64)
    end = np.zeros((q, 1), dtype=np.int64)
    if first:
        known, rest = np.concatenate((sym[:, :half][:, ::-1], end), axis=1), np.concatenate((sym[:, half:], end), axis=1)
    else:
        known, rest = np.concatenate((sym[:, half:], end), axis=1), np.concatenate((sym[:, :half][:, ::-1], end), axis=1)
    lo, other, width = _exact(index, first, known, zero, zero, every)
    lo, other = other, lo  # from here the other side grows
    who = np.flatnonzero(width > 0)
    lo, other, width = lo[who], other[who], width[who]
    bad = [np.zeros(0, dtype=np.int64)] * 4  # query, lo, other, width of patterns with their error behind them
    length = rest.shape[1]
    letters = np.arange(1, index.symbols)
    for p in range(length):
        want = rest[who, p]
        # every symbol that can come next: as a replacement it uses up the wanted one, as an insertion it does not
        grow = np.tile(letters, len(who))
        a, b, w = index.extend(not first, grow, *(np.repeat(x, len(letters)) for x in (lo, other, width)))
        src = np.repeat(np.arange(len(who)), len(letters))
        keep = w > 0
        src, grow, a, b, w = src[keep], grow[keep], a[keep], b[keep], w[keep]
        swap = (grow != want[src]) & (p < length - 1)
        added = [who[src], a, b, w]
        # erring patterns go on exactly: first those from before, with the inserted ones and the deletions, over the wanted symbol
        ahead = [np.concatenate(x) for x in zip(bad, added)]
        c = rest[ahead[0], p]
        ahead = [x[c >= 0] for x in ahead]
        nxt = index.extend(not first, rest[ahead[0], p], *ahead[1:])
        alive = nxt[2] > 0
        bad = [ahead[0][alive], *(x[alive] for x in nxt)]
        more = [[x[swap] for x in added]]
        if p < length - 1:
            more.append([who, lo, other, width])  # the wanted symbol left out
        bad = [np.concatenate(x) for x in zip(bad, *more)]
        if len(bad[0]):  # the same pattern by another place of the error
            _, one = np.unique(np.stack(bad[:2] + bad[3:]), axis=1, return_index=True)
            bad = [x[one] for x in bad]
        live = want >= 0
        who, lo, other, width, want = (x[live] for x in (who, lo, other, width, want))
        lo, other, width = index.extend(not first, want, lo, other, width)
        live = width > 0
        who, lo, other, width = (x[live] for x in (who, lo, other, width))
    # bad now holds `$word$`; in the order of the words' suffixes the last delimiter comes first
    at = (bad[2] if first else bad[1]) - 1
    return bad[0][at >= 0], at[at >= 0]  # `$$` is no word


def near(index: Index, words: list[str], first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(place in words, place in index.words) of the pairs at one edit that `search` finds; words are of any lengths.

    Pairs whose left half is alike are those of the first search, the second search leaves them out.
    """
    flat, lengths = codes(words)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    found = [(np.zeros(0, dtype=np.int64),) * 2]
    for m in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == m)
        step = max(1, min(QUERIES, LETTERS // max(m, 1)))
        for k in range(0, len(rows), step):
            own = rows[k:k + step]
            sym = index.symbol(flat[starts[own][:, None] + np.arange(m)])
            i, j = search(index, sym, m // 2, first)
            if not first and len(i):
                new = np.array([not index.words[y].startswith(words[own[x]][:m // 2]) for x, y in zip(i.tolist(), j.tolist())], dtype=bool)
                i, j = i[new], j[new]
            found.append((own[i], j))
    return tuple(np.concatenate(x) for x in zip(*found))
