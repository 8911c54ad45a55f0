"""The similarities of similarity.py for whole batches of pairs, the same numbers to the last bit.

Strings become rows of character codes, and the longest common subsequence of all pairs goes forward one character at a time in numpy:
a pair's state is one machine word, so one string of a pair may have up to 64 characters; pairs of longer ones go
through the plain function.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from entwine.functions import similarity as S

WORD = 64
#: Windows, and pairs of tokens, that are looked at together.
MOST_WINDOWS, MOST_TOKEN_PAIRS = 1 << 15, 1 << 17


class Strings:
    """Different strings of a batch by number: their characters' codes one after the other, and bit masks of those up to a word."""

    def __init__(self, values: Iterable[str]) -> None:
        self.values = list(values)
        self.lengths = np.fromiter(map(len, self.values), np.int64, len(self.values))
        points = np.frombuffer("".join(self.values).encode("utf-32-le", "surrogatepass"), np.uint32)
        known, codes = np.unique(points, return_inverse=True)
        self.none = len(known)  # the code of what is beyond a string's ends, which no mask has
        self.width = self.none + 1
        # every string has a word of blanks on either side, so that windows over its ends are windows like others
        self.starts = np.cumsum(self.lengths + WORD) - self.lengths
        self.codes = np.full(int((self.lengths + WORD).sum()) + WORD, self.none, np.int64)
        owner = np.repeat(np.arange(len(self.values)), self.lengths)
        at = np.arange(len(points)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.codes[self.starts[owner] + at] = codes
        self.masks = np.zeros(len(self.values) * self.width, np.uint64)
        short = at < WORD
        np.bitwise_or.at(self.masks, owner[short] * self.width + codes[short], np.uint64(1) << at[short].astype(np.uint64))

    def letters(self) -> np.ndarray:
        """A bit for every character that a string has; characters past 64 share bits, so a bit that is missing says that a character is."""
        found = np.zeros(len(self.values), np.uint64)
        owner = np.repeat(np.arange(len(self.values)), self.lengths)
        np.bitwise_or.at(found, owner, np.uint64(1) << (self.codes[self.codes < self.none] % 64).astype(np.uint64))
        return found

    def lcs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of pairs of numbers."""
        swap = self.lengths[a] > self.lengths[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        found = np.zeros(len(a), np.int64)
        long = self.lengths[a] > WORD
        for i in np.flatnonzero(long).tolist():
            found[i] = S.lcs(self.values[a[i]], self.values[b[i]])
        some = np.flatnonzero(~long)
        found[some] = self.run(a[some], self.starts[b[some]], self.lengths[b[some]])
        return found

    def run(self, a: np.ndarray, begin: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """lcs of strings of up to a word with `steps` characters from `begin` on."""
        order = np.argsort(-steps, kind="stable")
        left = steps[order]
        base, at = (a * self.width)[order], begin[order]
        lengths = self.lengths[a][order]
        full = np.where(lengths >= WORD, ~np.uint64(0), (np.uint64(1) << np.minimum(lengths, WORD - 1).astype(np.uint64)) - np.uint64(1))
        row = full.copy()
        for j in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -j, side="left"))  # those that have more than j steps
            now = row[:n]
            hit = now & self.masks[base[:n] + self.codes[at[:n] + j]]
            row[:n] = (now + hit) | (now - hit)
        found = np.empty(len(a), np.int64)
        found[order] = lengths - np.bitwise_count(row & full)
        return found

    def ratio(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        whole = self.lengths[a] + self.lengths[b]
        return percent(whole - 2 * self.lcs(a, b), whole)

    def partial(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """partial_ratio of pairs of numbers."""
        keys, back = np.unique(a * len(self.values) + b, return_inverse=True)
        a, b = keys // len(self.values), keys % len(self.values)
        swap = self.lengths[a] > self.lengths[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        best = np.where((self.lengths[a] == 0) & (self.lengths[b] == 0), 100.0, 0.0)
        long = self.lengths[a] > WORD
        for i in np.flatnonzero(long).tolist():
            best[i] = S.partial_ratio(self.values[a[i]], self.values[b[i]])
        some = np.flatnonzero(~long & (self.lengths[a] > 0))
        same = some[self.lengths[a[some]] == self.lengths[b[some]]]
        rows, needles, texts = np.concatenate([some, same]), np.concatenate([a[some], b[same]]), np.concatenate([b[some], a[same]])
        ends = np.cumsum(self.lengths[needles] + self.lengths[texts] - 1)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_WINDOWS, side="right")))
            np.maximum.at(best, rows[at:to], self.slide(needles[at:to], texts[at:to]))
            at = to
        return best[back]

    def slide(self, needles: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """The best ratio of each needle (up to a word) with a window of its length on its text, windows over the ends too."""
        n, whole = self.lengths[needles], self.lengths[texts]
        windows = n + whole - 1
        first = np.cumsum(windows) - windows
        pair = np.repeat(np.arange(len(needles)), windows)
        offset = np.arange(len(pair)) - first[pair] + 1 - n[pair]
        found = self.run(needles[pair], self.starts[texts[pair]] + offset, n[pair])
        both = n[pair] + np.minimum(offset + n[pair], whole[pair]) - np.maximum(offset, 0)
        return np.maximum.reduceat(percent(both - 2 * found, both), first)


def percent(apart: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, 100.0 * (1 - apart / np.maximum(whole, 1)), 100.0)


def numbered(values: Iterable[str], numbers: dict[str, int]) -> np.ndarray:
    return np.array([numbers.setdefault(v, len(numbers)) for v in values], np.int64)


def kinds(a: list[str], b: list[str]) -> dict[str, np.ndarray]:
    """ratio, token_sort, token_set, weighted and raw (in one) of pairs of strings."""
    numbers: dict[str, int] = {"": 0}
    parts: dict[str, tuple] = {}
    for s in dict.fromkeys(a) | dict.fromkeys(b):
        tokens = s.split()
        parts[s] = (frozenset(tokens), " ".join(sorted(tokens)), " ".join(sorted(set(tokens))))
    rest = [(parts[x][0], parts[y][0]) for x, y in zip(a, b)]
    both = [x & y for x, y in rest]
    joined = lambda tokens: " ".join(sorted(tokens))
    left, right = [joined(x - s) if s else parts[p][2] for (x, _), s, p in zip(rest, both, a)], [joined(y - s) if s else parts[p][2] for (_, y), s, p in zip(rest, both, b)]
    shared = np.array([sum(map(len, s)) + len(s) - 1 if s else 0 for s in both], np.int64)
    ia, ib = numbered(a, numbers), numbered(b, numbers)
    sa, sb = numbered((parts[x][1] for x in a), numbers), numbered((parts[x][1] for x in b), numbers)
    da, db = numbered((parts[x][2] for x in a), numbers), numbered((parts[x][2] for x in b), numbers)
    la, lb = numbered(left, numbers), numbered(right, numbers)
    known = Strings(numbers)
    size = known.lengths

    ratio, token_sort = known.ratio(ia, ib), known.ratio(sa, sb)
    gap = (shared > 0).astype(np.int64)
    whole_a, whole_b = shared + gap + size[la], shared + gap + size[lb]
    token_set = percent(size[la] + size[lb] - 2 * known.lcs(la, lb), whole_a + whole_b)
    beside = np.maximum(percent(gap + size[la], shared + whole_a), percent(gap + size[lb], shared + whole_b))
    token_set = np.where(shared > 0, np.maximum(token_set, beside), token_set)
    token_set = np.where((shared > 0) & ((size[la] == 0) | (size[lb] == 0)), 100.0, token_set)
    token_set = np.where((size[da] == 0) | (size[db] == 0), 0.0, token_set)

    short, long = np.minimum(size[ia], size[ib]), np.maximum(size[ia], size[ib])
    stretch = long / np.maximum(short, 1)
    near = np.maximum(ratio, 0.95 * np.maximum(token_sort, token_set))
    scale = np.where(stretch <= 8, 0.9, 0.6)
    weighted = near
    far = np.flatnonzero((stretch >= 1.5) & (short > 0))
    if len(far):
        one = known.partial(ia[far], ib[far])
        apart = far[shared[far] == 0]
        tokens = np.full(len(a), 100.0)
        tokens[apart] = np.maximum(known.partial(sa[apart], sb[apart]), known.partial(da[apart], db[apart]))
        weighted = near.copy()
        weighted[far] = np.maximum(np.maximum(ratio[far], scale[far] * one), 0.95 * scale[far] * tokens[far])
    weighted = np.where(short > 0, weighted, 0.0)
    return {"ratio": ratio, "token_sort": token_sort, "token_set": token_set, "weighted": weighted, "raw": np.maximum(np.maximum(token_set, token_sort), weighted) / 100.0}


def coverages(a: list[str], b: list[str], least: int, threshold: float, exponent: float) -> np.ndarray:
    """coverage of pairs of a query and a name."""
    numbers: dict[str, int] = {}
    lists = {s: [numbers.setdefault(t, len(numbers)) for t in S.scoring_tokens(s, least)] for s in dict.fromkeys(a) | dict.fromkeys(b)}
    known = Strings(numbers)
    ids = {s: i for i, s in enumerate(lists)}
    count = np.fromiter(map(len, lists.values()), np.int64, len(lists))
    ia, ib = np.fromiter(map(ids.__getitem__, a), np.int64, len(a)), np.fromiter(map(ids.__getitem__, b), np.int64, len(b))
    na, nb = count[ia], count[ib]
    wide = int(count.max(initial=0))
    # tokens of every string, beyond its last one a token of length 0 that is near nothing
    table = np.full((len(lists), wide), len(numbers), np.int32)
    table[np.arange(wide) < count[:, None]] = [t for ts in lists.values() for t in ts]
    lengths = np.append(known.lengths, 0)
    letters = np.append(known.letters(), np.uint64(0))
    top = int(lengths.max(initial=0)) + 1
    x, y = np.meshgrid(np.arange(top), np.arange(top), indexing="ij")
    close = ((2 * np.minimum(x, y) / np.maximum(x + y, 1) >= threshold) & (x > 0) & (y > 0)).ravel()
    rows, columns = (lengths * top)[table].astype(np.int32), lengths[table].astype(np.int32)
    forth, back = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    order = np.lexsort((nb, na))  # pairs of like sizes together, so little is looked at beyond the last token
    order = order[(na[order] > 0) & (nb[order] > 0)]
    at = 0
    while at < len(order):
        to = at + max(1, MOST_TOKEN_PAIRS // int(na[order[at]] * wide))
        own = order[at:to]
        at = to
        n, m = int(na[own].max()), int(nb[own].max())
        pair, i, j = np.nonzero(close[rows[ia[own], :n, None] + columns[ib[own], None, :m]])
        ta, tb = table[ia[own[pair]], i].astype(np.int64), table[ib[own[pair]], j].astype(np.int64)
        # a character that only one of two tokens has is in no common subsequence
        whole = lengths[ta] + lengths[tb]
        common = np.minimum(lengths[ta] - np.bitwise_count(letters[ta] & ~letters[tb]), lengths[tb] - np.bitwise_count(letters[tb] & ~letters[ta]))
        some = (ta == tb) | (2 * common / whole >= threshold - 1e-9)
        pair, i, j, ta, tb = pair[some], i[some], j[some], ta[some], tb[some]
        hit = ta == tb
        other = np.flatnonzero(~hit)
        if len(other):
            keys, where = np.unique(np.minimum(ta[other], tb[other]) * len(numbers) + np.maximum(ta[other], tb[other]), return_inverse=True)
            hit[other] = (known.ratio(keys // len(numbers), keys % len(numbers)) / 100.0 >= threshold)[where]
        pair, i, j = pair[hit], i[hit], j[hit]
        for found, part, width in ((forth, i, n), (back, j, m)):
            marks = np.zeros(len(own) * width, bool)
            marks[pair * width + part] = True
            found[own] = marks.reshape(len(own), width).sum(axis=1)
    told: dict[tuple, float] = {}
    made = np.zeros(len(a))
    for p in np.flatnonzero(forth).tolist():
        key = (forth[p], na[p], back[p], nb[p])
        if key not in told:
            f, n, g, m = map(int, key)
            told[key] = f / n * (g / m) ** exponent
        made[p] = told[key]
    return made


def name_scores(queries: list[str], names: list[str], config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """raw, coverage and name_score of pairs; without coverage the raw ratio isn't worked out where it does not count. Repeated pairs are worked out once."""
    known: dict[tuple[str, str], int] = {}
    back = np.array([known.setdefault(p, len(known)) for p in zip(queries, names)], np.int64)
    a, b = [p[0] for p in known], [p[1] for p in known]
    cover = coverages(a, b, config.min_scoring_token_len, config.token_coverage_threshold, config.compactness_exponent)
    raw = np.zeros(len(a))
    some = np.flatnonzero(cover > 0) if config.use_coverage else np.arange(len(a))
    if len(some):
        raw[some] = kinds([a[i] for i in some.tolist()], [b[i] for i in some.tolist()])["raw"]
    score = raw * cover if config.use_coverage else raw
    return raw[back], cover[back], score[back]
