"""String similarities of many pairs at once, by numpy: longest common subsequences as vectors of bits, 64 characters a word.

All functions take two lists of strings of one length, and give an array of as many numbers.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the weighted ratio: length ratios at which it changes, and weights.
LONGER, MUCH_LONGER = 1.5, 8.0
TOKEN_WEIGHT, PART_WEIGHT, SHORT_PART_WEIGHT = 0.95, 0.9, 0.6

#: Pairs that are worked on together; steps between the windows of a pair that are looked at first, and windows of each further round.
TOGETHER, STRIDE, FEW = 4096, 8, 4
#: Pairs all of whose windows are worked on together.
FEWER = 256


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of different texts as small numbers from 1 on, one text after the other; where each starts; their lengths."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.zeros(int(flat.max(initial=0)) + 1, np.int64)  # a table of all letters: sorting the characters took longer than all else
    known[flat] = 1
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.cumsum(known)[flat], np.cumsum(sizes) - sizes, sizes


def padded(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Characters by place (rows) and text (columns), 0 behind the end."""
    at = np.arange(int(sizes.max(initial=0)))[:, None]
    if not len(codes):
        return np.zeros((len(at), len(sizes)), np.int64)
    out = codes.take(starts + at, mode="clip")
    out[at >= sizes] = 0
    return out


def common(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences."""
    if not len(a):
        return np.zeros(0, np.int64)
    texts = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    return common_of(*coded(list(texts)), *(np.fromiter(map(texts.__getitem__, side), np.int64, len(side)) for side in (a, b)))


def common_of(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of coded texts, given by their numbers.

    The places of each character in a text of x are bits; a word of bits a pair is stepped through the characters of y, with
    the carry of its addition going on to the next word.
    """
    out = np.zeros(len(x), np.int64)
    swap = (sizes[x] > 64) & (sizes[y] < sizes[x])  # fewer words
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    letters = int(codes.max(initial=0)) + 1
    order = np.lexsort((x, sizes[y], -(-sizes[x] // 64)))  # texts of like length together, so that few steps are in vain
    for at in range(0, len(order), TOGETHER):
        mine = order[at : at + TOGETHER]
        mine = mine[np.argsort(sizes[y[mine]], kind="stable")]
        left, row = np.unique(x[mine], return_inverse=True)
        words = max(1, -(-int(sizes[left].max(initial=0)) // 64))
        places = np.zeros((words, len(left) * letters), np.uint64)
        size = sizes[left]
        who = np.repeat(np.arange(len(left)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        code = codes[np.repeat(starts[left], size) + place]
        np.bitwise_or.at(places, (place >> 6, who * letters + code), np.uint64(1) << (place & 63).astype(np.uint64))
        free = np.full((words, len(mine)), ~np.uint64(0))
        base, place, ends = row * letters, starts[y[mine]], sizes[y[mine]]
        done = np.searchsorted(ends, np.arange(int(ends[-1])), "right")  # pairs whose text of y is at its end, which stand first
        if words == 1:
            key, met, new = np.empty(len(mine), np.int64), np.empty(len(mine), np.uint64), np.empty(len(mine), np.uint64)
            for n in done:
                one, k, m, e = free[0, n:], key[n:], met[n:], new[n:]
                np.take(codes, place[n:], out=k, mode="clip")
                np.add(k, base[n:], out=k)
                np.take(places[0], k, out=m, mode="clip")
                np.bitwise_and(one, m, out=m)
                np.add(one, m, out=e)
                np.subtract(one, m, out=one)
                np.bitwise_or(one, e, out=one)
                place += 1
        else:
            for key in padded(codes, place, ends) + base:
                carry = None
                for w in range(words):
                    old, hit = free[w], places[w][key]
                    met = old & hit
                    new = old + met
                    over = new < met
                    if carry is not None:
                        new = new + carry
                        over |= new < carry
                    carry = over.astype(np.uint64)
                    free[w] = new | (old & ~hit)
        used = np.zeros(len(mine), np.int64)
        for w in range(words):
            bits = np.clip(sizes[x[mine]] - 64 * w, 0, 64)
            used += bits - np.bitwise_count(free[w] & below(bits))
        out[mine] = used
    return out


def spread(bits: np.ndarray, size: int) -> np.ndarray:
    """The bits of words (rows) by pair (columns), as flags by place and pair."""
    return np.unpackbits(np.ascontiguousarray(bits.T).view(np.uint8).reshape(bits.shape[1], -1), axis=1, count=size, bitorder="little").T.view(bool)


def jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler similarities: the places of b that are used, and that a letter of a may take, are bits."""
    out = np.zeros(len(a))
    if not len(a):
        return out
    texts = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    codes, starts, sizes = coded(list(texts))
    x, y = (np.fromiter(map(texts.__getitem__, side), np.int64, len(side)) for side in (a, b))
    letters, one = int(codes.max(initial=0)) + 1, np.uint64(1)
    order = np.lexsort((y, sizes[x]))
    for at in range(0, len(order), TOGETHER):
        mine = order[at : at + TOGETHER]
        n, m = sizes[x[mine]], sizes[y[mine]]
        right, row = np.unique(y[mine], return_inverse=True)
        size = sizes[right]
        words = max(1, -(-int(size.max(initial=0)) // 64))
        places = np.zeros((words, len(right) * letters), np.uint64)
        who = np.repeat(np.arange(len(right)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        np.bitwise_or.at(places, (place >> 6, who * letters + codes[np.repeat(starts[right], size) + place]), one << (place & 63).astype(np.uint64))
        reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
        first = padded(codes, starts[x[mine]], n)
        used, took = np.zeros((words, len(mine)), np.uint64), np.zeros((len(first), len(mine)), bool)
        for i, step in enumerate(first):
            key, found = row * letters + step, np.zeros(len(mine), bool)
            low, high = np.maximum(i - reach, 0), np.minimum(m, i + reach + 1)
            for w in range(words):
                inside = below(high - 64 * w) & ~below(low - 64 * w)
                free = places[w][key] & inside & ~used[w]
                free = np.where(found, np.uint64(0), free & (~free + one))  # the least place
                used[w] |= free
                found |= free != 0
            took[i] = found
        same = took.sum(0)
        second = padded(codes, starts[y[mine]], m)
        who, place = np.nonzero(took.T)
        left = first[place, who]
        who, place = np.nonzero(spread(used, 64 * words)[: len(second)].T)
        moved = np.bincount(who[left != second[place, who]], minlength=len(mine)) // 2
        jaro = (same / np.maximum(n, 1) + same / np.maximum(m, 1) + (same - moved) / np.maximum(same, 1)) / 3
        alike, prefix = np.ones(len(mine), bool), np.zeros(len(mine), np.int64)
        for i in range(min(4, len(first), len(second))):
            alike &= (first[i] == second[i]) & (first[i] > 0)
            prefix += alike
        jaro = np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)
        out[mine] = np.where(same > 0, jaro, np.where(n + m == 0, 1.0, 0.0))
    return out


#: Words with the 0 to 64 lowest bits.
LOWEST = np.array([(1 << i) - 1 for i in range(65)], np.uint64)


def below(n: np.ndarray) -> np.ndarray:
    """Words with the n lowest bits, of 0 to 64."""
    return LOWEST.take(n, mode="clip")


def levenshteins(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances."""
    if not len(a):
        return np.zeros(0, np.int64)
    texts = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    return levenshteins_of(*coded(list(texts)), *(np.fromiter(map(texts.__getitem__, side), np.int64, len(side)) for side in (a, b)))


def levenshteins_of(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edit distances of coded texts, given by their numbers: the differences down a column of the table are two words of bits, stepped through the longer text.

    Where both have more than 64 characters, whole numbers of Python are the words.
    """
    out = np.zeros(len(x), np.int64)
    x, y = np.where(sizes[x] <= sizes[y], x, y), np.where(sizes[x] <= sizes[y], y, x)
    for i in np.flatnonzero(sizes[x] > 64):
        out[i] = levenshtein(*("".join(map(chr, codes[starts[j] : starts[j] + sizes[j]].tolist())) for j in (x[i], y[i])))
    letters, one = int(codes.max(initial=0)) + 1, np.uint64(1)
    order = np.lexsort((x, sizes[y]))
    order = order[sizes[x[order]] <= 64]
    for at in range(0, len(order), TOGETHER):
        mine = order[at : at + TOGETHER]
        left, row = np.unique(x[mine], return_inverse=True)
        size, m = sizes[left], sizes[y[mine]]
        places = np.zeros(len(left) * letters, np.uint64)
        who = np.repeat(np.arange(len(left)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        np.bitwise_or.at(places, who * letters + codes[np.repeat(starts[left], size) + place], one << place.astype(np.uint64))
        last = np.maximum(size[row] - 1, 0).astype(np.uint64)
        more, less = np.full(len(mine), ~np.uint64(0)), np.zeros(len(mine), np.uint64)
        distance, base = size[row].copy(), row * letters
        for i, step in enumerate(padded(codes, starts[y[mine]], m)):
            same = places[base + step]
            met = same | less
            across = (((same & more) + more) ^ more) | same
            up, down = less | ~(across | more), more & across
            distance += np.where(i < m, ((up >> last) & one).astype(np.int64) - ((down >> last) & one).astype(np.int64), 0)
            up = (up << one) | one
            more, less = (down << one) | ~(met | up), up & met
        out[mine] = np.where(size[row] == 0, m, distance)
    return out


def levenshtein(a: str, b: str) -> int:
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, len(a) - 1
    more, less, distance = full, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        met = same | less
        across = (((same & more) + more) ^ more) | same
        up, down = (less | ~(across | more)) & full, more & across
        distance += (up >> last & 1) - (down >> last & 1)
        up = (up << 1 | 1) & full
        more, less = (down << 1 | ~(met | up)) & full, up & met
    return distance


def lengths(texts: list[str]) -> np.ndarray:
    return np.array([len(t) for t in texts], np.int64)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    total = lengths(a) + lengths(b)
    return np.where(total == 0, 1.0, 2 * common(a, b) / np.maximum(total, 1))


def in_order(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sorts(a: list[str], b: list[str]) -> np.ndarray:
    sorts = {t: in_order(t) for t in {*a, *b}}
    return ratios(list(map(sorts.__getitem__, a)), list(map(sorts.__getitem__, b)))


def token_sets(a: list[str], b: list[str]) -> np.ndarray:
    """The shared words stand first in both texts, so they are met whole, and only the words behind them are stepped through."""
    out, asked, first, second, whole = np.zeros(len(a)), [], [], [], []
    words = {t: set(t.split()) for t in {*a, *b}}
    sets = {t: (w, sorted(w), sum(map(len, w)) + len(w) - 1) for t, w in words.items()}
    for i, ((x, xs, size), (y, ys, _)) in enumerate(zip(map(sets.__getitem__, a), map(sets.__getitem__, b), strict=True)):
        if x and y:
            left, right = [w for w in xs if w not in y], [w for w in ys if w not in x]
            if not left or not right:
                out[i] = 1.0
                continue
            asked.append(i)
            first.append(" ".join(left))
            second.append(" ".join(right))
            whole.append(size)
    left, right = lengths(first), lengths(second)
    head = np.array(whole, np.int64) - left  # characters of the shared words and the blank behind them, 0 if there are none
    one, two = left + head, right + head
    best = 2 * (common(first, second) + head) / np.maximum(one + two, 1)
    for size in (one, two):
        best = np.where(head > 0, np.maximum(best, 2 * (head - 1) / np.maximum(head - 1 + size, 1)), best)
    out[np.array(asked, np.int64)] = best
    return out


class Windows:
    """All windows of b that a, the shorter one, may be laid on, and the length that a common subsequence with each can have at most.

    At first that is the number of letters they share. Next windows differ by a letter at each end, and so their common subsequences
    by one at most: what is known of one bounds the others by their distance.
    """

    def __init__(self, a: str, b: str):
        self.a, self.b, n = a, b, len(a)
        at = np.arange(1 - n, len(b))
        self.start, self.end, self.place = np.maximum(at, 0), np.minimum(at + n, len(b)), np.arange(len(at))
        self.size = n + self.end - self.start
        x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
        letters, times = np.unique(x, return_counts=True)
        seen = np.zeros((len(letters), len(b) + 1), np.int32)
        np.cumsum(y[None, :] == letters[:, None], axis=1, out=seen[:, 1:])
        self.most = np.minimum(seen[:, self.end] - seen[:, self.start], times[:, None]).sum(0).astype(np.int64)
        self.open = np.ones(len(at), bool)
        self.best = 0.0

    def first(self) -> np.ndarray:
        return np.arange(min(STRIDE, len(self.most)) // 2, len(self.most), STRIDE)

    def told(self, which: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Takes the lengths found for some windows; returns those that may still be better, best bounds first, a few at a time."""
        self.open[which] = False
        self.best = max(self.best, float((2 * found / self.size[which]).max(initial=0.0)))
        self.most[which] = found
        for turn in (slice(None), slice(None, None, -1)):
            self.most = (np.minimum.accumulate((self.most[turn] - self.place)) + self.place)[turn]
        bound = np.where(self.open, 2 * self.most / self.size, 0.0)
        able = np.flatnonzero(bound > self.best)
        return able[np.argsort(-bound[able], kind="stable")[:FEW]]


def partials(a: list[str], b: list[str]) -> np.ndarray:
    """Best ratio of the shorter string with a window of the longer one, windows over its ends included."""
    flip = lengths(a) > lengths(b)
    a, b = [y if f else x for x, y, f in zip(a, b, flip, strict=True)], [x if f else y for x, y, f in zip(a, b, flip, strict=True)]
    n, best = lengths(a), np.zeros(len(a))
    for mask, function in (((n > 0) & (n <= 64), all_windows), (n > 64, bounded_windows)):
        at = np.flatnonzero(mask)
        best[at] = function([a[i] for i in at], [b[i] for i in at])
    return best


def all_windows(a: list[str], b: list[str]) -> np.ndarray:
    """For strings a of 1 to 64 characters, not longer than those of b: from each place of b a word of bits is stepped through a window.

    Windows over the start are what the word from the first place has met on its way.
    """
    best = np.zeros(len(a))
    for at in range(0, len(a), FEWER):
        (codes, starts, sizes), k = coded([*a[at : at + FEWER], *b[at : at + FEWER]]), len(a[at : at + FEWER])
        n, m, letters = sizes[:k], sizes[k:], int(codes.max(initial=0)) + 1
        places, full = np.zeros(k * letters, np.uint64), below(n)
        who = np.repeat(np.arange(k), n)
        place = np.arange(n.sum()) - np.repeat(starts[:k], n)
        np.bitwise_or.at(places, who * letters + codes[: n.sum()], np.uint64(1) << place.astype(np.uint64))
        pair = np.repeat(np.arange(k), m)
        first = np.cumsum(m) - m  # the windows that start at a pair's first place
        start = np.arange(m.sum()) - np.repeat(first, m)
        size = np.minimum(n[pair], m[pair] - start)
        keys = padded(codes, starts[k:][pair] + start, size)
        keys += pair * letters
        free, found = np.full(len(pair), ~np.uint64(0)), best[at : at + k]
        for i, key in enumerate(keys):
            met = free & places[key]
            free = (free + met) | (free - met)
            same = np.where(i < n, n - np.bitwise_count(free[first] & full), 0)
            np.maximum(found, 2 * same / (n + i + 1), out=found)
        same = n[pair] - np.bitwise_count(free & full[pair])
        np.maximum.at(found, pair, 2 * same / (n[pair] + size))
    return best


def bounded_windows(a: list[str], b: list[str]) -> np.ndarray:
    """For any strings a that are not empty and not longer than those of b.

    Some windows are looked at in equal steps, then those whose bounds are above the best ratio, until there are none.
    """
    best, waiting = np.zeros(len(a)), []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        windows = Windows(x, y)
        waiting.append((i, windows, windows.first()))
    while waiting:
        first = [w.a for _, w, which in waiting for _ in which]
        found = common(first, [w.b[s:e] for _, w, which in waiting for s, e in zip(w.start[which], w.end[which], strict=True)])
        later, at = [], 0
        for i, windows, which in waiting:
            more = windows.told(which, found[at : at + len(which)])
            at += len(which)
            best[i] = windows.best
            if len(more):
                later.append((i, windows, more))
        waiting = later
    return best


def wratios(a: list[str], b: list[str]) -> np.ndarray:
    return weighted(a, b, ratios(a, b), token_sorts(a, b), token_sets(a, b))


def weighted(a: list[str], b: list[str], ratio: np.ndarray, token_sort: np.ndarray, token_set: np.ndarray) -> np.ndarray:
    """Weighted ratios, from the others of the same pairs."""
    x, y = lengths(a), lengths(b)
    full = (x > 0) & (y > 0)
    spread = np.maximum(x, y) / np.maximum(np.minimum(x, y), 1)
    out = np.where(full, ratio, 0.0)
    out = np.where(full & (spread < LONGER), np.maximum(out, TOKEN_WEIGHT * np.maximum(token_sort, token_set)), out)
    at = np.flatnonzero(full & (spread >= LONGER))
    p, q = [a[i] for i in at], [b[i] for i in at]
    weight = np.where(spread[at] <= MUCH_LONGER, PART_WEIGHT, SHORT_PART_WEIGHT)
    sets = [(set(x.split()), set(y.split())) for x, y in zip(p, q, strict=True)]
    subset = np.ones(len(at))
    apart = [i for i, (x, y) in enumerate(sets) if not x & y]
    subset[apart] = partials([" ".join(sorted(sets[i][0])) for i in apart], [" ".join(sorted(sets[i][1])) for i in apart])
    tokens = np.maximum(partials([in_order(x) for x in p], [in_order(y) for y in q]), subset)
    out[at] = np.maximum(out[at], np.maximum(weight * partials(p, q), TOKEN_WEIGHT * weight * tokens))
    return out


#: What similarities gives: of names, of their cores, of addresses and of names in their own script.
SIMILARITIES = {
    "name_ratio": (0, "ratio"), "name_wratio": (0, "wratio"), "name_token_set": (1, "token_set"), "name_token_sort": (1, "token_sort"), "name_jaro": (0, "jaro"),
    "address_ratio": (2, "ratio"), "address_wratio": (2, "wratio"), "address_token_set": (2, "token_set"), "address_jaro": (2, "jaro"), "original_script_name_ratio": (3, "ratio"),
}


def similarities(*sides: tuple[list[str], list[str]]) -> dict[str, np.ndarray]:
    """SIMILARITIES of records, from pairs of names, cores, addresses and original names; each different pair of strings is looked at once."""
    pairs: dict[tuple[str, str], int] = {}
    at = [np.fromiter((pairs.setdefault(p, len(pairs)) for p in zip(a, b, strict=True)), np.int64, len(a)) for a, b in (sides[0], sides[1], sides[2])]
    most = len(pairs)  # those of original names alone, which come last, have nothing but a ratio
    at.append(np.fromiter((pairs.setdefault(p, len(pairs)) for p in zip(*sides[3], strict=True)), np.int64, len(sides[3][0])))
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    found = {"ratio": ratios(a, b)}
    a, b = a[:most], b[:most]
    found |= {"token_sort": token_sorts(a, b), "token_set": token_sets(a, b), "jaro": jaro_winklers(a, b)}
    found["wratio"] = weighted(a, b, found["ratio"][:most], found["token_sort"], found["token_set"])
    return {name: found[kind][at[side]] for name, (side, kind) in SIMILARITIES.items()}
