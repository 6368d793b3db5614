"""Periodic runs of words, found by linear tandem repeats on a suffix tree, and texts without their repetitions.

Stretches of a document that could hold a run are found for many documents at once: a run of `least` words and `times` periods
repeats all its grams of `gram` words one period further on, so stretches whose grams don't come again soon enough hold none. On each
stretch left:

1. Lempel-Ziv blocks are read off a suffix tree. Squares whose centre lies in a block, by common extensions around the block's two
   ends, cover the leftmost occurrence of every kind of square.
2. Each such square is placed in the tree where its first occurrence is the leftmost leaf.
3. From each place, suffix links lead to the rotations of the square that also occur, until one is marked: the complete vocabulary.
4. The leaves below primitive squares are their occurrences; those that follow each other with one period merge into a run.

All comparisons are exact: words are numbered, and extensions are compared by ranks of substrings of doubling length.

Rows: a null or blank text has no words, no runs, and becomes the empty text. Repeated rows, and rows of one id, are each told alike. Other
columns are kept. A document must fit a task; a stretch takes about half a kilobyte a word while it is worked on.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import PORTION, U64, fresh, mix

#: A run has so many words and periods at least.
LEAST, TIMES = 24, 3
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_ODD = U64(0x9E3779B97F4A7C15)


class Tree:
    """The suffix tree of numbers with an end mark, built from left to right: nodes by number, 0 the root."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.s = [*ids.tolist(), int(ids.max()) + 1 if self.n else 0]
        self.width = self.s[-1] + 1
        self._build()
        self._order()

    def _build(self) -> None:
        s, width = self.s, self.width
        n = len(s)
        first, end, link, kids = [0], [0], [0], {}
        node = edge = length = waiting = 0
        for i, c in enumerate(s):
            last = 0
            waiting += 1
            while waiting:
                if not length:
                    edge = i
                key = node * width + s[edge]
                below = kids.get(key)
                if below is None:
                    kids[key] = len(first)
                    first.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    at = first[below]
                    size = (end[below] if end[below] <= i else i + 1) - at
                    if length >= size:
                        edge += size
                        length -= size
                        node = below
                        continue
                    if s[at + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    middle = len(first)
                    first += (at, i)
                    end += (at + length, n)
                    link += (0, 0)
                    kids[key] = middle
                    kids[middle * width + c] = middle + 1
                    first[below] = at + length
                    kids[middle * width + s[at + length]] = below
                    if last:
                        link[last] = middle
                    last = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.first, self.end, self.link, self.kids = first, end, link, kids

    def _order(self) -> None:
        """Parents, depths, the least leaf below each node, and leaves in the order of a walk."""
        total, n = len(self.first), len(self.s)
        keys = np.fromiter(self.kids.keys(), np.int64, len(self.kids)) // self.width
        below = np.fromiter(self.kids.values(), np.int64, len(self.kids))
        parent = np.zeros(total, np.int64)
        parent[below] = keys
        by = np.argsort(keys, kind="stable")
        offsets = np.searchsorted(keys[by], np.arange(total + 1)).tolist()
        below = below[by].tolist()
        size = (np.array(self.end) - np.array(self.first)).tolist()
        depth, walk, stack = [0] * total, [], [0]
        while stack:
            v = stack.pop()
            walk.append(v)
            some = below[offsets[v] : offsets[v + 1]]
            if some:
                d = depth[v]
                for w in some:
                    depth[w] = d + size[w]
                stack += some
        least, held = [n] * total, [1] * total
        up = parent.tolist()
        for v in reversed(walk):
            if offsets[v] == offsets[v + 1]:
                least[v] = n - depth[v]
            if v:
                u = up[v]
                if least[v] < least[u]:
                    least[u] = least[v]
                held[u] += held[v]
        self.parent, self.depth, self.least = up, depth, least
        walk = np.array(walk)
        place = np.empty(total, np.int64)
        place[walk] = np.arange(total)
        leaf = np.array(self.end)[walk] == n
        leaf &= np.diff(np.array(offsets))[walk] == 0
        self.leaves = n - np.array(depth)[walk[leaf]]
        upto = np.concatenate(([0], np.cumsum(leaf)))
        self.low = upto[place].tolist()
        self.high = upto[place + np.array(held)].tolist()
        self.leaf_of = np.empty(n, np.int64)
        self.leaf_of[self.leaves] = walk[leaf]

    def earlier(self) -> np.ndarray:
        """For each place, the length of the longest prefix from there that also starts further left."""
        least, up = np.array(self.least), np.array(self.parent)
        top = np.flatnonzero(least != least[up])
        out = np.zeros(len(self.s), np.int64)
        out[least[top]] = np.array(self.depth)[up[top]]
        return out


class Ranks:
    """Equal numbers for equal substrings of each length 2**j: common extensions in log steps, without hashing."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.levels = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
        while 2 << (len(self.levels) - 1) <= self.n:
            r, half = self.levels[-1], 1 << (len(self.levels) - 1)
            pair = r[: len(r) - half] * (self.n + 1) + r[half:]
            self.levels.append(np.unique(pair, return_inverse=True)[1])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the texts from a and from b agree."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            r = self.levels[j]
            x, y = a + out, b + out
            fits = (x < len(r)) & (y < len(r))
            fits[fits] = r[x[fits]] == r[y[fits]]
            out[fits] += 1 << j
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the texts up to a and up to b, both included, agree."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            r = self.levels[j]
            x, y = a - out - (1 << j) + 1, b - out - (1 << j) + 1
            fits = (x >= 0) & (y >= 0) & (x < len(r)) & (y < len(r))
            fits[fits] = r[x[fits]] == r[y[fits]]
            out[fits] += 1 << j
        return out

    def same(self, a: int, b: int, length: int) -> bool:
        if length <= 0:
            return True
        j = length.bit_length() - 1
        r, tail = self.levels[j], length - (1 << j)
        return r[a] == r[b] and r[a + tail] == r[b + tail]


def covering_squares(ids: np.ndarray, tree: Tree, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of squares that cover the leftmost occurrence of every kind of square."""
    n, earlier = len(ids), tree.earlier().tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += max(1, earlier[i])
    h = np.array(starts)
    h1 = np.append(h[1:], n)  # where the next block starts, and where it ends
    h2 = np.append(h1[1:], n)

    def each(sizes):
        block = np.repeat(np.arange(len(sizes)), sizes)
        return block, np.arange(len(block)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1

    # the square's second half starts in the block, left of its end
    block, k = each(np.where(h1 < n, h1 - h, 0))
    at = h1[block]
    q = at - k
    fwd, back = ranks.forward(at, q), ranks.backward(at - 1, q - 1)
    good = (fwd + back >= k) & (fwd > 0)
    s1, l1 = np.maximum(q - back, q - k + 1)[good], 2 * k[good]
    # and those that start left of the block or at its start
    block, k = each(h2 - h)
    at = h[block]
    q = at + k
    live = q < n
    block, k, at, q = block[live], k[live], at[live], q[live]
    fwd, back = ranks.forward(at, q), ranks.backward(at - 1, q - 1)
    s2 = np.maximum(at - back, at - k + 1)
    good = (fwd + back >= k) & (fwd > 0) & (s2 + k <= h1[block]) & (back > 0)
    return np.concatenate((s1, s2[good])), np.concatenate((l1, 2 * k[good]))


def vocabulary(tree: Tree, starts: np.ndarray, lengths: np.ndarray) -> set[tuple[int, int]]:
    """(node, length) of every kind of square: it ends on the edge to the node, or at it."""
    s, kids, width, depth, up, least, link = tree.s, tree.kids, tree.width, tree.depth, tree.parent, tree.least, tree.link
    earlier = tree.earlier()
    first = lengths > earlier[starts]  # others have an occurrence further left, which is covered
    by = np.lexsort((-lengths[first], starts[first]))
    marked, before = set(), -1
    for m, size in zip(starts[first][by].tolist(), lengths[first][by].tolist()):
        if m != before:
            v, before = int(tree.leaf_of[m]), m
        while depth[up[v]] >= size:
            v = up[v]
        marked.add((v, size))
    for v, size in list(marked):
        while True:
            m, u = least[v], up[v]
            w = link[u]
            d = depth[w]
            below = kids[w * width + s[m + 1 + d]]
            while depth[below] < size - 1:
                w, d = below, depth[below]
                below = kids[w * width + s[m + 1 + d]]
            if depth[below] == size - 1:
                v = kids.get(below * width + s[m])
                if v is None:
                    break
            elif s[least[below] + size - 1] == s[m]:
                v = below
            else:
                break
            if (v, size) in marked:
                break
            marked.add((v, size))
    return marked


@lru_cache(1 << 16)
def _primes(p: int) -> tuple[int, ...]:
    out, d = [], 2
    while d * d <= p:
        if p % d == 0:
            out.append(d)
            while p % d == 0:
                p //= d
        d += 1
    return tuple(out + [p] if p > 1 else out)


def all_runs(ids: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all maximal repetitions with at least two periods, by start and period."""
    if len(ids) < 2:
        return np.empty((0, 3), np.int64)
    tree, ranks = Tree(ids), Ranks(ids)
    found, periods = [], []
    for v, size in vocabulary(tree, *covering_squares(ids, tree, ranks)):
        p, i = size // 2, tree.least[v]
        if not any(ranks.same(i, i + p // r, p - p // r) for r in _primes(p)):
            at = tree.leaves[tree.low[v] : tree.high[v]]
            found.append(at)
            periods.append(np.full(len(at), p))
    if not found:
        return np.empty((0, 3), np.int64)
    at, p = np.concatenate(found), np.concatenate(periods)
    by = np.lexsort((at, p))
    at, p = at[by], p[by]
    cut = np.flatnonzero((p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])) - 1
    out = np.stack((at[lo], at[hi] - at[lo] + 2 * p[lo], p[lo]), 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def stretches(ids: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Parts of texts, one behind the other, that hold all their runs; `text` tells which one each number belongs to.

    A run of period p has (times - 1) * p - gram + 1 places in a row, or more, whose gram comes again within p places.
    """
    gram = least - least // times
    n = len(ids) - gram + 1
    if n < 2:
        return []
    with np.errstate(over="ignore"):
        values = mix(ids.astype(U64) + U64(1))
        h = np.zeros(n, U64)
        for k in range(gram):
            h = h * _ODD + values[k : k + n]
        h = mix(h + mix(text[:n].astype(U64)))
    inside = np.flatnonzero(text[gram - 1 :] == text[:n])
    by = inside[np.argsort(h[inside], kind="stable")]
    again = h[by[1:]] == h[by[:-1]]
    gap = np.zeros(n, np.int64)
    gap[by[:-1][again]] = (by[1:] - by[:-1])[again]
    live = gap > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], live, [False]))))
    lo, hi = edge[::2], edge[1::2]
    if not len(lo):
        return []
    # a stretch ends with its text
    size = hi - lo
    near = np.minimum.reduceat(np.append(gap, 0), np.stack((lo, hi), 1).ravel())[::2]
    longest = (size + gram - 1) // (times - 1)
    keep = near <= longest
    lo, hi = lo[keep], hi[keep] + gram - 1 + longest[keep]
    out: list[tuple[int, int]] = []
    for a, b in zip(lo.tolist(), hi.tolist()):
        b = min(b, int(np.searchsorted(text, text[a], "right")))
        if out and a <= out[-1][1] and text[a] == text[out[-1][0]]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return [(a, b) for a, b in out if b - a >= least]


def runs_of(texts: list[list], least: int = LEAST, times: int = TIMES) -> dict[int, np.ndarray]:
    """Rows (start, length, period), by start and period, for each list of words that has runs, by its place."""
    flat = [w for t in texts for w in t]
    number = dict(zip(flat, range(len(flat))))
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    sizes = np.array([len(t) for t in texts], np.int64)
    text, begin = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    out: dict[int, list[np.ndarray]] = {}
    for lo, hi in stretches(ids, text, least, times):
        part = all_runs(np.unique(ids[lo:hi], return_inverse=True)[1])
        part = part[(part[:, 1] >= least) & (part[:, 1] >= times * part[:, 2])]
        if len(part):
            k = int(text[lo])
            part[:, 0] += lo - begin[k]
            out.setdefault(k, []).append(part)
    return {k: np.concatenate(v) for k, v in out.items()}


def without_repeats(words: list, runs: np.ndarray) -> list:
    """The words that no run holds behind its first period."""
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(step[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def collapse_runs(docs: DataFrame, text: str = "text", runs: str = "runs", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Each row with its runs (start, length and period in words, by start and period) in a new column, and its text without repetitions.

    A run is a stretch of words with smallest period p and at least max(least, times * p) words that can't be extended. Words are runs
    without ASCII white space; of each run, the words behind its first period go, the others are joined by one space.
    """
    if runs in docs.columns:
        (runs,) = fresh(docs.columns, runs)
    at = docs.columns.index(text)
    schema = T.StructType([*(T.StructField(f.name, T.StringType()) if f.name == text else f for f in docs.schema), T.StructField(runs, RUNS)])
    cells = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
    names = [f.name for f in schema]

    def run(batches):
        for b in batches:
            raw = b.column(at).cast(pa.binary())
            lo = 0
            while lo < b.num_rows:
                hi, size, held = lo, 0, []
                while hi < b.num_rows and (hi == lo or size < PORTION):
                    whole = raw[hi].as_py() or b""
                    held.append(whole.split())
                    size += len(whole)
                    hi += 1
                found = runs_of(held, least, times)
                texts = [b" ".join(without_repeats(w, found[k]) if k in found else w) for k, w in enumerate(held)]
                told = [[dict(zip(("start", "length", "period"), r)) for r in found[k].tolist()] if k in found else [] for k in range(len(held))]
                columns = [c.slice(lo, hi - lo) for c in b.columns]
                columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(told, cells)], names)
                lo = hi

    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(run, schema)
