"""Fuzzy line dedup: keys from minima over neighbouring words, edit similarity, one occurrence kept for each connected group.

Lines are normalised (lower case, letters and digits only, single spaces). Equal lines fold into one before
anything is joined. Each distinct line gets `KEYS` keys: minima over its hashed pairs of neighbouring words, two to a key, or, for a
short line, the line itself and all ways to leave one word out. Keys are dealt into buckets as packed arrays, so no
row is made for a key that one line alone has. Lines under one key whose lengths let them be alike are tied to the first of them; ties are verified by
the edit similarity of the whole normalised lines. Such lines that still lie in several connected groups are then compared in full,
block by block: every two of them whose groups nothing joins yet. Of each connected group the first occurrence stays,
by document id and line number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import U64, alike, alike_pairs, connected_components, flags, fresh, letters, materialize, mix, plain_word, plain_words, portions, wide_rows

SIMILARITY = 0.85
#: Keys of a line, and minima of a key; a line of fewer words than keys has keys with words left out instead of minima.
KEYS, MINIMA = 10, 2
#: Lines of fewer words or characters stay: that short ones repeat says nothing.
WORDS, CHARS = 3, 12
#: Keys that a bucket should hold; keys packed at once; lines of one key among those from which they are left in place.
BUCKET, PACKED, MANY = 500_000, 1_000_000, 64
#: Lines of a key that are compared with one another, or with as many others, in one task.
BLOCK = 500
#: Pairs of lines of a key that are looked at first, and at most, before what was found joins them; pairs whose letters are counted at once.
WAVE, WAVES, SLICE = 1 << 12, 1 << 18, 1 << 14
#: Hash values by which runs of three characters are counted.
GRAMS = 1024
#: Parts of a large group that are told its first line apart.
SALTS = 16
_SEEDS = np.random.default_rng(17).integers(0, 1 << 63, MINIMA * KEYS).astype(U64)
_FACTORS = np.random.default_rng(18).integers(0, 1 << 62, MINIMA * KEYS).astype(U64) * U64(2) + U64(1)
_POWERS = np.cumprod(np.concatenate([[U64(1)], np.full(1 << 12, U64(0x9E3779B97F4A7C15), U64)]), dtype=np.uint64)
_NAMES = [f"k{t}" for t in range(KEYS)]


def plain_line(line: str) -> str:
    return b" ".join(w for x in line.encode().split() if (w := plain_word(x))).decode()


def line_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text, line number, hashed words line by line, words of each line, characters of each normalised line, the lines) of the lines that are long enough to count."""
    lines = [t.split(b"\n") for t in texts]
    counts = np.array([len(x) for x in lines])
    every = [x for own in lines for x in own]
    w, line, letters = plain_words(texts)
    n = np.bincount(line, minlength=len(every))
    size = np.bincount(line, letters, len(every)).astype(np.int64) + n - 1
    keep = (n >= WORDS) & (np.fromiter(map(len, every), np.int64, len(every)) >= CHARS)
    text = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(every)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text[keep], number[keep], w[keep[line]], n[keep], size[keep], [every[i] for i in np.flatnonzero(keep).tolist()]


def _at(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum(n) - n
    return starts, np.arange(int(n.sum())) - np.repeat(starts, n)


def fold(w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One hash for each run of n words, that depends on their order."""
    if not len(n):
        return np.empty(0, U64)
    starts, pos = _at(n)
    with np.errstate(over="ignore"):
        p = _POWERS[pos & 4095] * _POWERS[(pos >> 12) & 4095] * (U64(1) + U64(2) * (pos >> 12).astype(U64))
        return mix(np.add.reduceat(w * p, starts) ^ n.astype(U64))


def line_keys(w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(runs, KEYS) keys of each run of n hashed words; 0 where it has fewer. From KEYS words on, minima over pairs of neighbouring
    words; below, the whole run and every way to leave one word out."""
    if not len(n):
        return np.empty((0, KEYS), U64)
    starts, _ = _at(n)
    keys = np.zeros((len(n), KEYS), U64)
    with np.errstate(over="ignore"):
        pairs = mix(w * U64(0x9E3779B97F4A7C15) + np.roll(w, -1))  # the last word of a run pairs with its first, so all words count alike
        ends = starts + n - 1
        pairs[ends] = mix(w[ends] * U64(0x9E3779B97F4A7C15) + w[starts])
        for t in range(KEYS):
            key = np.full(len(n), U64(t))
            for i in range(MINIMA * t, MINIMA * (t + 1)):
                key = mix(key * U64(31) + np.minimum.reduceat((pairs ^ _SEEDS[i]) * _FACTORS[i], starts))
            keys[:, t] = key
    for size in range(1, KEYS):
        rows = np.flatnonzero(n == size)
        if len(rows):
            own = w[starts[rows][:, None] + np.arange(size)]
            keys[rows] = 0
            keys[rows, 0] = fold(own.ravel(), np.full(len(rows), size))
            for gone in range(size if size > 2 else 0):
                keys[rows, 1 + gone] = fold(np.delete(own, gone, axis=1).ravel(), np.full(len(rows), size - 1))
    return keys


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, line, h, raw, size, k0, ...) of every line that counts; docs: (_id, _t). raw is the hash of the line as it stands, size its letters and digits."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for first, texts in portions(b.column(1)):
                at, no, w, n, size, own = line_hashes(texts)
                raw = np.fromiter(map(xxhash.xxh3_64_intdigest, own), U64, len(own))
                keys = line_keys(w, n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + at]), pa.array(no.astype(np.int32)), pa.array(fold(w, n).view(np.int64)), pa.array(raw.view(np.int64)), pa.array(size.astype(np.int32)), *(pa.array(np.ascontiguousarray(keys[:, t]).view(np.int64)) for t in range(KEYS))], ["doc", "line", "h", "raw", "size", *_NAMES])

    return docs.mapInArrow(run, ", ".join(["doc long", "line int", "h long", "raw long", "size int", *(f"{k} long" for k in _NAMES)]))


def _place(doc: str, line: str) -> Column:
    """One number that orders lines by document id, then line number: aggregates of it need no sorting, unlike those of a struct."""
    return F.expr(f"cast({doc} as decimal(20,0)) * 2147483648BD + {line}").cast("decimal(32,0)")


#: A bit of a size that says that the line stands for very many lines of its key.
_HOT = 1 << 30


def _packed(lines: DataFrame, buckets: int) -> DataFrame:
    """(bucket, keys, lines, sizes, leads): the keys of lines, packed by bucket. Lines of a key that very many of the lines at hand
    have are left in place, with the first of them as lead, which alone goes into the bucket for them all. Equal lines at hand count once."""

    def run(batches):
        def pack(h, key, size):
            order = np.lexsort((h, key))
            order = order[np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (h[order][1:] != h[order][:-1])])]
            h, key, size = h[order], key[order], size[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff([*first, len(key)])
            many, lead = np.repeat(n >= MANY, n), np.repeat(first, n)
            if many.any():
                for lo in range(0, int(many.sum()), BUCKET):
                    at = np.flatnonzero(many)[lo : lo + BUCKET]
                    yield pa.RecordBatch.from_arrays([pa.array([int(key[at[0]] % U64(buckets))], pa.int32()), pa.array([key[at].tobytes()]), pa.array([h[at].tobytes()]), pa.array([b""]), pa.array([h[lead[at]].tobytes()])], _BLOBS)
                size = size | np.where(many, _HOT, 0).astype(np.int32)
            go = ~many | (lead == np.arange(len(key)))
            h, key, size = h[go], key[go], size[go]
            part = (key % U64(buckets)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, cols = part[order], [x[order] for x in (key, h, size)]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
            ends = [*cuts[1:], len(part)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), *(pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()) for x in cols), pa.nulls(len(cuts), pa.binary())], _BLOBS)

        held: list[list[np.ndarray]] = [[], [], []]
        n = 0
        for b in batches:
            h, size = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for t in range(KEYS):
                k = b.column(2 + t).to_numpy(zero_copy_only=False).view(U64)
                live = k != 0
                for x, y in zip(held, (h, k, size)):
                    x.append(y[live])
                n += int(live.sum())
            if n >= PACKED:
                yield from pack(*map(np.concatenate, held))
                held, n = [[], [], []], 0
        if n:
            yield from pack(*map(np.concatenate, held))

    return lines.select("h", "size", *_NAMES).mapInArrow(run, "bucket int, keys binary, lines binary, sizes binary, leads binary")


_BLOBS = ["bucket", "keys", "lines", "sizes", "leads"]


def _shared(packed: DataFrame, similarity: float) -> DataFrame:
    """(key, h, lead): the lines that share a key and may be alike by their lengths, as a key of their own, with the first of them."""

    def run(batches):
        def rows(key, h, lead):
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h), pa.array(lead)], ["key", "h", "lead"])

        def told(keys, lines, sizes):
            key, h, size = np.frombuffer(b"".join(keys), U64), np.frombuffer(b"".join(lines), np.int64), np.frombuffer(b"".join(sizes), np.int32)
            hot = np.isin(key, key[size >= _HOT])  # such a key stays in one piece, as its lines were left in place under its name
            size = np.where(hot, 0, size)
            order = np.lexsort((h, size, key))
            order = order[np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (h[order][1:] != h[order][:-1])])]  # equal lines of several batches
            key, h, size, hot = key[order], h[order], size[order], hot[order]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (size[:-1] < similarity * size[1:] - 1e-9)]))
            n = np.diff([*first, len(key)])
            some, lead = np.repeat(n > 1, n), h[np.repeat(first, n)]
            return rows(np.where(hot, key, mix(key + lead.view(U64)))[some], h[some], lead[some])

        now, held = None, ([], [], [])
        for b in batches:
            for bucket, *blobs, leads in zip(*(b.column(c) for c in range(5))):
                if leads.is_valid:
                    yield rows(np.frombuffer(blobs[0].as_py(), U64), np.frombuffer(blobs[1].as_py(), np.int64), np.frombuffer(leads.as_py(), np.int64))
                    continue
                if bucket.as_py() != now:
                    if held[0]:
                        yield told(*held)
                    now, held = bucket.as_py(), ([], [], [])
                for x, y in zip(held, blobs):
                    x.append(y.as_py())
        if held[0]:
            yield told(*held)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, h long, lead long")


def _texts(ids: DataFrame, docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h, s): the normalised line of each hash in ids (h)."""
    ends = materialize(ids.distinct().join(distinct.select("h", "raw"), "h"), "ends")
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(flags(ends, "raw")))

    def texts(batches):
        bits = np.unpackbits(wanted.value).view(bool)
        mask = len(bits) - 1
        for b in batches:
            found: dict[int, bytes] = {}
            for t in b.column(1):
                for x in t.as_py().split(b"\n"):
                    if len(x) >= CHARS:
                        r = xxhash.xxh3_64_intdigest(x)
                        if bits[r & mask]:
                            found[r] = x
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(found), U64).view(np.int64)), pa.array([plain_line(x.decode("utf-8", "replace")) for x in found.values()], pa.string())], ["r", "s"])

    s = docs.mapInArrow(texts, "r long, s string").join(ends, F.col("r") == F.col("raw")).select("h", "s").dropDuplicates(["h"])
    with wide_rows(docs.sparkSession):
        return materialize(s, "lines")


def _counts(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(length, characters counted by code modulo 32) of each line."""
    size = np.array([len(x) for x in lines])
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    counts = np.bincount(np.repeat(32 * np.arange(len(lines)), size) + codes % 32, minlength=32 * len(lines))
    return size, counts.reshape(-1, 32).astype(np.int32)


def _grams(lines: list[str]) -> np.ndarray:
    """Three neighbouring characters of each line, counted by hash modulo GRAMS."""
    size = np.array([len(x) for x in lines])
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(U64)
    with np.errstate(over="ignore"):
        h = (codes[:-2] * U64(0x9E3779B97F4A7C15) + codes[1:-1]) * U64(0x9E3779B97F4A7C15) + codes[2:]
        h = (h * U64(0xFF51AFD7ED558CCD)) >> U64(40)
    line = np.repeat(np.arange(len(lines)), size)[: len(h)]
    own = np.arange(len(h)) + 3 <= np.cumsum(size)[line]
    places = line[own] * GRAMS + (h[own] % U64(GRAMS)).astype(np.int64)
    return np.bincount(places, minlength=GRAMS * len(lines)).reshape(-1, GRAMS).astype(np.int32)


def _close(size, grams, other_size, other_grams, similarity: float) -> np.ndarray:
    """Can these lines be alike? An edit changes three runs of three characters at most."""
    most = ((1 - similarity) * np.maximum(size, other_size) + 1e-9).astype(np.int64)
    more = grams - other_grams
    return np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1)) <= 3 * most


def _near(size, counts, other_size, other_counts, similarity: float) -> np.ndarray:
    """Can these lines be alike? An edit takes at most one character away and gives one."""
    most = ((1 - similarity) * np.maximum(size, other_size) + 1e-9).astype(np.int64)
    more = counts - other_counts
    return (np.abs(size - other_size) <= most) & (np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1)) <= most)


def _verified(ties: DataFrame, s: DataFrame, similarity: float) -> DataFrame:
    """The ties whose normalised lines (s, of each h) are alike enough, over their whole length."""
    both = ties.join(s.select(F.col("h").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("h").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep = _near(*_counts(x), *_counts(y), similarity)
            at = np.flatnonzero(keep)
            keep[at] = alike_pairs(x + y, letters(x + y), at, len(x) + at, similarity)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _open_groups(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, h, c): the lines of the keys whose lines lie in several components, each set of lines under one of its keys only."""
    named = shared.select("key", "h").join(parts.select(F.col("node").alias("h"), "component"), "h", "left").select("key", "h", F.coalesce("component", "h").alias("c"))
    # two lines have been compared as a tie already
    mixed = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count_distinct("h").alias("n")).where("low <> high and n > 2").select("key")
    rows = materialize(named.join(mixed, "key").distinct(), "open")
    same = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("h")).alias("x"), F.min("h").alias("low"), F.max("h").alias("high"))
    once = same.groupBy("n", "x", "low", "high").agg(F.min("key").alias("key"), F.first("n").alias("size")).select("key", "size")
    return rows.join(once, "key")


def _waves(size: np.ndarray, counts: np.ndarray, c: np.ndarray, similarity: float, left: np.ndarray | None = None, own_pairs=None):
    """Yields pairs (i, j) of lines that may be alike and lie in different components c, is sent which are, and returns links that join
    components: each two lines are compared unless something joins theirs already. Waves grow, as one line may join a whole group.

    With `left`, only pairs of a line of the left and one of the right; with `own_pairs`, only those that it lets through."""
    own, links = c.copy(), []
    names, many = np.unique(c, return_counts=True)
    largest = names[np.argmax(many)]
    order = np.concatenate([np.flatnonzero(c != largest), np.flatnonzero(c == largest)])
    # two lines of the largest need no comparison, so only those of the others look at all after them
    place, upto, cells = 0, int((c != largest).sum()), WAVE
    while place < upto:
        rest = order[place:]
        first = rest[: min(upto - place, max(1, cells // len(rest)))]
        ok = (own[first][:, None] != own[rest]) & (np.arange(len(first))[:, None] < np.arange(len(rest)))
        if left is not None:
            ok &= left[first][:, None] != left[rest]
        short, long = np.minimum(size[first][:, None], size[rest]), np.maximum(size[first][:, None], size[rest])
        i, j = np.nonzero(ok & (long - short <= (1 - similarity) * long + 1e-9))
        i, j = first[i], rest[j]
        near = [_near(size[j[k : k + SLICE]], counts[j[k : k + SLICE]], size[i[k : k + SLICE]], counts[i[k : k + SLICE]], similarity) for k in range(0, len(i), SLICE)]
        if near:
            near = np.concatenate(near)
            i, j = i[near], j[near]
            if own_pairs is not None:
                mine = own_pairs(i, j)
                i, j = i[mine], j[mine]
            hit = yield i, j
            for p, q in zip(i[hit].tolist(), j[hit].tolist()):
                if own[p] != own[q]:
                    own[own == own[q]] = own[p]
                    links.append((q, p))
        place, cells = place + len(first), min(4 * cells, WAVES)
    return links


def _joined(lines: list[str], told, waves: list, starts: list[int], similarity: float) -> list[tuple[int, int]]:
    """The links of many waves at once; those of a wave count lines from its start."""
    out, sent = [], [None] * len(waves)
    while waves:
        asked, live = [], []
        for wave, lo, x in zip(waves, starts, sent):
            try:
                i, j = wave.send(x)
            except StopIteration as end:
                out += [(lo + p, lo + q) for p, q in end.value]
                continue
            asked.append((lo + i, lo + j))
            live.append((wave, lo))
        if not live:
            break
        hits = alike_pairs(lines, told, *map(np.concatenate, zip(*asked)), similarity)
        sent = np.split(hits, np.cumsum([len(i) for i, _ in asked])[:-1])
        waves, starts = map(list, zip(*live))
    return out


def joining(lines: list[str], c: np.ndarray, similarity: float, left: np.ndarray | None = None, counted: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs of alike lines that join the components c. With `left`, only pairs of a line of the left and one of the right."""
    return _joined(lines, letters(lines), [_waves(*(counted or _counts(lines)), c, similarity, left)], [0], similarity)


def _runs(batches, columns: int):
    """Whole keys of a stream sorted by its first column, as arrays of columns; later ones than integers as objects."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        x = [np.concatenate(y) for y in zip(held, new)] if held else new
        cut = int(np.searchsorted(x[0], x[0][-1]))
        if cut:
            yield [y[:cut] for y in x]
        held = [y[cut:] for y in x]
    if held:
        yield held


def _first_shared(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The smallest key that stands in a row of both."""
    out = np.full(len(keys), np.iinfo(np.int64).max)
    for t in range(others.shape[1]):
        shared = (keys == others[:, t : t + 1]).any(1)
        out[shared] = np.minimum(out[shared], others[shared, t])
    return out


def _group_links(groups: DataFrame, s: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of alike lines that join the components of each group; s: the normalised line of each h.

    A group is cut into blocks of about BLOCK lines, and every two blocks meet in a task of their own: none holds more than two blocks.
    Two lines that several groups hold are compared in that of the smallest key alone."""
    own = groups.groupBy("h").agg(F.collect_list(F.struct("key", "c", "size")).alias("own"))
    rows = own.join(s, "h").select("h", "s", F.col("own.key").alias("keys"), F.explode("own").alias("of")).select("h", "s", "keys", "of.*")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("h"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "h", "c", "s", (F.col("own") <= F.col("other")).alias("first"), (F.col("own") == F.col("other")).alias("within"), "key", "keys")

    def run(batches):
        for task, h, c, s, first, within, key, every in _runs(batches, 8):
            starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])).tolist()
            lines = s.tolist()
            size, counts = _counts(lines)
            keys = np.full((len(h), max(map(len, every))), np.iinfo(np.int64).max)
            keys[np.arange(keys.shape[1]) < np.fromiter(map(len, every), np.int64, len(h))[:, None]] = np.concatenate(every)

            def smallest(lo):
                return lambda i, j: _first_shared(keys[lo + i], keys[lo + j]) == key[lo]

            waves = [_waves(size[lo:hi], counts[lo:hi], c[lo:hi], similarity, None if within[lo] else first[lo:hi].astype(bool), smallest(lo)) for lo, hi in zip(starts, [*starts[1:], len(task)])]
            links = [(int(h[i]), int(h[j])) for i, j in _joined(lines, letters(lines), waves, starts, similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.repartition("task").sortWithinPartitions("task", "h").mapInArrow(run, "a long, b long").distinct()


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc, line, keep_doc, keep_line) of every line that goes, and the occurrence that stays for it; lines count from 0."""
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("_t")).where("_id is not null and _t is not null")
    with wide_rows(docs.sparkSession):
        lines = materialize(_lines(d), "line-hashes")
    distinct = lines.groupBy("h").agg(F.min(_place("doc", "line")).alias("place"), F.count("*").alias("n"), F.min("raw").alias("raw"), F.min("size").alias("size"))
    distinct = materialize(distinct, "distinct-lines")
    buckets = max(1, -(-distinct.count() * KEYS // BUCKET))
    shared = materialize(_shared(_packed(lines, buckets), similarity), "shared")
    ties = materialize(shared.where("h <> lead").select(F.col("h").alias("a"), F.col("lead").alias("b")).distinct(), "ties")
    s = _texts(ties.select(F.col("a").alias("h")).union(ties.select("b")), d, distinct)
    links = materialize(_verified(ties, s, similarity), "links")
    parts = materialize(connected_components(links, "a", "b"), "parts")
    groups = materialize(_open_groups(shared, parts), "groups")
    if not groups.isEmpty():
        links = links.unionByName(materialize(_group_links(groups, s, similarity), "links"))
        parts = materialize(connected_components(links, "a", "b"), "parts")
    named = distinct.join(parts, F.col("h") == F.col("node"), "left").select("h", F.coalesce("component", "h").alias("c"), "place", "n", F.col("node").isNotNull().alias("tied")).where("tied or n > 1")
    # a group may hold very many lines: it is told its first one in SALTS parts
    keep = named.groupBy("c").agg(F.min("place").alias("keep")).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    named = named.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int")).join(keep, ["c", "salt"]).select(F.col("h").alias("g"), "keep")
    gone = lines.select("doc", "line", "h").join(named, F.col("h") == F.col("g")).where(_place("doc", "line") != F.col("keep"))
    number = F.expr("cast(pmod(keep, 2147483648BD) as int)")
    return gone.withColumn("keep_line", number).select("doc", "line", F.expr("cast((keep - keep_line) div 2147483648BD as long)").alias("keep_doc"), "keep_line")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, count: str | None = None) -> DataFrame:
    """docs with the repeated lines taken out of text; columns and their order stay, `count` adds one with the number of lines taken.

    Lines end with \\n. A line of fewer than WORDS words or CHARS bytes always stays. Rows with a null id or text stay
    as they are. Rows that share an id count as one document: a line is a repeat of itself in none of them. A document
    that loses all its lines but blank ones goes; one that loses none stays, empty or not. Columns may have any other names.
    """
    names = docs.columns
    lost, own, new = fresh([*names, count or ""], "gone", "of", "left")
    gone = repeated_lines(docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t")), "i", "t", similarity).groupBy("doc").agg(F.collect_set("line").alias(lost)).withColumnRenamed("doc", own)
    both = docs.join(gone, F.col(f"`{doc_id}`").cast("long") == F.col(own), "left")
    t = F.col(f"`{text}`")
    kept = F.array_join(F.filter(F.split(t, "\n", -1), lambda x, i: ~F.array_contains(lost, i)), "\n")
    both = both.withColumn(new, F.when(F.col(lost).isNull() | t.isNull(), t).otherwise(kept))
    out = both.where(F.col(lost).isNull() | t.isNull() | (F.trim(F.translate(new, "\n\r\t", "   ")) != ""))
    cols = [F.col(new).alias(c) if c == text else F.col(f"`{c}`") for c in names]
    return out.select(*cols, *([F.coalesce(F.size(lost), F.lit(0)).alias(count)] if count else []))
