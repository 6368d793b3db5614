"""Long repeated byte strings, found by a hash-compared sort of suffixes in buckets, and texts without them.

A string of `least` bytes is bucketed by the run of least/2 bytes in it whose hash is smallest, its anchor: equal strings have equal
anchors at equal places, so only suffixes of one bucket and one place are ever compared.

1. Each document gives its anchors, about one for 50 bytes, each with the stretch of string starts that it stands for: hash of the
   anchor, and hash of the whole stretch (its class). Anchors seen once are dropped.
2. Anchors are counted by class. Where a whole class has two members, every string of it is repeated: copies, however many, are one row here.
3. Classes of one anchor that differ may still share strings, at the ends of a copied passage. Their bytes are fetched from one member
   each, and the suffixes of a bucket and place are sorted: a merge sort whose comparisons find the common extension of two suffixes
   by binary search over prefix polynomial hashes. Neighbours that agree in `least` bytes are compared byte by byte; where hashes lied,
   the bucket is settled by the bytes themselves. An anchor with very many different classes isn't sorted in one task: its strings are
   counted by digest, in as many partitions as there are.
4. Repeated starts go back to all members of their class, and to their documents, which lose the bytes they cover.

Nothing of the corpus goes to the driver; a task holds a portion of texts, one document's marks, or a batch of buckets.
Rows: a null text is empty. Rows of one id are documents of their own; rows equal in id and text repeat each other. Other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import PORTION, U64, fresh, materialize, mix

LEAST = 200
#: An anchor with more classes is counted by digests of its strings instead of being sorted in one task.
MOST_CLASSES = 2_000
#: Classes that a task sorts together, at least.
SORTED_TOGETHER = 20_000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_PLACE = 26  # bits of a place in a portion


class Prefixes:
    """Prefix polynomial hashes of bytes, modulo 2**64: the hash of any stretch in constant time."""

    def __init__(self, data: np.ndarray, base: int = _BASES[0]):
        n = len(data) + 1
        up, down = np.full(n, U64(base)), np.full(n, U64(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        self.down = np.cumprod(down, dtype=U64)
        self.sums = np.zeros(n, U64)
        values = mix(np.arange(256, dtype=U64) + U64(base))
        np.cumsum(values[data] * np.cumprod(up, dtype=U64)[: n - 1], out=self.sums[1:])

    def of(self, at: np.ndarray, size) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.down[at]


def _least_in_windows(keys: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbouring values: the larger part of one block and the smaller of the next."""
    n = len(keys)
    blocks = np.concatenate((keys, np.full(-n % w, ~U64(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(texts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, class hash, first start, number of starts, place of the anchor from there) of each stretch of starts."""
    run = least // 2
    w = least - run + 1
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < least:
        return tuple(np.empty(0, t) for t in (np.int64, U64, U64, np.int64, np.int64, np.int64))
    ends = np.cumsum([len(t) for t in texts])
    hashes = Prefixes(data)
    n = len(data) - run + 1
    h = mix(hashes.of(np.arange(n), run))
    mask = U64((1 << _PLACE) - 1)
    at = (_least_in_windows(h & ~mask | np.arange(n, dtype=U64), w) & mask).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[: len(at)]
    inside = np.arange(len(at)) + least <= ends[text]
    cut = np.flatnonzero((at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])) + 1
    lo = np.concatenate(([0], cut))
    hi = np.concatenate((cut, [len(at)]))
    lo, hi = lo[inside[lo]], hi[inside[lo]]
    at, text = at[lo], text[lo]
    shape = mix(((at - lo) * 4 * least + hi - lo).astype(U64))
    cls = mix(Prefixes(data, _BASES[1]).of(lo, hi - lo + least - 1) ^ shape)
    begin = ends - [len(t) for t in texts]
    return text, h[at], cls, lo - begin[text], hi - lo, at - lo


def _merge_sorted(at: np.ndarray, group: np.ndarray, less) -> np.ndarray:
    """Places, by group and then by suffix: a merge sort from the bottom up, all groups and runs of one width at once.

    less(a, b, even) tells for arrays of places which suffix at a stands before that at b, or with `even` not behind it.
    """
    by = np.argsort(group, kind="stable")
    at, group = at[by], group[by]
    first = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1))
    sizes = np.diff(np.append(first, len(at)))
    begin, own, size = np.repeat(first, sizes), np.arange(len(at)) - np.repeat(first, sizes), np.repeat(sizes, sizes)
    width = 1
    while width < sizes.max(initial=0):
        left = own // width % 2 == 0
        start = np.where(left, (own // width + 1) * width, (own // width - 1) * width)  # the run to merge with
        lo = np.minimum(start, size)
        hi = np.minimum(start + width, size)
        base = lo.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            x, y = at[live], at[begin[live] + mid]
            before = less(y, x, ~left[live])  # of equal ones, those of the left run come first
            lo[live[before]] = mid[before] + 1
            hi[live[~before]] = mid[~before]
            live = live[lo[live] < hi[live]]
        place = begin + own // (2 * width) * 2 * width + own % width + lo - base
        out = np.empty_like(at)
        out[place] = at
        at = out
        width *= 2
    return at


def repeated_starts(parts: list[bytes], bucket: np.ndarray, place: np.ndarray, counts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """For each start of each part, one behind the other: does a string of `least` bytes from there start in another part too?

    Parts of one bucket have the same anchor; `place` tells how far behind the first start it lies.
    """
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    part = np.repeat(np.arange(len(parts)), counts)
    own = np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (np.cumsum(sizes) - sizes)[part] + own
    group = bucket[part] * (4 * least) + (place[part] - own)
    _, group, n = np.unique(group, return_inverse=True, return_counts=True)
    out = np.zeros(len(part), bool)
    alone = n[group] == 1
    of = np.full(len(data), -1)  # which start a place is
    of[at] = np.arange(len(at))
    hashes = Prefixes(data)
    steps = [1 << k for k in range(least.bit_length() - 1, -1, -1)]

    def extension(a, b):
        size = np.zeros(len(a), np.int64)
        for step in steps:
            fits = size + step <= least
            x, y = a[fits] + size[fits], b[fits] + size[fits]
            fits[fits] = hashes.of(x, step) == hashes.of(y, step)
            size[fits] += step
        return size

    def less(a, b, even):
        size = extension(a, b)
        end = size == least
        size[end] = 0
        return np.where(end, even, data[a + size] < data[b + size])

    order = _merge_sorted(at[~alone], group[~alone], less)
    if not len(order):
        return out
    g = group[of[order]]
    pair = np.flatnonzero((g[1:] == g[:-1]) & (extension(order[1:], order[:-1]) == least))
    windows = np.lib.stride_tricks.sliding_window_view(data, least)
    good = np.concatenate([np.ones(0, bool), *((windows[order[p]] == windows[order[p + 1]]).all(1) for p in np.array_split(pair, len(pair) // 4096 + 1))])
    out[of[order[pair[good]]]] = out[of[order[pair[good] + 1]]] = True
    for lied in np.unique(g[pair[~good]]).tolist():
        where = order[g == lied]
        seen: dict[bytes, list[int]] = {}
        for p in where.tolist():
            seen.setdefault(data[p : p + least].tobytes(), []).append(p)
        for same in seen.values():
            out[of[same]] = len(same) > 1
    return out


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of each stretch of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


STARTS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("number", T.IntegerType())]))
_STARTS = pa.list_(pa.struct([("first", pa.int32()), ("number", pa.int32())]))


def _starts(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"first": a, "number": b} for a, b in x] for x in found], _STARTS)


def _anchor_rows(docs: DataFrame, ident: str, least: int) -> DataFrame:
    """The anchors of all documents: id, hash of the text, anchor, class, first start, number of starts, place of the anchor."""
    kind = docs.schema[ident].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(n, T.LongType()) for n in ("h", "k", "c")), T.StructField("first", T.LongType()), T.StructField("number", T.IntegerType()), T.StructField("place", T.IntegerType())])
    limit = (1 << _PLACE) - 1

    def tell(b, rows, texts, shift):
        text, k, c, first, number, place = anchors(texts, least)
        take = pa.array(np.array(rows)[text] if len(text) else np.empty(0, np.int64))
        cells = [b.column(0).take(take), b.column(1).take(take), pa.array(k.view(np.int64)), pa.array(c.view(np.int64)), pa.array(first + shift), pa.array(number.astype(np.int32)), pa.array(place.astype(np.int32))]
        return pa.RecordBatch.from_arrays(cells, schema.names)

    def run(batches):
        for b in batches:
            rows, texts, size = [], [], 0
            for i in range(b.num_rows):
                t = b.column(2)[i].as_py() or b""
                if len(t) < least:
                    continue
                if size + len(t) > PORTION and texts:
                    yield tell(b, rows, texts, 0)
                    rows, texts, size = [], [], 0
                if len(t) > limit:  # in pieces that hold every string once
                    for at in range(0, len(t) - least + 1, limit - least):
                        yield tell(b, [i], [t[at : at + limit - 1]], at)
                    continue
                rows.append(i)
                texts.append(t)
                size += len(t)
            yield tell(b, rows, texts, 0)

    return docs.mapInArrow(run, schema)


def _sorted_classes(classes: DataFrame, least: int) -> DataFrame:
    """(k, c, starts) of classes (k, c, number, place, bytes) that share strings with others of their anchor."""
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("c", T.LongType()), T.StructField("starts", STARTS)])

    def solve(rows):
        k, c, number, place, parts = zip(*rows)
        counts = np.array(number, np.int64)
        bucket = np.unique(np.array(k, np.int64), return_inverse=True)[1]
        flags = repeated_starts(list(parts), bucket, np.array(place, np.int64), counts, least)
        found = [spans_of(x) for x in np.split(flags, np.cumsum(counts)[:-1])]
        keep = [i for i, x in enumerate(found) if x]
        return pa.RecordBatch.from_arrays([pa.array([k[i] for i in keep], pa.int64()), pa.array([c[i] for i in keep], pa.int64()), _starts([found[i] for i in keep])], schema.names)

    def run(batches):
        held = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and row[:2] == held[-1][:2]:
                    continue  # a document that stands there twice gave its classes twice
                if len(held) >= SORTED_TOGETHER and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    x = classes.select("k", "c", "number", "place", "bytes")
    return x.repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k").sortWithinPartitions("k", "c").mapInArrow(run, schema)


def _counted_classes(classes: DataFrame, least: int) -> DataFrame:
    """The same for anchors of very many classes: each string is one row, known by place and digest."""
    one = F.transform(F.sequence(F.lit(0), F.col("number") - 1), lambda i: F.struct(i.alias("i"), (F.col("place") - i).alias("o"), F.md5(F.substring("bytes", i + 1, F.lit(least))).alias("d")))
    rows = classes.dropDuplicates(["k", "c"]).select("k", "c", F.inline(one))
    again = rows.groupBy("k", "o", "d").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    hit = rows.join(again, ["k", "o", "d"], "left_semi")
    return hit.groupBy("k", "c").agg(F.collect_list(F.struct(F.col("i").alias("first"), F.lit(1).alias("number"))).alias("starts"))


def _fetched(docs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Classes (k, c, first, number, place) with their bytes, from the document (id, h) that is told with each."""
    some = classes.groupBy("id", "h").agg(F.collect_list(F.struct("k", "c", "first", "number", "place", "m")).alias("some"))
    x = docs.join(some.withColumnsRenamed({"id": "id_", "h": "h_"}), F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")))
    return x.select("text", F.inline("some")).select("k", "c", "number", "place", "m", F.substring("text", (F.col("first") + 1).cast("int"), F.col("number") + F.lit(least - 1)).alias("bytes"))


def repeated(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = LEAST, most_classes: int = MOST_CLASSES) -> DataFrame:
    """(id, h, marks) of documents with strings that repeat: marks are lists of (first start, number of starts); h is xxhash64 of the text."""
    docs = docs.select(F.col(ident).alias("id"), F.xxhash64(text).alias("h"), F.col(text).cast("binary").alias("text"))
    all_anchors = materialize(_anchor_rows(docs, "id", least), "anchors")
    twice = all_anchors.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    live = materialize(all_anchors.join(twice, "k", "left_semi"), "anchors-live")
    classes = live.groupBy("k", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "h", "first", "number", "place")).alias("one"))
    classes = materialize(classes.select("k", "c", "n", "one.*"), "classes")
    per = classes.groupBy("k").agg(F.count("*").alias("m")).where("m > 1")
    fetched = materialize(_fetched(docs, classes.join(per, "k"), least), "class-bytes")
    whole = classes.where("n > 1").select("k", "c", F.array(F.struct(F.lit(0).alias("first"), F.col("number"))).alias("starts"))
    few = _sorted_classes(fetched.where(F.col("m") <= most_classes), least)
    many = _counted_classes(fetched.where(F.col("m") > most_classes), least)
    parts = few.unionByName(many).join(whole.select("k", "c"), ["k", "c"], "left_anti")
    marks = materialize(whole.unionByName(parts), "marks")
    back = live.select("id", "h", "k", "c", F.col("first").alias("at")).join(marks, ["k", "c"])
    back = back.select("id", "h", "at", F.inline("starts"))
    return back.groupBy("id", "h").agg(F.collect_set(F.struct((F.col("at") + F.col("first")).alias("first"), F.col("number"))).alias("marks"))


def cut_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = LEAST, most_classes: int = MOST_CLASSES) -> DataFrame:
    """Each row without the bytes covered by a string of `least` bytes that also starts elsewhere: columns kept (binary), n_bytes, n_removed, n_spans are added, the text goes."""
    marks = repeated(docs, ident, text, least, most_classes).withColumnsRenamed({"id": "__id", "h": "__h", "marks": "__marks"})
    others = [c for c in docs.columns if c != text]
    kept, n_bytes, n_removed, n_spans, h = fresh(others, "kept", "n_bytes", "n_removed", "n_spans", "h")
    x = docs.withColumn(h, F.xxhash64(text)).join(marks, F.col(ident).eqNullSafe(F.col("__id")) & (F.col(h) == F.col("__h")), "left")
    x = x.select(*others, F.col(text).cast("binary").alias("__text"), "__marks")
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(kept, T.BinaryType()), *(T.StructField(c, T.LongType()) for c in (n_bytes, n_removed, n_spans))])

    def run(batches):
        for b in batches:
            out = []
            for t, m in zip(b.column(len(others)), b.column(len(others) + 1)):
                data, m = t.as_py() or b"", m.as_py()
                gone, pieces, at, spans = 0, [], 0, 0
                for lo, number in sorted((x["first"], x["number"]) for x in m or ()):
                    hi = lo + number - 1 + least
                    if lo > at or not spans:
                        pieces.append(data[at:lo])
                        spans += 1
                        gone += hi - lo
                    else:
                        gone += max(0, hi - at)
                    at = max(at, hi)
                out.append((b"".join(pieces) + data[at:], len(data), gone, spans))
            cells = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(cells[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cells[1:])], schema.names)

    return x.mapInArrow(run, schema)
