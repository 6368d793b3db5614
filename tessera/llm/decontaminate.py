"""Benchmark decontamination by spaced seeds.

A seed is a mask over consecutive words: positions marked 1 are hashed, positions marked 0 may hold anything. Equal
seed hashes of a benchmark item and a document give a hit and its alignment; around the hit, the two are compared word
by word, and the stretch where matching words keep the lead (as in ungapped extension) is measured. A stretch of
at least `least` words (or the whole item, if that is shorter) with a share of `share` matching words is an overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import U64, fresh, mix, plain_words, portions

#: Four masks of weight 5: a run, and three that leave out one to four words.
MASKS = ("11111", "1110101", "11010011", "101100101")
SHARE, LEAST = 0.75, 12
#: Words of benchmark text up to which seeds and items go to every executor (about 60 bytes a word).
BROADCAST_WORDS = 500_000
BITS = 22
#: Sides on which a frequent seed of a joined benchmark is met.
SALTS = 8
ODD = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def each_words(texts: list[bytes]) -> list[np.ndarray]:
    """The words of each whole text without case and punctuation, hashed; what has neither letter nor digit is no word."""
    h, line, _ = plain_words(texts)
    first = np.cumsum([0, *(t.count(b"\n") + 1 for t in texts)])
    return np.split(h, np.searchsorted(line, first[1:-1]))


def word_hashes(text: bytes | None) -> np.ndarray:
    return each_words([text or b""])[0]


def seeds(w: np.ndarray, mask: int) -> np.ndarray:
    """The hash under MASKS[mask] at every position; a text shorter than the mask has none."""
    on = [i for i, c in enumerate(MASKS[mask]) if c == "1"]
    n = len(w) - len(MASKS[mask]) + 1
    if n <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        h = np.full(n, U64(mask + 1))
        for j, i in enumerate(on):
            h += w[i : i + n] * ODD[j]
    return mix(h)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, at: int, share: float, least: int) -> tuple[int, int, int] | None:
    """(first word in doc, words, matching words) of the stretch around doc[at], aligned with item[at - shift]; None if it is no overlap."""
    lo, hi = max(0, shift), min(len(doc), shift + len(item))
    same = doc[lo:hi] == item[lo - shift : hi - shift]
    # a match gains as much as lets a stretch of exactly `share` break even
    gain = np.where(same, 1 - share, -share)
    k = at - lo
    right = np.cumsum(gain[k:])
    left = np.cumsum(gain[:k][::-1])
    end = k + (len(right) - int(np.argmax(right[::-1])) if len(right) else 0)
    start = k - (len(left) - int(np.argmax(left[::-1])) if len(left) and left.max() >= 0 else 0)
    n, m = end - start, int(same[start:end].sum())
    need = min(least, len(item))
    if n < need and hi - lo >= need:  # too short to be sure: the best window of the length asked for that covers the hit
        sums = np.concatenate([[0], np.cumsum(same)])
        first = np.arange(max(0, k - need + 1), min(k, hi - lo - need) + 1)
        got = sums[first + need] - sums[first]
        start, n, m = int(first[np.argmax(got)]), need, int(got.max())
    return (lo + start, n, m) if n >= need and m >= share * n - 1e-9 else None


def along(doc: np.ndarray, item: np.ndarray, shift: int, hits, share: float, least: int):
    """The overlaps of one alignment: around its first hit, and around each further one that no stretch so far covers."""
    upto = -1
    for p in sorted(hits):
        if p >= upto and (got := overlap(doc, item, shift, p, share, least)):
            upto = got[0] + got[1]
            yield got


class _Index:
    """Benchmark seeds in memory: a bitmap in front of sorted hashes."""

    def __init__(self, items: dict[int, np.ndarray]):
        self.items = items
        parts = [(h, np.full(len(h), i), np.arange(len(h))) for i, w in items.items() for m in range(len(MASKS)) for h in [seeds(w, m)]]
        h = np.concatenate([p[0] for p in parts] or [np.empty(0, U64)])
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.pos = h[order], np.concatenate([p[1] for p in parts] or [np.empty(0, int)])[order], np.concatenate([p[2] for p in parts] or [np.empty(0, int)])[order]
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[(h >> U64(64 - BITS)).astype(np.int64)] = True

    def hits(self, w: np.ndarray):
        """The positions of the seed hits of each alignment (item, shift)."""
        out: dict[tuple[int, int], set[int]] = {}
        for m in range(len(MASKS)):
            h = seeds(w, m)
            at = np.flatnonzero(self.bits[(h >> U64(64 - BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.h, h[at], "left"), np.searchsorted(self.h, h[at], "right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                for k in range(a, b):
                    out.setdefault((int(self.item[k]), p - int(self.pos[k])), set()).add(p)
        return out


def _best(found: dict[int, tuple[int, int, int]], item: int, got: tuple[int, int, int]) -> None:
    """Most matching words first, then the earliest, then the longest."""
    if (item not in found or (got[2], -got[0], got[1]) > (found[item][2], -found[item][0], found[item][1])):
        found[item] = got


SCHEMA = "doc_id long, item_id long, start long, words long, matched long"


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE, least: int = LEAST, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, start, words, matched): the best overlap of each document and benchmark item that have one.

    start counts words from 0. Null or wordless texts on either side overlap with nothing; an item with fewer words than
    the shortest mask gives no seed, so none of its overlaps. Null ids are left out; a repeated document id or item id
    counts as one, with the best overlap of its texts. A benchmark of at most `broadcast_words` words goes to every executor;
    a larger one is joined with the documents' seeds by hash, with the same result.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").cast("binary").alias("_t")).where("_id is not null and _t is not null")
    items = benchmark.select(F.col(item_id).cast("long").alias("_item"), F.col(item_text).cast("string").alias("_s")).where("_item is not null and _s is not null")
    size = items.agg(F.sum(F.size(F.split("_s", r"\s+"))).alias("n"), F.sum(F.octet_length("_s")).alias("b")).first()
    if (size["n"] or 0) <= broadcast_words and (size["b"] or 0) <= 40 * broadcast_words:
        texts: dict[int, list[np.ndarray]] = {}
        for r in items.collect():
            texts.setdefault(r["_item"], []).append(word_hashes(r["_s"].encode()))
        flat = [(i, w) for i, ws in texts.items() for w in ws]
        index = spark.sparkContext.broadcast((_Index({k: w for k, (_, w) in enumerate(flat)}), [i for i, _ in flat]))

        def run(batches):
            idx, names = index.value
            for b in batches:
                out = []
                ids = b.column(0).to_pylist()
                for i, w in ((ids[first + k], w) for first, texts in portions(b.column(1)) for k, w in enumerate(each_words(texts))):
                    found: dict[int, tuple[int, int, int]] = {}
                    for (k, shift), hits in idx.hits(w).items():
                        for got in along(w, idx.items[k], shift, hits, share, least):
                            _best(found, names[k], got)
                    out += [(i, k, *v) for k, v in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], ["doc_id", "item_id", "start", "words", "matched"])

        every = d.mapInArrow(run, SCHEMA)
    else:
        every = _joined(d, items, share, least)
    best = every.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", (-F.col("start")).alias("at"), "words")).alias("b"))
    return best.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), (-F.col("b.at")).alias("start"), F.col("b.words").alias("words"), F.col("b.matched").alias("matched"))


def _seed_rows(rows: DataFrame) -> DataFrame:
    """(id, own, h, pos) of every seed of (id, own, text) rows; own names the text."""

    def run(batches):
        for b in batches:
            ids, own = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, texts in portions(b.column(2)):
                for k, w in enumerate(each_words(texts)):
                    for m in range(len(MASKS)):
                        h = seeds(w, m)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), ids[first + k])), pa.array(np.full(len(h), own[first + k])), pa.array(h.view(np.int64)), pa.array(np.arange(len(h)))], ["id", "own", "h", "pos"])

    return rows.mapInArrow(run, "id long, own long, h long, pos long")


def _joined(d: DataFrame, items: DataFrame, share: float, least: int) -> DataFrame:
    """All overlaps, for a benchmark of any size. Texts that share an id are told apart by a hash of the text."""
    d = d.select("_id", F.xxhash64("_t").alias("_d"), "_t").distinct()
    s = items.select("_item", F.col("_s").cast("binary").alias("_b")).select("_item", F.xxhash64("_b").alias("_k"), "_b").distinct()
    # a seed that many documents hold is met on SALTS sides
    one = _seed_rows(d).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    two = _seed_rows(s).select(F.col("id").alias("item"), F.col("own").alias("its"), "h", F.col("pos").alias("at"), F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS)))).alias("salt"))
    hits = one.join(two, ["h", "salt"])
    # of an alignment, no more positions than the item has words
    lines = hits.groupBy("id", "own", "item", "its", (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_set("pos").alias("pos"))
    both = lines.join(d, (F.col("id") == F.col("_id")) & (F.col("own") == F.col("_d"))).join(s, (F.col("item") == F.col("_item")) & (F.col("its") == F.col("_k"))).select("id", "item", "shift", "pos", "_t", "_b")

    def run(batches):
        for b in batches:
            out = []
            for i, k, shift, p, t, s in zip(*(b.column(c).to_pylist() for c in range(6))):
                doc, item = word_hashes(t), word_hashes(s)
                out += [(i, k, *got) for got in along(doc, item, shift, p, share, least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], ["doc_id", "item_id", "start", "words", "matched"])

    return both.mapInArrow(run, SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The documents that overlap with no benchmark item, with their columns as they were."""
    (leak,) = fresh(docs.columns, "leak")
    found = overlaps(docs.select(doc_id, text), benchmark, doc_id, text, **parameters).select(F.col(doc_id).alias(leak)).distinct()
    return docs.join(found, F.col(f"`{doc_id}`").cast("long") == F.col(leak), "left_anti")
