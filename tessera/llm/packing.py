"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

Documents become token ids plus an end id; only those longer than a sequence are cut. Pieces are dealt into blocks of
bounded size. For each block, several islands breed packings: a packing is a set of bins; crossover injects whole
well-filled bins of one parent into the other, removes the bins that then hold a piece twice, and best-fits the displaced
pieces by size. Between epochs each island's elite migrates to the next island of its block. Bins that a block
can't fill well are dissolved, and their pieces are dealt into fewer, new blocks, until one block is left: the waste is
that of one block, however many there were.
"""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import materialize, portions

LENGTH = 4096
END = 1
#: Pieces of a block; islands of a block; packings an island breeds; children an epoch; epochs.
BLOCK, ISLANDS, POPULATION, CHILDREN, EPOCHS = 4000, 3, 4, 6, 2
#: Bins filled less than this go to the next round of blocks.
WELL_FILLED = 0.999
#: Words that a worker remembers in each of two halves.
CACHE = 300_000
#: Bytes of texts that are encoded together; a longer text is encoded alone.
CHARS = 4_000_000
#: ASCII marks, which the tokenizer splits from letters and keeps together.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


class Recent:
    """Remembers what was asked for last: when the young half is full it becomes the old one, and what is asked for again stays."""

    def __init__(self, make, most: int = CACHE):
        self.make, self.most = make, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, key: str) -> bytes:
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = self.make(key)
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = got
        return got


#: Characters that the short way treats as the tokenizer does: white space, ASCII, and most letters and signs of Latin, Greek, Cyrillic.
PLAIN = ((9, 10), (13, 13), (0x20, 0x7E), (0xA0, 0x24F), (0x370, 0x3A2), (0x3A4, 0x4FF), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x2100, 0x214F))

#: Characters among those that normalisation changes or joins with others, or whose lower case is two characters.
CHANGED = (0x130, 0x374, 0x37E, 0x387, 0x483, 0x484, 0x485, 0x486, 0x487, 0x2126, 0x212A, 0x212B)


class Encoder:
    """Text -> little-endian uint32 ids as bytes, exactly those of the tokenizer file.

    The tokenizer's words never span white space or the line between letters and marks, so ids are remembered word by word. What
    the short way isn't known to treat alike (special tokens in the text, letters outside Latin, Greek and Cyrillic,
    control characters, capital sigma) goes through the tokenizer itself.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.odd = np.ones(0x110000, bool)
        for lo, hi in PLAIN:
            self.odd[lo : hi + 1] = False
        self.odd[list(CHANGED)] = True
        keep = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.bytes = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(keep))}
        self.words = Recent(self._word)
        probe = "It's A tést: don't (1) x...!"
        self.short = True
        self.short = self(probe) == np.array(self.whole.encode(probe, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        mapped = word if word.isascii() else "".join(map(self.bytes.__getitem__, word.encode()))
        return pack_ids(*[t.id for t in self.tokenize(mapped)])

    def _odd(self, text: str) -> bool:
        return not self.short or bool(self.odd[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any()) or any(x in text for x in SPECIAL)

    def all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Runs without white space, and the words in them, are looked up once for all texts."""
        odd = list(map(self._odd, texts))
        out = [np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if o else b"" for t, o in zip(texts, odd)]
        at = [i for i, o in enumerate(odd) if not o]
        if not at:
            return out
        runs = pc.utf8_split_whitespace(pa.array([texts[i] for i in at], pa.string()))
        ends = runs.offsets.to_numpy()
        told = runs.flatten().dictionary_encode()
        form = pc.utf8_lower(told.dictionary)
        # letters, then marks: two words of the tokenizer; what else there is goes through its pattern
        word = pc.utf8_rtrim(form, MARKS)
        plain = pc.or_(pc.utf8_is_alpha(word), pc.equal(word, ""))
        pool: list[bytes] = []

        def place(words: pa.Array) -> np.ndarray:
            """Puts the ids of the distinct words into the pool; returns where those of each word are."""
            own = words.dictionary_encode()
            pool.extend(map(self.words, own.dictionary.to_pylist()))
            return own.indices.to_numpy() + (len(pool) - len(own.dictionary))

        parts = np.stack([place(pc.if_else(plain, word, "")), place(self._tails(form, word, plain))], 1)
        rest = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        parts[rest, 0] = len(pool) + np.arange(len(rest))
        pool.extend(b"".join(map(self.words, self.parts(c))) for c in form.take(pa.array(rest)).to_pylist())
        size = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        first = np.cumsum(size) - size
        which = parts[told.indices.to_numpy()].ravel()
        n = size[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        every = np.frombuffer(b"".join(pool), "<u4")[np.repeat(first[which] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        cuts = (4 * upto[2 * ends]).tolist()
        for i, x, y in zip(at, cuts, cuts[1:]):
            out[i] = every[x:y]
        return out

    @staticmethod
    def _tails(form: pa.Array, word: pa.Array, plain: pa.Array) -> pa.Array:
        """What follows the word in each form, which starts with it; empty where that isn't plain."""
        size, whole = pc.binary_length(word).to_numpy().astype(np.int64), pc.binary_length(form).to_numpy().astype(np.int64)
        n = np.where(plain.to_numpy(zero_copy_only=False), whole - size, 0)
        starts = np.cumsum(whole) - whole + size
        if not n.any():
            return pa.array([""] * len(form), pa.string())
        data = np.frombuffer(form.buffers()[2], np.uint8)[int(np.frombuffer(form.buffers()[1], np.int32)[form.offset]) :]
        upto = np.concatenate([[0], np.cumsum(n)])
        picked = data[np.repeat(starts - upto[:-1], n) + np.arange(upto[-1])]
        return pa.Array.from_buffers(pa.string(), len(form), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(picked.tobytes())])

    def __call__(self, text: str) -> bytes:
        return self.all([text])[0]


def pack_ids(*ids: int) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """(_id, piece, start, length, crc) of every piece of every row, over whole texts. A null text is empty: its end id alone."""

    def run(batches):
        encode = _encoder(vocabulary)
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            doc = b.column(0).to_pylist()
            for first, texts in portions(b.column(1), CHARS):
                cols: list[list] = [[], [], [], [], []]
                for i, ids in zip(doc[first:], encode.all([t.decode() for t in texts])):
                    ids += tail
                    for k, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at : at + 4 * length]
                        for c, v in zip(cols, (i, k, at // 4, len(part) // 4, zlib.crc32(part))):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(cols)], ["_id", "piece", "start", "length", "crc"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("_t")).mapInArrow(run, "_id long, piece int, start long, length long, crc long")


# A packing: list of bins, a bin is a list of piece numbers; sizes are looked up by number.


def best_fit(sizes: list[int], order: list[int], bins: list[list[int]], room: list[int], cap: int) -> None:
    """Puts the pieces, in the order given, each into the open bin that it fills most; opens bins as needed."""
    open_, mask = [[] for _ in range(cap + 1)], 0
    for k, r in enumerate(room):
        if r:
            open_[r].append(k)
            mask |= 1 << r
    for i in order:
        s = sizes[i]
        if up := mask >> s:
            r = s + (up & -up).bit_length() - 1
            k = open_[r].pop()
            if not open_[r]:
                mask &= ~(1 << r)
            bins[k].append(i)
        else:
            k, r = len(bins), cap
            bins.append([i])
            room.append(cap)
        room[k] = r = r - s
        if r:
            open_[r].append(k)
            mask |= 1 << r


def cost(packing: list[list[int]], sizes: list[int], cap: int) -> tuple[int, float]:
    """Fewer bins first; then the fuller the full ones."""
    return len(packing), -sum((sum(sizes[i] for i in b) / cap) ** 2 for b in packing)


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], cap: int, rng: random.Random) -> list[list[int]]:
    """a, with some of the fullest bins of b injected whole."""
    full = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    full = full[: max(1, len(full) // 2)]
    inject = [list(x) for x in rng.sample(full, rng.randint(1, len(full)))]
    new = {i for x in inject for i in x}
    keep, displaced = [], []
    for x in a:
        if new.isdisjoint(x):
            keep.append(list(x))
        else:
            displaced += [i for i in x if i not in new]
    bins = inject + keep
    displaced.sort(key=lambda i: (-sizes[i], i))
    best_fit(sizes, displaced, bins, [cap - sum(sizes[i] for i in x) for x in bins], cap)
    return bins


def _new(sizes: list[int], cap: int, rng: random.Random, first: bool) -> list[list[int]]:
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)) if first else sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(0.7, 1.3))
    bins: list[list[int]] = []
    best_fit(sizes, order, bins, [], cap)
    return bins


def breed(sizes: list[int], elites: list[list[list[int]]], cap: int, seed: int, population: int = POPULATION, children: int = CHILDREN, greedy: bool = True) -> list[list[int]]:
    """One epoch of one island; returns its elite. Ends early at ceil(total / cap) bins, which no packing beats.

    An island without elites starts from best fit in order of size, or, unless it is greedy, from orders of its own."""
    rng, least = random.Random(seed), -(-sum(sizes) // cap)
    pool = [list(map(list, e)) for e in elites] or [_new(sizes, cap, rng, greedy)]
    pool.sort(key=lambda p: cost(p, sizes, cap))
    if len(pool[0]) <= least:
        return pool[0]
    while len(pool) < population:
        pool.append(_new(sizes, cap, rng, False))
    for _ in range(children):
        pool.sort(key=lambda p: cost(p, sizes, cap))
        if len(pool[0]) <= least:
            break
        a, b = rng.sample(pool[:population], 2)
        pool = [*pool[:population], crossover(a, b, sizes, cap, rng)]
    return min(pool, key=lambda p: cost(p, sizes, cap))


def _solve(pieces: DataFrame, n_blocks: int, cap: int, seed: int) -> DataFrame:
    """(key, size, block, bin) for (key, size) rows: the best packing that the islands of each block find."""
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n_blocks)).cast("int"))
    dealt = materialize(dealt, "blocks")
    islands = dealt.withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS)))))

    def epoch(table: pa.Table) -> pa.Table:
        """Rows of a block on an island: pieces, each with its bin in the island's own elite and in its neighbour's (-1: none)."""
        t = table.sort_by([("size", "descending"), ("key", "ascending")])
        sizes, block, island = t["size"].to_pylist(), t["block"][0].as_py(), t["island"][0].as_py()
        elites = []
        for name in ("own", "near"):
            at: dict[int, list[int]] = {}
            for i, k in enumerate(t[name].to_pylist()):
                if k >= 0:
                    at.setdefault(k, []).append(i)
            if at:
                elites.append([at[k] for k in sorted(at)])
        bins = breed(sizes, elites, cap, seed * 1_000_003 + block * 31 + island, greedy=island == 0)
        where = np.empty(len(sizes), np.int32)
        for k, x in enumerate(bins):
            where[x] = k
        value = cost(bins, sizes, cap)
        return pa.table({"key": t["key"], "size": t["size"], "block": t["block"], "island": t["island"], "bin": pa.array(where), "bins": pa.array([value[0]] * len(sizes), pa.int32()), "fill": pa.array([value[1]] * len(sizes), pa.float64())})

    schema = "key long, size long, block int, island int, bin int, bins int, fill double"
    now = islands.withColumns({"own": F.lit(-1), "near": F.lit(-1)})
    for k in range(EPOCHS):
        bred = materialize(now.select("key", "size", "block", "island", "own", "near").groupBy("block", "island").applyInArrow(epoch, schema), "epoch")
        least = bred.groupBy("block").agg(F.min("bins").alias("bins"), (F.ceil(F.sum("size") / (ISLANDS * cap))).alias("bound"))
        if k + 1 == EPOCHS or least.where("bins > bound").isEmpty():
            break
        near = bred.select("key", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("bin").alias("near"))
        now = bred.withColumnRenamed("bin", "own").join(near, ["key", "island"])
    best = bred.groupBy("block").agg(F.min(F.struct("bins", "fill", "island")).alias("b")).select("block", F.col("b.island").alias("island"))
    return bred.join(best, ["block", "island"]).select("key", "size", "block", "bin")


def pack(pieces: DataFrame, cap: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """(key, sequence_id, offset) for rows (key long, unique; size long, 1..cap): key's sequence and its place there, without gaps.

    Works through tables in the shared folder. Pieces as long as a sequence fill one each and take no part in breeding. Rounds end
    when one block is left, or when dealing what is left anew saves less than a bin for each block: what a packing of all
    pieces at once could save beyond that is a bin a block (and pieces over half a sequence fill no bin well, however they are dealt).
    """
    done = [pieces.where(F.col("size") >= cap).select("key", F.col("key").cast("string").alias("name"), F.lit(0).cast("long").alias("offset"))]
    left, level, before = pieces.where(F.col("size") < cap), 0, None
    n = left.count()
    while n:
        n_blocks = -(-n // block)
        solved = _solve(left, n_blocks, cap, level)
        solved = materialize(solved.withColumn("fill", F.sum("size").over(Window.partitionBy("block", "bin"))), "packed")
        badly = solved.where(F.col("fill") < WELL_FILLED * cap)
        n, bins = badly.agg(F.count("*"), F.count_distinct("block", "bin")).first()
        last = n_blocks == 1 or not n or before is not None and bins > before - n_blocks
        at = F.sum("size").over(_window("block", "bin").rowsBetween(Window.unboundedPreceding, -1))
        kept = solved if last else solved.where(F.col("fill") >= WELL_FILLED * cap)
        done.append(kept.select("key", F.concat_ws(":", F.lit(level), "block", "bin").alias("name"), F.coalesce(at, F.lit(0)).cast("long").alias("offset")))
        if last:
            break
        left, before, level = badly.select("key", "size"), bins, level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("key", F.xxhash64("name").alias("sequence_id"), "offset")


def _window(*keys: str):
    return Window.partitionBy(*keys).orderBy("key")


def pack_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of docs is packed: null and empty texts as their end id alone, repeated rows each for themselves, rows with
    a null id too. Other columns are not read. No rows give no rows. `vocabulary` is the path of a tokenizers file that
    every executor can open.
    """
    cut = pieces(docs, vocabulary, doc_id, text, length, end).withColumn("key", F.monotonically_increasing_id())
    cut = materialize(cut, "pieces")  # the keys are fixed from here on
    at = pack(cut.select("key", F.col("length").alias("size")), length)
    out = cut.join(at, "key")
    return out.select(F.col("_id").alias(doc_id), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
