"""What several operators of this subpackage share: shared storage, hashing, components, edit distance."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Where tables between jobs go if a local session (tests, a single machine) names no shared folder.
LOCAL_SHARED = "file:///tmp/tessera-shared"
#: Bytes of text that are worked on at once; a longer text is worked on alone.
PORTION = 1_000_000
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; on a cluster it must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or LOCAL_SHARED


def fresh(names, *wanted: str) -> list[str]:
    """Names for helper columns, like those wanted, that none of `names` equals in any case."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of one's own in the shared folder, that drop_tables removes."""
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that go to Python at once where a row holds a whole text or its set: some megabytes instead of some tens, in the JVM and in Python.
WIDE_ROWS = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def wide_rows(spark: SparkSession):
    """What is computed meanwhile hands at most WIDE_ROWS rows to Python at once; afterwards the session is as before."""
    held = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(int(held), WIDE_ROWS) if int(held) > 0 else WIDE_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, held)


def drop_tables(spark: SparkSession) -> int:
    """Removes the tables and archives that this application wrote to the shared folder; for when its results are written. Returns how many."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads the bits of 64-bit integers."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(33))
        h = h * U64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> U64(29))
        h = h * U64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U64(32))


# Words are hashed without taking them apart: the hash of a run of characters is the difference of two prefix sums of
# value(character) * B**position, times B**-start, modulo 2**64 (B is odd, so it has an inverse).
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, U64), np.ones(1, U64)]
_SPACES = (9, 10, 11, 12, 13, 32)
_SPACE = np.isin(np.arange(256), _SPACES)
_BYTE = mix(np.arange(256, dtype=U64) + U64(0x51ED270B))
_BYTE[65:91] = _BYTE[97:123]
_chars: list[np.ndarray] = []


def _run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each run values[start:end]; 0 for empty runs and for no other."""
    n = len(values) + 1
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(max(n, PORTION + PORTION // 8), U64(base))
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=U64)
    sums = np.zeros(n, U64)
    np.cumsum(values * _powers[0][: n - 1], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * _powers[1][starts])
    h[h == 0] = 1
    h[starts == ends] = 0
    return h


def byte_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text): runs without ASCII white space, A-Z as a-z."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return _run_hashes(_BYTE[data], starts, ends), np.diff(np.searchsorted(starts, bounds))


def plain_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, line, letters and digits) of all words that have a letter or digit; lines count over all texts, and every text starts one.

    Words are runs without ASCII white space, in lower case, letters and digits only (as plain_word has them).
    """
    if not _chars:
        kind = np.fromiter(map(str.isalnum, map(chr, range(0x110000))), bool, 0x110000).astype(np.uint8) * 2
        kind[list(_SPACES)] = 1
        _chars.extend((kind, mix(np.arange(0x110000, dtype=U64) + U64(0x2545F491))))
    text = (b"\n" + b"\n".join(texts) + b"\n").decode("utf-8", "replace").lower()
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _chars[0][codes]
    space = kind == 1
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = edges[::2]
    keep = kind == 2
    upto = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(keep, out=upto[1:])
    lo, hi = upto[starts], upto[edges[1::2]]
    h = _run_hashes(_chars[1][codes[keep]], lo, hi)
    line = np.cumsum(codes == 10)[starts] - 1
    live = h != 0
    return h[live], line[live], (hi - lo)[live]


def portions(column, most: int = PORTION):
    """Runs of texts (bytes, null as empty) of an Arrow column that are worked on at once, as (first, texts)."""
    first, held, size = 0, [], 0
    for i, t in enumerate(column):
        x = t.as_py() or b""
        if held and size + len(x) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(x)
        size += len(x)
    if held:
        yield first, held


def plain_word(word: bytes) -> bytes:
    """Lower case, letters and digits only: spelling that survives changes of case and punctuation."""
    word = word.strip(b".,;:!?|")
    if word.isalnum():  # ASCII
        return word.lower()
    w = word.decode("utf-8", "replace").lower()
    return (w if w.isalnum() else "".join(filter(str.isalnum, w))).encode()


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is the smallest node reachable.

    Alternating large-star and small-star rounds; each round is a table in the shared folder, so no graph is ever
    held by the driver or by one task. Null ends and loops are ignored; no edges give no rows.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = materialize(e, "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(e, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Columns after which an edit distance is held against its bound.
_COLUMNS = 12


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance of whole strings, bit-parallel over integers of any width. Beyond `most`, any number above it."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    a, b = a[n:], b[n:]
    n = 0
    for x, y in zip(reversed(a), reversed(b)):
        if x != y:
            break
        n += 1
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    plus, minus = full, 0  # rows of the column that are one more, or one less, than the row above
    slack = len(a) - len(b)
    for start in range(0, len(b), _COLUMNS):
        # no path costs less than the cell on the last cell's diagonal: costs change by one a row, and a path that is off it must come back
        if most is not None and start and start + slack > 0:
            upper = (1 << start + slack) - 1
            if start + (plus & upper).bit_count() - (minus & upper).bit_count() > most:
                return most + 1
        for c in b[start : start + _COLUMNS]:
            eq = where.get(c, 0)
            d0 = (((eq & plus) + plus) ^ plus) | eq | minus
            hp = (minus | ~(d0 | plus) & full) << 1 | 1
            plus = ((d0 & plus) << 1 | ~(d0 | hp)) & full
            minus = hp & d0 & full
    return len(b) + plus.bit_count() - minus.bit_count()


def alike(a: str, b: str, similarity: float) -> bool:
    """Is 1 - distance / length of the longer at least `similarity`?"""
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    return abs(len(a) - len(b)) <= most and edit_distance(a, b, most) <= most


#: Words of 64 rows that the band of a pair may take to be worked on beside others; the least pairs for which that pays, the most at once,
#: and the bytes that they may take; columns after which hopeless pairs go.
_BAND, _FEW, _PAIRS, _PAIR_BYTES, _LOOKS = 4, 48, 4096, 4_000_000, 8


def letters(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters of all lines as small numbers from 1, where each line starts, its length)."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(int(codes.max(initial=0)) + 1, bool)
    seen[codes] = True
    small = np.cumsum(seen)
    return small.astype(np.uint8 if small[-1] < 256 else np.uint32)[codes], np.cumsum(size) - size, size


def alike_pairs(lines: list[str], told: tuple[np.ndarray, np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """alike(lines[i], lines[j]) of many pairs at once; told: letters(lines)."""
    codes, start, size = told
    one, two = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
    m, n = size[one], size[two]
    most = ((1 - similarity) * n + 1e-9).astype(np.int64)
    # a path that leaves these diagonals, so many beside those of both ends, must come back and costs more than `most`
    beside = np.minimum((most - n + m) // 2, m)
    words = (n - m + 2 * beside + 64) // 64
    out = np.zeros(len(i), bool)
    rows = np.flatnonzero((n - m <= most) & (m > 0))
    rows = rows[np.lexsort((n[rows], words[rows]))]
    few = words[rows] <= _BAND
    for p in np.flatnonzero((n - m <= most) & (m == 0)).tolist() + rows[~few].tolist():
        out[p] = alike(lines[one[p]], lines[two[p]], similarity)
    rows = rows[few]
    at = 0
    while at < len(rows):
        w = int(words[rows[at]])
        same = int(np.searchsorted(words[rows], w, "right"))
        own = rows[at : min(same, at + _PAIRS)]
        room = np.arange(1, len(own) + 1) * (2 * n[own] + 64 * w + 1) <= _PAIR_BYTES
        own = own[: max(1, int(room.sum()))]
        if len(own) < _FEW:
            out[own] = [alike(lines[p], lines[q], similarity) for p, q in zip(one[own].tolist(), two[own].tolist())]
        else:
            out[own] = _within(codes, start, one[own], two[own], m[own], n[own], most[own], beside[own], w)
        at += len(own)
    return out


def _within(codes, start, one, two, m, n, most, beside, words: int) -> np.ndarray:
    """Is the edit distance of each pair at most `most`? one is no longer than two.

    Bit-parallel over the pairs: a column of a pair is `words` times 64 rows, the lowest of them `beside` rows under the diagonal, and
    goes down a row with each column. Rows above the first count as letters that nothing equals.
    """
    width, top = 64 * words, int(n.max())
    a, b = np.zeros((len(n), width + top + 1), codes.dtype), np.zeros((len(n), top), codes.dtype)
    for r, (x, y, k, q, o) in enumerate(zip(start[one].tolist(), start[two].tolist(), m.tolist(), n.tolist(), (width - beside).tolist())):
        a[r, o : o + k] = codes[x : x + k]
        b[r, :q] = codes[y : y + q]
    b = np.ascontiguousarray(b.T)
    out, name = np.zeros(len(n), bool), np.arange(len(n))
    one_, all_ = U64(1), U64(0xFFFFFFFFFFFFFFFF)

    def upwards(first):
        """Bits from `first` on, word by word."""
        by = np.clip(first[None, :] - 64 * np.arange(words)[:, None], 0, 64)
        return np.where(by < 64, all_ << np.minimum(by, 63).astype(U64), U64(0))

    plus, minus = upwards(width - beside - 1), np.zeros((words, len(n)), U64)
    # the rows between the diagonal of the last cell, of which no path costs less, and the lowest row
    between = upwards(width - 1 - (n - m + beside)) & ~upwards(np.full(len(n), width - 1))
    cost = beside.copy()
    for j in range(1, top + 1):
        eq = np.packbits(a[:, j : j + width] == b[j - 1][:, None], axis=1, bitorder="little").view(U64).T
        d0 = np.empty_like(plus)
        carry = None
        for w in range(words):
            p = plus[w]
            s = (eq[w] & p) + p
            if w + 1 < words or carry is not None:
                over = s < p
                if carry is not None:
                    s = s + carry
                    over |= s < carry
                carry = over.astype(U64)
            d0[w] = (s ^ p) | eq[w] | minus[w]
        hp, hn = minus | ~(d0 | plus), d0 & plus
        under = j + beside - m  # rows of the column under the last one
        if (under <= 0).all():
            cost += ((d0[-1] >> U64(63)) ^ one_).astype(np.int64)
        else:
            bit = np.clip(width - 1 - under, 0, width - 1)
            word, by, col = bit >> 6, (bit & 63).astype(U64), np.arange(len(n))
            last = ((hp[word, col] >> by) & one_).astype(np.int64) - ((hn[word, col] >> by) & one_).astype(np.int64)
            cost += np.where(under <= 0, ((d0[-1] >> U64(63)) ^ one_).astype(np.int64), last)
        down = d0 >> one_
        down[:-1] |= d0[1:] << U64(63)
        plus, minus = hn | ~(down | hp), down & hp
        done = n == j
        if done.any():
            out[name[done]] = cost[done] <= most[done]
        if j % _LOOKS == 0:
            least = cost - (np.bitwise_count(plus & between).astype(np.int64) - np.bitwise_count(minus & between).astype(np.int64)).sum(0)
            live = (n > j) & ((under > 0) | (least <= most))
            if not live.any():
                break
            if 4 * int(live.sum()) <= 3 * len(n):
                a, b = a[live], b[:, live]
                plus, minus, between = plus[:, live], minus[:, live], between[:, live]
                m, n, most, beside, cost, name = (x[live] for x in (m, n, most, beside, cost, name))
    return out


def flags(df: DataFrame, col: str, bits: int = 22) -> np.ndarray:
    """A bitmap of fixed size (2**bits) that holds pmod(col, 2**bits) of every row: lets every row in col pass, and few others.

    The driver gets at most 2**bits small integers, whatever the size of df; with many rows the map fills up and only filters less.
    """
    out = np.zeros(1 << bits, bool)
    for batch in df.select(F.pmod(F.col(col), F.lit(1 << bits)).cast("int").alias("b")).distinct().toArrow().to_batches():
        out[batch.column(0).to_numpy(zero_copy_only=False)] = True
    return out
