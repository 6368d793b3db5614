"""MinHash near-duplicates by an inverted join over signature coordinates.

Every document is the set of its distinct shingles; documents with equal sets fold into one before anything is joined.
Each set gets a signature of `coords` minima. A (coordinate, value) pair is a posting; two sets that agree on at least
`match` coordinates must share a posting among the coords - match + 1 first ones of each, whatever order of the postings
all sets follow (prefix filter). The order puts postings that many sets have last, by a fixed-size table of counts, so
long posting lists are rarely opened. Lists are merged as sorted streams: a list first links each member to its first
member only; lists whose members then still lie in different components are merged again, skipping pairs that a
component already joins. Collisions are counted over whole signatures, and what stays is confirmed on the full sets. No
step returns the pairs of a group: the last one returns the links that join components, and compares the rest in place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import PORTION, U64, byte_words, connected_components, flags, materialize, mix, portions, wide_rows

SEEDS = np.random.default_rng(20240229).integers(1, 2**63, 4096, dtype=np.uint64)
#: Slots of the table of posting counts that orders the postings.
COUNT_BITS = 18


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text: words are runs without ASCII white space, A-Z lower-cased."""
    words, counts = byte_words(texts)
    out, at = [], 0
    for m in counts.tolist():
        w, at = words[at : at + m], at + m
        if not m:
            out.append(w)
            continue
        n = max(1, m - size + 1)
        with np.errstate(over="ignore"):
            h = np.zeros(n, U64)
            for j in range(min(size, m)):
                h += w[j : j + n] * (SEEDS[j] | U64(1))
            out.append(np.unique(mix(h ^ U64(min(m, size)))))
    return out


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    return shingle_sets([text or b""], size)[0]


def _signatures(sets: list[np.ndarray], coords: int) -> np.ndarray:
    """(sets, coords) uint32; no set may be empty."""
    h, starts = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), coords), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(coords):
            out[:, j] = np.minimum.reduceat(((h * (SEEDS[64 + j] | U64(1))) >> U64(32)).astype(np.uint32), starts)
    return out


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, coords: int = 96) -> DataFrame:
    """(_id, n_shingles, hi, lo, sig) per row; hi and lo name the set, sig holds the minima (null for an empty set)."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for first, held in portions(texts, PORTION // 4):
                sets = shingle_sets(held, size)
                live = [s for s in sets if len(s)]
                sig = iter(_signatures(live, coords)) if live else iter(())
                kk = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(kk[:, 0]), pa.array(kk[:, 1]),
                    pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                ], ["_id", "n_shingles", "hi", "lo", "sig"])

    src = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").cast("binary").alias("_t"))
    return src.mapInArrow(run, "_id long, n_shingles long, hi long, lo long, sig binary")


def _tokens(sig: np.ndarray) -> np.ndarray:
    """(rows, coords) 64-bit names of the (coordinate, value) pairs."""
    return mix(sig.astype(U64) | (np.arange(1, sig.shape[1] + 1, dtype=U64) << U64(32)))


def _posting_counts(reps: DataFrame, coords: int) -> np.ndarray:
    """How often postings fall into each of 2**COUNT_BITS slots, counted over all sets."""

    def run(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32).reshape(-1, coords)
            total += np.bincount((_tokens(sig) >> U64(64 - COUNT_BITS)).ravel().astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    out = np.zeros(1 << COUNT_BITS, np.int64)
    t = reps.select("sig").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[t["slot"].to_numpy()] = t["n"].to_numpy()
    return out


def _postings(reps: DataFrame, coords: int, match: int) -> DataFrame:
    """(token, doc, n): the prefix of each set, rare postings first."""
    sc, keep = reps.sparkSession.sparkContext, coords - match + 1
    counts = sc.broadcast(_posting_counts(reps, coords).astype(np.int32))

    def run(batches):
        hot = counts.value
        for b in batches:
            if not b.num_rows:
                continue
            t = _tokens(np.frombuffer(b.column(2).cast(pa.binary()).to_pylist() and b"".join(b.column(2).to_pylist()), np.uint32).reshape(-1, coords))
            # the slot's count first, the token itself for ties: one order for all sets
            t.sort(axis=1)
            first = np.argsort(hot[(t >> U64(64 - COUNT_BITS)).astype(np.int64)], axis=1, kind="stable")[:, :keep]
            t = np.take_along_axis(t, first, 1)
            ids, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(t.ravel().view(np.int64)), pa.array(np.repeat(ids, keep)), pa.array(np.repeat(n, keep))], ["token", "doc", "n"])

    return reps.select("rep", "n_shingles", "sig").mapInArrow(run, "token long, doc long, n long")


def _lists(batches, columns: int):
    """Whole posting lists, as rows of numpy arrays, from a stream sorted by its first column."""
    held: list[np.ndarray] = []
    for b in batches:
        new = np.stack([b.column(i).to_numpy() for i in range(columns)])
        if not new.shape[1]:
            continue
        x = np.concatenate([*held, new], 1) if held else new
        cut = np.searchsorted(x[0], x[0, -1])
        if cut:
            yield x[:, :cut]
        held = [x[:, cut:]]
    if held:
        yield held[0]


def _alike(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Sizes that leave room for the similarity asked for."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _first_links(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member of a list with the list's first member of its size range."""

    def run(batches):
        for x in _lists(batches, 3):
            token, doc, n = x
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            lead = np.repeat(starts, np.diff([*starts, len(token)]))
            at = np.flatnonzero((lead != np.arange(len(token))) & _alike(n, n[lead], percent))
            pairs = np.unique(np.stack([doc[at], doc[lead[at]]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return postings.repartition("token").sortWithinPartitions("token", "doc").mapInArrow(run, "a long, b long").distinct()


def _apart(rows: DataFrame, parts: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs whose ends no component joins yet."""
    named = parts.select("node", "component")
    one, two = named.select(F.col("node").alias("na"), F.col("component").alias("ca")), named.select(F.col("node").alias("nb"), F.col("component").alias("cb"))
    both = rows.join(one, F.col(a) == F.col("na"), "left").join(two, F.col(b) == F.col("nb"), "left")
    return both.where(F.coalesce("ca", a) != F.coalesce("cb", b)).select(*rows.columns)


def _streamed(batches, columns: int, width: int, merge):
    """Merges whole lists of a stream sorted by its first column; the last column holds `width`-byte rows (0: of any size)."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(i).to_numpy() for i in range(columns)]
        raw = batch.column(columns).to_pylist()
        if width:
            new.append(np.frombuffer(b"".join(raw), np.uint32).reshape(batch.num_rows, -1))
        else:
            last = np.empty(len(raw), object)
            last[:] = [np.frombuffer(x, U64) for x in raw]
            new.append(last)
        x = [np.concatenate(y) for y in zip(held, new)] if held else new
        cut = int(np.searchsorted(x[0], x[0][-1]))
        if cut:
            yield merge(*(y[:cut] for y in x))
        held = [y[cut:] for y in x]
    if held:
        yield merge(*held)


def _runs(token: np.ndarray):
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    return zip(starts.tolist(), [*starts[1:].tolist(), len(token)])


def _open_groups(postings: DataFrame, parts: DataFrame, reps: DataFrame, percent: int, match: int) -> DataFrame:
    """(group, doc, c): within each list that spans components, the documents that collide with one of another component.

    Collisions are counted within the list, over whole signatures. Lists that give the same documents give one group.
    """
    named = postings.join(parts.select(F.col("node").alias("doc"), "component"), "doc", "left").select("token", "doc", "n", F.coalesce("component", "doc").alias("c"))
    mixed = named.groupBy("token").agg(F.count("*").alias("size"), F.min("c").alias("low"), F.max("c").alias("high")).where("size > 2 and low <> high").select("token")
    rows = named.join(mixed, "token").join(reps.select(F.col("rep").alias("doc"), "sig"), "doc").select("token", "doc", "n", "c", "sig")

    def merge(token, doc, n, c, sig):
        out: list[list[np.ndarray]] = [[], [], []]
        for lo, hi in _runs(token):
            open_ = np.zeros(hi - lo, bool)
            for i in range(lo, hi - 1):
                at = np.arange(i + 1, hi)
                at = at[(c[i + 1 : hi] != c[i]) & _alike(n[i + 1 : hi], n[i], percent)]
                at = at[(sig[at] == sig[i]).sum(1) >= match]
                if len(at):
                    open_[i - lo] = True
                    open_[at - lo] = True
            d = doc[lo:hi][open_]
            if len(d):
                name = xxhash.xxh3_64_intdigest(d.tobytes()) >> 1
                for k, v in enumerate((np.full(len(d), name), d, c[lo:hi][open_])):
                    out[k].append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.empty(0, np.int64)) for v in out], ["group", "doc", "c"])

    wide = rows.repartition("token").sortWithinPartitions("token", "doc")
    return wide.mapInArrow(lambda it: _streamed(it, 4, 4, merge), "group long, doc long, c long").dropDuplicates(["group", "doc"])


def _sets_of(ids: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(x, set) of the documents in ids (x), and of a few more."""
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(flags(ids, "x")))

    def sets(batches):
        bits = np.unpackbits(wanted.value).view(bool)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(bits[ids % len(bits)]):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i]], pa.int64()), pa.array([shingle_set(b.column(1)[int(i)].as_py(), size).tobytes()], pa.binary())], ["x", "set"])

    full = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").cast("binary").alias("_t")).where("_id is not null").mapInArrow(sets, "x long, set binary")
    return full.dropDuplicates(["x"])


def _group_links(groups: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """(a, b): links of alike sets that join the components of each group. A group's full sets meet in one task, as a stream
    of groups; every pair across components is compared until a link joins the two, and only joining links are returned."""
    rows = groups.join(_sets_of(groups.select(F.col("doc").alias("x")), docs, doc_id, text, size), F.col("doc") == F.col("x")).select("group", "doc", "c", "set")

    def merge(group, doc, c, sets):
        a, b = [], []
        for lo, hi in _runs(group):
            own = c[lo:hi].copy()
            sizes = np.array([len(s) for s in sets[lo:hi]])
            _, at = np.unique(np.concatenate(sets[lo:hi]), return_inverse=True)
            owner = np.repeat(np.arange(hi - lo), sizes)
            order = np.argsort(at, kind="stable")
            owners, ends = owner[order], np.cumsum(np.bincount(at))
            ends = np.concatenate([[0], ends])
            first = np.concatenate([[0], np.cumsum(sizes)])
            for i in range(hi - lo - 1):
                if (own[i + 1 :] == own[i]).all():
                    continue
                mine = at[first[i] : first[i + 1]]
                shared = np.bincount(np.concatenate([owners[ends[k] : ends[k + 1]] for k in mine]), minlength=hi - lo)
                near = 100 * shared >= percent * (sizes + sizes[i] - shared)
                near[: i + 1] = False
                for j in np.flatnonzero(near & (own != own[i])):
                    if own[j] != own[i]:
                        own[own == own[j]] = own[i]
                        a.append(doc[lo + j])
                        b.append(doc[lo + i])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition("group").sortWithinPartitions("group", "doc").mapInArrow(lambda it: _streamed(it, 3, 0, merge), "a long, b long").distinct()


def _colliding(pairs: DataFrame, reps: DataFrame, coords: int, match: int) -> DataFrame:
    """The pairs that agree on at least match coordinates of their whole signatures."""
    sig = reps.select(F.col("rep").alias("r"), F.col("sig").alias("s"))
    both = pairs.join(sig.select(F.col("r").alias("a"), F.col("s").alias("sa")), "a").join(sig.select(F.col("r").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(-1, coords) for i in (2, 3))
                at = pa.array((x == y).sum(1) >= match)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(at), b.column(1).filter(at)], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are alike enough. Each set travels once for each pair, not twice."""
    full = _sets_of(pairs.select(F.col("a").alias("x")).union(pairs.select("b")), docs, doc_id, text, size)
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(16)).cast("int"))
    heads = dealt.select("b", "salt").distinct().join(full, F.col("b") == F.col("x")).select("b", "salt", F.lit(None).cast("long").alias("a"), "set")
    members = dealt.join(full, F.col("a") == F.col("x")).select("b", "salt", "a", "set")

    def run(batches):
        key, head = None, None
        for batch in batches:
            a, b = [], []
            for k, salt, member, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                s = np.frombuffer(data, U64)
                if member is None:
                    key, head = (k, salt), s
                elif key == (k, salt):
                    shared = len(np.intersect1d(head, s, True))
                    if 100 * shared >= percent * (len(head) + len(s) - shared):
                        a.append(member)
                        b.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return heads.unionByName(members).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first()).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, coords: int = 96, match: int = 54) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest id reachable over links), kept.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| over their full shingle sets. A null, empty or
    blank text has no shingles and is linked with nothing; a text of fewer words than a shingle is one shingle. Rows
    with a null id get a null component and are kept. A repeated id gives its rows again, and they share a component.
    Other columns of docs are not read. match is how many of the coords minima a pair must share to be confirmed;
    with the defaults, a pair of similarity 0.75 has fewer with a probability of about one in 100,000.
    """
    spark = docs.sparkSession
    with wide_rows(spark):
        sigs = materialize(signatures(docs, doc_id, text, size, coords), "signatures")
    live = sigs.where("_id is not null and n_shingles > 0")
    reps = materialize(live.groupBy("hi", "lo").agg(F.min("_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "sets")
    with wide_rows(spark):
        postings = materialize(_postings(reps, coords, match), "postings")

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "pairs")
        with wide_rows(spark):
            return materialize(_confirmed(pairs, docs, doc_id, text, size, percent), "links")

    first = materialize(_first_links(postings, percent), "first")
    # one link each, to the earliest document: it alone joins most groups, whatever their size
    earliest = first.groupBy("a").agg(F.min("b").alias("b"))
    links = confirm(_colliding(earliest, reps, coords, match))
    parts = materialize(connected_components(links, "a", "b"), "parts")
    links = links.unionByName(confirm(_colliding(_apart(first.join(earliest, ["a", "b"], "left_anti"), parts, "a", "b"), reps, coords, match)))
    parts = materialize(connected_components(links, "a", "b"), "parts")
    groups = materialize(_open_groups(postings, parts, reps, percent, match), "groups")
    if not groups.isEmpty():
        with wide_rows(spark):
            links = links.unionByName(materialize(_group_links(groups, docs, doc_id, text, size, percent), "links"))
        parts = materialize(connected_components(links, "a", "b"), "parts")
    # a row's set -> the set's first document -> the component of that
    named = reps.select("hi", "lo", "rep").join(parts, F.col("rep") == F.col("node"), "left").select("hi", "lo", F.coalesce("component", "rep").alias("c"))
    linked = live.select("_id", "hi", "lo").join(named, ["hi", "lo"]).groupBy("_id").agg(F.min("c").alias("c"))
    out = sigs.select("_id", "n_shingles").join(linked, "_id", "left")
    c = F.coalesce("c", "_id")
    return out.select(F.col("_id").alias(doc_id), "n_shingles", c.alias("component_id"), F.coalesce(c == F.col("_id"), F.lit(True)).alias("kept"))
