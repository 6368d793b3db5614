"""Secret scan: patterns for what has a form, Markov models of characters for what has none.

Everything is DataFrame and SQL functions. Two first-order models give the probability of a character after another: one
of random strings, trained on the values that the patterns find, one of ordinary identifiers, trained on the long words of
documents in which the patterns find nothing. A run of identifier characters whose log-likelihood ratio favours
randomness is a span of kind `markov`, unless it overlaps a span of the patterns; those always stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import fresh

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the models judge: long runs of identifier characters that mix digits with letters, or cases.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
MIXED = r"[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]|[A-Z][A-Z][a-z]"
ORDINARY = r"[A-Za-z0-9+/_=-]{6,}"
#: Ordinary words don't change between digits and letters so often; what does is left out of their sample, as it may be what is looked for.
UNSURE = r"(?:[0-9]+[A-Za-z]+){3}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
K = len(ALPHABET) + 1
#: Documents of each kind that training looks at; the bound of the sample.
SAMPLE = 2_000
#: What the counts of characters alone weigh against those of pairs.
BACKOFF = 20.0
#: How much likelier random than an identifier a span must be: log-likelihood ratio in all, and by character.
RATIO, RATIO_BY_CHAR = 8.0, 0.25


@dataclass
class MarkovModel:
    """log P(next | character, random) - log P(next | character, identifier), by K * (place of the one) + place of the next."""

    weights: list[float]


def _places(token: Column) -> Column:
    """The places of a token's characters in the alphabet, 0 for others."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _bigrams(tokens: DataFrame, kind: int) -> DataFrame:
    """(kind, at, n) of the character pairs in (token) rows."""
    p = tokens.where(F.length("token") >= 2).select(_places(F.col("token")).alias("p"))
    at = F.explode(F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: a * K + b))
    return p.select(at.alias("at")).groupBy("at").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "at", "n")


def _values(t: Column) -> Column:
    """The values of base matches."""
    assigned = F.filter(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)
    return F.concat(assigned, F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(t, F.lit(HEX), F.lit(0)))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> MarkovModel:
    """Trains on whole texts of at most `sample` documents with base matches and as many without, those whose ids hash lowest.

    The driver gets counts of character pairs only, at most 2 * K * K. Without samples of a kind, all pairs are as likely.
    """
    d = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("t")).where("_id is not null and t is not null")
    hit = F.col("t").rlike(ASSIGN) | F.col("t").rlike(ACCESS) | F.col("t").rlike(HEX)
    ids = d.select("_id", hit.alias("hit"))
    lowest = lambda x: x.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    some = F.broadcast(lowest(ids.where("hit")))
    none = F.broadcast(lowest(ids.where("not hit")))
    random = d.join(some, "_id").select(F.explode(_values(F.col("t"))).alias("token"))
    plain = d.join(none, "_id").select(F.explode(F.regexp_extract_all("t", F.lit(ORDINARY), F.lit(0))).alias("token")).where(~F.col("token").rlike(UNSURE))
    n = [[0.0] * (K * K), [0.0] * (K * K)]
    for r in _bigrams(random, 0).unionByName(_bigrams(plain, 1)).collect():
        n[r["kind"]][r["at"]] += r["n"]
    kinds = [_transitions(x) for x in n]
    return MarkovModel([log(a) - log(b) for a, b in zip(*kinds)])


def _transitions(n: list[float], alpha: float = BACKOFF) -> list[float]:
    """P(next | character) from counts; characters seen seldom lean on how often the next is seen at all."""
    seen = [1.0 + sum(n[i * K + j] for i in range(K)) for j in range(K)]
    alone = [x / sum(seen) for x in seen]
    rows = [sum(n[i * K : (i + 1) * K]) for i in range(K)]
    return [(n[i * K + j] + alpha * alone[j]) / (rows[i] + alpha) for i in range(K) for j in range(K)]


def _placed(matches: str, text: str, pattern: str, kind: int) -> Column:
    """The spans (s, k, e, i) of all matches: their lengths and those of the text between them, added up. i counts from 1."""
    between = F.split(F.col(text), pattern, -1)
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<s:int,k:int,e:int,i:int>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["pos"] + x["gap"]
        e = s + x["size"]
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["i"].alias("i")))).alias("out"))

    sizes = F.zip_with(F.col(matches), F.slice(between, F.lit(1), F.size(matches)), lambda m, g: F.struct(F.length(m).alias("size"), F.length(g).alias("gap")))
    numbered = F.transform(sizes, lambda x, i: F.struct(x["size"].alias("size"), x["gap"].alias("gap"), (i + 1).alias("i")))
    empty = F.array().cast("array<struct<s:int,k:int,e:int,i:int>>")
    return F.when(F.size(matches) > 0, F.aggregate(numbered, start, add)["out"]).otherwise(empty)


def scan(docs: DataFrame, model: MarkovModel, doc_id: str = "doc_id", text: str = "text", out: str = "spans") -> DataFrame:
    """docs with a column more: its spans, array<struct<kind, start, end, value>>, sorted by start, then kind.

    Offsets are code points of the whole text, ends exclusive. Null and empty texts have none. All columns of docs stay (one
    named as `out` is replaced), so ids may be null or repeat; every row is judged by itself.
    """
    names = [c for c in docs.columns if c.lower() != out.lower()]
    wanted = ("t", "m0", "m1", "m2", "c", "v0", "random", "s0", "s1", "s2", "base", "drawn")
    at = dict(zip(wanted, fresh(names, *wanted)))
    d = docs.select(*(F.col(f"`{c}`") for c in names), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(at["t"]))
    every = lambda pattern, group=0: F.regexp_extract_all(at["t"], F.lit(pattern), F.lit(group))
    d = d.withColumns({at["m0"]: every(ASSIGN), at["m1"]: every(ACCESS), at["m2"]: every(HEX), at["c"]: every(CANDIDATE)})
    d = d.withColumn(at["v0"], F.when(F.size(at["m0"]) > 0, every(ASSIGN, 2)).otherwise(F.array().cast("array<string>")))
    weights = F.lit(model.weights)

    def odds(token: Column) -> Column:
        """The log-likelihood ratio of a token."""
        return F.aggregate(
            _places(token),
            F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
            lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.get(weights, acc["last"] * K + p))).alias("sum")),
        )["sum"]

    def drawn(token: Column) -> Column:
        mixed = token.rlike(MIXED)
        return F.when(mixed, odds(token) >= F.greatest(F.lit(RATIO), RATIO_BY_CHAR * F.length(token))).otherwise(False)

    d = d.withColumn(at["random"], F.transform(at["c"], drawn))
    d = d.withColumns({at[f"s{k}"]: _placed(at[f"m{k}"], at["t"], p, k) for k, p in enumerate((ASSIGN, ACCESS, HEX))})
    d = d.withColumn(at["s0"], F.filter(at["s0"], lambda x: F.length(F.element_at(at["v0"], x["i"])) >= 6))
    some = F.exists(at["random"], lambda x: x)
    empty = F.array().cast("array<struct<s:int,k:int,e:int,i:int>>")
    d = d.withColumn(at["base"], F.concat(at["s0"], at["s1"], at["s2"]))
    d = d.withColumn(at["drawn"], F.when(some, F.filter(_placed(at["c"], at["t"], CANDIDATE, 3), lambda x: F.element_at(at["random"], x["i"]))).otherwise(empty))
    d = d.withColumn(at["drawn"], F.filter(at["drawn"], lambda x: ~F.exists(at["base"], lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))))
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.transform(F.array_sort(F.concat(at["base"], at["drawn"])), lambda x: F.struct(F.element_at(kinds, x["k"] + 1).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), F.substring(F.col(at["t"]), x["s"] + 1, x["e"] - x["s"]).alias("value")))
    return d.select(*(F.col(f"`{c}`") for c in names), spans.alias(out))


def digest(spans: str | Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    return F.array_join(F.transform(F.filter(spans, lambda x: x["kind"].isin(*kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
