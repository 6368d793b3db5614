"""One query for each operator of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50, against all others."""
    from tessera.llm.ann import search

    v = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(v, v.where("vec_id % 50 = 0"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many spans of each pattern, a digest of those, and all spans."""
    from tessera.llm.secret_scan import KINDS, digest, fit, scan

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs))

    def of(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    base = digest("spans", KINDS[:3])
    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), digest("spans").alias("spans"))


def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that overlap."""
    from tessera.llm.decontaminate import overlaps

    return overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def vocabulary() -> str:
    """The tokenizer file of op4, which lies at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of a document: its ids by digest, and its place in the sequences."""
    from tessera.llm.packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), vocabulary())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document that stays: its text without repeated lines, and how many it lost."""
    from tessera.llm.line_dedup import dedup_lines

    return dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), count="n_removed")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: host and path of its url, the rule that fits, and the verdict."""
    from tessera.llm.url_filter import judge, mine

    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, mine(pages, _read(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


def op7_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its main text, and how long that is."""
    from tessera.llm.html_extract import extract

    out = extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the size of its set of shingles, its component, and whether it stays."""
    from tessera.llm.minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the expected grade of toxicity, and whether it is rejected."""
    from tessera.llm.toxicity import REJECT, fit, score

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", "severity", (F.col("severity") >= REJECT).alias("toxic"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest are those of the payload as read back; for a revisit, those its record states."""
    from tessera.llm._common import new_folder
    from tessera.llm.warc import round_trip

    got = round_trip(_read(spark, sf_dir, "pages").select("page_id", "url", "html"), new_folder(spark, "warc"))
    revisit = F.col("type") == "revisit"
    return got.select("page_id", F.when(revisit, F.col("length")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"), F.when(revisit, F.col("digest")).otherwise(F.sha1("payload")).alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


#: What op11 tells of each file, besides what the manifest has.
FILE_DIGEST = "day long, file_no long, path string, rewritten boolean, n_rows long, cents long, rows_crc long, columns string, ids_sha256 string"


def _file_digests(listed: DataFrame) -> DataFrame:
    """Each file (day, file_no, path, rewritten) read back by an executor in a stream, and told in a row."""
    import hashlib
    import zlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    from tessera.llm.late_overwrite import _open, _tasks

    def micros(c):
        return pc.fill_null(pc.cast(pc.cast(c, pa.int64()), pa.string()), "")

    def tell(path: str) -> tuple:
        n, cents, crc, ids, comma = 0, 0, 0, hashlib.sha256(), b""
        fs, at = _open(path)
        with fs.open_input_file(at) as f:
            file = pq.ParquetFile(f)
            for b in file.iter_batches(batch_size=50_000, columns=["sale_id", "total", "sold_at", "arrived_at"]):
                c = dict(zip(b.schema.names, b.columns))
                n += b.num_rows
                cents += int(np.floor(100 * pc.fill_null(c["total"], 0.0).to_numpy(zero_copy_only=False) + 0.5).sum())
                sale = pc.fill_null(pc.cast(c["sale_id"], pa.string()), "")
                rows = pc.binary_join_element_wise(sale, micros(c["sold_at"]), micros(c["arrived_at"]), ":")
                crc += sum(map(zlib.crc32, pc.cast(rows, pa.binary()).to_pylist()))
                if b.num_rows:
                    ids.update(comma + ",".join(sale.to_pylist()).encode())
                    comma = b","
            return n, cents, crc, ",".join(file.schema_arrow.names), ids.hexdigest()

    def run(batches):
        for b in batches:
            told = [tell(p) for p in b.column(2).to_pylist()]
            cells = list(zip(*told)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cells, kinds))], [x.split()[0] for x in FILE_DIGEST.split(", ")])

    return listed.repartition(_tasks(listed.sparkSession), "path").mapInArrow(run, FILE_DIGEST)


def op11_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file of the layout that late rows have overwritten: what it holds, read back, and whether it was written anew."""
    from tessera.llm._common import new_folder
    from tessera.llm.late_overwrite import Layout, create, manifest, overwrite_late

    sales = _read(spark, sf_dir, "sales").select("sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority")
    to = Layout(new_folder(spark, "late"), "sale_id", "sold_at", "arrived_at", 1 + sales.count() // 700)
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    copies = sales.where((h % 3 == 0) & (to.day() % 7 == 0)).withColumns({"total": F.col("total") + 1, "sold_at": F.col("sold_at") + F.make_dt_interval((h % 2).cast("int")), "arrived_at": F.col("arrived_at") + F.make_dt_interval((1 + h % 97).cast("int"))})
    rows = sales.unionByName(copies)
    early = F.coalesce(F.col("arrived_at") < F.lit("2024-04-10").cast("timestamp_ntz"), F.lit(False))
    create(rows.where(early), to)
    overwrite_late(rows.where(~early), to)
    return _file_digests(manifest(spark, to.path).select("day", "file_no", "path", (F.col("generation") > 1).alias("rewritten")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, a tenth of them made periodic: its runs by count and digest, the one of most periods, and its text without repetitions."""
    from tessera.llm.tandem_runs import collapse_runs

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    docs = docs.withColumn("a", F.col("g") % F.col("n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")))
    docs = docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
    row = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = F.reduce(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    out = collapse_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(row, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.floor(F.col("b.length") * 1000 / F.col("b.period"))
    return out.select("doc_id", "n_runs", *(F.col(f"b.{c}").alias(c) for c in ("start", "length", "period")), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its bytes, and what is left of them without strings of 200 bytes that start twice."""
    from tessera.llm.suffix_dedup import cut_repeats

    out = cut_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict:
    return {"op1_posting_lists": op1_posting_lists, "op2_secrets": op2_secrets, "op3_spaced_seeds": op3_spaced_seeds, "op4_best_fit_packing": op4_best_fit_packing, "op5_line_dedup": op5_line_dedup, "op6_url_rules": op6_url_rules, "op7_text_density": op7_text_density, "op8_minhash": op8_minhash, "op9_toxicity": op9_toxicity, "op10_warc": op10_warc, "op11_late_overwrite": op11_late_overwrite, "op12_periodic_runs": op12_periodic_runs, "op13_suffix_array": op13_suffix_array}


OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS d FROM pages),
h AS (SELECT d, max(page_id) AS head FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN h ON p.d = h.d AND p.n >= 1000
"""


#: Urls that no rule fits are allowed: where labels don't depend on urls, as in the tables at hand, nothing is mined that blocks them.
OP6_SQL = """
WITH p AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(name, h, p, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
best AS (SELECT page_id, arg_max(name, length(name)) AS rule, arg_max(verdict, length(name)) AS verdict FROM h, r WHERE (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN best ON h.page_id = best.page_id
"""

OP8_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(y, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(y, w.doc_id)) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN least ON w.doc_id = least.x
"""


#: Every string of 200 bytes by digest, over texts in hexadecimal digits, two for a byte.
OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT r, x, unnest(range(greatest(n - 199, 0))) AS i FROM d)),
again AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
opens AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS opens FROM again),
spans AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS k FROM opens) GROUP BY r, k),
parts AS (SELECT r, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY r ORDER BY lo) AS before FROM spans),
cut AS (SELECT p.r, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head FROM parts p JOIN d ON p.r = d.r GROUP BY p.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN last IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut ON d.r = cut.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_rules": OP6_SQL, "op8_minhash": OP8_SQL, "op10_warc": OP10_SQL, "op13_suffix_array": OP13_SQL}
