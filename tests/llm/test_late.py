"""Late rows over a layout of days, against a layout made from nothing in plain Python."""

import hashlib
import os
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import late_overwrite as lo
from tessera.llm import queries

EPOCH = datetime(1970, 1, 1)
SF = "/root/testdata/sf0.001"
ROW = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"


def day_of(t):
    return -1 if t is None else (t - EPOCH).days


def layout(rows, size):
    """{(day, file_no): rows} of the latest-arrived row of each id."""
    best = {}
    for r in rows:
        if r[0] not in best or (r[5] or datetime.min) > (best[r[0]][5] or datetime.min):
            best[r[0]] = r
    days = defaultdict(list)
    for r in best.values():
        days[day_of(r[4])].append(r)
    out = {}
    for d, x in days.items():
        x.sort(key=lambda r: (r[4] or datetime.min, -1 if r[0] is None else r[0]))
        out |= {(d, k // size): x[k : k + size] for k in range(0, len(x), size)}
    return out


def micros(t):
    return "" if t is None else str((t - EPOCH) // timedelta(microseconds=1))


def test_query_against_brute_force(spark):
    sales = duckdb.sql(f"SELECT * FROM '{SF}/sales.parquet'").fetchall()
    size, rows = 1 + len(sales) // 700, list(sales)
    for r in sales:
        h = zlib.crc32(str(r[0]).encode())
        if h % 3 == 0 and day_of(r[4]) % 7 == 0:
            rows.append((*r[:3], None if r[3] is None else r[3] + 1, r[4] + timedelta(h % 2), r[5] and r[5] + timedelta(1 + h % 97), r[6]))
    cut = datetime(2024, 4, 10)
    late = [r for r in rows if r[5] is None or r[5] >= cut]
    start, end = layout([r for r in rows if r[5] is not None and r[5] < cut], size), layout(rows, size)
    stood = {r[0]: d for (d, _), x in start.items() for r in x}
    kept = {(r, d) for (d, _), x in end.items() for r in x} & {(r, day_of(r[4])) for r in late}
    dirty = {d for _, d in kept} | {stood[r[0]] for r, _ in kept if r[0] in stood}
    want = {}
    for (d, k), x in end.items():
        ids = ",".join(str(r[0]) for r in x)
        crc = sum(zlib.crc32(f"{r[0]}:{micros(r[4])}:{micros(r[5])}".encode()) for r in x)
        cents = sum(int(100 * r[3] + 0.5) for r in x if r[3] is not None)
        want[d, k] = (len(x), cents, crc, hashlib.sha256(ids.encode()).hexdigest(), d in dirty)
    got = queries.op11_late_overwrite(spark, SF).collect()
    assert {(r["day"], r["file_no"]): (r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["rewritten"]) for r in got} == want
    assert {r["columns"] for r in got} == {"sale_id,client_id,status,total,sold_at,arrived_at,priority"} and len(got) == len(want)
    paths = [r["path"].removeprefix("file://") for r in got]
    found = {os.path.join(at, f) for at, _, fs in os.walk(os.path.dirname(os.path.dirname(paths[0]))) for f in fs if f.endswith((".parquet", ".tmp"))}
    assert found == set(paths) and any(r["rewritten"] for r in got) and not all(r["rewritten"] for r in got)


def make(spark, rows):
    return spark.createDataFrame(rows, ROW)


def row(i, sold, came, total=1.0):
    return (i, 1, "done", total, sold and datetime(2024, 1, sold), came and datetime(2024, 1, came), 1)


def state(spark, to):
    listed = lo.manifest(spark, to.path).collect()
    return {(r["day"] - 19723, r["file_no"]): (r["generation"], [x["sale_id"] for x in pq.read_table(r["path"].removeprefix("file://")).to_pylist()]) for r in listed}


def test_generations(spark, tmp_path):
    to = lo.Layout(f"file://{tmp_path}/a", "sale_id", "sold_at", "arrived_at", 2)
    lo.create(make(spark, [row(k, 1 + k // 4, 5) for k in range(12)] + [row(2, 3, 4), row(None, 1, 5), row(70, None, 5)]), to)
    assert state(spark, to) == {(-19724, 0): (1, [70]), (0, 0): (1, [None, 0]), (0, 1): (1, [1, 2]), (0, 2): (1, [3]), (1, 0): (1, [4, 5]), (1, 1): (1, [6, 7]), (2, 0): (1, [8, 9]), (2, 1): (1, [10, 11])}
    bytes_of = {f.name: f.read_bytes() for f in (tmp_path / "a/data").glob("*.parquet")}
    # one moves from day 1 to day 9; one is no later than what stands; one without arrival is new, one without arrival is not
    lo.overwrite_late(make(spark, [row(4, 10, 6), row(8, 12, 5), row(50, 20, None), row(9, 21, None), row(4, 11, 5)]), to)
    want = {(-19724, 0): (1, [70]), (0, 0): (1, [None, 0]), (0, 1): (1, [1, 2]), (0, 2): (1, [3]), (1, 0): (2, [5, 6]), (1, 1): (2, [7]), (2, 0): (1, [8, 9]), (2, 1): (1, [10, 11]), (9, 0): (2, [4]), (19, 0): (2, [50])}
    assert state(spark, to) == want
    left = {f.name: f.read_bytes() for f in (tmp_path / "a/data").glob("*.parquet")}
    assert len(left) == 10 and all(bytes_of[n] == b for n, b in left.items() if n.startswith("g000001"))
    # the last row of a day leaves: no file is left of it
    lo.overwrite_late(make(spark, [row(50, 20, 9), row(70, 3, 9)]), to)
    assert not [k for k in state(spark, to) if k[0] == -19724] and state(spark, to)[(19, 0)] == (3, [50])
    # nothing late: a new generation of untouched files
    before = state(spark, to)
    lo.overwrite_late(make(spark, []), to)
    assert state(spark, to) == before
    (tmp_path / "a/data/_broken.tmp").write_bytes(b"x")
    (tmp_path / "a/data/g000009-x-d1-00000.parquet").write_bytes(b"x")
    assert lo.vacuum(spark, to.path) == 2 and state(spark, to) == before
    assert lo.read_layout(spark, to).count() == 15
    with pytest.raises(ValueError):
        lo.create(make(spark, []), to)


def test_an_unfinished_generation_does_not_count(spark, tmp_path):
    to = lo.Layout(f"file://{tmp_path}/b", "sale_id", "sold_at", "arrived_at", 5)
    lo.create(make(spark, []), to)
    assert state(spark, to) == {} and lo.read_layout(spark, to).count() == 0
    (tmp_path / "b/_manifest/000002").mkdir()
    assert lo.manifest(spark, to.path).count() == 0
    (tmp_path / "b/_manifest/000002").rmdir()
    lo.overwrite_late(make(spark, [row(1, 1, 1)]), to)
    assert state(spark, to) == {(0, 0): (2, [1])}


def test_clashing_names_and_a_hot_id(spark, tmp_path):
    to = lo.Layout(f"file://{tmp_path}/c", "sale_id", "sold_at", "arrived_at", 3)
    x = make(spark, [row(k % 7 if k % 3 else 5, 1 + k % 2, 1 + k % 9, float(k)) for k in range(200)])
    for c in ("day", "at", "part", "path", "was", "ident", "n", "file_no", "place"):
        x = x.withColumn(c, F.lit(c))
    early = F.col("arrived_at") < F.lit("2024-01-06").cast("timestamp_ntz")
    lo.create(x.where(early), to)
    lo.overwrite_late(x.where(~early), to)
    got = lo.read_layout(spark, to)
    assert got.columns == x.columns and {r["sale_id"] for r in got.collect()} == set(range(7)) and got.where("day = 'day' and path = 'path'").count() == 7
