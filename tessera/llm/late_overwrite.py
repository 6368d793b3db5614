"""Days of a file layout that late rows overwrite: new generations of files, told by a manifest.

A layout is a folder with `data` (Parquet files, some for each day) and `_manifest` (one folder of JSON lines a generation, a line for
each file). It keeps the latest-arrived row of each id; a day's rows are sorted by time and id and cut into files of a fixed number of
rows. Late rows make some days dirty: those where a late row comes to stand, and those where its id stood before. Executors write
the files of dirty days anew, under the names of a new generation; the new manifest lists them together with the untouched files
of clean days. It counts once Spark's committer has marked its folder complete, so readers see the old layout or the new one.
Only then does the driver delete the files that the new manifest no longer lists.

Places in a day come from a range partitioning by day, time and id: no day, however hot, goes through one task. One file is written by
one task, in a stream. Lost tasks are run again: they write the same bytes under the same names, by renaming.

The manifest has a line for each file, so per_file should grow with the rows; the driver only ever sees lines of superseded files,
one at a time. A null id is an id like any other. A null time gives day -1. A null arrival is before all others. Of rows of an id that
arrived at once, the one with the greatest columns stays (in their order); against a row that stands already, it must arrive later.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._common import fresh, materialize

#: Columns of the manifest.
LISTED = "day long, file_no long, n_rows long, path string, generation long"
#: Rows that are held before they are written as a row group.
ROW_GROUP = 50_000


@dataclass(frozen=True)
class Layout:
    """Where a layout lies, and the names of the columns that rule it."""

    path: str
    ident: str
    time: str
    arrived: str
    per_file: int

    def day(self) -> Column:
        """Whole days since 1970; -1 without a time."""
        return F.coalesce(F.unix_date(F.col(self.time).cast("date")).cast("long"), F.lit(-1).cast("long"))


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _newest(spark: SparkSession, path: str) -> int:
    """The last generation whose manifest is complete; 0 if there is none."""
    at, fs = _hadoop(spark, f"{path}/_manifest")
    if not fs.exists(at):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return max((int(n) for n in names if n.isdigit() and fs.exists(_hadoop(spark, f"{path}/_manifest/{n}/_SUCCESS")[0])), default=0)


def manifest(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """A row for each file of a layout: day, file_no, n_rows, path, generation."""
    n = _newest(spark, path) if generation is None else generation
    if not n:
        raise ValueError(f"no layout in {path}")
    return spark.read.schema(LISTED).json(f"{path}/_manifest/{n:06d}")


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _open(path: str):
    """The file system of a path, and the path in it."""
    return FileSystem.from_uri(path if "://" in path else "file://" + path)


def read_files(listed: DataFrame, columns: list[str], schema, path: str = "path") -> DataFrame:
    """The rows of the files of a manifest, only `columns`, behind all columns of `listed`; read by executors in a stream."""
    names = [f.name for f in schema if f.name in set(columns)]
    lead = listed.columns
    out = listed.schema
    for n in names:
        out = out.add(schema[n])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                fs, at = _open(b.column(lead.index(path))[i].as_py())
                with fs.open_input_file(at) as f:
                    for part in pq.ParquetFile(f).iter_batches(batch_size=ROW_GROUP, columns=names):
                        told = [pa.repeat(b.column(k)[i], part.num_rows) for k in range(len(lead))]
                        yield pa.RecordBatch.from_arrays([*told, *(part.column(n) for n in names)], [*lead, *names])

    return listed.repartition(_tasks(listed.sparkSession), F.col(path)).mapInArrow(run, out)


def latest(rows: DataFrame, ident: str, arrived: str) -> DataFrame:
    """The latest-arrived row of each id; aggregated before the shuffle, so an id with a third of all rows is no burden."""
    best = rows.groupBy(F.col(ident)).agg(F.max(F.struct(F.col(arrived).alias("__first"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(rows.columns)))).alias("__best"))
    return best.select(*(F.col(f"__best.c{k}").alias(c) for k, c in enumerate(rows.columns)))


def _placed(rows: DataFrame, to: Layout, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows with their day, the file they belong to, and the place in their day, by range partitions whose sizes are counted."""
    day, at, part, first, n, before, file_no, place = names = fresh(columns, "day", "at", "part", "first", "n", "before", "file_no", "place")
    x = rows.select(*columns, to.day().alias(day))
    keys = [F.col(c).asc_nulls_first() for c in (day, to.time, to.ident)]
    x = x.repartitionByRange(_tasks(rows.sparkSession), *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    x = materialize(x, "layout").withColumn(part, F.shiftright(at, 33))
    counts = x.groupBy(day, part).agg(F.min(at).alias(first), F.count("*").alias(n))
    w = Window.partitionBy(day).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(day, part, first, F.coalesce(F.sum(n).over(w), F.lit(0)).alias(before))
    # a row for each day that a range partition holds: at most as many as there are partitions and days
    x = x.join(F.broadcast(counts), [day, part]).withColumn(place, F.col(before) + F.col(at) - F.col(first))
    x = x.withColumn(file_no, F.floor(F.col(place) / F.lit(to.per_file)).cast("long"))
    return x.select(day, file_no, place, *columns), names


def _write(rows: DataFrame, to: Layout, columns: list[str], generation: int) -> DataFrame:
    """The manifest rows of files that executors write as the DataFrame is computed."""
    x, (day, _, _, _, _, _, file_no, place) = _placed(rows, to, columns)
    folder, name = f"{to.path}/data", f"g{generation:06d}-{uuid.uuid4().hex[:8]}"

    def run(batches):
        key = writer = stream = None
        held, size, count, done = [], 0, 0, []

        def flush():
            nonlocal held, size
            if held:
                writer.write_table(pa.Table.from_batches(held))
            held, size = [], 0

        def close():
            flush()
            writer.close()
            stream.close()
            fs.move(hidden, final)
            done.append((*key, count, f"{folder}/{final.rpartition('/')[2]}", generation))

        for b in batches:
            days, files = b.column(0), b.column(1)
            d, f = days.to_numpy(), files.to_numpy()
            edges = [0, *((d[1:] != d[:-1]) | (f[1:] != f[:-1])).nonzero()[0] + 1, b.num_rows] if b.num_rows else [0, 0]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                part = pa.RecordBatch.from_arrays([b.column(k + 3).slice(lo, hi - lo) for k in range(len(columns))], columns)
                if key != (d[lo], f[lo]):
                    if key:
                        close()
                    key, count = (d[lo], f[lo]), 0
                    fs, root = _open(folder)
                    fs.create_dir(root, recursive=True)
                    final = f"{root}/{name}-d{key[0]}-{key[1]:05d}.parquet"
                    hidden = f"{root}/_{uuid.uuid4().hex}.tmp"
                    stream = fs.open_output_stream(hidden)
                    writer = pq.ParquetWriter(stream, part.schema)
                held.append(part)
                size += part.num_rows
                count += part.num_rows
                if size >= ROW_GROUP:
                    flush()
        if key:
            close()
        cells = list(zip(*done)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], [c.split()[0] for c in LISTED.split(", ")])

    return x.repartition(_tasks(rows.sparkSession), day, file_no).sortWithinPartitions(day, file_no, place).mapInArrow(run, LISTED)


def _commit(listed: DataFrame, to: Layout, generation: int) -> None:
    """Writes the manifest, and with it the files it lists."""
    listed.write.json(f"{to.path}/_manifest/{generation:06d}")


def create(rows: DataFrame, to: Layout) -> None:
    """Writes the layout of `rows` as the first generation, into a folder without a layout."""
    spark = rows.sparkSession
    if _newest(spark, to.path):
        raise ValueError(f"a layout lies in {to.path}")
    _commit(_write(latest(rows, to.ident, to.arrived), to, rows.columns, 1), to, 1)
    at, fs = _hadoop(spark, f"{to.path}/_layout.json")
    out = fs.create(at, True)
    out.write(bytearray(json.dumps({"schema": rows.schema.jsonValue(), "per_file": to.per_file}).encode()))
    out.close()


def overwrite_late(late: DataFrame, to: Layout) -> int:
    """Makes the layout that of its rows and `late` together, and returns the new generation.

    Of the files of clean days only ids and arrivals are read; they stay as they are. `late` has the layout's columns.
    Joins on ids are told to shuffle: however well ids compress, they are as many as the rows.
    """
    spark, columns = late.sparkSession, late.columns
    now = _newest(spark, to.path)
    old = manifest(spark, to.path, now)
    was, came, new_day, ident, path = fresh(columns, "was", "came", "new_day", "ident", "path")
    stands = read_files(old.select(F.col("day").alias(was), F.col("path").alias(path)), [to.ident, to.arrived], late.schema, path)
    stands = stands.select(was, F.col(to.ident).alias(ident), F.col(to.arrived).alias(came))
    x = latest(late, to.ident, to.arrived)
    x = x.join(stands.hint("merge"), F.col(to.ident).eqNullSafe(F.col(ident)), "left")
    later = F.col(came).isNull() & F.col(to.arrived).isNotNull() | (F.col(to.arrived) > F.col(came))
    kept = x.where(F.col(was).isNull() | later).select(*columns, was, to.day().alias(new_day))
    kept = materialize(kept, "late")
    dirty = kept.select(F.explode(F.array(was, new_day)).alias("day")).where("day is not null").distinct()
    dirty = materialize(dirty, "dirty")
    # the rows of dirty days that no late row replaces
    stay = read_files(old.join(dirty, "day", "left_semi").select(F.col("path").alias(path)), columns, late.schema, path).select(*columns)
    gone = kept.where(F.col(was).isNotNull()).select(F.col(to.ident).alias(ident))
    stay = stay.join(gone.hint("merge"), F.col(to.ident).eqNullSafe(F.col(ident)), "left_anti")
    files = _write(stay.unionByName(kept.select(*columns)), to, columns, now + 1)
    _commit(old.join(dirty, "day", "left_anti").select(files.columns).unionByName(files), to, now + 1)
    for row in old.join(dirty, "day", "left_semi").select("path").toLocalIterator():
        at, fs = _hadoop(spark, row["path"])
        fs.delete(at, False)
    return now + 1


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes what broken runs left in a layout's data folder: files that the newest manifest doesn't list. Returns how many. For when no run is going on."""
    live = {r["path"].rpartition("/")[2] for r in manifest(spark, path).select("path").toLocalIterator()}
    at, fs = _hadoop(spark, f"{path}/data")
    dead = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in live] if fs.exists(at) else []
    for p in dead:
        fs.delete(p, False)
    return len(dead)


def read_layout(spark: SparkSession, to: Layout) -> DataFrame:
    """The rows that the newest generation holds."""
    from pyspark.sql.types import StructType

    at, fs = _hadoop(spark, f"{to.path}/_layout.json")
    stream = fs.open(at)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    schema = StructType.fromJson(json.loads(text)["schema"])
    (path,) = fresh(schema.names, "path")
    return read_files(manifest(spark, to.path).select(F.col("path").alias(path)), schema.names, schema, path).select(*schema.names)
