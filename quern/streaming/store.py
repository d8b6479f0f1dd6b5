"""A keyed table as a base and what was written since, in buckets, with a manifest of what belongs to it.

Rows are dealt to buckets by a hash of their key. A batch is written as one folder of buckets; the manifest then names,
for each bucket, its base and the batches since. A read takes buckets without such batches as they are and merges only
the others, so that a table that is mostly at rest is not folded anew. Compaction makes the newest rows of some buckets
their base. A manifest is a table of its own under the next number, complete or not there, so readers see a whole state.

One writer at a time: the stream whose batches they are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.collection import latest
from quern.sources.tables import delete, exists

BUCKETS, MOST_DELTAS = 64, 8
MANIFEST = "bucket int, folder string, batch bigint"  # the base of a bucket has batch -1


def bucket(key: list[str], buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _folders(spark: SparkSession, path: str) -> list[str]:
    if not exists(spark, path):
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().getName() for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete manifests, ascending."""
    found = sorted(int(f.partition("=")[2]) for f in _folders(spark, f"{path}/manifest") if f.startswith("version="))
    return [v for v in found if exists(spark, f"{path}/manifest/version={v}/_SUCCESS")]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> list[tuple[int, str, int]]:
    """(bucket, folder, batch) of a version, by default the newest: at most a base and ``MOST_DELTAS`` or some more
    batches for each bucket."""
    known = versions(spark, path)
    if not known:
        return []
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/version={known[-1] if version is None else version}")
    return sorted((r.bucket, r.folder, r.batch) for r in rows.collect())


def publish(spark: SparkSession, path: str, entries: Iterable[tuple[int, str, int]]) -> None:
    """Make ``entries`` the next version."""
    known = versions(spark, path)
    number = max([int(f.partition("=")[2]) for f in _folders(spark, f"{path}/manifest") if f.startswith("version=")], default=0)
    spark.createDataFrame(sorted(set(entries)), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={max(number, known[-1] if known else 0) + 1}")


def write(path: str, rows: DataFrame, batch: int, key: list[str], buckets: int = BUCKETS) -> None:
    """Add ``rows``, one for each key, as ``batch``. A batch written again replaces itself."""
    spark, folder = rows.sparkSession, f"{path}/batches/batch={batch}"
    rows.withColumn("bucket", bucket(key, buckets)).write.mode("overwrite").partitionBy("bucket").parquet(folder)
    here = [int(f.partition("=")[2]) for f in _folders(spark, folder) if f.startswith("bucket=")]
    before = [e for e in manifest(spark, path) if e[2] != batch]
    publish(spark, path, [*before, *((b, folder, batch) for b in here)])


def _parts(spark: SparkSession, entries: list[tuple[int, str, int]]) -> DataFrame:
    """The rows of some buckets of some folders: of a batch its number is told, in a base each row has it."""
    out = None
    for folder, batch in sorted({(f, n) for _, f, n in entries}):
        rows = spark.read.parquet(*[f"{folder}/bucket={b}" for b, f, n in entries if (f, n) == (folder, batch)])
        rows = rows.withColumn("batch", F.lit(batch).cast("bigint")) if batch >= 0 else rows
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read(spark: SparkSession, path: str, key: list[str], order: list[str], keys: DataFrame | None = None, before: int | None = None, buckets: int = BUCKETS) -> DataFrame | None:
    """The newest row of each key by batch, then ``order``, with its ``batch``. None if nothing was ever written.

    With ``keys`` (a DataFrame of them) only their buckets are read and only their rows returned; with ``before`` only
    batches before that one count.
    """
    entries = [e for e in manifest(spark, path) if before is None or e[2] < before]
    if not entries:
        return None
    wanted = None if keys is None else {r[0] for r in keys.select(bucket(key, buckets)).distinct().collect()}
    by: dict[int, list[tuple[str, int]]] = {}
    for b, folder, batch in entries:
        by.setdefault(b, []).append((folder, batch))
    chosen = {b: f for b, f in by.items() if wanted is None or b in wanted}
    rest = [(b, f, n) for b, fs in chosen.items() if len(fs) == 1 for f, n in fs]
    dirty = [(b, f, n) for b, fs in chosen.items() if len(fs) > 1 for f, n in fs]
    found = _parts(spark, rest or entries[:1])  # for its columns, if no bucket is at rest
    found = found if rest else found.limit(0)
    if dirty:
        found = found.unionByName(latest(_parts(spark, dirty), key, ["batch", *order]), allowMissingColumns=True)
    return found if keys is None else found.join(keys.select(*key).distinct(), key, "left_semi")


def compact(spark: SparkSession, path: str, key: list[str], order: list[str], least: int = MOST_DELTAS, newest: bool = False) -> list[int]:
    """Make the newest rows of each bucket with ``least`` batches or more its base; the buckets that were.

    The newest batch stays apart, as it may be delivered again, unless ``newest`` says that it is settled.
    """
    known = manifest(spark, path)
    last = max((batch for _, _, batch in known), default=-1) + newest
    entries, rest = [e for e in known if e[2] < last], [e for e in known if e[2] >= last]
    deltas: dict[int, int] = {}
    for b, _, batch in entries:
        deltas[b] = deltas.get(b, 0) + (batch >= 0)
    full = sorted(b for b, n in deltas.items() if n >= least)
    if not full:
        return []
    folder = f"{path}/base/version={versions(spark, path)[-1] + 1}"
    merged = latest(_parts(spark, [e for e in entries if e[0] in full]), key, ["batch", *order])
    merged.withColumn("bucket", bucket(key)).repartition(len(full), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    publish(spark, path, [*rest, *(e for e in entries if e[0] not in full), *((b, folder, -1) for b in full)])
    return full


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete folders that none of the last ``keep`` manifests names, and older manifests. What was deleted."""
    known = versions(spark, path)
    used = {f.rstrip("/") for v in known[-keep:] for _, f, _ in manifest(spark, path, v)}
    gone = []
    folders = [f"{path}/{kind}/{f}" for kind in ("base", "batches") for f in _folders(spark, f"{path}/{kind}")]
    folders += [f"{path}/manifest/version={v}" for v in known[:-keep]]
    for folder in folders:
        if folder not in used and (not folder.startswith(f"{path}/manifest/") or int(folder.rpartition("=")[2]) in known[:-keep]):
            delete(spark, folder)
            gone.append(folder)
    return gone
