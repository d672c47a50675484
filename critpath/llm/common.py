"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: the shared folder that the cluster names; a folder of our own on one machine alone (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and stored in the shared checkpoint folder, where it outlives lost executors."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(column: str, by: int) -> Column:
    """crc32 of a column's text, modulo by; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(by)


def crc_of(value: object) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII white space; bytes.lower and bytes.split know ASCII only."""
    return text.encode().lower().split() if text else []


def plain(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[int | None]]:
    """docs under names that nothing clashes with (c0, c1, ...) and the places of the wanted columns (None: not there).

    Names are renamed by place, so dots, quotes and names that differ in case alone do no harm; of such names the exact one counts.
    """
    low = [n.lower() for n in docs.columns]

    def place(name: str) -> int | None:
        if name in docs.columns:
            return docs.columns.index(name)
        return low.index(name.lower()) if name.lower() in low else None

    return docs.toDF(*(f"c{i}" for i in range(len(low)))), [place(w) for w in wanted]


def only(docs: DataFrame, *wanted: str) -> DataFrame:
    """The wanted columns of docs alone, whatever else it has."""
    rows, places = plain(docs, *wanted)
    if None in places:
        raise ValueError(f"no column {wanted[places.index(None)]}")
    return rows.select(*(F.col(f"c{i}").alias(w) for i, w in zip(places, wanted, strict=True)))


def free(name: str, taken: list[str]) -> str:
    """name with as many leading underscores as keep it apart from the taken ones."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def appended(docs: DataFrame, wanted: list[str], carry: list[str], figures: dict[str, DataType], made: Callable[[], Callable[..., list[pa.Array]]], rows_at_once: int = 1 << 10) -> DataFrame:
    """The carried columns of docs and figures (renamed if a carried name clashes) of each row.

    made() gives a worker its function from the wanted columns, as Arrow arrays (all null if docs lacks one), to the
    figures' arrays.
    """
    rows, places = plain(docs, *wanted, *carry)
    if None in places[len(wanted) :]:
        raise ValueError("a carried column isn't there")
    values = [F.lit(None).cast("string") if i is None else F.col(f"c{i}") for i in places[: len(wanted)]]
    kept = [rows.schema[i] for i in places[len(wanted) :]]
    schema = StructType([StructField(f"k{n}", f.dataType) for n, f in enumerate(kept)] + [StructField(f"f{n}", t) for n, t in enumerate(figures.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = made()
        for batch in batches:
            for i in range(0, len(batch), rows_at_once):
                part = batch.slice(i, rows_at_once)
                yield pa.RecordBatch.from_arrays([*part.columns[len(wanted) :], *of(*part.columns[: len(wanted)])], names=schema.names)

    selected = rows.select(*(v.alias(f"w{n}") for n, v in enumerate(values)), *(F.col(f.name).alias(f"k{n}") for n, f in enumerate(kept)))
    return selected.mapInArrow(run, schema).toDF(*carry, *(free(x, carry) for x in figures))


def filtered(docs: DataFrame, wanted: list[str], made: Callable[[], Callable[..., pa.Array]]) -> DataFrame:
    """The rows of docs for which a worker's function of the wanted columns says true, all columns as they are."""
    rows, places = plain(docs, *wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = made()
        for batch in batches:
            yield batch.filter(of(*(pa.nulls(len(batch), pa.string()) if i is None else batch.column(i) for i in places)))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared checkpoint folder and read again."""
    spark = df.sparkSession
    with_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
