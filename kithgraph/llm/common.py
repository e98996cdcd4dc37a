"""What the operators share: the shared folder, written intermediate tables, row-wise Arrow stages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of an Arrow batch that Python holds as objects at once.
ROWS = 2_000
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, one of our own, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="kithgraph-")
            spark.sparkContext.setCheckpointDir(_OWN[app])
        path = _OWN[app]
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, together: int | None = None) -> DataFrame:
    """Writes rows to a path and reads them back. Of very large rows, only so many `together` are held by a task that writes or reads them."""
    options = {"compression": "zstd"} | ({"parquet.block.row.count.limit": together} if together else {})
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: cuts lineage, survives the loss of executors."""
    return stored(df, new_path(df.sparkSession, name))


class Scratch:
    """Written tables that are deleted at the end of a with block; what must outlive the block is written outside of it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str, together: int | None = None) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        return stored(df, self.paths[-1], together)

    def clear(self) -> None:
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()


def by_rows(df: DataFrame, make: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas under a name that says what it is for: whole rows in Arrow batches, no shuffle."""
    return df.mapInPandas(make, schema)


def text_of(column: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_columns_from(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[list]]], added: str) -> DataFrame:
    """Adds columns that Python computes from one column, batch by batch, without a shuffle.

    make() is called once per task and gives a function from a batch's values to one list per added column. The other
    columns pass through as they are, nulls and wide integers included.
    """
    fields = T.StructType(df.schema.fields + T._parse_datatype_string(added).fields)
    kinds = [to_arrow_type(f.dataType) for f in fields[len(df.columns) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                new = f(batch.column(batch.schema.get_field_index(column)).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, k) for x, k in zip(new, kinds, strict=True)]], names=fields.names)

    return df.mapInArrow(run, fields)


def packed_rows(docs: DataFrame, *more: str) -> DataFrame:
    """Documents as (row, doc_id, text, ...): the whole row in a struct, so that no name in it can clash with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", text_of().alias("text"), *more)


def unpacked_rows(rows: DataFrame, docs: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of documents again; with a text column, that as text (null texts are empty then) and n_chars counted anew."""
    new = {"text": F.col(text), "n_chars": F.char_length(text).cast("long")} if text else {}
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
