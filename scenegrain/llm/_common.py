"""What several operators of this subpackage share: durable intermediates and text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word separators of the contracts: space and \t \n \v \f \r. bytes.split() cuts at exactly these.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local session takes a temporary folder and sets it; on a cluster, whose
    executors would each write to a disk of their own, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not (jvm := context._jsc.sc().getCheckpointDir()).isDefined():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="scenegrain-"))
            jvm = context._jsc.sc().getCheckpointDir()
        found = jvm.get()
    return found.rstrip("/")


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read again, with the path.

    Cuts the lineage: a lost executor costs no more than the task that reads the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what stored() has written and nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def named(column: str) -> Column:
    """The column of that very name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as make it differ from all columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_rows(docs: DataFrame, run: Callable, *more: T.StructField) -> DataFrame:
    """docs.mapInArrow(run) for a run that gives the columns of docs, and more after them.

    run sees and gives columns named c0, c1, ...: mapInArrow can't be given names with dots.
    """
    plain = [f"c{i}" for i in range(len(docs.columns) + len(more))]
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(plain, [*docs.schema.fields, *more], strict=True)])
    return docs.toDF(*plain[: len(docs.columns)]).mapInArrow(run, schema).toDF(*docs.columns, *(f.name for f in more))


#: A key with more than one in HOT of all rows is looked up by broadcast; there are fewer than HOT of them.
HOT = 1000


def looked_up(rows: DataFrame, found: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Rows with the columns that found has for their key; found has one row a key and, in count, how many rows have it.

    Rows of a frequent key stay where they are and meet a broadcast of fewer than HOT rows; the
    others are shuffled by key, so that no task gets more than one in HOT of all rows for one key.
    """
    hot, *_ = unused(rows.columns + found.columns, "hot")
    frequent = found.where(F.col(count) * F.lit(HOT) > F.lit(total)).drop(count)
    keys = F.broadcast(frequent.select(F.col(key).alias(hot)))
    seldom = rows.join(keys, rows[key] == F.col(hot), "left_anti").join(found.where(F.col(count) * F.lit(HOT) <= F.lit(total)).drop(count), key)
    return rows.join(F.broadcast(frequent), key).unionByName(seldom)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """Text without nulls: a null text is the empty text."""
    return F.coalesce(named(col).cast("string"), F.lit(""))


def id_text_crc_mod(col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)
