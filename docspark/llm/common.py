"""What the corpus operators share: work folders, word rules, size-checked joins."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: A key that holds more than 1/HOT_SHARE of all rows is hot; so at most HOT_SHARE keys are.
HOT_SHARE = 1024

#: A table of classes may be broadcast up to so many rows.
BROADCAST_ROWS = 50_000


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``. Where that is unset, a local session gets a
    temporary folder and a cluster a folder below the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] == "local":
            root = tempfile.mkdtemp(prefix="docspark-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_docspark"
        spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(root)
    return qualified(spark, root)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark takes it from, so that tasks take it from the same."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(target).toString().rstrip("/")


def session_dir(spark: SparkSession) -> str:
    return f"{work_root(spark)}/docspark-{spark.sparkContext.applicationId}"


def work_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Removes what operators have left in the shared folder, for when no result of theirs is read any more."""
    drop_dir(spark, session_dir(spark))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends
    here, and a lost executor costs a reread instead of a recomputation."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a work folder through the file system that Spark uses for it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def unsettle(*tables: DataFrame) -> None:
    """Remove settled tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_dir(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is settled by now: it does when the driver collects its garbage.

    Twice, because what Python gives up is known to the JVM a moment later.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often body names it.

    A lambda variable is bound to an evaluated value, which neither the optimiser
    nor a loop inside ``body`` expands again.
    """
    return F.transform(F.array(value), body)[0]


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP, -1), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def text_key(text: Column) -> Column:
    """32 hex digits that stand for a text."""
    return F.md5(text.cast("binary"))


def attach_class(rows: DataFrame, classes: DataFrame, key: str, count: str, spread: Column, most: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of ``rows`` to the settled ``classes``, which have a row a ``key``; ``count``: the rows it has.

    Classes are broadcast if they are at most ``most``. Else those with over
    1/HOT_SHARE of all counted rows are: at most HOT_SHARE of them. Their rows then
    go through the join of the others under keys that ``spread`` deals out.
    """
    if classes.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(classes.drop(count)), key, "left")
    total = classes.agg(F.sum(count)).first()[0]
    hot = F.broadcast(classes.where(F.col(count) * HOT_SHARE > F.lit(total)).drop(count))
    cold = classes.where(F.col(count) * HOT_SHARE <= F.lit(total)).drop(count)
    others = [c for c in hot.columns if c != key]
    first = rows.join(hot.select(key, F.struct(*others).alias("__hot")), key, "left")
    dealt = F.when(F.col("__hot").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("#"), spread.cast("string")))
    out = first.withColumn("__dealt", dealt).join(cold.select(F.col(key).cast("string").alias("__dealt"), F.struct(*others).alias("__cold")), "__dealt", "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"__hot.{c}"), F.col(f"__cold.{c}")).alias(c) for c in others])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(df: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator needs, and whole rows as one column: no column that it makes can meet one of theirs."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("__row"), *[F.col(quoted(c)) for c in needed])


def restored(rows: DataFrame, df: DataFrame, **changed: Column) -> DataFrame:
    """Rows that were ``carried``, with the columns of ``df``; ``changed``: new values of some."""
    return rows.select(*[(changed[c] if c in changed else F.col(f"__row.{quoted(c)}")).alias(c) for c in df.columns])


def pieces(batches, rows: int = 400):
    """Arrow batches cut small, so that a task holds few texts as Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
