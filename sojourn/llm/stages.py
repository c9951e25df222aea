"""Staging that gives the disk of finished shuffles back, and names for carried columns."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame

from sojourn.operators.staging import staged_table


def released(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Shuffle files are kept until the driver's garbage shows that their plan is gone. A job of several large steps would so
    hold them all at once; collecting garbage after each step lets Spark's cleaner delete them.
    """
    table = staged_table(df)
    sweep(df)
    return table


def sweep(df: DataFrame) -> None:
    """Lets Spark's cleaner see which plans are gone."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes the files of released tables that nothing unwritten reads any more."""
    for table in tables:
        if files := table.inputFiles():
            jvm = table.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with underscores in front while ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
