"""Raw repository trees, ``root/<project folder>/...``, as a ``files`` relation.

Spark's own file sources leave out every name that starts with a dot or an underscore, and version files do.  Trees are
therefore listed through Arrow file systems inside Spark tasks, one level of folders after the other: each level's folders
are dealt out over tasks, whichever project they are in.  Land a tree once (``land_files``), then scan or stream the landed
table, which has every file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrules.functions.text import base_name
from corpusrules.session import scratch_path

_ENTRIES = "path string, is_folder boolean, size bigint, modified_at timestamp"
_ROWS_PER_BATCH = 10_000
_BYTES_PER_BATCH = 32 * 1024 * 1024


def _level(spark: SparkSession, folders: DataFrame, root: str) -> DataFrame:
    """Entries of the given folders, written so that they are listed once."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch["path"]:
                infos = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
                for start in range(0, len(infos), _ROWS_PER_BATCH):
                    part = infos[start : start + _ROWS_PER_BATCH]
                    yield pd.DataFrame(
                        {
                            "path": [i.path for i in part],
                            "is_folder": [i.type == fs.FileType.Directory for i in part],
                            "size": pd.Series([i.size for i in part], dtype="Int64"),
                            "modified_at": pd.to_datetime([i.mtime for i in part], utc=True).tz_localize(None),
                        }
                    )

    path = scratch_path(spark, "listing")
    folders.repartition("path").mapInPandas(entries, _ENTRIES).write.parquet(path)
    return spark.read.schema(_ENTRIES).parquet(path)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """S3 over a raw tree: every file of every project, hidden ones too, without content.

    ``project`` is the name of the project's folder, ``project_id`` the same as a number where it is one.
    """
    from pyarrow import fs

    _, base = fs.FileSystem.from_uri(root)
    base = base.rstrip("/")
    folders = spark.createDataFrame([(base,)], "path string")
    levels = []
    while True:
        entries = _level(spark, folders, root)
        levels.append(entries.where("not is_folder"))
        folders = entries.where("is_folder").select("path")
        if folders.isEmpty():
            break
    below = F.substr("path", F.lit(len(base) + 2))
    project = F.substring_index(below, "/", 1)
    path = F.substr(below, F.length(project) + 2)
    # Files that lie beside the project folders belong to no project.
    files = reduce(DataFrame.union, levels).where(below.contains("/"))
    return files.select(
        project.alias("project"),
        project.try_cast("bigint").alias("project_id"),
        path.alias("file_path"),
        base_name(path).alias("file_name"),
        "size",
        "modified_at",
        F.col("path").alias("location"),
    )


def read_listed(listing: DataFrame, root: str) -> DataFrame:
    """S4 over a raw tree: content of the listed files; files gone since then give no row.

    Filter the listing first.  Files are dealt out evenly over the tasks, whichever project they are from.
    """
    kept = [f for f in listing.schema.fields if f.name != "location"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", content binary"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            contents: list[bytes | None] = []
            start = held = 0
            for i, location in enumerate(batch["location"]):
                try:
                    with system.open_input_stream(location) as stream:
                        contents.append(stream.read())
                except FileNotFoundError:
                    contents.append(None)
                held += len(contents[-1] or b"")
                if held >= _BYTES_PER_BATCH or i == len(batch) - 1:
                    rows = batch.iloc[start : i + 1].drop(columns="location").assign(content=contents)
                    yield rows[rows["content"].notna()]
                    contents, start, held = [], i + 1, 0

    return listing.repartition("location").mapInPandas(read, schema)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files of a raw tree with their content.  Land them once when they are scanned often."""
    return read_listed(list_tree(spark, root), root)
