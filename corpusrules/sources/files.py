"""File inventories, contents and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusrules.functions.text import base_name, blank_to_null

METADATA = ("file_name", "file_path", "size", "encoding", "content_sha256", "ref", "blob_id", "commit_id", "last_commit_id")


def land_files(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a ``files`` relation once as Parquet, so later scans open few large files instead of many small ones."""
    files.write.mode(mode).parquet(path)


def inventory(
    files: DataFrame, project_id: object = None, path: str = "", recursive: bool = True, ref: str = ""
) -> DataFrame:
    """S3: names and paths of the files (not folders) of a project, a folder or a ref, never their content."""
    if "type" in files.columns:
        files = files.where(F.col("type") == "blob")
    if project_id is not None:
        files = files.where(F.col("project_id") == F.lit(project_id))
    if ref:
        files = files.where(F.col("ref") == ref)
    folder = path.strip("/")
    prefix = folder + "/" if folder else ""
    if prefix:
        files = files.where(F.col("file_path").startswith(prefix))
    if not recursive:
        files = files.where(~F.substr("file_path", F.lit(len(prefix) + 1)).contains("/"))
    name = F.col("file_name") if "file_name" in files.columns else base_name(F.col("file_path"))
    keys = ["project_id"] if "project_id" in files.columns else []
    return files.select(*keys, name.alias("file_name"), "file_path")


def fetch_content(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Content of the wanted ``(project_id, file_path[, ref])``; what does not exist gives no row.

    Files no one asks for drop out by path alone, before contents can meet the wanted keys in a shuffle; where Spark can
    broadcast the keys, nothing is shuffled at all.
    """
    keys = [c for c in ("project_id", "file_path", "ref") if c in wanted.columns and c in files.columns]
    asked = wanted.select(*keys).distinct()
    present = files.select(*keys).join(asked, keys, "left_semi").distinct()
    return files.join(present, keys, "left_semi")


def _metadata(files: DataFrame) -> dict[str, Column]:
    have = set(files.columns)

    def optional(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    commit = blank_to_null(optional("commit_id"))
    columns = {
        "file_name": F.col("file_name") if "file_name" in have else base_name(F.col("file_path")),
        "file_path": F.col("file_path"),
        "size": F.col("size") if "size" in have else F.octet_length("content").cast("bigint"),
        "encoding": optional("encoding"),
        "content_sha256": optional("content_sha256"),
        "ref": optional("ref"),
        "blob_id": optional("blob_id"),
        "commit_id": commit,
        "last_commit_id": F.coalesce(blank_to_null(optional("last_commit_id")), commit),
    }
    return {**({"project_id": F.col("project_id")} if "project_id" in have else {}), **columns}


def decoded_content(files: DataFrame) -> Column:
    """Content bytes; base64 content is decoded."""
    raw = F.col("content").cast("binary")
    if "encoding" not in files.columns:
        return raw
    return F.when(F.col("encoding") == "base64", F.unbase64(F.col("content").cast("string"))).otherwise(raw)


def file_contents(files: DataFrame) -> DataFrame:
    """Metadata and decoded content, with the SHA-256 worked out where the source gave none."""
    content = decoded_content(files)
    columns = _metadata(files)
    columns["content_sha256"] = F.coalesce(blank_to_null(columns["content_sha256"]), F.sha2(content, 256))
    return files.select(*[c.alias(n) for n, c in columns.items()], content.alias("content"))


def file_metadata(files: DataFrame) -> DataFrame:
    """Metadata only; the content column is not read where the table already has sizes."""
    return files.select(*[c.alias(n) for n, c in _metadata(files).items()])
