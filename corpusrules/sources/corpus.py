"""The benchmark tables seen as projects and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Set it to deal out tables that a reader would hand to few tasks; unset, tables are read as they are split.
PARTITIONS_CONF = "spark.corpusrules.inputPartitions"

# A manifest corpus derived from ``part`` by SQL both Spark and DuckDB run.  Four parts make a project with a file of a
# different kind each; every third part instead goes to one large shared project, a file per package folder.
MANIFEST_SQL = """
SELECT
  CASE WHEN p_partkey % 3 = 0 THEN CAST(0 AS BIGINT)
       ELSE CAST(1 + (p_partkey - p_partkey % 4) / 4 AS BIGINT) END AS project_id,
  CASE WHEN p_partkey % 3 = 0 THEN concat('pkg-', CAST(p_partkey AS string), '/', file_name)
       ELSE file_name END AS file_path,
  file_name,
  content
FROM (
  SELECT p_partkey,
    CASE p_partkey % 10
      WHEN 0 THEN '.python-version'
      WHEN 1 THEN 'runtime.txt'
      WHEN 2 THEN 'setup.py'
      WHEN 3 THEN 'Pipfile'
      WHEN 4 THEN 'pyproject.toml'
      WHEN 5 THEN concat('Dockerfile', CASE WHEN p_size % 2 = 0 THEN '' ELSE '.dev' END)
      WHEN 6 THEN '.gitlab-ci.yml'
      WHEN 7 THEN 'tox.ini'
      WHEN 8 THEN concat('requirements', CASE WHEN p_size % 2 = 0 THEN '' ELSE '-dev' END, '.txt')
      ELSE 'README.md'
    END AS file_name,
    CASE p_partkey % 10
      WHEN 0 THEN CASE p_size % 5
        WHEN 0 THEN concat(minor, nl)
        WHEN 1 THEN concat('  ', minor, '.', patch, '  ', nl)
        WHEN 2 THEN concat('python-', minor)
        WHEN 3 THEN concat('py', minor, nl)
        ELSE concat('system ', p_name, nl) END
      WHEN 1 THEN CASE p_size % 4
        WHEN 0 THEN concat('python-', minor, '.', patch, nl)
        WHEN 1 THEN concat('  python-', minor, nl)
        WHEN 2 THEN concat('ruby-', minor)
        ELSE concat('python', minor, repeat(' ', 20 * p_size)) END
      WHEN 2 THEN CASE WHEN p_size % 5 = 0 THEN concat('setup(name=', q, p_name, q, ')')
        ELSE concat('from setuptools import setup', nl, 'setup(', nl, '  name=', q, p_name, q, ',', nl,
                    '  python_requires = ', q, '>=', minor, ',<4.0', q, nl, ')') END
      WHEN 3 THEN concat('[packages]', nl, 'requests = "*"', nl, nl, '[requires]', nl,
        CASE p_size % 3
          WHEN 0 THEN concat('python_version = "', minor, '"', nl, 'python_full_version = "', minor, '.', patch, '"')
          WHEN 1 THEN concat('python_version = "', minor, '"')
          ELSE 'python_version = "*"' END, nl)
      WHEN 4 THEN CASE p_size % 4
        WHEN 0 THEN concat('[project]', nl, 'name = "', p_name, '"', nl, 'requires-python = ">=', minor, '"', nl,
                           'dependencies = [', nl, '  "requests[socks]>=2",', nl, '  # pinned, don', q, 't touch', nl,
                           '  "', replace(p_name, ' ', '-'), '==', patch, '",', nl, ']', nl)
        WHEN 1 THEN concat('[tool.poetry]', nl, 'name = "', p_name, '"', nl, nl, '[tool.poetry.dependencies]', nl,
                           'python = "^', minor, '"', nl, 'requests = "^2.28"', nl, nl, '[build-system]', nl)
        WHEN 2 THEN concat('[tool.poetry.dependencies]', nl, 'flask = "*"', nl, 'python = {version = "~', minor, '.', patch, '"}', nl)
        ELSE concat('[tool.mypy]', nl, 'python_version = "', minor, '"', nl) END
      WHEN 5 THEN concat('# ', p_name, nl, CASE p_size % 3
        WHEN 0 THEN concat('FROM python:', minor, '-slim', nl)
        WHEN 1 THEN concat('FROM ubuntu:latest', nl, '  FROM  python:', minor, '.', patch, '-alpine AS build', nl)
        ELSE concat('FROM ubuntu:22.04', nl, 'RUN apt-get install python:', minor, nl) END, 'RUN echo ', p_brand)
      WHEN 6 THEN concat('stages: [test]', nl, CASE p_size % 3
        WHEN 0 THEN concat('image: python:', minor, '-slim', nl)
        WHEN 1 THEN concat('test:', nl, '  image:   python:', minor, '.', patch, nl, 'image: python:2.7', nl)
        ELSE concat('image: "python:', minor, '"', nl) END, 'script: echo ', p_name)
      WHEN 7 THEN CASE p_size % 4
        WHEN 0 THEN concat('[tox]', nl, 'envlist = py', digits, ',py39', nl)
        WHEN 1 THEN concat('[tox]', nl, 'envlist = "lint,py', digits, '"', nl)
        WHEN 2 THEN concat('[tox]', nl, 'envlist =', nl, '    py', digits, nl, '    py27', nl)
        ELSE concat('[tox]', nl, 'skipsdist = True', nl, 'envlist = docs', nl) END
      WHEN 8 THEN concat(CASE p_size % 5
        WHEN 0 THEN concat('# Python ', minor, nl)
        WHEN 1 THEN concat('#  Requires Python >= ', minor, '.', patch, nl)
        WHEN 2 THEN concat('flask  # py >= ', minor, nl)
        WHEN 3 THEN concat('-r base.txt', nl, '--index-url https://example.com/simple', nl)
        ELSE '' END,
        replace(p_name, ' ', '-'), '[extra, ', lower(p_type), ']>=', patch, '.0,<9; python_version>', q, '3', q, nl,
        'zope.interface==', patch, nl, nl,
        '-e git+https://example.com/', replace(p_name, ' ', '/'), '.git@main#egg=', replace(p_name, ' ', '_'), nl,
        'locked==1.', patch, ' --hash=sha256:ab', patch, ' --hash=sha256:cd  # ', p_brand, nl,
        CASE WHEN p_size % 3 = 0 THEN concat('a', nl, 'b', nl, 'c>1', nl) ELSE '' END)
      ELSE concat(p_name, nl, p_brand, nl)
    END AS content
  FROM (
    SELECT p_partkey, p_name, p_brand, p_type, p_size, chr(10) AS nl, chr(39) AS q,
      concat('3.', CAST(8 + p_size % 6 AS string)) AS minor,
      concat('3', CAST(8 + p_size % 6 AS string)) AS digits,
      CAST(p_size % 10 AS string) AS patch
    FROM part
  ) AS p
) AS m
"""

# Projects of the manifest corpus, in the shape of a project listing.
MANIFEST_PROJECTS_SQL = """
SELECT id,
  concat('project-', CAST(id AS string)) AS name,
  concat('project-', CAST(id AS string)) AS path,
  concat('group', CAST(id % 5 AS string), CASE WHEN id % 3 = 0 THEN '/sub' ELSE '' END, '/project-', CAST(id AS string))
    AS path_with_namespace,
  id % 7 = 3 AS archived
FROM (
  SELECT CAST(1 + (p_partkey - p_partkey % 4) / 4 AS BIGINT) AS id FROM part GROUP BY 1
  UNION ALL
  SELECT CAST(0 AS BIGINT) AS id FROM part WHERE p_partkey % 3 = 0 GROUP BY 1
) AS ids
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` over as many partitions as the caller's session asks for, if it does."""
    wanted = df.sparkSession.conf.get(PARTITIONS_CONF, None)
    return df.repartition(int(wanted), *keys) if wanted else df


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source is the project, the language a folder."""
    return as_document_files(_dealt(table(spark, sf_dir, "documents"), "doc_id"))


def as_document_files(documents: DataFrame) -> DataFrame:
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.select(
        F.col("source").alias("project_id"),
        F.concat("lang", F.lit("/"), name).alias("file_path"),
        name.alias("file_name"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.col("text").alias("content"),
    )


def document_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("files"))
    return sources.select(
        "id",
        F.col("id").alias("name"),
        F.concat(F.lit("corpus/"), "id").alias("path_with_namespace"),
        (F.substr("id", F.lit(4)).cast("int") % 4 == 1).alias("archived"),
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("project_id"), F.lit("index.html").alias("file_path"), F.col("html").alias("content")
    )


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(table(spark, sf_dir, "conversations"), "conv_id", "turn").select(
        F.col("conv_id").alias("project_id"),
        F.concat("role", F.lit("/"), F.col("turn").cast("string")).alias("file_path"),
        F.col("text").alias("content"),
    )


def _sql(spark: SparkSession, part: DataFrame, sql: str) -> DataFrame:
    text = sql.replace("{", "{{").replace("}", "}}").replace("FROM part", "FROM {part} AS part")
    return spark.sql(text, part=part)


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, _dealt(table(spark, sf_dir, "part"), "p_partkey"), MANIFEST_SQL)


def manifest_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, table(spark, sf_dir, "part"), MANIFEST_PROJECTS_SQL)


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as very small files: the user is the project, the properties the content."""
    name = F.concat(F.lit("event-"), F.col("event_id").cast("string"), F.lit(".py"))
    return _dealt(table(spark, sf_dir, "events"), "event_id").select(
        F.col("user_id").alias("project_id"),
        name.alias("file_path"),
        name.alias("file_name"),
        F.octet_length("props").cast("bigint").alias("size"),
        F.col("props").alias("content"),
    )


def event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scan results, for statistics at scale."""
    return as_event_results(table(spark, sf_dir, "events"))


def as_event_results(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("project_name"),
        F.when(kind != "view", F.get_json_object("props", "$.k")).alias("python_version"),
        F.lit("props").alias("detection_source"),
        F.when(kind == "error", F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("error"),
    )
