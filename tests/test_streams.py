"""Streams that keep tables up to date: whole batches for readers, winners and caps per project."""

import pytest

from corpusrules.operators.projects import project_versions
from corpusrules.operators.search import search_content
from corpusrules.rulepack import Search, builtin_pack
from corpusrules.streaming import projects as SJ
from corpusrules.streaming import publish as SP
from corpusrules.streaming.scan import stream_table


class Landing:
    """Files that land in turn, and a stream over them that is started anew each time."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.schema = spark, schema
        self.landed, self.out, self.state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def land(self, rows):
        rows.write.mode("append").parquet(self.landed)

    def files(self):
        return stream_table(self.spark, self.schema, self.landed)


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


WON = ("project_id", "file_path", "rule_name", "version", "error", "files_found", "files_failed")


def test_winners_change_when_a_better_file_comes(spark, tmp_path, make_files):
    pack = builtin_pack()
    first = make_files((1, "Dockerfile", "FROM python:3.8"), (2, "tox.ini", "[tox]\nenvlist = py39"), (3, "readme.md", "x"))
    second = make_files((1, ".python-version", "3.12"), (1, "requirements.txt", "# Python 3.7\nflask"))
    third = make_files((2, "setup.py", "python_requires = '>=3.10'"), (4, "a/runtime.txt", "python-3.6"))
    landing = Landing(spark, tmp_path, first.schema)
    schema = SJ.winners_schema(first)

    def run(rows):
        landing.land(rows)
        SP.publish(SJ.stream_winners(landing.files(), pack), landing.out, landing.state).awaitTermination()
        return _rows(SP.read_latest(spark, landing.out, schema, ["project_id"]), "project_id", "file_path", "version", "files_found")

    assert run(first) == [(1, "Dockerfile", "3.8", 1), (2, "tox.ini", "3.9", 1)]
    assert run(second) == [(1, ".python-version", "3.12", 3), (2, "tox.ini", "3.9", 1)]
    SP.compact(spark, landing.out, schema, ["project_id"])
    SP.compact(spark, landing.out, schema, ["project_id"])
    # Files below the top level are none of the project's.
    assert run(third) == [(1, ".python-version", "3.12", 3), (2, "setup.py", "3.10", 2)]
    projects = spark.createDataFrame([(k, f"p{k}") for k in range(1, 5)], "id long, name string")
    winners = SP.read_latest(spark, landing.out, schema, ["project_id"])
    columns = ("id", "file_path", "rule_name", "priority", "python_version", "detection_source", "confidence", "error")
    batch = project_versions(projects, first.union(second).union(third), pack)
    assert _rows(SJ.with_projects(projects, winners), *columns) == _rows(batch, *columns)
    kinds = [(b, base) for b, base in SP.commits(spark, landing.out)]
    assert kinds == [(0, False), (1, False), (1, True), (2, False)]


def test_readers_see_whole_batches_only(spark, tmp_path, make_files):
    """A query that fails between its rows and their commit: readers keep the table they had, and a new start makes it good."""
    rows = make_files((1, ".python-version", "3.9"))
    landing = Landing(spark, tmp_path, rows.schema)
    schema = SJ.winners_schema(rows)

    def read():
        return _rows(SP.read_latest(spark, landing.out, schema, ["project_id"]), "project_id", "version")

    def run():
        return SP.publish(SJ.stream_winners(landing.files(), builtin_pack()), landing.out, landing.state)

    assert read() == []
    landing.land(rows)
    run().awaitTermination()
    assert read() == [(1, "3.9")]
    landing.land(make_files((1, ".python-version", "3.1"), (2, "runtime.txt", "python-3.2")))

    def broken(batch, number):
        batch.write.mode("overwrite").parquet(SP._rows(landing.out, number, False))
        raise RuntimeError("lost between rows and commit")

    writer = SJ.stream_winners(landing.files(), builtin_pack()).writeStream.outputMode("update").foreachBatch(broken)
    with pytest.raises(Exception, match="lost between rows and commit"):
        writer.option("checkpointLocation", landing.state).trigger(availableNow=True).start().awaitTermination()
    assert read() == [(1, "3.9")]
    run().awaitTermination()
    assert read() == [(1, "3.1"), (2, "3.2")]


def test_a_committed_batch_is_not_written_again(spark, tmp_path):
    out = str(tmp_path / "out")
    SP.write_batch(spark.range(3), out, 0)
    SP.write_batch(spark.range(5), out, 0)
    assert SP.read_published(spark, out, "id long").count() == 3
    SP.write_batch(spark.range(0), out, 1)
    assert SP.read_published(spark, out, "id long").count() == 0
    assert SP.read_published(spark, str(tmp_path / "none"), "id long").collect() == []


def test_errors_stand_for_projects_without_a_detection(spark, tmp_path, make_files):
    from corpusrules.rulepack import Rule, RulePack

    rows = make_files((1, ".python-version", "3.10.1"), (2, ".python-version", "3.9"))
    landing = Landing(spark, tmp_path, rows.schema)
    landing.land(rows)
    pack = RulePack((Rule("whole-file", ".python-version", "simple_version", max_file_size=4),))
    SP.publish(SJ.stream_winners(landing.files(), pack), landing.out, landing.state).awaitTermination()
    got = _rows(SP.read_latest(spark, landing.out, SJ.winners_schema(rows), ["project_id"]), *WON)
    error = "rule whole-file: file size 6 exceeds maximum 4 bytes"
    assert got == [(1, None, None, None, error, 0, 1), (2, ".python-version", "whole-file", "3.9", None, 1, 0)]


def test_caps_over_several_landings(spark, tmp_path, make_files):
    lines = "hit\nno\nhit two\nhit\nhit"
    parts = [
        make_files((1, "m.txt", lines), (2, "z.txt", "hit")),
        make_files((1, "b.txt", "x\nhit"), (3, "none.txt", "nothing")),
        make_files((1, "z.txt", lines), (2, "a.txt", lines), (None, "n.txt", "hit")),
    ]
    landing = Landing(spark, tmp_path, parts[0].schema)
    search, schema = Search("HIT", max_matches=3), SJ.top_matches_schema(parts[0])
    columns = ("project_id", "file_path", "line_number", "line_content", "matched_text")
    seen = None
    for part in parts:
        landing.land(part)
        SP.publish(SJ.stream_top_matches(landing.files(), search), landing.out, landing.state).awaitTermination()
        seen = part if seen is None else seen.union(part)
        got = SP.read_latest(spark, landing.out, schema, ["project_id"])
        assert _rows(got, *columns) == _rows(search_content(seen, search), *columns)
    assert [r["position"] for r in got.where("project_id = 1").orderBy("position").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        SJ.stream_top_matches(landing.files(), Search("x"))
