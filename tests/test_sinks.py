"""Small files, reports and guards."""

import json

import pytest
from pyspark.sql import functions as F

from logloom.functions import text
from logloom.sources import io


def test_json_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "m" / "metrics.json")
    io.write_json(spark, path, {"a": 1, "é": "错"})
    io.write_json(spark, path, {"a": 2})
    assert json.loads(io.read_text(spark, path)) == {"a": 2}
    assert [p.name for p in (tmp_path / "m").iterdir() if not p.name.startswith(".")] == ["metrics.json"]


def test_a_run_is_frozen_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    first = io.freeze_config(spark, path, "r", {"a": 1, "b": "错"})
    assert io.freeze_config(spark, path, "r", {"b": "错", "a": 1}) == first and io.freeze_config(spark, path, "other", {"a": 2}) != first
    with pytest.raises(ValueError):
        io.freeze_config(spark, path, "r", {"a": 2})
    name = next(p for p in (tmp_path / "runs").iterdir() if p.suffix == ".json")
    assert not io._create(spark, str(name), "{}") and json.loads(name.read_text())["digest"]


def test_rows_go_through_gzip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    io.write_json_rows(rows, str(tmp_path / "p"))
    assert list((tmp_path / "p").glob("*.json.gz"))
    assert sorted(io.read_predictions(spark, str(tmp_path / "p"), "k string, v int").select("k", "v").collect()) == sorted(rows.collect())


def test_lines_that_say_nothing_do_not_count(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a":1}\n\n   \n{"a":2}\n')
    (tmp_path / "e.jsonl").write_text("")
    assert io.count_lines(spark, str(tmp_path / "r.jsonl")) == 2 and io.count_lines(spark, str(tmp_path / "e.jsonl")) == 0
    assert io.read_jsonl(spark, str(tmp_path / "r.jsonl"), "a int").count() == 2


def test_archives_name_their_case(spark, tmp_path):
    for case, tag in (("c1", "000"), ("c1", "001"), ("c2", "000")):
        (tmp_path / case).mkdir(exist_ok=True)
        (tmp_path / case / f"{tag}.json").write_text(json.dumps({"tag": tag}))
    got = io.read_calls(spark, str(tmp_path), "tag string").collect()
    assert sorted((r.case_id, r.tag) for r in got) == [("c1", "000"), ("c1", "001"), ("c2", "000")]


def test_appended_rows_add_up(spark, tmp_path):
    for _ in range(2):
        io.append_jsonl(spark.range(3), str(tmp_path / "a"))
    assert io.read_jsonl(spark, str(tmp_path / "a"), "id long").count() == 6


def test_sections_are_spliced():
    once = io.splice_section("# R\n## Refs\nend", "## D", "## Refs", "## D\nold")
    assert once == "# R\n## D\nold\n## Refs\nend"
    assert io.splice_section(once, "## D", "## Refs", "## D\nnew") == "# R\n## D\nnew\n## Refs\nend"
    assert io.splice_section("# R\n", "## D", "## Refs", "## D") == "# R\n## D\n"


def test_labels_are_refused_at_any_depth(spark):
    clean = spark.createDataFrame([], "q string, history array<struct<step:int,content:string>>")
    assert io.check_no_labels(clean) is clean
    for schema in ("mistake_step int", "q struct<a:array<struct<mistake_agent:string>>>", "m map<string,struct<ground_truth:string>>"):
        with pytest.raises(ValueError):
            io.check_no_labels(spark.createDataFrame([], schema))


def test_steps_are_clipped(spark):
    cases = spark.createDataFrame([("q", "s", [(0, "A", "", "x" * 500), (1, "A", "", None)])], "question_ID string, source string, history " + io.STEP)
    got = {r.step: r.content for r in io.explode_steps(cases, 200).collect()}
    assert len(got[0].encode()) <= 200 and got[0].startswith("x") and got[0].endswith("x") and got[1] == ""


def test_formatting(spark):
    r = spark.range(1).select(text.percent(F.lit(0.12345)), text.percent(F.lit(None).cast("double")), text.thousands(F.lit(1234567)), text.redact(F.lit("a sk-abcdefghijklmnopqrst b")), text.iso_utc(F.lit(0))).first()
    assert tuple(r) == ("12.3%", "—", "1,234,567", "a [REDACTED] b", "1970-01-01T00:00:00Z")
