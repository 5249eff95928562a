import io
import json

import pytest
from pyspark.sql import functions as F

from simloom import cli
from simloom.config import Settings
from simloom.errors import NoFilesError, PathNotFoundError
from simloom.operators import features, ranking
from simloom.plans import report
from simloom.plans.scan import scan, similar_within_files
from simloom.sources import files
from simloom.streaming.incremental import match_batch

LOOP = "int {name}(int *values, int count) {{\n  int total = 0;\n  for (int index = 0; index < count; index++) {{\n    total += values[index];\n    note_it(total);\n    step_it(index);\n    more_of(total);\n  }}\n  return total;\n}}\n"


@pytest.fixture()
def tree(tmp_path):
    for path, name in (("a/one.c", "add_all"), ("b/two.c", "sum_all"), ("b/.hidden/three.c", "add_all"), ("vendor/four.c", "add_all")):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(LOOP.format(name=name))
    (tmp_path / "b/bad.c").write_bytes(b"\xff\xfe int")
    (tmp_path / "b/note.txt").write_text("no source")
    return tmp_path


def test_discovery(tree):
    s = Settings(ignore=(f"{tree}/vendor",))
    found = files.discover([str(tree)], s)
    assert [f.removeprefix(str(tree)) for f in found] == ["/a/one.c", "/b/bad.c", "/b/two.c"]
    small = Settings(max_file_size=5)
    assert files.discover([str(tree / "a"), str(tree / "a/one.c")], small) == [str(tree / "a/one.c")]
    assert files.discover([str(tree / "b/.hidden")], s)  # a root is never hidden
    with pytest.raises(PathNotFoundError):
        files.discover([str(tree / "none")], s)


def test_folder_source_agrees(spark, tree):
    s = Settings(ignore=("vendor",))
    assert {r.file for r in files.read_folder(spark, str(tree), s).collect()} == {"a/one.c", "b/two.c"}


def test_scan_and_reports(spark, tree):
    s = Settings(paths=(str(tree / "a"), str(tree / "b")))
    pairs, sources = scan(spark, s)
    rows = pairs.collect()
    assert len(rows) == 1 and rows[0].similarity > 0.99  # the best pair of blocks: equal bodies
    out = io.StringIO()
    assert report.write_report(pairs, sources, s.with_values({"output_format": "json"}), out) == 1
    doc = json.loads(out.getvalue())
    assert doc["total_issues"] == 1 and doc["intra_file"] == []
    assert set(doc["cross_file"][0]["matches"][0]) == {"file_a_line_start", "file_a_line_end", "file_b_line_start", "file_b_line_end"}
    out, inner = io.StringIO(), pairs.withColumn("file_b", F.col("file_a"))
    assert report.write_report(pairs, sources, s.with_values({"output_format": "sarif"}), out, inner) == 2
    sarif = json.loads(out.getvalue())
    assert sarif["version"] == "2.1.0" and [r["ruleId"] for r in sarif["runs"][0]["results"]] == ["code-duplication", "intra-file-duplication"]
    assert all(len(r["locations"]) == 2 for r in sarif["runs"][0]["results"])
    out = io.StringIO()
    assert report.write_report(pairs, sources, s.with_values({"output_format": "json"}), out, inner) == 2
    assert set(json.loads(out.getvalue())["intra_file"][0]["pairs"][0]) == {"region_a", "region_b", "similarity"}
    out = io.StringIO()
    assert report.write_report(pairs, sources, s, out) == 1
    assert "Critical (≥95%) (1):" in out.getvalue() and "1 pair in 2 files" in out.getvalue()
    assert ranking.summary(pairs).first() == (1, 2)
    stored, _ = scan(spark, Settings(paths=(f"file://{tree}",), ignore=("vendor",)))
    assert [(r.file_a, r.file_b) for r in stored.collect()] == [("a/one.c", "b/two.c")]
    for path in (str(tree / "b"), f"file://{tree}/b"):
        with pytest.raises(NoFilesError):
            scan(spark, Settings(paths=(path,), extensions=("zig",)))


def test_within_files(spark):
    blocks = spark.createDataFrame([(1, "f", 1, 5, ["aa", "bb", "cc"]), (2, "f", 7, 9, ["aa", "bb", "cc"]), (3, "f", 2, 4, ["aa", "bb", "cc"])], features.BLOCK)
    assert similar_within_files(blocks, Settings()).count() == 0
    found = similar_within_files(blocks, Settings(intra_file_extension=True)).collect()
    assert {(r.id_a, r.id_b) for r in found} == {(1, 2), (2, 3)}


def test_severity_edges(spark):
    df = spark.createDataFrame([(0.95,), (0.9499,), (0.85,), (0.75,), (0.7499,)], "similarity double")
    assert {r.severity: r.n for r in ranking.severity_counts(df).collect()} == {"critical": 1, "high": 2, "medium": 1, "low": 1}
    assert report.severity_of(0.75) == "medium"


def test_best_of_each_file_pair(spark):
    rows = [(1, 2, "b", "a", 3, 4, 1, 2, 0.9), (3, 4, "a", "b", 5, 6, 7, 8, 0.95), (5, 6, "a", "b", 1, 2, 7, 8, 0.95)]
    df = spark.createDataFrame(rows, "id_a long, id_b long, file_a string, file_b string, start_line_a int, end_line_a int, start_line_b int, end_line_b int, similarity double")
    best = ranking.best_per_file_pair(df).collect()
    assert [(r.id_a, r.id_b, r.similarity) for r in best] == [(5, 6, 0.95)]


def test_stream(spark, tmp_path):
    step = match_batch(str(tmp_path / "c"), str(tmp_path / "p"), Settings())
    block = lambda i: (i, f"f{i}", 1, 1, "alpha beta gamma delta".split())
    step(spark.createDataFrame([block(1)], features.BLOCK), 0)
    step(spark.createDataFrame([block(2), block(3)], features.BLOCK), 1)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_command_line(spark, tree, capsys, monkeypatch):
    monkeypatch.chdir(tree)
    assert cli.main(["-t", "170"]) == 1
    assert cli.main([str(tree / "none")]) == 1
    assert "error" in capsys.readouterr().err
    assert cli.main(["--generate-config"]) == 0 and (tree / "simloom.toml").exists()
