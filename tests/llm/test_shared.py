"""The shared folder."""

import os

import pytest

import corpus_pipeline
from quernspark.llm import shared


def test_sweep_takes_what_was_written(spark, monkeypatch):
    monkeypatch.setattr(shared, "_written", [])
    kept = shared.stash(spark.range(3), "kept")
    assert kept.count() == 3 and shared.sweep(spark) == 1 and shared.sweep(spark) == 0
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(kept.inputFiles()[0]).count()


def test_written_pipeline_leaves_no_tables(spark, tmp_path, monkeypatch):
    made, folder = [], shared.shared_dir

    def noted(*args):
        made.append(folder(*args))
        return made[-1]

    monkeypatch.setattr(shared, "_written", [])
    monkeypatch.setattr(shared, "shared_dir", noted)
    corpus_pipeline.write(spark, "/root/testdata/sf0.001", str(tmp_path / "out"))
    assert sum("/pipeline-" in p for p in made) == len(corpus_pipeline.STAGES) - 1
    assert not [p for p in made if os.path.exists(p.removeprefix("file://"))]
    pieces = spark.read.parquet(str(tmp_path / "out"))
    assert pieces.count() == pieces.select("sequence_id", "offset").distinct().count() > 0
