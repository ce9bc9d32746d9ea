import json

import numpy as np
import pytest

from recitant import api
from recitant.operators import repair
from recitant.sources import audio, epub


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\nA\n\n# Two\nB", encoding="utf-8")
    (tmp_path / "b.epub").write_bytes(epub.archive("Book", [("P", "x")]))
    (tmp_path / "c.txt").write_text("no")
    found = api.expand_inputs(spark, [str(tmp_path / "b.epub"), str(tmp_path)]).orderBy("item", "ord").collect()
    assert [r.path.rpartition("/")[2] for r in found] == ["b.epub", "a.md"]
    paths = [str(tmp_path / "a.md"), str(tmp_path / "b.epub")]
    assert api.load_sources(spark, paths).count() == 3
    assert [r.title for r in api.load_sources(spark, paths[:1], api.Options(chapter_index=2)).collect()] == ["Two"]
    with pytest.raises(ValueError):
        api.load_sources(spark, [str(tmp_path / "c.txt")])
    with pytest.raises(Exception, match="no chapter 3"):
        api.load_sources(spark, paths[:1], api.Options(chapter_index=3)).collect()
    with pytest.raises(ValueError):
        api.Options(heading_level=5)
    assert [r.title for r in api.load_chapters(spark, paths[0], single_chapter=True).collect()] == ["a"]
    assert api.source_metadata(b"no zip", "stem")["source_title"] == "stem"
    assert api.supported_suffixes() == [".epub", ".markdown", ".md"] and api.Options().chunk_chars == 450


def test_caches_and_manifests(spark, tmp_path):
    (tmp_path / "cache.json").write_text(json.dumps([{"title": "A", "text": "hello", "group": "g"}, {"text": "x"}, {}]))
    rows = sorted(map(tuple, api.read_chapter_cache(spark, str(tmp_path / "cache.json")).collect()), key=str)
    assert rows == [("A", "hello", "g"), ("Untitled", "", None), ("Untitled", "x", None)]
    api.write_chapter_cache(spark.createDataFrame([("s", 1, "T", "é", None)], "source_path string, chapter_index int, title string, text string, group_path string"), str(tmp_path / "out"))
    assert "é" in next((tmp_path / "out" / "source_path=s").glob("*.json")).read_text(encoding="utf-8")
    (tmp_path / "m.json").write_text('{"source": "s", "parts": [{"part": 1, "mp3_path": "a.mp3"}]}\n{broken\n')
    assert [r.source for r in api.read_manifests(spark, str(tmp_path / "m.json")).collect()] == ["s"]
    chunks = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "chapter_index int, chunk_index int")
    assert [tuple(r) for r in api.remaining(chunks, 1, 2).collect()] == [(1, 2), (2, 3)]


def test_audio(spark, tmp_path):
    parts = spark.createDataFrame([("01-a", [0.0, 0.5, -1.0, 2.0], 4)], "name string, samples array<float>, sample_rate int")
    made = audio.write(parts, str(tmp_path)).collect()
    assert made[0].bytes == 44 + 8
    row = audio.read(spark, [str(tmp_path)]).first()
    assert (row.sample_rate, row.channels, row.frames, row.duration_seconds) == (4, 1, 4, 1.0)
    assert np.allclose(row.samples, [0, 0.5, -1, 1], atol=1e-4)
    with pytest.raises(Exception, match="01-a"):
        audio.write(parts, str(tmp_path)).collect()
    assert audio.write(parts, str(tmp_path), force=True).count() == 1
    (tmp_path / "sub").mkdir()
    for name in ("B.mp3", "a.mp3", "sub/c.mp3"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.name for r in audio.listing(spark, str(tmp_path)).collect()] == ["a.mp3", "B.mp3"]
    assert [r.name for r in audio.listing(spark, str(tmp_path), deep=True).collect()] == ["sub/c.mp3"]


def test_repair(spark):
    schema = "book string, name string, title string, place int"
    roots = spark.createDataFrame([("b", "r1", "01 - The End", 1), ("b", "r2", "The End", 2), ("b", "r3", "Gate", 3), ("b", "r4", "???", 4), ("c", "r5", "Gate", 1)], schema)
    targets = spark.createDataFrame([("b", "t1", "The Old Gate", 1), ("b", "t2", "The End", 2), ("b", "t3", "The End Again", 3)], schema)
    assert sorted(map(tuple, repair.assigned(roots, targets, "book").collect())) == [("b", "r1", "t2"), ("b", "r2", "t3"), ("b", "r3", "t1")]


def test_readers_and_environment(spark, tmp_path, monkeypatch):
    (tmp_path / "n.note").write_text("one line")
    read = lambda s, paths, options: s.read.text(paths, wholetext=True).selectExpr("_metadata.file_path AS source_path", "1 AS chapter_index", "'Note' AS title", "value AS text", "CAST(NULL AS string) AS group_path")
    monkeypatch.setattr(api, "READERS", dict(api.READERS))
    api.register_reader([".note"], read)
    assert [r.text for r in api.load_sources(spark, [str(tmp_path / "n.note")]).collect()] == ["one line"] and ".note" in api.supported_suffixes()
    checks = {r["check"]: r.good for r in api.environment(spark).collect()}
    assert checks["spark"] and checks["shared folder"]
    assert api.warm_up(lambda t: (np.zeros(len(t)), 10)) > 0 and api.warm_up(lambda t: (np.zeros(1), 1), api.Options(warmup_text=" ")) == 0
    monkeypatch.setenv("RECITANT_DEBUG", "Yes")
    assert api.Options().debugging
