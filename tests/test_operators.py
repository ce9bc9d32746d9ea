import random
import weakref

import numpy as np
import pytest
from pyspark.sql import functions as F

from recitant.functions import text
from recitant.operators import events, jobs, layout, render, repair, resume
from recitant.sources import audio

JOBS = "job_id bigint, source_path string, chapter_index int, chapter_title string, estimated_chars int, estimated_chunks int, attempt int, preferred_provider string, fallback_locked boolean"


def test_picks(spark):
    df = spark.createDataFrame(
        [(1, "s", 1, "Chapter 1", 5000, 5, 1, None, False), (2, "s", 2, "Table of Contents", 9000, 9, 1, None, False), (3, "s", 3, "Big", 20000, 20, 1, "CUDAExecutionProvider", False)], JOBS
    )
    assert jobs.gpu_pick(df, ["source_path"]).first().job_id == 3
    assert jobs.gpu_pick(df, ["source_path"], short_first=True).first().job_id == 1
    cpu = jobs.cpu_pick(df, ["source_path"], allowed_chunks=1, gpu_active=True).first()
    assert (cpu.job_id, cpu.tier) == (2, 2)
    assert jobs.cpu_pick(df.where("job_id = 3"), ["source_path"], gpu_active=True).count() == 0
    assert jobs.cpu_pick(df.where("job_id = 3"), ["source_path"]).first().tier == 4
    assert jobs.gpu_pick(df.where("false"), ["source_path"]).count() == 0


def test_sizes(spark):
    rows = [("CPUExecutionProvider", "Map", 1, 10, 1), ("CPUExecutionProvider", "Prose", 1, 10, 3), ("CUDAExecutionProvider", "x", 12, 1, 1), ("CUDAExecutionProvider", "x", 1, 1, 9)]
    df = spark.createDataFrame(rows, "p string, t string, chunks int, chars int, attempt int")
    assert [r[0] for r in df.select(jobs.worker_chars(*(F.col(c) for c in df.columns))).collect()] == [1080, 576, 950, 450]
    assert jobs.worker_plan(2, 1) == [("gpu-1", jobs.GPU), ("gpu-2", jobs.GPU), ("cpu-1", jobs.CPU)]
    assert jobs.effective_chars() == 450 and jobs.effective_chars(300, 0) == 300


def test_completeness_and_retries(spark):
    queue = spark.createDataFrame([(k, "s", k, "t", 1, 1, a, p, l) for k, a, p, l in [(1, 1, None, False), (2, 1, None, False), (3, 3, None, False), (4, 2, None, True)]], JOBS)
    parts = spark.createDataFrame([(1, "a.mp3", None), (2, "b.mp3", None), (2, None, None), (3, "c.mp3", "c.wav"), (4, "d.mp3", "")], "job_id bigint, mp3_path string, wav_path string")
    files = spark.createDataFrame([("a.mp3", 9), ("b.mp3", 9), ("c.mp3", 9), ("c.wav", 0), ("d.mp3", 9), ("d.mp3", 9)], "path string, length long")
    done = jobs.complete(parts, files)
    assert sorted(r.job_id for r in jobs.pending(queue, done).collect()) == [2, 3]
    assert sorted(r.job_id for r in jobs.skipped(queue, done).collect()) == [1, 4]
    failures = spark.createDataFrame([(k, g) for k, g in [(1, False), (2, True), (3, True), (4, True)]], "job_id bigint, gpu_failure boolean")
    again = {r.job_id: (r.attempt, r.preferred_provider, r.fallback_locked) for r in jobs.next_attempts(queue, failures).collect()}
    assert again == {1: (2, None, False), 2: (2, jobs.CPU, True)}
    log = spark.createDataFrame([(1, "timeout", "x", "gpu-1"), (2, "timeout", "x", "cpu-1"), (3, "worker_exception", "CUDA failure", "gpu-2"), (4, "worker_exception", "CUDA failure", None)], "job_id bigint, event_kind string, line_text string, worker_name string")
    assert {r.job_id: r.gpu_failure for r in events.gpu_failures(log).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_names(spark):
    chapters = spark.createDataFrame(
        [(1, 1, 1, "A", " ", None), (2, 1, 2, "A", "x", None), (3, 1, 3, "B", "x", "Book"), (4, 1, 4, "B", "x", "Book"), (5, 1, 5, "A", "x", ""), (6, 1, 6, "C", "x", "???"), (7, 1, 7, "A", "x", None)],
        "chapter_id bigint, source_id bigint, chapter_index int, title string, text string, group_path string",
    )
    sources = spark.createDataFrame([(1, "in/My Book.v2.epub")], "source_id bigint, source_path string")
    got = {r.chapter_id: (r.chapter_index, r.output_subdir, r.output_name) for r in jobs.output_names(chapters, sources).collect()}
    assert got == {
        2: (1, "my-book-v2", "01-A"), 3: (2, "my-book-v2/01-book", "01-B"), 4: (3, "my-book-v2/01-book", "02-B"), 5: (4, "my-book-v2", "02-A"), 6: (5, "my-book-v2/02-document", "01-C"), 7: (6, "my-book-v2", "03-A"),
    }
    contents = spark.createDataFrame([(1, "A", 9), (1, "A", 4)], "source_id bigint, title string, place int")
    named = {r.chapter_id: r.output_name for r in jobs.output_names(chapters, sources, contents).collect()}
    assert (named[2], named[5], named[7]) == ("04-A", "04-A-c004", "04-A-c006")


def test_parts_end_where_the_group_changes(spark):
    rows = [(1, c, 60, g, t) for c, (g, t) in enumerate([("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), ("b", "z"), ("a", "z")], 1)]
    df = spark.createDataFrame(rows, "k int, chunk_index int, samples long, g string, t string")
    made = render.packed_parts(df, ["k"], 100, "g", "t").orderBy("start_chunk").collect()
    assert [(r.part_no, r.start_chunk, r.end_chunk, r.samples, r.group, r.chapter_titles) for r in made] == [(1, 1, 2, 120, "a", ["x"]), (2, 3, 3, 60, "a", ["y"]), (1, 4, 5, 120, "b", ["y", "z"]), (1, 6, 6, 60, "a", ["z"])]


def test_resuming(spark, tmp_path):
    parts = spark.createDataFrame([(1, 1, 1, 4), (1, 2, 5, 9), (1, 3, 10, 10)], "k int, part_no long, start_chunk long, end_chunk long")
    assert [tuple(r) for r in resume.points(parts, ["k"], 2).orderBy("run_no").collect()] == [(1, 1, 3, 10, 9, True), (1, 2, 4, 11, 10, False)]
    assert [tuple(r) for r in resume.points(parts, ["k"], 0).collect()] == [(1, 1, 4, 11, 10, False)]
    path = str(tmp_path / "state")
    assert resume.read(spark, path).count() == 0
    state = spark.createDataFrame([("s", 1, 5, 4, 2.5, 24000, None, 2, [(1, 1, 4)])], resume.STATE)
    resume.write(state, path)
    assert resume.read(spark, path).collect() == state.collect()
    assert [r.name for r in resume.stale(state, F.lit("04-Section")).collect()] == ["tmp-04 - Section-part-02"]
    assert resume.requeued(spark.createDataFrame([("s", 1), ("t", 2)], "source_path string, attempt int"), state).collect()[0].attempt == 1


def test_tags_moves_and_channels(spark, tmp_path):
    df = spark.createDataFrame([("T", 3, "Book", "", None, "2024", "A / B"), ("T", 3, "Book", "X", "P", "", None)], "t string, n int, s string, a string, p string, d string, g string")
    made = [r[0] for r in df.select(render.tags(*(F.col(c) for c in ("t", "n", "s", "a", "p", "d", "g")))).collect()]
    assert (made[0].album, made[0].artist, made[0].date, made[0].publisher) == ("B", None, "2024", None) and (made[1].album, made[1].albumartist, made[1].date, made[1].tracknumber) == ("Book", "X", None, "3")
    moves = spark.createDataFrame([("a.mp3", "/x/y/b.mp3"), ("c.mp3", "/x/d.mp3")], "root string, target string")
    there = spark.createDataFrame([("/x/y/b.mp3",)], "path string")
    assert {r.root: r.quarantined for r in repair.move_plan(moves, there, "/q/").collect()} == {"a.mp3": "/q/x__y__b.mp3", "c.mp3": None}
    two = spark.createDataFrame([([[0.0, 0.5], [-2.0, 1.0]],), ([[]],)], "c array<array<double>>").select(render.interleaved(F.col("c")).alias("x"))
    assert [r.x for r in two.collect()] == [[0, -32767, 16383, 32767], []]
    kept = render.chunk_files(spark.createDataFrame([(7, [0.0], 10)], "chunk_index int, samples array<float>, sample_rate int"))
    assert audio.write(kept, str(tmp_path)).first().path.endswith("chunks/0007.wav")
    paths = spark.createDataFrame([("out/a.b", 1), ("out/a.b", 2)], "r string, n int").select(text.output_paths(F.col("r"), F.col("n")).alias("f")).collect()
    assert [[x.mp3 for x in r.f] for r in paths] == [["out/a.mp3"], ["out/a.b-part01.mp3", "out/a.b-part02.mp3"]]


def test_failed_texts_are_halved_by_sentences():
    assert render.halves_of("One two. Three. Four five.") == ["One two.", "Three. Four five."] and render.halves_of("a b c") == ["a", "b c"] and render.halves_of("abc") == ["a", "bc"]
    spoken = []

    def voice(text):
        if len(text) > 24:
            raise MemoryError("Unable to allocate 3 GiB")
        spoken.append(text)
        return np.full(len(text), len(spoken)), 10

    samples, _ = render.synthesize(voice, "One two three four. Five six seven. Eight nine ten. Eleven twelve.")
    assert spoken == ["One two three four.", "Five six seven.", "Eight nine ten.", "Eleven twelve."] and samples.tolist() == sorted(samples.tolist())
    with pytest.raises(MemoryError):
        render.synthesize(lambda t: (_ for _ in ()).throw(MemoryError("unable to allocate")), "A text of more than twenty characters.")


def test_heartbeat_listener(spark):
    from recitant.streaming.heartbeat import Heartbeat

    lines = []
    listener = Heartbeat(lines.append)
    listener.onQueryStarted(None)
    listener.onQueryProgress(type("E", (), {"progress": type("P", (), {"numInputRows": 4})})())
    listener.onQueryTerminated(type("E", (), {"exception": None})())
    assert lines == ['{"heartbeat": true, "completed_rows": 0}', '{"heartbeat": true, "completed_rows": 4}', '{"worker_job_done": true, "completed_rows": 4}']


def test_parts_equal_a_loop(spark):
    chance, rows, expected = random.Random(5), [], []
    for key in range(20):
        run, first, part = 0, None, 1
        sizes = [chance.randint(1, 60) for _ in range(chance.randint(1, 40))]
        for c, n in enumerate(sizes, 1):
            rows.append((key, c, n))
            first, run = first or c, run + n
            if run >= 100 or c == len(sizes):
                expected.append((key, part, first, c, run))
                run, first, part = 0, None, part + 1
    made = render.packed_parts(spark.createDataFrame(rows, "k int, chunk_index int, samples long"), ["k"], 100)
    assert sorted(map(tuple, made.collect())) == sorted(expected)


def test_sound(spark):
    df = spark.createDataFrame([([0.0, 0.5, -2.0, 0.0, 0.0],), ([0.0, 0.0],)], "a array<double>")
    assert [r[0] for r in df.select(render.pcm16(F.col("a"))).collect()] == [[0, 16383, -32767, 0, 0], [0, 0]]
    assert [r[0] for r in df.select(render.trimmed(F.col("a"), 1000, 0.1, 1)).collect()] == [[0.0, 0.5, -2.0, 0.0], [0.0, 0.0]]

    def short_voice(text):
        if len(text) > 30:
            raise IndexError("index 510 is out of bounds")
        return np.zeros(len(text)), 10

    samples, rate = render.synthesize(short_voice, "word " * 40)
    assert rate == 10 and len(samples) > 100
    with pytest.raises(ValueError):
        render.synthesize(lambda t: (_ for _ in ()).throw(ValueError("no")), "text")
    made = render.rendered(spark.createDataFrame([(1, "abc"), (2, None)], "k int, t string"), ["k"], "t").orderBy("k").collect()
    assert [(r.n_samples, r.sample_rate) for r in made] == [(4800, 24000), (0, 24000)]


def test_rendered_holds_one_text(spark):
    """Before a text is spoken, the samples of all texts before it are gone, within a batch as well."""
    spoken = []

    def voice(said):
        assert not any(samples() is not None for samples in spoken), "samples of an earlier text are held"
        samples = np.zeros(len(said), dtype=np.float32)
        spoken.append(weakref.ref(samples))
        return samples, 10

    df = spark.createDataFrame([(k, "x" * k) for k in range(1, 101)], "k int, t string")
    for unique in (False, True):
        assert sorted(tuple(r) for r in render.rendered(df, ["k"], "t", voice, unique=unique).collect()) == [(k, k, 10) for k in range(1, 101)]


def test_groups(spark):
    rows = [(1, 1, 1, "Book / A"), (2, 1, 2, "Book / B"), (3, 1, 3, "Other"), (4, 1, 4, "Book / A"), (5, 1, 5, None)]
    df = spark.createDataFrame(rows, "chapter_id bigint, source_id bigint, chapter_index int, group_path string").withColumn("text", F.lit("x"))
    got = {r.group_path: r.directory for r in layout.group_directories(df).collect()}
    assert got == {"Book / A": "01-book/01-a", "Book / B": "01-book/02-b", "Other": "02-other"}
    numbers = {r.chapter_id: (r.place, r.number_in_group) for r in layout.numbered(df).collect()}
    assert numbers == {1: (1, 1), 2: (2, 1), 3: (3, 1), 4: (4, 2), 5: (5, 1)}


def test_events(spark):
    line = lambda k, text, at: (k, 1, "gpu-1", "line", text, f"2025-01-01 00:{at}")
    rows = [line(1, "[run:bootstrap] Loading onnxruntime...", "00:00"), line(2, "noise", "01:00"), line(3, "[run:warmup] done", "03:00"), line(4, "[4/10] 40.0% chapter=1/1 chunk=4 left eta=15.0s", "09:00"), line(5, '{"heartbeat": true}', "09:01"), line(6, "{broken", "09:02"), line(6, "{broken", "09:02")]
    log = spark.createDataFrame(rows, "event_id bigint, job_id bigint, worker_name string, event_kind string, line_text string, at string").withColumn("logged_at", F.to_timestamp("at"))
    assert [r.phase for r in events.phases(log).orderBy("event_id").collect()] == ["bootstrap_onnxruntime"] * 2 + ["chapter_load"] + ["render"] * 3
    assert sorted(r.event_id for r in events.silences(log).collect()) == [3, 4]
    p = {r.event_id: r for r in events.parsed(events.once(log)).collect()}
    assert (p[4].progress_current, p[4].progress_total, p[4].percent, p[4].eta_seconds) == (4, 10, 40.0, 15.0)
    assert p[5].is_heartbeat and not p[6].is_heartbeat and p[1].progress_current is None
    assert events.last_states(log, ["worker_name"]).first().event_id == 6
