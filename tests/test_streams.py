"""Streams with state and feedback against sequential computations, over restarts and replayed batches."""

import json
import os
import random
import shutil
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assetweave import rules
from assetweave.operators import classify, learning
from assetweave.streaming import jobs, runs, state


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / x) for x in ("in", "out", "mark")]


def add(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def replay_last_batch(mark):
    """The stream forgets that its last batch was finished, as after a crash before the commit."""
    commits = [x for x in os.listdir(f"{mark}/commits") if x.isdigit()]
    last = max(commits, key=int)
    for name in (last, f".{last}.crc"):
        if os.path.exists(f"{mark}/commits/{name}"):
            os.remove(f"{mark}/commits/{name}")
    return int(last)


# --- due again ------------------------------------------------------------------------------------

START = datetime(2024, 1, 1)
EVENTS = "supplier string, ts timestamp"


def at(days):
    return START + timedelta(days=days)


def due_rows(events, days, lateness):
    by, newest = defaultdict(set), max(t for _, t in events if t)
    for key, t in events:
        if key is not None and t is not None:
            by[key].add(t)
    out, period = [], timedelta(days=days)
    for key, times in by.items():
        order = sorted(times)
        for t, later in zip(order, [*order[1:], None]):
            if (later is None or later > t + period) and t + period < newest - timedelta(days=lateness):
                out.append((key, t, t + period))
    return sorted(out)


def run_due(spark, source, out, mark, files=1, **options):
    with state.rocksdb(spark):
        query = jobs.to_folder(state.due_again(jobs.watch_folder(spark, source, EVENTS, files_per_batch=files), "supplier", "ts", **options),
                               out, mark, once=True)
    query.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema("supplier string, last_seen timestamp, due timestamp").parquet(out).collect())


def test_due_once_per_last_event_and_again_after_a_new_one(spark, folders):
    source, out, mark = folders
    add(spark, [("a", at(0)), ("a", at(1)), ("b", at(2)), (None, at(1)), ("c", None)], EVENTS, source)
    assert run_due(spark, source, out, mark) == []
    add(spark, [("b", at(12))], EVENTS, source)
    first = [("a", at(1), at(8)), ("b", at(2), at(9))]
    assert run_due(spark, source, out, mark) == first
    assert run_due(spark, source, out, mark) == first  # nothing new, nothing due
    add(spark, [("z", at(40))], EVENTS, source)
    assert run_due(spark, source, out, mark) == [*first, ("b", at(12), at(19))]  # the state came through the restarts
    add(spark, [("a", at(60)), ("z", at(90))], EVENTS, source)
    assert run_due(spark, source, out, mark) == [("a", at(1), at(8)), ("a", at(60), at(67)), ("b", at(2), at(9)),
                                                 ("b", at(12), at(19)), ("z", at(40), at(47))]


def test_due_equals_the_batch_when_events_are_out_of_order(spark, folders):
    source, out, mark = folders
    made = random.Random(2)
    events = [(f"k{made.randrange(12)}", at(made.randrange(90 * 24) / 24)) for _ in range(160)]
    arriving = sorted(events, key=lambda e: e[1] + timedelta(hours=made.randrange(47)))
    for i in range(0, len(arriving), 20):
        add(spark, arriving[i:i + 20], EVENTS, source)
        if i == 80:
            run_due(spark, source, out, mark, days=5, lateness="2 days")  # and a restart in between
    want = due_rows(events, 5, 2)
    assert len(want) > 20 and run_due(spark, source, out, mark, days=5, lateness="2 days") == want


def test_due_takes_an_event_at_the_end_of_the_period_and_leaves_late_ones_out(spark, folders):
    """An event exactly a period later belongs to the same visit; one that comes later than `lateness` does not count, though its key is still open."""
    source, out, mark = folders
    micro = timedelta(microseconds=1)
    add(spark, [("a", at(0)), ("a", at(5)), ("b", at(0)), ("b", at(5) + micro), ("c", at(4)), ("e", at(2)), ("z", at(8))], EVENTS, source)
    first = [("b", at(0), at(5)), ("e", at(2), at(7))]  # the watermark is day 7
    assert run_due(spark, source, out, mark, days=5) == first
    add(spark, [("c", at(6)), ("z", at(9))], EVENTS, source)  # the first is late
    run_due(spark, source, out, mark, days=5)
    add(spark, [("z", at(40))], EVENTS, source)
    assert run_due(spark, source, out, mark, days=5) == [
        ("a", at(5), at(10)), first[0], ("b", at(5) + micro, at(10) + micro), ("c", at(4), at(9)), first[1], ("z", at(9), at(14))]


def test_due_keeps_its_state_without_python(spark, folders):
    source, *_ = folders
    add(spark, [("a", at(0))], EVENTS, source)
    plan = state.due_again(jobs.watch_folder(spark, source, EVENTS), "supplier", "ts")._jdf.queryExecution().logical().toString()
    assert "Pandas" not in plan and "Python" not in plan and "PySpark" not in plan


def test_provider_of_the_session_comes_back(spark):
    before = spark.conf.get(state.PROVIDER, None)
    with pytest.raises(KeyError), state.rocksdb(spark):
        assert spark.conf.get(state.PROVIDER) == state.ROCKSDB
        raise KeyError
    assert spark.conf.get(state.PROVIDER, None) == before


# --- learning with promotion ------------------------------------------------------------------------

ITEMS = "item string, description string"


def learn_in_turn(spark, files, known):
    """The batch operators, one file after the other."""
    weights, sightings, promoted, known = defaultdict(float), defaultdict(int), {}, set(known)
    for i, rows in enumerate(files):
        labelled = classify.classify(spark.createDataFrame(rows, ITEMS), "description")
        terms = spark.createDataFrame(sorted(known), "category string, keyword string")
        for r in learning.learn_candidates(labelled, "description", "label", terms).collect():
            weights[r.category, r.keyword] += r.weight
            sightings[r.category, r.keyword] += r.sightings
        heavy = [(*k, w) for k, w in weights.items() if round(w, 6) >= rules.MIN_OCCURRENCES and k not in known]
        if heavy:
            for r in learning.promote(spark.createDataFrame(heavy, "category string, keyword string, weight double"), terms).collect():
                if r.promoted:
                    known.add((r.category, r.keyword))
                    promoted[r.category, r.keyword] = i
    return sorted((*k, sightings[k], round(w, 6), promoted.get(k)) for k, w in weights.items())


def test_promoted_keywords_reach_the_next_batch(spark, folders):
    source, out, mark = folders
    made = random.Random(8)
    nouns = ["centrifuge", "rotor", "valve", "tubing", "license", "software", "gloves", "spectrometer", "adapter", "the", "x12345678", "nozzle"]
    files = [[(f"{i}-{j}", " ".join(made.choice(nouns) for _ in range(6))) for j in range(10)] + [(f"{i}", None), (f"{i}e", "")] for i in range(4)]
    base = [("hw", "rotor")]
    dictionary = spark.createDataFrame(base, "category string, keyword string")

    def run():
        jobs.learning_loop(jobs.watch_folder(spark, source, ITEMS, files_per_batch=1), "description", None, dictionary, out, mark, once=True).awaitTermination()
        return sorted((tuple(r) for r in jobs.learned_keywords(spark, out).collect()))
    for rows in files[:2]:
        add(spark, rows, ITEMS, source)
    run()
    for rows in files[2:]:
        add(spark, rows, ITEMS, source)
    want = learn_in_turn(spark, files, base)
    assert any(r[4] is not None and r[4] < 2 for r in want) and any(r[4] is None for r in want)
    assert run() == want
    assert replay_last_batch(mark) == 3
    assert run() == want  # the replayed batch saw neither itself nor changed anything
    assert spark.read.parquet(f"{out}/labelled").count() == sum(map(len, files))
    assert spark.read.parquet(f"{out}/learned").filter("batch = 3").count() < len(want)  # changes only


# --- changed files ------------------------------------------------------------------------------------

FILES = "path string, mtime timestamp"


def test_changed_files_against_a_set(spark, folders):
    source, out, mark = folders
    made, seen = random.Random(1), set()
    for _ in range(6):  # days go to and fro; repeats within and between batches; missing values
        rows = [(made.choice(["a", "b", "c", None]), made.choice([at(0), at(0.5), at(1), at(400), at(-300), None])) for _ in range(12)]
        seen |= set(rows)
        add(spark, rows, FILES, source)
    def run():
        query = jobs.to_changed_files(jobs.watch_folder(spark, source, FILES, files_per_batch=1), "path", "mtime", out, mark, once=True)
        query.awaitTermination()
        return query
    query = run()
    got = [tuple(r) for r in jobs.read_changed_files(spark, out).collect()]
    assert sorted(got, key=str) == sorted(seen, key=str)
    assert all(not p["stateOperators"] for p in map(lambda p: json.loads(p.json), query.recentProgress))
    replay_last_batch(mark)
    run()
    assert sorted(map(tuple, jobs.read_changed_files(spark, out).collect()), key=str) == sorted(seen, key=str)


def test_a_batch_reads_the_days_it_touches(spark, folders):
    source, out, mark = folders
    def run():
        jobs.to_changed_files(jobs.watch_folder(spark, source, FILES, files_per_batch=1), "path", "mtime", out, mark, once=True).awaitTermination()
    for day in (0, 1, 2):
        add(spark, [("a", at(day))], FILES, source)
    run()
    for kept in (x for x in os.listdir(f"{out}/batch=1") if x.startswith("day=")):
        shutil.move(f"{out}/batch=1/{kept}", f"{out}/batch=1/{kept}-unread")
        os.makedirs(f"{out}/batch=1/{kept}")
        with open(f"{out}/batch=1/{kept}/part-0.parquet", "w") as f:
            f.write("no parquet file")  # reading it would fail
        shutil.rmtree(f"{out}/batch=1/{kept}-unread")
    add(spark, [("a", at(0)), ("b", at(2))], FILES, source)
    run()
    assert [tuple(r) for r in spark.read.parquet(f"{out}/batch=3").select("path").collect()] == [("b",)]


# --- runs ---------------------------------------------------------------------------------------------

def test_runs_are_closed_also_when_they_die_outside_a_handler(spark, folders, tmp_path):
    source, out, mark = folders
    add(spark, [("a", at(0))], FILES, source)
    add(spark, [("b", at(1))], FILES, source)
    log = str(tmp_path / "log")
    stream = jobs.watch_folder(spark, source, FILES, files_per_batch=1)
    broken = stream.withColumn("path", F.when(F.col("path") == "b", F.raise_error(F.lit("bad row"))).otherwise(F.col("path")))
    with runs.RunRecorder(spark, log) as recorder:
        recorder.wait(jobs.to_folder(stream, out, mark, once=True))
        recorder.wait(jobs.to_folder(broken, out + "2", mark + "2", once=True))
    assert recorder.errors == []
    got = sorted((r.status, r.batches, r.rows, r.started is not None, r.ended is not None, "bad row" in (r.error or ""))
                 for r in runs.read_runs(spark, log).collect())
    assert got == [("failed", 1, 1, True, True, True), ("success", 2, 2, True, True, False)]


def test_a_run_without_an_end_is_open(spark, tmp_path):
    log = str(tmp_path / "log")
    recorder = runs.RunRecorder(spark, log)
    recorder._names["r"] = None
    recorder._write("r", "started", "2024-01-01T00:00:00Z")
    row = runs.read_runs(spark, log).first()
    assert (row.status, row.ended, row.batches) == ("open", None, 0)
    with pytest.raises(TimeoutError):
        recorder.wait(type("Query", (), {"awaitTermination": lambda self: None, "runId": "other"})(), 0.1)


def test_a_delivery_is_one_batch_whatever_number_of_tasks_wrote_it(spark, tmp_path):
    from assetweave.plans.catalog import streams

    rows, out, read = spark.range(40, numPartitions=4), str(tmp_path / "out"), []

    def save(batch, batch_id):
        read.append(batch.select(F.input_file_name()).distinct().count())
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    for arriving in streams._deliveries(rows, F.col("id") % 3, 3):
        jobs._start(arriving.writeStream.foreachBatch(save), str(tmp_path / "marks"), True).awaitTermination()
    assert {(r.batch, r.id) for r in spark.read.parquet(out).collect()} == {(i % 3, i) for i in range(40)}
    assert read == [4, 4, 4]
