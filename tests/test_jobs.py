import os

import pytest

from assetweave.plans import batch
from assetweave.sources import readers, writers
from assetweave.streaming import jobs


def test_read_items_with_header_on_second_line(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"s{i}.csv").write_text(f"Export {i},,\ncode,description,supplier\nc{i},\"a, b\",x\n,,\n")
    got = readers.read_items(spark, str(tmp_path), "csv")
    assert got.columns == ["code", "description", "supplier"]
    assert sorted(r.code for r in got.collect() if r.code) == ["c0", "c1", "c2"]
    with pytest.raises(ValueError):
        readers.read_items(spark, str(tmp_path / "x.doc"))


def test_file_listings(spark, tmp_path):
    for folder, name in (("Zeiss", "a.pdf"), ("Zeiss", "b.txt"), ("Olympus", "c.pdf")):
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / name).write_text("x" * 10)
    assert sorted((r.supplier, r.file_name, r.size_bytes) for r in readers.scan_library(spark, str(tmp_path)).collect()) == [
        ("Olympus", "c.pdf", 10), ("Zeiss", "a.pdf", 10)]
    for name in ("in.csv", "~$in.csv", "in_labeled.csv", "in.doc"):
        (tmp_path / name).write_text("x")
    assert [r.file_name for r in readers.list_inputs(spark, str(tmp_path / "*in*")).collect()] == ["in.csv"]
    (tmp_path / "hw.txt").write_text("# note\n Pump \n\nVALVE\n")
    assert sorted(r.keyword for r in readers.load_dictionary(spark, str(tmp_path / "hw.txt"), "hw").collect()) == ["pump", "valve"]


def test_run_logs(spark, tmp_path):
    (tmp_path / "pipeline_1.log").write_text("2024-05-01 10:00:00 x\nInput file:  in.xlsx \nfinished in 125.5 s\nPIPELINE COMPLETE\n")
    (tmp_path / "pipeline_2.log").write_text("nothing\n")
    got = {r.run: r for r in readers.parse_run_log(spark, str(tmp_path)).collect()}
    assert tuple(got["pipeline_1.log"])[1:] == ("2024-05-01 10:00:00", "in.xlsx", 125.5, "success")
    assert tuple(got["pipeline_2.log"])[1:] == ("-", "-", None, "failed")


def test_versions_ignore_unfinished_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_version(spark.range(1), path, 1)
    spark.range(2).write.parquet(f"{path}/version=2")  # a writer that stopped before the end
    assert writers.read_latest(spark, path).count() == 1


def test_streams_take_each_file_once_and_equal_the_batch(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "item string, description string"
    spark.createDataFrame([("1", "microscope")], schema).coalesce(1).write.parquet(source)
    def run():
        stream = jobs.label_stream(jobs.watch_folder(spark, source, schema), "description")
        query = jobs.to_folder(stream, out, mark, once=True)
        query.awaitTermination()
    run()
    spark.createDataFrame([("2", "software")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("item", "label").collect()) == [("1", "Research Instrument"), ("2", "Software")]


def test_whole_flow(spark):
    text = "Axio imager microscope operating instructions with stage and optics. " * 20
    items = spark.createDataFrame([(1, "C1", "Axio microscope imager", "***ZEISS***USE V#1***"), (2, "C2", "Desk", "Ikea"),
                                   (3, "C3", "centrifuge", "New Labs")], "item_id int, item_code string, description string, supplier string")
    hits = spark.createDataFrame([("NEW LABS", "first", 1, "https://newlabs.com/"), ("NEW LABS", "second", 1, "https://www.newlabs.com/x")],
                                 "supplier string, engine string, pos int, url string")
    got = batch.run(batch.Inputs(
        items=items, master=spark.createDataFrame([("ZEISS", "https://zeiss.com")], "supplier string, website string"),
        dictionary=spark.createDataFrame([("hw", "pump")], "category string, keyword string"),
        docs=spark.createDataFrame([(1, "zeiss", "imager manual.pdf", text), (2, "zeiss", "brochure.pdf", text)],
                                   "doc_id int, supplier string, file_name string, text string"), hits=hits))
    assert [(r.before, r.after) for r in got["clean_diff"].collect()] == [("***ZEISS***USE V#1***", "ZEISS")]
    assert {r.item_id: r.item_type for r in got["items"].collect()} == {1: "Research Instrument", 2: "Non-Instrument", 3: "Research Instrument"}
    assert sorted(r.supplier for r in got["resolved"].collect()) == ["NEW LABS", "ZEISS"]
    assert [(r.item_id, r.doc_id) for r in got["links_scored"].collect()] == [(1, 1)]
    assert got["summary"].first().with_match == 1
    with pytest.raises(ValueError):
        batch.run(None, batch.Settings(stages=("other",)))


def test_sheets_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Export,,\ncode,description,supplier\nc1,d1,s1\n")
    (tmp_path / "b.csv").write_text("Export,,\nsupplier,code,description\ns2,c2,\"d, 2\"\n")
    (tmp_path / "c.csv").write_text("Export,,\ncode,vendor\nc3,v3\n")
    (tmp_path / "d.csv").write_text("Export,,\ncode,description,supplier\nc4,d4,s4\n")
    got = {r.code: (r.description, r.supplier, r.vendor) for r in readers.read_items(spark, str(tmp_path), "csv").collect()}
    assert got == {"c1": ("d1", "s1", None), "c2": ("d, 2", "s2", None), "c3": (None, None, "v3"), "c4": ("d4", "s4", None)}


def test_late_events_are_not_lost(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "path string, mtime timestamp"
    for day in ("2024-05-09", "2024-01-01", "2024-03-01", "2024-01-01"):
        df = spark.sql(f"select 'p' || (id % 5) path, timestamp'{day} 10:00:00' mtime from range(10)")
        df.coalesce(1).write.mode("append").parquet(source)
    changes = jobs.watch_folder(spark, source, schema, files_per_batch=1)
    jobs.to_changed_files(changes, "path", "mtime", out, mark, once=True).awaitTermination()
    assert jobs.read_changed_files(spark, out).count() == 15


def test_changes_grow_with_changed_keys_only(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "key long, ts timestamp"
    def add(keys, stamp):
        spark.createDataFrame([(k,) for k in keys], "key long").selectExpr("key", f"timestamp'{stamp}' ts").coalesce(1).write.mode("append").parquet(source)
        jobs.to_changes(jobs.last_seen(jobs.watch_folder(spark, source, schema), "key", "ts"), out, mark, once=True).awaitTermination()
    add(range(20), "2024-01-02 00:00:00")
    add([3, 30], "2024-01-03 00:00:00")
    add([4], "2023-01-01 00:00:00")  # an older time changes nothing that counts
    assert spark.read.parquet(out).count() <= 23
    got = {r.key: str(r.last_seen)[:10] for r in jobs.read_changes(spark, out, "key").collect()}
    assert got == {**{k: "2024-01-02" for k in range(20)}, 3: "2024-01-03", 30: "2024-01-03"}
    jobs.fold_changes(spark, out, str(tmp_path / "folded"), "key")
    assert spark.read.parquet(str(tmp_path / "folded")).count() == 21


def test_settings_and_snapshot_before_a_new_dictionary(spark, tmp_path):
    path = str(tmp_path / "learning")
    candidates = spark.createDataFrame([("hw", "pump", 6.0)], "category string, keyword string, weight double")
    writers.save_learning(candidates, path, {"min_occurrences": 7, "confidence": 0.5}, "2024-01-01")
    assert writers.load_settings(spark, path) == {"min_occurrences": 7, "confidence": 0.5, "last_updated": "2024-01-01"}
    old, new = candidates.select("category", "keyword"), spark.createDataFrame([("hw", "pump"), ("hw", "valve")], "category string, keyword string")
    writers.replace_dictionary(old, new, str(tmp_path / "d"), str(tmp_path / "s"), 1, "20240101")
    assert writers.read_latest(spark, str(tmp_path / "d")).count() == 2
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1


def test_harvest_is_part_of_the_flow(spark):
    text = "Axio imager microscope operating instructions"
    pages = spark.createDataFrame([(1, "https://newlabs.com/", "<a href='/a.pdf'>a</a><a href='/p'>p</a>"), (2, "https://newlabs.com/p", "<a href='/b.pdf'>b</a>")],
                                  "page_id int, url string, html string")
    got = batch.run(batch.Inputs(
        items=spark.createDataFrame([(1, "C1", "Axio imager", "New Labs")], "item_id int, item_code string, description string, supplier string"),
        master=spark.createDataFrame([("NEW LABS", "https://newlabs.com/")], "supplier string, website string"),
        dictionary=spark.createDataFrame([("hw", "pump")], "category string, keyword string"),
        docs=spark.createDataFrame([(1, "New Labs", "imager.pdf", text)], "doc_id int, supplier string, file_name string, text string"),
        pages=pages, state=spark.createDataFrame([("NEW LABS", "2024-01-01T00:00:00")], "supplier string, last_seen string"),
        found=spark.createDataFrame([("NEW LABS", "https://newlabs.com/a.pdf", 5000), ("NEW LABS", "https://newlabs.com/b.pdf", 5)],
                                    "supplier string, url string, size_bytes long")),
        batch.Settings(item_wise=True))
    assert got["due"].count() == 1
    assert sorted(r.url for r in got["found"].collect()) == ["https://newlabs.com/a.pdf", "https://newlabs.com/b.pdf"]
    assert [r.file_name for r in got["downloads"].collect()] == ["a.pdf"]
    assert [(r.item_id, r.doc_id) for r in got["links_scored"].collect()] == [(1, 1)]


def test_any_number_of_headers_takes_one_scan_of_the_rows(spark, tmp_path):
    import csv
    want = []
    for i in range(30):
        names = ["code", f"extra {i}", "description"] if i % 2 else ["description", "code", f'say "{i}", or not']
        with open(tmp_path / f"f{i}.csv", "w", newline="") as f:
            f.write("" if i % 5 == 4 else f"Export {i},,")
            f.write("\r\n")
            out = csv.writer(f)
            for row in [names, *[[f"{n[:3]} {i}-{j}" for n in names] for j in range(3)], names]:
                out.writerow(row)
        want += [{n: f"{n[:3]} {i}-{j}" for n in names} for j in range(3)]
    (tmp_path / "short.csv").write_text("only a title\n")
    (tmp_path / "bare.csv").write_text("title\ncode,description,\nc,d,\n")
    want.append({"code": "c", "description": "d"})
    df = readers.read_items(spark, str(tmp_path), "csv")
    assert df.columns[:2] == ["code", "description"] and len(df.columns) == 32
    got = [{k: v for k, v in r.asDict().items() if v is not None} for r in df.collect()]
    assert sorted(got, key=lambda r: sorted(r.items())) == sorted(want, key=lambda r: sorted(r.items()))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan csv") == 1
    assert readers.read_items(spark, str(tmp_path), "csv", ["description", "nowhere"]).columns == ["description", "nowhere"]


def test_library_files_are_written_by_many_tasks(spark, tmp_path):
    from assetweave.plans.catalog import storage

    rows = [(i, f"text {i}", "ab"[i % 2]) for i in range(24)] + [(99, None, "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = storage.scan_library(spark, str(tmp_path))
    assert sorted((r.supplier, r.n, r.bytes) for r in got.collect()) == [("a", 12, 12 * 7 + 7), ("b", 12, 12 * 7 + 7)]
    tasks = {os.path.basename(f)[:10] for f in got.inputFiles()}
    assert len(tasks) > 1


def test_library_scan_lists_what_the_reader_lists_in_few_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    for name in ("Zeiss/a.pdf", "Zeiss/deep/er/b.pdf", "Zeiss/none.pdf", "Zeiss/.hid.pdf", "_x/c.pdf", "_x=1/d.pdf", "_metadata.d/e.pdf", "o d%20é/_f.pdf",
                 "o d%20é/_f=.pdf", "o d%20é/g.pdf._COPYING_", "o d%20é/h.PDF", "top.pdf", "o d%20é/i[1].pdf", *(f"many/{i}.pdf" for i in range(900))):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "none" in name else name)
    (tmp_path / "Zeiss" / "nowhere.pdf").symlink_to(tmp_path / "absent")
    (tmp_path / "Zeiss" / "linked.pdf").symlink_to(tmp_path / "top.pdf")
    for pattern in ("[a-f]*.{pdf,PDF}", "?.*", "*.pdf"):
        got = readers.scan_library(spark, str(tmp_path), pattern)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(str(tmp_path))
        want = files.select("path", F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1), "length", "modificationTime")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert readers.scan_library(spark, str(tmp_path)).rdd.getNumPartitions() < files.rdd.getNumPartitions()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.scan_library(spark, str(tmp_path / "absent"))


def test_a_file_per_row_without_checksums_and_with_lasting_names(spark, tmp_path):
    rows = [(1, "a/b", "same"), (1, "a/b", "same"), (1, "a/b", "öther"), (2, "", "x"), (None, None, "y"), (None, "q=%ä", ""), *((i, "z", f"t {i}") for i in range(9, 40))]
    df = spark.createDataFrame(rows, "k long, folder string, value string")
    df.select("folder", "value").write.partitionBy("folder").option("maxRecordsPerFile", 1).text(str(tmp_path / "spark"))
    held = {}
    for run, order in (("one", "value"), ("two", "folder")):
        writers.write_files(df.orderBy(order), "k", "folder", "value", str(tmp_path / run))
        assert not [f for f in (tmp_path / run).rglob(".*")]
        held[run] = {str(f.relative_to(tmp_path / run)): f.read_bytes() for f in (tmp_path / run).rglob("*.txt")}
    spark_files = [(f.parent.name, f.read_bytes()) for f in (tmp_path / "spark").rglob("*.txt")]
    assert held["one"] == held["two"] and sorted((os.path.dirname(k), v) for k, v in held["one"].items()) == sorted(spark_files)
    assert len({os.path.basename(f)[:10] for f in held["one"]}) > 1
