"""Versioned tables and states, the queue, the journal, SQLite scans and digests."""

import sqlite3
import threading

import pytest
from pyspark.sql import functions as F

from quillon.operators import correlation, service
from quillon.sources import commits, digests, sqlite, store


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    state = commits.State(spark, str(tmp_path / "state"), {"seen": []})
    wrong = []

    def work(k):
        try:
            for j in range(6):
                commits.State(spark, str(tmp_path / "state"), {"seen": []}).update(lambda s: {"seen": [*s["seen"], f"{k}:{j}"]})  # noqa: B023
        except Exception as e:  # noqa: BLE001
            wrong.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not wrong and len(state.get()["seen"]) == 18 and state.log.last() == 18
    for k in range(3):
        assert [x for x in state.get()["seen"] if x.startswith(f"{k}:")] == [f"{k}:{j}" for j in range(6)]
    assert state.update(lambda s: None) is None and state.log.last() == 18


def test_a_commit_is_made_by_one_only(spark, tmp_path):
    log = commits.Log(spark, str(tmp_path / "log"))
    assert log.read() is None and log.commit({"x": 1}, 0) == 1
    with pytest.raises(commits.Conflict):
        log.commit({"x": 2}, 0)
    assert log.read() == {"x": 1} and log.history() == [{"version": 1, "x": 1}]
    assert not list((tmp_path / "log").rglob("*.tmp"))
    with pytest.raises(KeyError):
        log.read(7)


def test_tables_keep_their_versions(spark, tmp_path):
    table = commits.Table(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.replace(spark.range(3), why="first") == 1 and table.append(spark.range(3, 5)) == 2
    before = table.read()
    assert table.update(lambda old: old.where("id > 1")) == 3
    assert sorted(r.id for r in table.read().collect()) == [2, 3, 4] and before.count() == 5 and table.read(1).count() == 3
    with pytest.raises(commits.Conflict):
        table.replace(spark.range(1), on=1)
    assert table.log.read(1)["why"] == "first" and table.version() == 3


def test_texts_are_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "x.json")
    store.write_text(spark, path, "one")
    store.write_text(spark, path, "two")
    store.write_text(spark, f"file://{path}", "three é")
    assert store.read_text(spark, path) == "three é" and [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")] == ["x.json"]


def test_a_run_goes_to_one_of_several_callers(spark, tmp_path):
    queue = commits.Queue(spark, str(tmp_path / "queue"))
    queue.submit("a", [f"a{k}" for k in range(4)])
    queue.submit("b", ["b0", "b1"])
    queue.submit("none", [])
    with pytest.raises(ValueError):
        queue.submit("c", ["b1"])
    got, lock = [], threading.Lock()

    def work(k):
        mine = commits.Queue(spark, str(tmp_path / "queue"))
        while (run := mine.claim(f"w{k}")) is not None:
            with lock:
                got.append((run["run"], run["who"]))

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r for r, _ in got) == ["a0", "a1", "a2", "a3", "b0", "b1"] and queue.claim("late") is None
    assert queue.jobs()["none"]["status"] == "succeeded"
    for run, status in (("a0", "failed"), ("a1", "succeeded"), ("a2", "skipped")):
        queue.end(run, status)
    assert queue.jobs()["a"]["status"] == "running"
    queue.end("a3", "succeeded", note="x")
    assert queue.jobs()["a"]["status"] == "failed" and queue.runs("a")[3]["note"] == "x"
    with pytest.raises(ValueError):
        queue.end("a3", "succeeded")
    queue.submit("d", ["d0", "d1"])
    assert queue.claim("w")["run"] == "d0"
    queue.cancel("d")
    assert queue.jobs()["d"]["status"] == "running" and queue.claim("w") is None
    queue.end("d0", "succeeded")
    assert queue.jobs()["d"]["status"] == "cancelled"
    # The same rule over a table of runs.
    table = spark.createDataFrame([(r["job"], r["status"]) for r in queue.runs()], "job string, status string")
    assert {r.job: r.status for r in service.job_status(table).collect()} == {j: x["status"] for j, x in queue.jobs().items() if j != "none"}


def test_the_journal_is_replayed_in_order(spark, tmp_path):
    journal = commits.Journal(spark, str(tmp_path / "journal"))
    for k in range(5):
        journal.append(f"event{k}", {"research_id": f"r{k % 2}"}, {"value": k}, at=f"2024-01-0{k + 1}")
    assert [r["value"] for r in journal.records()] == [0, 1, 2, 3, 4] and [r["value"] for r in journal.records("r0", 2)] == [2, 4]
    rows = journal.table().orderBy("version").collect()
    assert [(r.version, r.event, r.research_id) for r in rows] == [(k + 1, f"event{k}", f"r{k % 2}") for k in range(5)]


def test_two_callers_admit_one_after_the_other(spark, tmp_path):
    rows = spark.range(0, 400).selectExpr("cast(id div 8 as int) as t", "lpad(cast(id % 8 as string), 6, '0') as code", "rand(1) as c", "rand(2) as o", "rand(3) as vol").cache()
    files = {s: str(tmp_path / s) for s in ("c", "o", "vol")}
    for s in files:
        rows.select("t", "code", F.col(s).alias("values")).write.parquet(files[s])
    out = {}

    def work(name, text):
        out[name] = correlation.StoredLibrary(spark, str(tmp_path / "library")).admit(name, text, rows, files)

    # Two that are alike and one of its own: whoever comes second is refused, whatever the order.
    threads = [threading.Thread(target=work, args=x) for x in (("a", "c"), ("b", "c + o * 0.01"), ("d", "vol"))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    library = correlation.StoredLibrary(spark, str(tmp_path / "library"))
    assert sorted(x.admitted for n, x in out.items() if n != "d") == [False, True] and out["d"].admitted
    assert len(library.factors()) == 2 and library.matrix(rows, files).count() == 1 and library.valid(files)


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "state.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE runs (id TEXT PRIMARY KEY, job_id TEXT, status TEXT, horizon INTEGER, score REAL, done BOOLEAN, blob BLOB, created DATETIME)")
        db.executemany("INSERT INTO runs VALUES (?, ?, ?, ?, ?, ?, ?, ?)", [(f"r{k}", f"j{k % 5}", None if k % 11 == 0 else ["queued", "running", "succeeded", "failed"][k % 4], k, k / 3 if k % 7 else None, k % 2, b"x" * (k % 3), f"2024-01-{k % 28 + 1:02d}") for k in range(1000)])
        db.execute('CREATE TABLE "odd name" ("a ""b" TEXT, n INTEGER)')
        db.execute("DELETE FROM runs WHERE horizon BETWEEN 300 AND 499")
    return path


def test_sqlite_tables_are_read_in_parts(spark, database):
    runs = sqlite.scan(spark, database, "runs", parts=5)
    assert runs.rdd.getNumPartitions() == 5 and dict(runs.dtypes) == {"id": "string", "job_id": "string", "status": "string", "horizon": "bigint", "score": "double", "done": "boolean", "blob": "binary", "created": "string"}
    got = {r.id: r for r in runs.collect()}
    assert len(got) == 800 and got["r14"].score is None and got["r15"].score == 5.0 and got["r11"].status is None and bytes(got["r8"].blob) == b"xx" and got["r9"].done is True
    jobs = {r.job: r.status for r in service.job_status(runs.select(F.col("job_id").alias("job"), F.coalesce("status", F.lit("skipped")).alias("status"))).collect()}
    assert jobs == {f"j{k}": "running" for k in range(5)}
    assert sqlite.scan(spark, database, "odd name").count() == 0 and sqlite.scan(spark, database, "odd name").columns == ['a "b', "n"]


def test_sqlite_filters_and_columns_reach_the_file(spark, database):
    runs = sqlite.scan(spark, database, "runs", ["id", "status", "horizon"])
    assert runs.columns == ["id", "status", "horizon"]
    few = runs.where((F.col("status") == "failed") & (F.col("horizon") >= 900) & F.col("id").isin("r903", "r907", "r1") & F.col("status").isNotNull())
    assert sorted(r.id for r in few.collect()) == ["r903", "r907"]
    assert runs.where("status is null").count() == len([k for k in range(1000) if k % 11 == 0 and not 300 <= k <= 499])
    reader = sqlite.SQLiteReader(runs.schema, {"path": database, "table": "runs"})
    left = list(reader.pushFilters([sqlite.EqualTo(("status",), "failed"), sqlite.GreaterThan(("horizon",), 5), sqlite.EqualTo(("horizon",), "x")]))
    assert len(left) == 1 and reader.where == ['"status" = ?', '"horizon" > ?'] and reader.values == ["failed", 5]
    with pytest.raises(Exception):  # noqa: B017
        sqlite.scan(spark, database, "runs", ["nothing"]).count()


def test_sources_that_changed_are_refused(spark, tmp_path):
    for name in ("c", "o"):
        spark.range(50).selectExpr("id", f"id * {len(name)} as x").repartition(3).write.parquet(str(tmp_path / name))
    manifest = digests.Manifest(spark, str(tmp_path / "manifest"))
    paths = {n: str(tmp_path / n) for n in ("c", "o")}
    kept = manifest.write(paths, made="today")
    assert kept["sources"]["c"]["files"] == 3 and kept["made"] == "today" and manifest.differing() == []
    manifest.check()
    # The file system's own check sums of local files would notice first.
    for sums in (tmp_path / "o").glob(".*.crc"):
        sums.unlink()
    part = next((tmp_path / "o").glob("part-*"))
    data = part.read_bytes()
    part.write_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    assert manifest.differing() == ["o"]
    with pytest.raises(digests.Changed):
        manifest.check()
    part.write_bytes(data)
    manifest.check(paths)
    part.unlink()
    assert manifest.differing({"o": paths["o"]}) == ["o"]
    with pytest.raises(KeyError):
        manifest.differing({"new": paths["c"]})
    with pytest.raises(Exception):  # noqa: B017
        manifest.write({"none": str(tmp_path / "none")})
