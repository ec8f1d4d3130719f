"""Versions, the snapshot data source, and state with timers over several batches."""

import contextlib
import datetime as dt
import http.server
import io
import json
import threading

import pytest
from pyspark.sql import functions as F

from boutforge.sources import snapshot_source
from boutforge.sources.versions import Versions, retain
from boutforge.streaming import events, timers


def test_failures_leave_the_last_version_readable(spark, tmp_path, monkeypatch):
    versions = Versions(spark, str(tmp_path / "v"))
    assert versions.current() is None and versions.read() is None
    rows = spark.range(10)
    versions.write(rows)
    broken = spark.range(5).withColumn("id", F.expr("raise_error('lost')").cast("long"))
    with pytest.raises(Exception, match="lost"):  # while rows are written
        versions.write(broken)
    assert versions.read().count() == 10
    with monkeypatch.context() as m, pytest.raises(RuntimeError):  # rows written, manifest not
        m.setattr(Versions, "current", lambda self, seen=[]: (seen.append(1), None if len(seen) == 1 else 1 / 0)[1])  # noqa: B006
        m.setattr(type(spark), "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("stopped")))
        versions.write(spark.range(3))
    assert versions.read().count() == 10 and len(versions.history()) == 1
    versions.write(spark.range(7), day="2024-01-01")
    versions.write(spark.range(8))
    assert [r.n for r in versions.history()] == [10, 7, 8] and versions.read(version=0).count() == 10
    versions.forget(keep=1)
    assert versions.read().count() == 8 and versions.read(day="2024-02-01").count() == 7
    assert len(list((tmp_path / "v" / "data").iterdir())) == 2


def test_a_second_writer_of_a_version_fails(spark, tmp_path, monkeypatch):
    versions = Versions(spark, str(tmp_path / "v"))
    versions.write(spark.range(1))
    stale = versions.current()
    versions.write(spark.range(2))
    monkeypatch.setattr(Versions, "current", lambda self: stale)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        versions.write(spark.range(3))
    monkeypatch.undo()
    assert versions.read().count() == 2


def test_batches_are_merged_once(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    batch = lambda *rows: spark.createDataFrame(list(rows), "url string, at int")
    one, two = batch(("a", 1), ("b", 2), ("a", 3)), batch(("c", 5), ("b", 9))
    put = lambda rows, number, now: retain(versions, rows, number, "url", "at", 3, now=F.lit(now))
    assert put(one, 0, 10) and not put(one, 0, 11) and put(two, 1, 20) and not put(one, 0, 30) and not put(two, 1, 30)
    got = {(r.url, r.at, r.first_seen) for r in versions.read().collect()}
    assert got == {("a", 3, 10), ("b", 2, 10), ("c", 5, 20)}
    assert put(batch(("d", 7)), 2, 40)
    assert {r.url for r in versions.read().collect()} == {"a", "c", "d"}


ROWS = [{"title": f"news {k}", "at": k, "x": {"deep": 1}} for k in range(1000)] + [{"title": None, "at": 5}, {"at": None, "title": "news z"}]


def load(spark, path, **options):
    snapshot_source.register(spark)
    return spark.read.format("snapshot").schema("title string, at long").options(path=str(path), **options).load()


def plan_of(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain("formatted")
    return out.getvalue()


def test_snapshot_source_filters_while_it_reads(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, ROWS)))
    for split in ("5000", "100000000"):
        df = load(spark, tmp_path, split=split)
        assert sorted((r.title or "", r["at"] or -1) for r in df.collect()) == sorted((r["title"] or "", r["at"] or -1) if "title" in r else ("", r["at"]) for r in ROWS)
        some = df.where(F.col("title").startswith("news 1") & F.col("title").contains("7") & (F.col("at") > 17) & F.col("at").isin(*range(150, 200)))
        assert sorted(r["at"] for r in some.collect()) == [157, 167, *range(170, 180), 187, 197]
        assert df.where("title is null").count() == 1 and df.where("at is not null and title = 'news z'").count() == 0
    plan = plan_of(some)
    assert "Filter" not in plan.split("(1)")[0], plan  # nothing is left to decide above the scan
    reader = snapshot_source.SnapshotReader(df.schema, {"path": "x"})
    other = object.__new__(snapshot_source.EqualTo)
    object.__setattr__(other, "attribute", ("nested", "field"))
    assert list(reader.pushFilters([other])) == [other] and not reader.tests


def test_missing_and_broken_snapshots(spark, tmp_path):
    assert load(spark, tmp_path / "none").count() == 0
    with pytest.raises(Exception, match="none"):
        load(spark, tmp_path / "none", mode="strict").count()
    (tmp_path / "b.json").write_text('{"title": "a", "at": 1}\nnot json\n[1]\n{"title": "b", "at": "x"}\n{"title": "c"}\n')
    assert sorted(r.title for r in load(spark, tmp_path / "b.json").collect()) == ["a", "c"]
    with pytest.raises(Exception, match="JSON"):
        load(spark, tmp_path / "b.json", mode="strict").collect()
    (tmp_path / "e.json").write_text("")
    assert load(spark, tmp_path / "e.json", mode="strict").count() == 0


def test_a_fetched_copy_serves_until_it_is_old(tmp_path):
    body = [b'{"title": "one"}']

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if body[0] else 500)
            self.end_headers()
            self.wfile.write(body[0] or b"")

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    uri, cache = f"http://127.0.0.1:{server.server_port}/x.json", str(tmp_path / "cache")
    text = lambda now: open(snapshot_source.cached(uri, cache, 3600, now)).read()
    assert text(1000.0) == '{"title": "one"}'
    body[0] = b'{"title": "two"}'
    assert text(4599.0) == '{"title": "one"}' and text(4601.0) == '{"title": "two"}'
    body[0] = None
    assert text(5000.0) == '{"title": "two"}'
    with pytest.raises(Exception, match="500"):
        text(99_999.0)
    server.shutdown()


def streamed(spark, tmp_path, batches, processor, late="1 hour"):
    """What the processor gives out when each batch is a file of its own; times in hours."""
    schema = "key string, ts timestamp, at long, id long, kind string"
    start = dt.datetime(2024, 1, 1)
    for n, rows in enumerate(batches):
        made = [(k, start + dt.timedelta(hours=h), int(h * timers.HOUR), i, kind) for k, h, i, kind in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")).withWatermark("ts", late)
    offset = int(start.replace(tzinfo=dt.UTC).timestamp() * 1_000_000)
    shifted = stream.withColumn("at", F.col("at") + offset)
    kind = "key string, at long, id long" if isinstance(processor, timers.FirstSightings) else "key string, stage string, at long"
    out = events.run_append(timers.with_state(shifted, "key", processor, kind), "t")
    return sorted(tuple((v - offset) / timers.HOUR if c == "at" else v for c, v in r.asDict().items()) for r in out.collect())


def test_sightings_are_forgotten_and_seen_again(spark, tmp_path):
    batches = [[("a", 0, 1, ""), ("b", 1, 2, ""), ("a", 2, 3, "")], [("a", 9, 4, "")], [("a", 10, 5, ""), ("a", 21, 6, ""), ("b", 30, 7, "")], [("c", 100, 8, ""), ("a", 20, 9, "")], [("a", 101, 10, "")]]
    assert streamed(spark, tmp_path, batches, timers.FirstSightings(10 * timers.HOUR)) == [("a", 0.0, 1), ("a", 10.0, 5), ("a", 21.0, 6), ("a", 101.0, 10), ("b", 1.0, 2), ("b", 30.0, 7), ("c", 100.0, 8)]


def test_flash_news_is_demoted_by_timers(spark, tmp_path):
    stages = [("article", 24), ("old", 48), ("gone", 168)]
    batches = [[("f", 0, 1, "flash"), ("n", 1, 2, "")], [("f", 23, 3, "flash"), ("x", 26, 4, "")], [("x", 60, 5, "")], [("f", 200, 6, ""), ("x", 230, 7, "")]]
    got = streamed(spark, tmp_path, batches, timers.NewsStages(["flash"], stages))
    want = [("f", "flash", 0.0), ("f", "article", 24.0), ("f", "old", 48.0), ("f", "gone", 168.0), ("f", "article", 200.0)]
    want += [("n", "article", 1.0), ("n", "old", 49.0), ("n", "gone", 169.0), ("x", "article", 26.0), ("x", "old", 74.0), ("x", "gone", 194.0), ("x", "article", 230.0)]
    assert got == sorted(want)
