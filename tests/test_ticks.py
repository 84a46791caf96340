"""The tick source: frames, reconnects, pages that come later, restarts; and keyed state with timers."""

import datetime as dt
import json
import os

import pytest

from tessera.sources import ticks
from tessera.streaming import streams

T = "2024-01-05T14:30:00.125Z"


def test_frames():
    at = dt.datetime(2024, 1, 5, 14, 30, 0, 125000, dt.UTC)
    good = {"T": "t", "S": "A", "p": 1.5, "s": 2, "t": T}
    assert ticks.prints(json.dumps([good])) == [("A", 1.5, 2.0, at)]
    assert ticks.prints(json.dumps([{"T": "success", "msg": "authenticated"}, {"T": "t", "S": "A"}, {"T": "t", "p": 1}, {"T": "q", "S": "A", "p": 1}, 3])) == []
    assert ticks.prints(json.dumps([good | {"t": "no time"}, {"T": "t", "S": "B", "p": 3}])) == [("A", 1.5, 2.0, None), ("B", 3.0, 0.0, None)]
    assert ticks.prints("no json") == ticks.prints("{}") == ticks.prints("[]") == []
    with pytest.raises(ConnectionError, match="slow client"):
        ticks.prints(json.dumps([good, {"T": "error", "code": 407, "msg": "slow client"}]))


def serve(root, feed, page, *frames):
    os.makedirs(f"{root}/feed={feed}/page={page}", exist_ok=True)
    with open(f"{root}/feed={feed}/page={page}/part-0.txt", "w") as f:
        f.write("\n".join(json.dumps(x) for x in frames))


def tick(symbol, price):
    return [{"T": "t", "S": symbol, "p": price, "s": 1, "t": T}]


class Flaky(ticks.PageFolder):
    """A service that breaks in the middle of every page, the first two times it is asked for it."""

    def frames(self, feed, page):
        mark = f"{self.root}/../asked-{feed}-{page}-"
        n = sum(os.path.exists(f"{mark}{i}") for i in range(9))
        open(f"{mark}{n}", "w").close()
        lines = list(super().frames(feed, page))
        if n < 2:
            yield from lines[: len(lines) // 2]
            raise ConnectionError("lost")
        yield from lines


def stream(spark, root, **options):
    spark.dataSource.register(ticks.TickSource)
    return spark.readStream.format("tessera_ticks").option("path", str(root)).options(pause="0.01", **options).load()


def seen(df):
    return sorted((r["feed"], r["page"], r["symbol"], r["price"]) for r in df.collect())


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    root, out = tmp_path / "service", str(tmp_path / "out")
    serve(root, 0, 0, tick("A", 1), tick("A", 2))
    serve(root, 0, 2, tick("A", 9))  # page 1 is not there yet, so 2 is not read either
    assert seen(streams.run_to_end(stream(spark, root), out)) == [(0, 0, "A", 1), (0, 0, "A", 2)]
    assert len(seen(streams.run_to_end(stream(spark, root), out))) == 2  # nothing new
    serve(root, 0, 1, tick("A", 3))
    serve(root, 7, 0, tick("B", 1))  # a new feed
    want = [(0, 0, "A", 1), (0, 0, "A", 2), (0, 1, "A", 3), (0, 2, "A", 9), (7, 0, "B", 1)]
    assert seen(streams.run_to_end(stream(spark, root), out)) == want


def test_reconnects_read_a_page_anew(spark, tmp_path):
    root = tmp_path / "service"
    for page in range(3):
        serve(root, 1, page, *[tick(f"S{i}", page) for i in range(4)])
    got = seen(streams.run_to_end(stream(spark, root, client="tests.test_ticks:Flaky", pages="1"), str(tmp_path / "out")))
    assert got == [(1, page, f"S{i}", page) for page in range(3) for i in range(4)]


def test_pages_in_blocks(spark, tmp_path):
    """Blocks are read as single pages are, over restarts; what follows a gap waits; no page has a folder of its own."""
    root, out = str(tmp_path / "service"), str(tmp_path / "out")

    def told(feed, span, pages):
        rows = [(feed, span, p, json.dumps(tick(f"S{i}", p))) for p in pages for i in range(2)]
        spark.createDataFrame(rows, "feed int, span string, page long, value string").write.mode("append").partitionBy("feed", "span").parquet(root)

    client = {"client": "tessera.sources.ticks:PageBlocks", "pages": "3"}
    want = lambda *pages: sorted((1, p, f"S{i}", p) for p in pages for i in range(2))
    told(1, "0-4", [0, 1, 3])
    told(1, "8-9", [8])
    assert seen(streams.run_to_end(stream(spark, root, **client), out)) == want(0, 1, 3)
    told(1, "4-8", [5, 7])
    assert seen(streams.run_to_end(stream(spark, root, **client), out)) == want(0, 1, 3, 5, 7, 8)


def test_folders_of_the_service_do_not_grow_with_pages(spark, tmp_path, monkeypatch):
    from tessera.plans import streams as plans

    rows = spark.range(40_000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts", "id % 7 AS user_id", "'view' AS event_type", "1.5D AS value", "'' AS props")
    rows.where("event_id < 3000 or event_id >= 36000").write.parquet(str(tmp_path / "events.parquet"))  # pages without events between
    monkeypatch.setattr(plans.scratch, "folder", lambda *_: str(tmp_path / "scratch"))
    got = plans.sc21_ticks(spark, str(tmp_path))
    assert got.count() == got.distinct().count() == 7000
    folders = [d for d, _, _ in os.walk(tmp_path / "scratch" / "service")]
    assert len(folders) <= 1 + 4 + 4 * 2


def test_a_task_fails_when_reconnects_run_out(tmp_path):
    serve(tmp_path, 0, 0, [{"T": "error", "msg": "no", "code": 1}])
    reader = ticks.TickReader({"path": str(tmp_path), "retries": "1", "pause": "0"})
    with pytest.raises(ConnectionError):
        list(reader.read(ticks.Pages(0, 0, 1)))


def test_offsets_are_cut_into_tasks(tmp_path):
    reader = ticks.TickReader({"path": str(tmp_path), "pages": "10"})
    cut = reader.partitions({"0": 5}, {"0": 27, "3": 4, "4": 0})
    assert [(p.feed, p.first, p.end) for p in cut] == [(0, 5, 15), (0, 15, 25), (0, 25, 27), (3, 0, 4)]
    assert reader.initialOffset() == {} and reader.latestOffset() == {}


EVENTS = "event_id long, ts timestamp, user_id long, value double"


def at(day, hour, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def entered(spark, tmp_path):
    source = streams.stamped(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")))
    with streams.rocksdb(spark):
        found = streams.run_to_end(streams.entered(streams.ticks(source, "user_id", "value"), "user_id", 20.0, 3), str(tmp_path / "out"))
    return sorted((r["user_id"], r["at"].strftime("%d %H"), r["kind"]) for r in found.collect())


def test_newly_entered_over_restarts_and_late_rows(spark, tmp_path):
    arrive(spark, str(tmp_path / "in"), [(1, at(1, 0, 5), 1, 30.0), (2, at(1, 0, 9), 1, 10.0), (3, at(1, 0, 10), 2, 30.0), (4, at(1, 1, 5), 1, 30.0), (5, at(1, 3), 9, 1.0)])
    # user 1's last reading of the first hour is bad; those of 1:00 to 2:00 are closed by the row at 3:00
    assert entered(spark, tmp_path) == [(1, "01 02", "entered"), (2, "01 01", "entered")]
    arrive(spark, str(tmp_path / "in"), [(6, at(1, 0, 30), 1, 90.0), (7, at(1, 3, 1), 1, 5.0), (8, at(1, 9), 9, 1.0)])
    # the row of 0:30 is too late; user 1 falls, user 2's reading expires after three hours
    now = [(1, "01 02", "entered"), (1, "01 04", "fell"), (2, "01 01", "entered"), (2, "01 04", "expired")]
    assert entered(spark, tmp_path) == sorted(now)
    arrive(spark, str(tmp_path / "in"), [(9, at(1, 10), 2, 21.0), (10, at(1, 14, 30), 2, 25.0), (11, at(1, 20), 9, 1.0)])
    # in again; a gap of more than three hours between two readings of one batch ends the membership, too
    now += [(2, "01 11", "entered"), (2, "01 14", "expired"), (2, "01 15", "entered"), (2, "01 18", "expired")]
    assert entered(spark, tmp_path) == sorted(now)


def test_polls_take_turns(spark, tmp_path):
    rows = [(i, at(1, 0, 0) + dt.timedelta(seconds=97 * i), i % 8, float(i)) for i in range(400)]
    arrive(spark, str(tmp_path / "in"), rows)
    out = streams.run_to_end(streams.polled(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), "user_id", "value", 4, 300), str(tmp_path / "out")).collect()
    for r in out:
        assert int(r["polled_at"].replace(tzinfo=dt.UTC).timestamp()) // 300 % 4 == r["user_id"] % 4  # whose turn it is
        found = [x for x in rows if x[2] == r["user_id"] and r["polled_at"] - dt.timedelta(seconds=1200) <= x[1] < r["polled_at"]]
        assert r["n"] == len(found) and r["latest"] == found[-1][3]
    assert sum(r["n"] for r in out) > 300
