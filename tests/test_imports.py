from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from aeroseries.config import QcConfig
from aeroseries.operators.quality_control import apply_quality_control
from aeroseries.schema import QC_COLUMNS, STANDARD_COLUMNS
from aeroseries.sources import catalog
from aeroseries.sources.catalog import Manifest, file_spans, new_files, overlapping_files
from aeroseries.sources.logs import discover_files
from aeroseries.sources.store import Cell, GasStore
from aeroseries.streaming.imports import import_folders, import_stream, stream_folders

HEADER = "DATE TIME CO_sync CO2_sync CH4_sync"


def write_log(path, start, count, step=timedelta(minutes=10), co=1.0, mtime=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    times = [start + i * step for i in range(count)]
    lines = [f"{t:%Y-%m-%d %H:%M:%S} {co + i % 7 / 10} {400 + i % 5}.0 1.9" for i, t in enumerate(times)]
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    if mtime:
        os.utime(path, (mtime, mtime))


@pytest.fixture
def site(spark, tmp_path):
    folder = tmp_path / "logs"
    write_log(folder / "a.dat", datetime(2025, 11, 1), 100)
    write_log(folder / "b.dat", datetime(2025, 11, 29), 600)
    (folder / "bad.dat").write_text("nothing here\n")
    return GasStore(spark, str(tmp_path / "out")), Manifest(spark, str(tmp_path / "manifest")), folder


def content(store):
    return sorted(tuple(row) for row in store.raw().drop("source_file").collect())


def staged_folders(spark):
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sorted(name for name in os.listdir(root) if name.startswith("staged-") and not name.endswith(".crc"))


def test_import_is_incremental(spark, site):
    store, manifest, folder = site
    first = import_folders(store, manifest, [str(folder)])
    assert (first.new_files, first.skipped_files, first.row_count) == (2, 0, 700)
    assert first.last_sync == manifest.last_sync() is not None
    assert store.raw().count() == 700 and store.hourly_exists()
    before = content(store)

    again = import_folders(store, manifest, [str(folder)])
    assert (again.new_files, again.skipped_files, again.row_count) == (0, 2, 0)
    assert content(store) == before

    forced = import_folders(store, manifest, [str(folder)], force_reimport=True)
    assert forced.new_files == 2 and content(store) == before

    write_log(folder / "c.dat", datetime(2025, 12, 20), 50)
    more = import_folders(store, manifest, [str(folder)])
    assert (more.new_files, more.skipped_files, more.row_count) == (1, 2, 50)
    assert store.raw().count() == 750
    hours = store.raw().select("hour_start_ist").distinct().count()
    assert store.hourly().count() == hours


def test_changed_file_takes_the_place_of_its_rows(spark, site):
    store, manifest, folder = site
    import_folders(store, manifest, [str(folder)])
    write_log(folder / "a.dat", datetime(2026, 1, 5), 10, co=3.0, mtime=2_000_000_000)
    summary = import_folders(store, manifest, [str(folder)])
    assert summary.new_files == 1
    assert store.raw().where("source_file LIKE '%a.dat'").count() == 10
    assert store.raw().count() == 610
    fresh = new_files(discover_files(spark, [str(folder)]), manifest.read())
    assert [row.path.rsplit("/", 1)[1] for row in fresh.collect()] == ["bad.dat"]


def test_month_left_without_rows_is_dropped(spark, tmp_path):
    store, manifest = GasStore(spark, str(tmp_path / "out")), Manifest(spark, str(tmp_path / "manifest"))
    log = tmp_path / "logs" / "a.dat"
    write_log(log, datetime(2024, 5, 1), 30)
    import_folders(store, manifest, [str(log.parent)])
    write_log(log, datetime(2025, 7, 1), 20, mtime=2_000_000_000)
    import_folders(store, manifest, [str(log.parent)])
    assert store.raw().select("year", "month").distinct().collect() == [(2025, 7)]
    assert store.hourly().select("year").distinct().collect() == [(2025,)]


def test_batches_do_not_change_the_result(spark, site, tmp_path):
    store, manifest, folder = site
    write_log(folder / "c.dat", datetime(2025, 11, 30, 2), 300, co=2.0)
    import_folders(store, manifest, [str(folder)])
    other = GasStore(spark, str(tmp_path / "other"))
    import_folders(other, Manifest(spark, str(tmp_path / "other_manifest")), [str(folder)], batch_size=1)
    assert content(other) == content(store)


def test_stream_gives_the_same_store(spark, site, tmp_path):
    store, manifest, folder = site
    import_folders(store, manifest, [str(folder)])
    streamed = GasStore(spark, str(tmp_path / "streamed"))
    entries = Manifest(spark, str(tmp_path / "stream_manifest"))
    checkpoint = str(tmp_path / "stream_state")
    import_stream(streamed, entries, str(folder), checkpoint, files_per_trigger=2)
    assert content(streamed) == content(store)
    assert entries.read().count() == 2
    write_log(folder / "c.dat", datetime(2025, 12, 20), 50)
    import_stream(streamed, entries, str(folder), checkpoint, files_per_trigger=2)
    assert streamed.raw().count() == 750 and entries.read().count() == 3


def test_stream_takes_files_older_than_those_before(spark, tmp_path):
    folder = tmp_path / "logs"
    store, manifest = GasStore(spark, str(tmp_path / "out")), Manifest(spark, str(tmp_path / "manifest"))
    write_log(folder / "new.dat", datetime(2025, 11, 20), 10, mtime=1_763_600_000)
    import_stream(store, manifest, str(folder), str(tmp_path / "checkpoint"))
    write_log(folder / "old.dat", datetime(2025, 11, 1), 10, mtime=1_763_600_000 - 30 * 86_400)
    import_stream(store, manifest, str(folder), str(tmp_path / "checkpoint"))
    assert store.raw().count() == 20


def test_stream_folders_hands_on_readable_files_only(spark, site):
    _, _, folder = site
    handed = [row.path for _, files, _ in stream_folders(spark, [str(folder)]) for row in files.collect()]
    assert len(handed) == 2 and not any(path.endswith("bad.dat") for path in handed)


def test_batches_of_files(spark, site):
    _, manifest, folder = site
    batches = list(stream_folders(spark, [str(folder)], manifest.read(), batch_size=2))
    assert [files.count() for _, files, _ in batches] == [2, 0]  # the last batch holds only a file that cannot be read
    assert all(skipped == 0 for _, _, skipped in batches)


def test_no_staged_tables_are_left(spark, site):
    store, manifest, folder = site
    before = staged_folders(spark)
    import_folders(store, manifest, [str(folder)])
    assert staged_folders(spark) == before


TIGHT = QcConfig(point_spike_z=3.0, hourly_spike_z=1.5, sustained_shift_min_hours=1)


def write_noise(path, start, hours, seed, mtime=None):
    """Thirteen readings an hour, some hours shifted, some readings far off."""
    rng = random.Random(seed)
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [HEADER]
    for h in range(hours):
        shift = 6.0 if rng.random() < 0.08 else 0.0
        for i in range(13):
            at = start + timedelta(hours=h, minutes=4 * i)
            far = 50.0 if rng.random() < 0.01 else 0.0
            values = (round(rng.gauss(centre + shift, 1) + far, 3) for centre in (10, 400, 20))
            lines.append(f"{at:%Y-%m-%d %H:%M:%S} " + " ".join(map(str, values)))
    path.write_text("\n".join(lines) + "\n")
    if mtime:
        os.utime(path, (mtime, mtime))


def months_in_order(spark, tmp_path, names, config=TIGHT):
    """A store that the named folders were imported into one after the other."""
    label = "-".join(names)
    store, manifest = GasStore(spark, str(tmp_path / label)), Manifest(spark, str(tmp_path / f"{label}-manifest"))
    for name in names:
        import_folders(store, manifest, [str(tmp_path / part) for part in name.split("+")], config)
    return store


def test_import_order_does_not_matter(spark, tmp_path):
    write_noise(tmp_path / "nov" / "n.dat", datetime(2025, 11, 25), 150, 1)
    write_noise(tmp_path / "dec" / "d.dat", datetime(2025, 12, 1, 6), 60, 2)
    fresh = months_in_order(spark, tmp_path, ["nov+dec"])
    whole = content(fresh)
    assert content(months_in_order(spark, tmp_path, ["nov", "dec"])) == whole
    assert content(months_in_order(spark, tmp_path, ["dec", "nov"])) == whole
    # The same as quality control of all readings at once, with flags of every kind.
    readings = fresh.raw().select(*STANDARD_COLUMNS, "series_id")
    expected = apply_quality_control(readings, TIGHT, ["series_id"]).select(*QC_COLUMNS)
    assert sorted(map(tuple, fresh.raw().select(*QC_COLUMNS).collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    kinds = ("point_spike", "hourly_spike", "sustained_shift")
    flagged = fresh.raw().agg(*(F.count_if(f"co_sync_flag_{kind}").alias(kind) for kind in kinds)).first()
    assert all(flagged)


def test_only_cells_whose_flags_move_are_written_again(spark, tmp_path):
    write_noise(tmp_path / "old" / "o.dat", datetime(2025, 6, 1), 24 * 20, 1)
    write_noise(tmp_path / "nov" / "n.dat", datetime(2025, 11, 20), 24 * 12, 2)
    store = months_in_order(spark, tmp_path, ["old", "nov"])
    manifest = Manifest(spark, str(tmp_path / "old-nov-manifest"))
    files = lambda month: {f for f in store.raw().inputFiles() if f"month={month}/" in f}
    before = {month: files(month) for month in (6, 11, 12)}
    write_noise(tmp_path / "dec" / "d.dat", datetime(2025, 12, 2), 24, 3)
    import_folders(store, manifest, [str(tmp_path / "dec")], TIGHT)
    assert files(6) == before[6] and files(11) != before[11] and files(12) != before[12]


def test_replaced_file_brings_back_what_it_displaced(spark, tmp_path):
    folder = tmp_path / "logs"
    store, manifest = GasStore(spark, str(tmp_path / "out")), Manifest(spark, str(tmp_path / "manifest"))
    write_log(folder / "a.dat", datetime(2025, 11, 1), 10, co=1.0)
    write_log(folder / "b.dat", datetime(2025, 11, 1), 10, co=2.0)
    import_folders(store, manifest, [str(folder)])
    assert store.raw().count() == 10 and store.raw().where("source_file LIKE '%b.dat'").count() == 0
    write_log(folder / "a.dat", datetime(2025, 12, 5), 10, co=3.0, mtime=2_000_000_000)
    import_folders(store, manifest, [str(folder)])
    assert store.raw().count() == 20
    assert {r.source_file.rsplit("/")[-1]: r["count"] for r in store.raw().groupBy("source_file").count().collect()} == {"a.dat": 10, "b.dat": 10}


def test_instruments_on_one_clock_keep_their_rows(spark, tmp_path):
    folder = tmp_path / "logs"
    for i, name in enumerate(("north", "south")):
        write_log(folder / f"station-{name}" / "a.dat", datetime(2025, 11, 1), 20, co=1.0 + i)
    store = GasStore(spark, str(tmp_path / "out"), series_buckets=4)
    import_folders(store, Manifest(spark, str(tmp_path / "manifest")), [str(folder)], series_pattern=r"station-(\w+)/")
    assert store.raw().count() == 40
    assert {(r.series_id, r["count"]) for r in store.raw().groupBy("series_id").count().collect()} == {("north", 20), ("south", 20)}
    north = store.load_range("2025-11-01", "2025-11-02", ["co_sync_raw"], series="north")
    assert north.count() == 20 and north.agg(F.max("co_sync_raw")).first()[0] < 1.9
    assert "series_bucket" in north._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("]")[0]
    assert store.hourly().groupBy("hour_start_ist").count().where("count = 2").count() == store.hourly().count() / 2
    assert store.load_hourly_range("2025-11-01", "2025-11-01", "south").count() == 4
    with pytest.raises(ValueError, match="series buckets"):
        GasStore(spark, str(tmp_path / "out"), series_buckets=2)
    assert GasStore(spark, str(tmp_path / "out")).series_buckets == 4


def test_a_failed_batch_does_the_rest_when_it_runs_again(spark, tmp_path, monkeypatch):
    write_noise(tmp_path / "nov" / "n.dat", datetime(2025, 11, 27), 90, 1)
    write_noise(tmp_path / "dec" / "d.dat", datetime(2025, 12, 1), 40, 2)
    whole = content(months_in_order(spark, tmp_path, ["nov+dec"]))
    store = months_in_order(spark, tmp_path, ["dec"])
    manifest = Manifest(spark, str(tmp_path / "dec-manifest"))
    write = GasStore.replace_cells

    def fail(self, df, path, *rest):
        if path == self.statistics_path:
            raise RuntimeError("lost")
        write(self, df, path, *rest)

    # Readings are written, the tables behind their flags are not.
    monkeypatch.setattr(GasStore, "replace_cells", fail)
    with pytest.raises(RuntimeError, match="lost"):
        import_folders(store, manifest, [str(tmp_path / "nov")], TIGHT)
    monkeypatch.setattr(GasStore, "replace_cells", write)
    import_folders(store, manifest, [str(tmp_path / "nov")], TIGHT)
    assert content(store) == whole


def test_readings_saved_without_files_are_taken_along(spark, site, tmp_path):
    store, manifest, folder = site
    import_folders(store, manifest, [str(folder)])
    whole = content(store)
    other = GasStore(spark, str(tmp_path / "other"))
    other.save_batch(store.raw().drop("year", "month", "series_bucket"))
    write_log(folder.parent / "more" / "c.dat", datetime(2025, 12, 20), 50)
    import_folders(other, Manifest(spark, str(tmp_path / "m2")), [str(folder.parent / "more")])
    assert other.raw().count() == 750 and other.cells_of(other.statistics_path) == {Cell(2025, 11), Cell(2025, 12)}
    assert len(whole) == 700


def test_stream_sees_every_name(spark, tmp_path):
    folder = tmp_path / "logs"
    for i, name in enumerate(("_a.dat", ".b.dat", "_sub/d.dat", "c.dat")):
        write_log(folder / name, datetime(2025, 11, 1 + i), 10)
    store, manifest = GasStore(spark, str(tmp_path / "out")), Manifest(spark, str(tmp_path / "manifest"))
    import_stream(store, manifest, str(folder), str(tmp_path / "checkpoint"), files_per_trigger=3)
    assert store.raw().count() == 40 and manifest.read().count() == 4


def test_manifest_merges_its_entries(spark, site, tmp_path):
    _, _, folder = site
    manifest = Manifest(spark, str(tmp_path / "entries"), merge_after=3)
    files = discover_files(spark, [str(folder)])
    for _ in range(5):
        manifest.mark_processed(files)
    names = sorted(name for name in os.listdir(tmp_path / "entries"))
    assert names == ["added=000000000006", "merged=000000000005"]
    assert new_files(files, manifest.read()).count() == 0 and manifest.read().count() == 6
    manifest.mark_processed(files)
    assert manifest.last_sync() == manifest.read().agg(F.max("processed_at")).first()[0]


def test_overlapping_files(spark, tmp_path):
    rows = [("a", "x", 1, 10), ("b", "x", 10, 90), ("c", "x", 11, 40), ("d", "y", 1, 90), ("e", "x", 91, 99)]
    day = lambda n: datetime(2025, 1, 1) + timedelta(days=n)
    readings = [(f"{p}.dat", s, day(at)) for p, s, first, last in rows for at in (first, last)]
    spans = file_spans(spark.createDataFrame(readings, "source_file string, series_id string, datetime_utc timestamp_ntz"))
    found = {(r.path[0], r.beside[0]) for r in overlapping_files(spans, spans).collect()}
    assert found == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}


def test_overlapping_files_meet_once_whatever_the_months_they_share(spark):
    draw = random.Random(5)
    rows = []
    for number in range(60):
        first = datetime(2000, 1, 1) + timedelta(days=draw.choice([0, draw.randrange(4000)]))
        rows.append((f"{number}.dat", draw.choice("xy"), first, first + timedelta(days=draw.choice([0, 20, 3000])), 1))
    spans = spark.createDataFrame(rows, "path string, series_id string, first_utc timestamp_ntz, last_utc timestamp_ntz, rows long")
    entries = spans.where("path LIKE '%1.dat' OR path LIKE '2%'")
    for left in (spans, entries):
        found = overlapping_files(left, spans)
        kept = {row.path for row in left.collect()}
        expected = [
            (a[0], b[0]) for a in rows for b in rows
            if a[0] in kept and a[0] != b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]
        ]
        assert sorted(map(tuple, found.collect())) == sorted(expected)
        # Pairs come out of the joins as they are: there are no copies that a shuffle would have to remove.
        above = found._jdf.queryExecution().executedPlan().toString().split("Join")[0]
        assert "Aggregate" not in above and "Exchange" not in above


def shuffled_rows(found):
    """Rows that the shuffles of a frame which was collected wrote."""
    rows, plans = 0, [found._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(plan.plan())
        elif kind != "ReusedExchangeExec":
            if kind == "ShuffleExchangeExec":
                rows += plan.metrics().apply("shuffleRecordsWritten").value()
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return rows


def test_overlapping_files_are_shuffled_once_whatever_the_months_they_touch(spark):
    start = datetime(2000, 1, 1)
    rows = [(f"{n}.dat", "x", start + timedelta(days=n), start + timedelta(days=3650 + n), 1) for n in range(200)]
    spans = spark.createDataFrame(rows, "path string, series_id string, first_utc timestamp_ntz, last_utc timestamp_ntz, rows long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = overlapping_files(spans, spans)
        assert len(found.collect()) == 200 * 199
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < shuffled_rows(found) <= 4 * 200


@pytest.mark.parametrize("per_cell", [1, 7])
def test_overlapping_files_of_many_cells(spark, monkeypatch, per_cell):
    monkeypatch.setattr(catalog, "FILES_PER_CELL", per_cell)
    draw = random.Random(per_cell)
    rows = [("none.dat", "x", None, None, 0), ("old.dat", "y", datetime(1, 1, 1), datetime(2000, 1, 20), 1)]
    for number in range(60):
        first = datetime(2000, 1, 1) + timedelta(minutes=draw.choice([0, 20 * draw.randrange(4), draw.randrange(60_000)]))
        rows.append((f"{number}.dat", draw.choice("xy"), first, first + timedelta(minutes=draw.choice([0, 20, 600, 50_000])), 1))
    spans = spark.createDataFrame(rows, "path string, series_id string, first_utc timestamp_ntz, last_utc timestamp_ntz, rows long")
    entries = spans.where("path LIKE '%1.dat' OR path LIKE '2%'")
    for left, right in ((spans, spans), (entries, spans), (spans, entries), (spans.unionAll(spans), spans)):
        kept = [{row.path for row in frame.collect()} for frame in (left, right)]
        expected = [
            (a[0], b[0]) for a in rows for b in rows
            if a[0] in kept[0] and b[0] in kept[1] and a[0] != b[0] and a[1] == b[1]
            and a[2] and b[2] and a[2] <= b[3] and b[2] <= a[3]
        ]
        assert sorted(map(tuple, overlapping_files(left, right).collect())) == sorted(expected)
