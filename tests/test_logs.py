from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from aeroseries.config import REQUIRED_COLUMNS, ScaleLimits
from aeroseries.operators.standardize import validate_rows
from aeroseries.sources.logs import (
    count_files,
    data_rows,
    discover_files,
    discover_month_files,
    load_all,
    load_folders,
    read_log_lines,
    read_logs,
    readable_files,
    rejected_files,
    whole_file_rows,
)

HEADER = "DATE TIME CO_sync CO2_sync CH4_sync"
LINE = "2025-11-01 00:00:0{} 1.{} 400.0 1.8"
WHOLE = ScaleLimits()
SPLIT = ScaleLimits(whole_file_bytes=-1)


def body(*lines, end="\n"):
    return end.join(lines) + end


GOOD = {
    "plain": body(HEADER, LINE.format(0, 0), LINE.format(5, 5)),
    "wide": body("DATE        TIME        CO_sync   CO2_sync    CH4_sync", "  2025-11-01  00:00:00   1.0   400.0   1.8  "),
    "late": body("instrument log", "", "made by hand", HEADER, LINE.format(0, 0)),
    "lower": body(HEADER.lower(), LINE.format(0, 0)),
    "extra": body("X CH4_sync CO2_sync CO_sync TIME DATE Y", "9 1.8 400.0 1.0 00:00:00 2025-11-01 8"),
    "crlf": body(HEADER, LINE.format(0, 0), end="\r\n"),
    "comma": body("DATE,TIME,CO_sync,CO2_sync,CH4_sync", "2025-11-01,00:00:00,1.0,400.0,1.8"),
    "bad number": body(HEADER, "2025-11-01 00:00:00 oops 400.0 1.8"),
    "short line": body(HEADER, "2025-11-01 00:00:00 1.0"),
    "last line open": HEADER + "\n" + LINE.format(0, 0),
    "header at 103": body(*["-"] * 102, HEADER, LINE.format(0, 0)),
    "header at 500": body(*["-"] * 499, HEADER, LINE.format(0, 0)),
    "cr only": body(HEADER, LINE.format(0, 0), end="\r"),
    "a{1}[2]": body(HEADER, LINE.format(0, 0)),
}
BAD = {
    "empty": "",
    "no header": body(LINE.format(0, 0)),
    "missing column": body("DATE TIME CO_sync CO2_sync", "2025-11-01 00:00:00 1.0 400.0"),
    "dates only": body("DATE and TIME of the run", HEADER, LINE.format(0, 0)),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs") / "with space g[1]"
    root.mkdir()
    for name, text in {**GOOD, **BAD, "header only": body(HEADER)}.items():
        (root / f"{name.replace(' ', '_')}.dat").write_bytes(text.encode())
    return str(root)


@pytest.mark.parametrize("limits", [WHOLE, SPLIT], ids=["whole", "split"])
def test_reads_every_readable_form(spark, folder, limits):
    files = discover_files(spark, [folder])
    rows = read_logs(spark, files, limits)
    assert tuple(rows.columns) == (*REQUIRED_COLUMNS, "source_file", "line_no")
    found = {}
    for row in rows.orderBy("source_file", "line_no").collect():
        found.setdefault(row.source_file.rsplit("/", 1)[1][:-4].replace("_", " "), []).append(tuple(row)[:5])
    first = ("2025-11-01", "00:00:00", "1.0", "400.0", "1.8")
    expected = {name: [first] for name in GOOD}
    expected["plain"] = [first, ("2025-11-01", "00:00:05", "1.5", "400.0", "1.8")]
    expected["bad number"] = [("2025-11-01", "00:00:00", "oops", "400.0", "1.8")]
    expected["short line"] = [("2025-11-01", "00:00:00", "1.0", None, None)]
    assert found == expected


@pytest.mark.parametrize("limits", [WHOLE, SPLIT], ids=["whole", "split"])
def test_rejects_files_without_a_complete_header(spark, folder, limits):
    files = discover_files(spark, [folder])
    lines = read_log_lines(spark, files, limits)

    def names(df):
        return {row.path.rsplit("/", 1)[1][:-4].replace("_", " ") for row in df.collect()}

    assert names(rejected_files(files, lines)) == set(BAD) - {"empty"}
    assert names(readable_files(files, lines)) == {*GOOD, "header only"}


@pytest.mark.parametrize("limits", [WHOLE, SPLIT], ids=["whole", "split"])
def test_strict_reading_raises(spark, tmp_path, limits):
    (tmp_path / "x.dat").write_text(BAD["missing column"])
    files = discover_files(spark, [str(tmp_path)])
    with pytest.raises(PySparkException, match="missing required columns"):
        read_logs(spark, files, limits, strict=True).collect()


def test_large_file_in_splits_keeps_line_order(spark, tmp_path):
    lines = [f"2025-11-01 00:00:00.{i:06d} {i}.0 400.0 1.8" for i in range(20_000)]
    (tmp_path / "big.dat").write_text(body("note", HEADER, *lines))
    files = discover_files(spark, [str(tmp_path)])
    rows = read_logs(spark, files, SPLIT)
    ordered = [row.CO_sync for row in rows.orderBy("line_no").collect()]
    assert ordered == [f"{i}.0" for i in range(20_000)]


def make_months(tmp_path):
    for name in ("11/01/a-DataLog_User_Sync.dat", "12/b-DataLog_User_Sync.dat", "extra/c-DataLog_User_Sync.dat"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(GOOD["plain"])
    (tmp_path / "11" / "other.dat").write_text(GOOD["plain"])


def test_discovery_by_month(spark, tmp_path):
    make_months(tmp_path)

    def names(df):
        return sorted(row.path.rsplit("/", 1)[1][0] for row in df.collect())

    root = str(tmp_path)
    assert names(discover_month_files(spark, root, ["11"])) == ["a"]
    assert names(discover_month_files(spark, root, ["12", "13"])) == ["b"]
    assert names(discover_month_files(spark, root)) == ["a", "b"]
    assert names(discover_month_files(spark, root, ["13"])) == []
    assert names(discover_files(spark, [f"{root}/11", f"{root}/missing"])) == ["a", "o"]
    counted = count_files(spark, [f"{root}/11", f"{root}/extra", f"{root}/no"]).collect()
    counts = {row.folder.rsplit("/", 1)[1]: row.files for row in counted}
    assert counts == {"11": 2, "extra": 1, "no": 0}


def test_load_all(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_all(spark, str(tmp_path), ["11"])
    make_months(tmp_path)
    assert load_all(spark, str(tmp_path), ["11"]).count() == 2
    assert load_all(spark, str(tmp_path)).count() == 4
    assert load_folders(spark, [str(tmp_path)]).count() == 8


def test_only_paths_are_shuffled(spark, folder):
    plan = read_logs(spark, discover_files(spark, [folder]))._jdf.queryExecution().executedPlan().toString()
    after_reading = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in after_reading and "Join" not in after_reading


@pytest.mark.parametrize("limits", [WHOLE, SPLIT])
def test_hidden_names_are_read(spark, tmp_path, limits):
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(__import__("pathlib").Path(__file__).parents[1]))
    names = ["c.dat", "_a.dat", ".b.dat", "_sub/d.dat", "_sub/_e f%.dat"]
    (tmp_path / "_sub").mkdir()
    for name in names:
        (tmp_path / name).write_bytes(GOOD["plain"].encode())
    files = discover_files(spark, [str(tmp_path)])
    assert sorted(row.path for row in files.collect()) == sorted(f"file:{tmp_path}/{name}" for name in names)
    rows = read_logs(spark, files, limits)
    assert rows.count() == 2 * len(names) and rows.select("source_file").distinct().count() == len(names)
    assert rejected_files(files, read_log_lines(spark, files, limits)).count() == 0


def test_a_text_is_split_once_whatever_is_filtered(spark):
    text = "a note\n\ndate time co_sync co2_sync ch4_sync\n2025-11-01 00:00:00 1 2 3\n\n2025-11-01 00:00:01 \t4 5 6\r\n"
    texts = spark.createDataFrame([("a.dat", text), ("bad.dat", "nothing\nhere"), ("none.dat", None)], "path string, value string")
    rows = data_rows(whole_file_rows(texts)).where("CO_sync <> '1'")
    assert [(row.source_file, row.line_no, row.CO_sync, row.CH4_sync) for row in rows.collect()] == [("a.dat", 5, "4", "6")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(value") == 1


def test_white_space_goes_without_an_expression(spark):
    row = ["\t2025-11-01\x0b", "\f00:00:00\r", " \n1 ", "2\t", "\r\n3", " a.dat "]
    raw = spark.createDataFrame([row], "DATE string, TIME string, CO_sync string, CO2_sync string, CH4_sync string, source_file string")
    valid = validate_rows(raw)
    assert [tuple(r) for r in valid.collect()] == [("2025-11-01", "00:00:00", "1", "2", "3", "a.dat")]
    assert "regexp_replace" not in valid._jdf.queryExecution().optimizedPlan().toString()
