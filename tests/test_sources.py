"""Files to files, datasets of several tables and generated samples."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from veil import PolicyError, Settings
from veil.operators import audit
from veil.plans.job import _Staging, run_job
from veil.sources import samples
from veil.sources.tables import check_format, list_columns, load_tables, save_tables

PEOPLE = '''name,zip,phone,note,age
"Doe, John",01234,(555) 123-4567,"said ""hi""",30
Jane,98765,555.987.6543,"two
lines",25
Bob,00001,,,
'''
SCHEMA = "name string, zip string, phone string, note string, age int"


@pytest.fixture()
def people(tmp_path):
    path = tmp_path / "people.csv"
    path.write_text(PEOPLE)
    return str(path)


def test_one_csv_file(spark, people):
    table = load_tables(spark, people, schemas={"Sheet1": SCHEMA})["Sheet1"]
    rows = table.collect()
    assert [r["name"] for r in rows] == ["Doe, John", "Jane", "Bob"]
    assert [r["zip"] for r in rows] == ["01234", "98765", "00001"]
    assert rows[0]["note"] == 'said "hi"' and rows[1]["note"] == "two\nlines"
    assert rows[2]["phone"] is None and rows[2]["age"] is None
    assert list_columns(spark, people)["Sheet1"][0] == ("name", "string")
    inferred = load_tables(spark, people)["Sheet1"]
    assert dict(inferred.dtypes)["age"] == "int" and inferred.count() == 3


def test_broken_records_end_the_job(spark, tmp_path):
    for name, text in {"extra": "a,b\n1,x,y\n", "short": "a,b\n1\n"}.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(text)
        for breaks in (True, False):
            table = load_tables(spark, str(path), schemas={"Sheet1": "a string, b string"}, quoted_line_breaks=breaks)
            with pytest.raises(Exception, match="MALFORMED"):
                table["Sheet1"].select("a").collect()


def test_split_files_refuse_quoted_line_breaks(spark, people, tmp_path):
    with pytest.raises(ValueError, match="quoted line breaks"):
        load_tables(spark, people, schemas={"Sheet1": SCHEMA}, quoted_line_breaks=False)
    plain = tmp_path / "plain.csv"
    plain.write_text('a,b\n1,"x ""y"", z"\n2,\n')
    rows = load_tables(spark, str(plain), quoted_line_breaks=False)["Sheet1"].collect()
    assert [tuple(r) for r in rows] == [(1, 'x "y", z'), (2, None)]


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
@pytest.mark.parametrize("block", [40, 700, 1 << 20])
def test_records_are_the_same_at_any_split(spark, tmp_path, block, line_end):
    rng = random.Random(block)
    pieces = ["a", "\n", "\r", "\r\n", '"', ",", " ", "é😀", "", "long text " * 20]
    wanted = []
    (tmp_path / "t.csv").mkdir()
    for part in range(3):
        rows = [(str(rng.randrange(10**6)), "".join(rng.choices(pieces, k=rng.randrange(6))),
                 "".join(rng.choices(pieces, k=rng.randrange(3)))) for _ in range(rng.choice([0, 5, 150]))]
        rows += [("1", "x" + "\n" * 500, "a value over many blocks")]
        with open(tmp_path / "t.csv" / f"part-{part}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator=line_end, quoting=csv.QUOTE_ALL)
            writer.writerows([("a", "b\nb", "c"), *rows])
        wanted += rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        options = {"emptyValue": "", "nullValue": "\x00"}
        found = load_tables(spark, str(tmp_path / "t.csv"), infer_types=False, **options)["Sheet1"]
        assert found.columns == ["a", "b\nb", "c"]
        assert sorted(map(tuple, found.collect())) == sorted(wanted)
        inferred = load_tables(spark, str(tmp_path / "t.csv"), **options)["Sheet1"]
        assert [t for _, t in inferred.dtypes] == ["int", "string", "string"]
        if block < 100:
            assert found.rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_small_blocks_share_tasks(spark, tmp_path):
    rows = [(str(i), 'line "one"\nline, two' * (1 + i % 7)) for i in range(3000)]
    with open(tmp_path / "t.csv", "w", newline="", encoding="utf-8") as out:
        csv.writer(out, quoting=csv.QUOTE_ALL).writerows([("a", "b"), *rows])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        assert spark.read.text(str(tmp_path / "t.csv")).rdd.getNumPartitions() > 300
        found = load_tables(spark, str(tmp_path / "t.csv"), infer_types=False, emptyValue="")["Sheet1"]
        assert 10 < found.rdd.getNumPartitions() < 50
        assert sorted(map(tuple, found.collect())) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_an_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\n')
    with pytest.raises(ValueError, match="not closed"):
        load_tables(spark, str(tmp_path / "t.csv"))


def test_small_and_empty_files(spark, tmp_path):
    (tmp_path / "blank.csv").write_text("\n\na,b\n\n1,x\n")
    (tmp_path / "header.csv").write_text("a,b\n")
    (tmp_path / "unended.csv").write_text("a,b\n1,x")
    found = load_tables(spark, str(tmp_path))
    assert [tuple(r) for r in found["blank"].collect()] == [tuple(r) for r in found["unended"].collect()] == [(1, "x")]
    assert found["header"].columns == ["a", "b"] and found["header"].count() == 0


def test_compressed_tables(spark, tmp_path):
    import gzip

    (tmp_path / "t.csv.gz").write_bytes(gzip.compress(b"a,b\n1,x\n"))
    assert [tuple(r) for r in load_tables(spark, str(tmp_path))["t"].collect()] == [(1, "x")]
    assert list_columns(spark, str(tmp_path))["t"] == [("a", "string"), ("b", "string")]


def test_round_trip_of_a_dataset(spark, tmp_path, sf):
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("nation", "region")}
    for fmt in ("csv", "parquet", "json", "orc"):
        root = str(tmp_path / fmt)
        paths = save_tables(tables, root, fmt)
        assert paths["nation"].endswith("/anonymized_nation")
        back = load_tables(spark, root, schemas={f"anonymized_{t}": df.schema for t, df in tables.items()})
        assert set(back) == {"anonymized_nation", "anonymized_region"}
        for t, df in tables.items():
            assert sorted(map(str, back[f"anonymized_{t}"].collect())) == sorted(map(str, df.collect()))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        save_tables(tables, str(tmp_path / "csv"), "csv")


def test_partitioned_output(spark, tmp_path, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    save_tables({"nation": nation}, str(tmp_path), partition_by={"nation": ["n_regionkey"]}, prefix="")
    assert (tmp_path / "nation" / "n_regionkey=0").is_dir()


def test_refusals(spark, people, tmp_path, sf):
    with pytest.raises(FileNotFoundError):
        load_tables(spark, str(tmp_path / "missing.csv"))
    (tmp_path / "book.xlsx").write_text("x")
    (tmp_path / "notes.txt").write_text("x")
    for name in ("book.xlsx", "notes.txt"):
        with pytest.raises(ValueError, match="unsupported"):
            load_tables(spark, str(tmp_path / name))
    with pytest.raises(ValueError, match="unsupported"):
        check_format("xlsx")
    assert check_format(".CSV") == "csv"
    with pytest.raises(PolicyError):
        load_tables(spark, sf, tables=["nation", "nope"])
    assert list(load_tables(spark, sf, tables=["nation"])) == ["nation"]


def test_job(spark, people, tmp_path):
    out = str(tmp_path / "out")
    policy = '{"Sheet1": {"name": "hash", "phone": "anonymize_phone", "zip": "remove", "age": "scramble"}}'
    report = run_job(spark, people, out, policy, Settings("s"), output_format="csv", schemas={"Sheet1": SCHEMA})
    lines = {r["column"]: r for r in report.collect()}
    assert lines["zip"]["kind"] == "drop" and "scramble" in lines["age"]["note"]
    assert lines["name"]["output"] == f"{out}/anonymized_Sheet1"
    back = spark.read.csv(f"{out}/anonymized_Sheet1", header=True, escape='"', multiLine=True)
    assert back.columns == ["name", "phone", "note", "age"] and back.count() == 3
    assert back.filter("length(name) = 64").count() == 3
    assert "two\nlines" in [r["note"] for r in back.collect()]


def test_job_finds_errors_before_it_writes(spark, people, tmp_path):
    out = tmp_path / "out"
    bad = [
        (dict(output_format="xlsx"), {"Sheet1": {"name": "hash"}}, ValueError),
        ({}, {"Sheet1": {"nope": "hash"}}, PolicyError),
        ({}, {"Other": {"name": "hash"}}, PolicyError),
        ({}, {}, PolicyError),
        (dict(tables=["Other"]), {"Sheet1": {}}, PolicyError),
        (dict(links=[("Sheet1.name", "Sheet1.zip")]), {"Sheet1": {"name": "hash"}}, PolicyError),
    ]
    for extra, policy, error in bad:
        with pytest.raises(error):
            run_job(spark, people, str(out), policy, Settings("s"), **extra)
    assert not out.exists()


def test_untouched_tables_are_reported(spark, sf, tmp_path):
    report = run_job(spark, sf, str(tmp_path / "o"), {"nation": {"n_name": "hash"}}, Settings("s"), tables=["nation", "region"])
    notes = {r["table"]: r["note"] for r in report.collect()}
    assert notes == {"nation": "", "region": "no policy, passed through"}
    assert spark.read.parquet(str(tmp_path / "o" / "anonymized_region")).count() == 5


def test_samples(spark, settings):
    data = samples.sample_dataset(spark, settings)
    assert {t: df.count() for t, df in data.items()} == {"Staff": 100, "Employees": 50, "Customers": 100, "Transactions": 200}
    staff = data["Staff"].orderBy("EmployeeID").collect()
    assert [r["EmployeeID"] for r in staff] == list(range(1, 101))
    assert staff[0]["HireDate"] == "2020-01-01" and staff[-1]["HireDate"] == "2023-12-31"
    assert all(22 <= r["Age"] < 65 and 40000 <= r["Salary"] < 150000 for r in staff)
    assert data["Staff"].filter(~F.col("Phone").rlike(r"^\([2-9][0-9]{2}\) [2-9][0-9]{2}-[0-9]{4}$")).isEmpty()
    assert data["Staff"].filter(~F.col("SSN").rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")).isEmpty()
    assert data["Staff"].filter(~F.col("Email").rlike(r"^[a-z]+\.[a-z]+[0-9]+@[a-z]+\.com$")).isEmpty()
    links = audit.links(data["Transactions"], "CustomerID", data["Customers"], "CustomerID").first()
    assert links["rows"] == 200 and links["orphan_rows"] == 0
    assert len(data["Employees"].columns) == 13 and len(data["Customers"].columns) == 12
    assert len(data["Staff"].columns) == 15 and len(data["Transactions"].columns) == 9
    larger = samples.staff(spark, settings, 300).filter("EmployeeID <= 100").orderBy("EmployeeID").collect()
    assert [r["Name"] for r in larger] == [r["Name"] for r in staff]


def test_sample_files(spark, settings, tmp_path):
    save_tables(samples.sample_dataset(spark, settings), str(tmp_path), "csv", prefix="")
    back = load_tables(spark, str(tmp_path))
    assert back["Customers"].count() == 100 and set(back) == {"Staff", "Employees", "Customers", "Transactions"}


def _results(folder):
    return sorted(p.name for p in folder.iterdir()) if folder.exists() else []


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (source / "b.csv").write_text("id,name\n1,x\n2\n")
    schemas = {t: "id int, name string" for t in "ab"}
    policy = {"a": {"name": {"method": "k_anonymity", "options": {"k": 1}}}, "b": {"name": "hash"}}
    with pytest.raises(Exception, match="MALFORMED"):
        run_job(spark, str(source), str(out), policy, Settings("s"), schemas=schemas)
    assert _results(out) == []
    (source / "b.csv").write_text("id,name\n1,x\n2,z\n")
    run_job(spark, str(source), str(out), policy, Settings("s"), schemas=schemas)
    assert _results(out) == ["anonymized_a", "anonymized_b"]
    with pytest.raises(FileExistsError, match="anonymized_a"):
        run_job(spark, str(source), str(out), policy, Settings("s"), schemas=schemas)
    # Overwriting keeps the old tables until all new ones are there.
    (source / "a.csv").write_text("id,name\n7,new\n")
    (source / "b.csv").write_text("id,name\n1,x,y\n")
    with pytest.raises(Exception, match="MALFORMED"):
        run_job(spark, str(source), str(out), policy, Settings("s"), schemas=schemas, mode="overwrite")
    assert _results(out) == ["anonymized_a", "anonymized_b"]
    assert spark.read.parquet(str(out / "anonymized_a")).count() == 2
    (source / "b.csv").write_text("id,name\n1,x\n")
    run_job(spark, str(source), str(out), policy, Settings("s"), schemas=schemas, mode="overwrite")
    assert _results(out) == ["anonymized_a", "anonymized_b"]
    assert [tuple(r) for r in spark.read.parquet(str(out / "anonymized_a")).collect()] == [(7, "new")]


def test_moves_are_undone_if_one_fails(spark, tmp_path):
    staging = _Staging(spark, str(tmp_path))
    for name in ("old", "new"):
        (tmp_path / staging.folder.rsplit("/", 1)[1] / name).mkdir(parents=True)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "kept").write_text("x")
    with pytest.raises(Exception, match="missing|moved"):
        staging.publish({"a": f"{staging.folder}/new", "b": f"{staging.folder}/missing"},
                        {"a": str(tmp_path / "t"), "b": str(tmp_path / "u")})
    assert (tmp_path / "t" / "kept").exists() and not (tmp_path / "u").exists()
    staging.discard()
    assert _results(tmp_path) == ["t"]


@pytest.mark.parametrize("change", [
    {"policy": {"nation": {"n_name": {"method": "k_anonymity"}}, "region": {"r_name": "perturb"}}},
    {"policy": {"region": {"r_name": {"method": "mask", "where": "nothing > 1"}}}},
    {"links": [("nation.n_regionkey", "region.r_name")], "policy": {"nation": {"n_regionkey": "hash"}, "region": {"r_name": "hash"}}},
    {"links": [("nation.n_key", "region.r_regionkey")]}, {"mode": "append"},
])
def test_bad_jobs_end_before_anything_runs(spark, sf, tmp_path, change):
    request = {"policy": {"nation": {"n_name": "hash"}}, "tables": ["nation", "region"], **change}
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    with pytest.raises(PolicyError):
        run_job(spark, sf, str(tmp_path / "o"), settings=Settings("s"), **request)
    assert not (tmp_path / "o").exists()
    assert len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before) <= 2  # file schemas
