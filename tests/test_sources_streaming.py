"""Sources, sinks and the streaming extension."""

import pytest
from pyspark.sql import functions as F

from vitalspark.cohort import CohortSpec
from vitalspark.operators.km import kaplan_meier
from vitalspark.sources import tables
from vitalspark.streaming.incremental import curve_of_counts, start_counts


def rows(spark):
    return spark.createDataFrame([(k, f"c{k % 2}", float(k % 5), k % 3 % 2, k % 2) for k in range(40)], "patient_id long, center string, time double, event int, treated int")


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_centres_round_trip(spark, tmp_path, format):
    df = rows(spark)
    tables.write_centers(df, str(tmp_path / "x"), format=format)
    back = tables.read_centers(spark, str(tmp_path / "x"), "patient_id long, time double, event int, treated int", format)
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_results_append_and_merge(spark, tmp_path):
    path = str(tmp_path / "r")
    tables.append_results(spark.createDataFrame([(1,)], "a int"), path)
    tables.append_results(spark.createDataFrame([(2, 3.0)], "a int, b double"), path)
    assert tables.read_results(spark, path).count() == 2


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = rows(spark)
    a, b = tables.fingerprint(df).first(), tables.fingerprint(df.orderBy(F.desc("patient_id")).repartition(3)).first()
    assert a == b and a != tables.fingerprint(df.withColumn("time", F.col("time") + 1)).first()


def test_portable_fingerprint_and_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (3, "")], "k int, s string")
    one = tables.portable_fingerprint(df, ["k", "s"]).first()
    assert one == tables.portable_fingerprint(df.orderBy(F.desc("k")).repartition(3), ["k", "s"]).first() and one["n_rows"] == 4
    assert one != tables.portable_fingerprint(df.na.fill(""), ["k", "s"]).first() and one["fingerprint"] != tables.portable_fingerprint(df.distinct(), ["k", "s"]).first()["fingerprint"]
    assert tables.portable_fingerprint(df.limit(0), ["k"]).first()["fingerprint"] == "0"
    with pytest.raises(ValueError):
        tables.portable_fingerprint(df.withColumn("x", F.lit(1.0)), ["x"])
    names = spark.createDataFrame([(" Age (years) ", "smd_age_at_start"), ("BMI", "smd"), (None, None)], "a string, b string")
    kind, rest = tables.label_parts("b")
    assert [tuple(r) for r in names.select(tables.clean_name("a"), kind, rest).collect()] == [("age_years", "smd", "age_at_start"), ("bmi", "smd", None), (None, None, None)]


def test_registry(spark):
    df = spark.createDataFrame([("s_N120_cols-age-bmi", "x"), ("t_N5_cols-age", "y")], "name string, owner string")
    assert tables.registry(df, owner="x").count() == 1 and tables.registry(df, pattern="t_.*").count() == 1 and tables.registry(df, pattern="t_").count() == 0
    row = df.withColumns(tables.parse_dataset_name()).orderBy("owner").first()
    assert row["n"] == 120 and row["columns"] == ["age", "bmi"]


def test_clinical_scan(spark):
    df = spark.createDataFrame([(50.0, "M", 3.0, 3.0, "A"), (70.0, "F", None, 9.0, "B")], "age double, sex string, death double, follow double, arm string")
    out = tables.clinical(df, {"age": (40, 80)}, {"sex": ["F", "M"]}, "death", "follow", "arm", "A", "site1").orderBy("time").collect()
    assert [(r["time"], r["event"], r["treated"], r["age"], r["sex_M"]) for r in out] == [(3.0, 1, 1, 0.25, 1.0), (9.0, 0, 0, 0.75, 0.0)]
    with pytest.raises(ValueError):
        tables.clinical(df.drop("sex"), {"age": (40, 80)}, {"sex": ["F", "M"]}, "death", "follow", "arm", "A", "site1")


def test_stream_gives_the_batch_curve(spark, tmp_path):
    df = rows(spark)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = start_counts(stream, CohortSpec(), "counts_test", ["treated"], str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = curve_of_counts(spark.table("counts_test"), ["treated"]).orderBy("treated", "time").collect()
    want = kaplan_meier(df, CohortSpec()).orderBy("treated", "time").collect()
    assert [r["survival"] for r in got] == pytest.approx([r["survival"] for r in want])


def test_upserts_of_a_stream_survive_restarts_and_repeated_batches(spark, tmp_path):
    from vitalspark.streaming.upsert import UpsertTable, keep_counts

    df, source = rows(spark), str(tmp_path / "in")
    table = UpsertTable(spark, str(tmp_path / "table"), ["treated", "time"], keep=3)
    assert table.read() is None
    for k, part in enumerate(df.randomSplit([1.0] * 5, seed=3)):
        part.coalesce(1).write.mode("append").parquet(source)
        if k == 2:
            continue  # two files come in one restart
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = keep_counts(stream, CohortSpec(), table, str(tmp_path / "cp"), ["treated"], availableNow=True)
        q.awaitTermination()
    batches = table.last_batch()
    assert batches == 4 and len(table._live(table.log.read())) <= 3
    got = {(r["treated"], r["time"]): (r["leaving"], r["events"]) for r in table.read().collect()}
    want = df.groupBy("treated", "time").agg(F.sum(F.lit(1.0)).alias("n"), F.sum(F.col("event").cast("double")).alias("d")).collect()
    assert got == {(r["treated"], r["time"]): (r["n"], r["d"]) for r in want}
    # a batch that died after its merge comes again; one that was torn before its entry leaves no trace
    assert not table.merge(table.read().withColumn("events", F.lit(-1.0)), batches)
    table.read().write.parquet(str(tmp_path / "table" / "part-torn"))
    again = UpsertTable(spark, str(tmp_path / "table"), ["treated", "time"])
    assert {(r["treated"], r["time"]): (r["leaving"], r["events"]) for r in again.read().collect()} == got
    curve = {(r["treated"], r["time"]): r["survival"] for r in curve_of_counts(again.read(), ["treated"]).collect()}
    assert curve == pytest.approx({(r["treated"], r["time"]): r["survival"] for r in kaplan_meier(df, CohortSpec()).collect()})


def _ibm(x):
    """A number in the transport format's base-16 floating point."""
    import math

    if x is None:
        return b"." + bytes(7)
    if x == 0:
        return bytes(8)
    power = math.floor(math.log(abs(x), 16)) + 1
    fraction = round(abs(x) / 16.0**power * 2**56)
    if fraction >= 1 << 56:
        fraction, power = fraction >> 4, power + 1
    return (((128 if x < 0 else 0) | (power + 64)) << 56 | fraction).to_bytes(8, "big")


def _write_xpt(path, names, rows):
    import struct

    pad = lambda b: b + b" " * (-len(b) % 80)
    mark = lambda kind, rest: pad(f"HEADER RECORD*******{kind:8}HEADER RECORD!!!!!!!{rest}".encode())
    own = [f"{'SAS':8}{'SAS':8}{'SASLIB':8}{'9.4':8}{'X64':8}{'':24}{'01JAN20:00:00:00':16}".encode(), pad(b"01JAN20:00:00:00")]
    out = mark("LIBRARY ", "0" * 30) + b"".join(own) + mark("MEMBER  ", "000000000000000001600000000140") + mark("DSCRPTR ", "0" * 30) + b"".join(own)
    out += mark("NAMESTR ", f"000000{len(names):04}00000000000000000000")
    place, strs = 0, b""
    for k, (name, size) in enumerate(names):
        strs += struct.pack(">hhhh8s40s8shhh2s8shhl52s", 1 if size == 8 else 2, 0, size, k + 1, f"{name:8}".encode(), b" " * 40, b" " * 8, 0, 0, 0, b"  ", b" " * 8, 0, 0, place, bytes(52))
        place += size
    out += pad(strs) + mark("OBS     ", "0" * 30)
    body = b"".join(b"".join(_ibm(v) if size == 8 else f"{v or '':{size}}".encode() for v, (_, size) in zip(r, names)) for r in rows)
    with open(path, "wb") as file:
        file.write(out + pad(body))


def test_transport_files(spark, tmp_path, monkeypatch):
    import pandas as pd

    from vitalspark.sources import xpt

    monkeypatch.setattr(xpt, "CHUNK", 100)
    names = [("USUBJID", 6), ("AGE", 8), ("SEX", 1), ("BMI", 8)]
    rows = [(f"P{k:03}", None if k % 7 == 3 else float(k) * 1.25 - 9, "FM"[k % 2], (k - 20) * 1e-3) for k in range(41)]
    path = str(tmp_path / "dm.xpt")
    _write_xpt(path, names, rows)
    want = pd.read_sas(path, format="xport", encoding="ascii")
    got = xpt.read_xpt(spark, path).orderBy("USUBJID").toPandas()
    assert list(got.columns) == [n for n, _ in names] and len(got) == len(want) == 41
    for c in ("AGE", "BMI"):
        assert ((got[c] - want[c]).abs().fillna(0) < 1e-12).all() and (got[c].isna() == want[c].isna()).all()
    assert got["SEX"].tolist() == [r[2] for r in rows]
    two = xpt.read_xpt(spark, [path, path], ["AGE"])
    assert two.columns == ["AGE"] and two.count() == 82
    with pytest.raises(ValueError):
        xpt.layout(__file__)


def test_transport_files_as_a_format_with_pushed_filters_and_few_columns(spark, tmp_path):
    from vitalspark.sources import formats, xpt

    names = [("USUBJID", 6), ("AGE", 8), ("SEX", 1)]
    for part in range(3):
        _write_xpt(str(tmp_path / f"dm{part}.xpt"), names, [(f"P{part}{k:02}", None if k % 7 == 3 else float(k), "FM"[k % 2]) for k in range(30)])
    formats.register(spark)
    df = spark.read.format("sas_transport").option("chunk", 150).load(str(tmp_path))
    assert df.columns == ["USUBJID", "AGE", "SEX"] and df.count() == 90 and df.rdd.getNumPartitions() == 9
    old = df.where("AGE >= 20 and SEX = 'F' and USUBJID is not null")
    assert sorted(r["USUBJID"] for r in old.collect()) == [f"P{p}{k:02}" for p in range(3) for k in range(20, 30, 2) if k % 7 != 3]
    assert "Filter (" not in old._jdf.queryExecution().executedPlan().toString()  # the source has them all
    assert df.where("AGE is null").count() == 12 and df.where("SEX in ('M', 'X') and AGE < 4").count() == 3 and df.where("AGE * 2 > 50 and AGE < 28").count() == 6
    few = spark.read.format("sas_transport").schema("AGE double").load(str(tmp_path / "dm1.xpt"))
    assert few.columns == ["AGE"] and "SEX" not in few._jdf.queryExecution().executedPlan().toString() and few.agg(F.sum("AGE")).first()[0] == sum(k for k in range(30) if k % 7 != 3)
    assert xpt.read_xpt(spark, [str(tmp_path / "dm0.xpt")], ["SEX"]).distinct().count() == 2


@pytest.mark.parametrize("kind", ["csv", "parquet", "xpt"])
def test_centre_files_as_a_format_open_only_the_wanted_centres(spark, tmp_path, kind):
    from vitalspark.sources import formats

    formats.register(spark)
    for k, name in enumerate(("north", "center=south", "west")):
        folder = tmp_path / name
        folder.mkdir()
        rows = [(float(j + k), "ab"[j % 2]) for j in range(5)]
        if kind == "csv":
            (folder / "x.csv").write_text("time,arm,spare\n" + "".join(f"{t},{a},z\n" for t, a in rows))
        elif kind == "parquet":
            import pandas as pd

            pd.DataFrame(rows, columns=["time", "arm"]).to_parquet(folder / "x.parquet")
        else:
            _write_xpt(str(folder / "x.xpt"), [("time", 8), ("arm", 1)], rows)
    (tmp_path / "west" / f"broken.{kind}").write_bytes(b"" if kind == "csv" else b"no such file")
    df = spark.read.format("centers").schema("center string, arm string, time double, absent int").option("files", kind).load(str(tmp_path))
    some = df.where("center in ('north', 'south') and time > 0")
    assert sorted((r["center"], r["time"], r["arm"], r["absent"]) for r in some.collect()) == sorted((c, float(j + k), "ab"[j % 2], None) for k, c in enumerate(("north", "south")) for j in range(5) if j + k)
    assert df.where("center = 'nowhere'").count() == 0
    if kind != "csv":
        with pytest.raises(Exception):
            df.where("center = 'west'").collect()


def test_grids_and_clinical_checks(spark, tmp_path):
    grid = spark.createDataFrame([(0.1, 0.67), (1.0, 0.81)], "epsilon double, accuracy double")
    tables.write_grid(grid, str(tmp_path / "grid"))
    assert sorted(tuple(r) for r in tables.read_grid(spark, str(tmp_path / "grid"), "epsilon double, accuracy double").collect()) == [(0.1, 0.67), (1.0, 0.81)]
    raw = spark.createDataFrame([(60.0, "M", 3.0, None, "a"), (None, "F", 4.0, 2.0, "b"), (150.0, "X", 1.0, 1.0, "a"), (30.0, None, 1.0, 1.0, "a")], "age double, sex string, follow double, death double, arm string")
    bounds, levels = {"age": (0, 120)}, {"sex": ["F", "M"]}
    assert tuple(tables.clinical_violations(raw, bounds, levels).first()) == (4, 1, 1)
    out = tables.clinical(raw.where("sex is null or sex <> 'X'"), bounds, levels, "death", "follow", "arm", "a", "c0", impute=True)
    assert out.where("age is null or sex_M is null").count() == 0 and out.count() == 3


def test_many_line_items_are_dealt_in_parts_of_constant_size(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, tables.cohort(spark, sf).collect()))
    monkeypatch.setattr(tables, "LEFT_ROWS", 1000)
    monkeypatch.setattr(tables, "PART_ROWS", 700)
    many = tables.cohort(spark, sf)
    plan = many._jdf.queryExecution().toString()
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 700)
    assert "RepartitionByExpression [l_orderkey" in plan and f", {n}" in plan and tables.parts_of(1000) == 0 and tables.parts_of(7001) == 11
    assert sorted(map(tuple, many.collect())) == want
