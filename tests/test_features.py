"""Warnings, snapshots, layouts, bitmaps, code levels, merged summaries and ordered exports."""

import glob
import json
import os
import random
import threading

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from levylens import operators as v
from levylens.plans import maps, publish, views
from levylens.sources import files, readers, schemas, sinks, snapshots, warnings

AMOUNT = "taxable_sales_and_purchases"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pages(tmp_path):
    rows = [
        [{"jurisdiction": "ERIE", AMOUNT: "12.5"}, {"jurisdiction": "ERIE", AMOUNT: "1,000"}],
        [{"jurisdiction": "ALBANY", AMOUNT: "n/a"}, {"jurisdiction": "ALBANY", AMOUNT: ""}],
        [{"jurisdiction": "ALBANY"}, {"jurisdiction": "ERIE", AMOUNT: "NA"}],
    ]
    for i, page in enumerate(rows):
        (tmp_path / f"page{i}.json").write_text(json.dumps(page, indent=1))
    (tmp_path / "broken.json").write_text('[{"jurisdiction": "ERIE"')
    return str(tmp_path)


def test_warnings_count_cells_and_pages(spark, tmp_path):
    raw = readers.open_data(spark, pages(tmp_path), schemas.SALES, mark_broken=True)
    rows, found = warnings.parsed_and_stored(raw, [AMOUNT, "sales_tax_quarter"])
    assert rows.columns == schemas.SALES.names and rows.count() == 6
    assert rows.agg(F.sum(AMOUNT)).first()[0] == 12.5
    assert found.cells == {AMOUNT: 2, "sales_tax_quarter": 0} and found.pages == 1
    assert {tuple(r) for r in found.table(rows).collect()} == {
        ("pages", 1), (AMOUNT, 2), ("sales_tax_quarter", 0),
    }
    cells = warnings.unreadable(raw, [AMOUNT]).collect()
    assert {tuple(r) for r in cells} == {(AMOUNT, "n/a", 1), (AMOUNT, "1,000", 1)}


def test_warnings_are_counted_in_the_pass_of_the_rows(spark, tmp_path):
    raw = readers.open_data(spark, pages(tmp_path), schemas.SALES, mark_broken=True)
    rows, found = warnings.parsed(raw, [AMOUNT])
    erie = rows.where("jurisdiction = 'ERIE'")  # counts are taken before the filter
    assert erie.count() == 3 and found.cells[AMOUNT] == 2


def test_without_broken_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"jurisdiction": "ERIE", AMOUNT: "1"}]))
    raw = readers.open_data(spark, str(tmp_path), schemas.SALES, mark_broken=True)
    rows, found = warnings.parsed_and_stored(raw, [AMOUNT])
    assert rows.count() == 1 and found.pages == 0
    rows, found = warnings.parsed_and_stored(readers.open_data(spark, str(tmp_path), schemas.SALES), [AMOUNT])
    assert rows.count() == 1 and found.pages == 0


def test_pages_hold_so_many_rows(spark, tmp_path):
    path = str(tmp_path / "pages")
    df = spark.range(25).selectExpr("string(id) AS jurisdiction").repartition(2)
    sinks.save_pages(df, path, rows_per_page=4)
    sizes = [len(json.load(open(f))) for f in glob.glob(f"{path}/part-*")]
    assert sum(sizes) == 25 and max(sizes) == 4
    assert readers.open_data(spark, path, schemas.SALES).count() == 25


# -- snapshots ------------------------------------------------------------------------------------


def write(spark, n):
    return lambda folder: sinks.save_bundle({"t": spark.range(n)}, folder)


def test_a_reader_keeps_its_bundle_during_a_rebuild(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        snapshots.current(spark, root)
    first = snapshots.publish(spark, root, write(spark, 3))
    reader = snapshots.opened(spark, root, ["t"])["t"]

    def during(folder):
        write(spark, 5)(folder)
        assert snapshots.current(spark, root) == first and reader.count() == 3

    second = snapshots.publish(spark, root, during)
    assert snapshots.current(spark, root) == second
    assert reader.count() == 3 and snapshots.opened(spark, root, ["t"])["t"].count() == 5


def test_old_bundles_are_removed_and_failed_ones_never_seen(spark, tmp_path):
    root = str(tmp_path)
    folders = [snapshots.publish(spark, root, write(spark, n)) for n in (1, 2, 3)]
    assert [os.path.exists(f) for f in folders] == [False, True, True]

    def fails(folder):
        write(spark, 9)(folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        snapshots.publish(spark, root, fails)
    assert snapshots.current(spark, root) == folders[-1]
    assert sorted(os.listdir(f"{root}/bundles")) == sorted(f.rsplit("/", 1)[1] for f in folders[1:])


def test_builds_that_end_together_are_both_published(spark, tmp_path):
    root = str(tmp_path)
    threads = [
        threading.Thread(target=snapshots.publish, args=(spark, root, write(spark, n), 5)) for n in range(4)
    ]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(snapshots._manifests(spark, root)) == 4 == len(os.listdir(f"{root}/bundles"))


def test_a_new_year_rewrites_its_partition_only(spark, tmp_path):
    path = str(tmp_path / "years")
    rows = spark.range(40).selectExpr("id % 4 AS tax_year", "id AS agi")
    publish.add_years(rows, path)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/part-*")}
    publish.add_years(spark.createDataFrame([(2, 99)], "tax_year long, agi long"), path)
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/part-*")}
    assert {f for f in before if after.get(f) != before[f]} == {f for f in before if "tax_year=2" in f}
    got = readers.table(spark, path).groupBy("tax_year").agg(F.sum("agi").alias("s")).collect()
    assert {r.tax_year: r.s for r in got} == {0: 180, 1: 190, 2: 99, 3: 210}


def test_shared_folders_go_when_the_process_ends(spark, tmp_path):
    """The folder is on Hadoop's list of what is deleted when its file system is closed."""
    path = str(tmp_path / "later")
    conf = spark._jsc.hadoopConfiguration()
    system = spark._jvm.org.apache.hadoop.fs.FileSystem.newInstance(
        spark._jvm.java.net.URI("file:///"), conf
    )
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system.mkdirs(hadoop)
    system.deleteOnExit(hadoop)
    spark.range(3).write.mode("overwrite").parquet(path)
    system.close()
    assert not os.path.exists(path)
    own = sinks.shared_folder(spark, "x")
    assert files.exists(spark, own)
    assert files.file_system(spark, own)[0].cancelDeleteOnExit(files.file_system(spark, own)[1])


# -- layouts --------------------------------------------------------------------------------------


def row_groups(path, column, value):
    """(row groups that a filter on one value has to read, all row groups)."""
    hit = total = 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.read_metadata(file)
        at = meta.schema.to_arrow_schema().names.index(column)
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            total += 1
            hit += s.min <= value <= s.max
    return hit, total


def test_a_view_reads_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "shares")
    rows = spark.range(400_000).selectExpr(
        "concat('state ', lpad(id * 7919 % 50, 2, '0')) AS state", "int(2000 + id % 20) AS tax_year",
        "rand(1) AS value", "repeat(uuid(), 2) AS note",
    )
    sinks.save_clustered(rows, path, ["state", "tax_year"], bloom=["state"], row_group=1 << 19)
    hit, total = row_groups(path, "state", "state 07")
    assert total >= 20 and hit <= 0.1 * total
    table = readers.table(spark, path)
    view = views.states_view(table, ["state 07"])
    assert "state" in plan(view) and "PushedFilters: [" in plan(view)
    assert view.count() == 8000 and table.count() == 400_000
    scattered = str(tmp_path / "scattered")
    rows.write.option("parquet.block.size", 1 << 19).parquet(scattered)
    hit, total = row_groups(scattered, "state", "state 07")
    assert hit == total


def test_bucketed_tables_are_joined_without_exchange(spark, tmp_path):
    rng = random.Random(1)
    counties = spark.createDataFrame(
        [(y, f"c{i}", float(rng.randint(1, 50))) for y in range(6) for i in range(30)],
        "tax_year int, county string, number_of_all_returns double",
    )
    amounts = spark.createDataFrame(
        [(y, f"c{i}", float(rng.randint(1, 9))) for y in range(6) for i in range(40) for _ in range(3)],
        f"tax_year int, county string, {AMOUNT} double",
    )
    by, stored = ["tax_year", "county"], []
    for name, df in (("counties_b", counties), ("amounts_b", amounts)):
        sinks.save_bucketed(df, name, by, 4, str(tmp_path / name))
        assert len(glob.glob(f"{tmp_path}/{name}/*.parquet")) <= 4
        stored.append(spark.table(name))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = maps.sales_per_return(*stored)
        assert "Exchange" not in plan(joined)
        assert "Exchange" in plan(maps.sales_per_return(counties, amounts))
        assert sorted(joined.collect()) == sorted(maps.sales_per_return(counties, amounts).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in ("counties_b", "amounts_b"):
            spark.sql(f"DROP TABLE {name}")


def test_ordered_export_reads_in_order_file_by_file(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(30_000).selectExpr(
        "IF(id % 3 = 0, 7L, id * 7919 % 1000) AS place", "id"
    )  # a third of all rows share a place
    sinks.export_ordered(rows, path, [F.asc("place")], files=8)
    parts = sorted(glob.glob(f"{path}/part-*.csv"))
    sizes, places, ids = [], [], set()
    for part in parts:
        with open(part) as lines:
            body = [x.strip().split(",") for x in lines][1:]
        sizes.append(len(body))
        places += [int(p) for p, _ in body]
        ids |= {i for _, i in body}
    assert places == sorted(places) and len(ids) == 30_000 == len(places)
    assert len(parts) == 8 and max(sizes) < 2 * 30_000 / 8


# -- totals ---------------------------------------------------------------------------------------


def test_totals_in_one_pass(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(
        [("a", 1, 2.5, "x"), ("a", 1, 2.5, "x"), ("b", None, float("nan"), None), (None, 4, 1.0, "y")],
        "k string, n int, v double, note string",
    ).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    one = v.totals_row(df, bounded=True)
    assert plan(one).count("FileScan") == 1 and plan(v.totals_row(df)).count("FileScan") == 2
    key = lambda r: str(tuple(r))
    assert sorted(map(key, one.collect())) == sorted(map(key, v.totals_row(df).collect()))
    assert tuple(one.collect()[-1]) == ("Total", 6, 6.0, "-")
    assert one.schema["n"].dataType == v.totals_row(df).schema["n"].dataType
    groups = v.with_total(df, ["k"], {"n": F.sum("n"), "rows": F.count(F.lit(1))}, label="All")
    assert plan(groups).count("FileScan") == 1
    assert {tuple(r) for r in groups.collect()} == {("a", 2, 2), ("b", None, 1), (None, 4, 1), ("All", 6, 4)}


# -- bitmaps --------------------------------------------------------------------------------------


def test_presence_answers_like_sets(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *map(str, range(300))])) for _ in range(900)]
    rows += [(2, "hot")] * 500
    df = spark.createDataFrame(rows, "year int, county string").repartition(5)
    found = v.presence(df, ["county"], ["year"])
    sets = {y: {c for z, c in rows if z == y} for y in (1, 2, 3, None)}
    one = lambda df: sorted((r[0] for r in df.collect()), key=str)
    order = lambda s: sorted(s, key=str)
    y = F.col("year")
    assert {r.year: r.n for r in found.key_counts().collect()} == {k: len(s) for k, s in sets.items()}
    assert {r.year: r.freq for r in found.row_counts().collect()} == {
        k: sum(z == k for z, _ in rows) for k in sets
    }
    assert {tuple(r) for r in found.pairs().collect()} == set(rows)
    assert one(found.in_all(y.isin(1, 2))) == order(sets[1] & sets[2])
    assert one(found.in_all(y == 99)) == []
    assert one(found.in_any(y.isNull() | (y == 3))) == order(sets[None] | sets[3])
    assert one(found.only_in(y == 2, y.isin(1, 3))) == order(sets[2] - sets[1] - sets[3])
    assert one(found.only_in(y == 2, y == 99)) == order(sets[2])


def test_presence_over_many_buckets(spark):
    df = spark.range(100_000, numPartitions=3).selectExpr("id", "id % 2 AS side")
    found = v.presence(df, ["id"], ["side"])
    assert found.bits.where("side = 0").count() > 1
    assert {tuple(r) for r in found.key_counts().collect()} == {(0, 50_000), (1, 50_000)}
    assert found.only_in(F.col("side") == 1, F.col("side") == 0).agg(F.sum("id")).first()[0] == sum(range(1, 100_000, 2))


def test_one_scan_answers_all_coverage_questions(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(100).selectExpr("id % 7 AS county", "id % 3 AS year").write.parquet(path)
    found = v.presence(readers.table(spark, path), ["county"], ["year"])
    for df in (found.key_counts(), found.pairs(), found.in_all(F.col("year") < 2)):
        assert path not in plan(df)


# -- codes ----------------------------------------------------------------------------------------


def test_nearest_level(spark):
    levels = [("31-33", "Making"), ("44 - 45", "Retail"), (" 48–49", "Transport"), ("4541", "Online"), ("454", "Nonstore"),
              ("45-44", "backwards"), ("1-22", "uneven"), ("4541", "Ordering"), (None, "none"), ("07-09", "padded")]
    codes = ["31", "3399", "334110", "45", "4541", "45411", "45", "4551", "48", "99", "9", "", None, "3", "081"]
    df = spark.createDataFrame([(i, c, "old") for i, c in enumerate(codes)], "id int, code string, text string")
    table = spark.createDataFrame(levels, "code string, text string")
    got = v.nearest_level(df, "code", table, "code", "text")
    assert got.columns == ["id", "code", "text", "text_level"]
    assert [tuple(r)[1:] for r in got.orderBy("id").collect()] == [
        ("31", "Making", 2), ("3399", "Making", 2), ("334110", "Making", 2), ("45", "Retail", 2),
        ("4541", "Online", 4), ("45411", "Online", 4), ("45", "Retail", 2), ("4551", "Retail", 2),
        ("48", "Transport", 2), ("99", None, None), ("9", None, None), ("", None, None),
        (None, None, None), ("3", None, None), ("081", "padded", 2),
    ]


# -- merged summaries -----------------------------------------------------------------------------


def test_merged_summaries(spark, tmp_path):
    rng = random.Random(5)
    rows = [(2000 + i % 3, "ab"[i % 2], rng.choice([None, float("nan"), rng.gauss(0, 9)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "year int, county string, x double").repartition(4)
    path = str(tmp_path / "store")
    for part in ("year < 2002", "year = 2002"):
        v.store_summaries(df.where(part), "x", ["year", "county"], path)
    store = readers.table(spark, path)
    for by in ([], ["year"], ["county"], ["year", "county"]):
        want = {str(tuple(r)) for r in v.six_number_summary(df, "x", by).drop("mean", "total").collect()}
        got = {str(tuple(r)) for r in v.exact_summary(df, "x", store, by).drop("mean", "total").collect()}
        assert got == want
    near = v.approximate_summary(store, ["year"]).collect()
    exact = {r.year: r for r in v.six_number_summary(df, "x", ["year"]).collect()}
    assert all(abs(r.median - exact[r.year].median) < 1 and r.min == exact[r.year].min for r in near)


def test_a_later_year_reads_its_own_rows_only(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.range(600).selectExpr("int(id % 3) AS year", "'a' AS county", "double(id) AS x")
    v.store_summaries(df, "x", ["year", "county"], path)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/part-*")}
    v.store_summaries(df.where("year = 1").withColumn("x", F.lit(5.0)), "x", ["year", "county"], path)
    kept = {f for f in glob.glob(f"{path}/*/part-*") if before.get(f) == os.stat(f).st_mtime_ns}
    assert kept == {f for f in before if "year=1" not in f}
    got = v.approximate_summary(readers.table(spark, path), ["year"]).collect()
    assert {r.year: r.max for r in got} == {0: 597.0, 1: 5.0, 2: 599.0}
