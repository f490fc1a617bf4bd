import datetime
import json
import os

import pytest

from levylens.plans import publish
from levylens.sources import order_tables, readers, schemas, sinks, snapshots

FOLDER = "/root/testdata/sf0.001"


def test_open_data_pages(spark, tmp_path):
    page = [{"sector": "x", "jurisdiction": "ERIE", "taxable_sales_and_purchases": "12.5"}]
    for i in (1, 2):
        (tmp_path / f"page{i}.json").write_text(json.dumps(page))
    df = readers.open_data(spark, str(tmp_path), schemas.SALES)
    assert df.columns == schemas.SALES.names and df.count() == 2
    assert {t for _, t in df.dtypes} == {"string"}
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.json").write_text("\n".join(json.dumps(page[0]) for _ in range(3)))
    assert readers.open_data(spark, str(lines), schemas.SALES, one_array_per_file=False).count() == 3


def test_dimension_csv(spark, tmp_path):
    (tmp_path / "ncais.csv").write_text('sector,sector_description\n11,"Farms, and more"\n')
    df = readers.dimension_csv(spark, str(tmp_path / "ncais.csv"), schemas.SECTORS)
    assert [tuple(r) for r in df.collect()] == [(11.0, "Farms, and more")]


def test_boundaries_of_one_state(spark):
    df = readers.counties_of(order_tables.boundaries(spark, FOLDER))
    assert df.columns == ["GEOID", "county", "geometry"]
    assert {r.GEOID[:2] for r in df.collect()} == {"36"} and df.count() == 17


def test_build_and_export(spark, tmp_path):
    root = str(tmp_path / "out")
    raw = [
        f(spark, FOLDER)
        for f in (
            order_tables.raw_income_v1, order_tables.raw_income_v2, order_tables.raw_sales,
        )
    ]
    folder = publish.build(*raw, root, rate_years=(1996, 1998))
    assert folder == snapshots.current(spark, root)
    names = sorted(os.listdir(f"{folder}/dashboard"))
    tables = snapshots.opened(spark, root, names, publish.DASHBOARD)
    assert names == [
        "effective_rate", "industry_share", "region_per_return", "resident_share", "state_share",
    ]
    assert all(df.count() for df in tables.values())
    base = readers.bundle(spark, f"{folder}/base", ["county_income", "states"])
    day = datetime.date(2022, 5, 27)
    path = publish.export(
        tables["region_per_return"], base["county_income"], base["states"], root, day
    )
    assert path == f"{root}/data-2022-05-27.csv"
    assert spark.read.csv(path, header=True).count() == tables["region_per_return"].count()
    sheets = sorted(os.listdir(f"{root}/sheets"))
    assert sheets == ["NY Counties", "States"]


def test_saving_overwrites(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 2):
        sinks.save_table(spark.range(n), path)
    assert readers.table(spark, path).count() == 2
    sinks.save_table(spark.range(4).selectExpr("id", "id % 2 AS y"), path, partition_by=["y"])
    assert sorted(d for d in os.listdir(path) if d.startswith("y=")) == ["y=0", "y=1"]


def test_shared_folder_follows_the_session(spark):
    first, second = (sinks.shared_folder(spark, "x") for _ in range(2))
    assert first != second
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        assert first.startswith(f"{named.rstrip('/')}/x-")


@pytest.mark.parametrize("era", ["v1", "v2"])
def test_derived_tables_have_the_raw_schema(spark, era):
    build = {"v1": order_tables.raw_income_v1, "v2": order_tables.raw_income_v2}[era]
    expected = {"v1": schemas.INCOME_V1, "v2": schemas.INCOME_V2}[era]
    df = build(spark, FOLDER)
    assert df.columns == expected.names and {t for _, t in df.dtypes} == {"string"}


def test_derived_sales_have_the_raw_schema(spark):
    df = order_tables.raw_sales(spark, FOLDER)
    assert df.columns == schemas.SALES.names and {t for _, t in df.dtypes} == {"string"}
