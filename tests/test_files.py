"""Sources, sinks, the cleaned datasets and the snapshot refresh."""

import csv
import datetime as dt
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from guichet import session
from guichet import vocabulary as V
from guichet.catalogue import cleaning
from guichet.operators import settle
from guichet.operators.models import ModelMeta, model_card
from guichet.plans import datasets
from guichet.sources import delimited, files
from guichet.streaming.snapshots import refresh_on_snapshot

BOM = "\ufeff"

HEADER = (
    "Num identification SNPC;Date d'engagement;Annee de declaration;Engagements (K EUR);Equivalent don (K EUR);"
    "Montant verse (K EUR);Engagements (K USD);Agence;Code agence;Pays beneficiaire;Région;Secteur;"
    "Type de financement;Canal agrege;Canal de transfert;Origine des fonds mobilises;Bi/Multi;Bi/Multi;Genre;Description;Vide"
)
LINES = [
    'S1;05/03/2020;2020;"1 234,5";"1 000,0";10,5;1;Ministère de l’économie  et des finances;7;Türkiye;Europe;Santé;Dons;'
    "Groupe de la Banque Mondiale (BM);Réseaux;fonds PROPRES;1;Bilatéral;2;\"ligne 1\nligne \"\"2\"\"\";",
    "S1;01/02/2019;2021;10;20;1;1;AFD;7;Mali;Afrique;Eau;Prêt;GAVI;ONG INTERNATIONALE;FONDS;1;Bilatéral;;x;",
    "S1;01/02/2019;2021;10;20;1;1;AFD bis;7;Mali;Afrique;Eau;Prêt;GAVI;ONG INTERNATIONALE;FONDS;1;Bilatéral;;x;",
    "S2;32/01/2019;2021;5;;;1;AFD;7;nan;Afrique;Eau;NA;GAVI;Cités Unies Frances;;3;Multi;oui;x;",
    ";03/01/2018;2018;7;3;-1;1;AFD;7;Mali;Afrique;;Autre;GAVI;x;y;3;Multi;0;x;",
    ";02/01/2018;x;8;4;2;1;AFD;7;Mali;Afrique;Eau;Autre;GAVI;x;y;3;Multi;1;x;",
    "S3;02/01/2018;2018;-5;4;3;1;AFD;7;Mali;Afrique;Eau;Dons;GAVI;x;y;3;Multi;1;x;",
]


@pytest.fixture
def raw_path(tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(BOM + HEADER + "\n" + "\n".join(LINES) + "\n", encoding="utf-8")
    return str(path)


def test_headers():
    assert delimited.unique_headers(["a", "b", "a", "a", None, "a.1"]) == ["a", "b", "a.1", "a.2", "Unnamed: 4", "a.1.1"]


def test_scan_delimited(spark, raw_path):
    df = delimited.scan_delimited(spark, raw_path, encoding="utf-8-sig")
    assert df.columns[0] == V.PROJECT_KEY and df.columns[-1] == "row_ord"
    assert {"Bi/Multi", "Bi/Multi.1"} <= set(df.columns)
    rows = df.orderBy("row_ord").collect()
    assert len(rows) == len(LINES)
    assert rows[0]["Description"] == 'ligne 1\nligne "2"'
    assert rows[0]["Bi/Multi.1"] == "Bilatéral"
    assert rows[3]["Pays beneficiaire"] is None and rows[3]["Type de financement"] is None
    assert [r[V.PROJECT_KEY] for r in rows] == ["S1", "S1", "S1", "S2", None, None, "S3"]


def test_cells_are_read_like_pandas(spark, tmp_path):
    pool = [
        "plain", 'a "b" c', "x;y", "line\nbreak", "line\r\nbreak", " lead", "trail ", "NA", "nan", "", '"', '""', "é",
        "l’eau", "\ttab", "None", "-1", "1,5", "\\", 'end\\"', "#N/A", "null", "  ", "'single'", "a\\nb",
    ]
    rng = random.Random(7)
    table = [[str(i)] + [rng.choice(pool) for _ in range(4)] for i in range(400)]
    path = tmp_path / "cells.csv"
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        writer = csv.writer(out, delimiter=";", lineterminator="\n")
        writer.writerow(["i", "a", "b", "a", "c d"])
        writer.writerows(table)
    want = pd.read_csv(path, sep=";", dtype=str, encoding="utf-8-sig")
    got = delimited.scan_delimited(spark, str(path)).orderBy("row_ord").drop("row_ord")
    assert got.columns == list(want.columns)
    assert [tuple(r) for r in got.collect()] == [
        tuple(None if pd.isna(v) else v for v in row) for row in want.itertuples(index=False)
    ]


def test_row_order_over_files(spark, tmp_path):
    for name, first, n in (("a", 0, 5), ("b", 100, 5000), ("c", 10_000, 3)):
        body = "\n".join(str(first + i) for i in range(n))
        (tmp_path / f"{name}.csv").write_text("x;y\n" + "\n".join(f"{v};z" for v in body.split("\n")) + "\n")
    for multiline in (True, False):
        spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
        try:
            df = delimited.scan_delimited(spark, str(tmp_path), multiline=multiline)
            got = [int(r["x"]) for r in df.orderBy("row_ord").collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == sorted(got) and len(got) == 5008


@pytest.mark.parametrize("split", [128 << 20, 1500, 97])
def test_quoted_breaks_over_splits(spark, tmp_path, split, request):
    """Records that span splits, whole splits inside quotes, files with and without breaks."""
    rng = random.Random(split)
    tables = {}
    for name, breaks in (("a", 0.3), ("b", 0.0), ("c", 0.9)):
        tables[name] = [
            [f"{name}{i:04d}", "\n".join(rng.choice(['q"', "", "t;x", "é", ";"]) for _ in range(rng.randint(2, 60))) if rng.random() < breaks else "one"]
            for i in range(150)
        ]
        with open(tmp_path / f"{name}.csv", "w", encoding="utf-8", newline="") as out:
            writer = csv.writer(out, delimiter=";", lineterminator="\n")
            writer.writerows([["key;\nof", "text"], *tables[name]])
    if split < 1000:
        request.getfixturevalue("small_broadcasts")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        df = delimited.scan_delimited(spark, str(tmp_path))
        got = [tuple(r) for r in df.orderBy("row_ord").drop("row_ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert df.columns[:2] == ["key;\nof", "text"]
    assert got == [(a, None if b == "" else b) for name in "abc" for a, b in tables[name]]


def test_scan_latest(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        delimited.scan_latest(spark, str(tmp_path / "absent"))
    with pytest.raises(FileNotFoundError):
        delimited.scan_latest(spark, str(tmp_path), "s_*.csv")
    for hour, value in (("2024-05-01_09", 1), ("2024-05-01_10", 2), ("2024-04-30_23", 3)):
        (tmp_path / f"s_{hour}.csv").write_text(f"x;y\n{value};a\n")
    (tmp_path / "z_2025-01-01_00.csv").write_text("x;y\n9;a\n")
    assert delimited.scan_latest(spark, str(tmp_path), "s_*.csv").first()["x"] == "2"


def test_csv_keeps_types_and_texts(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 1.5, 'a "b"\nc,d', dt.date(2020, 1, 2)), (None, None, None, None)], "i int, x double, t string, d date"
    )
    path = str(tmp_path / "out")
    files.write_csv(df, path)
    back = delimited.scan_clean_csv(spark, path, df.schema)
    assert sorted(back.collect(), key=repr) == sorted(df.collect(), key=repr)


def test_inputs_are_not_overwritten(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_parquet(spark.range(3), path)
    df = files.scan_parquet(spark, path)
    for write in (files.write_parquet, files.write_csv, files.write_metrics):
        with pytest.raises(ValueError):
            write(df, path)
    files.write_parquet(df.withColumnRenamed("id", "Montant (K EUR)"), path + "2")
    assert files.scan_parquet(spark, path + "2").columns == ["Montant (K EUR)"]


def test_metrics_and_model_card(spark, tmp_path):
    meta = ModelMeta("RandomForestRegressor", 1.5439, 1.2191, 0.5427, 67372, 16844, ["a", "b"], ["a"], ["b"],
                     {"LinearRegression": 0.18})
    path = str(tmp_path / "meta")
    files.write_metrics(meta.table(spark), path)
    back = files.read_metrics(spark, path, ModelMeta.SCHEMA)
    assert back.count() == 1 and back.first()["cv_scores"] == {"LinearRegression": 0.18}
    card = model_card(back).first()
    assert card["headline"] == "Modèle actif : RandomForestRegressor"
    assert card["metrics"] == "R² = 0.543 | RMSE = 1.544 | MAE = 1.219"
    assert card["sizes"] == "Entraîné sur 67,372 projets | testé sur 16,844 projets"
    assert (card["n_features"], card["num_cols"], card["categorical_low"]) == (2, ["b"], [])


def test_explore_dataset(spark, raw_path):
    raw = delimited.scan_delimited(spark, raw_path)
    for staged in (False, True):
        df = datasets.build_explore_dataset(raw, staged=staged)
        gone = {"Vide", "Engagements (K USD)", "Code agence", "Bi/Multi", "Description", V.DECLARATION_YEAR, V.PROJECT_KEY}
        assert not gone & set(df.columns) and "Bi/Multi.1" in df.columns and "row_ord" not in df.columns
        assert df.count() == 4
        by_day = {(r[V.COMMITMENT_DAY], r[V.COMMITTED]): r for r in df.collect()}
        s1 = by_day[dt.datetime(2019, 2, 1), 1244.5]
        assert s1["Agence"] == "AFD" and s1[V.GRANT_EQUIVALENT] == 1020.0 and s1[V.COMMITMENT_MONTH] == 2
        assert s1[V.CHANNEL] == "ONG internationale" and s1[V.MOBILISED_ORIGIN] == "Fonds" and s1["Genre"] == 0
        s2 = by_day[None, 5.0]
        assert s2[V.CHANNEL] == "Cités Unies France" and s2[V.GRANT_EQUIVALENT] == 0.0 and s2[V.COMMITMENT_YEAR] is None
        no_key = by_day[dt.datetime(2018, 1, 2), None]
        assert no_key["Genre"] == 1 and no_key[V.PAID] is None


def test_labels_after_normalising(spark, raw_path):
    raw = delimited.scan_delimited(spark, raw_path).where(F.col(f"`{V.DECLARATION_YEAR}`") == "2020")
    row = datasets.build_explore_dataset(raw).first()
    assert row["Agence"] == "Ministère de l'économie, des finances, et de la souveraineté industrielle"
    assert (row[V.COUNTRY], row[V.CHANNEL], row[V.CHANNEL_GROUP]) == (
        "Turquie", "Réseau", "Groupe de la Banque mondiale (BM)")
    assert (row[V.MOBILISED_ORIGIN], row["Genre"], row[V.COMMITTED]) == ("Fonds propres", 1, 1234.5)


def test_model_dataset(spark, raw_path):
    raw = delimited.scan_delimited(spark, raw_path).where(F.col(f"`{V.DECLARATION_YEAR}`") != "x")
    df = datasets.build_model_dataset(raw, date_formats=V.DAY_FIRST_FORMATS)
    assert not [c for c in df.columns if "USD" in c or "code" in c.lower() or c in ("row_ord", V.COMMITMENT_DATE)]
    rows = df.collect()
    assert [r[V.GRANT_RATIO] for r in rows] == [None, 1.0, 1.0, None, 3 / 7, None]
    assert [r[V.FINANCING_CLASS] for r in rows] == ["Don", "Prêt", "Prêt", "Autre", "Autre", "Don"]
    assert [r["Genre"] for r in rows] == [1, 0, 0, 0, 0, 1]
    assert [r[V.COMMITMENT_MONTH] for r in rows] == [3, 2, 2, None, 1, 1]
    bad = delimited.scan_delimited(spark, raw_path)
    with pytest.raises(Exception, match="not an integer"):
        datasets.build_model_dataset(bad).collect()


def test_hourly_datasets(spark, raw_path):
    clean = datasets.build_hourly_clean(delimited.scan_delimited(spark, raw_path))
    rows = clean.collect()
    # Kept: positive payment, country, sector and year present.
    assert [(r[V.PAID], r[V.DECLARATION_YEAR]) for r in rows] == [(10.5, 2020), (1.0, 2021), (1.0, 2021), (3.0, 2018)]
    features = datasets.build_hourly_features(clean)
    assert features.columns == ["Agence", "Type de financement", "Pays beneficiaire", "Région", "Secteur",
                                "Bi/Multi", V.DECLARATION_YEAR, V.LOG_PAID]
    assert dict(features.dtypes)["Bi/Multi"] == "double"
    assert features.count() == 4
    tracked = datasets.with_log_target(spark.createDataFrame([(0.0,)], f"`{V.COMMITTED}` double"))
    assert tracked.first()[V.LOG_COMMITTED] == 0.0


def test_refresh_on_snapshot(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    seen = []

    def refresh():
        query = refresh_on_snapshot(
            spark, str(folder), lambda df: seen.append(df.first()["x"]), str(tmp_path / "state"), "s_*.csv"
        )
        assert query.awaitTermination(60)

    (folder / "s_2024-05-01_09.csv").write_text("x;y\n1;a\n")
    (folder / "s_2024-05-01_10.csv").write_text("x;y\n2;a\n")
    refresh()
    refresh()
    (folder / "s_2024-05-01_11.csv").write_text("x;y\n3;a\n")
    refresh()
    assert seen == ["2", "3"]


@pytest.mark.parametrize("form", ["relative", "plain", "qualified"])
def test_overwriting_an_input_is_refused_in_any_form(spark, tmp_path, monkeypatch, form):
    folder = tmp_path / "input"
    spark.range(5).write.parquet(str(folder))
    monkeypatch.chdir(tmp_path)
    path = {"relative": os.path.relpath(folder, spark._jvm.System.getProperty("user.dir")), "plain": str(folder), "qualified": f"file://{folder}"}[form]
    with pytest.raises(ValueError):
        files.write_parquet(spark.read.parquet(str(folder)), path)
    assert spark.read.parquet(str(folder)).count() == 5


def test_filters_stay_above_the_parsed_cells(spark, tmp_path):
    """Filters on cells that reach below the parser parse a record again for each of them."""
    (tmp_path / "a.csv").write_text("x;y;z\n1;a;b\n2;;c\n")
    df = delimited.scan_delimited(spark, str(tmp_path)).where("x is not null and y is not null and z is not null")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_csv(") == 1
    assert [r["x"] for r in df.collect()] == ["1"]


def test_records_with_breaks_are_not_written_down(spark, tmp_path):
    """Nor do lines meet more often than once per split and once over splits."""
    (tmp_path / "a.csv").write_text('x;y\n1;"a\nb"\n2;c\n3;"d\n"\n')
    with session.scratch(spark):
        df = delimited.scan_delimited(spark, str(tmp_path))
        assert not [p for p in session._written.get() if "/table-" in p]
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 3
        assert [tuple(r)[:2] for r in df.orderBy("row_ord").collect()] == [("1", "a\nb"), ("2", "c"), ("3", "d\n")]


def _shuffled(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for f in manager.getAllFiles().mkString("\n").split("\n") if (name := os.path.basename(f)).startswith("shuffle_")}


def test_a_snapshot_leaves_packed_text_alone(spark, tmp_path, monkeypatch):
    """Its shuffles are deleted, its files are packed and short, and its rows come back in order."""
    monkeypatch.setattr(cleaning, "SNAPSHOT_ROWS", 20)
    names = ["signed", "committed", "granted", "quantity", "marker", "financing", "year", "priority", "channel", "country", "region", "sector", "agency"]
    given = {"signed": "timestamp'2024-01-31'", "financing": "'R'", "year": "2024", "marker": "0.5", "quantity": "3.0"}
    columns = [f"{given.get(c, '1.5' if c in ('committed', 'granted') else repr(c))} AS {c}" for c in names]
    lines = spark.range(200).selectExpr("199 - id AS project", "1 AS line", "2L AS part", "3L AS supplier", *columns)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = _shuffled(spark), spark.conf.get(setting)
    cleaning._snapshot(lines, str(tmp_path / "s"))
    assert spark.conf.get(setting) == was
    for _ in range(100):
        if not _shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffled(spark) - before
    parts = [f for f in os.listdir(tmp_path / "s") if f.startswith("part-")]
    assert len(parts) >= 10 and all(f.endswith(".gz") for f in parts)
    back = delimited.scan_delimited(spark, str(tmp_path / "s")).orderBy("row_ord").select("project").collect()
    assert [r[0] for r in back] == [str(i) for i in range(200)]


def test_parsed_rows_are_packed(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(datasets, "stage", lambda df, **options: written.append(options) or settle.stage(df, **options))
    raw = spark.createDataFrame([("1", "01/02/2024", "1,5"), ("1", "01/02/2024", "2,5")], [V.PROJECT_KEY, V.COMMITMENT_DATE, V.COMMITTED])
    got = datasets.build_explore_dataset(raw, [F.col(V.COMMITTED)]).collect()
    assert [r[V.COMMITTED] for r in got] == [4.0] and written == [{"compression": "zstd"}]
