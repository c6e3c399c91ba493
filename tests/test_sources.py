import gzip

import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import types as T

from helpers import rows
from tunestrata import sources as io
from tunestrata.operators import classify, features
from tunestrata.plans import fixtures as fx

SONG, TRACK = "S" * 18, "T" * 18


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_match_log_fields(spark):
    df = lines(spark, f"ERROR: <{SONG} {TRACK}> a  -  b  !=  c  -  d", "other text", "")
    assert rows(io.parse_match_log(df)) == [(SONG, TRACK, "a", "b", "c", "d")]


def test_match_log_first_separator_wins(spark):
    df = lines(spark, f"ERROR: <{SONG} {TRACK}> a  -  b  -  b2  !=  c  -  d  -  d2  !=  e")
    assert rows(io.parse_match_log(df)) == [(SONG, TRACK, "a", "b  -  b2", "c", "d  -  d2  !=  e")]


def test_match_log_keeps_empty_and_special_texts(spark):
    df = lines(spark, f"ERROR: <{SONG} {TRACK}>   -  $1 \\2  !=  c  -  ")
    assert rows(io.parse_match_log(df)) == [(SONG, TRACK, "", "$1 \\2", "c", "")]


def test_match_log_prefixes_do_not_mix(spark):
    plain = f"ERROR: <{SONG} {TRACK}> a  -  b  !=  c  -  d"
    df = lines(spark, plain, "< " + plain, " " + plain)
    assert io.parse_match_log(df).count() == 1
    assert io.parse_match_log(df, accepted=True).count() == 1


def test_malformed_lines_are_dropped_and_can_be_seen(spark):
    bad = f"ERROR: <short {TRACK}> a  -  b  !=  c  -  d"
    df = lines(spark, bad, f"ERROR: <{SONG} {TRACK}> no separators", "else")
    assert io.parse_match_log(df).count() == 0
    assert io.malformed_lines(df).count() == 2


def test_schema_from_attributes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,NUMERIC\ny,real\n z , STRING \nw,string\n")
    schema = io.schema_from_attributes(io.read_attributes(spark, str(tmp_path)))
    assert [(f.name, f.dataType) for f in schema] == [
        ("x", T.DoubleType()), ("y", T.DoubleType()), ("z", T.StringType()), ("w", T.StringType()),
    ]
    assert all(f.nullable for f in schema)
    (tmp_path / "b.csv").write_text("q,int8\n")
    with pytest.raises(ValueError, match="int8"):
        io.schema_from_attributes(io.read_attributes(spark, str(tmp_path / "b.csv")))
    census = io.attribute_type_census(io.read_attributes(spark, str(tmp_path)))
    assert dict(rows(census))["NUMERIC"] == 1


def test_gzip_and_separators(spark, tmp_path):
    path = tmp_path / "t.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write("u1\ts1\t3\nu2\t\t1\n")
    schema = T.StructType.fromDDL("user_id string, song_id string, plays int")
    assert rows(io.read_delimited(spark, str(path), schema, "\t")) == [("u1", "s1", 3), ("u2", None, 1)]
    assert io.line_count(spark, str(path)).first()[0] == 2


def test_inferred_and_given_types(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("song_id,hot\na,0.5\nb,\n")
    assert io.read_inferred(spark, str(path)).dtypes == [("song_id", "string"), ("hot", "double")]
    given = io.read_inferred(spark, str(path), T.StructType.fromDDL("song_id string, hot string"))
    assert rows(given) == [("a", "0.5"), ("b", None)]


def test_catalog(spark, tmp_path):
    catalog = io.Catalog(str(tmp_path))
    assert len(catalog.names) == len(set(catalog.names)) == 13
    with pytest.raises(KeyError):
        catalog.path("none")
    name = catalog.names[0]
    (tmp_path / "attributes").mkdir()
    (tmp_path / "features").mkdir()
    (tmp_path / "attributes" / f"{name}.attributes.csv").write_text("f,NUMERIC\nid,STRING\n")
    (tmp_path / "features" / f"{name}.csv").write_text("1.5,'A'\n")
    catalog.register(spark, name, "catalog_view")
    assert rows(spark.table("catalog_view")) == [(1.5, "'A'")]


def test_inventory_and_preview(spark, tmp_path, sf_dir):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("12345")
    (tmp_path / "d" / "y.txt").write_text("1")
    [(folder, n, size)] = rows(io.storage_inventory(spark, str(tmp_path)))
    assert folder.endswith("/d") and (n, size) == (2, 6)
    assert io.preview(fx.triplets(spark, sf_dir), 3).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    assert rows(io.checkpoint(df, str(tmp_path / "p"))) == rows(df)
    assert rows(io.checkpoint(df.limit(1), str(tmp_path / "p"))) == rows(df.limit(1))
    io.export_csv(df, str(tmp_path / "c"))
    assert rows(io.read_inferred(spark, str(tmp_path / "c"))) == rows(df)


def test_model_round_trip(spark, sf_dir, tmp_path):
    df = fx.binary_tagged(spark, sf_dir)
    train, test, _ = features.prepare(df, df, fx.FEATURES, "genres")
    model = classify.binary_logistic().fit(train)
    io.save_model(model, str(tmp_path / "m"))
    again = io.load_model(LogisticRegressionModel, str(tmp_path / "m"))
    columns = ["track", "probability", "prediction"]
    assert rows(model.transform(test).select(columns)) == rows(again.transform(test).select(columns))


def test_losses_are_counted_by_the_pass_that_parses(spark):
    good = "ERROR: <SO0000000000000001 TR0000000000000001> a  -  b  !=  c  -  d"
    lines = spark.createDataFrame([(good,), ("ERROR: broken",), ("< " + good,), ("note",), (None,)], "value string")
    for accepted, figures in ((False, (3, 1, 1)), (True, (4, 0, 1))):
        marked = io.parse_marked(lines, accepted)
        parsed = marked.where("kind = 'parsed'").drop("kind")
        assert rows(parsed) == rows(io.parse_match_log(lines, accepted))
        assert rows(io.losses(marked)) == [figures]
        assert marked.where("kind = 'malformed'").count() == io.malformed_lines(lines, accepted).count()
