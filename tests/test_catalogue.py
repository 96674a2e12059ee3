"""The catalogue keeps its rules, and columns are routed to it."""

import pytest
from pyspark.sql import functions as F

from prismcol.operators import catalogue, ontology, similarity
from prismcol.sources.values import values_frame


def test_catalogue_is_valid(spark, tmp_path):
    table = catalogue.ontology_table(spark)
    assert ontology.validate(table).count() == 0 and set(r[0] for r in table.select("match_kind").distinct().collect()) <= set(ontology.MATCH_KINDS)
    ids = {r["p"]: r["semantic_type_id"] for r in table.select(F.concat_ws("/", "data_type", "semantic_family", "semantic_type").alias("p"), "semantic_type_id").collect()}
    assert ids["number/quantity/measurement"] == "n0001" and ids["text/name/person"] == "n0027" and ids["identifier/id/administrative"] == "n0073" and len(set(ids.values())) == len(ids)
    table.drop("node_label").toPandas().to_csv(tmp_path / "o.csv", index=False)
    back = catalogue.ontology_table(spark, str(tmp_path / "o.csv"))
    assert back.count() == table.count() and back.where("examples like '%;;%'").count() == table.where("examples like '%;;%'").count()


COLUMNS = {
    "state": ["California", "TX", "Ohio", "New York", "FL"],
    "book": ["isbn 0395629764", "ISBN 957-33-0471-6", "0-19-852663-6"],
    "who": ["James Smith", "Maria Garcia", "Robert Johnson", "Priscilla Ramos"],
    "day": ["03/15/2019", "12/31/2020", "01/01/2021"],
    "moment": ["2020-09-12T10:50:39", "2019-01-02T00:00:00"],
    "hour": ["14:30:00", "09:15:45", "23:59:59"],
    "words": ["the quick brown fox", "lorem ipsum dolor", "hello world foo"],
    "money": ["$1,234.50", "$99.00", "$12.30", "$5000"],
    "blank": ["", " ", None],
}


def test_routes(spark):
    rows = [(c, v) for c, vs in COLUMNS.items() for v in vs]
    values = spark.createDataFrame(rows, "column string, v string").groupBy("column", "v").agg(F.count("*").alias("w"))
    got = {r["column"]: r for r in catalogue.route(values).collect()}
    assert set(got) == set(COLUMNS)
    assert (got["state"]["semantic_type"], got["state"]["format_label"], got["state"]["depth"]) == ("geographic", "us_state", 4)
    assert (got["book"]["semantic_type"], got["book"]["format_label"]) == ("administrative", "isbn") and got["who"]["semantic_type"] == "person"
    assert [got[c]["semantic_type"] for c in ("day", "moment", "hour")] == ["calendar", "timestamp", "clock"]
    assert got["words"]["format_label"] is None and got["words"]["depth"] <= 3
    assert got["money"]["format_label"] is None and got["money"]["depth"] <= 3
    assert got["blank"]["depth"] == 0 and got["blank"]["data_type"] is None
    assert got["words"]["data_type"] in ("text", None) and got["money"]["data_type"] in ("number", None), (got["words"], got["money"])


def test_foil_is_rejected_by_validating_recipes(spark):
    foil = spark.createDataFrame([("foil", v, 1) for v in catalogue.FOIL], "column string, v string, w long")
    rates = {r["recipe"]: r["confirm"] for r in catalogue.recipe_rates(foil, ["as_isbn", "lookup:usps", "as_mmddyyyy", "as_factor", "as_number", "as_email"]).collect()}
    assert all(rates[k] <= 0.05 for k in ("as_isbn", "lookup:usps", "as_mmddyyyy", "as_email")) and rates["as_factor"] == 1


def test_classify_table_and_pairs(spark):
    df = spark.createDataFrame([(f"{i:05d}", f"2019-01-{i % 28 + 1:02d}", "CA" if i % 2 else "TX") for i in range(60)], "code string, day string, st string")
    predictions, features = catalogue.classify_table(df, blocks=["length", "mask"])
    got = {r["column"]: r for r in predictions.collect()}
    assert got["st"]["guess"] == "us_state" and got["day"]["route_semantic_type"] == "calendar" and {r["column"] for r in features.collect()} == {"code", "day", "st"}
    signed = similarity.signatures(values_frame(df))
    rows = similarity.explain_pair(signed, "code", "st").collect()
    distance = signed.alias("a").where("column = 'code'").join(signed.alias("b").where("column = 'st'")).select(similarity.signature_distance("a", "b")).first()[0]
    assert len(rows) == 7 and abs(sum(r["part"] for r in rows if r["part"] is not None) - distance) < 1e-9
    table = catalogue.ontology_table(spark)
    assert df.select(catalogue.stabilize_by(F.lit("$1,200.50"), table, "usd")).first()[0] == "1200.5"
    with pytest.raises(ValueError):
        catalogue.stabilize_by(F.col("c"), table, "nonsense")
    with pytest.raises(ValueError):
        catalogue.stabilize_by(F.col("c"), table, "person", "nonsense")


def test_audit(spark):
    hazards = {r["variant_id"]: r["hazards"] for r in catalogue.audit(catalogue.ontology_table(spark)).collect()}
    assert "leading_zeros_dropped" in hazards["n0046-f04"]
