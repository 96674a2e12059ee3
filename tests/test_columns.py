"""Scores, headers, profiles, transforms, screens and the ontology on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from prismcol.operators import bank, evaluation, ontology, screens, similarity
from prismcol.operators import profile as P
from prismcol.operators.scoring import classify_names, guess_columns
from prismcol.operators.stabilize import parse_transform, stabilize, transform
from prismcol.sources.values import values_frame


def column(spark, values, name="c"):
    return spark.createDataFrame([(v,) for v in values], f"`{name}` string")


def test_guesses(spark):
    cases = {
        "code": (["USD", "EUR", "JPY", "GBP"], "currency_code", "value"), "county": (["06037", "36061", "48201"], "county_fips", "value"), "weight": (["a@b.com", "c@d.org"], "email", "value"),
        "sampling_weight": (["3.4", "5.1", "7.8", "2.2"], "weight", "name"), "xqz_blob_42": (["3.4", "5.1"], None, "none"), "when": (["FY2018", "FY2019"], "fiscal_year", "value"), "tax_period_end": (["201701", "201702"], "yyyymm", "value"), "fruit": (["apple", None, " "], None, "none"),
    }
    frames = [values_frame(column(spark, v, k)) for k, (v, _, _) in cases.items()]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    got = {r["column"]: (r["guess"], r["source"]) for r in guess_columns(rows).collect()}
    assert got == {k: (g, s) for k, (_, g, s) in cases.items()}


def test_headers(spark):
    rows = classify_names(spark.createDataFrame([("customerId",), ("unit_price",), ("blob",)], "column string")).collect()
    assert [(r["header"], r["name_class"]) for r in rows] == [("customer id", "record_id"), ("unit price", "currency"), ("blob", None)]


@pytest.mark.parametrize("block", ["core", "length", "charclass", "mask", "charfreq", "numeric", "regex", "zipf", "punct"])
def test_copies_change_no_share(spark, block):
    values = ["12-3456789", "98-7654321", "Quercus alba", "12.50", "a@b.com", "7", "8", None]
    one, three = (P.BLOCKS[block](values_frame(column(spark, values * k))).first().asDict() for k in (1, 3))
    # Quantiles interpolate between neighbours, which copies move.
    counts = {"num_iqr", "num_median", "len_median", "n", "n_usable", "max_value_freq", "mean_value_freq", "unique_ratio", "is_candidate_key", "hapax_ratio"}
    for name in one.keys() - counts:
        a, b = one[name], three[name]
        assert a == b or abs(a - b) < 1e-6, name


def test_profile_of_edge_columns(spark):
    df = spark.createDataFrame([(None, "", "x")] * 3, "a string, b string, c string")
    rows = {r["column"]: r for r in P.profile(df, blocks=["length", "mask"]).collect()}
    assert rows["a"]["pct_missing"] == 1 and rows["b"]["pct_sentinel_na"] == 1 and rows["c"]["is_constant"] == 1 and rows["a"]["n_unique"] == 0
    assert P.profile(df.limit(0), blocks=["length"]).count() == 0


def test_transforms(spark):
    def run(v, expression):
        return column(spark, [v]).select(transform(F.col("c"), expression)).first()[0]

    cases = [("$1,234.50", "as_usd", "1234.5"), ("03/15/2019", "as_mmddyyyy", "2019-03-15"), ("03/04/2019", "as_mmddyyyy", "2019-04-03"), ("Mar 5, 2020 14:30", "as_datetime", "2020-03-05T14:30:00"), ("2:05 PM 3/4", "as_mmddyyyy", None),
             ("isbn 0395629764", "as_isbn", "0395629764"), ("123456789", "as_ein", "12-3456789"), ("12345678", "as_ein", None), ("Yes", "as_boolean", "TRUE"), ("Smith, John", "as_full_name", "John Smith"), ("Tx", "lookup:usps", "TX"), ("7", "zeropad5", "00007"),
             ("$5", "{{ [strip:$][dec:1] }}", "5.0"), ("x", "no_such_verb", None), ("x", "", None), (None, "as_id", None), ("1.7", "as_integer", None), ("q1 2020", "as_quarter", "Q12020")]
    for v, e, want in cases:
        assert run(v, e) == want, (v, e)
    assert parse_transform("as_number+dec:2") == [("as_number", None), ("dec", "2")]
    with pytest.raises(ValueError):
        stabilize(F.col("c"), "nonsense")


def test_screens(spark):
    df = spark.createDataFrame([("007", "MAR1", "-x", "1.50")] * 9 + [("12", "SEPT2", "y", "2")], "zip string, gene string, f string, d string")
    got = {r["column"]: r for r in screens.roundtrip(values_frame(df)).collect()}
    assert got["zip"]["hazards"] == "leading_zeros_dropped" and got["zip"]["value_changed"] and got["gene"]["hazards"] == "symbol_coerced_to_date" and got["f"]["hazards"] == "formula_injection" and got["d"]["inferred"] == "double"
    verdicts = {r["column"]: r["verdict"] for r in screens.triage(values_frame(spark.range(10).select(F.col("id").cast("string").alias("ids"), F.lit("é漢字").alias("same")))).collect()}
    assert verdicts == {"ids": "clean", "same": "empty"}


def test_paths_and_feasibility(spark):
    df = spark.createDataFrame([("a/b/c", p) for p in ("a/b/c", "a/b/x", "a/x/c", "x/b/c")], "p string, q string")
    assert [round(r[0], 6) for r in df.select(similarity.path_distance(F.col("p"), F.col("q"))).collect()] == [0, 0.333333, 0.666667, 1]
    rows = [(("a", "b", "c"), ("a", "b", "c"), 3, 0), (("a", None, None), ("a", "b", "c"), 3, 1), (("a", "b", "x"), ("a", "b", "c"), 2, 0), (("x", "b", "c"), ("a", "b", "c"), 3, 2), ((None,) * 3, ("a", "", ""), 1, 2), ((None,) * 3, (None, "", None), 0, 0), (("a", "", ""), (None, "", None), 0, 2)]
    df = spark.createDataFrame([(*p, *q, d, want) for p, q, d, want in rows], "p1 string, p2 string, p3 string, q1 string, q2 string, q3 string, d int, want int")
    got = df.withColumn("got", evaluation.feasibility([F.col(f"p{k}") for k in (1, 2, 3)], [F.col(f"q{k}") for k in (1, 2, 3)], F.col("d")))
    assert got.where("got <> want").count() == 0


def test_governance(spark):
    levels = "data_type string, semantic_family string, semantic_type string, semantic_type_id string"
    rows = spark.createDataFrame([("number", "quantity", "measurement", None), ("text", "", "person", None), (None, None, None, None), ("text", None, None, "n1"), (None, None, None, "n1")], levels)
    known = spark.createDataFrame([("number", "quantity", "measurement", "n1")], levels)
    assert sorted(r["depth_labeled"] for r in ontology.governance(rows, known).collect()) == [0, 1, 1, 3, 3]
    assert ontology.governance(rows).columns == ["data_type", "semantic_family", "semantic_type", "semantic_type_id", "depth_labeled", "confidence", "ontology_version", "detector_id"]


def test_bank_files(spark, tmp_path):
    values = values_frame(spark.createDataFrame([(f"v{i % 400}", str(i % 3)) for i in range(2000)], "many string, few string"))
    labels = spark.createDataFrame([("many", "text", "t1", "hard"), ("few", "number", "t2", None)], "column string, data_type string, semantic_type_id string, difficulty string")
    cases = bank.make_cases(values, labels, version="v1")
    bank.write_bank(cases, str(tmp_path / "bank"))
    one = cases.where("case_id = 'few'").toJSON().first()
    (tmp_path / "single").mkdir()
    (tmp_path / "single" / "few.json").write_text(json.dumps(json.loads(one), indent=2))
    assert bank.index_bank(bank.read_bank(spark, str(tmp_path / "single"))).first()["semantic_type_id"] == "t2"
    back = {r["case_id"]: r for r in bank.read_bank(spark, str(tmp_path / "bank"), lines=True).collect()}
    assert back["many"]["values"]["storage_mode"] == "sample" and back["many"]["values"]["n_stored"] == 100 and not back["many"]["values"]["is_lossless"]
    assert [(x["value"], x["count"]) for x in back["few"]["values"]["data"]] == [("0", 667), ("1", 667), ("2", 666)] and back["few"]["label"]["semantic_type_id"] == "t2"
    index = bank.index_bank(bank.read_bank(spark, str(tmp_path / "bank"), lines=True))
    assert {(r["case_id"], r["difficulty"], r["ontology_version"]) for r in index.collect()} == {("many", "hard", "v1"), ("few", None, "v1")}
    diff = spark.createDataFrame([("t1", "merged", "a/b/c", "a/b/d", "mechanical", "x", "n")], "semantic_type_id string, change_kind string, from_path string, to_path string, case_impact string, scoring_impact string, note string")
    flagged = bank.flag_cases(bank.read_bank(spark, str(tmp_path / "bank"), lines=True), bank.impacted_cases(diff, index))
    bank.write_bank(flagged, str(tmp_path / "next"))
    queue = bank.relabel_queue(bank.index_bank(bank.read_bank(spark, str(tmp_path / "next"), lines=True))).collect()
    assert [(r["case_id"], r["relabel_trigger"]) for r in queue] == [("many", "merged of t1 (a/b/c -> a/b/d)")]
