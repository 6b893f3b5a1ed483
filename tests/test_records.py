"""Records, comparison, configuration."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veilspark.operators import compare, config, records
from veilspark.sources.derived import SIGNINS
from veilspark.sources.files import read_records, write_records

FOLDER = "/root/testdata/sf0.001"


def test_in_place_cleaning_agrees_with_the_dictionary(spark):
    rows = SIGNINS.frame(spark, FOLDER)
    values = records.extract_values(rows, "entry")
    words = records.dictionary(values)
    by_words = records.apply_dictionary(values, words, "entry").select(
        "entry", "field", "cleaned")
    in_place = records.extract_values(
        records.clean_records(rows), "entry").withColumnRenamed("value", "cleaned")
    assert by_words.exceptAll(in_place).count() == 0
    assert in_place.exceptAll(by_words).count() == 0


def test_json_fields(spark):
    row = SIGNINS.frame(spark, FOLDER).limit(1)
    text = ('{"city":"Newton-On-Tees","state":"{PII9}","countryOrRegion":"GB",'
            '"geoCoordinates":{"latitude":0.000007,"longitude":null}}')
    out = records.clean_records(row.withColumn("LocationDetails", F.lit(text))).select(
        F.parse_json("LocationDetails").alias("j")).selectExpr(
        "variant_get(j, '$.city', 'string') as city", "variant_get(j, '$.state', 'string') as state",
        "schema_of_variant(variant_get(j, '$.geoCoordinates.latitude')) as kind",
        "variant_get(j, '$.countryOrRegion', 'string') as country").first()
    assert out["city"] != "Newton-On-Tees" and out["state"] == "{PII9}"
    assert out["country"] == "GB" and out["kind"].startswith("DECIMAL")
    broken = records.clean_records(row.withColumn("LocationDetails", F.lit("not json"))).first()
    assert broken["LocationDetails"] == "not json"


def test_json_list_and_single_object(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"a": "x"}, {"a": "é"}]', encoding="utf-8")
    (tmp_path / "one.json").write_text('{"a": "z"}', encoding="utf-8")
    assert read_records(spark, str(tmp_path / "list.json"), "a string", True).count() == 2
    assert read_records(spark, str(tmp_path / "one.json"), "a string", True).first()["a"] == "z"
    write_records(read_records(spark, str(tmp_path / "list.json"), "a string", True),
                  str(tmp_path / "out"))
    assert {r["a"] for r in read_records(spark, str(tmp_path / "out"), "a string", False)
            .collect()} == {"x", "é"}


def test_written_records_are_compressed(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id", "'a value that repeats in every record' as a",
                                        "if(id % 2 = 0, 'é', null) as b")
    write_records(rows, str(tmp_path / "out"))
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("part-*"))
    assert size < 2000 * 20
    back = read_records(spark, str(tmp_path / "out"), rows.schema)
    assert back.exceptAll(rows).count() == 0 and rows.exceptAll(back).count() == 0


def test_comparison(spark):
    schema = "id int, a string, b struct<c:string,d:array<string>>"
    before = spark.createDataFrame(
        [(1, "x@y.org", ("q", ["10.0.0.1", ""])), (2, "same", ("z", [])), (3, "gone", None)], schema)
    after = spark.createDataFrame(
        [(1, "u@v.net", ("q", ["10.9.9.9", ""])), (2, "same", ("z", ["new"]))], schema)
    values = compare.paired_values(before, after, "id")
    assert {tuple(r)[1:] for r in values.filter("id = 1").collect()} == {
        (0, "a", "x@y.org", "u@v.net"), (1, "b.c", "q", "q"), (2, "b.d[0]", "10.0.0.1", "10.9.9.9")}
    assert [tuple(r) for r in compare.by_field(values).collect()] == [("a", 1), ("b", 1)]
    total = compare.summary(values, before, "id").first()
    assert total["total_changes"] == 2 and total["modified_entries"] == 1
    assert tuple(compare.pair_counts(before, after, "id").first()) == (2, 1, 0)
    long = values.withColumn("original", F.repeat(F.lit("x"), 300))
    assert len(compare.samples(long, "id").first()["original"]) == 203


def test_config_round_trip(spark):
    at = datetime(2024, 1, 1)
    configs, types = config.default_config(spark, at)
    loaded = config.load_config(configs, types)
    assert loaded.threshold == 0.7 and len(loaded.entity_types) == 11
    changes = spark.createDataFrame(
        [(1, "CREDIT_CARD", None, "mask", {"chars_to_mask": "4"}), (1, "", True, None, None),
         (1, "URL", None, None, None)],
        "config_id bigint, entity_type string, enabled boolean, strategy string, "
        "strategy_params map<string,string>")
    merged = config.upsert_types(types, changes)
    assert merged.count() == 12
    loaded = config.load_config(configs, merged)
    assert loaded.strategies == {"CREDIT_CARD": ("mask", {"chars_to_mask": 4})}
    assert "URL" in loaded.entity_types
    with pytest.raises(ValueError):
        config.update(configs, F.current_timestamp(), threshold=1.2)
    kept = config.update(configs, F.lit("2024-02-01").cast("timestamp_ntz"), language="de").first()
    assert kept["locale"] == "en_US" and kept["language"] == "de"
    none = configs.filter("id < 0")
    assert config.load_config(none, types).entity_types is None


def test_comparison_is_never_broadcast(spark):
    """The cleaned side is large however small Spark thinks it is."""
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, a string")
    for made in (compare.paired_values(rows, rows, "id"), compare.changed_entries(rows, rows, "id")):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_records_are_cleaned_in_few_rounds_of_the_analyzer(spark):
    one = records.FIELDS[0]
    rows = spark.createDataFrame([
        (1, "mail a@b.example.com", None, None), (2, None, None, None), (3, " ", "not json", "{}")],
        f"entry int, {one} string, LocationDetails string, DeviceDetail string")
    before = spark.conf.get("spark.sql.analyzer.maxIterations", "100")
    spark.conf.set("spark.sql.analyzer.maxIterations", "60")
    try:
        out = records.clean_records(rows, fields=(one,)).collect()
    finally:
        spark.conf.set("spark.sql.analyzer.maxIterations", before)
    words = records.dictionary(rows.selectExpr(f"{one} as value").dropna()).collect()
    cleaned = {w["value"]: w["cleaned"] for w in words}
    assert [r[one] for r in sorted(out)] == [cleaned["mail a@b.example.com"], None, " "]


def test_dictionary_is_cleaned_in_tasks_that_grow_with_the_values(spark):
    values = spark.range(200).selectExpr(
        "'client' || cast(id % 90 as string) || '@mail.example.com' as value")
    words = records.dictionary(values, spread=7)
    assert words.rdd.getNumPartitions() == 7
    assert sorted(words.collect()) == sorted(records.dictionary(values).collect())
    few = records.value_tasks(spark, 10)
    assert records.value_tasks(spark, 10**6) == 38 and few == records.value_tasks(spark, 0)
    assert records.value_tasks(spark, 10**6, per_task=100_000) == 190


def test_all_values_come_from_one_pass(spark):
    row = {c: f"{c}@x.example.com" for c in records.FIELDS}
    places = '{"city":"Rom","state":" ","geoCoordinates":{"latitude":1.50,"longitude":"2.5"}}'
    rows = [dict(row, entry=1, LocationDetails=places, DeviceDetail='{"deviceId":"{PII1}","displayName":"d"}'),
            dict(row, entry=1, Identity=None, UserId="  ", LocationDetails="no json", DeviceDetail=None),
            dict({c: None for c in row}, entry=None, LocationDetails=None, DeviceDetail="{}")]
    names = ["entry", *records.FIELDS, *records.JSON_FIELDS]
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in rows],
                                  ", ".join(f"{n} {'int' if n == 'entry' else 'string'}" for n in names))
    one = records.all_values(frame, "entry")
    two = records.extract_values(frame, "entry").unionByName(records.extract_json_values(frame, "entry"))
    assert sorted(one.collect()) == sorted(two.collect()) and one.count() == 2 * 13 - 2 + 4
    assert one._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
