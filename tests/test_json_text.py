"""JSON held as text: changed members, and everything else as it was."""

import json
import random

from pyspark.sql import functions as F

from veilspark.functions.json_text import member, members, quoted, scalar, written
from veilspark.operators.records import clean_records


def made(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 6)
    if kind == 0:
        return None
    if kind == 1:
        return rng.choice([True, False])
    if kind == 2:
        return rng.choice([0, -5, 10 ** 40, 2 ** 53 + 1, 7])
    if kind == 3:
        return rng.choice([1.5, -0.25, 0.000007, 1e300])
    if kind in (4, 5):
        return rng.choice(["", "a", 'q"\\/', "é\n\t", "12", "null", "{}", "😀"])
    if kind == 6:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "city", 'k"', "é", "z"]): made(rng, depth + 1) for _ in range(rng.randrange(5))}


def test_members_survive_a_change(spark):
    rng = random.Random(1)
    values = [{**{f"k{i}": made(rng) for i in range(rng.randrange(6))}, "city": rng.choice(["x", None, 3])}
              for _ in range(150)]
    rows = [(i, json.dumps(v, ensure_ascii=bool(i % 2), indent=i % 3 or None)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", members(F.col("t")).alias("m"))
    got = df.select("i", written(F.col("m"), {"city": F.when(F.col("i") % 2 == 0, quoted(F.lit('new"')))}),
                    scalar(member(F.col("m"), "city"))).collect()
    for i, text, city in got:
        want = dict(values[i])
        if i % 2 == 0:
            want["city"] = 'new"'
        assert json.loads(text) == want and list(json.loads(text)) == list(want)
        assert city == (None if values[i]["city"] is None else str(values[i]["city"]))


def test_what_is_no_object(spark):
    texts = [None, "", "no", "[1]", '"s"', "3", '{"a":1} x', '{"a":1},{"b":2}', "{", "{}",
             '{"a":1,"b":2,"a":"3"}', '{"a":{"b":1,"b":"2"}}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        written(members(F.col("t")), {})).collect()]
    assert got == [None] * 9 + ["{}", '{"b":2,"a":"3"}', '{"a":{"b":1,"b":"2"}}']


def test_records_keep_every_key(spark):
    place = {"zip": None, "city": "Newton-On-Tees", "geoCoordinates": {"altitude": 0.00001, "latitude": 54.123457,
                                                                       "longitude": None}, "x": [1, {"y": None}]}
    device = {"trustType": "AD", "deviceId": 5, "isCompliant": None}
    rows = spark.createDataFrame([(json.dumps(place), json.dumps(device), "keep")],
                                 "LocationDetails string, DeviceDetail string, other string")
    got = clean_records(rows, fields=()).head()
    out = json.loads(got["LocationDetails"])
    assert out["city"] != place["city"] and out["geoCoordinates"]["latitude"] != 54.123457
    assert isinstance(out["geoCoordinates"]["latitude"], float)
    out["city"], out["geoCoordinates"]["latitude"] = place["city"], 54.123457
    assert out == place and json.loads(got["DeviceDetail"]) == device and got["other"] == "keep"
