from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import types as T

from corpuslens.operators.instants import resolve_instants

REC = T.StructType([T.StructField("record_no", T.LongType()), T.StructField("collection", T.StringType()),
                    T.StructField("chunk_id", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
                    T.StructField("default_tz", T.StringType())])
SET = T.StructType([T.StructField("collection", T.StringType()), T.StructField("default_tz", T.StringType()), T.StructField("date_order", T.StringType())])


def us(*a, tz=timezone.utc, f=0):
    return int((datetime(*a, tzinfo=tz) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)) + f


def run(spark, cases, settings):
    rows = [(i, c, cid, m, "clash") for i, (c, cid, m, _) in enumerate(cases)]
    out = resolve_instants(spark.createDataFrame(rows, REC), spark.createDataFrame(settings, SET))
    assert "default_tz" in out.columns
    return {r.record_no: (r.utc_us, r.instant_source, r.ambiguous) for r in out.collect()}


def test_spellings(spark):
    ny = ZoneInfo("America/New_York")
    m = lambda v, **k: {"created_at": v, **k}
    cases = [
        ("a", "x", m("2024-05-01T10:00:00Z"), us(2024, 5, 1, 10)),
        ("a", "x", m("\t 2024-05-01 10:00:00.1234567891Z\n"), us(2024, 5, 1, 10, f=123456)),
        ("a", "x", m("2024-05-01T10:00:00+05:30"), us(2024, 5, 1, 4, 30)),
        ("a", "x", m("2024-05-01 10:00:00-0230"), us(2024, 5, 1, 12, 30)),
        ("a", "x", m("01/02/2024 03:04"), us(2024, 2, 1, 3, 4)),
        ("b", "x", m("01/02/2024 3:04 PM"), us(2024, 1, 2, 15, 4, tz=ny)),
        ("b", "x", m("12/12/2024 12:04 AM"), us(2024, 12, 12, 0, 4, tz=ny)),
        ("b", "x", m("13/01/2024 03:04"), None),
        ("b", "x", m("01.02.2024 03:04:05"), us(2024, 2, 1, 3, 4, 5, tz=ny)),
        ("b", "x", m("2024-11-03 01:30:00"), us(2024, 11, 3, 5, 30)),  # repeated hour: first pass
        ("b", "x", m("2024-03-10 02:30:00"), us(2024, 3, 10, 7, 30)),  # skipped hour: forward
        ("b", "x", m("2024-03-10"), us(2024, 3, 10, 5)),
        ("b", "x", m("2024-03-10 10:00", tz="Asia/Tokyo"), us(2024, 3, 10, 1)),
        ("b", "x", m("2024-03-10 10:00", tz="No/Zone"), us(2024, 3, 10, 14)),
        ("z", "x", m("5 Jun 2022 04:09"), us(2022, 6, 5, 4, 9)),
        ("z", "x", m("Mon, 24 Jul 2023 05:49:58 +0200"), us(2023, 7, 24, 3, 49, 58)),
        ("z", "x", m("28 Jun 2025 10:00 AEST"), us(2025, 6, 28, 0)),
        ("z", "x", m("20250101T024743Z"), us(2025, 1, 1, 2, 47, 43)),
        ("z", "x", m("1684224669.10"), 1684224669100000),
        ("z", "x", m("1713530928233"), 1713530928233000),
        ("z", "x", m("1736346152391802"), 1736346152391802),
        ("z", "x", {"createdAt": "2024-05-01T10:00Z"}, us(2024, 5, 1, 10)),
        ("z", "x", m("2023-02-30 10:00"), None), ("z", "x", m("0000-00-00 00:00:00"), None),
        ("z", "x", m("2024-13-45T00:00:00Z"), None), ("z", "x", m("v2024"), None), ("z", "x", m(""), None),
        ("z", "x", m("2024-05-01 10:00 XYZ"), None), ("z", None, None, None), (None, None, m("2024-01-01"), us(2024, 1, 1)),
        ("z", "x", m("9" * 5000), None), ("z", "x", m(None), None),
    ]
    got = run(spark, cases, [("a", None, "DMY"), ("b", "America/New_York", "MDY"), ("b", "America/New_York", "MDY")])
    for i, c in enumerate(cases):
        assert got[i][0] == c[3], (c, got[i])


def test_ids(spark):
    import uuid

    u = uuid.uuid1()
    want = (u.time - 0x01B21DD213814000) // 10
    cases = [("z", str(u), None, want), ("z", str(u).upper(), {"created_at": "n/a"}, want), ("z", str(uuid.uuid4()), {}, None),
             ("z", "01ARZ3NDEKTSV4RRFFQ69G5FAV", None, 1469922850259000), ("z", "01arz3ndektsv4rrffq69g5fav", None, 1469922850259000),
             ("z", "01ARZ3NDEKTSV4RRFFQ69G5FAU", None, None), ("z", "01ARZ3NDEKTSV4RRFFQ69G5FA", None, None)]
    got = run(spark, cases, [])
    assert [got[i][0] for i in range(len(cases))] == [c[3] for c in cases]
    assert got[0][1] == "uuid_v1" and got[3][1] == "ulid" and got[2][1] is None


def test_orders_are_learned(spark):
    v = lambda x: {"created_at": x}
    cases = [("u", "x", v(f"{d}/01/2024"), None) for d in range(13, 28)] + [("u", "x", v("03/04/2024"), None)]
    cases += [("w", "x", v("03/04/2024"), None)]
    got = run(spark, cases, [("u", None, None)])
    assert got[15][0] == us(2024, 4, 3) and not got[15][2]
    assert got[16] == (None, None, True)


def test_two_digit_dates(spark):
    """Orders of short dates: learned where the source shows them, ambiguous where it doesn't."""
    v = lambda x: {"created_at": x}
    year = [("y", "x", v(f"{y}-{m:02}-28 10:00"), None) for y in range(95, 100) for m in (1, 5, 11)] + [("y", "x", v("21-03-04"), None)]
    day = [("d", "x", v(f"{d}.12.99"), None) for d in range(13, 29)] + [("d", "x", v("05.06.07"), None), ("d", "x", v("31/12/98"), None)]
    lone = [("l", "x", v("05-06-07"), None), ("l", "x", v("07-07-07"), None), ("l", "x", v("99-99-99"), None), ("m", "x", v("05/06/07"), None), ("l", "x", v("5-6-7"), None)]
    cases = year + day + lone
    got = run(spark, cases, [("y", None, None), ("m", None, "MDY")])
    n, k = len(year), len(year) + len(day)
    assert got[n - 1][:2] == (us(2021, 3, 4), "metadata_field") and got[0][0] == us(1995, 1, 28, 10)
    assert got[k - 2][0] == us(2007, 6, 5) and got[k - 1][0] == us(1998, 12, 31) and got[n][0] == us(1999, 12, 13)
    assert got[k] == (None, None, True) and got[k + 1][0] == us(2007, 7, 7) and got[k + 2] == (None, None, False) and got[k + 3][0] == us(2007, 5, 6) and got[k + 4][0] is None


def test_a_mixed_source_stays_open(spark):
    """Day-first and month-first values in equal number leave the others ambiguous; what only one order allows is read."""
    v = lambda x: {"created_at": x}
    cases = [("u", "x", v(f"{d}/01/2024"), None) for d in range(13, 28)] + [("u", "x", v(f"01/{d}/2024"), None) for d in range(13, 28)] + [("u", "x", v("03/04/2024"), None)]
    got = run(spark, cases, [])
    assert got[0][0] == us(2024, 1, 13) and got[15][0] == us(2024, 1, 13) and got[30] == (None, None, True)


def test_future_readings_are_rare(spark):
    """A reading after the record was received hardly counts."""
    rows = [(i, "u", "x", {"created_at": x}, datetime(2024, 6, 1)) for i, x in enumerate(["02/11/2024", "03/10/2024", "04/12/2024", "05/09/2024"])]
    df = spark.createDataFrame(rows, "record_no long, collection string, chunk_id string, metadata map<string,string>, received_at timestamp_ntz")
    got = {r.record_no: r.utc_us for r in resolve_instants(df, spark.createDataFrame([], SET)).collect()}
    assert got == {0: us(2024, 2, 11), 1: us(2024, 3, 10), 2: us(2024, 4, 12), 3: us(2024, 5, 9)}


def test_empty(spark):
    assert run(spark, [], [("u", None, None)]) == {}
