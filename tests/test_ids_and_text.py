import ast

from pyspark.sql import functions as F

from hostweave.functions import ids, text, timefn
from tests.conftest import rows


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_bytes_literals_decode_like_python(spark):
    raw = [bytes(range(256)), b"\x00A\n'\\", b"it's", b'say "hi"', b"a'b\"c", b"\\x41", b"1\\7", b" "]
    assert column(spark, [repr(b) for b in raw], ids.clean_id("v")) == [b.hex() for b in raw]


def test_other_escapes_decode_like_python(spark):
    literals = [r"b'\a\b\f\v\0\101\7'", r"b'\'\"'"]
    assert column(spark, literals, ids.clean_id("v")) == [
        ast.literal_eval(x).hex() for x in literals]


def test_other_texts_stay(spark):
    kept = ["n12", "", "b'", "b'open", "b'a'b'", "b'\\x4'", "b'é'", "xb'a'", None]
    assert column(spark, kept, ids.clean_id("v")) == kept


def test_long_literal_does_not_recurse(spark):
    body = b"\x01z" * 20_000
    assert column(spark, [repr(body)], ids.clean_id("v")) == [body.hex()]


def test_double_quotes_can_stay_undecoded(spark):
    # Some producers leave these as text; by default they are decoded.
    assert column(spark, ["b\"it's\""], ids.clean_id("v", double_quoted=False)) == ["b\"it's\""]


def test_empty_objects_are_null(spark):
    assert column(spark, ["", "b''", 'b""', "b'A'", None], ids.clean_object_id("v")) == [
        None, None, None, "41", None]


def test_literal_round_trip(spark):
    assert column(spark, ["00ff27"], ids.clean_id(ids.bytes_literal("v"))) == ["00ff27"]


def test_event_class_first_match_wins(spark):
    names = ["EVENT_EXECUTE", "EVENT_WRITE", "EVENT_READ", "EVENT_SENDTO", "EVENT_OPEN",
             "EVENT_WRITE_SOCKET_PARAMS", "EVENT_EXEC_READ"]
    assert column(spark, names, text.event_class("v")) == [
        "EXEC", "WRITE", "READ", "SEND", "OTHER", "WRITE", "EXEC"]


def test_step_weight_text(spark):
    df = spark.range(1).select(text.step_weights_text(F.array(F.lit(0.2), F.lit(0.305), F.lit(0.495))))
    assert df.first()[0] == "T1: 20.0% | T2: 30.5% | T3: 49.5%"


def test_times_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    nanos = 1557241841912000000
    try:
        for name in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:01.123456' AS ts")
            got = df.select(
                timefn.to_micros("ts"), timefn.from_micros(timefn.to_micros("ts")).cast("string"),
                timefn.floor_to("ts", 60).cast("string"),
                timefn.nanos_to_local(F.lit(nanos)).cast("string"),
                timefn.nanos_to_local(F.lit(-1)).cast("string")).first()
            assert tuple(got) == (
                1710037801123456, "2024-03-10 02:30:01.123456", "2024-03-10 02:30:00",
                "2019-05-07 11:10:41.912", "1969-12-31 18:59:59.999999")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_floor_div_is_exact_for_large_numbers(spark):
    df = spark.createDataFrame([(2 ** 60 - 1,), (-1,), (7,)], "v bigint")
    assert rows(df.select(timefn.floor_div(F.col("v"), 1000))) == [
        (-1,), (0,), ((2 ** 60 - 1) // 1000,)]
