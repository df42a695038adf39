"""Line protocol in both directions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolake.errors import BadRequest, EncodeError
from chronolake.model import Point
from chronolake.sources import line_protocol as lp


def one(text):
    return lp.parse(text)[0]


@pytest.mark.parametrize(
    ("text", "value"),
    [("1i", 1), ("-42i", -42), ("1", 1.0), ("5", 5.0), ("1.5", 1.5), ("-3.14", -3.14), ("1.5e10", 1.5e10), ('"s"', "s"), ('"a b,c=d"', "a b,c=d"), (r'"say \"hi\""', 'say "hi"'), ("true", True), ("FALSE", False), ("True", True)],
)
def test_values(text, value):
    found = one(f"m value={text} 1").fields["value"]
    assert found == value and type(found) is type(value)


@pytest.mark.parametrize("text", ["t", "f", "1u", "NaN", "inf", "xi", "1.5i", '"open', "", "1x"])
def test_bad_values(text):
    with pytest.raises(BadRequest):
        one(f"m value={text} 1")


@pytest.mark.parametrize("line", ["m,=x v=1i", "m,k= v=1i", "m,k v=1i", "m v", "m =1i", "m v=1i xyz", "m v=1i 1.5", "this is not line protocol!!", "m"])
def test_bad_lines(line):
    with pytest.raises(BadRequest):
        lp.parse(line)


def test_escapes_and_names():
    assert one(r"my\ measurement value=1i").measurement == "my measurement"
    assert one(r"my\,measurement field=1i").measurement == "my,measurement"
    assert one(r"m,k=v\=1 f=1i").tags == {"k": "v=1"}
    assert one(r"m,k=v\,1,k2=a\ b f\ x=1i").tags == {"k": "v,1", "k2": "a b"}
    assert one("m,k=a,k=b f=1i").tags == {"k": "b"}
    assert one("m f=1i 5 ignored").time_ns == 5
    assert [r.measurement for r in lp.parse("# no\n\na v=1i\n\nb v=2i\n")] == ["a", "b"]


@pytest.mark.parametrize(("precision", "scale"), [("nanosecond", 1), ("microsecond", 10**3), ("millisecond", 10**6), ("second", 10**9)])
def test_precision(precision, scale):
    assert lp.parse("m v=1i 7", precision)[0].time_ns == 7 * scale


def test_encode():
    assert lp.encode(Point("cpu", {"value": 0.64})) == "cpu value=0.64"
    assert lp.encode(Point("cpu", {"count": 42, "ok": True, "f": 2.0})) == "cpu count=42i,ok=true,f=2.0"
    assert lp.encode(Point("event", {"msg": 'a "b" \\'})) == 'event msg="a \\"b\\" \\\\"'
    assert lp.encode(Point("cpu", {"v": 1}, {"zone": "a", "host": "b", "app": "c d"}, 9)) == "cpu,app=c\\ d,host=b,zone=a v=1i 9"
    assert lp.encode(Point("c", {"max": 2**63 - 1})) == "c max=9223372036854775807i"
    assert lp.encode([]) == ""
    for point, reason in ((Point("m", {}), "empty_fields"), (Point("", {"v": 1}), "empty_measurement"), (Point("m", {"v": 1}, {}, "bad"), "invalid_timestamp")):
        with pytest.raises(EncodeError, match=reason):
            lp.encode(point)


text = st.text(st.characters(codec="utf-8", exclude_characters='\n\r\\"', exclude_categories=("Cs", "Cc", "Z")), min_size=1, max_size=8).filter(lambda t: not t.startswith(('#', '"')) and not t.endswith('"'))
spaced = st.builds(lambda a, b, c: a + c + b, text, text, st.sampled_from(["", " ", ",", "="]))
values = st.one_of(st.integers(-(2**70), 2**70), st.floats(allow_nan=False, allow_infinity=False), st.booleans(), st.text(st.characters(codec="utf-8", exclude_characters="\n\r", exclude_categories=("Cs",)), max_size=9))


@settings(max_examples=150, deadline=None)
@given(spaced.filter(lambda t: "=" not in t), st.dictionaries(spaced, spaced, max_size=3), st.dictionaries(spaced, values, min_size=1, max_size=3), st.integers(-(2**63), 2**63 - 1))
def test_what_is_encoded_parses_back(measurement, tags, fields, stamp):
    row = one(lp.encode(Point(measurement, fields, tags, stamp)))
    assert (row.measurement, row.tags, row.fields, row.time_ns) == (measurement, tags, fields, stamp)


def test_columns_without_a_line(spark):
    from pyspark.sql import functions as F

    from chronolake.sources.line_protocol import encoded

    df = spark.createDataFrame([(1, 1.5, "a"), (2, None, "b"), (3, 1e300, None), (4, 0.1, "c d")], "k long, v double, t string")
    line = encoded("m", {"t": F.col("t")}, {"v": (F.col("v"), "f")}, F.col("k"))
    assert [r[0] for r in df.orderBy("k").select(line).collect()] == ["m,t=a v=1.5 1", None, "m v=1.0E300 3", "m,t=c\\ d v=0.1 4"]
    for bad in (float("nan"), float("inf"), float("-inf")):
        with pytest.raises(Exception, match="invalid_field"):
            spark.createDataFrame([(1, bad, "a")], "k long, v double, t string").select(line).collect()
