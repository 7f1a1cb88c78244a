import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from feedloom.functions.timestamps import host_of, utc_micros


def us(y, mo, d, h=0, mi=0, s=0, micro=0, offset=0):
    t = dt.datetime(y, mo, d, h, mi, s, micro, dt.UTC) - dt.timedelta(minutes=offset)
    return (t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)


CASES = [
    ("Mon, 26 Dec 2011 10:44:54 -0500", None, us(2011, 12, 26, 10, 44, 54, offset=-300)),
    ("Sun, 26 Dec 2011 10:44:54 -0500", None, us(2011, 12, 26, 10, 44, 54, offset=-300)),  # the weekday is wrong
    ("2013-02-09T10:25:15Z", None, us(2013, 2, 9, 10, 25, 15)),
    ("2013-02-09t10:25:15.1234567z", None, us(2013, 2, 9, 10, 25, 15, 123456)),
    ("2012-10-15 10:32+05:45", None, us(2012, 10, 15, 10, 32, offset=345)),
    ("2011-07-06T17:51:11,559-0330", None, us(2011, 7, 6, 17, 51, 11, 559000, -210)),
    ("20121115T134721", "Asia/Kolkata", us(2012, 11, 15, 13, 47, 21, offset=330)),
    ("Saturday, 26-Oct-13 21:04:33 EDT", None, us(2013, 10, 26, 21, 4, 33, offset=-240)),
    ("Thu Jun  2 07:36:14 2011", "UTC", us(2011, 6, 2, 7, 36, 14)),
    ("7/21/2012 8:54 PM", None, us(2012, 7, 21, 20, 54)),
    ("8/13/2012 12:19 AM", None, us(2012, 8, 13, 0, 19)),
    ("Oct 13, 2013 12:49 pm", None, us(2013, 10, 13, 12, 49)),
    ("01.08.2013 04:20", "Europe/Berlin", us(2013, 8, 1, 4, 20, offset=120)),
    ("2013/06/05 16:00:55", None, us(2013, 6, 5, 16, 0, 55)),
    ("2010年1月26日 下午11:31", None, us(2010, 1, 26, 23, 31)),
    ("2010年1月26日 上午12:05", None, us(2010, 1, 26, 0, 5)),
    ("mar., 24 août 2010 01:13:52 +0200", None, us(2010, 8, 24, 1, 13, 52, offset=120)),
    ("Sa, 24 Mär 2012 20:51:15 -0330", None, us(2012, 3, 24, 20, 51, 15, offset=-210)),
    ("7 авг 2013 23:47", "Europe/Moscow", us(2013, 8, 7, 23, 47, offset=240)),
    ("Mon, 14 Feb 2011 19:18:48 +0800 (server time)", None, us(2011, 2, 14, 19, 18, 48, offset=480)),
    ("\n    TUE, 27 DEC 2011 17:10:38 -0500\n", None, us(2011, 12, 27, 17, 10, 38, offset=-300)),
    ("2010-06-09", "America/New_York", us(2010, 6, 9, 4)),
    ("1268861774", None, 1268861774000000),
    ("1388137421021", None, 1388137421021000),
    ("1332702496100276", None, 1332702496100276),
    ("1332702496100276123", None, 1332702496100276),
    ("1383334476.71", None, 1383334476710000),
    # a wall time that occurs twice is the first, one that is skipped moves on by the gap
    ("2013-11-03 01:30:00", "America/New_York", us(2013, 11, 3, 5, 30)),
    ("2013-03-10 02:30:00", "America/New_York", us(2013, 3, 10, 7, 30)),
    *[(s, None, None) for s in (None, "", "   ", "yesterday", "2 hours ago", "25:61", "2012-13-45T00:00:00Z", "Thu, 31 Feb 2012 10:00:00 +0000", "Wed, 00 Jan 1900", "0000-00-00 00:00:00", "1e", "soon", "{{ pubDate }}", "2012-01-01T10:00:00+99:00", "2012-01-01 13:00 PM", "x" * 5000)],
]


def test_cascade(spark):
    df = spark.createDataFrame([(i, s, z) for i, (s, z, _) in enumerate(CASES)], "i int, s string, z string")
    got = {r["i"]: r["us"] for r in df.select("i", utc_micros(F.col("s"), F.col("z")).alias("us")).collect()}
    assert [(CASES[i][0], got[i]) for i in range(len(CASES)) if got[i] != CASES[i][2]] == []


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Australia/Sydney", "Asia/Kolkata"])
def test_wall_times_against_zoneinfo(spark, zone):
    start, rows = dt.datetime(2012, 1, 1), []
    for k in range(0, 366 * 24, 7):
        rows.append((start + dt.timedelta(hours=k, minutes=30),))
    df = spark.createDataFrame([(r[0].strftime("%Y-%m-%d %H:%M:%S"),) for r in rows], "s string")
    got = {r["s"]: r["us"] for r in df.select("s", utc_micros(F.col("s"), F.lit(zone)).alias("us")).collect()}
    for (t,) in rows:
        want = t.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(dt.UTC)  # zoneinfo has the same rule for gaps with fold 0
        assert got[t.strftime("%Y-%m-%d %H:%M:%S")] == us(*want.timetuple()[:6])


def test_host(spark):
    df = spark.createDataFrame([("http://A.test/x",), ("https://u@b.test:80?q",), ("x",), (None,)], "u string")
    assert [r[0] for r in df.select(host_of(F.col("u"))).collect()] == ["a.test", "b.test", "", None]
