import numpy as np
import pytest

from leitmotiv.sources import points as src
from leitmotiv.sources import spectral, tsf, wfdb

GOOD = """# a comment
@relation x
@attribute name string
@attribute start date
@attribute code numeric
@frequency daily
@horizon 30
@missing true
@equallength false
@data
# one more
T1:2020-01-02 03-04-05:7:1.5,?,3
Tü:2020-02-02 00-00-00:-8:4,5
"""


def rows(df):
    return [(r["t"], r["dim"], r["value"]) for r in df.orderBy("t", "dim").collect()]


def test_tsf(spark, tmp_path):
    f = tmp_path / "x.tsf"
    f.write_bytes(GOOD.encode("cp1252"))
    df, head = tsf.read_tsf(spark, str(f))
    a, b = df.orderBy("series_no").collect()
    assert (a["name"], str(a["start"]), a["code"], a["series_value"]) == ("T1", "2020-01-02 03:04:05", 7, [1.5, None, 3.0])
    assert (b["name"], b["code"], b["series_value"]) == ("Tü", -8, [4.0, 5.0])
    assert (head.frequency, head.horizon, head.missing, head.equallength) == ("daily", 30, True, False)
    assert rows(tsf.tsf_points(df)) == [(0, 0, 1.5), (0, 1, 4.0), (1, 0, 0.0), (1, 1, 5.0), (2, 0, 3.0)]


@pytest.mark.parametrize(
    "text",
    ["", "@attribute a\n@data\nx:1\n", "@frequency\n@attribute a string\n@data\nx:1\n", "@data\nx:1\n", "@attribute a string\nx:1\n", "@attribute a string\n@data\n", "@attribute a complex\n@data\nx:1\n", "@attribute a string\n@data\nx:y:1\n", "@attribute a string\n@data\nx:?,?\n"],
)
def test_tsf_errors(spark, tmp_path, text):
    f = tmp_path / "x.tsf"
    f.write_text(text)
    with pytest.raises(Exception):  # noqa: B017  ValueError on the driver, Spark's own from a task
        tsf.read_tsf(spark, str(f))[0].collect()


def test_wfdb(spark, tmp_path):
    raw = np.array([[100, -50], [300, 7], [-32768, 9]], "<i2")
    (tmp_path / "r1.dat").write_bytes(raw.tobytes())
    (tmp_path / "r1.hea").write_text("r1 2 100 3\nr1.dat 16 10.5(-5)/g 0 0 1 2 0 v-acceleration\nr1.dat 16 2(1)/degrees/s 0 0 1 2 0 yaw\n#Age: 3\n")
    spark.dataSource.register(wfdb.WfdbSource)
    df = spark.read.format("wfdb").option("samplesPerTask", 2).load(str(tmp_path / "r1"))
    got = {(r["t"], r["dim"]): r["value"] for r in df.collect()}
    assert len(got) == 6 and got[0, 0] == 10.0 and got[1, 1] == 3.0 and np.isnan(got[2, 0])
    head = wfdb.parse_header((tmp_path / "r1.hea").read_text())
    assert (head.frequency, head.samples, head.signals[1].unit, head.signals[0].name) == (100.0, 3, "degrees/s", "v-acceleration")


def test_text_files(spark, tmp_path):
    (tmp_path / "a.dat").write_text("  0  1.5   2\n 1 3 4e1\n\n")
    assert rows(src.read_whitespace(spark, str(tmp_path / "a.dat"))) == [(0, 0, 1.5), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 40.0)]
    (tmp_path / "a.csv").write_text("Time,Unix,x,y,Issues\na,1,1.5,2,0\nb,2,3,4,0\n")
    assert rows(src.read_csv(spark, str(tmp_path / "a.csv"), drop=("Time", "Unix", "Issues"))) == [(0, 0, 1.5), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]


def test_parquet_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "x double, y double").coalesce(1)
    src.write_parquet(df, str(tmp_path / "p"))
    assert rows(src.read_parquet(spark, str(tmp_path / "p"))) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]
    assert rows(src.read_parquet(spark, str(tmp_path / "p"), transpose=True)) == [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 4.0)]
    for _ in range(2):
        src.write_csv(df, str(tmp_path / "c"), append=True)
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 4
    src.append_text(str(tmp_path / "log.txt"), "one")
    src.append_text(str(tmp_path / "log.txt"), "two")
    assert (tmp_path / "log.txt").read_text() == "one\ntwo\n"


def test_shared_table(spark):
    df = spark.createDataFrame([("s", 0, 0, 1.0)], src.POINTS)
    assert src.share(df, "shared_points").count() == 1 and spark.catalog.isCached("shared_points")
    spark.catalog.uncacheTable("shared_points")


def samples(spark, x):
    return spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(x)], "series_id string, t bigint, value double")


def test_band_energies(spark, monkeypatch):
    monkeypatch.setattr(spectral, "FRAMES", 16)
    rate, t = 40.0, np.arange(400)
    x = np.sin(2 * np.pi * 10 * t / rate)
    got = {(r["t"], r["dim"]): r["value"] for r in spectral.band_energies(samples(spark, x), rate, bands=4).collect()}
    assert len(got) == 4 * 99
    energy = [sum(got[f, b] for f in range(99)) for b in range(4)]
    assert int(np.nanargmax(energy)) == 1 and np.isnan(energy[3])  # 10 Hz, of the bands from 1 to 20; none of the transform's is in the last
    w = spectral.tukey(8)
    seg = x[40:48] - x[40:48].mean()
    power = np.abs(np.fft.rfft(seg * w)) ** 2 / (rate * (w**2).sum()) * np.array([1, 2, 2, 2, 1])
    assert np.isclose(got[10, 1], power[2])


def test_mel_decibels(spark, monkeypatch):
    monkeypatch.setattr(spectral, "FRAMES", 8)
    rate, t = 16000.0, np.arange(6000)
    out = spectral.mel_decibels(samples(spark, np.sin(2 * np.pi * 1000 * t / rate)), rate, bands=16).collect()
    value = {(r["t"], r["dim"]): r["value"] for r in out}
    assert len(value) == 16 * (6000 // 128 + 1) and max(value.values()) == 0 and min(value.values()) >= -80
    loudest = max(range(16), key=lambda b: value[20, b])
    filters = spectral.mel_filters(rate, 2048, 16, 0, 8000)
    assert loudest == int(filters[:, 128].argmax())
