"""Numbers from pixels and sound, and the run that puts them on the grid."""

import numpy as np
import pytest

from gridloom.functions import media
from gridloom.plans import annotate
from gridloom.sources import stimuli as sources


def test_picture_of_one_colour():
    got = media.picture(np.full((20, 30, 3), [255, 0, 0], np.uint8))
    assert got["luminance"] == pytest.approx(0.299) and got["r_mean"] == 1 and got["b_mean"] == 0
    assert got["rms_contrast"] == pytest.approx(0, abs=1e-12) and got["edge_density"] == 0 and got["entropy"] == 0
    assert (got["hue_mean"], got["sat_mean"], got["val_mean"]) == (0, 1, 1)
    assert got["colorfulness"] == pytest.approx(0.3 * np.hypot(255, 127.5))


def test_edge_of_two_halves():
    gray = np.zeros((16, 16))
    gray[:, 8:] = 1
    found = media.edges(gray)
    assert found[:, 7:9].any(1).all() and not found[:, :6].any() and not found[:, 10:].any()


def test_slope_of_noise_is_flat():
    rng = np.random.default_rng(0)
    assert abs(media.spectral_slope(rng.random((64, 64)))) < 0.3
    assert np.isnan(media.spectral_slope(rng.random((8, 8))))


@pytest.mark.parametrize("power", [-1.0, -2.0, -3.0])
@pytest.mark.parametrize("shape", [(128, 128), (97, 120)])
def test_slope_of_a_known_spectrum(power, shape):
    """A picture made with random phases and power f ** power."""
    rng = np.random.default_rng(1)
    f = np.hypot(*np.meshgrid(np.fft.fftfreq(shape[0], 1 / shape[0]), np.fft.fftfreq(shape[1], 1 / shape[1]), indexing="ij"))
    noise = np.fft.fft2(rng.normal(size=shape))
    picture = np.fft.ifft2(noise / np.abs(noise) * np.where(f > 0, np.maximum(f, 1) ** (power / 2), 0)).real
    assert media.spectral_slope(picture) == pytest.approx(power, abs=0.12)
    assert media.spectral_slope(3 * picture + 7) == pytest.approx(media.spectral_slope(picture))


def test_slope_of_half_a_spectrum_is_that_of_all():
    rng = np.random.default_rng(2)
    for shape in ((40, 40), (41, 64), (64, 41)):
        gray = rng.random(shape)
        power = np.abs(np.fft.fft2(gray - gray.mean())) ** 2
        ring = np.hypot(*np.meshgrid(np.fft.fftfreq(shape[0], 1 / shape[0]), np.fft.fftfreq(shape[1], 1 / shape[1]), indexing="ij")).astype(int)
        rings = np.arange(1, min(shape) // 2)
        want = np.polyfit(np.log(rings), np.log([power[ring == r].mean() for r in rings]), 1)[0]
        assert media.spectral_slope(gray) == pytest.approx(want)


def test_histogram_of_colours():
    rgb = np.array([[[0, 0, 0], [31, 31, 31], [32, 0, 255], [255, 255, 255]]], np.uint8)
    found = media.color_histogram(rgb)
    assert len(found) == 512 and found.sum() == 1
    assert (found[0], found[1 * 64 + 0 * 8 + 7], found[511]) == (0.5, 0.25, 0.25)


def test_what_stands_out():
    """One odd dot in an even texture is the peak; a shifted picture has the same numbers."""
    rng = np.random.default_rng(3)
    rgb = np.repeat((120 + 8 * rng.normal(size=(64, 64, 1))).astype(np.uint8), 3, 2)
    rgb[40:44, 20:24] = 255
    found = media.saliency(rgb)
    assert 0 < found["saliency_mean"] < 0.2 and found["saliency_peak"] == pytest.approx(1, abs=1e-4) and found["salient_area_frac"] < 0.1
    again = media.saliency(np.roll(rgb, (9, 30), (0, 1)))
    assert all(again[k] == pytest.approx(v, abs=1e-6) for k, v in found.items())
    flat = media.saliency(np.full((32, 32, 3), 90, np.uint8))
    assert np.isfinite(list(flat.values())).all()


def test_sound_of_a_tone():
    rate = 22050
    y = 0.5 * np.sin(2 * np.pi * 1000 * np.arange(2 * rate) / rate)
    times, got = media.sound(y, rate)
    mid = len(times) // 2
    assert got["spectral_centroid"][mid] == pytest.approx(1000, rel=0.01)
    assert got["zcr"][mid] == pytest.approx(2 * 1000 / rate, rel=0.05)
    assert got["spectral_flatness"][mid] < 1e-3


def frames(spark):
    red, blue = (np.full((16, 16, 3), c, np.uint8).tobytes() for c in ([255, 0, 0], [0, 0, 255]))
    rows = [("m", k / 2, 16, 16, bytearray(red if k < 4 else blue)) for k in range(8)] + [("broken", 0.0, 16, 16, bytearray(b"xx"))]
    return spark.createDataFrame(rows, "stim_id string, t double, width int, height int, rgb binary")


def test_annotation_has_one_shape(spark):
    stimuli = spark.createDataFrame([("m", "audiovisual", 4.0), ("s", "text-only", 3.0), ("broken", "video-only", 2.0)], "stim_id string, modality string, duration_sec double")
    values, failed = annotate.annotate(stimuli, {"frames": frames(spark)}, sources.template(spark), ("core", "vision"))
    assert {r.stim_id: r["count"] for r in values.groupBy("stim_id").count().collect()} == {"m": 103 * 4, "s": 103 * 3, "broken": 103 * 2}
    assert {r.stim_id for r in failed.collect()} == {"broken"}
    red = {r.bin: r.num for r in values.where("stim_id = 'm' and path like '%r_mean'").collect()}
    assert red[0] == 1 and red[3] == 0
    assert values.where("stim_id = 's' and num is not null").count() == 0


def test_shots(spark):
    from gridloom.operators import grid

    bins = grid.time_grid(spark.createDataFrame([("m", 4.0)], "stim_id string, duration_sec double"))
    cuts, index = annotate.shots(frames(spark).where("stim_id = 'm'"), bins)
    assert [r.t for r in cuts.collect()] == [2.0]
    assert [r.shot for r in index.orderBy("bin").collect()] == [0, 0, 1, 1]


def test_no_bins_is_an_error(spark):
    stimuli = spark.createDataFrame([("m", "audiovisual", 0.4)], "stim_id string, modality string, duration_sec double")
    with pytest.raises(ValueError, match="no bin"):
        annotate.annotate(stimuli, {"frames": frames(spark)}, sources.template(spark))


def test_batch_takes_what_is_left(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    index = spark.createDataFrame([("a", "ok"), ("z", "ok")], "id string, status string")
    from pyspark.sql import functions as F

    got = annotate.run_batch(ids("a", "b"), ids("a"), lambda df: df.withColumn("status", F.lit("partial")), index)
    assert sorted(map(tuple, got.collect())) == [("a", "ok"), ("b", "partial"), ("z", "ok")]


@pytest.mark.parametrize("hz", [82.4, 220.0, 440.0, 1318.5])
def test_pitch_and_note_of_tones(hz):
    rate = 22050
    t = np.arange(rate) / rate
    y = sum(0.4 / k * np.sin(2 * np.pi * hz * k * t) for k in (1, 2, 3))
    found = media.pitch(y, rate)
    assert np.nanmedian(found) == pytest.approx(hz, rel=0.005) and np.isfinite(found[5:-5]).all()
    noise = media.pitch(0.3 * np.random.default_rng(0).normal(size=rate), rate)
    assert np.isnan(noise).mean() > 0.9 and np.isnan(media.pitch(np.zeros(rate), rate)).all()
    notes = media.chroma(np.sin(2 * np.pi * hz * t), rate)[20]
    assert notes.max() == 1
    if hz > 200:  # below, notes lie nearer than frequencies
        assert notes.argmax() == round(12 * np.log2(hz / 440) + 9) % 12


def test_cepstrum_is_a_cosine_transform():
    rate, rng = 22050, np.random.default_rng(1)
    y = rng.normal(size=rate // 2)
    bands = media.mel_bands(rate, 40)
    assert bands.shape == (40, 1025) and (bands.sum(1) * rate / 2048 == pytest.approx(np.ones(40), rel=0.35)) and (bands.argmax(1)[1:] >= bands.argmax(1)[:-1]).all()
    full = media.cepstrum(y, rate, 40, 40)
    level = media._decibels(media._power(media._frames(y)) @ bands.T)
    assert (full**2).sum(1) == pytest.approx((level**2).sum(1))  # the transform keeps lengths
    assert full[:, 0] == pytest.approx(level.sum(1) / np.sqrt(40)) and media.cepstrum(y, rate).shape[1] == 13


@pytest.mark.parametrize("beats", [90, 120, 150])
def test_tempo_of_clicks(beats):
    rate = 22050
    y = np.zeros(12 * rate)
    for at in np.arange(0.3, 11.5, 60 / beats):
        y[int(at * rate) : int(at * rate) + 200] = np.hanning(200)
    strength = media.onset_strength(y, rate)
    assert strength.max() > 10 * np.median(strength) and media.tempo(strength, rate) == pytest.approx(beats, rel=0.03)
    assert np.isnan(media.tempo(media.onset_strength(np.zeros(rate), rate), rate))
