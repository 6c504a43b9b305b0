import hashlib
import math
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweave.llm import compression_classifier as C
from sparkweave.llm import media_columns as M

from .fixtures import awkward, awkward_rows, empty, wider

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return C.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = C.classify(spark.read.parquet(f"{DATA}/documents.parquet"), model).where("held_out").join(labels, "doc_id").collect()
    score, good = np.array([r.score for r in rows]), np.array([r.quality for r in rows]) == 1
    ranks = score.argsort().argsort() + 1
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97
    predicted = score >= C.THRESHOLD
    assert (predicted[good]).mean() > 0.98 and (~predicted[~good]).mean() > 0.8
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_training_rows_are_not_held_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    rows, share = C.sample(docs, labels, 1000)
    texts = [r.text for r in rows.collect()]
    assert len(texts) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200)) and 0.3 < share < 0.7
    assert all(zlib.crc32(t.split()[1].encode()) % 5 for t in texts)
    assert C.sample(docs, labels, 10)[0].count() == 20


def test_without_both_labels_all_get_the_share(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(20)], "doc_id long, text string")
    of = lambda label: {r.score for r in C.classify(docs, C.fit(docs, spark.createDataFrame([(i, label) for i in range(20)], "doc_id long, quality int"))).collect()}
    assert of(1) == {1.0} and of(0) == {0.0} and of(None) == {0.5}
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in C.classify(docs, C.fit(docs, none)).collect()} == {0.5}


def test_query_on_empty_tables(spark, tmp_path):
    from sparkweave.llm import queries

    empty(spark).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "a" / "labels.parquet"))
    assert queries.op8_compression_classifier(spark, str(tmp_path / "a")).count() == 0
    awkward(spark).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "b" / "labels.parquet"))
    assert {r.score for r in queries.op8_compression_classifier(spark, str(tmp_path / "b")).collect()} == {0.5}


def test_scores_by_another_loop(spark, model):
    """Sizes by streaming each window through a compressor of its own, and the curve by math."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in C.classify(docs, model).collect():
        raw, sizes = texts[r.doc_id].encode(), []
        for d in (model.good, model.bad, None):
            kind = d and zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c, at, size = zstandard.ZstdCompressor(level=C.LEVEL, dict_data=kind, write_content_size=False, write_dict_id=False), 0, 0
            while at < len(raw):
                size += len(c.compress(raw[at : at + C.WINDOW]))
                at += C.WINDOW
            sizes.append(size)
        assert [r.n_good, r.n_bad, r.n_plain] == sizes
        z = model.intercept + model.slope * (sizes[1] - sizes[0]) / sizes[2] if raw else 0
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)) if raw else model.prior, abs=1e-6)


def test_curve_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(0.1, 0.05, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(-4 + 60 * x)))).astype(float)
    a, b = C.fit_curve(x, y, float(y.mean()))
    assert a == pytest.approx(-4, abs=0.5) and b == pytest.approx(60, abs=6)


@pytest.mark.parametrize("change", [lambda d: d, wider])
def test_awkward_scores(spark, model, change):
    got = C.classify(change(awkward(spark)), model).collect()
    assert len(got) == len(awkward_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] and by[3] == by[4] == pytest.approx(model.prior, abs=1e-6)
    assert C.classify(empty(spark), model).count() == 0


@settings(max_examples=150, deadline=None)
@given(payload=st.binary(max_size=3000))
def test_wav_round_trip(payload):
    assert M.read_back(M.store(payload)) == payload


def test_media_rows(spark):
    for change in (lambda d: d, wider):
        for r in M.media_columns(change(awkward(spark))).collect():
            text = next((t or "" for i, t, *_ in awkward_rows() if i == r.doc_id))
            raw = text.encode()
            payload = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
            assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
            assert r.media_sha256 == hashlib.sha256(M.store(payload)).hexdigest() and r.media_bytes == len(M.store(payload))
            assert len(r.codes) == len(r.code_frames) and r.code_frames == sorted(r.code_frames)
    assert M.media_columns(empty(spark)).count() == 0


def slow_fingerprint(samples):
    """The same by plain loops over frames and bands."""
    signal = [128] * M.HOP + list(samples) + [128] * M.HOP
    while (len(signal) - M.FRAME) % M.HOP:
        signal.append(128)
    window = np.hanning(M.FRAME).astype(np.float32)
    frames = [signal[a : a + M.FRAME] for a in range(0, len(signal) - M.FRAME + 1, M.HOP)]
    height, line = [], []
    for f in frames:
        spectrum = np.abs(np.fft.rfft((np.array(f, np.float32) - 128) * window))[1:]
        bands = [spectrum[b : b + M.BINS] for b in range(0, len(spectrum), M.BINS)]
        height.append([float(b.max().round(3)) for b in bands])
        line.append([int(b.argmax()) + 1 + M.BINS * i for i, b in enumerate(bands)])
    peaks = []
    for t in range(len(frames)):
        for b in range(len(height[0])):
            near = [(u, height[u][b]) for u in range(max(0, t - M.AROUND), min(len(frames), t + M.AROUND + 1)) if u != t]
            if height[t][b] > 0 and all(height[t][b] > h if u < t else height[t][b] >= h for u, h in near):
                peaks.append((t, line[t][b]))
    codes = [(t, x << 13 | y << 5 | u - t) for i, (t, x) in enumerate(peaks) for u, y in peaks[i + 1 : i + 1 + M.FAN] if u - t <= M.GAP]
    return len(frames), sorted(codes)


def test_fingerprint_against_loops():
    rng = np.random.default_rng(3)
    for n in (192, 384, 576, 960, 5000):
        samples = bytes(rng.integers(32, 123, n, dtype=np.uint8))
        frames, at, codes = M.fingerprint(samples)
        assert (frames, list(zip(at.tolist(), codes.tolist()))) == slow_fingerprint(samples)


def test_equal_stretches_share_codes():
    rng = np.random.default_rng(5)
    shared = bytes(rng.integers(32, 123, M.HOP * 80, dtype=np.uint8))
    other = bytes(rng.integers(32, 123, M.HOP * 40, dtype=np.uint8))
    a, b = set(M.fingerprint(shared + other)[2].tolist()), set(M.fingerprint(other[: M.HOP * 20] + shared)[2].tolist())
    c = set(M.fingerprint(bytes(rng.integers(32, 123, M.HOP * 120, dtype=np.uint8)))[2].tolist())
    assert len(a & b) > 5 * max(1, len(a & c))


def test_every_byte_is_in_a_frame():
    for n in (192, 384, 576, 960, 1344):
        before = M.band_peaks(rng_bytes(n))
        for at in (0, n // 2, n - 1):
            samples = bytearray(rng_bytes(n))
            samples[at] ^= 0x1F
            assert (M.band_peaks(bytes(samples)) != before).any()


def rng_bytes(n):
    return bytes(np.random.default_rng(n).integers(32, 123, n, dtype=np.uint8))
