"""WAV files by byte ranges, and fingerprints of files of any size."""

import hashlib
import io
import math
import os
import random
import struct
import wave

import pytest

from spanloom.sources import audio, media


def wav(samples, rate=8000, channels=1, width=2, before=b"", claim=None):
    data = struct.pack(f"<{len(samples)}h", *samples)
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * width, channels * width, 8 * width)
    return b"RIFF" + struct.pack("<I", 36 + len(before) + len(data)) + b"WAVE" + before + fmt + b"data" + struct.pack("<I", len(data) if claim is None else claim) + data


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("wav")
    r = random.Random(2)
    made = {"a": [r.randint(-9000, 9000) for _ in range(30_001)], "b": [0] * 5000, "c": [r.randint(-20, 20) for _ in range(20_000)], "none": []}
    (at / "a.wav").write_bytes(wav(made["a"], before=b"LIST" + struct.pack("<I", 5) + b"abcde\0"))  # an odd chunk and its pad
    (at / "b.wav").write_bytes(wav(made["b"], claim=0xFFFFFFFF))  # a size that streams write
    (at / "sub").mkdir()
    (at / "sub" / "c d.wav").write_bytes(wav(made["c"]) + b"tail chunk left out")
    (at / "none.wav").write_bytes(wav([]))
    (at / "stereo.wav").write_bytes(wav([1, 2] * 100, channels=2))
    (at / "junk.wav").write_bytes(b"RIFFxxxxWAVEfmt ")
    (at / "empty.wav").write_bytes(b"")
    return at, made


def test_spans_cover_each_file_once(spark, folder):
    at, made = folder
    got = {}
    for r in sorted(audio.read(spark, str(at), 1000).collect(), key=lambda r: r.first):
        name = os.path.basename(r.path)[0]
        assert r.first == len(got.setdefault(name, [])) == r.span * 1000 and r.rate == 8000 and r.total == len(made[name])
        got[name] += r.samples
    assert got == {k: made[k] for k in "abc"}
    # partitions of a few spans each: a file is many tasks, none of which starts from its beginning
    spark.dataSource.register(audio.PcmSource)
    d = spark.read.format("pcm").option("span", 500).option("spans", 4).load(f"file://{at}")
    assert d.rdd.getNumPartitions() >= 25 and d.count() == 61 + 10 + 40


def test_levels_and_slices(spark, folder):
    at, made = folder
    spans = audio.read(spark, str(at), 700)
    path = {os.path.basename(r.path)[0]: r.path for r in spans.select("path").distinct().collect()}
    r, cuts = random.Random(3), []
    for k in "abc":
        cuts += [(path[k], round(a, 3), round(a + r.choice([0.05, 0.1, 0.8, 9.0]), 3)) for a in (r.random() * 4 for _ in range(12))] + [(path[k], 0.0, 100.0), (path[k], 50.0, 60.0), (path[k], 0.5, 0.5)]
    cuts = list(dict.fromkeys(cuts))
    df = spark.createDataFrame(cuts, "path string, start double, end double")
    db = {(x.path, x.start, x.end): x.db for x in audio.levels(spans, df, 700).collect()}
    made_wav = {(x.path, x.start, x.end): x.wav for x in audio.slices(spans, df, 700).collect()}
    assert len(db) == len(made_wav) == len(cuts)
    for p, a, b in cuts:
        s = made[next(k for k in "abc" if path[k] == p)]
        lo, hi = max(0, int(a * 8000)), min(len(s), int(b * 8000))
        if hi - lo < 800:
            want = -120.0
        else:
            rms = math.sqrt(sum(x * x for x in s[lo:hi]) / (hi - lo)) / 32768.0
            want = 20 * math.log10(rms or 1e-9)
        assert abs(db[p, a, b] - want) < 1e-9
        if hi > lo:
            with wave.open(io.BytesIO(bytes(made_wav[p, a, b]))) as w:
                assert w.getframerate() == 8000 and w.readframes(w.getnframes()) == struct.pack(f"<{hi - lo}h", *s[lo:hi])
        else:
            assert made_wav[p, a, b] is None


def test_written_files_are_read_back(spark, tmp_path):
    rows = [("x", 1000, [1, -2, 3] * 400), ("y", 8000, []), ("z", 8000, [5])]
    audio.write(spark.createDataFrame(rows, "name string, rate int, samples array<short>"), f"file://{tmp_path}/out")
    with wave.open(f"{tmp_path}/out/x.wav") as w:
        assert (w.getframerate(), w.getnframes()) == (1000, 1200)
    assert {(os.path.basename(r.path), r.total) for r in audio.read(spark, f"file://{tmp_path}/out").collect()} == {("x.wav", 1200), ("z.wav", 1)}


def test_fingerprint_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    big, small = tmp_path / "big.mp4", tmp_path / "small one.mp4"
    with open(big, "wb") as f:
        f.write(b"head" * 1000)
        f.truncate(3 << 30)
        f.seek((3 << 30) - 4)
        f.write(b"tail")
    small.write_bytes(b"abc" * 100)
    got = {os.path.basename(r.path): r.fingerprint for r in media.fingerprints(spark, str(tmp_path), 1 << 20).collect()}
    for f, head, tail in ((big, b"head" * 1000 + bytes((1 << 20) - 4000), bytes((1 << 20) - 4) + b"tail"), (small, b"abc" * 100, b"")):
        st = f.stat()
        assert got[f.name] == hashlib.sha256(f"{st.st_size}|{int(st.st_mtime)}|{f.name}".encode() + head + tail).hexdigest()[:20]


def test_small_files_share_partitions(spark, tmp_path):
    """A task for each of thousands of small files would cost more than reading them."""
    r = random.Random(9)
    made = {f"f{k}": [r.randint(-99, 99) for _ in range(k % 700)] for k in range(1500)}
    for name, samples in made.items():
        (tmp_path / f"{name}.wav").write_bytes(wav(samples))
    d = audio.read(spark, str(tmp_path), 300)
    assert d.rdd.getNumPartitions() <= 2 * audio.BUNDLES + 1
    got = {}
    for x in d.orderBy("path", "span").collect():
        assert x.first == 300 * x.span and x.total == len(made[os.path.basename(x.path)[:-4]])
        got.setdefault(os.path.basename(x.path)[:-4], []).extend(x.samples)
    assert got == {k: v for k, v in made.items() if v}
