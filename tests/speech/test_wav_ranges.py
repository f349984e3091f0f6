import os
import resource
import struct

import numpy as np
import pytest

from speechlake.operators.feature_slices import sliced_features
from speechlake.operators.features import features
from speechlake.sources.audio_files import encode_wav, read_wav
from speechlake.sources.wav_ranges import Ranges, WavReader, planned, read_wav_ranges, write_wav


def files(folder):
    r = np.random.default_rng(1)
    x = (r.standard_normal(5000) * 0.2).astype(np.float32)
    os.makedirs(f"{folder}/sub")
    plain = encode_wav(x, 16_000)
    odd = b"LIST" + struct.pack("<I", 5) + b"notes\0"
    named = {
        "mono.wav": plain, "stereo.wav": encode_wav(x, 44_100, 2), "float.wav": encode_wav(x[:999], 8000, 1, 32), "sub/chunks.wav": plain[:12] + odd * 40 + plain[12:36] + odd + plain[36:],
        "none.wav": encode_wav(x[:0], 16_000), "cut.wav": plain[:-1001], "one.wav": encode_wav(x[:1], 16_000), "other.txt": b"no audio",
    }
    for name, data in named.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)


@pytest.mark.parametrize(("range_bytes", "piece_bytes"), [(1 << 26, 1 << 22), (1000, 1 << 22), (777, 100), (45, 4)])
def test_pieces_are_the_whole_files(spark, tmp_path, range_bytes, piece_bytes):
    files(str(tmp_path))
    want = {os.path.basename(x.path): (x.sample_rate, x.channels, x.bits, x.samples) for x in read_wav(spark, f"file://{tmp_path}").collect()}
    rows = sorted(read_wav_ranges(spark, str(tmp_path), range_bytes, piece_bytes).collect(), key=lambda x: (x.path, x.offset))
    got, upto = {}, {}
    for x in rows:
        name = os.path.basename(x.path)
        assert x.offset == upto.get(name, 0) and x.error is None and len(x.samples) * x.bits // 8 <= max(piece_bytes, x.channels * x.bits // 8)
        upto[name] = x.offset + len(x.samples) // x.channels
        got[name] = (x.sample_rate, x.channels, x.bits, (got[name][3] if name in got else []) + x.samples)
    assert got == want and len(got) == 7


def test_bad_files_are_error_rows(spark, tmp_path):
    good = encode_wav(np.zeros(50, np.float32), 16_000)
    for name, data in {"a.wav": good, "b.wav": b"RIFFxxxxWAVE", "c.wav": b"", "d.wav": good[:34] + b"\x18\0" + good[36:]}.items():
        (tmp_path / name).write_bytes(data)
    rows = read_wav_ranges(spark, f"file://{tmp_path}", 40, on_error="row").collect()
    assert sorted((os.path.basename(x.path), x.samples is None) for x in rows) == [("a.wav", False), ("a.wav", False), ("a.wav", False), ("b.wav", True), ("c.wav", True), ("d.wav", True)]
    assert all(x.error.startswith(x.path) for x in rows if x.samples is None)
    with pytest.raises(Exception, match="WAVE|chunk"):
        read_wav_ranges(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        read_wav_ranges(spark, str(tmp_path), on_error="odd")
    (tmp_path / "empty").mkdir()
    assert read_wav_ranges(spark, f"{tmp_path}/empty").collect() == []


def test_planning_looks_at_sizes_only():
    plan = planned([("big", 250), ("a", 60), ("b", 30), ("c", 20), ("empty", 0)], 100)
    assert sorted(plan, key=lambda p: p.parts) == [Ranges([("a", 60, 0, 60), ("b", 30, 0, 30)]), Ranges([("big", 250, 0, 100)]), Ranges([("big", 250, 100, 200)]), Ranges([("big", 250, 200, 250)]), Ranges([("c", 20, 0, 20), ("empty", 0, 0, 1)])]


def test_a_file_of_three_gigabytes_in_bounded_memory(tmp_path):
    """A sparse file over what one binary row holds: every range is read on its own, in pieces."""
    size, path = 3_000_000_000, f"{tmp_path}/long.wav"
    head = encode_wav(np.zeros(0, np.float32), 16_000)
    with open(path, "wb") as f:
        f.write(head[:4] + struct.pack("<I", size + 36) + head[8:40] + struct.pack("<I", size))
        f.truncate(44 + size)
        f.seek(44 + size - 2)
        f.write(struct.pack("<h", 16384))
    reader = WavReader({"path": str(tmp_path)})
    plan = reader.partitions()
    assert len(plan) == 45 and all(b - a <= 64 << 20 for p in plan for _, _, a, b in p.parts)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    upto = plan[20].parts[0][2] // 2 - 22
    for p in (plan[20], plan[-1]):
        for batch in reader.read(p):
            assert len(batch.column("samples").flatten()) <= 2 << 20
            offset, n = batch.column("offset")[0].as_py(), len(batch.column("samples").flatten())
            upto = offset + n
    assert upto == size // 2 and batch.column("samples").flatten()[-1].as_py() == 0.5
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB


def test_features_of_files_by_ranges(spark, tmp_path):
    r = np.random.default_rng(2)
    audio = spark.createDataFrame([(k, 16_000, (r.standard_normal(9000 + k) * 0.1).round(4).tolist()) for k in range(3)], "audio_id long, sample_rate int, samples array<float>")
    write_wav(audio, f"{tmp_path}/out")
    pieces = read_wav_ranges(spark, f"{tmp_path}/out", 3000, 1000)
    got = {(x.path[-5:], x.frame_idx): x.feat for x in sliced_features(pieces, "log_mel", "path", slice_samples=2000).collect()}
    want = {(x.path[-5:], x.frame_idx): x.feat for x in features(read_wav(spark, f"file://{tmp_path}/out"), "log_mel", "path").collect()}
    assert got.keys() == want.keys() and max(np.abs(np.array(got[k]) - np.array(want[k])).max() for k in want) < 1e-4
