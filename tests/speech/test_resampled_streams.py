import numpy as np
import pytest

from speechlake.options import StreamOptions
from speechlake.sources.audio_files import Resampler, resample, resample_pieces, resampled
from speechlake.sources.audio_files import BLOCK
from speechlake.streaming.session import Session
from tests.speech.test_streaming import RATE, load, recording


@pytest.mark.parametrize("rate", [8000, 11_025, 16_000, 22_050, 44_100, 48_000, 15_999])
@pytest.mark.parametrize("size", [1, 7, 100, 2500, 100_000])
def test_chunked_equals_whole_at_any_cut(rate, size):
    x = (np.random.default_rng(rate).standard_normal(600 if size == 1 else 20_000) * 0.3).astype(np.float32)
    want = resampled(x, rate, 16_000)
    r, got = Resampler(rate, 16_000), []
    for a in range(0, len(x), size):
        got.append(r.feed(x[a : a + size], a + size >= len(x)))
        r = Resampler(rate, 16_000, r.seen, r.made, r.tail)
        assert len(r.tail) <= 2 * r.weights.shape[1] + r.down // r.up + 1
    assert len(np.concatenate(got)) == len(want) and np.abs(np.concatenate(got) - want).max() < 1e-6
    assert BLOCK > 0 and len(Resampler(rate, 16_000).feed(np.zeros(0, np.float32), True)) == 0


def test_pieces_of_recordings(spark):
    r = np.random.default_rng(1)
    rows, pieces = [], []
    for k, (n, rate) in enumerate([(5000, 44_100), (3, 8000), (4000, 16_000), (0, 22_050), (2500, 22_050)]):
        x = (r.standard_normal(n) * 0.2).astype(np.float32)
        rows.append((f"r{k}", rate, x.tolist()))
        cuts = sorted({0, n, *r.integers(0, n + 1, 4).tolist()})
        pieces += [(f"r{k}", rate, a, x[a:b].tolist(), 1) for a, b in zip(cuts, cuts[1:], strict=False)] or [(f"r{k}", rate, 0, None, 1)]
    r.shuffle(pieces)
    df = spark.createDataFrame([(a, int(b), int(c), d, int(e)) for a, b, c, d, e in pieces], "path string, sample_rate int, offset long, samples array<float>, made int")
    got = {}
    for x in sorted(resample_pieces(df).collect(), key=lambda x: (x.path, x.offset)):
        assert x.offset == len(got.setdefault(x.path, [])) and x.sample_rate == 16_000
        got[x.path] += x.samples
    want = {x.path: x.samples for x in resample(spark.createDataFrame(rows, "path string, sample_rate int, samples array<float>")).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) and len(got[k]) == len(want[k]) for k in want)
    with pytest.raises(Exception, match="follow"):
        resample_pieces(df.where("path = 'r0' and offset > 0")).collect()


@pytest.mark.parametrize("source", [8000, 48_000])
def test_a_session_at_another_rate(source):
    """Chunks at another rate give the events of the resampled stream, whatever their cut, through saved state."""
    x, o = resampled(recording(), RATE, source), StreamOptions(source_rate=source)
    found = []
    for size in (source // 4, source // 10, 777):
        s, out = Session(options=o, **load()), []
        for i, a in enumerate(range(0, len(x), size)):
            s = Session.load(s.save(), options=o, **load())
            out += s.push(i, a * 1000 // source, x[a : a + size], a + size >= len(x))
        assert out[-1]["event_type"] == "pipeline_done"
        found.append([(e["start_ms"], e["end_ms"]) for e in out if e["event_type"] == "speech_end"])
    assert found[0] == found[1] == found[2] and len(found[0]) == 2
    plain = Session(**load())
    want = [e for i, a in enumerate(range(0, len(recording()), 4000)) for e in plain.push(i, a // 16, recording()[a : a + 4000], a + 4000 >= len(recording()))]
    assert np.abs(np.array(found[0]) - np.array([(e["start_ms"], e["end_ms"]) for e in want if e["event_type"] == "speech_end"])).max() <= 40
