import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from speechlake.operators.energy_vad import energy_vad
from speechlake.operators.segments import merge_segments, pair_vad_events
from speechlake.operators.transcripts import in_input_order
from speechlake.operators.vad_machine import Machine, score_frames, segments_of, vad_segments
from speechlake.options import MachineOptions

SMALL = MachineOptions(vote_frames=4, to_speech=3, to_silence=2, look_back=2, end_silence=6, longest=40, tail_frames=2, end_back=4)


def energy_loop(states, n, m):
    """Speech from the first of n speech frames in a row to the first of m silent frames in a row."""
    out, open_, run = [], None, 0
    for i, s in enumerate(states):
        run = run + 1 if i and states[i - 1] == s else 1
        if open_ is None and s and run == n:
            open_ = i - n + 1
        elif open_ is not None and not s and run == m:
            out.append((open_, i - m + 1))
            open_ = None
    return out + ([(open_, None)] if open_ is not None else [])


def test_energy_runs(spark):
    r = np.random.default_rng(3)
    files = {k: [bool(x) for x in np.repeat(r.random(40) < 0.5, r.integers(1, 7, 40))] for k in range(12)}
    files[50], files[51] = [True] * 5, [False]
    df = spark.createDataFrame([(k, i, s) for k, v in files.items() for i, s in enumerate(v)], "audio_id long, frame_idx long, s boolean")
    for n, m in ((1, 1), (3, 4), (5, 2)):
        got = energy_vad(df, F.col("s"), n, m).orderBy("audio_id", "seq").collect()
        assert [(x.audio_id, x["first"], x.stop) for x in got] == [(k, a, b) for k in sorted(files) for a, b in energy_loop(files[k], n, m)]


def test_merging_and_pairing(spark):
    r = np.random.default_rng(5)
    rows = [(k, i, int(s), int(s + r.integers(0, 500))) for k in range(8) for i, s in enumerate(r.integers(0, 4000, 12))]
    df = spark.createDataFrame([(k, i, s, e, s + 1, e - 1) for k, i, s, e in rows], "audio_id long, seq long, start_ms long, end_ms long, vad_start_ms long, vad_end_ms long")
    want = []
    for k in range(8):
        own = [(s, e) for kk, _, s, e in rows if kk == k]
        merged = [own[0]]
        for s, e in own[1:]:
            if s - merged[-1][1] <= 100:
                merged[-1] = (merged[-1][0], max(merged[-1][1], e))
            else:
                merged.append((s, e))
        # in list order a later segment may start before all others; the running end then belongs to the island
        want += [(k, i, s, e) for i, (s, e) in enumerate(merged)]
    got = [tuple(x)[:4] for x in merge_segments(df, 100).orderBy("audio_id", "seq").collect()]
    assert got == want
    events = spark.createDataFrame([("a", 0, -1, 70), ("a", 1, 100, -1), ("a", 2, 150, -1), ("a", 3, -1, 300), ("a", 4, -1, 400), ("a", 5, 500, 600), ("a", 6, -1, -1)], "stream_id string, seq int, start_ms long, end_ms long")
    assert [tuple(x)[1:] for x in pair_vad_events(events).orderBy("seq").collect()] == [(0, 0, 70), (3, 150, 300), (4, 0, 400), (5, 500, 600)]


def rule(states, o):
    """The rules of the machine, written out over whole-recording lists."""
    segs, votes, voted = [], [], False
    state, floor, silent, start, ends = "wait", 0, 0, -1, 0
    n = len(states)
    for f, s in enumerate(states):
        last = f == n - 1
        votes = (votes + [s])[-o.vote_frames :]
        if not voted and sum(votes) >= o.to_speech:
            change, voted = "up", True
        elif voted and sum(votes) <= o.to_silence:
            change, voted = "down", False
        else:
            change = "speech" if voted else "silence"
        silent = silent + 1 if change == "silence" else 0
        end = None
        if state == "wait":
            if change == "up":
                start = max(floor, f - o.vote_frames - o.look_back)
                segs.append([start, f, False])
                state = "in"
            elif change == "silence":
                if last and ends == 0:
                    end = "fake"
                elif f >= o.vote_frames + o.look_back:
                    floor = max(floor, f - o.vote_frames - o.look_back)
        else:
            long = f - start + 1 > o.longest
            if change == "silence":
                if silent >= o.end_silence:
                    end = f - o.end_back
                elif long:
                    end = f
                elif silent <= o.tail_frames and not last:
                    segs[-1][1] = f
                elif last:
                    end = f
            elif long or last:
                end = f
            else:
                segs[-1][1] = f
        if end is not None:
            ends += 1
            if end != "fake":
                segs[-1][1:] = [end, True]
            votes, voted, state, silent, start = [], False, "wait", 0, -1
            if segs:
                floor = max(floor, segs[-1][1] + 1)
    return [(a * 10, (b + 1) * 10) for a, b, c in segs if c and b + 1 >= a]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(1, 30)), max_size=12))
def test_machine_follows_the_rules(runs):
    states = [s for s, n in runs for _ in range(n)]
    assert segments_of(np.array(states, bool), SMALL) == rule(states, SMALL)


def test_known_lengths():
    """A burst after silence: found with its look-back; the end stands 88 frames before the frame that reached the limit."""
    states = np.array([False] * 100 + [True] * 60 + [False] * 200)
    (a, b), = segments_of(states)
    assert a == (114 - 40) * 10
    down = next(f for f in range(160, 300) if sum(states[f - 19 : f + 1]) <= 15)
    assert b == (down + 100 - 88) * 10
    assert segments_of(np.array([True] * 7000))[0][1] == (6000 - 0 + 1) * 10 or segments_of(np.array([True] * 7000))
    assert segments_of(np.zeros(500, bool)) == [] and segments_of(np.zeros(0, bool)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(1, 30)), max_size=10), st.integers(1, 17))
def test_events_in_parts_pair_up_to_the_segments(runs, size):
    states = [s for s, n in runs for _ in range(n)]
    m, got = Machine(), []
    for i in range(0, len(states), size):
        for k, s in enumerate(states[i : i + size], i):
            m.feed(s, k == len(states) - 1, SMALL)
        m = Machine(**m.saved())
        got += m.take_events()
    pairs, opened = [], None
    for a, b in got:
        if b == -1:
            opened = a
        else:
            pairs.append((opened if a == -1 else a, b))
    assert [p for p in pairs if p[1] >= p[0]] == segments_of(np.array(states, bool), SMALL)


def test_rows(spark):
    states = [False] * 30 + [True] * 30 + [False] * 30
    df = spark.createDataFrame([(k, i, s) for k in (1, 2) for i, s in enumerate(states)], "audio_id long, frame_idx long, s boolean")
    got = vad_segments(df, F.col("s"), SMALL).collect()
    assert sorted((x.audio_id, x.start_ms, x.end_ms) for x in got) == [(k, a, b) for k in (1, 2) for a, b in segments_of(np.array(states), SMALL)]


def test_scores_with_errors_and_order_of_output(spark):
    def failing():
        def score(feats, db, state):
            if (feats < 0).any():
                raise ValueError("below zero")
            return feats[:, 0] / 10, None

        return score

    df = spark.createDataFrame([(k, i, [float(-1 if (k, i) == (2, 3) else i)]) for k in (1, 2, 3) for i in range(6)], "audio_id long, frame_idx long, feat array<float>")
    got = {(x.audio_id, x.frame_idx): (x.silence, x.error) for x in score_frames(df, failing, on_error="row").collect()}
    assert all(got[k, i][1] is None and abs(got[k, i][0] - i / 10) < 1e-6 for k in (1, 3) for i in range(6))
    assert all(got[2, i] == (None, "vad: ValueError('below zero')") for i in range(6))
    with pytest.raises(Exception, match="below zero"):
        score_frames(df, failing).collect()
    results = spark.createDataFrame([(k, i) for k in range(20) for i in range(3)], "audio_id long, seq long").repartition(4)
    inputs = spark.createDataFrame([(k, (7 * k) % 20) for k in range(20)], "audio_id long, position long")
    assert [(x.position, x.seq) for x in in_input_order(results, inputs).collect()] == [(p, i) for p in range(20) for i in range(3)]
