import hashlib
import random
import zlib

import pytest

from speechlake.llm import matroska as m


def test_every_lacing_and_unknown_sizes():
    r = random.Random(1)
    for lacing in (m.NO_LACING, m.XIPH, m.FIXED, m.EBML_LACING):
        for sizes in ([7], [254, 255, 256, 0, 510, 3], [1000, 1, 20000, 5, 5], [192] * 8):
            if lacing == m.NO_LACING and len(sizes) > 1 or lacing == m.FIXED and len(set(sizes)) > 1:
                continue
            frames = [bytes(r.choices(range(256), k=n)) for n in sizes]
            body = m._uint(m.CLUSTER_TIMESTAMP, 40) + m.element(0xEC, b"void") + m.element(m.SIMPLE_BLOCK, b"\x81\xff\xfe" + bytes([lacing << 1]) + m.laced(frames, lacing))
            group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x82\x00\x05\x00" + b"abc") + m.element(m.REFERENCE_BLOCK, b"\x01"))
            cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + body + group
            data = m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + m.element(m.INFO, m._uint(m.TIMESTAMP_SCALE, 1000)) + cluster + cluster + m.element(m.CUES, b"")
            file = m.read_file(data)
            assert len(file.clusters) == 2 and len(file.packets) == 2 * len(frames) + 2
            assert [data[p.start : p.end] for p in file.packets if p.track == 1] == frames * 2
            assert {p.timestamp_ns for p in file.packets if p.track == 1} == {38_000} and {(p.timestamp_ns, p.key) for p in file.packets if p.track == 2} == {(45_000, False)}


def test_written_file():
    payload = random.Random(2).randbytes(192 * 8 * 16 * 2 + 192 * 3)
    data = m.write_audio(payload)
    back, file = m.stored_payload(data)
    assert back == payload and file.doc_type == "matroska"
    assert file.tracks == {1: {"number": 1, "type": 2, "default_duration": 24_000_000, "codec": "A_PCM/INT/LIT", "rate": 8000.0, "channels": 1, "bits": 8}}
    assert [p for _, _, p in file.cues] == file.clusters and [t for t, _, _ in file.cues] == sorted({min(p.timestamp_ns for p in file.packets if p.cluster == c) for c in file.clusters})
    assert [p.timestamp_ns for p in file.packets] == [24_000_000 * i for i in range(len(payload) // 192)]
    assert {p.lacing for p in file.packets} == {m.FIXED, m.XIPH, m.EBML_LACING}


def test_damage():
    data = m.write_audio(b"x" * 192)
    for bad in (data[:-3], b"\x00" + data, data[:40], b"\x1a\x45\xdf\xa3\xff"):
        with pytest.raises(m.Malformed):
            m.read_file(bad)
    assert m.read_file(b"").packets == []


def test_query(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 192), (5, "y" * 100_000), (1, "héllo"), (None, "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, media int")
    got = sorted(m.media_features(m.text_media(df)).collect(), key=str)
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(want, key=str)
    assert len({(x.media_sha256, x.feature) for x in got if x.doc_id == 1}) == 1
    media = m.text_media(df).union(spark.createDataFrame([(70, b"\x00", 0), (71, None, 0)], "doc_id long, media binary, n_bytes long"))
    packets = m.packet_table(media).collect()
    assert sum(x.doc_id == 5 for x in packets) == 521 and {x.doc_id: x.error is not None for x in packets}.items() >= {70: True, 71: True, 5: False}.items()
    assert m.media_features(m.text_media(df.limit(0))).collect() == []
