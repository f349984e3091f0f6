import binascii
import random

import numpy as np

from speechlake.llm.language_id import Model, fitted, identified, predictions

WORDS = {
    "en": "the and that with from have this which would there their about".split(),
    "de": "der und die nicht sich mit auch für werden einen über können".split(),
    "fr": "les que dans pour une est pas plus être avec sont après".split(),
}


def rows(seed=1, n=600):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        out.append((i, " ".join(r.choices(WORDS[lang], k=r.randint(1, 60))).capitalize(), lang if r.random() < 0.9 else None, lang))
    return out


def test_held_out_accuracy_and_contract(spark):
    data = rows()
    extra = [(2000, None, "en"), (2001, " 12 %", "de"), (2002, "", None), (2003, "the " * 60_000, None), (None, "les que dans pour", "fr"), (2005, data[0][1], "zz")]
    df = spark.createDataFrame([x[:3] + (1,) for x in data] + [x + (1,) for x in extra], "doc_id long, text string, lang string, score int")
    got = predictions(df).collect()
    assert len(got) == len(data) + len(extra)
    by = {x.doc_id: x for x in got}
    assert all(by[i].held_out == (binascii.crc32(str(i).encode()) % 4 == 2) for i in by if i is not None)
    right = [by[i].lang_pred == truth for i, _, _, truth in data if by[i].held_out]
    assert len(right) > 100 and np.mean(right) > 0.98
    assert [by[i].lang_pred for i in (2000, 2001, 2002, 2003, None)] == ["und", "und", "und", "en", "fr"]
    assert all(0 <= x.score <= 1 for x in got) and (by[2005].lang_pred, by[2005].score) == (by[0].lang_pred, by[0].score)
    kept = identified(df)
    assert kept.columns == df.columns and {2000, 2001, 2002} & {x.doc_id for x in kept.collect()} == set()
    assert {x.doc_id for x in kept.collect()} >= {i for i, *_ in data}


def test_scores_are_sums_of_log_probabilities(spark, monkeypatch):
    model = fitted(spark.createDataFrame([x[:3] for x in rows(2, 200)], "doc_id long, text string, lang string"))
    import speechlake.llm.language_id as m

    texts = ["The and", "x", "être avec sont", "zz" * 400, "İİ das ist " * 30]
    for piece in (1, 2, 3, 50, 1 << 17):
        monkeypatch.setattr(m, "PIECE", piece)
        best, sure = model.scores(texts)
        for k, t in enumerate(texts):
            total = model.priors.copy()
            for n in (1, 2, 3):
                for i in range(len(t.lower())):
                    own = 0
                    for c in (t.lower() + "  ")[i : i + n]:
                        own = (own * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                    total = total + model.matrix[(own + n) * 0xD6E8FEB86659FD93 % 2**64 >> 49]
            p = np.exp(total - total.max())
            assert best[k] == total.argmax() and abs(sure[k] - p.max() / p.sum()) < 1e-9
    assert isinstance(model, Model) and model.languages == ("de", "en", "fr")


def test_long_text_in_bounded_memory():
    import tracemalloc

    languages = tuple(f"l{i:03d}" for i in range(100))
    model = Model(languages, np.zeros(100), np.random.default_rng(1).normal(size=(1 << 15, 100)))
    text = "the quick brown fox é " * 900_000
    tracemalloc.start()
    model.scores([text, "short"])
    assert len(text) > 19_000_000 and tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert predictions(df).collect() == [] and identified(df).collect() == []
    unlabelled = spark.createDataFrame([(1, "abc", None), (2, "12", None)], df.schema)
    assert [(x.lang_pred, x.score) for x in predictions(unlabelled).collect()] == [("und", 0.0)] * 2
    assert [x.doc_id for x in identified(unlabelled).collect()] == [1]


def test_all_languages_are_learned(spark):
    own = {f"l{k:02d}": "".join(map(chr, range(0x4E00 + 20 * k, 0x4E14 + 20 * k))) for k in range(70)}
    data = [(4 * i + j, text, lang) for i, (lang, text) in enumerate(own.items()) for j in range(4)] + [(1000 + i, "the and that", "en") for i in range(4000)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    for sample in (20_000, 50):
        model = fitted(df, sample)
        assert model.languages == ("en", *own)
        rows = [x for x in data if binascii.crc32(str(x[0]).encode()) % 4 != 2]
        for k, lang in enumerate(model.languages):
            assert abs(np.exp(model.priors[k]) - sum(x[2] == lang for x in rows) / len(rows)) < 1e-9
        got = {x.doc_id: x.lang_pred for x in predictions(df, sample).where("doc_id < 1010").collect()}
        assert all(got[i] == lang for i, _, lang in data if i in got)


def test_passes_over_slices_predict_the_same(spark, monkeypatch):
    """More languages than are broadcast at once are scored in passes, with equal results and one slice in memory."""
    import speechlake.llm.language_id as m

    own = {f"l{k:02d}": "".join(map(chr, range(0x4E00 + 7 * k, 0x4E14 + 7 * k))) for k in range(40)}
    r = random.Random(2)
    data = [(4 * i + j, "".join(r.choices(text, k=12)), lang, 1) for i, (lang, text) in enumerate(own.items()) for j in range(4)]
    data += [(900, None, "l01", 1), (901, "12", "l02", 1), (902, own["l03"] + own["l30"], None, 1), (None, "x y", None, 1), (None, "x y", None, 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, row int")
    want = sorted(predictions(df).collect(), key=str)
    kept = sorted(map(str, identified(df, 0.6).collect()))
    sizes = []
    real = m.log_matrix
    monkeypatch.setattr(m, "log_matrix", lambda counted, languages: sizes.append(len(languages)) or real(counted, languages))
    monkeypatch.setattr(m, "AT_ONCE", 9)
    got = sorted(predictions(df).collect(), key=str)
    assert [(x.doc_id, x.held_out, x.lang_pred) for x in got] == [(x.doc_id, x.held_out, x.lang_pred) for x in want]
    assert max(abs(x.score - y.score) for x, y in zip(got, want, strict=True)) < 1e-12 and sizes == [9, 9, 9, 9, 4]
    assert sorted(map(str, identified(df, 0.6).collect())) == kept and 0 < len(kept) < len(data)
