import random
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from speechlake.llm.common import settle
from tests.llm.test_jaccard_join import brute
from tests.llm.test_language_id import WORDS

SECRET = "0123456789abcdef" * 2


def corpus(seed=6):
    r = random.Random(seed)
    rows = []
    for i in range(150):
        lang = r.choice(list(WORDS))
        words = [r.choice(WORDS[lang]) + r.choice("abcdefgh") * r.randint(0, 2) for _ in range(r.choice([1, 4, 30, 80]))]
        if r.random() < 0.2:
            words.insert(3, f'token = "{SECRET}"')
        rows.append((i, " ".join(words), lang if r.random() < 0.8 else None, r.choice(["a", "b", "c", None])))
    for i in range(150, 190):
        words = r.choice(rows)[1].split(" ")
        if len(words) > 40 and r.random() < 0.6:
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), None, "b"))
    rows += [(200, None, "en", "a"), (201, "123 %%", "en", "a"), (202, "", None, None)]
    return [(*x, len(x[1] or "")) for x in rows]


def test_stages_and_whole_run(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), df.columns
    steps = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        steps[name] = docs.collect()
        assert name == "encode" or docs.columns == columns
    texts = {i: t for i, t, *_ in rows}
    assert {x.doc_id for x in steps["language_id"]} == {i for i, t in texts.items() if t and re.search("[a-z]", t)}
    groups = brute([(x.doc_id, x.text) for x in steps["language_id"]], 5, 80)
    assert sorted(x.doc_id for x in steps["near_duplicates"]) == sorted(i for i, (_, g) in groups.items() if i == g)
    for x in steps["secrets"]:
        assert x.text == texts[x.doc_id].replace(f'token = "{SECRET}', "[SECRET]") and x.n_chars == len(x.text)
    kept = {x.doc_id: x.text for x in steps["secrets"]}
    drawn = Counter(x.doc_id for x in steps["mix"])
    assert max(drawn.values()) == 2 and set(drawn) <= set(kept)
    words = sum(len(t.split()) for t in kept.values())
    assert abs(sum(n * len(kept[i].split()) for i, n in drawn.items()) - 1.5 * words) < 0.05 * words + 320
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for x in steps["encode"]:
        assert list(x.ids) == theirs.encode(kept[x.doc_id], add_special_tokens=False).ids and x.n_tokens == len(x.ids)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, steps["encode"]))


def test_edge_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_key long, block int"
    for rows in ([], [(None, "the and that with", "en", "a", 1, 1, 1), (1, "the and that with", "en", "a", 1, 1, 1), (1, "the and that with", "en", "a", 1, 1, 1), (2, None, None, None, None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            assert name == "encode" or docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert len(docs.collect()) <= 4


def test_one_id_with_two_texts(spark):
    rows = [(1, "alpha beta", "en", "a", 1), (1, "gamma delta", "en", "a", 1), (1, "gamma delta", "en", "a", 1), (2, "ALPHA  beta", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.text for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == ["alpha beta", "gamma delta"]


def test_which_of_repeated_rows_stays(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "en", "b", 5), (1, text, "en", "a", 5), (1, text, None, "z", 5), (1, "other words here", "fr", None, 1), (2, text, "en", "a", 5), (3, None, "en", "b", 0), (3, None, "en", None, 0), (None, text, "en", "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(str, map(tuple, corpus_pipeline.near_duplicates(spark, df, "").collect())))
    assert got == sorted(map(str, [(1, text, None, "z", 5), (1, "other words here", "fr", None, 1), (3, None, "en", None, 0), (None, text, "en", "a", 5)]))


def test_very_long_texts(spark):
    words = [f"{WORDS['en'][i % len(WORDS['en'])]} w{(i * 7919) % 1_000_003}" for i in range(60_000)]
    near = list(words)
    near[::3000] = ["other"] * len(near[::3000])
    rows = [(1, " ".join(words) + f' token = "{SECRET}"'), (2, " ".join(near)), (3, "the and that with"), (4, "9 " * 500_000)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, ""), name)
        kept.append({x.doc_id for x in docs.select("doc_id").collect()})
        if name == "secrets":
            assert {x.doc_id: x.text for x in docs.collect()} == {1: " ".join(words) + " [SECRET]" + '"', 3: "the and that with"}
    assert kept[:3] == [{1, 2, 3}, {1, 3}, {1, 3}] and kept[4] == kept[3] <= {1, 3}


def test_recognised_languages_reach_the_result(spark, tmp_path):
    r = random.Random(3)
    data = [(i, " ".join(r.choice(WORDS[lang]) + r.choice("abcdefgh") for _ in range(30)), lang) for i in range(200) for lang in [r.choice(list(WORDS))]]
    rows = [(i, t, None if i % 5 == 0 else "fr" if i == 7 else lang, "a", len(t)) for i, t, lang in data]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.lang for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    truth = {i: lang for i, _, lang in data}
    assert len(got) > 90 and sum(truth[i] == lang for i, lang in got.items()) >= 0.98 * len(got)
