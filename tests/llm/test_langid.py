import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from parcelwise.llm import langid

SAMPLES = {
    "en": "the and of to in is that for with was this have are from they which",
    "de": "der die und das nicht ist mit auch eine von zu den dem werden über",
    "fr": "les des que est dans pour une qui sur par avec être aux plus été",
    "es": "los las que una por con para como más pero sus está niño año",
}


def sentence(rng, lang, n=30):
    return " ".join(rng.choice(SAMPLES[lang].split()) for _ in range(n))


def labelled(spark, n=80):
    rng = random.Random(0)
    return spark.createDataFrame([(i, sentence(rng, lang), lang) for i in range(n) for lang in [list(SAMPLES)[i % 4]]], "doc_id long, text string, lang string")


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 7, 12):
        code = langid.codewords(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= (1 if n == 2 else 2 ** max(0, n - 2) if n <= 7 else 15)
        assert (np.abs(code.sum(0)) < n).all()


def test_held_out_accuracy(spark):
    model = langid.fit(labelled(spark))
    rng = random.Random(9)
    texts = [(lang, sentence(rng, lang, 12)) for lang in SAMPLES for _ in range(25)]
    names, score, _ = model.predict(pa.array([t for _, t in texts]))
    assert [lang for lang, _ in texts] == names.to_pylist()
    assert ((score > 0) & (score <= 1)).all()


def test_blocks_give_the_score_of_the_whole(spark, monkeypatch):
    model = langid.fit(labelled(spark))
    texts = pa.array(["the and of", "x", "", "der die und das " * 50, None, "été que dans"])
    whole = model.margins(texts)
    monkeypatch.setattr(langid, "STEP", 7)
    assert np.allclose(whole, model.margins(texts), atol=1e-3)


def test_odd_texts(spark, odd_docs, no_docs):
    model = langid.fit(labelled(spark))
    got = {r.doc_id: r for r in langid.identify(odd_docs, model).collect()}
    assert len(got) == odd_docs.count()
    for i in (0, 1, 2, 3, 6, 16, 17):
        assert (got[i].lang_pred, got[i].score, got[i].ambiguous) == ("und", 0.0, False)
    assert got[11].lang_pred in SAMPLES and got[4].source == "src0"
    assert langid.identify(no_docs, model).count() == 0


def test_nothing_to_learn_from(spark, odd_docs, no_docs):
    model = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.identify(odd_docs, model).collect()} == {"und"}
    one = langid.fit(labelled(spark).where("lang = 'en'"))
    assert one.predict(pa.array(["the", "1"]))[0].to_pylist() == ["en", "und"]


def test_mixed_text_is_ambiguous():
    counts = {k: np.zeros(langid.BUCKETS, np.int64) for k in ("a", "b")}
    for k, text in (("a", "aaaa"), ("b", "bbbb")):
        for _, _, code in langid.trigrams(pa.array([text])):
            counts[k] += np.bincount(code, minlength=langid.BUCKETS + 1)[: langid.BUCKETS]
    model = langid.LanguageModel.from_counts(counts)
    _, score, ambiguous = model.predict(pa.array(["aaaa bbbb", "aaaaaaaa"]))
    assert ambiguous[0] and score[0] < 0.6 < score[1]


def plain_model(rows):
    """Error-correcting output codes in plain Python: by language the counts of hashed trigrams, by bit the log ratios."""
    counts = {}
    for text, lang in rows:
        counts.setdefault(lang, Counter()).update(plain_codes(text))
    langs = sorted(counts)
    words = [[1 if split << 1 >> i & 1 else -1 for split in range(1, 1 << (len(langs) - 1))] for i in range(len(langs))]
    total = [sum(counts[x].values()) + 0.5 * langid.BUCKETS for x in langs]
    share = lambda i, code: (counts[langs[i]][code] + 0.5) / total[i]
    sides = lambda b, sign: [i for i in range(len(langs)) if words[i][b] == sign]
    mean = lambda own, code: sum(share(i, code) for i in own) / len(own)
    ratio = lambda b, code: math.log(mean(sides(b, 1), code) / mean(sides(b, -1), code))
    seen = set().union(*counts.values())
    trust = []
    for b in range(len(words[0])):
        each = [(mean(sides(b, 1), c) - mean(sides(b, -1), c)) * ratio(b, c) for c in seen]
        p, q = (mean(sides(b, s), -1) for s in (1, -1))
        trust.append(sum(each) + (langid.BUCKETS - len(seen)) * (p - q) * math.log(p / q))
    return langs, words, ratio, [t / sum(trust) for t in trust]


def plain_codes(text):
    raw = f" {text.lower()} ".encode()
    return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % (1 << 32)) >> 16 for i in range(len(raw) - 2)]


def plain_prediction(model, text):
    langs, words, ratio, trust = model
    codes = plain_codes(text)
    margins = [sum(ratio(b, c) for c in codes) / math.sqrt(len(codes)) for b in range(len(trust))]
    loss = [sum(t * math.log1p(math.exp(-m * w)) if -m * w < 500 else t * -m * w for t, m, w in zip(trust, margins, word, strict=True)) for word in words]
    return langs[loss.index(min(loss))], 1 / sum(math.exp(min(loss) - x) for x in loss)


def test_predictions_equal_plain_output_codes(spark):
    rows = labelled(spark)
    model = langid.fit(rows)
    plain = plain_model([(r.text, r.lang) for r in rows.collect()])
    rng = random.Random(4)
    texts = [sentence(rng, lang, n) for lang in SAMPLES for n in (1, 3, 20)] + ["the die les", "x", "Über ÉTÉ Ωmega", "zzz 12 qq"]
    names, score, ambiguous = model.predict(pa.array(texts))
    for text, name, s, unsure in zip(texts, names.to_pylist(), score.tolist(), ambiguous.tolist(), strict=True):
        lang, want = plain_prediction(plain, text)
        assert name == lang and abs(s - want) < 1e-4 and (unsure == (want < 0.75) or abs(want - 0.75) < 1e-3)


def test_ties_go_to_the_first_language():
    counts = {k: np.full(langid.BUCKETS, 3, np.int64) for k in ("b", "a", "c")}
    names, score, ambiguous = langid.LanguageModel.from_counts(counts).predict(pa.array(["some text", "12"]))
    assert names.to_pylist() == ["a", "und"] and abs(score[0] - 1 / 3) < 1e-9 and ambiguous.tolist() == [True, False]


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    rng = random.Random(2)
    rows = [(None, sentence(rng, lang), lang) for lang in ("en", "de") for _ in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, rows_per_lang=40)
    assert model.predict(pa.array(["the and of to in", "der die und das"]))[0].to_pylist() == ["en", "de"]
