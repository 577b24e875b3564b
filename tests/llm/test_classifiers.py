import random

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import language, quality, toxicity

SYLLABLES = {"en": "th er on an re he in ed nd".split(), "de": "sch ung ein ich ver ge zu au".split(), "fr": "eau oi eux que le tion ou".split(), "it": "zio gli che ano ino ella".split(), "pl": "czy sz wie nie prz ow ski".split(), "fi": "kko ä yö nen ssa lla uu".split()}


def text(pick, lang, n=80):
    return " ".join("".join(pick.choice(SYLLABLES[lang]) for _ in range(pick.choice([1, 2, 3]))) for _ in range(n))


@pytest.mark.parametrize("languages", [["en"], ["en", "de"], ["en", "de", "fr"], list(SYLLABLES)])
def test_language(documents, languages):
    pick = random.Random(4)
    rows = [(i, text(pick, languages[i % len(languages)]), languages[i % len(languages)]) for i in range(90)]
    model = language.fit(documents(rows[:60]).select("text", "lang"))
    got = {r.doc_id: r for r in language.identify(documents(rows[60:]), model, ["doc_id"]).collect()}
    assert {i: got[i].lang_pred for i, _, _ in rows[60:]} == {i: x for i, _, x in rows[60:]}
    assert all(0 <= r.score <= 1 and not r.ambiguous for r in got.values())
    code = language.code_book(len(languages))
    assert len({tuple(r) for r in code.tolist()}) == len(languages) or len(languages) < 2


def plain_answer(model, given):
    """Trigrams, margins and losses of one text, one by one."""
    import math

    if not any(c.isalpha() for c in given or ""):
        return "und", 1.0
    data = [b if 97 <= b <= 122 or b >= 128 else 32 for b in given.lower().encode()]
    buckets = []
    for i in range(len(data)):
        code = int.from_bytes(bytes((data[i : i + 3] + [32, 32])[:3]), "big")
        buckets.append(0 if code == 0x202020 else (code * 2654435761 % 2**32) >> 17)
    scale = language.MARGIN / (sum(b != 0 for b in buckets) + language.PRIOR)
    margin = [scale * sum(float(model.odds[b, bit]) for b in buckets) for bit in range(model.code.shape[1])]
    loss = [sum(model.weight[n][bit] * math.log1p(math.exp(-m * model.code[n][bit])) for bit, m in enumerate(margin)) for n in range(len(model.languages))]
    least = min(loss)
    return model.languages[loss.index(least)], 1 / sum(math.exp(-8 * (x - least)) for x in loss)


def test_language_equals_a_plain_decoder(documents, odd, monkeypatch):
    pick = random.Random(9)
    rows = [(i, text(pick, x), x) for i, x in enumerate(["en", "de", "fr"] * 20)]
    model = language.fit(documents(rows).select("text", "lang"))
    texts = [t for _, t, _ in rows] + ["ab", "é", "12", "", None, "The end. " * 30] + ["x" * 20_000]
    for size in (language.SLICE, 30):  # losses a few rows at a time are the same
        monkeypatch.setattr(language, "SLICE", size)
        found, score, _ = model.answers(pa.array(texts))
        for given, lang, s in zip(texts, found, score, strict=True):
            want = plain_answer(model, given)
            assert lang == want[0] and s == pytest.approx(want[1], rel=1e-4), given


def test_language_of_odd_rows(odd, none):
    model = language.fit(odd.select("text", "lang"))
    got = language.identify(odd, model, ["doc_id", "text"]).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    assert {r.lang_pred for r in language.identify(odd, language.fit(none.select("text", "lang")), ["doc_id"]).collect()} == {"und"}
    assert language.identify(none, model, ["doc_id"]).count() == 0


def test_texts_between_two_codewords_are_ambiguous(documents):
    pick = random.Random(5)
    rows = [(i, text(pick, "en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(60)]
    model = language.fit(documents(rows).select("text", "lang"))
    words = {x: text(pick, x, 400).split() for x in ("en", "de")}
    mixes = [" ".join(words["en"][:n] + words["de"][: 400 - n]) for n in range(0, 401, 4)]
    found, score, ambiguous = model.answers(pa.array(mixes))
    assert found[0] == "de" and found[-1] == "en" and not ambiguous[0] and not ambiguous[-1]
    assert score.min() < 0.95 < score[0]
    assert score[-1] > 0.95


def labelled(spark, rows):
    return spark.createDataFrame(rows, "text string, label int")


@pytest.fixture(scope="module")
def toxic_model(spark, documents):
    pick = random.Random(6)
    rows = []
    for i in range(240):
        words = text(pick, "en").split()
        if i % 3 == 0:
            for bad in pick.sample(["idiot", "moron", "scum", "vilefolk", "vilecrew", "vileband"], 3):
                words.insert(pick.randrange(len(words)), bad)
        rows.append((" ".join(words), int(i % 3 == 0)))
    docs = documents([(i, t, "en") for i, (t, _) in enumerate(rows)])
    return toxicity.fit(docs, labelled(spark, rows))


def test_toxicity_plain_and_disguised(toxic_model):
    pick = random.Random(7)
    clean = [text(pick, "en") for _ in range(20)]
    bad = ["1d10t m0ron", "i d i o t and s.c.u.m", "idiooooot morooon", "$cum 1diot", "IDIOT moron", "vilethings vilefolk", "id!ot scuuum"]
    spoiled = [t + " " + b for t, b in zip(clean, bad, strict=False)]
    low, high = (toxic_model.score(toxic_model.evidence(pa.array(x))) for x in (clean, spoiled))
    assert (low < 0.3).all() and (high >= 0.7).all(), (low.max(), high)


def test_restored_spans(toxic_model):
    found = toxicity.disguised(pa.array(["an i d i o t ok", None, "", "m0r0n, plain words", "a b", "nothing... here"]))
    assert {(0, "i d i o t"), (3, "m0r0n,")} <= set(found) and not [x for d, x in found if d in (1, 2, 4, 5)]
    assert toxicity.restore("m0r0n", toxic_model.model) == "moron"


def test_every_disguise_reaches_the_lattice(toxic_model):
    spans = ["idio7", "scu+", "a$$", "sh17", "m103n", "f€ck", "£oser", "¡diot", "scuum", "iddiot", "a s s", "i d i o t", "i - d - i - o - t", "é c o l", "ï.d.ï.ö.t"]
    found = toxicity.disguised(pa.array([f"Le {x} là" for x in spans]))
    assert {(i, x) for i, x in enumerate(spans)} <= set(found)
    # chains end with the text; letters beside quotes of three bytes are alone; pictures are no letters
    assert toxicity.disguised(pa.array(["x a", "b c", "a     b     c", "😀😀", "l'a"])) == []
    assert toxicity.disguised(pa.array(["“i d i o t”"])) == [(0, "i d i o t")]
    of, restored = toxic_model.restored(pa.array(["idio7", "scuum", "iddiot", "i - d - i - o - t", "$cum!", "moron"]))
    assert dict(zip(of.tolist(), (x.strip() for x in restored.to_pylist()), strict=True)) == {0: "idiot", 1: "scum", 2: "idiot", 3: "idiot", 4: "scum"}
    pick = random.Random(9)
    bad = ["idio7", "scuum", "i - d - i - o - t", "iddiot", "m o r o n", "5cum", "idio+"]
    texts = [text(pick, "en") + f" {b} {b.upper()} vilething" for b in bad]
    assert (toxic_model.evidence(pa.array(texts))[:, 2] >= np.log1p(2)).all()


def test_evidence_is_not_cut_by_frequency(spark):
    """A word of toxic texts only counts, however many commoner words both kinds share."""
    pick = random.Random(10)
    common = " ".join("".join(pick.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(6000))
    rows = [(f"{common} {i}" + (" zzword" if i < 20 else ""), int(i < 30)) for i in range(90)]
    hashes, odds = toxicity._evidence(labelled(spark, rows).repartition(4), 30, 60)
    wanted = toxicity.Words(*toxicity.lower_bytes(pa.array(["zzword"])))
    assert set(np.concatenate([wanted.hashes(n)[1] for n in (None, *toxicity.PREFIXES)]).tolist()) == set(hashes.tolist())
    assert odds == pytest.approx(np.log(20.5 / 31) - np.log(0.5 / 61))
    model = toxicity.fit(labelled(spark, rows), labelled(spark, rows))
    assert np.array_equal(model.hashes, hashes)


def test_viterbi_finds_the_least_cost(toxic_model):
    """Against all readings of short spans."""
    from itertools import product

    model = toxic_model.model

    def cost(chars, prices):
        a = b = 0
        total = sum(prices)
        for c in chars:
            s = toxicity.symbol(c) if c else -1
            if s < 0 or s == 0 and b == 0:
                continue
            total, a, b = total - float(model[a, b, s]), b, s
        return total - float(model[a, b, 0])

    for span in ("1d10t", "i.d", "sss", "a$1", "m0rr0"):
        options = [toxicity.choices(span, i) for i in range(len(span))]
        best = min(cost([c for c, _ in way], [p for _, p in way]) for way in product(*options))
        got = toxicity.restore(span, model)
        readings = [cost([c for c, _ in way], [p for _, p in way]) for way in product(*options) if "".join(c for c, _ in way) == got]
        assert readings and min(readings) == pytest.approx(best, abs=1e-4)


def test_toxicity_of_odd_rows(spark, odd, none, toxic_model):
    got = toxicity.score(odd, toxic_model, ["doc_id"]).collect()
    assert len(got) == odd.count() and all(0 <= r.score < 0.7 for r in got)
    assert toxicity.score(none, toxic_model, ["doc_id"]).count() == 0
    only = toxicity.fit(none, labelled(spark, [("a b c", 0)]))
    assert {r.score < 0.01 for r in toxicity.score(odd, only).collect()} == {True}


def test_labelled_rows_are_bounded_and_repeatable(spark, documents):
    docs = documents([(i, f"text {i}", "en") for i in range(50)] + [(3, "text 3", "en"), (None, "x", "en")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60)] + [(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    a, b = (sorted(map(tuple, toxicity.labelled_rows(docs, labels, "toxic", 20).collect())) for _ in range(2))
    assert a == b and len(a) <= 20 and all(y == int(t.split()[1]) % 2 for t, y in a)


def test_quality(spark, odd, none):
    pick = random.Random(8)
    rows = []
    for i in range(400):
        t = text(pick, "en")
        if i % 4 == 0:
            t = [t.upper().replace(" ", "!! "), " ".join(w for w in t.split() for _ in range(4)), t.replace(" ", " | "), t.replace(" ", "### ")][i // 4 % 4]
        rows.append((t, int(i % 4 != 0)))
    model = quality.fit(labelled(spark, rows[:300]))
    assert 0 < len(model.rules) < 100
    scored = quality.score(labelled(spark, rows[300:]), model, ["label"]).collect()
    assert np.mean([(r.score >= 0.3) == (r.label == 1) for r in scored]) > 0.95
    got = quality.score(odd, model, ["doc_id"]).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(none, model, ["doc_id"]).count() == 0
    for labels, share in (([], 0.5), ([("a", 1)], 1.0), ([("a", 0)], 0.0)):
        one = quality.fit(labelled(spark, labels) if labels else labelled(spark, [("a", 1)]).limit(0))
        assert quality.score(odd, one).first().score == pytest.approx(share, abs=1e-6)


def test_statistics():
    got = dict(zip(quality.STATISTICS, quality.measure(pa.array(["Ab ab ab!\nÉ 12", None]))[0], strict=True))
    assert got["bytes"] == 15 and got["words"] == 4 and got["repeats"] == 0.5 and got["distinct"] == 0.5 and got["longest"] == 2
    assert got["upper"] == pytest.approx(2 / 15) and got["digits"] == pytest.approx(2 / 15) and got["line_length"] == 7.5
    assert (quality.measure(pa.array([None, ""], pa.string())) == 0).all()
