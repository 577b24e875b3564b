import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import mixing
from threadloom.session import cut


@pytest.fixture(scope="module")
def corpus(documents):
    rows = []
    for i in range(120):
        d = ("en", "de", "fr")[0 if i % 6 < 4 else i % 6 - 3]
        marks = {"en": "the of and ", "de": "der und ein ", "fr": "les que dans "}[d]
        rows.append((i, (f"w{i} " + marks) * (3 + i % 7) + "end", d))
    return documents(rows)


def plain(tokens, p, goal, least=0.0):
    """The same least squares on one machine, by small plain steps: documents' rates nearest to 1 that meet the goal."""
    scale = tokens.sum()
    slope, size = np.zeros(len(goal)), np.linalg.eigvalsh((p * tokens[:, None]).T @ p).max()
    for _ in range(200_000):
        r = np.maximum(least, 1 - p @ slope)
        miss = (r * tokens) @ p - goal
        if np.abs(miss).max() < 1e-9 * scale:
            break
        slope = slope + miss / size
    return r


@pytest.mark.parametrize("targets", [{"en": 0.2, "de": 0.5, "fr": 0.3}, {"en": 0.9, "de": 0.1, "fr": 0.0}, None])
def test_targets_are_met(corpus, targets):
    model = mixing.fit_domains(corpus.select("text", F.col("lang").alias("domain")))
    found = mixing.rates(corpus, model, targets, total=5000.0, keep=["doc_id", "lang"]).toPandas()
    assert len(found) == 120 and (found.rate >= 0).all()
    p = found[[f"p_{d}" for d in model.domains]].to_numpy()
    assert (p.argmax(axis=1) == [model.domains.index(d) for d in found.lang]).all() and np.allclose(p.sum(axis=1), 1)
    tokens = found.n_tokens.to_numpy(float)
    now = tokens @ p / tokens.sum()
    goal = 5000.0 * (mixing.tempered(now) if targets is None else np.array([targets[d] for d in model.domains]))
    assert np.abs((found.rate.to_numpy() * tokens) @ p - goal).max() < 0.01 * 5000
    assert np.allclose(found.rate, plain(tokens, p, goal), atol=2e-3)


def test_rare_domains_are_kept(spark):
    """A domain with 2 of 20 000 labels is learned, has its prior and meets its target; too many are an error."""
    common = spark.range(20_000).selectExpr("concat('n', id, ' the and of the end') AS text", "'en' AS domain")
    rare = spark.range(2).selectExpr("concat('r', id, ' zul mek zul end') AS text", "'xx' AS domain")
    rows = common.union(rare)
    model = mixing.fit_domains(rows)
    assert model.domains == ["en", "xx"] and model.prior == pytest.approx([20_000 / 20_002, 2 / 20_002])
    found = mixing.rates(rows.limit(200).union(rare), model, {"xx": 0.5, "en": 0.5}, keep=["domain"]).toPandas()
    assert (found.p_xx[found.domain == "xx"] > 0.5).all() and (found.rate[found.domain == "xx"] > 10).all()
    # copies of one text do not hide a domain
    same = spark.range(20_000).selectExpr("'always the same' AS text", "'yy' AS domain")
    assert mixing.fit_domains(rows.union(same)).domains == ["en", "xx", "yy"]
    many = spark.range(65).selectExpr("concat('text ', id) AS text", "CAST(id AS STRING) AS domain")
    assert len(mixing.fit_domains(many.where("id < 64")).domains) == 64
    with pytest.raises(ValueError, match="domains"):
        mixing.fit_domains(many)


def test_no_rate_below_the_least(corpus):
    model = mixing.fit_domains(corpus.select("text", F.col("lang").alias("domain")))
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)  # the targets are met
        found = mixing.rates(corpus, model, keep=["doc_id"], least=1.0).withColumn("copies", mixing.copies(F.col("rate"), F.col("doc_id"))).toPandas()
    assert (found.rate >= 1).all() and (found.copies >= 1).all() and found.copies.sum() > 120
    assert abs(found.copies.sum() - found.rate.sum()) < 30
    p, tokens = found[[f"p_{d}" for d in model.domains]].to_numpy(), found.n_tokens.to_numpy(float)
    have = tokens @ p
    wanted = mixing.tempered(have / have.sum())
    goal = wanted * (have / wanted).max()
    assert np.abs((found.rate.to_numpy() * tokens) @ p - goal).max() < 1e-3 * goal.sum()
    assert np.allclose(found.rate, plain(tokens, p, goal, least=1.0), atol=5e-3)


def test_targets_out_of_reach_are_reported(corpus):
    model = mixing.fit_domains(corpus.select("text", F.col("lang").alias("domain")))
    with pytest.warns(UserWarning, match="missed"):
        found = mixing.rates(corpus, model, {"en": 0.0, "de": 0.5, "fr": 0.5}, keep=["doc_id", "lang"], least=1.0).toPandas()
    assert (found.rate >= 1).all() and (found.rate[found.lang == "en"] < 1.01).all()


def test_texts_are_not_stored(corpus, monkeypatch):
    """What is stored on the way to the rates has no text, and no kept column where the text is kept."""
    stored = []
    monkeypatch.setattr(mixing, "cut", lambda df: stored.append(df.schema.simpleString()) or cut(df))
    model = mixing.fit_domains(corpus.select("text", F.col("lang").alias("domain")))
    stored.clear()
    found = mixing.rates(corpus, model, keep=["doc_id", "text"], least=1.0)
    assert len(stored) == 1 and not any(x in stored[0] for x in ("text", "kept")) and found.count() == 120
    stored.clear()
    mixing.rates(corpus, model, keep=["doc_id"], least=1.0)
    assert len(stored) == 2 and not any("text" in x for x in stored)


def test_posteriors_are_naive_bayes(corpus, spark):
    """Brute force over words in Python, with the model's own buckets and weights."""
    import re

    model = mixing.fit_domains(corpus.select("text", F.col("lang").alias("domain")))
    texts = ["The OF and W3, der-und; ein!", "les\nque dans dans", "", None, "12 !?", "\u6f22\u5b57\u3068\u304b\u306a", "Ünd DER\u00a0ein", "\u0e01\u0e02 the"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    unspaced = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
    words = []
    for t in texts:
        runs, out = re.findall("[a-z\u00aa\u00b5\u00ba\u00c0-\u1fff\u2070-\u2fff\u3040-\U0010ffff]+", (t or "").lower()), []
        for run in runs:
            for c in run:
                if unspaced.match(c) or c is run[0] and (not out or out[-1] != ""):
                    out.append("")
                out[-1] += c
            out.append("")
        words.append(sorted({w for w in out if w}))
    flat = sorted({w for ws in words for w in ws}) or [""]
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in flat], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).alias("b")).collect()}
    for r in model.posteriors(rows).collect():
        at = sorted({bucket[w] for w in words[r.i]})
        logs = np.log(model.prior) + model.weights[at].sum(axis=0)
        want = np.exp(logs - logs.max())
        assert np.allclose([r[f"p{d}"] for d in range(len(model.domains))], want / want.sum(), atol=1e-9), (r.i, words[r.i])


def test_words_of_a_long_run_and_of_unspaced_script(spark):
    rows = spark.createDataFrame([("x" * 300_000,), ("\u6f22" * 300_000,)], "text string")
    assert [r.n for r in rows.select(F.size(mixing.features(F.col("text"))).alias("n")).collect()] == [1, 1]
    assert [r.n for r in rows.select(mixing.tokens(F.col("text")).alias("n")).collect()] == [1, 1]
    odd = spark.createDataFrame([(" a  b ",), ("",), (None,), ("a",), ("\n",), ("a\t",)], "text string")
    assert [r.n for r in odd.select(mixing.tokens(F.col("text")).alias("n")).collect()] == [2, 0, 0, 1, 0, 1]


def test_odd_rows(odd, none, spark):
    model = mixing.fit_domains(odd.select("text", F.col("lang").alias("domain")))
    found = mixing.rates(odd, model, keep=["doc_id", "text", "score", "rep"]).collect()
    assert len(found) == odd.count()
    blank = [r for r in found if not (r.text or "").strip()]
    assert all(r.n_tokens == 0 and r.p_en == pytest.approx(model.prior[model.domains.index("en")]) for r in blank)
    assert {r.rate for r in mixing.rates(odd, mixing.fit_domains(none.select("text", F.col("lang").alias("domain"))), keep=["doc_id"]).collect()} == {1.0}
    assert mixing.rates(none, model, keep=["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        mixing.rates(odd, model, {"xx": 1.0})


def test_plan_is_native(corpus, capsys):
    model = mixing.fit_domains(corpus.select("text", F.col("lang").alias("domain")))
    model.posteriors(cut(corpus)).explain("formatted")
    assert not any(x in capsys.readouterr().out for x in ("Python", "Arrow", "Pandas"))
