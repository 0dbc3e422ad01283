import random

import numpy as np
import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeglass.llm import prose
from lodeglass.llm.prose_stats import NAMES, statistics

DOCS = "doc_id bigint, text string, lang string, language string, stats string"
WORDS = {
    "en": "the of and to a in is that it for was on are with as be this have not or by from at we but they an which you can if has no do so what there all when".split(),
    "de": "der die das und in zu den von mit ist nicht ein eine für auf dem sich als auch es an werden aus er hat dass sie nach bei um am sind".split(),
}
COMMON = {k: frozenset(v) for k, v in WORDS.items()}
EN = [
    "The parser became slow last week, and nobody found time to measure it properly.", "We keep the first copy if a later file turns out broken.", "It took several reviewers two days before they noticed the missing index.",
    "There was no answer from the support team, so our intern restored everything by hand.", "What you see in this note covers only half of the planned changes for next month.",
]
DE = [
    "Der Leser ist nicht schnell genug, und das macht uns große Sorgen.", "Wir prüfen die Liste heute noch einmal und melden dann alle Fehler.", "Es bleibt für uns unklar, warum die Abfrage bei kleinen Dateien hängt.",
    "Das lief vor der Umstellung anders, aber niemand hat es damals aufgeschrieben.",
]


def texts(seed=1, n=240):
    """(kind, text)"""
    rng = random.Random(seed)
    noun = lambda: rng.choice(["lease", "chunk", "folder", "query", "window", "token"])
    out = []
    for k in range(n):
        body = " ".join(rng.choice(DE if k % 6 == 0 else EN) for _ in range(rng.randint(2, 12)))
        if k % 5 == 1:
            width = rng.randint(45, 75)
            lines, line = [], ""
            for w in body.split():
                if len(line) + len(w) + 1 > width:
                    lines, line = [*lines, line], ""
                line = f"{line} {w}".strip()
            body = "\n".join([*lines, line])
        if k % 5 == 2:
            body = body.lower().replace(",", "").replace(".", "")
        if k % 5 == 3:
            body = f"# Note\n\n{body}\n\n- a {noun()}\n- {noun()}"
        out.append(("prose", body))
    for k in range(n // 2):
        out.append(("other", [
            "\n".join(f"- {noun()} {noun()}" for _ in range(15)), "\n".join(f"| {noun()} | {rng.randint(0, 999)} | {noun()} |" for _ in range(9)),
            "\n".join(f"    {noun()}.set({rng.randint(0, 99)}, {noun()});" for _ in range(9)), "\n".join(f"2024-01-0{k % 9 + 1} 10:00:0{k % 9} INFO [{noun()}] it was not there" for _ in range(9)),
            "".join(rng.choice("abc;.,# ") for _ in range(300)), " ".join(noun() for _ in range(80)), "\n".join(rng.choice(["for us, by us", "what to do with an old " + noun(), "no " + noun() + " at all"]) for _ in range(12)),
        ][k % 7]))
    return out


@pytest.fixture(scope="module")
def frames(spark):
    data = texts()
    docs = [(k, t, ["en", "EN-us", None, "de"][k % 4], "x", "y") for k, (_, t) in enumerate(data)]
    docs += [(9001, None, "en", "x", "y"), (9002, "", "en", "x", "y"), (9003, " \n", "en", "x", "y"), (None, "abc", "en", "x", "y"), (9004, "* \n#", None, "x", "y")]
    words = spark.createDataFrame([(k, w) for k, ws in WORDS.items() for w in ws] + [(None, "x"), ("en", None)], "lang string, word string")
    labels = spark.createDataFrame([(k, kind, 1) for k, (kind, _) in enumerate(data) if k % 10 == 0] + [(1, None, 1), (None, "prose", 1), (123456, "other", 2)], "doc_id bigint, label string, rater int")
    return data, spark.createDataFrame(docs, DOCS), words, labels


def test_prose_is_told_from_the_rest(frames):
    data, docs, words, labels = frames
    got = {r["doc_id"]: r["is_prose"] for r in prose.judged(docs, words, labels).collect()}
    assert set(got) == {*range(len(data)), 9004}
    wrong = [k for k, (kind, _) in enumerate(data) if got[k] != (kind == "prose")]
    assert len(wrong) <= 0.02 * len(data) and not got[9004]


def test_without_labels(frames):
    data, docs, words, _ = frames
    got = {r["doc_id"]: r["is_prose"] for r in prose.judged(docs, words).collect()}
    assert sum(got[k] != (kind == "prose") for k, (kind, _) in enumerate(data)) <= 0.03 * len(data)


def test_contributions_and_fit_against_numpy(frames):
    _, docs, words, _ = frames
    stats = prose.text_statistics(docs, words)
    x = {}
    for r in stats.collect():
        x.setdefault(r["language"], []).append(r["stats"])
    models = prose.fit_prose(stats.repartition(5), rounds=2)
    common, closed = NAMES.index("common_share"), NAMES.index("closed_share")
    overall = np.diag(np.var(np.array([v for k, vs in x.items() if k for v in vs]), axis=0))
    for language, values in x.items():
        if not language:
            continue
        v = np.array(values)
        w = ((v[:, common] >= prose.SEED_COMMON) & (v[:, closed] >= prose.SEED_CLOSED)).astype(float)
        for _ in range(2):
            mean = np.average(v, axis=0, weights=w)
            cov = (1 - prose.SHRINKAGE) * np.cov(v.T, aweights=w, bias=True) + prose.SHRINKAGE * overall
            d = v - mean
            d2 = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
            n = len(NAMES)
            last, w = mean, np.where(d2 > 8 * n, 0, np.minimum(1, 2 * n / np.maximum(d2, 1e-9)))
        assert np.allclose(models[language].mean, last)
        assert np.allclose(models[language].inverse, np.linalg.inv(cov), rtol=1e-4, atol=1e-6)
    for r in prose.prose_distances(stats, models).collect():
        assert sum(r["contributions"]) == pytest.approx(r["distance"]) and r["distance"] >= -1e-9


def test_cutoff(spark):
    d = spark.createDataFrame([(k, float(2**k)) for k in range(10)], "doc_id bigint, distance double")
    label = lambda *x: spark.createDataFrame([(k, "other" if k >= 6 else "prose") for k in x], "doc_id bigint, label string")
    assert prose.cutoff(d, label(*range(10)), 30.0) == pytest.approx(2**5.5)
    assert prose.cutoff(d, label(1, 2), 30.0) == prose.cutoff(d, label(8, 9), 30.0) == prose.cutoff(d, label(), 30.0) == prose.cutoff(d, None, 30.0) == 30.0


def test_no_statistic_decides_alone(frames):
    """Without any one statistic the others still tell prose from the rest."""
    data, docs, words, _ = frames
    rows_ = prose.text_statistics(docs.where("doc_id < 9000"), words).collect()
    x, kind = np.array([r["stats"] for r in rows_]), np.array([data[r["doc_id"]][0] == "other" for r in rows_])
    language = np.array([r["language"] for r in rows_])
    for left_out in range(len(NAMES)):
        kept = [k for k in range(len(NAMES)) if k != left_out]
        v, d2 = x[:, kept], np.zeros(len(x))
        for lang in {*language}:
            at = language == lang if lang else language != "none"
            z = v[at]
            w = ((x[at][:, NAMES.index("common_share")] >= prose.SEED_COMMON) & (x[at][:, NAMES.index("closed_share")] >= prose.SEED_CLOSED)).astype(float)
            for _ in range(prose.ROUNDS):
                mean = np.average(z, axis=0, weights=w)
                cov = (1 - prose.SHRINKAGE) * np.cov(z.T, aweights=w, bias=True) + prose.SHRINKAGE * np.diag(np.var(v, axis=0))
                now = np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(cov), z - mean)
                w = np.where(now > 8 * len(kept), 0, np.minimum(1, 2 * len(kept) / np.maximum(now, 1e-9)))
            d2[language == lang] = now[language[at] == lang]
        order = np.argsort(d2)
        wrong = min(np.sum(kind[order[:k]]) + np.sum(~kind[order[k:]]) for k in range(len(x) + 1))
        assert wrong <= 0.06 * len(x), NAMES[left_out]


def test_empty_tables(spark, frames):
    _, docs, words, labels = frames
    none = docs.where("false")
    assert rows(prose.judged(none, words, labels)) == []
    assert rows(prose.judged(docs, words.where("false"), labels).select("doc_id")) is not None


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab the.,\n\t*-#>|\"'é☃{};:12= \r﻿"), max_size=80))
def test_any_text_has_finite_statistics(text):
    found = statistics(text, COMMON)
    assert (found is None) == (not text.replace("﻿", "").strip())
    assert found is None or len(found[1]) == len(NAMES) and all(np.isfinite(found[1]))


@pytest.mark.parametrize("part", [".", " a", "- ", "a.", "1 ", "\tx", "'", "a-", "a\n", ",a", "1.", "> "])
def test_long_texts_take_linear_time(part):
    statistics(part * 200_000, COMMON)
