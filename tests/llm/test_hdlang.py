"""Languages: held-out accuracy, mixed texts, and the cosine against dense vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hdlang

PARTS = {
    "en": (["The water board", "A grain exporter", "The rail union", "An audit team"], ["rejected", "signed", "welcomed", "questioned"], ["the closure of the old smelter", "a loan for the railway", "new limits on emissions", "the budget for clinics"], ["on both banks", "near the fortress", "last weekend", "without delay"]),
    "fr": (["La banque centrale", "Le conseil régional", "Les pêcheurs du lac", "Une équipe d'ingénieurs"], ["a annoncé", "a rejeté", "a défendu", "a publié"], ["la réforme du cadastre", "un prêt pour le chemin de fer", "l'achat de vieilles turbines", "le traité de pêche"], ["dans la zone franche", "sur les deux rives", "sans délai", "autour du lac"]),
    "de": (["Der Regionalrat", "Die Reederei", "Das Finanzministerium", "Eine Gruppe von Ingenieuren"], ["verwarf", "bestätigte", "verschob", "genehmigte"], ["den Verlauf der Gasleitung", "die neue Zollordnung", "einen Kredit für die Bahnstrecke", "das Verbot nächtlicher Landungen"], ["rund um den See", "auf beiden Ufern", "an der Grenze", "ohne Verzug"]),
    "es": (["La junta de aguas", "El consejo regional", "Un antiguo juez", "La naviera"], ["rechazó", "firmó", "celebró", "cuestionó"], ["la reforma del catastro", "un puente sobre el estuario", "el nuevo arancel aduanero", "la compra de turbinas usadas"], ["en toda la provincia", "en ambas orillas", "cerca de la fortaleza", "sin demora"]),
    "it": (["La società mineraria", "Il ministero delle finanze", "Gli esperti", "Un esportatore di cereali"], ["ha approvato", "ha difeso", "hanno discusso", "ha sospeso"], ["la riforma del catasto", "un ponte sull'estuario", "la vendita del legname", "la chiusura della vecchia fonderia"], ["su entrambe le rive", "in tutta la provincia", "alla foce del fiume", "senza ritardo"]),
    "pt": (["A autoridade portuária", "Um antigo juiz", "O banco central", "A comissão eleitoral"], ["suspendeu", "aprovou", "criticou", "assinou"], ["a reforma do cadastro", "uma remessa de vacinas", "os números do trimestre", "um empréstimo para a ferrovia"], ["além da fronteira", "em ambas as margens", "perto da antiga fortaleza", "sem demora"]),
}


def _text(r, lang, n=4):
    return " ".join(" ".join(r.choice(p) for p in PARTS[lang]) + "." for _ in range(n))


@pytest.fixture(scope="module")
def prototypes(spark):
    r, rows = random.Random(1), []
    for lang in PARTS:
        for _ in range(60):
            label = lang if r.random() > 0.15 else r.choice(list(PARTS))
            rows.append((_text(r, lang), r.choice([label, label.upper() + " ", label + "-XX"])))
    rows += [(None, "en"), ("", "en"), ("12 34", "fr"), ("hello there", None)]
    return hdlang.train(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")


def _detect(spark, prototypes, rows, schema="doc_id long, text string"):
    return hdlang.detect(spark.createDataFrame(rows, schema), ["doc_id"], "text", prototypes)


def test_held_out_texts(spark, prototypes):
    r = random.Random(2)
    rows, want = [], {}
    for i in range(240):
        want[i] = r.choice(list(PARTS))
        t = _text(r, want[i], r.choice([1, 2, 5]))
        rows.append((i, r.choice([t, t.upper(), "<P> " + t, t.encode().decode("latin-1")])))
    got = {x["doc_id"]: (x["seg_no"], x["lang"]) for x in _detect(spark, prototypes, rows).collect()}
    assert sum(got[i] == (0, want[i]) for i in want) >= 0.97 * len(want)


def test_stretches(spark, prototypes):
    r = random.Random(3)
    rows, want = [], {}
    for i in range(80):
        langs = r.sample(list(PARTS), r.choice([2, 3]))
        want[i] = list(enumerate(langs, 1))
        rows.append((i, r.choice([" ", "\n\n"]).join(_text(r, x, r.choice([2, 3, 4])) for x in langs)))
    out = _detect(spark, prototypes, rows).collect()
    got = {}
    for x in sorted(out, key=lambda x: (x["doc_id"], x["seg_no"])):
        got.setdefault(x["doc_id"], []).append((x["seg_no"], x["lang"]))
        assert rows[x["doc_id"]][1][x["start"] : x["stop"]].strip().endswith(".") and 0 <= x["confidence"] <= 1
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_edges(spark, prototypes):
    quoted = _text(random.Random(4), "en") + ' He left ("comme on dit ici") at once.'
    rows = [(1, None), (2, ""), (3, " \n"), (4, "12 34.5"), (5, quoted), (5, quoted), (6, _text(random.Random(5), "de", 2000)), (7, "日本語"), (8, "Собака спит. Кошка ест."), (9, "Ok."), (10, "a\x00b" * 9)]
    found = _detect(spark, prototypes, rows).collect()
    got = sorted((x["doc_id"], x["seg_no"], x["lang"]) for x in found if x["doc_id"] != 10)
    assert got == [(5, 0, "en"), (5, 0, "en"), (6, 0, "de"), (7, 0, "und"), (8, 0, "und"), (9, 0, "und")]
    assert {(x["confidence"], x["n_sentences"], x["start"]) for x in found if x["lang"] == "und"} == {(0.0, 0, 0)} and sum(x["doc_id"] == 10 for x in found) == 1
    assert _detect(spark, prototypes, []).count() == 0
    assert _detect(spark, np.zeros_like(prototypes), rows).count() == 0
    same = hdlang.detect(spark.createDataFrame(rows[4:5], "lang long, text string"), ["lang"], "text", prototypes)
    assert same.columns[:3] == ["lang", "seg_no", "lang_"] and same.first()["lang_"] == "en"
    clash = hdlang.detect(spark.createDataFrame([(1, "x", _text(random.Random(6), "it"))], "doc_id long, _text string, t string"), ["doc_id", "_text"], "t", prototypes)
    assert [(r["doc_id"], r["_text"], r["lang"]) for r in clash.collect()] == [(1, "x", "it")]


def test_looked_up_products_are_those_of_the_bundles(prototypes):
    texts = [hdlang._letters(_text(random.Random(i), "fr")) for i in range(5)]
    model = hdlang.Profiles(prototypes)
    dots, norms = model.bundles(texts)
    for t, d, n in zip(texts, dots, norms):
        dense = hdlang.gram_vectors(hdlang.gram_ids(t), model.v).astype(np.float64).sum(axis=0)
        assert np.allclose(model.p @ dense, d, rtol=1e-3, atol=1e-2)
        assert abs(np.linalg.norm(dense) / n - 1) < 0.2


def test_labels(spark):
    rows = [("en", "en"), (" EN ", "en"), ("en_US", "en"), ("eng", "en"), ("English", "en"), ("pt-BR", "pt"), ("es-419", "es"), ("German", "de"), ("The", None), ("nl", None), ("", None), (None, None), ("english (uk)", "en")]
    df = spark.createDataFrame(rows, "l string, want string")
    assert df.where(~F.coalesce(hdlang.label_language(F.col("l")), F.lit("")).eqNullSafe(F.coalesce("want", F.lit("")))).count() == 0


def test_confidence_says_how_often_it_is_right(spark, prototypes):
    r, rows, want = random.Random(9), [], {}
    for i in range(600):
        want[i] = r.choice(list(PARTS))
        w = _text(r, want[i], 1).split()
        rows.append((i, " ".join(r.sample(w, min(len(w), r.choice([2, 3, 8]))))))
    got = [(x["confidence"], x["lang"] == want[x["doc_id"]]) for x in _detect(spark, prototypes, rows).collect() if x["lang"] != "und"]
    high, low = [ok for c, ok in got if c >= 0.9], [ok for c, ok in got if c < 0.7]
    assert sum(high) >= 0.97 * len(high) and sum(high) / len(high) > sum(low) / max(1, len(low))
    assert all(0 < c <= 1 for c, _ in got)


def test_side_by_side_is_one_by_one():
    r = np.random.default_rng(1)
    size = r.integers(1, 9, 60)
    first, gain = np.cumsum(size) - size, r.normal(size=(size.sum(), 6))
    alone = [hdlang.segments(gain[a : a + n], np.array([0]), 1.0) for a, n in zip(first, size)]
    assert (np.concatenate(alone) == hdlang.segments(gain, first, 1.0)).all()
    for a, n in zip(first, size):
        if n < 6:
            every = np.array(np.meshgrid(*[range(6)] * n)).T.reshape(-1, n)
            value = gain[a + np.arange(n), every].sum(axis=1) - (every[:, 1:] != every[:, :-1]).sum(axis=1)
            assert (every[value.argmax()] == hdlang.segments(gain[a : a + n], np.array([0]), 1.0)).all()


def test_long_texts_are_sampled_for_training(spark):
    rows = [(_text(random.Random(i), lang, 900), lang) for i, lang in enumerate(PARTS)]
    p = hdlang.train(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert p.any(axis=1).all()
