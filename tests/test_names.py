"""Names by one automaton equal single patterns; windows of mentions, vote announcements and list vetoes equal loops."""

import random
import re

from quillwork.operators import names

WORDS = ["vinelli", "vineli", "binelli", "vinellis", "el", "ministro", "cuba", "ana", "noboa", "novoa", "facultades", "legislativas", "biometria", "abba", "aba", "abbba", "senasa", "canciller", "espa"]


def catalogue(spark):
    rows = spark.createDataFrame([("Marco Vinelli",), ("Ana Cuba",), ("Daniel Noboa",), ("Rosa Abba",), ("Carlos Espá",)], "name string")
    said = spark.createDataFrame([("facultades legislativas",), ("biometri",), ("SENASA",), ("",), (None,)], "term string")
    return names.people(rows, "name", ["cuba", "espa"], ["ministro", "ministra", "canciller"], ["Daniel Noboa"]).unionByName(names.terms(said, "term"))


def patterns():
    """The rules, one regular expression each."""
    roles = "(?:ministro|ministra|canciller)"
    double = lambda s: re.sub(r"[bv]", "[bv]", re.sub(r"(\w)\1", r"\1{1,2}", s))
    return {
        "Marco Vinelli": rf"\b{double('vinelli')}\b", "Daniel Noboa": rf"\b{double('noboa')}\b", "Rosa Abba": r"\ba[bv]{1,2}a\b",
        "Ana Cuba": rf"\b(?:ana cuba|{roles} cuba)\b", "Carlos Espá": rf"\b(?:carlos espa|{roles} espa)\b",
        "facultades legislativas": r"\bfacultades legislativas", "biometri": r"\bbiometri", "SENASA": r"\bsenasa",
    }


def test_against_single_patterns(spark):
    rng = random.Random(2)
    texts = [(i, rng.choice(["", ", ", "¡"]).join([" ".join(rng.choices(WORDS, k=rng.randrange(30))), ""])) for i in range(200)]
    texts += [(900, "El Ministro ESPÁ y la señora Vineli"), (901, None), (902, ""), (903, "xvinelli vinelli_ vinelliñ"), (904, "Novoa"), (904, "Novoa")]
    df = spark.createDataFrame(texts, "k long, t string")
    got = sorted(tuple(r) for r in names.spotted(df, catalogue(spark), ["k"], "t").select("k", "label", "start", "end").distinct().collect())
    fold = str.maketrans("áéíóúñ", "aeioun")
    expected = {(k, label, m.start(), m.end()) for k, t in texts for label, p in patterns().items() for m in re.finditer(f"(?={p})", (t or "").lower().translate(fold)) for m in [re.compile(p).match((t or "").lower().translate(fold), m.start())] if m}
    assert got == sorted(expected) and len(got) > 100


def test_mentions(spark):
    lines = [(1, 0, "buenas noches"), (1, 10, "hoy nos acompaña el ministro Vinelli"), (1, 20, "las facultades legislativas"), (1, 200, "deportes"), (1, 400, "el Senasa dijo")]
    lines += [(2, 0, "Novoa viajo"), (3, 0, "Novoa y el Senasa"), (4, 0, "a Cuba y a Valencia"), (5, 7, None)]
    promo = "no vea el acto si quiere ver candidatos hablar del senasa de una manera ridicula"
    lines += [(6, t, promo) for t in (0, 300, 600)]
    df = spark.createDataFrame(lines, "s long, t long, x string")
    found = names.spotted(df, catalogue(spark), ["s", "t"], "x")
    got = sorted((r.s, r.start, r.end, r.labels, r.said) for r in names.mentions(df, found, "s", "t", "x").collect())
    assert [g[:4] for g in got] == [
        (1, 10, 20, ["Marco Vinelli", "facultades legislativas"]), (1, 400, 400, ["SENASA"]), (3, 0, 0, ["Daniel Noboa", "SENASA"]), (6, 0, 0, ["SENASA"]),
    ]
    assert got[0][4] == "buenas noches hoy nos acompaña el ministro Vinelli las facultades legislativas"


def test_votes(spark):
    rng = random.Random(8)
    said = ["se vota el proyecto", "han votado a favor, 67", "con 12 votos en contra", "pasamos a cuarto intermedio", "ha sido aprobado " * 30, "x" * 700]
    lines = [(s, t, rng.choice(said)) for s in range(3) for t in range(25)] + [(9, 0, None), (9, 1, "")]
    got = {(r.s, r.t): (r.matched, r.said) for r in names.vote_events(spark.createDataFrame(lines, "s long, t long, x string"), "s", "t", "x", names.VOTES, 100, 40).collect()}
    expected = {}
    for s in range(3):
        text = ""
        for _, t, x in sorted(r for r in lines if r[0] == s):
            start = len(text) + (1 if text else 0)
            text = f"{text} {x}" if text else x
            if m := re.search(names.VOTES, x):
                end = start + m.end()
                expected[s, t] = (m[0], text[max(0, end - 100) : min(end + 40, len(text))].strip())
    assert got == expected and got


def test_lists(spark):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choices(["vega", "presente", "si", "otra", "cosa", "ñandu"], k=rng.randrange(80)))) for i in range(60)]
    df = spark.createDataFrame([*texts, (99, None)], "k long, t string")
    got = sorted(tuple(r) for r in names.mentions_outside_lists(df, "k", "t", r"\bvega\b", r"\b(?:presente|si)\b", 30, 3).collect())
    expected = []
    for k, t in texts:
        for m in re.finditer(r"\bvega\b", t):
            lo, hi = max(0, m.start() - 30), min(len(t), m.end() + 30)
            n = sum(a.start() >= lo and a.end() <= hi for a in re.finditer(r"\b(?:presente|si)\b", t))
            if n < 3:
                expected.append((k, m.start(), m.end(), t[lo:hi]))
    assert got == sorted(expected) and got
