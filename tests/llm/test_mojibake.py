from __future__ import annotations

from factloom.llm import mojibake as m

CLEAN = ["Où en est la tâche « stage » ? Elle était prévue pour l’été, à vérifier près du déjeuner.", "Die Prüfung läuft über den Schlüssel – außerdem fünf größere Übungen.", "Файл слишком велик, сначала перенесите общий код.", "파일은 너무 크다 그리고 순환에서 끝난다", "処理は既に終了しました", "MAÇÃ, CORAÇÃO, AVÔ — ÂMBITO", "├── a\n└── b"]


def found(spark, texts):
    rows = [(i, t, "x", "y") for i, t in enumerate([*CLEAN, *CLEAN, *CLEAN, *texts])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, garbled string, original string")
    n = 3 * len(CLEAN)
    return {r.doc_id - n for r in m.affected_ids(df).collect()}, df, n


def test_chains(spark):
    fr, de, ru, ko, ja, _, tree = CLEAN
    bad = [
        fr.encode().decode("latin-1"),
        de.encode().decode("cp1252", "replace"),
        de.encode("cp1252").decode("mac_roman"),
        de.encode().decode("cp850"),
        ru.encode("cp1251").decode("latin-1"),
        ru.encode("koi8_r").decode("cp1251"),
        ko.encode("cp949").decode("latin-1"),
        ja.encode().decode("latin-1"),
        fr.encode().decode("latin-1").encode().decode("latin-1"),
        de.encode("cp1252").decode("utf-8", "replace"),
        tree.encode().decode("latin-1"),
        "Genuine words first, then " + fr.encode().decode("latin-1") + " and plain ones after",
    ]
    good = [None, "", "plain ASCII", "Sample alphabet: Ã, Â, Å, Ä, Ð, Ñ", "cites `Ã©tÃ©` and `�` only", "AMANHÃ ÀS 2H: MAÇÃ, AVÔ", "± 5 ms, σ ≈ 3 µs", "‹one› † ‡", "FORÊT, DÉJÀ"]
    got, _, _ = found(spark, bad + good)
    assert got == set(range(len(bad)))


def test_restoration(spark):
    fr, de = CLEAN[0], CLEAN[1]
    got, df, n = found(spark, [fr.encode().decode("latin-1"), "x " + de.encode("cp1252").decode("mac_roman") + " `cÃ©`", de.encode("cp1252").decode("utf-8", "replace")])
    out = {r.doc_id - n: r for r in m.restored(df).collect()}
    assert out[0].restored_text == fr
    assert out[1].restored_text == "x " + de + " `cÃ©`"
    assert got == {0, 1, 2} and out[2].restored_words <= out[2].garbled_words


def test_round_trip_of_forms():
    for w in ("été", "Übungen", "слишком", "파일은"):
        forms = m.garbled_forms(w)
        assert w not in forms and m.is_clean(w)
        for page in ("latin-1", "cp1252"):
            g = "".join(m._readings(w.encode(), page)[0])
            assert all(p in forms for p in m.WORD.findall(g) if sum(c > "\x7f" for c in p) >= 2)
    assert not m.is_clean("été".encode().decode("latin-1"))


def test_copies_and_ties(spark):
    de, fr = CLEAN[1], CLEAN[0]
    short = "Où, là, dès, né, été."
    bad = [
        *[de.encode("cp1252").decode("mac_roman")] * 5,  # more copies than its clean words have
        *[fr.encode("cp1252").decode("utf-8", "replace")] * 5,
        "Überprüfung der Größenänderung".encode("cp1252").decode("cp850"),  # clean once, garbled once
        short.encode("cp1252").decode("mac_roman"),  # short words only
    ]
    good = ["Überprüfung der Größenänderung", short, "‹one› † ‡", "MAÇÃ, AVÔ"]
    got, df, n = found(spark, bad + good)
    assert got == set(range(len(bad)))
    out = {r.doc_id - n: r.restored_text for r in m.restored(df).collect()}
    assert out[0] == de and out[10] == good[0] and out[11] == short


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert m.affected_ids(df).count() == 0 and m.restored(df).count() == 0
