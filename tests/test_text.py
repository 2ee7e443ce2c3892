"""Text rules against their golden values and against a plain restatement of the hyphen rule."""

import random
import re

from pyspark.sql import functions as F

from foliant.functions import text as X

L, S = X.LETTERS, X.SMALL_LETTERS


def one(spark, f, *values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", f(F.col("t")).alias("o")).collect()
    return [r.o for r in sorted(rows)]


def closer(s, i):
    """Where the first closing dash at or after i is, seen through a window that ends the text for it; -1 if there is none."""
    stop = min(len(s), i + X.DASH_WINDOW)
    return next((j for j in range(i, stop) if s[j] == "-" and re.match(f"[{L}]", s[j - 1 : j]) and (j + 1 == stop or s[j + 1] in " ,.;:)")), -1)


def hyphens(s):
    """Letter by letter: what opens without a closer goes, and then what closes without an opener."""
    small, letter = (lambda c: re.match(f"[{S}]", c)), (lambda c: re.match(f"[{L}]", c))
    out, i = "", 0
    while i < len(s):
        if s[i : i + 2] == " -" and i and letter(s[i - 1]) and small(s[i + 2 : i + 3]) and closer(s, i + 2) < 0:
            i += 2
        else:
            out, i = out + s[i], i + 1
    s, out, i = out, "", 0
    paired = {closer(s, k + 2) for k in range(1, len(s)) if s[k : k + 2] == " -" and letter(s[k - 1]) and small(s[k + 2 : k + 3])}
    while i < len(s):
        if s[i : i + 2] == "- " and i and letter(s[i - 1]) and small(s[i + 2 : i + 3]) and i not in paired:
            i += 2
        else:
            out, i = out + s[i], i + 1
    return out


def test_normalize(spark):
    assert one(spark, X.normalize, "45 m²", "45 m 2", "45 m?", "Fondo  MÁXIMO", "tipo U d o B o", "venta -nal", "cua- tro", "muros -altos o bajos- con", "a\uf0b1  5", "ß ø") == [
        "45 m2", "45 m2", "45 m2", "fondo maximo", "tipo ud o bo", "ventanal", "cuatro", "muros -altos o bajos- con", "a± 5", "ß ø"]


def test_hyphens(spark):
    random.seed(4)
    made = ["".join(random.choice(["a", "b", "é", "B", " ", " -", "- ", "-", ",", "x" * 70, ".", ") "]) for _ in range(random.randint(1, 14))) for _ in range(1500)]
    made = [re.sub(r"\s+", " ", s).strip() for s in made]
    bad = [(s, g, hyphens(s)) for s, g in zip(made, one(spark, X.rejoin_hyphens, *made), strict=True) if g != hyphens(s)]
    assert not bad, bad[:3]


def test_repair(spark):
    assert one(spark, lambda c: X.repair(c, True), "9 m? y 5><6", "m?   z", "dm? w") == ["9 m² y 5×6", "m² z", "dm? w"]
    assert one(spark, X.repair, "9 m?") == ["9 m?"]


def test_cites(spark):
    got = one(spark, X.parse_cite, "Sección HS 3 Aire", "Artículo 7. Patios", "2.5 y", "2.5.y", "C.1.4.", "nada", "ANEJO B z", "Título II")
    assert [(g.cite, g.kind, g.rank) for g in got] == [("Sección HS 3", "ns", 1), ("Artículo 7", "ns", 2), ("2.5", "num", None), (None, None, None), ("C.1.4", "num", None), (None, None, None), ("ANEJO B", "ns", 1), ("Título II", "ns", 1)]
    assert one(spark, X.cite_path, "Artículo 7.2.b)", "Capítulo IX") == ["art7.2.b", "capIX"]
    assert one(spark, X.doc_code, "Norma-7", "a.b-c_d", "DOG_2025") == ["NOR", "ABC", "DOG"]


def test_dashes_in_long_texts(spark):
    """Only dashes look back: a text of 100,000 words with one dash takes no time to speak of (letters that look back take some twenty times as long)."""
    import time

    text = "muro- sa " + "palabra " * 100_000
    rows = spark.createDataFrame([(text,)] * 40, "t string").repartition(4)
    out = rows.select(X.rejoin_hyphens(F.col("t")).alias("n"))
    assert out.first()["n"].startswith("murosa palabra")
    begin = time.time()
    assert out.agg(F.sum(F.length("n"))).first()[0] == 40 * (len(text) - 2)
    assert time.time() - begin < 15
