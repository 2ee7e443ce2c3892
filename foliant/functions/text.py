"""Text rules as column expressions: repair, normalisation, cites, markers. All run in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: glyphs, subscript pairs, letters, cite shapes ---
GLYPHS = {"\uf0b1": "±", "\uf061": "α", "\uf044": "Δ", "\uf06d": "μ"}
SUBSCRIPTS = ("R d", "C 1", "B o", "U d", "R c")
LETTERS = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
SMALL_LETTERS = "a-záéíóúüñ"
DASH_WINDOW = 200
RUNNING_HEADER = r"(?U)\s*DOG\s+N[uú]m\.\s*[\d.]+\s*$"
MARKER = r"^\s*([0-9]+|[a-zA-Z]|[ivxIVX]+)\s*[.)]\s*$"
INLINE_MARKER = r"(?U)^\s*([0-9]+(?:\.[0-9]+)*|[a-z]|[ivx]+)\s*[).]?\s+(?=[A-ZÁÉÍÓÚÜÑ])"
HEADING = r"(?U)^[A-Z]\.[0-9]+(?:\.[0-9]+)*\.?\s+\S"
HEADING_LENGTH = 100
#: (pattern, kind, rank), the first that matches counts
CITES = (
    (r"(?iU)^(Anejo\s+[A-Z])\b", "ns", 1),
    (r"(?iU)^(Secci[oó]n\s+[A-Z]*\s*[0-9]+)\b", "ns", 1),
    (r"(?iU)^(Cap[ií]tulo\s+[IVXLC0-9]+)\b", "ns", 1),
    (r"(?iU)^(T[ií]tulo\s+[IVXLC0-9]+)\b", "ns", 1),
    (r"(?iU)^(Art[ií]culo\s+[0-9]+)\b", "ns", 2),
    (r"(?U)^([A-Z]\.[0-9]+(?:\.[0-9]+)*)\.?(?=[\s.]|$)", "num", None),
    (r"(?U)^([0-9]+(?:\.[0-9]+)*)\.?(?=\s|$)", "num", None),
)
PREFIXES = (("art[ií]?culo", "art"), ("anejo", "anejo"), ("secci[oó]?n", "sec"), ("cap[ií]?tulo", "cap"), ("t[ií]?tulo", "tit"))
CODES = {"DccSUA": "SUA", "DOG_2025": "DOG", "dog-habitabilidad": "D128"}


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Every character whose decomposition without marks is one other character, and that character."""
    found = {}
    for i in range(0x80, sys.maxunicode + 1):
        bare = [c for c in unicodedata.normalize("NFD", chr(i)) if unicodedata.category(c) != "Mn"]
        if len(bare) == 1 and bare[0] != chr(i):
            found[chr(i)] = bare[0]
    return "".join(found), "".join(found.values())


def bound(c: Column, f) -> Column:
    """f of the column's value, computed once however often f mentions it."""
    return F.get(F.transform(F.array(c), f), 0)


def strip_accents(c: Column) -> Column:
    """Decomposes and drops marks. ASCII texts, the common case, skip the table."""
    return bound(c, lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(x, *_accents()), r"\p{Mn}", "")).otherwise(x))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def glyphs(c: Column) -> Column:
    return F.translate(c, "".join(GLYPHS), "".join(GLYPHS.values()))


def repair(text: Column, ocr: Column | bool = False) -> Column:
    """The printed text with its known extraction faults mended."""
    s = F.replace(glyphs(text), F.lit("><"), F.lit("×"))
    return collapse(F.when(F.lit(ocr) if isinstance(ocr, bool) else ocr, F.regexp_replace(s, r"(?U)(?<=\bm)\?", "²")).otherwise(s))


def rejoin_hyphens(c: Column) -> Column:
    """Joins words that a line break cut; dashes that open and close a parenthesis stay.

    Both passes are single expressions: an opening dash is kept if a closing one begins within DASH_WINDOW
    characters, and a closing dash is kept if an opener within the window has it as its first closer. The look back over the window comes after
    that for a dash: before it, every letter of a text would look back.
    """
    close = rf"(?<=[{LETTERS}])-(?:[\s,.;:)]|$)"
    first = rf"(?U)(?<=[{LETTERS}])\s+-(?=[{SMALL_LETTERS}])(?!.{{0,{DASH_WINDOW - 2}}}{close}|.{{{DASH_WINDOW - 1}}}(?<=[{LETTERS}])-)"
    opened = rf"[{LETTERS}]\s-(?=[{SMALL_LETTERS}])(?:(?!{close}).){{0,{DASH_WINDOW - 1}}}"
    second = rf"(?U)(?=-\s)(?<=[{LETTERS}])(?<!{opened})-\s+(?=[{SMALL_LETTERS}])"
    one = bound(c, lambda x: F.when(x.contains(" -"), F.regexp_replace(x, first, "")).otherwise(x))
    return bound(one, lambda x: F.when(x.contains("- "), F.regexp_replace(x, second, "")).otherwise(x))


def normalize(text: Column) -> Column:
    """The form that search matches; queries go through the same function."""
    s = rejoin_hyphens(collapse(glyphs(text)))
    for pair in SUBSCRIPTS:
        head, tail = pair.split()
        s = F.regexp_replace(s, rf"(?U)\b{head}\s+{tail}\b", head + tail)
    return F.regexp_replace(strip_accents(F.lower(s)), r"(?U)\bm\s*[²2?]", "m2")


def parse_cite(text: Column) -> Column:
    """struct(cite, kind, rank) of a heading; all null if it bears none."""
    s = collapse(text)
    out = F.struct(F.lit(None).cast("string").alias("cite"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("rank"))
    for pattern, kind, rank in reversed(CITES):
        got = F.regexp_extract(F.trim(text), pattern, 1)
        out = F.when(got != "", F.struct(F.trim(got).alias("cite"), F.lit(kind).alias("kind"), F.lit(rank).cast("int").alias("rank"))).otherwise(out)
    return F.when(s.isNotNull(), out)


def cite_path(cite: Column) -> Column:
    """The part of an address that a printed cite makes."""
    s = strip_accents(cite)
    for word, short in PREFIXES:
        s = F.regexp_replace(s, rf"(?iU)^{word}\s*", short)
    return F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", ""), r"[.)]+$", "")


def doc_code(doc: Column) -> Column:
    out = F.upper(F.substring(F.regexp_replace(doc, "[^A-Za-z0-9]", ""), 1, 3))
    for name, code in CODES.items():
        out = F.when(doc == name, code).otherwise(out)
    return out


def is_marker(c: Column) -> Column:
    return F.trim(c).rlike(MARKER)


def marker_ordinal(c: Column) -> Column:
    """3. is 3, c) is 3; null for anything else."""
    bare = F.regexp_extract(c, r"^\s*([0-9]+|[a-z])\s*[.)]", 1)
    return F.when(bare.rlike("^[0-9]+$"), bare.try_cast("int")).when(bare.rlike("^[a-z]$"), F.ascii(bare) - 96)


def term_pattern(normal: str) -> str:
    """A pattern that finds a normalised term, taken literally, at a word boundary."""
    return r"(?U)\b" + "".join("\\" + c if ord(c) < 128 and not c.isalnum() else c for c in normal)


def normal_terms(spark, terms: list[str]) -> list[str]:
    """Terms in the form of the norm column, in order."""
    rows = spark.createDataFrame(list(enumerate(terms)), "i int, t string").select("i", normalize(F.col("t")).alias("t")).collect()
    return [r["t"] for r in sorted(rows)]
