"""Normalised names and the stable keys of nodes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Particles that are dropped as whole words, kinds, confidences, and the form of a key.
PARTICLES = ("DA", "DAS", "DE", "DI", "DO", "DOS", "E")
COMPANY, PERSON, FOREIGNER = "pessoa_juridica", "pessoa_fisica", "estrangeiro"
KINDS = {"1": COMPANY, "2": PERSON, "3": FOREIGNER}
EXACT, ESTIMATED, WEAK, UNMERGEABLE = "exata", "estimada", "fraca", "nao_fundivel"
SEPARATOR, KEY_DIGITS = "|", 16


def _folding() -> tuple[str, str]:
    """Accented letters of the Latin blocks and their plain ones, from their decompositions."""
    pairs = [(chr(p), unicodedata.normalize("NFKD", chr(p)).encode("ascii", "ignore").decode()) for p in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()
#: What has no plain letter goes: combining marks and all other characters beyond ASCII.
BEYOND_ASCII = "[^\\x00-\\x7F]"


def normalise_name(name: Column) -> Column:
    """Accents off, upper case, words by one blank, particles out; null if nothing is left."""
    plain = F.upper(F.regexp_replace(F.translate(F.coalesce(name, F.lit("")), ACCENTED, PLAIN), BEYOND_ASCII, ""))
    words = F.filter(F.split(plain, r"[ \t\n\x0B\f\r\x1C-\x1F]+"), lambda w: (w != "") & ~w.isin(*PARTICLES))
    return F.nullif(F.array_join(words, " "), F.lit(""))


def node_id(*parts: Column) -> Column:
    """First sixteen hexadecimal digits of the SHA-256 of the parts."""
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *parts), 256), 1, KEY_DIGITS)


def company_id(cnpj_basico: Column) -> Column:
    """The key of a company's node; both ends of a link must use it."""
    return node_id(F.lit(COMPANY), cnpj_basico)


def kind_of(code: Column) -> Column:
    out = F.when(code == "1", COMPANY)
    for c, kind in list(KINDS.items())[1:]:
        out = out.when(code == c, kind)
    return out


def confidence_of(code: Column, name: Column, document: Column) -> Column:
    return (
        F.when(code == "1", EXACT)
        .when((code == "2") & name.isNotNull() & document.isNotNull(), ESTIMATED)
        .when((code == "3") & name.isNotNull(), WEAK)
        .otherwise(UNMERGEABLE)
    )


def partner_id(confidence: Column, company: Column, name: Column, document: Column, country: Column) -> Column:
    """The key of a partner's node by its confidence."""
    blank = F.lit("")
    return (
        F.when(confidence == EXACT, company_id(F.substring(document, 1, 8)))
        .when(confidence == ESTIMATED, node_id(F.lit(PERSON), name, document))
        .when(confidence == WEAK, node_id(F.lit(FOREIGNER), name, F.coalesce(country, blank)))
        .otherwise(node_id(F.lit(UNMERGEABLE), company, F.coalesce(document, blank), F.coalesce(name, blank), F.coalesce(country, blank)))
    )


def fiscal_region(mask: Column) -> Column:
    """Ninth character of a masked personal number."""
    return F.substring(mask, 9, 1)
