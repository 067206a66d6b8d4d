"""Personal and company registration numbers as column expressions: check digits, parsing, suppression in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mark, and the shapes of documents that are suppressed by shape alone.
MARK = "[NUMERO SUPRIMIDO]"
KNOWN_SHAPES = (
    r"[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}",
    r"[0-9]{3}\.[0-9]{3}\.[0-9]{3}\.[0-9]{2}",
    r"[0-9]{3} [0-9]{3} [0-9]{3} [0-9]{2}",
    r"[0-9]{10,}",
)
SPLIT_CPF = r"[0-9]{9}[-. ][0-9]{2}"
SHORT_CPF = 9
# Weights of the two check digits of a company number.
CNPJ_WEIGHTS = ((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def _weighted(digits: Column, weights: list[int]) -> Column:
    """Sum of digit times weight; the digits must be digits."""
    terms = [F.substring(digits, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def cpf_valid(number: Column) -> Column:
    """Eleven digits, not all the same, with both check digits right; never null."""
    return F.coalesce(_let(number, _cpf_valid), F.lit(False))


def _cpf_valid(number: Column) -> Column:
    first = _weighted(number, list(range(10, 1, -1))) * 10 % 11 % 10
    second = _weighted(number, list(range(11, 1, -1))) * 10 % 11 % 10
    return (
        number.rlike("^[0-9]{11}$")
        & (number != F.repeat(F.substring(number, 1, 1), F.lit(11)))
        & (first == F.substring(number, 10, 1).try_cast("int"))
        & (second == F.substring(number, 11, 1).try_cast("int"))
    )


def _without(text: Column, found: Column, is_document) -> Column:
    return F.aggregate(F.filter(found, is_document), text, lambda t, x: F.replace(t, x, F.lit(MARK)))


def suppress_documents(text: Column) -> Column:
    """Free text with every recognisable personal number replaced by the mark; null stays null.

    Known shapes go first: only then is a run of nine digits and two more what it seems to be.
    """
    known = text
    for shape in KNOWN_SHAPES:
        known = F.regexp_replace(known, shape, MARK)
    return F.when(text.rlike("[0-9]"), _let(_let(known, _without_split), _without_short)).otherwise(text)


def _without_split(text: Column) -> Column:
    return _without(text, F.regexp_extract_all(text, F.lit(SPLIT_CPF), F.lit(0)), lambda x: cpf_valid(F.concat(F.substring(x, 1, 9), F.substring(x, 11, 2))))


def _without_short(text: Column) -> Column:
    return _without(text, F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda x: (F.length(x) == SHORT_CPF) & cpf_valid(F.lpad(x, 11, "0")))


def cnpj_check_digits(base: Column) -> Column:
    """The two check digits of twelve digits, as text; null for anything else."""

    def digit(value: Column, weights: tuple[int, ...]) -> Column:
        return _let(_weighted(value, list(weights)) % 11, lambda rest: F.when(rest < 2, 0).otherwise(11 - rest).cast("string"))

    def both(value: Column) -> Column:
        extended = _let(F.concat(value, digit(value, CNPJ_WEIGHTS[0])), lambda v: F.concat(F.substring(v, 13, 1), digit(v, CNPJ_WEIGHTS[1])))
        return F.when(value.rlike("^[0-9]{12}$"), extended)

    return _let(base, both)


def cnpj_parse(text: Column) -> Column:
    """``struct(valid, basico, ordem, verificador, error)`` of a company number with or without ``. - /`` and white space."""

    def parsed(digits: Column) -> Column:
        shaped = digits.rlike("^[0-9]{14}$")
        valid = F.coalesce(shaped & (cnpj_check_digits(F.substring(digits, 1, 12)) == F.substring(digits, 13, 2)), F.lit(False))
        return _let(valid, lambda v: F.struct(
            v.alias("valid"),
            F.when(v, F.substring(digits, 1, 8)).alias("basico"),
            F.when(v, F.substring(digits, 9, 4)).alias("ordem"),
            F.when(v, F.substring(digits, 13, 2)).alias("verificador"),
            F.when(v, F.lit(None).cast("string")).when(shaped, "verifier").otherwise("shape").alias("error"),
        ))

    return _let(F.regexp_replace(F.coalesce(text, F.lit("")), r"[.\-/\s]", ""), parsed)


def cnpj_format(basico: Column) -> Column:
    """The head office's full number, punctuated, from the eight digits of the base (text or number)."""
    def dotted(base: Column) -> Column:
        return F.concat(
            F.substring(base, 1, 2), F.lit("."), F.substring(base, 3, 3), F.lit("."), F.substring(base, 6, 3), F.lit("/0001-"), cnpj_check_digits(F.concat(base, F.lit("0001")))
        )

    return _let(F.lpad(basico.cast("string"), 8, "0"), dotted)
