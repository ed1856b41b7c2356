"""Text, number, date and code scalars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Empty text counts as missing; blanks alone don't."""
    return F.nullif(c, F.lit(""))


def filled(c: Column) -> Column:
    """True where there is more than white space."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def missing(c: Column) -> Column:
    return F.coalesce(c.cast("string") == "", F.lit(True))


def squeeze(c: Column) -> Column:
    """Trimmed, runs of white space as one blank; null as empty text."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def digits(c: Column) -> Column:
    """The digits alone; null for null or empty text."""
    return F.when(~missing(c), F.regexp_replace(c, "[^0-9]", ""))


def digits_or_null(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(c, "[^0-9]", ""))


def _number(c: Column) -> Column:
    """A plain decimal number with an optional exponent, and nothing that only a cast would let through."""
    return F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))


def number_br(c: Column) -> Column:
    """A number written the Brazilian or the English way, other characters ignored.

    With both marks the later one is decimal; a single kind is decimal. Null where no number is left.
    """
    kept = F.regexp_replace(c, r"[^0-9.,\-]", "")
    comma = F.length(kept) - F.locate(",", F.reverse(kept))
    dot = F.length(kept) - F.locate(".", F.reverse(kept))
    has_comma, has_dot = F.instr(kept, ",") > 0, F.instr(kept, ".") > 0
    plain = (
        F.when(has_comma & has_dot & (comma > dot), F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(has_comma & has_dot, F.replace(kept, F.lit(","), F.lit("")))
        .when(has_comma, F.replace(kept, F.lit(","), F.lit(".")))
        .otherwise(kept)
    )
    return _number(plain)


def number_or_zero(c: Column) -> Column:
    """A plain number, else one with a decimal comma, else 0."""
    text = F.trim(c.cast("string"))
    br = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.coalesce(_number(text), F.when(F.instr(text, ",") > 0, _number(br)), F.lit(0.0))


def plain_or_zero(c: Column) -> Column:
    return F.coalesce(_number(F.trim(c.cast("string"))), F.lit(0.0))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f mentions it, and outside the method that whole-stage code is fused into.

    Branches evaluate what they mention anew, and the JVM leaves a method of over 8,000 bytes uncompiled.
    """
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strict_decimal(c: Column, scale: int) -> Column:
    """As document XML writes it: blanks dropped, a comma is decimal and then dots group; other symbols give null."""
    plain = lambda text: F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast(f"decimal(18,{scale})"))
    marks = lambda text: F.when(F.instr(text, ",") > 0, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(text)
    # Most are plain already and need one match.
    return F.coalesce(plain(c), F.when(c.isNotNull(), _once(_once(F.regexp_replace(c, r"\s+", ""), marks), plain)))


def positive_int(c: Column) -> Column:
    return F.nullif(digits_or_null(c).try_cast("int"), F.lit(0))


def iso_date(c: Column) -> Column:
    """The first year-month-day, else day-month-year, as YYYY-MM-DD; the calendar isn't checked."""
    part = lambda text, *places: F.concat_ws("-", *[F.substring(text, *p) for p in places])
    dmy = _once(F.regexp_extract(c, r"(\d{2})[-/](\d{2})[-/](\d{4})", 0), lambda d: F.when(d != "", part(d, (7, 4), (4, 2), (1, 2))))
    ymd = _once(F.regexp_extract(c, r"(\d{4})[-/](\d{2})[-/](\d{2})", 0), lambda d: F.when(d != "", part(d, (1, 4), (6, 2), (9, 2))))
    # Most begin with it and need one match.
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(c, 1, 10)).when(c.isNotNull(), F.coalesce(ymd, dmy))


def as_date(c: Column) -> Column:
    return F.try_to_date(c, "yyyy-MM-dd")


def month_key(c: Column) -> Column:
    return F.substring(c, 1, 7)


def year_key(c: Column) -> Column:
    return F.substring(c, 1, 4)


def day_before_after(c: Column) -> tuple[Column, Column]:
    return F.date_sub(as_date(c), 1), F.date_add(as_date(c), 1)


def in_future(c: Column, as_of: Column) -> Column:
    return F.coalesce(as_date(c) > as_of, F.lit(False))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def title_or_region(c: Column) -> Column:
    """White space squeezed; text of four letters or fewer in upper case."""
    text = squeeze(c)
    return F.when(F.length(text) <= 4, F.upper(text)).otherwise(text)


# Company suffixes that are written in capitals.
SUFFIXES = ("LTDA", "ME", "EPP", "EIRELI", "S/A", "SA", "MEI", "SPE", "SIMPLES", "SIMPLES NACIONAL", "SCP", r"S\.A\.")


def company_name(c: Column) -> Column:
    text = title_or_region(c)
    for suffix in SUFFIXES:
        text = F.regexp_replace(text, rf"(?i)\b{suffix}(?!\w)", suffix.replace("\\", ""))
    for spaced, joined in (("S. A.", "S.A."), ("S / A", "S/A"), ("S. / A.", "S/A")):
        text = F.replace(text, F.lit(spaced), F.lit(joined))
    return squeeze(text)


def shortened_middle(c: Column, head: int, tail: int) -> Column:
    return F.when(F.length(c) <= head + tail, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit("\n...\n"), F.right(c, F.lit(tail))))


def shortened(c: Column, most: int) -> Column:
    """At most that many characters, cut at a word's end, with a mark that something is missing."""
    cut = F.regexp_replace(F.left(squeeze(c), F.lit(most - 1)), r"\s+\S*$", "")
    return F.when(F.length(squeeze(c)) <= most, squeeze(c)).otherwise(F.concat(cut, F.lit("…")))


_MARKED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"


def unaccented(c: Column) -> Column:
    return F.translate(c, _MARKED, _PLAIN)


def word_tokens(c: Column) -> Column:
    """Lower case, no accents, everything else than a-z and 0-9 as one blank; null if nothing is left."""
    return blank_to_null(F.trim(F.regexp_replace(unaccented(F.lower(c)), "[^a-z0-9]+", " ")))


def layout_text(c: Column, most: int = 50_000) -> Column:
    kept = F.regexp_replace(unaccented(F.lower(F.coalesce(c, F.lit("")))), r"[^a-z0-9|:;,.%\- ]+", " ")
    return F.left(squeeze(kept), F.lit(most))


def layout_fingerprint(columns: Column, text: Column) -> Column:
    return F.left(F.sha2(F.concat(columns, F.lit("||"), layout_text(text)), 256), F.lit(32))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def mask_tax_id(c: Column) -> Column:
    """14 digits as dd.ddd.ddd/dddd-dd, 11 as ddd.ddd.ddd-dd, anything else unchanged."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return (
        F.when(F.length(d) == 14, F.regexp_replace(d, r"(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})", "$1.$2.$3/$4-$5"))
        .when(F.length(d) == 11, F.regexp_replace(d, r"(\d{3})(\d{3})(\d{3})(\d{2})", "$1.$2.$3-$4"))
        .otherwise(c)
    )


def postal_code(c: Column) -> Column:
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) == 8, F.concat_ws("-", F.left(d, F.lit(5)), F.right(d, F.lit(3)))).otherwise(c)


def joined_address(*parts: Column) -> Column:
    """The non-blank parts in order, comma-separated; null if there are none."""
    nul = F.lit("\0")
    # Most parts are squeezed already: between marks, no two blanks or marks then follow each other.
    as_written = ~F.concat(nul, F.concat_ws("\0", *parts), nul).rlike(r"[ \x00]{2}|[\t\n\x0B\f\r]")
    squeezed = F.transform(F.array(*parts), squeeze)
    joined = F.aggregate(squeezed, F.lit(None).cast("string"), lambda joined, p: F.when(p == "", joined).otherwise(F.concat_ws(", ", joined, p)))
    return F.when(as_written, F.concat_ws(", ", *parts)).otherwise(joined)


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def invoice_number(c: Column) -> Column:
    d = F.regexp_replace(digits_or_null(c), "^0+(?=.)", "")
    return F.when(F.length(d) <= 10, d)


def series(c: Column) -> Column:
    s = F.replace(F.upper(F.trim(c)), F.lit(" "), F.lit(""))
    return F.when(s.rlike("^[A-Z0-9-]{1,6}$"), s)


def model(c: Column) -> Column:
    s = F.replace(F.upper(F.trim(c)), F.lit(" "), F.lit(""))
    return F.when(s.rlike("^[A-Z0-9-]{1,10}$"), s)


def fixed_digits(c: Column, n: int) -> Column:
    """Codes of exactly n digits; anything else is null."""
    d = digits(c)
    return F.when(F.length(d) == n, d)


def state_registration(c: Column) -> Column:
    s = F.regexp_replace(F.upper(F.trim(c)), r"[^0-9A-Z./\-]", "")
    for word in ("BAIRRO", "POSTO", "RUA"):
        s = F.replace(s, F.lit(word), F.lit(""))
    return F.when(s.rlike("^([0-9]{3,}|ISENTO)$"), s)


def city_registration(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(F.upper(F.trim(c)), r"[^0-9A-Z./\-]", ""))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def tidy_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")
