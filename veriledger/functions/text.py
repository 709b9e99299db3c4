"""Names, document numbers, keys and free text. Names follow Turkish case rules, document numbers
plain ones, scoring plain lower case: three domains that must not be mixed."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turkish capitals and their small letters; letters and their ASCII neighbours.
TURKISH_UPPER, TURKISH_LOWER = "İIŞĞÜÖÇ", "iışğüöç"
DIACRITICS, PLAIN = "ğĞşŞıİöÖüÜçÇ", "gGsSiIoOuUcC"
#: Words of a company's legal form, which carry no identity.
LEGAL_FORMS = r"(?iu)\b(a\.?ş\.?|ltd\.?|şti\.?|san\.?|tic\.?|ve|a\.?s\.?|anonim|limited|şirketi|sirketi)\b"
NOT_KEY = "[^0-9a-zçğıöşü]+"
#: How currencies are written.
CURRENCIES = {
    "TL": "TRY", "T.L.": "TRY", "TL.": "TRY", "TÜRK LİRASI": "TRY", "TURK LIRASI": "TRY", "LIRA": "TRY", "YTL": "TRY", "YENİ TÜRK LİRASI": "TRY",
    "$": "USD", "US$": "USD", "DOLAR": "USD", "€": "EUR", "EURO": "EUR", "£": "GBP", "STERLIN": "GBP",
}
#: Date formats a document may use, tried in this order.
DATE_FORMATS = ("yyyy-M-d", "d.M.yyyy", "d/M/yyyy", "d-M-yyyy")


#: Latin and Greek letters with marks, from their canonical decompositions to one character each.
MARKS = "\u0300-\u036f"
COMPOSED = {unicodedata.normalize("NFD", chr(i)): chr(i) for lo, hi in ((0xC0, 0x250), (0x386, 0x3CF), (0x1E00, 0x1F00)) for i in range(lo, hi) if len(unicodedata.normalize("NFD", chr(i))) > 1}


def compose(c: Column) -> Column:
    """Letters followed by combining marks as single characters, as NFC has them, for Latin and
    Greek letters; other text stays. Text without such marks, nearly all, is only searched for one."""
    one = F.create_map(*[F.lit(x) for kv in COMPOSED.items() for x in kv])
    letters = F.regexp_extract_all(c, F.lit(f"(?s).[{MARKS}]*"), F.lit(0))
    joined = F.array_join(F.transform(letters, lambda x: F.when(F.length(x) > 1, F.coalesce(F.try_element_at(one, x), x)).otherwise(x)), "")
    return F.when(c.rlike(f"[{MARKS}]"), joined).otherwise(c)


def normalise_name(c: Column) -> Column:
    """A company name without legal form, case and punctuation."""
    low = F.lower(F.translate(compose(F.coalesce(c, F.lit(""))), TURKISH_UPPER, TURKISH_LOWER))
    bare = F.regexp_replace(low, LEGAL_FORMS, " ")
    return F.trim(F.regexp_replace(bare, NOT_KEY, " "))


def normalise_doc_number(c: Column) -> Column:
    return F.regexp_replace(F.lower(compose(F.coalesce(c, F.lit("")))), NOT_KEY, "")


def number_core(c: Column) -> Column:
    """All digits, without leading zeros."""
    return F.ltrim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", ""), F.lit("0"))


def supplier_key(tax_id: Column, name: Column) -> Column:
    """The tax number's digits, else the normalised name."""
    return F.coalesce(F.nullif(F.regexp_replace(tax_id, "[^0-9]", ""), F.lit("")), normalise_name(name))


def identity_key(supplier: Column, number: Column) -> Column:
    return F.concat_ws("|", supplier, number)


def as_date(c: Column) -> Column:
    """The first of the known formats that fits, else null."""
    text = F.trim(c)
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, DATE_FORMATS[0]))
    return F.coalesce(iso, *[F.when(text.rlike(r"^\d{1,2}[./-]\d{1,2}[./-]\d{4}$"), F.try_to_date(text, f)) for f in DATE_FORMATS[1:]])


def normalise_currency(c: Column) -> Column:
    code = F.trim(F.upper(c))
    known = F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, code), code)


def normalise_vendor(c: Column) -> Column:
    return F.translate(F.trim(F.lower(c)), DIACRITICS, PLAIN)


def normalise_text(c: Column) -> Column:
    """Lower case, one space between words; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def token_scores(predicted: Column, truth: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 on the sets of words, 4 places."""
    words = lambda c: F.array_remove(F.array_distinct(F.split(normalise_text(c), " ")), "")
    p, g = words(predicted), words(truth)
    both, n, m = F.size(F.array_intersect(p, g)), F.size(p), F.size(g)
    precision = F.when(m == 0, F.when(n == 0, 1.0).otherwise(0.0)).when(n == 0, 0.0).otherwise(both / n)
    recall = F.when(m == 0, 1.0).when(n == 0, 0.0).otherwise(both / m)
    f1 = F.when(m == 0, F.when(n == 0, 1.0).otherwise(0.0)).when(both == 0, 0.0).otherwise(2 * both / (n + m))
    return F.round(precision, 4), F.round(recall, 4), F.round(f1, 4)


def markdown_escape(c: Column) -> Column:
    """Backslash before the characters that chat markdown reads."""
    return F.regexp_replace(c, r"([_*`\[])", r"\\$1")
