"""Column functions: names, numbers, dates, tax numbers, JSON text, similarity."""

from veriledger.functions.jsontext import parse_json_response, strip_stray_escapes
from veriledger.functions.numbers import cents, days_between, is_numeric, money, numeric_close, to_number, turkish_money
from veriledger.functions.similarity import text_similarity
from veriledger.functions.taxid import classify_tax_id, is_valid_tckn, is_valid_vkn, normalize_tax_id
from veriledger.functions.text import as_date, identity_key, markdown_escape, normalise_doc_number, normalise_name, normalise_text, normalise_vendor, normalise_currency, number_core, supplier_key, token_scores

__all__ = [
    "as_date", "cents", "classify_tax_id", "days_between", "identity_key", "is_numeric", "is_valid_tckn", "is_valid_vkn", "markdown_escape", "money", "normalise_currency", "normalise_doc_number", "normalise_name", "normalise_text", "normalise_vendor",
    "normalize_tax_id", "number_core", "numeric_close", "parse_json_response", "strip_stray_escapes", "supplier_key", "text_similarity", "to_number", "token_scores", "turkish_money",
]
