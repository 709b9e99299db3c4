from pyspark.sql import functions as F

from veriledger import functions as fn


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in rows], schema).select(column).collect()]


def test_tax_numbers_and_every_changed_digit(spark):
    good = ["1234567890", "0012345672", "9876543217"]
    assert values(spark, fn.is_valid_vkn(F.col("x")), good) == [True] * 3
    changed = [n[:i] + d + n[i + 1 :] for n in good[:1] for i in range(10) for d in "0123456789" if d != n[i]]
    assert not any(values(spark, fn.is_valid_vkn(F.col("x")), changed + ["1234576890", "1111111111", None, "12"]))
    person = "12345678950"
    assert values(spark, fn.is_valid_tckn(F.col("x")), [person]) == [True]
    changed = [person[:i] + d + person[i + 1 :] for i in range(11) for d in "0123456789" if d != person[i]]
    assert not any(values(spark, fn.is_valid_tckn(F.col("x")), [*changed, "10000000000"]))


def test_tax_number_kinds(spark):
    got = values(spark, fn.classify_tax_id(F.col("x")), ["123 456.789-0", "Vergi No 1234567890", "DE123456789", "701236788", "abc"])
    assert [(g["kind"], g["normalized"], g["valid"]) for g in got] == [("vkn", "1234567890", True), ("label_captured", "1234567890", None), ("not_numeric", None, None), ("unknown_length", "701236788", None), ("not_numeric", None, None)]


def test_names_numbers_and_keys(spark):
    assert len(set(values(spark, fn.normalise_name(F.col("x")), ["TTNET ANONİM ŞİRKETİ", "TTNET A.Ş.", "Ttnet"]))) == 1
    assert values(spark, fn.normalise_name(F.col("x")), ["SARITEKELİ MARKET", None]) == ["sarıtekeli market", ""]
    assert values(spark, fn.normalise_doc_number(F.col("x")), [" gib-2026/000012345 ", "GIB2026000012345"]) == ["gib2026000012345"] * 2
    assert values(spark, fn.number_core(F.col("x")), ["GIB-12345", "0007"]) == ["12345", "7"]
    assert values(spark, fn.normalise_currency(F.col("x")), [" tl ", "€", "CHF"]) == ["TRY", "EUR", "CHF"]


def test_dates_and_numbers(spark):
    got = values(spark, fn.as_date(F.col("x")).cast("string"), ["2026-08-15", "15.08.2026", "15/08/2026", "15-8-2026", "geçen ay", None, "2026-02-30"])
    assert got == ["2026-08-15"] * 4 + [None] * 3
    assert values(spark, fn.to_number(F.col("x")), ["1,234.50", "1 000", "12d", "abc", None]) == [1234.5, 1000.0, None, None, None]
    assert values(spark, fn.cents(F.col("x")), [42000.0, 0.1 + 0.2, -1.005, 2.675], "x double") == [4200000, 30, -100, 268]
    assert values(spark, fn.turkish_money(F.col("x")), [1234.56, -0.5], "x double") == ["1.234,56 TL", "-0,50 TL"]


def test_model_responses(spark):
    rows = ['{"a": 1}', 'x ```json\n{"a": 1}\n``` y', "```\n{\"a\": 1}\n```", 'so {"a": 1} it is', "nope", None]
    got = values(spark, F.to_json(fn.parse_json_response(F.col("x"))), rows)
    assert got == ['{"a":1}'] * 4 + [None, None]
    assert values(spark, fn.strip_stray_escapes(F.col("x")), ['a \\"b\\"']) == ['a "b"']


def test_similarity_is_ratcliff_obershelp(spark):
    got = values(spark, fn.text_similarity(F.col("x"), F.col("y")), [("tide", "diet"), ("diet", "tide"), ("a", "a"), (None, "a")], "x string, y string")
    assert got == [0.25, 0.5, 1.0, None]
