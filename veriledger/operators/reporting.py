"""Findings and decisions in a bookkeeper's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledger.functions.numbers import turkish_money
from veriledger.functions.text import markdown_escape

#: Label, meaning and advice for each kind of anomaly of an order match.
ANOMALIES = {
    "WRONG_VENDOR": ("Tedarikçi Uyuşmazlığı", "Faturadaki firma adı veya kimliği siparişle eşleşmiyor.", "Doğru tedarikçiden yeni fatura talep edin ya da sipariş bilgilerini doğrulayın."),
    "PRICE_MISMATCH": ("Fiyat Farkı", "Birim fiyat siparişteki rakamdan farklı.", "Tedarikçiyle fiyat mutabakatı yapın; gerekirse siparişi revize edin."),
    "TOTAL_MISMATCH": ("Toplam Tutar Farkı", "Satır toplamı veya genel toplam siparişteki rakamla uyuşmuyor.", "Kalem fiyat ve miktarlarını kontrol edin; KDV kaynaklı fark olabilir."),
    "QTY_MISMATCH": ("Miktar Uyuşmazlığı", "Faturalanan miktar, sipariş edilen miktarla uyuşmuyor.", "Teslim alınan miktarı ambar kaydıyla karşılaştırın, farkı tedarikçiye bildirin."),
    "DESC_MISMATCH": ("Kalem Açıklaması Farklı", "Eşleşen kalemin açıklaması faturada ve siparişte belirgin biçimde farklı.", "Kalemin doğru ürün/hizmet olduğunu tedarikçiyle teyit edin."),
    "DATE_ANOMALY": ("Tarih Sorunu", "Fatura tarihi sipariş tarihiyle mantıksal olarak çelişiyor.", "Fatura tarihini ve sipariş tarihini belgeleri üzerinden doğrulayın."),
    "CURRENCY_MISMATCH": ("Para Birimi Farklı", "Faturadaki para birimi siparişteki para birimiyle uyuşmuyor.", "Sözleşmedeki para birimini ve faturayı karşılaştırın."),
    "NOT_IN_PO": ("Siparişsiz Kalem", "Faturada sipariş dışında ek kalem bulunuyor.", "Siparişe ek kalem ekleyin ya da tedarikçiden düzeltilmiş fatura isteyin."),
    "MISSING_ITEM": ("Eksik Kalem", "Siparişteki bazı kalemler faturada yer almıyor.", "Tedarikçiden eksik kalemleri içeren revize fatura isteyin."),
    "TAX_RATE_MISMATCH": ("KDV Oranı Farkı", "Faturadaki vergi oranı beklenen orandan farklı.", "Muhasebe departmanınızla vergi oranını doğrulayın."),
    "UOM_MISMATCH": ("Ölçü Birimi Farklı", "Faturada kullanılan ölçü birimi sipariştekiyle uyuşmuyor.", "Birim dönüşümünü kontrol edin veya tedarikçiyle teyit edin."),
    "OTHER": ("Diğer Uyuşmazlık", "Fatura ile sipariş arasında bir fark tespit edildi.", "Muhasebe departmanınızla görüşün."),
}
#: Signs of levels, and what a line on one side only is called.
ICONS = {"HIGH": "🔴", "MEDIUM": "🟡"}
LONE = {"_extra_invoice_line": "Faturada siparişte olmayan kalem", "_missing_po_line": "Siparişte olup faturada olmayan kalem"}
#: The anomaly each field of an order match leads to.
FIELD_ANOMALY = {"quantity": "QTY_MISMATCH", "unit_price": "PRICE_MISMATCH", "total": "TOTAL_MISMATCH", "description": "DESC_MISMATCH", "total_amount": "TOTAL_MISMATCH", "currency": "CURRENCY_MISMATCH", "supplier_vendor": "WRONG_VENDOR", "_extra_invoice_line": "NOT_IN_PO", "_missing_po_line": "MISSING_ITEM"}
#: Sign, title, subtitle, colour and advice by the status of an order match.
MATCH_VERDICTS = {
    "APPROVE": ("✅", "ÖDEMEYİ ONAYLAYABİLİRSİNİZ", "Fatura ve sipariş kayıtlarıyla tam uyuşuyor.", "#22c55e", "Ödemeyi onaylayabilirsiniz."),
    "REVIEW": ("⚠️", "İNCELEME GEREKLİ", "Dikkat gerektiren noktalar tespit edildi.", "#f59e0b", "Belirtilen sorunları gözden geçirin, ardından onaylayın veya reddedin."),
    "REJECT": ("🚫", "ÖDEME DURDURULDU", "Kritik sorun tespit edildi — acil inceleme gerekli.", "#ef4444", "Sorunlar çözülene kadar ödeme yapmayın."),
}
#: Signs, headlines and subtitles of decisions.
SIGNS = {"PAY": "✅", "HOLD": "🚫", "REVIEW": "⚠️"}
TITLES = {"PAY": "KONTROLLERDEN GEÇTİ", "HOLD": "ÖDEMEYİ BEKLETİN", "REVIEW": "İNCELEME GEREKLİ"}
SUBTITLES = {"PAY": "Ödemeyi durduracak bir bulgu çıkmadı. Ödeme kararı sizde.", "HOLD": "Ödeme öncesi durdurulması gereken bir bulgu var.", "REVIEW": "Tedarikçiye yüklenemeyecek bir sorun var; bir kişi bakmalı."}
HOLD_SUBTITLES = {"POSSIBLE_DUPLICATE": "Bu belge daha önce işlenmiş olabilir.", "PRICE_MISMATCH": "Fatura, siparişte anlaşılandan fazlasını istiyor.", "QTY_MISMATCH": "Faturalanan miktar siparişle uyuşmuyor.", "NOT_IN_PO": "Faturada siparişte olmayan kalem var."}
#: Label and advice for each kind of finding.
KINDS = {
    "PRICE_MISMATCH": ("Fiyat Farkı", "Tedarikçiyle fiyat mutabakatı yapın."),
    "QTY_MISMATCH": ("Miktar Uyuşmazlığı", "Teslim alınan miktarı irsaliyeyle karşılaştırın."),
    "LINE_TOTAL_MISMATCH": ("Satır Toplamı Tutmuyor", "Miktar, birim fiyat ve iskontoyu kontrol edin."),
    "TOTAL_MISMATCH": ("Genel Toplam Tutmuyor", "Ara toplam, vergi ve toplamı belge üzerinden doğrulayın."),
    "SUBTOTAL_MISMATCH": ("Ara Toplam Tutmuyor", "Kalem toplamlarını ara toplamla karşılaştırın."),
    "TAX_ID_INVALID": ("Vergi Numarası Geçersiz", "Numarayı belge üzerinden bir kişi doğrulasın; kontrol hanesi tutmuyor."),
    "TAX_ID_MALFORMED": ("Vergi Numarası Bozuk", "Numaranın yanına etiket karışmış; düzeltin."),
    "SELLER_TAX_ID_MISSING": ("Satıcı Vergi No Okunamadı", "e-Arşiv faturasında zorunludur; belgeden alın."),
    "FIELD_MISSING": ("Zorunlu Alan Eksik", "Belgeyi elle tamamlayın."),
    "NOT_IN_PO": ("Siparişsiz Kalem", "Siparişe ekleyin ya da düzeltilmiş fatura isteyin."),
    "MISSING_ITEM": ("Eksik Kalem", "Tedarikçiden revize fatura isteyin."),
    "CURRENCY_MISMATCH": ("Para Birimi Farklı", "Sözleşmedeki para birimini doğrulayın."),
    "DESC_MISMATCH": ("Kalem Açıklaması Farklı", "Kalemin doğru ürün olduğunu teyit edin."),
    "EXTRACTION_FAILED": ("Belge Okunamadı", "Belgeyi yeniden tarayın veya fotoğrafı tekrar çekin."),
    "POSSIBLE_DUPLICATE": ("Mükerrer Olabilir", "Ödemeden önce eski kaydı açın; aynı belge ise bu kaydı iptal edin."),
}
#: Sentences of the texts.
OVERCHARGED, INTERNAL, BLIND = "Fazla faturalanan tutar: ", "Belge içi tutarsızlık: ", "Denetlenemeyen alanlar "
INTERNAL_NOTE = "(Bu tedarikçinin fazla istediği para değil — belgenin kendi sayıları kapanmıyor. Yanlış faturalama da olabilir, bizim yanlış okumamız da.)"
BLIND_NOTE = "Bu alanları karşılaştıracak ikinci bir kaynak yok; doğruluklarına dair bir iddiada bulunulmuyor."
FOUND, TO_DO, SHORTENED = "⚠️ *Tespit Edilen Sorunlar*", "💡 *Yapmanız Gereken*", "\n\n_\\.\\.\\. mesaj kısaltıldı_"
#: Kinds whose values are amounts in kuruş.
AMOUNT_KINDS = ("PRICE_MISMATCH", "LINE_TOTAL_MISMATCH", "TOTAL_MISMATCH", "SUBTOTAL_MISMATCH")
TOP, RAW, LONGEST = 6, 100, 4000


def named(names: dict[str, str], key: Column, other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key), other)


def match_problems(problems: DataFrame) -> DataFrame:
    """doc_id, ord, field, severity and, if there is one, message to anomaly code, level with its
    sign, label, detail, raw_desc (the message) and advice."""
    code = named(FIELD_ANOMALY, F.col("field"), F.lit("OTHER"))
    text = lambda i: named({k: v[i] for k, v in ANOMALIES.items()}, F.col("code"), F.lit(ANOMALIES["OTHER"][i]))
    level = F.when(F.col("severity") == "critical", "HIGH").otherwise("MEDIUM")
    raw = F.coalesce("message", F.lit("")) if "message" in problems.columns else F.lit("")
    return problems.withColumn("code", code).withColumn("level", level).select("doc_id", "ord", "code", "level", named(ICONS, F.col("level"), F.lit("")).alias("icon"), text(0).alias("label"), text(1).alias("detail"), raw.alias("raw_desc"), text(2).alias("action"))


def lone_line(field: Column, description: Column) -> Column:
    """What is said of a line that only one side has; no colon without a description."""
    text = F.trim(F.coalesce(description, F.lit("")))
    return F.concat(named(LONE, field, F.lit("")), F.when(text != "", F.concat(F.lit(": "), text)).otherwise(""))


def match_verdict(summary: DataFrame) -> DataFrame:
    """doc_id, icon, title, subtitle, color, action by overall_status; unknown ones are to be reviewed."""
    of = lambda i: named({k: v[i] for k, v in MATCH_VERDICTS.items()}, F.col("overall_status"), F.lit(MATCH_VERDICTS["REVIEW"][i]))
    return summary.select("doc_id", *[of(i).alias(c) for i, c in enumerate(("icon", "title", "subtitle", "color", "action"))])


def ordered_problems(findings: DataFrame) -> DataFrame:
    """findings (with is_financial) with place: money first, priced first, larger first, severe
    first, then by ord."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "info", 2).otherwise(3)
    order = Window.partitionBy("doc_id").orderBy(~F.col("is_financial"), F.col("amount_k").isNull(), -F.abs(F.coalesce("amount_k", F.lit(0))), rank, "ord")
    return findings.withColumn("place", F.row_number().over(order))


def _money(kurus: Column) -> Column:
    """Text of an amount, null for none and for 0."""
    return F.when(kurus != 0, turkish_money(kurus / F.lit(100.0)))


def finding_text() -> Column:
    """A finding's lines: label and amount, the two values, the message where they don't say it all,
    and the advice."""
    duplicate, both = F.col("kind") == "POSSIBLE_DUPLICATE", F.col("expected").isNotNull() & F.col("actual").isNotNull()
    of = lambda i, other: named({k: v[i] for k, v in KINDS.items()}, F.col("kind"), other)
    head = F.concat(F.lit("• "), of(0, F.col("kind")), F.coalesce(F.concat(F.lit("  ("), _money(F.col("amount_k")), F.lit(")")), F.lit("")))
    before, now = (F.when(duplicate, d).otherwise(o) for d, o in (("    Önceki: ", "    Beklenen: "), ("    Bu belge: ", "    Faturada: ")))
    shown = lambda c: F.when(F.col("kind").isin(*AMOUNT_KINDS), turkish_money(F.col(c).try_cast("long") / F.lit(100.0))).otherwise(F.col(c))
    values = F.when(both, F.concat(before, shown("expected"), now, shown("actual")))
    said = F.when((F.col("message") != "") & (duplicate | ~both), F.concat(F.lit("    "), "message"))
    return F.concat_ws("\n", head, values, said, F.concat(F.lit("    → "), of(1, F.lit(None).cast("string"))))


def decision_texts(decisions: DataFrame, findings: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """doc_id, title, subtitle, impact, internal, text: the headline names a hold's first critical
    cause, the money comes next, then the findings with what to do, and the fields that nothing
    could be checked against (blind, in coverage)."""
    critical = (F.col("severity") == "critical") & F.col("kind").isin(*HOLD_SUBTITLES)
    lines = ordered_problems(findings).groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", finding_text().alias("t")))), lambda x: x["t"]).alias("lines"),
        F.min_by(F.when(critical, F.col("kind")), F.when(critical, F.col("ord"))).alias("cause"),
    )
    out = decisions.join(lines, "doc_id", "left")
    out = out.withColumn("blind", F.array().cast("array<string>")) if coverage is None else out.join(coverage.select("doc_id", "blind"), "doc_id", "left")
    title, plain = (named(x, F.col("verdict"), F.lit(x["REVIEW"])) for x in (TITLES, SUBTITLES))
    subtitle = F.when(F.col("verdict") == "HOLD", named(HOLD_SUBTITLES, F.col("cause"), plain)).otherwise(plain)
    impact, internal = _money(F.col("financial_k")), _money(F.col("internal_k"))
    said = F.concat(F.concat_ws(" ", named(SIGNS, F.col("verdict"), F.lit(SIGNS["REVIEW"])), title), F.lit("\n"), subtitle)
    unseen = F.when(F.size("blind") > 0, F.concat(F.lit(BLIND + "("), F.size("blind").cast("string"), F.lit("): "), F.array_join("blind", ", "), F.lit("\n" + BLIND_NOTE)))
    text = F.concat_ws("\n\n", said, F.concat(F.lit(OVERCHARGED), impact), F.concat(F.lit(INTERNAL), internal, F.lit("\n" + INTERNAL_NOTE)), "lines", unseen)
    return out.select("doc_id", title.alias("title"), subtitle.alias("subtitle"), impact.alias("impact"), internal.alias("internal"), text.alias("text"))


def top_problems(problems: DataFrame) -> DataFrame:
    """The six most severe problems of each document, with n, their place; of equal ones the first."""
    level = F.when(F.col("level") == "HIGH", 0).when(F.col("level") == "MEDIUM", 1).otherwise(2)
    return problems.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(level, "ord"))).where(F.col("n") <= TOP)


def chat_message(verdicts: DataFrame, problems: DataFrame) -> DataFrame:
    """doc_id, message of every verdict: headline, its most severe problems and what to do, escaped
    for chat markdown and cut to what a message may hold."""
    said = F.when(F.col("raw_desc") != "", F.concat(F.lit("   _"), markdown_escape(F.substring("raw_desc", 1, RAW)), F.lit("_")))
    one = F.concat_ws("\n", F.concat("icon", F.lit(" *"), markdown_escape(F.col("label")), F.lit("*")), said, F.concat(F.lit("   → "), markdown_escape(F.col("action"))))
    listed = top_problems(problems).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("t")))), lambda x: x["t"]), "\n\n").alias("listed"))
    out = verdicts.join(listed, "doc_id", "left")
    head = F.concat("icon", F.lit(" *"), markdown_escape(F.col("title")), F.lit("*\n_"), markdown_escape(F.col("subtitle")), F.lit("_"))
    text = F.concat_ws("\n\n", head, F.concat(F.lit(FOUND + "\n"), "listed"), F.concat(F.lit(TO_DO + "\n"), markdown_escape(F.col("action"))))
    out = out.select("doc_id", F.concat(text, F.lit("\n")).alias("message"))
    return out.withColumn("message", F.when(F.length("message") > LONGEST, F.concat(F.substring("message", 1, LONGEST - 50), F.lit(SHORTENED))).otherwise(F.col("message")))


def as_json(rows: DataFrame) -> DataFrame:
    """doc_id and the row as JSON text."""
    return rows.select("doc_id", F.to_json(F.struct(*[c for c in rows.columns if c != "doc_id"])).alias("json"))
