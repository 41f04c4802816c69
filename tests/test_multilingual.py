"""Requests in seven languages: the columns say what the driver's form says, and the parser understands it."""

from pyspark.sql import functions as F

from tessera.language import multilingual, requests

TEXTS = {
    "生成5万个银行客户，2％欺诈，12个月的历史": ("zh", "generate 50000 bank customers, 2% fraud, 12 months history"),
    "1.25百万客户": ("zh", "1250000 customers"),
    "१.५ लाख बैंक ग्राहक बनाओ": ("hi", "150000 bank customers generate"),
    "ग्राहकोंका ७ महीने": ("hi", "ग्राहकोंका 7 months"),  # a longer word is none of the known ones
    "۵ ہزار بینک صارفین، ۲٪ دھوکہ دہی": ("ur", "5000 bank customers, 2% fraud"),
    "أنشئ ٥٠ ألف عملاء بنك مع ٢٪ احتيال": ("ar", "generate 50000 customers bank with 2% fraud"),
    "2 mil clientes de banco en España": ("es", "2 thousand customers of bank in spain"),
    "300 clients avec fraude": ("fr", "300 customers with fraud"),
    "kundenbetrug mit 3 kunden": ("de", "kundenbetrug with 3 customers"),
    "50k customers, 12 months": ("en", "50k customers, 12 months"),
    "": ("en", ""),
}


def test_columns_and_driver_agree(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    found = {r.t: (r.lang, r.text) for r in df.select("t", multilingual.language(F.col("t")).alias("lang"), multilingual.english(F.col("t")).alias("text")).collect()}
    assert found.pop(None) == (None, None)
    for text, (lang, english) in TEXTS.items():
        assert (multilingual.language_of(text), multilingual.canonical(text)) == (lang, english)
        if text != "1.25百万客户":
            assert found[text] == (lang, english), text
    assert found["1.25百万客户"] == ("zh", "1250000 customers")


def test_requests_are_understood():
    config = requests.parse("生成5万个银行客户，2％欺诈，12个月的历史").config
    assert (config.rows, config.domain, config.flag_rate, config.months) == (50_000, "bank", 0.02, 12)
    assert requests.parse("۵ ہزار بینک صارفین، ۲٪ دھوکہ دہی").config.rows == 5_000
