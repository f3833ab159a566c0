"""SQL names for what built-in expressions cannot say: registered in a session, then used from any statement."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from listloom.session import ship


def _decoded(text: str | None) -> str | None:
    return None if text is None else html.unescape(text)


def _folded(text: str | None) -> str | None:
    """Entities decoded, marks stripped, lower case; everything but a-z and digits becomes single blanks."""
    if text is None:
        return None
    plain = unicodedata.normalize("NFD", html.unescape(text).lower())
    return re.sub("[^a-z0-9]+", " ", "".join(c for c in plain if not unicodedata.combining(c))).strip()


_CARD = re.compile(r'<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', re.S)


class MailCards:
    """mail_cards(html): (url, text) of each anchor that names a price, in their order."""

    def eval(self, page: str | None):
        for url, inner in _CARD.findall(page or ""):
            text = " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())
            if re.search(r"\d ?(€|eur)", text):
                yield url, text


def register(spark: SparkSession) -> None:
    """``decode_entities`` and ``fold_text`` (over Arrow batches), and the table function ``mail_cards``."""
    ship(spark)

    @F.pandas_udf("string")
    def decode_entities(texts: pd.Series) -> pd.Series:
        return texts.map(_decoded)

    @F.pandas_udf("string")
    def fold_text(texts: pd.Series) -> pd.Series:
        return texts.map(_folded)

    spark.udf.register("decode_entities", decode_entities)
    spark.udf.register("fold_text", fold_text)
    spark.udtf.register("mail_cards", F.udtf(MailCards, returnType="url string, text string"))
