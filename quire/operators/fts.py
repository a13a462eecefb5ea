"""Term lookup over chunk texts: postings, and term, prefix and phrase matches as joins on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def postings(chunks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(term, *keys, pos): every occurrence of every term, pos from 0."""
    return chunks.select(*keys, F.posexplode(tokens(text)).alias("pos", "term")).select("term", *keys, "pos")


def match_term(index: DataFrame, term: str, keys: list[str]) -> DataFrame:
    """Keys of the texts that hold the term (any case, accents aside), with the number of occurrences."""
    wanted = tokens(F.lit(term))[0]
    return index.where(F.col("term") == wanted).groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))


def match_prefix(index: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    wanted = tokens(F.lit(prefix))[0]
    return index.where(F.startswith("term", wanted)).groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))


def match_phrase(index: DataFrame, phrase: str, keys: list[str]) -> DataFrame:
    """Keys of the texts that hold the phrase's terms one behind the other, with the number of places.

    One pass: an occurrence of the k-th term votes for the place where the phrase would begin.
    """
    terms = index.sparkSession.range(1).select(tokens(F.lit(phrase)).alias("t")).first().t
    numbered = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for k, t in enumerate(terms)))
    votes = index.where(F.col("term").isin(*terms)).select(*keys, "pos", F.explode(F.filter(numbered, lambda x: x["t"] == F.col("term"))).alias("x"))
    starts = votes.groupBy(*keys, (F.col("pos") - F.col("x.k")).alias("start")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms))
    return starts.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))
