"""Token budget of each slice of a corpus, and documents whose stored estimate can't be relied on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunemill.llm.tokens import PIECE_CHARS, VOCABULARY, count_tokens
from tunemill.session import source_name


def language(col: str = "lang"):
    """Lower-cased primary subtag; null and blank stay null."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(col), r"^([A-Za-z]+)", 1)), F.lit(""))


def document_tokens(documents: DataFrame, path: str = VOCABULARY, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(doc_id, source, lang, domain, token_est, n_chars, n_tokens, unreliable) of every document.

    unreliable: at least 200 characters, and token_est null, not positive, over three times or under a third of n_tokens.
    A null text has 0 tokens and is never unreliable.
    """
    rows = documents.select("doc_id", source_name("source").alias("source"), language().alias("lang"), "domain", "token_est", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), "text")
    n = count_tokens(rows, ["doc_id", "source", "lang", "domain", "token_est", "n_chars"], path, piece_chars)
    est, real = F.col("token_est").cast("bigint"), F.col("n_tokens")
    off = est.isNull() | (est <= 0) | (est > 3 * real) | (3 * est < real)
    return n.withColumn("unreliable", (F.col("n_chars") >= 200) & off)


def budget(tokens: DataFrame) -> DataFrame:
    """Documents and tokens by source, language and domain, rolled up: level 3 is a slice, 0 the whole corpus.

    Rows with a null source belong to no source: they count in levels with a null source only as the slice they form.
    """
    return (
        tokens.rollup("source", "lang", "domain")
        .agg((3 - F.bit_count(F.grouping_id())).cast("int").alias("level"), F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.count_if("unreliable").alias("unreliable_docs"))
        .select("level", "source", "lang", "domain", "docs", "tokens", "unreliable_docs")
    )
