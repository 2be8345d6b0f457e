"""Cleaning of raw entries: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def clean_records(raw: DataFrame, carry: tuple[str, ...] = (), *, plain: bool = False) -> DataFrame:
    """The twelve cleaned fields of raw entries, null where a field is absent; comments is empty instead. Of other columns only carry stays.

    White space is cleaned first, once for each text, as fields are made from one text many times; not where plain says
    that it is clean already and no text is null. All texts go through one expression: with one for each, the code that Spark makes for a row is
    a method too large for the JVM to compile, and takes twice the time.
    """
    texts = ("school", "program", "added_on", "decision", "meta", "comment", "url")
    raws = [F.col("url" if c == "url" else f"raw_{c}_text").cast("string") for c in texts]
    if plain:
        plain_texts = raw.select(*(x.alias(c) for c, x in zip(texts, raws)), *carry)
    else:
        each = raw.select(F.transform(F.array(*raws), T.clean_text).alias("_texts"), *carry)
        plain_texts = each.select(*(F.get("_texts", F.lit(k)).alias(c) for k, c in enumerate(texts)), *carry)
    meta = F.col("meta")
    fields = {
        "program": T.compose_program(T.program_without_degree(F.col("program")), F.col("school")),
        "comments": T.free_comment(F.col("comment")),
        "date_added": T.with_added_on(F.col("added_on")),
        "url": F.col("url"),
        "status": F.col("decision"),
        "term": T.term(meta),
        "US/International": T.student_type(meta),
        "GRE": T.labelled_number(meta, T.GRE, "GRE"),
        "GRE V": T.labelled_number(meta, T.GRE_V, "GRE V"),
        "GRE AW": T.labelled_number(meta, T.GRE_AW, "GRE AW"),
        "GPA": T.labelled_number(meta, T.GPA, "GPA"),
        "Degree": T.degree_token(F.col("program")),
    }
    return plain_texts.select(*((c if k == "comments" else T.none_if_empty(c)).alias(k) for k, c in fields.items()), *carry)
