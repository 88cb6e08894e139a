"""The wizard: answers to a query, to results and to a sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import values as V
from shelfspark.functions.text import lookup, strings, truthy

from .recommend import first_results


def to_queries(answers: DataFrame) -> DataFrame:
    """answers: qid, age, format, feeling, interest, time, interaction. The query of each, with defaults for what is missing."""
    moods = {k: v for k, v in V.FEELING_MOODS.items()}
    mood = F.coalesce(F.element_at(F.create_map(*[x for k, v in moods.items() for x in (F.lit(k), strings(v))]), F.col("feeling")), strings([]))
    learn = F.when(F.col("feeling") == "learn", V.LEARN_INTEREST)
    together = F.col("interaction")
    return answers.select(
        "qid",
        F.coalesce("age", F.lit(V.WIZARD_AGE)).cast("double").alias("age"),
        F.coalesce("format", F.lit("all")).alias("format"),
        truthy(F.array(F.col("interest"), learn)).alias("interests"),
        mood.alias("moods"),
        F.when(together == "self", "independent").when(together.isin("family", "adult"), "family").alias("situation"),
        lookup(V.TIME_DURATIONS, F.coalesce("time", F.lit(""))).alias("duration"),
        F.lit("").alias("search"),
    )


def results(items: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """The first six results of each set of answers, one for each key."""
    return first_results(items, to_queries(answers), V.WIZARD_LIMIT, key)


def explanation(answers: DataFrame) -> DataFrame:
    """qid and the sentences over the results."""
    form = F.when(F.col("format") == "reading", "историю для чтения").when(F.col("format") == "cartoon", "мультфильм").when(F.col("format") == "movie", "фильм").otherwise("книгу, мультфильм или фильм")
    mood = F.when(F.col("feeling") == "anxious", "спокойный и уютный").when(F.col("feeling") == "laugh", "смешной").when(F.col("feeling") == "learn", "познавательный").otherwise("подходящий по настроению")
    way = F.when(F.col("interaction") == "self", "для самостоятельного знакомства").otherwise("для совместного времени")
    return answers.select("qid", F.concat(F.lit("Сейчас лучше выбрать "), mood, F.lit(" "), form, F.lit(" "), way, F.lit(f". {V.WIZARD_NOTE}")).alias("sentence"))
