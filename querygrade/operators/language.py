"""Language profile from labelled text, and the penalty for answers that are not English.

Naive Bayes over whole words with add-one smoothing. The profile grows with the vocabulary, so it is joined
and not sent to all tasks; only the words that make up a fixed share of all text are, and there can be no
more of them than one over that share. These are also the words that would be hot keys of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygrade.functions.text import remove_sql_blocks, strip

#: A word is common if it is one in so many of all words; so there are no more common words than that, and a tenth of
#: it in the texts tried. Common words are sent to every task; each rare word of a text is a row of a shuffle.
COMMON = 200_000
SHORTEST_TEXT = 5


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def language_profile(labelled: DataFrame, text: str, lang: str, languages: list[str]) -> DataFrame:
    """``(word, <language>...)``: how often each distinct word comes up in each language."""
    words = labelled.select(F.col(lang).alias("lang"), F.explode(words_of(F.col(text))).alias("word"))
    counts = [F.count_if(F.col("lang") == name).alias(name) for name in languages]
    return words.groupBy("word").agg(*counts)


def common_word(languages: list[str], everything: float) -> Column:
    """Is a word of the profile common, among so many words in all?"""
    return sum((F.col(name) for name in languages), F.lit(0)) * COMMON > everything


def language_scores(texts: DataFrame, key: str, text: str, profile: DataFrame, languages: list[str]) -> DataFrame:
    """``(key, n_words, <language>...)``: log likelihood with add-one smoothing over the profile's vocabulary.

    One pass over the texts: common words meet a bounded table in every task and are summed up to one row per text
    there; only the rare words go on to a join by word. ``profile`` is read several times: store it first.
    """
    mass = [F.sum(name).cast("double").alias(name) for name in languages]
    totals = profile.agg(F.count(F.lit(1)).cast("double").alias("vocabulary"), *mass).first()  # one row
    everything = sum(totals[name] or 0.0 for name in languages)
    logs = lambda prefix: [F.log(F.col(name) + 1.0).alias(prefix + name) for name in languages]
    is_common = common_word(languages, everything)
    common = profile.where(is_common).select("word", F.lit(True).alias("common"), *logs("common_"))
    rare = profile.where(~is_common).select(F.col("word").alias("rare_word"), *logs("rare_"))
    words = texts.select(key, F.explode_outer(words_of(F.col(text))).alias("word")).join(F.broadcast(common), "word", "left")
    # What is no rare word gets a name of its own per text, which no profile holds, so it is no hot key of the join.
    none = F.concat(F.lit(" "), F.col(key).cast("string"))
    named = F.when(F.col("common").isNull() & F.col("word").isNotNull(), F.col("word")).otherwise(none).alias("rare_word")
    by_word = words.groupBy(key, named).agg(F.count("word").alias("n"), *[F.sum(f"common_{name}").alias(f"common_{name}") for name in languages])
    met = by_word.join(rare, "rare_word", "left")
    value = lambda name: F.coalesce(f"common_{name}", F.col("n") * F.col(f"rare_{name}"), F.lit(0.0))
    sums = met.groupBy(key).agg(F.sum("n").alias("n_words"), *[F.sum(value(name)).alias(name) for name in languages])
    mass_of = {name: F.log(F.lit((totals[name] or 0.0) + totals["vocabulary"])) for name in languages}
    return sums.select(key, "n_words", *[(F.col(name) - F.when(F.col("n_words") > 0, F.col("n_words") * mass_of[name]).otherwise(0.0)).alias(name) for name in languages])


def probability_of(wanted: str, languages: list[str]) -> Column:
    """Softmax share of one language; differences are held below 700 so ``exp`` stays finite."""
    odds = [F.exp(F.least(F.col(name) - F.col(wanted), F.lit(700.0))) for name in languages]
    total = odds[0]
    for odd in odds[1:]:
        total = total + odd
    return 1.0 / total


def foreign_language_penalty(
    answers: DataFrame,
    key: str,
    text: str,
    profile: DataFrame,
    languages: list[str],
    wanted: str = "en",
    threshold: float = 0.9,
) -> DataFrame:
    """``(key, penalty)``: -1 unless the text without SQL blocks is surely in the wanted language.

    Texts that are too short or hold no words get 0.
    """
    short = F.coalesce(F.length(strip(F.col(text))), F.lit(0)) < SHORTEST_TEXT
    prose = answers.select(key, F.when(~short, remove_sql_blocks(F.col(text))).alias("prose"))
    scores = language_scores(prose, key, "prose", profile, languages)
    foreign = (F.col("n_words") > 0) & (probability_of(wanted, languages) < threshold)
    return scores.select(key, F.when(foreign, -1.0).otherwise(0.0).alias("penalty"))
