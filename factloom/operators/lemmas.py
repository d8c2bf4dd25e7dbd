"""Base forms of words by suffix rules, learned from a table of words with their lemmas; phrases brought to the nominative singular of their head.

A pair of word and lemma gives the change behind their common beginning: so many
letters go, these come. It is counted under every ending of the word that the
change lies in, up to CONTEXT letters more than it, and of an ending the most
frequent change is its rule. A word that the table holds has the table's lemma;
another one the change of the longest ending that has a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters before a change that a rule may look at, and the longest ending of all.
CONTEXT, LONGEST = 4, 12
#: Words of a phrase up to which it is brought to a base form.
PHRASE_WORDS = 6
RULES = "ending string, tag string, gender string, cut int, add string"

# Fixed value: the gender of an adjective's base form where its noun's is unknown.
_GENDER = "masc"


def common_beginning(a: Column, b: Column) -> Column:
    """How many first letters two words share."""
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), lambda k: (F.substr(a, F.lit(1), k) == F.substr(b, F.lit(1), k)) & (F.length(a) >= k) & (F.length(b) >= k)))


def learn(pairs: DataFrame) -> DataFrame:
    """RULES of pairs: word, lemma and, where it is known, tag (NOUN, ADJF, PRTF or others) and gender of the word or, for adjectives, of the lemma.

    An adjective has a pair for each gender that its lemma can take. Of equally frequent changes the shortest cut is taken,
    then the least addition.
    """
    known = pairs.select(F.lower("word").alias("word"), F.lower("lemma").alias("lemma"), *[(F.col(c) if c in pairs.columns else F.lit(None).cast("string")).alias(c) for c in ("tag", "gender")]).where("word != '' AND lemma != ''")
    shared = known.withColumn("shared", common_beginning(F.col("word"), F.col("lemma")))
    cut = (F.length("word") - F.col("shared")).alias("cut")
    change = shared.select("word", cut, F.substr("lemma", F.col("shared") + 1, F.length("lemma")).alias("add"), "tag", "gender")
    lengths = F.sequence(F.greatest(F.col("cut"), F.lit(1)), F.least(F.length("word"), F.col("cut") + CONTEXT, F.lit(LONGEST)))
    endings = change.where(F.col("cut") <= F.least(F.length("word"), F.lit(LONGEST))).withColumn("n", F.explode(lengths)).withColumn("ending", F.expr("right(word, n)"))
    counted = endings.groupBy("ending", "tag", "gender", "cut", "add").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("cut", "add"), F.struct("n", -F.col("cut"), F.col("add")))
    # The tag of an ending that several have is decided by its words, too; genders of an adjective are rules of their own.
    tags = counted.groupBy("ending", "tag").agg(F.sum("n").alias("n")).groupBy("ending").agg(F.max_by("tag", F.struct("n", "tag")).alias("best_tag"))
    ruled = counted.groupBy("ending", "tag", "gender").agg(best.alias("rule"))
    kept = ruled.join(tags, "ending").where(F.col("tag").eqNullSafe(F.col("best_tag")))
    return kept.select("ending", "tag", "gender", F.col("rule.cut").cast("int").alias("cut"), F.col("rule.add").alias("add"))


def lemmas(words: DataFrame, rules: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """word, tag, gender, lemma of each distinct word of words: known (as learn takes it) first, then by the longest ending with a rule; without any the word itself.

    Several rows for a word whose ending has rules for several genders. All words and rules meet in joins by whole endings.
    """
    asked = words.select(F.lower("word").alias("word")).where("word != ''").distinct()
    endings = asked.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(LONGEST))))).withColumn("ending", F.expr("right(word, n)"))
    met = endings.join(rules, "ending").where(F.col("cut") <= F.length("word"))
    longest = met.groupBy("word").agg(F.max("n").alias("longest"))
    ruled = met.join(longest, "word").where("n = longest").select("word", "tag", "gender", F.concat(F.expr("left(word, length(word) - cut)"), "add").alias("lemma"))
    if known is not None:
        columns = [(F.col(c) if c in known.columns else F.lit(None).cast("string")).alias(c) for c in ("tag", "gender")]
        table = known.select(F.lower("word").alias("word"), *columns, F.lower("lemma").alias("lemma")).distinct()
        ruled = table.join(asked, "word", "left_semi").unionByName(ruled.join(table.select("word").distinct(), "word", "left_anti"))
    return asked.join(ruled, "word", "left").withColumn("lemma", F.coalesce("lemma", "word"))


def base_phrases(phrases: DataFrame, parsed: DataFrame) -> DataFrame:
    """Adds base to phrases (phrase_id, name): the head noun as its lemma, and the adjectives and participles before it as theirs, in its gender.

    The head is the first word that is a noun; what stands behind it, such as a genitive, stays. So do abbreviations and
    words with digits, Latin letters or signs; a phrase without a noun or of over PHRASE_WORDS words is left as it is.
    parsed: word, tag, gender, lemma, as `lemmas` gives it.
    """
    split = F.filter(F.split(F.trim("name"), r"\s+"), lambda w: w != "")
    words = phrases.select("phrase_id", F.posexplode(split).alias("k", "token")).withColumn("word", F.lower("token"))
    plain = F.col("word").rlike("^[а-яё]+$") & ~((F.upper("token") == F.col("token")) & F.length("token").between(2, 6))
    forms = parsed.groupBy("word").agg(F.max_by("tag", F.struct("tag")).alias("tag"), F.max("gender").alias("own_gender"), F.min("lemma").alias("any_lemma"), F.map_from_entries(F.collect_set(F.when(F.col("gender").isNotNull(), F.struct("gender", "lemma")))).alias("by_gender"))
    read = words.join(forms, "word", "left").withColumn("tag", F.when(plain, F.col("tag")))
    noun = F.when(F.col("tag") == "NOUN", F.struct("k", "own_gender", "any_lemma"))
    heads = read.groupBy("phrase_id").agg(F.min(noun).alias("head"), F.count("*").alias("n_words")).where(F.col("head").isNotNull() & (F.col("n_words") <= PHRASE_WORDS))
    agreeing = F.col("tag").isin("ADJF", "PRTF") & (F.col("k") < F.col("head.k"))
    form = F.when(F.col("k") == F.col("head.k"), F.col("head.any_lemma")).when(agreeing, F.coalesce(F.try_element_at("by_gender", F.col("head.own_gender")), F.try_element_at("by_gender", F.lit(_GENDER)), F.col("any_lemma"))).otherwise(F.col("token"))
    rebuilt = read.join(heads, "phrase_id").groupBy("phrase_id").agg(F.array_sort(F.collect_list(F.struct("k", form.alias("form")))).alias("forms"))
    base = rebuilt.select("phrase_id", F.array_join(F.transform("forms", lambda x: x["form"]), " ").alias("base"))
    return phrases.join(base, "phrase_id", "left").withColumn("base", F.coalesce("base", "name"))
