"""Joins of payments with registers: siblings, tokens, phone suffixes, amounts, fuzzy names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.similarity import jaro_winkler
from tallyspark.functions.text import digit_runs, tokens
from tallyspark.operators.skew import join_summaries
from tallyspark.session import cut, cut_table

#: Weights, similarity and length of the candidate list.
STRONG, MEDIUM, ALIKE, TOP = 10, 5, 0.88, 5


def sibling_counts(links: DataFrame) -> DataFrame:
    """(student_id, siblings): how many other students share a guardian. Students with the same guardians are one class with a
    number; only different classes that share a guardian meet, each pair once, so a guardian of very many students makes as
    many pairs as there are different sets of guardians around, not students."""
    sets = links.where("student_id is not null and guardian_id is not null").groupBy("student_id").agg(F.sort_array(F.collect_set("guardian_id")).alias("s")).withColumn("class", F.md5(F.to_json("s")))
    sets = cut_table(sets)
    classes = cut(sets.groupBy("class").agg(F.first("s").alias("s"), F.count("*").alias("_n")))
    each = classes.select("class", "_n", F.explode("s").alias("g"))
    pairs = each.select("class", "g").join(each.select(F.col("class").alias("other"), F.col("_n").alias("k"), "g"), "g").select("class", "other", "k").distinct()
    totals = pairs.groupBy("class").agg((F.sum("k") - 1).alias("siblings")).where("siblings > 0")
    summed = cut(totals.join(classes.select("class", "_n"), "class"))
    return join_summaries(sets.select("student_id", "class"), summed, ["class"], "_n").select("student_id", "siblings")


def token_overlap(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, name_id, common): how many distinct tokens a text shares with a name; by an equi-join on
    tokens. texts: (text_id, text); names: (name_id, name)."""
    left = texts.select("text_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    right = names.select("name_id", F.explode(F.array_distinct(tokens(F.col("name")))).alias("token"))
    return left.join(right, "token").groupBy("text_id", "name_id").agg(F.count("*").alias("common"))


def phone_matches(texts: DataFrame, phones: DataFrame) -> DataFrame:
    """(text_id, phone_id): a run of at least three digits of the text ends with the suffix. One equi-join on the
    runs' endings of the lengths that occur. texts: (text_id, text); phones: (phone_id, suffix)."""
    usable = phones.where("suffix is not null and suffix <> ''").select("phone_id", "suffix", F.length("suffix").alias("n"))
    lengths = [r.n for r in usable.select("n").distinct().orderBy("n").collect()]  # lengths, not suffixes: as many as the longest at most
    if not lengths:
        return texts.limit(0).select("text_id").crossJoin(phones.limit(0).select("phone_id"))
    runs = texts.select("text_id", F.explode(digit_runs(F.col("text"))).alias("run"))
    ends = runs.select("text_id", F.explode(F.array(*(F.when(F.length("run") >= n, F.right("run", F.lit(n))) for n in lengths))).alias("suffix"))
    return ends.where("suffix is not null").join(usable.select("phone_id", "suffix"), "suffix").select("text_id", "phone_id").distinct()


def amount_matches(payments: DataFrame, balances: DataFrame) -> DataFrame:
    """(payment_id, matching): how many accounts have exactly the payment's amount open. Accounts are counted per
    amount first, so that an amount many share does not multiply the rows."""
    counts = balances.where("balance > 0").groupBy(F.col("balance").alias("amount")).agg(F.countDistinct("account").alias("matching"))
    return payments.join(counts, "amount").select("payment_id", "matching")


def _letters(text: str) -> Column:
    """A bit per letter a to z that occurs; one bit for all other characters."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1), F.when((c >= "a") & (c <= "z"), F.ascii(c) - 97).otherwise(26))
    return F.aggregate(F.transform(F.split(F.col(text), ""), bit), F.lit(0), lambda x, y: x.bitwiseOR(y))


def alike_names(left: DataFrame, right: DataFrame, at_least: float = ALIKE) -> DataFrame:
    """(a, b, score) of distinct texts a and b whose similarity is at least so high. Every pair is looked at; pairs
    that cannot reach it by their lengths, common beginning and letters are left out before it is computed. With
    m common letters the Jaro part is at most (m / shorter + m / longer + 1) / 3. left: (a), right: (b)."""
    l = left.where("a is not null").select("a").distinct().select("a", F.length("a").alias("_n"), _letters("a").alias("_x"))
    r = right.where("b is not null").select("b").distinct().select("b", F.length("b").alias("_m"), _letters("b").alias("_y"))
    prefix = F.lit(0)
    for k in range(1, 5):
        prefix = F.when((F.least("_n", "_m") >= k) & (F.substring("a", 1, k) == F.substring("b", 1, k)), k).otherwise(prefix)
    only_a = F.bit_count(F.col("_x").bitwiseAND(F.bitwise_not(F.col("_y"))))
    only_b = F.bit_count(F.col("_y").bitwiseAND(F.bitwise_not(F.col("_x"))))
    common = F.least(F.col("_n") - only_a, F.col("_m") - only_b)
    jaro = (common / F.greatest("_n", F.lit(1)) + common / F.greatest("_m", F.lit(1)) + 1) / 3
    reach = jaro + prefix * 0.1 * (1 - jaro)
    pairs = l.join(r, (F.col("a") == F.col("b")) | (reach >= at_least - 1e-9))
    return pairs.select("a", "b", jaro_winkler(F.col("a"), F.col("b")).alias("score")).where(F.col("score") >= at_least)


def best_candidates(signals: DataFrame, top: int = TOP) -> DataFrame:
    """(text_id, name_id, score, rank): distinct signals summed per candidate, the best few per text.
    signals: (text_id, name_id, signal, weight)."""
    summed = signals.distinct().groupBy("text_id", "name_id").agg(F.sum("weight").alias("score"))
    order = Window.partitionBy("text_id").orderBy(F.desc("score"), F.asc("name_id"))
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
