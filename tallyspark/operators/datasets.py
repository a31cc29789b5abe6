"""Building evaluation sets: signatures, families, seeded selection, leak checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.text import normalize_name, seeded_hash, squeezed, tokens
from tallyspark.operators.components import connected_components, links_by_key
from tallyspark.session import cut


def signatures(cases: DataFrame) -> DataFrame:
    """(case_no, signature): family, sorted tokens, amount in steps of 10 000 naira and sorted normalised names. Only
    amounts written as plain whole numbers have a step; others are in step 0. cases: (case_no, family, text, amount, names)."""
    step = F.coalesce(F.when(F.trim("amount").rlike("^[0-9]+$"), F.floor(F.trim("amount").try_cast("decimal(38,0)") / 10_000).cast("string")), F.lit("0"))
    return cases.select(
        "case_no",
        F.concat_ws("|", F.coalesce("family", F.lit("")), F.array_join(F.array_sort(tokens(F.col("text"))), " "), step, F.array_join(F.array_sort(F.transform("names", normalize_name)), " ")).alias("signature"),
    )


def families(cases: DataFrame, *keys: str) -> DataFrame:
    """(case_no, family): cases that share any of the key columns, directly or through others, form one family
    named by its smallest case. Null keys link nothing."""
    parts = [cases.select("case_no", F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))).alias("key")) for k in keys]
    members = parts[0]
    for p in parts[1:]:
        members = members.unionByName(p)
    found = connected_components(links_by_key(members, "case_no", "key")).withColumnRenamed("node", "case_no")
    return cases.select("case_no").distinct().join(found, "case_no", "left").select("case_no", F.coalesce("root", "case_no").alias("family"))


def leaks(assigned: DataFrame) -> DataFrame:
    """(family, splits) of families that lie in more than one split. assigned: (family, split)."""
    return assigned.groupBy("family").agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def first_of_digest(rows: DataFrame, text: str, key: str, seed: str, n: int | None = None) -> DataFrame:
    """Of rows with the same normalised text the first in seeded order, then the first n of these."""
    h = seeded_hash(seed, F.col(key))
    one = rows.withColumn("_h", h).withColumn("_d", F.sha2(squeezed(F.coalesce(F.col(text), F.lit(""))), 256))
    one = one.withColumn("_nth", F.row_number().over(Window.partitionBy("_d").orderBy("_h"))).where("_nth = 1").drop("_nth", "_d")
    return (one.orderBy("_h").limit(n) if n is not None else one).drop("_h")


def top_per_group(rows: DataFrame, group: str, key: str, seed: str, n: int) -> DataFrame:
    """The first n of each group in seeded order, with their rank."""
    order = Window.partitionBy(group).orderBy(seeded_hash(seed, F.col(key)))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def answer_pairs(messages: DataFrame) -> DataFrame:
    """(question, answer) of messages and the messages they reply to; of repeated ids the later row wins, only
    the best reply counts, and both texts must have a fitting length. messages: (row_no, message_id, parent_id,
    role, lang, text, rank, deleted)."""
    last = messages.groupBy("message_id").agg(*(F.max_by(c, "row_no").alias(c) for c in ("parent_id", "role", "lang", "text", "rank", "deleted")))
    last = last.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).where("not coalesce(deleted, false)")
    answers = last.where("role = 'assistant' and lang = 'en' and rank = 0 and length(text) between 20 and 2000")
    asked = last.where("role = 'prompter' and lang = 'en' and length(text) between 20 and 1500").select(F.col("message_id").alias("parent_id"), F.col("text").alias("question"))
    return answers.join(asked, "parent_id").select("message_id", "question", F.col("text").alias("answer"))


#: The shares of a leak-free split and the order in which equal deficits are looked at.
TARGETS = {"train": 0.7, "val": 0.15, "test": 0.15}


def component_split(members: DataFrame, seed: str, targets: dict[str, float] | None = None) -> DataFrame:
    """(case_no, family, split, problem) of every case, all cases of a family in one split.

    members: (case_no, family, provenance, pinned: val, test or null). Families with a pinned case go where it is pinned; they are a problem
    if pins differ, or if a case is not pinned or synthetic. Other families with a synthetic case are for training. The
    rest go one by one, the largest first, to the split that lacks most of its share of the authored cases. Families of one
    size are interchangeable: how many of a size each split gets is a fold over the table of sizes, of which there are few, and
    the first of them by number go to the first split. No family reaches the driver.
    """
    targets = targets or TARGETS
    comps = cut(members.groupBy("family").agg(
        F.count("*").alias("size"), F.count_if(F.col("provenance") == "team_authored").alias("authored"), F.max(F.coalesce(F.col("provenance") == "synthetic", F.lit(False))).alias("synthetic"),
        F.min("pinned").alias("pin"), F.max("pinned").alias("other"), F.count("pinned").alias("pins"),
    ))
    problem = F.when(F.col("pin") != F.col("other"), "straddles").when(F.col("pin").isNotNull() & (F.col("synthetic") | (F.col("pins") < F.col("size"))), "polluted")
    comps = comps.withColumn("problem", problem)
    placed = comps.where("pin is not null").groupBy("pin").agg(F.sum("authored").alias("n")).collect()  # at most two rows
    free = comps.where("pin is null and not synthetic")
    total = members.where("provenance = 'team_authored'").count()
    sizes = free.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()  # sizes, not families
    shares = greedy_shares([(r["size"], r["n"]) for r in sizes], {s: t * total for s, t in targets.items()}, {r.pin: r.n for r in placed}, seed)
    limits = [(size, name, start, end) for size, parts in shares.items() for name, start, end in parts]
    table = members.sparkSession.createDataFrame(limits, "size bigint, split string, start bigint, end bigint")
    rank = F.row_number().over(Window.partitionBy("size").orderBy("family"))
    dealt = free.withColumn("rank", rank).join(F.broadcast(table), "size").where("rank > start and rank <= end").select("family", "split", "problem")
    fixed = comps.where("pin is not null or synthetic").select("family", F.coalesce("pin", F.lit("train")).alias("split"), "problem")
    return members.select("case_no", "family").join(fixed.unionByName(dealt), "family")


def greedy_shares(sizes: list[tuple[int, int]], wanted: dict[str, float], have: dict[str, int], seed: str) -> dict[int, list[tuple[str, int, int]]]:
    """Per size the ranges of families each split gets if families go, one after the other, to the split with the
    largest deficit; equal deficits by a digest of split and size. Once the deficits lie within one size of each other
    the splits take turns, so a size of any number of families takes few steps."""
    from hashlib import sha256

    count = {s: float(have.get(s, 0)) for s in wanted}
    out = {}
    for size, left in sizes:
        got = dict.fromkeys(wanted, 0)
        key = lambda s: (count[s] - wanted[s], sha256(f"{seed}:{s}:{size}".encode()).hexdigest())  # noqa: E731, B023
        while left:
            gaps = [count[s] - wanted[s] for s in wanted]
            turns = left // len(wanted) if max(gaps) - min(gaps) <= size else 0
            for s in wanted if turns > 1 else ():
                got[s] += turns - 1
                count[s] += (turns - 1) * size
                left -= turns - 1
            best = min(wanted, key=key)
            got[best] += 1
            count[best] += size
            left -= 1
        ranges, at = [], 0
        for s in wanted:
            ranges.append((s, at, at + got[s]))
            at += got[s]
        out[size] = ranges
    return out


def mixture_counts(rendered: int, fraction: float) -> tuple[int, int]:
    """(owned, public): how many general examples of either kind make ``fraction`` of the whole beside the rendered ones."""
    general = round(rendered * fraction / (1 - fraction))
    return -(-general // 2), general - -(-general // 2)


def owned_examples(spark: SparkSession, n: int, seed: str, tasks: list[tuple[str, str, str]], topics: list[str]) -> DataFrame:
    """(id, category, prompt, completion) of n examples: tasks in turn, the topic by number and a digest. tasks: (category, prompt,
    completion) with {topic} and {no} in them."""
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("i").cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    rows = spark.range(n).withColumnRenamed("id", "i").withColumns({"t": F.col("i") % len(tasks), "topic": pick(topics, (F.col("i") + drawn) % len(topics)), "no": F.lpad(F.col("i").cast("string"), 5, "0")})
    fill = lambda k: F.replace(F.replace(pick([t[k] for t in tasks], F.col("t")), F.lit("{topic}"), F.col("topic")), F.lit("{no}"), F.col("no"))
    category = pick([t[0] for t in tasks], F.col("t"))
    return rows.select(F.concat_ws("-", F.lit("owned"), category, "no").alias("id"), category.alias("category"), fill(1).alias("prompt"), fill(2).alias("completion"))


def fit_and_threshold(rows: DataFrame, key: str, fit: float = 2 / 3) -> DataFrame:
    """``rows`` with part: the first two thirds, in the order of ``key``, are for the fit, the others for the threshold. The place of a
    row is its rank in a range partitioning, without bringing all rows to one task."""
    total = rows.count()
    parts = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    parts = cut(parts.withColumn("_i", F.col("_m") - F.col("_p").cast("bigint") * (1 << 33)))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect()  # one row per partition
    starts, at = [], 0
    for r in sizes:
        starts.append((r["_p"], at))
        at += r["n"]
    offsets = rows.sparkSession.createDataFrame(starts or [(0, 0)], "_p int, _s bigint")
    place = F.col("_s") + F.col("_i")
    return parts.join(F.broadcast(offsets), "_p").withColumn("part", F.when(place < int(total * fit), "fit").otherwise("threshold")).drop("_p", "_m", "_i", "_s")


def chat_examples(cases: DataFrame) -> DataFrame:
    """(case_no, prompt, completion): cases as plain questions and answers, without those that an import blocks.
    cases: (case_no, setup, txn, expected)."""
    say = lambda c: F.coalesce(c, F.lit(""))
    known = lambda s: F.when(F.size(F.coalesce(s["aliases"], F.array().cast("array<string>"))) > 0, F.concat(F.lit(" (aka "), F.array_join(s["aliases"], ", "), F.lit(")"))).otherwise("")
    line = lambda s: F.concat(F.lit("- "), s["id"], F.lit(" "), say(s["name"]), known(s), F.lit(": "), F.array_join(F.transform(s["charges"], lambda c: F.concat_ws(" ", c["fee_id"], c["amount_naira"])), ", "))
    head = F.concat(F.lit("A bank transfer of NGN "), say(F.col("txn.amount_naira")), F.lit(" arrived (payer: "), say(F.col("txn.payer_name")), F.lit(', narration: "'), say(F.col("txn.narration")), F.lit('").'))
    prompt = F.concat_ws("\n", head, F.lit("Students and balances:"), F.array_join(F.transform("setup.students", line), "\n"), F.lit("Who is it for, and how is it divided? Say so if it needs review."))
    answer = F.concat(say(F.col("expected.rationale")), F.lit(" Recommended action: "), F.col("expected.outcome"), F.lit("."))
    return cases.where("expected.outcome <> 'duplicate_blocked'").select("case_no", prompt.alias("prompt"), answer.alias("completion"))
