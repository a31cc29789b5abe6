"""Statement rows linked to the students they pay for, without shared keys (problem 4).

Candidates. Texts become name tokens. Unknown tokens are mapped to the vocabulary of names once per distinct
token (one edit by shared deletions, run-together pairs of names, shortened names by prefix). A row and a
student meet if a token of the narration is a name or alias of the student and a second token, of narration
or payer, is another name of the student or of a guardian; initials of a guardian's other names are compared too. What was
matched, and how, is collected per pair as bits.

Confidence. Heuristic functions vote on each pair from these bits and from amount and class: form of the
first name, surname, payer, amount, class, and whether a rival for the mention has as much evidence. A generative label model
learns from the votes alone how accurate each function is; a weak score of the votes is where the fit begins. Functions
that depend on each other given the truth are joined into factors. It is fitted by expectation maximisation on the counts of vote
patterns of all pairs, of which there are at most ``PATTERNS``. The posterior of a pattern is the confidence.

Each mention of a first name goes to the pair with the highest confidence; ties that nothing resolves are
left out. Payers name no family (collection agents, terminals) if the same words recur in many rows and either none
of them is a name of a guardian or student, or the rows name many unrelated families; a guardian is heard however often they pay.

Defined results: rows without a narration, or that name no child, give nothing; null payers, amounts and
classes are no votes; repeated links and fees count once; copies of a row each get their students; texts of
any length are read as a whole.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyspark.functions.money import parse_money
from tallyspark.llm import names
from tallyspark.session import cut, cut_table

#: Words of a payer that recur in so many rows are no slip of the pen, and name nobody if none of them is a name.
LEAST_COLLECTIVE = 50
#: A family is told by few names: so many of them, the commonest, make at least this share of the names in its rows.
FAMILY_NAMES = 20
FAMILY_SHARE = 0.5
#: So many of the commonest names are broadcast, whatever the size of the vocabulary.
COMMON = 20_000
#: Token positions per mask; as many masks are kept as the longest narration needs.
PLACES = 60
#: Least confidence of a link.
CONFIDENT = 0.5
#: Mutual information, given the truth, from which two functions are one factor of the model.
DEPENDENT = 0.01
#: Outcomes of the six voting functions; their product bounds the patterns collected.
OUTCOMES = (5, 4, 4, 4, 3, 3)
PATTERNS = int(np.prod(OUTCOMES))
#: Bits of evidence of a pair.
EXACT, FUZZY, SHORT, ALIAS, SURNAME, OTHER, GUARDIAN, GIVEN, FAMILY, OWN, INITIAL, SPLIT = (1 << k for k in range(12))
_PERSON = T.ArrayType(T.StructType([T.StructField("t", T.StringType()), T.StructField("m", T.IntegerType())]))
_WORDS = T.StructType([T.StructField("w", T.ArrayType(T.StringType())), T.StructField("i", T.IntegerType()), T.StructField("p", _PERSON), T.StructField("l", T.ArrayType(T.StringType()))])
_RUN = re.compile(r"[^\W_]+")
#: Words that tell what a payment is for, which a payer's name does not.
_PURPOSE = frozenset("fee fees school schl sch tuition pymt payment payments term balance".split())


def _words(text: str | None) -> list[str]:
    return [names.fold(t) for t in _RUN.findall(names.plain(text))]


def _letter(token: str) -> int:
    """The bit of a token's first letter; one bit serves all letters outside a to z."""
    return 1 << (ord(token[0]) - 97 if "a" <= token[0] <= "z" else 26)


def person_tokens(every: list[str]) -> list[dict]:
    """The words of a person's name, each with the initials of the others as bits."""
    every = [t for t in every if t not in names.TITLES and t.isalpha()]
    out: dict[str, int] = {}
    for k, t in enumerate(every):
        if len(t) > 2:
            out[t] = out.get(t, 0) | sum({_letter(u) for m, u in enumerate(every) if m != k})
    return [{"t": t, "m": m} for t, m in out.items()]


_ARROW_PERSON = pa.list_(pa.struct([("t", pa.string()), ("m", pa.int32())]))


def _plain(texts: pa.Array) -> pa.Array:
    """``names.plain`` of a batch: plain letters by a kernel, others one by one."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    out = pc.replace_substring(pc.utf8_lower(texts), "'", "")
    odd = pc.invert(pc.string_is_ascii(texts))
    if pc.any(odd).as_py():
        out = pc.replace_with_mask(out, odd, pa.array([names.plain(t) for t in texts.filter(odd).to_pylist()], pa.string()))
    return out


def row_words(narrations: pa.Array, payers: pa.Array) -> pa.Array:
    """(w, i, p, l) of a batch: the words of the narrations that may name somebody, each once and in order; single letters in it as
    bits; the words of the payers with the initials of their others; the single letters from a to z. Where a payer reads like a narration
    and the narration does not, the two are exchanged. What a word is, is found once per different word of the batch."""
    n = len(narrations)
    # as re's word characters, without the underscore: letters, numbers of any kind
    lists = [pc.split_pattern_regex(_plain(x), r"[^\p{L}\p{N}]+") for x in (narrations, payers)]
    row = np.concatenate([np.repeat(np.arange(n), np.diff(x.offsets.to_numpy())) for x in lists])
    side = np.repeat([0, 1], [len(x.flatten()) for x in lists])
    coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    of = coded.indices.to_numpy(zero_copy_only=False)
    raw = coded.dictionary.to_pylist()
    folded = [names.fold(t) for t in raw]
    flag = lambda test: np.fromiter((test(t) for t in folded), bool, len(folded))[of]
    size = np.fromiter(map(len, folded), np.int64, len(folded))[of]
    letter = np.fromiter((_letter(t) if t else 0 for t in folded), np.int64, len(folded))[of]
    alpha, title, filler, purpose = flag(str.isalpha), flag(names.TITLES.__contains__), flag(names.is_filler), flag(_PURPOSE.__contains__)
    asks = [np.bincount(row[(side == k) & purpose], minlength=n) > 0 for k in (0, 1)]
    told = side ^ (asks[1] & ~asks[0])[row] == 0
    values = pa.array(folded, pa.string()).dictionary_encode()
    code = values.indices.to_numpy(zero_copy_only=False)[of]

    def once(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the first of each word in a row, in order, and the offsets of the rows."""
        k = np.flatnonzero(keep)
        k = k[np.argsort(row[k], kind="stable")]
        _, first = np.unique(row[k] * max(1, len(values.dictionary)) + code[k], return_index=True)
        k = k[np.sort(first)]
        return k, np.concatenate([[0], np.cumsum(np.bincount(row[k], minlength=n))]).astype(np.int32)

    k, offsets = once(told & (size > 2) & alpha & ~title & ~filler)
    words = pa.ListArray.from_arrays(pa.array(offsets), values.dictionary.take(pa.array(code[k])))
    initials = np.zeros(n, np.int64)
    single = told & (size == 1) & alpha
    np.bitwise_or.at(initials, row[single], letter[single])
    k, offsets = once(single & (letter < 1 << 26))
    letters = pa.ListArray.from_arrays(pa.array(offsets), values.dictionary.take(pa.array(code[k])))
    name = ~told & alpha & ~title
    seen = np.zeros((n, 27), np.int64)
    place = np.log2(np.maximum(letter, 1)).astype(np.int64)
    np.add.at(seen, (row[name], place[name]), 1)
    every = ((seen > 0) * (1 << np.arange(27))).sum(1)
    k, offsets = once(name & (size > 2))
    others = np.where(seen[row[k], place[k]] > 1, every[row[k]], every[row[k]] & ~letter[k])
    person = pa.StructArray.from_arrays([values.dictionary.take(pa.array(code[k])), pa.array(others, pa.int32())], ["t", "m"])
    return pa.StructArray.from_arrays([words, pa.array(initials, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), person), letters], ["w", "i", "p", "l"])


@F.arrow_udf(_WORDS)
def _row_words(narrations: pa.Array, payers: pa.Array) -> pa.Array:
    return row_words(narrations, payers)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _tokens(texts: pa.Array) -> pa.Array:
    return pa.array([list(dict.fromkeys(t for t in names.all_tokens(x) if t.isalpha() and len(t) > 1)) for x in texts.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(_PERSON)
def _person(texts: pa.Array) -> pa.Array:
    return pa.array([person_tokens(_words(x)) for x in texts.to_pylist()], _ARROW_PERSON)


_row_words, _tokens, _person = (f.asNondeterministic() for f in (_row_words, _tokens, _person))  # run once each


def class_code(text: Column) -> Column:
    """A number for the class in either spelling, or quoted in a narration; null if there is none."""
    pattern = r"(?i)(?<![\p{L}])(jss|ss|primary|pry|p|nursery|nur)[\s\p{Z}.,/_-]*([1-6])[a-e]?(?![\p{L}\p{N}])"
    # as an array's one element, so that the text is searched once
    number = lambda found: F.when(found != "", F.ascii(F.lower(found)) * 10 + F.regexp_extract(found, "[1-6]", 0).try_cast("int"))
    return F.transform(F.array(F.regexp_extract(text, pattern, 0)), number)[0]


def _pair_key(child: str | Column, context: str | Column) -> Column:
    """A hash of two tokens. It is not verified: among a thousand million keys and as many different pairs of words the
    number of stray candidates to be expected is 0.05, and a stray one still needs the votes."""
    return F.xxhash64(child, context)


def _first_letter(name: str) -> Column:
    """The bit of a token's first letter, as in ``_letter``."""
    code = F.ascii(name) - 97
    return F.call_function("shiftleft", F.lit(1), F.when((code >= 0) & (code < 26), code).otherwise(26))


def students_with_keys(students: DataFrame, guardians: DataFrame, links: DataFrame, fees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, vocabulary). keys: one row per student and pair of tokens (child token, context token), hashed,
    with the evidence it stands for, the student's total fees and class. vocabulary: (token, name, head) with name true
    for tokens of names, false for aliases only, and head true for what a child may be called by."""
    surname_first = F.col("name").contains(",")
    own = students.select(
        "student_id",
        class_code(F.coalesce("class", F.lit(""))).alias("level"),
        _tokens(F.coalesce("name", F.lit(""))).alias("n"),
        _tokens(F.regexp_replace(F.coalesce("aliases", F.lit("")), ";", " ")).alias("a"),
        surname_first.alias("first"),
    )
    own = own.withColumn("surname", F.when(F.size("n") > 0, F.when(F.col("first"), F.element_at("n", 1)).otherwise(F.element_at("n", -1))))
    paid = fees.select("student_id", "fee_id", "term_id", parse_money(F.col("amount")).alias("m")).groupBy("student_id", "fee_id", "term_id").agg(F.max("m").alias("m"))
    paid = paid.groupBy("student_id").agg(F.sum("m").alias("total"))
    person = guardians.select("guardian_id", _person(F.coalesce("name", F.lit(""))).alias("g"), F.element_at(_tokens(F.coalesce("name", F.lit(""))), -1).alias("family"))
    kin = links.select("student_id", "guardian_id").distinct().join(cut_table(person), "guardian_id")
    around = kin.select("student_id", "family", F.explode("g").alias("x")).select("student_id", F.col("x.t").alias("c"), F.when(F.col("x.t") == F.col("family"), FAMILY).otherwise(GIVEN).alias("e"), F.col("x.m").alias("m"))
    base = cut_table(own.join(paid, "student_id", "left"))
    mine = base.select("student_id", "surname", F.explode("n").alias("c"))
    mine = mine.select("student_id", "c", F.when(F.col("c") == F.col("surname"), SURNAME | OWN).otherwise(OTHER).alias("e"), F.lit(0).alias("m"))
    initial = base.where("surname is not null").select("student_id", F.substring("surname", 1, 1).alias("c"), F.lit(INITIAL).alias("e"), F.lit(0).alias("m"))
    context = around.unionByName(mine).unionByName(initial).groupBy("student_id", "c").agg(F.bit_or("e").alias("e"), F.bit_or("m").alias("m"))
    given = F.array_except("n", F.array("surname"))
    child = F.concat(
        F.transform(given, lambda t: F.struct(t.alias("t"), F.lit(False).alias("alias"))),
        F.transform(F.array_except("a", "n"), lambda t: F.struct(t.alias("t"), F.lit(True).alias("alias"))),
    )
    heads = base.where("surname is not null").select("student_id", "level", "total", _first_letter("surname").alias("own"), F.explode(child).alias("x")).select("student_id", "level", "total", "own", "x.t", "x.alias")
    # what a token pair stands for, in one number: context evidence, and whether the child's name is an alias
    stands = F.col("e").bitwiseOR(F.when(F.col("alias"), ALIAS).otherwise(0))
    keys = heads.join(context, "student_id").where("t <> c").select(_pair_key("t", "c").alias("key"), "student_id", "level", "total", "own", "m", stands.alias("stands"))
    words = base.select(F.explode("n").alias("token"), F.lit(True).alias("name"), F.lit(False).alias("head"))
    words = words.unionByName(base.select(F.explode("a").alias("token"), F.lit(False).alias("name"), F.lit(False).alias("head")))
    words = words.unionByName(kin.select(F.explode("g.t").alias("token"), F.lit(True).alias("name"), F.lit(False).alias("head")))
    words = words.unionByName(base.where("surname is not null").select(F.explode(child).alias("x")).select(F.col("x.t").alias("token"), F.lit(False).alias("name"), F.lit(True).alias("head")))
    vocabulary = words.where(F.length("token") > 1).groupBy("token").agg(F.max("name").alias("name"), F.max("head").alias("head"))
    return keys, vocabulary


@F.arrow_udf(T.BooleanType())
def _one_edit(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([x is not None and names.distance(x, y, 1) <= 1 for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


def _deletions(token: str) -> Column:
    """A token and its forms with one letter less."""
    t = F.col(token)
    shorter = F.transform(F.sequence(F.lit(1), F.length(t)), lambda k: F.concat(F.substr(t, F.lit(1), k - 1), F.substr(t, k + 1)))
    return F.array_distinct(F.concat(F.array(t), shorter))


def token_map(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, known, form, head) of distinct tokens that are no names: form FUZZY for one edit, SPLIT for one of two
    names run together, SHORT for a prefix of the known token."""
    plain = vocabulary
    whole = cut_table(tokens.join(vocabulary.where("name").select("token"), "token", "left_anti"))
    forms = whole.where("length(token) >= 4").select("token", F.explode(_deletions("token")).alias("d"))
    known = plain.where("length(token) >= 4").select(F.col("token").alias("known"), F.explode(_deletions("token")).alias("d"))
    near = forms.join(known, "d").select("token", "known").where("token <> known").distinct().withColumn("edits", F.levenshtein("token", "known", 2))
    # two edits may be one exchange of neighbours
    swapped = F.when((F.col("edits") == 2) & (F.length("token") == F.length("known")), F.col("token"))
    near = near.where((F.col("edits") == 1) | _one_edit(swapped, "known")).select("token", "known")
    cuts = F.sequence(F.lit(3), F.length("token") - 3)
    parts = whole.where("length(token) >= 8").select("token", F.explode(cuts).alias("k"))
    parts = parts.select("token", F.substring("token", 1, F.col("k")).alias("x"), F.substr(F.col("token"), F.col("k") + 1).alias("y"))
    names_ = plain.where("name and length(token) >= 3").select("token")
    parts = parts.join(names_.withColumnRenamed("token", "x"), "x").join(names_.withColumnRenamed("token", "y"), "y")
    parts = parts.select("token", F.explode(F.array("x", "y")).alias("known"))
    lead = plain.where("name").select(F.col("token").alias("known"), F.explode(F.sequence(F.lit(3), F.lit(5))).alias("k")).where("k < length(known)")
    short = whole.where("length(token) between 3 and 5").join(lead.select("known", F.substring("known", 1, F.col("k")).alias("token")), "token")
    every = near.withColumn("form", F.lit(FUZZY))
    every = every.unionByName(parts.withColumn("form", F.lit(SPLIT))).unionByName(short.select("token", "known").withColumn("form", F.lit(SHORT)))
    every = every.groupBy("token", "known").agg(F.min("form").alias("form"))
    return every.join(plain.select(F.col("token").alias("known"), "head"), "known")


def _letters() -> Column:
    """The single letters of a row: an initial alone is a context only where no payer gives one."""
    return F.when(F.size("p") == 0, F.col("l")).otherwise(F.array().cast("array<string>"))


def _where(position: str, payers: Column) -> Column:
    """The position of a word among those of a narration, its payer and its single letters: its own, -1 or -2. payer: its place among the payer's words."""
    return F.when(F.col("payer") < 0, F.col(position)).when(F.col("payer") < payers, -1).otherwise(-2)


def _mask(masks: str) -> Column:
    """The initials beside the payer's word at the place ``payer``; none for other words."""
    return F.when((F.col("payer") >= 0) & (F.col("payer") < F.size(masks)), F.get(masks, F.col("payer"))).otherwise(0)


def _pair(child: Column, other: Column, pos: Column, where: Column, mask: Column, form: Column) -> list[Column]:
    """(key, place, what): the pair of words; the positions of both; the other's initials and the form of the child's name."""
    place = pos.cast("bigint") * (1 << 32) + where + 2
    return [_pair_key(child, other).alias("key"), place.alias("place"), (mask.cast("bigint") * (1 << 16) + form).alias("what")]


def candidate_pairs(rows: DataFrame, keys: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(row_id, student_id, level, total, own, bits, place): every meeting of a row and a student, with class, fees and initial of the
    student, evidence and token positions; and, without a student, every row once, with its own class, amount, initials
    and, as bits, whether its payer is collective. ``whole_pairs`` makes pairs of them. rows: (row_id, w, i, p, amount, row_level, collective).

    Pairs of words as they are written are made where their row lies. Only rows with a word that may stand for
    another one are moved, to meet what it stands for."""
    frequent = cut_table(rows.select(F.explode(F.concat("w", "p.t")).alias("token")).groupBy("token").agg(F.count("*").alias("n")))
    mapping = cut_table(token_map(frequent.select("token"), vocabulary))
    # the commonest words, at most COMMON: whether they stand for others too, and whether they are names of children
    common = frequent.orderBy(F.desc("n"), "token").limit(COMMON).select("token")
    common = common.join(mapping.select("token").distinct().withColumn("loose", F.lit(True)), "token", "left").join(vocabulary, "token", "left")
    common = cut(common.select("token", F.coalesce("loose", F.lit(False)).alias("loose"), F.coalesce("head", F.lit(False)).alias("head")))
    barren = F.broadcast(common.where("not head").select(F.col("token").alias("child")))
    heads = rows.select("row_id", "w", "p", "l", F.posexplode("w").alias("pos", "child")).join(barren, "child", "left_anti")
    beside = heads.select("row_id", "pos", "child", F.size("w").alias("n"), F.col("p.m").alias("m"), F.posexplode(F.concat("w", "p.t", _letters())).alias("k", "other"))
    beside = beside.where("child <> other").withColumn("payer", F.col("k") - F.col("n"))
    pairs = beside.select("row_id", *_pair(F.col("child"), F.col("other"), F.col("pos"), _where("k", F.size("m")), _mask("m"), F.lit(EXACT)))
    # words that may stand for others, and their rows
    loose = rows.select("row_id", "w", "p", "l", F.posexplode(F.concat("w", "p.t")).alias("k", "token"))
    loose = loose.join(F.broadcast(common.where("not loose").select("token")), "token", "left_anti").withColumn("payer", F.col("k") - F.size("w"))
    loose = loose.withColumn("pos", F.when(F.col("payer") < 0, F.col("k")).otherwise(-1)).withColumn("mask", F.when(F.col("payer") < 0, 0).otherwise(F.get("p.m", F.col("payer"))))
    stands = loose.select("row_id", "token", "pos", "mask").join(mapping, "token")
    stands = stands.groupBy("row_id").agg(F.collect_set(F.struct("pos", "known", "form", "mask", "head")).alias("m"))
    texts = loose.groupBy("row_id").agg(*(F.any_value(c).alias(c) for c in ("w", "p", "l")))
    moved = texts.join(stands, "row_id").select("row_id", "w", "p", _letters().alias("l"), *(F.col(f"m.{c}").alias(f"s_{c}") for c in ("pos", "known", "form", "mask", "head")), F.size("w").alias("n"))
    meant = moved.select("*", F.posexplode(F.concat("w", "s_known")).alias("h", "child")).withColumn("at", F.col("h") - F.col("n"))
    meant = meant.where((F.col("at") < 0) | (F.get("s_pos", F.col("at")) >= 0) & F.get("s_head", F.col("at"))).join(barren, "child", "left_anti")
    meant = meant.withColumns({"pos": F.when(F.col("at") < 0, F.col("h")).otherwise(F.get("s_pos", F.col("at"))), "form": F.when(F.col("at") < 0, EXACT).otherwise(F.get("s_form", F.col("at")))})
    # a word as it is written has met the others that are written already
    among = F.when(F.col("at") < 0, F.col("s_known")).otherwise(F.concat("s_known", "w", "p.t", "l"))
    drawn = F.col("k") - F.size("s_known")  # the others: what words stand for, then the words as they are
    meant = meant.select("*", F.posexplode(among).alias("k", "other")).where("child <> other").withColumns({"drawn": drawn, "payer": drawn - F.col("n")})
    where = F.when(F.col("drawn") < 0, F.get("s_pos", F.col("k"))).otherwise(_where("drawn", F.size("p")))
    mask = F.when(F.col("drawn") < 0, F.get("s_mask", F.col("k"))).otherwise(_mask("p.m"))
    meant = meant.select("row_id", "child", "other", "pos", "form", where.alias("where"), mask.alias("mask"), F.when(F.col("drawn") < 0, F.get("s_form", F.col("k"))).otherwise(EXACT).alias("by"))
    meant = meant.where(f"where <> pos or form = {SPLIT} and by = {SPLIT}")
    pairs = pairs.unionByName(meant.select("row_id", *_pair(*(F.col(c) for c in ("child", "other", "pos", "where", "mask", "form")))))
    found = pairs.join(keys, "key").select(
        "row_id", "student_id", "level", "total", "own", "m", "stands", "place",
        (F.col("place").bitwiseAND((1 << 32) - 1) - 2).cast("int").alias("where"),
        F.shiftright("what", 16).cast("int").alias("mask"), F.col("what").bitwiseAND((1 << 16) - 1).cast("int").alias("form"),
    )
    form = F.when(F.col("stands").bitwiseAND(ALIAS) > 0, ALIAS).otherwise(F.col("form"))
    # what the context stands for depends on where it was found
    kind = F.when(F.col("where") == -2, INITIAL).when(F.col("where") >= 0, SURNAME | OTHER).otherwise(GIVEN | FAMILY | OWN)
    seen = F.col("stands").bitwiseAND(kind)
    # a guardian's word with the initial of another of the guardian's words
    both = (F.col("where") == -1) & (F.col("mask").bitwiseAND(F.col("m")) > 0)
    seen = seen.bitwiseOR(F.when(both, GUARDIAN).otherwise(0))
    bits = F.when(seen > 0, seen.bitwiseOR(form)).otherwise(0).cast("int")
    found = found.select("row_id", "student_id", "level", "total", "own", bits.alias("bits"), "place").where("bits > 0")
    said = rows.select("row_id", F.lit(None).cast(keys.schema["student_id"].dataType).alias("student_id"), F.col("row_level").alias("level"), F.col("amount").alias("total"), F.col("i").alias("own"), F.col("collective").cast("int").alias("bits"), F.lit(None).cast("bigint").alias("place"))
    return found.unionByName(said)


def _has(bits: np.ndarray, bit: int) -> np.ndarray:
    return bits & bit > 0


#: What a piece of evidence is worth when rivals for one mention are told apart.
_WORTH = ((EXACT, 3), (ALIAS, 2), (FUZZY, 2), (SPLIT, 2), (SURNAME, 3), (INITIAL, 1), (OTHER, 1), (GUARDIAN, 3), (GIVEN, 1), (FAMILY, 1), (OWN, 1))
_VOTED = ("mention", "alone", "strength", "v0", "v1", "v2", "v3", "v4", "v5")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of numbers, 0 for null, and where they are given."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys begins; the keys lie group by group."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def vote(pairs: pa.Table, masks: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The votes of whole rows' pairs, which lie row by row: the place of the pair of each vote, and its outcomes."""
    bits, row = pairs["bits"].to_numpy(), pairs["row_id"].to_numpy()
    heads, covers = (np.stack([pairs[f"{c}{k}"].to_numpy() for k in range(masks)], 1) for c in ("heads", "covers"))
    at, mention = [], []
    for k in range(masks):  # each position of a head is a mention; nearly all pairs have one
        of, rest = np.flatnonzero(heads[:, k]), heads[heads[:, k] != 0, k]
        while len(of):
            at.append(of)
            mention.append(np.frexp((rest & -rest).astype(np.float64))[1] - 1 + k * PLACES)
            rest = rest & (rest - 1)
            of, rest = of[rest != 0], rest[rest != 0]
    at, mention = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (at, mention))
    number = np.repeat(np.arange(len(first := _starts(row))), np.diff([*first, len(row)]))
    order = np.lexsort((mention, number[at]))
    at, mention = at[order], mention[order]
    group, bits, heads, covers = number[at], bits[at], heads[at], covers[at]
    if not len(at):
        return at, {c: np.zeros(0, np.int32) for c in _VOTED}
    (total, priced), (amount, paid), (level, classed), (row_level, told) = ((x[at], y[at]) for x, y in (_numbers(pairs[c]) for c in ("total", "amount", "level", "row_level")))
    collective = pairs["collective"].to_numpy()[at]
    by_row, by_place = _starts(group), _starts(group, mention)
    rows, places = np.diff([*by_row, len(at)]), np.diff([*by_place, len(at)])
    # what the children that nobody else could be meant by cost together
    sure = priced & (np.repeat(places, places) == 1)
    together, some = np.repeat(np.add.reduceat(np.where(sure, total, 0), by_row), rows), np.repeat(np.logical_or.reduceat(sure, by_row), rows)
    row_heads, known = (np.repeat(np.bitwise_or.reduceat(x, by_row), rows, 0) for x in (heads, covers))
    mentions = np.bitwise_count(row_heads).sum(1)
    lost = np.bitwise_count(known & ~(covers | row_heads)).sum(1)
    has = partial(_has, bits)
    out = {"mention": mention, "alone": np.repeat(rows == 1, rows)}
    out["v0"] = np.select([has(EXACT), has(ALIAS), has(FUZZY | SPLIT), has(SHORT)], [0, 1, 2, 3], 4)
    out["v1"] = np.select([has(SURNAME), has(INITIAL), lost == 0], [0, 1, 2], 3)
    out["v2"] = np.select([has(GUARDIAN), has(FAMILY | OWN | GIVEN), collective], [0, 1, 2], 3)

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (y != 0) & (np.abs(x / np.where(y != 0, y, 1) - 1) < 0.003)

    fits = [near(k * amount, total) | some & near(k * amount, together) for k in (1, 2)]
    out["v3"] = np.select([~paid | ~priced, *fits, (mentions > 1) & (amount > total)], [3, 0, 1, 3], 2)
    out["v4"] = np.select([~classed | ~told, level == row_level, mentions > 1], [2, 0, 2], 1)
    strength = np.choose(out["v3"], [2, 1, 0, 0]) + np.choose(out["v4"], [1, -2, 0]) + sum(points * has(bit) for bit, points in _WORTH)
    top = strength == np.repeat(np.maximum.reduceat(strength, by_place), places)
    out["strength"] = strength
    out["v5"] = np.select([~top, np.repeat(np.add.reduceat(top.astype(np.int64), by_place), places) > 1], [2, 1], 0)
    return at, {c: out[c].astype(np.int32) for c in _VOTED}


def whole_pairs(met: pa.Table, masks: int) -> pa.Table:
    """(row_id, student_id, bits, heads0.., covers0.., level, total, amount, row_level, collective): the pairs of whole rows, which lie row by
    row, as from ``candidate_pairs``. As bits of token positions, ``PLACES`` to a mask, in as many masks as the longest
    narration needs: heads, the names of the child; covers, all names of the student."""
    row = met["row_id"].to_numpy()
    number = np.repeat(np.arange(len(first := _starts(row))), np.diff([*first, len(row)]))
    paired = met["student_id"].is_valid().to_numpy()
    student = pc.fill_null(met["student_id"].combine_chunks().dictionary_encode().indices, 0).to_numpy()
    k = np.flatnonzero(paired)
    k = k[np.lexsort((student[k], number[k]))]
    said = np.zeros(len(first), np.int64)
    said[number[~paired]] = np.flatnonzero(~paired)
    begin = _starts(number[k], student[k]) if len(k) else k
    merged = lambda x: np.bitwise_or.reduceat(x, begin) if len(k) else x
    place = pc.fill_null(met["place"], 0).to_numpy()[k]
    pos, where = place >> 32, (place & ((1 << 32) - 1)) - 2
    bit = lambda x, m: np.where((x >= m * PLACES) & (x < (m + 1) * PLACES), np.int64(1) << np.clip(x - m * PLACES, 0, PLACES), 0)
    heads = {f"heads{m}": merged(bit(pos, m)) for m in range(masks)}
    covers = {f"covers{m}": heads[f"heads{m}"] | merged(bit(where, m)) for m in range(masks)}
    every, own = (pc.fill_null(met[c], 0).to_numpy() for c in ("bits", "own"))
    at = k[begin]
    of = said[number[at]]
    bits = merged(every[k]) | np.where(own[of] & own[at] > 0, INITIAL, 0)
    pairs = met.select(["row_id", "student_id", "level", "total"]).take(pa.array(at))
    rows = met.select(["total", "level"]).take(pa.array(of)).rename_columns(["amount", "row_level"])
    for name, values in {"bits": bits, **heads, **covers, "collective": every[of] > 0}.items():
        pairs = pairs.append_column(name, pa.array(values))
    return pairs.append_column("amount", rows["amount"]).append_column("row_level", rows["row_level"])


def votes(pairs: DataFrame, masks: int = 1, make: Callable[[pa.Table, int], pa.Table] | None = None) -> DataFrame:
    """One row per pair and mention of a child's name, with its strength among rivals, the outcomes v0..v5 of the six functions, and
    whether it is the only one of its row, as 1. pairs: as from ``whole_pairs``, or what ``make`` makes such pairs of."""

    def voted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        whole = make(whole, masks) if make else whole
        at, out = vote(whole, masks)
        keys = [whole[c].combine_chunks().take(pa.array(at)) for c in ("row_id", "student_id")]
        return pa.RecordBatch.from_arrays([*keys, *(pa.array(out[c]) for c in _VOTED)], ["row_id", "student_id", *_VOTED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the row that may go on in the next batch
        for batch in (b for b in batches if len(b)):
            row = batch["row_id"].to_numpy()
            last = int(_starts(row)[-1])
            if last or held and held[0]["row_id"][0].as_py() != row[0]:
                yield voted([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield voted(held)

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("row_id", "student_id"))
    return pairs.repartition("row_id").sortWithinPartitions("row_id").mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} int" for c in _VOTED))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> np.ndarray:
    """Confidence of each vote pattern, learnt from the counts of all patterns.

    patterns: [n, functions] outcomes. A latent truth with class-conditional outcome tables is fitted by
    expectation maximisation. A weak score (a surname, a guardian's name or a fitting amount speak for a pair,
    their absence against it) is the starting point only: it tells the fit which of the two classes is the true
    one. Then functions that depend on each other given the truth, by ``DEPENDENT`` nats a pair or more, are
    joined into factors of two, the most dependent first, and the fit is repeated, which models that correlation.
    """
    if not len(patterns):
        return np.zeros(0)
    n, k = patterns.shape
    lean = (
        np.choose(np.minimum(patterns[:, 0], 4), [0.4, 0.3, 0.1, -0.4, -1.0])
        + np.choose(np.minimum(patterns[:, 1], 3), [1.5, 0.7, 0.2, -1.5])
        + np.choose(np.minimum(patterns[:, 2], 3), [1.5, 0.5, 0.0, -0.7])
        + np.choose(np.minimum(patterns[:, 3], 3), [1.5, 0.8, -0.4, 0.0])
        + np.choose(np.minimum(patterns[:, 4], 2), [0.7, -0.9, 0.0])
        + np.choose(np.minimum(patterns[:, 5], 2), [0.8, -0.5, -1.5])
    )
    start = 1 / (1 + np.exp(-(lean - 1.0)))

    def expectation(factors: list[tuple[int, ...]], truth: np.ndarray) -> np.ndarray:
        sizes = [int(np.prod([OUTCOMES[j] for j in f])) for f in factors]
        codes = [np.ravel_multi_index([patterns[:, j] for j in f], [OUTCOMES[j] for j in f]) for f in factors]
        for _ in range(steps):
            prior = np.clip((counts * truth).sum() / counts.sum(), 1e-4, 1 - 1e-4)
            odds = np.full(n, np.log(prior / (1 - prior)))
            for size, code in zip(sizes, codes):
                yes = np.bincount(code, counts * truth, size) + 1.0
                no = np.bincount(code, counts * (1 - truth), size) + 1.0
                odds += np.log(yes / yes.sum())[code] - np.log(no / no.sum())[code]
            new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            if np.abs(new - truth).max() < 1e-6:
                return new
            truth = new
        return truth

    truth = expectation([(j,) for j in range(k)], start)

    def dependence(i: int, j: int) -> float:
        total = 0.0
        for weight in (counts * truth, counts * (1 - truth)):
            table = np.zeros((OUTCOMES[i], OUTCOMES[j]))
            np.add.at(table, (patterns[:, i], patterns[:, j]), weight)
            p = table / max(table.sum(), 1e-12)
            outer = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
            some = p > 0
            total += weight.sum() * (p[some] * np.log(p[some] / outer[some])).sum()
        return total / counts.sum()

    single, factors = set(range(k)), []
    for i, j in sorted(itertools.combinations(range(k), 2), key=lambda x: -dependence(*x)):
        if i in single and j in single and dependence(i, j) >= DEPENDENT:
            factors.append((i, j))
            single -= {i, j}
    return expectation([*factors, *((m,) for m in sorted(single))], truth)


def collective_payers(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(who) of payers that name no family, by what they are called and whom their rows name, not by their share of
    the rows. words: (who, w, p), who being the payer's words in a fixed order; vocabulary: (token, name)."""
    known = vocabulary.where("name").select("token")
    often = words.where("who <> ''").groupBy("who").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COLLECTIVE)
    often = cut_table(often.select("who", F.split("who", " ").alias("t")))
    called = cut_table(often.select("who", F.explode("t").alias("token")).join(known, "token", "left_semi").select("who").distinct())
    # those that are called by a name: the names in their rows without their own
    told = words.join(called, "who", "left_semi").select("who", F.explode(F.array_except("w", "p.t")).alias("token"))
    told = told.groupBy("who", "token").agg(F.count("*").alias("n")).join(known, "token", "left_semi")
    place = Window.partitionBy("who").orderBy(F.desc("n"), "token")
    ranked = told.withColumn("rank", F.row_number().over(place))
    shares = ranked.groupBy("who").agg((F.sum(F.when(F.col("rank") <= FAMILY_NAMES, F.col("n"))) / F.sum("n")).alias("share"))
    many = shares.where(F.col("share") < FAMILY_SHARE).select("who")
    return often.select("who").join(called, "who", "left_anti").unionByName(many)


def matches(statements: DataFrame, students: DataFrame, guardians: DataFrame, links: DataFrame, fees: DataFrame) -> DataFrame:
    """(row_id, student_id, confidence) of every statement row and student it pays for."""
    spark = statements.sparkSession
    words = statements.select(
        "row_id",
        (F.trim(F.coalesce("payer", F.lit(""))) == "").alias("unpaid"),
        parse_money(F.col("amount")).alias("amount"),
        class_code(F.coalesce("narration", F.lit(""))).alias("row_level"),
        _row_words("narration", "payer").alias("x"),
    ).select("row_id", "unpaid", "amount", "row_level", *(F.col(f"x.{c}").alias(c) for c in "wipl"))
    words = cut_table(words.withColumn("who", F.array_join(F.sort_array("p.t"), " ")))
    keys, vocabulary = students_with_keys(students, guardians, links, fees)
    vocabulary = cut(vocabulary)
    crowd = cut_table(collective_payers(words, vocabulary))  # of known size: broadcast where it is small
    rows = words.where((F.size("w") > 0) & F.col("row_id").isNotNull()).join(crowd.withColumn("collective", F.lit(True)), "who", "left")
    rows = rows.withColumn("collective", F.coalesce("collective", "unpaid"))
    rows = rows.withColumn("p", F.when(F.col("collective"), F.array().cast("array<struct<t:string,m:int>>")).otherwise(F.col("p")))
    longest = words.agg(F.max(F.size("w"))).first()[0] or 0
    masks = max(1, -(-longest // PLACES))
    voted = cut_table(votes(candidate_pairs(rows, keys, vocabulary), masks, whole_pairs))
    names_ = [f"v{k}" for k in range(6)]
    table = voted.groupBy(*names_).agg(F.count("*").alias("n")).collect()  # at most PATTERNS rows
    patterns = np.array([[r[c] for c in names_] for r in table], int).reshape(-1, 6)
    posterior = fit_label_model(patterns, np.array([r.n for r in table], float))
    learnt = spark.createDataFrame([(*map(int, p), float(q)) for p, q in zip(patterns, posterior)], ", ".join(f"{c} int" for c in names_) + ", confidence double")
    judged = voted.join(F.broadcast(learnt), names_).where(F.col("confidence") >= CONFIDENT)
    # every mention of a child goes to the likeliest student; equal ones are left out. A row's only one has no rivals
    best = Window.partitionBy("row_id", "mention").orderBy(F.desc("confidence"), F.desc("strength"))
    ranked = judged.where("alone = 0").select("row_id", "student_id", "mention", "confidence", "strength").repartition("row_id")
    ranked = ranked.withColumns({"rank": F.row_number().over(best), **{f"next_{c}": F.lead(c).over(best) for c in ("confidence", "strength")}})
    clear = ranked.where("rank = 1 and not (confidence <=> next_confidence and strength <=> next_strength)")
    clear = clear.groupBy("row_id", "student_id").agg(F.max("confidence").alias("confidence"))
    return judged.where("alone = 1").select("row_id", "student_id", "confidence").unionByName(clear)
