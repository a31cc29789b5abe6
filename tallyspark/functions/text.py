"""Text normalisation as Column expressions: names, references, tokens, identifiers, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles that a person's name is compared without.
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "chief", "alhaji", "mallam")
#: The token estimate of a text is ceil(length / 3) plus its non-ASCII characters plus this.
TOKEN_OVERHEAD = 8


def _kept(parts: Column) -> Column:
    return F.filter(parts, lambda t: t != "")


def normalize_name(text: Column) -> Column:
    """Lower case, ASCII letters only, titles dropped, words joined by one blank; '' for null."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+")
    return F.array_join(F.filter(words, lambda t: (t != "") & ~t.isin(*TITLES)), " ")


def canonical_reference(text: Column) -> Column:
    """Letters and digits in capitals; null if nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", "")), F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order, repeats kept; empty for null."""
    return _kept(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"))


def identifier_tokens(text: Column) -> Column:
    """Tokens like 'STU-12': letters, an optional dash and digits, in capitals."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z]+-?[0-9]+)"), 1), F.upper)


def digit_runs(text: Column) -> Column:
    """Distinct runs of at least three digits, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9]{3,})"), 1)))


def alias_list(text: Column) -> Column:
    """The parts between semicolons, trimmed, empty ones dropped."""
    return _kept(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda a: F.trim(a)))


def squeezed(text: Column) -> Column:
    """Lower case with single blanks between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x0b\x1c-\x1f\x85\p{Z}]+", " "))


def token_estimate(text: Column) -> Column:
    """A conservative number of model tokens; lengths in code points."""
    odd = F.char_length(F.regexp_replace(text, "[\\x00-\\x7F]", ""))
    return (F.ceil(F.char_length(text) / 3) + odd + TOKEN_OVERHEAD).cast("bigint")


def choice_letter(text: Column) -> Column:
    """The first letter A to D that stands alone in the text in capitals; '' if there is none."""
    return F.regexp_extract(F.upper(text), r"(?:^|[^\p{L}\p{N}_])([ABCD])(?:$|[^\p{L}\p{N}_])", 1)


def contains_all(text: Column, part: Column) -> Column:
    """Whether the normalised part occurs in the normalised text."""
    return F.contains(squeezed(text), squeezed(part))


def has_marker(text: Column, markers: tuple[str, ...]) -> Column:
    """Whether any of the markers occurs, whatever the case."""
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(F.lower(text), F.lit(m.lower()))
    return F.coalesce(found, F.lit(False))


def dedup_hash(reference: Column, source: Column, occurrence: Column, date: Column, amount: Column, payer: Column, narration: Column) -> Column:
    """24 hex digits: of the canonical reference if there is one, else of the row's content, with the payer's name
    normalised, and its occurrence number within the file, so that two equal rows of one file stay apart."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    row = F.concat_ws("|", F.lit("ROW"), blank(source), occurrence.cast("string"), blank(date), blank(amount), normalize_name(payer), F.array_join(tokens(narration), " "))
    basis = F.when(reference.isNotNull(), F.concat(F.lit("REF:"), reference)).otherwise(row)
    return F.substring(F.sha2(basis, 256), 1, 24)


def seeded_hash(seed: str, key: Column) -> Column:
    """Hex digest by which rows are put into a reproducible random order."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def stable_seed(key: Column) -> Column:
    """The first eight bytes of the digest as an unsigned number."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def sigmoid(z: Column) -> Column:
    """Logistic function without overflow on either side."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def percent(rate: Column) -> Column:
    """'12.3%', or a long dash for null."""
    return F.when(rate.isNull(), "—").otherwise(F.format_string("%.1f%%", rate * 100))


def lookalikes(text: Column) -> Column:
    """A text as a careless scan would read it: o, i, s and b as digits."""
    return F.translate(text, "oOiIsSbB", "00115588")


def initials(name: Column) -> Column:
    """The first letters of a name's words with full stops, the last word in full."""
    words = _kept(F.split(F.trim(name), " +"))
    head = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.concat(F.substring(w, 1, 1), F.lit(".")))
    return F.array_join(F.concat(head, F.slice(words, -1, 1)), " ")


def nickname(name: Column) -> Column:
    """The first three letters of a first name."""
    return F.substring(F.coalesce(F.get(_kept(F.split(F.trim(name), " +")), F.lit(0)), F.lit("")), 1, 3)


def name_variant(seed: str, key: Column, name: Column) -> Column:
    """A name written otherwise, chosen by a digest of the key: initials only, two letters exchanged, or the first name."""
    words = _kept(F.split(F.trim(name), " +"))
    pick = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("bigint") % 3
    swapped = F.concat(F.substring(name, 1, 2), F.substring(name, 4, 1), F.substring(name, 3, 1), F.substr(name, F.lit(5)))
    return F.when(pick == 0, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ".")).when((pick == 1) & (F.char_length(name) > 4), swapped).otherwise(F.coalesce(F.get(words, F.lit(0)), F.lit("")))


def pidgin(names: Column) -> Column:
    return F.concat(F.lit("abeg na "), names, F.lit(" school fee be dis"))


def injected(narration: Column, payload: Column) -> Column:
    """A narration that carries an instruction. It stays data: nothing reads it as anything but text."""
    return F.concat_ws(" ", narration, payload)


def choice_label(text: Column) -> Column:
    """A to D of a number from 0 to 3 or of such a letter; null for anything else."""
    return F.coalesce(F.get(F.array(*map(F.lit, "ABCD")), text.try_cast("int")), F.when(F.upper(F.trim(text)).rlike("^[A-D]$"), F.upper(F.trim(text))))


def prefixed(fields: Column, prefix: str) -> Column:
    """Of a map of form fields those whose name begins with the prefix, without it."""
    return F.transform_keys(F.map_filter(fields, lambda k, v: F.startswith(k, F.lit(prefix))), lambda k, v: F.substr(k, F.lit(len(prefix) + 1)))
