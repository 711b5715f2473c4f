"""Text and time expressions; each takes and returns columns and stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the word filter.
FILLERS = ("uh", "um", "mm", "hmm", "uhh", "umm")
HMS = r"^(?:(\d+):)?(\d+):(\d+)$"


def seconds_to_hms(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds, rounded down; hours may pass 24."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def parse_hms(text: Column, strict: bool = False) -> Column:
    """Seconds from H:M:S, M:S or a plain number; null (strict: an error) for anything else."""
    h, m, s = (F.try_to_number(F.regexp_extract(text, HMS, i), F.lit("999999")).cast("long") for i in (1, 2, 3))
    got = F.when(text.rlike(HMS), (F.coalesce(h, F.lit(0)) * 3600 + m * 60 + s).cast("double")).otherwise(text.try_cast("double"))
    return F.when(got.isNull() & text.isNotNull(), F.raise_error(F.concat(F.lit("not a time: "), text))).otherwise(got) if strict else got


def samples_to_ms(samples: Column, rate: int = 16000) -> Column:
    return F.floor(samples * 1000 / rate).cast("long")


def ms_to_samples(ms: Column, rate: int = 16000) -> Column:
    return F.floor(ms * rate / 1000).cast("long")


def normalize_text(text: Column) -> Column:
    """Lower case without anything that is neither a word character of any script nor white space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", "")


def normalize(text: Column) -> Column:
    """Lower case; white space to one space first, then anything but a-z, 0-9 and space to a space; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), r"[^a-z0-9 ]+", " "))


def tokenize(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " +"), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(tokenize(text))


def clean_text(text: Column) -> Column:
    """White space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_fences(text: Column) -> Column:
    """Without a leading and a trailing code fence; null becomes empty."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(" \n\t"))
    t = F.regexp_replace(t, r"^```[a-z]*\s*", "")
    return F.trim(F.regexp_replace(t, r"\s*```$", ""), F.lit(" \n\t"))


def is_meaningful(word: Column) -> Column:
    """A word of letters only, of more than one, and no filler."""
    w = F.lower(F.trim(word))
    return w.rlike(r"^\p{L}+$") & (F.length(w) > 1) & ~w.isin(*FILLERS)


def has_tokens(text: Column, least: int = 3) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))) >= least


def collection_name(name: Column) -> Column:
    return F.concat(F.lit("db_"), F.regexp_replace(name, "[^a-zA-Z0-9]", "_"))


def base_name(file: Column, prefix: str = "") -> Column:
    """A file's name without folder, extension and prefix."""
    name = F.regexp_replace(F.regexp_replace(file, r"^.*/", ""), r"\.[^.]*$", "")
    return F.regexp_replace(name, f"^{prefix}", "") if prefix else name


def meeting_of(file: Column) -> Column:
    """The part of a file's name before the first point."""
    return F.substring_index(F.regexp_replace(file, r"^.*/", ""), ".", 1)


def speaker_letter(name: Column) -> Column:
    """`speaker 1` to `speaker 4` become A to D, anything else upper case."""
    n = F.lower(F.trim(name))
    case = F
    for i, letter in enumerate("ABCD", 1):
        case = case.when(n == f"speaker {i}", letter)
    return case.otherwise(F.upper(F.trim(name)))


def speaker_number(label: Column) -> Column:
    """The first run of digits in a label; null without one."""
    return F.regexp_extract(label, r"(\d+)", 1).try_cast("int")


def href_ids(href: Column) -> Column:
    """The ids in a link such as file.A.words#id(x.words1)..id(x.words9)."""
    return F.regexp_extract_all(href, F.lit(r"id\((.*?)\)"), F.lit(1))


def href_speaker(href: Column) -> Column:
    return F.split_part(F.split_part(href, F.lit("#"), F.lit(1)), F.lit("."), F.lit(2))


def word_number(word_id: Column) -> Column:
    return F.element_at(F.split(word_id, "words"), -1).try_cast("int")


def utterance_line(start: Column, speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("["), start, F.lit("] "), speaker, F.lit(": "), text)


def span_line(start: Column, end: Column, text: Column, speaker: Column | None = None) -> Column:
    """`[start-end] text`, with a speaker `[start-end] [speaker] text`."""
    who = [F.lit("["), speaker, F.lit("] ")] if speaker is not None else []
    return F.concat(F.lit("["), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("] "), *who, text)


def bullet_line(text: Column, speaker: Column | None = None) -> Column:
    """`- text`, with a speaker `- [speaker] text`."""
    return F.concat(F.lit("- "), *([F.lit("["), speaker, F.lit("] ")] if speaker is not None else []), text)


def said_line(speaker: Column, text: Column) -> Column:
    return F.concat(speaker, F.lit(": "), text)


def python_round(x: Column, digits: int) -> Column:
    """x rounded from its exact binary value, exact ties to the even digit, as Python's round does; Spark's own round goes by the shortest decimal form.

    x * 10**digits is taken as a sum of two doubles (Dekker's product), so that a tie is told from what only looks like
    one; for values under 2**52 / 10**digits.
    """
    scale = float(10**digits)
    split = lambda v: (v * 134217729.0) - ((v * 134217729.0) - v)
    p = x * scale
    xh, sh = split(x), (scale * 134217729.0) - ((scale * 134217729.0) - scale)
    xl, sl = x - xh, scale - sh
    rest = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
    low = F.floor(p).cast("double")
    up = (p - low > 0.5) | ((p - low == 0.5) & ((rest > 0) | ((rest == 0) & (low % 2 != 0))))
    return (low + F.when(up, 1.0).otherwise(0.0)) / scale


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of the distinct tokens of a that b has; 0 if a has none."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def bag_cosine(a: Column, b: Column) -> Column:
    """Cosine of binary token bags: the default text embedder."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt((F.size(a) * F.size(b)).cast("double"))).otherwise(F.lit(0.0))


def title_tokens(text: Column) -> Column:
    """Distinct tokens that start with a capital."""
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda t: t.rlike("^[A-Z][a-z]+$")))
