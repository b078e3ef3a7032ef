"""Normalising answers, letters, entities and token sets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and phrases of the answer format.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
WHERE = r"(?iU)^\s*where\s+is\s+(.+?)\s*\??\s*$"
LETTER = r"(?<![A-Za-z])([A-H])(?![A-Za-z])"
TEACHER = r"(?imU)^\s*(?:\[\d+\]|\d+[.)]|-|\*)?\s*(?:[A-Za-z][\w /-]{0,30}:\s*)?([^|\n]+?)\s*\|\s*observation:\s*([^|\n]+?)\s*\|\s*frame:\s*(\d+)"
CUT = "Is this option correct?"
LEAD_INS = "answer|the answer is|it is|it's|there are|there is"
ENTITY_STOP = ["the", "a", "an", "of", "in", "on", "at", "with", "and", "to", "is", "his", "her", "their", "its", "s"]
ANSWER_STOP = ["the", "a", "an", "at", "of", "and", "frame"]
COLORS = ["gray", "red", "blue", "green", "brown", "cyan", "purple", "yellow"]
MATERIALS = ["metal", "rubber"]
SHAPES = ["cube", "sphere", "cylinder"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(x), r"^[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+|[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+$", "")


def normalize_short(x) -> Column:
    """First token in lower case without punctuation, number words as digits; empty if there is none."""
    t = F.regexp_replace(F.lower(strip(x)), rf"^({LEAD_INS})[:\s]+", "")
    tok = F.element_at(F.split(F.trim(F.regexp_replace(t, "[^a-z0-9 ]+", " ")), " +"), 1)
    digit = F.array_position(F.array(*[F.lit(w) for w in NUMBER_WORDS]), tok) - 1
    return F.when(digit >= 0, digit.cast("string")).otherwise(tok)


def parse_letters(x, n_options) -> Column:
    """Chosen option letters, sorted and distinct; empty for none."""
    t = strip(x)
    valid = F.substring(F.lit("ABCDEFGH"), F.lit(1), _c(n_options) if not isinstance(n_options, int) else F.lit(n_options))
    keep = lambda a: F.array_join(F.array_sort(F.array_distinct(F.filter(a, lambda c: F.contains(valid, c)))), "")
    alone = keep(F.regexp_extract_all(F.upper(t), F.lit(LETTER), 1))
    packed = F.replace(F.replace(F.upper(t), F.lit(","), F.lit("")), F.lit(" "), F.lit(""))
    compact = F.when(packed.rlike("^[A-H]+$"), keep(F.regexp_extract_all(packed, F.lit("([A-H])"), 1))).otherwise("")
    none = t.rlike(r"(?iU)\bnone\b") & ~t.rlike(r"(?U)\b[A-H]\b")
    return F.when(none, "").when(alone != "", alone).otherwise(compact)


def extract_answer(x) -> Column:
    """Text of the first answer tag, stripped; null without one."""
    return F.when(_c(x).rlike(r"(?s)<answer>.*?</answer>"), strip(F.regexp_extract(_c(x), r"(?s)<answer>(.*?)</answer>", 1)))


def entity_of(question) -> Column:
    """What a step asks the place of, 1 to 80 characters, else null: any white space, and the question mark may be missing."""
    e = F.regexp_extract(_c(question), WHERE, 1)
    e = F.regexp_replace(F.trim(e), r"^\d+\s*:\s*", "")
    e = F.when(F.contains(e, F.lit(": ")), F.substring_index(e, ": ", -1)).otherwise(e)
    e = F.btrim(e, F.lit(" ."))
    return F.when(F.length(e).between(1, 80), e)


def content_words(x) -> Column:
    """Letters and digits of any script in lower case, without stop words."""
    words = F.split(F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}]+", " "), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(ENTITY_STOP))


def answer_words(x) -> Column:
    """Set of a-z and 0-9 words of an answer without its stop words."""
    words = F.regexp_extract_all(F.lower(_c(x)), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(ANSWER_STOP)))


def jaccard(a, b) -> Column:
    """Likeness of two answers' word sets, 0 if both are empty."""
    x, y = answer_words(a), answer_words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def entities_in_text(entities, prompt, mode: str = "all") -> Column:
    """Whether the prompt names all (or, for ``none``, shares no word with) the entities; null without entities."""
    words = content_words(F.substring_index(_c(prompt), CUT, 1))
    if mode == "none":
        hit = ~F.exists(_c(entities), lambda e: F.arrays_overlap(content_words(e), words))
    else:
        hit = F.forall(_c(entities), lambda e: F.size(F.array_except(content_words(e), words)) == 0)
    return F.when(F.size(_c(entities)) > 0, hit)


def named_objects(x) -> Column:
    """Distinct colour, material and shape triples that a text names, in order."""
    p = rf"\b({'|'.join(COLORS)}) ({'|'.join(MATERIALS)}) ({'|'.join(SHAPES)})\b"
    t = F.lower(_c(x))
    return F.array_distinct(F.arrays_zip(*[F.regexp_extract_all(t, F.lit(p), g).alias(n) for g, n in ((1, "color"), (2, "material"), (3, "shape"))]))


def teacher_steps(x, most: int = 4) -> Column:
    """ARRAY<STRUCT<entity, observation, frame>> of a teacher's lines ``entity | observation: ... | frame: n`` with any
    numbering or label before: entities of 1 to 80 characters, frames 0 to 15, the first ``most``."""
    group = lambda k: F.regexp_extract_all(_c(x), F.lit(TEACHER), k)
    found = F.arrays_zip(group(1).alias("e"), group(2).alias("o"), group(3).alias("f"))
    steps = F.transform(found, lambda s: F.struct(strip(F.btrim(strip(s["e"]), F.lit("."))).alias("entity"), strip(s["o"]).alias("observation"), s["f"].try_cast("int").alias("frame")))
    return F.slice(F.filter(steps, lambda s: s["frame"].between(0, 15) & F.length(s["entity"]).between(1, 80)), 1, most)


def gold_letters(flags) -> Column:
    """Letters of the options whose flag is set."""
    picked = F.filter(F.transform(_c(flags), lambda v, i: F.when(v, F.substring(F.lit("ABCDEFGH"), i + 1, F.lit(1)))), lambda c: c.isNotNull())
    return F.array_join(picked, "")
