"""String and JSON expressions: tokens, verdicts, thinking blocks, names, relation labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The relation labels, and their rank when several apply.
LABELS = ("IND", "EQV", "NSO", "OSN", "CON")
PRIORITY = ("CON", "OSN", "NSO", "EQV", "IND")


def tokens(c: Column) -> Column:
    """Lower-cased words between blanks."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def word_f1(a: Column, b: Column) -> Column:
    """F1 of the distinct words of two texts; 0 if either has none."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def jaccard(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 if both are empty."""
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return F.when(union == 0, F.lit(0.0)).otherwise(both / union)


def fence_free(c: Column) -> Column:
    """The inside of a fenced code block, else the trimmed text."""
    inner = F.regexp_extract(c, r"(?s)```[a-zA-Z]*\s*(.*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(F.trim(c))


def outer_braces(c: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def json_value(c: Column, path: str) -> Column:
    """A value of loosely written JSON: fenced, bare, or with words around it."""
    return F.coalesce(*[F.try_variant_get(F.try_parse_json(x), path, "string") for x in (fence_free(c), outer_braces(c))])


def response_text(c: Column) -> Column:
    """What a model said: of a JSON object the first of response, text and content that is not blank, else the text itself."""
    whole = F.try_parse_json(F.trim(c))
    picked = F.coalesce(*[F.nullif(F.trim(F.try_variant_get(whole, f"$.{k}", "string")), F.lit("")) for k in ("response", "text", "content")])
    return F.when(F.trim(c).startswith("{") & whole.isNotNull(), picked).otherwise(F.trim(c))


def only_memories(c: Column) -> Column:
    """Why an extraction's JSON is refused (no object, other keys, no list of strings); null if it is right."""
    whole = F.try_parse_json(fence_free(c))
    keys = F.json_object_keys(fence_free(c))
    listed = F.from_json(F.try_variant_get(whole, "$.memories", "string"), "array<string>", {"mode": "PERMISSIVE"})
    kinds = F.schema_of_variant(F.try_variant_get(whole, "$.memories", "variant"))
    return (
        F.when(keys.isNull(), "not a JSON object")
        .when(F.size(F.array_except(keys, F.array(F.lit("memories")))) > 0, "keys other than memories")
        .when(~F.array_contains(keys, "memories"), "no memories")
        .when(listed.isNull() | ~kinds.isin("ARRAY<STRING>", "ARRAY<VOID>"), "memories is not a list of strings")
    )


#: The tags that enclose thinking.
THINKING_TAGS = ("think", "thinking", "redacted_thinking")
_ANY_TAG = "(?:" + "|".join(THINKING_TAGS) + ")"


def thinking(c: Column) -> Column:
    """The bodies of all thinking blocks, blank ones left out, with empty lines between."""
    bodies = F.regexp_extract_all(c, F.lit(rf"(?is)<{_ANY_TAG}>(.*?)</{_ANY_TAG}>"), 1)
    return F.array_join(F.filter(F.transform(bodies, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), "\n\n")


def after_thinking(c: Column) -> Column:
    """What follows the last block; the whole text if there is none with a body."""
    rest = F.regexp_replace(c, rf"(?is)^.*</{_ANY_TAG}>", "")
    return F.regexp_replace(F.when(thinking(c) == "", c).otherwise(rest), r"^\s+|\s+$", "")


def verdict(c: Column) -> Column:
    """Whether a judge's text says yes: a named answer, else its last line, else its first word."""
    t = F.lower(after_thinking(c))
    named = F.regexp_extract(t, r"(final answer|answer)\s*[:\-]\s*(yes|no)\b", 2)
    last = F.regexp_extract(F.regexp_replace(t, r"\s+$", ""), r"(?:^|\n)[ \t]*(yes|no)[.!\s]*$", 1)
    return F.when(named != "", named == "yes").when(last != "", last == "yes").otherwise(t.startswith("yes"))


def relation_strict(c: Column) -> Column:
    """The label of a JSON answer; anything else is IND."""
    label = F.upper(F.trim(json_value(c, "$.relation")))
    return F.when(label.isin(*LABELS), label).otherwise("IND")


def relation_loose(c: Column) -> Column:
    """The label of a JSON answer, else the first label (in their order) that the text holds, else IND."""
    label = F.upper(F.trim(json_value(c, "$.relation")))
    held = F.coalesce(*[F.when(F.contains(F.upper(c), F.lit(x)), F.lit(x)) for x in LABELS], F.lit("IND"))
    return F.when(label.isin(*LABELS), label).otherwise(held)


def relation_word(c: Column) -> Column:
    """The label of a JSON answer, else the first label that stands as a word, else PARSE_FAIL."""
    label = F.upper(F.trim(json_value(c, "$.relation")))
    word = F.regexp_extract(F.upper(c), rf"\b({'|'.join(LABELS)})\b", 1)
    return F.when(label.isin(*LABELS), label).when(word != "", word).otherwise("PARSE_FAIL")


def active(label: Column, labels: tuple[str, ...]) -> Column:
    """Labels that are not in use count as IND."""
    return F.when(label.isin(*labels), label).otherwise("IND")


def slug(c: Column) -> Column:
    """Lower-case letters, digits, dashes and underscores; ``x`` if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9_-]+", "-"), "-{2,}", "-")
    t = F.regexp_replace(t, "^[-_]+|[-_]+$", "")
    return F.when(t == "", F.lit("x")).otherwise(t)


def file_name(c: Column) -> Column:
    """A name without characters that file systems dislike."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def question_file(c: Column) -> Column:
    """The file name part of a question's id."""
    return F.regexp_replace(c, "^gpt4_", "gp_4_")


def aliased(c: Column, history: Column) -> Column:
    """Speakers named after their history, in text."""
    pairs = [("the user", "User_"), ("the assistant", "Asst_"), ("The user", "User_"), ("The assistant", "Asst_")]
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.concat(F.lit(p[1]), history)), pairs, c)


def leaks(answer: Column, correct: Column) -> Column:
    """Whether a text gives away an answer of more than three characters."""
    return (F.length(F.trim(correct)) > 3) & F.contains(F.lower(answer), F.lower(F.trim(correct)))


def about_user(c: Column) -> Column:
    """A fact long enough that starts with its subject."""
    return (F.length(c) >= 12) & c.startswith("The user")


def role(c: Column) -> Column:
    """user for people, assistant for all else."""
    return F.when(F.lower(c).isin("user", "human"), "user").otherwise("assistant")


def lines(c: Column) -> Column:
    """Trimmed lines that are not blank; the whole text if there is none."""
    found = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(c))
