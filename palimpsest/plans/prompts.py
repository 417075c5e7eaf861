"""Prompts, in our own words, as templates for ``str.format`` and as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

RELATION = """Compare an OLD and a NEW fact about one person. Answer with JSON: {{"relation": label}}.
IND: neither follows from the other. EQV: each follows from the other.
OSN: the new one says all of the old one and more. NSO: the old one says all of the new one and more.
CON: both name a value of something that has one value at a time, and the values differ.
OLD: {old}
NEW: {new}"""
FUSE = {
    "CON": "The value changed. Write one fact that gives the values in order, the latest last.\nOLD: {old}\nNEW: {new}",
    "OSN": "The new fact is more specific. Write one fact with everything both say.\nOLD: {old}\nNEW: {new}",
    "NSO": "The old fact is more specific. Write one fact with everything both say.\nOLD: {old}\nNEW: {new}",
    "EQV": "Both say the same. Write it once; if it happened at different times, say how often.\nOLD: {old}\nNEW: {new}",
}
EXTRACT = 'List durable facts about the user in this dialogue, one statement each. Answer with JSON: {{"memories": [...]}}; the list may be empty.\nDialogue:\n{dialogue}'
#: Further passes over a chunk, by the names that ``extract.aspect_templates`` lists.
ASPECTS = {
    name: f'List {what} in this dialogue, one statement each. Answer with JSON: {{{{"memories": [...]}}}}; the list may be empty.\nDialogue:\n{{dialogue}}'
    for name, what in (
        ("events", "what the user did or plans to do, with its time,"),
        ("preferences", "what the user likes, dislikes or prefers"),
        ("people", "people and things that belong to the user's life, and how,"),
    )
}
OPERATIONS = 'Existing memories:\n{existing}\nNew facts:\n{facts}\nFor each, decide ADD, UPDATE, DELETE or NONE. Answer with JSON: {{"memory": [{{"id": ..., "event": ..., "text": ...}}]}}.'
UTILITY = 'How useful will this fact be later, from 0 to 1? Context:\n{context}\nFact: {fact}\nAnswer with JSON: {{"utility": x}}.'
BUNDLE = "Write these related statements as one, losing nothing.\n{lines}"
ANSWER = "Answer from these memories.\n\n{context}\n\n{question}"
GOLDEN = "List what this session says about the user that helps to answer the question, one statement each. Answer with JSON: {{\"memories\": [...]}}.\nQuestion: {question}\nAnswer: {answer}\nSession of {date}:\n{session}"
LOWER = "Say the same with other words, as unlike the question as you can, so that the answer still follows.\nQuestion: {question}\nAnswer: {answer}\nStatement: {text}"
DISTRACT = "Write one statement about the user that is on the question's subject but does not give its answer. It starts with 'The user'.\nQuestion: {question}\nAnswer: {answer}\nRound: {round}"
JUDGE = "Question: {question}\nReference: {reference}\nAnswer: {answer}\nDoes the answer agree with the reference? Reason step by step, then end with 'Final answer: yes' or 'Final answer: no'."
JUDGE_BRIEF = "Question: {question}\nReference: {reference}\nAnswer: {answer}\nDoes the answer agree with the reference? Say only 'yes' or 'no'."


def relation(old: str, new: str) -> str:
    return RELATION.format(old=old, new=new)


def fuse(label: str, old: str, new: str) -> str:
    """The prompt of a relation; a label without one is an error."""
    if label not in FUSE:
        raise ValueError(f"no fusion for relation {label!r}")
    return FUSE[label].format(old=old, new=new)


def rendered(template: str, **columns: Column) -> Column:
    """A template over columns."""
    parts = []
    for said, name, _, _ in string.Formatter().parse(template):
        parts += [F.lit(said)] if said else []
        parts += [F.coalesce(columns[name], F.lit(""))] if name else []
    return F.concat(*parts)


def bundle_lines(members: Column) -> Column:
    """Numbered lines of a bundle's members (structs text, edge, parent: the number of the line it hangs on)."""
    said = lambda m: F.coalesce(F.concat(m["edge"], F.lit(" of "), m["parent"].cast("string")), F.lit("PRIMARY"))
    return F.array_join(F.transform(members, lambda m, i: F.concat((i + 1).cast("string"), F.lit(". ["), said(m), F.lit("] "), m["text"])), "\n")


def judged_text(question: Column, reference: Column, model_answer: Column, hypothesis: Column, use_cot: bool = True) -> Column:
    """The judge's prompt; the model's answer, else the hypothesis. Question and reference are one line each."""
    line = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")
    return rendered(JUDGE if use_cot else JUDGE_BRIEF, question=line(question), reference=line(reference), answer=F.coalesce(model_answer, hypothesis))
