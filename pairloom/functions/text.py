"""Text functions of the pair pipeline, as Column expressions (no Python at run time)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attribute order of a serialized record, and the words that mean missing.
ATTRIBUTES = ("title", "brand", "description", "price", "priceCurrency")
MISSING_WORDS = ("nan", "none", "null")
MISSING_TEXT = "<missing>"
TASK_LINE = "Task: decide whether Record A and Record B refer to the same real-world entity."
RECORD_B_MARK = "\n\nRecord B:\n"
RECORD_A_MARK = "\n\nRecord A:\n"
#: Spellings of the two labels.
MATCH_WORDS = ("1", "true", "match")
NON_MATCH_WORDS = ("0", "false", "non-match", "non_match", "no match")
#: Lines of the answer-only prompt around pair_id and the serialized pair.
PROMPT_HEAD = (
    "Task: decide whether Record A and Record B refer to the same real-world product.",
    "",
    "Return exactly one of these labels:",
    "- match: the two records refer to the same real-world product.",
    "- non_match: the two records refer to different real-world products.",
    "",
    "Do not explain your answer. Do not output JSON. Do not add punctuation.",
)


def _nothing() -> Column:
    return F.lit(None).cast("string")


def strip(text: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(value: Column) -> Column:
    """Stripped text; blank texts and words for missing become null."""
    bare = strip(value.cast("string"))
    return F.when((bare == "") | F.lower(bare).isin(*MISSING_WORDS), _nothing()).otherwise(bare)


def attribute(record: Column, name: str) -> Column:
    """An attribute of a record, "" where it is missing."""
    return F.coalesce(record["attributes"][name], F.lit(""))


def word_tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 in the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def model_tokens(text: Column) -> Column:
    """Distinct lower-cased tokens of three characters or more with a digit at or after them in their line."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?iud)(?=.*\p{Nd})[a-z0-9][a-z0-9._-]{2,}"), F.lit(0)), F.lower))


def jaccard(left: Column, right: Column) -> Column:
    """Size of intersection over union of two sets (arrays of different values); 0.0 for two empty ones."""
    both = F.size(F.array_intersect(left, right))
    return F.coalesce(F.try_divide(both, F.size(left) + F.size(right) - both), F.lit(0.0))


def price(text: Column) -> Column:
    """A price as double; a lone comma is a decimal point, else commas are dropped; null if unreadable."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9.,-]", "")
    plain = F.when(kept.contains(",") & ~kept.contains("."), F.replace(kept, F.lit(","), F.lit("."))).otherwise(F.replace(kept, F.lit(","), F.lit("")))
    number = plain.try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def record_lines(record: Column, name: str, order: Sequence[str] = ATTRIBUTES, missing: str = MISSING_TEXT) -> Column:
    """A record as text lines: known attributes in order, further ones by name."""
    line = lambda key, value: F.concat(F.lit("- "), key, F.lit(": "), F.coalesce(F.nullif(value, F.lit("")), F.lit(missing)))
    known = F.array(F.lit(f"Record {name}:"), *[line(F.lit(k), record["attributes"][k]) for k in order])
    more = F.array_sort(F.array_except(F.map_keys(record["attributes"]), F.array(*[F.lit(k) for k in order])))
    return F.array_join(F.concat(known, F.transform(more, lambda k: line(k, record["attributes"][k]))), "\n")


def input_text(record_a: Column, record_b: Column) -> Column:
    return input_of_lines(record_lines(record_a, "A"), record_lines(record_b, "B"))


def input_of_lines(lines_a: Column, lines_b: Column) -> Column:
    """``input_text`` of records whose lines are made."""
    return F.concat_ws("\n\n", F.lit(TASK_LINE), lines_a, lines_b)


def preview(text: Column, most: int = 1200) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def answer_label(answer: Column, usual: Sequence[str] = ()) -> Column:
    """match or non_match of a strict answer; null for anything else.

    Answers spelled as ``usual`` are parsed when Spark folds constants, and only compared in the rows.
    """
    if usual:
        told = [(answer == u, answer_label(F.lit(u))) for u in usual]
        return reduce(lambda c, x: c.when(*x), told[1:], F.when(*told[0])).otherwise(answer_label(answer))
    bare = F.lower(strip(answer))
    inner = F.regexp_extract(bare, r"^([\"'`])([\s\S]*)\1$", 2)
    quoted = bare.rlike(r"^([\"'`])[\s\S]*\1$") & (F.length(bare) >= 2)
    word = F.when(quoted, strip(inner)).otherwise(bare)
    return F.when(word == "match", "match").when(word.isin("non_match", "non-match"), "non_match")


def decision(text: Column, depth: int = 3) -> Column:
    """True for match, False for non-match, null if unreadable; JSON decisions nest up to ``depth`` times."""
    bare = F.lower(strip(text))
    marked = F.regexp_extract(bare, r"\[\[decision\]\]\s*(non-match|non match|no match|match)\b", 1)
    first = strip(F.element_at(F.split(bare, r"\r\n|[\n\r\u000b\f\u001c-\u001e\u0085\u2028\u2029]"), 1))
    no = F.lit(False)
    read = (
        F.when(bare == "", F.lit(None).cast("boolean"))
        .when(marked != "", marked == "match")
        .when(first.startswith("non-match") | first.startswith("non match") | first.startswith("no match"), no)
        .when(first.startswith("match"), ~no)
        .when(bare.contains('"decision": "non-match"') | bare.contains("'decision': 'non-match'"), no)
        .when(bare.contains('"decision": "match"') | bare.contains("'decision': 'match'"), ~no)
    )
    if depth == 0:
        return read
    # A text that is JSON as a whole is read by its key, also where the key has no value.
    # In brackets, as the parser overlooks what follows a whole value.
    listed = F.concat(F.lit("["), bare, F.lit("]"))
    whole = F.try_parse_json(listed).isNotNull() & (F.json_array_length(listed) == 1)
    keyed = bare.startswith("{") & whole & F.array_contains(F.json_object_keys(bare), "decision")
    nested = F.coalesce(F.get_json_object(bare, "$.decision"), F.lit("none"))
    return F.when(F.coalesce(keyed, no), decision(nested, depth - 1)).otherwise(read)


def prompt(pair_id: Column, text: Column) -> Column:
    """The answer-only prompt; the gold label is never part of it."""
    head = "\n".join(PROMPT_HEAD)
    return F.concat(F.lit(f"{head}\npair_id: "), pair_id, F.lit("\n\nserialized_pair:\n"), text, F.lit("\n\nlabel:"))


def _label(value: Column, yes: str, no: str, otherwise: Column) -> Column:
    bare = F.lower(strip(value.cast("string")))
    return F.when(bare.isin(*MATCH_WORDS), yes).when(bare.isin(*NON_MATCH_WORDS), no).when(value.isNull(), no).otherwise(otherwise)


def _refused(value: Column) -> Column:
    return F.raise_error(F.concat(F.lit("Unsupported label value: "), value.cast("string"))).cast("string")


def canonical_label(value: Column, strict: bool = True) -> Column:
    """match or non_match of any usual spelling; an error otherwise, or null if not strict."""
    return _label(value, "match", "non_match", _refused(value) if strict else _nothing())


def gold_label(target_label: Column, label: Column) -> Column:
    return canonical_label(F.coalesce(target_label, label.cast("string")))


def target_text(label: Column) -> Column:
    """A cache label in the vocabulary of training targets."""
    return F.when(label == "match", "match").otherwise("non-match")


def gold_target(target_label: Column, label: Column) -> Column:
    """The target text if it is one, else from the label."""
    told, words = F.lower(strip(target_label)), ("match", "non-match")
    # A target as it is written needs no parsing.
    return F.when(target_label.isin(*words), target_label).when(told.isin(*words), told).otherwise(_label(label, "match", "non-match", _refused(label)))


def class_id(target: Column, classes: Mapping[str, int]) -> Column:
    """Number of a class; underscores count as hyphens."""
    known = F.create_map(*[x for k, v in classes.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(known, F.replace(F.lower(strip(target)), F.lit("_"), F.lit("-")))


def label_flag(label: Column) -> Column:
    return _label(label, "t", "f", _refused(label)) == "t"


def split_input(text: Column) -> tuple[Column, Column]:
    """The two segments of a serialized pair; the mark stays with the second. Null if there is no mark."""
    at = F.instr(text, RECORD_B_MARK)
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1)), F.when(at > 0, F.substr(text, at + 2))


def record_bodies(text: Column) -> tuple[Column, Column]:
    """What follows the marks of record A and of record B."""
    a, b = F.instr(text, RECORD_A_MARK), F.instr(text, RECORD_B_MARK)
    start = a + len(RECORD_A_MARK)
    return F.when((a > 0) & (b > 0), F.substr(text, start, b - start)), F.when((a > 0) & (b > 0), F.substr(text, b + len(RECORD_B_MARK)))


def segments_of_lines(lines_a: Column, lines_b: Column) -> dict[str, Column]:
    """``split_input`` and ``record_bodies`` of the text of records whose lines are made: nothing is searched. Not for lines that hide a mark (``hides_mark``)."""
    body = lambda lines, name: F.substr(lines, F.lit(len(f"Record {name}:\n") + 1))
    return {"first_segment": F.concat_ws("\n\n", F.lit(TASK_LINE), lines_a), "second_segment": lines_b, "body_a": body(lines_a, "A"), "body_b": body(lines_b, "B")}


def hides_mark(lines_a: Column) -> Column:
    """Whether the mark of record B may come before its place: in the lines of record A, or over their end."""
    return lines_a.contains(RECORD_B_MARK.rstrip("\n"))


def instruct_text(instruction: str, query: Column, document: Column) -> Column:
    told = [F.coalesce(x, F.lit("null")) for x in (query, document)]
    return F.concat(F.lit(f"<Instruct>: {instruction}\n<Query>: "), told[0], F.lit("\n<Document>: "), told[1])


def slug(text: Column) -> Column:
    """Lower case, with one hyphen for each run of other characters."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))


def budget_of(path: Column) -> Column:
    """The budget in the name of a training file, such as 128 or full."""
    found = F.regexp_extract(F.substring_index(path, "/", -1), r"train_([A-Za-z0-9]+)", 1)
    return F.when(found != "", found)


def strategy_of(path: Column) -> Column:
    """How the pairs of a training file were chosen: random in the folder of small budgets, else what its name says."""
    name = F.substring_index(path, "/", -1)
    said = F.regexp_extract(name, r"train_[A-Za-z0-9]+\.([A-Za-z0-9_]+)\.jsonl$", 1)
    return F.when(F.try_element_at(F.split(path, "/"), F.lit(-2)).eqNullSafe("low_label") & name.startswith("train_"), "random").when(said != "", said)


def message_text(content: Column) -> Column:
    """A message's JSON content as text: a string, or the texts of its parts."""
    parts = F.from_json(content, "array<struct<text:string>>")
    text = F.from_json(F.concat(F.lit('{"v":'), content, F.lit("}")), "struct<v:string>")["v"]
    return F.when(content.startswith("["), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")).otherwise(F.coalesce(text, F.lit("")))


def first_key(document: Column, names: Sequence[str]) -> Column:
    """The first of several keys of a JSON document that has a value."""
    return F.coalesce(*[F.get_json_object(document, f"$.{n}") for n in names])


def carried(row_map: Column, prefix: str = "selection_") -> Column:
    """The entries of a map whose keys have the prefix and whose values are not null."""
    return F.map_filter(row_map, lambda k, v: k.startswith(prefix) & v.isNotNull())


def round6(x: Column) -> Column:
    """Six decimals, halves up; the same in every engine for x >= 0."""
    return F.floor(x * 1000000 + 0.5) / 1000000
