"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as blank, the white space of Unicode and the separators 0x1C to 0x1F.
_BLANK = r"(?U)\A[\s\x1c-\x1f]*\z"
_GAP = r"(?U)[\s\x1c-\x1f]+"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(as_column(text), 256)


def key(namespace: str, text: Column | str) -> Column:
    return F.concat_ws("-", F.lit(namespace), content_hash(text))


def is_blank(text: Column | str) -> Column:
    return as_column(text).rlike(_BLANK)


def one_line(text: Column | str) -> Column:
    return F.replace(as_column(text), F.lit("\n"), F.lit(" "))


def label(text: Column | str) -> Column:
    """A node's label: line ends become spaces; from 8 characters on, the first 8 and an ellipsis."""
    line = one_line(text)
    return F.when(F.char_length(line) < 8, line).otherwise(F.concat(F.substring(line, 1, 8), F.lit("...")))


def triple_text(subj: Column | str, pred: Column | str, obj: Column | str) -> Column:
    """A relation's text, the input of its hash and its embedding."""
    return F.concat(F.lit("('"), F.concat_ws("', '", as_column(subj), as_column(pred), as_column(obj)), F.lit("')"))


def parse_triple_text(text: Column | str) -> Column:
    """The parts of a relation's text, for tables that hold nothing else."""
    t = as_column(text)
    return F.split(F.substring(t, F.lit(3), F.char_length(t) - 4), "', '", -1)


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(as_column(text), _GAP, -1), lambda w: w != ""))


def json_list_slice(answer: Column | str) -> Column:
    """From the first [ on, and up to the last ]; either is optional."""
    a = as_column(answer)
    start = F.instr(a, "[")
    a = F.when(start > 0, F.substring(a, start, F.char_length(a))).otherwise(a)
    back = F.instr(F.reverse(a), "]")
    return F.when(back > 0, F.substring(a, F.lit(1), F.char_length(a) - back + 1)).otherwise(a)


def split_reasoning(answer: Column | str) -> Column:
    """struct(reasoning, content) of a model's answer; reasoning is null unless there is exactly one end mark after the last start mark."""
    last = F.element_at(F.split(as_column(answer), "<think>", -1), -1)
    parts = F.split(last, "</think>", -1)
    two = F.size(parts) == 2
    return F.struct(F.when(two, parts[0]).alias("reasoning"), F.when(two, parts[1]).otherwise(parts[0]).alias("content"))


def typed(value: Column | str, kind: Column | str) -> Column:
    """struct(int, float, str): an attribute's text in the column of its declared type."""
    v, k = as_column(value), as_column(kind)
    return F.struct(
        F.when(k == "int", v.try_cast("bigint")).alias("int"),
        F.when(k == "float", v.try_cast("double")).alias("float"),
        F.when(~k.isin("int", "float"), v).alias("str"),
    )


def weight(value: Column | str) -> Column:
    return F.coalesce(as_column(value).cast("double"), F.lit(0.0))
