"""Keys, labels and text forms as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what an empty list is shown as.
EMPTY = "∅"


def _marked(text: Column) -> Column:
    """A field that no separator or missing value can pass for another."""
    for mark in ("\\", ";", "="):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return F.coalesce(text, F.lit("\\N"))


def digest(params: Column, length: int = 10) -> Column:
    """Order-independent short digest of a ``map<string,string>``.

    Separators inside a key or value are escaped and a null value is a value of its own, so different sets have different
    texts. A null map has no digest.
    """
    pairs = F.transform(F.array_sort(F.map_keys(params)),
                        lambda key: F.concat(_marked(key), F.lit("="), _marked(F.element_at(params, key))))
    return F.substring(F.sha2(F.array_join(pairs, ";"), 256), 1, length)


def trial_label(*parts: Column) -> Column:
    return F.concat_ws("__", *parts)


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``; null where it does not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def tuple_parts(text: Column) -> Column:
    """Fields of a tuple written as text, blanks and parentheses removed."""
    return F.filter(F.split(F.regexp_replace(text, r"[()\s]", ""), ","), lambda x: x != "")


def tuple_text(text: Column) -> Column:
    """Canonical spelling ``(5, 4)``; a single field keeps the comma."""
    parts = tuple_parts(text)
    return F.concat(F.lit("("), F.concat_ws(", ", parts),
                    F.when(F.size(parts) == 1, ",").otherwise(""), F.lit(")"))


def tuple_order(text: Column) -> Column:
    """Sortable form: non-negative integers of any length compare as numbers.

    Each field, leading zeros removed, stands behind its length.
    """
    def field(x: Column) -> Column:
        short = F.regexp_replace(x, r"^0+(?=.)", "")
        return F.concat(F.lpad(F.length(short).cast("string"), 10, "0"), short)

    return F.concat_ws(",", F.transform(tuple_parts(text), field))


def field_label(fields: Mapping[str, Column]) -> Column:
    return F.concat_ws(" – ", *[F.concat(F.lit(name[:1].upper() + name[1:] + ": "),
                                         value.cast("string")) for name, value in fields.items()])


def slug(values: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(", ", values), F.lit("")), F.lit(EMPTY))


def param_text(
    params: Mapping[str, Column], include: Sequence[str] = (), exclude: Sequence[str] = (),
) -> Column:
    """``name=value`` list; a dotted name keeps its last part."""
    names = [n for n in params if (not include or n in include) and n not in exclude]
    return F.concat_ws(", ", *[F.concat(F.lit(n.rsplit(".", 1)[-1] + "="),
                                        params[n].cast("string")) for n in names])


def model_name(root: Column, subs: Column) -> Column:
    return F.concat(root, F.when(F.size(subs) > 0, F.concat(
        F.lit("["), F.concat_ws(",", subs), F.lit("]"))).otherwise(""))


def init_key(reason: Column) -> Column:
    return extract(reason, r"Init params: (.*)")


def outcome_class(outcome: Column) -> Column:
    text = F.lower(outcome)
    return (F.when(text.rlike("not ?converged"), "Not converged")
            .when(text.contains("converged"), "Converged")
            .when(text.contains("failed"), "Failed")
            .otherwise(outcome))


def first_line(text: Column) -> Column:
    return F.element_at(F.split(text, "\n"), 1)


def duration_text(seconds: Column) -> Column:
    """``1D 02h 03m 04s``; leading zero parts are left out, zero is ``00s``."""
    s = seconds.cast("long")
    days, hours = F.floor(s / 86400), F.floor(s % 86400 / 3600)
    minutes, rest = F.floor(s % 3600 / 60), s % 60
    return F.concat_ws(
        " ",
        F.when(days > 0, F.format_string("%dD", days)),
        F.when(s >= 3600, F.format_string("%02dh", hours)),
        F.when(s >= 60, F.format_string("%02dm", minutes)),
        F.format_string("%02ds", rest))


def component_name(history: Column, index: Column) -> Column:
    """``rates_01``; comma separated once any index has two digits."""
    digits = F.transform(index, lambda i: i.cast("string"))
    joined = F.when(F.exists(index, lambda i: i > 9), F.concat_ws(",", digits)).otherwise(
        F.concat_ws("", digits))
    return F.when(F.size(index) == 0, history).otherwise(F.concat(history, F.lit("_"), joined))
