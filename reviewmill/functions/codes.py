"""Category codes, names and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reviewmill.fixed_values import CATEGORY_CODES, CATEGORY_LABELS, CATEGORY_NAMES


def _lookup(key: Column, table: dict) -> Column:
    result = None
    for known, value in table.items():
        result = (F if result is None else result).when(key == F.lit(known), F.lit(value))
    return result


def category_name(code: Column) -> Column:
    """Code to name; a missing code is "other", an unknown code stays NULL."""
    return F.when(code.isNull(), F.lit("other")).otherwise(_lookup(code, CATEGORY_NAMES))


def category_label(code: Column) -> Column:
    """Code to Danish label."""
    return _lookup(code, CATEGORY_LABELS)


def category_code(name: Column) -> Column:
    """English name or Danish label to code, ignoring case and outer spaces."""
    table = {name.lower(): code for name, code in CATEGORY_CODES.items()}
    table.update({label.lower(): code for code, label in CATEGORY_LABELS.items() if label})
    return _lookup(F.lower(F.trim(name)), table)


def category_codes(names) -> list[int]:
    """Codes of a request's category names; codes pass through, unknown names raise."""
    table = {name.lower(): code for name, code in CATEGORY_CODES.items()}
    table.update({label.lower(): code for code, label in CATEGORY_LABELS.items() if label})
    codes = []
    for name in names:
        if isinstance(name, int):
            codes.append(name)
        elif name.strip().lower() in table:
            codes.append(table[name.strip().lower()])
        else:
            raise ValueError(f"Unknown category: {name}")
    return codes
