"""JSON out of free text: what may be JSON in it, as columns, and the first of it that parses.

Most answers are plain: objects, or arrays of objects and scalars, written as Python's json writes them. These are
told by a pattern and taken as they are; only texts that aren't are parsed. Answers become typed columns
by way of VARIANT, so that a field of another type is null beside its raw value.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import strip

#: A text within a code fence, up to its last fence; and what stands in brackets, first to last.
FENCED = r"(?s)\A```[^\n]*\n(.*)```.*\z"
BRACKETED = (r"(?s)(\[.*\])", r"(?s)(\{.*\})")
_SCALAR = r'(?:"[^"\\\x00-\x1f]*+"|-?(?:[1-9]\d{0,14}|0)(?:\.(?:0|\d{0,3}[1-9]))?+(?![\d.eE])|true|false|null)'
_OBJECT = rf'\{{(?:"[^"\\\x00-\x1f]*+": {_SCALAR}(?:, "[^"\\\x00-\x1f]*+": {_SCALAR})*+)?+\}}'
#: What is_plain() takes: -0 and numbers of over 15 digits are not as they are written.
PLAIN = rf"\A(?!.*[\[ ]-0(?![.\d]))(?:{_OBJECT}|\[(?:(?:{_OBJECT}|{_SCALAR})(?:, (?:{_OBJECT}|{_SCALAR}))*+)?+\])\z"


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _body(text: str | Column) -> Column:
    """What is looked at: a text without white space around it, or what stands in its code fence."""
    fenced = lambda w: F.when(F.startswith(w, F.lit("```")) & F.rlike(w, F.lit(FENCED)), strip(F.regexp_extract(w, FENCED, 1))).otherwise(w)
    return _once(strip(text), fenced)


def _parts(body: Column) -> Column:
    return F.filter(F.array(body, *[F.regexp_extract(body, p, 1) for p in BRACKETED]), lambda x: x != "")


def candidates(text: str | Column) -> Column:
    """The parts of a text that may be JSON, in the order in which they count; a null text has none."""
    return _once(_body(text), _parts)


def is_plain(text: str | Column) -> Column:
    """Whether a text is JSON just as json.dumps(..., ensure_ascii=False) writes it: an object of scalars, or an array of scalars and such objects, without escapes, exponents, long numbers or repeated keys."""
    text = F.col(text) if isinstance(text, str) else text
    objects = F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), 0)
    unique = F.forall(objects, lambda o: _once(F.regexp_extract_all(o, F.lit(r'"([^"]*)": '), 1), lambda keys: F.size(F.array_distinct(keys)) == F.size(keys)))
    # Braces within strings would cut objects elsewhere.
    return F.coalesce(F.rlike(text, F.lit(PLAIN)) & ~F.rlike(text, F.lit(r'"[^"]*[{}][^"]*"(?=[,:}\]])')) & unique, F.lit(False))


def _first_json(lists: pd.Series) -> pd.DataFrame:
    kinds, values = [], []
    for texts in lists:
        found = None
        for text in texts if texts is not None else ():
            try:
                found = json.loads(text)
                break
            except (json.JSONDecodeError, RecursionError):
                continue
        kinds.append({dict: "object", list: "array", type(None): "none"}.get(type(found), "scalar"))
        values.append(None if found is None else json.dumps(found, ensure_ascii=False))
    return pd.DataFrame({"kind": kinds, "value": values})


def _taken_or_parsed(lists: pd.Series) -> pd.DataFrame:
    """Of a list that starts with a text that text as it is, of one that starts with a null the first of the others that parses."""
    whole = np.array([x is not None and len(x) > 0 and x[0] is not None for x in lists], bool)
    out = pd.DataFrame({"kind": "none", "value": pd.Series([None] * len(lists), dtype=object)})
    first = [x[0] for x in lists[whole]]
    out.loc[whole, "value"] = first
    out.loc[whole, "kind"] = ["object" if x[0] == "{" else "array" for x in first]
    out.loc[~whole, ["kind", "value"]] = _first_json(pd.Series([None if x is None else x[1:] for x in lists[~whole]], dtype=object)).to_numpy()
    return out


def extract_json(text: str | Column) -> Column:
    """Struct of kind (object, array, scalar, none) and value (JSON text): the first candidate that is strict JSON."""
    judged = lambda b: F.when(is_plain(b), F.array(b)).otherwise(F.concat(F.array(F.lit(None).cast("string")), _parts(b)))
    return F.pandas_udf(_taken_or_parsed, "kind string, value string")(_once(_body(text), judged))


def typed_annotations(rows: DataFrame, value: str = "value") -> DataFrame:
    """rows with idx, line_start, line_end, annotation, raw: a row for each element of the JSON array in `value`.

    A line number counts if it is a whole number that fits an int, an annotation if it is a string; of another type,
    or missing, it is null. A range that ends before it starts has neither end. raw is the element as JSON, its keys in
    order. value is what extract_json() gives: of what isn't JSON as strict as that, Spark's parser takes more. Values
    that are null or no arrays have no rows, nor have empty arrays. Existing columns of these five names are replaced.
    """
    names = ("idx", "line_start", "line_end", "annotation", "raw")
    rest = [c for c in rows.columns if c.lower() not in names]
    own = next("_" * i + "e" for i in range(1, len(rest) + 2) if "_" * i + "e" not in {c.lower() for c in rest})
    items = F.try_variant_get(F.try_parse_json(F.col(value)), "$", "array<variant>")
    each = rows.select(*rest, F.posexplode(items).alias("idx", own))
    field = lambda name, kind: F.when(F.schema_of_variant(F.try_variant_get(own, f"$.{name}", "variant")) == {"int": "BIGINT", "string": "STRING"}[kind], F.try_variant_get(own, f"$.{name}", kind))
    typed = each.select(*rest, "idx", field("line_start", "int").alias("line_start"), field("line_end", "int").alias("line_end"), field("annotation", "string").alias("annotation"), F.to_json(own).alias("raw"))
    back = F.col("line_end") < F.col("line_start")
    return typed.withColumns({"line_start": F.when(~F.coalesce(back, F.lit(False)), F.col("line_start")), "line_end": F.when(~F.coalesce(back, F.lit(False)), F.col("line_end"))})


def accepted_overview(found: Column) -> Column:
    """An object that isn't empty."""
    return (found["kind"] == "object") & (found["value"] != "{}")


def accepted_annotations(found: Column) -> Column:
    return (found["kind"] == "array") & (found["value"] != "[]")
