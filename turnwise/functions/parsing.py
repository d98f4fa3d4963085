"""Expressions that read model responses: QA pairs out of JSON replies, scores out of judge replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions import fixed
from turnwise.functions.text import strip

QA_PAIRS_TYPE = "array<struct<question:string,answer:string>>"

_JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}
_NUMBER = r"(?i)^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?\z"
_INFINITE = r"(?i)^\+?inf(inity)?\z"
_MINUS_INFINITE = r"(?i)^-inf(inity)?\z"
_NAN = r"(?i)^[+-]?nan\z"


def _json_object(text: Column, fields: str) -> Column:
    """Read ``text`` as one JSON object of the given type; null unless the whole text is that object.

    ``from_json`` stops reading at the end of the first value. Inside brackets, text after the object is an error
    or a second element, and inside a field it is an error, so only a text that passes both is a single object.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{fields}>", _JSON_OPTIONS)
    field = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"v {fields}", _JSON_OPTIONS).getField("v")
    starts = text.rlike(r"^[ \t\r\n]*\{")
    return F.when(starts & (F.size(listed) == 1) & F.get(listed, F.lit(0)).isNotNull(), field)


def _is_object(text: Column) -> Column:
    return F.coalesce(_json_object(text, "map<string,string>").isNotNull(), F.lit(False))


def _is_array(text: Column) -> Column:
    """True if the whole text is one JSON array."""
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<array<string>>", _JSON_OPTIONS)
    field = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v array<string>", _JSON_OPTIONS).getField("v")
    starts = text.rlike(r"^[ \t\r\n]*\[")
    return F.coalesce(starts & (F.size(listed) == 1) & field.isNotNull(), F.lit(False))


def without_fences(text: Column) -> Column:
    return strip(F.regexp_replace(text, fixed.CODE_FENCE, ""))


def qa_json(text: Column) -> Column:
    """The JSON object a QA response holds, as text: all of it, all but code fences, or from the first ``{`` to
    the last ``}``. Null if there is none, or if the response is an array."""
    bare = without_fences(text)
    block = F.regexp_extract(text, fixed.JSON_BLOCK, 0)
    return (
        F.when(_is_object(text), text)
        .when(_is_array(text), F.lit(None))
        .when(_is_object(bare), bare)
        .when(_is_array(bare), F.lit(None))
        .when(_is_object(block), block)
    )


def qa_pairs(json: Column) -> Column:
    """The pairs in a JSON object found by ``qa_json``: empty if the key is missing, null if its value is null."""
    fields = F.from_json(json, "map<string,string>", _JSON_OPTIONS)
    typed = F.from_json(json, f"qa_pairs {QA_PAIRS_TYPE}", _JSON_OPTIONS).getField("qa_pairs")
    return F.when(json.isNull(), F.lit(None)).when(
        ~F.map_contains_key(fields, "qa_pairs"), F.array().cast(QA_PAIRS_TYPE)
    ).otherwise(typed)


def _number(text: Column) -> Column:
    """A number written the way a float literal may be written; null for anything else."""
    text = strip(text)
    return (
        F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
        .when(text.rlike(_INFINITE), F.lit(float("inf")))
        .when(text.rlike(_MINUS_INFINITE), F.lit(float("-inf")))
        .when(text.rlike(_NAN), F.lit(float("nan")))
    )


def _score_field(text: Column) -> Column:
    """The ``score`` of a response that is one JSON object."""
    value = _json_object(text, "struct<score:string>").getField("score")
    flag = _json_object(text, "struct<score:boolean>").getField("score")
    # NaN and Infinity come back with quotes around them.
    bare = F.regexp_replace(value, r'^"([+-]?(?:NaN|Infinity))"\z', "$1")
    return F.coalesce(_number(bare), flag.cast("double"))


def extract_score(text: Column) -> Column:
    """The score in a judge response, 0.0 if there is none: a JSON score, a JSON score inside code fences, a
    ``"score"`` field anywhere, or the first number that stands alone if it is no more than ten."""
    field = F.nullif(F.regexp_extract(text, fixed.SCORE_FIELD, 1), F.lit("")).try_cast("double")
    bare = F.nullif(F.regexp_extract(text, fixed.BARE_NUMBER, 1), F.lit("")).try_cast("double")
    unfenced = without_fences(text)
    return F.coalesce(
        _score_field(text),
        F.when(unfenced != text, _score_field(unfenced)),
        field,
        F.when(bare <= fixed.MAX_SCORE, bare),
        F.lit(0.0),
    )


def clamp_score(score: Column) -> Column:
    return F.greatest(F.lit(fixed.MIN_SCORE), F.least(F.lit(fixed.MAX_SCORE), score))


def strip_prompt(generated: Column, prompt: Column) -> Column:
    """The answer in a generated text that repeats its prompt first."""
    return strip(F.substring(generated, F.length(prompt) + 1, F.length(generated)))
