"""JSON, key/value and vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(c: Column) -> Column:
    """JSON text as a variant, null where it isn't JSON; parse once, then take paths with the functions below."""
    return F.try_parse_json(c)


def variant_double(v: Column, path: str, default: float | None = None) -> Column:
    """A number at a path of a variant; the default for a missing path or another kind of value."""
    found = F.try_variant_get(v, path, "double")
    return found if default is None else F.coalesce(found, F.lit(default))


def variant_length(v: Column, path: str) -> Column:
    """How many elements the array at a path has; 0 where there is none."""
    return F.coalesce(F.size(F.try_variant_get(v, path, "array<variant>")), F.lit(0))


def json_double(c: Column, path: str, default: float = 0.0) -> Column:
    """A number at a JSON path; the default for bad JSON, a missing path or another kind of value."""
    return variant_double(parsed(c), path, default)


def json_length(c: Column, path: str) -> Column:
    return variant_length(parsed(c), path)


def json_or_empty(c: Column) -> Column:
    """The text if it holds a JSON object, else {}."""
    return F.when(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), c).otherwise(F.lit("{}"))


def json_merge(left: Column, right: Column, depth: int = 4) -> Column:
    """Two JSON objects as one, the right one's values first; objects under one key are merged in turn, down to depth.

    Lists and other values are replaced whole; what isn't an object counts as an empty one.
    """
    return F.to_json(variant_merge(parsed(left), parsed(right), depth))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _fields(v: Column) -> Column:
    """An object's values by key; none of anything else."""
    return F.when(_is_object(v), v.cast("map<string,variant>")).otherwise(F.create_map().cast("map<string,variant>"))


def variant_merge(own: Column, other: Column, depth: int = 4) -> Column:
    """json_merge of two variants, as a variant: each is taken apart once a level, nothing is written as text between."""

    def merged(pair: Column) -> Column:
        def value(k: Column) -> Column:
            x, y = F.try_element_at(pair["a"], k), F.try_element_at(pair["b"], k)
            plain = F.when(F.map_contains_key(pair["b"], k), y).otherwise(x)
            return plain if depth <= 1 else F.when(_is_object(x) & _is_object(y), variant_merge(x, y, depth - 1)).otherwise(plain)

        keys = F.array_union(F.map_keys(pair["a"]), F.map_keys(pair["b"]))
        return F.to_variant_object(F.map_from_arrays(keys, F.transform(keys, value)))

    # An array of one pair gives the lambda what each side holds, so neither is taken apart for every key.
    both = F.array(F.struct(_fields(own).alias("a"), _fields(other).alias("b")))
    return F.element_at(F.transform(both, merged), 1)


def first_json(c: Column) -> Column:
    """The widest {...} in a text, if it is JSON."""
    block = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(block).isNotNull() & (block != ""), block)


def vector(c: Column) -> Column:
    return F.from_json(c, "array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length, without values, of length zero or not finite."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0) & (norm < float("inf")), dot(a, b) / norm), F.lit(0.0))


def chunks(c: Column, size: int = 800) -> Column:
    """Pieces of the trimmed text, one after the other; none for blank text."""
    text = F.trim(c)
    count = F.ceil(F.length(text) / size).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def key_share(c: Column, keys: list[str]) -> Column:
    """Share of the expected keys that hold a value, to three decimals."""
    found = [F.when(F.coalesce(F.get_json_object(c, f"$.{k}") != "", F.lit(False)), 1).otherwise(0) for k in keys]
    return F.round(sum(found[1:], found[0]) / len(keys), 3)


def moving_success(events: Column, alpha: float = 0.2) -> Column:
    """Exponential mean over ordered (at, success) structs: s becomes (1 - alpha) * s + alpha * x; starts at the first."""
    ordered = F.transform(F.array_sort(events), lambda e: e["success"].cast("double"))
    return F.aggregate(F.slice(ordered, 2, F.greatest(F.lit(0), F.size(ordered) - 1)), F.try_element_at(ordered, F.lit(1)), lambda s, x: (1 - alpha) * s + alpha * x)
