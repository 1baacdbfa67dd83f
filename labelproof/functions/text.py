"""String, path, label and JSON expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_slug(text: Column) -> Column:
    """Runs of characters outside ``A-Za-z0-9._-`` become ``_``; outer ``_`` go."""
    return F.btrim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def lower_slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def entity_key(text: Column) -> Column:
    """Comparison key: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def display_label(label: Column) -> Column:
    """``sans_serif`` -> ``Sans serif``."""
    spaced = F.lower(F.replace(label, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.left(spaced, F.lit(1))), F.substring(spaced, 2, 2**30))


def title_label(label: Column) -> Column:
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def first_match(text: Column, pattern: str) -> Column:
    """First group of the first match, empty text when there is none."""
    return F.coalesce(F.regexp_extract(text, pattern, 1), F.lit(""))


def every_match(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def metadata_fields(text: Column) -> Column:
    """Fields of a text-format metadata record as a struct."""
    single = {f: first_match(text, rf'(?m)^{key}:\s*"([^"]+)"') for f, key in (("name", "name"), ("category", "category"), ("license", "license"))}
    repeated = {f: every_match(text, rf'{key}:\s*"([^"]+)"') for f, key in (("filenames", "filename"), ("subsets", "subsets"))}
    return F.struct(*[c.alias(n) for n, c in {**single, **repeated}.items()])


def preferred_name(names: Column, allowed: str, preferred: Sequence[str], avoid: str) -> Column:
    """Pick one name: by the first preferred suffix that occurs, else the first without ``avoid``, else the first.

    ``allowed`` is a pattern a name must match at all; null when none does.
    """
    usable = F.filter(names, lambda n: F.lower(n).rlike(allowed))

    def first_of(array: Column) -> Column:
        return F.try_element_at(array, F.lit(1))

    def ending(suffix: str):
        return lambda n: n.endswith(suffix)

    picks = [first_of(F.filter(usable, ending(s))) for s in preferred]
    plain = first_of(F.filter(usable, lambda n: ~F.lower(n).contains(avoid)))
    return F.coalesce(*picks, plain, first_of(usable))


def json_problem(text: Column, fields: Sequence[str]) -> Column:
    """Why a JSON text cannot be expanded; empty text when it can. A null value keeps its key."""
    present = F.json_object_keys(text)
    missing = F.array_sort(F.array_except(F.array(*[F.lit(f) for f in fields]), present))
    return (
        F.when(text.isNull() | present.isNull(), "invalid JSON")
        .when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ",")))
        .otherwise("")
    )


def parse_struct(text: Column, schema: T.StructType) -> Column:
    return F.from_json(text, schema)


def signature(struct: Column, fields: Sequence[str]) -> Column:
    """Chosen fields as JSON with sorted keys and explicit nulls."""
    return F.to_json(F.struct(*[struct[f].alias(f) for f in sorted(fields)]), {"ignoreNullFields": "false"})


def resolve_path(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def portable_path(path: Column, root: str) -> Column:
    """Path relative to root when it lies inside, otherwise unchanged."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**30)).otherwise(path)


def range_label(low: Column, high: Column) -> Column:
    return F.format_string("%.1f–%.1f", low, high)


def size_label(width: Column, height: Column) -> Column:
    return F.concat_ws("x", width.cast("string"), height.cast("string"))


def lenient_time(text: Column) -> Column:
    """Timestamp or null; bad text is not an error."""
    return text.try_cast("timestamp_ntz")


def markdown_cell(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "|\n", "/ ")
