"""Nested values: what is empty goes at any depth, JSON is held against a specification, contacts become one text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_list(c: Column) -> Column:
    """The distinct texts of an array in order, stripped, without null and blank ones; an empty array for null."""
    texts = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), stripped), lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(texts)


def drop_empty(c: Column, kind: T.DataType) -> Column:
    """A value of this type without what is empty, at any depth: texts are stripped, and blank ones, empty arrays, maps without
    values and structs without fields that say something become null; arrays and maps lose their null entries. to_json then leaves out
    the null fields. Numbers, flags and times stay. The expression is made from the type, so that nothing leaves the JVM."""
    if isinstance(kind, T.StringType):
        return F.nullif(stripped(c), F.lit(""))
    if isinstance(kind, T.ArrayType):
        kept = F.filter(F.transform(c, lambda x: drop_empty(x, kind.elementType)), lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, T.MapType):
        kept = F.map_filter(F.transform_values(c, lambda _, v: drop_empty(v, kind.valueType)), lambda _, v: v.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, T.StructType):
        fields = [drop_empty(c[f.name], f.dataType).alias(f.name) for f in kind]
        says = F.lit(False)
        for f in fields:
            says = says | f.isNotNull()
        return F.when(c.isNotNull() & says, F.struct(*fields))
    return c


class Maybe:
    """A specification that null meets too."""

    def __init__(self, spec):
        self.spec = spec


#: Types of a specification and their names in errors.
PLAIN = {str: "str", int: "int", float: "float", bool: "bool", dict: "dict", list: "list"}


def _is(kind: Column, plain: type) -> Column:
    """Whether a JSON value of this kind (as schema_of_variant names it) is of a type. A number is an int if it was written as one: such as
    don't fit into 64 bits are decimals without a fraction of 19 digits and more."""
    whole = (kind == "BIGINT") | F.coalesce(F.regexp_extract(kind, r"^DECIMAL\((\d+),0\)$", 1).try_cast("int") >= 19, F.lit(False))
    number = whole | F.startswith(kind, F.lit("DECIMAL")) | kind.isin("DOUBLE", "FLOAT")
    return {str: kind == "STRING", int: whole, float: number, bool: kind == "BOOLEAN", dict: F.startswith(kind, F.lit("OBJECT")), list: F.startswith(kind, F.lit("ARRAY"))}[plain]


def _errors(v: Column, path: Column, spec) -> Column:
    """Errors of a variant against a specification, as an array of texts."""
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    none = F.array().cast("array<string>")
    wrong = lambda what: F.array(F.concat(path, F.lit(f": must be {what}")))
    if isinstance(spec, Maybe):
        return F.when(kind == "VOID", none).otherwise(_errors(v, path, spec.spec))
    if isinstance(spec, tuple):  # literals
        text = F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
        fits = F.lit(False)
        for x in spec:
            fits = fits | (_is(kind, type(x)) & (text == (str(x).lower() if isinstance(x, bool) else str(x))))
        return F.when(fits, none).otherwise(wrong("one of " + ", ".join(sorted(map(str, spec)))))
    if isinstance(spec, list):
        each = F.flatten(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: _errors(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), spec[0])))
        return F.when(_is(kind, list), each).otherwise(wrong("list"))
    if isinstance(spec, dict):
        keys = F.coalesce(F.json_object_keys(F.try_variant_get(v, "$", "string")), none)
        at = lambda k: F.concat(path, F.lit("."), k)
        asked = F.array(*[F.lit(k) for k in sorted(spec)]).cast("array<string>")
        missing = F.transform(F.array_except(asked, keys), lambda k: F.concat(at(k), F.lit(": missing")))
        extra = F.transform(F.array_sort(F.array_except(keys, asked)), lambda k: F.concat(at(k), F.lit(": extra")))
        held = [F.when(F.array_contains(keys, k), _errors(F.try_variant_get(v, f"$['{k}']", "variant"), at(F.lit(k)), s)).otherwise(none) for k, s in spec.items()]
        return F.when(_is(kind, dict), F.concat(missing, extra, *held)).otherwise(wrong("dict"))
    return F.when(_is(kind, spec), none).otherwise(wrong(PLAIN[spec]))


def json_errors(text: Column, spec: dict) -> Column:
    """What is wrong with a JSON text, as an array of `path: error`; empty if nothing is, and [$: not JSON] for other texts and null.

    spec: a dict of exactly the keys that an object has, each with str, int, float, bool, dict, list, a tuple of literals, a list with the
    specification of its items, a dict, or Maybe of one of these. Missing keys come first, then extra ones, then the values in the order of the
    specification. A flag is no int, and 1.0 isn't one either."""
    v = F.try_parse_json(text)
    return F.when(v.isNull(), F.array(F.lit("$: not JSON"))).otherwise(_errors(v, F.lit("$"), spec))


# Headings of the sections of a contact's text.
HEADINGS = {
    "categories": "Geschaeftskategorien:",
    "keywords": "Suchanfragen fuer Kataloge:",
    "statuses": "Statusangaben:",
    "socials": "Soziale Netzwerke:",
    "company_names": "Weitere Unternehmensnamen:",
    "addresses": "Weitere Adressen:",
}


def contact_text(c: Column) -> Column:
    """What is known of a contact as one text of sections in a fixed order, parted by blank lines: name, address (with its state, unless
    that stands in it), categories, phones, descriptions, keywords, statuses, social networks, other names and other addresses (without the
    main ones). Empty sections have no heading; every list is without repeats. c: a struct with company_name, address, land, description_web,
    description (texts) and company_names, addresses, categories, keywords, statuses, phones, socials (arrays)."""
    one = lambda f: F.coalesce(stripped(c[f]), F.lit(""))
    name, land = one("company_name"), one("land")
    address = one("address")
    address = F.when((address != "") & (land != "") & ~F.contains(address, land), F.concat(address, F.lit(", "), land)).otherwise(address)

    def section(values: Column, heading: str | None) -> Column:
        lines = F.array_join(values, "\n")
        return F.when(F.size(values) > 0, lines if heading is None else F.concat(F.lit(heading + "\n"), lines))

    listed = lambda f, but=None: section(text_list(c[f]) if but is None else F.filter(text_list(c[f]), lambda x: x != but), HEADINGS.get(f))
    parts = [F.nullif(name, F.lit("")), F.nullif(address, F.lit("")), listed("categories"), listed("phones"), F.nullif(one("description_web"), F.lit("")), F.nullif(one("description"), F.lit(""))]
    parts += [listed("keywords"), listed("statuses"), listed("socials"), listed("company_names", name), listed("addresses", address)]
    return stripped(F.concat_ws("\n\n", *parts))
