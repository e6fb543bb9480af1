"""Typed answers of language models: what an answer has to look like, and where one first doesn't."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookspark.operators.model import unfenced
from bookspark.session import cut

#: Texts and numbers that are read as booleans.
TRUE = ("true", "t", "yes", "y", "on", "1")
FALSE = ("false", "f", "no", "n", "off", "0")


@dataclass(frozen=True)
class Text:
    """A string, of a closed vocabulary if one is given."""

    allowed: tuple[str, ...] = ()


@dataclass(frozen=True)
class Flag:
    """A boolean, or a text or number that is read as one."""


@dataclass(frozen=True)
class Many:
    """A list of values of a kind."""

    of: object


@dataclass(frozen=True)
class Again:
    """A record of the schema's name for it, at any depth."""

    name: str


@dataclass(frozen=True)
class Optional:
    """A field that may be missing, and then has the default; with `nullable` it may be null too."""

    of: object
    default: object = None
    nullable: bool = False


@dataclass(frozen=True)
class Record:
    """An object with fields; others are passed over."""

    fields: dict = field(hash=False)


@dataclass(frozen=True)
class Schema:
    """A record, and the named records that it comes back to."""

    root: Record
    named: dict = field(default_factory=dict, hash=False)


def _get(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _first(faults: list[Column]) -> Column:
    return F.coalesce(*faults) if len(faults) > 1 else faults[0] if faults else F.lit(None).cast("string")


def _missing(v: Column) -> Column:
    return v.isNull() | (F.schema_of_variant(v) == "VOID")


def fault(v: Column, path: Column, kind) -> Column:
    """The first fault of a variant, `path what`, in the order of the schema's fields and the lists' items; null if there is none.

    What lies below an Again is left to deeper().
    """
    say = lambda what: F.concat(path, F.lit(f" {what}"))
    shape = F.schema_of_variant(v)
    if isinstance(kind, Again):
        return F.lit(None).cast("string")
    if isinstance(kind, Optional):
        inner = fault(v, path, kind.of)
        absent = _missing(v) if kind.nullable else v.isNull()
        return F.when(~absent, inner)
    present = F.when(v.isNull(), say("is missing"))
    if isinstance(kind, Text):
        out = present.when(shape != "STRING", say("is not a string"))
        return out.when(~F.try_variant_get(v, "$", "string").isin(*kind.allowed), say("is not allowed")) if kind.allowed else out
    if isinstance(kind, Flag):
        return present.when(_flag(v).isNull(), say("is not a boolean"))
    if isinstance(kind, Many):
        inner = F.transform(_items(v), lambda x, i: fault(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), kind.of))
        return present.when(~shape.startswith("ARRAY"), say("is not a list")).otherwise(F.get(F.filter(inner, lambda x: x.isNotNull()), F.lit(0)))

    def below(n: str, k) -> Column:
        # a lambda reads each field once, and keeps the generated code small
        return F.get(F.transform(F.array(_get(v, n)), lambda x: fault(x, F.concat(path, F.lit(f".{n}")), k)), F.lit(0))

    return present.when(~shape.startswith("OBJECT"), say("is not an object")).otherwise(_first([below(n, k) for n, k in kind.fields.items()]))


_DEEPER = "array<struct<path string, ord array<int>, name string, v variant>>"


def deeper(v: Column, path: Column, order: Column, kind) -> Column:
    """The values below a variant that an Again stands for, with path, place and name."""
    nothing = F.expr(f"cast(array() as {_DEEPER})")
    if isinstance(kind, Again):
        return F.array(F.struct(path.alias("path"), order.alias("ord"), F.lit(kind.name).alias("name"), v.alias("v")))
    if isinstance(kind, Optional):
        return F.when(~_missing(v), deeper(v, path, order, kind.of)).otherwise(nothing)
    if isinstance(kind, Many):
        inner = F.transform(F.coalesce(_items(v), F.expr("cast(array() as array<variant>)")), lambda x, i: deeper(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), F.concat(order, F.array(i)), kind.of))
        return F.flatten(inner)
    if isinstance(kind, Record):
        parts = [deeper(_get(v, n), F.concat(path, F.lit(f".{n}")), F.concat(order, F.array(F.lit(k))), sub) for k, (n, sub) in enumerate(kind.fields.items()) if _comes_back(sub)]
        return F.concat(*parts) if parts else nothing
    return nothing


def _comes_back(kind) -> bool:
    """Whether an Again lies below."""
    if isinstance(kind, Record):
        return any(map(_comes_back, kind.fields.values()))
    return isinstance(kind, Again) or isinstance(kind, (Many, Optional)) and _comes_back(kind.of)


def _flag(v: Column) -> Column:
    text = F.lower(F.try_variant_get(v, "$", "string"))
    number = F.regexp_replace(text, r"\A([01])\.0+\z", "$1")
    shape = F.schema_of_variant(v)
    read = F.when(shape == "STRING", text).when((shape == "BOOLEAN") | shape.startswith("BIGINT") | shape.startswith("DECIMAL") | (shape == "DOUBLE"), number)
    return F.when(read.isin(*TRUE), True).when(read.isin(*FALSE), False)


def value(v: Column, kind) -> Column:
    """A faultless variant as typed columns, with defaults; what an Again lies below stays a variant."""
    if _comes_back(kind):
        return v
    if isinstance(kind, Text):
        return F.try_variant_get(v, "$", "string")
    if isinstance(kind, Flag):
        return F.get(F.transform(F.array(v), _flag), F.lit(0))
    if isinstance(kind, Many):
        return F.transform(_items(v), lambda x: value(x, kind.of))
    if isinstance(kind, Optional):
        own = value(v, kind.of)
        return F.when(_missing(v), F.lit(None) if kind.nullable and kind.default is None else _default(kind)).otherwise(own)
    return F.struct(*[value(_get(v, n), k).alias(n) for n, k in kind.fields.items()])


def ddl(kind) -> str:
    """The type of value()."""
    if _comes_back(kind):
        return "variant"
    if isinstance(kind, Optional):
        return ddl(kind.of)
    if isinstance(kind, Many):
        return f"array<{ddl(kind.of)}>"
    if isinstance(kind, Record):
        return f"struct<{', '.join(f'`{n}`: {ddl(k)}' for n, k in kind.fields.items())}>"
    return "boolean" if isinstance(kind, Flag) else "string"


def _default(kind: Optional) -> Column:
    if isinstance(kind.default, (list, tuple)):
        return F.array(*map(F.lit, kind.default)).cast(ddl(kind)) if kind.default else F.expr(f"cast(array() as {ddl(kind)})")
    return F.lit(kind.default).cast(ddl(kind))


def parse_typed(answers: DataFrame, schema: Schema, answer: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) of JSON answers. good has a typed column for each field of the root, and defaults where optional ones are missing.

    quarantine has the reason: empty, not JSON, or the path and kind of the first
    fault, top down. A leading code fence is taken off. Records that
    come back, as those of trees, are walked level by level until none is left, at any depth;
    such a field stays a variant. Fields that the schema doesn't name are passed over.
    """
    rows = answers.withColumn("__v", F.try_parse_json(unfenced(F.col(answer))))
    if schema.named:
        rows = cut(rows.withColumn("__id", F.monotonically_increasing_id()))
    empty = F.when(F.coalesce(F.length(answer), F.lit(0)) == 0, "empty").when(F.col("__v").isNull(), "not JSON")
    rows = rows.withColumn("reason", empty.otherwise(fault(F.col("__v"), F.lit("$"), schema.root)))
    if schema.named:
        nowhere = F.expr("cast(array() as array<int>)")
        level = rows.where("reason is null").select("__id", F.explode(deeper(F.col("__v"), F.lit("$"), nowhere, schema.root)).alias("x"))
        level, found = cut(level.select("__id", "x.*")), None
        while not level.isEmpty():
            by_name = reduce(lambda c, n: c.when(F.col("name") == n, fault(F.col("v"), F.col("path"), schema.named[n])), schema.named, F.when(F.lit(False), F.lit(None).cast("string")))
            below = reduce(lambda c, n: c.when(F.col("name") == n, deeper(F.col("v"), F.col("path"), F.col("ord"), schema.named[n])), schema.named, F.when(F.lit(False), F.expr(f"cast(array() as {_DEEPER})")))
            level = level.withColumn("fault", by_name)
            wrong = level.where("fault is not null").groupBy("__id").agg(F.min(F.struct("ord", "fault")).alias("f"))
            found = wrong if found is None else found.unionAll(wrong)
            level = cut(level.where("fault is null").select("__id", F.explode(below).alias("x")).select("__id", "x.*"))
        if found is not None:
            first = cut(found.groupBy("__id").agg(F.min("f").alias("f")))
            rows = rows.join(first, "__id", "left").withColumn("reason", F.coalesce("reason", "f.fault")).drop("f")
        rows = rows.drop("__id")
    values = {n: value(_get(F.col("__v"), n), k) for n, k in schema.root.fields.items()}
    return rows.where("reason is null").withColumns(values).drop("__v", "reason"), rows.where("reason is not null").drop("__v")


def typed_or_default(answers: DataFrame, schema: Schema, defaults: dict[str, Column] | None = None, answer: str = "answer") -> DataFrame:
    """answers with the schema's fields; a failed answer has, as a whole, the given defaults, else its optional fields' own, empty lists and nulls."""
    good, bad = parse_typed(answers, schema, answer)
    own = {}
    for n, k in schema.root.fields.items():
        if defaults and n in defaults:
            own[n] = defaults[n]
        elif isinstance(k, Optional):
            own[n] = F.parse_json(F.lit("[]")) if _comes_back(k) else _default(k)
        elif isinstance(k, Many):
            own[n] = F.parse_json(F.lit("[]")) if _comes_back(k) else F.expr(f"cast(array() as {ddl(k)})")
        else:
            own[n] = F.lit(None).cast(ddl(k))
    return good.unionByName(bad.drop("reason").withColumns(own))


#: What answers about headings, passages, requests and topics have to look like.
NODE = Record({"title": Text(), "children": Optional(Many(Again("node")), (), True)})
STRUCTURE = Schema(Record({"structure": Many(Again("node"))}), {"node": NODE})
MAPPINGS = Schema(Record({"mappings": Many(Record({"title": Text(), "source_text": Text()}))}))
INTENT = Schema(Record({"task_type": Text(), "scope": Text(), "depth": Text(), "language_level": Text(), "format_type": Text(), "allow_external_knowledge": Optional(Flag(), True), "normalized_query": Text()}))
NORMALIZED = Schema(Record({"canonical_topic_name": Text(), "alternative_names": Optional(Many(Text()), ())}))
MERGES = Schema(Record({"merge_groups": Many(Record({"primary": Text(), "secondary": Optional(Many(Text()), ())}))}))
CLASSIFICATION = Schema(
    Record(
        {
            "topic_type": Text(("core_concept", "sub_concept", "reference_only", "example", "application", "definition_only")),
            "explanation_depth": Text(("detailed", "brief", "none")),
            "definition_status": Text(("needs_explanation", "already_explained", "reference_only")),
        }
    )
)
RELATIONS = Schema(Record({"relationships": Many(Record({"topic": Text(), "relation": Text(("depends_on", "explains", "applies", "exception_to", "example_of"))}))}))
