"""Decision metadata: triples queried as joins, and (entity, field, value) rows pivoted to records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sizes import broadcast_if_small


def list_entities(triples: DataFrame, identifier: str, conditions: dict[str, str], prefix: str = "") -> DataFrame:
    """(value) distinct identifiers of subjects that have all of the given (predicate, object) pairs, in order."""
    out = triples.where(F.col("p") == identifier).select("s", F.col("o").alias("value"))
    for p, o in conditions.items():
        out = out.join(triples.where((F.col("p") == p) & (F.col("o") == o)).select("s"), "s", "left_semi")
    return out.where(F.col("value").startswith(prefix)).select("value").distinct().orderBy("value")


def as_fields(triples: DataFrame, mapping: DataFrame, labels: DataFrame | None = None, lang: str = "en") -> DataFrame:
    """(entity, field, value): triples whose predicate is in mapping (p, field, hop); with ``hop`` the value is the object's label."""
    own = triples.join(broadcast_if_small(mapping), "p").select(F.col("s").alias("entity"), "field", F.col("o").alias("value"), "hop")
    direct = own.where(~F.col("hop")).select("entity", "field", "value")
    if labels is None:
        return direct
    named = own.where("hop").join(labels.where(F.col("lang") == lang).select(F.col("s").alias("value"), F.col("o").alias("label")), "value")
    return direct.unionByName(named.select("entity", "field", F.col("label").alias("value")))


def exists_chain(triples: DataFrame, start: DataFrame, *predicates: str) -> DataFrame:
    """The entities of ``start`` (entity) from which the chain of predicates leads anywhere."""
    at = start.select("entity", F.col("entity").alias("node"))
    for p in predicates:
        at = at.join(triples.where(F.col("p") == p).select(F.col("s").alias("node"), F.col("o").alias("next")), "node").select("entity", F.col("next").alias("node")).distinct()
    return start.join(at.select("entity").distinct(), "entity", "left_semi")


def first_value(rows: DataFrame, entity: str, value: str) -> DataFrame:
    return rows.groupBy(entity).agg(F.min(value).alias(value))


def manifestation(rows: DataFrame, entity: str, kind: str, place: str, wanted: str = "fmx4", document: str = "/DOC_1") -> DataFrame:
    """(entity, url): the document of each entity's first manifestation of the wanted kind (least place); without one, no row."""
    return first_value(rows.where(F.col(kind) == wanted), entity, place).select(entity, F.concat(F.col(place), F.lit(document)).alias("url"))


def pivot(rows: DataFrame, scalars: list[str], arrays: list[str], not_self: list[str] = ()) -> DataFrame:
    """One record per entity: the least value of scalar fields, sorted distinct arrays of the others; ``not_self`` drops the entity itself."""
    is_field = lambda f: F.col("field") == f
    keep = lambda f: is_field(f) & (F.col("value") != F.col("entity")) if f in not_self else is_field(f)
    one = [F.min(F.when(is_field(f), F.col("value"))).alias(f) for f in scalars]
    many = [F.array_sort(F.collect_set(F.when(keep(f), F.col("value")))).alias(f) for f in arrays]
    return rows.groupBy("entity").agg(*one, *many)
