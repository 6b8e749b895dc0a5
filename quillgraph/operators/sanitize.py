"""Consistency of familial relations: one function per rule.

Each takes relations (src_id, dst_id, relation_type, evidence, strength) and
returns the rows that a rule keeps, adds or changes, so effects can be counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.scalar import infer_gender, stripped_key
from quillgraph.operators.graph import FAMILIAL, upsert_relations, with_inverses

KEY = ["src_id", "dst_id", "relation_type"]


def drop_impersonal_familial(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Without familial relations one end of which is known to be no person."""
    other = entities.where("entity_type <> 'Person'").select("entity_id")
    familial = F.col("relation_type").isin(FAMILIAL)
    flagged = relations.join(other.select(F.col("entity_id").alias("src_id"), F.lit(True).alias("s")), "src_id", "left").join(other.select(F.col("entity_id").alias("dst_id"), F.lit(True).alias("t")), "dst_id", "left")
    return flagged.where(~(familial & (F.col("s").isNotNull() | F.col("t").isNotNull()))).select(relations.columns)


def missing_inverses(relations: DataFrame) -> DataFrame:
    """The inverse and symmetric rows that familial relations lack."""
    rows = relations.where(F.col("relation_type").isin(FAMILIAL)).select(*KEY, "evidence")
    return upsert_relations(with_inverses(rows)).join(relations.select(KEY), KEY, "left_anti")


def shared_chunk_strength(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """Strength out of the chunks that mention both ends, else out of the evidence."""
    one, two = mentions.toDF("chunk_id", "src_id"), mentions.toDF("chunk_id", "dst_id")
    ends = relations.select("src_id", "dst_id").distinct()
    shared = ends.join(one, "src_id").join(two, ["dst_id", "chunk_id"]).groupBy("src_id", "dst_id").agg(F.count("*").alias("n"))
    rows = relations.join(shared, ["src_id", "dst_id"], "left")
    value = F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("n") / 10)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.size("evidence") / 10)))
    return rows.withColumn("strength", value).drop("n")


def inferred_genders(entities: DataFrame) -> DataFrame:
    """Persons without a gender whose description tells one."""
    rows = entities.where("entity_type = 'Person'").where(F.coalesce("gender", F.lit("unknown")).isin("unknown", ""))
    return rows.select("entity_id", infer_gender(F.coalesce("description", F.lit(""))).alias("gender")).where("gender IS NOT NULL")


def drop_same_gender_spouses(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Without spouses whose known genders are equal (the rule of the reference data)."""
    known = entities.where(F.lower("gender").isin("male", "female")).select("entity_id", F.lower("gender").alias("g"))
    rows = relations.join(known.toDF("src_id", "gs"), "src_id", "left").join(known.toDF("dst_id", "gt"), "dst_id", "left")
    return rows.where(~((F.col("relation_type") == "spouse_of") & F.coalesce(F.col("gs") == F.col("gt"), F.lit(False)))).select(relations.columns)


def drop_superseded_half_siblings(relations: DataFrame) -> DataFrame:
    """Without half siblings that are also siblings."""
    full = relations.where("relation_type = 'sibling_of'").select("src_id", "dst_id")
    both = full.unionByName(full.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))).distinct()
    half = F.col("relation_type") == "half_sibling_of"
    return relations.where(~half).unionByName(relations.where(half).join(both, ["src_id", "dst_id"], "left_anti").select(relations.columns))


def children_turned(relations: DataFrame) -> DataFrame:
    """With every child_of as the parent_of of the other direction, its evidence
    joined with that of a parent_of that is there already."""
    child = F.col("relation_type") == "child_of"
    ends = (F.when(child, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("dst_id", "src_id"), ("src_id", "dst_id")))
    return upsert_relations(relations.select(*ends, F.when(child, "parent_of").otherwise(F.col("relation_type")).alias("relation_type"), "evidence"))


def drop_parent_paradoxes(relations: DataFrame) -> DataFrame:
    """Of parents of each other the stronger statement stays, of equal ones neither."""
    parents = relations.where("relation_type = 'parent_of'")
    back = parents.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), F.col("strength").alias("other"))
    bad = parents.join(back, ["src_id", "dst_id"]).where("strength <= other").select(KEY)
    return relations.join(bad, KEY, "left_anti")


def drop_type_mismatches(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Without places that are known to be persons or works, and employers that are."""
    kinds = entities.select(F.col("entity_id").alias("dst_id"), "entity_type")
    bad = F.col("relation_type").isin("located_in", "works_at", "lived_in") & F.coalesce(F.col("entity_type").isin("Person", "CreativeWork", "Work"), F.lit(False))
    return relations.join(kinds, "dst_id", "left").where(~bad).select(relations.columns)


def honorific_stubs(entities: DataFrame) -> DataFrame:
    """Entities whose name is nothing but honorifics."""
    return entities.where((stripped_key(F.col("name")) == "") & (F.trim("name") != "")).select("entity_id", "name")


def purge_unseeded_parents(relations: DataFrame, seed: str = "seeded") -> DataFrame:
    """If a source has a seeded parent or child relation, its unseeded ones and
    their inverses go. ``seed`` is a boolean column of ``relations``."""
    lineage = relations.where(F.col("relation_type").isin("parent_of", "child_of"))
    sources = lineage.where(F.col(seed)).select("src_id").distinct()
    drop = lineage.where(~F.col(seed)).join(sources, "src_id", "left_semi").select(KEY)
    inverse = F.when(F.col("relation_type") == "parent_of", "child_of").otherwise("parent_of")
    twins = drop.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), inverse.alias("relation_type"))
    return relations.join(drop.unionByName(twins).distinct(), KEY, "left_anti")


def maiden_name_candidates(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """``(wife_id, candidate_id)``: for spouses exactly one of whom is female, other
    persons with her first name who lack the husband's last name."""
    people = entities.where("entity_type = 'Person' AND name IS NOT NULL").select("entity_id", F.lower("gender").alias("g"), F.split(F.lower(F.trim("name")), r"\s+").alias("w"))
    people = people.select("entity_id", "g", F.element_at("w", 1).alias("first"), F.element_at("w", -1).alias("last"))
    pairs = relations.where("relation_type = 'spouse_of'").select("src_id", "dst_id")
    pairs = pairs.join(people.toDF("src_id", "gs", "fs", "ls"), "src_id").join(people.toDF("dst_id", "gt", "ft", "lt"), "dst_id")
    hers = F.coalesce(F.col("gs") == "female", F.lit(False))
    his = F.coalesce(F.col("gt") == "female", F.lit(False))
    pairs = pairs.where(hers != his).select(F.when(hers, F.col("src_id")).otherwise(F.col("dst_id")).alias("wife_id"), F.when(hers, F.col("fs")).otherwise(F.col("ft")).alias("first"), F.when(hers, F.col("lt")).otherwise(F.col("ls")).alias("surname"))
    found = pairs.join(people.select(F.col("entity_id").alias("candidate_id"), "first", "last"), "first")
    return found.where("candidate_id <> wife_id AND last <> surname").select("wife_id", "candidate_id").distinct()
