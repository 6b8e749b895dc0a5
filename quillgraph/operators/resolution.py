"""Entity resolution in tiers: candidate pairs (keep_id, drop_id) of each rule.

Candidates come from equality joins on keys. Where most of a name's tokens must
be shared (:func:`subset`), each name is looked up by its few rarest tokens, and
where most of its letters (:func:`fuzzy`), by its few rarest runs of letters, which
keeps frequent ones out of the joins; where any one token is enough
(:func:`by_embedding`), by all of them, the frequent ones in blocks.
Ties go to the entity with more mentions, then the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.common import tasks
from quillgraph.functions.scalar import has_disambiguation_token, normalize_name, significant_words, strip_qualifications, stripped_key
from quillgraph.operators.graph import SYMMETRIC, adjacency, neighbours

# Relations that one pair cannot have with the same third one.
CONTRADICTIONS = [
    ("spouse_of", "sibling_of"), ("spouse_of", "half_sibling_of"), ("spouse_of", "child_of"), ("spouse_of", "parent_of"),
    ("spouse_of", "grandparent_of"), ("spouse_of", "grandchild_of"), ("parent_of", "child_of"), ("grandparent_of", "grandchild_of"),
    ("sibling_of", "parent_of"), ("sibling_of", "child_of"), ("half_sibling_of", "parent_of"), ("half_sibling_of", "child_of"),
]

# Tokens that make no candidates for the comparison of embeddings.
EMBEDDING_STOP = [
    "the", "and", "of", "in", "a", "an", "for", "at", "by", "to", "dr", "mr", "mrs", "ms", "prof", "sir", "north", "south", "east", "west",
    "new", "old", "cape", "great", "lower", "upper", "central", "union", "street", "road", "avenue", "lane", "school", "institute", "college",
    "university", "club", "party", "movement", "committee", "association", "council", "congress", "league", "society", "church", "hall",
    "high", "primary", "secondary", "its", "was", "his", "her",
]

_WORDS = F.split


def named(entities: DataFrame) -> DataFrame:
    """entity_id, entity_type, mention_count, name, norm, words, key of each named entity."""
    rows = entities.where(F.col("name").isNotNull()).select("entity_id", "entity_type", "mention_count", "name", normalize_name(F.col("name")).alias("norm"), stripped_key(F.col("name")).alias("key"))
    return rows.where("norm <> ''").withColumn("words", F.split("norm", " "))


def _pairs(left: DataFrame, on: list[str], right: DataFrame | None = None) -> DataFrame:
    """All pairs a, b equal in ``on``: columns prefixed a_ and b_."""
    right = left if right is None else right
    a = left.select(*on, *(F.col(c).alias(f"a_{c}") for c in left.columns if c not in on))
    b = right.select(*on, *(F.col(c).alias(f"b_{c}") for c in right.columns if c not in on))
    return a.join(b, on)


def _kept(pairs: DataFrame) -> DataFrame:
    """(keep_id, drop_id): more mentions first, then the smaller id."""
    first = (F.col("a_mention_count") > F.col("b_mention_count")) | ((F.col("a_mention_count") == F.col("b_mention_count")) & (F.col("a_entity_id") < F.col("b_entity_id")))
    return pairs.select(F.when(first, F.col("a_entity_id")).otherwise(F.col("b_entity_id")).alias("keep_id"), F.when(first, F.col("b_entity_id")).otherwise(F.col("a_entity_id")).alias("drop_id")).distinct()


def group_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Within each group the best entity with every other: no pairs inside a group."""
    best = Window.partitionBy(*keys)
    keep = F.max_by("entity_id", F.struct("mention_count", -F.col("entity_id"))).over(best)
    return rows.withColumn("keep_id", keep).where("keep_id <> entity_id").select("keep_id", F.col("entity_id").alias("drop_id"))


def exact(entities: DataFrame) -> DataFrame:
    return group_duplicates(named(entities), ["norm"])


def honorific(entities: DataFrame) -> DataFrame:
    """Equal apart from honorifics, of one type; a Mr and a Mrs stay apart."""
    title = F.when(F.array_contains("words", "mrs"), "mrs").when(F.array_contains("words", "mr"), "mr").otherwise("")
    rows = named(entities).where("key <> ''").withColumn("title", title)
    forms = rows.groupBy("key", "entity_type").agg(F.countDistinct("norm").alias("n"), F.max(F.col("title") == "mr").alias("mr"), F.max(F.col("title") == "mrs").alias("mrs"))
    usable = forms.where("n > 1 AND NOT (mr AND mrs)").select("key", "entity_type")
    return group_duplicates(rows.join(usable, ["key", "entity_type"]), ["key", "entity_type"])


def alias_match(entities: DataFrame) -> DataFrame:
    """The key of a name equals the key of another entity's alias of the same type."""
    names = named(entities).where("key <> ''").select("entity_type", "key", "entity_id")
    aliases = entities.select("entity_type", F.col("entity_id").alias("keep_id"), F.explode("aliases").alias("alias")).withColumn("key", stripped_key(F.col("alias")))
    return aliases.join(names, ["entity_type", "key"]).where("keep_id <> entity_id").select("keep_id", F.col("entity_id").alias("drop_id")).distinct()


def rarest_tokens(rows: DataFrame, n: int, least_length: int = 1) -> DataFrame:
    """``(token, entity_id)``: each name's n rarest tokens of at least that length."""
    words = rows.select("entity_id", F.explode(F.array_distinct("words")).alias("token")).where(F.length("token") >= least_length)
    counts = words.groupBy("token").agg(F.count("*").alias("df"))
    order = Window.partitionBy("entity_id").orderBy("df", "token")
    return words.join(counts, "token").withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).select("token", "entity_id")


def shared_neighbours(pairs: DataFrame, relations: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``n_shared``: neighbours that both have."""
    nb = neighbours(relations)
    shared = pairs.select(a, b).distinct().join(nb.select(F.col("node_id").alias(a), "neighbour_id"), a).join(nb.select(F.col("node_id").alias(b), "neighbour_id"), [b, "neighbour_id"])
    return pairs.join(shared.groupBy(a, b).agg(F.count("*").alias("n_shared")), [a, b], "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))


def subset(entities: DataFrame, relations: DataFrame, least_shared: int = 2) -> DataFrame:
    """All words of at least 4 letters of a shorter name stand in a longer one of
    the type, and both share neighbours. Looked up by the shorter name's rarest word."""
    rows = named(entities).withColumn("long_words", F.filter(F.array_distinct("words"), lambda w: F.length(w) >= 4)).where(F.size("long_words") > 0)
    short = rows.join(rarest_tokens(rows.withColumn("words", F.col("long_words")), 1, 4), "entity_id")
    long = rows.withColumn("token", F.explode("long_words"))
    pairs = _pairs(long, ["token", "entity_type"], short).where(F.col("a_entity_id") != F.col("b_entity_id"))
    pairs = pairs.where((F.size("a_words") > F.size("b_words")) & (F.size(F.array_except("b_long_words", "a_long_words")) == 0))
    pairs = pairs.select(F.col("a_entity_id").alias("keep_id"), F.col("b_entity_id").alias("drop_id")).distinct()
    return shared_neighbours(pairs, relations, "keep_id", "drop_id").where(F.col("n_shared") >= least_shared).select("keep_id", "drop_id")


def _shortened(norm: Column, letters: int) -> Column:
    """``norm`` with up to that many letters after the first taken out, in all ways."""
    forms = F.array(norm)
    for _ in range(letters):
        shorter = F.transform(forms, lambda v: F.transform(F.sequence(F.lit(2), F.greatest(F.length(v), F.lit(2))), lambda i: F.concat(v.substr(F.lit(1), i - 1), v.substr(i + 1, F.length(v)))))
        forms = F.array_distinct(F.concat(forms, F.flatten(shorter)))
    return forms


def name_keys(names: DataFrame, distance: int, run: int = 4, buckets: int = 1 << 18) -> DataFrame:
    """``(key, entity_type, norm)``: keys of the different ``names`` (entity_type, norm), of
    which any two of one type and first letter at most ``distance`` edits apart share one.

    An edit changes at most ``run`` of a name's runs of ``run`` letters, so two names
    have one of the ``run * distance + 1`` rarest of each in common, whatever order
    ranks them; it is by the count of a run's bucket, which bounds the broadcast.
    Names too short for so many runs are looked up with letters taken out.
    """
    first, length = F.substring("norm", 1, 1), F.length("norm")
    key = lambda v: F.xxhash64("entity_type", first, v)
    least = run * (distance + 1)
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), length - (run - 1)), lambda i: key(F.col("norm").substr(i, F.lit(run)))))
    runs = names.where(length >= least).select("entity_type", "norm", F.explode(runs).alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    counts = runs.groupBy("bucket").agg(F.count("*").alias("n"))
    order = Window.partitionBy("entity_type", "norm").orderBy("n", "key")
    rare = runs.join(F.broadcast(counts), "bucket").withColumn("r", F.row_number().over(order)).where(F.col("r") <= run * distance + 1)
    # of two names one of which is too short, the other is at most distance letters longer
    short = names.where(length < least + distance).select(F.explode(F.array_distinct(F.transform(_shortened(F.col("norm"), distance), key))).alias("key"), "entity_type", "norm")
    return rare.select("key", "entity_type", "norm").unionByName(short)


def close_names(names: DataFrame, distance: int) -> DataFrame:
    """``(entity_type, a_norm, b_norm)``: all pairs of the different ``names`` (entity_type,
    norm) of one type and first letter that are at most ``distance`` edits apart, once each."""
    pairs = _pairs(name_keys(names, distance), ["key"]).where("a_entity_type = b_entity_type AND a_norm < b_norm").where(F.abs(F.length("a_norm") - F.length("b_norm")) <= distance)
    pairs = pairs.where((F.substring("a_norm", 1, 1) == F.substring("b_norm", 1, 1)) & (F.levenshtein("a_norm", "b_norm", distance) >= 0))
    return pairs.select(F.col("a_entity_type").alias("entity_type"), "a_norm", "b_norm").distinct()


def fuzzy(entities: DataFrame, distance: int = 2) -> DataFrame:
    """Names of one type at most ``distance`` edits apart that share a token of at
    least 4 letters; first tokens must begin with the same letter, so they are not
    different initials. Close names are found first, whatever they share, since a
    shared token may be a frequent one; then come the entities of each name."""
    rows = named(entities)
    long_words = lambda words: F.filter(words, lambda w: F.length(w) >= 4)
    # a fixed number of parts: each name becomes some 20 rows, which the size of the parts does not tell
    names = rows.where(F.size(long_words("words")) > 0).select("entity_type", "norm").repartition(tasks(entities.sparkSession), "entity_type", "norm").distinct()
    pairs = close_names(names, distance).where(F.arrays_overlap(long_words(F.split("a_norm", " ")), long_words(F.split("b_norm", " "))))
    for side in ("a", "b"):
        pairs = pairs.join(rows.select("entity_type", *(F.col(c).alias(f"{side}_{c}") for c in ("norm", "entity_id", "mention_count"))), ["entity_type", f"{side}_norm"])
    return _kept(pairs)


def qualification(entities: DataFrame) -> DataFrame:
    """Equal after trailing degrees are taken off, at least two tokens."""
    rows = named(entities).withColumn("bare", F.coalesce(strip_qualifications(F.col("name")), F.col("norm"))).where(F.size(F.split("bare", " ")) >= 2)
    different = rows.groupBy("bare", "entity_type").agg(F.countDistinct("norm").alias("n")).where("n > 1").select("bare", "entity_type")
    return group_duplicates(rows.join(different, ["bare", "entity_type"]), ["bare", "entity_type"])


def first_name_only(entities: DataFrame) -> DataFrame:
    """A one-word name that is the first token of exactly one longer name of the type."""
    rows = named(entities)
    longer = rows.where(F.size("words") > 1).groupBy("entity_type", F.element_at("words", 1).alias("norm")).agg(F.count("*").alias("n"), F.min("entity_id").alias("keep_id")).where("n = 1")
    return rows.where(F.size("words") == 1).join(longer, ["entity_type", "norm"]).select("keep_id", F.col("entity_id").alias("drop_id"))


def unique_surname(entities: DataFrame) -> DataFrame:
    """A one-word name that is the last token of exactly one longer name of the type."""
    rows = named(entities)
    longer = rows.where(F.size("words") > 1).groupBy("entity_type", F.element_at("words", -1).alias("norm")).agg(F.count("*").alias("n"), F.min("entity_id").alias("keep_id")).where("n = 1")
    return rows.where(F.size("words") == 1).join(longer, ["entity_type", "norm"]).select("keep_id", F.col("entity_id").alias("drop_id"))


def middle_drop(entities: DataFrame) -> DataFrame:
    """A name of two tokens with the first and last token of exactly one name of three or more."""
    rows = named(entities).withColumn("first", F.element_at("words", 1)).withColumn("last", F.element_at("words", -1))
    longer = rows.where(F.size("words") >= 3).groupBy("entity_type", "first", "last").agg(F.count("*").alias("n"), F.min("entity_id").alias("keep_id")).where("n = 1")
    return rows.where(F.size("words") == 2).join(longer, ["entity_type", "first", "last"]).select("keep_id", F.col("entity_id").alias("drop_id"))


def neighbour_containment(entities: DataFrame, relations: DataFrame, share: float = 0.6, least: int = 2, hub: int = 25) -> DataFrame:
    """Entities most of whose neighbours are neighbours of another of the type;
    neighbours with more than ``hub`` neighbours say nothing and are left out
    before the pairs are formed."""
    nb = neighbours(relations)
    small = nb.groupBy("neighbour_id").agg(F.count("*").alias("n")).where(F.col("n") <= hub).select("neighbour_id")
    kinds = entities.select(F.col("entity_id").alias("node_id"), "entity_type")
    nb = nb.join(small, "neighbour_id", "left_semi").join(kinds, "node_id")
    size = nb.groupBy("node_id").agg(F.count("*").alias("n"))
    a, b = nb.toDF("node_a", "neighbour_id", "entity_type"), nb.toDF("node_b", "neighbour_id", "entity_type")
    pairs = a.join(b, ["neighbour_id", "entity_type"]).where("node_a <> node_b").groupBy("node_a", "node_b").agg(F.count("*").alias("shared"))
    pairs = pairs.where(F.col("shared") >= least).join(size.toDF("node_b", "n"), "node_b").where(F.col("shared") / F.col("n") >= share)
    return pairs.select(F.col("node_a").alias("keep_id"), F.col("node_b").alias("drop_id"), F.col("shared"), F.round(F.col("shared") / F.col("n"), 6).alias("share"))


def role_contradictions(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs (keep_id, drop_id) whose relations to the same third entity contradict."""
    both = F.lit(False)
    for x, y in CONTRADICTIONS:
        both = both | (F.col("ra").isin(x, y) & F.col("rb").isin(x, y) & (F.col("ra") != F.col("rb")))
    out = relations.select("src_id", "dst_id", "relation_type")
    rows = pairs.join(out.toDF("keep_id", "third", "ra"), "keep_id").join(out.toDF("drop_id", "third", "rb"), ["drop_id", "third"])
    return rows.where(both).select("keep_id", "drop_id").distinct()


def descriptions_diverge(pairs: DataFrame, entities: DataFrame, least_length: int = 100, least_share: float = 0.12) -> DataFrame:
    """Pairs whose descriptions are long and have few significant words in common."""
    d = entities.select("entity_id", F.coalesce("description", F.lit("")).alias("d"))
    rows = pairs.join(d.toDF("keep_id", "da"), "keep_id").join(d.toDF("drop_id", "db"), "drop_id")
    a, b = significant_words(F.col("da")), significant_words(F.col("db"))
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))
    return rows.where((F.length("da") >= least_length) & (F.length("db") >= least_length) & (share < least_share)).select("keep_id", "drop_id")


def bare_first_name(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """A one-word name (without honorifics, at least 3 letters) that is the first word
    of exactly one longer name, of its type; the bare one has no description or both
    share a neighbour, and the descriptions do not diverge."""
    rows = named(entities).where("key <> ''").withColumn("k", F.split("key", " "))
    longer = rows.where(F.size("k") >= 2).groupBy(F.element_at("k", 1).alias("key")).agg(F.count("*").alias("n"), F.min("entity_id").alias("keep_id"), F.min("entity_type").alias("entity_type")).where("n = 1")
    bare = rows.where((F.size("k") == 1) & (F.length("key") >= 3)).select("key", "entity_type", F.col("entity_id").alias("drop_id"))
    pairs = bare.join(longer, ["key", "entity_type"]).select("keep_id", "drop_id")
    plain = entities.select(F.col("entity_id").alias("drop_id"), (F.coalesce("description", F.lit("")) == "").alias("plain"))
    fit = shared_neighbours(pairs.join(plain, "drop_id"), relations, "keep_id", "drop_id").where("plain OR n_shared > 0").select("keep_id", "drop_id")
    return fit.join(descriptions_diverge(fit, entities), ["keep_id", "drop_id"], "left_anti")


def trusted_parents(relations: DataFrame, least: float = 0.1) -> DataFrame:
    """``(entity_id, parent_id)`` of child_of relations that are strong enough."""
    return relations.where((F.col("relation_type") == "child_of") & (F.col("strength") >= least)).select(F.col("src_id").alias("entity_id"), F.col("dst_id").alias("parent_id")).distinct()


def trusted_family(relations: DataFrame, least: float = 0.1) -> DataFrame:
    """``(entity_id, other_id, relation_types)`` of the symmetric family relations, from both ends."""
    rows = adjacency(relations).where(F.col("relation_type").isin(SYMMETRIC) & (F.col("strength") >= least))
    return rows.groupBy(F.col("node_id").alias("entity_id"), F.col("neighbour_id").alias("other_id")).agg(F.array_sort(F.collect_set("relation_type")).alias("relation_types"))


def different_parents(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs (keep_id, drop_id) with a parent in common and another one on each side: half siblings."""
    parents = trusted_parents(relations)
    n = parents.groupBy("entity_id").agg(F.count("*").alias("n"))
    shared = pairs.join(parents.toDF("keep_id", "parent_id"), "keep_id").join(parents.toDF("drop_id", "parent_id"), ["drop_id", "parent_id"]).groupBy("keep_id", "drop_id").agg(F.count("*").alias("k"))
    rows = shared.join(n.toDF("keep_id", "na"), "keep_id").join(n.toDF("drop_id", "nb"), "drop_id")
    return rows.where("k < na AND k < nb").select("keep_id", "drop_id")


def unconfirmed_surnames(entities: DataFrame, relations: DataFrame, surnames: DataFrame) -> DataFrame:
    """Pairs of entities with the same one of ``surnames`` (surname) that have no equal
    relation to a third entity; for review, so all pairs of a surname are asked for."""
    rows = named(entities).select("entity_id", F.element_at("words", -1).alias("surname")).join(surnames, "surname", "left_semi")
    pairs = rows.withColumnRenamed("entity_id", "keep_id").join(rows.withColumnRenamed("entity_id", "drop_id"), "surname").where("keep_id < drop_id").select("keep_id", "drop_id")
    family = trusted_family(relations).select("entity_id", "other_id", F.explode("relation_types").alias("relation_type"))
    sure = family.withColumnRenamed("entity_id", "keep_id").join(family.withColumnRenamed("entity_id", "drop_id"), ["other_id", "relation_type"]).where("keep_id < drop_id").select("keep_id", "drop_id").distinct()
    return pairs.join(sure, ["keep_id", "drop_id"], "left_anti")


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by up to four common first letters."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, matched = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                matched.append(x)
                break
    m = len(matched)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(matched, (b[j] for j in range(len(b)) if used[j]))) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_column(a, b):
    import pandas as pd

    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b)], dtype=float)


def near_embeddings(rows: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """``(a_entity_id, b_entity_id)``: all pairs of one type that share one of their
    ``tokens`` and whose embeddings have a cosine of at least ``threshold`` (above
    0), up to rounding. The entities of a token are split into blocks of about
    ``block``, and each two blocks are compared by one matrix product."""
    words = rows.where("NOT exists(embedding, x -> x IS NULL)").select("entity_id", "entity_type", F.size("embedding").alias("size"), "embedding", F.explode("tokens").alias("token"))
    key = ["entity_type", "size", "token"]
    counts = words.groupBy(*key).agg(F.count("*").alias("df")).where("df > 1").withColumn("blocks", F.ceil(F.col("df") / block).cast("int")).drop("df")
    placed = words.join(counts, key).withColumn("at", F.pmod(F.xxhash64("entity_id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(*key, F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "entity_id", "embedding")

    def compare(group, pdf):
        import numpy as np
        import pandas as pd

        values = np.stack(pdf["embedding"].to_numpy()).astype(float)
        norm = np.linalg.norm(values, axis=1)
        known = norm > 0
        unit, ids, at = values[known] / norm[known, None], pdf["entity_id"].to_numpy()[known], pdf["at"].to_numpy()[known]
        left, right = at == group[3], at == group[4]
        a, b = np.nonzero(unit[left] @ unit[right].T >= threshold - 1e-9)
        a, b = ids[left][a], ids[right][b]
        found = pd.DataFrame({"a_entity_id": np.minimum(a, b), "b_entity_id": np.maximum(a, b)})
        return found[found["a_entity_id"] < found["b_entity_id"]].drop_duplicates()

    return placed.groupBy(*key, "i", "j").applyInPandas(compare, "a_entity_id bigint, b_entity_id bigint").distinct()


def by_embedding(entities: DataFrame, threshold: float = 0.9, least_spelling: float = 0.6, block: int = 1024) -> DataFrame:
    """Pairs of one type that share a token of at least 3 letters outside the stop
    list, are spelt alike and whose embeddings agree. Different titles (Mr, Mrs),
    different first tokens before one surname and diverging descriptions cap the
    cosine at 0.96 and 0.94."""
    from quillgraph.functions.scalar import cosine

    rows = named(entities).where(~has_disambiguation_token(F.col("name"))).join(entities.select("entity_id", "embedding", F.coalesce("description", F.lit("")).alias("description")), "entity_id").where("embedding IS NOT NULL")
    tokens = F.filter(F.array_distinct("words"), lambda w: (F.length(w) >= 3) & ~w.isin(EMBEDDING_STOP))
    pairs = near_embeddings(rows.select("entity_id", "entity_type", "embedding", tokens.alias("tokens")), threshold, block)
    for side in ("a", "b"):
        pairs = pairs.join(rows.select(*(F.col(c).alias(f"{side}_{c}") for c in rows.columns)), f"{side}_entity_id")
    pairs = pairs.withColumn("spelling", jaro_winkler_column("a_norm", "b_norm")).where(F.col("spelling") >= least_spelling)
    titles = F.array_contains("a_words", "mr") & F.array_contains("b_words", "mrs") | F.array_contains("a_words", "mrs") & F.array_contains("b_words", "mr")
    firsts = (F.element_at("a_words", -1) == F.element_at("b_words", -1)) & (F.element_at("a_words", 1) != F.element_at("b_words", 1)) & (F.length(F.element_at("a_words", 1)) > 1) & (F.length(F.element_at("b_words", 1)) > 1)
    wa, wb = significant_words(F.col("a_description")), significant_words(F.col("b_description"))
    apart = (F.length("a_description") >= 100) & (F.length("b_description") >= 100) & (F.size(F.array_intersect(wa, wb)) / F.greatest(F.lit(1), F.size(F.array_union(wa, wb))) < 0.12)
    similar = F.least(cosine(F.col("a_embedding"), F.col("b_embedding")), F.when(apart, 0.94).when(titles | firsts, 0.96).otherwise(1.0))
    return _kept(pairs.withColumn("similar", similar).where(F.col("similar") >= threshold))


def greedy_names(entities: DataFrame) -> DataFrame:
    """``(keep_id, drop_id)`` of the consolidation's rule: equal names, a single
    word equal to another's last word, or four fifths of the words in common for
    names of more than 10 letters; greedy in the order of the ids.

    Candidate links come from joins on the whole name, the last word and the
    rarest words; the greedy choice is made within each connected component.
    """
    from quillgraph.common import cut
    from quillgraph.operators.components import connected_components

    every = entities.where(F.col("name").isNotNull()).select("entity_id", F.lower(F.trim("name")).alias("norm")).where("norm <> ''")
    # equal names are one representative, the smallest id, which the greedy order takes
    # first in any case; the choice is made among representatives
    alike = every.groupBy("norm").agg(F.min("entity_id").alias("rep"))
    equal = every.join(alike, "norm").where("entity_id <> rep").select("rep", "entity_id")
    rows = alike.select(F.col("rep").alias("entity_id"), "norm").withColumn("words", F.split("norm", r"\s+")).withColumn("last", F.element_at("words", -1))
    single = rows.where(F.size("words") == 1).select("last", "entity_id")
    last = _pairs(rows.where(F.size("words") > 1).select("last", "entity_id"), ["last"], single).select("a_entity_id", "b_entity_id")
    # with at least 4 of 5 words in common, one of the rarest fifth and one more is common
    long = rows.where(F.length("norm") > 10)
    counts = long.select("entity_id", F.explode(F.array_distinct("words")).alias("token"))
    df = counts.groupBy("token").agg(F.count("*").alias("df"))
    order = Window.partitionBy("entity_id").orderBy("df", "token")
    prefix = counts.join(df, "token").withColumn("r", F.row_number().over(order)).join(long.select("entity_id", F.size(F.array_distinct("words")).alias("n"), F.array_distinct("words").alias("set")), "entity_id")
    prefix = prefix.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * 0.8) + 1).select("token", "entity_id", "n", "set")
    overlap = _pairs(prefix, ["token"]).where("a_entity_id < b_entity_id").where(F.size(F.array_intersect("a_set", "b_set")) / F.greatest("a_n", "b_n") >= 0.8).select("a_entity_id", "b_entity_id")
    links = cut(last.unionByName(overlap).select(F.least("a_entity_id", "b_entity_id").alias("a"), F.greatest("a_entity_id", "b_entity_id").alias("b")).distinct())
    if links.isEmpty():
        return equal.toDF("keep_id", "drop_id")
    groups = connected_components(links, "a", "b")

    def choose(pdf):
        import pandas as pd

        near: dict = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        gone, out = set(), []
        for node in sorted(near):
            if node not in gone:
                for other in sorted(near[node]):
                    if other > node and other not in gone:
                        gone.add(other)
                        out.append((node, other))
        return pd.DataFrame(out, columns=["keep_id", "drop_id"])

    chosen = cut(links.join(groups.toDF("a", "component"), "a").groupBy("component").applyInPandas(choose, "keep_id bigint, drop_id bigint"))
    # a name whose representative is gone goes with it
    gone = chosen.select(F.col("drop_id").alias("rep"), "keep_id")
    rest = equal.join(gone, "rep", "left").select(F.coalesce("keep_id", "rep").alias("keep_id"), F.col("entity_id").alias("drop_id"))
    return chosen.unionByName(rest)
