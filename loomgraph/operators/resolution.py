"""Entity resolution as set operations: mentions to entities, and merging of entities."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.fuzzy import ratio, token_set_ratio
from loomgraph.functions.records import entity_type, parse_adjudication
from loomgraph.functions.text import normalize_name, pair_key
from loomgraph.operators.items import provider_answers
from loomgraph.session import cut

CANDIDATE_SCORE = 65.0
AUTO_SCORE = 93.0


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """Resolve a batch of mentions as if they came one by one in the order (item_id, position).

    A surface form that is an alias binds to its entity.  Else the canonical name of the form's
    first mention decides: a known entity of that name, or a new one, whose name and type are
    those of its first mention.  A canonical name decides only where the form is unknown.

    ``mentions``: item_id, position, surface_form, canonical_name, entity_type_guess, confidence.
    Returns the new state of ``entities`` and ``aliases``, and ``item_entities``.
    """
    rows = mentions.withColumn("form", normalize_name(F.col("surface_form"))).withColumn("name", normalize_name(F.col("canonical_name")))
    in_order = Window.partitionBy("form").orderBy("item_id", "position")
    first = rows.withColumn("_n", F.row_number().over(in_order)).where("_n = 1").drop("_n")
    known_forms = aliases.select(F.col("surface_form_normalized").alias("form"), F.col("entity_id").alias("by_form"))
    known_names = entities.groupBy(F.col("canonical_name_normalized").alias("name")).agg(F.min("entity_id").alias("by_name"))
    first = first.join(known_forms, "form", "left").join(known_names, "name", "left")
    minted = F.concat(F.lit("e:"), F.sha2(F.col("name"), 256))
    first = first.withColumn("entity_id", F.coalesce("by_form", "by_name", minted))
    new_rows = first.where("by_form is null and by_name is null")
    naming = Window.partitionBy("name").orderBy("item_id", "position")
    new = new_rows.withColumn("_n", F.row_number().over(naming)).where("_n = 1").select("entity_id", "canonical_name", F.col("name").alias("canonical_name_normalized"), entity_type(F.col("entity_type_guess")).alias("entity_type"), F.lit("discovered").alias("created_from"), F.lit(0).cast("long").alias("observation_count"))
    bound = rows.join(first.select("form", "entity_id"), "form")
    seen = bound.groupBy("entity_id").agg(F.count("*").alias("seen"))
    state = entities.unionByName(new).join(seen, "entity_id", "left").withColumn("observation_count", F.col("observation_count") + F.coalesce("seen", F.lit(0))).drop("seen")
    fresh = first.where("by_form is null").select(F.col("form").alias("surface_form_normalized"), "surface_form", "entity_id")
    links = bound.groupBy("item_id", "entity_id", "surface_form").agg(F.max_by("confidence", -F.col("position")).alias("confidence"))
    return {"entities": state, "aliases": aliases.unionByName(fresh), "item_entities": links}


def load_seeds(seeds: DataFrame, entities: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, aliases, new entities) after seeding.  Loading again changes nothing.

    ``seeds``: canonical_name, entity_type, alias.  A seed whose canonical name is known, as a name
    or an alias, leaves what is there untouched; a new one has no observations yet, and its
    aliases are added where they are free (of seeds that claim one, the first by name gets it).
    """
    known = entities.select(F.col("canonical_name_normalized").alias("name")).union(aliases.select("surface_form_normalized")).distinct()
    rows = seeds.withColumn("name", normalize_name(F.col("canonical_name"))).join(known, "name", "left_anti")
    rows = rows.withColumn("entity_id", F.concat(F.lit("e:"), F.sha2(F.col("name"), 256)))
    new = rows.groupBy("entity_id", F.col("name").alias("canonical_name_normalized")).agg(F.min(F.struct("canonical_name", "entity_type")).alias("n"))
    new = new.select("entity_id", "n.canonical_name", "canonical_name_normalized", entity_type(F.lower("n.entity_type")).alias("entity_type"), F.lit("seed").alias("created_from"), F.lit(0).cast("long").alias("observation_count"))
    forms = rows.withColumn("form", normalize_name(F.col("alias"))).groupBy("form").agg(F.min(F.struct((F.col("form") != F.col("name")).alias("k"), "name", "alias", "entity_id")).alias("s"))
    forms = forms.join(aliases.select(F.col("surface_form_normalized").alias("form")), "form", "left_anti")
    fresh = forms.select(F.col("form").alias("surface_form_normalized"), F.col("s.alias").alias("surface_form"), "s.entity_id")
    return entities.unionByName(new), aliases.unionByName(fresh), new


def candidate_pairs(names: DataFrame, decided: DataFrame | None = None, least: float = CANDIDATE_SCORE) -> DataFrame:
    """Pairs of entities of one type whose best score over their names reaches ``least``, best first.

    ``names``: entity_id, entity_type, name.  Quadratic within a type, as the operator is.
    """
    a = names.select(F.col("entity_id").alias("a"), "entity_type", F.col("name").alias("name_a"))
    b = names.select(F.col("entity_id").alias("b"), "entity_type", F.col("name").alias("name_b"))
    pairs = a.join(b, "entity_type").where("a < b").withColumn("score", token_set_ratio(F.col("name_a"), F.col("name_b")))
    best = pairs.groupBy("a", "b", "entity_type").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    best = best.withColumn("pair_key", pair_key(F.col("a"), F.col("b")))
    if decided is not None:
        best = best.join(decided.select("pair_key"), "pair_key", "left_anti")
    return best.orderBy(F.desc("score"), "pair_key")


def merge_decisions(candidates: DataFrame, entities: DataFrame, aliases: DataFrame, adjudicate: Callable[[dict], str], auto: float = AUTO_SCORE) -> DataFrame:
    """pair_key, score, ratio, method, decision, confidence, keep, drop of each pair that is decided.

    Pairs are decided as if one after another, best score first; a pair one of whose sides
    was absorbed before is skipped.  What an earlier pair decides matters only to pairs that
    share a side with it, so in each round all pairs that come first for both their sides
    are decided at once, and only those that need it are put to ``adjudicate`` (a row to an
    answer as JSON text, on the executors).  Names whose plain ratio reaches ``auto`` merge without asking.
    The survivor has more observations, then more aliases, then comes first.
    """
    counts = aliases.groupBy("entity_id").agg(F.count("*").alias("n"))
    facts = entities.join(counts, "entity_id", "left").select("entity_id", "canonical_name", "observation_count", F.coalesce("n", F.lit(0)).alias("n"))
    left = candidates
    for side in ("a", "b"):
        left = left.join(facts.select(F.col("entity_id").alias(side), F.struct("canonical_name", "observation_count", "n").alias(f"of_{side}")), side)
    rank = lambda s: F.struct(f"of_{s}.observation_count", f"of_{s}.n")
    second = rank("b") > rank("a")
    left = left.withColumn("ratio", ratio(F.col("of_a.canonical_name"), F.col("of_b.canonical_name"))).withColumn("keep", F.when(second, F.col("b")).otherwise(F.col("a"))).withColumn("drop", F.when(second, F.col("a")).otherwise(F.col("b")))
    left = left.withColumn("place", F.struct((-F.col("score")).alias("k"), "pair_key"))
    left = cut(left.select("pair_key", "a", "b", "of_a.canonical_name", F.col("of_b.canonical_name").alias("other_name"), "score", "ratio", "keep", "drop", "place"), "pairs")
    done: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("a", "b")).alias("side"), "place").groupBy("side").agg(F.min("place").alias("first"))
        turn = left
        for side in ("a", "b"):
            turn = turn.join(ends.select(F.col("side").alias(side), F.col("first").alias(f"first_{side}")), side)
        turn = turn.where("place = first_a and place = first_b").drop("first_a", "first_b")
        alike = turn.where(F.col("ratio") >= auto).withColumn("answer", F.lit(None).cast("string"))
        asked = turn.where(F.col("ratio") < auto)
        answers = provider_answers(asked.select("pair_key", "canonical_name", "other_name", "score"), "pair_key string, answer string", lambda row: [{"pair_key": row["pair_key"], "answer": adjudicate(row)}])
        both = alike.unionByName(asked.join(answers, "pair_key", "left").select(*alike.columns))
        told = parse_adjudication(F.col("answer"))
        sure = F.col("ratio") >= auto
        made = both.select("pair_key", "a", "b", "score", "ratio", F.when(sure, "auto").otherwise("adjudicator").alias("method"), F.when(sure | told["same"], "merge").otherwise("reject").alias("decision"), F.when(sure, F.col("ratio") / 100).otherwise(told["confidence"]).alias("confidence"), "keep", "drop")
        made = cut(made, "decisions")
        done.append(made)
        gone = made.where("decision = 'merge'").select("drop")
        left = left.join(made.select("pair_key"), "pair_key", "left_anti")
        for side in ("a", "b"):
            left = left.join(gone.withColumnRenamed("drop", side), side, "left_anti")
        left = cut(left, "pairs")
    empty = left.select("pair_key", "a", "b", "score", "ratio", F.lit("").alias("method"), F.lit("").alias("decision"), F.lit(0.0).alias("confidence"), "keep", "drop")
    return reduce(DataFrame.unionByName, done, empty)


def survivors(decisions: DataFrame) -> DataFrame:
    """(entity_id, survivor): where each absorbed entity ends up; chains are halved by joining the table with itself."""
    at = cut(decisions.where("decision = 'merge'").select(F.col("drop").alias("entity_id"), F.col("keep").alias("survivor")), "survivors")
    while True:
        step = at.select(F.col("entity_id").alias("survivor"), F.col("survivor").alias("next"))
        new = cut(at.join(step, "survivor", "left").select("entity_id", F.coalesce("next", "survivor").alias("survivor"), F.col("next").isNotNull().alias("moved")), "survivors")
        at = new.select("entity_id", "survivor")
        if new.where("moved").isEmpty():
            return at


def apply_merges(entities: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]], decisions: DataFrame) -> dict[str, DataFrame]:
    """Repoint every table (with its key) to the survivors, and write down who absorbed whom (``log``).

    Observation counts add up, and a seed among the merged makes the survivor a seed.  Where
    rows come to have one key, the survivor's own row stays, else that of the least former id.
    """
    gone = survivors(decisions)
    moved = lambda df: df.join(gone, "entity_id", "left").withColumn("_was", F.col("entity_id")).withColumn("entity_id", F.coalesce("survivor", "entity_id")).drop("survivor")
    sums = moved(entities.select("entity_id", "observation_count", "created_from")).groupBy("entity_id").agg(F.sum("observation_count").alias("total"), F.bool_or(F.col("created_from") == "seed").alias("seeded"))
    state = entities.join(gone, "entity_id", "left_anti").join(sums, "entity_id").withColumn("observation_count", F.col("total")).withColumn("created_from", F.when(F.col("seeded"), "seed").otherwise(F.col("created_from"))).drop("total", "seeded")
    out = {"entities": state}
    for name, (df, key) in tables.items():
        own = Window.partitionBy(*key).orderBy((F.col("_was") != F.col("entity_id")), "_was")
        out[name] = moved(df).withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n", "_was")
    named = entities.select("entity_id", "canonical_name")
    log = decisions.where("decision = 'merge'").select(F.col("keep").alias("survivor_id"), F.col("drop").alias("merged_id"), "method", "confidence")
    for side in ("survivor", "merged"):
        log = log.join(named.select(F.col("entity_id").alias(f"{side}_id"), F.col("canonical_name").alias(f"{side}_name")), f"{side}_id")
    return out | {"log": log}


def stance_results(pending: DataFrame, answers: DataFrame, keep_neutral: bool = True) -> DataFrame:
    """Stances of pending (item, entity) pairs; a pair that the detector left out is neutral with strength 0, and a gap."""
    found = pending.join(answers, ["item_id", "entity_id"], "left")
    done = found.select("item_id", "entity_id", F.coalesce("polarity", F.lit("neutral")).alias("polarity"), F.coalesce("strength", F.lit(0.0)).alias("strength"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("polarity").isNull().alias("gap"))
    return done if keep_neutral else done.where("polarity <> 'neutral'")
