import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph, items, pairs, resolution, rollups
from loomgraph.plans import catalog
from loomgraph.schemas import EDGE, PROFILE
from loomgraph.sources import readers, writers
from loomgraph.streaming import collection


def test_edges_without_types(spark, tmp_path):
    """A column that is all null has no type in a file written by inference."""
    (tmp_path / "e").mkdir()
    base = {"edge_id": ["1"], "edge_type": ["forward"], "src_item_id": ["a"], "directed": [True], "observed_at": ["2024-01-01T00:00:00"], "origin": ["collected"], "evidence": ["{}"]}
    pq.write_table(pa.table(base | {"dst_item_id": pa.nulls(1), "weight": pa.nulls(1)}), tmp_path / "e/1.parquet")
    pq.write_table(pa.table(base | {"dst_item_id": ["b"], "weight": [0.5], "dst_external_ref": ["telegram:7:1"]}), tmp_path / "e/2.parquet")
    rows = readers.read_edges(spark, f"{tmp_path}/e/*.parquet")
    assert rows.schema == EDGE and {(r["dst_item_id"], r["weight"]) for r in rows.collect()} == {(None, None), ("b", 0.5)}


def test_seeds_and_handles(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"entities": [{"canonical_name": "Acme", "entity_type": "org", "aliases": ["ACME Inc"]}, {"canonical_name": "Old", "entity_type": "org", "aliases": []}]}))
    seeds = readers.read_seed_entities(spark, str(tmp_path / "s.json"))
    assert {r["alias"] for r in seeds.collect()} == {"Acme", "ACME Inc", "Old"}
    known = spark.createDataFrame([("old",)], "canonical_name_normalized string")
    forms = spark.createDataFrame([], "surface_form_normalized string")
    assert {r["canonical_name"] for r in readers.new_seeds(seeds, known, forms).collect()} == {"Acme"}
    (tmp_path / "c.csv").write_text("name,Telegram Handle\na,one\nb,  \nc,two\n")
    assert [r["handle"] for r in readers.read_seed_handles(spark, str(tmp_path / "c.csv")).collect()] == ["one", "two"]
    (tmp_path / "d.csv").write_text("name\na\n")
    with pytest.raises(ValueError):
        readers.read_seed_handles(spark, str(tmp_path / "d.csv"))


def test_refuses_to_overwrite(spark, tmp_path):
    rows = spark.createDataFrame([("a",)], "item_id string")
    writers.write_items(rows, str(tmp_path / "run"))
    with pytest.raises(Exception, match="exist"):
        writers.write_items(rows, str(tmp_path / "run"))


def _items(spark):
    rows = [("a", "h1", None, "x", "2024-01-01 00:00:00"), ("b", "h1", "m", "y", "2024-01-02 00:00:00"), ("c", None, "m", "y", "2024-01-02 00:00:01"), ("d", "h2", None, None, None), ("e", "h1", None, "x", "2024-01-05 00:00:00")]
    return spark.createDataFrame(rows, "item_id string, text_hash string, media_hash string, author_native_id string, published_at string").withColumn("published_at", F.col("published_at").cast("timestamp"))


def test_pairs_and_cocluster(spark):
    found = pairs.equal_pairs(pairs.hash_pool(_items(spark), ("text", "media")))
    got = {(r["src_item_id"], r["dst_item_id"], r["edge_type"]) for r in found.collect()}
    assert got == {("a", "b", "near_duplicate_text"), ("a", "e", "near_duplicate_text"), ("b", "e", "near_duplicate_text"), ("b", "c", "shared_media")}
    near = pairs.temporal_cocluster(found).collect()
    assert [(r["src_item_id"], r["dst_item_id"], r["time_delta_seconds"]) for r in near] == [("a", "b", 86400.0)]  # the window's end counts
    once, twice = pairs.derive_all(_items(spark)), pairs.derive_all(_items(spark))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_components_match_pairs(spark, sf_dir):
    rows = catalog._items(spark, sf_dir)
    pool = pairs.hash_pool(rows, ("text", "media")).cache()
    label = {r["item_id"]: r["label"] for r in graph.components(pool.select("item_id", F.concat("field", "hash").alias("hash"))).collect()}
    parent: dict[str, str] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in pairs.equal_pairs(pool).collect():
        a, b = sorted((find(r["src_item_id"]), find(r["dst_item_id"])))
        parent[b] = a
    assert {x: find(x) for x in parent} == label and label


def test_long_chain(spark):
    links = [(f"{i:03d}", f"h{i}") for i in range(60)] + [(f"{i + 1:03d}", f"h{i}") for i in range(60)]
    got = graph.components(spark.createDataFrame(links, "item_id string, hash string"))
    assert {r["label"] for r in got.collect()} == {"000"} and got.count() == 61


def test_profiles(spark):
    rows = spark.createDataFrame([("a", "telegram", "x"), ("b", "telegram", "x"), ("c", "telegram", None)], "item_id string, source_type string, author_native_id string").withColumn("published_at", F.lit("2024-01-01").cast("timestamp"))
    stance = spark.createDataFrame([("a", "e", "positive", 1.0), ("b", "e", "negative", 0.5), ("c", "e", "positive", 1.0)], "item_id string, entity_id string, polarity string, strength double")
    members = spark.createDataFrame([("tight:a", "a"), ("tight:a", "b")], "narrative_id string, item_id string")
    found = rollups.author_profiles(stance, rows, members)
    assert [f.name for f in found.schema] == PROFILE.names  # nothing that joins consistency and synchrony
    r = found.first()
    assert (r["author_id"], r["volume"], r["net_stance"], r["narrative_spread"]) == ("telegram:x", 2, 0.25, 1) and 0 <= r["stance_consistency"] <= 1


def test_resolve_in_order(spark):
    rows = [("1", 0, "PM", "Modi", "person", 0.9), ("1", 1, "Modi", "Modi", "person", 0.8), ("2", 0, "pm", "Khan", "person", 0.9), ("2", 1, "Acme ", "Acme", "Firm", 0.7)]
    mentions = spark.createDataFrame(rows, "item_id string, position int, surface_form string, canonical_name string, entity_type_guess string, confidence double")
    old = spark.createDataFrame([("e1", "Acme", "acme", "org", "seed", 0)], catalog._ENTITY)
    got = resolution.resolve(mentions, old, spark.createDataFrame([], catalog._ALIAS))
    state = {r["canonical_name"]: (r["entity_type"], r["observation_count"]) for r in got["entities"].collect()}
    assert state == {"Acme": ("org", 1), "Modi": ("person", 3)}  # pm was bound by its first mention
    assert {r["surface_form_normalized"] for r in got["aliases"].collect()} == {"pm", "modi", "acme"}
    again = resolution.resolve(mentions, got["entities"], got["aliases"])
    assert {r["canonical_name"]: r["observation_count"] for r in again["entities"].collect()} == {"Acme": 2, "Modi": 6}


def plain_merges(pairs, facts, ratio, yes, auto=93.0):
    """The decisions of a loop over the pairs, best first."""
    live, out = set(facts), {}
    for a, b, score in sorted(pairs, key=lambda p: (-p[2], f"{p[0]}|{p[1]}")):
        if a in live and b in live:
            same = ratio(facts[a][0], facts[b][0]) >= auto or yes(facts[a][0])
            keep, drop = (b, a) if facts[b][1:] > facts[a][1:] else (a, b)
            out[f"{a}|{b}"] = (same, keep, drop)
            live -= {drop} if same else set()
    return out


def test_merge_chain(spark):
    """Rounds of pairs decide as the loop does, also where entities are absorbed on the way."""
    import random

    from loomgraph.functions.fuzzy import _ratio

    rng = random.Random(3)
    names = ["ali mirza", "ali mirzaa", "mirza ali", "alia mirza", "ali mirzas", "bo li", "bo lii", "bob li", "li bo"]
    rows = [(f"e{i:02d}", rng.choice(names), "", "person", rng.choice(["seed", "discovered"]), rng.randint(0, 3)) for i in range(24)]
    ents = spark.createDataFrame(rows, catalog._ENTITY)
    aliases = spark.createDataFrame([(f"f{i}", "F", f"e{i % 5:02d}") for i in range(12)], catalog._ALIAS)
    n_aliases = {f"e{i:02d}": sum(k % 5 == i for k in range(12)) for i in range(24)}
    pairs = resolution.candidate_pairs(ents.select("entity_id", "entity_type", F.col("canonical_name").alias("name")))
    answer = lambda row: '{"same_entity": true, "confidence": 1}' if len(row["canonical_name"]) % 2 else "unsure"
    made = resolution.merge_decisions(pairs, ents, aliases, answer)
    want = plain_merges([(r["a"], r["b"], r["score"]) for r in pairs.collect()], {r[0]: (r[1], r[5], n_aliases[r[0]]) for r in rows}, _ratio, lambda name: len(name) % 2)
    assert {r["pair_key"]: (r["decision"] == "merge", r["keep"], r["drop"]) for r in made.collect()} == want
    final = {drop: keep for same, keep, drop in want.values() if same}
    end = lambda x: end(final[x]) if x in final else x
    assert {r["entity_id"]: r["survivor"] for r in resolution.survivors(made).collect()} == {x: end(x) for x in final}
    links = spark.createDataFrame([(f"i{k % 2}", f"e{k:02d}", k) for k in range(24)], "item_id string, entity_id string, mark long")
    out = resolution.apply_merges(ents, {"links": (links, ["item_id", "entity_id"])}, made)
    state = {r["entity_id"]: (r["observation_count"], r["created_from"]) for r in out["entities"].collect()}
    for x in {end(r[0]) for r in rows}:
        mine = [r for r in rows if end(r[0]) == x]
        seed = any(r[4] == "seed" for r in mine)
        assert state[x] == (sum(r[5] for r in mine), "seed" if seed else next(r[4] for r in mine if r[0] == x))
    kept = {(r["item_id"], r["entity_id"]): r["mark"] for r in out["links"].collect()}
    for (item, x), mark in kept.items():
        mine = [k for k in range(24) if f"i{k % 2}" == item and end(f"e{k:02d}") == x]
        assert mark == (int(x[1:]) if int(x[1:]) in mine else min(mine))
    assert out["log"].count() == len(final)
    assert resolution.merge_decisions(pairs.where("false"), ents, aliases, answer).count() == 0


def test_seed_precedence_and_neutral(spark, tmp_path):
    from loomgraph.sources import readers

    (tmp_path / "s.csv").write_text("Name, Telegram HANDLE \nx, one \ny,\n")
    got = lambda *a: sorted(r["handle"] for r in readers.seed_handles(spark, *a).collect())
    assert got(["a"], str(tmp_path / "s.csv"), ["d"]) == ["a"] and got([], str(tmp_path / "s.csv"), ["d"]) == ["one"] and got([], None, ["d"]) == ["d"]
    pending = spark.createDataFrame([("i", "e"), ("i", "f")], "item_id string, entity_id string")
    answers = spark.createDataFrame([("i", "e", "positive", 0.5, 0.9)], "item_id string, entity_id string, polarity string, strength double, confidence double")
    assert [r["entity_id"] for r in resolution.stance_results(pending, answers, keep_neutral=False).collect()] == ["e"]


def test_provider_once_a_row(spark):
    rows = spark.createDataFrame([("h1", "a b"), ("h2", "")], "text_hash string, text string")
    got = items.provider_answers(rows, "text_hash string, word string", lambda r: [{"text_hash": r["text_hash"], "word": w} for w in r["text"].split()])
    assert sorted(tuple(r) for r in got.collect()) == [("h1", "a"), ("h1", "b")]


def test_crash_between_write_and_commit(spark, tmp_path):
    rows = spark.range(30).withColumn("x", F.col("id") * 2)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    go = lambda **k: collection.collect(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "marks"), **k)
    with pytest.raises(Exception, match="broken"):
        go(fail_in=1)
    go()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).select("id").collect()) == list(range(30))
    spark.range(30, 40).withColumn("x", F.col("id")).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_limit_leaves_no_gap(spark):
    rows = spark.createDataFrame([("s", "k", i) for i in range(10)], "source string, key string, id long")
    marks = spark.createDataFrame([("s", "k", 3)], "source string, key string, mark long")
    some = collection.beyond(rows, marks, limit=2)
    assert sorted(r["id"] for r in some.collect()) == [4, 5]
    assert collection.advance(marks, some).first()["mark"] == 5
