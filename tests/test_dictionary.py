"""Dictionary matching and the registry of entities, against plain loops."""

import random
import re
import time

from presswork.operators import kg
from presswork.operators.dictionary import Matcher, folded


def by_patterns(entries, text):
    """Each alias as a pattern of its own, then the claims."""
    out, spans, taken = [], [], set()
    for alias, entity in entries:
        found = re.search(rf"(?<!\w){re.escape(alias)}(?!\w)", text, re.I)
        if found and entity not in taken and all(found.end() <= a or b <= found.start() for a, b in spans):
            taken.add(entity)
            spans.append(found.span())
            out.append((entity, found[0]))
    return out


def some_gazetteer(rng, n):
    word = lambda: "".join(rng.choice("abÉß1") for _ in range(rng.randrange(1, 4)))
    make = lambda: " ".join(word() for _ in range(rng.randrange(1, 4)))
    return [{"name": f"e{i}", "type": "drug", "aliases": [make() for _ in range(rng.randrange(1, 4))]} for i in range(n)]


def test_claims_equal_patterns_with_overlapping_aliases():
    rng = random.Random(3)
    for _ in range(60):
        gaz = some_gazetteer(rng, 12)
        found = Matcher(kg.aliases(gaz))
        for _ in range(20):
            text = "".join(rng.choice("abÉéßAB1  -.") for _ in range(rng.randrange(60)))
            assert found.claims(text) == by_patterns(kg.aliases(gaz), text), (gaz, text)
    assert found.claims(None) == found.claims("") == []


def test_borders_and_case():
    found = Matcher([("Straße-7", 0), ("naïve", 1), ("x", 2), ("C++", 3)])
    assert found.claims("STRAßE-7 NAÏVE x_ 'X'") == [(0, "STRAßE-7"), (1, "NAÏVE"), (2, "X")]
    assert found.claims("naïves xx ́x x́ _x") == []
    assert found.claims("C++x") == [(2, "x"), (3, "C++")] and found.claims("C++ x") == [(2, "x")]  # a sign has its border before a word
    assert folded("ẞſİ") and len(folded("ẞſİ")) == 3


def test_many_aliases_take_no_longer_for_a_text(spark):
    rng = random.Random(4)
    few = [{"name": f"n{i}", "type": "gene", "aliases": [f"gene{i}", f"the gene {i}"]} for i in range(54)]
    many = few + [{"name": f"m{i}", "type": "gene", "aliases": [f"marker{i} of {i % 7}"]} for i in range(100_000)]
    texts = [" ".join(rng.choice(["the", "gene", f"gene{rng.randrange(80)}", f"{rng.randrange(60)}", "marker9 of 2"]) for _ in range(200)) for _ in range(300)]
    took, got = [], []
    for gaz in (few, many):
        found = Matcher(kg.aliases(gaz))
        start = time.process_time()
        got.append([[e for e in found.claims(t) if e[0] < 54] for t in texts])
        took.append(time.process_time() - start)
    assert got[0] == got[1] and took[1] < 4 * took[0] + 0.5
    df = spark.createDataFrame(list(enumerate(texts)) + [(900, None)], "id bigint, text string")
    rows = {(r.article_id, r.pos, r.entity, r.mention_text) for r in kg.mentions(df, many).collect()}
    assert rows == {(i, n, *c) for i, t in enumerate(texts) for n, c in enumerate(Matcher(kg.aliases(many)).claims(t))}


def in_turn(requests, registry):
    """The rule as a loop: {arrival: (name, type, external id) of the entity}, new ones."""
    known, new, out = list(registry), [], {}
    for arrival, name, kind, ext in sorted(requests, key=lambda r: r[0]):
        hit = next((e for e in known if ext and e[2] == ext), None) or next((e for e in known if e[:2] == (name, kind)), None)
        if hit is None:
            hit = (name, kind, ext)
            known.append(hit)
            new.append(hit)
        out[arrival] = hit
    return out, new


def test_registry_equals_the_rule_in_turn(spark):
    rng = random.Random(7)
    columns = "arrival bigint, name string, entity_type string, external_source string, external_id string"
    registry, stored = [], spark.createDataFrame([], "entity_id bigint, name string, entity_type string, external_source string, external_id string")
    for batch in range(3):
        pick = lambda: (rng.choice("abcdef"), rng.choice(["drug", "gene"]), rng.choice([None, None, "", *[f"X{i}" for i in range(7)]]))
        asked = [(batch * 100 + i, *pick()) for i in range(60)]
        want, new = in_turn(asked, registry)
        df = spark.createDataFrame([(a, n, k, "S", x) for a, n, k, x in asked], columns)
        resolved, made = kg.resolve(df.repartition(3), stored)
        made = made.cache()
        assert sorted((r.name, r.entity_type, r.external_id or "") for r in made.collect()) == sorted((n, k, x or "") for n, k, x in new)
        stored = spark.createDataFrame(stored.union(made).collect(), stored.schema)
        named = {r.entity_id: (r.name, r.entity_type, r.external_id) for r in stored.collect()}
        assert {r.arrival: named[r.entity_id] for r in resolved.collect()} == want
        registry += new
    assert len(named) == len(registry)


def test_one_name_with_and_without_an_external_id_is_one_entity(spark):
    rows = [(1, "aspirin", "drug", None, None), (2, "aspirin", "drug", "CHEBI", "15365"), (3, "acetylsalicylate", "drug", "CHEBI", "15365")]
    df = spark.createDataFrame(rows, "arrival bigint, name string, entity_type string, external_source string, external_id string")
    resolved, made = kg.resolve(df, spark.createDataFrame([], "entity_id bigint, name string, entity_type string, external_source string, external_id string"))
    ids = {r.arrival: r.entity_id for r in resolved.collect()}
    assert ids[1] == ids[2] != ids[3] and made.count() == 2
