import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import MINUTE, START, frame
from wardline.operators import profiles as P
from wardline.operators.bounded_lists import ANY, LIST, replay, spells


def literal(shown, limit):
    """(value, first, gone) of every stay by keeping the whole list at each step."""
    held, open_at, out = [], {}, []
    for at, value in shown:
        after = list(dict.fromkeys(held + [value]))[-limit:]
        for gone in [v for v in held if v not in after]:
            out.append((gone, open_at.pop(gone), at))
        if value not in held:
            open_at[value] = at
        held = after
    return sorted(out + [(v, at, None) for v, at in open_at.items()], key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=40), st.integers(1, 6), st.integers(1, 10))
def test_replay_in_chunks_is_the_literal_list(values, limit, chunk):
    held, added = [], []
    for start in range(0, len(values), chunk):
        part = values[start:start + chunk]
        new = replay(part, held, limit)
        added += [start + i for i in new]
        held = (held + [part[i] for i in new])[-limit:]
    stays = sorted([(values[i], i, added[k + limit] if k + limit < len(added) else None) for k, i in enumerate(added)], key=str)
    assert stays == literal(list(enumerate(values)), limit)


@pytest.mark.parametrize("chunk", [1_000_000, 37])
def test_spells_of_many_lists(spark, chunk):
    rng = random.Random(chunk)
    limits = {"small": 2, "large": 5}
    rows = [("", key, dim, rng.choice("abcdefgh"[:width]), START + i // 2 * MINUTE * 97, f"e{i // 2:04d}", i % 2)
            for key, width in (("k1", 8), ("k2", 3)) for dim in limits for i in range(200)]
    rows += [("s", "k1", "small", "a", START, "e", 0), ("", "k1", "small", ANY, START, "e0000", 7)]
    shown = spark.createDataFrame(rows, "scope string, key string, dim string, value string, us bigint, event_id string, place int")
    got = spells(shown, limits, chunk).collect()
    assert [r for r in got if r["value"] == ANY][0]["gone_at"] is None
    for scope, key, dim in {r[:3] for r in rows}:
        mine = sorted([((r[4], r[5], r[6]), r[3]) for r in rows if r[:3] == (scope, key, dim) and r[3] != ANY])
        want = sorted([(v, a[:2], b and b[:2]) for v, a, b in literal(mine, limits[dim])], key=str)
        found = sorted([(r["value"], tuple(r["first_at"]), r["gone_at"] and tuple(r["gone_at"])) for r in got if tuple(r[c] for c in LIST) == (scope, key, dim) and r["value"] != ANY], key=str)
        assert found == want


def test_values_seen_again_are_known_again(spark):
    """A list of two: c pushes out a, a comes back and pushes out b."""
    policy = P.ProfilePolicy(value_limits={**P.ProfilePolicy().value_limits, "resource": 2}, entity_minimum=1, list_chunk=3)
    order = ["a", "b", "c", "b", "a", "a", "b", "c"]
    rows = frame(spark, [{"resource_id": v} for v in order])
    chosen = P.choose_baseline(P.positions(rows), policy)
    seen = P.first_sightings(rows, None, policy)
    scores = {r["event_id"]: r["resource_novelty_score"] for r in P.novelty_features(rows, chosen, seen, policy).collect()}
    held, want = [], []
    for v in order:
        want.append(.25 if not want else float(v not in held))
        held = list(dict.fromkeys(held + [v]))[-2:]
    assert [scores[f"e{i:04d}"] for i in range(len(order))] == want
    known = {r["key"]: r["known"] for r in P.known_values(rows, ("resource",), policy).collect()}
    assert known["entity:clerk-07"] == held


def test_several_commands_of_one_event_push_each_other_out(spark):
    policy = P.ProfilePolicy(value_limits={**P.ProfilePolicy().value_limits, "transition": 2}, entity_minimum=1)
    rows = frame(spark, [{"command_sequence": ["a", "b", "c"]}, {"command_sequence": ["a", "b", "c"]}, {"command_sequence": ["a", "b", "c"]}])
    chosen = P.choose_baseline(P.positions(rows), policy)
    scores = {r["event_id"]: r["command_transition_novelty_score"] for r in P.novelty_features(rows, chosen, P.first_sightings(rows, None, policy), policy).collect()}
    # After an event the list holds a->b and b->c; the next event finds these two and not the first step.
    assert scores["e0001"] == pytest.approx(1 / 3)
    assert P.first_sightings(rows, None, policy).where(F.col("dim") == "transition").where(F.col("value") != ANY).where("gone_at IS NULL").groupBy("key").count().agg(F.max("count")).first()[0] == 2
