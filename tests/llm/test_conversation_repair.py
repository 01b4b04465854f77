"""Repair of conversations equals a search over all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from factloom.llm import conversation_repair as cr
from factloom.llm import oracles
from factloom.llm.queries import QUERIES
from tests.compare import duck, of_frame, of_sql

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("role", "text", "fault", "row", "state", "sha", "part"))])
GOOD = re.compile(r"(s?(ua)+)?")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def damage(rows):
    for conv, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)


def cheapest(rows):
    """Dijkstra over (rows dealt with, roles so far), in order of (cost, edits): the first end is the best."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, at, roles, out = heapq.heappop(heap)
        if at == len(rows) and GOOD.fullmatch(roles):
            return cost, edits, out
        # what may follow depends on the last role and on whether there is one
        if (at, roles[-1:]) in done or not any(GOOD.fullmatch(roles + end) for end in ("", "a", "ua")):
            continue
        done.add((at, roles[-1:]))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, edits + "I", at, roles + role[0], (*out, f"{role}:")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, edits + "D", at + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if role[:1] in ("s", "u", "a") and (role[:1] != "s" or not roles):
                    heapq.heappush(heap, (cost + more, edits + "K", at + 1, roles + role[:1], (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 2, edits + "R", at + 1, roles + new[0], (*out, f"{new}:{text}")))


def brute(rows):
    out = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for conv, *_ in rows}
    groups = {}
    for r in damage(rows):
        groups.setdefault(r[0], []).append(r)
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in found:
            inside = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not inside else "duplicate" if (role, text) in seen else "truncated" if inside[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, edits, texts = cheapest([(r[2], r[3], f) for r, f in zip(found, faults, strict=True)])
        turns = [r[1] for r in found if r[1] is not None]
        illegal = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(found))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return sorted(((k, *v) for k, v in out.items()), key=str)


def result(spark, rows):
    t = table(spark, rows)
    return sorted((tuple(r) for r in cr.repair_conversations(cr.damaged(t), t).collect()), key=str)


TEXTS = ["Yes.", "No", "Why?", " ", "", None, "Well.\n ", "é!", "Long " * 200 + "end."]


@pytest.mark.parametrize("piece", [512, 3, 1])
def test_equals_a_search_over_all_edits(spark, monkeypatch, piece):
    monkeypatch.setattr(cr, "PIECE_ROWS", piece)
    rng = random.Random(piece)
    rows = []
    for conv in [*range(60), None]:
        for i in range(rng.choice([1, 2, 4, 7])):
            turn = rng.choice([i, i, i, i + 3, None])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(TEXTS)))
    rows += [(7, 0, "user", "Yes.")] * 3
    # workers get the module by import, so the size of a piece is passed by the closure of the test
    assert result(spark, rows) == brute(rows)


def test_one_long_conversation_in_many_pieces(spark):
    rng = random.Random(1)
    rows = [(5, i, ("user", "assistant")[i % 2], f"Turn {i}{rng.choice(['.', '!', ''])}") for i in range(3000)]
    assert result(spark, rows) == brute(rows)
    same = [(5, 1, "user", "Yes.")] * 2000 + [(6, 2, "user", "Hm?")]
    assert result(spark, same) == brute(same)


def test_layers_are_made_once_for_a_prefix(monkeypatch):
    words = sorted("".join(w) for n in range(5) for w in itertools.product("suaxdUA", repeat=n))[::3]
    nodes = {w[:i] for w in words for i in range(1, len(w) + 1)}
    plain, made = cr.stepped, []
    monkeypatch.setattr(cr, "stepped", lambda layer, letter: made.append(1) or plain(layer, letter))
    found = dict(cr.trie_walk(iter(words)))
    assert len(made) == 4 * len(nodes) and list(found) == words
    alone = dict(pair for w in words for pair in cr.trie_walk(iter([w])))
    assert all(found[w] == alone[w] for w in words)


def test_empty_and_all_dropped(spark):
    assert result(spark, []) == []
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert result(spark, [(gone, 0, "user", "a.")]) == brute([(gone, 0, "user", "a.")])


def test_query_equals_sql_and_brute_force(spark, sf):
    got = QUERIES["op12_conversation_repair"](spark, sf)
    assert of_frame(got) == of_sql(duck(sf), oracles.ORACLES["op12_conversation_repair"])
    c = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([tuple(r) for r in c])
