"""Orphan references against a brute-force version, and the defined edge cases."""

import random
import re
import unicodedata
from datetime import datetime, timedelta

from lexweave.operators import orphans

REL = "rel_id long, source string, target string, loaded_at timestamp"
ENT = "id string, name string, source_chunk_ids array<string>, loaded_at timestamp"
UNIT = "chunk_id string, loaded_at timestamp"
TOMB = "kind string, deleted_key string, deleted_at timestamp"


def key(v):
    if v is None:
        return ""
    v = re.sub("[​‌‍﻿]", "", unicodedata.normalize("NFC", v)).translate(str.maketrans("๐๑๒๓๔๕๖๗๘๙", "0123456789"))
    return " ".join(v.split())


def brute(rel, ent, unit, tomb):
    first: dict = {}
    for kind, rows in (("entity", [(n, t) for _, n, _, t in ent]), ("chunk", unit)):
        for k, t in rows:
            if key(k):
                old = first.get((kind, key(k)), "none")
                first[(kind, key(k))] = t if old in ("none", None) else old if t is None else min(old, t)
    dead = {(k, key(d)) for k, d, _ in tomb}
    refs: dict = {}
    for i, s, t, at in rel:
        for field, k in (("source", s), ("target", t)):
            refs.setdefault(("relationships", None if i is None else str(i), field, k, "entity", s, t), []).append(at)
    for i, _, ks, at in ent:
        for k in set(ks or []):
            refs.setdefault(("entities", i, "source_chunk_ids", k, "chunk", str(ks), ""), []).append(at)
    out = set()
    for (table, i, field, k, kind, *_), times in refs.items():
        if not key(k):
            continue
        known = [t for t in times if t is not None]
        at = min(known) if known else None
        p = (kind, key(k))
        if p not in first:
            out.add((table, i, field, k, "deleted" if p in dead else "missing"))
        elif first[p] is not None and at is not None and first[p] > at:
            out.add((table, i, field, k, "late"))
    return out


def run(spark, rel, ent, unit, tomb, **kw):
    df = orphans.orphan_references(spark.createDataFrame(rel, REL), spark.createDataFrame(ent, ENT), spark.createDataFrame(unit, UNIT), spark.createDataFrame(tomb, TOMB), **kw)
    return {tuple(r) for r in df.select("ref_table", "ref_id", "ref_field", "ref_key", "status").collect()}


def data(seed, n=300):
    rng = random.Random(seed)
    t = lambda: None if rng.random() < 0.05 else datetime(2024, 1, 1) + timedelta(days=rng.randrange(100))
    names = [f"[พรบ.{i % 7}] มาตรา {i}" for i in range(60)]
    odd = lambda v: rng.choice([v, v, v, f" {v}", v.replace(" ", "  "), v.replace("1", "๑"), v[:2] + "​" + v[2:], None, "", "　", "﻿"])
    ent = [(f"e{i}", names[i], [f"c{rng.randrange(40)}", f"c{rng.randrange(40)}", odd("c5")] if i % 9 else None, t()) for i in range(40)]
    unit = [(f"c{i}", t()) for i in range(25)]
    tomb = [("entity", n, None) for n in names[35:50]] + [("chunk", f"c{i}", None) for i in range(20, 32)]
    hot = names[55]
    rel = [(i, odd(rng.choice(names)), hot if rng.random() < 0.4 else odd(rng.choice(names)), t()) for i in range(n)]
    rel += [(i, s, x, a + timedelta(days=1) if a else a) for i, s, x, a in rel[:20]]
    return rel, ent, unit, tomb


def test_equals_brute_force(spark):
    for seed in (1, 2):
        d = data(seed)
        assert run(spark, *d) == brute(*d)
    assert run(spark, *data(1), hot_share=0.01, salts=3) == brute(*data(1))
    assert run(spark, *data(1), hot_share=2.0) == brute(*data(1))


def test_empty_tables(spark):
    rel, ent, unit, tomb = data(3)
    assert run(spark, [], [], [], []) == set()
    assert run(spark, [], [], unit, tomb) == set()
    assert run(spark, rel, [], [], []) == brute(rel, [], [], [])
    assert run(spark, rel, ent, [], tomb) == brute(rel, ent, [], tomb)


def test_nulls_repeats_and_clashing_columns(spark):
    at = datetime(2024, 1, 1)
    rel = [(None, "a", None, None), (1, "a", "b", at), (1, "a", "b", at + timedelta(days=9)), (1, "a", "b", at), (2, "x" * 100_000, "ก", at)]
    ent = [("e", None, None, None), ("f", "ก", [None, ""], at), ("f", "ก", [None, ""], at)]
    got = run(spark, rel, ent, [(None, None)], [(None, None, None)])
    assert got == brute(rel, ent, [(None, None)], [(None, None, None)])
    more = [spark.createDataFrame(r, s).selectExpr("*", "1 as key", "2 as kind", "3 as salt", "4 as is_ref", "5 as live", "6 as valid_from", "7 as spread", "8 as status") for r, s in ((rel, REL), (ent, ENT), ([("c", at)], UNIT))]
    found = orphans.orphan_references(*more, spark.createDataFrame([("entity", "a", at)], TOMB))
    assert {r.status for r in found.collect() if r.ref_key == "a"} == {"deleted"}
    report = orphans.orphan_report(found).collect()
    assert sum(r.n_references for r in report) == found.count()
