"""Tools under one name, against a walk through the sightings."""

import random

from loomtrail.operators.tool_catalog import tool_catalog

SCHEMA = "run_id int, raw_name string, source string, kind string, place int"


def brute(rows):
    catalog = {}
    fold = lambda n: "".join(c for c in n.casefold() if c.isalnum())
    for kind in ("call", "session", "declared"):
        for run, raw, source, _, _ in sorted((r for r in rows if r[3] == kind), key=lambda r: r[4]):
            if not raw:
                continue
            names = [n for r, n in catalog if r == run]
            name = "Shown" if raw == "shown" or raw.endswith("__shown") else raw
            if name not in names and kind != "call":
                alike = [n for n in names if fold(n) == fold(name)]
                name = alike[0] if len(alike) == 1 else name
            e = catalog.setdefault((run, name), [0, set(), set(), set()])
            e[0] += kind == "call"
            e[1].add(kind)
            e[2].add(raw)
            e[3].add(source)
    return {k: (n, {"call", "session", "declared"} & kinds, sorted(raws), sorted(sources)) for k, (n, kinds, raws, sources) in catalog.items()}


def test_names_are_those_of_a_walk_through_all_sightings(spark):
    r = random.Random(2)
    names = ["Read", "read", "re_ad", "READ-", "mcp__x__shown", "shown", "Show n", "é", "É", "1a", "a1", "", None]
    rows = [(run, r.choice(names), r.choice("uvw"), r.choice(["call", "session", "session", "declared"]), n) for run in range(60) for n in range(r.randrange(9))]
    got = tool_catalog(spark.createDataFrame(rows, SCHEMA), {"shown": "Shown"}).collect()
    flags = lambda x: {k for k, c in (("call", "observed"), ("session", "available_in_session"), ("declared", "declared")) if x[c]}
    assert {(x["run_id"], x["name"]): (x["call_count"], flags(x), x["raw_names"], x["sources"]) for x in got} == brute(rows)
    assert tool_catalog(spark.createDataFrame([], SCHEMA)).count() == 0
