"""Operators on small inputs against brute force and known results."""

import json
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from platlark.functions import geometry as G, platnames as P
from platlark.operators import answers as A, context as X, export as E, graph, prompts as B, runs as R
from platlark.operators.graph import connected_components
from platlark.plans import stages
from platlark.sources import readers, writers
from platlark.streaming import ingest

SQUARE = np.array([[0, 0], [0, 10], [10, 10], [10, 0], [0, 0]], dtype=float)
HOLE = np.array([[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]], dtype=float)


def clipped(*cases):
    """(pair, lo, hi) of every (line, rings), clipped together."""
    lines = [np.array(line, dtype=float) for line, _ in cases]
    edges = [np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) for r in rings]) for _, rings in cases]
    pair, lo, hi, ax, ay, bx, by = G.clip_pairs(
        np.concatenate(lines), np.array([len(x) for x in lines]), np.concatenate(edges), np.array([len(x) for x in edges])
    )
    for k, a, z, *ends in zip(pair, lo, hi, ax, ay, bx, by, strict=True):
        steps = np.hypot(*np.diff(lines[k], axis=0).T)
        for m, x, y in ((a, *ends[:2]), (z, *ends[2:])):
            at = np.append(0, np.cumsum(steps))
            assert (np.interp(m, at, lines[k][:, 0]), np.interp(m, at, lines[k][:, 1])) == pytest.approx((x, y))
    return [(int(k), float(a), float(z)) for k, a, z in zip(pair, lo, hi, strict=True)]


def test_clip_cuts_at_crossings_holes_and_edges():
    got = clipped(
        ([[-5, 5], [15, 5]], [SQUARE]),
        ([[-5, 5], [15, 5]], [SQUARE, HOLE]),
        ([[-5, 0], [15, 0]], [SQUARE]),
        ([[20, 0], [30, 0]], [SQUARE]),
        ([[1, 1], [1, 1]], [SQUARE]),
        ([[1, 1]], [SQUARE]),
        ([[2, 2], [2, 2], [2, 8], [20, 8], [20, 5], [5, 5]], [SQUARE, HOLE]),
    )
    assert got == [(0, 5.0, 15.0), (1, 5.0, 9.0), (1, 11.0, 15.0), (2, 5.0, 15.0), (6, 0.0, 14.0), (6, 37.0, 41.0)]
    assert clipped(([[20, 0], [30, 0]], [SQUARE])) == []


@pytest.mark.parametrize("seed", range(5))
def test_clip_matches_dense_samples(seed):
    rng = np.random.default_rng(seed)
    cases = []
    for _ in range(6):
        angle = np.sort(rng.uniform(0, 2 * np.pi, 9))
        ring = np.stack([np.cos(angle), np.sin(angle)], axis=1) * rng.uniform(3, 9, (9, 1))
        cases.append((rng.uniform(-9, 9, (7, 2)), [np.concatenate([ring, ring[:1]])]))
    got = clipped(*cases)
    for k, (line, rings) in enumerate(cases):
        steps = np.hypot(*np.diff(line, axis=0).T)
        at = np.append(0, np.cumsum(steps))
        m = np.linspace(0, at[-1], 20_001)
        inside = G.inside(np.stack([np.interp(m, at, line[:, 0]), np.interp(m, at, line[:, 1])], axis=1), rings)
        assert sum(z - a for i, a, z in got if i == k) == pytest.approx(inside.mean() * at[-1], abs=0.02)


def test_ring_distance():
    far = SQUARE + [30, 0]
    assert G.ring_distance([SQUARE], [far]) == pytest.approx(20)
    assert G.ring_distance([SQUARE], [SQUARE / 4 + 2]) == 0


def test_projection(spark):
    """The arc along the central meridian by quadrature; away from it, equal scale north and east and the known grid scale."""
    at = lambda lon, lat: (lambda p: np.array([p.x, p.y]))(spark.range(1).select(G.to_utm(F.lit(lon), F.lit(lat)).alias("p")).first()["p"])
    e2 = 2 / G.INVERSE_F - 1 / G.INVERSE_F**2
    phi = np.radians(np.linspace(0, 43.6, 20001))
    arc = np.trapezoid(G.A * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi)
    assert at(-117.0, 43.6) == pytest.approx((500000, 0.9996 * arc), abs=1e-3)
    p, d = np.radians(43.6), 1e-5
    meridian, normal = G.A * (1 - e2) / (1 - e2 * np.sin(p) ** 2) ** 1.5, G.A / np.sqrt(1 - e2 * np.sin(p) ** 2)
    here = at(-116.2, 43.6)
    north = (at(-116.2, 43.6 + d) - here) / (np.radians(d) * meridian)
    east = (at(-116.2 + d, 43.6) - here) / (np.radians(d) * normal * np.cos(p))
    scale = 0.9996 * (1 + ((here[0] - 500000) / 0.9996) ** 2 / (2 * meridian * normal))
    assert np.hypot(*north) == pytest.approx(scale, abs=1e-6) and np.hypot(*east) == pytest.approx(scale, abs=1e-6)
    assert abs(north @ east) < 1e-6


def piece(m, a, b):
    return {"m": m, "a": {"x": a[0], "y": a[1]}, "b": {"x": b[0], "y": b[1]}}


def test_one_theme():
    words = {"birds": ["bird"], "bird species": ["bird", "spec"], "trees": ["tree"], "gems": ["gem"]}
    theme = lambda *t: E.one_theme(list(t), [words[x] for x in t])
    assert theme("birds", "birds", "bird species", "birds", "trees") == "birds"
    assert theme("birds", "birds", "birds", "trees", "trees", "trees") == ""
    assert theme("birds", "birds") == ""


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_match_brute_force(spark, pairs):
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    df = spark.createDataFrame(pairs or [(None, None)], "src long, dst long")
    want = {x: find(x) for x in linked}
    assert {r.node: r.component for r in connected_components(df).collect()} == want
    with pytest.MonkeyPatch.context() as m:
        m.setattr(graph, "SMALL_GRAPH", -1)
        assert {r.node: r.component for r in connected_components(df).collect()} == want


def test_answer_tables(spark):
    text = "Sure:\n| n | street | choice | confidence |\n|---|---|\n| 1 | Elm | `b` | High | trees | why |\n| 2 | Oak | Z | low |\n| 3 | Fir | **NONE** |\n| 3 | Fir | INVENTED | low |"
    rows = A.table_rows(spark.createDataFrame([("c", text)], "custom_id string, text string")).orderBy("n").collect()
    assert [(r.n, r.choice, r.confidence, r.theme) for r in rows] == [(1, "B", "high", "trees"), (3, "INVENTED", "low", "")]


def test_guards():
    with pytest.raises(R.Refused, match="pending"):
        R.guard(True, True, False, 500, False)
    with pytest.raises(R.Refused, match="sent before"):
        R.guard(False, True, False, 1, True)
    with pytest.raises(R.Refused, match="at most"):
        R.guard(False, True, True, 201, True)
    assert R.guard(False, False, False, 10, False) is False
    assert R.guard(False, False, False, 10, True) is True
    with pytest.raises(R.Refused):
        R.newer_or_same("2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z")
    R.newer_or_same(None, "2024-02-01T00:00:00Z")


def test_short_phases(spark):
    d = spark.createDataFrame([("Elm, Phase 2", "Elm"), ("Elm", "Elm"), ("Oak", "Elm")], "full string, label string")
    assert [r.s for r in d.select(E.short_phase(F.col("full"), F.col("label")).alias("s")).collect()] == ["Phase 2", "Elm", "Oak"]


LAT, LON = 43.6, -116.2


def town(folder: Path):
    """Two streets in one plat of two phases, a third outside."""

    def way(k, name, points, nodes):
        return {"type": "way", "id": k, "nodes": nodes, "tags": {"name": name, "highway": "residential"}, "geometry": [{"lat": LAT + y * 1e-4, "lon": LON + x * 1e-4} for x, y in points]}

    def plat(k, name, box, ms):
        x0, y0, x1, y1 = box
        ring = [[LON + x * 1e-4, LAT + y * 1e-4] for x, y in ((x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0))]
        return {"attributes": {"OBJECTID": k, "SubdivisionName": name, "RecordedDate": ms, "InitialTaxYear": None}, "geometry": {"rings": [ring]}}

    ways = [way(1, "West Robin Street", [(1, 1), (9, 1)], [1, 2]), way(2, "North Wren Court", [(5, 1), (5, 9)], [2, 3]), way(3, "Finch Road", [(12, 1), (20, 1)], [4, 5]), way(4, "", [(0, 0), (1, 1)], [])]
    plats = [plat(1, "ELM GROVE SUB NO 01", (0, 0, 10, 5), 0), plat(2, "ELM GROVE SUB NO 02", (0, 5, 10, 10), 86_400_000 * 800)]
    (folder / "ways.json").write_text(json.dumps({"elements": ways}))
    (folder / "plats.json").write_text(json.dumps({"features": plats}))
    hit = lambda q: [{"qid": q, "label": q.lower(), "description": "", "matched": q, "match_type": "label"}]
    (folder / "candidates.json").write_text(json.dumps({"robin": hit("Q1"), "wren": hit("Q2"), "finch": []}))


def test_stages_end_to_end(spark, tmp_path):
    town(tmp_path)
    m = stages.measure(readers.ways(spark, str(tmp_path / "ways.json")), readers.plats(spark, str(tmp_path / "plats.json")))
    contexts, scored = stages.decide(m)
    ctx = {r.place_id: r for r in contexts.collect()}
    assert set(ctx) == {"robin#0", "wren#0", "finch#0"}
    robin, finch = ctx["robin#0"], ctx["finch#0"]
    assert (robin.name, robin.naming_plat, robin.naming_phase) == ("West Robin Street", "Elm Grove", "Elm Grove, Phase 1")
    assert robin.confidence == 0.95 and robin.peers == ["wren#0"] and robin.attached == ["wren#0"]
    assert finch.naming_plat is None and finch.peers == [] and finch.attached == []
    candidates = readers.candidates(spark, str(tmp_path / "candidates.json"))
    requests, index, cost = stages.ask(contexts, candidates)
    assert [(r.n, r.place) for r in index.orderBy("n").collect()] == [(1, "robin#0"), (2, "wren#0")]
    prompt = requests.first()["prompt"]
    assert "### 1. West Robin Street\n- **Subdivision:** Elm Grove, platted 1970\n- **Confidence this subdivision laid the street out:** 0.95" in prompt
    assert "- **Named by that subdivision:** Wren\n" in prompt and "    - **A.** q1 — (no description)" in prompt
    assert prompt.startswith("# Street etymology — 2 items") and "## Items (2)" in prompt
    assert cost.first()["input_tokens"] == int(len(prompt) / 2.37)
    reply = {"custom_id": "batch-0000", "result": {"type": "succeeded", "message": {"content": [{"type": "text", "text": "| 1 | West Robin Street | A | high | birds | x |"}], "usage": {"input_tokens": 1, "output_tokens": 2}}}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/r.jsonl").write_text(json.dumps(reply) + "\n\n" + json.dumps({"custom_id": "x", "result": {"type": "errored", "error": "boom"}}) + "\n")
    results = readers.results(spark, str(tmp_path / "in"))
    got = {r.place: (r.status, r.qid) for r in stages.read(results, index, candidates).collect()}
    assert got == {"robin#0": ("answered", "Q1"), "wren#0": ("missing", "")}
    assert [(r.custom_id, r.error) for r in A.failures(results).collect()] == [("x", "boom")]
    answers = A.latest(stages.read(results, index, candidates).filter("status = 'answered'").withColumn("file_no", F.lit(0)))
    streets, subdivisions, phases = stages.draw(m, contexts, scored, answers, candidates)
    seen = {r.place: (r.category, r.not_asked_because, r.plat_year) for r in streets.collect()}
    assert seen == {"robin#0": ("ENTITY", "", 1970), "wren#0": ("NOT_ASKED", "not_in_a_run_yet", 1970), "finch#0": ("NOT_ASKED", "no_wikidata_candidate", None)}
    sub = subdivisions.collect()
    assert [(s.subdivision, s.phases, s.named, s.recorded_from, s.recorded_to) for s in sub] == [("Elm Grove", ["Elm Grove, Phase 1", "Elm Grove, Phase 2"], ["robin#0", "wren#0"], 1970, 1972)]
    by_phase = {p.phase: (p.named, p.through) for p in phases.collect()}
    assert by_phase["Phase 2"] == ([], ["wren#0"])
    writers.feature_document(E.street_features(streets), str(tmp_path / "map"), E.legend(streets))
    text = "".join(p.read_text() for p in (tmp_path / "map").glob("part-*"))
    assert len(json.loads(text)["features"]) == 3 and json.loads(text)["counts"]["category"] == {"ENTITY": 1, "NOT_ASKED": 2}
    writers.csv(index, str(tmp_path / "index"), ["n"])
    assert readers.batch_index(spark, str(tmp_path / "index")).count() == 2
    ingest.parse_into(ingest.result_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("choice").collect()[0][0] == "A"


def test_selection_and_chunks(spark):
    ctx = spark.createDataFrame([(f"c{i:03}#0", f"c{i:03}", f"S{i}", f"S{i}") for i in range(90)], "place_id string, core string, name string, display string")
    lines = ctx.select("core", F.array(F.lit("x")).alias("lines"))
    drop = ctx.filter("core < 'c005'").select("place_id")
    items = B.numbered_items(ctx, lines, exclude=drop)
    index = B.batch_index(items).orderBy("n").collect()
    assert [r.n for r in index] == list(range(1, 86)) and index[0].place == "c005#0"
    assert {r.custom_id: sum(x.custom_id == r.custom_id for x in index) for r in index} == {"batch-0000": 40, "batch-0001": 40, "batch-0002": 5}
    assert B.numbered_items(ctx, lines, sample=7, seed=3).count() == 7
    assert B.numbered_items(ctx, lines, only=drop, limit=2).count() == 2


def test_plat_label_helpers(spark):
    cases = [
        ("MRS A M WILSON", "MRS A. M. WILSON", "Mrs A M Wilson"),
        ("02ND STREET OF MCKAY", "02ND STREET OF MCKAY", "2nd Street of McKay"),
        ("A T", "A. T.", "A T"),
        ("B BAR B ACRES", "B BAR B ACRES", "B Bar B Acres"),
        ("TOYS R US", "TOYS R US", "Toys R Us"),
        ("O'NEIL, THE", "O'NEIL, THE", "The O'Neil"),
        ("COLONY VII AT Sunset", "COLONY VII AT Sunset", "Colony VII at Sunset"),
        ("", "", ""),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    got = df.select("i", P.dotted(F.col("x")).alias("d"), P.title(F.col("x")).alias("t")).orderBy("i").collect()
    assert [(r.d, r.t) for r in got] == [c[1:] for c in cases]
