"""Files and runs: layers and stage tables on disk, the command line, the life of a run, paged sources."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from platlark.__main__ import main
from platlark.functions import geometry as G
from platlark.operators import export as E
from platlark.operators.lifecycle import Folder, Rejected, RunLog
from platlark.operators.runs import Refused
from platlark.sources import paged, readers
from tests.test_operators import town


def test_projection_goes_back(spark):
    points = [(-116.2, 43.6), (-117.0, 43.0), (-115.01, 44.9), (-116.9, -3.0)]
    df = spark.createDataFrame(points, "lon double, lat double").withColumn("p", G.to_utm(F.col("lon"), F.col("lat")))
    for r in df.withColumn("q", G.to_lonlat(F.col("p.x"), F.col("p.y"))).collect():
        assert (r.q.lon, r.q.lat) == pytest.approx((r.lon, r.lat), abs=1e-8)


def test_polygons_with_holes_and_parts(spark):
    def square(x, y, m, hole=False):
        ring = [(x, y), (x, y + m), (x + m, y + m), (x + m, y), (x, y)]
        return ring[::-1] if hole else ring

    at = 560_000.0, 4_828_000.0
    outer, hole, other = square(*at, 900), square(at[0] + 200, at[1] + 200, 300, True), square(at[0] + 2000, at[1], 500)
    rows = [(1, [outer, hole]), (2, [outer, hole, other]), (3, []), (4, [hole]), (5, [[at] * 5])]
    df = spark.createDataFrame(rows, "family long, rings array<array<struct<x: double, y: double>>>").withColumn("theme", F.lit(None).cast("string"))
    got = {r.place: json.loads(r.feature) for r in E.polygon_features(df, "family").collect()}
    assert sorted(got) == [1, 2, 4] and got[1]["properties"] == {"family": 1, "theme": None}
    assert (got[1]["geometry"]["type"], len(got[1]["geometry"]["coordinates"])) == ("Polygon", 2)
    assert (got[2]["geometry"]["type"], [len(p) for p in got[2]["geometry"]["coordinates"]]) == ("MultiPolygon", [2, 1])
    ring = got[4]["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] and all(-117 < lon < -116 and 43 < lat < 44 for lon, lat in ring)


def test_command_line_runs_every_stage(spark, tmp_path, capsys):
    town(tmp_path)
    at = lambda name: str(tmp_path / name)
    main(["measure", "--ways", at("ways.json"), "--plats", at("plats.json"), "--out", at("measures")], spark)
    main(["context", "--measures", at("measures"), "--out", at("context")], spark)
    main(["context", "--measures", at("measures"), "--dump", "West Robin Street"], spark)
    told = capsys.readouterr().out
    assert "[robin#0]" in told and "North Wren Court" in told
    main(["batch", "--context", at("context"), "--candidates", at("candidates.json"), "--out", at("batch")], spark)
    lines = [json.loads(r.value) for r in spark.read.text(at("batch/requests")).collect()]
    assert [x["custom_id"] for x in lines] == ["batch-0000"]
    index = {r.place: r.n for r in readers.batch_index(spark, at("batch/index")).collect()}
    assert index == {"robin#0": 1, "wren#0": 2}
    main(["batch", "--context", at("context"), "--candidates", at("candidates.json"), "--exclude", at("batch/index"), "--out", at("rest")], spark)
    assert spark.read.text(at("rest/requests")).count() == 0
    table = "| n | street | choice | confidence | theme | reasoning |\n| 1 | a | A | high | birds | x |\n| 2 | b | NONE | low | | y |"
    message = {"content": [{"type": "text", "text": table}], "stop_reason": "end_turn", "usage": {"input_tokens": 1, "output_tokens": 2}}
    (tmp_path / "results.jsonl").write_text(json.dumps({"custom_id": "batch-0000", "result": {"type": "succeeded", "message": message}}) + "\n")
    main(["answers", "--results", at("results.jsonl"), "--index", at("batch/index"), "--candidates", at("candidates.json"), "--out", at("answers")], spark)
    assert {r.place: r.qid or "" for r in readers.answers(spark, [at("answers")]).collect()} == {"robin#0": "Q1", "wren#0": ""}
    main(["draw", "--measures", at("measures"), "--context", at("context"), "--candidates", at("candidates.json"), "--answers", at("answers"), "--out", at("map")], spark)
    layers = {x: json.loads("".join(r.value for r in spark.read.text(at(f"map/{x}")).collect())) for x in ("streets", "subdivisions", "phases")}
    assert [len(layers[x]["features"]) for x in ("streets", "subdivisions", "phases")] == [3, 1, 2]
    (plat,) = layers["subdivisions"]["features"]
    # its two plats share a side, so they are drawn as one outline
    assert plat["geometry"]["type"] == "Polygon" and len(plat["geometry"]["coordinates"]) == 1 and plat["properties"]["phase_count"] == 2
    (tmp_path / "claims.csv").write_text("item,type\nhttp://kb.example.org/entity/Q1,\n")
    main(["filter", "--candidates", at("candidates.json"), "--claims", at("claims.csv"), "--out", at("kept.json")], spark)
    assert {k for k, hits in json.loads((tmp_path / "kept.json").read_text()).items() if hits} == {r.core for r in readers.candidates(spark, at("kept.json")).collect()}
    assert json.loads((tmp_path / "context" / "contexts.json").read_text()).keys() == {r.place_id for r in spark.read.parquet(at("context/contexts")).collect()}
    with pytest.raises(SystemExit):
        main(["measure", "--ways", "x", "--plats", "y"], spark)


class Service:
    """A service that counts what is posted."""

    def __init__(self, fail: Exception | None = None):
        self.fail, self.sent, self.asked = fail, [], 0

    def post(self, requests):
        self.sent.append(requests)
        if self.fail:
            raise self.fail
        return {"id": f"b{len(self.sent)}"}

    def batches(self):
        return [{"id": "b1"}, {"id": "lost"}]

    def batch(self, batch_id):
        return {"id": batch_id, "status": "ended"}

    def cancel(self, batch_id):
        return {"id": batch_id, "status": "canceling"}

    def results(self, batch_id):
        self.asked += 1
        return iter([b"one\n", b"two\n"])

    def models(self):
        return ["m-1"]


def run(digest, when="2024-01-01T00:00:00Z"):
    return {"digest": digest, "submitted": when}


def test_a_run_is_sent_once_and_recorded(spark, tmp_path):
    log, service = RunLog(spark, str(tmp_path)), Service()
    assert log.submit(service, [{}], run("d1")) is None and not service.sent
    assert log.submit(service, [{}], run("d1"), confirmed=True)["batch_id"] == "b1"
    with pytest.raises(Refused, match="sent before"):
        log.submit(service, [{}], run("d1"), confirmed=True)
    with pytest.raises(Refused, match="at most"):
        log.submit(service, [{}] * 201, run("d2"), confirmed=True)
    assert log.submit(service, [{}], run("d1", "2024-01-02T00:00:00Z"), confirmed=True, again=True)["batch_id"] == "b2"
    assert len(service.sent) == 2 and log.latest()["batch_id"] == "b2" and [r["batch_id"] for r in log.records()] == ["b1", "b2"]
    (tmp_path / "broken.json").write_text("{")
    assert len(log.records()) == 2
    assert log.status(service) == {"id": "b2", "status": "ended"} and log.cancel(service, "b1")["status"] == "canceling"
    with pytest.raises(Refused, match="no record"):
        log.status(service, "b9")
    assert log.verify(service, "m-1")
    with pytest.raises(Refused):
        log.verify(service, "m-2")
    assert readers.run_records(spark, str(tmp_path)).count() == 2


def test_the_marker_outlives_a_lost_answer(spark, tmp_path):
    log = RunLog(spark, str(tmp_path))
    with pytest.raises(ConnectionError):
        log.submit(Service(ConnectionError("reset")), [{}], run("d"), confirmed=True)
    with pytest.raises(Refused, match="pending"):
        log.submit(Service(), [{}], run("other"), confirmed=True)
    assert [b["id"] for b in log.reconcile(Service())] == ["b1", "lost"]
    log.reconcile(Service(), settle=True)
    with pytest.raises(Refused, match="400"):
        log.submit(Service(Rejected("status 400")), [{}], run("d"), confirmed=True)
    assert log.submit(Service(), [{}], run("d"), confirmed=True)["batch_id"] == "b1"
    assert [b["id"] for b in log.reconcile(Service())] == ["lost"]


def test_results_are_saved_once(spark, tmp_path):
    log, service = RunLog(spark, str(tmp_path)), Service()
    log.keep({"batch_id": "b1", **run("d")})
    path = log.download(service)
    assert log.files.read("b1.results.jsonl") == b"one\ntwo\n" and path.endswith("/b1.results.jsonl")
    log.download(service, "b1")
    assert service.asked == 1
    log.download(service, "b1", force=True)
    assert service.asked == 2
    with pytest.raises(FileExistsError):
        Folder(spark, str(tmp_path)).write("b1.results.jsonl", [b"x"], over=False)


@pytest.fixture
def server():
    asked, busy = [], {"left": 2}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            form = dict(urllib.parse.parse_qsl(self.rfile.read(int(self.headers["Content-Length"])).decode()))
            asked.append((self.path, form))
            if self.path == "/down" or (self.path == "/busy" and busy["left"] > 0):
                busy["left"] -= 1
                return self.answer(503, "")
            if self.path == "/wrong":
                return self.answer(400, "")
            if "query" in form:
                names = form["query"].split("{ ")[2].split(" }")[0].split()
                return self.answer(200, "item,type\r\n" + "".join(f"http://x/{n[3:]},{'' if n == 'wd:Q2' else 'http://x/T'}\r\n" for n in names))
            return self.answer(200, json.dumps(form))

        def answer(self, code, text):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_paged_sources(spark, server):
    base, asked = server
    rows = paged.recorder_features(spark, f"{base}/busy", list(range(450)), pause=0.01).collect()
    assert sorted(len(r.asked.split(",")) for r in rows) == [50, 200, 200] and all(json.loads(r.body)["outSR"] == "4326" for r in rows)
    assert len(asked) == 5  # two were told to come again
    (one,) = paged.street_extract(spark, [f"{base}/down", f"{base}/up"], "way;", tries=2, pause=0.01).collect()
    assert json.loads(one.body) == {"data": "way;"}
    got = {r.item: r.type for r in paged.claims(spark, f"{base}/kb", [f"Q{k}" for k in range(5)], batch=2).collect()}
    assert got == {f"http://x/Q{k}": None if k == 2 else "http://x/T" for k in range(5)}
    assert {r.asked for r in paged.searches(spark, f"{base}/search", ["elm", "oak"]).collect()} == {"elm", "oak"}
    with pytest.raises(Exception, match="400"):
        paged.pages(spark, [f"{base}/wrong"], ["1"], pause=0.01).collect()
