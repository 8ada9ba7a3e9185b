"""Sinks and sources of services: documents with a commit, ids first, paced searches, guarded saves."""

import json
import os
import threading
import time
import urllib.parse
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from platlark.operators.runs import Refused
from platlark.sources import paged, raw, writers
from platlark.streaming import searches


def features(spark, n, parts):
    d = spark.range(n).select(F.format_string("p%05d", "id").alias("place"), F.format_string('{"type":"Feature","id":%d}', "id").alias("feature"))
    return d.repartition(parts)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_document_is_the_same_for_any_number_of_tasks(spark, tmp_path, n):
    texts = []
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            writers.feature_document(features(spark, n, parts), str(tmp_path / f"d{parts}"))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        texts.append((tmp_path / f"d{parts}").read_bytes())
    assert texts[0] == texts[1]
    assert [f["id"] for f in json.loads(texts[0])["features"]] == list(range(n))
    assert sorted(os.listdir(tmp_path)) == ["d1", "d7"]


def test_document_is_whole_or_absent(spark, tmp_path):
    path = str(tmp_path / "doc")
    bad = features(spark, 50, 4).withColumn("feature", F.when(F.col("place") == "p00033", F.raise_error(F.lit("broken"))).otherwise(F.col("feature")))
    with pytest.raises(Exception, match="broken"):
        writers.feature_document(bad, path)
    assert os.listdir(tmp_path) == []
    writers.feature_document(features(spark, 2, 1), path)
    before = open(path, "rb").read()
    with pytest.raises(Exception, match="FileExists"):
        writers.feature_document(features(spark, 3, 1), path)
    assert open(path, "rb").read() == before and os.listdir(tmp_path) == ["doc"]
    writers.feature_document(features(spark, 3, 2), path, spark.createDataFrame([("era", None, 2)], "field string, value string, n long"), mode="overwrite")
    doc = json.loads(open(path).read())
    assert len(doc["features"]) == 3 and doc["counts"] == {"era": {"": 2}}


@pytest.fixture
def service():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            form = dict(urllib.parse.parse_qsl(self.rfile.read(int(self.headers["Content-Length"])).decode()))
            asked.append((time.time(), form))
            if form.get("returnIdsOnly"):
                return self.answer(200, json.dumps({"objectIds": [30, 10, 20, 50, 40]}))
            if "objectIds" in form:
                ids = [int(x) for x in form["objectIds"].split(",")]
                shape = {"rings": [[[-116.2, 43.6], [-116.2, 43.7], [-116.1, 43.6], [-116.2, 43.6]]]}
                rows = [{"attributes": {"OBJECTID": i, "SubdivisionName": f"PLAT {i}", "RecordedDate": i * 1000, "InitialTaxYear": None}, "geometry": shape if i != 20 else None} for i in ids]
                return self.answer(200, json.dumps({"error": "bad"} if 40 in ids and len(ids) == 1 else {"features": rows}))
            if "data" in form:
                ways = [{"type": "way", "id": i, "nodes": [1, 2], "geometry": [{"lat": 43.6, "lon": -116.2}], "tags": {"name": f"{form['data']} {i}", "highway": "residential"}} for i in (5, 3)]
                return self.answer(200, json.dumps({"osm3s": {"timestamp_osm_base": "2024"}, "elements": ways}))
            if form["search"].startswith("bad"):
                return self.answer(400, "")
            if form["search"] == "odd":
                return self.answer(200, "<html>")
            found = [] if form["search"] == "none" else [{"id": f"Q-{form['search']}", "label": "L", "match": {"text": "t", "type": "label"}}]
            return self.answer(200, json.dumps({"search": found}))

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


def test_plats_are_asked_by_ids_that_filters_leave(spark, service):
    url, asked = service
    rows = {r.oid: r for r in paged.recorded_plats(spark, [url], batch=2, pause=0.01).collect()}
    assert sorted(rows) == [10, 20, 30, 40, 50] and [rows[k].ord for k in sorted(rows)] == [0, 1, 2, 3, 4]
    assert rows[10].name == "PLAT 10" and rows[10].recorded_ms == 10000 and rows[20].rings == []
    assert rows[10].rings[0][0].x == pytest.approx(564500, abs=200)
    asked.clear()
    some = paged.recorded_plats(spark, [url], batch=2, pause=0.01).filter("oid > 10 and oid <= 30 and name like 'PLAT%'").collect()
    assert sorted((r.oid, r.ord) for r in some) == [(20, 1), (30, 2)]
    assert [f["objectIds"] for _, f in asked if "objectIds" in f] == ["20,30"]
    with pytest.raises(Exception, match="bad"):
        paged.recorded_plats(spark, [url], batch=1, pause=0.01).collect()


def test_ways_come_typed_and_once(spark, service):
    url, _ = service
    rows = paged.map_ways(spark, [url], ["a", "b"], pause=0.01).orderBy("ord").collect()
    assert [(r.way_id, r.name, r.highway, r.nodes, r.stamp) for r in rows] == [(5, "a 5", "residential", [1, 2], "2024"), (3, "a 3", "residential", [1, 2], "2024")]
    assert [len(r.pts) for r in rows] == [1, 1]


def test_searches_are_paced_and_resume(spark, service, tmp_path):
    url, asked = service
    at = lambda x: str(tmp_path / x)
    params = searches.SearchParams(pause=0.02, per_batch=3, tries=1, retry_pause=0.01)
    cores = spark.createDataFrame([(x,) for x in ("elm", "oak", "bad one", "none", "odd", "fir", "elm", None)], "core string")
    searches.save_terms(cores.coalesce(1), at("terms"), params)
    seen = []

    def stop(number):
        seen.append(number)
        if len(seen) == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        searches.start(spark, at("terms"), url, at("out"), at("checkpoint"), params, after=stop).awaitTermination()
    first = len(asked)
    searches.start(spark, at("terms"), url, at("out"), at("checkpoint"), params).awaitTermination()
    names = [f["search"] for _, f in asked]
    assert sorted(set(names)) == ["bad one", "elm", "fir", "none", "oak", "odd"]
    assert first <= 3 and len(names) <= 6 + first  # only the open micro-batch was asked again
    searches.start(spark, at("terms"), url, at("out"), at("checkpoint"), params).awaitTermination()
    assert len(asked) == len(names)
    assert {r.core for r in searches.searched(spark, at("out")).collect()} == {"elm", "fir", "none", "oak"}
    assert {(r.core, r.pos, r.qid, r.description, r.match_type) for r in searches.found(spark, at("out")).collect()} == {(x, 0, f"Q-{x}", "", "label") for x in ("elm", "fir", "oak")}
    assert {r.core for r in spark.read.parquet(at("out") + "/failed").collect()} == {"bad one", "odd"}
    times = [t for t, _ in asked]
    assert min(b - a for a, b in zip(times, times[1:], strict=False)) >= 0.015


def test_an_older_extract_is_refused(spark, tmp_path):
    e = raw.Extract(spark, str(tmp_path))
    assert e.current() is None and e.path() is None
    assert e.save([b"one"], "2024-02-01")["number"] == 1
    with pytest.raises(Refused, match="older"):
        e.save([b"old"], "2024-01-01")
    assert e.files.read(e.current()["file"]) == b"one"
    assert e.save([b"two", b"!"], "2024-02-01")["number"] == 2
    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(lambda k: e.save([str(k).encode()], f"2024-03-0{k % 3 + 1}") if k % 3 == 2 else _tried(e, k), range(6)))
    numbers = [d["number"] for d in done if d]
    assert len(set(numbers)) == len(numbers)
    assert e.current()["stamp"] == "2024-03-03"
    bodies = [n for n in os.listdir(tmp_path) if n.startswith("body-")]
    assert len(bodies) == 2 + len(numbers)


def _tried(e, k):
    try:
        return e.save([str(k).encode()], f"2024-03-0{k % 3 + 1}")
    except Refused:
        return None
