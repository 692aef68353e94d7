"""Paged searches against a service on this machine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from folioflow.sources import search


@pytest.fixture
def service():
    held, asked = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((body["pn"], body["rn"]))
            found = {"result": {"totalcount": len(held), "records": held[body["pn"] : body["pn"] + body["rn"]]}}
            data = json.dumps({"content": json.dumps(found)} if body["pn"] else found).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield held, asked, f"http://127.0.0.1:{server.server_port}/search"
    server.shutdown()


def record(k):
    return {"infoid": f"i{k}", "title": f"t{k}", "webdate": f"2024-01-{k + 1:02d} 10:00:00", "categorynum": "014001"}


def test_payload_and_rows():
    assert search.payload("1", 0, 5, None, "2024-02-01")["time"][0]["startTime"] == "2024-02-01 00:00:00" and "time" not in search.payload("1", 0, 5)
    with pytest.raises(ValueError):
        search.payload("1", 0, 5, "02/2024")
    assert search.row({"infoId": " x ", "titlenew": "", "infoDate": "2024-03-04T1", "projectNo": 7}, 3, "c", "u/{category}/{key}") == ("x", "x", "u/c/x", "c", "2024-03-04", None, "7", None, 3)
    assert search.row("text", 0, "c", "") is None and search.row({"title": "t"}, 0, "c", "") is None
    assert search.unwrapped("[]") == search.unwrapped('{"result": []}') == {}


def test_batch(spark, service):
    held, asked, url = service
    spark.dataSource.register(search.SearchSource)
    read = lambda: spark.read.format("paged_search").options(url=url, category="014001", pageSize=4, detail="d/{key}").load()
    assert read().count() == 0
    held += [record(k) for k in range(10)] + [{"title": "no key"}]
    rows = read().orderBy("position").collect()
    assert [(r.item_key, r.published, r.detail_url, r.position) for r in rows] == [(f"i{k}", f"2024-01-{k + 1:02d}", f"d/i{k}", k) for k in range(10)]
    assert {(0, 4), (4, 4), (8, 3)} <= set(asked)


def test_stream_resumes(spark, service, tmp_path):
    held, asked, url = service
    spark.dataSource.register(search.SearchSource)

    def run():
        stream = spark.readStream.format("paged_search").options(url=url, category="014001", pageSize=3).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.item_key for r in spark.read.parquet(str(tmp_path / "out")).collect())

    held += [record(k) for k in range(5)]
    assert run() == [f"i{k}" for k in range(5)]
    held += [record(k) for k in range(5, 9)]
    asked.clear()
    assert run() == [f"i{k}" for k in range(9)]
    assert all(start >= 5 for start, size in asked if size > 1)
