"""A model server, prompt files, and a polled table of a stream."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tessera.sources import models
from tessera.streaming import feeds


class Server(BaseHTTPRequestHandler):
    """Lists two models; the first answer to each prompt is no JSON, the one after a repair request is."""

    def do_GET(self):  # noqa: N802
        self._say({"models": [{"name": "qwen2.5:14b"}, {"name": "Other:latest"}]})

    def do_POST(self):  # noqa: N802
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        good = asked["prompt"].endswith(models.REPAIR) and not asked["prompt"].startswith("never")
        self._say({"response": '{"a": 1}' if good else "sorry"})

    def _say(self, body):
        raw = json.dumps(body).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_probe(spark, url):
    got = {r.model: (r.reachable, r.installed) for r in models.probe(spark, url, ["QWEN2.5:14b", "other", "missing"]).collect()}
    assert got == {"QWEN2.5:14b": (True, True), "other": (True, True), "missing": (True, False)}
    gone = models.probe(spark, "http://127.0.0.1:9", ["other"], 0.5).first()
    assert (gone.reachable, gone.installed) == (False, False)


def test_answers_of_a_server(spark, url):
    rows = spark.createDataFrame([(1, "parse this"), (2, "never mind")], "id long, prompt string")
    got = {r.id: (r.answer, r.attempts, r.error is None) for r in models.complete(rows, models.ask(url, "other")).collect()}
    assert got == {1: ('{"a": 1}', 2, True), 2: (None, models.ATTEMPTS, False)}


def test_prompt_files(spark, tmp_path):
    path = tmp_path / "v1" / "parse.txt"
    path.parent.mkdir()
    path.write_text("Read:\n{text}\nend")
    requests = spark.createDataFrame([("a",), (None,)], "text string")
    ask = lambda where: sorted(r.prompt for r in models.prompts(spark, where, requests, "{text}", "short {text}").collect())
    assert ask(models.versioned(str(tmp_path), "v1", "parse")) == ["Read:\n\nend", "Read:\na\nend"]
    assert ask(models.versioned(str(tmp_path), "v2", "parse")) == ["short ", "short a"]


def test_a_polled_table(spark, tmp_path):
    source = str(tmp_path / "events")
    spark.sql("SELECT 1L AS user_id, 1L AS event_id, 'parsing' AS event_type, timestamp'2024-01-01 00:00:00' AS ts").write.parquet(source)
    run = feeds.to_memory(feeds.task_states(feeds.read_events(spark, source, spark.read.parquet(source).schema)), "polled", "complete")
    run.awaitTermination()
    assert [(r.user_id, r.status, r.progress) for r in spark.table("polled").collect()] == [(1, "parsing", 20)]
