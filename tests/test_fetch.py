"""Readers that fetch, against a server on this machine."""

import email.utils
import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from quarry.sources import fetch

FAST = fetch.Policy(attempts=3, base=0.01, timeout=5.0, most_bytes=1000)


@pytest.fixture
def server():
    seen, contents = Counter(), {"/doc": b"one"}

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status, body=b"", **headers):
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            url = urlparse(self.path)
            seen[self.path] += 1
            n, q = seen[self.path], parse_qs(url.query)
            if url.path == "/busy":
                return self.answer(429, b"Retry after 0 seconds") if n < 2 else self.answer(503, b"", Retry_After=email.utils.formatdate(time.time() - 5)) if n < 3 else self.answer(200, b"at last")
            if url.path == "/down":
                return self.answer(503)
            if url.path == "/doc":
                tag = f'"{len(contents["/doc"])}"'
                return self.answer(304) if self.headers.get("If-None-Match") == tag else self.answer(200, contents["/doc"], ETag=tag)
            if url.path == "/plain":
                return self.answer(200, b"the same")
            if url.path == "/list":
                at, size = int(q.get("cursor", ["0"])[0]), int(q["limit"][0])
                if n == 1 and at:
                    return self.answer(500)
                rows = [{"id": f"{q.get('search', ['all'])[0]}/{i}"} for i in range(at, min(at + size, 25))]
                return self.answer(200, json.dumps(rows).encode(), **({"Link": f'</list?{url.query.split("&cursor")[0]}&cursor={at + size}>; rel="next"'} if at + size < 25 else {}))
            if url.path == "/arxiv":
                ids = q["id_list"][0].split(",")
                if "bad" in ids and n == 1:
                    return self.answer(200, b"<feed><entry>")
                entries = "".join(f"<entry><id>http://arxiv.org/abs/{i}v1</id><title>T\n {i}</title>{'' if i == 'none' else f'<summary>About {i}</summary>'}</entry>" for i in ids)
                return self.answer(200, f"<feed xmlns='http://www.w3.org/2005/Atom'>{entries}</feed>".encode())
            known = {"/empty": (200, b" \n"), "/large": (200, b"x" * 2000), "/gone": (404, b""), "/closed": (403, b""), "/m/a/raw/s1/README.md": (200, b"# A \xff"), "/m/b/raw/s2/README.md": (404, b""), "/m/c/raw/s3/README.md": (401, b"")}
            self.answer(*known.get(url.path, (404, b"")))

        def log_message(self, *args):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    thread = threading.Thread(target=httpd.serve_forever, daemon=True)
    thread.start()
    yield f"http://127.0.0.1:{httpd.server_address[1]}", seen, contents
    httpd.shutdown()
    httpd.server_close()


def test_retries_and_outcomes(spark, server):
    base, seen, _ = server
    paths = ["busy", "down", "empty", "large", "gone", "closed", "doc"]
    df = spark.createDataFrame([(p, f"{base}/{p}") for p in paths] + [("nowhere", "http://127.0.0.1:9/x"), ("odd", "no address")], "key string, url string")
    got = {r.key: r for r in fetch.fetched(df, FAST, tasks=3).collect()}
    assert {k: r.outcome for k, r in got.items()} == {"busy": "ok", "down": "error", "empty": "empty", "large": "too_large", "gone": "missing", "closed": "refused", "doc": "ok", "nowhere": "error", "odd": "error"}
    assert (got["busy"].attempts, bytes(got["busy"].body), got["busy"].status) == (3, b"at last", 200)
    assert got["down"].attempts == 3 and got["down"].error == "HTTP 503" and got["large"].body is None and got["nowhere"].status is None
    assert seen["/gone"] == 1 and got["doc"].etag == '"3"' and got["doc"].sha256
    assert fetch.fetched(df.limit(0), FAST).collect() == []


def test_waits_are_as_asked():
    assert fetch.asked_wait({"retry-after": "7"}, b"", 0) == "7.0"
    assert float(fetch.asked_wait({"retry-after": email.utils.formatdate(100)}, b"", 40)) == 60.0
    assert fetch.asked_wait({"retry-after": "soon"}, b"We had to rate limit you. Retry after 93 seconds", 0) == "93"
    assert fetch.asked_wait({}, b"", 0) is None


def test_a_later_run_asks_for_what_is_missing(spark, server, tmp_path):
    base, seen, _ = server
    wanted = spark.createDataFrame([(p, f"{base}/{p}") for p in ("doc", "down", "gone")], "key string, url string")
    store = f"file://{tmp_path}/store"
    for _ in range(2):
        got = {r.key: r.outcome for r in fetch.fetch_missing(wanted, store, FAST).collect()}
        assert got == {"doc": "ok", "down": "error", "gone": "missing"}
    assert (seen["/doc"], seen["/gone"], seen["/down"]) == (1, 1, 6)


def test_conditional_refresh(spark, server, tmp_path):
    base, seen, contents = server
    sources = spark.createDataFrame([(p, f"{base}/{p}") for p in ("doc", "plain", "down", "empty")], "key string, url string")
    table = f"file://{tmp_path}/sources"

    def run(df=sources):
        return {r.key: (r.outcome, r.changed) for r in fetch.refresh(df, table, FAST).collect()}

    held = lambda: {r.key: bytes(r.content) for r in fetch.current(spark, table).collect()}
    assert run() == {"doc": ("ok", True), "plain": ("ok", True), "down": ("error", False), "empty": ("empty", False)}
    assert held() == {"doc": b"one", "plain": b"the same"}
    assert run() == {"doc": ("not_modified", False), "plain": ("ok", False), "down": ("error", False), "empty": ("empty", False)}
    contents["/doc"] = b"second"
    assert run()["doc"] == ("ok", True) and held() == {"doc": b"second", "plain": b"the same"}
    failing = spark.createDataFrame([("doc", f"{base}/down"), ("plain", f"{base}/plain")], "key string, url string")
    assert run(failing)["doc"] == ("error", False) and held()["doc"] == b"second"
    assert run(sources.filter("key = 'plain'"))["plain"] == ("ok", False) and set(held()) == {"plain"}


def test_listings_by_pages(spark, server):
    base, seen, _ = server
    strata = {"chat": [{"search": "a", "tags": ["x", "y"], "library": "l"}, {"sort": "likes"}], "few": [{"search": "b"}]}
    df = fetch.listings(spark, f"{base}/list", strata, {"chat": 18, "few": 4}, FAST, page=10)
    assert df.rdd.getNumPartitions() == 3
    got = df.orderBy("seq", "place").collect()
    assert [(r.seq, r.place, json.loads(r.record)["id"]) for r in got] == [(0, i, f"a/{i}") for i in range(18)] + [(1, i, f"all/{i}") for i in range(18)] + [(2, i, f"b/{i}") for i in range(4)]
    assert got[0].label == "chat:library=l,search=a,tags=['x', 'y'],sort=downloads"
    assert any(p.startswith("/list?search=a&filter=x&filter=y&filter=l&sort=downloads&limit=10") for p in seen)
    with pytest.raises(Exception, match="HTTP 404"):
        fetch.listings(spark, f"{base}/absent", {"s": [{}]}, {"s": 1}, FAST).collect()


def test_cards(spark, server, tmp_path):
    base, _, _ = server
    records = spark.createDataFrame([("m/a", "s1"), ("m/b", "s2"), ("m/c", "s3")], "repo_id string, sha string")
    answers = fetch.fetch_missing(fetch.card_requests(records, base), f"file://{tmp_path}/cards", FAST)
    got = {r.repo_id: (r.sha, r.status, r.text) for r in fetch.cards(answers).collect()}
    assert got == {"m/a": ("s1", "ok", "# A �"), "m/b": ("s2", "missing_readme", None), "m/c": ("s3", "gated", None)}


def test_abstracts_in_batches(spark, server, tmp_path):
    base, seen, _ = server
    ids = spark.createDataFrame([(f"2401.{i:05}",) for i in range(25)] + [("none",), ("bad",), ("bad",), ("",)], "arxiv_id string")
    run = lambda: {r.arxiv_id: r.title for r in fetch.fetch_abstracts(ids, f"file://{tmp_path}/abs", f"{base}/arxiv", fetch.Policy(base=0.01), batch=10).collect()}
    first = run()
    assert len(first) == 20 and "bad" not in first  # the third batch has no whole answer
    assert sum(seen.values()) == 3
    second = run()
    assert len(second) == 26 and second["bad"] == "T bad" and second["2401.00003"] == "T 2401.00003" and "none" not in second
    assert sum(seen.values()) == 4
    assert spark.read.parquet(f"file://{tmp_path}/abs").filter(F.col("abstract") == "About 2401.00024").count() == 1
