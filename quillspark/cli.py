"""Command line: index, list, mq, sql, repl, lint, stats, vacuum, show, serve."""

from __future__ import annotations

import argparse
import base64
import hmac
import json
import sys
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import navigation as nav
from .operators.store import DocumentStore
from .plans import selector
from .plans.sqlfront import _significant
from .sources.render import RENDERERS, blocks_to_html, render


def session() -> SparkSession:
    spark = SparkSession.builder.appName("quillspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *, form: str | None = "table", store: bool = True):
        c = sub.add_parser(name)
        if store:
            c.add_argument("store", help="folder of a saved store")
        if form:
            c.add_argument("--format", choices=sorted(RENDERERS), default=form)
        return c

    c = add("index", form=None)
    c.add_argument("paths", nargs="+")
    c.add_argument("--no-recursive", action="store_true")
    c.add_argument("--no-spans", action="store_true")
    c.add_argument("--prune", action="store_true")
    add("list")
    c = add("mq")
    c.add_argument("program")
    c.add_argument("--html", action="store_true")
    c = add("sql")
    c.add_argument("statement")
    c.add_argument("--write-back", action="store_true")
    c = add("repl")
    c.add_argument("--write-back", action="store_true")
    c = add("lint")
    c.add_argument("--depth", type=int, default=2)
    add("stats")
    add("vacuum", form=None)
    c = add("show")
    c.add_argument("document", type=int)
    c = add("serve", form=None)
    c.add_argument("--port", type=int, default=8080)
    c.add_argument("--api-key")
    c.add_argument("--basic-auth", metavar="USER:PASSWORD")
    c.add_argument("--rate-limit", type=int, metavar="N", help="requests a second from one address")
    c.add_argument("--timeout", type=float, metavar="SECONDS", help="a statement that takes longer is cancelled")
    c.add_argument("--tls", nargs=2, metavar=("CERTIFICATE", "KEY"))
    return p


def repl(store: DocumentStore, form: str, write_back: bool, lines=None, out=sys.stdout) -> None:
    """``.mode FORMAT``, ``.help``, ``.quit``, selector programs (starting with a dot or select) or SQL."""
    for line in lines if lines is not None else sys.stdin:
        line = line.strip()
        if not line:
            continue
        if line in (".quit", ".exit"):
            return
        if line == ".help":
            print(repl.__doc__, file=out)
        elif line.startswith(".mode"):
            form = line.split()[1] if len(line.split()) == 2 and line.split()[1] in RENDERERS else form
        else:
            try:
                is_selector = line.startswith(".") or (_significant(line)[0].lower() == "select" and line[6:7] == "(" and "from" not in [w.lower() for w in _significant(line)])
                df = selector.run(store.blocks(), line).orderBy("document_id", "ord").select("output") if is_selector else store.sql(line, write_back)
                print(render(df, form), end="", file=out)
            except Exception as e:  # a statement's error ends the statement only
                print(f"error: {str(e).splitlines()[0]}", file=out)


class RateLimit:
    """At most ``n`` requests of one address in any second by the clock; what is remembered is bounded."""

    def __init__(self, n: int, now=time.monotonic):
        self.n, self.now, self.second, self.seen = n, now, None, {}

    def allows(self, address: str) -> bool:
        second = int(self.now())
        if second != self.second:
            self.second, self.seen = second, {}
        self.seen[address] = self.seen.get(address, 0) + 1
        return self.seen[address] <= self.n


def _admitted(headers, api_key: str | None, basic: str | None) -> bool:
    """Either credential will do where both are set."""
    same = lambda a, b: hmac.compare_digest(a.encode(), b.encode())
    given = headers.get("Authorization", "")
    if api_key and (same(headers.get("X-Api-Key", ""), api_key) or same(given, f"Bearer {api_key}")):
        return True
    if basic and same(given, "Basic " + base64.b64encode(basic.encode()).decode()):
        return True
    return not (api_key or basic)


def serve(store: DocumentStore, port: int, api_key: str | None, basic_auth: str | None = None, rate_limit: int | None = None, timeout: float | None = None, tls: tuple[str, str] | None = None):
    """POST /sql and /mq (the text as body), GET /health; JSON answers."""
    from concurrent.futures import ThreadPoolExecutor
    from concurrent.futures import TimeoutError as Late
    from http.server import BaseHTTPRequestHandler, HTTPServer

    limit = RateLimit(rate_limit) if rate_limit else None
    pool = ThreadPoolExecutor(1) if timeout else None
    context = store.spark.sparkContext

    def answer(path: str, text: str) -> str:
        return render(store.sql(text) if path == "/sql" else selector.run(store.blocks(), text).orderBy("document_id", "ord"), "json")

    def in_time(path: str, text: str) -> str:
        if pool is None:
            return answer(path, text)
        tag = f"quillspark-{uuid.uuid4().hex}"

        def run() -> str:
            context.addJobTag(tag)
            try:
                return answer(path, text)
            finally:
                context.removeJobTag(tag)

        job = pool.submit(run)
        try:
            return job.result(timeout)
        except Late:
            context.cancelJobsWithTag(tag)
            raise

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: str, **headers: str) -> None:
            data = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self._send(200, '{"status": "ok"}') if self.path == "/health" else self._send(404, "{}")

        def do_POST(self):
            if limit and not limit.allows(self.client_address[0]):
                return self._send(429, '{"error": "too many requests"}', Retry_After="1")
            if not _admitted(self.headers, api_key, basic_auth):
                return self._send(401, '{"error": "unauthorized"}', **({"WWW_Authenticate": 'Basic realm="quillspark"'} if basic_auth else {}))
            text = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            if self.path not in ("/sql", "/mq"):
                return self._send(404, "{}")
            try:
                return self._send(200, in_time(self.path, text))
            except Late:
                return self._send(408, '{"error": "timed out"}')
            except Exception as e:
                return self._send(400, json.dumps({"error": str(e).splitlines()[0] if str(e) else type(e).__name__}))

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", port), Handler)
    if tls:
        import ssl

        secure = ssl.SSLContext(ssl.PROTOCOL_TLS_SERVER)
        secure.load_cert_chain(*tls)
        server.socket = secure.wrap_socket(server.socket, server_side=True)
    return server


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    if a.command == "index":
        store = DocumentStore.open(spark, a.store) if DocumentStore.exists(spark, a.store) else DocumentStore(spark, spans=not a.no_spans, location=a.store)
        report = store.reindex_paths(a.paths, not a.no_recursive, a.prune)
        store.save(a.store)
        failed = report.pop("failed_paths")
        print(", ".join(f"{k} {v}" for k, v in report.items()))
        for p in failed:
            print(f"failed: {p}", file=sys.stderr)
        return int(bool(failed))
    store = DocumentStore.open(spark, a.store)
    if a.command == "list":
        print(render(store.documents().orderBy("id"), a.format), end="")
    elif a.command == "mq":
        if a.html:
            keep, _ = selector.compile_selector(a.program)
            print(blocks_to_html(store.blocks().where(keep).orderBy("document_id", "ord").collect()))
        else:
            for r in selector.run(store.blocks(), a.program).orderBy("document_id", "ord").toLocalIterator():
                print(r["output"])
    elif a.command == "sql":
        print(render(store.sql(a.statement, a.write_back), a.format), end="")
        if a.write_back:
            store.save(a.store)
    elif a.command == "repl":
        repl(store, a.format, a.write_back)
        if a.write_back:
            store.save(a.store)
    elif a.command == "lint":
        bad = nav.lint_heading_followed_by(store.blocks(), a.depth)
        print(render(bad.orderBy("document_id", "heading_pre"), a.format), end="")
        return int(not bad.isEmpty())
    elif a.command == "stats":
        print(render(store.stats(), a.format), end="")
    elif a.command == "vacuum":
        print(", ".join(f"{k} {v}" for k, v in store.vacuum().items()))
    elif a.command == "show":
        print(render(store.blocks().where(F.col("document_id") == a.document).orderBy("ord").select("pre", "post", "block_type", "depth", "lang", "content"), a.format), end="")
    elif a.command == "serve":
        serve(store, a.port, a.api_key, a.basic_auth, a.rate_limit, a.timeout, a.tls).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
