"""A small server over a snapshot: its graph, statistics and clusters as JSON, and its changes as a stream of events.

    python -m quillon.sinks.serve --db PATH --port 3000

It serves graphs that a viewer can show; what it sends is made by the same
operators as everything else and passes the driver as one JSON text.
"""

from __future__ import annotations

import argparse
import http.server
import json
import queue
import threading
import urllib.parse

from pyspark.sql import SparkSession

from quillon.operators import export
from quillon.sources.store import CLUSTERS, MEMBERS, load_snapshot

#: Events a slow listener may be behind; then it misses the oldest.
BEHIND = 100


def graph_event(spark: SparkSession, path: str) -> str:
    """{"type": "graph_snapshot", "data": {nodes, edges, clusters}} of the snapshot under a path."""
    tables, _ = load_snapshot(spark, path)
    empty = {"clusters": CLUSTERS, "members": MEMBERS}
    clusters, members = (tables[n] if n in tables else spark.createDataFrame([], s) for n, s in empty.items())
    return export.snapshot_event(tables["nodes"], tables["edges"], clusters, members).first()["event"]


class Hub:
    """Passes each event to all listeners."""

    def __init__(self) -> None:
        self._lock, self._listeners = threading.Lock(), []

    def join(self) -> queue.Queue:
        q: queue.Queue = queue.Queue(BEHIND)
        with self._lock:
            self._listeners.append(q)
        return q

    def leave(self, q: queue.Queue) -> None:
        with self._lock:
            self._listeners.remove(q)

    def send(self, event: str) -> None:
        with self._lock:
            for q in self._listeners:
                while True:
                    try:
                        q.put_nowait(event)
                        break
                    except queue.Full:
                        q.get_nowait()


class State:
    """The graph as it was last read; `notify` reads it again and tells all listeners."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.hub = spark, path, Hub()
        self._event: str | None = None

    def load(self) -> str:
        self._event = graph_event(self.spark, self.path)
        return self._event

    @property
    def event(self) -> str:
        return self._event or self.load()

    def notify(self) -> None:
        self.hub.send(self.load())


class Handler(http.server.SimpleHTTPRequestHandler):
    """GET /api/graph, /api/stats, /api/clusters and /events, POST /api/notify; files of a folder otherwise. Statistics and clusters are read anew each time."""

    state: State
    folder: str | None = None

    def __init__(self, *args) -> None:
        super().__init__(*args, directory=self.folder)

    def log_message(self, *args) -> None:
        pass

    def end_headers(self) -> None:
        self.send_header("Access-Control-Allow-Origin", "*")
        super().end_headers()

    def _answer(self, status: int, body: str, kind: str = "application/json") -> None:
        raw = body.encode()
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def _try(self, make) -> None:
        try:
            body = make()
        except Exception as e:  # noqa: BLE001 - the client is told
            self._answer(500, str(e), "text/plain; charset=utf-8")
        else:
            self._answer(200, body)

    def do_OPTIONS(self) -> None:
        self.send_response(204)
        self.send_header("Access-Control-Allow-Methods", "GET, POST, OPTIONS")
        self.send_header("Access-Control-Allow-Headers", "*")
        self.end_headers()

    def do_GET(self) -> None:
        at = urllib.parse.urlsplit(self.path).path
        data = lambda event: json.loads(event)["data"]
        if at == "/api/graph":
            self._try(lambda: json.dumps(data(self.state.event)))
        elif at == "/api/stats":
            self._try(lambda: json.dumps({f"{n[:-1]}_count": len(x) for n, x in data(self.state.load()).items()}))
        elif at == "/api/clusters":
            self._try(lambda: json.dumps(data(self.state.load())["clusters"]))
        elif at == "/events":
            self._events()
        elif self.folder:
            super().do_GET()
        else:
            self._answer(404, "not found", "text/plain")

    def _events(self) -> None:
        """The graph, then each event, as server-sent events, until the client goes."""
        mine = self.state.hub.join()
        try:
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.end_headers()
            event: str | None = self.state.event
            while event is not None:
                self.wfile.write(f"data: {event}\n\n".encode())
                self.wfile.flush()
                event = mine.get()
        except OSError:
            pass
        finally:
            self.state.hub.leave(mine)

    def do_POST(self) -> None:
        if urllib.parse.urlsplit(self.path).path != "/api/notify":
            return self._answer(404, "not found", "text/plain")

        def told() -> str:
            self.state.notify()
            return json.dumps({"status": "ok", "message": "Update broadcasted"})

        self._try(told)


def server(state: State, port: int = 3000, host: str = "0.0.0.0", folder: str | None = None) -> http.server.ThreadingHTTPServer:
    """A server that listens; `serve_forever` runs it. Files of `folder` are served beside the API."""
    made = type("Bound", (Handler,), {"state": state, "folder": folder})
    out = http.server.ThreadingHTTPServer((host, port), made)
    out.daemon_threads = True
    return out


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--db", default="graph.db")
    p.add_argument("--port", type=int, default=3000)
    p.add_argument("--files")
    got = p.parse_args(args)
    state = State(SparkSession.builder.appName("quillon").getOrCreate(), got.db)
    try:
        state.load()
    except Exception as e:  # noqa: BLE001 - it may be written later
        print(f"no graph yet: {e}")
    server(state, got.port, folder=got.files).serve_forever()


if __name__ == "__main__":
    main()
