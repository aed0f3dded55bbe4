"""The tools as a server of the Model Context Protocol: JSON-RPC 2.0, a message a line, or posted over HTTP."""

from __future__ import annotations

import inspect
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO

from nestfold.tools.analysis import TASKS, Analysis

VERSIONS = ("2024-11-05", "2025-03-26", "2025-06-18")
_KINDS = {"str": "string", "int": "integer", "list": "array", "float": "number", "bool": "boolean"}


def described(tools: Analysis, name: str) -> dict:
    """A tool's name, what it does, and its arguments, as its signature tells them."""
    method = getattr(tools, name)
    properties, required = {}, []
    for p in inspect.signature(method).parameters.values():
        kind = str(p.annotation).split("|")[0].strip()
        properties[p.name] = {"type": _KINDS.get(kind, "string")} | ({"items": {"type": "number"}} if kind == "list" else {})
        if p.default is p.empty:
            required.append(p.name)
    return {"name": name, "description": inspect.getdoc(method) or name.replace("_", " "), "inputSchema": {"type": "object", "properties": properties, "required": required}}


class Server:
    """Answers one message at a time, whoever sends it."""

    def __init__(self, tools: Analysis, expressions: bool = True):
        self.tools, self.lock = tools, threading.Lock()
        self.names = [n for n in tools.TOOLS if expressions or n != "nested_eval"]

    def answer(self, message: dict) -> dict | None:
        """The reply to a message; None for a notification."""
        if not isinstance(message, dict) or "method" not in message:
            return self._reply(None, error=(-32600, "not a request"))
        asked, number, given = message["method"], message.get("id"), message.get("params") or {}
        if number is None:
            return None
        handler = {"initialize": self._initialize, "ping": lambda p: {}, "tools/list": self._list, "tools/call": self._call, "prompts/list": lambda p: {"prompts": []}, "resources/list": lambda p: {"resources": []}}.get(asked)
        if handler is None:
            return self._reply(number, error=(-32601, f"there is no method {asked}"))
        try:
            with self.lock:
                return self._reply(number, handler(given))
        except (KeyError, TypeError) as e:
            return self._reply(number, error=(-32602, f"bad parameters: {e}"))

    @staticmethod
    def _reply(number, result=None, error=None) -> dict:
        said = {"error": {"code": error[0], "message": error[1]}} if error else {"result": result}
        return {"jsonrpc": "2.0", "id": number} | said

    def _initialize(self, given: dict) -> dict:
        version = given.get("protocolVersion")
        about = "Read-only queries over collision events. Tasks: " + " ".join(f"{k}: {v}" for k, v in TASKS.items())
        return {"protocolVersion": version if version in VERSIONS else VERSIONS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "nestfold", "version": "1"}, "instructions": about}

    def _list(self, given: dict) -> dict:
        return {"tools": [described(self.tools, n) for n in self.names]}

    def _call(self, given: dict) -> dict:
        if given["name"] not in self.names:
            return {"content": [{"type": "text", "text": f"there is no tool {given['name']}"}], "isError": True}
        said = self.tools.call(given["name"], **(given.get("arguments") or {}))
        return {"content": [{"type": "text", "text": json.dumps(said, default=str)}], "isError": "error" in said}


def _parsed(text: str | bytes):
    try:
        return json.loads(text)
    except ValueError:
        return None


def serve(server: Server, lines: IO, out: IO) -> None:
    """Until ``lines`` end."""
    for line in lines:
        if line.strip():
            said = server.answer(_parsed(line))
            if said is not None:
                out.write(json.dumps(said) + "\n")
                out.flush()


def serve_http(server: Server, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server of posted messages, not started yet (``serve_forever``)."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            said = server.answer(_parsed(self.rfile.read(int(self.headers.get("Content-Length") or 0))))
            body = b"" if said is None else json.dumps(said).encode()
            self.send_response(202 if said is None else 200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
