"""The Model Context Protocol over standard input and output: one JSON-RPC 2.0 message a line.

Answers initialize, ping, tools/list, tools/call, resources/list, resources/templates/list and resources/read from an
``api.Server``. Notifications have no answer; a line that is no message is answered with a parse error.
"""

from __future__ import annotations

import json
import sys

from codeloom import __version__

# Versions of the protocol that the messages used here are the same in, and error codes of JSON-RPC.
VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
PARSE, INVALID, UNKNOWN, BAD_PARAMETERS, INTERNAL = -32700, -32600, -32601, -32602, -32603


class Refused(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Exchange:
    """The state of one client's session."""

    def __init__(self, server):
        self.server, self.ready = server, False
        self.methods = {
            "initialize": self.initialize, "ping": lambda _: {}, "tools/list": lambda _: {"tools": server.list_tools()}, "tools/call": self.call_tool,
            "resources/list": lambda _: {"resources": [{"uri": u, "name": u.rpartition("/")[2], "mimeType": "application/json"} for u in server.resources()]},
            "resources/templates/list": lambda _: {"resourceTemplates": []}, "resources/read": self.read_resource,
        }

    def initialize(self, given: dict) -> dict:
        asked = given.get("protocolVersion")
        return {
            "protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {"listChanged": False}, "resources": {"subscribe": False, "listChanged": False}},
            "serverInfo": {"name": "codeloom", "version": __version__},
        }

    def call_tool(self, given: dict) -> dict:
        name = given.get("name")
        if not isinstance(name, str):
            raise Refused(BAD_PARAMETERS, "a tool's name is required")
        answer = self.server.call(name, given.get("arguments") or {})
        return {"content": [{"type": "text", "text": json.dumps(answer, default=str)}], "isError": "error" in answer}

    def read_resource(self, given: dict) -> dict:
        uri = given.get("uri")
        answer = self.server.read_resource(uri) if isinstance(uri, str) else {"error": "a uri is required"}
        if "error" in answer:
            raise Refused(BAD_PARAMETERS, answer["error"])
        return {"contents": [{"uri": uri, "mimeType": "application/json", "text": json.dumps(answer, default=str)}]}

    def answer(self, line: str) -> dict | None:
        """The answer to a line, or None if it asks for none."""
        try:
            message = json.loads(line)
        except ValueError as e:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": str(e)}}
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            return {"jsonrpc": "2.0", "id": message.get("id") if isinstance(message, dict) else None, "error": {"code": INVALID, "message": "not a request"}}
        method, given = message["method"], message.get("params") or {}
        if "id" not in message:
            self.ready = self.ready or method == "notifications/initialized"
            return None
        out = {"jsonrpc": "2.0", "id": message["id"]}
        try:
            if method not in self.methods:
                raise Refused(UNKNOWN, f"unknown method: {method}")
            return out | {"result": self.methods[method](given)}
        except Refused as e:
            return out | {"error": {"code": e.code, "message": str(e)}}
        except Exception as e:  # noqa: BLE001  a client gets every failure as an answer
            return out | {"error": {"code": INTERNAL, "message": str(e)}}


def serve(server, lines=sys.stdin, out=sys.stdout) -> None:
    """Answers messages until the input ends, then writes the session's metrics."""
    exchange = Exchange(server)
    try:
        for line in lines:
            if line.strip() and (answer := exchange.answer(line)) is not None:
                print(json.dumps(answer), file=out, flush=True)
    finally:
        server.session.persist()
        server.session.end()
