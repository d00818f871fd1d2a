"""The catalog's functions as tools over standard input and output: one JSON-RPC message a line, in the Model Context Protocol.

The role and the principal are those of the client that the server was started with; no message can change them.
Answers go out in the order of the requests. A tool that refuses says so in its result; a message that is
none, or that names no method, tool or argument of ours, gets an error of the protocol.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import IO, Any

from .catalog import Client
from .gateway import MOST_ROWS

#: Versions of the protocol that are spoken, the newest first.
VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
#: Fixed values of JSON-RPC.
NOT_JSON, NOT_A_REQUEST, NO_METHOD, BAD_PARAMETERS, INTERNAL = -32700, -32600, -32601, -32602, -32603
_KINDS = {"string": str, "integer": int}


class ProtocolError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Tool:
    about: str
    run: Callable[..., Any]
    #: Arguments with their JSON types; those with a default need not be there.
    arguments: dict[str, str]
    defaults: dict[str, Any] = field(default_factory=dict)

    def described(self, name: str) -> dict[str, Any]:
        properties = {a: {"type": t} | ({"default": self.defaults[a]} if a in self.defaults else {}) for a, t in self.arguments.items()}
        required = [a for a in self.arguments if a not in self.defaults]
        schema = {"type": "object", "properties": properties, "required": required, "additionalProperties": False}
        return {"name": name, "description": self.about, "inputSchema": schema, "annotations": {"readOnlyHint": True}}

    def checked(self, given: Any) -> dict[str, Any]:
        """The arguments as the tool takes them; anything unknown, missing or of another type is an error."""
        if not isinstance(given, dict):
            raise ProtocolError(BAD_PARAMETERS, "arguments have to be an object")
        own = self.defaults | given
        wrong = [a for a in own if a not in self.arguments] + [a for a in self.arguments if a not in own]
        wrong += [a for a, t in self.arguments.items() if a in own and (isinstance(own[a], bool) or not isinstance(own[a], _KINDS[t]))]
        if wrong:
            raise ProtocolError(BAD_PARAMETERS, f"wrong arguments: {', '.join(sorted(set(wrong)))}")
        return own


def tools(client: Client) -> dict[str, Tool]:
    return {
        "search_tables": Tool("Tables by words of their names, descriptions and columns.", lambda query: {"tables": client.search_tables(query)}, {"query": "string"}),
        "describe_table": Tool("Columns of one table with types, descriptions and classes of personal data.", client.describe_table, {"name": "string"}),
        "get_metric": Tool("The definition of a metric, its known variants and its latest values.", client.get_metric, {"name": "string"}),
        "run_query": Tool(f"The rows of one SELECT over the tables, {MOST_ROWS} at most.", client.run_query, {"sql": "string", "limit": "integer"}, {"limit": MOST_ROWS}),
    }


class Server:
    def __init__(self, client: Client):
        self.tools = tools(client)
        self.methods: dict[str, Callable[[dict], Any]] = {"initialize": self._initialize, "ping": lambda _: {}, "tools/list": lambda _: {"tools": [t.described(n) for n, t in self.tools.items()]}, "tools/call": self._call}

    def _initialize(self, params: dict) -> dict[str, Any]:
        asked = params.get("protocolVersion")
        return {"protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "millrace", "version": "1"}, "instructions": "Find tables with search_tables and describe_table, then ask with run_query."}

    def _call(self, params: dict) -> dict[str, Any]:
        name = params.get("name")
        if name not in self.tools:
            raise ProtocolError(BAD_PARAMETERS, f"no tool {name}")
        arguments = self.tools[name].checked(params.get("arguments", {}))
        try:
            found = self.tools[name].run(**arguments)
        except LookupError as e:
            return _text(str(e.args[0]), failed=True)
        if "denied" in found:
            return _text(f"query denied: {found['denied']}", failed=True)
        return _text(json.dumps(found, ensure_ascii=False)) | {"structuredContent": found}

    def answer(self, line: str) -> dict[str, Any] | None:
        """The response to one message; None for a notification and for an empty line."""
        if not line.strip():
            return None
        key = None
        try:
            try:
                message = json.loads(line)
            except ValueError:
                raise ProtocolError(NOT_JSON, "no JSON") from None
            if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
                raise ProtocolError(NOT_A_REQUEST, "no request")
            if "id" not in message:
                return None
            key, params = message["id"], message.get("params", {})
            if message["method"] not in self.methods:
                raise ProtocolError(NO_METHOD, f"no method {message['method']}")
            if not isinstance(params, dict):
                raise ProtocolError(BAD_PARAMETERS, "params have to be an object")
            return {"jsonrpc": "2.0", "id": key, "result": self.methods[message["method"]](params)}
        except ProtocolError as e:
            return _error(key, e.code, str(e))
        except Exception as e:  # noqa: BLE001  one failing request ends no session; its message might hold values
            return _error(key, INTERNAL, type(e).__name__)

    def serve(self, source: Iterator[str] | IO[str], sink: IO[str]) -> None:
        """Answers every line until there are no more."""
        for line in source:
            if (response := self.answer(line)) is not None:
                sink.write(json.dumps(response, ensure_ascii=False) + "\n")
                sink.flush()


def _text(text: str, failed: bool = False) -> dict[str, Any]:
    return {"content": [{"type": "text", "text": text}], "isError": failed}


def _error(key: Any, code: int, message: str) -> dict[str, Any]:
    return {"jsonrpc": "2.0", "id": key, "error": {"code": code, "message": message}}
