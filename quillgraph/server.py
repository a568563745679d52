"""The tools over standard input and output: JSON-RPC 2.0, one message a line (the model context protocol's stdio form)."""

from __future__ import annotations

import json
import logging
import sys
from typing import IO

from .schema import DEFAULTS
from .tools import Tools

log = logging.getLogger(__name__)

PROTOCOL = "2024-11-05"
_GRAPH = {"type": "string", "description": "a graph's nickname or name, see list_indexes"}
#: name -> (description, properties, required)
TOOLS: dict[str, tuple[str, dict, list[str]]] = {
    "list_indexes": ("The graphs known on this machine and which of them are indexed.", {}, []),
    "semantic_search": (
        "Search a graph by meaning and keywords. An old index is refreshed before; see refresh.state.",
        {"graph": _GRAPH, "query": {"type": "string"}, "k": {"type": "integer", "minimum": 0, "default": DEFAULTS.default_k}},
        ["graph", "query"],
    ),
    "refresh_index": ("Capture a graph again and index what has changed.", {"graph": _GRAPH}, ["graph"]),
    "index_stats": ("What an index was made from, and when.", {"graph": _GRAPH}, ["graph"]),
}


def answer(tools: Tools, message: dict) -> dict | None:
    """The answer to one message; None for a notification."""
    method, params = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    if method == "initialize":
        result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "quillgraph", "version": "2"}}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}
    elif method == "tools/call" and params.get("name") in TOOLS:
        try:
            found, failed = json.dumps(getattr(tools, params["name"])(**(params.get("arguments") or {})), default=str), False
        except Exception as e:  # noqa: BLE001  told to the caller, who may ask again
            log.warning("%s failed: %s", params["name"], e)
            found, failed = str(e), True
        result = {"content": [{"type": "text", "text": found}], "isError": failed}
    elif method == "ping":
        result = {}
    else:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"unknown: {method} {params.get('name', '')}".strip()}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve(tools: Tools, asked: IO[str] = sys.stdin, said: IO[str] = sys.stdout) -> None:
    """Answer messages until the input ends."""
    for line in asked:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            found = answer(tools, message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
        except json.JSONDecodeError as e:
            found = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if found is not None:
            print(json.dumps(found), file=said, flush=True)
