"""Tools over an index by JSON-RPC, one message a line: read-only SQL and notes of symbols."""

from __future__ import annotations

import json
import re

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.export import notes
from lodestone.operators import read, sqlapi


def note(action: str, folder: str, symbol: str, tables: dict | None, text: str | None = None) -> str:
    """Open or create, append to or renew the note of a symbol; gives its path and text."""
    name = re.sub(r"^[._-]+|[._-]+$", "", re.sub(r"[^A-Za-z0-9._-]+", "_", symbol)) or "symbol"
    path = f"{folder}/{name}.md"
    if action == "append":
        if not text:
            raise ValueError("no text to append")
        notes.append(path, text)
    else:
        body = _body(symbol, tables)
        notes.sync(path, body) if action == "sync" else notes.get_or_create(path, body)
    with open(path, encoding="utf-8") as f:
        return f"Path: {path}\n\n{f.read()}"


def _body(symbol: str, tables: dict | None) -> str:
    found = read.lookup_symbol(tables["symbols"], tables["files"], symbol).first() if tables else None
    if found is None:
        return f"# {symbol}\n"
    made = notes.notes(tables["symbols"], tables["edges"], tables["files"]).where(F.col("path") == found.qualified_name.replace(".", "/") + ".md").first()
    return made.body if made else f"# {found.name}\n\nkind: {found.kind}\nqualified_name: {found.qualified_name}\nfile_path: {found.path}\n"


TOOLS = {"read_query": ["query"], "list_tables": [], "describe_table": ["table_name"], "get_or_create_note": ["symbol_name"], "append_note": ["symbol_name", "text"], "sync_note_structure": ["symbol_name"]}


def call(spark, tables: dict, folder: str, name: str, given: dict) -> str:
    if name not in TOOLS or set(TOOLS[name]) - set(given):
        raise ValueError(f"no tool {name} with these arguments")
    if name == "read_query":
        return sqlapi.as_text(sqlapi.read_query(spark, given["query"]))
    if name == "list_tables":
        return "\n".join(sqlapi.list_tables(spark))
    if name == "describe_table":
        return sqlapi.describe_table(spark, given["table_name"])
    action = {"get_or_create_note": "get-or-create", "append_note": "append", "sync_note_structure": "sync"}[name]
    return note(action, folder, given["symbol_name"], tables, given.get("text"))


def serve(spark, tables: dict, folder: str, lines, out) -> None:
    """Answer requests until the input ends; what a tool refuses is an error result, not the end of the server."""
    for line in lines:
        if not line.strip():
            continue
        ask = json.loads(line)
        if "id" not in ask:
            continue  # a notification
        method, given = ask.get("method"), ask.get("params") or {}
        answer: dict = {"jsonrpc": "2.0", "id": ask["id"]}
        if method == "initialize":
            answer["result"] = {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": "0"}}
        elif method == "tools/list":
            text = lambda names: {"type": "object", "properties": {n: {"type": "string"} for n in names}, "required": names}
            answer["result"] = {"tools": [{"name": n, "description": n.replace("_", " "), "inputSchema": text(a)} for n, a in TOOLS.items()]}
        elif method == "tools/call":
            try:
                said, bad = call(spark, tables, folder, given.get("name"), given.get("arguments") or {}), False
            except (ValueError, FileNotFoundError, PySparkException) as e:
                said, bad = str(e), True
            answer["result"] = {"content": [{"type": "text", "text": said}], "isError": bad}
        else:
            answer["error"] = {"code": -32601, "message": f"no method {method}"}
        print(json.dumps(answer), file=out, flush=True)
