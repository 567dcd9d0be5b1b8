"""Line-delimited JSON-RPC loop over the tools, batch runs, and the answer envelope."""

from __future__ import annotations

import json
import time
from typing import IO

from docframe import __version__
from docframe.tools import registry

MAX_LINE = 10_000_000
RESOURCES = {
    "docframe://manual": ("Manual", "Document tools of docframe: search, read, edit, clean, chunk, extract, convert and picture documents. Call tools/list for their arguments."),
    "docframe://formats": ("Formats", "Read: pdf, docx, xlsx, csv, md, txt, text, log. Convert: xlsx-csv, md-docx/pdf/txt, docx-md/txt/pdf, pdf-txt/md/docx, images among each other and to pdf."),
}
PROMPTS = {"survey_folder": "List the files of a folder, read their metadata, and sum up what they hold. Use search_files, extract_metadata and search_docs."}


def envelope(command: str, data: object = None, error: str = "", message: str = "", stats: dict | None = None) -> dict:
    out: dict = {"success": not error}
    for k, v in (("command", command), ("message", message), ("data", data), ("error", error), ("stats", stats)):
        if v not in ("", None):
            out[k] = v
    return out


def answer(request: dict) -> dict | None:
    """Response to a request, None to a notification."""
    rid, method, params = request.get("id"), request.get("method", ""), request.get("params") or {}
    ok = lambda result: {"jsonrpc": "2.0", "id": rid, "result": result}
    bad = lambda code, text: {"jsonrpc": "2.0", "id": rid, "error": {"code": code, "message": text}}
    if not isinstance(params, dict):
        return bad(-32602, "params must be an object") if rid is not None else None
    if method == "initialize":
        return ok({"protocolVersion": "2024-11-05", "capabilities": {"tools": {}, "resources": {}, "prompts": {}}, "serverInfo": {"name": "docframe", "version": __version__}})
    if method == "ping":
        return ok({})
    if method == "resources/list":
        return ok({"resources": [{"uri": u, "name": n, "mimeType": "text/markdown"} for u, (n, _) in RESOURCES.items()]})
    if method == "resources/read":
        uri = params.get("uri", "")
        return ok({"contents": [{"uri": uri, "mimeType": "text/markdown", "text": RESOURCES.get(uri, ("", f"Resource not found: {uri}"))[1]}]})
    if method == "prompts/list":
        return ok({"prompts": [{"name": n, "description": t} for n, t in PROMPTS.items()]})
    if method == "prompts/get":
        text = PROMPTS.get(params.get("name", ""), "Prompt not found")
        return ok({"messages": [{"role": "user", "content": {"type": "text", "text": text}}]})
    if method == "tools/list":
        return ok({"tools": registry.export()})
    if method == "tools/call":
        if not isinstance(params.get("name"), str):
            return bad(-32602, "a tool name is needed")
        text, error = registry.dispatch(params["name"], params.get("arguments") or {})
        return ok({"content": [{"type": "text", "text": text}], "isError": error})
    return bad(-32601, f"unknown method: {method}") if rid is not None else None


def serve(source: IO[str], sink: IO[str]) -> None:
    """Answer requests line by line; lines that are no JSON object or too long are passed over."""
    for line in source:
        if not line.strip() or len(line) > MAX_LINE:
            continue
        try:
            request = json.loads(line)
        except ValueError:
            continue
        if isinstance(request, dict) and (out := answer(request)) is not None:
            sink.write(json.dumps(out, ensure_ascii=False) + "\n")
            sink.flush()


def manifest(data: bytes) -> list[dict]:
    """Steps of a manifest; a byte order mark is taken off, UTF-16 is read by its mark."""
    text = data.decode("utf-16") if data[:2] in (b"\xff\xfe", b"\xfe\xff") else data.decode("utf-8-sig")
    steps = json.loads(text)
    if not isinstance(steps, list):
        raise ValueError("a manifest is a list of steps")
    return steps


def run_batch(steps: list[dict], stop_on_error: bool = False) -> dict:
    """Run steps one after another: an envelope with their results and how many went well."""
    began, out = time.time(), []
    for n, step in enumerate(steps, 1):
        t = time.time()
        text, error = registry.dispatch(step.get("tool", ""), step.get("arguments") or {})
        row = {"id": step.get("id") or f"step_{n}", "tool": step.get("tool", ""), "success": not error, "duration_ms": int((time.time() - t) * 1000)}
        out.append(row | ({"error": text} if error else {"result": json.loads(text)}))
        if error and stop_on_error:
            break
    good = sum(r["success"] for r in out)
    return envelope("batch", {"steps": out, "succeeded": good, "failed": len(out) - good}, stats={"total": len(steps), "duration_ms": int((time.time() - began) * 1000)})
