"""Command line: ``python -m docframe.tools.cli GROUP COMMAND ...``; every tool is a command, with file-only ones beside."""

from __future__ import annotations

import argparse
import json
import os
import sys

from docframe import session
from docframe.formats import convert, docx, images, pdf, xlsx
from docframe.operators import icons
from docframe.sources.files import write_atomic
from docframe.tools import registry, server

# command -> tool
COMMANDS = {
    "search code": "search_code", "search files": "search_files", "search docs": "search_docs", "text read-lines": "read_lines", "text replace-lines": "replace_lines", "text insert-lines": "insert_lines", "text delete-lines": "delete_lines",
    "text concat": "concat_files", "text clean": "clean_file", "text chunk": "text_chunk", "text tokens": "text_tokens", "sheets info": "sheets_info", "sheets set-cell": "sheets_set_cell", "sheets get-cell": "sheets_get_cell", "sheets add-row": "sheets_add_row",
    "docs read": "docs_read", "docs snapshot": "docs_snapshot", "pdf read": "pdf_read", "pdf snapshot": "pdf_snapshot", "image extract": "image_extract", "convert run": "convert", "extract links": "extract_links", "extract tables": "extract_tables",
    "extract metadata": "extract_metadata", "icon search": "icon_search", "icon get": "icon_get", "icon scrape": "icon_scrape",
}


def docs_info(a):
    return docx.info(registry.read(a.args[0]))


def docs_edit(a):
    kind, path, *rest = a.args
    data = registry.read(path)
    if kind == "replace":
        data, n = docx.replace_text(data, rest[0], rest[1])
        out = {"replaced": n}
    else:
        data, out = docx.append(data, rest[0], int(rest[1]) if len(rest) > 1 else 0), {"appended": True}
    write_atomic(a.output or path, data)
    return out | {"output": a.output or path}


def pdf_info(a):
    return pdf.info(registry.read(a.args[0]))


def pdf_merge(a):
    write_atomic(a.output, pdf.merge([registry.read(p) for p in a.args]))
    return {"output": a.output}


def pdf_split(a):
    write_atomic(a.output, pdf.split(registry.read(a.args[0]), int(a.args[1]), int(a.args[2]) if len(a.args) > 2 else 0))
    return {"output": a.output}


def image_info(a):
    return images.info(registry.read(a.args[0])) or {"error": "unknown image format"}


def image_convert(a):
    write_atomic(a.output, convert.convert(registry.read(a.args[0]), a.args[0], a.output, quality=a.quality))
    return {"output": a.output}


def image_to_pdf(a):
    write_atomic(a.output, pdf.from_images([registry.read(p) for p in a.args]))
    return {"output": a.output, "pages": len(a.args)}


def sheets_xlsx2csv(a):
    text = xlsx.to_csv(registry.read(a.args[0]), a.sheet, a.delimiter)
    if a.output:
        write_atomic(a.output, text.encode())
    return {"output": a.output} if a.output else {"content": text}


def sheets_csv2xlsx(a):
    write_atomic(a.output, xlsx.from_csv(registry.read(a.args[0]).decode("utf-8", "replace"), a.sheet or "Sheet1", a.delimiter))
    return {"output": a.output}


def icon_collections(a):
    return [r.asDict() for r in icons.collections(registry.spark()).collect()]


def schema_export(a):
    return registry.export(a.format, a.tool)


def batch_run(a):
    return server.run_batch(server.manifest(registry.read(a.args[0])), a.stop_on_error)


def rpc_serve(a):
    server.serve(sys.stdin, sys.stdout)


OTHERS = {f.__name__.replace("_", " ", 1): f for f in (docs_info, docs_edit, pdf_info, pdf_merge, pdf_split, image_info, image_convert, image_to_pdf, sheets_xlsx2csv, sheets_csv2xlsx, icon_collections, schema_export, batch_run, rpc_serve)}
OTHERS = {k.replace("to_pdf", "to-pdf"): v for k, v in OTHERS.items()}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docframe", description="Document tools. Tool commands take --name value for every argument.")
    p.add_argument("--json", action="store_true", help="print the envelope")
    p.add_argument("--silent", action="store_true", help="print nothing but errors")
    p.add_argument("--workers", type=int, default=os.cpu_count() or 1, help="threads of the local session")
    p.add_argument("group")
    p.add_argument("command")
    known, rest = p.parse_known_args(argv)
    command = f"{known.group} {known.command}"
    session.build(f"local[{max(known.workers, 1)}]", spark__sql__shuffle__partitions=str(max(known.workers, 1)))
    try:
        if command in COMMANDS:
            t = registry.TOOLS[COMMANDS[command]]
            q = argparse.ArgumentParser(prog=f"docframe {command}")
            for name, (kind, text) in t.accepted.items():
                extra = {"action": "store_true"} if kind == "boolean" else {"nargs": "+"} if kind == "array" else {"type": registry.KINDS[kind]}
                q.add_argument(f"--{name}", help=text, default=None, **extra)
            args = {k: v for k, v in vars(q.parse_args(rest)).items() if v is not None}
            text, error = registry.dispatch(t.name, args)
            out = server.envelope(command, error=text) if error else server.envelope(command, json.loads(text))
        elif command in OTHERS:
            q = argparse.ArgumentParser(prog=f"docframe {command}")
            q.add_argument("args", nargs="*")
            q.add_argument("-o", "--output", default="")
            q.add_argument("--sheet", default="")
            q.add_argument("--delimiter", default=",")
            q.add_argument("--quality", type=int, default=0)
            q.add_argument("--format", default="plain")
            q.add_argument("--tool", default="")
            q.add_argument("--stop-on-error", action="store_true")
            out = server.envelope(command, OTHERS[command](q.parse_args(rest)))
        else:
            out = server.envelope(command, error=f"unknown command: {command}")
    except (OSError, ValueError, KeyError, IndexError) as x:
        out = server.envelope(command, error=f"{type(x).__name__}: {x}")
    if not out["success"]:
        print(json.dumps(out, ensure_ascii=False) if known.json else f"Error: {out['error']}", file=sys.stdout if known.json else sys.stderr)
        return 1
    if not known.silent:
        print(json.dumps(out if known.json else out.get("data"), ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
