"""A chunking run as a function call with plain arguments and a plain result."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import fields
from typing import Any

from quirefold.config import ChunkingConfig
from quirefold.constants import OCR_POLICIES, STRATEGIES

#: Settings a caller may give; strict reading is not offered.
OFFERED = tuple(f.name for f in fields(ChunkingConfig) if f.name != "strict")
_TYPES = {str: "string", int: "integer", bool: "boolean"}
_CHOICES = {"strategy": STRATEGIES, "on_ocr_needed": OCR_POLICIES}
_LEAST = {"max_tokens": 1, "overlap": 0, "min_chunk_tokens": 0}


def _property(name: str) -> dict[str, Any]:
    default = ChunkingConfig.default(name)
    out: dict[str, Any] = {"type": _TYPES[type(default)], "default": default}
    if name in _CHOICES:
        out["enum"] = list(_CHOICES[name])
    if name in _LEAST:
        out["minimum"] = _LEAST[name]
    return out


TOOL_SPEC: dict[str, Any] = {
    "name": "chunk_pages",
    "description": "Cut the page text of extracted documents (JSONL) into token-budgeted chunks (JSONL).",
    "input_schema": {
        "type": "object",
        "properties": {
            "input_path": {"type": "string", "description": "JSONL of document and page records"},
            "output_path": {"type": "string", "description": "JSONL to write"},
            **{name: _property(name) for name in OFFERED},
        },
        "required": ["input_path", "output_path"],
        "additionalProperties": False,
    },
}


def run_tool(arguments: Mapping[str, Any], spark=None) -> dict[str, Any]:
    """ok with counters, or ok: False with an error; it never raises. Unknown arguments are ignored."""
    try:
        source, target = arguments.get("input_path"), arguments.get("output_path")
        if not source or not target:
            return {"ok": False, "error": "input_path and output_path are required"}
        cfg = ChunkingConfig(**{k: v for k, v in arguments.items() if k in OFFERED})
        from quirefold.plans.stream_job import process_file, summary
        from quirefold.session import local_session

        made = process_file(spark or local_session(), str(source), str(target), cfg)
        # the caller asked for one file with all skipped pages in its last line; the result lists them, too
        stats, skipped = summary(made, None)
        return {"ok": True, "output_path": str(target), "stats": stats, "chunks_written": stats["chunks_written"], "pages_skipped": skipped}
    except Exception as e:  # the caller gets every failure as a result
        return {"ok": False, "error": f"{type(e).__name__}: {e}"}
