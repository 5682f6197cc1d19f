"""What counts as a valid input line, and how its values are read.

Integers may come as whole floats, booleans or digit strings; booleans as 0, 1 or
the usual words; strings only as strings. Null is refused unless stated. Outline
entries and metadata admit no unknown keys, documents and pages do.
"""

from __future__ import annotations

import json

from quirefold.schemas import METADATA_FIELDS

MOST = 2**63 - 1
#: Strings read as booleans, in any case.
TRUE = ("true", "t", "yes", "y", "on", "1")
FALSE = ("false", "f", "no", "n", "off", "0")


class Invalid(ValueError):
    pass


def integer(value, name: str, least: int | None = None) -> int:
    if isinstance(value, str):
        text = value.strip()
        whole, _, rest = text.partition(".")
        if rest.strip("0") or not whole.lstrip("+-").isdecimal() or (not rest and text.endswith(".")):
            raise Invalid(f"{name}: not an integer")
        value = int(whole)
    elif isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")) or value != int(value):
            raise Invalid(f"{name}: not an integer")
        value = int(value)
    elif isinstance(value, bool):
        value = int(value)
    elif not isinstance(value, int):
        raise Invalid(f"{name}: not an integer")
    if least is not None and value < least or abs(value) > MOST:
        raise Invalid(f"{name}: out of range")
    return value


def string(value, name: str) -> str:
    if not isinstance(value, str):
        raise Invalid(f"{name}: not a string")
    try:
        value.encode("utf-8")
    except UnicodeEncodeError:
        raise Invalid(f"{name}: a lone surrogate") from None
    return value


def boolean(value, name: str) -> bool:
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) and value in (0, 1):
        return bool(value)
    if isinstance(value, str) and value.lower() in TRUE:
        return True
    if isinstance(value, str) and value.lower() in FALSE:
        return False
    raise Invalid(f"{name}: not a boolean")


def _field(record: dict, name: str):
    if name not in record:
        raise Invalid(f"{name}: missing")
    return record[name]


def _closed(record, names: tuple[str, ...], where: str) -> dict:
    if not isinstance(record, dict):
        raise Invalid(f"{where}: not an object")
    if extra := set(record) - set(names):
        raise Invalid(f"{where}: unknown key {sorted(extra)[0]!r}")
    return record


def document(record: dict) -> dict:
    meta = _closed(_field(record, "metadata"), METADATA_FIELDS, "metadata")
    toc = record.get("toc", [])
    if not isinstance(toc, list):
        raise Invalid("toc: not a list")
    entries = []
    for x in toc:
        x = _closed(x, ("text", "level", "page_index"), "toc entry")
        page = x.get("page_index")
        entries.append(
            {
                "text": string(_field(x, "text"), "toc text"),
                "level": integer(_field(x, "level"), "toc level", 0),
                "page_index": None if page is None else integer(page, "toc page_index"),
            }
        )
    return {
        "doc_id": string(_field(record, "doc_id"), "doc_id"),
        "source_path": string(_field(record, "source_path"), "source_path"),
        "page_count": integer(_field(record, "page_count"), "page_count", 0),
        "metadata": {n: string(meta.get(n, ""), n) for n in METADATA_FIELDS},
        "toc": entries,
    }


def page(record: dict) -> dict:
    label = _field(record, "page_label")
    return {
        "doc_id": string(_field(record, "doc_id"), "doc_id"),
        "page_index": integer(_field(record, "page_index"), "page_index", 0),
        "page_label": None if label is None else string(label, "page_label"),
        "text": string(_field(record, "text"), "text"),
        "needs_ocr": boolean(_field(record, "needs_ocr"), "needs_ocr"),
    }


def read_line(line: str) -> tuple[str, dict | None, str | None]:
    """(document, page or invalid; the record; what is wrong)."""
    try:
        record = json.loads(line)
    except (ValueError, RecursionError) as e:
        return "invalid", None, f"not JSON ({e})"
    if not isinstance(record, dict):
        return "invalid", None, "not an object"
    reader = {"document": document, "page": page}.get(record.get("record_type")) if isinstance(record.get("record_type"), str) else None
    if reader is None:
        return "invalid", None, "unknown record_type"
    try:
        return record["record_type"], reader(record), None
    except Invalid as e:
        return "invalid", None, str(e)
