"""Fixed values that the result format prescribes."""

ENGINE_NAME = "quirefold"
ENGINE_VERSION = "0.1.0"

# Fixed values of the result format.
PAGE_JOINER = "\n\n"
SCHEMA_VERSION = "1.0.0"
STRATEGIES = ("page", "fixed-size", "sentence", "recursive", "section")
OCR_POLICIES = ("skip", "include", "error")
SKIP_REASONS = ("needs_ocr", "empty_text", "invalid_record")

#: White space as Python's str.strip and \s see it; Java's own classes differ.
WS_CHARS = (
    "\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a"
    "\\u2028\\u2029\\u202f\\u205f\\u3000"
)
WS = f"[{WS_CHARS}]"
NON_WS = f"[^{WS_CHARS}]"
