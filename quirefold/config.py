"""The settings of a chunking run."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from quirefold.constants import OCR_POLICIES, STRATEGIES


class SegmentationError(RuntimeError):
    """A run that cannot go on; the message names the line, document or page."""


@dataclass(frozen=True)
class ChunkingConfig:
    strategy: str = "recursive"
    max_tokens: int = 512
    overlap: int = 64
    min_chunk_tokens: int = 20
    tokenizer_model: str = "BAAI/bge-small-en-v1.5"
    cross_page: bool = False
    on_ocr_needed: str = "skip"
    strict: bool = False

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
        if self.on_ocr_needed not in OCR_POLICIES:
            raise ValueError(f"on_ocr_needed must be one of {', '.join(OCR_POLICIES)}")
        for name, least in (("max_tokens", 1), ("overlap", 0), ("min_chunk_tokens", 0)):
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool) or value < least:
                raise ValueError(f"{name} must be an integer of at least {least}")
        if self.overlap >= self.max_tokens:
            raise ValueError("overlap must be below max_tokens")
        if self.min_chunk_tokens >= self.max_tokens:
            raise ValueError("min_chunk_tokens must be below max_tokens")

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def default(cls, name: str):
        return next(f.default for f in fields(cls) if f.name == name)
