"""Settings of the engine."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Limits and switches; defaults reproduce the documented behaviour, switches mend single quirks of it.

    lenient_enum: enum bodies without `;` give their constants, too. strict_missing: an external `missing` with evidence
    goes to confirm rather than fix. trim_path_tail: full stops at the end of a path are not part of it.
    """

    error_code_digits: int = 5
    max_block_lines: int = 40
    text_batch_lines: int = 1200
    text_batch_blocks: int = 60
    image_batch_blocks: int = 6
    base_lines: int = 320
    verdict_batch: int = 8
    verdict_code_lines: int = 600
    recheck_batch: int = 5
    recheck_code_lines: int = 900
    method_head: int = 100
    method_tail: int = 120
    fallback_window: int = 25
    quote_window: int = 25
    sample_size: int = 20
    seed: int = 0
    lenient_enum: bool = False
    strict_missing: bool = False
    trim_path_tail: bool = False

    @classmethod
    def from_env(cls, **more) -> EngineConfig:
        """Digits of error codes from VERITRACE_ERROR_CODE_DIGITS where it is a positive number."""
        raw = os.environ.get("VERITRACE_ERROR_CODE_DIGITS", "")
        if raw.isdigit() and int(raw) > 0:
            more.setdefault("error_code_digits", int(raw))
        return cls(**more)
