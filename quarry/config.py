"""Settings from environment variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

_FALSE = ("false", "0", "no")
VISION_MODES = ("threshold", "landscape", "all")


@dataclass(frozen=True)
class Config:
    watch_folders: tuple[str, ...] = ()
    store_path: str = "quarry_store"
    llm_model: str = ""
    embedding_model: str = "hashing-64"
    chunk_size: int = 2000
    chunk_overlap: int = 200
    file_extensions: tuple[str, ...] = field(default=(".pdf", ".docx", ".doc", ".txt", ".md", ".rtf", ".xlsx", ".xls"))
    max_file_size_mb: int = 100
    use_structured_parsing: bool = True
    max_chunk_tokens: int = 512
    enable_ocr: bool = True
    enable_vision_enhancement: bool = False
    vision_word_threshold: int = 50
    vision_mode: str = "threshold"
    max_initial_files: int = 500

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        """Unset variables leave the defaults; folders that don't exist are left out; all but false, 0 and no is true."""
        env = os.environ if env is None else env
        found: dict = {}

        def listed(name: str) -> tuple[str, ...]:
            return tuple(x.strip() for x in env[name].split(",") if x.strip())

        if "WATCH_FOLDERS" in env:
            found["watch_folders"] = tuple(x for x in listed("WATCH_FOLDERS") if os.path.isdir(x))
        if "FILE_EXTENSIONS" in env:
            found["file_extensions"] = listed("FILE_EXTENSIONS")
        for name, key in (("STORE_PATH", "store_path"), ("LLM_MODEL", "llm_model"), ("EMBEDDING_MODEL", "embedding_model")):
            if name in env:
                found[key] = env[name]
        for name in ("CHUNK_SIZE", "CHUNK_OVERLAP", "MAX_FILE_SIZE_MB", "MAX_CHUNK_TOKENS", "VISION_WORD_THRESHOLD", "MAX_INITIAL_FILES"):
            if name in env:
                found[name.lower()] = int(env[name])
        for name in ("USE_STRUCTURED_PARSING", "ENABLE_OCR", "ENABLE_VISION_ENHANCEMENT"):
            if name in env:
                found[name.lower()] = env[name].strip().lower() not in _FALSE
        if (mode := env.get("VISION_MODE", "").strip().lower()) in VISION_MODES:
            found["vision_mode"] = mode
        return cls(**found)
