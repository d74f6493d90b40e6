"""Settings from the environment, and logging."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    data_dir: str = "data"
    default_embedding: str = "hashing"

    @classmethod
    def from_env(cls) -> Config:
        return cls(os.environ.get("DATA_DIR", cls.data_dir), os.environ.get("DEFAULT_EMBEDDING", cls.default_embedding))


def get_logger(name: str) -> logging.Logger:
    """A logger with one stream handler at INFO, however often it is asked for."""
    logger = logging.getLogger(name)
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        logger.addHandler(handler)
        logger.setLevel(logging.INFO)
    return logger
