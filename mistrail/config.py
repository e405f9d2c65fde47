"""Configurations and their hashes, by which results are tied to what made them."""

from __future__ import annotations

import dataclasses
import hashlib
import json


def content_hash(config: object) -> str:
    """Sixteen hex digits of the configuration's content: a dataclass, a dict, or anything that JSON can hold."""
    plain = dataclasses.asdict(config) if dataclasses.is_dataclass(config) and not isinstance(config, type) else config
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()[:16]
