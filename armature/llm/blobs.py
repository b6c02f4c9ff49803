"""Files below the shared folder that tasks write once and other tasks read."""

from __future__ import annotations

import uuid

from armature.llm.token_files import place


def store(folder: str, raw: bytes) -> str:
    """A new file; its name is of this attempt of the task alone."""
    files, at = place(folder)
    files.create_dir(at, recursive=True)
    name = uuid.uuid4().hex
    with files.open_output_stream(f"{at}/{name}") as f:
        f.write(raw)
    return name


def fetch(folder: str, name: str) -> bytes:
    files, at = place(folder)
    with files.open_input_stream(f"{at}/{name}") as f:
        return f.read()
