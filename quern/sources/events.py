"""Event streams, as a server sends them and a client reads them: lines ``event:`` and ``data:``, parted by blank lines."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, is_dataclass


def encode(events: Iterable[tuple[str, object]]) -> Iterator[str]:
    """Each event as text; data is JSON."""
    for name, data in events:
        yield f"event: {name}\ndata: {json.dumps(asdict(data) if is_dataclass(data) else data, ensure_ascii=False, default=str)}\n\n"


def decode(lines: Iterable[str]) -> Iterator[tuple[str, object]]:
    """(event, data) of lines as they come. Comments and unknown fields are passed over, data of several lines is joined,
    an event without a name is a message, and data that is no JSON stays a string; an event cut off by the end counts."""
    name, data = "message", []
    for line in [*(part for text in lines for part in text.splitlines() or [""]), ""]:
        field, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if not line:
            if data:
                text = "\n".join(data)
                try:
                    yield name, json.loads(text)
                except ValueError:
                    yield name, text
            name, data = "message", []
        elif field == "event":
            name = value
        elif field == "data":
            data.append(value)
