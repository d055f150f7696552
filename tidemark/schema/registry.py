"""The schema registry: content-addressed schemas, linked to topics in order."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .canonical import canonical, schema_hash
from .compat import Incompatible, NotFound, TopicNotFound, backward_compatible, load

#: Fixed: smaller ids are reserved.
FIRST_ID = 100


@dataclass
class Registry:
    """Kept in memory, and in one JSON file if a path is given, which is replaced as a whole."""

    path: str | None = None
    schemas: dict[int, str] = field(default_factory=dict)
    links: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.path and Path(self.path).exists():
            saved = json.loads(Path(self.path).read_text())
            self.schemas, self.links = {int(k): v for k, v in saved["schemas"].items()}, saved["links"]

    def create_topic(self, topic: str) -> None:
        self.links.setdefault(topic, [])
        self._save()

    def register(self, topic: str, schema: Any) -> int:
        """The schema's id. The same schema again gives the same id; else it must read the topic's latest."""
        load(schema)
        if topic not in self.links:
            raise TopicNotFound(topic)
        known = self.id_of(schema)
        if known is not None and known in self.links[topic]:
            return known
        if not self.check(topic, schema):
            raise Incompatible(topic)
        number = known if known is not None else max([FIRST_ID - 1, *self.schemas]) + 1
        self.schemas[number] = canonical(schema)
        self.links[topic].append(number)
        self._save()
        return number

    def check(self, topic: str, schema: Any) -> bool:
        latest = self.links.get(topic)
        return not latest or backward_compatible(schema, self.schemas[latest[-1]])

    def get(self, number: int) -> Any:
        if number not in self.schemas:
            raise NotFound(number)
        return json.loads(self.schemas[number])

    def latest(self, topic: str) -> tuple[int, Any]:
        if not self.links.get(topic):
            raise NotFound(topic)
        number = self.links[topic][-1]
        return number, self.get(number)

    def list(self, topic: str) -> list[int]:
        """Newest first."""
        if topic not in self.links:
            raise TopicNotFound(topic)
        return self.links[topic][::-1]

    def id_of(self, schema: Any) -> int | None:
        h = schema_hash(schema)
        return next((n for n, s in self.schemas.items() if schema_hash(s) == h), None)

    def _save(self) -> None:
        if self.path:
            new = f"{self.path}.new"
            Path(new).write_text(json.dumps({"schemas": self.schemas, "links": self.links}))
            os.replace(new, self.path)
