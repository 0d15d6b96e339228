"""What an extractor finds in one file. Sequence numbers stand for ids until the file's path is known."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Found:
    package: str | None = None
    symbols: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    locals: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)

    def add(self, table: str, **row) -> int:
        rows = getattr(self, table)
        rows.append({"seq": len(rows), **row})
        return len(rows) - 1
