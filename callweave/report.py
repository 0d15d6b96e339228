"""Answers as text: source slices with line numbers, relations, evidence, routes. Input is small by then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = {
    "ambiguous-name": "its receiver has no known type, and several declarations have the name",
    "complex-receiver-chain": "its receiver is another call's result",
    "unknown-type": "the receiver's type was not found",
    "no-enclosing-symbol": "it stands outside of any declaration",
}


def reason_text(reason: str | None) -> str:
    return REASONS.get(reason or "", reason or "unresolved")


def source_slices(symbols: DataFrame, texts: DataFrame, max_lines: int = 200) -> DataFrame:
    """``id, source``: each symbol's own lines, numbered to the right, with a note on what was cut. Native.

    ``texts`` has ``file_id, text``; symbols' byte columns are character offsets.
    """
    met = symbols.join(texts, "file_id").select("id", "start_line", "end_line", F.expr("split(substring(text, start_byte + 1, end_byte - start_byte), '\\n', -1)").alias("ls"))
    shown = F.slice("ls", 1, max_lines)
    width = F.length((F.col("start_line") + F.least(F.size("ls"), F.lit(max_lines)) - 1).cast("string"))
    numbered = F.transform(shown, lambda line, i: F.concat(F.lpad((F.col("start_line") + i).cast("string"), width, F.lit(" ")), F.lit(" | "), line))
    note: Column = F.concat(F.lit("\n"), F.lpad(F.lit(""), width, F.lit(" ")), F.lit(" | ... ("), (F.size("ls") - max_lines).cast("string"), F.lit(" more lines, to line "), F.col("end_line").cast("string"), F.lit(")"))
    return met.select("id", F.concat(F.array_join(numbered, "\n"), F.when(F.size("ls") > max_lines, note).otherwise("")).alias("source"))


def changed_paths(given: list[str], root: str, cwd: str = "") -> list[str]:
    """Paths as the index has them: relative to the root, given so or from the working folder."""
    out = []
    for path in (p.strip() for p in given):
        if not path:
            continue
        full = path if path.startswith("/") else f"{cwd.rstrip('/')}/{path}" if cwd else path
        base = root.rstrip("/") + "/"
        out.append(full[len(base) :] if full.startswith(base) else path.removeprefix("./"))
    return list(dict.fromkeys(out))


def table_text(rows: list, columns: list[str]) -> str:
    """Rows under their column names, aligned."""
    cells = [[("" if r[c] is None else str(r[c])) for c in columns] for r in rows]
    widths = [max(len(c), *(len(x[i]) for x in cells)) if cells else len(c) for i, c in enumerate(columns)]
    line = lambda xs: "  ".join(x.ljust(w) for x, w in zip(xs, widths, strict=True)).rstrip()
    return "\n".join([line(columns), *(line(x) for x in cells)])
