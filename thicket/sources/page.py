"""A store as a page: an aid for looking at small ones."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

from ..operators import scans


def to_html(kv: DataFrame, limit: int = 1000) -> str:
    """The first ``limit`` paths of a ``kv`` frame, in key order, as nested lists; values that are no text are shown as hex."""
    rows = scans.scan(kv, limit=limit + 1).collect()
    out, open_path = ["<ul>"], []
    for row in rows[:limit]:
        path = list(row.path)
        same = 0
        while same < min(len(open_path), len(path) - 1) and open_path[same] == path[same]:
            same += 1
        out += ["</ul></li>"] * (len(open_path) - same)
        for part in path[same:-1]:
            out.append(f"<li>{escape(part)}<ul>")
        open_path = path[:-1]
        value = row.value if row.value is not None else f"0x{bytes(row.data).hex()}"
        out.append(f"<li>{escape(path[-1])}: <code>{escape(value)}</code></li>")
    out += ["</ul></li>"] * len(open_path)
    out.append("</ul>" + "<p>more</p>" * (len(rows) > limit))
    return "".join(out)
