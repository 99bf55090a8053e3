"""Lines that the fold knows at one look, against the whole walk through their containers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import blocks

NOTE = [
    "# Top", "- one", "", "- two [[x]]", "  more", "", "  - inner", "", "    text", "## In items", "> quote", "> - in it", "- out", "> # q", "# after", "- x", "```py", "- code", "# code", "", "text", "  ~~~", "```",
    "* star", "lazy", "+ plus", "", "", "1. number", "", "   # inner", "# out", "para", "- item", "para", "# head ##", "#none", "    deep", "", "- after deep", "    code", "# h", "<!--", "- gone", "# gone", "", "-->",
    "- back", "<div>", "- html", "# html", "", "- free", "> ```", "> - c", "- left", "  ```", "  - c", "", "# ends", "", "    deep", "", "    deeper", "- item", "# ends", "    deep", "# ends", "- # inner", "- - two", "- ", "-", "---", "- a", "===", "~~~", "```", "#", "~~~", "#", "-\tx", "\t- y",
]


def test_quick_lines_are_those_of_the_walk(spark, monkeypatch):
    lines = F.array(*[F.lit(x) for x in NOTE])
    rows = lambda: spark.range(1).select(blocks.block_lines(lines, F.lit(0)).alias("r")).first()["r"]
    quick = rows()
    monkeypatch.setattr(blocks, "QUICK", False)
    walked = rows()
    assert [(a, b) for a, b in zip(quick, walked) if a != b] == [] and len(quick) == len(NOTE)
    assert {r["kind"] for r in quick} >= set("bphrxdofe")
