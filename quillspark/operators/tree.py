"""The section tree: path-encoded node ids (P<paper>/S<1.2.3>), parents, roll-ups, numbering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def parent_of(node: str | Column) -> Column:
    """Id of the parent: the number without its last part; null for a top section."""
    c = F.col(node) if isinstance(node, str) else node
    return F.when(c.rlike(r"\.[0-9]+$"), F.regexp_replace(c, r"\.[0-9]+$", ""))


def ancestors(node: str | Column) -> Column:
    """Ids of the node and of everything above it, top first."""
    c = F.col(node) if isinstance(node, str) else node
    paper, parts = F.regexp_extract(c, r"^(P[0-9]+/S)", 1), F.split(F.regexp_extract(c, r"/S([0-9.]+)$", 1), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(paper, F.array_join(F.slice(parts, F.lit(1), i), ".")))


def one_per_node(nodes: DataFrame) -> DataFrame:
    """The first stored row of each node; copies of a node drop out before anything is summed."""
    return nodes.groupBy("paper_id", "node_id").agg(*[F.min_by(c, "id").alias(c) for c in nodes.columns if c not in ("paper_id", "node_id", "id")], F.min("id").alias("id"))


def roll_up(nodes: DataFrame) -> DataFrame:
    """paper_id, node_id, n_sections, n_chars of every node with all below it: each node is counted for its ancestors, no recursion."""
    each = one_per_node(nodes.select("id", "paper_id", "node_id", "body")).select("paper_id", F.length(F.coalesce("body", F.lit(""))).alias("n"), F.explode(ancestors("node_id")).alias("node_id"))
    return each.groupBy("paper_id", "node_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("n").alias("n_chars"))


def number_paths(paths: DataFrame) -> DataFrame:
    """paper_id, seq, number: dotted numbers for sections given in order by their title paths (an array).

    A section keeps the numbers of the ancestors it shares with the one before, counts on where the paths part, and
    begins at 1 below; an equal path is the next sibling. Sections of a paper follow each other, so each paper is one
    group; papers are bounded.
    """

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        names: list[str] = []
        counts: list[int] = []
        out = []
        for row in pdf.sort_values("seq").itertuples(index=False):
            path = [p for p in row.path if p] or [""]
            shared = next((i for i, (a, b) in enumerate(zip(names, path)) if a != b), min(len(names), len(path)))
            shared = min(shared, len(path) - 1)
            counts = [counts[i] if i < shared else counts[i] + 1 if i == shared and i < len(counts) else 1 for i in range(len(path))]
            names = path
            out.append((row.paper_id, row.seq, ".".join(map(str, counts))))
        return pd.DataFrame(out, columns=["paper_id", "seq", "number"])

    return paths.groupBy("paper_id").applyInPandas(number, "paper_id bigint, seq bigint, number string")


def passages(nodes: DataFrame, size: int = 400) -> DataFrame:
    """id, passage_no, offset, passage: paragraphs and sentences packed greedily up to about `size` characters."""
    import re

    cut = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, body in zip(pdf["id"], pdf["body"]):
                begin, no = 0, 0
                for m in [*cut.finditer(body), None]:
                    end = m.end() if m else len(body)
                    if end - begin >= size or m is None:
                        piece = body[begin:end]
                        if piece.strip():
                            no += 1
                            out.append((i, no, begin, piece.strip()))
                        begin = end
            yield pd.DataFrame(out, columns=["id", "passage_no", "offset", "passage"]).astype({"passage_no": "int32", "offset": "int32"})

    return nodes.select("id", "body").where("length(body) > 0").mapInPandas(pack, "id bigint, passage_no int, offset int, passage string")
