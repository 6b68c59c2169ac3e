"""Articles -> heading-aware chunks, document by document without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import CHUNK

HEADING = re.compile(r"(#{2,4})\s+(.*)$")
ITEM = re.compile(r"-|\d+\.\s+")


def tokens(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def tidy(text: str) -> str:
    """``normalize_whitespace`` of one text."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text.replace("\r\n", "\n"))).strip()


def split_sections(markdown: str, title: str) -> list[tuple[list[str], str]]:
    """``(heading path, content)`` of the parts between headings of levels two to four; the path starts with the title.

    A heading takes the place of all of its depth or deeper, where depth counts headings, so a skipped level nests.
    Headings split inside code fences too.
    """
    parts: list[tuple[list[str], list[str]]] = [([title], [])]
    path: list[str] = []
    for line in markdown.splitlines():
        if m := HEADING.match(line):
            name = m[2].strip()
            path = path[: len(m[1]) - 2] + [name] * bool(name)
            parts.append(([title, *path], []))
        else:
            parts[-1][1].append(line)
    filled = [(p, content) for p, lines in parts if (content := "\n".join(lines).strip())]
    return filled or [([title], markdown.strip())]


def split_blocks(text: str) -> list[str]:
    """Blocks between blank lines; a code fence ends its block and keeps its blank lines."""
    blocks: list[list[str]] = [[]]
    fenced = False
    for line in text.splitlines():
        fence = line.strip().startswith("```")
        if fence or fenced or line.strip():
            blocks[-1].append(line)
        if fence and fenced or not fenced and not fence and not line.strip():
            blocks.append([])
        fenced ^= fence
    return [b for lines in blocks if (b := "\n".join(lines).strip())]


def pack(pieces: list[str], between: str, most: int) -> list[str]:
    """Pieces joined greedily while their estimate stays within ``most``; lengths are carried, not joined anew."""
    out, held, size = [], [], 0
    for piece in pieces:
        if held:
            lead, trail = len(held[0]) - len(held[0].lstrip()), len(piece) - len(piece.rstrip())
            if (size + len(between) + len(piece) - lead - trail) // 4 > most:
                out.append(between.join(held).strip())
                held, size = [], 0
        size += len(piece) + len(between) * bool(held)
        held.append(piece)
    return out + [between.join(held).strip()] * bool(held)


def split_oversized(block: str, most: int) -> list[str]:
    """An oversized block by its list items, or else by its sentences."""
    lines = block.splitlines()
    if not any(ITEM.match(x.strip()) for x in lines):
        return pack([s for s in re.split(r"(?<=[.!?])\s+", block) if s], " ", most)
    items: list[list[str]] = []
    for line in lines:
        if not items or ITEM.match(line.strip()):
            items.append([])
        items[-1].append(line)
    return pack(["\n".join(i) for i in items], "\n", most)


def chunk_text(markdown: str, title: str, least: int = 200, most: int = 500) -> list[tuple[list[str], str]]:
    """``(heading path, text)`` of the chunks of one article.

    Blocks are packed up to ``most`` tokens within a section, oversized ones split; a chunk of fewer than ``least`` tokens
    then joins the chunk before it, whatever its section, which may so exceed ``most``.
    """
    pieces: list[tuple[list[str], str]] = []
    for path, content in split_sections(markdown, title):
        run: list[str] = []
        for block in split_blocks(content):
            if tokens(block) <= most:
                run.append(block)
                continue
            pieces += [(path, t) for t in pack(run, "\n\n", most) + split_oversized(block, most)]
            run = []
        pieces += [(path, t) for t in pack(run, "\n\n", most)]
    merged: list[tuple[list[str], str]] = []
    for path, text in pieces:
        text = tidy(text)
        if merged and tokens(text) < least:
            merged[-1] = (merged[-1][0], tidy(merged[-1][1] + "\n\n" + text))
        else:
            merged.append((path, text))
    return merged


def chunk_articles(articles: DataFrame, min_tokens: int = 200, max_tokens: int = 500) -> DataFrame:
    """Chunk rows ``doc_id#0, doc_id#1, ...`` with their article's attributes; missing attributes are null."""
    carried = ["updated_at", "breadcrumbs", "tags", "source", "source_host", "scraped_at", "content_hash"]
    names = [c.split()[0] for c in CHUNK.split(", ")]
    kinds = dict(c.split() for c in CHUNK.split(", "))
    own = articles.select("doc_id", "url", "title", "body_markdown", *[F.col(c) if c in articles.columns else F.lit(None).cast(kinds[c]).alias(c) for c in carried])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a in batch.to_dict("records"):
                for i, (path, text) in enumerate(chunk_text(a["body_markdown"] or "", a["title"] or "", min_tokens, max_tokens)):
                    rows.append({**a, "chunk_id": f"{a['doc_id']}#{i}", "heading_path": path, "section": path[-1], "text": text, "tokens_estimate": tokens(text)})
            yield pd.DataFrame([[r[c] for c in names] for r in rows], columns=names, dtype=object)

    return own.mapInPandas(run, CHUNK)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
