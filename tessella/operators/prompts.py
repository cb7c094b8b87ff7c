"""Prompt columns. The wording is this library's own; structure and cuts are the rules'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import values as v
from tessella.functions.text import splitlines, strip

OVERVIEW_HEAD = "Explain this project to a reader who does not program. Its files follow.\n\n"
OVERVIEW_TAIL = '\n\nAnswer with one JSON object: {"summary": "", "description": "", "files": [{"path": "", "role": "", "importance": "high|medium|low"}], "how_to_run": [""], "quick_tips": [""]}'
ANNOTATE_HEAD = "Explain this {language} file line by line in plain words.\n\n```{language}\n"
ANNOTATE_TAIL = '\n\nAnswer with a JSON array: [{"line_start": 1, "line_end": 1, "annotation": ""}]. Lines count from 1.'
CUT = "\n... (truncated)"


def section(most: int = v.PROMPT_PREVIEW_CHARS) -> Column:
    """One file's part of an overview prompt."""
    text = strip(F.coalesce(F.col("preview"), F.lit("")))
    head = F.concat(F.lit("### "), F.col("path"), F.lit(" ("), F.col("language"), F.lit(", "), F.col("size").cast("string"), F.lit(" bytes)\n"))
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(CUT))).otherwise(text)
    return F.concat(head, F.when(text == "", F.lit("(empty)")).otherwise(F.concat(F.lit("```\n"), cut, F.lit("\n```"))))


def overview_prompts(files: DataFrame, most: int = v.PROMPT_PREVIEW_CHARS) -> DataFrame:
    """project, prompt from ranked files. The cap on files bounds a project's row."""
    sections = F.array_sort(F.collect_list(F.struct("rank", section(most).alias("section"))))
    body = F.array_join(F.transform(sections, lambda x: x["section"]), "\n\n")
    return files.groupBy("project").agg(F.concat(F.lit(OVERVIEW_HEAD), body, F.lit(OVERVIEW_TAIL)).alias("prompt"))


def annotation_prompt(code: str = "content", language: str = "language", most: int = v.ANNOTATED_LINES) -> Column:
    """The first lines of a file; a longer file's note says how many lines it has."""
    lines = splitlines(code)
    long = F.size(lines) > most
    shown = F.when(long, F.array_join(F.slice(lines, 1, most), "\n")).otherwise(F.col(code))
    note = F.when(long, F.concat(F.lit("\n\n(The file has "), F.size(lines).cast("string"), F.lit(f" lines; the first {most} are shown.)"))).otherwise(F.lit(""))
    head = F.replace(F.lit(ANNOTATE_HEAD), F.lit("{language}"), F.col(language))
    return F.concat(head, shown, F.lit("\n```"), note, F.lit(ANNOTATE_TAIL))
