"""Line-first cleaning.

Each line is judged on its own: lines without words go; a line goes for
missing punctuation (many words and no sentence end), for navigation (short
entries between separators), for boilerplate (fixed phrases) and for being a
symbol or capitals run. What is left is the cleaned text. A document is kept
if its rules on the whole hold (base) and it loses at most a share of its words.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, table

SYMBOLS = "#*$%&|<>"
MOST_LOST = 0.5
#: Fixed phrases of boilerplate lines.
BOILERPLATE = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|enable javascript"
    r"|subscribe to our newsletter|sign up for|log ?in to|click here|read more|share this|follow us on|skip to (?:main )?content|back to top|lorem ipsum",
    re.IGNORECASE,
)
MARKS = re.compile("[.!?:;,…\"'”’)。！？、،؟।]")
LETTER = re.compile(r"[^\W\d_]")


def line_verdict(line: str, words: list[bytes]) -> str:
    """'' for a line to keep, else the rule that removes it: empty, navigation, symbols, capitals, boilerplate or punctuation.

    words: the line's words as UTF-8.
    """
    n = len(words)
    if not n:
        return "empty"
    bars = sum(w in (b"|", b"\xc2\xbb", b"\xe2\x80\xba", b">", b"\xe2\x80\xa2", b"\xc2\xb7") for w in words)
    if bars >= 2 and 4 * bars >= n:
        return "navigation"
    symbols = sum(map(line.count, SYMBOLS))
    if 2 * symbols > n and 10 * symbols > len(line):
        return "symbols"
    if n >= 5 and line.count("!") * 2 > n and line.isupper():
        return "capitals"
    if len(line) <= 300 and BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 30 and not MARKS.search(line):
        return "punctuation"
    if not LETTER.search(line):
        return "symbols"
    return ""


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words inside of windows that are found twice or more, the first included."""
    n = len(words)
    if n <= window:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: n - window + 1].tolist()
    spans = [joined[a:b] for a, b in zip(starts, (ends[window - 1 :] - 1).tolist(), strict=True)]
    if len(set(spans)) == len(spans):
        return 0
    first: dict[bytes, int] = {}
    twice = np.zeros(n + 1, np.int64)
    marked = set()
    for i, span in enumerate(spans):
        j = first.setdefault(span, i)
        if j != i:
            for k in (i, j) if j not in marked else (i,):
                twice[k] += 1
                twice[min(k + window, n)] -= 1
            marked.add(j)
    return int((np.cumsum(twice[:n]) > 0).sum())


def clean_documents(docs: DataFrame, most_lost: float = MOST_LOST, with_text: bool = True) -> DataFrame:
    """A row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed, n_words_removed and, with_text, cleaned.

    Null and empty texts have zero words, so their base fails. Repeated rows and
    rows with a null doc_id are each judged. Other columns are ignored. An empty
    table gives no rows. A repeated line is removed at its second and later places.
    """
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, n_words_removed long" + ", cleaned string" * with_text
    names = [c.split()[0] for c in schema.split(", ")]

    def one(doc_id, text):
        words = text.encode().split()
        n = len(words)
        seen, dup, lost, removed, left = set(), 0, 0, 0, []
        for line in text.split("\n"):
            own = line.encode().split()
            verdict = line_verdict(line, own)
            if own:
                if line in seen:
                    dup += 1
                    verdict = verdict or "repeated"
                seen.add(line)
            if verdict:
                removed += 1
                lost += len(own)
            elif with_text:
                left.append(line)
        repeat = repeated_words(words)
        failed = n < 20 or 100 * repeat > 30 * n
        chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
        return (doc_id, n, chars, sum(map(text.count, SYMBOLS)), dup, repeat, failed, not failed and lost <= most_lost * n, removed, lost, *["\n".join(left)] * with_text)

    def run(batches):
        for batch in batches:
            if batch["doc_id"]:
                yield dict(zip(names, map(list, zip(*map(one, batch["doc_id"], batch["text"]), strict=True)), strict=True))

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")), run, schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_documents(table(spark, sf_dir, "documents"), with_text=False)
