"""Line-first cleaning: rules judge single lines, then the document by what is left.

A line with words fails
* the punctuation rule when it neither ends like a sentence nor is long enough to be
  prose that was wrapped, or when symbols stand at a large share of its words,
* the navigation rule when separators cut it into short items, or arrows lead it,
* the boilerplate rule when it is short and holds a stock phrase.
Lines that fail are removed. A document is rejected when it loses more than a share
of its words, or when the document-wide counts fail.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from occuspan.llm.common import add_text_columns

MOST_LOST = 0.5
WRAPPED_WORDS = 8
MOST_SYMBOLS = 0.3
SHORT_LINE_WORDS = 30
ITEM_WORDS = 4
MIN_WORDS = 50
MOST_REPEATED = 0.5
# Ends of sentences, separators of menus, phrases of page furniture.
SENTENCE_END = tuple(x.encode() for x in (".", "!", "?", "…", "。", "！", "？", ":", ";", '"', "”", "»", "'", "’", ")", "]"))
SEPARATORS = re.compile("[|»›•·>]")
LEADS = ("»", "›", "«", "‹", "←", "→", ">>", "<<")
PHRASES = (
    "accept cookies", "all rights reserved", "back to top", "click here", "contact us", "cookie policy", "enable javascript",
    "follow us on", "forgot password", "log in", "lorem ipsum", "privacy policy", "read more", "share this", "sign in", "sign up",
    "skip to content", "subscribe to our newsletter", "terms and conditions", "terms of service", "terms of use", "use of cookies",
)
BOILERPLATE = re.compile("|".join(rf"\b{re.escape(p)}\b" for p in PHRASES))
SYMBOLS = re.compile(rb"[#*$%&|<>]")
CONTINUED = bytes(range(0x80, 0xC0))


def line_fails(line: bytes, n_words: int) -> str | None:
    """The first rule that a line with words fails."""
    bare = line.strip()
    if n_words < WRAPPED_WORDS and not bare.endswith(SENTENCE_END):
        return "punctuation"
    if len(SYMBOLS.findall(line)) > MOST_SYMBOLS * n_words + 1:
        return "punctuation"
    text = bare.decode("utf-8", "replace")
    items = SEPARATORS.split(text)
    if text.startswith(LEADS) or (len(items) >= 3 and n_words <= ITEM_WORDS * len(items)):
        return "navigation"
    if n_words <= SHORT_LINE_WORDS and BOILERPLATE.search(text.lower()):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    k = len(number)
    windows = [(a * k + b) * k + c for a, b, c in zip(ids, ids[1:], ids[2:])]
    if len(set(windows)) == n - 2:
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def judge(data: bytes, most_lost: float) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words, cleaned."""
    lines = data.split(b"\n")
    words, seen, left = [], set(), []
    duplicates = lost = 0
    for line in lines:
        own = line.split()
        if not own:
            left.append(line)
            continue
        words += own
        duplicates += line in seen
        seen.add(line)
        if line_fails(line, len(own)):
            lost += len(own)
        else:
            left.append(line)
    n = len(words)
    joined = b"".join(words)
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or repeats > MOST_REPEATED * n
    kept = not failed and lost <= most_lost * n
    chars = len(joined.translate(None, CONTINUED))
    return n, chars, len(SYMBOLS.findall(data)), duplicates, repeats, failed, kept, lost, b"\n".join(left).decode("utf-8", "replace")


FIELDS = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("base_failed", "boolean"), ("kept", "boolean"), ("n_removed_words", "long"), ("cleaned", "string"),
]


def clean_documents(docs: DataFrame, most_lost: float = MOST_LOST, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each document with its counts, the verdict and the text its good lines leave.

    No row is shuffled or left out. A null or empty text has no words and fails; a
    line of blanks is no line with words, stays, and loses nothing. Repeated rows are
    judged alike. Input columns named like a result give way. An empty table gives an
    empty table.
    """

    def make():
        def work(texts: list[bytes]) -> list:
            made = [judge(t, most_lost) for t in texts]
            return [list(c) for c in zip(*made, strict=True)] if made else [[] for _ in FIELDS]

        return work

    return add_text_columns(docs, make, FIELDS, keep, text)
