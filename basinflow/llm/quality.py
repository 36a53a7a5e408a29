"""Quality rules from within-text repetition, found with a suffix array over each text's words.

Defined cases: a null or word-less text has no words and fails; repeated rows get equal rows; a null doc_id is carried along.
Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from basinflow.llm.common import by_text
from basinflow.llm.suffix import covered, longest_repeats

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS, REPEATED_PERCENT = 8, 20, 30
#: The verdict of the method: the largest share of a text's characters in words under repeats, and the longest repeat, in words and as a share.
COVERED_LIMIT, LONGEST_WORDS, LONGEST_SHARE = 0.20, 50, 0.15
FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_fraction double, longest_repeat long"
)


def measure(text: str | None) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    chars = len(raw.translate(None, SPACES).decode())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ids: dict[bytes, int] = {}
    longest = longest_repeats(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n))
    under = covered(longest, WINDOW)
    repeated = int(under.sum())
    most = int(longest.max(initial=0))
    failed = n < LEAST_WORDS or 100 * repeated > REPEATED_PERCENT * n
    share = len(b"".join([w for w, u in zip(words, under.tolist()) if u]).decode()) / chars if repeated else 0.0
    kept = not failed and share <= COVERED_LIMIT and (most < LONGEST_WORDS or most <= LONGEST_SHARE * n)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, failed, kept, share, most


def repetition_quality(docs: DataFrame) -> DataFrame:
    """Counts, base rule and verdict of every whole text; one pass, no shuffle."""
    return by_text(docs, lambda: measure, FIELDS)


def op3_suffix_quality(spark, sf_dir):
    from basinflow.llm.common import table

    return repetition_quality(table(spark, sf_dir, "documents"))
