"""Quality rules, line first: bad lines go, then documents that lose too much of their text.

Each line is judged alone by navigation, boilerplate and punctuation rules, in this order. A document is kept if the
lines that pass hold at least `min_kept` percent of its word characters, unless the base rules on words and repetition
fail it.

Each document is judged from its own text, in one pass without a shuffle. Defined results: null, empty and wordless
texts have no words and fail; lines without a word are neither good nor bad; a line is equal to an earlier one if all
its characters are; rows are judged one by one, so repeated rows give repeated results; a very long text is a slice of
its own, judged whole in time and memory linear in it (but for a sort of its windows); an empty table gives no rows;
extra columns pass through, and the columns added win over columns of the same names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.arrays import NOT_SPACE, shingles, slices, words

SYMBOLS = "#*$%&|<>"
# Phrases of page furniture, matched in lower case.
BOILERPLATE = [
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "click here",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "log in to comment",
    "share this article",
    "enable javascript",
    "lorem ipsum",
]

_ADDED = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "n_bad_lines": pa.int64(),
    "kept_chars": pa.int64(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
    "clean_text": pa.string(),
}


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; percentages are of the line's words or characters.

    max_symbols: symbols a hundred words; max_shout: words that end in repeated ! or ?; nav_words, nav_marks: a line of at
    most so many words with at least so many separators is navigation; min_letters: letters or digits among non-blank
    characters; min_kept: word characters that must be left.
    """

    max_symbols: int = 30
    max_shout: int = 50
    nav_words: int = 12
    nav_marks: int = 3
    min_letters: int = 40
    min_kept: int = 50


_BLANK = r"[ \t\x0b\x0c\r]"
_SHOUT = re.compile(rf"[!?]{{2,}}(?:{_BLANK}|$)")
_NAV = re.compile(rf"{_BLANK}[|>»•·/]{_BLANK}")
_MARK = re.compile(r"[^\w \t\x0b\x0c\r]|_")
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)))


def bad_line(line: str, n_words: int, rules: Rules) -> str:
    """The rule a line with words fails, or an empty string."""
    if n_words <= rules.nav_words:
        if len(_NAV.findall(line)) >= rules.nav_marks:
            return "navigation"
        if _BOILER.search(line.lower()):
            return "boilerplate"
    if 100 * sum(map(line.count, SYMBOLS)) > rules.max_symbols * n_words:
        return "symbols"
    if ("!!" in line or "??" in line or "!?" in line or "?!" in line) and 100 * len(_SHOUT.findall(line)) > rules.max_shout * n_words:
        return "shout"
    blank = sum(map(line.count, " \t\r\x0b\x0c"))
    if 100 * len(_MARK.findall(line)) > (100 - rules.min_letters) * (len(line) - blank):
        return "letters"
    return ""


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))


def judge(text: str, n_words: int, n_repeat: int, rules: Rules) -> tuple:
    chars, kept_chars, bad, duplicates = word_chars(text), 0, 0, 0
    seen, good = set(), []
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if not n:
            good.append(line)
            continue
        duplicates += line in seen
        seen.add(line)
        if bad_line(line, n, rules):
            bad += 1
        else:
            kept_chars += word_chars(line)
            good.append(line)
    failed = n_words < 50 or 100 * n_repeat > 50 * n_words
    kept = not failed and 100 * kept_chars >= rules.min_kept * chars
    symbols = sum(map(text.count, SYMBOLS))
    return n_words, chars, symbols, duplicates, n_repeat, bad, kept_chars, failed, kept, "\n".join(good)


def repeated_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of words, and of words in 3-word windows found twice or more in the row."""
    found = words(column, NOT_SPACE)
    n_words = np.diff(found.first)
    out = np.zeros(len(n_words), np.int64)
    keys, begin = shingles(found, 3)
    for row in np.flatnonzero(n_words > 3):
        own = keys[begin[row] : begin[row + 1]]
        order = np.sort(own)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            again = np.isin(own, twice)
            covered = np.zeros(len(own) + 2, dtype=bool)
            for j in range(3):
                covered[j : j + len(own)] |= again
            out[row] = covered.sum()
    return n_words, out


def judge_quality(documents: DataFrame, rules: Rules = Rules(), text: str = "text", with_text: bool = True) -> DataFrame:  # noqa: B008
    """The documents with the counts, the base rules' outcome, the verdict and (with_text) the cleaned text."""
    added = {k: v for k, v in _ADDED.items() if with_text or k != "clean_text"}
    source = documents.select(*(F.col(f"`{c}`") for c in documents.columns if c not in added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            column = part.column(part.schema.get_field_index(text))
            n_words, repeats = repeated_words(column)
            rows = [judge(t or "", n, r, rules) for t, n, r in zip(column.to_pylist(), n_words.tolist(), repeats.tolist(), strict=True)]
            columns = list(zip(*rows, strict=True))[: len(added)]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(columns, added.values(), strict=True))], names=[*part.schema.names, *added])

    kinds = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string"}
    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), *(f"{k} {kinds[v]}" for k, v in added.items())]
    return source.mapInArrow(run, ", ".join(schema))


def oracle_sql(rules: Rules = Rules()) -> str:  # noqa: B008
    """judge_quality(documents, with_text=False) without the text, for DuckDB."""
    blank = r"[ \t\x0B\x0C\r]"
    phrases = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)
    symbols = "length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT rid, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
 grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2)),
 again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
 repeats AS (SELECT rid, count(DISTINCT i + j) AS n FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
 parts AS (SELECT rid, line, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)),
 judged AS (SELECT rid, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
   (n <= {rules.nav_words} AND (len(regexp_extract_all(line, '{blank}[|>»•·/]{blank}')) >= {rules.nav_marks} OR {phrases}))
   OR 100 * ({symbols}) > {rules.max_symbols} * n
   OR 100 * len(regexp_extract_all(line, '[!?]{{2,}}({blank}|$)')) > {rules.max_shout} * n
   OR 100 * length(regexp_replace(line, '[\p{{L}}\p{{N}} \t\x0B\x0C\r]', '', 'g')) > {100 - rules.min_letters} * (length(line) - length(regexp_replace(line, '[^ \t\x0B\x0C\r]', '', 'g'))) AS bad
  FROM parts WHERE n > 0),
 lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, count_if(bad) AS n_bad_lines, sum(CASE WHEN bad THEN 0 ELSE chars END) AS kept_chars FROM judged GROUP BY rid),
 counted AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
   coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(n_bad_lines, 0) AS n_bad_lines, coalesce(kept_chars, 0) AS kept_chars
  FROM d JOIN w USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN lines USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
 CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_bad_lines AS BIGINT) AS n_bad_lines, CAST(kept_chars AS BIGINT) AS kept_chars,
 n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_chars >= {rules.min_kept} * word_chars AS kept
FROM counted
"""
