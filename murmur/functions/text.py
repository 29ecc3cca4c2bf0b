"""Token and n-gram expressions. Regex work runs in the JVM (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns. Both are valid in Java regex and RE2.
# A word is a run of letters, digits or underscore (Python's ``\w`` under
# Unicode). The case-kept tokeniser adds apostrophe tails ('s, 't) and any
# single character that is neither a word character nor whitespace.
WORD_PATTERN = r"[\p{L}\p{N}_]+"
CASED_TOKEN_PATTERN = r"[\p{L}\p{N}_]+|'\p{L}+|[^\p{L}\p{N}_\t\n\x0B\f\r ]"

# The rewrites that part a text into treebank-style tokens, in
# order. Valid in Java regex and RE2 (no look-around); \\1 is the first group.
# First on the text: quotes, marks, brackets and dashes stand alone, but for
# commas and colons between digits.
MARK_STEPS = (
    (r'(^|[\t\n\x0B\f\r (\[{<])"', r"\1 `` "),
    (r"\.\.\.", r" ... "),
    (r"([0-9]),([0-9])", "\\1\x01\\2"), (r"([0-9]),([0-9])", "\\1\x01\\2"),
    (r"([0-9]):([0-9])", "\\1\x02\\2"), (r"([0-9]):([0-9])", "\\1\x02\\2"),
    (r"([,:;@#$%&?!()\[\]{}<>])", r" \1 "),
    ("\x01", ","), ("\x02", ":"),
    (r"--", r" -- "),
    (r'"', r" '' "),
)
# Then on the pieces, two spaces between them: closing quotes, final periods
# (not of words with inner periods), and the parts of contractions.
PART_STEPS = (
    (r"([^ '])' ", r"\1  ' "),
    (r"( [^ .]*[^ .])\. ", r"\1  . "),
    (r"([^ ])([nN]'[tT]) ", r"\1  \2 "),
    (r"([^ '])('(?:[sSmMdD]|ll|LL|re|RE|ve|VE)) ", r"\1  \2 "),
    (r" ([cC]an)([nN]ot) ", r" \1  \2 "), (r" ([gG]on)([nN]a) ", r" \1  \2 "), (r" ([gG]ot)([tT]a) ", r" \1  \2 "),
    (r" ([gG]im)([mM]e) ", r" \1  \2 "), (r" ([lL]em)([mM]e) ", r" \1  \2 "), (r" ([wW]an)([nN]a) ", r" \1  \2 "),
    (r" ([dD])('[yY][eE]) ", r" \1  \2 "), (r" ([mM]ore)('[nN]) ", r" \1  \2 "), (r" ('[tT])([iI]s) ", r" \1  \2 "), (r" ('[tT])([wW]as) ", r" \1  \2 "),
)


#: The same rewrites in fewer passes for Spark: look-around stands for the repeated steps, and steps on a fixed string need no pattern.
_OPENING = r'"(?<=(?:^|[\t\n\x0B\f\r (\[{<])")'
_MARKS = r"[;@#$%&?!()\[\]{}<>]|(?<![0-9])[,:]|[,:](?![0-9])"
# Pieces that PART_STEPS can part: with a single quote, a final period, or one of these words.
_JOINED = ("cannot", "gonna", "gotta", "gimme", "lemme", "wanna")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens_lower(text) -> Column:
    """Lower-cased word tokens; missing text gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(WORD_PATTERN), 0)


def tokens_cased(text) -> Column:
    """Case-kept tokens: words, apostrophe tails and single punctuation marks."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(CASED_TOKEN_PATTERN), 0)


def tokens_parted(text) -> Column:
    """Case-kept treebank-style tokens: "Don't" -> Do, n't; "it's" -> it, 's; cannot -> can, not.

    Quotes become `` and '', marks and brackets stand alone, a period only at
    the end of a word without other periods. Missing text gives an empty
    array. A single quote that opens a word stays with it."""
    return F.filter(F.flatten(F.transform(marked_pieces(text), piece_tokens)), lambda x: x != "")


def marked_pieces(text) -> Column:
    """The first half of ``tokens_parted``: the text cut at blanks, marks and quotes on their own (MARK_STEPS). Some pieces may be empty."""
    marked = F.replace(F.regexp_replace(F.coalesce(_c(text), F.lit("")), _OPENING, " `` "), F.lit("..."), F.lit(" ... "))
    marked = F.replace(F.replace(F.regexp_replace(marked, _MARKS, " $0 "), F.lit("\x01"), F.lit(",")), F.lit("\x02"), F.lit(":"))
    marked = F.replace(F.replace(marked, F.lit("--"), F.lit(" -- ")), F.lit('"'), F.lit(" '' "))
    return F.split(marked, r"[\t\n\x0B\f\r ]+", -1)


def piece_tokens(piece) -> Column:
    """The second half: a piece's tokens (PART_STEPS, run only on pieces that they can part). Some may be empty."""
    x = _c(piece)
    line = F.concat(F.lit(" "), x, F.lit(" "))
    for pattern, to in PART_STEPS:
        line = F.regexp_replace(line, pattern, to.replace("\\1", "$1").replace("\\2", "$2"))
    may_part = F.contains(x, F.lit("'")) | F.endswith(x, F.lit(".")) | (F.octet_length(x).between(5, 6) & F.lower(x).isin(*_JOINED))
    return F.when(may_part, F.split(line, " +", -1)).otherwise(F.array(x))


def ngrams(tokens, n: int) -> Column:
    """Adjacent n-token windows joined by one space; fewer than n tokens -> []."""
    toks = _c(tokens)
    if n == 1:
        return toks
    return F.transform(F.slice(toks, 1, F.greatest(F.size(toks) - (n - 1), F.lit(0))),
                       lambda t, i: F.concat_ws(" ", t, *[F.get(toks, i + j) for j in range(1, n)]))
