"""Quality rules as weak supervision.

Each rule looks at one document and votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the
histogram of vote patterns (at most 3**rules rows, however large the corpus) estimates for each rule how often its
vote is right in either class, without labels; the posterior probability of good quality then decides.

Defined cases: a null or wordless text has no words, every ratio is 0 and the base rules fail it; a null id is kept as
null; repeated rows are judged alike and each returned; a very long text is judged whole, by one task; an empty table gives an empty result; columns of docs other
than the text never matter, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import add_column, fresh
from .shared import small_batches
from .tokens import PIECE, covered, per_text, span_hashes, text_buffer, window_starts, windows, words

#: What counts as a symbol, and frequent function words of English, German, French and Spanish.
SYMBOLS = "#*$%&|<>"
COMMON = "the of and to in is that for with der die und das ist von mit den le la les de et des un une que el los y en con para del"
#: Code points of the short words that prose in any language has many of.
SHORT = 3
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Posterior from which a document stays: losing a good one costs more than keeping a bad one.
KEEP_AT = 0.2

FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_bare", "n_common", "n_short", "n_ended", "n_adjacent"]
FEATURE_TYPE = T.StructType([T.StructField(n, T.LongType()) for n in FEATURES])


def _flag(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int8)
    table[list(chars.encode())] = 1
    return table


_ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(key: np.ndarray, doc: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values that belong to texts: which repeat an earlier one of the same text, and which occur twice or more in it."""
    both = key ^ (doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(both, kind="stable")
    same = np.zeros(len(key), dtype=bool)
    a, b = order[:-1], order[1:]
    same[1:] = (both[a] == both[b]) & (doc[a] == doc[b]) & (check[a] == check[b])
    later = np.zeros(len(key), dtype=bool)
    later[order] = same
    twice = later.copy()
    twice[order[:-1]] |= same[1:]
    return later, twice


def features(column: pa.Array) -> pa.Array:
    """The counts that the rules look at, for each text of a column."""
    buf, offsets = text_buffer(column)
    starts, ends, first = words(buf, offsets)
    n, h = len(offsets) - 1, span_hashes(buf, starts, ends)
    lead = (buf & 0xC0) != 0x80
    space = _flag(" \t\n\v\f\r")[buf].astype(bool)
    letter = _flag(_ALNUM)[buf].astype(bool) | (buf >= 0xC3)
    upper = _flag("ABCDEFGHIJKLMNOPQRSTUVWXYZ")[buf]
    out = {"n_words": np.diff(first), "word_chars": _per_doc(lead & ~space, offsets), "n_symbols": _per_doc(_flag(SYMBOLS)[buf], offsets), "n_letters": _per_doc(letter & lead, offsets), "n_upper": _per_doc(upper, offsets)}

    letters = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(letter, out=letters[1:])
    out["n_bare"] = per_text((letters[ends] == letters[starts]).astype(np.int64), first)
    known = np.frombuffer(COMMON.encode(), np.uint8)
    known_starts, known_ends, _ = words(known, np.array([0, len(known)]))
    out["n_common"] = per_text(np.isin(h, span_hashes(known, known_starts, known_ends)).astype(np.int64), first)

    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=points[1:])
    out["n_short"] = per_text((points[ends] - points[starts] <= SHORT).astype(np.int64), first)

    pair, _ = window_starts(first, 2)
    same = np.zeros(len(h), np.int64)
    same[pair + 1] = h[pair] == h[pair + 1]
    out["n_adjacent"] = per_text(same, first)
    at, doc = window_starts(first, REPEAT_WINDOW)
    if len(at):
        _, twice = _repeats(windows(h, REPEAT_WINDOW)[at], doc, windows(h, REPEAT_WINDOW, 1)[at])
        out["n_repeat_words"] = per_text(covered(at[twice], REPEAT_WINDOW, len(h)).astype(np.int64), first)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)

    # A line runs from a text's start or a line feed to the next line feed or the text's end.
    feeds = np.flatnonzero(buf == 10)
    counts = _per_doc(buf == 10, offsets) + 1
    line_doc = np.repeat(np.arange(n), counts)
    own = np.cumsum(counts) - counts
    begin = np.empty(len(line_doc), np.int64)
    begin[own] = offsets[:-1]
    rest = np.ones(len(line_doc), dtype=bool)
    rest[own] = False
    begin[rest] = feeds + 1
    end = np.empty(len(line_doc), np.int64)
    if n:
        last = np.cumsum(counts) - 1
        inner = np.ones(len(line_doc), dtype=bool)
        inner[last] = False
        end[last] = offsets[1:]
        end[inner] = feeds
    used = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~space, out=used[1:])
    full = used[end] > used[begin]
    begin, end, line_doc = begin[full], end[full], line_doc[full]
    later, _ = _repeats(span_hashes(buf, begin, end), line_doc, span_hashes(buf, begin, end, 1))
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n)
    # The line's last word byte: the last word that starts before the line's end.
    tail = buf[ends[np.searchsorted(starts, end) - 1] - 1] if len(end) else np.zeros(0, np.uint8)
    out["n_ended"] = np.bincount(line_doc[_flag(".!?\"'")[tail].astype(bool)], minlength=n)
    return pa.StructArray.from_arrays([pa.array(out[k].astype(np.int64)) for k in FEATURES], names=FEATURES)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("byte")


def rule_votes(q) -> dict[str, Column]:
    """The votes, from a function that gives a feature's column. Each rule has a wide band in which it abstains."""
    w, chars, letters, lines = (F.greatest(q(x), F.lit(1)) for x in ("n_words", "word_chars", "n_letters", "n_lines"))
    enough = q("n_words") >= MIN_WORDS
    return {
        "length": _vote(q("n_words") >= 40, q("n_words") < MIN_WORDS),
        "word_length": _vote((q("word_chars") >= 3 * w) & (q("word_chars") <= 9 * w), (q("word_chars") > 15 * w) | (q("word_chars") < 2 * w)),
        "symbols": _vote(q("n_symbols") * 100 <= chars, q("n_symbols") * 10 >= chars),
        "repeat_words": _vote(q("n_repeat_words") * 10 <= w, q("n_repeat_words") * 100 > MAX_REPEAT_PERCENT * w),
        "adjacent_words": _vote(q("n_adjacent") * 20 <= w, q("n_adjacent") * 5 >= w),
        "repeat_lines": _vote((q("n_dup_lines") == 0) & (lines > 2), (lines >= 5) & (q("n_dup_lines") * 2 > lines)),
        "upper_case": _vote(q("n_upper") * 5 <= letters, q("n_upper") * 2 >= letters),
        "bare_tokens": _vote(q("n_bare") * 50 <= w, q("n_bare") * 5 >= w),
        # Prose of other languages has short words instead: the rule abstains.
        "common_words": _vote(enough & (q("n_common") * 20 >= w), enough & (q("n_common") * 100 <= w) & (q("n_short") * 10 < w)),
        "sentences": _vote(q("n_ended") * 2 >= lines, enough & (q("n_ended") == 0)),
    }


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> dict:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) with their counts.

    A voting rule is right with one probability among good texts and another among bad ones; abstaining tells nothing.
    The start states what rules are for: a bad vote is rare among good texts (2 %), a good vote common among bad ones.
    Beta priors worth PRIOR votes keep the classes from changing places where votes are few. No rows: the start stays.
    """
    rules = patterns.shape[1]
    right_good, right_bad, share = np.full(rules, 0.98), np.full(rules, 0.3), 0.85
    prior = 20.0
    for _ in range(rounds if len(counts) else 0):
        odds = posterior_log_odds(patterns, right_good, right_bad, share)
        good = counts / (1 + np.exp(-np.clip(odds, -500, 500)))
        bad = counts - good
        new_share = float(np.clip((good.sum() + 0.85 * prior) / (counts.sum() + prior), 0.05, 0.99))
        a = ((patterns == 1).T @ good + 0.98 * prior) / ((patterns != 0).T @ good + prior)
        b = ((patterns == -1).T @ bad + 0.3 * prior) / ((patterns != 0).T @ bad + prior)
        moved = max(np.abs(a - right_good).max(), np.abs(b - right_bad).max(), abs(new_share - share))
        right_good, right_bad, share = a, b, new_share
        if moved < 1e-9:
            break
    return {"right_good": np.clip(right_good, 1e-4, 1 - 1e-4), "right_bad": np.clip(right_bad, 1e-4, 1 - 1e-4), "share": share}


def posterior_log_odds(patterns, right_good, right_bad, share):
    yes = np.log(right_good / (1 - right_bad))
    no = np.log((1 - right_good) / right_bad)
    return math.log(share / (1 - share)) + (patterns == 1) @ yes + (patterns == -1) @ no


def label_model(featured: DataFrame, q) -> tuple[list[str], dict]:
    """Fit on every row: only the histogram of patterns, bounded by 3**rules, comes to the driver."""
    votes = rule_votes(q)
    rows = featured.groupBy(*[v.alias(k) for k, v in votes.items()]).count().collect()
    rows.sort(key=tuple)
    patterns = np.array([list(r)[:-1] for r in rows], np.int64).reshape(-1, len(votes))
    return list(votes), fit_label_model(patterns, np.array([r["count"] for r in rows], np.float64))


def _posterior(q, names: list[str], model: dict) -> Column:
    votes, odds = rule_votes(q), F.lit(math.log(model["share"] / (1 - model["share"])))
    for k, name in enumerate(names):
        a, b = model["right_good"][k], model["right_bad"][k]
        odds = odds + F.when(votes[name] == 1, float(np.log(a / (1 - b)))).when(votes[name] == -1, float(np.log((1 - a) / b))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def base_failed(q) -> Column:
    return (q("n_words") < MIN_WORDS) | (100 * q("n_repeat_words") > MAX_REPEAT_PERCENT * q("n_words"))


def with_quality(docs: DataFrame, text: str = "text", keep_at: float = KEEP_AT) -> tuple[DataFrame, str]:
    """docs and a struct column (its name is returned): features, votes, posterior, base_failed and kept.

    Two passes over the texts: one gathers the histogram of votes, one scores; no text is shuffled.
    """
    small_batches(docs.sparkSession)
    only = docs.select(F.col(text).alias("text"))
    make = lambda piece: features(piece.column(piece.schema.get_field_index("text")))
    names, model = label_model(add_column(only, "q", FEATURE_TYPE, "text", make, PIECE), lambda k: F.col("q")[k])
    raw, name = fresh(docs.columns, "features"), fresh(docs.columns, "quality")
    own = lambda piece: features(piece.column(piece.schema.get_field_index(text)))
    q = lambda k: F.col(raw)[k]
    scored = add_column(docs, raw, FEATURE_TYPE, text, own, PIECE)
    probability = _posterior(q, names, model)
    votes = F.array(*rule_votes(q).values())
    result = F.struct(*[q(k).alias(k) for k in FEATURES], votes.alias("votes"), probability.alias("posterior"), base_failed(q).alias("base_failed"), (~base_failed(q) & (probability >= keep_at)).alias("kept"))
    return scored.withColumn(name, result).drop(raw), name


def filter_quality(docs: DataFrame, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that neither the base rules nor the posterior reject, with their own columns."""
    scored, name = with_quality(docs, text, keep_at)
    return scored.where(F.col(name)["kept"]).drop(name)
