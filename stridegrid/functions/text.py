"""Prompts, names and time labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stridegrid.functions.numbers import finite, let, round_half_up


def _unique_ignoring_case(words: Column, most: int) -> Column:
    """The first ``most`` words that differ ignoring case, each as first written."""
    keys = F.slice(F.array_distinct(F.transform(words, F.lower)), 1, most)
    return let(
        words,
        lambda ws: F.transform(
            keys, lambda k: F.get(F.filter(ws, lambda w: F.lower(w) == k), F.lit(0))
        ),
    )


def split_prompts(text: Column, most: int = 8) -> Column:
    """Prompts split on ``, ; |``, trimmed, unique ignoring case, default person."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), "[,;|]"), _strip)
    unique = _unique_ignoring_case(F.filter(items, lambda p: p != ""), most)
    return F.when(F.size(unique) == 0, F.array(F.lit("person"))).otherwise(unique)


_SPACES = " \t\n\x0b\f\r"


def _strip(p: Column) -> Column:
    """Without white space at both ends, as the pattern ``^\\s+|\\s+$`` takes it: also before a last line separator.

    Only the ends are looked at; a pattern is tried at every character.
    """
    head = F.ltrim(p, F.lit(_SPACES))
    last = F.right(head, F.lit(1))
    rest = F.rtrim(F.substring(head, F.lit(1), F.char_length(head) - 1), F.lit(_SPACES))
    return F.when(last.isin("\x85", "\u2028", "\u2029"), F.concat(rest, last)).otherwise(F.rtrim(head, F.lit(_SPACES)))


def canonical_prompts(prompts: Column, most: int = 8) -> Column:
    """Canonical spelling of "only" prompts, unique, default person."""
    # Spellings and the prompt they stand for.
    spellings = {
        "hand only": "hand", "only hand": "hand", "just hand": "hand",
        "person only": "person", "only person": "person", "just person": "person",
        "main": "hand", "la main": "hand",
    }

    def canonical(p: Column) -> Column:
        expr = p
        for text, to in reversed(spellings.items()):
            expr = F.when(F.lower(p) == text, to).otherwise(expr)
        return expr

    items = F.transform(F.filter(F.transform(prompts, _strip), lambda p: p != ""), canonical)
    unique = _unique_ignoring_case(items, most)
    return F.when(F.size(unique) == 0, F.array(F.lit("person"))).otherwise(unique)


def simplify_chain(prompt: Column) -> Column:
    """Prompt variants, each cut at the right-most clause word, ending in person."""
    # Words that open a clause.
    clause_words = (
        "with", "holding", "carrying", "wearing", "in", "on", "near", "behind", "beside",
        "that", "who", "having", "and",
    )
    base = F.regexp_replace(_strip(F.coalesce(prompt, F.lit(""))), r"\s+", " ")

    def variants(tokens: Column) -> Column:
        bare = lambda w: F.regexp_replace(F.lower(w), "^[,.;]+|[,.;]+$", "")
        opens = F.transform(
            tokens, lambda w, i: F.when((i > 0) & bare(w).isin(*clause_words), i)
        )
        cuts = F.reverse(F.filter(opens, lambda i: i.isNotNull()))
        shorter = F.transform(cuts, lambda i: F.array_join(F.slice(tokens, 1, i), " "))
        return F.array_distinct(F.concat(F.array(F.array_join(tokens, " ")), shorter))

    def ending_in_person(chain: Column) -> Column:
        has = F.exists(chain, lambda v: F.lower(v) == "person")
        return F.when(has, chain).otherwise(F.concat(chain, F.array(F.lit("person"))))

    chain = let(let(F.split(base, " "), variants), ending_in_person)
    return F.when(base == "", F.array(F.lit("person"))).otherwise(chain)


def safe_token(text: Column) -> Column:
    """Runs of other characters and of underscores as one underscore, none at the ends."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9-]+"), lambda w: w != "")
    return let(F.array_join(words, "_"), lambda t: F.when(t == "", "run").otherwise(t))


def safe_file_name(text: Column, fallback: str = "export") -> Column:
    # as much of the text as gives 120 characters
    begin = F.regexp_extract(text, r"^(?:[a-zA-Z0-9._-]|[^a-zA-Z0-9._-]++){0,120}", 0)
    name = F.regexp_replace(begin, r"[^a-zA-Z0-9._-]+", "_")
    return F.coalesce(F.nullif(name, F.lit("")), F.when(text.isNotNull(), F.lit(fallback)))


def valid_run_id(run_id: Column) -> Column:
    """The trimmed id, null where empty or holding a path separator or NUL."""
    rid = _strip(run_id)
    bad = (
        (rid == "") | run_id.contains("/") | run_id.contains("\\") | run_id.contains("\0")
    )
    return F.when(~bad, rid)


def format_timecode(seconds: Column) -> Column:
    safe = F.when(finite(seconds) & (seconds > 0), seconds).otherwise(0.0)
    minutes = F.floor(safe / 60.0)
    return F.concat(
        minutes.cast("string"), F.lit(":"), F.format_string("%05.2f", safe - minutes * 60)
    )


def timestamp_ms(frame: Column, fps: Column) -> Column:
    return round_half_up(frame / F.greatest(F.lit(1.0), fps) * 1000.0)


def duration_label(frames: Column, fps: Column) -> Column:
    total = F.when(fps > 0, frames / fps)
    s = round_half_up(total)
    h, m, sec = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))

    def unit(v: Column, name: str) -> Column:
        return F.concat(v.cast("string"), F.lit(name))

    label = (
        F.when(h > 0, F.concat(unit(h, "h"), F.when(m > 0, unit(m, "min")).otherwise("")))
        .when(m > 0, F.concat(unit(m, "min"), F.when(sec > 0, unit(sec, "s")).otherwise("")))
        .otherwise(unit(sec, "s"))
    )
    return F.when(F.coalesce(finite(total) & (total > 0), F.lit(False)), label).otherwise("")


def csv_number(v: Column) -> Column:
    """Plain number with at most six decimals, empty where missing."""
    whole = v == F.floor(v)
    fixed = F.regexp_replace(F.format_string("%.6f", v), r"0+$", "")
    trimmed = F.regexp_replace(fixed, r"\.$", "")
    return F.when(
        F.coalesce(finite(v), F.lit(False)),
        F.when(whole, F.format_string("%.0f", v)).otherwise(trimmed),
    ).otherwise("")


def parse_crop(text: Column) -> list[Column]:
    """``"x,y,w,h"`` fractions kept inside the frame; null for the full frame."""
    parts = F.split(text, ",")
    v = [F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in range(4)]
    ok = F.size(parts) == 4
    for c in v:
        ok = ok & F.coalesce(finite(c), F.lit(False))
    x = F.least(F.greatest(v[0], F.lit(0.0)), F.lit(0.98))
    y = F.least(F.greatest(v[1], F.lit(0.0)), F.lit(0.98))
    w = F.least(F.greatest(v[2], F.lit(0.05)), 1.0 - x)
    h = F.least(F.greatest(v[3], F.lit(0.05)), 1.0 - y)
    full = (x < 0.001) & (y < 0.001) & (w > 0.999) & (h > 0.999)
    return [F.when(ok & ~full, c) for c in (x, y, w, h)]
